"""Continuous training parameters: candidates around what was tried, scored by all past samples.

An action space has templates, points on a few axes. Candidates are the
templates, changed copies of the best samples, and points spread evenly over
the box; their number is a parameter. Samples can be as many as the search
has edges: each pass over them scores a block of candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Candidates spread over the box, kernel width, weights of exploration and of epochs, price of distance.
SPREAD, WIDTH, EXPLORE, EPOCH_COST, FAR = 32, 0.35, 0.15, 0.02, 0.25
BEST = 5
_PRIMES = (2, 3, 5, 7, 11, 13, 17, 19)
#: Templates of one action space at most; they are part of the plan.
MOST_TEMPLATES = 1000


@dataclass(frozen=True)
class Axis:
    """A parameter: limits of its range, whether it must be positive and counts by its logarithm, digits that tell values apart."""

    name: str
    least: float = 0.0
    most: float = math.inf
    positive: bool = False
    log: bool = False
    digits: int = 6


# The axes of a training run.
RATE, REPLAY, EPOCHS = (
    Axis("learning_rate", 1e-12, positive=True, log=True, digits=12), Axis("replay_sample_ratio", most=1.0), Axis("num_train_epochs", 0.1, positive=True),
)
AXES = (RATE, REPLAY, EPOCHS)
# Changes of a good sample, (name, axis, factor, shift).
CHANGES = (
    ("history_exact", "", 1.0, 0.0),
    ("history_lr_down", "learning_rate", 0.9, 0.0),
    ("history_lr_up", "learning_rate", 1.1, 0.0),
    ("history_replay_up", "replay_sample_ratio", 1.0, 0.05),
    ("history_replay_down", "replay_sample_ratio", 1.0, -0.05),
    ("history_epochs_up", "num_train_epochs", 1.0, 0.25),
    ("history_epochs_down", "num_train_epochs", 1.0, -0.25),
)

Box = dict[str, tuple[float, float]]


def halton(index: int, base: int) -> float:
    """The index-th point of the van der Corput sequence."""
    out, scale = 0.0, 1.0
    while index > 0:
        scale /= base
        index, digit = divmod(index, base)
        out += digit * scale
    return out


def _log(value: float) -> float:
    return math.log(max(value, 1e-12))


def usable(rows: DataFrame, axes: tuple[Axis, ...] = AXES) -> DataFrame:
    """Rows with a number on every axis, above zero where that must be; shares are held within their limits."""
    good = reduce(lambda a, b: a & b, [F.col(a.name).isNotNull() & ~F.isnan(a.name) & ((F.col(a.name) > 0) if a.positive else F.lit(True)) for a in axes])
    shares = {a.name: F.least(F.lit(a.most), F.greatest(F.lit(a.least), F.col(a.name))) for a in axes if not a.positive}
    return rows.where(good).withColumns(shares)


def box(templates: DataFrame, axes: tuple[Axis, ...] = AXES) -> Box:
    """The range of the templates on each axis; one value alone gets a fifth of room to both sides."""
    r = templates.agg(*[f(F.col(a.name).cast("double")).alias(f"{a.name}_{k}") for a in axes for k, f in (("low", F.min), ("high", F.max))]).first()
    out = {}
    for a in axes:
        low, high = r[f"{a.name}_low"], r[f"{a.name}_high"]
        if low is None:
            raise ValueError("an action space without a usable template")
        if abs(high - low) <= 1e-12:
            low, high = low * 0.8, high * 1.2
        low = max(a.least, low)
        out[a.name] = (low, max(low, min(a.most, high)))
    return out


def scaled(axis: Axis, bounds: Box, value: Column | None = None) -> Column:
    """A value's place in its range, 0 to 1."""
    low, high = bounds[axis.name]
    value = F.col(axis.name) if value is None else value
    if axis.log:
        low, high, value = _log(low), _log(high), F.ln(F.greatest(value, F.lit(1e-12)))
    if abs(high - low) <= 1e-12:
        return F.lit(0.5)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))


def nearest_template(templates: DataFrame, bounds: Box, default: Column, axes: tuple[Axis, ...] = AXES) -> Column:
    """The ``action_key`` of the template nearest to a row in the scaled box; the first by ``position`` on ties."""
    rows = templates.select("position", "action_key", *[scaled(a, bounds).alias(f"s_{a.name}") for a in axes]).limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    if not rows:
        return default
    here = [scaled(a, bounds) for a in axes]
    far = [sum((h - F.lit(float(r[f"s_{a.name}"]))) * (h - F.lit(float(r[f"s_{a.name}"]))) for h, a in zip(here, axes, strict=True)) for r in rows]
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(r.position).alias("p"), F.lit(r.action_key).alias("k")) for d, r in zip(far, rows, strict=True)]))["k"]


def candidates(templates: DataFrame, samples: DataFrame, default: str, round_id: int = 0, spread: int = SPREAD, axes: tuple[Axis, ...] = AXES) -> DataFrame:
    """Distinct candidates: candidate_id, action_key, the axes, their scaled values ``s_<axis>``, generation.

    ``templates``: (action_key, position, axes); ``samples``: (seq, action_key,
    axes, reward). First the templates, then :data:`CHANGES` of the best
    samples (earlier ones on ties), then points spread over the box, from
    number ``round_id`` + 1 on; the latter two belong to the nearest template.
    Values are held in the box; of equal ones the first stays.
    """
    spark = templates.sparkSession
    templates, samples = usable(templates, axes), usable(samples, axes).where(F.col("reward").isNotNull())
    bounds = box(templates, axes)
    names = [a.name for a in axes]
    anchors = templates.select(F.lit(0).alias("tier"), F.col("position").cast("long").alias("place"), "action_key", *names, F.lit("template_anchor").alias("generation"))
    best = samples.orderBy(F.col("reward").desc(), "seq").limit(BEST).withColumn("rank", F.row_number().over(Window.orderBy(F.col("reward").desc(), "seq")))
    forms = [
        F.struct(F.lit(i).alias("i"), F.lit(g).alias("generation"), *[(F.col(n) * f + s if n == axis else F.col(n)).cast("double").alias(n) for n in names])
        for i, (g, axis, f, s) in enumerate(CHANGES)
    ]
    near = lambda otherwise: nearest_template(templates, bounds, otherwise, axes)
    history = best.select("rank", F.col("action_key").alias("own"), F.explode(F.array(*forms)).alias("f")).select("rank", "own", "f.*")
    history = history.select(F.lit(1).alias("tier"), (F.col("rank") * len(CHANGES) + F.col("i")).cast("long").alias("place"), near(F.col("own")).alias("action_key"), *names, "generation")
    points = []
    for i in range(1, spread + 1):
        at = []
        for a, p in zip(axes, _PRIMES, strict=False):
            (low, high), u = bounds[a.name], halton(max(1, i + max(0, round_id)), p)
            at.append(math.exp(_log(low) + u * (_log(high) - _log(low))) if a.log else low + u * (high - low))
        points.append((i, *at))
    even = spark.createDataFrame(points, "place long, " + ", ".join(f"{n} double" for n in names))
    even = even.select(F.lit(2).alias("tier"), "place", near(F.lit(default)).alias("action_key"), *names, F.lit("halton").alias("generation"))
    held = {a.name: F.least(F.lit(bounds[a.name][1]), F.greatest(F.lit(bounds[a.name][0]), F.col(a.name).cast("double"))) for a in axes}
    every = anchors.unionByName(history).unionByName(even).withColumns(held)
    one = every.groupBy("action_key", *[F.round(a.name, a.digits).alias(f"_{a.name}") for a in axes]).agg(F.min(F.struct("tier", "place", *names, "generation")).alias("c"))
    out = one.select("action_key", "c.*").withColumns({f"s_{a.name}": scaled(a, bounds) for a in axes})
    number = F.row_number().over(Window.orderBy("tier", "place"))  # templates, changes and points: a bounded number
    return out.select(number.alias("candidate_id"), "action_key", *names, *[f"s_{n}" for n in names], "generation")


def _partial(points: np.ndarray, ids: np.ndarray, axes: list[str], width: float, far: float):
    """Sums over a task's samples for each point: weights, weighted rewards, the best reward less its distance."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, r, best, n = np.zeros(len(ids)), np.zeros(len(ids)), np.full(len(ids), -np.inf), 0
        for f in frames:
            reward, at = f["reward"].to_numpy(float), f[axes].to_numpy(float)
            n += len(f)
            for lo in range(0, len(f), 1024):  # a tile of points and samples at a time
                square = np.zeros((len(ids), min(1024, len(f) - lo)))
                for k in range(len(axes)):
                    square += (points[:, k, None] - at[None, lo : lo + 1024, k]) ** 2
                weight, own = np.exp(-square / (2 * width * width)), reward[lo : lo + 1024]
                w += weight.sum(1)
                r += weight @ own
                best = np.maximum(best, (own - far * np.sqrt(square)).max(1, initial=-np.inf))
        if n:
            yield pd.DataFrame({"candidate_id": ids, "support": w, "weighted": r, "near": best, "n": n})

    return run


def _blocks(points: DataFrame, samples: DataFrame, axes: list[str], width: float, far: float, block: int) -> DataFrame:
    """candidate_id, support, weighted, near and n (samples) of each point, ``block`` points in each pass over the samples."""
    rows = points.select("candidate_id", *axes).toLocalIterator()
    kind = dict(points.dtypes)["candidate_id"]
    schema = f"candidate_id {kind}, support double, weighted double, near double, n long"
    passes = []
    for some in iter(lambda: list(islice(rows, block)), []):
        ids, at = np.array([p[0] for p in some]), np.array([[float(x) for x in p[1:]] for p in some])
        parts = samples.select("reward", *axes).mapInPandas(_partial(at, ids, axes, width, far), schema)
        passes.append(parts.groupBy("candidate_id").agg(F.sum("support").alias("support"), F.sum("weighted").alias("weighted"), F.max("near").alias("near"), F.sum("n").alias("n")))
    return reduce(DataFrame.unionByName, passes) if passes else points.sparkSession.createDataFrame([], schema)


def kernel_surrogate(points: DataFrame, samples: DataFrame, axes: list[str], width: float = 0.25, block: int = 2048) -> DataFrame:
    """Each point's expected reward: Gaussian weights of past samples; what a task adds up is sent, not the samples."""
    known = samples.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ["reward", *axes]]))
    return _blocks(points, known, axes, width, 0.0, block).select("candidate_id", "support", F.try_divide("weighted", "support").alias("expected"))


def scored(found: DataFrame, samples: DataFrame, bounds: Box, evidence: DataFrame | None = None, axes: tuple[Axis, ...] = AXES, block: int = 2048) -> DataFrame:
    """Candidates with support, expected reward, exploration bonus, evidence, cost and ``score``.

    Expected is the greater of the kernel mean and the best reward less its
    distance, none below zero.
    """
    names = [f"s_{a.name}" for a in axes]
    known = usable(samples, axes).where(F.col("reward").isNotNull())
    tried = known.select("reward", *[scaled(a, bounds).alias(f"s_{a.name}") for a in axes])
    sums = _blocks(found, tried, names, WIDTH, FAR, block)
    out = found.join(sums, "candidate_id", "left").fillna({"support": 0.0, "weighted": 0.0, "near": 0.0, "n": 0})
    mean = F.when(F.col("support") > 1e-12, F.col("weighted") / F.col("support")).otherwise(0.0)
    if evidence is None:
        out = out.withColumn("evidence", F.lit(0.0))
    else:
        out = out.join(evidence.select("action_key", F.col("evidence").cast("double").alias("evidence")), "action_key", "left").fillna(0.0, ["evidence"])
    cost = F.lit(0.0)
    for a in axes:
        if a.name == EPOCHS.name:
            cost = EPOCH_COST * F.col(f"s_{a.name}")
    out = out.withColumns({"expected": F.greatest(mean, F.col("near"), F.lit(0.0)), "bonus": EXPLORE * F.sqrt(F.ln(F.col("n") + 2.0) / (F.col("support") + 1.0)), "cost": cost})
    return out.withColumn("score", F.col("expected") + F.col("bonus") + F.col("evidence") - F.col("cost")).drop("weighted", "near")


def chosen(templates: DataFrame, samples: DataFrame, default: str, round_id: int = 0, evidence: DataFrame | None = None, axes: tuple[Axis, ...] = AXES, most: int = BEST) -> DataFrame:
    """The best ``most`` candidates, ``place`` 1.. by score, and ``selected`` for the one to train.

    Without any sample that is the default's template, wherever it stands (it
    is then listed last), else the best.
    """
    bounds = box(usable(templates, axes), axes)
    found = candidates(templates, samples, default, round_id, axes=axes)
    ranked = scored(found, samples, bounds, evidence, axes)
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), "candidate_id"))
    own = (F.col("action_key") == default) & (F.col("generation") == "template_anchor") & (F.col("n") == 0)
    ranked = ranked.withColumns({"place": place, "_own": own})
    first = F.min(F.struct(F.when(F.col("_own"), 0).otherwise(1), F.col("place"))).over(Window.partitionBy())
    ranked = ranked.withColumn("selected", F.col("place") == first["place"])
    return ranked.where((F.col("place") <= most) | F.col("selected")).drop("_own", "n")
