"""Queries of nested values and of objects inside texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import metrics
from .queries import _query, _table

ORACLE: dict[str, str] = {}


def _numbers(spark, sf):
    """Numbers of a nested record of each event: its properties, and a list of its value and its type."""
    json = F.concat(
        F.lit('{"Event": '), F.coalesce("props", F.lit("null")), F.lit(', "list": ['), F.coalesce(F.col("value").cast("decimal(18,4)").cast("string"), F.lit("null")),
        F.lit(', {"type": "'), F.coalesce("event_type", F.lit("")), F.lit('", "seen": true, "deep": {"user": '), F.coalesce(F.col("user_id").cast("string"), F.lit("null")), F.lit("}}]}"),
    )
    return metrics.flattened(_table(spark, sf, "events"), json, "event_id")


@_query
def event_numbers(spark, sf):
    return _numbers(spark, sf)


_NUMBERS = """select event_id, 'Event.k' as path, json_extract(props, '$.k')::double as value from events where json_extract(props, '$.k') is not null
union all select event_id, 'list.0', cast(cast(value as decimal(18,4)) as double) from events where value is not null
union all select event_id, 'list.1.deep.user', cast(user_id as double) from events where user_id is not null"""
ORACLE["event_numbers"] = _NUMBERS


@_query
def event_scores(spark, sf):
    """The preferred number of each event, as a share."""
    return metrics.chosen(_numbers(spark, sf), ["accuracy", "DEEP.user", "k"], "event_id")


ORACLE["event_scores"] = f"""with n as ({_NUMBERS}), r as (select *, case path when 'list.1.deep.user' then 1 when 'Event.k' then 2 end as rank from n),
f as (select *, row_number() over (partition by event_id order by rank) as place from r where rank is not null)
select event_id, path, least(greatest(case when value > 1 then value / 100 else value end, 0), 1)::double as score from f where place = 1"""


@_query
def first_objects(spark, sf):
    """The first object of answers around each event's properties; what follows a closed thought goes first."""
    props = F.coalesce("props", F.lit("none"))
    said = F.concat(F.lit("so {"), F.col("event_type"), F.lit("} then "), props, F.lit(' and {"k": 0}'))
    said = F.when(F.col("event_type") == "error", F.concat(said, F.lit('</think> not {this} but {"k": {"of": "}"}}'))).otherwise(said)
    return _table(spark, sf, "events").select("event_id", T.first_json_object(said).alias("found"))


ORACLE["first_objects"] = """select event_id, case when event_type is null then null when event_type = 'error' then '{"k": {"of": "}"}}'
  when props is null then '{"k": 0}' else props end as found from events"""
