"""Current item states from a stream of events.

The reference semantics are batch; this is an addition. Events of an item
need not be in order within a micro-batch: they are sorted by ``seq`` there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_NEXT = {
    ("unused", "reserve"): "reserved",
    ("reserved", "unreserve"): "unused",
    ("reserved", "use"): "used",
    ("reserved", "defeat"): "defeated",
    ("defeated", "revive"): "unused",
}


def step(state: str | None, kind: str) -> str | None:
    """The state after an event; events before registration are ignored."""
    if state is None:
        return "unused" if kind == "register" else None
    return "used" if kind == "mark_used" else _NEXT.get((state, kind), state)


def _update(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
    state = group.get[0] if group.exists else None
    events = pd.concat(list(frames)).sort_values("seq")
    for kind in events.kind:
        state = step(state, kind)
    if state is not None:
        group.update((state,))
        yield pd.DataFrame({"dataset": [key[0]], "question_id": [key[1]], "state": [state]})


def item_states(events: DataFrame) -> DataFrame:
    """State changes of a stream (dataset, question_id, seq, kind)."""
    return events.groupBy("dataset", "question_id").applyInPandasWithState(
        _update, "dataset string, question_id string, state string", "state string", "update", GroupStateTimeout.NoTimeout
    )
