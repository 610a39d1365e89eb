"""Slot memory of sessions kept by a stateful stream, equal to the batch operator at every turn."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.sessions import memory_events

OUT = "session string, turn int, slot string, value string, required boolean"


def advance(state: dict, events: pd.DataFrame) -> dict:
    """Applies the events of one turn, in step order."""
    for e in events.sort_values("step").itertuples():
        value, required = state.get(e.slot, (None, False))
        state[e.slot] = (e.value if pd.notna(e.value) else None, bool(e.required) if pd.notna(e.required) else required)
    return state


def stream_memory(turns: DataFrame, slots_from: str = "append") -> DataFrame:
    """turns: a stream of session, turn, asked, text, each session's turns in order. session, turn, slot, value, required after each
    turn, the slots that hold a value. Parsing stays in the JVM; only state goes through Python, in Arrow batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: tuple(v) for k, v in json.loads(state.get[0]).items()} if state.exists else {}
        rows = []
        for turn, events in pd.concat(list(batches)).groupby("turn", sort=True):
            held = advance(held, events)
            rows += [(key[0], int(turn), k, v, r) for k, (v, r) in held.items() if v is not None]
        state.update((json.dumps(held),))
        yield pd.DataFrame(rows, columns=["session", "turn", "slot", "value", "required"])

    return memory_events(turns).groupBy("session").applyInPandasWithState(step, OUT, "held string", slots_from, GroupStateTimeout.NoTimeout)
