"""Keyed state over tool events: error resolution one for one, and the one-shot acknowledgement gate.

State lives as long as it can matter: by the watermark, it goes when its horizon has passed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.config import DEFAULT, EngineConfig

RESOLVED = "session_id string, event_id long, fixed_by long, content string"
BLOCKED = "session_id string, created_at timestamp, event_id long"


def _keep(state: GroupState, value: tuple, until: float | None) -> None:
    """Keep the value until a time in seconds; without one there is nothing to keep."""
    if until is None:
        if state.exists:
            state.remove()
        return
    state.update(value)
    state.setTimeoutTimestamp(max(int(until * 1000) + 1, state.getCurrentWatermarkMs() + 1))


def resolutions(acts: DataFrame, config: EngineConfig = DEFAULT, late: str = "10 minutes") -> DataFrame:
    """A stream of activities (event_id, session_id, ts, category, description, error) to (session_id, event_id, fixed_by, content).

    State: the last five failures of a session.  A success resolves the oldest open one of the last fix_seconds whose
    texts are long enough; each failure is resolved once, each success resolves one.  late: how late events may come.
    """
    seconds = config.fix_seconds

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids, times, errors = (list(x) for x in state.get) if state.exists else ([], [], [])
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for r in rows.itertuples():
            at = r.ts.timestamp()
            if r.category == "TRIED-FAILED" and r.error:
                ids, times, errors = (ids + [r.event_id])[-5:], (times + [at])[-5:], (errors + [r.error])[-5:]
            elif r.category in ("CHANGED", "INFRA"):
                hit = next((i for i, t in enumerate(times) if 0 <= at - t <= seconds and len(errors[i]) >= 15 and len(r.description) >= 15), None)
                if hit is not None:
                    out.append((key[0], ids[hit], r.event_id, f"Resolved '{errors[hit]}' by: {r.description}"))
                    del ids[hit], times[hit], errors[hit]
        _keep(state, (ids, times, errors), max(times) + seconds if times else None)
        yield pd.DataFrame(out, columns=["session_id", "event_id", "fixed_by", "content"])

    acts = acts.withWatermark("ts", late)
    return acts.groupBy("session_id").applyInPandasWithState(step, RESOLVED, "ids array<long>, times array<double>, errors array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def gate(events: DataFrame, config: EngineConfig = DEFAULT, late: str = "10 minutes") -> DataFrame:
    """A stream of (session_id, ts, event_id, count) to the blocked calls (session_id, created_at, event_id).

    Rows with a count set the marker of their session (a count of 0 takes it away); of the others the first within
    gate_seconds of a marker is blocked and uses it up.  late: how late events may come.
    """
    seconds = config.gate_seconds

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        marker: Any = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            at = r.ts.timestamp()
            if pd.notna(r.count_):
                marker = at if r.count_ > 0 else None
            elif marker is not None:
                if at - marker <= seconds:
                    out.append((key[0], pd.Timestamp(marker, unit="s", tz="UTC"), r.event_id))
                marker = None
        _keep(state, (marker,), None if marker is None else marker + seconds)
        yield pd.DataFrame(out, columns=["session_id", "created_at", "event_id"])

    return events.withWatermark("ts", late).withColumnRenamed("count", "count_").groupBy("session_id").applyInPandasWithState(step, BLOCKED, "marker double", "append", GroupStateTimeout.EventTimeTimeout)
