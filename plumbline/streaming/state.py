"""Stateful streams over camera and track events, one state a key."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.selection import Residency

#: Time constant of the smoothing, in milliseconds.
TAU_MS = 180.0


def smooth(previous: float | None, value: float | None, elapsed_ms: float, tau_ms: float = TAU_MS) -> float | None:
    """One step of exponential smoothing; a missing value keeps the previous one."""
    if value is None or value != value:
        return previous
    if previous is None:
        return value
    return previous + (value - previous) * (1 - math.exp(-max(0.0, elapsed_ms) / tau_ms))


def follow_table(events: DataFrame) -> DataFrame:
    """events(track, ts_ms, seq, z) of a table -> (track, seq, level). A track is one viewer's session."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, level, last, out = rows.sort_values(["ts_ms", "seq"]), None, None, []
        for ts, z in zip(rows["ts_ms"].tolist(), rows["z"].tolist()):
            level, last = smooth(level, z, 0.0 if last is None else ts - last), ts
            out.append(level)
        return rows[["track", "seq"]].assign(level=out)

    return events.groupBy("track").applyInPandas(run, "track long, seq long, level double")


def _follow(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    level, last = state.get if state.exists else (None, None)
    rows = pd.concat(list(batches)).sort_values(["ts_ms", "seq"])
    out = []
    for ts, seq, z in zip(rows["ts_ms"].tolist(), rows["seq"].tolist(), rows["z"].tolist()):
        level = smooth(level, z, 0.0 if last is None else ts - last)
        last = ts
        out.append((key[0], seq, level))
    state.update((level, last))
    yield pd.DataFrame(out, columns=["track", "seq", "level"])


def follow_ground(events: DataFrame) -> DataFrame:
    """events(track, ts_ms, seq, z) -> (track, seq, level): the smoothed height along each track, as batches come in."""
    return events.groupBy("track").applyInPandasWithState(
        _follow, "track long, seq long, level double", "level double, last long", "append", GroupStateTimeout.NoTimeout
    )


def _reconcile(budget: int, fetches: int):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Residency([tuple(t) for t in json.loads(state.get[0])] if state.exists else [])
        rows, out = pd.concat(list(batches)), []
        for tick, wanted in rows.sort_values(["tick", "priority"]).groupby("tick"):
            fetched, evicted = held.step(list(zip(wanted["key"], wanted["points"].astype(int))), budget, fetches)
            settled = all(k in held.tiles for k in wanted["key"])
            out += [(key[0], tick, "fetch", k, settled) for k in fetched] + [(key[0], tick, "evict", k, settled) for k in evicted]
        state.update((json.dumps(list(held.tiles.items())),))
        yield pd.DataFrame(out, columns=["viewer", "tick", "action", "key", "settled"])

    return step


def tile_residency(selections: DataFrame, budget: int, fetches: int = 6) -> DataFrame:
    """selections(viewer, tick, priority, key, points) -> (viewer, tick, action, key, settled).

    Each viewer's state is the tiles it holds, at most the budget's worth and one selection."""
    return selections.groupBy("viewer").applyInPandasWithState(
        _reconcile(budget, fetches), "viewer long, tick long, action string, key string, settled boolean", "tiles string", "append", GroupStateTimeout.NoTimeout
    )
