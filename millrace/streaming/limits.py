"""Counting rules that depend on what they decided before: sliding limits and lockouts.

Over a table they are folds of each key's events in order; over a stream the same step runs with a
key's state. A key's state is small: the times of the accepted hits within the window, or a count and a time.

A stream with a ``delay`` is taken in the order of its events, whatever batches they come in: events wait in their key's state until
the watermark has passed them, so the result is that of the table, without events later than the delay. A state goes
when the watermark has passed what it may still decide: the window behind the last hit, or the end of a lock with no failure open.
Without a delay batches are trusted to come in order, events are answered at once, and states stay.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import fold_rows
from ..session import workers_import

MOST, WINDOW_MS = 5, 3_600_000
FAILURES, LOCK_MS = 5, 900_000


def in_order(events: DataFrame, columns: list[str], out: str, start: Callable[[], Any], step: Callable[..., tuple], over: Callable[[Any], int | None], delay: str) -> DataFrame:
    """A fold of each key's events of a stream in the order of ms, event_id: ``columns`` (event_id and ms first, then what ``step``
    needs after the state and ms) and ``out`` (names and types). ``over(state)`` tells when a state is of no more use,
    None: never. States are JSON."""
    workers_import(events.sparkSession)
    names = ["key", *columns, *(x.split()[0] for x in out.split(", "))]
    schema = ", ".join([*(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in ("key", *columns)), out])

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, held = json.loads(state.get[0]) if state.exists else (start(), [])
        for batch in batches:
            held += batch[columns].astype(object).to_numpy().tolist()
        held.sort(key=lambda r: (r[1], r[0]))
        water = state.getCurrentWatermarkMs()
        ready = [r for r in held if r[1] <= water]
        held = held[len(ready) :]
        made = [(*key, *r, *step(own, *r[1:])) for r in ready]
        until = held[0][1] if held else over(own)
        if not held and until is not None and until <= water:
            state.remove()
        else:
            state.update((json.dumps([own, held]),))
            if until is not None:
                state.setTimeoutTimestamp(max(int(until), water + 1))
        yield pd.DataFrame(made, columns=names)

    timed = events.select("key", *columns, F.timestamp_millis("ms").alias("_at")).withWatermark("_at", delay)
    return timed.groupBy("key").applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def take(hits: list[int], ms: int, most: int, window_ms: int) -> bool:
    """Accept a hit if fewer than ``most`` were accepted within the window; a refused hit is not recorded."""
    hits[:] = [t for t in hits if t > ms - window_ms]
    if len(hits) >= most:
        return False
    hits.append(ms)
    return True


def rate_limited(events: DataFrame, most: int = MOST, window_ms: int = WINDOW_MS) -> DataFrame:
    """events (key, event_id, ms) with ``accepted``."""
    rows = events.select("key", "event_id", "ms")
    return fold_rows(rows, ["key"], ["ms", "event_id"], ["ms"], list, lambda hits, ms: (take(hits, int(ms), most, window_ms),), "accepted boolean")


def rate_limited_stream(events: DataFrame, most: int = MOST, window_ms: int = WINDOW_MS, delay: str | None = None) -> DataFrame:
    """The same over a stream: a key's accepted hits are its state. Hits of a key within a batch are taken in order, with a
    ``delay`` (as of a watermark) those of all batches."""
    if delay is not None:
        over = lambda hits: max(hits, default=-(1 << 62)) + window_ms
        return in_order(events, ["event_id", "ms"], "accepted boolean", list, lambda hits, ms: (take(hits, int(ms), most, window_ms),), over, delay)
    workers_import(events.sparkSession)

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ms", "event_id"])
        rows = rows.assign(accepted=[take(hits, int(ms), most, window_ms) for ms in rows["ms"]])
        state.update((hits,))
        yield rows[["key", "event_id", "ms", "accepted"]]

    return events.select("key", "event_id", "ms").groupBy("key").applyInPandasWithState(step, "key long, event_id long, ms long, accepted boolean", "hits array<long>", "append", GroupStateTimeout.NoTimeout)


def attempt(state: dict[str, int], ms: int, failed: bool, failures: int, lock_ms: int) -> tuple[bool, int]:
    """Whether an attempt is refused, and the failures in a row after it. ``state``: count, until."""
    if ms < state["until"]:
        return True, state["count"]
    state["count"] = state["count"] + 1 if failed else 0
    if state["count"] >= failures:
        state.update(count=0, until=ms + lock_ms)
    return False, state["count"]


def _unlocked() -> dict[str, int]:
    return {"count": 0, "until": -(1 << 62)}


def lockouts(events: DataFrame, failures: int = FAILURES, lock_ms: int = LOCK_MS) -> DataFrame:
    """events (key, event_id, ms, failed: boolean) with ``locked`` (refused) and ``count`` (failures in a row after
    it). As many failures in a row as ``failures`` lock the key for a while and start anew; a success clears; an attempt
    that is refused changes nothing."""
    rows = events.select("key", "event_id", "ms", "failed")
    step = lambda state, ms, failed: attempt(state, int(ms), bool(failed), failures, lock_ms)
    return fold_rows(rows, ["key"], ["ms", "event_id"], ["ms", "failed"], _unlocked, step, "locked boolean, count int")


def lockouts_stream(events: DataFrame, failures: int = FAILURES, lock_ms: int = LOCK_MS, delay: str | None = None) -> DataFrame:
    """The same over a stream: a key's failures in a row and the end of its lock are its state; ``delay`` as in
    ``rate_limited_stream``."""
    if delay is not None:
        over = lambda own: own["until"] if own["count"] == 0 else None
        step = lambda own, ms, failed: attempt(own, int(ms), bool(failed), failures, lock_ms)
        return in_order(events, ["event_id", "ms", "failed"], "locked boolean, count int", _unlocked, step, over, delay)
    workers_import(events.sparkSession)

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = dict(zip(("count", "until"), state.get, strict=True)) if state.exists else _unlocked()
        rows = pd.concat(list(batches)).sort_values(["ms", "event_id"])
        found = [attempt(own, int(ms), bool(failed), failures, lock_ms) for ms, failed in zip(rows["ms"], rows["failed"], strict=True)]
        state.update((own["count"], own["until"]))
        yield rows.assign(locked=[a for a, _ in found], count=[b for _, b in found])[["key", "event_id", "ms", "failed", "locked", "count"]]

    schema = "key long, event_id long, ms long, failed boolean, locked boolean, count int"
    return events.select("key", "event_id", "ms", "failed").groupBy("key").applyInPandasWithState(step, schema, "count int, until long", "append", GroupStateTimeout.NoTimeout)
