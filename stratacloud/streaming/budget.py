"""The adaptive budget: slow runs cut it at once, three fast ones in a row raise it again.

One transition serves tables (a sorted pass over sessions) and streams (keyed state).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIB = 1 << 20
# Limits in milliseconds, factors, and the least budgets of points and bytes.
SLOW = {"render": 2_500, "total": 45_000, "decode": 8_000, "worker": 10_000, "trip": 10_000}
FAST = {"render": 1_500, "total": 8_000, "decode": 2_500, "worker": 3_500, "trip": 3_500}
RENDER_CUT, SOURCE_CUT, RAISE, STREAK = 0.75, 0.45, 1.25, 3
LEAST = {"rendered": 10_000, "source_points": 360_000, "node_points": 30_000, "source_bytes": 4 * MIB, "node_bytes": 512 * 1024}
LIMITS = {"rendered": 360_000, "source_points": 900_000, "node_points": 80_000, "source_bytes": 16 * MIB, "node_bytes": 2 * MIB}
BUDGETS = tuple(LEAST)
SOURCE = BUDGETS[1:]


def step(state: dict, run: dict, limits: dict = LIMITS) -> dict:
    """The state after a run."""
    slow_render = run["render"] > SLOW["render"]
    slow_source = any(run[k] > SLOW[k] for k in ("total", "decode", "worker", "trip"))
    out = dict(state)
    if slow_render or slow_source:
        cut = (["rendered"] if slow_render else []) + (list(SOURCE) if slow_source else [])
        for k in cut:
            out[k] = min(state[k], max(LEAST[k], floor(state[k] * (RENDER_CUT if k == "rendered" else SOURCE_CUT))))
        out["streak"] = 0
        return out
    below = any(state[k] < limits[k] for k in BUDGETS)
    if not (below and all(run[k] < FAST[k] for k in FAST)):
        return out | {"streak": 0}
    out["streak"] = state["streak"] + 1
    if out["streak"] >= STREAK:
        out |= {k: min(limits[k], ceil(state[k] * RAISE)) for k in BUDGETS} | {"streak": 0}
    return out


def start(limits: dict = LIMITS) -> dict:
    return dict(limits) | {"streak": 0}


_STATE = ", ".join(f"{k} long" for k in (*BUDGETS, "streak"))


def fold(runs: DataFrame, by: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """(by, budgets, streak) after all runs of a session. One pass over sorted rows holds one state, however long a session lives."""
    names = (*BUDGETS, "streak")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, done = None, None, []
        for batch in batches:
            columns = batch.to_pydict()
            for session, *values in zip(*(columns[c] for c in (by, *SLOW))):
                if session != key or now is None:
                    if now is not None:
                        done.append((key, *(now[k] for k in names)))
                    key, now = session, start()
                now = step(now, dict(zip(SLOW, values)))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], names=[by, *names])
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (key, *(now[k] for k in names))], names=[by, *names])

    ordered = runs.repartition(by).sortWithinPartitions(by, *order).select(F.col(by).cast("bigint").alias(by), *SLOW)
    return ordered.mapInArrow(run, f"{by} long, {_STATE}")


def stream(runs: DataFrame, by: str = "user_id") -> DataFrame:
    """The same over a stream: the state of a session is its budgets; each batch returns it anew (update mode)."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names = (*BUDGETS, "streak")
        now = dict(zip(names, state.get)) if state.exists else start()
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for run in rows[list(SLOW)].to_dict("records"):
            now = step(now, run)
        state.update(tuple(int(now[k]) for k in names))
        yield pd.DataFrame([{by: key[0]} | now])

    return runs.groupBy(by).applyInPandasWithState(update, f"{by} long, {_STATE}", _STATE, "update", "NoTimeout")
