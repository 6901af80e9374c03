"""The clipping controller as a stateful stream: one state per run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.controller import START, STATE, Settings, next_state
from ..session import reach_workers

SCHEMA = ", ".join(f"{name} {kind}" for name, kind in STATE)


def replay_stream(stream: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``stream(run, step, norm)`` -> the state of each run after every batch;
    rows of a batch are taken in step order, ``aborted_at`` is -1 and ``reason``
    empty while the run goes on."""

    def fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = state.get if state.exists else START
        rows = pd.concat([f[f["norm"].notna()] for f in frames]).sort_values(["step", "norm"])
        for step, norm in zip(rows["step"], rows["norm"]):
            s = next_state(s, int(step), float(norm), settings)
        s = tuple({"double": float, "bigint": int, "string": str}[kind](v) for v, (_, kind) in zip(s, STATE))
        state.update(s)
        yield pd.DataFrame([(key[0], *s)], columns=["run", *[name for name, _ in STATE]])

    reach_workers(stream.sparkSession)
    return stream.groupBy("run").applyInPandasWithState(fold, "run bigint, " + SCHEMA, SCHEMA, "update", "NoTimeout")
