"""Early stopping on a live metric stream (T7, streaming form).

Scores arrive epoch by epoch; as a Structured Streaming job the rule is a keyed
stateful operator: each run keeps its best score, where it was, where the run
stopped and its length in state across micro-batches
(``applyInPandasWithState``), and each trigger emits the runs it updated.

A run's rows of one micro-batch come in several Arrow chunks in no order, so
their order columns and scores (nothing else) are gathered and sorted once.
That is bounded by the size of a trigger: set ``maxFilesPerTrigger`` or
``maxBytesPerTrigger`` on the source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dyad.operators.learn import follow_minima

STATE_SCHEMA = "best double, best_at long, stop long, epochs long"
OUT_SCHEMA = "run long, best double, best_epoch long, stop_epoch long, n_epochs long"


def _update(patience: int, min_delta: float, order: list[str], score: str):
    def fn(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, at, stop, seen = state.get if state.exists else (math.inf, 0, 0, 0)
        chunks = [pdf[[*order, score]] for pdf in batches]
        rows = sum(map(len, chunks))
        if not rows:
            return
        values = pd.concat(chunks).sort_values(order)[score].to_numpy(dtype="float64", na_value=np.nan)
        values = np.where(np.isnan(values), math.inf, values)
        lower = np.flatnonzero(values < np.minimum.accumulate(np.append(best, values))[:-1])
        best, at, stop = follow_minima(best, at, stop, zip((seen + lower + 1).tolist(), values[lower].tolist()), patience, min_delta)
        seen += rows
        if not stop and seen >= at + patience:
            stop = at + patience
        state.update((best, at, stop, seen))
        yield pd.DataFrame([(key[0], best if at else None, at, stop, stop or seen)],
                           columns=["run", "best", "best_epoch", "stop_epoch", "n_epochs"])

    return fn


def early_stop_stream(scores: DataFrame, run: str, score: str, order: list[str], patience: int = 10,
                      min_delta: float = 0.0) -> DataFrame:
    """Streaming ``(run, best, best_epoch, stop_epoch, n_epochs)`` per updated run.

    Epochs are counted in arrival order: within a micro-batch rows are taken in
    ``order`` (e.g. ``[ts, event_id]``), and later micro-batches continue the
    count from state.  NULL and NaN scores never improve.  Use output mode
    ``update``.
    """
    if min_delta < 0:
        raise ValueError("min_delta must be >= 0")
    keyed = scores.select(scores[run].cast("long").alias("run"), *order, score)
    return keyed.groupBy("run").applyInPandasWithState(
        _update(max(patience, 1), min_delta, list(order), score), OUT_SCHEMA, STATE_SCHEMA, "update",
        GroupStateTimeout.NoTimeout,
    )
