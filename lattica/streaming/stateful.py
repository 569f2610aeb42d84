"""Recurrent best-neuron search as a stateful stream: one small state for each series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .temporal import msom_step, som_sd_step


def merge_stream(events: DataFrame, w: np.ndarray, c: np.ndarray, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """A streaming ``events(series, ts, event_id, v)`` to (event_id, series, neuron_id).

    A series' rows of one micro-batch are taken in the order of (ts, event_id); batches count in
    the order in which they arrive. The state is the last best neuron.
    """
    return _stream(events, lambda x, last: msom_step(x, w, c, last, alpha, beta))


def position_stream(events: DataFrame, w: np.ndarray, place: np.ndarray, at: np.ndarray, alpha: float = 0.5) -> DataFrame:
    """As ``merge_stream``, with the grid position of the last best neuron as context."""
    return _stream(events, lambda x, last: som_sd_step(x, w, place, at, last, alpha))


def _stream(events: DataFrame, step) -> DataFrame:
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        out = []
        for v in rows["v"]:
            last = step(np.array([v]), last)
            out.append(last)
        state.update((last,))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "series": key[0], "neuron_id": out})

    return events.groupBy("series").applyInPandasWithState(run, "event_id long, series long, neuron_id long", "last long", "append", GroupStateTimeout.NoTimeout)
