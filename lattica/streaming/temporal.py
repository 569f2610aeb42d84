"""Temporal context: recurrent best-neuron search over ordered series.

A series' state is its last best neuron, so a batch is one pass over each series in order of
time, and a stream keeps one small state for each key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def msom_step(x: np.ndarray, w: np.ndarray, c: np.ndarray, last: int | None, alpha: float, beta: float) -> int:
    """The neuron nearest by (1 - alpha) |x - w| + alpha |context - c|; without a past, by |x - w| alone."""
    d = np.sqrt(((w - x) ** 2).sum(axis=1))
    if last is not None:
        ctx = (1 - beta) * w[last] + beta * c[last]
        d = (1 - alpha) * d + alpha * np.sqrt(((c - ctx) ** 2).sum(axis=1))
    return int(d.argmin())


def som_sd_step(x: np.ndarray, w: np.ndarray, place: np.ndarray, at: np.ndarray, last: int | None, alpha: float) -> int:
    """SOM-SD: the context is the grid position of the last best neuron."""
    d = (1 - alpha) * np.sqrt(((w - x) ** 2).sum(axis=1))
    if last is not None:
        d = d + alpha * np.sqrt(((at - place[last]) ** 2).sum(axis=1))
    return int(d.argmin())


def leaky(x: np.ndarray, w: np.ndarray, potential: np.ndarray, leak: float = 0.5) -> np.ndarray:
    """Temporal Kohonen potentials after ``x``; the best neuron has the greatest."""
    return leak * potential - 0.5 * ((w - x) ** 2).sum(axis=1)


def assign_series(events: DataFrame, w: np.ndarray, c: np.ndarray, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """``events(series, ts, event_id, v)`` to (event_id, series, neuron_id), in order of (ts, event_id).

    Rows are sorted by the shuffle and read batch by batch, so a long series needs no more memory.
    """
    ordered = events.repartition("series").sortWithinPartitions("series", "ts", "event_id").select("series", "event_id", "v")

    def run(batches):
        state = (None, None)
        for b in batches:
            out = []
            for s, v in zip(b.column("series").to_pylist(), b.column("v").to_pylist(), strict=True):
                last = state[1] if state[0] == s else None
                k = msom_step(np.array([v]), w, c, last, alpha, beta)
                state = (s, k)
                out.append(k)
            yield pa.RecordBatch.from_arrays([b.column("event_id"), b.column("series"), pa.array(out, pa.int64())], names=["event_id", "series", "neuron_id"])

    return ordered.mapInArrow(run, "event_id long, series long, neuron_id long")


__all__ = ["assign_series", "leaky", "msom_step", "som_sd_step"]
