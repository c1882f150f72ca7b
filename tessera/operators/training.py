"""Training of the small head on features: one distributed gradient a step.

The head is sigmoid(w2 . relu(w1 x + b1) + b2) under mean binary cross-entropy, by
full-batch steps of Adam with decoupled weight decay. In each step every partition
adds up the gradients of its rows in matrix products and emits one row for each
block of parameters; two rounds of sums, by lots and by blocks, combine them. What reaches the driver has the
size of the head, never of the data. Weights travel to the tasks as a broadcast of
that size, and the state after each step is written to the shared folder, so a
training that dies goes on from its last step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.caches import Records

#: Parameters in one row of a gradient, and lots that the rows of a block are first summed in.
BLOCK, LOTS = 4096, 32


@dataclass
class Head:
    """Parameters in one flat vector: w1 by rows, b1, w2, b2."""

    dims: int
    hidden: int
    flat: np.ndarray

    @classmethod
    def drawn(cls, dims: int, hidden: int, seed: int = 42) -> Head:
        """Uniform within one over the root of a layer's inputs."""
        rng = np.random.default_rng(seed)
        a, b = 1 / np.sqrt(dims), 1 / np.sqrt(hidden)
        return cls(dims, hidden, np.concatenate([rng.uniform(-a, a, hidden * dims + hidden), rng.uniform(-b, b, hidden + 1)]))

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        k = self.hidden * self.dims
        return self.flat[:k].reshape(self.hidden, self.dims), self.flat[k : k + self.hidden], self.flat[k + self.hidden : -1], float(self.flat[-1])


def loss_and_gradient(head: Head, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over the rows of the loss and of its gradient."""
    w1, b1, w2, b2 = head.parts()
    z = x @ w1.T + b1
    h = np.maximum(z, 0.0)
    logit = h @ w2 + b2
    loss = float((np.logaddexp(0.0, logit) - y * logit).sum())
    d = 0.5 * (1 + np.tanh(logit / 2)) - y
    back = (d[:, None] * w2) * (z > 0)
    return loss, np.concatenate([(back.T @ x).ravel(), back.sum(0), h.T @ d, [d.sum()]])


def summed_gradient(rows: DataFrame, head: Head) -> tuple[int, float, np.ndarray]:
    """Rows, loss and gradient summed over ``rows`` (x array<double>, y double)."""
    kept = rows.sparkSession.sparkContext.broadcast(head)
    schema = pa.schema([("block", pa.int32()), ("n", pa.int64()), ("loss", pa.float64()), ("g", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, loss, total = kept.value, 0, 0.0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, own.dims)
            part, g = loss_and_gradient(own, x, np.asarray(batch.column("y"), float))
            n, loss, total = n + batch.num_rows, loss + part, g if total is None else total + g
        if total is not None:
            blocks = range(0, len(total), BLOCK)
            yield pa.RecordBatch.from_pylist([{"block": i // BLOCK, "n": n if not i else 0, "loss": loss if not i else 0.0, "g": total[i : i + BLOCK].tolist()} for i in blocks], schema=schema)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        g = np.asarray(table["g"].combine_chunks().flatten()).reshape(len(table), -1).sum(0)
        return pa.Table.from_pylist([{"block": key[0].as_py(), "n": sum(table["n"].to_pylist()), "loss": sum(table["loss"].to_pylist()), "g": g.tolist()}], schema=schema)

    kinds = "block int, n long, loss double, g array<double>"
    parts = rows.select("x", "y").mapInArrow(run, kinds).withColumn("lot", F.spark_partition_id() % LOTS)
    summed = parts.groupBy("block", "lot").applyInArrow(add, kinds).groupBy("block").applyInArrow(add, kinds)
    blocks = sorted(summed.collect())  # as long as the head
    kept.destroy()
    if not blocks:
        raise ValueError("no rows to train on")
    return sum(b["n"] for b in blocks), sum(b["loss"] for b in blocks), np.concatenate([b["g"] for b in blocks])


def train_head(rows: DataFrame, head: Head, steps: int = 20, rate: float = 0.01, decay: float = 0.01, folder: str | None = None) -> tuple[Head, list[float]]:
    """The head after ``steps`` and the mean loss before each, over ``rows`` (x array<double>, y 0 or 1); rows without features or label take no part.

    With ``folder`` the state after each step is kept there, and a further call goes on
    from the newest.
    """
    known = rows.where("x is not null and y is not null").select(F.transform("x", lambda v: v.cast("double")).alias("x"), F.col("y").cast("double").alias("y"))
    flat, m, v, losses, start = head.flat.copy(), np.zeros_like(head.flat), np.zeros_like(head.flat), [], 0
    records = Records(rows.sparkSession, folder, "step int, losses array<double>, flat array<double>, m array<double>, v array<double>") if folder else None
    if records:
        start, state = records.newest()
        start = max(0, start)
        if state:
            flat, m, v = (np.array(state[0][c]) for c in ("flat", "m", "v"))
            losses = list(state[0]["losses"])
    for step in range(start + 1, steps + 1):
        n, loss, g = summed_gradient(known, Head(head.dims, head.hidden, flat))
        losses.append(loss / n)
        flat, m, v = adam(flat, g / n, m, v, step, rate, decay)
        if records:
            records.write(step, [(step, losses, flat.tolist(), m.tolist(), v.tolist())])
            records.remove(step - 1 if step > 1 else -1)
    return Head(head.dims, head.hidden, flat), losses


def adam(flat: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, step: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step of Adam (0.9, 0.999, 1e-8) with decoupled decay."""
    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
    return flat * (1 - rate * decay) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8), m, v
