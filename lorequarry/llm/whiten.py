"""Whitening of vectors by a one-sided Jacobi singular value decomposition.

* Blockwise QR: each task folds its centred rows, a block at a time, into one
  triangular factor; factors are stacked and folded again, some at a time, until
  one is left.  It has as many rows as a vector has entries, whatever the input.
* Plane rotations make the factor's columns orthogonal.  Columns are taken in the
  rounds of a tournament, whose pairs are disjoint, so that a round is one step
  on arrays.  The lengths of the columns are the singular values, and the
  rotations, accumulated, are the components.  The covariance is never formed, so
  small deviations keep their digits.

Sums are exact integers, and rows are centred before anything is multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorequarry.llm.arrow import pick
from lorequarry.scratch import spool

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this, scaled, cannot be told apart as doubles.
LARGEST = 1 << 52
#: Rows folded at once, and factors stacked at once.
BLOCK, FAN = 2048, 16
SWEEPS = 60


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: vectors as whole numbers, ``floor(SCALE * c) + OFFSET`` of each entry.

    Left out are null vectors, those with a null or non-finite entry or one beyond
    ``LARGEST``, and those whose length is not the commonest (of lengths as common,
    the largest): they lack entries.  Ids may be null or repeat; each row counts.
    """
    named = pick(rows, id_col, vector_col).toDF("vec_id", "v")
    scaled = named.select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * SCALE)).alias("x"), F.transform("v", lambda c: F.abs(c.cast("double") * SCALE)).alias("size"))
    whole = scaled.where(F.size("x") > 0).where(F.forall("size", lambda c: F.coalesce(c < LARGEST, F.lit(False))))
    kept = spool(whole.select("vec_id", F.transform("x", lambda c: c + OFFSET).alias("x")), "whiten-x")
    lengths = kept.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return kept.where(F.size("x") == (lengths["n"] if lengths else 0))


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: rows ``n``, exact sums, unit components as columns by falling
    variance, their variances (all above zero), and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        base = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - base) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """``sum((n * x - S) ** 2)`` of each row, exactly; null where a long is too small for it."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        y = x - base
        far = int(np.abs(y).max(initial=0))
        if max(far, max(rest, default=0)) * far * y.shape[1] < 1 << 62:
            squares, cross = (y * y).sum(axis=1).tolist(), (y @ np.array(rest, np.int64)).tolist()
        else:
            wide = y.astype(object)
            squares, cross = (wide * wide).sum(axis=1).tolist(), (wide @ np.array(rest, object)).tolist()
        last, n = sum(r * r for r in rest), self.n
        found = (n * n * s - 2 * n * c + last for s, c in zip(squares, cross, strict=True))
        return [d if d < 1 << 63 else None for d in found]


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part["vec_id"], part["x"].flatten().to_numpy().reshape(-1, d)


def _added_up(rows: DataFrame, column: str) -> list:
    """The entries of arrays of one bounded length, added up over all rows."""
    placed = rows.select(F.posexplode(column).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    return [r["v"] for r in sorted(placed.collect())]


def exact_sums(x: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows, and the sum of each entry, as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for _, block in _blocks(batches, d):
            total = [t + s for t, s in zip(total, (block - OFFSET).astype(object if np.abs(block).max() > 1 << 40 else np.int64).sum(axis=0).tolist(), strict=True)]
            n += len(block)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[*total, n]], pa.list_(pa.decimal128(38, 0)))], names=["s"])

    found = _added_up(x.mapInArrow(run, "s array<decimal(38,0)>"), "s")
    n = int(found[-1]) if found else 0
    return n, [int(s) + n * OFFSET for s in found[:-1]]


def folded(rows: np.ndarray, factor: np.ndarray | None = None) -> np.ndarray:
    """The triangular factor of ``factor`` with ``rows`` under it."""
    return np.linalg.qr(rows if factor is None else np.vstack([factor, rows]), mode="r")


def triangular_factor(x: DataFrame, mean: Whitening) -> np.ndarray:
    """R of all centred rows: a factor a task, stacked ``FAN`` at a time until one is left."""
    d = len(mean.sums)
    schema = "slot int, r array<double>"
    arrow = pa.schema([("slot", pa.int32()), ("r", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = None
        for _, block in _blocks(batches, d):
            factor = folded(mean.centred(block), factor)
        if factor is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([factor.ravel()], arrow.field(1).type)], schema=arrow)

    def stack(table: pa.Table) -> pa.Table:
        factor = None
        for r in table.sort_by("slot")["r"]:
            factor = folded(np.asarray(r.values).reshape(-1, d), factor)
        return pa.table([pa.array([table["slot"][0].as_py() // FAN], pa.int32()), pa.array([factor.ravel()], arrow.field(1).type)], schema=arrow)

    factors = spool(x.mapInArrow(run, schema), "whiten-r")
    while factors.count() > 1:
        factors = spool(factors.groupBy(F.floor(F.col("slot") / FAN)).applyInArrow(stack, schema), "whiten-r")
    return np.array(factors.first()["r"]).reshape(-1, d)


def tournament(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs of ``d`` players in which everyone meets everyone once."""
    players = list(range(d + d % 2))
    rounds = []
    for _ in range(len(players) - 1):
        pairs = [(min(p, q), max(p, q)) for p, q in zip(players[: len(players) // 2], players[::-1], strict=False) if max(p, q) < d]
        rounds.append((np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)))
        players = [players[0], players[-1], *players[1:-1]]
    return rounds


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of ``r``, falling, and right singular vectors as columns."""
    d = r.shape[1]
    order = np.argsort(-np.square(r).sum(axis=0), kind="stable")
    u, v = r[:, order].copy(), np.eye(d)[:, order]
    close = np.finfo(float).eps * np.sqrt(d)
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in tournament(d):
            up, uq = u[:, p], u[:, q]
            a, b, g = np.square(up).sum(axis=0), np.square(uq).sum(axis=0), (up * uq).sum(axis=0)
            size = np.sqrt(a) * np.sqrt(b)
            apart = np.divide(np.abs(g), size, out=np.zeros_like(g), where=size > 0)
            worst = max(worst, apart.max(initial=0.0))
            turn = apart > close
            zeta = np.divide(b - a, 2 * g, out=np.zeros_like(g), where=turn)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            u[:, p], u[:, q] = c * up - s * uq, s * up + c * uq
            vp, vq = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
        if worst <= close:
            break
    lengths = np.sqrt(np.square(u).sum(axis=0))
    falling = np.argsort(-lengths, kind="stable")
    return lengths[falling], v[:, falling]


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all rows of ``x`` (``vec_id, x``); nothing without rows.  Directions in
    which the rows do not differ, to the last digits of a double, give no component."""
    first = x.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    n, sums = exact_sums(x, d)
    mean = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    lengths, vectors = jacobi(triangular_factor(x, mean))
    some = min(components, int((lengths > lengths[0] * d * 8 * np.finfo(float).eps).sum()))
    variances = np.square(lengths) / n
    return Whitening(n, sums, vectors[:, :some], variances[:some], float(variances.sum()))


def identity_error(x: DataFrame, model: Whitening) -> float:
    """The largest entry by which the covariance of the whitened rows is not the identity."""
    d, k = len(model.sums), len(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k + k)
        for _, block in _blocks(batches, d):
            w = model.whitened(block)
            total += np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    found = np.array(_added_up(x.mapInArrow(run, "s array<double>"), "s")) / model.n
    mean = found[k * k :]
    return float(np.abs(found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def transform(x: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, deviation, whitened`` (an array, one entry a component) of each row."""
    d, k = len(model.sums), len(model.variances)
    schema = T.StructType([x.schema["vec_id"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _blocks(batches, d):
            made = model.whitened(block)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * k), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.deviations(block), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return x.mapInArrow(run, schema)


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each usable row's whitened entries, a row for each component: ``vec_id,
    component, n, deviation, whitened, explained, identity_error``.

    Rows that ``quantised`` leaves out give nothing; repeated ids and rows give
    rows each.  A table without usable rows, or whose rows are all alike, gives an
    empty one.  Other columns are ignored.
    """
    x = quantised(rows, id_col, vector_col)
    model = fit(x, components)
    if model is None or not len(model.variances):
        kind = x.schema["vec_id"].dataType.simpleString()
        return x.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.variances))
    error = identity_error(x, model)
    made = transform(x, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return made.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
