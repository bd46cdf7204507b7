"""Whitening of embeddings along their leading components.

Vectors are put on a grid (``floor(64 c) + 1000000``); the fit list holds each
different grid vector once.  Its sums are exact integers, its covariance is a
sum over all tasks of products of centred vectors, and only that matrix (one
row and column per dimension, ``MAX_DIMENSIONS`` at most) comes to the driver,
where ``eigen.leading`` takes its components.  The projection, dimensions times
components, is sent to the tasks, which whiten every row.

A row whose vector is null, empty or holds a null or a non-finite entry is
dropped, as is one with an entry beyond 2**40 (off the grid) or, since it has no
covariance with the others, one of another length than most (of equally
frequent lengths, the longest).  Equal rows and null keys are kept as they are;
only the key and vector columns are read.  Components whose variance is under
``LEAST`` of the largest have no whitened values and are left out, so a table of
equal vectors, or an empty one, gives an empty result.  ``deviation`` is null
where it does not fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.llm import eigen
from rentgrid.llm.tables import small_batches, written

#: The covariance is dense: 8 bytes times the square of this on the driver.
MAX_DIMENSIONS = 4096
COMPONENTS = 16
#: Least share of the largest variance that a component must have.
LEAST = 1e-11
#: Grid: steps per unit, and what is added.
STEPS, ADDED = 64.0, 1_000_000
_LARGEST = float(1 << 40)


def on_grid(table: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and the grid vector ``x`` of the rows that can be used."""
    c = F.col(vector)
    usable = c.isNotNull() & (F.size(c) > 0) & F.forall(
        c, lambda e: F.coalesce(F.abs(e.cast("double")) < _LARGEST, F.lit(False)))  # false for NaN, which sorts last
    grid = F.transform(c, lambda e: F.floor(e.cast("double") * STEPS) + F.lit(ADDED).cast("long"))
    return table.where(usable).select(F.col(key).alias("key"), grid.alias("x"))


def _matrix(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    column = batch.column(name)
    values = column.flatten()
    return values.to_numpy(zero_copy_only=False).reshape(len(column), d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension."""
    def part(batches):
        n, total = 0, np.zeros(d, np.int64)
        for b in batches:
            x = _matrix(b, "x", d)
            n += len(x)
            total += x.sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"j": np.arange(d, dtype=np.int32), "n": np.full(d, n), "s": total})
    rows = fit.mapInArrow(part, "j int, n long, s long").groupBy("j").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    total = [0] * d
    for r in rows:
        total[r.j] = int(r.s)
    return (rows[0].n if rows else 0), total


def _covariance(fit: DataFrame, d: int, n: int, sums: list[int], projection: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the fit list (divisor n), of its projection if one is
    given.  Vectors are centred before they are multiplied."""
    whole, rest = _centre(n, sums)
    width = d if projection is None else projection.shape[1]

    def part(batches):
        total = np.zeros((width, width))
        for b in batches:
            z = (_matrix(b, "x", d) - whole) - rest
            if projection is not None:
                z = z @ projection
            total += z.T @ z
        for i in range(width):
            yield pa.RecordBatch.from_pydict({"i": np.full(i + 1, i, np.int32), "j": np.arange(i + 1, dtype=np.int32),
                                              "v": total[i, :i + 1]})
    cells = fit.mapInArrow(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((width, width))
    for r in cells:
        out[r.i, r.j] = out[r.j, r.i] = r.v / n
    return out


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean in two parts, so that centring loses no digits: its nearest
    integer, and what is left of it."""
    whole = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(whole, np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole)])


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: ``key, component, n, deviation,
    whitened, explained, identity_error``."""
    key_type = table.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = on_grid(table, key, vector)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    nothing = table.sparkSession.createDataFrame([], schema)
    if lengths is None:
        return nothing
    d = lengths.d
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; at most {MAX_DIMENSIONS}")
    small_batches(table.sparkSession)
    rows = rows.where(F.size("x") == d)
    fit = written(rows.select("x").distinct(), "whitening-fit")
    n, sums = _sums(fit, d)
    covariance = _covariance(fit, d, n, sums)
    values, axes = eigen.leading(covariance, components)
    kept = values > LEAST * max(values[0], 0)
    values, axes = values[kept], axes[:, kept]
    if not len(values):
        return nothing
    projection = axes / np.sqrt(values)
    error = float(np.abs(_covariance(fit, d, n, sums, projection) - np.eye(len(values))).max())
    explained = values / np.trace(covariance)
    whole, rest = _centre(n, sums)
    left = np.array([s - w * n for s, w in zip(sums, whole.tolist())])  # n x - S = n (x - whole) - left
    k = len(values)

    def project(batches):
        for b in batches:
            if not len(b):
                continue
            z = _matrix(b, "x", d) - whole
            white = ((z - rest) @ projection).ravel()
            rough = ((z * float(n) - left) ** 2).sum(1)
            exact = ((z * n - left) ** 2).sum(1)
            many = len(z)
            deviation = pa.array(np.repeat(exact, k), pa.int64(), mask=np.repeat(rough > 9.2e18, k))
            yield pa.RecordBatch.from_arrays([
                b.column("key").take(pa.array(np.repeat(np.arange(many), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                pa.array(np.full(many * k, n, np.int64)), deviation, pa.array(white),
                pa.array(np.tile(explained, many)), pa.array(np.full(many * k, error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(project, schema)
