"""Embedding whitening by shifted CholeskyQR over distributed rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import Scratch

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Rows of a Gram matrix in one message, and tasks whose matrices one task adds up.
STRIP, FAN_IN = 64, 64
#: Eigenvalues under this share of the largest count as zero and give no component.
RANK = 1e-12
#: Passes stop when no entry of the Gram matrix is this far from the identity's, or after PASSES.
CLOSE, PASSES = 1e-10, 6
#: Rows worked on at once in a task.
ROWS = 4096


class Centre(NamedTuple):
    """The rows' number, their sums, and their mean as whole part and rest, so that no digit of a difference goes to the offset."""

    n: int
    sums: list[int]
    whole: np.ndarray
    rest: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, entry), F.lit(False))


def fixed_point(vector: Column) -> Column:
    """Entries as whole numbers, floor(SCALE * c) + OFFSET, c as double; it must stay within 62 bits."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("long"))


def matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the rows with their column `x` as a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)


def _sums(width: int):
    """A row a task: its number of rows and the sum of each entry, in two halves that can't overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for _, x in matrices(batches, width):
            n, high, low = n + len(x), high + (x >> 31).sum(0), low + (x & 0x7FFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n] * width), pa.array(range(width), pa.int32()), pa.array(high), pa.array(low)], names=["n", "entry", "high", "low"])

    return run


def centre_of(rows: DataFrame, width: int) -> Centre:
    parts = rows.mapInArrow(_sums(width), "n long, entry int, high long, low long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    found = parts.groupBy("entry").agg(F.sum("n").alias("n"), *wide).orderBy("entry").collect()
    n, sums = (found[0].n if found else 0), [int(r.high) * 2**31 + int(r.low) for r in found]
    return Centre(n, sums, np.array([s // max(n, 1) for s in sums], np.int64), np.array([s % max(n, 1) / max(n, 1) for s in sums]))


def _gram(width: int, centre: Centre, times: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((times.shape[1],) * 2)
        for _, x in matrices(batches, width):
            rows = centre.of(x) @ times
            gram += rows.T @ rows
        blobs = [gram[a : a + STRIP].tobytes() for a in range(0, len(gram), STRIP)]
        task = pa.array([TaskContext.get().partitionId()] * len(blobs), pa.int64())
        yield pa.RecordBatch.from_arrays([task, pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], names=["task", "strip", "sums"])

    return run


def _added(key: tuple, table: pa.Table) -> pa.Table:
    blobs = table.column("sums").to_pylist()
    total = sum(np.frombuffer(blobs[i]) for i in np.argsort(table.column("task").to_numpy()))
    return pa.table({"task": pa.array([key[0].as_py()], pa.int64()), "strip": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def gram_of(rows: DataFrame, width: int, centre: Centre, times: np.ndarray) -> np.ndarray:
    """The Gram matrix of the centred rows times a matrix; tasks' sums are added FAN_IN at a time until FAN_IN are left."""
    schema, size = "task long, strip int, sums binary", times.shape[1]
    parts, tasks = rows.mapInArrow(_gram(width, centre, times), schema), rows.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.groupBy(F.floor(F.col("task") / FAN_IN).alias("to"), "strip").applyInArrow(_added, schema)
    gram = np.zeros((size, size))
    for r in sorted(parts.collect()):
        gram[r.strip * STRIP : (r.strip + 1) * STRIP] += np.frombuffer(r.sums).reshape(-1, size)
    return gram


def factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper Cholesky factor of `gram` with a shifted diagonal; the shift grows until there is one."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(shift * 10, np.finfo(float).eps * np.trace(gram), np.finfo(float).tiny)


def triangular(rows: DataFrame, width: int, centre: Centre) -> np.ndarray:
    """R of the centred rows' QR decomposition, by shifted CholeskyQR.

    Columns are scaled to length one first. The first pass factors their Gram matrix with a shift,
    so that there is a factor whatever the rows' condition. Each later pass factors the Gram matrix
    of the rows times the inverse of the R so far, which comes closer to the identity every time,
    and multiplies its own factor on; this takes the shift out again. Columns that are constant are
    zero in R. Where columns depend on others no Gram matrix comes close to the identity; each pass
    then shrinks R along those directions, and they fall under RANK.
    """
    gram = gram_of(rows, width, centre, np.eye(width))
    length = np.sqrt(np.diag(gram))
    varies = np.flatnonzero(length > 0)
    found, size = np.zeros((len(varies), width)), len(varies)
    if not size:
        return found
    unit = np.eye(width)[:, varies] / length[varies]
    gram = gram[np.ix_(varies, varies)] / np.outer(length[varies], length[varies])
    r = factor(gram, 11 * size * (size + 1) * np.finfo(float).eps * np.linalg.norm(gram, 2))
    for _ in range(PASSES):
        gram = gram_of(rows, width, centre, unit @ np.linalg.solve(r, np.eye(size)))
        r = factor(gram, 0.0) @ r
        if np.abs(gram - np.eye(size)).max() < CLOSE:
            break
    found[:, varies] = r * length[varies]
    return found


def deviations(x: np.ndarray, centre: Centre) -> list[int | None]:
    """The sum over entries of (n * x - sums)^2, exact; None where it passes a long."""
    n, width = centre.n, x.shape[1]
    near = (np.abs(x - centre.whole).max(axis=1, initial=0) + 1.0) * n < 2**31 / np.sqrt(width + 1)
    out: list[int | None] = [None] * len(x)
    y = (x[near] - centre.whole) * n - np.array([s % n for s in centre.sums], np.int64)
    for i, v in zip(np.flatnonzero(near).tolist(), (y * y).sum(1).tolist()):
        out[i] = v
    for i in np.flatnonzero(~near).tolist():
        exact = sum((n * v - s) ** 2 for v, s in zip(x[i].tolist(), centre.sums))
        out[i] = exact if exact < 2**63 else None
    return out


def _whitened(width: int, centre: Centre, project: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in matrices(batches, width):
            rows = centre.of(x) @ project
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * rows.shape[1])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviations(x, centre), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], names=["vec_id", "deviation", "whitened"])

    return run


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """Vectors on the principal components of the distinct fixed-point vectors, each scaled to unit variance.

    Columns: vec_id, component (from 1, by falling eigenvalue), n (distinct vectors), deviation (sum
    over entries of (n * x - sums)^2; null where it passes a long), whitened, explained (share of the
    whole variance) and identity_error (how far the covariance of `whitened` over the distinct
    vectors is from the identity, at most).

    Vectors that are null or hold null or non-finite entries give no rows; those shorter than the
    longest are filled up with zeros. Rows alike all appear, a null id stays null, and other columns
    are not read. Fewer components come out where fewer directions vary: none, so no rows, for an
    empty table or one distinct vector. The driver holds matrices of one row and column an entry.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    good = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("x")).where(usable(F.col("x")))
    width = good.agg(F.max(F.size("x"))).first()[0] or 0
    filler = F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(width) - F.size("x"))
    placed = good.select("vec_id", F.concat(fixed_point(F.col("x")), filler).alias("x"))
    distinct = scratch.store(placed.select("x").distinct(), "distinct")
    centre = centre_of(distinct, width)
    _, sizes, turns = np.linalg.svd(triangular(distinct, width, centre), full_matrices=False)
    values = sizes**2 / max(centre.n, 1)
    k = min(components, int((values > RANK * values.max(initial=0)).sum()))
    project = turns[:k].T / np.sqrt(values[:k])
    error = float(np.abs(gram_of(distinct, width, centre, project) / centre.n - np.eye(k)).max()) if k else 0.0
    kind = good.schema["vec_id"].dataType.simpleString()
    told = placed.mapInArrow(_whitened(width, centre, project), f"vec_id {kind}, deviation long, whitened array<double>")
    told = told.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(v)) for v in values[:k] / values.sum()]), F.col("at") + 1) if k else F.lit(0.0)
    return told.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
