"""Whitening of embeddings from an exact scatter matrix.

Components become whole numbers. The fit list holds every distinct vector once.
Each task cuts its vectors into slices, shifts every dimension by the slice's
least value, and packs the bit planes of each dimension across rows into 64-bit
words; the sum over rows of y_i * y_j is then the weighted count of common bits,
sum over planes a, b of 2^(a+b) * popcount(P_i^a & P_j^b), which is exact. Slices
are unshifted and added in limbs of 32 bits, so nothing overflows at any number of
rows. Only dims * (dims + 1) / 2 sums and dims totals reach the driver, which
centres them as whole numbers, n * C - S_i * S_j, before any division, and takes
the eigenvectors.

Defined results: rows whose vector is null, empty, or holds a null or non-finite
component are left out, as are rows of another length than most rows have (the
larger length on a tie). Repeated rows and repeated vectors weigh once in the fit
and are all returned; null and repeated ids stay. A component whose eigenvalue is
not above rounding (dims * 2^-52 of the largest) has no direction and is not
returned, so equal vectors alone give no rows; an empty table gives an empty
result. Of equal eigenvalues any basis is right; the solver's is taken. A
deviation beyond a long is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.integer_vectors import common_length, matrix, quantised, usable
from bidloom.llm.tables import table
from bidloom.session import Scratch

COMPONENTS = 4
#: Rows whose bit planes are packed together: 64 words a plane.
SLICE = 4096
#: Bytes of common bits looked at together.
TILE = 4 << 20
LIMB = 32
LIMBS = 5


def planes(y: np.ndarray) -> np.ndarray:
    """Bit planes of (rows, dims) values as (bits, dims, words)."""
    rows, dims = y.shape
    bits = max(1, int(y.max(initial=0)).bit_length())
    words = -(-rows // 64)
    padded = np.zeros((dims, words * 64), np.uint64)
    padded[:, :rows] = y.T
    packed = [np.packbits((padded >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64) for b in range(bits)]
    return np.stack(packed)


def common_bits(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Counts of common set bits of every dimension of p with every dimension of q."""
    dims, words = p.shape
    step = max(1, TILE // (8 * words * len(q)))
    return np.concatenate([np.bitwise_count(p[i:i + step, None, :] & q[None, :, :]).sum(-1, dtype=np.int64) for i in range(0, dims, step)])


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of x_i * x_j and of x_i over the rows of one slice; Python integers where 64 bits do not do."""
    rows = len(x)
    low = x.min(0)
    narrow = max(abs(int(x.min())), abs(int(x.max()))) < 1 << 24
    kind = np.int64 if narrow else object
    p = planes(x.astype(np.uint64) - low.astype(np.uint64))
    total, sums = np.zeros((x.shape[1],) * 2, kind), np.zeros(x.shape[1], kind)
    for a in range(len(p)):
        sums = sums + np.bitwise_count(p[a]).sum(-1, dtype=np.int64).astype(kind) * (1 << a)
        for b in range(a, len(p)):
            c = common_bits(p[a], p[b]).astype(kind)
            total = total + (c if a == b else c + c.T) * (1 << (a + b))
    low = low.astype(kind)
    return total + np.outer(sums, low) + np.outer(low, sums) + rows * np.outer(low, low), sums + rows * low


def limbs(values: np.ndarray) -> list[np.ndarray]:
    """Each whole number as LIMBS signed parts of LIMB bits, least first; all but the last are not negative."""
    mask, out = (1 << LIMB) - 1, []
    for _ in range(LIMBS - 1):
        out.append((values & mask).astype(np.int64))
        values = values >> LIMB
    return [*out, values.astype(np.int64)]


def _moments(dims: int):
    upper = np.triu_indices(dims)
    i, j = np.concatenate([upper[0], np.arange(dims)]), np.concatenate([upper[1], np.full(dims, -1)])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            for start in range(0, len(x), SLICE):
                total, sums = scatter(x[start:start + SLICE])
                parts = np.stack(limbs(np.concatenate([total[upper], sums])))
                held = parts if held is None else held + parts
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, held)], ["i", "j", *[f"l{k}" for k in range(LIMBS)]])

    return moments


@dataclass(frozen=True)
class Whitening:
    """Size, totals and directions of a fit list; `identity_error` is measured on its whitened rows."""

    dims: int
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    directions: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S exactly, and x - S / n in double precision."""
        reach = self.n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, self.sums))
        narrow = reach * reach * self.dims < 1 << 63
        kind = np.int64 if narrow else object
        wide = x.astype(kind) * self.n - np.array(self.sums, kind)
        return wide, (wide / self.n).astype(np.float64)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred @ (self.directions / np.sqrt(self.values))


def solve(n: int, cross: dict[tuple[int, int], int], sums: list[int], components: int) -> Whitening:
    """Eigenvectors of the covariance whose entries are (n * C_ij - S_i * S_j) / n^2."""
    dims = len(sums)
    v = np.zeros((dims, dims))
    for (i, j), c in cross.items():
        v[i, j] = v[j, i] = (n * c - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values[-1], 0.0) * dims * np.finfo(float).eps]
    return Whitening(dims, n, tuple(sums), values[order], vectors[:, order], values[order] / max(np.trace(v), np.finfo(float).tiny))


def _errors(model: Whitening):
    k = len(model.values)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = model.project(model.centred(matrix(batch.column("x"), model.dims))[1])
            total, sums = total + w.T @ w, sums + w.sum(0)
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([i, np.arange(k)]), pa.int32()), pa.array(np.concatenate([j, np.full(k, -1)]), pa.int32()), pa.array(np.concatenate([total.ravel(), sums]))], ["i", "j", "s"]
        )

    return errors


def prepared(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    return vectors.select(F.col(id).alias("id"), F.col(vector).alias("v")).where(usable(F.col("v"))).select("id", quantised(F.col("v")).alias("x"))


def fit(rows: DataFrame, scratch: Scratch, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of `rows` (x); None where there are none."""
    dims = common_length(rows, "x")
    if dims is None:
        return None
    listed = scratch.save(rows.where(F.size("x") == dims).select("x").distinct(), "fit-list")
    n = listed.count()
    schema = "i int, j int, " + ", ".join(f"l{k} bigint" for k in range(LIMBS))
    summed = listed.mapInArrow(_moments(dims), schema).groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])
    exact = {(r["i"], r["j"]): sum(r[f"l{k}"] << (LIMB * k) for k in range(LIMBS)) for r in summed.collect()}
    sums = [exact.pop((i, -1)) for i in range(dims)]
    model = solve(n, exact, sums, components)
    measured = {(r["i"], r["j"]): r["s"] / n for r in listed.mapInArrow(_errors(model), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    mean = lambda i: measured[i, -1]
    error = max((abs(c - mean(i) * mean(j) - (i == j)) for (i, j), c in measured.items() if j >= 0), default=0.0)
    return Whitening(dims, n, model.sums, model.values, model.directions, model.explained, error)


def _whitened(model: Whitening, id_type: pa.DataType):
    k = len(model.values)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide, centred = model.centred(matrix(batch.column("x"), model.dims))
            rows, w = batch.num_rows, model.project(centred)
            deviation = pa.array([d if d < 1 << 63 else None for d in (wide * wide).sum(1).tolist()], pa.int64())
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(each).cast(id_type), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, model.n)), deviation.take(each),
                pa.array(w.ravel()), pa.array(np.tile(model.explained, rows)), pa.array(np.full(rows * k, model.identity_error)),
            ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whitened


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    spark = vectors.sparkSession
    rows = prepared(vectors, id, vector).withColumn("id", F.col("id").cast("bigint"))
    schema = "id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = fit(rows, Scratch(spark, "whitening"), components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    return rows.where(F.size("x") == model.dims).mapInArrow(_whitened(model, pa.int64()), schema)


def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {"op12_whitening": op12_whitening}
