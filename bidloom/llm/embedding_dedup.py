"""Near-duplicate embeddings by lattice hashing.

Every distinct vector is scaled to length one and projected, in several tables,
to eight random directions; the nearest point of the lattice E8 is its cell.
A vector stands in its own cell of every table and looks into that cell and the
neighbouring cells (of the 240 around) that lie nearest to its projection. What
meets is verified by cosine in double precision, so no false link is made, and a
true one is missed only if all tables miss it (tests/llm measures the share).

Equal vectors of a label are one node that counts for all of them. Cells carry
the label, so labels never meet. Links are pairs of nodes; a group of copies is
never expanded. Caps: none, a cell's rows meet through an equi-join.

Defined results: a null label or vector, a vector that is empty, zero or holds a
null or non-finite component links with nothing: n_links 0, its own component,
kept. Vectors of other lengths than `dims` likewise never meet those of `dims`
but are compared among themselves, each length with its own projections. Rows
with a null id count as links and stay in the result; a component is named by
the least non-null id. Repeated rows are linked copies. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.components import components
from bidloom.llm.spans import U64, mix
from bidloom.llm.tables import table
from bidloom.session import Scratch

COSINE = 0.98
TABLES = 6
PROBES = 8
#: Width of a projection in units of the lattice.
SCALE = 0.8
SEED = 20


@cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of one, or eight halves with an even number of minus signs."""
    ones = [(i, j, a, b) for i in range(8) for j in range(i + 1, 8) for a in (1, -1) for b in (1, -1)]
    out = np.zeros((len(ones) + 128, 8))
    for k, (i, j, a, b) in enumerate(ones):
        out[k, i], out[k, j] = a, b
    signs = 1 - 2 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    out[len(ones):] = signs[(signs < 0).sum(1) % 2 == 0] / 2
    return out


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """The nearest whole point with an even sum."""
    point = np.rint(y)
    off = y - point
    worst = np.abs(off).argmax(-1)[..., None]
    odd = (point.sum(-1) % 2 != 0)[..., None]
    at = np.take_along_axis(off, worst, -1)
    fixed = point.copy()
    np.put_along_axis(fixed, worst, np.take_along_axis(point, worst, -1) + np.where(at >= 0, 1.0, -1.0), -1)
    return np.where(odd, fixed, point)


def nearest(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8: the better of the even whole points and those moved by a half."""
    a, b = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(-1) <= ((y - b) ** 2).sum(-1))[..., None], a, b)


@cache
def projections(dims: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, tables * 8)) / SCALE


def _keys(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A 64-bit name of every lattice point, salted by label and table."""
    key = salt.astype(U64)
    for k in range(8):
        key = mix(key * U64(3) + (2 * points[..., k]).astype(np.int64).view(U64))
    return key.view(np.int64)


def cells(unit: np.ndarray, label: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """Own cells `(n, tables)` and neighbouring cells `(n, tables * probes)` of vectors of length one."""
    n, dims = unit.shape
    y = (unit @ projections(dims, tables)).reshape(n, tables, 8)
    point = nearest(y)
    closest = np.argpartition(-((y - point) @ neighbours().T), probes - 1, axis=-1)[..., :probes]
    salt = mix(label.astype(np.int64).view(U64)[:, None] * U64(1009) + U64(dims << 20) + np.arange(tables, dtype=U64))
    around = point[:, :, None, :] + neighbours()[closest]
    return _keys(point, salt), _keys(around, np.broadcast_to(salt[..., None], around.shape[:-1])).reshape(n, -1)


def _vector(cell) -> np.ndarray | None:
    if not cell or any(x is None for x in cell):
        return None
    v = np.array(cell, np.float64) + 0.0
    return v if np.isfinite(v).all() and v.any() else None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_vector(c) for c in batch.column("vector").to_pylist()]
        digest = [None if v is None else hashlib.md5(v.tobytes()).hexdigest() for v in found]
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), batch.column("label"), pa.array(digest, pa.string()), pa.array([None if v is None else v.tobytes() for v in found], pa.binary()),
        ], ["id", "label", "digest", "raw"])


def _unit(raw: list[bytes]) -> list[np.ndarray]:
    found = [np.frombuffer(x, np.float64) for x in raw]
    scaled = [v / np.abs(v).max() for v in found]
    return [v / np.linalg.norm(v) for v in scaled]


def _hash(tables: int, probes: int):
    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                unit, label = _unit(part.column("raw").to_pylist()), np.array(part.column("label").to_pylist(), np.int64)
                for dims in sorted({len(v) for v in unit}):
                    at = np.array([i for i, v in enumerate(unit) if len(v) == dims])
                    own, near = cells(np.stack([unit[i] for i in at]), label[at], tables, probes)
                    yield pa.RecordBatch.from_arrays([
                        part.column("node").take(pa.array(at)), pa.array(list(own), pa.list_(pa.int64())), pa.array(list(near), pa.list_(pa.int64()))
                    ], ["node", "own", "near"])

    return hash_


def _verify(cosine: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                a, b = (_unit(part.column(c).to_pylist()) for c in ("raw_a", "raw_b"))
                good = [len(x) == len(y) and float(x @ y) >= cosine for x, y in zip(a, b)]
                yield part.select(["a", "b"]).filter(pa.array(good))

    return verify


def linked(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """`(id, n_links, component)` of every row."""
    scratch = Scratch(vectors.sparkSession, "embedding-dedup")
    rows = vectors.select(F.col(id).alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("vector"))
    schema = rows.select("id", "label").schema.add("digest", "string").add("raw", "binary")
    read = rows.mapInArrow(_digests, schema)
    node = F.when(F.col("label").isNotNull() & F.col("digest").isNotNull(), F.xxhash64("label", "digest"))
    read = scratch.save(read.withColumn("node", node), "vectors")
    known = read.where("node IS NOT NULL")
    nodes = known.groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("raw").alias("raw"))
    nodes = scratch.save(nodes, "nodes")

    hashed = scratch.save(nodes.select("node", "label", "raw").mapInArrow(_hash(tables, probes), "node bigint, own array<bigint>, near array<bigint>"), "hashed")
    stands = hashed.select(F.col("node").alias("x"), F.explode("own").alias("cell"))
    looks = hashed.select(F.col("node").alias("y"), F.explode(F.concat("own", "near")).alias("cell"))
    pairs = stands.join(looks, "cell").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    a, b = (nodes.select(F.col("node").alias(c), F.col("raw").alias(f"raw_{c}")) for c in "ab")
    links = scratch.save(scratch.save(pairs, "pairs").join(a, "a").join(b, "b").mapInArrow(_verify(cosine), "a bigint, b bigint"), "links")

    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(nodes.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    labels = components(links, scratch).withColumnRenamed("root", "above")
    tagged = nodes.select("node", "copies", "least").join(others, "node", "left").join(labels, "node", "left")
    root = F.coalesce("above", "node")
    tagged = scratch.save(tagged.select("node", "least", root.alias("root"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "tagged")
    least = scratch.save(tagged.groupBy("root").agg(F.min("least").alias("component")), "least")
    tagged = scratch.save(tagged.join(least, "root").select("node", "n_links", "component"), "named")
    out = read.select("id", "node").join(tagged, "node", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component"))


def op7_embedding_dedup(spark, sf_dir):
    found = linked(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


ORACLE = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

QUERIES = {"op7_embedding_dedup": op7_embedding_dedup}
ORACLES = {"op7_embedding_dedup": ORACLE}
