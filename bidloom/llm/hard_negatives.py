"""Hard negatives by a vertical scan of quantised embeddings.

Rows are dealt to blocks by a hash of the row and every anchor visits every
block, so a task holds one block and streams the anchors past it; nothing is
broadcast and no pair leaves a task unless it is among the block's best. In a
block the vectors stand as columns, one per dimension. For each anchor the
columns are read in falling magnitude of the anchor's component; after every few
columns the least and the largest that the remaining ones can still add (from the
block's minimum and maximum of each) bound each candidate's score, and the bitmap
of candidates shrinks to those that can still matter: among the best k of the
anchor's label in the first pass; in the second, within a score window that one
of the anchor's positives opens, and not surely behind k others of that window.
What is left after the last column has its exact score. Blocks' best rows are
merged by rank, k from each.

Scores are exact: inner products of whole numbers, in doubles while every sum
stays below 2^53 and in Python integers beyond.

Defined results: a row whose label or vector is null, whose vector is empty or
holds a null or non-finite component, or whose id is null takes no part, nor does
one of another length than most rows have (the larger on a tie). Rows equal in
id, label and vector count once. Rows of equal id but different label or vector
are rows of their own, and none is the "other row" of another with its id; ties
beyond score and id go by a hash of the row. A negative positive score opens no
window. Scores beyond a long are cut to its end. An empty table, or one without
anchors, gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.llm.integer_vectors import common_length, matrix, quantised, usable
from bidloom.llm.tables import table
from bidloom.session import Scratch

POSITIVES = 5
NEGATIVES = 5
ANCHOR_EVERY = 100
#: A negative scores at least this percentage of its positive, and at most as much.
WINDOW_PERCENT = 80
#: Components in a block, and the rows below which cutting one up is not worth a task.
BLOCK = 1 << 22
SMALL = 2048
#: Columns read between two looks at the bounds.
STEP = 8
_LONG = (1 << 63) - 1

_FOUND = pa.schema([("anchor", pa.int64()), ("anchor_key", pa.int64()), ("place", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("key", pa.int64())])
FOUND = "anchor bigint, anchor_key bigint, place int, score bigint, id bigint, key bigint"


class Block:
    """The rows of a block by column, equal labels together."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, labels: np.ndarray, x: np.ndarray, exact: bool):
        order = np.argsort(labels, kind="stable")
        self.ids, self.keys, self.labels = ids[order], keys[order], labels[order]
        self.columns = np.ascontiguousarray(x[order].T.astype(np.float64 if exact else object))
        self.low, self.high = self.columns.min(1), self.columns.max(1)

    def of_label(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right")))

    def scan(self, q: np.ndarray, among: slice, wanted: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Rows left, with exact scores; `keep(part, least, most)` marks who can still matter, given what is still to come."""
        order = np.argsort(-np.abs(q), kind="stable")
        least, most = np.minimum(q * self.low, q * self.high)[order], np.maximum(q * self.low, q * self.high)[order]
        rows, part = None, np.zeros(among.stop - among.start, self.columns.dtype)
        for at in range(0, len(q), STEP):
            read = order[at:at + STEP]
            part = part + (q[read] @ self.columns[read, among] if rows is None else q[read] @ self.columns[read[:, None], rows[None, :]])
            left = keep(part, least[at + STEP:].sum(), most[at + STEP:].sum())
            if rows is None:
                left &= wanted
                # Whole columns are read while most candidates live.
                if left.sum() * 2 > len(left) and at + STEP < len(q):
                    continue
                rows = np.arange(among.start, among.stop)
            rows, part = rows[left], part[left]
            if not len(rows):
                break
        return rows, part

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        return np.lexsort((self.keys[rows], self.ids[rows], -scores))[:k]

    def nearest(self, anchor: int, label: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows of the anchor's label but of another id, and their scores."""
        among = self.of_label(label)
        if among.start == among.stop:
            return np.zeros(0, np.int64), np.zeros(0)
        wanted = self.ids[among] != anchor

        def keep(part, least, most):
            # `part` may still hold rows that are not wanted: they must not raise the bar.
            valid = part[wanted] if len(part) == len(wanted) else part
            if len(valid) <= k:
                return np.ones(len(part), bool)
            bar = np.partition(valid, len(valid) - k)[len(valid) - k]
            return part + most >= bar + least

        rows, scores = self.scan(q, among, wanted, keep)
        best = self._best(rows, scores, k)
        return rows[best], scores[best]

    def within(self, label: int, q: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per window (low, high): the k best rows of other labels whose scores lie in it."""
        same = self.of_label(label)
        wanted = np.ones(len(self.ids), bool)
        wanted[same] = False

        def keep(part, least, most):
            whole = len(part) == len(wanted)
            left = np.zeros(len(part), bool)
            for low, high in windows:
                may = (part + most >= low) & (part + least <= high)
                sure = (part + least >= low) & (part + most <= high)
                if whole:
                    sure &= wanted
                if np.count_nonzero(sure) >= k:
                    in_window = part[sure]
                    may &= part + most >= np.partition(in_window, len(in_window) - k)[len(in_window) - k] + least
                left |= may
            return left

        rows, scores = self.scan(q, slice(0, len(self.ids)), wanted, keep)
        out = []
        for low, high in windows:
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            best = inside[self._best(rows[inside], scores[inside], k)]
            out.append((rows[best], scores[best]))
        return out


def window(positive: int) -> tuple[int, int]:
    """Whole scores from WINDOW_PERCENT of the positive's up to its own; empty for a negative one."""
    return -(-WINDOW_PERCENT * positive // 100), positive


def _visits(dims: int, k: int, by_label: bool):
    """Blocks arrive whole before their anchors; `windows` holds the scores of an anchor's positives."""

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _FOUND)], schema=_FOUND)

    def visit(block: Block, part: pa.RecordBatch) -> list[tuple]:
        found = []
        x = matrix(part.column("x"), dims).astype(block.columns.dtype)
        for q, anchor, key, label, windows in zip(x, *(part.column(c).to_pylist() for c in ("id", "key", "label", "windows"))):
            if by_label:
                hits = [(0, *block.nearest(anchor, label, q, k))]
            else:
                scores = sorted({s for s in windows if s >= 0})
                by_score = dict(zip(scores, block.within(label, q, [window(s) for s in scores], k)))
                hits = [(place, *by_score[s]) for place, s in enumerate(windows) if s in by_score]
            for place, rows, scores in hits:
                found += [(anchor, key, place, max(-_LONG - 1, min(_LONG, int(s))), int(block.ids[r]), int(block.keys[r])) for r, s in zip(rows.tolist(), scores.tolist())]
        return found

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            number, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                if number[start] != at:
                    at, held, block = number[start], [], None
                if kind[start] == 0:
                    held.append((*(part.column(c).to_numpy().copy() for c in ("id", "key", "label")), matrix(part.column("x"), dims).copy(), bool(part.column("exact")[0].as_py())))
                    continue
                if block is None and held:
                    block = Block(*(np.concatenate(c) for c in list(zip(*held))[:4]), held[0][4])
                    held = []
                if block is not None:
                    found = visit(block, part)
                    if found:
                        yield batch_of(found)

    return visits


def _best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, exact: bool, visits) -> DataFrame:
    """What every anchor finds in every block."""
    columns = ("block", "kind", "id", "key", "label", "x", "windows", "exact")
    dealt = rows.select(F.pmod("key", F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "key", "label", "x", F.array().cast("array<bigint>").alias("windows"))
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "key", "label", "x", "windows")
    both = dealt.unionAll(sent).withColumn("exact", F.lit(exact)).select(*columns)
    return both.repartition(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(visits, FOUND)


def mine(
    vectors: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that `anchor`, a condition on `id`, names."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    label = F.col(label) if isinstance(label, str) else label
    read = vectors.select(F.col(id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).alias("v"))
    read = read.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).select("id", "label", quantised(F.col("v")).alias("x"))
    rows = scratch.save(read.distinct().withColumn("key", F.xxhash64("id", "label", "x")), "rows")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    dims = common_length(rows, "x")
    if dims is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == dims)
    n, reach = rows.agg(F.count("*"), F.max(F.array_max(F.transform("x", lambda c: F.abs(c.cast("double")))))).first()
    # Sums of products, and the bounds made from them, are whole numbers that doubles hold.
    exact = 4 * dims * reach * reach < 2.0 ** 53
    blocks = max(-(-n * dims // BLOCK), min(-(-n // SMALL), 2 * spark.sparkContext.defaultParallelism), 1)

    anchors = rows.where(anchor).withColumn("windows", F.array().cast("array<bigint>"))
    near = _best(_met(rows, anchors, blocks, exact, _visits(dims, positives, True)), positives, "anchor", "anchor_key")
    near = scratch.save(near.select("anchor", "anchor_key", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    opened = near.groupBy("anchor", "anchor_key").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    opened = rows.join(opened.select(F.col("anchor").alias("id"), F.col("anchor_key").alias("key"), F.col("p.positive_score").alias("windows")), ["id", "key"])
    far = _best(_met(rows, opened, blocks, exact, _visits(dims, negatives, False)), negatives, "anchor", "anchor_key", "place")
    named = far.select("anchor", "anchor_key", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(near, ["anchor", "anchor_key", "place"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _stirred(id: str, label: str) -> str:
    return f"CASE WHEN {id} % 7 = 0 THEN ({label} + 1) % 10 ELSE {label} END"


def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return mine(rows, F.col("id") % ANCHOR_EVERY == 0, label=F.expr(_stirred("vec_id", "label")))


ORACLE = f"""
WITH v AS MATERIALIZED (SELECT DISTINCT vec_id, {_stirred('vec_id', 'label')} AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % {ANCHOR_EVERY} = 0),
p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE same) WHERE r <= {POSITIVES}),
n AS (SELECT p.a, p.b AS positive_id, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r FROM p JOIN s ON s.a = p.a AND NOT s.same
    WHERE {WINDOW_PERCENT} * p.score <= 100 * s.score AND s.score <= p.score)
SELECT a AS anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= {NEGATIVES}"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES = {"op13_hard_negatives": ORACLE}
