"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are documents' sets of distinct word shingles,
columns are shingle hashes. The columns are cut into blocks by hash; how many
blocks depends on the size class, and follows from the size-derived bound: two
sets of a and b shingles with similarity s share at least s(a+b)/(1+s), so they
differ in at most d = (1-s)(a+b)/(1+s) columns. With d + 1 + slack blocks, a pair
above the bound agrees in more than slack blocks, so it meets under the
fingerprint of a whole block, and a set of which no more blocks than that recur
elsewhere (empty ones counted) has no partner at all and is discarded before any
pair is formed. Sets that share a passage or a few frequent shingles agree in a
block or two and go here.

Near copies come in groups of thousands. The set of a block group that recurs most
is its leader (of a base and its variants that is the base); every member is
multiplied with the leader only, and a member that is connected with it, through
any group, is done. Those that are not are cut into blocks of bounded size, as are
all members of the group, and every block of the former meets every block of the
latter in one task: overlap counts are accumulated over blocks of the columns that
recur, pairs below their bound are dropped there, and what leaves the task is a
spanning set of the links. So a pair of a group never is a row of a table, no task
holds more than two blocks, and no link between components is lost: a pair of
which both are connected with the leader needs no test.

Defined results: null or blank texts, and texts without words, have no shingles
and are linked with nothing; a text of fewer words than a shingle is one shingle;
repeated rows and repeated ids each get their row; a component's name is the
least non-null id in it; an empty table gives an empty result. Other columns are
not read, so their names cannot clash. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.llm.components import components
from bidloom.llm.spans import U64, distinct_runs, mix, range_sums, shingle_hashes, slices
from bidloom.llm.tables import table
from bidloom.session import Scratch

SHINGLE = 5
PERCENT = 80
#: Slack as a part of the columns that may differ.
SLACK_PART = 4
GROWTH = 1.5
#: Rows of a block, about, and columns of one step of a product.
BLOCK_ROWS, BLOCK_COLUMNS = 200, 4096


@cache
def size_classes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least size of every class, its number of blocks and its slack. Below the first class only equal sets can link."""
    least = -(-percent // (100 - percent))
    bounds = [least]
    while bounds[-1] < 1 << 40:
        bounds.append(int(np.ceil(bounds[-1] * GROWTH)))
    low = np.array(bounds[:-1])
    differ = 2 * (np.array(bounds[1:]) - 1) * (100 - percent) // (100 + percent)
    slack = differ // SLACK_PART + 1
    return low, differ + 1 + slack, slack


def block_keys(shingles: np.ndarray, marks: np.ndarray, classes: np.ndarray, blocks: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of the blocks of every set under its given class (-1: none), each set's range in them, and how many must recur.

    Empty blocks are left out unless a set has more of them than the slack; then one block that recurs is enough.
    """
    count = np.where(classes >= 0, blocks[np.maximum(classes, 0)], 0)
    offset = np.concatenate([[0], np.cumsum(count)])
    size = np.diff(marks)
    owner = np.repeat(np.arange(len(size)), size)
    used = classes[owner] >= 0
    s, owner = shingles[used], owner[used]
    h = mix(s ^ U64(0x51ED270B))
    at = offset[owner] + ((h >> U64(33)) % count[owner].astype(U64)).astype(np.int64) if len(s) else np.zeros(0, np.int64)
    sums = np.zeros(offset[-1], U64)
    np.add.at(sums, at, mix(s))
    empty = np.bincount(at, minlength=offset[-1]) == 0
    doc = np.repeat(np.arange(len(size)), count)
    place = np.arange(offset[-1]) - offset[doc] if len(doc) else np.zeros(0, np.int64)
    spare = slack[np.maximum(classes, 0)] - np.bincount(doc, empty, len(size)).astype(np.int64)
    keep = ~empty | (spare < 0)[doc]
    key = mix(sums + mix((classes[doc].astype(U64) << U64(40)) + place.astype(U64)))
    return key[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(size)))]).astype(np.int64), np.maximum(spare, 0) + 1


def set_ids(shingles: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """A fingerprint of every whole set."""
    return mix(range_sums(mix(shingles + U64(1)), marks) + np.diff(marks).astype(U64)).view(np.int64)


#: Low bits of a key that hold its size class, and sets a task remembers to send their keys once.
CLASS_BITS = 7
REMEMBERED = 200_000


def _sets(size: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data, bounds in slices(batch.column("text")):
                s, marks = distinct_runs(*shingle_hashes(data, bounds, size))
                n = np.diff(marks)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, len(n)), pa.array(n, pa.int64()), pa.array(set_ids(s, marks), mask=n == 0)], ["id", "n", "set_id"])

    return read


def _keys(size: int, percent: int):
    low, blocks, slack = size_classes(percent)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for start, data, bounds in slices(batch.column("text")):
                s, marks = distinct_runs(*shingle_hashes(data, bounds, size))
                n = np.diff(marks)
                identity = set_ids(s, marks)
                # Copies of a set would send the same keys; most are told apart here.
                fresh = np.zeros(len(n), bool)
                for i, x in enumerate(identity.tolist()):
                    if n[i] and x not in sent:
                        fresh[i] = True
                        sent.add(x)
                if len(sent) > REMEMBERED:
                    sent.clear()
                kind = np.where(fresh, np.searchsorted(low, n, "right") - 1, -2)
                # A set close below the next class may link into it.
                nxt = np.minimum(kind + 1, len(low) - 1)
                upper = np.where((kind >= -1) & (100 * n >= percent * low[np.maximum(nxt, 0)]) & (nxt > kind), nxt, -1)
                for c in (np.maximum(kind, -1), upper):
                    keys, ends, need = block_keys(s, marks, c, blocks, slack)
                    owner = np.repeat(np.arange(len(n)), np.diff(ends))
                    if len(owner):
                        tagged = (keys.view(np.int64) >> CLASS_BITS << CLASS_BITS) | c[owner]
                        yield pa.RecordBatch.from_arrays([pa.array(tagged), pa.array(identity[owner]), pa.array(need[owner].astype(np.int32))], ["key", "set_id", "need"])

    return read


def _incidence(size: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data, bounds in slices(batch.column("text")):
                s, marks = distinct_runs(*shingle_hashes(data, bounds, size))
                raw = s.tobytes()
                cells = [raw[8 * a:8 * b] for a, b in zip(marks[:-1].tolist(), marks[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(s, marks)), pa.array(cells, pa.binary())], ["set_id", "row"])

    return read


def _with_leader(percent: int):
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                left, right = part.column("leader_row").to_pylist(), part.column("row").to_pylist()
                size = np.array([(len(a) + len(b)) // 8 for a, b in zip(left, right)])
                near = np.array(differences(left, right)) * (100 + percent) <= (100 - percent) * size
                yield pa.RecordBatch.from_arrays([part.column("leader"), part.column("node"), pa.array(near)], ["leader", "node", "near"])

    return multiply


def differences(left: list[bytes], right: list[bytes]) -> list[int]:
    """Of every pair of incidence rows, how many columns only one of them has."""
    out = []
    for a, b in zip(left, right):
        x = np.sort(np.frombuffer(a + b, U64))
        out.append(len(x) - 2 * int(np.count_nonzero(x[1:] == x[:-1])))
    return out


def product(rows: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of every two incidence rows, summed over blocks of the columns that recur."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    order = np.argsort(np.concatenate(rows), kind="stable")
    column, owner = np.concatenate(rows)[order], owner[order]
    first = np.concatenate([[True], column[1:] != column[:-1]])
    number = np.cumsum(first) - 1
    again = np.bincount(number)[number] > 1
    number, owner = (np.cumsum(first[again]) - 1), owner[again]
    overlap = np.zeros((len(rows), len(rows)), np.float32)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, BLOCK_COLUMNS):
        a, b = np.searchsorted(number, [at, at + BLOCK_COLUMNS])
        cells = np.zeros((len(rows), BLOCK_COLUMNS), np.float32)
        cells[owner[a:b], number[a:b] - at] = 1
        overlap += cells @ cells.T
    return overlap


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all that is linked: each row with the first row of its component."""
    out, fresh = [], np.ones(len(linked), bool)
    for i in range(len(linked)):
        if fresh[i]:
            fresh[i], front = False, np.array([i])
            while len(front):
                front = np.flatnonzero(linked[front].any(0) & fresh)
                fresh[front] = False
                out += [(i, int(j)) for j in front]
    return out


def _of_two_blocks(percent: int):
    def multiply(table_: pa.Table) -> pa.Table:
        found = dict(zip(table_.column("node").to_pylist(), table_.column("row").to_pylist()))
        node, rows = list(found), [np.frombuffer(r, U64) for r in found.values()]
        n = np.array([len(r) for r in rows])
        edges = spanning(product(rows) * (100 + percent) >= percent * (n[:, None] + n[None, :])) if len(rows) > 1 else []
        return pa.table({"a": pa.array([node[i] for i, _ in edges], pa.int64()), "b": pa.array([node[j] for _, j in edges], pa.int64())})

    return multiply


def _links(members: DataFrame, rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links `(a, b)` between sets that connect all that is linked.

    `members(key, set_id)`: the block groups with more than one set; `rows(set_id, row)`: their incidence rows.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    recurs = members.join(sizes, "key").groupBy("set_id").agg(F.sum("size").alias("recurs"))
    heads = members.join(recurs, "set_id").groupBy("key").agg(F.max_by("set_id", F.struct("recurs", "set_id")).alias("leader"), F.count("*").alias("size")).where("size > 1")
    stars = members.join(scratch.save(heads.drop("size"), "heads"), "key").select("leader", F.col("set_id").alias("node")).where("leader <> node").distinct()
    led = scratch.save(stars, "stars").join(rows.select(F.col("set_id").alias("leader"), F.col("row").alias("leader_row")), "leader")
    led = led.join(rows.withColumnRenamed("set_id", "node"), "node").mapInArrow(_with_leader(percent), "leader bigint, node bigint, near boolean")
    led = scratch.save(led, "led")
    plain = led.where("near").select(F.col("leader").alias("a"), F.col("node").alias("b"))

    labels = components(plain, scratch)
    of = lambda c, name: labels.select(F.col("node").alias(c), F.col("root").alias(name))
    apart = led.join(of("node", "r"), "node", "left").join(of("leader", "l"), "leader", "left").select(
        "leader", "node", (F.coalesce("r", "node") != F.coalesce("l", "leader")).alias("far")
    )
    apart = scratch.save(apart, "apart")
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    # A group of two has no other pair.
    undone = apart.groupBy("leader").agg(F.count("*").alias("others"), F.count_if("far").alias("apart")).where("others > 1 AND apart > 0")
    undone = scratch.save(undone.select("leader", blocks(F.col("apart")).alias("x_blocks"), blocks(F.col("others")).alias("y_blocks")), "undone")
    left = apart.join(undone, "leader")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    far = left.where("far").select("leader", "node", place("x_blocks").alias("x"), every("y_blocks").alias("y"))
    all_ = left.select("leader", "node", every("x_blocks").alias("x"), place("y_blocks").alias("y"))
    dealt = scratch.save(far.unionAll(all_), "blocks")
    more = dealt.join(rows.withColumnRenamed("set_id", "node"), "node").groupBy("leader", "x", "y").applyInArrow(_of_two_blocks(percent), "a bigint, b bigint")
    return scratch.save(plain.unionAll(more), "links")


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`(id, n, component)` of every row: its number of distinct shingles and the least id it is linked with, directly or not."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("set_id", T.LongType())])
    sets = scratch.save(docs.mapInArrow(_sets(size), schema), "sets")

    # One shuffle of the keys: those that two sets have are found and picked where they lie.
    keyed = docs.select("text").mapInArrow(_keys(size, percent), "key bigint, set_id bigint, need int")
    of_key = Window.partitionBy("key")
    several = keyed.withColumns({"low": F.min("set_id").over(of_key), "high": F.max("set_id").over(of_key)}).where("low <> high")
    met = scratch.save(several.select("key", "set_id", "need"), "met").distinct()
    enough = F.count("*").over(Window.partitionBy("set_id", F.col("key").bitwiseAND(F.lit((1 << CLASS_BITS) - 1)))) >= F.col("need")
    members = scratch.save(met.withColumn("enough", enough).where("enough").select("key", "set_id"), "members")

    nodes = members.select("set_id").distinct()
    chosen = sets.join(scratch.save(nodes, "nodes"), "set_id", "left_semi").groupBy("set_id").agg(F.min("id").alias("chosen"))
    chosen = scratch.save(chosen.select("chosen").distinct(), "chosen")
    texts = docs.join(chosen, F.col("id").eqNullSafe(F.col("chosen")), "left_semi").select("text")
    rows = scratch.save(texts.mapInArrow(_incidence(size), "set_id bigint, row binary").dropDuplicates(["set_id"]), "rows")
    edges = _links(members, rows, percent, scratch)
    labels = components(edges, scratch)
    scratch.drop(members, rows)

    rooted = sets.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").select("id", "n", F.coalesce("root", "set_id").alias("root"))
    rooted = scratch.save(rooted, "rooted")
    least = scratch.save(rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component")), "least")
    return rooted.join(least, "root", "left").select("id", "n", F.coalesce("component", "id").alias("component"))


def keep_one_row(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Exactly one row of each group of near copies, and every row whose text has no words.

    The row of the least id stays (a null id comes last), of several texts under that id the one of the least hash, of
    rows equal in both the first by their other columns. Rows are told apart by id and text, so neither a repeated nor a
    null id decides over a row of another text.
    """
    scratch = Scratch(docs.sparkSession, "ngram-kept")
    key = F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.xxhash64(text).alias("tid"))
    rows = docs.select(F.struct("*").alias("doc"), key.alias("row"), F.col(text).alias("text"))
    found = jaccard_components(rows, "row", "text", **options).where("n > 0")
    other = scratch.save(found.groupBy("id", "component").count().where("id <> component OR count > 1").select("id", (F.col("id") == F.col("component")).alias("again")), "other")
    same = F.col("row") == F.col("id")
    kept = rows.join(other, same, "left_anti").select("doc")
    again = rows.join(other.where("again"), same).select("doc", "row")
    rest = [F.col(f"doc.`{c}`") for c, t in docs.dtypes if c not in (id, text) and "map<" not in t and "variant" not in t]
    first = F.row_number().over(Window.partitionBy("row").orderBy(*rest, "row"))
    return kept.unionAll(again.withColumn("first", first).where("first = 1").select("doc")).select("doc.*")


def op9_ngram_join(spark, sf_dir):
    found = jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
edges AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)"""

ORACLES = {"op9_ngram_join": ORACLE}
QUERIES = {"op9_ngram_join": op9_ngram_join}
