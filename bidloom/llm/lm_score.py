"""Language-model scoring with a sharded Elias-Fano n-gram trie.

Tokens are words with A-Z in lower case and one end per text. The base model is
the smoothed unigram; on it stand bigrams and trigrams with absolute discount,

    p(c | a b) = max(n(abc) - D, 0) / n(ab) + rest(ab) p(c | b),

each level giving what it does not spend (`rest`) to the shorter context, so the
model is a proper distribution. Words seen fewer than WORD_COUNT times and
n-grams seen fewer than GRAM_COUNT times stay out of the higher levels.

The trie. Frequent words have ids; a level is the rising sequence parent * words
+ word, whose upper bits are the monotone pointers from parents to children, in
Elias-Fano code, with 16-bit codes of the discounted probability and of `rest`
beside it. An n-gram is found by going down: the successor of the context's base
plus the word, within the context. N-grams are range-partitioned by their first
two words; a task writes each range as one file into the shared folder, and
scorers map the files into memory. The vocabulary (64-bit hash, count, id) lies
in sorted files in the same way. What the driver holds is one row per file.

A task that writes names its file anew, and only files of committed tasks are
used. On a store that cannot be mapped a shard is read when it is needed.

Defined results: a null or empty text is its end token alone; without training
rows N and V are 0 and every token has probability 1; repeated rows count and
are scored each; null ids are trained on unless the caller's split says
otherwise; an empty table gives an empty result; other columns are not read.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.llm.elias_fano import EliasFano
from bidloom.llm.spans import U64, mix, slices, word_hashes, words
from bidloom.llm.tables import table
from bidloom.session import Scratch, bounded_batches

WORD_COUNT = 5
GRAM_COUNT = 2
DISCOUNT = 0.75
#: A code is a negative log10 in steps of 1 / STEPS; the last code stands for nothing.
STEPS = 8000
NOTHING = 65535
END = np.array([0x0E0D0C0B0A090807], U64)
#: Bytes of text looked up together: the more, the fewer n-grams are asked for twice, and the more memory a worker takes.
TOGETHER = 1 << 20
#: Tokens or n-grams that a task counts before it hands them on.
HELD = 1 << 19


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end token, and each text's range in them."""
    starts, ends, first = words(data, bounds)
    marks = first + np.arange(len(first))
    out = np.empty(marks[-1], U64)
    out[marks[1:] - 1] = END
    solid = np.ones(len(out), bool)
    solid[marks[1:] - 1] = False
    out[solid] = word_hashes(data, starts, ends)
    return out, marks


def code(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        c = np.rint(-np.log10(p) * STEPS)
    return np.where(p > 0, np.clip(c, 0, NOTHING - 1), NOTHING).astype(np.uint16)


def value(c: np.ndarray) -> np.ndarray:
    return np.where(c == NOTHING, 0.0, 10.0 ** (-c.astype(float) / STEPS))


# --- files ---------------------------------------------------------------------


def _write(folder: str, arrays: list[np.ndarray]) -> tuple[str, list[int]]:
    """Arrays one after the other in a new file; its name, and places and lengths in turn."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    name, at, marks = f"{uuid.uuid4().hex}.bin", 0, []
    with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
        for a in arrays:
            raw = a.tobytes() + b"\0" * (-a.nbytes % 8)
            out.write(raw)
            marks += [at, len(a)]
            at += len(raw)
    return name, marks


@lru_cache(maxsize=512)
def _mapped(folder: str, name: str) -> np.ndarray:
    fs, root = pafs.FileSystem.from_uri(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(f"{root}/{name}", np.uint8, "r").view(np.ndarray)
    with fs.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.readall(), np.uint8)


def _arrays(folder: str, name: str, marks: list[int], kinds: list[type]) -> list[np.ndarray]:
    raw = _mapped(folder, name)
    return [raw[at:at + n * np.dtype(k).itemsize].view(k) for at, n, k in zip(marks[::2], marks[1::2], kinds)]


@dataclass(frozen=True)
class Model:
    """Where the files are, in order of the keys they begin with, and the totals."""

    folder: str
    vocabulary: list[tuple]  # first hash, file, marks
    contexts: list[tuple]  # first id, file, marks
    grams: list[tuple]  # first (a, b) as one number, file, marks, widths
    frequent: int
    total: int
    distinct: int

    def counts(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training count and id (-1: not frequent) of every hash; hashes in rising order."""
        n, ids = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int64)
        for part, _, name, marks in _split(hashes, [U64(v[0]) for v in self.vocabulary], self.vocabulary):
            keys, count, id_ = _arrays(self.folder, name, marks, [U64, np.int64, np.int64])
            at = np.minimum(np.searchsorted(keys, hashes[part]), len(keys) - 1)
            hit = keys[at] == hashes[part]
            n[part] = np.where(hit, count[at], 0)
            ids[part] = np.where(hit, id_[at], -1)
        return n, ids

    def rests(self, ids: np.ndarray) -> np.ndarray:
        """What a frequent word's bigrams leave to the unigram; ids in rising order."""
        out = np.ones(len(ids))
        for part, first, name, marks in _split(ids, [c[0] for c in self.contexts], self.contexts):
            (codes,) = _arrays(self.folder, name, marks, [np.uint16])
            at = ids[part] - first
            out[part] = np.where(at < len(codes), value(codes[np.minimum(at, len(codes) - 1)]), 1.0)
        return out

    def shard(self, k: int) -> tuple:
        _, name, marks, widths = self.grams[k]
        found = _arrays(self.folder, name, marks, [np.uint8, np.uint8, np.int64] * 3 + [np.uint16] * 3)
        levels = [EliasFano(w[0], w[1], *found[3 * j:3 * j + 3]) for j, w in enumerate(widths)]
        return *levels, *found[9:]


def _split(keys: np.ndarray, firsts: list, files: list[tuple]) -> Iterator[tuple]:
    """Runs of the rising keys that lie in one file each."""
    if not files or not len(keys):
        return
    cuts = np.searchsorted(keys, np.array(firsts[1:], keys.dtype)) if len(firsts) > 1 else np.zeros(0, np.int64)
    edges = [0, *cuts.tolist(), len(keys)]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            yield slice(a, b), files[k][0], files[k][1], files[k][2]


# --- counting ------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def hand() -> pa.RecordBatch:
        w, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n, pa.int64())], ["w", "n"])

    for batch in batches:
        for _, data, bounds in slices(batch.column("text")):
            held.append(tokens(data, bounds)[0])
            if sum(map(len, held)) > HELD:
                yield hand()
    if held:
        yield hand()


def _count_grams(model: Model):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def hand() -> pa.RecordBatch:
            rows = np.concatenate(held)
            held.clear()
            key = mix(mix(mix(rows[:, 0].view(U64)) + rows[:, 1].view(U64)) + rows[:, 2].view(U64))
            _, at, n = np.unique(key, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([*(pa.array(rows[at, j]) for j in range(3)), pa.array(n, pa.int64())], ["a", "b", "c", "n"])

        for batch in batches:
            for _, data, bounds in slices(batch.column("text"), TOGETHER):
                hashes, marks = tokens(data, bounds)
                ids = _ids(model, hashes)[1]
                last = np.zeros(len(ids), bool)
                last[marks[1:] - 1] = True
                two = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & ~last[:-1])
                three = two[np.isin(two + 1, two, assume_unique=True)]
                held.append(np.stack([ids[two], ids[two + 1], np.full(len(two), -1)], 1))
                held.append(np.stack([ids[three], ids[three + 1], ids[three + 2]], 1))
                if sum(map(len, held)) > HELD:
                    yield hand()
        if held:
            yield hand()

    return count


def _ids(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, back = np.unique(hashes, return_inverse=True)
    n, ids = model.counts(distinct)
    return n[back], ids[back]


# --- building ------------------------------------------------------------------

_FILE = "first bigint, name string, marks array<bigint>, widths array<array<bigint>>"


def _file(first: int, name: str, marks: list[int], widths: list | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([first], pa.int64()), pa.array([name]), pa.array([marks], pa.list_(pa.int64())), pa.array([widths], pa.list_(pa.list_(pa.int64())))],
        ["first", "name", "marks", "widths"],
    )


def _columns(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    parts = [[b.column(n).to_numpy(zero_copy_only=False) for n in names] for b in batches if b.num_rows]
    return [np.concatenate(p) for p in zip(*parts)] if parts else []


def _write_vocabulary(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _columns(batches, "order", "n", "id")
        if found:
            keys = (found[0].astype(np.int64).view(U64)) ^ U64(1 << 63)
            name, marks = _write(folder, [keys, found[1].astype(np.int64), found[2].astype(np.int64)])
            yield _file(int(found[0][0]), name, marks)

    return write


def _write_contexts(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _columns(batches, "id", "rest")
        if found:
            name, marks = _write(folder, [code(found[1].astype(float))])
            yield _file(int(found[0][0]), name, marks)

    return write


def _write_grams(folder: str, frequent: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _columns(batches, "a", "b", "c", "n", "context")
        if not found:
            return
        a, b, c, n, context = (x.astype(np.int64, copy=False) for x in found)
        two = np.flatnonzero(c < 0)
        parent = np.cumsum(c < 0) - 1  # every trigram follows its bigram
        three = np.flatnonzero(c >= 0)
        heads, rank = np.unique(a[two], return_inverse=True)
        levels = [EliasFano.encode(heads), EliasFano.encode(rank * frequent + b[two]), EliasFano.encode(parent[three] * frequent + c[three])]
        p2 = (n[two] - DISCOUNT) / context[two]
        p3 = (n[three] - DISCOUNT) / n[two][parent[three]]
        spent = np.bincount(parent[three], p3, len(two))
        arrays = [x for e in levels for x in (e.low, e.high, e.zeros.astype(np.int64))] + [code(p2), code(1 - spent), code(p3)]
        name, marks = _write(folder, arrays)
        yield _file(int(a[0] * frequent + b[0]), name, marks, [[e.n, e.width] for e in levels])

    return write


def _files(df: DataFrame) -> list[tuple]:
    """One row per file reaches the driver, in order of the keys."""
    return sorted((r.first, r.name, list(r.marks), [tuple(w) for w in r.widths or []]) for r in df.collect())


def train(texts: DataFrame) -> Model:
    """A model of all rows of `text`."""
    bounded_batches(texts.sparkSession)
    scratch = Scratch(texts.sparkSession, "language-model")
    folder = f"{scratch.root}/files"
    counted = texts.mapInArrow(_count_words, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    # Signed order of `order` is the unsigned order of the hash.
    counted = counted.select(F.col("w").bitwiseXOR(F.lit(-(1 << 63))).alias("order"), "n").repartitionByRange("order")
    counted = scratch.save(counted.withColumn("part", F.spark_partition_id()), "words")
    sizes = counted.groupBy("part").agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") >= WORD_COUNT)).collect()
    total, distinct, frequent, starts = sum(r[1] for r in sizes), sum(r[2] for r in sizes), 0, []
    for part, _, _, some in sorted(sizes):
        starts.append((part, frequent))
        frequent += some
    if not total:
        return Model(folder, [], [], [], 0, 0, 0)
    first = F.broadcast(texts.sparkSession.createDataFrame(starts, "part int, start bigint"))
    often = F.col("n") >= WORD_COUNT
    turn = F.sum(often.cast("bigint")).over(Window.partitionBy("part").orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
    numbered = counted.join(first, "part").withColumn("id", F.when(often, F.col("start") + turn - 1).otherwise(-1))
    numbered = scratch.save(numbered.select("part", "order", "n", "id"), "numbered")
    by_part = numbered.repartitionByRange("order").sortWithinPartitions("order")
    files = scratch.save(by_part.mapInArrow(_write_vocabulary(folder), _FILE), "vocabulary")
    vocabulary = [(f[0] + (1 << 63), *f[1:]) for f in _files(files)]
    model = Model(folder, vocabulary, [], [], frequent, total, distinct)

    grams = texts.mapInArrow(_count_grams(model), "a bigint, b bigint, c bigint, n bigint").groupBy("a", "b", "c").agg(F.sum("n").alias("n"))
    grams = scratch.save(grams.where(F.col("n") >= GRAM_COUNT), "grams")
    ids = numbered.where("id >= 0").select(F.col("id").alias("a"), F.col("n").alias("context"))
    pairs = grams.where("c < 0")
    spent = scratch.save(pairs.groupBy("a").agg(F.sum(F.col("n") - DISCOUNT).alias("spent")), "spent")
    rest = ids.join(spent, "a", "left").select(F.col("a").alias("id"), (1 - F.coalesce("spent", F.lit(0.0)) / F.col("context")).alias("rest"))
    contexts = scratch.save(rest.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(_write_contexts(folder), _FILE), "contexts")

    both = pairs.join(scratch.save(ids, "ids"), "a").unionByName(grams.where("c >= 0").withColumn("context", F.lit(0).cast("bigint")))
    both = both.select("a", "b", "c", "n", "context").repartitionByRange("a", "b").sortWithinPartitions("a", "b", "c")
    tries = scratch.save(both.mapInArrow(_write_grams(folder, frequent), _FILE), "tries")
    return Model(folder, vocabulary, _files(contexts), _files(tries), frequent, total, distinct)


# --- scoring -------------------------------------------------------------------


def token_scores(model: Model, hashes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training count, base and model log10 probability of every token."""
    n, ids = _ids(model, hashes)
    base = (n + 1) / (model.total + model.distinct + 1)
    p = base.copy()
    if not model.grams:
        return n, np.log10(base), np.log10(p)
    first = np.zeros(len(ids), bool)
    first[marks[:-1][np.diff(marks) > 0]] = True
    at = np.flatnonzero(~first)
    at = at[ids[at - 1] >= 0]  # tokens after a frequent word
    context, back = np.unique(ids[at - 1], return_inverse=True)
    rest1 = np.zeros(len(ids))
    rest1[at] = model.rests(context)[back]
    p[at] = rest1[at] * base[at]

    both = at[ids[at] >= 0]
    pair, back = np.unique(ids[both - 1] * model.frequent + ids[both], return_inverse=True)
    p2, rest2 = np.zeros(len(pair)), np.ones(len(pair))
    # Trigrams are asked for in the shard of the bigram that is their context.
    third = both[np.isin(both - 1, both, assume_unique=True)]
    place = np.full(len(ids), -1)
    place[both] = back
    asked = place[third - 1] * model.frequent + ids[third]
    triple, back3 = np.unique(asked, return_inverse=True)
    p3 = np.zeros(len(triple))
    owner = triple // model.frequent
    shards = {g[1]: k for k, g in enumerate(model.grams)}
    for part, _, name, _ in _split(pair, [g[0] for g in model.grams], model.grams):
        k = shards[name]
        heads, level2, level3, codes2, rests, codes3 = model.shard(k)
        a, b = pair[part] // model.frequent, pair[part] % model.frequent
        heads_of, back_a = np.unique(a, return_inverse=True)
        head = heads.find(heads_of)[back_a]
        node = np.where(head >= 0, level2.find(np.maximum(head, 0) * model.frequent + b), -1)
        hit = node >= 0
        p2[part] = np.where(hit, value(codes2[np.maximum(node, 0)]) if len(codes2) else 0.0, 0.0)
        rest2[part] = np.where(hit, value(rests[np.maximum(node, 0)]) if len(rests) else 1.0, 1.0)
        some = slice(*np.searchsorted(owner, [part.start, part.stop]))
        up = node[owner[some] - part.start]
        leaf = np.where(up >= 0, level3.find(np.maximum(up, 0) * model.frequent + triple[some] % model.frequent), -1)
        p3[some] = np.where(leaf >= 0, value(codes3[np.maximum(leaf, 0)]) if len(codes3) else 0.0, 0.0)
    p[both] += p2[back]
    after = at[np.isin(at - 1, both, assume_unique=True)]  # tokens after a pair of frequent words
    p[after] *= rest2[place[after - 1]]
    p[third] += p3[back3]
    return n, np.log10(base), np.log10(p)


def _score(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data, bounds in slices(batch.column("text"), TOGETHER):
                hashes, marks = tokens(data, bounds)
                n, base, own = token_scores(model, hashes, marks)
                cut = marks[:-1]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc").slice(start, len(cut)), pa.array(np.diff(marks), pa.int64()), pa.array(np.add.reduceat((n > 0).astype(np.int64), cut)),
                    pa.array(np.add.reduceat(base, cut)), pa.array(np.add.reduceat(own, cut)),
                ], ["doc", "n_tokens", "n_known", "base_score", "score"])

    return score


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`doc` (the kept columns) with `n_tokens`, `n_known`, `base_score` and `score`."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("doc"), F.col(text).alias("text"))
    schema = rows.select("doc").schema
    for name, kind in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())):
        schema = schema.add(name, kind)
    return rows.mapInArrow(_score(model), schema)


def held_out(id: Column) -> Column:
    """Documents whose crc32 of the id as text leaves 2 by 7; a null id leaves none."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op6_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))).select("text"))
    out = scored(docs, model)
    return out.select(
        "doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


QUERIES = {"op6_lm_score": op6_lm_score}
