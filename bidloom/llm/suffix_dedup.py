"""Removal of long byte strings that occur more than once, over a logarithmic family of suffix indexes.

Which suffixes are indexed. A full suffix array holds a row per byte. Here a
window of LENGTH bytes chooses one suffix inside it by content alone (the least
hash of a short gram among its first SPREAD places), so equal windows choose
equal suffixes; that leaves about 2 / SPREAD rows a byte. The windows that chose
a suffix make one entry `(shallow, deep)`: the fingerprint of the suffix's first
LENGTH - SPREAD bytes, which all these windows contain, and the fingerprint of
the bytes that they span together. Suffixes are ordered by these: any order
serves that puts equal long prefixes side by side.

The family. Documents arrive in batches. A batch's suffix array is its sorted
run of distinct entries; it is merge-scanned against every level there is, and
equal neighbours (or entries that the batch holds twice) are long matches. Then
it becomes a level; before the next batch arrives, equal-sized levels merge, so
n batches leave at most log2(n) + 1 levels and every entry is rewritten at most
log2(n) times.

What is decided. Windows whose deep fingerprint matched are all repeated. Where
only the shallow one matched, they lie at the edge of a repeat. There the windows
are taken in parts of PART, by their distance from the chosen suffix, and parts
are judged likewise by the bytes that all of a part's windows contain and those
that they span; what is open after that is compared window by window. No other
window is repeated. So the result is exact up to 64-bit collisions.

Defined results: a null text is empty and keeps the digest of nothing; texts
shorter than LENGTH lose nothing by themselves; copies of a text (repeated rows
too) remove each other whole; rows with equal or null ids each get their row; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.spans import _BYTE, U64, _power, mix, slices
from bidloom.llm.tables import table
from bidloom.session import Scratch

LENGTH = 400
SPREAD = 200
GRAM = 32
BATCHES = 4
PART = 16
_LOW = U64(0xFFFFFFFF)


class Windows:
    """All windows of the texts in one run of bytes, grouped by the suffix they chose."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        n = len(data)
        power, self._inverse = _power(n + 1)
        self._total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[data] * power[:n], out=self._total[1:])
        ends = np.repeat(bounds[1:], np.diff(bounds))
        valid = np.arange(n) + LENGTH <= ends
        starts = np.flatnonzero(valid)
        self.first = self.last = np.zeros(0, np.int64)
        self.owner = self.sample = self.shallow = self.deep = self.first
        if not len(starts):
            return
        grams = self.hash_at(np.arange(n - GRAM + 1), GRAM)
        low = (grams & ~_LOW) | np.arange(len(grams), dtype=U64)
        width = 1
        while 2 * width <= SPREAD:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (SPREAD - width)], low[SPREAD - width:])
        chosen = (low[starts] & _LOW).astype(np.int64)
        doc = np.searchsorted(bounds, starts, "right") - 1
        new = np.ones(len(starts), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        self.first = starts[at]
        self.last = starts[np.concatenate([at[1:], [len(starts)]]) - 1]
        self.owner = doc[at]
        self.sample = chosen[at]
        self.shallow = mix(self.hash_at(chosen[at], LENGTH - SPREAD) + U64(1)).view(np.int64)
        self.deep = self.span(self.first, self.last, 2)

    def hash_at(self, place: np.ndarray, length: int) -> np.ndarray:
        return mix((self._total[place + length] - self._total[place]) * self._inverse[place])

    def span(self, first: np.ndarray, last: np.ndarray, salt: int) -> np.ndarray:
        """Fingerprints of the bytes from the windows first through the windows last, at most LENGTH on."""
        a, b = self.hash_at(first, LENGTH), self.hash_at(last, LENGTH)
        return mix(a + mix(b + (last - first).astype(U64) * U64(0xD6E8FEB86659FD93)) + U64(salt)).view(np.int64)

    def parts(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Parts of the given entries: entry, first and last window, what all windows at these distances contain, what these windows span."""
        first, last, sample = self.first[runs], self.last[runs], self.sample[runs]
        low, high = (sample - last) // PART, (sample - first) // PART
        run, turn = _expand(high - low + 1)
        near = sample[run] - PART * (low[run] + turn)
        a, b = np.maximum(first[run], near - PART + 1), np.minimum(last[run], near)
        core = mix(self.hash_at(near, LENGTH - PART + 1) + U64(5)).view(np.int64)
        return runs[run], a, b, core, self.span(a, b, 4)

    def single(self, windows: np.ndarray) -> np.ndarray:
        return mix(self.hash_at(windows, LENGTH) + U64(3)).view(np.int64)


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every index as often as its count says, and the turn of each."""
    index = np.repeat(np.arange(len(counts)), counts)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)


def _between(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges first..last, and the range of each."""
    index, turn = _expand(last - first + 1)
    return first[index] + turn, index


def _lists(values: np.ndarray, owner: np.ndarray, count: int) -> pa.ListArray:
    """A list per text of the values that it owns; owners rise."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(count + 1)), pa.int32()), pa.array(values, pa.int64()))


def _known(batch: pa.RecordBatch, start: int, count: int, *names: str) -> list[np.ndarray]:
    """Fingerprints told to any of the texts. What holds for a fingerprint holds for it in every text."""
    return [np.unique(batch.column(n).slice(start, count).flatten().to_numpy(zero_copy_only=False)) for n in names]


def _holds(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(found, keys), len(found) - 1)
    return found[at] == keys


def _once(used: np.ndarray, matched: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which are used, of matched ones with the same key only the first: one occurrence is all that a match with it needs."""
    again = used & matched
    again[np.flatnonzero(again)[np.unique(keys[again], return_index=True)[1]]] = False
    return np.flatnonzero(used & ~again)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, data, bounds in slices(batch.column("text")):
            w, n = Windows(data, bounds), len(bounds) - 1
            yield pa.RecordBatch.from_arrays([batch.column("tid").slice(start, n), _lists(w.shallow, w.owner, n), _lists(w.deep, w.owner, n)], ["tid", "shallow", "deep"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of all entries under an open shallow fingerprint."""
    for batch in batches:
        for start, data, bounds in slices(batch.column("text")):
            w, n = Windows(data, bounds), len(bounds) - 1
            whole, open_ = _known(batch, start, n, "whole", "open")
            run, _, _, core, span = w.parts(_once(_holds(open_, w.shallow), _holds(whole, w.deep), w.deep))
            yield pa.RecordBatch.from_arrays([batch.column("tid").slice(start, n), _lists(core, w.owner[run], n), _lists(span, w.owner[run], n)], ["tid", "shallow", "deep"])


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single windows of parts that are still open."""
    for batch in batches:
        for start, data, bounds in slices(batch.column("text")):
            w, n = Windows(data, bounds), len(bounds) - 1
            open_, whole_parts, open_parts = _known(batch, start, n, "open", "whole_parts", "open_parts")
            run, a, b, core, span = w.parts(np.flatnonzero(_holds(open_, w.shallow)))
            used = _once(_holds(open_parts, core), _holds(whole_parts, span), span)
            place, part = _between(a[used], b[used])
            order = np.argsort(w.owner[run[used]][part], kind="stable")
            yield pa.RecordBatch.from_arrays([batch.column("tid").slice(start, n), _lists(w.single(place)[order], w.owner[run[used]][part][order], n)], ["tid", "keys"])


def repeated_windows(w: Windows, size: int, whole, open_, whole_parts, open_parts, single) -> np.ndarray:
    """Which places of the bytes begin a repeated window."""
    steps = np.zeros(size + 1, np.int64)
    sure = _holds(whole, w.deep)
    run, a, b, core, span = w.parts(np.flatnonzero(_holds(open_, w.shallow) & ~sure))
    sure_part = _holds(whole_parts, span)
    for first, last in ((w.first[sure], w.last[sure]), (a[sure_part], b[sure_part])):
        np.add.at(steps, first, 1)
        np.add.at(steps, last + 1, -1)
    out = np.cumsum(steps[:-1]) > 0
    rest = np.flatnonzero(_holds(open_parts, core) & ~sure_part)
    place, _ = _between(a[rest], b[rest])
    out[place[_holds(single, w.single(place))]] = True
    return out


def whole_characters(text: bytes, spans: list[list[int]]) -> str:
    """The text without the spans, of which a character at a span's edge that is only partly inside is kept."""
    out, at = [], 0
    inside = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    for a, b in spans:
        while inside(a):
            a += 1
        while b > a and inside(b):
            b -= 1
        if b > a:
            out.append(text[at:a])
            at = b
    return b"".join([*out, text[at:]]).decode()


def _cut(with_text: bool):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data, bounds in slices(batch.column("text")):
                w, n, size = Windows(data, bounds), len(bounds) - 1, len(data)
                repeated = repeated_windows(w, size, *_known(batch, start, n, "whole", "open", "whole_parts", "open_parts", "single"))
                steps = np.zeros(size + LENGTH + 1, np.int64)
                at = np.flatnonzero(repeated)
                steps[at] += 1
                steps[at + LENGTH] -= 1
                gone = np.concatenate([np.cumsum(steps)[:size] > 0, [False]])
                lost = np.concatenate([[0], np.cumsum(gone[:-1])])
                rows = []
                for doc in np.flatnonzero(np.diff(lost[bounds])).tolist():
                    a, b = int(bounds[doc]), int(bounds[doc + 1])
                    edge = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    left = data[a:b][~gone[a:b]].tobytes()
                    text = whole_characters(data[a:b].tobytes(), edge.tolist()) if with_text else None
                    rows.append((start + doc, b - a - len(left), [{"start": x, "end": y} for x, y in edge.tolist()], hashlib.sha256(left).hexdigest(), text))
                doc, *columns = map(list, zip(*rows)) if rows else ([],) * 5
                kinds = [pa.int64(), spans_type, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("tid").take(pa.array(doc, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    ["tid", "n_removed", "spans", "kept_sha256", "kept_text"],
                )

    return cut


def text_id(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


class SuffixIndex:
    """The family of levels: sorted runs of `(shallow, deep, n)` whose sizes are different powers of two of a batch."""

    def __init__(self, scratch: Scratch):
        self.scratch = scratch
        self.levels: list[tuple[int, DataFrame]] = []

    def _run(self, entries: DataFrame) -> DataFrame:
        """Distinct entries as one sorted run; `n` counts to two, which is all that a match needs."""
        counted = entries.groupBy("shallow", "deep").agg(F.least(F.sum("n"), F.lit(2)).alias("n"))
        return self.scratch.save(counted.sortWithinPartitions("shallow", "deep"), "run")

    def append(self, entries: DataFrame) -> DataFrame:
        """Add a batch of `(shallow, deep)`; returns the matches it makes, within itself or with a level, as `(kind, key)`."""
        self._merge()
        run = self._run(entries.withColumn("n", F.lit(1).cast("bigint")))
        twice = run.groupBy("shallow").agg(F.sum("n").alias("n")).where("n > 1")
        hits = run.where("n > 1").select(F.lit("deep").alias("kind"), F.col("deep").alias("key"))
        hits = hits.unionAll(twice.select(F.lit("shallow"), "shallow"))
        for _, level in self.levels:
            both = run.select("shallow", "deep").join(level.select("shallow", "deep"), ["shallow", "deep"])
            side = run.select("shallow").distinct().join(level.select("shallow"), "shallow", "left_semi")
            hits = hits.unionAll(both.select(F.lit("deep"), "deep")).unionAll(side.select(F.lit("shallow"), "shallow"))
        self.levels.append((1, run))
        return self.scratch.save(hits, "hits")

    def _merge(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, self._run(a.unionAll(b))))
            self.scratch.drop(a, b)


def _judged(entries: DataFrame, shallow: DataFrame, deep: DataFrame, names: tuple[str, str], scratch: Scratch) -> DataFrame:
    """Per text, its deep fingerprints that matched and its shallow ones under which some entry is open.

    `entries(tid, shallow, deep)`; `shallow` and `deep` are the fingerprints that occur twice.
    """
    met = entries.select("tid", "shallow", "deep").distinct().join(shallow, "shallow")
    met = scratch.save(met.join(deep.withColumn("whole", F.lit(True)), "deep", "left"), "met")
    edge = scratch.save(met.where("whole IS NULL").select("shallow").distinct().withColumn("edge", F.lit(True)), "edge")
    own = met.join(edge, "shallow", "left").groupBy("tid").agg(
        F.collect_set(F.when(F.col("whole"), F.col("deep"))).alias(names[0]), F.collect_set(F.when(F.col("edge"), F.col("shallow"))).alias(names[1])
    )
    return scratch.save(own, "own")


def _zipped(entries: DataFrame, *keep: str) -> DataFrame:
    return entries.select(*keep, "tid", F.explode(F.arrays_zip("shallow", "deep")).alias("e")).select(*keep, "tid", "e.shallow", "e.deep")


def _twice(rows: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    return scratch.save(rows.groupBy(name).count().where("count > 1").select(name), "twice")


def repeated_spans(docs: DataFrame, text: str = "text", batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """`(tid, n_removed, spans, kept_sha256, kept_text)` of every distinct text that loses bytes; `tid` is the text's 64-bit hash."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    texts = docs.select(text_id(text).alias("tid"), F.col(text).alias("text"))
    schema = "tid bigint, shallow array<bigint>, deep array<bigint>"
    entries = texts.mapInArrow(_entries, schema).where(F.size("deep") > 0)
    entries = _zipped(scratch.save(entries.withColumn("batch", F.pmod("tid", F.lit(batches)).cast("int")), "entries", ("batch",)), "batch")

    index, hits = SuffixIndex(scratch), None
    for j in range(batches):
        new = index.append(entries.where(F.col("batch") == j).select("shallow", "deep"))
        hits = new if hits is None else hits.unionAll(new)
    hits = scratch.save(hits.distinct(), "all-hits")
    side = lambda kind: hits.where(F.col("kind") == kind).select(F.col("key").alias(kind))
    own = _judged(entries, side("shallow"), side("deep"), ("whole", "open"), scratch)
    # One copy of every text travels from each task, however many rows hold it.
    near = texts.groupBy("tid").agg(F.first("text").alias("text")).join(own, "tid").select("tid", "text", "whole", "open")
    near = scratch.save(near, "near")

    parts = _zipped(scratch.save(near.where(F.size("open") > 0).mapInArrow(_parts, schema).where(F.size("deep") > 0), "parts"))
    own = _judged(parts, _twice(parts, "shallow", scratch), _twice(parts, "deep", scratch), ("whole_parts", "open_parts"), scratch)
    left = near.select("tid", "text", "open").join(own.where(F.size("open_parts") > 0), "tid")
    singles = scratch.save(left.mapInArrow(_singles, "tid bigint, keys array<bigint>").where(F.size("keys") > 0), "singles")
    singles = singles.select("tid", F.explode("keys").alias("key"))
    single = singles.distinct().join(_twice(singles, "key", scratch), "key").groupBy("tid").agg(F.collect_set("key").alias("single"))
    near = near.join(scratch.save(own.join(single, "tid", "left"), "known"), "tid", "left")
    schema = "tid bigint, n_removed bigint, spans array<struct<start bigint, end bigint>>, kept_sha256 string, kept_text string"
    cut = near.mapInArrow(_cut(with_text), schema).where("n_removed > 0")
    return scratch.save(cut, "cut")


def remove_repeats(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """Every row with its text cut; `length` names a column of the text's characters to keep in step."""
    cut = repeated_spans(docs, text, with_text=True).select("tid", "kept_text")
    rows = docs.select(F.struct("*").alias("doc"), text_id(text).alias("tid")).join(cut, "tid", "left")
    new = {text: F.coalesce("kept_text", F.col(f"doc.{text}"))}
    if length:
        new[length] = F.when(F.col("kept_text").isNull(), F.col(f"doc.{length}")).otherwise(F.length("kept_text")).cast(docs.schema[length].dataType)
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op4_suffix_dedup(spark, sf_dir):
    """The contract's columns, then the bytes left and the text left (bytes that are no UTF-8 any more are replaced in it)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    base = docs.select("doc_id", text_id("text").alias("tid"), F.octet_length(raw).cast("bigint").alias("n_bytes"), F.sha2(raw, 256).alias("sha"), F.coalesce("text", F.lit("")).alias("own"))
    cut = repeated_spans(docs, with_text=True).select("tid", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256", "kept_text")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return base.join(cut, "tid", "left").select(
        "doc_id", "n_bytes", zero("n_removed").alias("n_removed"), zero("n_spans").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        (F.col("n_bytes") - zero("n_removed")).alias("kept_bytes"), F.coalesce("kept_text", "own").alias("text"),
    )


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
