"""Which of many names stand in which of many texts, by multi-pattern automata.

Names are dealt by their first characters to shards small enough for one automaton
each; names that begin alike and are too many for one are divided among several. A text
goes to the shards that may hold a name beginning somewhere in it, which
a bit table of all beginnings tells, and of the text only the pieces from there on as
long as the longest name. A shard that many pieces go to is divided into parts; a task
takes the names of one cell (shard, part) first, builds their automaton once and runs
it over the cell's pieces. So a name travels once per part of its own shard, a text to
few shards however many there are, and neither side has to fit anywhere whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.session import Scratch

#: Characters of names in one automaton.
SHARD_CHARS = 2_000_000
#: Texts of a part.
PART_TEXTS = 100_000
#: Characters that a name is dealt by; a shorter one is dealt by all it has.
HEAD = 14
#: Bits of the table for each name, tests for each beginning, and the bounds of the table.
NAME_BITS, TESTS = 16, 4
LEAST_BITS, MOST_BITS = 20, 28
#: Bits that one group puts together.
BLOCK = 20
#: Characters of texts looked at in one step.
STRETCH = 1 << 20

_U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _beginnings(letters: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the `size` letters from every place that has as many after it."""
    h = np.full(max(0, len(letters) - size + 1), size, _U)
    for i in range(size):
        h = h * _U(0x9E3779B97F4A7C15) + letters[i:i + len(h)]
    return _mixed(h)


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(_U)


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (h >> _U(32)) | _U(1)
    return [((h + _U(i) * step) & _U((1 << bits) - 1)).astype(np.int64) for i in range(TESTS)]


def _hashed(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Every name with the hash of its beginning and the shard which that is dealt to."""
    for batch in batches:
        names = batch.column("name").to_pylist()
        heads = [n[:HEAD] for n in names]
        out = np.zeros(len(heads), _U)
        for size in {len(h) for h in heads}:
            at = [i for i, h in enumerate(heads) if len(h) == size]
            # Beginnings of one length stand one behind the other: each hash is taken where one starts.
            out[at] = _beginnings(_letters("".join(heads[i] for i in at)), size)[::size]
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out.view(np.int64)), pa.array((out % _U(shards)).astype(np.int32))], ["name", "hash", "shard"])


def _table(hashed: DataFrame, bits: int) -> np.ndarray:
    """The bit table of all beginnings: at most 2 ** MOST_BITS bits, put together block by block."""
    block = min(BLOCK, bits)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_places(batch.column("hash").to_numpy().view(_U), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> block).astype(np.int32)), pa.array((at & ((1 << block) - 1)).astype(np.int32))], ["block", "place"])

    def packed(rows: pa.Table) -> pa.Table:
        out = np.zeros(1 << block, bool)
        out[rows.column("place").to_numpy()] = True
        return pa.table({"block": rows.column("block").slice(0, 1), "bits": pa.array([np.packbits(out).tobytes()], pa.binary())})

    found = hashed.select("hash").distinct().mapInArrow(places, "block int, place int").distinct().groupBy("block").applyInArrow(packed, "block int, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (block - 3)
    for row in found.toLocalIterator():
        out[row["block"] * width:(row["block"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return out


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """The ids and texts of a batch, some STRETCH characters at a time."""
    texts, start, size = batch.column("text").to_pylist(), 0, 0
    for i, text in enumerate(texts, 1):
        size += len(text)
        if size >= STRETCH or i == len(texts):
            yield batch.column("id").slice(start, i - start), texts[start:i]
            start, size = i, 0


def _router(table: np.ndarray, bits: int, sizes: list[int], longest: int, shards: int):
    """Pieces of every text by the shard that may hold a name beginning there."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in (x for batch in batches for x in _stretches(batch)):
            ends = np.cumsum([len(t) for t in texts])
            letters, starts = _letters("".join(texts)), np.concatenate([[0], ends[:-1]])
            place, shard = [], []
            for size in sizes:
                h = _beginnings(letters, size)
                hit = np.arange(len(h))
                for i in range(TESTS):
                    at = _places(h[hit], bits)[i]
                    hit = hit[(table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0]
                hit = hit[hit + size <= ends[np.searchsorted(ends, hit, "right")]]
                place.append(hit)
                shard.append((h[hit] % _U(shards)).astype(np.int64))
            place, shard = np.concatenate(place), np.concatenate(shard)
            if not len(place):
                continue
            row = np.searchsorted(ends, place, "right")
            order = np.lexsort((place, shard, row))
            row, shard, place = row[order], shard[order], place[order]
            new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(shard, prepend=-1) != 0))
            pieces = []
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(row)]):
                text, own, low, high = texts[row[a]], [], -1, -1
                for p in (place[a:b] - starts[row[a]]).tolist():
                    if p > high:
                        if high > low:
                            own.append(text[low:high])
                        low = p
                    high = p + longest
                pieces.append([*own, text[low:high]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[new].astype(np.int32)), ids.take(pa.array(row[new])), pa.array(pieces, pa.list_(pa.string()))], ["shard", "id", "pieces"]
            )

    return route


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    cell, automaton = None, None
    for batch in batches:
        where, kind = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero((where[1:] != where[:-1]) | (kind[1:] != kind[:-1])) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)]):
            if start == stop:
                continue
            if where[start] != cell:
                cell, automaton = where[start], ahocorasick.Automaton()
            texts = batch.column("pieces").slice(start, stop - start).to_pylist()
            if kind[start] == 0:
                for (name,) in texts:
                    automaton.add_word(name, name)
                continue
            if automaton.kind == ahocorasick.TRIE:
                automaton.make_automaton()
            if automaton.kind != ahocorasick.AHOCORASICK:
                continue  # a cell without names
            rows, found = [], []
            for i, pieces in enumerate(texts, start):
                here = sorted({name for piece in pieces for _, name in automaton.iter(piece)})
                rows += [i] * len(here)
                found += here
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(found, pa.string())], ["id", "name"])


def names_in_texts(texts: DataFrame, names: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """`(id, name)` for every text (id, text) and every name (name) that stands in it, letter for letter.

    Null and empty names and texts match nothing; a repeated name is one name.
    """
    names = names.where(F.length("name") > 0).select("name").distinct()
    texts = texts.where(F.length("text") > 0).select("id", "text")
    kind = texts.schema["id"].dataType
    schema = texts.select("id").schema.add("name", "string")
    scratch = Scratch(texts.sparkSession, "names")
    names, length = scratch.save(names, "names"), F.length("name")
    facts = names.agg(F.count("*").alias("n"), F.sum(length).alias("chars"), F.max(length).alias("longest"), F.collect_set(F.least(length, F.lit(HEAD))).alias("sizes")).first()
    if not facts["n"]:
        return texts.sparkSession.createDataFrame([], schema)
    shards = max(1, -(-facts["chars"] // shard_chars))
    hashed = scratch.save(names.mapInArrow(lambda batches: _hashed(batches, shards), "name string, hash bigint, shard int"), "hashed")
    bits = min(max((facts["n"] * NAME_BITS).bit_length(), LEAST_BITS), MOST_BITS)
    route = _router(_table(hashed, bits), bits, sorted(facts["sizes"]), facts["longest"], shards)
    routed = scratch.save(texts.mapInArrow(route, f"shard int, id {kind.simpleString()}, pieces array<string>"), "pieces")

    # Parts of a shard by the texts that go to it, automata of a part by the names; a shard that no text goes to needs none.
    parts = routed.groupBy("shard").agg(F.ceil(F.count("*") / PART_TEXTS).cast("int").alias("parts"))
    automata = hashed.groupBy("shard").agg(F.ceil(F.sum(length) / (2 * shard_chars)).cast("int").alias("automata"))
    plan = scratch.save(parts.join(automata, "shard"), "plan")
    total = plan.agg(F.coalesce(F.sum(F.col("parts") * F.col("automata")), F.lit(0))).first()[0]
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    sent = hashed.join(F.broadcast(plan), "shard").select(
        "shard", F.pmod(F.xxhash64("name"), F.col("automata")).cast("int").alias("automaton"), every("parts").alias("part"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("id"), F.array("name").alias("pieces")
    )
    read = routed.join(F.broadcast(plan), "shard").select(
        "shard", every("automata").alias("automaton"), F.pmod(F.xxhash64("id", "pieces"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "id", "pieces"
    )
    cells = sent.unionAll(read).select(F.xxhash64("shard", "automaton", "part").alias("cell"), "kind", "id", "pieces")
    dealt = cells.repartition(max(1, total), "cell").sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(_search, schema)
