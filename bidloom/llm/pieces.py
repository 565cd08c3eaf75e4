"""SentencePiece encoding and decoding in batches of equal-length words.

A text becomes segments, a run of spaces with the word after it. The distinct
segments of a batch are sorted by length, and those of one length form a matrix
that advances together: hashes of all substrings are probed in the sorted piece
keys, which gives a lattice of piece numbers by (word, start, length). Over it

* `viterbi` takes, place by place, the vectorised maximum of the scores and
  stores backpointers: the segmentation that a unigram model defines;
* `merges` joins, round by round, the best-ranked neighbouring pair of every
  word at once: the segmentation that a byte-pair model defines.

The model file says which of the two it is. The path of the file is a parameter;
the text is read as the file's identity normaliser asks: one space put in front,
spaces shown as U+2581, nothing else changed. Characters without a piece become
byte pieces.

Defined results: null and empty texts have no pieces and decode to an empty text;
a text of any length is encoded whole; repeated rows are encoded alike; an empty
table gives an empty result; other columns travel in `doc`. A literal U+2581
decodes to a space, as in every tokenizer of this kind.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.llm.spans import U64, mix
from bidloom.llm.tables import table
from bidloom.session import bounded_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, USER, BYTE = 1, 4, 6
NONE = -1
#: Segments up to this length advance as matrices; longer ones are taken one at a time.
LONGEST_TOGETHER = 64
#: Segments remembered by a worker; the memory starts anew when it is full.
REMEMBERED = 400_000
_POINT = U64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Pieces:
    """A model's pieces, with the hashes of the matchable ones sorted for probing."""

    kind: int
    names: list[str]
    scores: np.ndarray
    keys: np.ndarray
    ids: np.ndarray
    longest: int
    bytes_: np.ndarray
    unknown: int
    splits: bool

    @cached_property
    def directory(self) -> np.ndarray:
        """Where the sorted keys of each leading 16 bits begin."""
        return np.searchsorted(self.keys, np.arange(1 << 16, dtype=U64) << U64(48)).astype(np.int32)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """The piece of every key: the sorted keys are entered at the key's leading bits and read on from there."""
        shape, keys = keys.shape, keys.ravel()
        found = np.full(len(keys), NONE, np.int64)
        lead = (keys >> U64(48)).astype(np.int64)
        at = self.directory[lead].astype(np.int64)
        end = np.append(self.directory, len(self.keys))[lead + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            place = at[left]
            hit = self.keys[place] == keys[left]
            found[left[hit]] = self.ids[place[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return found.reshape(shape)


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _extend(key: np.ndarray, point: np.ndarray) -> np.ndarray:
    return mix(key * U64(3) + (point.astype(U64) + U64(1)) * _POINT)


def build(kind: int, names: list[str], scores, types, unknown: int) -> Pieces:
    usable = [i for i, t in enumerate(types) if t in (NORMAL, USER)]
    by_length: dict[int, list[int]] = {}
    for i in usable:
        by_length.setdefault(len(names[i]), []).append(i)
    keys, ids = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for length, some in by_length.items():
        grid = _points([names[i] for i in some]).reshape(len(some), length)
        key = np.zeros(len(some), U64)
        for k in range(length):
            key = _extend(key, grid[:, k])
        keys.append(key)
        ids.append(np.array(some, np.int64))
    keys, ids = np.concatenate(keys), np.concatenate(ids)
    order = np.argsort(keys, kind="stable")
    bytes_ = np.full(256, unknown, np.int64)
    for i, t in enumerate(types):
        if t == BYTE:
            bytes_[int(names[i][1:-1], 16)] = i
    inner = any(SPACE in n.lstrip(SPACE) for n in (names[i] for i in usable))
    return Pieces(kind, names, np.asarray(scores, float), keys[order], ids[order], max(by_length, default=1), bytes_, unknown, not inner)


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("only models with an identity normaliser and a leading space are read")
    p = model.pieces
    return build(model.trainer_spec.model_type, [x.piece for x in p], [x.score for x in p], [x.type for x in p], model.trainer_spec.unk_id)


def lattice(pieces: Pieces, grid: np.ndarray) -> np.ndarray:
    """Piece numbers of all substrings of equally long words: (word, start, length - 1), NONE where there is no piece."""
    n, length = grid.shape
    most = min(length, pieces.longest)
    out = np.full((n, length, most), NONE, np.int64)
    key = np.zeros((n, length), U64)
    for k in range(most):
        width = length - k
        key = _extend(key[:, :width], grid[:, k:])
        out[:, :width, k] = pieces.probe(key)
    return out


def viterbi(pieces: Pieces, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best path of every word as marks between pieces and their number; a character without a piece costs more than any piece."""
    n, length, most = cells.shape
    scores = np.where(cells == NONE, -np.inf, pieces.scores[cells])
    lonely = pieces.scores.min() - 10.0
    scores[:, :, 0] = np.where(cells[:, :, 0] == NONE, lonely, scores[:, :, 0])
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, length + 1), np.int64)
    for end in range(1, length + 1):
        widths = np.arange(1, min(end, most) + 1)
        reach = best[:, end - widths] + scores[:, end - widths, widths - 1]
        at = reach.argmax(1)
        best[:, end] = reach[np.arange(n), at]
        back[:, end] = widths[at]
    # All words walk back together; marks are filled from the end and then moved to the front.
    marks = np.full((n, length + 1), length)
    count, end, rows = np.zeros(n, np.int64), np.full(n, length), np.arange(n)
    while len(rows):
        end[rows] -= back[rows, end[rows]]
        count[rows] += 1
        marks[rows, length - count[rows]] = end[rows]
        rows = rows[end[rows] > 0]
    take = np.minimum(np.arange(length + 1)[None, :] + (length - count)[:, None], length)
    return np.take_along_axis(marks, take, 1), count


def merges(pieces: Pieces, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte-pair segmentation of every word as marks between pieces and their number: best score first, leftmost on a tie.

    A piece is known by its start. What joining it with the piece after it costs is kept by start,
    and a round changes it only for the piece that grew and the one before.
    """
    n, length, most = cells.shape
    every, ends = np.arange(n), np.tile(np.arange(1, length + 2), (n, 1))
    before = np.tile(np.arange(-1, length), (n, 1))
    live = np.ones((n, length), bool)
    cost = np.full((n, length), np.inf)

    def price(rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The cost of a piece from start to end; none where it would be too long or leave the word."""
        width = end - start
        piece = cells[rows, start, np.clip(width, 1, most) - 1]
        return np.where((width <= most) & (end <= length) & (piece != NONE), -pieces.scores[piece], np.inf)

    for k in range(length - 1):
        cost[:, k] = price(every, np.full(n, k), np.full(n, k + 2))
    alive = every
    while len(alive):
        now = cost[alive]
        at = now.argmin(1)
        go = np.isfinite(now[np.arange(len(alive)), at])
        alive, at = alive[go], at[go]
        second = ends[alive, at]
        stop = ends[alive, second]
        ends[alive, at] = stop
        live[alive, second], cost[alive, second] = False, np.inf
        before[alive, stop] = at
        # The last column of `ends` lies beyond the word, so a piece without a successor costs too much.
        cost[alive, at] = price(alive, at, np.where(stop < length, ends[alive, np.minimum(stop, length)], length + 1))
        left = before[alive, at]
        some = left >= 0
        cost[alive[some], left[some]] = price(alive[some], left[some], stop[some])
    count = live.sum(1)
    marks = np.full((n, length + 1), length)
    row, start = np.nonzero(live)
    marks[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = start
    return marks, count


def _one_long(pieces: Pieces, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same two segmentations for one long word, whose merges are too many to be made one a round; its lattice, marks and count."""
    cells = lattice(pieces, points[None, :])
    if pieces.kind == UNIGRAM:
        return cells, *viterbi(pieces, cells)
    grid, cells, length = cells, cells[0], len(points)
    most = cells.shape[1]
    after, before = list(range(1, length + 1)), list(range(-1, length - 1))
    end = list(range(1, length + 1))
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < length and end[j] - i <= most and cells[i, end[j] - i - 1] != NONE:
            heapq.heappush(heap, (-pieces.scores[cells[i, end[j] - i - 1]], i, end[i], end[j]))

    for i in range(length):
        offer(i)
    gone = bytearray(length)
    while heap:
        _, i, middle, last = heapq.heappop(heap)
        j = after[i]
        if gone[i] or end[i] != middle or j >= length or end[j] != last:
            continue
        gone[j] = 1
        end[i], after[i] = last, after[j]
        if after[i] < length:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    marks = np.array([i for i in range(length) if not gone[i]] + [length])
    return grid, marks[None, :], np.array([len(marks) - 1])


def segment(pieces: Pieces, words: list[str]) -> list[list[int]]:
    """Piece numbers of every word."""
    solve = viterbi if pieces.kind == UNIGRAM else merges
    out: list[list[int]] = [[]] * len(words)
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_length.setdefault(len(word), []).append(i)
    for length, members in by_length.items():
        step = max(1, 2_000_000 // (length * min(length, pieces.longest) + 1))
        for k in range(0, len(members), step):
            some = members[k:k + step]
            grid = _points([words[i] for i in some]).reshape(len(some), length)
            if length <= LONGEST_TOGETHER:
                cells = lattice(pieces, grid)
                solved = [(some, cells, *solve(pieces, cells))]
            else:
                solved = [([i], *_one_long(pieces, row)) for i, row in zip(some, grid)]
            for members_, cells, marks, count in solved:
                row = np.repeat(np.arange(len(members_)), count)
                place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start, end = marks[row, place], marks[row, place + 1]
                flat = cells[row, start, end - start - 1]
                lost = np.zeros(len(members_), bool)
                lost[row[flat == NONE]] = True
                ids, at = flat.tolist(), [0, *np.cumsum(count).tolist()]
                for r, i in enumerate(members_):
                    out[i] = ids[at[r]:at[r + 1]]
                    if lost[r]:
                        out[i] = list(chain.from_iterable(
                            [p] if p != NONE else pieces.bytes_[list(words[i][a:a + 1].encode("utf-8", "replace"))].tolist()
                            for p, a in zip(out[i], start[at[r]:at[r + 1]].tolist())
                        ))
    return out


_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Codec:
    """Encodes and decodes texts, remembering a bounded number of segments."""

    def __init__(self, path: str = MODEL, pieces: Pieces | None = None):
        self.pieces = pieces or load(path)
        self._forget()
        self.names: list[str | int] = []
        byte = {i: b for b, i in enumerate(self.pieces.bytes_.tolist()) if i != self.pieces.unknown}
        for i, name in enumerate(self.pieces.names):
            self.names.append(byte.get(i, name.replace(SPACE, " ")))
        self.is_byte = np.array([isinstance(n, int) for n in self.names])
        self.letters = np.array([1 if isinstance(n, int) else len(n) for n in self.names])

    def _forget(self) -> None:
        """Nothing is known: the number of a segment, where each one's piece numbers begin in `flat`, and the segments that they do not decode to."""
        self.known: dict[str, int] = {}
        self.flat, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.lost: set[str] = set()

    def _segments(self, texts: list[str]) -> list[list[str]]:
        """Segments of every text, each of them known afterwards."""
        spaced = [(SPACE + t.replace(" ", SPACE)) if t else "" for t in texts]
        cut = [_SEGMENT.findall(t) if self.pieces.splits else [t] * bool(t) for t in spaced]
        if len(self.known) > REMEMBERED:
            self._forget()
        new = [w for w in {w for c in cut for w in c} if w not in self.known]
        ids = segment(self.pieces, new)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(size)])
        self.lost.update(self._not_decoded(new, ids))
        return cut

    def _not_decoded(self, words: list[str], ids: list[list[int]]) -> list[str]:
        """The words that their pieces do not decode to. Words of plain pieces are decoded in one go: all are right when each has its length and the whole is right."""
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(ids)), size)
        plain = np.bincount(owner, self.is_byte[flat], len(ids)) == 0
        letters = np.bincount(owner, self.letters[flat], len(ids))
        said = "".join(map(self.names.__getitem__, flat[plain[owner]].tolist()))
        chosen = [w for w, p in zip(words, plain.tolist()) if p]
        right = said == "".join(chosen).replace(SPACE, " ") and letters[plain].tolist() == list(map(len, chosen))
        return [w for w, i, p in zip(words, ids, plain.tolist()) if not (p and right) and self._said(i) != w.replace(SPACE, " ")]

    def encode(self, texts: list[str]) -> list[list[int]]:
        flat, marks = self._joined(self._segments(texts))
        return [flat[a:b].tolist() for a, b in zip(marks[:-1], marks[1:])]

    def _joined(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all segments in a row, and where each text's begin (n + 1 marks)."""
        count = [len(c) for c in cut]
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, sum(count))
        begin = self.begin[number]
        size = self.begin[number + 1] - begin
        mark = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(begin - mark[:-1], size) + np.arange(mark[-1])]
        return flat, mark[np.concatenate([[0], np.cumsum(count, dtype=np.int64)])]

    def encode_checked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """All piece numbers in a row, where each text's begin (n + 1 marks), and whether they decode to it.

        A text decodes to what its segments decode to, one after the other: bytes of a
        character never lie in two segments. So each distinct segment is decoded once.
        """
        cut = self._segments(texts)
        flat, marks = self._joined(cut)
        return flat, marks.astype(np.int32), [not self.lost or self.lost.isdisjoint(c) for c in cut]

    def _said(self, ids: list[int]) -> str:
        parts = [self.names[i] for i in ids]
        if any(isinstance(p, int) for p in parts):
            raw = b"".join(bytes([p]) if isinstance(p, int) else p.encode() for p in parts)
            return raw.decode("utf-8", "replace")
        return "".join(parts)

    def decode(self, ids: list[int]) -> str:
        return self._said(ids).removeprefix(" ")


def _encode(path: str, field: int | None = None):
    """The encoder of the column `text`, or of the field of `doc` that is the text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column("text") if field is None else pc.struct_field(part.column("doc"), field)
                ids, marks, same = codec.encode_checked([t or "" for t in texts.to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.ListArray.from_arrays(pa.array(marks), pa.array(ids)), pa.array(same)], ["doc", "ids", "round_trip"])

    return encode


def _decode(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            texts = [codec.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string())], ["doc", "text"])

    return decode


def encoded(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", model: str = MODEL) -> DataFrame:
    """`doc` (the kept columns), `ids` and whether decoding them gives the text back."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("doc"), F.col(text).alias("text"))
    schema = rows.select("doc").schema.add("ids", T.ArrayType(T.IntegerType())).add("round_trip", T.BooleanType())
    if text in keep:  # it travels to the worker once
        return rows.select("doc").mapInArrow(_encode(model, keep.index(text)), schema)
    return rows.mapInArrow(_encode(model), schema)


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """`doc` and the `text` of its `ids`."""
    rows = tokens.select("doc", "ids")
    return rows.mapInArrow(_decode(model), rows.select("doc").schema.add("text", T.StringType()))


def op8_sentencepiece(spark, sf_dir):
    tokens = encoded(table(spark, sf_dir, "documents"))
    return tokens.select("doc.doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "round_trip")


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
