"""Piece numbers beside the library's, and the unigram path beside plain recursion."""

import random
import tracemalloc
from functools import cache

import numpy as np
import pytest

from bidloom.llm import pieces as P

TEXTS = [
    "", " ", "  two  spaces ", "The quick brown fox, 3.14!", "x" * 500, "日本語テスト 🙂🙂 çà va", "tab\there\nnew\r\n", "a" * 70 + " end", "▁x", "\u0000퟿", "Ünïcödé " * 40,
]


def random_texts(n):
    r = random.Random(5)
    return ["".join(r.choice("etaoin shrdlu  ETA.,\n0123éß漢") for _ in range(r.randint(1, 200))) for _ in range(n)]


def test_numbers_equal_the_library():
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.MODEL)
    codec, texts = P.Codec(), TEXTS + random_texts(200)
    ids = codec.encode(texts)
    assert ids == library.encode(texts)
    for t, i in zip(texts, ids):
        assert codec.decode(i) == t.replace("▁", " ")


def test_unigram_path_is_the_best_one():
    r = random.Random(2)
    names = ["<unk>", *"abc▁", *sorted({"".join(r.choice("abc") for _ in range(r.randint(2, 5))) for _ in range(60)}), "▁ab", "▁c"]
    scores = [0.0] + [-r.random() * 8 for _ in names[1:]]
    model = P.build(P.UNIGRAM, names, scores, [2] + [P.NORMAL] * (len(names) - 1), 0)
    number = {n: i for i, n in enumerate(names)}
    words = ["▁" + "".join(r.choice("abc") for _ in range(k)) for k in (1, 2, 5, 9, 9, 20, 80)]

    def best(w):
        @cache
        def at(i):
            return 0.0 if i == 0 else max(at(j) + scores[number[w[j:i]]] for j in range(i) if w[j:i] in number)

        return at(len(w))

    for w, ids in zip(words, P.segment(model, words)):
        assert "".join(names[i] for i in ids) == w
        assert np.isclose(sum(scores[i] for i in ids), best(w))


def test_frames(spark):
    rows = [(1, "Hello world", "x"), (None, None, "y"), (1, "Hello world", "x"), (2, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    tokens = P.encoded(df, keep=("doc_id", "ids"))
    back = P.decoded(tokens)
    assert sorted((r.doc.doc_id, r.text) for r in back.collect() if r.doc.doc_id) == [(1, "Hello world"), (1, "Hello world"), (2, "")]
    assert all(r.round_trip for r in tokens.collect()) and tokens.count() == 4
    assert P.encoded(df.limit(0)).count() == 0


def test_a_remembered_segment_takes_little_memory(monkeypatch):
    texts, model = [f"{i:05d}xyzq ab{i:05d}" for i in range(10_000)], P.load(P.MODEL)
    tracemalloc.start()
    codec = P.Codec(pieces=model)
    first = codec.encode(texts[:10])
    begun = tracemalloc.get_traced_memory()[0]
    for k in range(0, len(texts), 500):
        codec.encode(texts[k:k + 500])
    each = (tracemalloc.get_traced_memory()[0] - begun) / len(codec.known)
    tracemalloc.stop()
    assert len(codec.known) == 20_000 and each < 300
    assert codec.encode(texts[:10]) == first and codec.decode(first[3]) == texts[3]
    monkeypatch.setattr(P, "REMEMBERED", 100)
    assert codec.encode(texts[:10]) == first and len(codec.known) == 20
    flat, marks, same = codec.encode_checked(["", texts[0], "", texts[1]])
    assert flat.tolist() == first[0] + first[1] and marks.tolist() == [0, 0, len(first[0]), len(first[0]), len(flat)] and all(same)


def test_a_kept_text_travels_once(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, "")], "doc_id bigint, text string").coalesce(1)
    once = P.encoded(df, keep=("doc_id", "text"))
    assert once._jdf.queryExecution().optimizedPlan().children().head().output().size() == 1
    want = {r.doc.doc_id: r.ids for r in P.encoded(df).collect()}
    assert {r.doc.doc_id: r.ids for r in once.collect()} == want and want[2] == want[3] == []
