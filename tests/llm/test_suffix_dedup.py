"""Removed bytes beside a count of all windows in plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np

from bidloom.llm import suffix_dedup as S


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + S.LENGTH] for b in raw for i in range(len(b) - S.LENGTH + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - S.LENGTH + 1):
            if seen[b[i:i + S.LENGTH]] > 1:
                gone[i:i + S.LENGTH] = True
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]]))) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß€🙂") for _ in range(r.randint(2, 9)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passages = [fresh(n) for n in (30, 75, 90, 120, 400)]
    texts = [fresh(r.choice([5, 60, 300])) for _ in range(20)]
    for _ in range(60):
        parts = [fresh(r.choice([0, 3, 40])), r.choice(passages), fresh(r.choice([0, 1, 50])), r.choice(passages)]
        t = list(" ".join(parts))
        for _ in range(r.choice([0, 0, 1, 2])):
            t[r.randrange(len(t))] = "X"
        texts.append("".join(t))
    texts += [texts[3]] * 3 + [texts[25]] * 2
    texts += ["", None, "ab" * 700, "ab" * 650 + "tail", "x" * 399, "x" * 399, "é" * 200, "é" * 200, "é" * 199 + "e"]
    # A repeat that begins inside a character: the second bytes agree, the first differ.
    texts += ["é" + fresh(0) + passages[2][:390] + "q", "ĩ" + passages[2][:390] + "q"]
    return texts


def test_bytes_equal_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        rows = [(None if i == 4 else i // 2, t, i) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, n int").repartition(4)
        cut = {r.tid: r for r in S.repeated_spans(df, with_text=True).collect()}
        got = {}
        for r in df.select("n", "text", S.text_id("text").alias("tid")).collect():
            raw = (r.text or "").encode()
            c = cut.get(r.tid)
            got[r.n] = (len(raw), c.n_removed, len(c.spans), c.kept_sha256) if c else (len(raw), 0, 0, hashlib.sha256(raw).hexdigest())
            if c:
                left = b"".join(raw[a:b] for a, b in zip([0, *(s.end for s in c.spans)], [*(s.start for s in c.spans), len(raw)]))
                assert len(left) <= len(c.kept_text.encode()) <= len(left) + 6 * len(c.spans)
        assert [got[i] for i in range(len(texts))] == brute(texts)
    kept = S.remove_repeats(df.withColumn("n_chars", df.n.cast("bigint")), length="n_chars")
    assert kept.columns == [*df.columns, "n_chars"] and kept.count() == len(texts)
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_levels_stay_logarithmic(spark):
    scratch = S.Scratch(spark, "levels")
    index = S.SuffixIndex(scratch)
    for k in range(7):
        index.append(spark.createDataFrame([(k, 10 * k), (99, 5)], "shallow bigint, deep bigint"))
    index._merge()
    assert [size for size, _ in index.levels] == [4, 2, 1]
    hits = index.append(spark.createDataFrame([(3, 30), (4, 7), (55, 1)], "shallow bigint, deep bigint"))
    assert {(r.kind, r.key) for r in hits.collect()} == {("deep", 30), ("shallow", 3), ("shallow", 4)}
