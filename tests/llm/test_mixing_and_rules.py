"""Mixing, quality rules and the quality classifier on small frames."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from bidloom.llm import mixing, quality_classifier, quality_rules


def shares(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = [s for s in sizes if s not in full]
        rate = (total - sum(2 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in left))
        new = {s for s in left if rate * weight[s] > 2 * sizes[s]}
        if not new:
            return {s: 2 * sizes[s] if s in full else rate * weight[s] for s in sizes}
        full |= new


def test_mix_comes_near_its_targets(spark):
    r = random.Random(3)
    rows = [(i if i % 50 else None, r.choice(["b", "b", "b", "b", "a", "é", None, "z"]), " ".join("w" * r.randint(0, 1) + "x" for _ in range(r.choice([0, 1, 5, 40, 300])))) for i in range(400)]
    rows += rows[:20] + [(9999, "solo", None), (9998, "tiny", "one")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("size", F.lit("clash")).repartition(3)
    sizes, largest = defaultdict(int), 0
    for _, s, t in rows:
        n = len((t or "").split())
        sizes[s] += n
        largest = max(largest, n)
    wanted = shares(sizes)
    out = mixing.mixed(df, mixing.word_count(F.col("text")), tie=F.xxhash64("text"))
    taken, n = defaultdict(int), 0
    for x in out.collect():
        n += 1
        assert x.size == len((x.doc.text or "").split()) and 0 <= x.copies <= 2 and x.source_size == sizes[x.doc.source]
        assert abs(x.target - wanted[x.doc.source]) < 1e-6 * max(1, x.target)
        taken[x.doc.source] += x.copies * x.size
    assert n == len(rows)
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 2 * largest + 1
    copies = mixing.mix_documents(df)
    assert copies.columns == df.columns and copies.count() == out.agg(F.sum("copies")).first()[0]
    assert mixing.mix_documents(df.limit(0)).count() == 0


GOOD = "It is a plain sentence of the kind that people write, number {0}, and nothing in it repeats so that all of its words say something else {1}."


def labelled_rows(n=300):
    r = random.Random(8)
    words = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "ginkgo", "hazel", "ivy", "juniper", "larch", "maple"]
    out = []
    for i in range(n):
        text = GOOD.format(i, " ".join(r.sample(words, 8)))
        kind = i % 6
        bad, toxic = kind == 0, kind == 1
        if bad:
            text = " ".join(w + r.choice(["###", "$$$", "&&&"]) for w in text.split())
        if toxic:
            text = text.replace("people", r.choice(["grobble", "snerk"])).replace("plain", "grobble")
        out.append((i, text, "s%d" % (i % 4), "en", 0 if bad else 1, 1 if toxic else 0))
    return out


def test_rules_reject_junk_only(spark):
    rows = [(i, t, s, lang) for i, t, s, lang, *_ in labelled_rows()]
    extra = [(None, None, None, None), (-1, "", "x", "en"), (-2, "short text", "x", "en"), (-3, "same words again and again " * 40, "x", "en"), (0, rows[1][1], "x", "en")]
    df = spark.createDataFrame(rows + extra, "doc_id bigint, text string, source string, kept string")
    got = quality_rules.judge(df).collect()
    assert len(got) == len(df.collect())
    for r in got:
        if r.doc.source and r.doc.source.startswith("s"):
            assert r.kept == (r.doc.doc_id % 6 != 0)
        elif r.doc.doc_id != 0:
            assert r.base_failed and not r.kept
    assert quality_rules.filter_documents(df).columns == df.columns
    assert quality_rules.filter_documents(df.limit(0)).count() == 0


def test_repeated_windows_and_lines(spark):
    texts = ["a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 9, "l1 a\n\nl1 a\n \nl1 a", "a b c d e f g h i a b c d e f g h i z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc.doc_id: (r.n_words, r.n_repeat_words, r.n_dup_lines) for r in quality_rules.counted(df).collect()}
    assert got == {0: (8, 0, 0), 1: (16, 16, 0), 2: (9, 9, 0), 3: (6, 0, 2), 4: (19, 18, 0)}


def test_classifier_on_rows_it_has_not_seen(spark):
    rows = labelled_rows()
    docs = spark.createDataFrame([r[:4] for r in rows] + [(None, None, None, None), (0, "", "s0", "en")], "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], r[4], r[5]) for r in rows[: len(rows) // 2]], "doc_id bigint, quality int, toxic int")
    found = quality_classifier.classified(docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(found) == len(rows) + 2
    truth = {r[0]: r[4] == 1 and r[5] == 0 for r in rows[len(rows) // 2:]}
    right = [(x.p_quality >= 0.5) == truth[x.doc.doc_id] for x in found if x.doc.doc_id in truth]
    assert sum(right) >= 0.97 * len(truth)
    assert all(0 <= x.p_quality <= 1 and 0 < x.p_host < 1 and 0 < x.p_path < 1 for x in found)
    none = quality_classifier.classified(docs, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert all(abs(x.p_quality - 0.5) < 1e-9 for x in none)
    assert quality_classifier.classified(docs.limit(0), labels, F.col("source"), F.col("lang")).count() == 0


def test_sparse_groups_stay_near_their_prior(spark):
    groups = spark.createDataFrame([("a", 1000, 900.0), ("b", 1000, 300.0), ("c", 2, 0.0)], "host string, n bigint, good double")
    k = quality_classifier._strength(groups, F.lit(0.6))
    assert 1.0 <= k < 100
    assert (0.0 + k * 0.6) / (2 + k) > 0.15 and abs((900 + k * 0.6) / (1000 + k) - 0.9) < 0.05
