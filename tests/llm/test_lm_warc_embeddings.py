"""Language model, archives and embeddings on small frames, beside plain Python."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from bidloom.llm import embedding_dedup as E
from bidloom.llm import lm_score as M
from bidloom.llm import warc
from bidloom.llm.elias_fano import EliasFano


def test_elias_fano_finds_what_it_holds():
    r = np.random.default_rng(1)
    for n, top in ((1, 1), (4, 9), (1000, 1001), (1000, 10**6), (20000, 2**60)):
        v = np.unique(r.integers(0, top, n))
        q = np.concatenate([v, r.integers(0, top + 5, 500), [0, 2 * top]])
        at = np.minimum(np.searchsorted(v, q), len(v) - 1)
        assert (EliasFano.encode(v).find(q) == np.where(v[at] == q, at, -1)).all()
    assert (EliasFano.encode(np.zeros(0, np.int64)).find(np.array([0, 5])) == -1).all()


def test_a_full_bucket_is_halved(monkeypatch):
    v = np.concatenate([np.arange(0, 300_000, 3), np.arange(1, 50) << 40])
    code, steps, low = EliasFano.encode(v), [], EliasFano._low
    monkeypatch.setattr(EliasFano, "_low", lambda self, at: steps.append(len(at)) or low(self, at))
    q = np.sort(np.concatenate([v[::7], v[::7] + 1, [1 << 60]]))
    at = np.minimum(np.searchsorted(v, q), len(v) - 1)
    assert (code.find(q) == np.where(v[at] == q, at, -1)).all()
    assert len(steps) < 50  # the first bucket holds 100,000 values


def test_counted_grams_leave_in_small_batches(spark):
    texts = [" ".join(f"w{(i * j) % 997}" for j in range(3000)) for i in range(1, 900)]
    model = M.train(spark.createDataFrame([(t,) for t in texts[:20]], "text string"))
    out = list(M._count_grams(model)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
    # What a task holds: the bound, and the pairs and triples of one slice over it.
    assert max(b.num_rows for b in out) <= M.HELD + 2 * M.TOGETHER // 4 and M.HELD <= 1 << 19 and M.TOGETHER <= 1 << 20
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def reference(train, texts):
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    c = Counter(w for t in train for w in tok(t))
    total, kinds, often = sum(c.values()), len(c), {w for w in c if c[w] >= M.WORD_COUNT}
    two, three = Counter(), Counter()
    for x in map(tok, train):
        for i in range(len(x) - 1):
            if x[i] in often and x[i + 1] in often:
                two[x[i], x[i + 1]] += 1
                if i + 2 < len(x) and x[i + 2] in often:
                    three[x[i], x[i + 1], x[i + 2]] += 1
    two, three = ({k: v for k, v in g.items() if v >= M.GRAM_COUNT} for g in (two, three))
    spent2, spent3 = Counter(), Counter()
    for (a, _), v in two.items():
        spent2[a] += (v - M.DISCOUNT) / c[a]
    for (a, b, _), v in three.items():
        spent3[a, b] += (v - M.DISCOUNT) / two[a, b]
    p1 = lambda w: (c[w] + 1) / (total + kinds + 1)

    def p2(a, w):
        return (two[a, w] - M.DISCOUNT) / c[a] * ((a, w) in two) + (1 - spent2[a]) * p1(w) if a in often and (a, w) in two else (1 - spent2[a]) * p1(w) if a in often else p1(w)

    def p3(a, b, w):
        if (a, b) not in two:
            return p2(b, w)
        return ((three[a, b, w] - M.DISCOUNT) / two[a, b] if (a, b, w) in three else 0) + (1 - spent3[a, b]) * p2(b, w)

    out = []
    for x in map(tok, texts):
        score = sum(math.log10(p1(w) if i == 0 else p2(x[0], w) if i == 1 else p3(x[i - 2], x[i - 1], w)) for i, w in enumerate(x))
        out.append((len(x), sum(c[w] > 0 for w in x), sum(math.log10(p1(w)) for w in x), score))
    return out


def test_scores_equal_plain_python(spark):
    r = random.Random(4)
    words = ["the", "of", "Cat", "dog", "runs", "sees", "é", "big"]
    train = [" ".join(r.choice(words[: r.randint(2, 8)]) for _ in range(r.randint(0, 40))) for _ in range(120)] + [None, "rare words here"]
    texts = train[:30] + ["unknown thing", "", None, "THE OF the of\tthe\nof", "the " * 2000]
    model = M.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(3))
    df = spark.createDataFrame([(i if i else None, t, "n") for i, t in enumerate(texts)], "doc_id bigint, text string, score string")
    got = {r.doc.doc_id or 0: r for r in M.scored(df, model, keep=("doc_id", "score")).collect()}
    assert len(got) == len(texts)
    for i, (n, known, base, score) in enumerate(reference(train, texts)):
        g = got[i]
        assert (g.n_tokens, g.n_known) == (n, known) and abs(g.base_score - base) < 1e-6
        assert abs(g.score - score) < 2e-4 * n
    assert M.scored(df.limit(0), model).count() == 0
    empty = M.train(df.select("text").limit(0))
    assert {r.score for r in M.scored(df, empty).collect()} == {0.0}


def test_archives_read_back(spark):
    html = ["<p>one</p>", "<p>two é</p>", "<p>one</p>", None, "", "<p>one</p>", "x" * 50000]
    urls = ["http://B.example.com/x?y=1#z", None, "https://a.example.com:8080/", "http://a.example.com/", "ftp://u@c.org", "http://a.example.com/", "http://\ttab"]
    rows = [(i, u, h, "k") for i, (u, h) in enumerate(zip(urls, html))] + [(6, "http://again", "x" * 50000, "k"), (None, "u", "<p>one</p>", "k")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string").repartition(3)
    archive = warc.Archive.write(df, block_lines=2)
    got = archive.records().collect()
    assert len(got) == len(rows)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    by_id = {r.page_id: r for r in got}
    for i, h in enumerate(html):
        r = by_id[i]
        assert (r.payload_bytes, r.payload_digest) == (len((h or "").encode()), digest(h))
        assert (r.record_type, r.refers_to) == {0: ("revisit", 5), 2: ("revisit", 5), 3: ("revisit", 4)}.get(i, ("response", None))
        if r.record_type == "response":
            assert r.payload.decode() == (h or "")
    assert (by_id[None].record_type, by_id[None].refers_to) == ("revisit", 5)
    found = archive.find("http://a.example.com/")
    assert sorted(f["warc"]["WARC-Record-ID"] for f in found) == ["<urn:page:2>", "<urn:page:3>", "<urn:page:5>"]
    assert archive.find("http://nowhere.example") == []
    keys = [r.first for r in archive.directory.orderBy("first").collect()]
    assert keys == sorted(keys) and any(k.startswith("com,example,a)") for k in keys)
    assert warc.Archive.write(df.limit(0)).records().count() == 0


def test_lattice_points_are_nearest():
    r = np.random.default_rng(2)
    y = r.normal(size=(200, 8)) * 2
    x = E.nearest(y)
    assert np.allclose((2 * x) % 1, 0) and np.all((x.sum(1) % 2 == 0)) and len(E.neighbours()) == 240
    around = x[:, None, :] + E.neighbours()[None]
    assert np.all(((y - x) ** 2).sum(1)[:, None] <= ((y[:, None] - around) ** 2).sum(2) + 1e-9)


def test_recall_at_the_threshold():
    r = np.random.default_rng(7)
    u = r.normal(size=(2000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = r.normal(size=u.shape)
    w -= (w * u).sum(1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    v = E.COSINE * u + math.sqrt(1 - E.COSINE**2) * w
    zero = np.zeros(len(u), np.int64)
    own_u, near_u = E.cells(u, zero)
    own_v, near_v = E.cells(v, zero)
    met = [bool((set(a) | set(b)) & set(c)) or bool((set(c) | set(d)) & set(a)) for a, b, c, d in zip(own_u, near_u, own_v, near_v)]
    assert np.mean(met) >= 0.97


def test_links_equal_all_pairs(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(12, 64))
    rows, n = [], 0
    for k in range(150):
        v = base[k % 12] + r.normal(size=64) * r.choice([0.0, 0.05, 0.1, 0.14])
        rows.append((n, v.astype(np.float32).tolist(), int(k % 3)))
        n += 1
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64, [float("inf")] + [1.0] * 63, [1.0, 2.0], [1.0, 2.0], [2.0, 4.0]]
    rows += [(n + i, v, 1) for i, v in enumerate(odd)] + [(500, rows[0][1], None), (501, rows[0][1], 0), (502, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    got = {x.id: (x.n_links, x.component) for x in E.linked(df).collect()}
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, *_ in rows}
    for i, a, la in good:
        for j, b, lb in good:
            if i < j and la == lb and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= E.COSINE:
                links[i].add(j)
                links[j].add(i)
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i] == (len(links[i]), min(seen)), i
    assert E.linked(df.limit(0)).count() == 0
