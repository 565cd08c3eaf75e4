"""The licence scan beside a plain Python version, and its rules."""

import random
import re
import time

from bidloom.llm import license_scan as L
from bidloom.llm.license_rules import BASE, CLASSES, WORTH

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORD.findall((text or "").translate(str.maketrans(L.UPPER, L.UPPER.lower())))
    base = [(i, label) for i in range(len(words)) for label, p in BASE if words[i:i + len(p.split())] == p.split()]
    found = []
    for i, w in enumerate(words):
        ahead = " " + "  ".join(words[i:i + L.SPAN]) + " "
        for r in L.RULES:
            m = r.first == w and re.match(r.pattern, ahead)
            if m:
                found.append((i, i + len(m.group(0).split()), r))
    kept = [(s, e, r) for s, e, r in found if not any(
        bs <= s and be >= e and (b.kind < r.kind or (b.kind == r.kind and ((bs, be) != (s, e) or b.number < r.number))) for bs, be, b in found)]
    starts = [i for i, _ in base]
    score = max([WORTH[CLASSES[r.kind]] for _, _, r in kept] + ([L.BASE_WORTH] if base else [0.0]))
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), sorted({x for _, x in base}),
            sorted({x for _, x in base} | {r.label for _, _, r in kept}), len(kept), score)


def test_rules_are_hundreds_and_each_matches_what_it_names():
    assert len(L.RULES) > 300 and len({r.number for r in L.RULES}) == len(L.RULES)
    for r in L.RULES:
        assert "'" not in r.pattern and "\\" not in r.pattern and r.pattern.startswith(f" {r.first} ")
    labels = plain("SPDX-License-Identifier: GPL-2.0-or-later, see https://opensource.org/licenses/MIT and the Mozilla Public License, v2.0")[5]
    assert labels == ["gpl-2.0", "mit", "mpl-2.0"]


def test_scan_agrees_with_plain_python(spark):
    r = random.Random(4)
    pieces = ["MIT License", "mit license", "Apache License, Version 2.0", "apache", "license", "GNU General Public License version 3", "general public license", "Licensed under the",
              "SPDX-License-Identifier:", "BSD-3-Clause", "MIT", "CC BY-NC 4.0", "spdx license identifier mit 0", "the terms of the", "mozilla public", "ÉMIT license", "mit licensé", "ü", "x1", "word",
              "Permission is hereby granted, free of charge, to any person obtaining a copy", "Redistribution and use in source and binary forms, with or without modification", "lesser"]
    texts = ["".join(r.choice(pieces) + r.choice([" ", "\n", "-", ", ", "  "]) for _ in range(r.choice([1, 3, 9, 40]))) for _ in range(150)]
    texts += [None, "", " \n", "MIT LICENSE" * 3, "\x00mit\x7flicense", "mit license " * 500, texts[0], texts[0]]
    df = spark.createDataFrame([(i if i % 30 else None, t, "clash", 5) for i, t in enumerate(texts)], "doc_id bigint, text string, labels string, n_words int").repartition(3)
    rows = L.scanned(df).collect()
    assert len(rows) == len(texts)
    for x in rows:
        assert (x.n_words, x.n_base, x.first_word, x.last_word, list(x.base_labels), list(x.labels), x.n_detections, x.score) == plain(x.doc.text), x.doc.text
        assert x.doc.labels == "clash"
    empty = L.scanned(df.limit(0))
    assert empty.count() == 0 and set(empty.columns) == set(rows[0].__fields__)


def test_contained_detections_are_suppressed(spark):
    text = "This work is licensed under the GNU General Public License, version 3."
    row = L.scanned(spark.createDataFrame([(text,)], "text string")).first()
    # One notice covers the name, the number and the mention; the base label stays.
    assert (row.n_detections, row.labels, row.base_labels, row.score) == (1, ["gpl", "gpl-3.0"], ["gpl"], 0.85)


def test_a_very_long_text_is_read_whole_and_stays_native(spark):
    text = "filler word " * 400_000 + "apache license 2.0 " * 20_000
    df = spark.createDataFrame([(text,)], "text string")
    started = time.time()
    row = L.scanned(df).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (880_000, 20_000, 800_000, 879_996) and row.labels == ["apache", "apache-2.0"]
    assert time.time() - started < 120
    plan = L.scanned(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
