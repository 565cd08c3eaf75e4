"""The pipeline's stages in order, and the whole beside its parts."""

from pathlib import Path

import pytest

import corpus_pipeline as pipeline
from bidloom.llm import mixing, ngram_join, pieces, quality_rules, suffix_dedup
from bidloom.llm.tables import table

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables not present")
def test_run_is_its_stages(spark):
    docs = table(spark, DATA, "documents")
    kept = quality_rules.filter_documents(docs)
    single = ngram_join.keep_one_row(kept)
    assert single.columns == docs.columns and 0 < single.count() < kept.count() < docs.count()
    cut = suffix_dedup.remove_repeats(single, length="n_chars")
    assert cut.count() == single.count() and cut.where("n_chars <> length(text)").count() == 0
    mix = mixing.mix_documents(cut)
    codec = pieces.Codec()
    wanted = sorted((r.doc_id, tuple(codec.encode([r.text or ""])[0])) for r in mix.collect())
    assert sorted((r.doc_id, tuple(r.ids)) for r in pipeline.run(spark, DATA).collect()) == wanted
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "mixing sources", "SentencePiece encoding"]


def test_odd_rows_pass_through(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "word " * 100, "en", None, 500)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() >= 0 and "ids" in docs.columns
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, DATA)
    assert empty.count() == 0


def test_one_copy_of_repeated_rows_keeps_its_text(spark):
    text = " ".join(f"word{i}" for i in range(200))
    other = " ".join(f"term{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text, "en", "s", 1)] * 3 + [(None, other, "en", "s", 1)] * 2, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in pipeline.STAGES[1:3]:
        docs = stage(spark, docs, DATA)
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == [(0, other), (1, text)]
