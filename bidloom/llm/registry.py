"""The queries of this subpackage and their SQL counterparts, for the driver's contract."""

from __future__ import annotations

import corpus_pipeline

from bidloom.llm import embedding_dedup, hard_negatives, html_extract, license_scan, lm_score, mixing, ngram_join, pieces, quality_classifier, quality_rules, suffix_dedup, warc, whitening

_MODULES = (mixing, quality_rules, ngram_join, suffix_dedup, pieces, embedding_dedup, warc, html_extract, quality_classifier, lm_score, license_scan, whitening, hard_negatives)


def queries() -> dict:
    found = {}
    for module in _MODULES:
        found |= module.QUERIES
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {}
    for module in _MODULES:
        found |= getattr(module, "ORACLES", {})
    return found
