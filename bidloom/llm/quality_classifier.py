"""Quality classifier with hierarchical empirical Bayes over sites and paths.

Document evidence. A naive Bayes model over binned counts is fitted on labelled
rows; a document is good if it is labelled of quality and not toxic. One of the
counts is how many words of a learned lexicon a text has: words that occur in
labelled toxic documents many times more often than in others.

Site evidence. The expected number of good documents is summed per host and per
host and path. A host's posterior mean shrinks its own rate toward the global
one, and a path's shrinks toward its host's, by as many pseudo-documents as the
spread between groups justifies (method of moments over all groups); a group
with few documents stays near its prior. A document's final probability is its
own evidence with the prior of its path in place of the global prior.

All sums are grouped aggregates that combine before the shuffle, so a host with
a third of all rows costs no more than its share; group means are joined back to
the rows. The fit reads at most FIT_ROWS labelled rows, chosen by a hash of the
id; everything else covers all rows.

Defined results: a null or blank text has counts of zero; a null host or path is
a group of its own; without any labelled row every probability is the prior 0.5
and every document is kept; repeated rows are scored alike; null ids match no
label; an empty table gives an empty result. Rows travel in `doc`, so other
columns' names cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm.quality_rules import counted
from bidloom.llm.tables import table, words
from bidloom.session import Scratch

#: At most so many labelled rows are used to fit (documented bound of the sample).
FIT_ROWS = 40_000
#: A lexicon word is in at least so many labelled toxic documents, and so many times likelier there than elsewhere.
LEXICON_ROWS, LEXICON_LIFT, LEXICON_WORDS = 5, 8.0, 500
#: Most pseudo-documents of a prior: groups that do not differ would ask for infinitely many.
STRONGEST = 1000.0
CLIP = 1e-6

#: Binned counts: SQL of a value, and the bounds of its bins.
FEATURES = {
    "length": ("n_words", (5, 20, 50, 200, 1000)),
    "symbols": ("n_symbols / greatest(n_words, 1)", (0.001, 0.02, 0.1, 0.5)),
    "upper": ("n_upper / greatest(word_chars, 1)", (0.01, 0.03, 0.06, 0.1, 0.3)),
    "exclaims": ("n_exclaims / greatest(n_words, 1)", (0.001, 0.05, 0.5)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.001, 0.1, 0.3)),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", (0.001, 0.1, 0.3)),
    "vocabulary": ("n_distinct / greatest(n_words, 1)", (0.1, 0.25, 0.4, 0.6)),
    "word_length": ("word_chars / greatest(n_words, 1)", (3.0, 4.5, 5.5, 7.0, 9.0)),
    "lexicon": ("n_lexicon", (1, 2, 4)),
}


def _plain_words(text: str) -> Column:
    """Words in lower case without marks at their ends."""
    bare = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return F.array_distinct(words(bare))


def _binned() -> list[Column]:
    out = []
    for name, (value, bounds) in FEATURES.items():
        out.append(F.expr(" + ".join(f"CAST({value} >= {b} AS INT)" for b in bounds)).alias(f"b_{name}"))
    return out


@dataclass(frozen=True)
class Evidence:
    """Log odds per bin, the prior log odds and the lexicon."""

    prior: float = 0.0
    bins: dict[str, dict[int, float]] = field(default_factory=dict)
    lexicon: tuple[str, ...] = ()

    def log_odds(self) -> Column:
        total = F.lit(self.prior)
        for name, table_ in self.bins.items():
            case = F.lit(0.0)
            for value, odds in table_.items():
                case = F.when(F.col(f"b_{name}") == value, F.lit(odds)).otherwise(case)
            total = total + case
        return total


def _lexicon(rows: DataFrame, text: str) -> tuple[str, ...]:
    """Words that mark toxic documents, from the bounded labelled rows."""
    totals = rows.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    if not totals[0] or not totals[1]:
        return ()
    seen = rows.select("toxic", F.explode(_plain_words(text)).alias("word")).groupBy("word").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("o"))
    lift = (F.col("t") + 0.5) / totals[0] / ((F.col("o") + 0.5) / totals[1])
    best = seen.where(f"t >= {LEXICON_ROWS}").withColumn("lift", lift).where(F.col("lift") >= LEXICON_LIFT)
    return tuple(r.word for r in best.orderBy(F.desc("lift"), "word").limit(LEXICON_WORDS).collect())


def _features(rows: DataFrame, lexicon: tuple[str, ...], text: str) -> DataFrame:
    known = F.array(*[F.lit(w) for w in lexicon]) if lexicon else F.array().cast("array<string>")
    with_words = counted(rows, text).withColumn("n_lexicon", F.size(F.array_intersect(_plain_words(f"doc.{text}"), known)) if lexicon else F.lit(0))
    return with_words.select("doc", *_binned())


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> Evidence:
    """Evidence from at most `rows` labelled documents; `labels(doc_id, quality, toxic)`."""
    chosen = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.max("quality") == 1).alias("fine"), F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("toxic")
    ).where("fine IS NOT NULL")
    chosen = scratch.save(chosen, "labels")
    # An even share by hash, so that no task has to rank all labels; 3 % below the bound, which a hash's chance does not bridge.
    share = min(1.0, 0.97 * rows / max(chosen.count(), 1))
    chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(math.floor(share * (1 << 20))))
    chosen = chosen.select(F.col("doc_id").alias("of"), (F.col("fine") & ~F.col("toxic")).alias("good"), "toxic")
    known = docs.select(F.col(id).alias("id"), F.col(text).alias(text)).join(scratch.save(chosen, "chosen"), F.col("id") == F.col("of")).select(text, "good", "toxic")
    known = scratch.save(known, "labelled")
    totals = {r.good: r["count"] for r in known.groupBy("good").count().collect()}
    if not totals:
        return Evidence()
    lexicon = _lexicon(known, text)
    made = scratch.save(_features(known, lexicon, text).select("doc.good", *[f"b_{n}" for n in FEATURES]), "bins")
    good, bad = totals.get(True, 0) + 1.0, totals.get(False, 0) + 1.0
    bins = {}
    for name, (_, bounds) in FEATURES.items():
        seen = {(r[0], r[1]): r[2] for r in made.groupBy("good", f"b_{name}").count().collect()}
        size = len(bounds) + 1
        rate = lambda side, v, total: (seen.get((side, v), 0) + 1.0) / (total - 1.0 + size)  # noqa: E731, B023
        bins[name] = {v: math.log(rate(True, v, good)) - math.log(rate(False, v, bad)) for v in range(size)}
    return Evidence(math.log(good) - math.log(bad), bins, lexicon)


def _strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-documents of a prior: from the spread of group rates around it beyond what their sizes explain."""
    rate = F.col("good") / F.col("n")
    m = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), mean))
    row = groups.agg(F.sum(F.col("n") * (rate - mean) ** 2), F.sum(m * (1 - m)), F.sum(F.col("n") * m * (1 - m)), F.sum("n"), F.count("*")).first()
    if not row[3] or not row[1]:
        return STRONGEST
    # Weighted squares expect variance(1 - 1/k) from sampling plus spread * documents.
    spread = max(row[0] - row[1], 0.0) / row[3]
    within = row[2] / row[3]
    return STRONGEST if spread <= 0 else min(STRONGEST, max(within / spread - 1.0, 1.0))


def classified(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row as `doc` with `p_document`, `p_host`, `p_path` (posterior means) and `p_quality`."""
    scratch = Scratch(docs.sparkSession, "quality-classifier")
    evidence = fit(docs, labels, scratch, id, text)
    keyed = docs.select(F.struct("*").alias("doc"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text).alias(text))
    made = _features(keyed, evidence.lexicon, text)
    odds = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), evidence.log_odds()))
    rows = made.select("doc.doc", "doc.host", "doc.path", odds.alias("odds")).withColumn("p_document", 1 / (1 + F.exp(-F.col("odds"))))
    rows = scratch.save(rows, "documents")

    paths = scratch.save(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_document").alias("good")), "paths")
    hosts = scratch.save(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    mean = total[1] / total[0] if total[0] else 0.5
    by_host = _strength(hosts, F.lit(mean))
    hosts = scratch.save(hosts.select(F.col("host").alias("h"), ((F.col("good") + by_host * mean) / (F.col("n") + by_host)).alias("p_host")), "host-means")
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    by_path = _strength(paths, F.col("p_host"))
    p_path = (F.col("good") + by_path * F.col("p_host")) / (F.col("n") + by_path)
    paths = scratch.save(paths.select(F.col("host").alias("h"), F.col("path").alias("p"), "p_host", p_path.alias("p_path")), "path-means")

    joined = rows.join(paths, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    logit = lambda p: F.log(F.greatest(F.lit(CLIP), p)) - F.log(F.greatest(F.lit(CLIP), 1 - p))
    final = F.col("odds") - logit(F.lit(mean)) + logit(F.col("p_path"))
    return joined.select("doc", "p_document", "p_host", "p_path", (1 / (1 + F.exp(-final))).alias("p_quality"))


def op2_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = classified(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return found.select("doc.doc_id", "p_document", "p_host", "p_path", "p_quality", (F.col("p_quality") >= 0.5).alias("kept"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
