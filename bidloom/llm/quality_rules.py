r"""Quality rules as weak supervision.

Every rule votes good (1), bad (-1) or abstains (0) on a document. The rules'
class-conditional accuracies and the share of good documents are estimated by
expectation-maximisation over the *counts of vote patterns*, so the iterations
cost the same at any corpus size: one pass makes the votes, one grouped count
makes at most 3**rules patterns, and each round is an aggregate of those. A
document's verdict is its posterior probability of being good, not a list of
tests it must all pass; only the two base conditions of the contract reject
outright. An abstention says nothing of either class. Every kind of fault is seen
by two rules or more: what a single rule says alone cannot be told from chance.

Columns and SQL expressions only: no Python runs on the executors.

Defined results: a null or blank text has no words, zero counts, fails the base
conditions and is not kept; repeated rows are judged alike and all returned; an
empty table gives an empty result; other columns travel untouched in `doc`, so
their names cannot clash; a text of any length is counted whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm.tables import WORD, let, table, words
from bidloom.session import Scratch

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
ROUNDS = 25
#: Added to every vote count, so a vote never seen in a class stays possible.
SMOOTHING = 1.0

#: name, bad when, good when (SQL over the counts below, valid in Spark and DuckDB); neither: the rule abstains.
RULES = (
    ("symbols", "5 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    ("symbol_share", "20 * n_symbols > word_chars", "200 * n_symbols <= word_chars"),
    ("shouting", "2 * n_upper > word_chars", "4 * n_upper <= word_chars"),
    ("exclaiming", "2 * n_exclaims > n_words", "20 * n_exclaims <= n_words"),
    ("repeated_windows", "4 * n_repeat_words > n_words", "n_repeat_words = 0"),
    ("vocabulary", "n_words >= 50 AND 4 * n_distinct < n_words", "5 * n_distinct >= 2 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines", "n_dup_lines = 0"),
    ("word_length", "2 * word_chars < 5 * n_words OR word_chars > 12 * n_words", "word_chars >= 4 * n_words AND word_chars <= 9 * n_words"),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_exclaims")
BASE = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"


def vote_sql(bad: str, good: str) -> str:
    return f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"


def _repeat_words(hashes: Column) -> Column:
    """Words inside any window that occurs twice or more, from the hashes of a text's words."""
    window = lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
    )

    def covered(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twin = lambda z: F.filter(
            z, lambda e, i: (F.coalesce(F.get(z, i - 1)["h"] == e["h"], F.lit(False))) | F.coalesce(F.get(z, i + 1)["h"] == e["h"], F.lit(False))
        )
        places = F.array_sort(F.transform(let(placed, twin), lambda e: e["p"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"]
        )

    some = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0)
    return F.when(F.size(hashes) >= WINDOW, let(window(hashes), some)).otherwise(0)


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """`doc` (the row as it came) and the counts that the rules read, in one pass over each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    matches = lambda pattern: F.regexp_count(t, F.lit(pattern))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    by_word = let(words(F.col(text)), lambda w: F.struct(
        F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), F.size(F.array_distinct(w)).alias("distinct"),
        let(F.transform(w, lambda x: F.xxhash64(x)), _repeat_words).alias("repeat"),
    ))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    made = docs.select(F.struct("*").alias("doc"), by_word.alias("w"), by_line.alias("l"), matches("[#*$%&|<>]").alias("s"), matches(r"\p{Lu}").alias("u"), matches("!").alias("x"))
    parts = {
        "n_words": "w.n", "word_chars": "w.chars", "n_symbols": "s", "n_dup_lines": "l.dup", "n_repeat_words": "w.repeat",
        "n_lines": "l.n", "n_distinct": "w.distinct", "n_upper": "u", "n_exclaims": "x",
    }
    return made.select("doc", *[F.col(c).cast("bigint").alias(n) for n, c in parts.items()])


def voted(counts: DataFrame) -> DataFrame:
    votes = [F.expr(vote_sql(bad, good)).cast("int").alias(f"v{j}") for j, (_, bad, good) in enumerate(RULES)]
    return counts.select("*", F.expr(BASE).alias("base_failed"), *votes)


def _m_step() -> list[str]:
    """SQL of the weighted vote counts in both classes; `n` rows share a pattern, `q` is its chance of being good."""
    sums = ["sum(n * q) AS g", "sum(n * (1 - q)) AS b"]
    for j in range(len(RULES)):
        for v in (-1, 1):
            sums += [f"sum(CASE WHEN v{j} = {v} THEN n * q ELSE 0 END) AS g{j}_{v + 1}", f"sum(CASE WHEN v{j} = {v} THEN n * (1 - q) ELSE 0 END) AS b{j}_{v + 1}"]
    return sums


def _e_step(value) -> str:
    """SQL of a pattern's posterior; `value` renders a sum of the M-step as SQL."""
    terms = [f"ln({value('b')} + {SMOOTHING}) - ln({value('g')} + {SMOOTHING})"]
    for j in range(len(RULES)):
        votes = lambda c: f"{value(f'{c}{j}_0')} + {value(f'{c}{j}_2')} + 2 * {SMOOTHING}"  # noqa: E731, B023
        rate = lambda c, v: f"(ln({value(f'{c}{j}_{v + 1}')} + {SMOOTHING}) - ln({votes(c)}))"  # noqa: E731, B023
        cases = " ".join(f"WHEN {v} THEN {rate('b', v)} - {rate('g', v)}" for v in (-1, 1))
        terms.append(f"CASE v{j} {cases} ELSE 0 END")
    return f"1 / (1 + exp(greatest(-600.0, least(600.0, {' + '.join(terms)}))))"


START = f"CASE WHEN {' OR '.join(f'v{j} < 0' for j in range(len(RULES)))} THEN 0.01 ELSE 0.99 END"


@dataclass(frozen=True)
class RuleModel:
    """The fitted sums: class totals and, per rule, how often each class is voted bad and good."""

    sums: dict[str, float]

    def posterior(self) -> Column:
        return F.expr(_e_step(lambda name: repr(float(self.sums[name])) + "D"))

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Per rule: how often a vote is right on good and on bad documents."""
        s, out = self.sums, {}
        for j, (name, _, _) in enumerate(RULES):
            right = lambda c, v: s[f"{c}{j}_{v}"] / max(s[f"{c}{j}_0"] + s[f"{c}{j}_2"], 1e-9)  # noqa: E731, B023
            out[name] = (right("g", 2), right("b", 0))
        return out


def fit(votes: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> RuleModel | None:
    """EM over the vote patterns of all documents that pass the base conditions; None when there are none."""
    names = [f"v{j}" for j in range(len(RULES))]
    patterns = scratch.save(votes.where("NOT base_failed").groupBy(*names).agg(F.count("*").cast("double").alias("n")).coalesce(1), "patterns")
    sums = patterns.withColumn("q", F.expr(START)).selectExpr(*_m_step()).first()
    if sums["g"] is None:
        return None
    model = RuleModel(sums.asDict())
    for _ in range(rounds - 1):
        model = RuleModel(patterns.withColumn("q", model.posterior()).selectExpr(*_m_step()).first().asDict())
    return model


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row as `doc`, with its counts, votes, `base_failed`, `p_good` and `kept`."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    votes = scratch.save(voted(counted(docs, text)), "votes")
    model = fit(votes, scratch)
    p = model.posterior() if model else F.lit(None).cast("double")
    scored = votes.withColumn("p_good", p)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.coalesce("p_good", F.lit(0.0)) >= 0.5))


def filter_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose verdict is good, with their columns as they came."""
    return judge(docs, text).where("kept").select("doc.*")


def op5_quality_rules(spark, sf_dir):
    rows = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    votes = ", ".join(f"{vote_sql(bad, good)} AS v{j}" for j, (_, bad, good) in enumerate(RULES))
    names = ", ".join(f"v{j}" for j in range(len(RULES)))
    steps = [f"q0 AS MATERIALIZED (SELECT *, {START} AS q FROM patterns)"]
    for r in range(ROUNDS):
        steps.append(f"s{r} AS MATERIALIZED (SELECT {', '.join(_m_step())} FROM q{r})")
        steps.append(f"q{r + 1} AS MATERIALIZED (SELECT p.*, {_e_step(lambda name: f's.{name}')} AS q FROM patterns p CROSS JOIN s{r} s)")
    return rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM documents),
spans AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM
    (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM base WHERE len(w) >= {WINDOW})),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM spans) WHERE c > 1),
repeated AS (SELECT doc_id, sum(least({WINDOW}, i - coalesce(before, -{WINDOW}))) AS n FROM
    (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice) GROUP BY doc_id),
counts AS (SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct,
    CAST(len(regexp_extract_all(t, '\p{{Lu}}')) AS BIGINT) AS n_upper, CAST(len(regexp_extract_all(t, '!')) AS BIGINT) AS n_exclaims
    FROM base b LEFT JOIN repeated r USING (doc_id)),
votes AS MATERIALIZED (SELECT *, {BASE} AS base_failed, {votes} FROM counts),
patterns AS MATERIALIZED (SELECT {names}, CAST(count(*) AS DOUBLE) AS n FROM votes WHERE NOT base_failed GROUP BY {names}),
{", ".join(steps)},
s AS (SELECT {', '.join(_m_step())} FROM q{ROUNDS - 1})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND {_e_step(lambda name: f's.{name}')} >= 0.5 AS kept FROM votes CROSS JOIN s"""


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES = {"op5_quality_rules": _oracle()}
