r"""Licence detection by ordered signature rules.

Words are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII.
Every rule of `license_rules` begins with a plain word. The words of a text that
begin any rule are found by one set intersection (the keyword prefilter; texts
without any are done), and only where such a word stands are its rules tried, on
the next SPAN words, and only those whose second keyword is among them. A
detection is suppressed when another that covers its interval has a better class,
or the same class and a longer interval (for equal intervals the earlier rule
stays). All suppressors of a detection come before it in order of start, falling
end, class and rule, so one fold that carries the farthest end of each class
settles a text in linear time. The contract's base phrases are counted apart, and
nothing suppresses them.

Columns and SQL expressions only; each row is judged by itself, so nothing is
shuffled whatever text, source or group of copies is frequent.

Defined results: a null, empty or wordless text has no words, no places, empty
label strings, score 0 and null first and last words; repeated rows are judged
alike and all returned; of detections that tie in everything but the rule the
earlier rule stays; a text of any length is read whole; an empty table gives an
empty result; other columns travel untouched in `doc`, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm.license_rules import BASE, CLASSES, SPAN, WORTH, Rule, rules
from bidloom.llm.tables import let, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What a base phrase without any kept detection is worth.
BASE_WORTH = 0.5

RULES = rules()


def license_words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _by_first(ruleset: tuple[Rule, ...]) -> Column:
    """Rules by their first word, as a literal map; patterns hold neither quotes nor backslashes."""
    groups: dict[str, list[str]] = {}
    for r in ruleset:
        made = f"named_struct('kind', {r.kind}, 'rule', {r.number}, 'need', '{r.need}', 'pattern', '^(?:{r.pattern})', 'label', '{r.label}')"
        groups.setdefault(r.first, []).append(made)
    return F.expr("map(" + ", ".join(f"'{first}', array({', '.join(rs)})" for first, rs in groups.items()) + ")")


def _standing(words: Column, hits: Column) -> Column:
    """Places, from 0, of the words that begin a rule."""
    every = F.sequence(F.lit(0), F.size(words) - 1)
    return F.when(F.size(hits) > 0, F.filter(every, lambda i: F.array_contains(hits, words[i]))).otherwise(F.array().cast("array<int>"))


def _detected(words: Column, places: Column, by_first: Column) -> Column:
    """All matches of all rules, as (start, -end, kind, rule, label), in order."""

    def at(i: Column) -> Column:
        ahead = F.concat(F.lit(" "), F.array_join(F.slice(words, i + 1, SPAN), "  "), F.lit(" "))

        def tried(text: Column) -> Column:
            usable = F.filter(F.coalesce(by_first[words[i]], F.array()), lambda r: F.contains(text, r["need"]))
            read = F.transform(usable, lambda r: F.struct(F.call_function("regexp_extract", text, r["pattern"], F.lit(0)).alias("m"), r.alias("r")))
            found = F.filter(read, lambda x: x["m"] != "")
            # Every word read has a blank on both sides.
            length = lambda m: ((F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit("")))) / 2).cast("int")
            return F.transform(found, lambda x: F.struct(
                i.alias("start"), (-i - length(x["m"])).alias("back"), x["r"]["kind"].alias("kind"), x["r"]["rule"].alias("rule"), x["r"]["label"].alias("label"),
            ))

        return let(ahead, tried)

    return F.array_sort(F.flatten(F.transform(places, at)))


def _kept(detections: Column) -> Column:
    """(label, kind) pairs that some unsuppressed detection has, from detections in order."""
    n = len(CLASSES)
    start = F.struct(
        F.array_repeat(F.lit(-1), n).alias("reach"), F.array().cast("array<struct<label:string,kind:int>>").alias("kept"), F.lit(0).cast("bigint").alias("n"),
    )

    def step(a: Column, d: Column) -> Column:
        stays = F.get(a["reach"], d["kind"]) < -d["back"]
        reach = F.transform(a["reach"], lambda x, c: F.when(c >= d["kind"], F.greatest(x, -d["back"])).otherwise(x))
        named = F.array_union(a["kept"], F.array(F.struct(d["label"].alias("label"), d["kind"].alias("kind"))))
        return F.struct(
            F.when(stays, reach).otherwise(a["reach"]).alias("reach"), F.when(stays, named).otherwise(a["kept"]).alias("kept"),
            (a["n"] + stays.cast("bigint")).alias("n"),
        )

    return F.aggregate(detections, start, step, lambda a: F.struct(a["kept"].alias("kept"), a["n"].alias("n")))


def _base_places(words: Column, places: Column) -> Column:
    """(start, label) of every place where a base phrase stands."""

    def of(label: str, phrase: str) -> Column:
        stands = lambda i: F.forall(
            F.array(*[F.coalesce(F.get(words, i + k) == w, F.lit(False)) for k, w in enumerate(phrase.split())]), lambda x: x
        )
        return F.transform(F.filter(places, lambda i: stands(i)), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))

    return F.concat(*[of(label, phrase) for label, phrase in BASE])


def scanned(docs: DataFrame, text: str = "text", ruleset: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row as `doc` with n_words, base places and labels, the labels kept by the rules and the score."""
    starters = sorted({r.first for r in ruleset} | {p.split()[0] for _, p in BASE})
    by_first, worth = _by_first(ruleset), F.array(*[F.lit(WORTH[c]) for c in CLASSES])

    def read(words: Column) -> Column:
        hits = F.array_intersect(words, _strings(starters))

        def placed(places: Column) -> Column:
            return F.struct(F.size(words).cast("bigint").alias("n_words"), _base_places(words, places).alias("base"), _kept(_detected(words, places, by_first)).alias("rules"))

        return let(let(hits, lambda h: _standing(words, h)), placed)

    made = docs.select(F.struct("*").alias("doc"), let(license_words(F.col(text)), read).alias("x"))
    base, kept = F.col("x.base"), F.col("x.rules.kept")
    starts = F.transform(base, lambda b: b["start"].cast("bigint"))
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda b: b["label"])))
    labels = F.array_sort(F.array_union(F.transform(base, lambda b: b["label"]), F.transform(kept, lambda k: k["label"])))
    best = F.array_max(F.transform(kept, lambda k: F.get(worth, k["kind"])))
    return made.select(
        "doc", F.col("x.n_words").alias("n_words"), F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        base_labels.alias("base_labels"), labels.alias("labels"), F.col("x.rules.n").alias("n_detections"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size(base) > 0, F.lit(BASE_WORTH)).otherwise(F.lit(0.0))).alias("score"),
    )


def op11_license_scan(spark, sf_dir):
    rows = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("doc.doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score", "n_detections")


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _oracle() -> str:
    values = ", ".join(f"({r.kind}, {r.number}, {_quoted(r.first)}, {_quoted(f'^(?:{r.pattern})')}, {_quoted(r.label)}, {WORTH[CLASSES[r.kind]]})" for r in RULES)
    phrases = ", ".join(f"({_quoted(label)}, {len(p.split())}, {_quoted(p.split()[0])}, {_quoted(p)})" for label, p in BASE)
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
rules(kind, rule, first, pattern, label, worth) AS (VALUES {values}),
phrases(label, size, first, phrase) AS (VALUES {phrases}),
spots AS MATERIALIZED (SELECT k, i, w[i] AS word, w[i:i + {SPAN - 1}] AS ahead FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM docs)
    WHERE w[i] IN (SELECT first FROM rules UNION SELECT first FROM phrases)),
base AS (SELECT k, i - 1 AS start, label FROM spots JOIN phrases ON first = word WHERE array_to_string(ahead[1:size], ' ') = phrase),
tried AS (SELECT k, i - 1 AS start, kind, rule, label, worth, regexp_extract(' ' || array_to_string(ahead, '  ') || ' ', pattern, 0) AS m FROM spots JOIN rules ON first = word),
found AS MATERIALIZED (SELECT * EXCLUDE (m), start + (length(m) - length(replace(m, ' ', ''))) // 2 AS stop FROM tried WHERE m <> ''),
kept AS (SELECT * FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.k = a.k AND b.start <= a.start AND b.stop >= a.stop AND
    (b.kind < a.kind OR (b.kind = a.kind AND (b.start < a.start OR b.stop > a.stop OR b.rule < a.rule))))),
by_base AS (SELECT k, count(*) AS n, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM base GROUP BY k),
by_rule AS (SELECT k, max(worth) AS worth, count(*) AS n FROM kept GROUP BY k),
named AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM (SELECT k, label FROM base UNION ALL SELECT k, label FROM kept) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(b.names, '') AS base_labels, coalesce(l.names, '') AS labels,
    CAST(greatest(coalesce(r.worth, 0), CASE WHEN b.n > 0 THEN {BASE_WORTH} ELSE 0 END) AS DOUBLE) AS score, CAST(coalesce(r.n, 0) AS BIGINT) AS n_detections
FROM docs d LEFT JOIN by_base b USING (k) LEFT JOIN by_rule r USING (k) LEFT JOIN named l USING (k)"""


QUERIES = {"op11_license_scan": op11_license_scan}
ORACLES = {"op11_license_scan": _oracle()}
