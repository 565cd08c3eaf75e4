"""Quality criteria: clustered questions, scored answers, scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom import vocabulary as V
from bidloom.functions import labels as L
from bidloom.functions import questions as Q
from bidloom.functions.common import round_half_up
from bidloom.functions.similarity import text_similarity
from bidloom.operators.ordering import earliest_cluster, numbered
from bidloom.session import checkpoint

SAME_TEXT_RATIO = 0.82
COMMON_SHARE = 0.3


def question_profile(texts: DataFrame, question: str = "question") -> DataFrame:
    """Each distinct question with the evidence `same_question` compares."""
    tokens = Q.question_tokens(question)
    base = texts.withColumns({"tokens": tokens, "acronyms": Q.acronyms(question), "reading": Q.question_reading(question)})
    return base.withColumns(
        {
            "digits": F.filter("tokens", lambda t: t.rlike("^[0-9]+$")),
            "words": Q.content_words(F.col("tokens")),
        }
    )


def same_question(a: str, b: str, likeness: Column) -> Column:
    """Two phrasings of one requirement. `a` and `b` are struct columns from question_profile."""
    A, B = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    return ~_figures_conflict(A, B) & (_evidence_alike(A, B) | (likeness >= SAME_TEXT_RATIO))


def _figures_conflict(A, B) -> Column:
    return (F.size(A("digits")) > 0) & (F.size(B("digits")) > 0) & ~F.arrays_overlap(A("digits"), B("digits"))


def _evidence_alike(A, B) -> Column:
    union = F.size(F.array_union(A("tokens"), B("tokens")))
    common = F.array_intersect(A("tokens"), B("tokens"))
    distinctive = F.size(F.array_except(common, F.array(*[F.lit(w) for w in ("yes", "no", "months", "month")])))
    pair = (distinctive >= 2) & (distinctive / union >= COMMON_SHARE)
    words = F.size(F.array_intersect(A("words"), B("words")))
    shorter = F.least(F.size(A("words")), F.size(B("words")))
    shorthand = (shorter > 0) & (words == shorter)
    initials = F.arrays_overlap(A("tokens"), B("acronyms")) | F.arrays_overlap(B("tokens"), A("acronyms"))
    telling = F.array_except(F.array_intersect(A("words"), B("words")), F.array(*[F.lit(w) for w in ("delivery", "quality", "monthly")]))
    same_target = (
        (A("reading.threshold") == B("reading.threshold"))
        & A("reading.unit").eqNullSafe(B("reading.unit"))
        & ((F.size(telling) > 0) | initials)
    )
    return pair | shorthand | initials | F.coalesce(same_target, F.lit(False)) | (F.size(common) / union >= 0.5)


def _rarity(nodes: DataFrame, column: str) -> DataFrame:
    return nodes.select(F.explode(column).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))


def _rarest_first(nodes: DataFrame, key: str, column: str) -> DataFrame:
    """The column's members ordered rarest first; a question's own members only, so groups stay small."""
    return (
        nodes.select(key, F.explode(column).alias("gram"))
        .join(_rarity(nodes, column), "gram")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("r"))
        .select(key, F.col("r.gram").alias(f"{column}_rare"))
    )


def question_pairs(nodes: DataFrame, key: str = "question", rank: str = "rank", directed: bool = False) -> DataFrame:
    """(earlier, later) questions that are the same requirement.

    Likeness of texts depends on which comes first. With `directed` every pair is judged both
    ways round and `earlier` is the one that stands already; otherwise `rank` says.

    Candidates are found by equality on keys every matching pair must share:
    one of the rarest tokens (any pair alike on tokens), the shorter phrasing's
    rarest word (shorthand), a token that is the other's initials, a common
    target with a word, or one of the rarest letter pairs (near-identical text).
    """
    letters = F.sequence(F.lit(1), F.greatest(F.length(key) - 1, F.lit(1)))
    enriched = nodes.withColumn(
        "grams", F.array_distinct(F.transform(letters, lambda i: F.substr(F.lower(F.col(key)), i, F.lit(2))))
    )
    for column in ("tokens", "words", "grams"):
        enriched = enriched.join(_rarest_first(enriched.select(key, column), key, column), key, "left")
    enriched = checkpoint(enriched)

    none = F.array().cast("array<string>")
    tag = lambda kind, arr: F.transform(F.coalesce(arr, none), lambda x: F.concat_ws("|", F.lit(kind), x))
    token_prefix = F.slice("tokens_rare", 1, F.size("tokens_rare") - F.ceil(F.size("tokens_rare") * COMMON_SHARE) + 1)
    gram_prefix = F.slice("grams_rare", 1, F.least(F.size("grams_rare"), F.floor(F.length(key) * 0.61) + 1))
    first_word = F.slice("words_rare", 1, 1)
    target = F.when(
        F.col("reading.threshold").isNotNull(),
        F.transform("words", lambda w: F.concat_ws("|", F.lit("t"), F.col("reading.threshold").cast("string"), F.coalesce("reading.unit", F.lit("-")), w)),
    )
    shared = F.concat(tag("w", token_prefix), F.coalesce(target, none), tag("g", gram_prefix))
    left_keys = F.concat(shared, tag("x", first_word), tag("y", F.col("words")), tag("p", F.col("tokens")), tag("q", F.col("acronyms")))
    right_keys = F.concat(shared, tag("x", F.col("words")), tag("y", first_word), tag("p", F.col("acronyms")), tag("q", F.col("tokens")))

    usable = enriched.where(F.size("tokens") > 0)
    left = usable.select(F.col(key).alias("earlier"), F.col(rank).alias("er"), F.explode(left_keys).alias("k"))
    right = usable.select(F.col(key).alias("later"), F.col(rank).alias("lr"), F.explode(right_keys).alias("k"))
    order = F.col("earlier") != F.col("later") if directed else F.col("er") < F.col("lr")
    candidates = left.join(right, "k").where(order).select("earlier", "later").distinct()

    facts = F.struct("tokens", "digits", "words", "acronyms", "reading")
    a = usable.select(F.col(key).alias("earlier"), facts.alias("a"))
    b = usable.select(F.col(key).alias("later"), facts.alias("b"))
    both = candidates.join(a, "earlier").join(b, "later")
    A, B = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    judged = both.select(
        "earlier", "later",
        _figures_conflict(A, B).alias("conflict"),
        _evidence_alike(A, B).alias("alike"),
    ).where(~F.col("conflict"))
    needs_text = ~F.col("alike")
    scored = judged.withColumn(
        "ratio", text_similarity(F.when(needs_text, F.col("earlier")), F.when(needs_text, F.col("later")))
    )
    return scored.where(F.col("alike") | (F.col("ratio") >= SAME_TEXT_RATIO)).select("earlier", "later")


def question_clusters(answers: DataFrame) -> DataFrame:
    """Every distinct question with the earliest question of its cluster.

    `answers` needs vendor_ord, question_ord and question; copies of a question
    collapse before anything is compared.
    """
    asked = answers.where(F.trim("question") != "").groupBy(F.trim("question").alias("question")).agg(
        F.min(F.struct("vendor_ord", "question_ord")).alias("rank"), F.count("*").alias("asked")
    )
    nodes = checkpoint(question_profile(asked))
    clusters = earliest_cluster(nodes, question_pairs(nodes), "question", "rank")
    return nodes.select("question", "rank", "asked", "reading").join(clusters, "question")


def derive_criteria(clusters: DataFrame, units_per_month: float | Column | None = None) -> DataFrame:
    """One criterion per cluster: clearest phrasing, first stated target, every variant counted."""
    has_target = F.col("reading.threshold").isNotNull()
    target = F.struct("reading.direction", "reading.threshold", "reading.unit")
    grouped = clusters.groupBy("root").agg(
        F.min("rank").alias("rank"),
        F.count("*").alias("variants"),
        F.max_by(F.col("question"), F.struct(Q.phrasing_rank("question"), (-F.col("rank.vendor_ord")).alias("v"), (-F.col("rank.question_ord")).alias("q"))).alias("question"),
        F.min_by(F.col("reading"), F.col("rank")).alias("own"),
        F.min_by(target, F.when(has_target, F.col("rank"))).alias("stated"),
    )
    placed = numbered(grouped.withColumn("slug", Q.question_slug("root")).withColumns({"v": F.col("rank.vendor_ord"), "q": F.col("rank.question_ord")}), "position", "v", "q")
    first_of_slug = placed.groupBy("slug").agg(F.min("position").alias("first_position"))
    chosen = F.when(F.col("own.threshold").isNotNull() | F.col("stated").isNull(), F.struct("own.direction", "own.threshold", "own.unit")).otherwise(F.col("stated"))
    monthly = F.lit(None).cast("double") if units_per_month is None else (F.lit(units_per_month) if not isinstance(units_per_month, Column) else units_per_month)
    return placed.join(first_of_slug, "slug").withColumn("target", chosen).select(
        F.when(F.col("position") == F.col("first_position"), F.col("slug")).otherwise(F.concat_ws("_", "slug", F.col("position").cast("string"))).alias("key"),
        F.col("position").cast("bigint").alias("position"),
        "question", "root", "variants",
        F.col("own.kind").alias("kind"),
        "target.direction", "target.threshold", "target.unit",
        F.lit("Scored").alias("requirement"),
        F.lit(1.0).alias("weight"),
        Q.suggested_threshold(F.col("target.unit"), monthly).alias("suggested_threshold"),
    )


def latest_answers(answers: DataFrame, clusters: DataFrame, criteria: DataFrame) -> DataFrame:
    """Each vendor's answer per criterion; where it answered twice the later answer stands."""
    keyed = (
        answers.withColumn("question", F.trim("question"))
        .join(clusters.select("question", "root"), "question")
        .join(criteria.select("root", "key"), "root")
    )
    return read_answers(keyed)


def read_answers(keyed: DataFrame) -> DataFrame:
    """Answers already tied to a criterion `key`, read into verdict, figure and evidence."""
    last = keyed.groupBy("vendor", "key").agg(
        F.max(F.struct("question_ord", "answer", "stated_value", "evidence", "note")).alias("said")
    )
    reading = Q.answer_reading(F.col("said.answer"), F.col("said.stated_value"), F.col("said.evidence"), F.col("said.note"))
    return last.select("vendor", "key", reading.alias("r")).select("vendor", "key", "r.*")


def score_answers(answers: DataFrame, criteria: DataFrame) -> DataFrame:
    """One row per answered criterion: met or not, by how much it falls short, and why.

    The figure decides where there is both a figure and a target; otherwise the
    answer does. Criteria are a small dimension and reach the answers by an
    ordinary join.
    """
    facts = criteria.select(
        "key", "question", "direction", F.col("threshold").alias("target"), "requirement", "weight",
        Q.threshold_label(F.col("direction"), F.col("threshold"), F.col("unit")).alias("target_label"),
    )
    joined = answers.drop("unit").join(facts, "key")
    answered = F.col("verdict") != "Unanswered"
    measured = answered & F.col("target").isNotNull() & F.col("value").isNotNull()
    clears = F.when(F.col("direction") == "lower_better", F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target"))
    meets = F.when(measured, clears).otherwise(F.col("verdict") == "Yes")
    shortfall = F.when(measured & ~clears & (F.col("target") != 0), F.abs(F.col("value") - F.col("target")) / F.col("target"))
    explanation = (
        F.when(~answered, F.lit("Did not address this question at all."))
        .when(
            measured,
            F.concat(F.lit("Stated "), F.col("stated_text"), F.lit(", which "), F.when(clears, F.lit("meets")).otherwise(F.lit("does not meet")),
                     F.lit(" the target of "), F.col("target_label"), F.lit(".")),
        )
        .when(F.col("verdict") == "Yes", F.lit("Answered Yes."))
        .when(F.col("verdict") == "Partial", F.lit("Answered only in part."))
        .when(F.col("note") == "", F.lit("Answered No."))
        .otherwise(F.concat(F.lit("Answered No — "), F.col("note")))
    )
    return joined.select(
        "vendor", "key", "question", "verdict", "stated_text", "value", "target", "direction",
        meets.alias("meets"), "evidence", "evidence_text", "note",
        F.when(meets, F.lit(1.0)).otherwise(F.lit(0.0)).alias("score"),
        "requirement", "weight", shortfall.alias("shortfall"), explanation.alias("explanation"),
    )


def scorecards(scored: DataFrame, criteria: DataFrame, vendors: DataFrame) -> DataFrame:
    """Per vendor: weight satisfied over weight in play, must-haves missed, silences, figures disclosed.

    What a vendor never answered is the criteria less what it did answer, so no
    vendor-by-criterion product is built to find it.
    """
    counted = F.col("requirement") != "Ignore"
    exact = lambda c: c.cast("decimal(28,6)")
    totals = criteria.agg(
        F.struct(
            F.coalesce(F.sum(F.when(counted, exact(F.col("weight")))).cast("double"), F.lit(0.0)).alias("weight"),
            F.array_sort(F.collect_set("key")).alias("keys"),
            F.array_sort(F.collect_set(F.when(F.col("requirement") == "Must have", F.col("key")))).alias("musts"),
        ).alias("t")
    ).scalar()
    mine = scored.groupBy("vendor").agg(
        F.coalesce(F.sum(F.when(counted & F.col("meets"), exact(F.col("weight")))).cast("double"), F.lit(0.0)).alias("met_weight"),
        F.collect_set(F.when(F.col("verdict") != "Unanswered", F.col("key"))).alias("answered"),
        F.collect_set(F.when((F.col("requirement") == "Must have") & F.col("meets"), F.col("key"))).alias("met_musts"),
        F.count("value").alias("disclosed_figures"),
    )
    none, held = F.array().cast("array<string>"), totals
    totals = F.col("totals")
    quality = F.when(totals["weight"] > 0, round_half_up(F.coalesce("met_weight", F.lit(0.0)) / totals["weight"], 4)).otherwise(F.lit(0.0))
    failures = F.array_except(totals["musts"], F.coalesce("met_musts", none))
    return vendors.select("vendor").join(mine, "vendor", "left").withColumn("totals", held).select(
        "vendor",
        quality.alias("quality_score"),
        (F.size(failures) == 0).alias("meets_requirements"),
        failures.alias("hard_failures"),
        F.array_except(totals["keys"], F.coalesce("answered", none)).alias("unanswered_criteria"),
        F.coalesce("disclosed_figures", F.lit(0).cast("bigint")).alias("disclosed_figures"),
    )


def with_overrides(criteria: DataFrame, overrides: DataFrame) -> DataFrame:
    """The buyer's settings (key, requirement, threshold, weight) over the derived criteria.

    Answers are untouched: rescoring is `score_answers` again on the result.
    """
    o = overrides.select(
        "key", F.col("requirement").alias("o_requirement"), F.col("threshold").alias("o_threshold"),
        F.col("weight").alias("o_weight"), F.lit(True).alias("set"),
    )
    return criteria.join(o, "key", "left").withColumns(
        {
            "requirement": F.coalesce("o_requirement", "requirement"),
            "threshold": F.when(F.col("set"), F.col("o_threshold")).otherwise(F.col("threshold")),
            "weight": F.coalesce("o_weight", "weight"),
        }
    ).drop("o_requirement", "o_threshold", "o_weight", "set")


def questionnaire(scored: DataFrame, criteria: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row per vendor and criterion, silence included: what the stored table holds."""
    dims = criteria.agg(
        F.collect_list(F.struct("key", "question", F.col("threshold").alias("target"), "direction", "requirement", "weight")).alias("c")
    ).scalar()
    wanted = vendors.select("vendor", F.inline(dims)).alias("w")
    answered = scored.select("vendor", "key", "verdict", "stated_text", "value", "meets", "evidence", "evidence_text", "note", "score")
    return wanted.join(answered, ["vendor", "key"], "left").select(
        "vendor", F.col("key").alias("criterion_key"), "question",
        F.coalesce("verdict", F.lit("Unanswered")).alias("verdict"),
        F.coalesce("stated_text", F.lit("")).alias("stated_value"),
        F.col("value").alias("numeric_value"), "target", "direction",
        F.coalesce("meets", F.lit(False)).cast("int").alias("meets"),
        F.coalesce("evidence", F.lit("none")).alias("evidence"),
        F.coalesce("evidence_text", F.lit("")).alias("evidence_text"),
        F.coalesce("note", F.lit("")).alias("note"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "requirement", "weight",
    )


def questionnaire_grid(table: DataFrame, criteria: DataFrame, cards: DataFrame, vendors: list[str]) -> DataFrame:
    """Criteria as rows, the named vendors as columns, and the score row beneath."""
    state = L.answer_state(F.col("verdict"), F.col("meets") == 1)
    mark = F.coalesce(*[F.when(state == k, F.lit(m)) for k, m in V.VERDICT_MARKS.items()])
    shown = F.when(F.col("numeric_value").isNotNull(), F.col("stated_value")).otherwise(F.col("verdict"))
    backing = F.when(F.col("evidence") != "none", F.concat(F.lit("  ("), L.evidence_label(F.col("evidence")), F.lit(")"))).otherwise(F.lit(""))
    text = F.when(state == "Unanswered", F.lit("— not answered")).otherwise(F.concat(mark, F.lit(" "), shown, backing))
    wide = table.select("criterion_key", "vendor", text.alias("t")).groupBy("criterion_key").pivot("vendor", vendors).agg(F.min("t"))
    label = Q.criterion_label(F.col("question"), F.col("direction"), F.col("threshold"), F.col("unit"))
    rows = criteria.select(F.col("key").alias("criterion_key"), "position", label.alias("criterion"), F.format_string("%.2f", "weight").alias("weight")).join(wide, "criterion_key", "left")
    totals = (
        cards.where(F.col("vendor").isin(vendors))
        .select(F.lit("").alias("criterion_key"), "vendor", F.format_string("%.0f", F.col("quality_score") * 100).alias("t"))
        .groupBy("criterion_key").pivot("vendor", vendors).agg(F.min("t"))
        .withColumns({"position": F.lit(None).cast("bigint"), "criterion": F.lit("QUALITY SCORE"), "weight": F.lit("")})
    )
    return rows.unionByName(totals)
