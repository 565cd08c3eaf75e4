"""

Each query reads the given tables whole. SQL is given wherever the same answer
can be stated in SQL; clustering, exact text likeness and the full matching
ladder are tested against brute force in `tests/` instead.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions import dates, questions, text, units
from bidloom.operators import attribution, award, derive, grid, matching, normalise, ordering, reports, requests, shortlist
from bidloom.operators import criteria as quality
from bidloom.plans import analyses, comparison, inputs, sqlview
from bidloom.session import Scratch
from bidloom.sources import catalogues, documents, replies, sinks

# The subpackage is optional: without its folder there are fewer queries. One that is there but broken is an error.
llm = import_module("bidloom.llm.registry") if find_spec("bidloom.llm") and find_spec("bidloom.llm.registry") else None

RATES_AS_OF = "2026-01-01"
TODAY = "2026-03-01"


def _comparison(spark: SparkSession, d: str, level: str, scored: bool = False) -> comparison.Comparison:
    extra = {}
    if scored:
        extra = {"answers": _answers(spark, d), "criteria": inputs.criteria(spark), "terms": inputs.terms(spark, d)}
    return comparison.build(
        inputs.quote_lines(spark, d, level), inputs.request_lines(spark, d), inputs.responses(spark, d, level),
        normalise.fx_rates(spark, RATES_AS_OF), by_code_only=True, **extra,
    )


def _laddered(spark: SparkSession, d: str) -> comparison.Comparison:
    """Codes and wording mixed, all rungs of the ladder."""
    rates = normalise.fx_rates(spark, RATES_AS_OF)
    return comparison.build(inputs.mixed_lines(spark, d), inputs.request_lines(spark, d), inputs.responses(spark, d), rates, mode="portable")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return quality.read_answers(inputs.answers(spark, d))


def _joined(df: DataFrame) -> DataFrame:
    """Lists as comma-joined text, so rows compare across engines."""
    return df.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def _houses(spark: SparkSession, d: str) -> list[str]:
    """The pooled vendors, one for each region there is."""
    return sorted(f"House {r.r_name}" for r in inputs.read(spark, d, "region").select("r_name").collect())


def _listed(vendors: DataFrame) -> DataFrame:
    return vendors.withColumns({"quality_score": F.lit(1.0), "meets_requirements": F.lit(True)})


# --- prices ------------------------------------------------------------------

def award_lines(spark, d):
    c = _comparison(spark, d, "supplier")
    lines = award.allocate(grid.offers(c.cells), c.items)
    return lines.select("rfx_sku", "winner", "price", "extended", "runner_up", "runner_up_price", "saving_per_unit", "extended_saving", "contenders", "status")


def normalized_quotes(spark, d):
    cells = _comparison(spark, d, "supplier").cells
    return _joined(cells.select(
        "rfx_sku", "vendor", "original_value", "original_currency", "canonical_value", "factor", "rules", "status", "flags", "comparable"
    ))


def refusals(spark, d):
    cells = _comparison(spark, d, "supplier").cells.where("status = 'Unresolved'")
    return cells.select("rfx_sku", "vendor", "reason", "missing_datum")


def status_counts(spark, d):
    return _comparison(spark, d, "supplier").cells.groupBy("status").agg(F.count("*").alias("n"), F.sum("comparable").alias("comparable"))


def fx_restamp(spark, d):
    c = _comparison(spark, d, "house")
    later = normalise.normalise_quotes(c.placed, normalise.fx_rates(spark, "2026-02-01", {"INR": 1.0, "USD": 90.0, "EUR": 94.2}))
    return later.groupBy("vendor", "status").agg(F.count("*").alias("n"))


def unit_parse(spark, d):
    lines = inputs.quote_lines(spark, d).groupBy("unit_text").agg(F.count("*").alias("lines"))
    read = units.with_unit(lines, "unit_text")
    return read.select("unit_text", "lines", F.col("quoted_family").alias("family"), F.col("unit_pack").alias("pack"), F.col("unit_noun").alias("noun"))


def condition_flags(spark, d):
    lines = inputs.quote_lines(spark, d)
    flags = F.array_join(units.condition_flags(F.col("conditions"), F.col("notes")), ",")
    unread = F.array_join(units.unrecognised_conditions(F.col("conditions")), ";")
    return lines.groupBy(flags.alias("flags"), unread.alias("unrecognised")).agg(F.count("*").alias("n"))


def confidence_scores(spark, d):
    cells = _comparison(spark, d, "supplier").cells
    return cells.select("rfx_sku", "vendor", "extraction_confidence", F.array_join("confidence_notes", "; ").alias("notes"))


# --- matching ----------------------------------------------------------------

def sku_match(spark, d):
    matched = matching.match_by_code(inputs.quote_lines(spark, d), inputs.request_lines(spark, d), "left")
    return matched.select("line_id", "rfx_sku", "match_basis", "match_confidence")


def marker_vocabulary(spark, d):
    return matching.marker_vocabulary(inputs.request_lines(spark, d))


def dimension_signatures(spark, d):
    items = inputs.request_lines(spark, d).select("sku", F.array_join(text.dimension_signature("description").cast("array<string>"), "x").alias("size"))
    return items.where("size is not null").groupBy("size").agg(F.count("*").alias("items"))


def _texts(spark, d):
    return inputs.uncoded_lines(spark, d).select(matching.line_text().alias("text")).distinct()


def dimension_match(spark, d):
    items = inputs.request_lines(spark, d)
    vocabulary = matching.marker_vocabulary(items)
    catalogue = matching.catalogue_profile(items, vocabulary)
    found = matching.match_by_size(matching.profile(_texts(spark, d), "text", vocabulary), catalogue)
    return found.select("text", "rfx_sku", "match_confidence")


def description_match(spark, d):
    items = inputs.request_lines(spark, d)
    vocabulary = matching.marker_vocabulary(items)
    catalogue = matching.checkpoint(matching.catalogue_profile(items, vocabulary))
    texts = matching.checkpoint(matching.profile(_texts(spark, d), "text", vocabulary))
    found = matching.match_by_description(texts, catalogue, "portable")
    return found.select("text", "rfx_sku", "match_confidence")


def description_match_exact(spark, d):
    """The same rung with the matching-blocks ratio."""
    items = inputs.request_lines(spark, d)
    vocabulary = matching.marker_vocabulary(items)
    catalogue = matching.checkpoint(matching.catalogue_profile(items, vocabulary))
    texts = matching.checkpoint(matching.profile(_texts(spark, d), "text", vocabulary))
    return matching.match_by_description(texts, catalogue, "exact").select("text", "rfx_sku", "match_confidence")


def match_ladder(spark, d):
    matched = _laddered(spark, d).matched
    return matched.select("line_id", "rfx_sku", "match_basis", "match_confidence")


def ladder_cells(spark, d):
    cells = _laddered(spark, d).cells
    return _joined(cells.select("rfx_sku", "vendor", "original_value", "canonical_value", "rules", "status", "flags", "comparable", "match_basis", "match_confidence"))


def ladder_unplaced(spark, d):
    return _laddered(spark, d).unplaced


def ladder_award(spark, d):
    c = _laddered(spark, d)
    lines = award.allocate(grid.offers(c.cells), c.items)
    return lines.select("rfx_sku", "winner", "price", "extended", "runner_up", "runner_up_price", "contenders", "status")


def duplicate_quotes(spark, d):
    c = _comparison(spark, d, "supplier")
    return matching.repeated_lines(c.matched, c.placed).select("line_id", "vendor", "rfx_sku", "quoted_value")


def unplaced_lines(spark, d):
    return _comparison(spark, d, "supplier").unplaced


# --- the grid ------------------------------------------------------------------

def coverage_gaps(spark, d):
    return _comparison(spark, d, "supplier").gaps


def full_grid(spark, d):
    c = _comparison(spark, d, "house")
    return grid.full_grid(c.cells, c.gaps, c.items).select("rfx_sku", "vendor", "status", "canonical_value", "reason")


def vendor_summary(spark, d):
    v = _comparison(spark, d, "supplier", scored=True).vendors
    return _joined(v.drop("vendor_ord"))


def comparison_view(spark, d):
    c = _comparison(spark, d, "supplier", scored=True).settled("rfx_sku", "vendor", "original_value", "canonical_value", "status", "comparable")
    view = grid.comparison_view(c.cells, c.items, c.vendors)
    return view.select("rfx_sku", "rfx_description", "rfx_quantity", "vendor", "canonical_value", "extended_value", "status", "quality_score", "coverage_quoted")


def cheapest_by_line(spark, d):
    return grid.cheapest_by_line(_comparison(spark, d, "supplier").cells)


def cheapest_hiding_vendors(spark, d):
    return grid.cheapest_by_line(_comparison(spark, d, "house").cells, _houses(spark, d)[1:])


def win_counts(spark, d):
    return grid.cheapest_by_line(_comparison(spark, d, "supplier").cells).groupBy("vendor").agg(F.count("*").alias("cheapest_on"))


def winner_margin(spark, d):
    c = _comparison(spark, d, "house")
    rows = grid.winner_margin(c.cells, c.items)
    return rows.withColumn("label", grid.winner_label(F.col("winner"), F.col("gap"), F.col("share"), F.col("verdict")))


def price_matrix(spark, d):
    c = _comparison(spark, d, "house")
    return grid.price_matrix(c.cells, c.items, _houses(spark, d))


def status_grid(spark, d):
    c = _comparison(spark, d, "house")
    return grid.display_grid(c.cells, c.items, _houses(spark, d))[1]


def label_grid(spark, d):
    c = _comparison(spark, d, "house")
    return grid.display_grid(c.cells, c.items, _houses(spark, d))[0]


def headline_stats(spark, d):
    c = _comparison(spark, d, "supplier").settled("rfx_sku", "vendor", "status", "comparable")
    return grid.headline_stats(c.cells, c.vendors, c.items)


def exceptions(spark, d):
    c = _comparison(spark, d, "house")
    return reports.exceptions(grid.full_grid(c.cells, c.gaps, c.items), c.items, c.unplaced)


def exception_counts(spark, d):
    return reports.exception_counts(exceptions(spark, d))


def review_legend(spark, d):
    return reports.review_legend(_comparison(spark, d, "supplier").cells)


def evidence(spark, d):
    c = _comparison(spark, d, "supplier")
    return _joined(grid.evidence(c.cells, "PTAA-123").select("rfx_sku", "vendor", "original_value", "original_unit", "canonical_value", "factor", "rules", "status", "source_snippet"))


def original_quotes(spark, d):
    return _joined(grid.original_quotes(_comparison(spark, d, "supplier").cells, "PTAA-123"))


def audit_export(spark, d):
    c = _comparison(spark, d, "house")
    return _joined(reports.audit_export(c.cells, c.items).select("rfx_sku", "description", "rfx_quantity", "vendor", "original_value", "canonical_value", "rules", "status"))


# --- the award -----------------------------------------------------------------

def _priced(spark, d) -> comparison.Comparison:
    """The houses' prices and facts, written out once for all that a plan reads them for."""
    return _comparison(spark, d, "house").settled("rfx_sku", "vendor", "comparable", "canonical_value")


def _plan(spark, d, **settings) -> tuple[award.AwardPlan, comparison.Comparison]:
    c = _priced(spark, d)
    return award.recommend(c.cells, c.items, _listed(c.vendors), **settings), c


def award_by_vendor(spark, d):
    return _plan(spark, d)[0].vendors


def award_table(spark, d):
    return reports.award_lines_table(_plan(spark, d)[0].lines)


def award_gaps(spark, d):
    return reports.award_gaps(_plan(spark, d)[0].lines)


def common_basket(spark, d):
    plan, _ = _plan(spark, d)
    return award.common_basket(plan.priced, plan.shortlist.where("eligible"))


def split_vs_single(spark, d):
    plan, c = _plan(spark, d)
    return award.split_vs_single(plan.lines, plan.priced, plan.shortlist.where("eligible"), c.items)


def plan_summary(spark, d):
    return _plan(spark, d)[0].summary


def award_stats(spark, d):
    return reports.award_stats(_plan(spark, d)[0].summary)


def award_headline(spark, d):
    return award.headline(_plan(spark, d)[0].vendors)


def consolidated_award(spark, d):
    """The award of the whole comparison after consolidation at the higher of the ordinary bars."""
    plan, _ = _plan(spark, d, min_lines=ORDINARY_BARS[1])
    return plan.lines.select("rfx_sku", "winner", "price", "contenders", "status", "reassigned_from")


def consolidated_plan(spark, d):
    """Consolidation over the whole comparison at ordinary bars: what each drops, where it stops and what it costs."""
    c = _priced(spark, d)

    def at(min_lines):
        plan = award.recommend(c.cells, c.items, _listed(c.vendors), min_lines)
        facts = {"dropped": F.lit(plan.consolidation.n).cast("bigint"), "stopped": F.lit(plan.consolidation.stopped)}
        return plan.lines.select(F.lit(min_lines).cast("bigint").alias("min_lines"), "rfx_sku", "winner", "price", "contenders", "status", "reassigned_from"), plan.summary.withColumns(facts)

    (low, low_facts), (high, high_facts) = (at(n) for n in ORDINARY_BARS)
    facts = [f.select("consolidation_cost", "dropped", "stopped") for f in (low_facts, high_facts)]
    return low.crossJoin(F.broadcast(facts[0])).unionAll(high.crossJoin(F.broadcast(facts[1])))


# Lines a house has to win to be worth an award.
ORDINARY_BARS = (3, 300)
SUPPLIER_BAR = 15


def consolidated_suppliers(spark, d):
    """The suppliers dropped at a bar, in order, where each supplier quotes for itself."""
    c = _comparison(spark, d, "supplier")
    # The offers are read more than once: lines are matched and placed once for that.
    done = award.dropped_for_size(Scratch(spark, "offers").save(grid.offers(c.cells), "offers"), c.responses, SUPPLIER_BAR)
    return done.dropped.select("vendor", "place", F.lit(done.n).cast("bigint").alias("dropped"), F.lit(done.stopped).alias("stopped"))


def award_caveats(spark, d):
    plan, c = _plan(spark, d)
    return award.caveats(plan, c.vendors)


def shortlist_by_quality(spark, d):
    v = award.shortlist(_comparison(spark, d, "supplier", scored=True).vendors, 0.6)
    return v.select("vendor", "quality_score", "meets_requirements", "eligible")


# --- quality --------------------------------------------------------------------

def question_parse(spark, d):
    asked = inputs.answers(spark, d).groupBy("question").agg(F.count("*").alias("asked"))
    read = asked.withColumn("r", questions.question_reading("question"))
    return read.select("question", "asked", "r.*", questions.question_slug("question").alias("slug"))


def question_clusters(spark, d):
    clusters = quality.question_clusters(inputs.answers(spark, d))
    return clusters.select("question", "root", "asked")


def derived_criteria(spark, d):
    clusters = quality.question_clusters(inputs.answers(spark, d))
    monthly = derive.basket_per_month(inputs.request_lines(spark, d)).select("units_per_month").scalar()
    return quality.derive_criteria(clusters, monthly)


def scored_answers(spark, d):
    return quality.score_answers(_answers(spark, d), inputs.criteria(spark)).select(
        "vendor", "key", "verdict", "stated_text", "value", "meets", "evidence", "score", "explanation"
    )


def _cards(spark, d, criteria):
    scored = quality.score_answers(_answers(spark, d), criteria)
    return quality.scorecards(scored, criteria, inputs.responses(spark, d))


def scorecards(spark, d):
    return _joined(_cards(spark, d, inputs.criteria(spark)))


def rescored(spark, d):
    changes = spark.createDataFrame([("iso", "Scored", None, 3.0), ("capacity", "Must have", 14000.0, 1.0)], "key string, requirement string, threshold double, weight double")
    return _joined(_cards(spark, d, quality.with_overrides(inputs.criteria(spark), changes)))


def scorecard_report(spark, d):
    return reports.scorecard_table(_cards(spark, d, inputs.criteria(spark)), F.lit(len(inputs.CRITERIA)))


def questionnaire(spark, d):
    criteria = inputs.criteria(spark)
    scored = quality.score_answers(_answers(spark, d), criteria)
    return quality.questionnaire(scored, criteria, inputs.responses(spark, d)).select("vendor", "criterion_key", "verdict", "numeric_value", "target", "meets", "score", "requirement")


# --- deriving the list -------------------------------------------------------------

def _grouped(spark, d):
    lines = inputs.quote_lines(spark, d)
    return lines.withColumn("sku", text.item_code("vendor_sku")).where("sku is not null")


def unit_vote(spark, d):
    return derive.vote_units(_grouped(spark, d))


def quantity_vote(spark, d):
    return derive.vote_quantities(_grouped(spark, d))


def description_vote(spark, d):
    worded = inputs.uncoded_lines(spark, d).withColumnsRenamed({"true_sku": "sku"}).withColumns({"vendor_ord": F.lit(0), "line_id": F.col("vendor")})
    return derive.best_descriptions(worded)


def currency_vote(spark, d):
    return derive.vote_currency(inputs.quote_lines(spark, d), inputs.responses(spark, d))


def basket_monthly(spark, d):
    return derive.basket_per_month(inputs.request_lines(spark, d))


def derived_items(spark, d):
    worded = inputs.uncoded_lines(spark, d)
    lines = worded.select(
        "vendor", F.lit(0).cast("bigint").alias("vendor_ord"), "line_ord", F.concat_ws("/", "vendor", "line_ord", "true_sku").alias("line_id"),
        F.when(F.col("line_ord") % 2 == 0, F.col("true_sku")).alias("vendor_sku"), "description",
        F.lit("per box").alias("unit_text"), F.lit(None).cast("double").alias("quantity"),
    )
    return derive.derive_items(derive.group_lines(lines, "portable"))


def placeholder_codes(spark, d):
    """Customers as groups without a code, in a list where every third part number is a code in use."""
    seen = F.struct(F.col("c_nationkey").alias("vendor_ord"), F.col("c_custkey").alias("line_ord"), F.col("c_name").alias("line_id"))
    groups = inputs.read(spark, d, "customer").select(F.col("c_name").alias("text"), F.col("c_name").alias("root"), seen.alias("seen"))
    taken = inputs.read(spark, d, "part").where("p_partkey % 3 = 0").select(F.expr("concat('ITEM-', lpad(cast(p_partkey as string), greatest(3, length(cast(p_partkey as string))), '0')) AS sku"))
    return derive.mint_codes(groups, taken).select("text", "sku")


# --- documents ------------------------------------------------------------------

def folder_lines(spark, d):
    """Documents written out as text files by language, and the folder read back file by file."""
    path = Scratch(spark, "folder-lines").path("texts")
    inputs.read(spark, d, "documents").select("lang", "text").where("text IS NOT NULL").write.partitionBy("lang").text(path)
    lines = documents.intake(spark, path, whole_bytes=1 << 17).lines.where(F.col("file").endswith(".txt") & (F.trim("line") != ""))
    lang = F.regexp_extract("file", "lang=([^/]*)/", 1)
    return lines.groupBy(lang.alias("lang")).agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def request_catalogue(spark, d):
    """Orders as request files of drifting shape, read back: lines as plain text, figures as text, files that are no JSON."""
    was, _ = inputs.snapshots(spark, d)
    item = F.expr("""case when item % 5 = 0 then concat('"plain ', item, '"')
        when item % 7 = 0 then concat('{"sku": "P-', item, '", "description": "part ', item, '", "quantity": "1,', lpad(item % 1000, 3, '0'), ' pcs"}')
        else concat('{"sku": "P-', item, '", "description": " part ', item, ' ", "quantity": ', quantity, ', "unit": "box"}') end""")
    files = was.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("line_no", item.alias("said")))).alias("l"))
    value = F.expr("""case when request_id % 97 = 0 then 'not json' else concat('{"title": "Order ', request_id, '", "window_days": "', request_id % 30, ' days", "lines": [', array_join(l.said, ', '), '], "basis": ', request_id % 3, '}') end""")
    read = catalogues.parse_requests(files.select(F.col("request_id").cast("string").alias("request_id"), value.alias("value")))
    head = read.header.select("request_id", "title", "window_days", F.element_at("rescued", F.lit("basis")).alias("basis"))
    return head.join(read.lines.select("request_id", "line_no", "sku", "description", "quantity", "canonical_unit"), "request_id", "left")


def vendor_directory(spark, d):
    """Customers as directory files, some scores written as text, read back."""
    value = F.expr("""concat('{"categories": [{"key": "', c_mktsegment, '", "vendors": [{"name": " ', c_name, '", "incumbent": ', case when c_custkey % 10 = 0 then '"TRUE"' when c_custkey % 10 = 1 then 'true' else '0' end,
        ', "scores": {"quality": ', 5 + c_custkey % 6, ', "delivery": ', case when c_custkey % 7 = 0 then '"unknown"' else concat('"', 4 + c_custkey % 5, '.5"') end, '}, "rank": ', c_nationkey, '}, {"name": ""}]}]}')""")
    read = catalogues.parse_directory(inputs.read(spark, d, "customer").select(value.alias("value")))
    return read.select("category_key", "vendor", "incumbent", F.col("scores.quality").alias("quality"), F.col("scores.delivery").alias("delivery"), F.element_at("rescued", F.lit("rank")).alias("rank"))


def located_lines(spark, d):
    return documents.located_lines(inputs.read(spark, d, "documents"), "doc_id", "text").select("doc_id", "line_no", "located")


def located_rows(spark, d):
    rows = documents.located_lines(inputs.read(spark, d, "conversations"), "conv_id", "text", "row", keep_blank=False)
    return rows.groupBy("conv_id").agg(F.count("*").alias("rows"), F.max("line_no").alias("last_row"))


def html_text(spark, d):
    pages = inputs.read(spark, d, "pages").withColumn("body", documents.html_to_text("html"))
    return documents.located_lines(pages, "page_id", "body").select("page_id", "line_no", "located")


def text_triage(spark, d):
    docs = inputs.read(spark, d, "documents")
    return docs.select("doc_id", documents.triage("text").alias("t")).select("doc_id", "t.rejected", "t.reason")


def document_limits(spark, d):
    docs = inputs.read(spark, d, "documents").select("doc_id", documents.in_parts("text", 20_000).alias("t"))
    chars = F.aggregate("t.parts", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x["text"]))
    return docs.select("doc_id", "t.over_limit", F.size("t.parts").alias("parts"), chars.alias("chars"))


def decoded_text(spark, d):
    docs = inputs.read(spark, d, "documents")
    raw = docs.select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return raw.select("doc_id", F.md5(F.encode(documents.decode_text(F.col("content")), "UTF-8")).alias("digest"))


def file_formats(spark, d):
    files = documents.route(inputs.responses(spark, d).select(F.col("source_file").alias("file")))
    return files.groupBy("extension", "reader", "format").agg(F.count("*").alias("files"))


def file_outcomes(spark, d):
    # Every customer sent a document; only suppliers' documents hold quoted lines.
    quoting = inputs.quote_lines(spark, d).groupBy(F.regexp_extract("vendor", "([0-9]+)$", 1).alias("file")).agg(F.count("*").alias("lines_found"))
    docs = inputs.read(spark, d, "customer").select(
        F.regexp_extract("c_name", "([0-9]+)$", 1).alias("file"), F.lit("text").alias("reader"),
        (F.col("c_custkey") % 17 != 0).alias("has_content"), F.expr("case when c_custkey % 23 = 0 then 'unreadable' end").alias("error"),
    )
    return replies.outcomes(docs, quoting)


def blanket_conditions(spark, d):
    return replies.blanket_conditions(inputs.quote_lines(spark, d))


def demoted_conditions(spark, d):
    lines, terms = replies.demote_blanket(inputs.quote_lines(spark, d), inputs.terms(spark, d))
    kept = lines.select("vendor", F.size("conditions").alias("k")).groupBy("vendor").agg(F.sum("k").alias("conditions_left"))
    return kept.join(terms.groupBy("vendor").agg(F.count("*").alias("terms")), "vendor")


def _reply_files(spark, d):
    lines = inputs.quote_lines(spark, d)
    fields = F.struct("vendor_sku", "description", "quoted_value", "currency", "unit_text", "confidence", "conditions", F.struct(F.col("source_locator").alias("locator")).alias("source"))
    # One reply file per line bundle keeps every file small however large a vendor is.
    bundles = lines.groupBy("vendor", F.floor(F.col("line_ord") / 1000).alias("part")).agg(F.array_sort(F.collect_list(F.struct("line_ord", "line_id", fields.alias("x")))).alias("l"))
    doc = F.to_json(F.struct("vendor", F.col("l.x").alias("lines")))
    return bundles.select(F.concat_ws("-", "vendor", F.col("part").cast("string")).alias("file"), doc.alias("value"))


def responses_flat(spark, d):
    read = replies.parse_replies(_reply_files(spark, d)).lines
    return read.groupBy("vendor", "unit_text", "currency").agg(
        F.count("*").alias("lines"), F.count("quoted_value").alias("priced"), F.sum(F.size("conditions")).alias("conditions")
    )


# --- invitations and requests -----------------------------------------------------

def _invitations(spark, d):
    return attribution.invitations(inputs.invited_requests(spark, d), inputs.invited(spark, d))


def invite_tokens(spark, d):
    return _invitations(spark, d).select("request_id", "vendor", "token", "subject", "attachment_name")


def reply_attribution(spark, d):
    sent = _invitations(spark, d)
    return attribution.attribute_replies(inputs.replies(spark, d, sent), sent)


def credited_replies(spark, d):
    sent = _invitations(spark, d)
    came = inputs.replies(spark, d, sent)
    whose = attribution.attribute_replies(came, sent)
    read = came.select("reply_id", F.col("read_as").alias("vendor"))
    return attribution.credited(read, whose, "reply_id")


def invitation_status(spark, d):
    sent = _invitations(spark, d)
    answered = attribution.attribute_replies(inputs.replies(spark, d, sent), sent).where("vendor is not null").select("vendor").distinct()
    state = sent.join(answered.withColumn("responded", F.lit(True)), "vendor", "left")
    ok = F.when(F.col("vendor_ord") % 5 != 0, F.col("vendor_ord") % 7 != 0)
    status = attribution.invitation_status(F.coalesce("responded", F.lit(False)), ok)
    return state.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def request_validation(spark, d):
    return requests.validation_issues(inputs.requests(spark, d))


def quoting_windows(spark, d):
    r = inputs.requests(spark, d)
    days = dates.window_days(F.col("starts_at"), F.col("ends_at"))
    return r.select("request_id", days.alias("days"), dates.window_check(days).alias("check"), dates.stamp(F.col("starts_at")).alias("opens"))


def rate_staleness(spark, d):
    age = dates.rate_age(F.col("o_orderdate"), F.lit("1998-06-01").cast("date"))
    return inputs.read(spark, d, "orders").groupBy(dates.rate_check(age).alias("check")).agg(F.count("*").alias("n"))


def vendor_shortlist(spark, d):
    return shortlist.recommended_vendors(inputs.directory(spark, d)).select("category", "vendor", "rating", "approved", "clearing")


def vendor_ratings(spark, d):
    return shortlist.rated(inputs.directory(spark, d)).select("vendor", "rating", "why")


def _catalogue(spark, d):
    return inputs.request_lines(spark, d).withColumn("catalogue", F.floor((F.col("line_no") - 1) / 50))


def replenishment_draw(spark, d):
    drawn = requests.replenishment_draw(_catalogue(spark, d), "catalogue", "day-1")
    return drawn.select("catalogue", "sku", "line_no", "origin")


def annual_list(spark, d):
    lines = _catalogue(spark, d)
    optional = F.col("line_no") % 50 > 28
    return requests.annual_list(lines.where(~optional), lines.where(optional), "catalogue", "2026").select("catalogue", "sku", "origin")


def edit_log_fold(spark, d):
    return requests.fold_line_events(inputs.edit_events(spark, d)).drop("added_at")


def sendable_lines(spark, d):
    lines = requests.fold_line_events(inputs.edit_events(spark, d))
    return requests.sendable_lines(lines).groupBy("request_id").agg(F.count("*").alias("lines"))


def table_diff(spark, d):
    before, after = inputs.snapshots(spark, d)
    diff = requests.snapshot_diff(before, after, ["request_id", "line_no"], ["item", "quantity"])
    return diff.select("request_id", "line_no", "change")


def merged_edits(spark, d):
    before, after = inputs.snapshots(spark, d)
    name = lambda df: df.withColumns({"sku": F.concat(F.lit("L-"), F.col("line_no").cast("string")), "description": F.concat(F.lit("item "), F.col("item").cast("string"))})
    stored = name(before).withColumns({"canonical_unit": F.lit("per box"), "note": F.lit(""), "origin": F.when(F.col("item") % 2 == 0, "suggested").otherwise("document")})
    edited = name(after).withColumn("unit", F.lit("box"))
    return requests.merge_line_edits(stored, edited).select("request_id", "sku", "description", "quantity", "origin")


def _terms_text(spark, d):
    line = F.concat_ws("\n", F.concat(F.lit("Payment: "), F.col("o_orderpriority")), F.lit("  net of tax"), F.col("o_orderstatus"), F.concat(F.lit("payment: "), F.col("o_custkey").cast("string")))
    return inputs.read(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), line.alias("text"))


def terms_parse(spark, d):
    return requests.terms_from_text(_terms_text(spark, d))


def unique_item_codes(spark, d):
    lines = inputs.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    rows = lines.select(F.col("l_orderkey").alias("request_id"), F.concat(F.lit("C-"), (F.col("p") % 2).cast("string")).alias("sku"), "l_linenumber")
    return ordering.unique_codes(rows, "sku", "l_linenumber", "request_id")


def completed_terms(spark, d):
    own = requests.terms_from_text(_terms_text(spark, d)).select("request_id", "kind", "text")
    standing = inputs.read(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.explode(F.array(F.lit("payment"), F.lit("tax"))).alias("kind"), F.lit("as usual").alias("text"))
    return requests.complete_rows(own, standing, ["request_id", "kind"]).groupBy("kind").agg(F.count("*").alias("n"))


def extra_invitees(spark, d):
    ticked = inputs.invited(spark, d).where("vendor_ord % 3 = 0").select("request_id", "vendor")
    typed = inputs.invited(spark, d).where("vendor_ord % 2 = 0").select("request_id", "vendor")
    return requests.extra_invitees(typed, ticked)


def asked_questions(spark, d):
    asked = inputs.answers(spark, d).select((F.col("vendor_ord") % 10).alias("request_id"), (F.col("vendor_ord") * 10 + F.col("question_ord")).alias("event_ord"), "question")
    return requests.accepted_questions(asked).select("request_id", "question", "key", "threshold")


def merged_questions(spark, d):
    """Each order's questions and files after an edit, and whether the edit changed the order at all."""
    # Lines are gathered once for all that reads them, and edits merged once for what they are and for what they changed.
    scratch = Scratch(spark, "merged-questions")
    was, now = (scratch.save(df, "snapshot") for df in inputs.snapshots(spark, d))
    ask = lambda df: F.concat(F.lit("Is part "), (F.col("item") % 50).cast("string"), F.lit(" in stock?"))
    rows = lambda df: df.withColumns({
        "serial": F.col("line_no"), "question": ask(df), "direction": F.lit("boolean"), "threshold": F.col("quantity").cast("double"), "unit": F.lit(" "),
        "requirement": F.when(F.col("item") % 3 == 0, F.lit("Must have")).otherwise(F.lit("as before")), "weight": F.when(F.col("item") % 4 == 0, F.lit(0.0)),
    })
    stored = rows(was).withColumns({
        "key": F.concat(F.lit("part_"), (F.col("item") % 50).cast("string")), "kind": F.lit("other"), "variants": F.array("question"), "unit": F.lit(None).cast("string"),
        "requirement": F.when(F.col("item") % 3 == 0, F.lit("Must have")).otherwise(F.lit("Scored")), "weight": F.when(F.col("item") % 4 == 0, F.lit(0.0)).otherwise(F.lit(1.0)),
    })
    typed = rows(now).withColumn("question", F.when(F.col("item") % 5 == 0, F.concat(F.lit(" Corrected: "), "question")).otherwise(F.col("question")))
    merged = scratch.save(requests.merge_criteria_edits(stored, typed), "questions")
    asks = requests.changed_requests(stored, merged, "serial", requests.CRITERION)
    files = lambda df: df.select("request_id", "line_no", F.concat(F.lit("file-"), F.col("line_no").cast("string")).alias("name"), (F.col("quantity") % 2).cast("string").alias("note"))
    listed = scratch.save(requests.merge_attachment_edits(files(was), files(now)), "files")
    held = requests.changed_requests(files(was), listed, "line_no", ["name", "note"])
    questions_ = merged.select("request_id", F.lit("question").alias("part"), "serial", "key", F.col("question").alias("text"), F.array_join("variants", "|").alias("variants"), "requirement", "weight")
    notes = listed.select("request_id", F.lit("file").alias("part"), F.col("line_no").alias("serial"), F.col("name").alias("key"), F.col("note").alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("variants", "string"), ("requirement", "string"), ("weight", "double"))])
    return questions_.join(asks, "request_id").unionAll(notes.join(held, "request_id"))


def document_lines(spark, d):
    """Lines of an order's own document beside those it has; every third comes without a code."""
    was, now = inputs.snapshots(spark, d)
    had = was.select("request_id", "line_no", F.concat(F.lit("P-"), (F.col("item") % 4).cast("string")).alias("sku"), F.lit("kept").alias("description"), "quantity", F.lit("buyer").alias("origin"))
    had = ordering.unique_codes(had, "sku", "line_no", "request_id")
    said = now.select(
        "request_id", "line_no", F.when(F.col("item") % 3 != 0, F.concat(F.lit("p "), (F.col("item") % 4).cast("string"))).alias("sku"),
        F.when(F.col("item") % 11 != 0, F.concat(F.lit("Widget no "), F.col("item").cast("string"), F.lit(" large"))).alias("description"), (F.col("quantity") % 7).alias("quantity"), F.lit("box").alias("unit"), F.lit(None).cast("string").alias("note"),
    )
    return requests.add_document_lines(had, said).select("request_id", "line_no", "sku", "description", "quantity", "origin")


def question_log_fold(spark, d):
    """Suppliers' questions as the log of ten requests: most are added, each fourth takes away what it names."""
    removes = (F.col("vendor_ord") + F.col("question_ord")) % 4 == 0
    none = {c: F.lit(None).cast(t) for c, t in (("threshold", "double"), ("direction", "string"), ("unit", "string"))}
    log = inputs.answers(spark, d).select(
        (F.col("vendor_ord") % 10).alias("request_id"), (F.col("vendor_ord") * 10 + F.col("question_ord")).alias("event_ord"), "question",
        F.when(removes, F.lit("remove_question")).otherwise(F.lit("add_question")).alias("op"),
        F.when(F.col("vendor_ord") % 3 == 0, F.lit("Must have")).alias("requirement"), (F.col("vendor_ord") % 2).cast("double").alias("weight"),
    ).withColumns(none)
    return requests.fold_question_events(log)


# --- warnings, reports, analyses, SQL ----------------------------------------------

def warnings(spark, d):
    return _comparison(spark, d, "supplier", scored=True).warnings()


def warning_counts(spark, d):
    return reports.warning_counts(warnings(spark, d))


def vendor_report(spark, d):
    return reports.vendor_table(_comparison(spark, d, "supplier").vendors)


def terms_report(spark, d):
    return reports.terms_table(inputs.terms(spark, d))


def cheapest_cleared(spark, d):
    c = _comparison(spark, d, "supplier", scored=True).settled("rfx_sku", "vendor", "comparable", "canonical_value")
    return analyses.cheapest_among_cleared(c.cells, c.vendors, 0.6)


def split_analysis(spark, d):
    c = _priced(spark, d)
    return analyses.split_against_single(c.cells, c.items, _listed(c.vendors))


def price_disagreements(spark, d):
    return analyses.price_disagreements(_comparison(spark, d, "supplier").cells)


def what_to_ask(spark, d):
    return analyses.what_to_ask(_comparison(spark, d, "supplier").cells)


def effect_of_quality(spark, d):
    c = _comparison(spark, d, "supplier", scored=True).settled("rfx_sku", "vendor", "comparable", "canonical_value")
    return analyses.effect_of_quality(c.cells, c.items, c.vendors, 0.6)


def guarded_sql(spark, d):
    c = _comparison(spark, d, "house")
    surface = sqlview.SqlSurface(spark, {"quotes": c.cells, "rfx_lines": c.items, "vendors": c.vendors})
    return surface.query(
        "SELECT q.vendor, r.canonical_unit, COUNT(*) AS n, MIN(q.canonical_value) AS lowest FROM quotes q "
        "JOIN rfx_lines r ON r.sku = q.rfx_sku WHERE q.comparable = 1 AND q.canonical_value > :floor GROUP BY q.vendor, r.canonical_unit",
        {"floor": 1.0},
    )


STORED = """
    SELECT 'rfx_lines' AS source, canonical_unit AS label, count(*) AS n, cast(min(quantity) AS double) AS low FROM rfx_lines GROUP BY 2
    UNION ALL SELECT 'vendors', cast(meets_requirements AS string), count(*), cast(min(coverage_quoted) AS double) FROM vendors GROUP BY 2
    UNION ALL SELECT 'questionnaire', verdict, count(*), min(score) FROM questionnaire GROUP BY 2
    UNION ALL SELECT 'terms', kind, count(*), min(value) FROM terms GROUP BY 2
    UNION ALL SELECT 'quotes', status, count(*), min(canonical_value) FROM quotes WHERE status <> 'Not Quoted' GROUP BY 2
    UNION ALL SELECT 'award', status, count(*), min(price) FROM award GROUP BY 2
    UNION ALL SELECT 'comparison', status, count(*), min(extended_value) FROM comparison WHERE status <> 'Not Quoted' GROUP BY 2
"""


def _stored(spark, d) -> sqlview.SqlSurface:
    """A comparison written to the shared folder, its award replaced, and reopened."""
    c = _comparison(spark, d, "supplier", scored=True).settled()
    path = Scratch(spark, "stored-comparison").path("store")
    sinks.write_comparison(c.stored(), path)
    sinks.write_award(award.allocate(grid.offers(c.cells), c.items), path)
    return sqlview.SqlSurface.stored(spark, path)


def stored_comparison(spark, d):
    return _stored(spark, d).query(STORED)


def sql_shown(spark, d):
    """What a person is shown of a longer result, and that it goes on."""
    shown = _stored(spark, d).show("SELECT rfx_sku, winner, price FROM award WHERE winner IS NOT NULL ORDER BY price DESC, rfx_sku")
    rows = [(r["rfx_sku"], r["winner"], r["price"], shown.truncated) for r in shown.rows]
    return spark.createDataFrame(rows, "rfx_sku string, winner string, price double, truncated boolean")


_QUERIES = (
    award_lines, normalized_quotes, refusals, status_counts, fx_restamp, unit_parse, condition_flags, confidence_scores,
    sku_match, marker_vocabulary, dimension_signatures, dimension_match, description_match, description_match_exact, match_ladder, ladder_cells, ladder_unplaced, ladder_award, duplicate_quotes, unplaced_lines,
    coverage_gaps, full_grid, vendor_summary, comparison_view, cheapest_by_line, cheapest_hiding_vendors, win_counts, winner_margin,
    price_matrix, status_grid, label_grid, headline_stats, exceptions, exception_counts, review_legend, evidence, original_quotes, audit_export,
    award_by_vendor, award_table, award_gaps, common_basket, split_vs_single, plan_summary, award_stats, award_headline,
    consolidated_award, consolidated_plan, consolidated_suppliers, award_caveats, shortlist_by_quality,
    question_parse, question_clusters, derived_criteria, scored_answers, scorecards, rescored, scorecard_report, questionnaire,
    unit_vote, quantity_vote, description_vote, currency_vote, basket_monthly, derived_items, placeholder_codes,
    folder_lines, request_catalogue, vendor_directory, located_lines, located_rows, html_text, text_triage, document_limits, decoded_text, file_formats, file_outcomes,
    blanket_conditions, demoted_conditions, responses_flat,
    invite_tokens, reply_attribution, credited_replies, invitation_status, request_validation, quoting_windows, rate_staleness,
    vendor_shortlist, vendor_ratings, replenishment_draw, annual_list, edit_log_fold, sendable_lines, table_diff, merged_edits,
    terms_parse, unique_item_codes, completed_terms, extra_invitees, asked_questions, question_log_fold, merged_questions, document_lines,
    warnings, warning_counts, vendor_report, terms_report, cheapest_cleared, split_analysis, price_disagreements, what_to_ask,
    effect_of_quality, guarded_sql, stored_comparison, sql_shown,
)


def entry(spark: SparkSession) -> DataFrame:
    """Who wins each item, at what price, and who is next."""
    return award_lines(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES} | (llm.queries() if llm else {})


def oracle_sql() -> dict[str, str]:
    import oracles

    return oracles.statements() | (llm.oracle_sql() if llm else {})
