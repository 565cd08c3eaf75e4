"""The item-by-vendor grid, coverage and vendor summaries.

Only quoted cells are stored. "Not Quoted" is held as runs of consecutive
missing lines per vendor, which says exactly the same without ever pairing
every item with every vendor; runs are expanded only for a display.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from bidloom import vocabulary as V
from bidloom.functions import labels
from bidloom.functions.common import blank_to_null
from bidloom.operators.normalise import CELL_COLUMNS
from bidloom.session import Scratch

RUN_BUCKET = 65_536


def coverage_gaps(placed: DataFrame, vendors: DataFrame, items: DataFrame, bucket: int = RUN_BUCKET) -> DataFrame:
    """Runs of request lines each vendor did not price: (vendor, first_line, last_line, missing).

    `placed` has vendor and line_no, numbered 1..n. Neighbours are compared
    within fixed-size stretches of the list first, then across stretches, so
    even a vendor holding most of the data is spread over many tasks.
    """
    total = items.agg(F.count("*").alias("n")).scalar()
    # Written out once: neighbours, ends of stretches and reaches all read it, and lines are placed only once for them.
    quoted = Scratch(placed.sparkSession, "gaps").save(placed.select("vendor", "line_no", F.floor(F.col("line_no") / bucket).alias("stretch")), "quoted")
    inside = quoted.withColumn(
        "before", F.lag("line_no").over(Window.partitionBy("vendor", "stretch").orderBy("line_no"))
    ).select("vendor", (F.col("before") + 1).alias("first_line"), (F.col("line_no") - 1).alias("last_line"))

    ends = quoted.groupBy("vendor", "stretch").agg(F.min("line_no").alias("low"), F.max("line_no").alias("high"))
    by_stretch = Window.partitionBy("vendor").orderBy("stretch")
    across = ends.select(
        "vendor",
        (F.lag("high", 1, 0).over(by_stretch) + 1).alias("first_line"),
        (F.col("low") - 1).alias("last_line"),
    )
    reach = ends.groupBy("vendor").agg(F.max("high").alias("high"))
    tail = vendors.select("vendor").join(reach, "vendor", "left").select(
        "vendor", (F.coalesce("high", F.lit(0)) + 1).alias("first_line"), total.cast("bigint").alias("last_line")
    )
    return (
        inside.unionByName(across)
        .unionByName(tail)
        .where(F.col("last_line") >= F.col("first_line"))
        .withColumn("missing", F.col("last_line") - F.col("first_line") + 1)
    )


def not_quoted_cells(gaps: DataFrame, items: DataFrame, base_currency: str = V.BASE_CURRENCY) -> DataFrame:
    """One "Not Quoted" cell per missing line: the expanded form of the runs."""
    lines = gaps.select("vendor", F.explode(F.sequence("first_line", "last_line")).alias("line_no"))
    empty = F.array().cast("array<string>")
    return lines.join(items.select("line_no", F.col("sku").alias("rfx_sku"), "canonical_unit"), "line_no").select(
        "rfx_sku", "vendor",
        *[F.lit(None).cast("string").alias(c) for c in ("original_text",)],
        F.lit(None).cast("double").alias("original_value"),
        *[F.lit(None).cast("string").alias(c) for c in ("original_unit", "original_currency")],
        F.lit(None).cast("double").alias("canonical_value"),
        "canonical_unit",
        F.lit(base_currency).alias("canonical_currency"),
        F.lit(None).cast("string").alias("factor"),
        empty.alias("rules"),
        F.lit(V.NOT_QUOTED).alias("status"),
        F.lit("This line does not appear anywhere in the vendor's response.").alias("reason"),
        F.lit(None).cast("string").alias("missing_datum"),
        empty.alias("flags"),
        F.lit(0).alias("comparable"),
        F.lit("unmatched").alias("match_basis"),
        F.lit(0.0).alias("match_confidence"),
        F.lit(0.0).alias("extraction_confidence"),
        empty.alias("confidence_notes"),
        empty.alias("unrecognised_conditions"),
        *[F.lit(None).cast("string").alias(c) for c in ("source_file", "source_locator", "source_snippet")],
    ).select(*CELL_COLUMNS)


def full_grid(cells: DataFrame, gaps: DataFrame, items: DataFrame) -> DataFrame:
    """Every line for every vendor, for the moments a dense grid is really wanted."""
    return cells.select(*CELL_COLUMNS).unionByName(not_quoted_cells(gaps, items))


def vendor_summary(
    responses: DataFrame, matched: DataFrame, cells: DataFrame, items: DataFrame, scorecards: DataFrame | None = None
) -> DataFrame:
    """One row per vendor: coverage, comparability, quality and the terms it stated."""
    total = items.agg(F.count("*").alias("n")).scalar()
    read = matched.groupBy("vendor").agg(
        F.count("*").alias("lines_read"),
        F.count_if(F.col("rfx_sku").isNull()).alias("extra_lines"),
        F.count_if(blank_to_null("currency").isNotNull()).alias("with_currency"),
    )
    priced = cells.groupBy("vendor").agg(
        F.count("*").alias("coverage_quoted"), F.sum("comparable").cast("bigint").alias("comparable_lines")
    )
    base = responses.join(read, "vendor", "left").join(priced, "vendor", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    summary = base.select(
        "vendor", "vendor_ord", "source_file",
        zero("coverage_quoted").alias("coverage_quoted"),
        total.cast("bigint").alias("coverage_total"),
        zero("comparable_lines").alias("comparable_lines"),
        zero("extra_lines").alias("extra_lines"),
        (zero("lines_read") - zero("extra_lines") - zero("coverage_quoted")).alias("second_prices"),
        "freight_included", "payment_terms_days", "lead_time_days", "document_currency",
        ((zero("with_currency") == 0) & blank_to_null("document_currency").isNull()).alias("currency_assumed"),
        "unresolved_references", "overall_confidence",
    )
    if scorecards is None:
        return summary
    return summary.join(scorecards, "vendor", "left")


def comparison_view(cells: DataFrame, items: DataFrame, vendors: DataFrame) -> DataFrame:
    """Cells, with what of them is given, with their item and vendor facts beside them, plus the extended value."""
    i = items.select(
        F.col("sku").alias("rfx_sku"), F.col("description").alias("rfx_description"),
        F.col("quantity").alias("rfx_quantity"), F.col("canonical_unit").alias("rfx_unit"),
    )
    facts = [c for c in ("meets_requirements", "quality_score", "freight_included", "coverage_quoted", "coverage_total") if c in vendors.columns]
    v = vendors.select("vendor", *facts)
    shown = (
        "rfx_sku", "vendor", "original_value", "original_unit", "original_currency", "canonical_value", "canonical_currency",
        "factor", "status", "reason", "missing_datum", "flags", "comparable", "extraction_confidence", "source_locator", "source_snippet",
    )
    q = cells.select(*[c for c in shown if c in cells.columns])
    return q.join(i, "rfx_sku").join(v, "vendor").withColumn(
        "extended_value", F.col("canonical_value") * F.col("rfx_quantity")
    )


def offers(cells: DataFrame, vendors: DataFrame | list[str] | None = None) -> DataFrame:
    """Comparable prices only, optionally for a shortlist or the vendors left visible."""
    priced = cells.where(F.col("comparable") == 1).select("rfx_sku", "vendor", F.col("canonical_value").alias("price"))
    if isinstance(vendors, list):
        return priced.where(F.col("vendor").isin(vendors))
    return priced if vendors is None else priced.join(vendors.select("vendor"), "vendor", "left_semi")


def cheapest_by_line(cells: DataFrame, vendors: DataFrame | list[str] | None = None) -> DataFrame:
    """The cheapest comparable vendor per item (price, then vendor)."""
    return (
        offers(cells, vendors)
        .groupBy("rfx_sku")
        .agg(F.min(F.struct("price", "vendor")).alias("best"))
        .select("rfx_sku", F.col("best.vendor").alias("vendor"), F.col("best.price").alias("price"))
    )


def lowest(k: int, *order: str) -> Column:
    """The k least of the given columns as an array of structs: a bounded aggregate that merges map-side."""
    return F.array_sort(InternalFunction.collect_top_k(F.struct(*order), k, True))


def two_best(priced: DataFrame, *by: str) -> DataFrame:
    """Winner, runner-up and number of contenders per item (and `by`), from one aggregate.

    Its state is two offers and a count, merged before the shuffle, so an item
    quoted by most vendors sends one row per task and the offers are read once.
    """
    top = priced.groupBy("rfx_sku", *by).agg(lowest(2, "price", "vendor").alias("best"), F.count("*").alias("contenders"))
    first, second = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    return top.select(
        "rfx_sku", *by, first["vendor"].alias("winner"), first["price"].alias("price"),
        second["vendor"].alias("runner_up"), second["price"].alias("runner_up_price"), "contenders",
    )


def winner_margin(cells: DataFrame, items: DataFrame, vendors: DataFrame | list[str] | None = None) -> DataFrame:
    """Who is cheapest on each item, and whether by enough to matter."""
    ranked = items.select(F.col("sku").alias("rfx_sku")).join(two_best(offers(cells, vendors)), "rfx_sku", "left")
    gap = F.col("runner_up_price") - F.col("price")
    share = F.when(F.col("runner_up_price") != 0, gap / F.col("runner_up_price")).otherwise(F.lit(0.0))
    verdict = (
        F.when(F.col("winner").isNull(), F.lit("no comparable price"))
        .when(F.col("contenders") < 2, F.lit("only price"))
        .when(share < 0.005, F.lit("too close to call"))
        .otherwise(F.lit("cheaper"))
    )
    return ranked.select(
        "rfx_sku", "winner", "price", gap.alias("gap"),
        F.when(F.col("runner_up_price").isNotNull(), share).alias("share"), verdict.alias("verdict"),
    )


def winner_label(winner: Column, gap: Column, share: Column, verdict: Column) -> Column:
    """`Acme · ₹4.00 (9%) cheaper`."""
    money = F.concat(F.lit(V.CURRENCY_SYMBOLS[V.BASE_CURRENCY]), F.format_number(gap, 2))
    return (
        F.when(verdict == "no comparable price", verdict)
        .when(verdict == "only price", F.concat(winner, F.lit(" · only price")))
        .when(verdict == "too close to call", F.concat(winner, F.lit(" · "), money, F.lit(" ahead — too close to call")))
        .otherwise(F.concat(winner, F.lit(" · "), money, F.lit(" ("), F.format_string("%.0f", share * 100), F.lit("%) cheaper")))
    )


def price_matrix(cells: DataFrame, items: DataFrame, vendors: list[str], normalised: bool = True) -> DataFrame:
    """Items as rows and the named vendors as columns; prices that do not compare are NULL."""
    value = F.when(F.col("comparable") == 1, F.col("canonical_value")) if normalised else F.col("original_value")
    wide = (
        cells.where(F.col("vendor").isin(vendors))
        .select("rfx_sku", "vendor", value.alias("value"))
        .groupBy("rfx_sku")
        .pivot("vendor", vendors)
        .agg(F.min("value"))
    )
    return items.select(F.col("sku").alias("rfx_sku"), "line_no").join(wide, "rfx_sku", "left")


def display_grid(cells: DataFrame, items: DataFrame, vendors: list[str], normalised: bool = True) -> tuple[DataFrame, DataFrame]:
    """The labelled grid and its parallel grid of statuses, for the named vendors."""
    shown = cells.where(F.col("vendor").isin(vendors)).select(
        "rfx_sku", "vendor", "status",
        labels.cell_label({c: F.col(c) for c in cells.columns}, normalised).alias("label"),
    )
    frame = items.select(
        F.col("sku").alias("rfx_sku"), "line_no", "description",
        F.coalesce(F.format_number("quantity", 0), F.lit("—")).alias("qty"),
        F.replace(F.col("canonical_unit"), F.lit("per "), F.lit("")).alias("unit"),
    )

    def spread(value: str, absent: str) -> DataFrame:
        wide = shown.groupBy("rfx_sku").pivot("vendor", vendors).agg(F.min(value))
        return frame.join(wide, "rfx_sku", "left").na.fill(absent, vendors)

    return spread("label", "not quoted"), spread("status", V.NOT_QUOTED)


def headline_stats(cells: DataFrame, vendors: DataFrame, items: DataFrame) -> DataFrame:
    """The counters a buyer sees first, from one pass over the quoted cells."""
    n_items = items.agg(F.count("*").alias("n")).scalar()
    n_vendors = vendors.agg(F.count("*").alias("n")).scalar()
    formats = vendors.agg(
        F.count_distinct(labels.format_name(F.lower(F.regexp_extract("source_file", r"\.([^.]*)$", 1)))).alias("n")
    ).scalar()
    per_item = cells.groupBy("rfx_sku").agg(
        F.count("*").alias("quoted"), F.sum("comparable").alias("ok"),
        F.count_if(F.col("status").isin(V.UNRESOLVED, V.NEEDS_REVIEW)).alias("doubtful"),
    )
    return per_item.agg(
        F.coalesce(F.sum("ok"), F.lit(0)).cast("bigint").alias("comparable_cells"),
        F.coalesce(F.sum("quoted"), F.lit(0)).cast("bigint").alias("quoted_cells"),
        F.coalesce(F.sum("doubtful"), F.lit(0)).cast("bigint").alias("doubtful_cells"),
        F.count_if(F.col("ok") > 0).alias("items_with_best_price"),
    ).withColumns({"suppliers": n_vendors.cast("bigint"), "formats": formats.cast("bigint"), "items": n_items.cast("bigint")}).withColumn(
        "cells", F.col("items") * F.col("suppliers")
    ).select(
        "suppliers", "formats", "comparable_cells", "cells",
        (F.col("doubtful_cells") + F.col("cells") - F.col("quoted_cells")).alias("need_attention"),
        "items_with_best_price", "items",
    )


def evidence(cells: DataFrame, rfx_sku: str, vendor: str | None = None) -> DataFrame:
    """What was written and what was done to it, for one cell or one item's vendors."""
    hit = cells.where(F.col("rfx_sku") == F.lit(rfx_sku))
    return hit if vendor is None else hit.where(F.col("vendor") == F.lit(vendor))


def original_quotes(cells: DataFrame, rfx_sku: str) -> DataFrame:
    """Everything needed to show what each vendor actually wrote for one item."""
    from bidloom.functions.common import lookup
    from bidloom.functions.units import money_text

    c = F.col
    stated = c("original_value").isNotNull()
    return evidence(cells, rfx_sku).select(
        "vendor", "status",
        lookup(c("status"), V.STATUS_SENTENCES).alias("plain"),
        F.when(stated, money_text(c("original_value"), F.coalesce("original_currency", F.lit(V.BASE_CURRENCY)))).alias("quoted"),
        F.coalesce("original_unit", F.when(stated, F.lit("unit not stated"))).alias("unit"),
        F.coalesce("original_currency", F.when(stated, F.lit("not stated"))).alias("currency"),
        F.when(c("canonical_value").isNotNull(), money_text(c("canonical_value"), c("canonical_currency"))).alias("comparable_price"),
        "factor", "reason", c("missing_datum").alias("missing"),
        labels.flag_legend(c("flags")).alias("flags"),
        F.when(stated, labels.confidence_label(c("extraction_confidence"))).otherwise(F.lit("—")).alias("confidence_label"),
        "confidence_notes", c("source_snippet").alias("snippet"), c("source_file").alias("file"), c("source_locator").alias("locator"),
        F.replace(c("match_basis"), F.lit("_"), F.lit(" ")).alias("match_basis"),
    )
