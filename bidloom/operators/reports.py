"""Reports a buyer reads. Each is a DataFrame; text is composed from columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom import vocabulary as V
from bidloom.functions import labels
from bidloom.functions.common import blank_to_null, lookup, percent, plain_number
from bidloom.functions.units import money_text

SEVERITY = {V.UNRESOLVED: 0, V.NEEDS_REVIEW: 1, V.NOT_QUOTED: 2}


def _as_quoted(value: Column, currency: Column, unit: Column) -> Column:
    said = F.concat(money_text(value, F.coalesce(currency, F.lit(V.BASE_CURRENCY))), F.coalesce(F.concat(F.lit(" "), blank_to_null(unit)), F.lit("")))
    return F.when(value.isNotNull(), said).otherwise(F.lit("—"))


def exceptions(cells: DataFrame, items: DataFrame, unplaced: DataFrame | None = None) -> DataFrame:
    """Everything that needs a human, with how badly (severity 0 worst), why, and what would settle it.

    Unordered: sort the result, or write it sorted, only when it is to be read.
    """
    named = items.select(F.col("sku").alias("rfx_sku"), F.col("description").alias("item"))
    open_cells = cells.where(F.col("status").isin(*SEVERITY)).join(named, "rfx_sku", "left")
    quoted = F.col("original_value").isNotNull()
    rows = open_cells.select(
        lookup(F.col("status"), SEVERITY).alias("severity"),
        "status", F.col("rfx_sku").alias("line"), F.coalesce("item", "rfx_sku").alias("item"), "vendor",
        _as_quoted(F.col("original_value"), F.col("original_currency"), F.col("original_unit")).alias("as_quoted"),
        F.when(quoted, labels.confidence_label(F.col("extraction_confidence"))).otherwise(F.lit("—")).alias("read_clarity"),
        F.col("reason").alias("why"),
        F.coalesce("missing_datum", F.lit("—")).alias("needed"),
    )
    if unplaced is None:
        return rows
    second = F.col("why").startswith("a second")
    left_out = unplaced.select(
        F.lit(3).alias("severity"),
        F.when(second, F.lit("Second price")).otherwise(F.lit("Not on your list")).alias("status"),
        F.col("code").alias("line"), F.col("description").alias("item"), "vendor",
        _as_quoted(F.col("value"), F.col("currency"), F.col("unit")).alias("as_quoted"),
        F.lit("—").alias("read_clarity"),
        F.when(second, F.concat(F.lit("Read from their quote, but it is "), F.col("why"), F.lit(" — only one price per item can go in the grid.")))
        .otherwise(F.lit("Read from their quote, but it does not match any item on your request.")).alias("why"),
        F.when(second, F.lit("Confirm which of the two prices applies."))
        .otherwise(F.lit("Add it to your request, or confirm they are quoting something you did not ask for.")).alias("needed"),
    )
    return rows.unionByName(left_out)


def exception_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("n"))


def review_legend(cells: DataFrame) -> DataFrame:
    """The review tags actually on screen, with how many cells carry each first."""
    flag = labels.review_flag(F.col("flags"))
    tagged = cells.where(F.col("status") == V.NEEDS_REVIEW).select(flag.alias("flag")).where(F.col("flag").isNotNull())
    return tagged.groupBy("flag").agg(F.count("*").alias("cells")).select(
        "flag", lookup(F.col("flag"), V.REVIEW_TAGS).alias("tag"), lookup(F.col("flag"), V.FLAG_LABELS).alias("meaning"), "cells"
    )


def scorecard_table(vendors: DataFrame, criteria_count: Column) -> DataFrame:
    return vendors.select(
        "vendor", F.format_string("%.0f", F.col("quality_score") * 100).alias("quality"),
        F.concat(F.col("disclosed_figures").cast("string"), F.lit("/"), criteria_count.cast("string")).alias("figures_disclosed"),
        F.size("unanswered_criteria").cast("bigint").alias("not_answered"),
        F.coalesce(blank_to_null(F.array_join("hard_failures", ", ")), F.lit("no")).alias("misses"),
        labels.score_band(F.col("quality_score")).alias("band"),
    )


def vendor_table(vendors: DataFrame) -> DataFrame:
    """One row per vendor as it is shown on cards."""
    pct = lambda c: F.floor(F.lit(100.0) * F.col(c) / F.greatest(F.col("coverage_total"), F.lit(1)) + 0.5).cast("bigint")
    days = lambda c, text: F.when(F.col(c) != 0, F.concat(text, F.lit(" days"))).otherwise(F.lit("not stated"))
    return vendors.select(
        "vendor", F.col("source_file").alias("document"),
        labels.format_name(F.lower(F.regexp_extract("source_file", r"\.([^.]*)$", 1))).alias("format"),
        F.concat_ws("/", F.col("coverage_quoted").cast("string"), F.col("coverage_total").cast("string")).alias("lines_quoted"),
        pct("coverage_quoted").alias("coverage_pct"), pct("comparable_lines").alias("comparable_pct"),
        labels.freight_label(F.col("freight_included")).alias("freight"),
        days("payment_terms_days", F.col("payment_terms_days").cast("string")).alias("payment"),
        days("lead_time_days", plain_number(F.col("lead_time_days"))).alias("lead_time"),
        F.coalesce("document_currency", F.lit("not stated")).alias("currency"),
        percent(F.col("overall_confidence")).alias("read_clarity"),
    )


def award_lines_table(lines: DataFrame) -> DataFrame:
    """Suggested supplier per item, with price, runner-up and saving in words."""
    base = F.lit(V.BASE_CURRENCY)
    saving = F.coalesce(
        money_text(F.col("extended_saving"), base),
        F.when(F.col("saving_per_unit") != 0, F.concat(money_text(F.col("saving_per_unit"), base), F.lit(" per unit"))),
        F.lit("—"),
    )
    return lines.where(F.col("status") != "no_comparable").select(
        F.col("rfx_sku").alias("line"), F.col("description").alias("item"), F.col("winner").alias("suggested_supplier"),
        money_text(F.col("price"), base).alias("price"),
        F.coalesce(F.format_number(F.when(F.col("quantity") != 0, F.col("quantity")), 0), F.lit("—")).alias("qty"),
        F.coalesce(money_text(F.col("extended"), base), F.lit("—")).alias("spend"),
        F.coalesce("runner_up", F.lit("— only one price")).alias("next_best"),
        saving.alias("saving"),
        F.when(F.col("status") == "awarded", F.lit("yes")).otherwise(F.lit("no")).alias("contested"),
    )


def award_gaps(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("status") == "no_comparable").select(F.col("rfx_sku").alias("line"), F.col("description").alias("item"), F.col("reason").alias("why"))


def award_stats(summary: DataFrame) -> DataFrame:
    """The four figures above an award, each with its caption."""
    saved = F.col("saving_vs_single").isNotNull() & F.col("best_single_vendor").isNotNull()
    first_name = F.coalesce(F.get(F.split("best_single_vendor", " "), F.lit(0)), F.lit("one supplier"))
    symbol = F.lit(V.CURRENCY_SYMBOLS[V.BASE_CURRENCY])
    value = (
        F.when(~saved, F.lit("n/a"))
        .when(F.col("saving_vs_single") <= 0, F.concat(symbol, F.lit("0.00")))
        .otherwise(F.concat(symbol, F.format_number("saving_vs_single", 0), F.lit(" · "), percent(F.col("saving_share"), 1)))
    )
    basket = F.col("common_basket").cast("string")
    caption = (
        F.when(~saved & (F.col("supplier_count") < 2), F.lit("one supplier — nothing to split"))
        .when(~saved, F.lit("no split saving to show yet"))
        .when(F.col("saving_vs_single") <= 0, F.concat(first_name, F.lit(" alone is no more expensive on those "), basket, F.lit(" items")))
        .otherwise(F.concat(F.lit("less than "), first_name, F.lit(" alone, on the "), basket, F.lit(" items all of them priced")))
    )
    return summary.select(
        F.col("supplier_count").alias("suppliers_recommended"),
        F.concat_ws("/", F.col("awarded_lines").cast("string"), F.col("items").cast("string")).alias("items_recommended"),
        F.coalesce(money_text(F.col("total_extended"), F.lit(V.BASE_CURRENCY)), F.lit("—")).alias("estimated_spend"),
        value.alias("saving"), caption.alias("saving_caption"),
    )


def audit_export(cells: DataFrame, items: DataFrame) -> DataFrame:
    """Every cell with its item's description and quantity: the original, the canonical, everything between."""
    facts = items.select(F.col("sku").alias("rfx_sku"), "description", F.col("quantity").alias("rfx_quantity"))
    joined = cells.join(facts, "rfx_sku", "left")
    rest = [c for c in cells.columns if c != "rfx_sku"]
    return joined.select("rfx_sku", "description", "rfx_quantity", *rest)


def terms_table(terms: DataFrame) -> DataFrame:
    return terms.select(
        F.col("vendor").alias("supplier"), F.initcap("kind").alias("about"), F.col("text").alias("in_their_words"), F.coalesce("trigger", F.lit("—")).alias("only_if")
    )


# --- warnings ---------------------------------------------------------------

def comparability_warnings(vendors: DataFrame, discounts: DataFrame | None = None) -> DataFrame:
    """Reasons the cheapest price shown may not be the cheapest real price.

    One row per (kind, vendor) with the detail the sentence names, so a warning
    about very many vendors is still an ordinary distributed table.
    """
    freight_in = vendors.agg(F.count_if(F.col("freight_included")).alias("n")).scalar()
    freight_extra = vendors.agg(F.count_if(~F.coalesce("freight_included", F.lit(False))).alias("n")).scalar()
    mixed = (freight_in > 0) & (freight_extra > 0)
    left_out = F.col("extra_lines") + F.col("second_prices")
    raised = F.array_compact(
        F.array(
            F.when(left_out > 0, F.struct(F.lit("unplaced").alias("kind"), F.concat(left_out.cast("string"), F.lit(" priced lines not placed")).alias("detail"))),
            F.when(
                mixed,
                F.struct(
                    F.lit("freight").alias("kind"),
                    F.when(F.col("freight_included"), F.lit("includes delivery")).when(~F.col("freight_included"), F.lit("charges delivery on top")).otherwise(F.lit("does not say who pays delivery")).alias("detail"),
                ),
            ),
            F.when(F.col("currency_assumed"), F.struct(F.lit("currency_assumed").alias("kind"), F.lit("never states a currency").alias("detail"))),
            F.when(
                F.col("coverage_quoted") < F.col("coverage_total"),
                F.struct(F.lit("partial").alias("kind"), F.concat(F.lit("priced "), F.col("coverage_quoted").cast("string"), F.lit(" of "), F.col("coverage_total").cast("string")).alias("detail")),
            ),
            F.when(
                F.size("unresolved_references") > 0,
                F.struct(F.lit("unsent_documents").alias("kind"), F.concat(F.lit("points to “"), F.array_join("unresolved_references", "”, “"), F.lit("”")).alias("detail")),
            ),
        )
    )
    rows = vendors.select("vendor", F.inline(raised))
    if discounts is not None:
        offer = F.when(F.coalesce("value", F.lit(0.0)) != 0, F.concat(F.lit("offers "), plain_number(F.col("value")), F.lit("%"))).otherwise(F.lit("offers a discount"))
        rows = rows.unionByName(discounts.where(F.col("kind") == "discount").select("vendor", F.lit("discount").alias("kind"), offer.alias("detail")))
    return rows


def warning_counts(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("kind").agg(F.count("*").alias("mentions"), F.count_distinct("vendor").alias("vendors"))
