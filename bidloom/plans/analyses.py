"""The five questions a buyer asks first, as parameterised jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom import vocabulary as V
from bidloom.functions.common import money_sum, round_half_up
from bidloom.operators import award, grid


def cheapest_among_cleared(cells: DataFrame, vendors: DataFrame, min_quality: float) -> DataFrame:
    """Cheapest comparable vendor per item among those whose quality clears the bar."""
    cleared = award.shortlist(vendors, min_quality).where("eligible")
    return grid.cheapest_by_line(cells, cleared)


def split_against_single(cells: DataFrame, items: DataFrame, vendors: DataFrame, min_quality: float = 0.0) -> DataFrame:
    """What a line-by-line split spends against giving the whole basket to one vendor."""
    plan = award.recommend(cells, items, vendors, 1, min_quality)
    return plan.summary.select(
        "total_extended", "common_basket", "split_on_common", "best_single_vendor", "best_single_total", "saving_vs_single", "saving_share"
    )


def price_disagreements(cells: DataFrame) -> DataFrame:
    """Spread of comparable prices per item, and whether unit handling is behind it.

    Spread is highest over lowest; a wide spread with converted prices among its
    ends points at units, one without points at the market.
    """
    ok = cells.where((F.col("comparable") == 1) & (F.col("canonical_value") > 0))
    converted = F.array_contains("rules", "pack_multiple") | F.array_contains("rules", "fx_conversion") | F.array_contains("rules", "family_assumed_from_rfx")
    end = F.struct(F.col("canonical_value").alias("price"), "vendor", converted.alias("converted"))
    return ok.groupBy("rfx_sku").agg(F.count("*").alias("offers"), F.min(end).alias("low"), F.max(end).alias("high")).where(F.col("offers") > 1).select(
        "rfx_sku", "offers", F.col("low.price").alias("low_price"), F.col("high.price").alias("high_price"),
        round_half_up(F.col("high.price") / F.col("low.price"), 4).alias("spread"),
        F.when(F.col("low.converted") | F.col("high.converted"), F.lit("check units")).otherwise(F.lit("price")).alias("cause"),
    )


def what_to_ask(cells: DataFrame) -> DataFrame:
    """Per vendor: what stops its prices comparing, and how many lines one question would free."""
    stuck = cells.where(F.col("status").isin(V.UNRESOLVED, V.NEEDS_REVIEW))
    ask = (
        F.when(F.array_contains("rules", "weight_basis_unconvertible"), F.lit("unit weight"))
        .when(F.array_contains("rules", "length_basis_unconvertible"), F.lit("length per unit"))
        .when(F.array_contains("rules", "unknown_currency"), F.lit("a convertible currency"))
        .when(F.col("status") == V.UNRESOLVED, F.lit("a stated price"))
        .when(F.array_contains("flags", "cross_basis"), F.lit("a price on the requested unit"))
        .otherwise(F.lit("confirmation of conditions"))
    )
    return stuck.groupBy("vendor", ask.alias("ask")).agg(F.count("*").alias("lines"))


def scenarios(cells: DataFrame, items: DataFrame, vendors: DataFrame, rules: list[tuple[str, float, bool]]) -> DataFrame:
    """Spend and items awarded under several shortlists (name, quality bar, enforce must-haves), from one pass over the cells.

    A vendor carries the names of the shortlists it is on, its offers are expanded by
    them, and each is awarded within its name. A shortlist that awards nothing has a row too.
    """
    passes = [F.when(award.shortlisted(bar, enforce), F.lit(name)) for name, bar, enforce in rules]
    listed = vendors.select("vendor", F.array_compact(F.array(*passes)).alias("on"))
    offered = grid.offers(cells).join(listed, "vendor").select("rfx_sku", "vendor", "price", F.explode("on").alias("scenario"))
    amounts = items.select(F.col("sku").alias("rfx_sku"), F.when(F.col("quantity") != 0, F.col("quantity")).alias("quantity"))
    won = grid.two_best(offered, "scenario").join(amounts, "rfx_sku").groupBy("scenario").agg(
        F.count("*").alias("awarded_lines"), money_sum(round_half_up(F.col("price") * F.col("quantity"), 2), 2).alias("total_extended")
    )
    named = vendors.sparkSession.createDataFrame([(name,) for name, _, _ in rules], "scenario string")
    return named.join(won, "scenario", "left").withColumn("awarded_lines", F.coalesce("awarded_lines", F.lit(0).cast("bigint")))


def effect_of_quality(cells: DataFrame, items: DataFrame, vendors: DataFrame, min_quality: float) -> DataFrame:
    """Spend and items awarded with the quality bar and without it."""
    return scenarios(cells, items, vendors, [("with quality bar", min_quality, True), ("ignoring quality", 0.0, False)])
