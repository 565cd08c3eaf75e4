"""Rating the approved vendors of a category and choosing whom to ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidloom import vocabulary as V
from bidloom.functions.labels import rating, rating_reason


def rated(directory: DataFrame) -> DataFrame:
    return directory.withColumns(
        {
            "rating": rating(F.col("scores")),
            "why": rating_reason(F.col("scores"), F.col("incumbent"), F.col("note")),
        }
    )


def recommended_vendors(directory: DataFrame, category: str = "category") -> DataFrame:
    """Vendors to ask, per category: everyone at the bar, topped up to two where fewer reach it.

    Those at the bar need no ranking at all; only the top-up ranks, and its
    rank filter keeps two rows per category and task.
    """
    all_rated = directory.withColumn("rating", rating(F.col("scores")))
    clearing = F.col("rating") >= V.RECOMMEND_AT
    counts = all_rated.groupBy(category).agg(F.count("*").alias("approved"), F.count_if(clearing).alias("clearing"))
    order = Window.partitionBy(category).orderBy(F.desc("rating"), F.desc("incumbent"), "vendor")
    first_two = (
        all_rated.withColumn("place", F.row_number().over(order)).where(F.col("place") <= V.MINIMUM_SHORTLIST).drop("place")
        .join(counts.where(F.col("clearing") < V.MINIMUM_SHORTLIST), category)
    )
    at_bar = all_rated.where(clearing).join(counts.where(F.col("clearing") >= V.MINIMUM_SHORTLIST), category)
    return at_bar.unionByName(first_two)
