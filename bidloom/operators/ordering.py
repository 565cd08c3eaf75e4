"""Global numbering and greedy clustering without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from bidloom.session import checkpoint


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Rows numbered 1..n in the given order, spread over range partitions.

    Only one count per partition reaches the driver, to become the offsets.
    """
    ranged = checkpoint(df.repartitionByRange(*order).withColumn("_stretch", F.spark_partition_id()))
    sizes = sorted((r["_stretch"], r["count"]) for r in ranged.groupBy("_stretch").count().collect())
    offsets, start = [], 0
    for stretch, size in sizes:
        offsets.append((stretch, start))
        start += size
    starts = df.sparkSession.createDataFrame(offsets, "_stretch int, _start bigint")
    place = F.row_number().over(Window.partitionBy("_stretch").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_stretch").withColumn(name, place + F.col("_start")).drop("_stretch", "_start")


def unique_codes(df: DataFrame, code: str, order: str, *scope: str) -> DataFrame:
    """Repeated codes within a scope made distinct: `BX-001`, `BX-001-2`, ...

    Repeats of a code take its suffix numbers in order, leaving out those that
    somebody's own code really uses. A list is made only of such numbers, per
    code that is itself repeated.
    """
    keys = [*scope]
    turn = F.row_number().over(Window.partitionBy(*keys, code).orderBy(order))
    ranked = df.withColumn("_turn", turn)
    suffixed = df.select(*keys, F.regexp_extract(code, "^(.*)-([1-9][0-9]{0,8})$", 1).alias("_base"), F.regexp_extract(code, "^(.*)-([1-9][0-9]{0,8})$", 2).alias("_n"))
    suffixed = suffixed.where("_n <> '' AND _n <> '1'").select(*keys, "_base", F.col("_n").cast("int").alias("_n")).distinct()
    repeated = ranked.where("_turn = 2").select(*keys, F.col(code).alias("_base"))
    on = lambda left, right, a, b: [left[k].eqNullSafe(right[k]) for k in keys] + [left[a] == right[b]]
    used = suffixed.join(repeated, on(suffixed, repeated, "_base", "_base"), "left_semi").groupBy(*keys, "_base").agg(F.array_sort(F.collect_list("_n")).alias("_used"))
    placed = ranked.join(used, on(ranked, used, code, "_base"), "left").select(ranked["*"], F.coalesce("_used", F.array().cast("array<int>")).alias("_used"))
    # The i-th number in use lies below the wanted one when it is at most i above the turn.
    number = F.col("_turn") + F.size(F.filter("_used", lambda n, i: n - i <= F.col("_turn")))
    named = F.when(F.col("_turn") == 1, F.col(code)).otherwise(F.concat(F.col(code), F.lit("-"), number.cast("string")))
    return placed.withColumn("_named", named).drop(code, "_turn", "_used").withColumnRenamed("_named", code)


def earliest_cluster(nodes: DataFrame, edges: DataFrame, key: str, rank: str) -> DataFrame:
    """Greedy first-come clustering as a fixpoint.

    `edges(earlier, later)` always point from an earlier node to a later one.
    A node takes the earliest cluster any of its earlier matches belongs to, or
    opens its own. Every round is one join and one min, and each is written out
    so a lost executor costs a round rather than the whole chain.
    """
    own = nodes.select(F.col(key).alias("node"), F.struct(F.col(rank).alias("rank"), F.col(key).alias("root")).alias("own"))
    edges = checkpoint(edges)
    labels = checkpoint(own.withColumn("label", F.col("own")))
    while True:
        inherited = edges.join(labels.select(F.col("node").alias("earlier"), "label"), "earlier").groupBy(
            F.col("later").alias("node")
        ).agg(F.min("label").alias("taken"))
        fresh = checkpoint(
            labels.join(inherited, "node", "left").select(
                "node", "own", F.coalesce("taken", "own").alias("label"), (F.coalesce("taken", "own") != F.col("label")).alias("changed")
            )
        )
        labels = fresh.drop("changed")
        if fresh.where("changed").isEmpty():
            return labels.select(F.col("node").alias(key), F.col("label.root").alias("root"))
