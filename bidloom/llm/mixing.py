"""Mixing sources to target weights by systematic sampling.

Each source gets a target in words and so a rate, its target over its size. Its
documents stand in a row by size; every document's expected number of copies is
the rate, their prefix sum runs along the row from one random offset, and a
document is emitted once for each integer boundary that its share crosses. Since
neighbours in the row are of like size, the words taken stay within about one
document of the target, whatever the offset.

A source is never gathered: rows are range-partitioned by (source, size, id,
text hash), and a row's place in its source is its place in its range plus the
sizes of the ranges before. Only one count per range and three sums per round of
sharing reach the driver.

Defined results: a null source is a source of its own, last in order; a null or
blank text has size 0 and adds nothing; a source of size 0 has target 0; repeated
rows are separate documents; null ids are allowed; an empty table gives an empty
result. The row travels in `doc`, so other columns' names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from bidloom.llm.tables import WORD, table
from bidloom.session import Scratch

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a percentage of all words, and of its own words the most a source may give.
SHARE_PERCENT = 150
MOST = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def placed(df: DataFrame, order: list[Column], name: str, scratch: Scratch) -> DataFrame:
    """Rows with their place 0, 1, ... in the order, worked out range by range."""
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = scratch.save(ranged, "ranged")
    offsets, start = [], 0
    for row in sorted(ranged.groupBy("_range").count().collect()):
        offsets.append((row[0], start))
        start += row[1]
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "_range int, _start bigint"))
    turn = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(starts, "_range").withColumn(name, turn + F.col("_start") - 1).drop("_range", "_start")


def source_targets(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """`(source, source_size, target)`: the share of each source by weight, none above MOST times its size."""
    numbered = placed(sizes, [F.col("source").asc_nulls_last()], "_place", scratch)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("_place") % len(WEIGHTS) + 1).cast("int"))
    sources = scratch.save(numbered.withColumn("weight", weight).drop("_place"), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    full, rate = F.lit(False), 0.0
    capped = -1
    while True:
        now = sources.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if now[2] == capped or not now[1]:
            break
        capped = now[2]
        rate = (SHARE_PERCENT * total - 100 * MOST * (now[0] or 0)) / (100.0 * now[1])
        full = F.lit(rate) * F.col("weight") > F.lit(float(MOST)) * F.col("source_size")
    target = F.when(full, F.lit(float(MOST)) * F.col("source_size")).otherwise(F.lit(rate) * F.col("weight"))
    return scratch.save(sources.select("source", "source_size", target.cast("double").alias("target")), "targets")


def offset(source: Column, seed: str) -> Column:
    """The source's one random offset, a whole number of 65,536ths plus a half."""
    named = F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return (F.conv(F.substring(F.md5(named.cast("binary")), 1, 4), 16, 10).cast("bigint") + 0.5) / 65536


def mixed(docs: DataFrame, size: Column, source: str = "source", id: str = "doc_id", tie: Column | None = None, seed: str = SEED) -> DataFrame:
    """Every row as `doc` with `size`, `source_size`, `target` and its number of `copies` in the mix."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(F.struct("*").alias("doc"), F.col(source).alias("source"), size.alias("size"), F.col(id).alias("id"), (F.lit(0) if tie is None else tie).alias("tie"))
    rows = scratch.save(placed(rows, [F.col("source").asc_nulls_last(), F.col("size"), F.col("id"), F.col("tie")], "place", scratch), "placed")
    sizes = scratch.save(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("place").alias("first")), "sizes")
    targets = source_targets(sizes, scratch)
    marked = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    marked = marked.withColumn("offset", offset(F.col("source"), seed)).join(sizes.select(F.col("source").alias("s"), "first"), F.col("source").eqNullSafe(F.col("s")))
    marked = scratch.save(marked.drop("s").withColumnRenamed("source", "of"), "marked")
    joined = rows.join(marked, F.col("source").eqNullSafe(F.col("of")))
    rank = F.col("place") - F.col("first")
    crossed = lambda r: F.floor(r * F.col("rate") + F.col("offset"))
    copies = (crossed(rank + 1) - crossed(rank)).cast("bigint")
    return joined.select("doc", "size", "source_size", "target", copies.alias("copies"))


def mix_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: rows as they came, once per copy."""
    out = mixed(docs, word_count(F.col(text)), tie=F.xxhash64(text), **options)
    return out.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")


def op3_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    out = mixed(docs, F.col("size"), tie=F.col("tie"))
    return out.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, list_extract([{', '.join(map(str, WEIGHTS))}], 1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS INT)) AS weight
    FROM d GROUP BY source),
r AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, row_number() OVER w AS k FROM s WINDOW w AS (ORDER BY source_size / weight, source)),
l AS (SELECT *, CAST({SHARE_PERCENT} * total - {100 * MOST} * filled AS DOUBLE) / (100.0 * free) AS rate FROM r),
cut AS (SELECT rate FROM l WHERE NOT rate * weight > {float(MOST)} * source_size ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN cut.rate * weight > {float(MOST)} * source_size THEN {float(MOST)} * source_size ELSE cut.rate * weight END AS target FROM l CROSS JOIN cut),
p AS (SELECT d.doc_id, d.size, CAST(t.source_size AS BIGINT) AS source_size, CAST(t.target AS DOUBLE) AS target,
    CASE WHEN t.source_size > 0 THEN CAST(t.target AS DOUBLE) / t.source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k,
    (CAST('0x' || substr(md5('{SEED}' || coalesce('=' || d.source, '')), 1, 4) AS BIGINT) + 0.5) / 65536 AS o
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor(k * rate + o) - floor((k - 1) * rate + o) AS BIGINT) * size AS taken FROM p"""

QUERIES = {"op3_mixing": op3_mixing}
ORACLES = {"op3_mixing": ORACLE}
