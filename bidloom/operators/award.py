"""Split-award recommendation: who gets which items, and what that leaves out."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions.common import money_sum, one_row, round_half_up
from bidloom.operators.grid import lowest, offers, two_best
from bidloom.operators.ordering import numbered
from bidloom.session import bounded_batches, broadcast_if_small, checkpoint

# The sentences are compared output.
NO_OFFER = "No shortlisted supplier gave a price we can safely compare, so we cannot suggest anyone for this item."
ONE_OFFER = "Only one shortlisted supplier priced this line comparably, so there is nothing to compare it with."


def shortlisted(min_quality: float = 0.0, enforce_requirements: bool = True) -> Column:
    """A vendor passes every must-have (if enforced) and reaches the bar."""
    passes = F.lit(True) if not enforce_requirements else F.coalesce("meets_requirements", F.lit(True))
    return passes & (F.coalesce("quality_score", F.lit(0.0)) >= min_quality)


def shortlist(vendors: DataFrame, min_quality: float = 0.0, enforce_requirements: bool = True) -> DataFrame:
    """`vendors` with `eligible`."""
    return vendors.withColumn("eligible", shortlisted(min_quality, enforce_requirements))


def allocate(priced: DataFrame, items: DataFrame) -> DataFrame:
    """One award per item from the given offers (rfx_sku, vendor, price)."""
    wanted = items.select(
        F.col("sku").alias("rfx_sku"), "description", "quantity", F.col("canonical_unit").alias("unit")
    )
    quantity = F.when(F.col("quantity") != 0, F.col("quantity"))
    saving = round_half_up(F.col("runner_up_price") - F.col("price"), 4)
    status = (
        F.when(F.col("winner").isNull(), F.lit("no_comparable"))
        .when(F.col("contenders") == 1, F.lit("single_source"))
        .otherwise(F.lit("awarded"))
    )
    return wanted.join(two_best(priced), "rfx_sku", "left").select(
        "rfx_sku", "description", "quantity", "unit", "winner", "price",
        round_half_up(F.col("price") * quantity, 2).alias("extended"),
        "runner_up", "runner_up_price",
        saving.alias("saving_per_unit"),
        round_half_up(saving * quantity, 2).alias("extended_saving"),
        F.coalesce("contenders", F.lit(0).cast("bigint")).alias("contenders"),
        status.alias("status"),
        F.when(F.col("winner").isNull(), F.lit(NO_OFFER)).when(F.col("contenders") == 1, F.lit(ONE_OFFER)).otherwise(F.lit("")).alias("reason"),
    )


def win_counts(awards: DataFrame) -> DataFrame:
    return awards.where(F.col("winner").isNotNull()).groupBy(F.col("winner").alias("vendor")).agg(F.count("*").alias("wins"))


@dataclass
class Consolidation:
    """Who was dropped for winning too few items: (vendor, place), how many, and whether an item's last offer stopped it."""

    dropped: DataFrame
    n: int = 0
    stopped: bool = False
    rounds: int = 0


#: Numbers of vendors that the one task holds in which drops are played, over all items: some 4 bytes each.
HELD_OFFERS = 16_000_000
#: Offers of an item it is given at most.
MOST_OFFERS = 16
_PLAYED = "no int, place bigint"


def dropped_for_size(priced: DataFrame, vendors: DataFrame, min_lines: int) -> Consolidation:
    """Vendors to drop because they would win too few items, in the order dropped.

    The rule drops the smallest winner below the bar (ties: earliest vendor), lets its
    items go to the next offer, and repeats, until none is below the bar or the smallest
    is the last to offer some item. A vendor that already wins enough can only ever win
    more, so all this concerns just the items first won by a vendor below the bar.

    Each drop rests on the one before, so they are played one by one in a single task, over
    numbers: the best few offers of each such item are all it holds. Where an item's few are
    used up and it has more, the round ends before that drop, and the next one begins with
    the best few of those still there. Only how a round ended reaches the driver.
    """
    spark = priced.sparkSession
    nobody = vendors.select("vendor", F.lit(0).cast("bigint").alias("place")).limit(0)
    if min_lines <= 1:
        return Consolidation(nobody)
    ordered = vendors.select("vendor", "vendor_ord")
    winner = F.min(F.struct("price", "vendor"))["vendor"].alias("winner")
    # Both are read several times below, and each reading would go through all offers again.
    first = checkpoint(priced.groupBy("rfx_sku").agg(winner))
    safe = checkpoint(win_counts(first).where(F.col("wins") >= min_lines).select("vendor"))
    contested_items = first.join(safe, first.winner == safe.vendor, "left_anti").select("rfx_sku")
    # Written out once: every round reads this remainder, not the whole comparison.
    active = checkpoint(priced.join(contested_items, "rfx_sku", "left_semi"))
    # Numbers are in the order of names; an offer without a name has number 0 and, as in any sorting, comes before all.
    names = checkpoint(numbered(active.select("vendor").where("vendor IS NOT NULL").distinct(), "no", "vendor").select("vendor", F.col("no").cast("int").alias("no")))
    small = numbered(ordered.join(safe, "vendor", "left_anti"), "turn", "vendor_ord", "vendor")
    small = checkpoint(small.join(names, "vendor").select("no", F.col("turn").cast("bigint").alias("turn")))
    offered = active.join(broadcast_if_small(names, names), "vendor", "left").select("rfx_sku", "price", F.coalesce("no", F.lit(0)).alias("no"))
    most = max(4, min(MOST_OFFERS, HELD_OFFERS // max(1, first.join(safe, first.winner == safe.vendor, "left_anti").count())))

    remaining, n, rounds, ended = ordered.count(), 0, 0, _PAUSED
    gone: list[DataFrame] = []
    bounded_batches(spark)
    while ended == _PAUSED and remaining > 1:
        left = reduce(lambda df, g: df.join(broadcast_if_small(g, g), "no", "left_anti"), gone, offered)
        best = left.groupBy("rfx_sku").agg(lowest(most, "price", "no")["no"].alias("offers"), (F.count("*") <= most).alias("whole"))
        held = best.select("offers", "whole", F.lit(None).cast("int").alias("no"), F.lit(None).cast("bigint").alias("turn"))
        listed = small.select(F.lit(None).cast("array<int>").alias("offers"), F.lit(None).cast("boolean").alias("whole"), "no", "turn")
        played = checkpoint(held.unionAll(listed).repartition(1).mapInArrow(partial(_play, min_lines=min_lines, remaining=remaining, before=n), _PLAYED))
        ended = played.where("no IS NULL").first()["place"]
        fresh = played.where("no IS NOT NULL")
        dropped_now = fresh.count()
        if dropped_now:
            rounds += 1
            gone.append(fresh)
            remaining, n = remaining - dropped_now, n + dropped_now
        else:
            most *= 2
    if not gone:
        return Consolidation(nobody, 0, ended == _STOPPED, rounds)
    dropped = checkpoint(reduce(DataFrame.unionAll, gone).join(names, "no").select("vendor", "place"))
    return Consolidation(dropped, n, ended == _STOPPED, rounds)


_DONE, _STOPPED, _PAUSED = 0, 1, 2


def _play(batches, min_lines: int, remaining: int, before: int):
    """Rows of items (their best offers in order, and whether these are all) and of vendors (number, turn)
    that may be dropped; yields the drops in order and one row that says how they ended.

    A vendor listed on several rows takes as many places, but one if it leaves items to a vendor without any.
    """
    parts, sizes, whole, turns, times = [], [], [], {}, {}
    for batch in batches:
        offers_, whole_, no, turn = batch.columns
        items = batch.filter(no.is_null())
        parts.append(items.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int32))
        sizes.append(items.column(0).value_lengths().to_numpy(zero_copy_only=False))
        whole.append(items.column(1).to_numpy(zero_copy_only=False).astype(bool))
        for v, t in zip(no.drop_null().to_pylist(), turn.drop_null().to_pylist(), strict=True):
            turns[v], times[v] = min(t, turns.get(v, t)), times.get(v, 0) + 1
    none = [np.zeros(0, np.int64)]
    offered, whole = np.concatenate(parts or none).astype(np.int32), np.concatenate(whole or none)
    ends = np.cumsum(np.concatenate(sizes or none).astype(np.int64))
    at = np.concatenate([none[0], [0], ends])[: len(ends)].astype(np.int64)
    wins = np.bincount(offered[at], minlength=max([1, *turns, *(int(x.max(initial=0)) for x in parts)]) + 1)
    small = np.zeros(len(wins), bool)
    small[[v for v in turns if wins[v] < min_lines]] = True
    lost = np.zeros(len(wins), bool)
    holds = {v: [] for v in np.flatnonzero(small).tolist()}
    for i in np.flatnonzero(small[offered[at]]):
        holds[int(offered[at[i]])].append(int(i))
    heap = [(int(wins[v]), turns[v], v) for v in holds if wins[v]]
    heapq.heapify(heap)
    drops, ended = [], _DONE
    while heap and remaining > 1:
        k, _, v = heapq.heappop(heap)
        if lost[v] or wins[v] != k or not small[v]:
            continue
        lost[v] = True
        moves, idle, last, short = [], False, False, False
        for i in holds[v]:
            p, end = int(at[i]) + 1, int(ends[i])
            while p < end and lost[offered[p]]:
                p += 1
            heir = p
            # An offer without a name holds an item, but no vendor is dropped for one.
            while heir < end and (offered[heir] == 0 or lost[offered[heir]]):
                heir += 1
            if heir == end:
                last, short = last or bool(whole[i]), True
                continue
            idle = idle or (small[offered[heir]] and wins[offered[heir]] == 0)
            moves.append((i, p))
        if last or short:
            ended = _STOPPED if last else _PAUSED
            break
        took = min(1 if idle else times[v], remaining - 1)
        drops += [v] * took
        remaining -= took
        gained = set()
        for i, p in moves:
            at[i], heir = p, int(offered[p])
            wins[heir] += 1
            if small[heir]:
                holds[heir].append(i)
                gained.add(heir)
        del holds[v]
        for heir in gained:
            if wins[heir] < min_lines:
                heapq.heappush(heap, (int(wins[heir]), turns[heir], heir))
            else:
                # It wins enough for good.
                small[heir] = False
                del holds[heir]
    for start in range(0, len(drops), 1 << 16):
        some = drops[start:start + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(range(before + start + 1, before + start + 1 + len(some)), pa.int64())], ["no", "place"])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int32()), pa.array([ended], pa.int64())], ["no", "place"])


@dataclass
class AwardPlan:
    """The recommendation as DataFrames, plus the vendors consolidation dropped."""

    lines: DataFrame
    vendors: DataFrame
    summary: DataFrame
    shortlist: DataFrame
    priced: DataFrame
    consolidation: Consolidation
    min_lines: int = 1


def recommend(
    cells: DataFrame, items: DataFrame, vendors: DataFrame, min_lines: int = 1, min_quality: float = 0.0, enforce_requirements: bool = True
) -> AwardPlan:
    """Build the split award over the shortlisted vendors."""
    listed = shortlist(vendors, min_quality, enforce_requirements)
    eligible = listed.where("eligible")
    # Ranking, baskets and consolidation all read the offers, so they are written out once.
    priced = checkpoint(offers(cells, eligible))
    # Who they are is all that is read of them here: their coverage is not worked out for it.
    eligible = checkpoint(eligible.select("vendor", "vendor_ord"))
    small = dropped_for_size(priced, eligible, min_lines)
    baseline = allocate(priced, items)
    if small.n:
        kept = priced.join(small.dropped, "vendor", "left_anti")
        before = baseline.select("rfx_sku", F.col("winner").alias("winner_before"), F.col("extended").alias("extended_before"))
        lost = small.dropped.select(F.col("vendor").alias("winner_before"), F.lit(True).alias("lost"))
        moved = F.col("lost") & (F.col("winner_before") != F.col("winner"))
        lines = allocate(kept, items).join(before, "rfx_sku").join(lost, "winner_before", "left").withColumn(
            "reassigned_from", F.when(moved, F.col("winner_before"))
        ).drop("winner_before", "lost")
    else:
        lines = baseline.withColumns({"reassigned_from": F.lit(None).cast("string"), "extended_before": F.col("extended")})
    by_vendor = award_by_vendor(lines)
    summary = plan_summary(lines, priced, eligible, bool(small.n))
    return AwardPlan(lines, by_vendor, summary, listed, priced, small, min_lines)


def award_by_vendor(lines: DataFrame) -> DataFrame:
    """Per vendor: items suggested, how many uncontested, spend, and share of all items suggested.

    The items themselves are the award table filtered on its winner.
    """
    won = lines.where(F.col("winner").isNotNull())
    total = won.agg(F.count("*").alias("n")).scalar()
    return won.groupBy(F.col("winner").alias("vendor")).agg(
        F.count("*").alias("line_count"),
        F.count_if(F.col("status") == "single_source").alias("single_source_lines"),
        money_sum(F.col("extended"), 2).alias("extended_total"),
    ).withColumn("share_of_lines", F.col("line_count") / total)


def common_basket(priced: DataFrame, eligible: DataFrame) -> DataFrame:
    """Items every shortlisted vendor priced comparably."""
    n = eligible.agg(F.count("*").alias("n")).scalar()
    return priced.groupBy("rfx_sku").agg(F.count("*").alias("quoting")).where(F.col("quoting") == n).select("rfx_sku")


def basket_totals(priced: DataFrame, basket: DataFrame, items: DataFrame) -> DataFrame:
    """What each vendor would charge for the whole common basket on its own."""
    wanted = items.select(F.col("sku").alias("rfx_sku"), _basket_quantity().alias("q"))
    return (
        priced.join(basket, "rfx_sku").join(wanted, "rfx_sku")
        .groupBy("vendor")
        .agg(round_half_up(money_sum(F.col("price") * F.col("q")), 2).alias("total"))
    )


def _basket_quantity() -> Column:
    return F.when(F.coalesce("quantity", F.lit(0)) == 0, F.lit(1)).otherwise(F.col("quantity"))


def split_vs_single(lines: DataFrame, priced: DataFrame, eligible: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One row: the split against the best single vendor, on the common basket only."""
    wanted = items if items is not None else lines.select(F.col("rfx_sku").alias("sku"), "quantity")
    basket = common_basket(priced, eligible)
    split = lines.join(basket, "rfx_sku", "left_semi").agg(
        F.count("*").alias("common_basket"),
        round_half_up(money_sum(F.col("price") * _basket_quantity()), 2).alias("split_on_common"),
        F.coalesce(F.bool_and(F.coalesce("quantity", F.lit(0)) != 0), F.lit(True)).alias("common_quantities_known"),
    )
    best = (
        basket_totals(priced, basket, wanted)
        .join(eligible.select("vendor", "vendor_ord"), "vendor")
        .agg(F.min(F.struct("total", "vendor_ord", "vendor")).alias("best"))
    )
    n = eligible.agg(F.count("*").alias("n")).scalar()
    held = split.withColumns({"single": one_row(best.select("best.vendor", "best.total")), "vendors": n})
    contest = (F.col("common_basket") > 0) & (F.col("vendors") > 1)
    return held.select(
        "common_basket",
        F.when(contest, F.col("split_on_common")).alias("split_on_common"),
        F.when(contest, F.col("single.vendor")).alias("best_single_vendor"),
        F.when(contest, F.col("single.total")).alias("best_single_total"),
        F.when(contest, round_half_up(F.col("single.total") - F.col("split_on_common"), 2)).alias("saving_vs_single"),
        "common_quantities_known",
    ).withColumn(
        "saving_share",
        F.when(F.col("best_single_total") != 0, F.col("saving_vs_single") / F.col("best_single_total")),
    )


def plan_summary(lines: DataFrame, priced: DataFrame, eligible: DataFrame, consolidated: bool) -> DataFrame:
    """The plan in one row."""
    won = F.col("winner").isNotNull()
    before, after = money_sum(F.col("extended_before"), 2), money_sum(F.col("extended"), 2)
    totals = lines.agg(
        F.count("*").alias("items"),
        F.count_if(won).alias("awarded_lines"),
        F.count_if(F.col("status") == "single_source").alias("single_source_lines"),
        F.count_if(F.col("status") == "no_comparable").alias("unawardable"),
        F.count_distinct("winner").alias("supplier_count"),
        after.alias("total_extended"),
        (F.count_if(F.col("extended").isNotNull()) == F.count_if(won)).alias("all_extended"),
        F.when(F.lit(consolidated) & (before != 0) & (after != 0), round_half_up(after - before, 2)).alias("consolidation_cost"),
    )
    versus = split_vs_single(lines, priced, eligible)
    return totals.withColumn("versus", one_row(versus)).select(
        *[c for c in totals.columns if c != "all_extended"],
        (F.col("all_extended") & F.col("total_extended").isNotNull()).alias("quantities_known"),
        "versus.*",
    ).withColumn("outside_basket", F.col("items") - F.col("common_basket"))


def headline(by_vendor: DataFrame) -> DataFrame:
    """Vendors by items suggested, each with its part of the sentence."""
    part = F.concat(
        F.lit("**"), F.col("vendor"), F.lit("** for "), F.col("line_count").cast("string"),
        F.when(F.col("line_count") == 1, F.lit(" item")).otherwise(F.lit(" items")),
    )
    return by_vendor.select("vendor", "line_count", part.alias("part")).orderBy(F.desc("line_count"), "vendor")


def caveats(plan: AwardPlan, vendors: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """What the recommendation leaves out: (position, kind, n), only the kinds that apply."""
    facts = plan.shortlist.agg(
        F.count_if(~F.col("eligible")).alias("excluded"),
        (F.count_distinct("freight_included") + F.max(F.when(F.col("freight_included").isNull(), 1).otherwise(0))).alias("freight_bases"),
    )
    discounts = F.lit(0).cast("bigint") if terms is None else terms.where(F.col("kind") == "discount").agg(F.count("*").alias("n")).scalar()
    facts = facts.withColumns({"s": one_row(plan.summary), "discounts": discounts})
    s = F.col("s")
    kinds = [
        ("excluded", F.col("excluded")),
        ("uncontested", s["single_source_lines"]),
        ("unawardable", s["unawardable"]),
        ("consolidated", F.lit(plan.consolidation.n).cast("bigint")),
        ("freight_mixed", F.when(F.col("freight_bases") > 1, F.col("freight_bases")).otherwise(0)),
        ("discounts_not_applied", F.col("discounts")),
        ("quantities_missing", F.when(~s["quantities_known"], s["awarded_lines"]).otherwise(0)),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(k).alias("kind"), n.cast("bigint").alias("n")) for i, (k, n) in enumerate(kinds, 1)])
    return facts.select(F.inline(rows)).where(F.col("n") > 0)
