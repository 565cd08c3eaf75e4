"""Placing quoted lines on the requested items.

A ladder, cheapest and most certain rung first. Each rung only sees what the
earlier ones left, and the dearer rungs work on *distinct* texts rather than on
lines. Nothing compares every text with every item: candidates come from
equality on selective keys that every acceptable pair is certain to share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom import vocabulary as V
from bidloom.functions import similarity
from bidloom.functions.common import blank_to_null, percent
from bidloom.operators.grid import lowest
from bidloom.operators.ordering import numbered
from bidloom.session import Scratch, broadcast_if_small, checkpoint, hashed_if_large, never_broadcast
from bidloom.functions.text import description_tokens, dimension_signature, figures, item_code

#: Profiles up to which they are built whole in the driver's memory: some 50 MB.
WIDE_ROWS = 60_000
MATCH_COLUMNS = ("rfx_sku", "match_basis", "match_confidence", "match_reason")


def line_code() -> Column:
    """The item code a line carries: its code cell first, else inside its description."""
    return F.coalesce(item_code("vendor_sku"), item_code("description"))


def line_text() -> Column:
    """The wording the description rungs read."""
    return F.concat_ws(" ", blank_to_null(F.col("vendor_sku")), blank_to_null(F.col("description")))


def match_by_code(lines: DataFrame, items: DataFrame, how: str = "inner") -> DataFrame:
    """Rungs 1 and 2: equality on the item code, verbatim (1.0) or after reading it (0.97)."""
    known = items.select(F.col("sku").alias("rfx_sku"), *[c for c in items.columns if c not in (*lines.columns, "sku")])
    # A line without a code gets a key of its own kind that no item has, so such
    # lines spread evenly and the key needs no null test on every scan.
    keyless = F.concat(F.lit("?"), F.pmod(F.xxhash64("line_id"), F.lit(4096)).cast("string"))
    coded = lines.withColumn("code", F.coalesce(line_code(), keyless, F.lit("?")))
    # Read before the lines are dealt out by code: the code cell itself need not travel for it.
    coded = coded.withColumn("verbatim", F.coalesce(F.upper(F.trim("vendor_sku")) == F.col("code"), F.lit(False)))
    joined = coded.join(hashed_if_large(known, items), coded.code == known.rfx_sku, how)
    verbatim, found = F.col("verbatim"), F.col("rfx_sku").isNotNull()
    return joined.withColumns(
        {
            "match_basis": F.when(found & verbatim, F.lit("exact_sku")).when(found, F.lit("normalized_sku")),
            "match_confidence": F.when(found & verbatim, F.lit(1.0)).when(found, F.lit(0.97)),
            "match_reason": F.when(found & verbatim, F.lit("SKU quoted verbatim.")).when(
                found,
                F.concat(F.lit("SKU '"), F.coalesce("vendor_sku", "description"), F.lit("' normalised to "), F.col("code"), F.lit(".")),
            ),
        }
    ).drop("code", "verbatim")


def token_frequency(items: DataFrame, description: str = "description") -> DataFrame:
    """How many non-blank descriptions carry each token."""
    tokens = items.select(F.explode(description_tokens(description)).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("lines"))


def described_count(items: DataFrame, description: str = "description") -> DataFrame:
    return items.agg(F.count(blank_to_null(F.col(description))).alias("n"))


def marker_vocabulary(items: DataFrame, description: str = "description") -> DataFrame:
    """Words that tell this catalogue's items apart: on at most half its lines, never a bare figure."""
    n = described_count(items, description).scalar()
    limit = F.greatest(F.lit(1), F.floor(n * V.MARKER_SHARE))
    return token_frequency(items, description).where((n >= 2) & ~F.col("token").rlike("^[0-9]+$") & (F.col("lines") <= limit))


def profile(texts: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """Evidence per text: tokens, figures, size, and marker words rarest first.

    Only a text's own tokens are gathered again, so no group outgrows a description.
    """
    base = texts.select(
        "*", description_tokens(text).alias("tokens"), dimension_signature(text).alias("size_sig")
    )
    marks = (
        base.select(F.col(text).alias("mark_text"), F.explode("tokens").alias("token"))
        .join(vocabulary, "token")
        .groupBy("mark_text")
        .agg(F.array_sort(F.collect_list(F.struct("lines", "token"))).alias("ranked"))
        .select("mark_text", F.col("ranked.token").alias("markers"))
    )
    return base.join(never_broadcast(marks), base[text] == marks.mark_text, "left").select(
        *base.columns,
        F.array_sort(figures(F.col("tokens"))).alias("figs"),
        F.coalesce("markers", F.array().cast("array<string>")).alias("markers"),
    )


def catalogue_profile(items: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """One row per distinct description with how many items share it."""
    described = (
        items.groupBy(F.coalesce("description", F.lit("")).alias("description"))
        .agg(F.count("*").alias("copies"), F.min("sku").alias("sku"))
    )
    return profile(described, "description", vocabulary if vocabulary is not None else marker_vocabulary(items))


def match_by_size(texts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Rung 3: the same dimensions, when they single an item out.

    `texts` and `catalogue` are profiles. Both joins run against catalogue rows
    already reduced to one per key, so neither can fan out.
    """
    sized = catalogue.where(F.col("size_sig").isNotNull())
    hits = sized.groupBy("size_sig").agg(F.sum("copies").alias("hits"), F.min("description").alias("hit_text"))
    located = texts.where(F.col("size_sig").isNotNull()).join(never_broadcast(hits), "size_sig")

    single = sized.select(
        F.col("description").alias("hit_text"), F.col("sku").alias("rfx_sku"),
        F.col("figs").alias("c_figs"), F.col("markers").alias("c_markers"),
    )
    alone = (
        located.where(F.col("hits") == 1)
        .join(never_broadcast(single), "hit_text")
        .where(~similarity.contradicts(F.col("figs"), F.col("c_figs"), F.col("markers"), F.col("c_markers")))
        .select("text", "rfx_sku", F.lit(0.88).alias("match_confidence"),
                F.concat(F.lit("Dimensions "), _signature_text(), F.lit(" are unique to this line.")).alias("match_reason"))
    )
    by_marker = (
        sized.select("size_sig", "sku", "copies", F.explode("markers").alias("marker"))
        .groupBy("size_sig", "marker")
        .agg(F.min("sku").alias("low"), F.max("sku").alias("high"), F.max("copies").alias("copies"))
    )
    shared = (
        located.where(F.col("hits") > 1)
        .select("text", "size_sig", F.explode("markers").alias("marker"))
        .join(never_broadcast(by_marker), ["size_sig", "marker"])
        .groupBy("text", "size_sig")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("copies").alias("copies"),
             F.array_sort(F.collect_set("marker")).alias("words"))
        .where((F.col("low") == F.col("high")) & (F.col("copies") == 1))
        .select("text", F.col("low").alias("rfx_sku"), F.lit(0.85).alias("match_confidence"),
                F.concat(F.lit("Dimensions "), _signature_text(), F.lit(" plus "), F.array_join("words", ", "), F.lit(".")).alias("match_reason"))
    )
    return alone.unionByName(shared).withColumn("match_basis", F.lit("dimensions"))


def _signature_text() -> Column:
    return F.array_join(F.col("size_sig").cast("array<string>"), " x ")


# --- description rung -------------------------------------------------------

def _figure_key(figs: Column) -> Column:
    """The smaller figure set of an acceptable pair, cut to two figures; one that was cut says so."""
    return F.concat(F.array_join(F.slice(figs, 1, 2), "+"), F.when(F.size(figs) > 2, F.lit("+")).otherwise(F.lit("")))


def _figure_subsets(figs: Column, proper: bool) -> Column:
    """Keys of every figure set that lies within a text's (with `proper`, that is not the whole of it): those of
    at most two members, the empty one included, and the longer ones by the two they may be cut to."""
    ones = F.transform(figs, lambda a: F.array(a))
    twos = F.flatten(
        F.transform(figs, lambda a: F.transform(F.filter(figs, lambda b: b > a), lambda b: F.array(a, b)))
    )
    empty = F.array(F.array().cast("array<string>"))
    short = F.transform(F.concat(empty, ones, twos), lambda s: F.array_join(s, "+"))
    cut = F.when(F.size(figs) > (3 if proper else 2), F.transform(twos, lambda s: F.concat(F.array_join(s, "+"), F.lit("+")))).otherwise(F.array().cast("array<string>"))
    every = F.concat(short, cut)
    whole = F.array_join(figs, "+")
    return F.filter(every, lambda s: s != whole) if proper else every


def _rare_markers(markers: Column) -> Column:
    """Enough of the rarest markers that any pair reaching the agreement share has one in common."""
    n = F.size(markers)
    return F.slice(markers, 1, n - F.ceil(n * V.MARKER_AGREEMENT) + 1)


#: Bits of the marks by which a side learns which keys the other has: 2 MB, however many texts there are.
MARK_BITS = 1 << 24
#: Places of an item's number in the number that ranks a pair.
_ITEM_BITS = 40
_EVIDENCE = ("tokens", "figs", "markers", "size_sig")


def _bit(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(MARK_BITS))


def _marks(bits: DataFrame) -> Column:
    """The numbers of the column `bit` as marks in one list of 64-bit words."""
    words = bits.select((F.col("bit") / 64).cast("int").alias("i"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int")).alias("word"))
    every = bits.sparkSession.range(MARK_BITS // 64).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("bigint").alias("word"))
    whole = words.unionAll(every).groupBy("i").agg(F.bit_or("word").alias("word"))
    return whole.agg(F.array_sort(F.collect_list(F.struct("i", "word")))["word"].alias("marks")).scalar()


def _marked(marks: Column, bit: Column) -> Column:
    word = F.get(marks, (bit / 64).cast("int"))
    return F.call_function("shiftright", word, (bit % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1


def _meeting(texts: DataFrame, catalogue: DataFrame, *also: Column) -> DataFrame:
    """Rows of both sides that share a word and may not contradict each other, once each: columns of the texts as t_*, of the catalogue as c_*.

    They meet at a key of a word and a figure set. A pair may share several; it counts at the
    first shared word of the text only, and from the side whose figures lie within the other's.
    So whole rows travel once per key, and no pair needs to travel to be told from its repeats.
    Before they do, each side learns roughly which keys the other has; a key it surely lacks stays.
    """
    # Figures and marker words are tokens (and no marker is a figure), so the rest of these completes them.
    texts, catalogue = (
        df.withColumn("rest", F.array_except(F.array_except("tokens", "figs"), "markers")).drop("tokens") for df in (texts, catalogue)
    )
    unmarked, rare, words = F.size("markers") == 0, _rare_markers(F.col("markers")), F.concat("figs", "markers", "rest")
    some_plain_items = catalogue.agg(F.coalesce(F.bool_or(unmarked), F.lit(False)).alias("x")).scalar()
    some_plain_texts = texts.agg(F.coalesce(F.bool_or(unmarked), F.lit(False)).alias("x")).scalar()
    none = F.array().cast("array<struct<own:boolean,by_marker:boolean,place:int,figset:string,k:bigint>>")

    def keyed(df: DataFrame, text_side: bool, which: tuple[bool, ...]) -> DataFrame:
        """The rows at their keys: `which` says whether at those of their own figure set, of the sets within it, or both."""
        sets = F.concat(
            F.transform(F.array(_figure_key(F.col("figs"))) if True in which else F.array().cast("array<string>"), lambda f: F.struct(F.lit(True).alias("own"), f.alias("f"))),
            F.transform(_figure_subsets(F.col("figs"), text_side) if False in which else F.array().cast("array<string>"), lambda f: F.struct(F.lit(False).alias("own"), f.alias("f"))),
        )

        def keys(kind: str, of: Column) -> Column:
            def at(w, i):
                # The side whose own set a key names is the one within.
                key = lambda s: F.xxhash64(F.lit(kind), s["own"] == F.lit(text_side), w, s["f"])
                return F.transform("sets", lambda s: F.struct(s["own"].alias("own"), F.lit(kind == "m").alias("by_marker"), i.alias("place"), s["f"].alias("figset"), key(s).alias("k")))

            return F.flatten(F.transform(of, at))

        # Texts without a marker word meet every item under "t", the others those without one under "i".
        if text_side:
            found = F.when(unmarked, keys("t", words)).otherwise(F.concat(keys("m", rare), F.when(some_plain_items, keys("i", words)).otherwise(none)))
        else:
            found = F.concat(F.when(unmarked, keys("i", words)).otherwise(keys("m", rare)), F.when(some_plain_texts, keys("t", words)).otherwise(none))
        return df.withColumn("sets", sets).withColumn("e", F.explode(found)).drop("sets")

    def met(df: DataFrame, other: DataFrame, text_side: bool) -> DataFrame:
        theirs = keyed(other.select("figs", "markers", "rest"), not text_side, (True,)).select(_bit(F.col("e.k")).alias("bit"))
        reach = other.select(F.explode(_figure_subsets(F.col("figs"), not text_side)).alias("f")).select(_bit(F.col("f")).alias("bit"))
        there = F.when(F.col("e.own"), _marked(_marks(reach), _bit(F.col("e.figset")))).otherwise(_marked(_marks(theirs), _bit(F.col("e.k"))))
        side = "t" if text_side else "c"
        extra = [(F.col("e.own") == F.lit(True)).alias("t_within"), F.col("e.by_marker").alias("by_marker"), F.col("e.place").alias("place")] if text_side else []
        return keyed(df, text_side, (True, False)).where(there).select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns], F.col("e.k").alias(f"{side}_k"), *extra)

    t_figs, c_figs = F.col("t_figs"), F.col("c_figs")
    inside = F.when(F.col("t_within"), F.size(F.array_except(t_figs, c_figs)) == 0).otherwise(
        (F.size(t_figs) > F.size(c_figs)) & (F.size(F.array_except(c_figs, t_figs)) == 0)
    )
    both = [F.concat(f"{x}_figs", f"{x}_markers", f"{x}_rest") for x in "tc"]
    first = (F.col("place") == 0) | F.when(
        F.col("by_marker"), ~F.arrays_overlap(F.slice("t_markers", F.lit(1), F.col("place")), _rare_markers(F.col("c_markers")))
    ).otherwise(~F.arrays_overlap(F.slice(both[0], F.lit(1), F.col("place")), both[1]))
    left, right = met(texts, catalogue, True), met(catalogue, texts, False)
    pairs = left.join(never_broadcast(right), reduce(lambda x, y: x & y, also, (F.col("t_k") == F.col("c_k")) & inside & first))
    return pairs.withColumns({"t_tokens": both[0], "c_tokens": both[1]})


def candidate_pairs(texts: DataFrame, catalogue: DataFrame, text: str = "text", description: str = "description") -> DataFrame:
    """Pairs of the columns `text` and `description` that share a word and may not contradict each other.

    Non-contradiction needs one figure set inside the other, and, where both
    sides have marker words, at least one of their rarest markers in common.
    A key combines the two, so boilerplate words alone never bring texts together.
    Texts without any marker word are paired on all their words instead; those
    keys are produced only where such texts exist at all.
    """
    met = _meeting(texts.select(text, *_EVIDENCE), catalogue.select(description, *_EVIDENCE))
    return met.select(F.col(f"t_{text}").alias(text), F.col(f"c_{description}").alias(description))


def scored_pairs(texts: DataFrame, catalogue: DataFrame, mode: str = "exact", *also: Column) -> DataFrame:
    """Agreement of every candidate pair as (text_no, item_no, score); the character term is computed only where it can matter.

    Both sides bring their numbers, `text` or `description`, and a profile; `also` are
    conditions a pair has to meet, on the columns named t_* and c_*. No pair is shuffled.
    """
    pairs = _meeting(texts, catalogue, *also)
    # Whose figures lie within whose was asked where they met.
    viable = pairs.where(~similarity.marker_clash(F.col("t_markers"), F.col("c_markers")))
    evidence = viable.select(
        F.col("t_text_no").alias("text_no"), F.col("c_item_no").alias("item_no"), "t_text", "c_description",
        similarity.evidence_score(
            F.col("t_tokens"), F.col("c_tokens"), F.col("t_size_sig"), F.col("c_size_sig"), F.col("t_markers"), F.col("c_markers")
        ).alias("evidence"),
    )
    # A pair below the decisive floor less the decisive lead can neither win nor
    # stop a winner, whatever its characters say; it only counts as a rival.
    relevant = F.col("evidence") + 0.10 >= V.DECISIVE_FLOOR - V.DECISIVE_MARGIN
    likeness = similarity.text_similarity(F.when(relevant, F.col("t_text")), F.when(relevant, F.col("c_description")), mode)
    return evidence.withColumn("likeness", likeness).select(
        "text_no", "item_no", similarity.agreement(F.col("evidence"), F.when(relevant, F.col("likeness")).otherwise(F.lit(0.0))).alias("score")
    )


def _with_rivals_elsewhere(judged: DataFrame, catalogue: DataFrame) -> DataFrame:
    """How many items a text could still permissibly be read as without sharing a word with them.

    That depends only on which kinds of evidence the two sides have (figures,
    marker words), so four catalogue counts answer it for every text. The chosen
    item itself is taken off where it is among those counted.
    """
    bare, unmarked = F.size("figs") == 0, F.size("markers") == 0

    def total(where: Column | None = None) -> Column:
        return F.coalesce(F.sum(F.col("copies") if where is None else F.when(where, F.col("copies"))), F.lit(0))

    counts = catalogue.agg(
        F.struct(
            total().alias("any"), total(bare).alias("bare"), total(unmarked).alias("unmarked"), total(bare & unmarked).alias("neither")
        ).alias("counts")
    ).scalar()
    own, best = F.col("best.copies"), F.col("best")
    held, counts = counts, F.col("counts")
    t_bare, t_unmarked = F.col("t_bare"), F.col("t_unmarked")
    elsewhere = (
        F.when(t_bare & t_unmarked, counts["any"] - own)
        .when(t_bare, counts["unmarked"] - F.when(best["c_unmarked"], own).otherwise(0))
        .when(t_unmarked, counts["bare"] - F.when(best["c_bare"], own).otherwise(0))
        .otherwise(counts["neither"] - F.when(best["c_bare"] & best["c_unmarked"], own).otherwise(0))
    )
    return judged.withColumn("counts", held).withColumn("elsewhere", elsewhere)


def match_by_description(texts: DataFrame, catalogue: DataFrame, mode: str = "exact") -> DataFrame:
    """Rung 4: the best-agreeing item, if it is good enough and clear of the next best.

    Only the two best candidates of a text survive the shuffle, as two numbers, so a
    text with many look-alikes stays cheap.
    """
    scratch = Scratch(texts.sparkSession, "pairs")
    texts = scratch.save(texts.select("text", *_EVIDENCE).withColumn("text_no", F.monotonically_increasing_id()), "texts")
    # Numbers in the order of the wordings, which decides between equal scores.
    catalogue = scratch.save(numbered(catalogue.select("description", "sku", "copies", *_EVIDENCE), "item_no", "description"), "catalogue")
    kinds = texts.select("text_no", "text", (F.size("figs") == 0).alias("t_bare"), (F.size("markers") == 0).alias("t_unmarked"))
    facts = catalogue.select("item_no", "sku", "copies", (F.size("figs") == 0).alias("c_bare"), (F.size("markers") == 0).alias("c_unmarked"))
    # Scores have three places.
    behind = F.lit(1000) - F.round(F.col("score") * 1000).cast("bigint")
    ranked = scored_pairs(texts, catalogue.drop("sku", "copies"), mode).select(
        "text_no", (F.shiftleft(behind, _ITEM_BITS) + F.col("item_no")).alias("rank")
    )
    score = lambda i: (F.lit(1000) - F.shiftright(F.get("top", F.lit(i))["rank"], _ITEM_BITS)) / F.lit(1000.0)
    best_two = ranked.groupBy("text_no").agg(lowest(2, "rank").alias("top")).select(
        "text_no", score(0).alias("score"), score(1).alias("second"), F.get("top", F.lit(0))["rank"].bitwiseAND(F.lit((1 << _ITEM_BITS) - 1)).alias("item_no")
    )
    with_item = best_two.join(broadcast_if_small(facts, catalogue, WIDE_ROWS), "item_no").select(
        "text_no", "second", F.struct("score", "sku", "copies", "c_bare", "c_unmarked").alias("best")
    )
    judged = _with_rivals_elsewhere(with_item.join(never_broadcast(kinds), "text_no"), catalogue).select(
        "text",
        F.col("best.sku").alias("rfx_sku"),
        F.col("best.score").alias("score"),
        F.when(F.col("best.copies") > 1, F.col("best.score")).otherwise(F.col("second")).alias("second"),
        "elsewhere",
    )
    lead = F.col("score") - F.coalesce("second", F.lit(0.0))
    floor = F.col("score") >= V.DESCRIPTION_FLOOR
    rivalled = F.col("second").isNotNull() | (F.col("elsewhere") > 0)
    clears = F.when(
        rivalled,
        (floor & (lead >= V.DESCRIPTION_MARGIN)) | ((F.col("score") >= V.DECISIVE_FLOOR) & (lead >= V.DECISIVE_MARGIN)),
    ).otherwise(floor)
    reason = F.concat(
        F.lit("Descriptions agree "), percent(F.col("score")), F.lit(", next best "), percent(F.coalesce("second", F.lit(0.0))), F.lit(".")
    )
    return judged.where(clears).select(
        "text", "rfx_sku", F.lit("description").alias("match_basis"), F.col("score").alias("match_confidence"), reason.alias("match_reason")
    )


def match_texts(texts: DataFrame, items: DataFrame, mode: str = "exact") -> DataFrame:
    """Rungs 3 and 4 over distinct texts. `texts` has one column, `text`."""
    vocabulary = marker_vocabulary(items)
    # Both profiles feed every later branch, so they are written out once.
    catalogue = checkpoint(catalogue_profile(items, vocabulary))
    read = checkpoint(profile(texts, "text", vocabulary))
    by_size = match_by_size(read, catalogue)
    left_over = read.join(never_broadcast(by_size.select("text")), "text", "left_anti")
    return by_size.unionByName(match_by_description(left_over, catalogue, mode), allowMissingColumns=True)


def match_lines(lines: DataFrame, items: DataFrame, overrides: DataFrame | None = None, mode: str = "exact") -> DataFrame:
    """Every line with where it was placed, on what basis, how surely and why.

    `overrides(line_id, override_sku)` holds decisions taken by hand; one is used
    only for a line nothing else placed, and only if its item is on the list.
    """
    attributes = items.select(F.col("sku").alias("rfx_sku"), *[c for c in items.columns if c != "sku" and c not in lines.columns])
    coded = match_by_code(lines, items.select("sku"), "left")
    settled = coded.where(F.col("rfx_sku").isNotNull())
    unsettled = coded.where(F.col("rfx_sku").isNull()).drop(*MATCH_COLUMNS).withColumn("text", line_text())
    placed_texts = match_texts(unsettled.where(F.col("text") != "").select("text").distinct(), items, mode)
    worded = unsettled.join(never_broadcast(placed_texts), "text", "left").drop("text")
    if overrides is not None:
        accepted = overrides.join(items.select(F.col("sku").alias("override_sku")), "override_sku", "left_semi")
        by_hand = F.col("rfx_sku").isNull() & F.col("override_sku").isNotNull()
        worded = worded.join(accepted, "line_id", "left").select(
            *lines.columns,
            F.coalesce("rfx_sku", "override_sku").alias("rfx_sku"),
            F.when(by_hand, F.lit("override")).otherwise(F.col("match_basis")).alias("match_basis"),
            F.when(by_hand, F.lit(0.6)).otherwise(F.col("match_confidence")).alias("match_confidence"),
            F.when(by_hand, F.lit("Decided by hand.")).otherwise(F.col("match_reason")).alias("match_reason"),
        )
    every = settled.select(*lines.columns, *MATCH_COLUMNS).unionByName(worded.select(*lines.columns, *MATCH_COLUMNS))
    unmatched = F.col("rfx_sku").isNull()
    return every.join(broadcast_if_small(attributes, items), "rfx_sku", "left").withColumns(
        {
            "match_basis": F.when(unmatched, F.lit("unmatched")).otherwise(F.col("match_basis")),
            "match_confidence": F.coalesce("match_confidence", F.lit(0.0)),
            "match_reason": F.when(
                unmatched, F.lit("No SKU, dimensions or description close enough to an RFx line.")
            ).otherwise(F.col("match_reason")),
        }
    )


# --- one line per vendor and item -----------------------------------------

def place_lines(matched: DataFrame) -> DataFrame:
    """Keep, per (vendor, item), the surest line and the earliest on a tie.

    The rank filter runs before the shuffle as well as after it: each task sends
    one row per vendor and item, however often that item was quoted again.
    """
    # Codes differ in their first letters sooner than names do, which makes the sort cheap.
    order = Window.partitionBy("rfx_sku", "vendor").orderBy(F.desc("match_confidence"), "line_ord", "line_id")
    hit = matched.where(F.col("rfx_sku").isNotNull())
    return hit.withColumn("place", F.row_number().over(order)).where(F.col("place") == 1).drop("place")


def repeated_lines(matched: DataFrame, placed: DataFrame) -> DataFrame:
    """Lines beaten to their item by a surer line of the same vendor. Joined on the
    unique line id, which no hot vendor or item can skew."""
    return matched.where(F.col("rfx_sku").isNotNull()).join(placed.select("line_id"), "line_id", "left_anti")


def extra_lines(matched: DataFrame) -> DataFrame:
    """Lines that answer nothing on the item list."""
    return matched.where(F.col("rfx_sku").isNull())


def unplaced_lines(matched: DataFrame, placed: DataFrame) -> DataFrame:
    """Both kinds of line left out of the grid, with the reason."""

    def shape(rows: DataFrame, why: Column) -> DataFrame:
        return rows.select(
            "vendor", "line_id",
            F.coalesce(blank_to_null("vendor_sku"), F.lit("—")).alias("code"),
            F.coalesce(blank_to_null("description"), F.lit("—")).alias("description"),
            F.col("quoted_value").alias("value"), "currency",
            F.coalesce("unit_text", F.lit("")).alias("unit"),
            why.alias("why"),
        )

    return shape(extra_lines(matched), F.lit("not on your list")).unionByName(
        shape(repeated_lines(matched, placed), F.concat(F.lit("a second price for "), F.col("rfx_sku")))
    )
