"""Editing requests as set-oriented merges, drawing lists, and checking before sending."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom import vocabulary as V
from bidloom.functions import dates
from bidloom.functions.common import blank_to_null
from bidloom.functions.questions import question_reading, question_slug
from bidloom.functions.text import item_code
from bidloom.functions.units import request_unit
from bidloom.operators.criteria import question_pairs, question_profile
from bidloom.operators.ordering import unique_codes
from bidloom.session import checkpoint


def clean_code(raw: Column) -> Column:
    """A code the buyer will recognise: an item code where it is one, else tidied text."""
    tidy = F.upper(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"[^A-Za-z0-9\-]+", "-"), "^-+|-+$", ""))
    return F.coalesce(item_code(raw), F.when(tidy != "", tidy), F.lit("ITEM"))


def latest(value: str, order: str = "event_ord") -> Column:
    """Aggregate: the last value that says something."""
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order))).alias(value)


_LINE_EVENTS = ("add_line", "revise_line", "remove_line")
_FOLDED = ("sku", "added_at", "description", "quantity", "canonical_unit", "unit_family", "origin", "note")


def fold_line_events(events: DataFrame) -> DataFrame:
    """The lines a log of add / revise / remove events leaves behind.

    Events have request_id, event_ord, op, sku, description, quantity, unit,
    note, origin. An addition takes its code, or `code-2`, `code-3` and so on
    while those are present at that moment. A revision or removal names a line by
    the code it was given, in either case of letters; blank descriptions, zero
    quantities and blank units revise nothing; an origin never changes.

    Which codes are present depends on the order of events, so every family of
    codes (a code and its suffixed forms) of a request is played through in
    order. Rows stream through in that order and only the lines present are held.
    """
    e = events.where(F.col("op").isin(*_LINE_EVENTS)).withColumn("code", F.when(F.col("op") == "add_line", clean_code(F.col("sku"))).otherwise(F.upper(F.trim("sku"))))
    suggested = F.coalesce(F.lower("origin").startswith("sugg"), F.lit(False))
    read = e.withColumn("u", request_unit(F.coalesce("unit", F.lit("unit")))).select(
        "request_id", F.regexp_replace(F.upper("code"), "(-[0-9]+)+$", "").alias("family"), "event_ord", "op", "code",
        F.trim("description").alias("description"), F.col("quantity").cast("bigint").alias("quantity"), F.col("u.label").alias("canonical_unit"),
        F.col("u.family").alias("unit_family"), (F.coalesce(F.trim("unit"), F.lit("")) != "").alias("has_unit"), "note",
        F.when(suggested, F.lit("suggested")).otherwise(F.lit("buyer")).alias("origin"),
    )
    ordered = read.repartition("request_id", "family").sortWithinPartitions("request_id", "family", "event_ord")
    kind = events.schema["request_id"].dataType.simpleString()
    return ordered.mapInArrow(_fold, f"request_id {kind}, sku string, added_at bigint, description string, quantity bigint, canonical_unit string, unit_family string, origin string, note string")


def _fold(batches):
    """Play sorted events family by family; the lines still present at the end of each."""
    kind, at, present, out = None, None, {}, []

    def hand():
        columns = list(zip(*out)) if out else [()] * (1 + len(_FOLDED))
        types = [kind, pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["request_id", *_FOLDED])

    def close():
        out.extend((at[0], *(line[f] for f in _FOLDED)) for line in present.values())
        present.clear()

    for batch in batches:
        kind = batch.schema.field("request_id").type
        for event in batch.to_pylist():
            key = (event["request_id"], event["family"])
            if key != at:
                close()
                at = key
            _play(present, event)
        if out:
            yield hand()
    if at is not None:
        close()
    if out:
        yield hand()


def _play(present: dict, e: dict) -> None:
    """Apply one event to the lines present, kept by their codes in upper case."""
    code = e["code"]
    if e["op"] == "add_line":
        given, suffix = code, 2
        while given.upper() in present:
            given, suffix = f"{code}-{suffix}", suffix + 1
        line = {f: e[f] for f in ("description", "canonical_unit", "unit_family", "origin")}
        present[given.upper()] = line | {"sku": given, "added_at": e["event_ord"], "quantity": e["quantity"] or None, "note": e["note"] or ""}
    elif e["op"] == "remove_line":
        present.pop(code, None)
    elif code in present:
        line = present[code]
        line["description"] = e["description"] or line["description"]
        line["quantity"] = e["quantity"] or line["quantity"]
        if e["has_unit"]:
            line |= {f: e[f] for f in ("canonical_unit", "unit_family")}
        if e["note"] is not None:
            line["note"] = e["note"]


# A currency is its first three letters in upper case, as the request has always kept it.
def fold_scope_events(events: DataFrame, fields: tuple[str, ...] = ("title", "reference", "scope", "currency", "delivery_location", "starts_at", "ends_at")) -> DataFrame:
    scoped = events.where(F.col("op") == "set_scope")
    named = scoped.withColumns({f: blank_to_null(f) for f in fields})
    named = named.withColumn("currency", F.substring(F.upper(F.trim("currency")), 1, 3))
    return named.groupBy("request_id").agg(*[latest(f) for f in fields])


def fold_term_events(events: DataFrame) -> DataFrame:
    terms = events.where(F.col("op") == "set_term").select("request_id", "event_ord", F.lower(F.trim("kind")).alias("kind"), F.trim("text").alias("text"))
    return terms.groupBy("request_id", "kind").agg(F.max_by("text", "event_ord").alias("text"), F.min("event_ord").alias("first_ord"))


def same_questions(texts: DataFrame) -> DataFrame:
    """(stands, asked) for every two wordings of `texts` (question) that are one requirement, a wording and itself included."""
    read = checkpoint(question_profile(texts.groupBy("question").agg(F.min("question").alias("rank"))))
    pairs = question_pairs(read, directed=True).select(F.col("earlier").alias("stands"), F.col("later").alias("asked"))
    itself = read.where(F.size("tokens") > 0).select(F.col("question").alias("stands"), F.col("question").alias("asked"))
    return checkpoint(pairs.unionAll(itself))


def fold_question_events(events: DataFrame) -> DataFrame:
    """The questions a log of add_question / remove_question events leaves behind, in order.

    Events have request_id, event_ord, op, question, and for additions threshold, direction,
    unit, requirement and weight. An addition is refused while a question that is the same
    requirement stands; a removal takes away every question it is the same as.

    When a question would go does not depend on whether it was accepted: it lives from its
    event to the first later removal that means it. An addition is refused when an accepted
    one whose life covers it is the same, so acceptance is a fixpoint over those pairs, settled
    in rounds. Between two removals nothing goes, so only the first of equal wordings there
    is looked at, and sameness is judged once per pair of distinct wordings.

    All lives of a wording that are open at one moment end with the same removal, so the
    lives that cover an event are, per wording that is the same, those before it in one
    group (wording, end). An event meets as many groups as there are such wordings,
    however many lives these hold, and no life is ever paired with another.
    """
    asked = events.where(F.col("op").isin("add_question", "remove_question")).withColumn("question", F.trim("question"))
    asked = asked.where(F.col("question").isNotNull()).withColumn("removes", F.col("op") == "remove_question")
    same = same_questions(asked.select("question"))
    epoch = F.sum(F.col("removes").cast("int")).over(Window.partitionBy("request_id").orderBy("event_ord"))
    asked = checkpoint(asked.withColumn("epoch", epoch))
    adds = asked.where(~F.col("removes"))
    first = adds.groupBy("request_id", "question", "epoch").agg(F.min("event_ord").alias("event_ord"))

    # The first removal after each addition, for every wording that stands beside it as the same or is its own.
    heads = first.select("request_id", "question", "event_ord").distinct()
    met = heads.select("request_id", F.col("question").alias("asked"), "event_ord").join(same, "asked").select("request_id", F.col("stands").alias("wording"), "event_ord", F.lit("met").alias("role"))
    own = heads.select("request_id", F.col("question").alias("wording"), "event_ord", F.lit("own").alias("role"))
    removal = asked.where("removes").select("request_id", F.col("question").alias("asked"), "event_ord").join(same, "asked").select("request_id", F.col("stands").alias("wording"), "event_ord", F.lit(None).cast("string").alias("role"))
    # From the last event back, additions before removals of the same moment, which do not end them.
    later = Window.partitionBy("request_id", "wording").orderBy(F.desc("event_ord"), F.col("role").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = F.last(F.when(F.col("role").isNull(), F.col("event_ord")), ignorenulls=True).over(later)
    timed = checkpoint(met.unionAll(own).unionAll(removal).withColumn("gone", gone).where("role IS NOT NULL"))
    lives = checkpoint(timed.where("role = 'own'").select("request_id", "event_ord", F.col("wording").alias("question"), "gone"))
    covers = checkpoint(timed.where("role = 'met'").select("request_id", "event_ord", F.col("wording").alias("question"), "gone"))
    kept = _first_come(lives, covers)
    left = lives.where(F.col("gone").isNull()).join(kept, ["request_id", "event_ord"], "left_semi").select("request_id", "event_ord")
    read = adds.join(left, ["request_id", "event_ord"]).withColumn("r", question_reading("question"))
    must = F.lower(F.coalesce(F.trim("requirement"), F.lit(""))).startswith("must")
    return read.select(
        "request_id", "event_ord", "question", question_slug("question").alias("key"), "r.kind",
        F.coalesce(blank_to_null("direction"), "r.direction", F.lit("boolean")).alias("direction"), F.coalesce("threshold", "r.threshold").alias("threshold"),
        F.coalesce("unit", "r.unit").alias("unit"), F.when(must, F.lit("Must have")).otherwise(F.lit("Scored")).alias("requirement"),
        F.when(F.col("weight") != 0, F.col("weight")).otherwise(F.lit(1.0)).alias("weight"),
    )


def _first_come(lives: DataFrame, covers: DataFrame) -> DataFrame:
    """The events (request_id, event_ord) that stay when each is refused by any earlier one that stays in a group it meets.

    `lives(request_id, event_ord, question, gone)` says which group (question, gone) an event
    is in, `covers` of the same columns which it meets. A group matters by two events only:
    its first that stays and its first that is not settled.
    """
    group = ["request_id", "question", "_end"]
    ended = lambda df: df.withColumn("_end", F.coalesce(F.col("gone").cast("string"), F.lit("open"))).drop("gone")
    lives, covers = ended(lives), ended(covers)
    state = checkpoint(lives.select("request_id", "event_ord").distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        ahead = lives.join(state, ["request_id", "event_ord"]).groupBy(*group).agg(
            F.min(F.when(F.col("kept"), F.col("event_ord"))).alias("stays"), F.min(F.when(F.col("kept").isNull(), F.col("event_ord"))).alias("unsure")
        )
        before = covers.join(ahead, group).groupBy("request_id", "event_ord").agg(
            F.coalesce(F.bool_or(F.col("stays") < F.col("event_ord")), F.lit(False)).alias("clashes"),
            F.coalesce(F.bool_or(F.col("unsure") < F.col("event_ord")), F.lit(False)).alias("waits"),
        )
        verdict = F.when(F.col("clashes"), F.lit(False)).when(~F.coalesce("waits", F.lit(False)), F.lit(True))
        state = checkpoint(state.join(before, ["request_id", "event_ord"], "left").select("request_id", "event_ord", F.coalesce("kept", verdict).alias("kept")))
        if state.where(F.col("kept").isNull()).isEmpty():
            return state.where("kept").select("request_id", "event_ord")


def accepted_questions(asked: DataFrame) -> DataFrame:
    """Questions of each request, in order, without those already asked in other words.

    `asked` has request_id, event_ord and question: a log without removals.
    """
    none = {c: F.lit(None).cast(t) for c, t in (("threshold", "double"), ("direction", "string"), ("unit", "string"), ("requirement", "string"), ("weight", "double"))}
    return fold_question_events(asked.withColumn("op", F.lit("add_question")).withColumns(none)).drop("requirement", "weight")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows added, removed, changed or unchanged between two snapshots of a table."""
    b = before.select(*keys, F.struct(*columns).alias("was"))
    a = after.select(*keys, F.struct(*columns).alias("now"))
    change = (
        F.when(F.col("was").isNull(), F.lit("added"))
        .when(F.col("now").isNull(), F.lit("removed"))
        .when(F.col("was").eqNullSafe(F.col("now")), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    return b.join(a, keys, "full_outer").select(*keys, change.alias("change"), "was", "now")


def merge_line_edits(before: DataFrame, edited: DataFrame) -> DataFrame:
    """Edited item rows over the stored ones. A suggestion the buyer touched becomes the buyer's;
    a row absent from the edit is gone."""
    unit = request_unit(F.coalesce("unit", F.lit("unit")))
    e = edited.withColumn("u", unit).select(
        "request_id", "sku", F.trim("description").alias("description"), F.when(F.col("quantity") != 0, F.col("quantity")).alias("quantity"),
        F.col("u.label").alias("canonical_unit"), F.col("u.family").alias("unit_family"),
    )
    old = before.select(
        "request_id", "sku", F.struct("description", "quantity", "canonical_unit", "origin", "note").alias("was")
    )
    merged = e.join(old, ["request_id", "sku"], "left")
    description = F.coalesce(blank_to_null("description"), F.col("was.description"))
    touched = ~(
        description.eqNullSafe(F.col("was.description")) & F.col("canonical_unit").eqNullSafe(F.col("was.canonical_unit")) & F.col("quantity").eqNullSafe(F.col("was.quantity"))
    )
    origin = F.when(F.col("was").isNull() | ((F.col("was.origin") == "suggested") & touched), F.lit("buyer")).otherwise(F.col("was.origin"))
    return merged.where(blank_to_null("description").isNotNull() | F.col("was").isNotNull()).select(
        "request_id", "sku", description.alias("description"), "quantity", "canonical_unit", "unit_family", origin.alias("origin"), F.coalesce("was.note", F.lit("")).alias("note")
    )


#: What makes a stored question another question.
CRITERION = ("key", "question", "direction", "threshold", "unit", "requirement", "weight")


def merge_criteria_edits(before: DataFrame, edited: DataFrame) -> DataFrame:
    """Edited questions over the stored ones, tied by serial so a corrected typo keeps its variants.

    `before` has request_id, serial, question, key, kind and variants; `edited` has request_id,
    serial and what a row shows. A row without a known serial is the stored question of equal
    text, if there is one, else a new question. Rows without a question are none.
    """
    level = F.trim("requirement")
    e = edited.where(blank_to_null("question").isNotNull()).select(
        "request_id", "serial", F.trim("question").alias("question"), "direction", "threshold", blank_to_null("unit").alias("unit"),
        F.when(level.isin("Must have", "Scored", "Ignore"), level).otherwise(F.lit("Scored")).alias("requirement"), F.coalesce("weight", F.lit(1.0)).alias("weight"),
    )
    old = before.select("request_id", "serial", "question", F.struct("key", "kind", "variants").alias("was"))
    alike = old.groupBy("request_id", "question").agg(F.min_by("was", "serial").alias("alike"))
    known = e.join(old.drop("question"), ["request_id", "serial"], "left").join(alike, ["request_id", "question"], "left").withColumn("was", F.coalesce("was", "alike"))
    merged = known.select(
        "request_id", "serial", "question",
        F.coalesce("was.key", question_slug("question")).alias("key"), F.coalesce("was.kind", question_reading("question")["kind"]).alias("kind"),
        F.array_union(F.coalesce("was.variants", F.array().cast("array<string>")), F.array("question")).alias("variants"),
        "direction", "threshold", "unit", "requirement", "weight",
    )
    turn = F.row_number().over(Window.partitionBy("request_id", "key").orderBy("serial", "question"))
    return merged.withColumn("key", F.when(turn == 1, F.col("key")).otherwise(F.concat_ws("_", "key", turn.cast("string"))))


def merge_attachment_edits(before: DataFrame, edited: DataFrame) -> DataFrame:
    """Notes typed against files that are still listed; files no longer listed are dropped."""
    notes = edited.where(blank_to_null("name").isNotNull()).groupBy("request_id", F.trim("name").alias("name")).agg(F.max(F.trim("note")).alias("new_note"))
    return before.join(notes, ["request_id", "name"]).withColumn("note", F.coalesce("new_note", "note")).drop("new_note")


def changed_requests(before: DataFrame, after: DataFrame, order: str, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """(request_id, changed) for every request of either side: whether its rows, in order, differ in any of the columns.

    Rows are tied by their place and not by their keys, so a row that only moved counts too.
    What is compared is the request and not the table it was edited in: an edit that
    normalises to what was there changes nothing.
    """
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(order))
    sides = [df.select("request_id", place.alias("place"), F.struct(*columns).alias(name)) for df, name in ((before, "was"), (after, "now"))]
    return sides[0].join(sides[1], ["request_id", "place"], "full_outer").groupBy("request_id").agg(F.bool_or(~F.col("was").eqNullSafe(F.col("now"))).alias("changed"))


def accept_suggestions(lines: DataFrame) -> DataFrame:
    return lines.withColumn("origin", F.when(F.col("origin") == "suggested", F.lit("buyer")).otherwise(F.col("origin")))


def sendable_lines(lines: DataFrame) -> DataFrame:
    """Only lines a person stands behind go out."""
    return lines.where(F.col("origin") != "suggested")


def suggested_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("origin") == "suggested")


def add_document_lines(existing: DataFrame, extracted: DataFrame) -> DataFrame:
    """Lines read from the buyer's own document, coded uniquely beside those already there.

    A line without a code takes the first twelve characters of its description as one:
    a short handle by rule, made unique like any code; the description stays whole.
    """
    unit = request_unit(F.coalesce("unit", F.lit("unit")))
    fresh = extracted.where(blank_to_null("description").isNotNull()).withColumn("u", unit).select(
        "request_id", clean_code(F.coalesce(blank_to_null("sku"), F.substring(F.trim("description"), 1, 12))).alias("sku"),
        F.trim("description").alias("description"), F.when(F.col("quantity") != 0, F.col("quantity")).alias("quantity"),
        F.col("u.label").alias("canonical_unit"), F.col("u.family").alias("unit_family"), F.lit("document").alias("origin"),
        F.coalesce("note", F.lit("")).alias("note"), (F.col("line_no") + F.lit(1 << 40)).alias("line_no"),
    )
    return unique_codes(existing.unionByName(fresh, allowMissingColumns=True), "sku", "line_no", "request_id")


def header_from_document(header: DataFrame, read: DataFrame) -> DataFrame:
    """A request's header after its document was read: the document's currency stands in for an inferred one, its title for a missing one.

    `header` has request_id, title, currency and currency_inferred; `read` has request_id, title and currency.
    A currency is its first three letters in upper case.
    """
    said = read.select("request_id", blank_to_null("title").alias("said_title"), F.substring(F.upper(F.trim(blank_to_null("currency"))), 1, 3).alias("said_currency"))
    takes = F.col("said_currency").isNotNull() & F.col("currency_inferred")
    own = [c for c in header.columns if c not in ("title", "currency", "currency_inferred")]
    return header.join(said, "request_id", "left").select(
        *own, F.coalesce(blank_to_null("title"), F.trim("said_title")).alias("title"),
        F.when(takes, F.col("said_currency")).otherwise(F.col("currency")).alias("currency"), (F.col("currency_inferred") & ~takes).alias("currency_inferred"),
    )


def complete_header(header: DataFrame, template: DataFrame, fields: list[str]) -> DataFrame:
    """Keep what a request has; fill what it lacks from the buyer's standing template."""
    t = template.select("template_id", *[F.col(f).alias(f"t_{f}") for f in fields])
    filled = header.join(t, "template_id", "left")
    return filled.select(*[c for c in header.columns if c not in fields], *[F.coalesce(blank_to_null(f), F.col(f"t_{f}")).alias(f) for f in fields])


def complete_rows(existing: DataFrame, standing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the template a request does not have yet are added; its own are never replaced."""
    return existing.unionByName(standing.join(existing.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def terms_from_text(texts: DataFrame, key: str = "request_id") -> DataFrame:
    """A block of typed terms as rows (key, position, kind, text).

    `Label: text` opens a term, an unlabelled line becomes a numbered note, an
    indented line continues the term above, a repeated label gets a number.
    """
    lines = texts.select(key, F.posexplode(F.split("text", "\r\n|\n|\r")).alias("pos", "raw")).where(F.trim("raw") != "")
    by_pos = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("pos") == F.min("pos").over(Window.partitionBy(key))
    opens = first | ~F.col("raw").rlike("^[ \t]")
    body = F.trim("raw")
    label = F.trim(F.regexp_extract(body, "^([^:]*):", 1))
    rest = F.trim(F.regexp_extract(body, "^[^:]*:(.*)$", 1))
    labelled = (label != "") & (rest != "") & (F.length(label) <= 60)
    read = lines.select(key, "pos", opens.alias("opens"), body.alias("body"), F.when(labelled, F.lower(label)).alias("label"), F.when(labelled, rest).otherwise(body).alias("said"))
    grouped = read.withColumn("term", F.sum(F.col("opens").cast("int")).over(by_pos))
    terms = grouped.groupBy(key, "term").agg(
        F.min(F.when(F.col("opens"), F.struct("pos", "label", "said"))).alias("head"),
        F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct("pos", "body")))).alias("tail"),
    )
    text = F.array_join(F.concat(F.array("head.said"), F.col("tail.body")), "\n")
    ordered = Window.partitionBy(key).orderBy("term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    note_no = F.sum(F.col("head.label").isNull().cast("int")).over(ordered)
    named = terms.select(key, "term", text.alias("text"), F.coalesce("head.label", F.concat(F.lit("note "), note_no.cast("string"))).alias("kind"))
    turn = F.row_number().over(Window.partitionBy(key, "kind").orderBy("term"))
    return named.select(
        key, F.col("term").cast("bigint").alias("position"),
        F.when(turn == 1, F.col("kind")).otherwise(F.concat(F.col("kind"), F.lit(" ("), turn.cast("string"), F.lit(")"))).alias("kind"), "text",
    )


# --- drawing lists ---------------------------------------------------------

def drawn_count(scope: Column, seed: str, low: int, high: int) -> Column:
    """How many items a draw takes, between the bounds, the same for the same seed."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), scope.cast("string"), F.lit("size"))), 1, 6), 16, 10).cast("bigint")
    return low + digest % (high - low + 1)


def draw_lines(catalogue: DataFrame, scope: str, seed: str, wanted: Column, sku: str = "sku") -> DataFrame:
    """A seeded random draw per scope, the rest of the row untouched.

    The lot of an item depends only on the seed and its code, so any cluster
    draws the same list.
    """
    lot = F.md5(F.concat_ws("|", F.lit(seed), F.col(scope).cast("string"), F.col(sku)))
    place = F.row_number().over(Window.partitionBy(scope).orderBy("lot", sku))
    return catalogue.withColumn("lot", lot).withColumn("wanted", wanted).withColumn("place", place).where(F.col("place") <= F.col("wanted")).drop("lot", "wanted", "place")


def replenishment_draw(catalogue: DataFrame, scope: str, seed: str) -> DataFrame:
    """Ten to fifteen items of each catalogue, as suggestions."""
    wanted = drawn_count(F.col(scope), seed, *V.REPLENISHMENT_RANGE)
    return draw_lines(catalogue, scope, seed, wanted).withColumn("origin", F.lit("suggested"))


def annual_list(standing: DataFrame, optional: DataFrame, scope: str, seed: str) -> DataFrame:
    """All standing items plus enough drawn optional ones to reach this year's length."""
    low, high = V.FULL_REQUEST_RANGE
    sizes = standing.groupBy(scope).agg(F.count("*").alias("core"))
    span = F.greatest(F.lit(high), F.col("core")) - F.greatest(F.lit(low), F.col("core")) + 1
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(scope).cast("string"), F.lit("size"))), 1, 6), 16, 10).cast("bigint")
    extra = F.greatest(F.lit(low), F.col("core")) + digest % span - F.col("core")
    drawn = draw_lines(optional.join(sizes, scope), scope, seed, extra).drop("core")
    return standing.unionByName(drawn).withColumn("origin", F.lit("buyer"))


# --- checks before sending ---------------------------------------------------

def validation_issues(requests: DataFrame) -> DataFrame:
    """(request_id, position, issue) for everything mandatory still outstanding.

    `requests` has starts_at, ends_at, vendor_category and supplier_count.
    """
    missing = lambda c: blank_to_null(c).isNull()
    start = missing("starts_at") | dates.unreadable(F.col("starts_at"))
    end = missing("ends_at") | dates.unreadable(F.col("ends_at"))
    category = missing("vendor_category")
    backwards = ~(start | end | category) & (dates.window_days(F.col("starts_at"), F.col("ends_at")) < 0)
    rules = [
        (start, "RFQ start date and time"),
        (end, "RFQ end date and time"),
        (category, "Vendor category"),
        (backwards, "A closing time later than the opening time"),
        (F.col("supplier_count") < 1, "At least one supplier"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("position"), F.lit(t).alias("issue"))) for i, (c, t) in enumerate(rules, 1)]))
    return requests.select("request_id", F.inline(found))


def blank_questions(edited: DataFrame) -> DataFrame:
    """Rows with a target or unit but nothing to test, counted per request."""
    stray = blank_to_null("question").isNull() & ((F.coalesce("threshold", F.lit(0.0)) != 0) | blank_to_null("unit").isNotNull())
    return edited.groupBy("request_id").agg(F.count_if(stray).alias("blank_questions"))


def extra_invitees(typed: DataFrame, ticked: DataFrame) -> DataFrame:
    """Suppliers typed in beside the directory that are not ticked already, after the ticked ones."""
    return ticked.unionByName(typed.join(ticked.select("request_id", "vendor"), ["request_id", "vendor"], "left_anti"), allowMissingColumns=True)
