"""Category codes and display texts carried in the reports."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from bidloom import vocabulary as V
from bidloom.functions.common import blank_to_null, lookup, percent
from bidloom.functions.confidence import confidence_band
from bidloom.functions.units import money_text


def comparable(status: Column, canonical_value: Column) -> Column:
    """The only rows a price comparison may use."""
    return canonical_value.isNotNull() & status.isin(*V.COMPARABLE_STATUSES)


def confidence_label(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("—")).otherwise(F.concat(percent(value), F.lit(" · "), confidence_band(value)))


def review_flag(flags: Column) -> Column:
    """The first flag, in the order raised, that has a short tag."""
    return F.try_element_at(F.filter(flags, lambda f: f.isin(*V.REVIEW_TAGS)), F.lit(1))


def review_tag(flags: Column, missing_datum: Column, reason: Column) -> Column:
    """The short why, for a cell that needs a human. By rule a reason is shown by its first 34 characters; it stays whole in its own column."""
    first_sentence = F.lower(F.trim(F.substring_index(F.coalesce(reason, F.lit("")), ".", 1)))
    return F.coalesce(
        lookup(review_flag(flags), V.REVIEW_TAGS),
        F.concat(F.lit("needs "), blank_to_null(missing_datum)),
        blank_to_null(F.substring(first_sentence, 1, 34)),
        F.lit("needs a look"),
    )


def flag_legend(flags: Column) -> Column:
    return F.transform(flags, lambda f: lookup(f, V.FLAG_LABELS, f))


def evidence_label(grade: Column) -> Column:
    return lookup(grade, V.EVIDENCE_LABELS, grade)


def answer_state(verdict: Column, meets: Column) -> Column:
    return (
        F.when(F.coalesce(verdict, F.lit("Unanswered")) == "Unanswered", F.lit("Unanswered"))
        .when(meets, F.lit("Yes"))
        .when(verdict == "Partial", F.lit("Partial"))
        .otherwise(F.lit("No"))
    )


def freight_label(freight_included: Column) -> Column:
    return F.when(freight_included, F.lit("Included")).when(~freight_included, F.lit("Extra")).otherwise(F.lit("Not stated"))


def format_name(extension: Column) -> Column:
    return lookup(extension, V.FORMAT_NAMES, F.when(extension == "", F.lit("Unknown format")).otherwise(F.upper(extension)))


def score_band(score: Column) -> Column:
    return F.when(score * 100 >= 80, F.lit("good")).when(score * 100 >= 55, F.lit("mid")).otherwise(F.lit("poor"))


def cell_label(cell: dict[str, Column], normalised: bool = True) -> Column:
    """What one square of the grid says."""
    if normalised:
        unpriced = F.when(
            cell["missing_datum"].isNotNull(), F.concat(F.lit("no price — needs "), cell["missing_datum"])
        ).otherwise(F.lower(cell["status"]))
        mark = (
            F.when(cell["status"] == V.NEEDS_REVIEW, F.concat(F.lit(" ▲ "), review_tag(cell["flags"], cell["missing_datum"], cell["reason"])))
            .when(cell["status"] == V.NORMALIZED, F.lit(" ◆"))
            .otherwise(F.lit(""))
        )
        priced = F.concat(money_text(cell["canonical_value"], cell["canonical_currency"]), mark)
        text = F.when(cell["canonical_value"].isNull(), unpriced).otherwise(priced)
    else:
        unit = F.coalesce(F.concat(F.lit(" "), blank_to_null(cell["original_unit"])), F.lit(""))
        quoted = F.concat(money_text(cell["original_value"], F.coalesce(cell["original_currency"], F.lit(V.BASE_CURRENCY))), unit)
        text = F.when(cell["original_value"].isNull(), F.lower(cell["status"])).otherwise(quoted)
    return F.when(cell["status"] == V.NOT_QUOTED, F.lit("not quoted")).otherwise(text)


def rating(scores: Column) -> Column:
    """Mean of the four directory scores that are present, to one decimal."""
    present = F.array_compact(F.array(*[F.try_element_at(scores, F.lit(k)) for k in V.SCORE_ORDER]))
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x)
    mean = total / F.size(present)
    return F.when(F.size(present) > 0, F.floor(mean * 10 + 0.5) / F.lit(10.0)).otherwise(F.lit(0.0))


def rating_reason(scores: Column, incumbent: Column, note: Column) -> Column:
    """One line for or against asking a supplier: strongest and weakest score."""

    def at(key: str, default: float) -> Column:
        return F.coalesce(F.try_element_at(scores, F.lit(key)), F.lit(default))

    def pick(default: float, better) -> tuple[Column, Column]:
        name, value = F.lit(V.SCORE_ORDER[0]), at(V.SCORE_ORDER[0], default)
        for key in V.SCORE_ORDER[1:]:
            wins = better(at(key, default), value)
            name, value = F.when(wins, F.lit(key)).otherwise(name), F.when(wins, at(key, default)).otherwise(value)
        return name, value

    best, high = pick(0.0, lambda a, b: a > b)
    worst, low = pick(10.0, lambda a, b: a < b)
    spread = F.concat(
        F.lit("strongest on "), best, F.lit(" ("), _trim(high), F.lit("), weakest on "), worst, F.lit(" ("), _trim(low), F.lit(")")
    )
    even = F.concat(F.lit("even across the board at "), F.format_string("%.1f", rating(scores)))
    shape = F.when(high - low < 1.0, even).otherwise(spread)
    prefix = F.when(incumbent, F.lit("Incumbent. ")).otherwise(F.lit(""))
    return F.when(F.coalesce(F.size(scores), F.lit(0)) <= 0, note).otherwise(F.concat(prefix, shape, F.lit(".")))


def _trim(value: Column) -> Column:
    return F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
