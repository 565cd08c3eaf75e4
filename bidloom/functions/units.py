"""Reading a supplier's unit wording and currency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom import vocabulary as V
from bidloom.functions.common import as_col, blank_to_null, let

_ALL_WORDS = tuple(w for words in V.UNIT_FAMILIES.values() for w in words)
# Java regexes spelled once: whole-word currency marks, longest spelling first.
_CURRENCY_MARK = r"(?<![a-z])(?:inr|usd|eur|gbp|rs\.|rs|₹|\$|€|£)(?![a-z])"


def family_of(word: Column) -> Column:
    """Unit family of one word, NULL when the word names no unit."""
    first, *rest = V.UNIT_FAMILIES.items()
    return reduce(
        lambda acc, fam: acc.when(word.isin(*fam[1]), F.lit(fam[0])),
        rest,
        F.when(word.isin(*first[1]), F.lit(first[0])),
    )


def currency_code(raw: Column | str) -> Column:
    """A currency as a code however it was written; an unknown spelling is kept upper-cased."""
    text = F.trim(as_col(raw))
    token = F.regexp_replace(F.lower(text), r"\.+$", "")
    first, *rest = [(s, c) for s, c in V.CURRENCY_SPELLINGS if not s.endswith(".")]
    known = reduce(lambda acc, sc: acc.when(token == sc[0], F.lit(sc[1])), rest, F.when(token == first[0], F.lit(first[1])))
    return F.when(text != "", F.coalesce(known, F.upper(text)))


def _currency_inside(lowered: Column) -> Column:
    chain, literals = None, []
    for spelling, code in V.CURRENCY_SPELLINGS:
        literals.append(spelling.replace(".", r"\.").replace("$", r"\$"))
        hit = lowered.rlike(f"(?<![a-z]){literals[-1]}(?![a-z])")
        chain = F.when(hit, F.lit(code)) if chain is None else chain.when(hit, F.lit(code))
    # Few unit texts name a currency, and one look at the others tells that.
    return F.when(lowered.rlike(f"(?<![a-z])(?:{'|'.join(literals)})(?![a-z])"), chain)


_PACK_FORM = r"(?:per|/|por)\s*(\d[\d,]*)\s*([a-z.]*)"
# The last unit word of a text: everything before it is taken greedily.
_LAST_WORD = r"(?s)^.*(?<![a-z.])\.*(" + "|".join(_ALL_WORDS) + r")\.*(?![a-z.])"


def _lowered(stated: Column) -> Column:
    return F.replace(F.lower(stated), F.lit("–"), F.lit("-"))


def _pack_parts(cleaned: Column) -> dict[str, Column]:
    return {
        "number": F.regexp_replace(F.regexp_extract(cleaned, _PACK_FORM, 1), ",", "").try_cast("double"),
        "follower": F.regexp_replace(F.regexp_extract(cleaned, _PACK_FORM, 2), r"^[. ]+|[. ]+$", ""),
        "word": F.nullif(F.regexp_extract(cleaned, _LAST_WORD, 1), F.lit("")),
    }


def _pack(number: Column, follower: Column) -> Column:
    """A number is a pack size only when something countable, or nothing, follows it."""
    singular = F.regexp_extract(follower, "^(.*)s$", 1)
    counts = (follower == "") | follower.isin(*V.COUNTING_NOUNS) | follower.isin(*_ALL_WORDS) | singular.isin(*_ALL_WORDS)
    return F.when((number > 1) & counts, number).otherwise(F.lit(1.0))


def _noun(word: Column) -> Column:
    shorter = F.regexp_extract(word, "^(.*)s$", 1)
    return F.when(shorter.isin(*_ALL_WORDS), shorter).otherwise(word)


def with_unit(df: DataFrame, source: str) -> DataFrame:
    """`df` with unit_raw, unit_currency, unit_pack, unit_noun and quoted_family read from a unit text.

    The reading is laid out in steps, each naming what the next one tests, so
    the whole of it stays in generated code and nothing is evaluated twice.
    NULL family means the source never said.
    """
    stated = df.withColumn("unit_raw", F.trim(F.coalesce(F.col(source), F.lit(""))))
    lowered = stated.withColumn("_low", _lowered(F.col("unit_raw")))
    cleaned = lowered.withColumns({"_clean": F.regexp_replace("_low", _CURRENCY_MARK, " "), "unit_currency": _currency_inside(F.col("_low"))})
    parts = cleaned.withColumns({f"_{k}": c for k, c in _pack_parts(F.col("_clean")).items()})
    return parts.withColumns(
        {
            "quoted_family": family_of(F.col("_word")),
            "unit_pack": _pack(F.col("_number"), F.col("_follower")),
            "unit_noun": _noun(F.col("_word")),
        }
    ).drop("_low", "_clean", "_number", "_follower", "_word")


def unit_spec(raw: Column | str) -> Column:
    """The same reading as one STRUCT(family, pack, noun, currency, raw) value, for small tables."""

    def read(stated: Column, lowered: Column) -> Column:
        parts = _pack_parts(F.regexp_replace(lowered, _CURRENCY_MARK, " "))
        return let(
            F.struct(*[c.alias(k) for k, c in parts.items()]),
            lambda p: F.struct(
                family_of(p["word"]).alias("family"),
                _pack(p["number"], p["follower"]).alias("pack"),
                _noun(p["word"]).alias("noun"),
                _currency_inside(lowered).alias("currency"),
                stated.alias("raw"),
            ),
        )

    return let(F.trim(F.coalesce(as_col(raw), F.lit(""))), lambda stated: let(_lowered(stated), lambda lowered: read(stated, lowered)))


def request_unit(raw: Column | str) -> Column:
    """STRUCT(label, family) for a buyer's own unit wording (`per 100 sheets`)."""
    text = as_col(raw)
    fallback = F.trim(F.lower(F.coalesce(blank_to_null(text), F.lit("unit"))))

    def labelled(spec: Column, noun: Column) -> Column:
        word = F.when((noun == "") | noun.isin(*V.COUNTING_WORDS), F.lit("unit")).otherwise(noun)
        bulk = F.concat(F.lit("per "), F.format_number(spec["pack"], 0), F.lit(" "), F.regexp_replace(word, "s$", ""), F.lit("s"))
        return F.struct(
            F.when(spec["pack"] > 1, bulk).otherwise(F.concat(F.lit("per "), word)).alias("label"),
            F.coalesce(spec["family"], F.lit("discrete")).alias("family"),
        )

    return let(
        unit_spec(text),
        lambda spec: let(F.trim(F.regexp_replace(F.coalesce(spec["noun"], fallback), r"^per\s+", "")), lambda noun: labelled(spec, noun)),
    )


def condition_flags(conditions: Column, notes: Column) -> Column:
    """Distinct flags, in pattern order, raised by a line's conditions and notes."""
    haystack = F.lower(F.concat_ws(" ; ", conditions, blank_to_null(notes)))
    raised = [F.when(haystack.rlike(p), F.lit(flag)) for p, flag in V.CONDITION_PATTERNS]
    # Most lines say nothing, and then there is nothing to read.
    silent = (F.coalesce(F.size(conditions), F.lit(0)) <= 0) & blank_to_null(notes).isNull()
    return F.when(silent, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(*raised))))


def unrecognised_conditions(conditions: Column) -> Column:
    """Conditions no pattern reads: shown beside the price, never silently dropped."""
    any_pattern = "|".join(f"(?:{p})" for p, _ in V.CONDITION_PATTERNS)
    return F.when(F.coalesce(F.size(conditions), F.lit(0)) <= 0, F.array().cast("array<string>")).otherwise(
        F.filter(conditions, lambda c: ~F.lower(c).rlike(any_pattern))
    )


def money_text(value: Column, currency: Column) -> Column:
    """`₹1,250.00`, or `1,250.00 JPY` where the currency has no symbol here."""
    symbol = None
    for code, mark in V.CURRENCY_SYMBOLS.items():
        hit = currency == code
        symbol = F.when(hit, F.lit(mark)) if symbol is None else symbol.when(hit, F.lit(mark))
    amount = F.format_number(value, 2)
    return F.when(symbol.isNotNull(), F.concat(symbol, amount)).otherwise(
        F.trim(F.concat(amount, F.lit(" "), F.coalesce(currency, F.lit(""))))
    )
