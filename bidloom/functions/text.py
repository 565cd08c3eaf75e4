"""Item codes, dimensions, tokens, tolerant numbers and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidloom import vocabulary as V
from bidloom.functions.common import as_col, finite, let

# What a cell that is an item code looks like, what one inside a sentence does, and what a size does.
WHOLE_CODE = r"^([A-Z]{2,5})[\s_-]{0,2}(\d{1,6})$"
CODE_INSIDE = r"\b([A-Z]{2,5})[_-](\d{1,6})\b"
SIZE = r"(?i)(\d{2,5})\s*[x×*]\s*(\d{2,5})(?:\s*[x×*]\s*(\d{2,5}))?"


def _code(prefix: Column, digits: Column) -> Column:
    number = digits.cast("int")
    return F.concat(prefix, F.lit("-"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))


def item_code(raw: Column | str) -> Column:
    """Canonical item code (`bx 1` -> `BX-001`), or NULL when the text carries none.

    A whole cell may be a code; inside a sentence only a hyphen or underscore form counts.
    """
    text = F.upper(F.trim(as_col(raw)))
    whole_prefix = F.regexp_extract(text, WHOLE_CODE, 1)
    is_whole = text.rlike(WHOLE_CODE) & ~whole_prefix.isin(*V.CODE_STOP_PREFIXES)

    found = F.regexp_extract_all(text, F.lit(CODE_INSIDE), F.lit(0))
    usable = F.filter(found, lambda c: ~F.regexp_extract(c, "^[A-Z]+", 0).isin(*V.CODE_STOP_PREFIXES))
    embedded = let(
        F.get(usable, F.lit(0)), lambda c: _code(F.regexp_extract(c, "^[A-Z]+", 0), F.regexp_extract(c, "[0-9]+$", 0))
    )
    return F.when(is_whole, _code(whole_prefix, F.regexp_extract(text, WHOLE_CODE, 2))).otherwise(embedded)


def dimension_signature(raw: Column | str) -> Column:
    """Two or three figures joined by x, × or *, largest first; NULL when there are none."""
    text = as_col(raw)
    figures = F.array(*[F.regexp_extract(text, SIZE, g).try_cast("int") for g in (1, 2, 3)])
    return F.when(text.rlike(SIZE), F.reverse(F.array_sort(F.array_compact(figures))))


def _is_digits(token: Column) -> Column:
    return token.rlike("^[0-9]+$")


def description_tokens(raw: Column | str) -> Column:
    """Words and figures that tell one item from another, as a distinct array."""
    text = F.lower(F.coalesce(as_col(raw), F.lit("")))
    compounds = F.filter(
        F.regexp_extract_all(text, F.lit("[a-z0-9]+(?:-[a-z0-9]+)+"), F.lit(0)),
        lambda word: ~word.rlike("(^|-)[0-9]+(-|$)"),
    )

    def with_counts(pieces: Column) -> Column:
        beside = F.zip_with(pieces, F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1))), lambda a, b: F.concat_ws("-", a, b))
        counted = F.filter(
            beside, lambda p: p.rlike("^[0-9]+-[a-z]{2,}$") & ~F.substring_index(p, "-", -1).isin(*V.NOISE_WORDS)
        )
        return F.concat(pieces, counted)

    pieces = let(F.regexp_extract_all(text, F.lit("[a-z]+|[0-9]+"), F.lit(0)), with_counts)
    every = F.array_distinct(F.concat(pieces, compounds))
    return F.filter(every, lambda t: ~t.isin(*V.NOISE_WORDS) & ((F.length(t) > 1) | _is_digits(t)))


def figures(tokens: Column) -> Column:
    """The bare figures among a text's tokens."""
    return F.filter(tokens, _is_digits)


def tolerant_number(raw: Column | str) -> Column:
    """First number in a text, thousands separators dropped; NULL when none or not finite."""
    found = F.regexp_extract(as_col(raw).cast("string"), r"-?\d[\d,]*(?:\.\d+)?", 0)
    return finite(F.regexp_replace(found, ",", "").try_cast("double"))


def tolerant_integer(raw: Column | str) -> Column:
    number = tolerant_number(raw)
    return F.when(F.abs(number) < 1e15, number.cast("bigint"))


def title_case(raw: Column) -> Column:
    """Capitalise every run of letters, so `NORTH-PACK` reads `North-Pack`."""
    runs = F.regexp_extract_all(raw, F.lit(r"[\p{L}]+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), "")


def supplier_name(raw: Column | str, fallback: Column | str) -> Column:
    """A name fit for a column header: address -> company word, shouting -> title case."""
    def company(domain: Column) -> Column:
        labels = F.filter(
            F.split(domain, "\\."),
            lambda p: ~F.lower(p).isin("com", "co", "in", "net", "org", "example", "www"),
        )
        return title_case(F.replace(F.coalesce(F.get(labels, F.lit(0)), domain), F.lit("-"), F.lit(" ")))

    def readable(name: Column) -> Column:
        domain = F.regexp_extract(name, r"^[^@\s]+@([^@\s]+)$", 1)
        return F.when(domain != "", company(domain)).otherwise(name)

    def quiet(name: Column) -> Column:
        letters = F.regexp_replace(name, r"[^\p{L}]", "")
        return F.when((F.length(letters) > 4) & (letters == F.upper(letters)), title_case(name)).otherwise(name)

    name = F.trim(F.regexp_replace(F.trim(as_col(raw)), "^[\"']+|[\"']+$", ""))
    cleaned = let(let(name, readable), quiet)
    return F.coalesce(F.when(F.trim(as_col(raw)) != "", F.nullif(cleaned, F.lit(""))), as_col(fallback))


def file_extension(path: Column | str) -> Column:
    """Lower-cased suffix, empty when the name has none."""
    return F.lower(F.regexp_extract(as_col(path), r"\.([^.]*)$", 1))
