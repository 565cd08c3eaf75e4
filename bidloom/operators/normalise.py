"""Restating quoted prices on the request's unit and currency, or refusing to."""

from __future__ import annotations

from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom import vocabulary as V
from bidloom.functions import confidence, labels, units
from bidloom.functions.common import blank_to_null, compact, plain_number, round_half_up

CELL_COLUMNS = (
    "rfx_sku", "vendor", "original_text", "original_value", "original_unit", "original_currency",
    "canonical_value", "canonical_unit", "canonical_currency", "factor", "rules", "status", "reason",
    "missing_datum", "flags", "comparable", "match_basis", "match_confidence", "extraction_confidence",
    "confidence_notes", "unrecognised_conditions", "source_file", "source_locator", "source_snippet",
)


def fx_rates(spark: SparkSession, as_of: str | None = None, rates: dict[str, float] | None = None) -> DataFrame:
    """The dated, fixed rate table: one row per currency, units of base per unit.

    It is a relation of literal rows, so the planner knows its exact size.
    """
    stamp = as_of or date.today().isoformat()
    table = rates or V.FX_TO_BASE
    columns = {"fx_currency": pa.array(table, pa.string()), "fx_rate": pa.array([float(r) for r in table.values()], pa.float64())}
    return spark.createDataFrame(pa.table(columns | {"fx_as_of": pa.array([stamp] * len(table), pa.string())}))


def normalise_quotes(
    matched: DataFrame,
    rates: DataFrame,
    base_currency: str = V.BASE_CURRENCY,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One comparison cell per matched line.

    `matched` carries the line, its response header and the item it was placed
    on (`rfx_sku`, `canonical_unit`, `unit_family`). `rates` has one row per
    currency; a table of known size within the planner's broadcast bound (that of
    `fx_rates` is some hundred bytes) is joined without shuffling the lines, which
    have but a few currencies between them. Refusals keep whatever rules and flags
    had been established before the refusal.
    """
    stated = units.with_unit(matched, "unit_text").withColumn(
        "raised", units.condition_flags(F.col("conditions"), F.col("notes"))
    )
    currency = F.coalesce(
        units.currency_code("currency"), F.col("unit_currency"), units.currency_code("document_currency")
    )
    priced = stated.withColumn("stated_currency", currency).withColumn(
        "price_currency", F.coalesce("stated_currency", F.lit(base_currency))
    )
    priced = priced.join(rates, F.col("price_currency") == F.col("fx_currency"), "left")

    # Each step names what the next ones test, so no condition is spelled twice.
    value, family = F.col("quoted_value"), F.col("quoted_family")
    tested = priced.withColumns(
        {
            "no_price": value.isNull(),
            "unreadable": F.coalesce(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(False)),
            "family_silent": family.isNull(),
            "cross": F.coalesce(family != F.col("unit_family"), F.lit(False)),
            "packed": F.col("unit_pack") > 1,
            "currency_silent": F.col("stated_currency").isNull(),
            "foreign": F.col("price_currency") != base_currency,
        }
    ).withColumns(
        {
            "off_basis": F.col("cross") & family.isin("weight", "length") & ~F.col("no_price") & ~F.col("unreadable"),
            "no_rate": F.col("foreign") & F.col("fx_rate").isNull(),
        }
    ).withColumn("refused", F.col("no_price") | F.col("unreadable") | F.col("off_basis"))

    refused, packed, foreign = F.col("refused"), F.col("packed"), F.col("foreign")
    family_silent, cross, currency_silent = F.col("family_silent"), F.col("cross"), F.col("currency_silent")
    converted = value / F.when(packed, F.col("unit_pack")).otherwise(F.lit(1.0)) * F.when(foreign, F.col("fx_rate")).otherwise(F.lit(1.0))
    rules = F.when(F.col("no_price") | F.col("unreadable"), F.array().cast("array<string>")).when(
        F.col("off_basis"), F.array(F.concat(family, F.lit("_basis_unconvertible")))
    ).otherwise(
        compact(
            F.when(family_silent, F.lit("family_assumed_from_rfx"))
            .when(cross, F.lit("cross_basis_mismatch"))
            .otherwise(F.lit("unit_alias")),
            F.when(packed, F.lit("pack_multiple")),
            F.when(currency_silent, F.lit("currency_assumed_from_rfx")),
            F.when(F.col("no_rate"), F.lit("unknown_currency")).when(foreign, F.lit("fx_conversion")),
        )
    )
    flags = F.concat(
        F.col("raised"),
        compact(
            F.when(~F.col("freight_included"), F.lit("freight_excluded")),
            F.when(~refused & family_silent, F.lit("assumed_family")),
            F.when(~refused & cross, F.lit("cross_basis")),
            F.when(~refused & currency_silent, F.lit("currency_assumed")),
        ),
    )
    derived = tested.withColumns(
        {
            "canonical_value": F.when(~refused & ~F.col("no_rate"), round_half_up(converted, 4)),
            "rules": rules,
            "flags": flags,
        }
    )
    conditional = F.arrays_overlap("flags", F.array(*[F.lit(f) for f in V.DOWNGRADING_FLAGS]))
    status = (
        F.when(refused, F.lit(V.UNRESOLVED))
        .when(F.col("no_rate") | conditional, F.lit(V.NEEDS_REVIEW))
        .when(packed | foreign | family_silent | currency_silent, F.lit(V.NORMALIZED))
        .otherwise(F.lit(V.CONFIRMED))
    )
    division = F.concat(F.lit("÷ "), plain_number(F.col("unit_pack")), F.lit(" ("), F.col("unit_raw"), F.lit(" → "), F.col("canonical_unit"), F.lit(")"))
    exchange = F.concat(F.lit("× "), plain_number(F.col("fx_rate")), F.lit(f" {base_currency}/"), F.col("price_currency"), F.lit(" @ "), F.col("fx_as_of"))
    factor = F.concat_ws("  ", F.when(packed, division), F.when(foreign, exchange))
    score = confidence.reading_confidence(
        stated=F.col("confidence"),
        snippet=F.col("source_snippet"),
        unit_stated=blank_to_null(F.col("unit_text")).isNotNull(),
        currency_stated=blank_to_null(F.col("currency")).isNotNull() | blank_to_null(F.col("document_currency")).isNotNull(),
        source_file=F.col("source_file"),
        source_locator=F.col("source_locator"),
        match_basis=F.col("match_basis"),
        match_confidence=F.col("match_confidence"),
        rerendered=F.col("rerendered") if "rerendered" in matched.columns else None,
    )
    facts = derived.withColumns(
        {
            "original_text": F.coalesce(blank_to_null("source_snippet"), blank_to_null("notes")),
            "original_value": value,
            "original_unit": F.col("unit_text"),
            "original_currency": F.when(~F.col("no_price"), F.col("stated_currency")),
            "canonical_currency": F.lit(base_currency),
            "factor": F.when(F.col("canonical_value").isNotNull() & (packed | foreign), factor),
            "status": status,
            "score": score,
            "unrecognised_conditions": units.unrecognised_conditions(F.col("conditions")),
        }
    )
    texts = _reasons(base_currency)
    finished = facts.select(
        "*", texts["reason"].alias("reason"), texts["missing"].alias("missing_datum")
    ).withColumns(
        {
            "comparable": labels.comparable(F.col("status"), F.col("canonical_value")).cast("int"),
            "extraction_confidence": F.col("score.value"),
            "confidence_notes": F.col("score.notes"),
        }
    )
    return finished.select(*CELL_COLUMNS, *keep)


def _reasons(base_currency: str) -> dict[str, Column]:
    """The sentence behind each status, and the one datum that would resolve it.

    Fixed values: the sentences are compared output.
    """
    said = blank_to_null(F.array_join("conditions", "; "))
    raw = F.col("unit_raw")
    family = F.col("quoted_family")
    refused_weight = F.col("off_basis") & (family == "weight")
    refused_length = F.col("off_basis") & (family == "length")
    assumed = F.concat_ws(
        "; ",
        F.when(F.col("family_silent"), F.lit("unit not stated in source, assumed to be the rfx unit")),
        F.when(
            F.col("currency_silent"),
            F.lit(f"currency not stated anywhere in the document, assumed {base_currency.lower()} from the rfx"),
        ),
    )
    reason = (
        F.when(
            F.col("no_price"),
            F.coalesce(said, blank_to_null("notes"), F.lit("The vendor referenced this line but did not state a price.")),
        )
        .when(
            F.col("unreadable"),
            F.lit("The price came through as a number that is not a number, so nothing can be computed from it."),
        )
        .when(
            refused_weight,
            F.concat(
                F.lit("Quoted "), units.money_text(F.col("original_value"), F.col("original_currency")), F.lit(" "), raw,
                F.lit(", but the RFx asks for a price "), F.col("canonical_unit"),
                F.lit(". Converting weight to pieces needs the unit weight of this item, which appears in neither the RFx nor this response."),
            ),
        )
        .when(
            refused_length,
            F.concat(
                F.lit("Quoted per length, but the RFx asks "), F.col("canonical_unit"),
                F.lit(". Converting needs the length contained in one unit."),
            ),
        )
        .when(
            F.col("no_rate"),
            F.concat(F.lit("Quoted in "), F.col("price_currency"), F.lit(", for which no conversion rate is configured.")),
        )
        .when(
            F.col("cross"),
            F.concat(
                F.lit("Vendor quoted "), F.coalesce(blank_to_null(raw), F.lit("an unstated unit")), F.lit(" ("), family,
                F.lit(") but the RFx line is priced "), F.col("canonical_unit"), F.lit(" ("), F.col("unit_family"),
                F.lit("). The number is shown but excluded from price comparisons."),
            ),
        )
        .when(F.col("status") == V.NEEDS_REVIEW, F.coalesce(said, F.lit("Price carries an unresolved condition.")))
        .when(F.col("packed") | F.col("foreign"), F.concat(F.lit("Converted from “"), raw, F.lit("” to "), F.col("canonical_unit"), F.lit(".")))
        .when(F.col("status") == V.NORMALIZED, F.concat(F.upper(F.substring(assumed, 1, 1)), F.substr(assumed, F.lit(2)), F.lit(".")))
        .otherwise(F.lit("Quoted directly on the RFx basis."))
    )
    missing = (
        F.when(F.col("no_price"), F.concat(F.lit("a stated price for "), F.col("rfx_sku")))
        .when(F.col("unreadable"), F.concat(F.lit("a readable price for "), F.col("rfx_sku")))
        .when(
            refused_weight,
            F.concat(F.lit("unit weight in kg of one "), F.replace(F.col("canonical_unit"), F.lit("per "), F.lit("")), F.lit(" of "), F.col("rfx_sku")),
        )
        .when(refused_length, F.concat(F.lit("length per "), F.col("canonical_unit"), F.lit(" for "), F.col("rfx_sku")))
        .when(F.col("no_rate"), F.concat(F.col("price_currency"), F.lit(f"/{base_currency} rate")))
    )
    return {"reason": reason, "missing": missing}
