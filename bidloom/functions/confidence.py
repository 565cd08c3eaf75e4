"""How clearly a number was read, from evidence that can be re-checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidloom import vocabulary as V
from bidloom.functions.common import compact, round_half_up
from bidloom.functions.text import file_extension


def reading_confidence(
    stated: Column,
    snippet: Column,
    unit_stated: Column,
    currency_stated: Column,
    source_file: Column,
    source_locator: Column,
    match_basis: Column,
    match_confidence: Column,
    rerendered: Column | None = None,
) -> Column:
    """STRUCT(value, notes): the stated figure times every factor that applies."""
    start = F.when((stated > 0.0) & (stated <= 1.0), stated).otherwise(F.lit(0.80))
    photo = F.coalesce(F.lower(source_locator).contains("photo"), F.lit(False)) | F.coalesce(
        file_extension(source_file).isin(*V.IMAGE_SUFFIXES), F.lit(False)
    )
    checks = [
        (F.coalesce(F.length(snippet), F.lit(0)) == 0, V.NO_SNIPPET),
        (photo, V.PHOTOGRAPH),
        (~unit_stated, V.UNIT_UNSTATED),
        (~currency_stated, V.CURRENCY_UNSTATED),
        (F.lit(False) if rerendered is None else F.coalesce(rerendered, F.lit(False)), V.RERENDERED),
    ]
    value, notes = start, []
    for applies, (factor, note) in checks:
        value = value * F.when(applies, F.lit(factor)).otherwise(F.lit(1.0))
        notes.append(F.when(applies, F.lit(note)))
    by_text = match_basis.isin("description", "override")
    by_size = match_basis == "dimensions"
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), match_confidence))
    value = value * F.when(by_text, F.lit(0.70) + F.lit(0.30) * bounded).when(by_size, F.lit(V.BY_DIMENSIONS[0])).otherwise(F.lit(1.0))
    notes.append(F.when(by_text, F.lit(V.BY_DESCRIPTION_NOTE)).when(by_size, F.lit(V.BY_DIMENSIONS[1])))
    clamped = F.greatest(F.lit(0.05), F.least(F.lit(0.99), value))
    return F.struct(round_half_up(clamped, 2).alias("value"), compact(*notes).alias("notes"))


def confidence_band(value: Column) -> Column:
    """Plain words for how clearly a figure was read."""
    return (
        F.when(value >= 0.95, F.lit("very clear"))
        .when(value >= 0.85, F.lit("clear"))
        .when(value >= 0.70, F.lit("readable"))
        .when(value.isNotNull(), F.lit("hard to read"))
    )
