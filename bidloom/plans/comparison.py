"""From quoted lines to a comparison: match, place, normalise, summarise."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.operators import criteria as C
from bidloom.operators import grid, matching
from bidloom.operators.attribution import credited
from bidloom.operators.derive import basket_per_month, derive_items, group_lines
from bidloom.operators.ordering import numbered
from bidloom.operators.normalise import fx_rates, normalise_quotes
from bidloom.operators.reports import comparability_warnings
from bidloom.session import Scratch
from bidloom.sources.replies import Replies, demote_blanket
from bidloom.sources.sinks import empty_award


@dataclass
class Comparison:
    """The comparison as DataFrames. Each part is planned when first asked for, and run when used."""

    items: DataFrame
    responses: DataFrame
    matched: DataFrame
    rates: DataFrame
    base_currency: str = "INR"
    answers: DataFrame | None = None
    criteria: DataFrame | None = None
    terms: DataFrame | None = None
    quoted: DataFrame | None = None

    @cached_property
    def placed(self) -> DataFrame:
        return matching.place_lines(self.matched)

    @cached_property
    def cells(self) -> DataFrame:
        return normalise_quotes(self.placed, self.rates, self.base_currency)

    @cached_property
    def unplaced(self) -> DataFrame:
        return matching.unplaced_lines(self.matched, self.placed)

    @cached_property
    def gaps(self) -> DataFrame:
        return grid.coverage_gaps(self.placed if self.quoted is None else self.quoted, self.responses, self.items)

    @cached_property
    def scored(self) -> DataFrame | None:
        return None if self.criteria is None else C.score_answers(self.answers, self.criteria)

    @cached_property
    def vendors(self) -> DataFrame:
        cards = None if self.scored is None else C.scorecards(self.scored, self.criteria, self.responses)
        return grid.vendor_summary(self.responses, self.matched, self.cells, self.items, cards)

    def settled(self, *columns: str) -> Comparison:
        """The same comparison for whoever reads its cells more than once: the cells (all columns or those
        named) are written out, so lines are matched and placed once. Whole cells are for whoever stores the
        comparison and reads the vendors more than once too; these are then written out beside them."""
        scratch = Scratch(self.items.sparkSession, "comparison")
        cells = normalise_quotes(self.placed, self.rates, self.base_currency, keep=("line_no",))
        known = scratch.save(cells.select(*columns, "line_no") if columns else cells, "cells")
        out = replace(self, quoted=known)
        out.cells = known.drop("line_no")
        if not columns:
            # Taking the summary caches it; its written form then stands in its place.
            out.__dict__["vendors"] = scratch.save(out.vendors, "vendors")
        return out

    def stored(self) -> dict[str, DataFrame]:
        """What is written to disk: quoted cells and runs of missing lines, never the dense grid."""
        tables = {
            "rfx_lines": self.items.select("sku", "description", "quantity", "canonical_unit", "line_no"),
            "vendors": self.vendors,
            "cells": self.cells,
            "gaps": self.gaps,
        }
        if self.criteria is not None:
            tables["questionnaire"] = C.questionnaire(self.scored, self.criteria, self.vendors)
        if self.terms is not None:
            tables["terms"] = self.terms.select("vendor", "kind", "text", "trigger", "value")
        return tables

    def tables(self) -> dict[str, DataFrame]:
        """The seven names users query, the grid expanded as it is read."""
        tables = self.stored()
        full = grid.full_grid(tables.pop("cells"), tables.pop("gaps"), self.items)
        return tables | {"quotes": full, "award": empty_award(self.items.sparkSession), "comparison": grid.comparison_view(full, self.items, self.vendors)}

    def warnings(self) -> DataFrame:
        return comparability_warnings(self.vendors, self.terms)


def build(
    lines: DataFrame,
    items: DataFrame,
    responses: DataFrame,
    rates: DataFrame,
    base_currency: str = "INR",
    answers: DataFrame | None = None,
    criteria: DataFrame | None = None,
    terms: DataFrame | None = None,
    overrides: DataFrame | None = None,
    by_code_only: bool = False,
    mode: str = "exact",
) -> Comparison:
    """Assemble the comparison of `lines` against `items`.

    `by_code_only` stops after the item-code rungs, for replies known to quote
    the buyer's codes. A later rate date is another call with other `rates`;
    edited criteria are another call with other `criteria`.
    """
    matched = matching.match_by_code(lines, items, "left") if by_code_only else matching.match_lines(lines, items, overrides, mode)
    return Comparison(items, responses, matched, rates, base_currency, answers, criteria, terms)


def credit_replies(replies: Replies, attributed: DataFrame) -> Replies:
    """Replies under the suppliers they were attributed to: (file, vendor, token, basis), one row per file.

    The responses also say how each was identified; see `attribution.credited`.
    """
    extra = ("identified_by", "token", "attribution_note")
    others = [credited(t, attributed).drop(*extra) for t in (replies.lines, replies.answers, replies.terms)]
    return Replies(credited(replies.responses, attributed), *others)


def build_from_replies(
    replies: Replies, rates: DataFrame | None = None, base_currency: str = "INR", items: DataFrame | None = None, mode: str = "exact", attributed: DataFrame | None = None
) -> Comparison:
    """Replies alone are enough: without a request the item list and the criteria come from them.

    Where the request was sent out, `attributed` (file, vendor, token, basis) says whose reply each file is.
    """
    if attributed is not None:
        replies = credit_replies(replies, attributed)
    quoting = replies.responses.where(F.col("lines_found") > 0)
    order = quoting.select("file", "vendor", F.col("file").alias("_by"))
    places = numbered(order, "vendor_ord", "_by").select("file", F.col("vendor_ord").cast("bigint").alias("vendor_ord"))
    responses = quoting.join(places, "file").withColumnRenamed("file", "source_file")
    lines, terms = demote_blanket(replies.lines, replies.terms)
    header = responses.select("source_file", "vendor_ord", "document_currency", "freight_included")
    lines = lines.drop("file").join(header, "source_file")
    if items is None:
        items = derive_items(group_lines(lines, mode))
    answers = replies.answers.join(places, "file")
    clusters = C.question_clusters(answers)
    monthly = basket_per_month(items).select("units_per_month").scalar()
    criteria = C.derive_criteria(clusters, monthly)
    said = C.latest_answers(answers, clusters, criteria)
    return build(
        lines, items, responses, rates or fx_rates(items.sparkSession), base_currency, said, criteria, terms, mode=mode
    )
