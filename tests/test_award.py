"""Award rules on small grids, consolidation against a plain re-statement."""

import random


from bidloom.operators import award, grid, normalise
from bidloom.plans import analyses


def grid_of(spark, prices, quantities):
    cells = spark.createDataFrame([(s, v, p, 1) for (s, v), p in prices.items()], "rfx_sku string, vendor string, canonical_value double, comparable int")
    items = spark.createDataFrame([(s, s.lower(), q, "per box") for s, q in quantities.items()], "sku string, description string, quantity bigint, canonical_unit string")
    names = sorted({v for _, v in prices})
    vendors = spark.createDataFrame([(v, i, 1.0 - i / 10, True, None) for i, v in enumerate(names)],
                                    "vendor string, vendor_ord bigint, quality_score double, meets_requirements boolean, freight_included boolean")
    return cells, items, vendors


PRICES = {("A", "x"): 40.0, ("A", "y"): 40.0, ("B", "x"): 60.0, ("B", "y"): 55.0, ("C", "y"): 5.0}
QUANTITIES = {"A": 10, "B": 2, "C": None, "D": 4}


def test_ties_go_by_name_and_gaps_are_named(spark):
    cells, items, vendors = grid_of(spark, PRICES, QUANTITIES)
    plan = award.recommend(cells, items, vendors)
    lines = {r.rfx_sku: r for r in plan.lines.collect()}
    assert (lines["A"].winner, lines["A"].saving_per_unit, lines["A"].status) == ("x", 0.0, "awarded")
    assert (lines["B"].winner, lines["B"].extended, lines["B"].extended_saving) == ("y", 110.0, 10.0)
    assert (lines["C"].status, lines["C"].extended, lines["D"].status) == ("single_source", None, "no_comparable")
    row = plan.summary.first()
    assert (row.common_basket, row.split_on_common, row.best_single_vendor, row.best_single_total, row.saving_vs_single) == (2, 510.0, "y", 510.0, 0.0)
    assert (row.awarded_lines, row.unawardable, row.quantities_known, row.outside_basket) == (3, 1, False, 2)
    kinds = {r.kind for r in award.caveats(plan, vendors).collect()}
    assert {"uncontested", "unawardable", "quantities_missing"} <= kinds


def test_quality_bar_excludes(spark):
    cells, items, vendors = grid_of(spark, PRICES, QUANTITIES)
    plan = award.recommend(cells, items, vendors, min_quality=0.95)
    assert {r.winner for r in plan.lines.collect()} == {"x", None}
    effect = {r.scenario: r.awarded_lines for r in analyses.effect_of_quality(cells, items, vendors, 0.95).collect()}
    assert effect == {"with quality bar": 2, "ignoring quality": 3}


def plain_consolidation(prices, names, min_lines):
    def winners(active):
        best = {}
        for (s, v), p in prices.items():
            if v in active:
                best.setdefault(s, []).append((p, v))
        return {s: (min(o)[1], len(o)) for s, o in best.items()}

    active, dropped = list(names), []
    while len(active) > 1:
        won = winners(active)
        counts = {v: sum(w == v for w, _ in won.values()) for v in active}
        small = [v for v in active if 0 < counts[v] < min_lines]
        if not small:
            break
        candidate = min(small, key=lambda v: counts[v])
        if any(w == candidate and k == 1 for w, k in won.values()):
            break
        active.remove(candidate)
        dropped.append(candidate)
    return dropped


def test_consolidation_equals_plain_loop(spark):
    rng = random.Random(3)
    for trial in range(3):
        names = list("abcdef")
        prices = {(f"S{i}", v): float(rng.randint(1, 30)) for i in range(30) for v in names if rng.random() < (0.9 if trial else 0.6)}
        cells, _, vendors = grid_of(spark, prices, {"S0": 1})
        for min_lines in (4, 8):
            assert dropped(award.dropped_for_size(grid.offers(cells), vendors, min_lines)) == plain_consolidation(prices, names, min_lines)


def dropped(done):
    rows = sorted((r.place, r.vendor) for r in done.dropped.collect())
    assert [p for p, _ in rows] == list(range(1, done.n + 1))
    return [v for _, v in rows]


def test_consolidation_drops_many_in_a_round(spark):
    rng = random.Random(11)
    names = [f"v{i:03d}" for i in range(150)]
    # Many small winners, each with an item or two of its own, beside a few large ones that are next in line.
    prices = {}
    for i in range(400):
        own = rng.choice(names[:140]) if i < 150 else rng.choice(names[140:])
        prices[f"S{i:03d}", own] = 1.0
        for v in rng.sample(names[130:], 4):
            prices.setdefault((f"S{i:03d}", v), float(rng.randint(2, 9)))
    cells, _, vendors = grid_of(spark, prices, {"S000": 1})
    done = award.dropped_for_size(grid.offers(cells), vendors, 8)
    expected = plain_consolidation(prices, names, 8)
    assert dropped(done) == expected and len(expected) > 60 and done.rounds < len(expected) / 3


def test_consolidation_of_close_rivals_takes_few_rounds(spark, monkeypatch):
    """Everybody is next in line to everybody, so each drop changes who comes next: a round used to hold a few."""
    rng = random.Random(17)
    names = [f"v{i:02d}" for i in range(90)]
    prices = {(f"S{i:03d}", v): float(rng.randint(1, 9)) for i in range(120) for v in rng.sample(names, 12)}
    cells, _, vendors = grid_of(spark, prices, {"S000": 1})
    expected = plain_consolidation(prices, names, 9)
    done = award.dropped_for_size(grid.offers(cells), vendors, 9)
    assert dropped(done) == expected and len(expected) > 40 and done.rounds == 1
    # With four offers of an item at once it takes more rounds and comes to the same.
    monkeypatch.setattr(award, "MOST_OFFERS", 4)
    done = award.dropped_for_size(grid.offers(cells), vendors, 9)
    assert dropped(done) == expected and 1 < done.rounds < 20


def test_consolidation_passes_over_offers_without_a_name(spark):
    priced = spark.createDataFrame([("A", "x", 1.0), ("A", None, 2.0), ("A", "y", 3.0), *[(f"B{i}", "y", 1.0) for i in range(3)]], "rfx_sku string, vendor string, price double")
    vendors = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "vendor string, vendor_ord int")
    assert dropped(award.dropped_for_size(priced, vendors, 2)) == ["x"]
    # With nobody named behind it, x is the last to offer its item.
    assert award.dropped_for_size(priced.where("rfx_sku <> 'A' OR vendor = 'x' OR vendor IS NULL"), vendors, 2).stopped


def quote(spark, rows):
    schema = ("rfx_sku string, vendor string, quoted_value double, currency string, unit_text string, conditions array<string>, notes string, document_currency string, "
              "freight_included boolean, canonical_unit string, unit_family string, confidence double, match_basis string, match_confidence double, "
              "source_file string, source_locator string, source_snippet string")
    full = [("S", "V", v, c, u, cond, n, dc, f, "per box", "discrete", 0.9, "exact_sku", 1.0, "q.xlsx", f"row {i:02d}", "text") for i, (v, c, u, cond, n, dc, f) in enumerate(rows)]
    cells = normalise.normalise_quotes(spark.createDataFrame(full, schema), normalise.fx_rates(spark, "2026-01-01"))
    return sorted(cells.collect(), key=lambda r: r.source_locator)


def test_normalising_and_refusing(spark):
    nan = float("nan")
    got = quote(spark, [
        (45.0, "₹", "per box", [], "", None, None), (45.0, None, "per 100 pcs", [], "", "INR", False), (2.0, "$", "per box", [], "", None, None),
        (45.0, "INR", "per kg", [], "", None, None), (45.0, "INR", "per metre", [], "", None, None), (None, "INR", "per box", [], "as per last year", None, None),
        (nan, "INR", "per box", [], "", None, None), (45.0, "JPY", "per box", [], "", None, None), (45.0, None, None, [], "", None, None),
        (45.0, "INR", "per roll", [], "", None, None), (45.0, "INR", "per box", ["subject to FX"], "", None, None), (45.0, "INR", "per box", ["Printing plates are a one-time charge"], "", None, None),
    ])
    assert [(r.status, r.canonical_value) for r in got] == [
        ("Confirmed", 45.0), ("Normalized", 0.45), ("Normalized", 175.0), ("Unresolved", None), ("Unresolved", None), ("Unresolved", None),
        ("Unresolved", None), ("Needs Review", None), ("Normalized", 45.0), ("Needs Review", 45.0), ("Needs Review", 45.0), ("Confirmed", 45.0)]
    assert got[1].factor == "÷ 100 (per 100 pcs → per box)" and got[1].flags == ["freight_excluded"]
    assert got[2].factor == "× 87.5 INR/USD @ 2026-01-01"
    assert got[3].missing_datum == "unit weight in kg of one box of S" and got[3].rules == ["weight_basis_unconvertible"]
    assert got[8].flags == ["assumed_family", "currency_assumed"] and got[8].extraction_confidence == 0.8
    assert got[11].unrecognised_conditions == ["Printing plates are a one-time charge"]


def test_the_rate_join_does_not_shuffle_the_lines(spark):
    lines = spark.range(1000).selectExpr(
        "'S' AS rfx_sku", "'V' AS vendor", "1.0D AS quoted_value", "if(id % 2 = 0, 'USD', 'INR') AS currency", "'per box' AS unit_text", "array('') AS conditions", "'' AS notes",
        "'INR' AS document_currency", "true AS freight_included", "'per box' AS canonical_unit", "'discrete' AS unit_family", "0.9D AS confidence",
        "'exact_sku' AS match_basis", "1.0D AS match_confidence", "'a' AS source_file", "'b' AS source_locator", "'c' AS source_snippet")
    cells = normalise.normalise_quotes(lines, normalise.fx_rates(spark, "2026-01-01"))
    assert cells.agg({"canonical_value": "sum"}).first()[0] == 44_250.0
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_gaps_cross_stretches(spark):
    placed = spark.createDataFrame([("a", n) for n in (2, 3, 9, 10)] + [("b", 1)], "vendor string, line_no bigint")
    vendors = spark.createDataFrame([("a",), ("b",), ("c",)], "vendor string")
    items = spark.createDataFrame([(f"S{i}", i, "per box") for i in range(1, 12)], "sku string, line_no bigint, canonical_unit string")
    gaps = grid.coverage_gaps(placed, vendors, items, bucket=4)
    assert sorted((r.vendor, r.first_line, r.last_line) for r in gaps.collect()) == [("a", 1, 1), ("a", 4, 8), ("a", 11, 11), ("b", 2, 11), ("c", 1, 11)]
    assert grid.not_quoted_cells(gaps, items).count() == 7 + 10 + 11


def test_price_ranking_is_one_mergeable_aggregate(spark):
    cells, items, _ = grid_of(spark, PRICES, QUANTITIES)
    best = grid.two_best(grid.offers(cells))
    plan = best._jdf.queryExecution().toString()
    assert "partial_collect_top_k" in plan and "Window" not in plan and plan.split("== Physical Plan ==")[1].count("Scan ExistingRDD") == 1
    assert {(r.rfx_sku, r.winner, r.runner_up, r.runner_up_price, r.contenders) for r in best.collect()} == {("A", "x", "y", 40.0, 2), ("B", "y", "x", 60.0, 2), ("C", "y", None, None, 1)}


def test_ranking_equals_sorting(spark):
    rng = random.Random(4)
    prices = {(f"S{rng.randint(0, 9)}" if i % 3 else "hot", f"v{i}"): float(rng.randint(1, 6)) for i in range(600)}
    cells, _, _ = grid_of(spark, prices, {"S0": 1})
    got = {r.rfx_sku: r for r in grid.two_best(grid.offers(cells.repartition(7))).collect()}
    for sku, r in got.items():
        offers = sorted((p, v) for (s, v), p in prices.items() if s == sku)
        assert [(r.price, r.winner), (r.runner_up_price, r.runner_up), r.contenders] == [*offers[:2], len(offers)]


def test_an_award_scans_the_lines_once(spark, tmp_path):
    from __spark_entry__ import award_lines

    plan = award_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "lineitem" in line]
    assert len(scans) == 1, len(scans)


def test_consolidation_cost_and_stop(spark):
    prices = {(f"S{i}", v): p for i in range(6) for v, p in (("x", 5.0 + i), ("y", 6.0 if i > 1 else 4.0))} | {("T", "z"): 1.0}
    cells, items, vendors = grid_of(spark, prices, dict.fromkeys([f"S{i}" for i in range(6)] + ["T"], 10))
    plan = award.recommend(cells, items, vendors, min_lines=2)
    assert (plan.consolidation.n, plan.consolidation.stopped, plan.summary.first().consolidation_cost) == (0, True, None)
    cells, items, vendors = grid_of(spark, prices | {("T", "x"): 3.0}, dict.fromkeys([f"S{i}" for i in range(6)] + ["T"], 10))
    plan = award.recommend(cells, items, vendors, min_lines=2)
    moved = {r.rfx_sku: r.reassigned_from for r in plan.lines.collect() if r.reassigned_from}
    assert dropped(plan.consolidation)[0] == "z" and moved["T"] == "z" and plan.summary.first().consolidation_cost >= 20.0
