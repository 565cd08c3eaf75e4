"""Steps that must not grow faster than their input: how often they read it and how far they spread it."""

import random

from pyspark.sql import functions as F

from bidloom import session
from bidloom.operators import award, grid, matching, names, requests
from bidloom.sources import replies


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_name_travels_to_its_own_shard_only(spark):
    rng = random.Random(5)
    firms = [f"{rng.choice(['north', 'the company of ', 'ös', 'x'])}{rng.randrange(10**6):06d} ltd" for _ in range(600)] + ["ab", "a", "north"]
    texts = [(i, f"dear sirs, {rng.choice(firms)} and{rng.choice(firms)} " + "filler " * (i % 40)) for i in range(5000)] + [(7, "north"), (None, "ab")]
    found = names.names_in_texts(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(f,) for f in firms] + [(None,), ("",)], "name string"), shard_chars=200)
    expected = sorted((str(i), f) for i, t in texts for f in set(firms) if f in t)
    assert sorted((str(r["id"]), r["name"]) for r in found.collect()) == expected
    # Some 50 shards of 200 characters; every part of the texts used to take every one of them.
    assert found.rdd.getNumPartitions() < 300
    nothing = names.names_in_texts(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([], "name string"))
    assert nothing.columns == ["id", "name"] and nothing.isEmpty()


def test_gaps_read_the_placed_lines_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    placed = spark.createDataFrame([("v", n) for n in (2, 3, 7, 9)] + [("w", 1)], "vendor string, line_no bigint").mapInArrow(counted, "vendor string, line_no bigint")
    vendors = spark.createDataFrame([("v",), ("w",), ("x",)], "vendor string")
    items = spark.createDataFrame([(str(n),) for n in range(10)], "sku string")
    gaps = {(r["vendor"], r["first_line"], r["last_line"]) for r in grid.coverage_gaps(placed, vendors, items, bucket=4).collect()}
    assert gaps == {("v", 1, 1), ("v", 4, 6), ("v", 8, 8), ("v", 10, 10), ("w", 2, 10), ("x", 1, 10)}
    assert read.value == 5


def test_no_side_of_unknown_size_is_built_whole(spark):
    items = spark.createDataFrame([("P-1", "steel ring 10 x 20 mm"), ("P-2", "brass ring 30")], "sku string, description string")
    vocabulary = matching.marker_vocabulary(items)
    catalogue = matching.catalogue_profile(items, vocabulary)
    texts = matching.profile(spark.createDataFrame([("ring of steel 10x20",)], "text string"), "text", vocabulary)
    pairs = matching.candidate_pairs(texts, catalogue).join(session.never_broadcast(texts), "text")
    assert "CartesianProduct" not in plan_of(pairs) and "SortMergeJoin" in plan_of(pairs)
    one = spark.createDataFrame([(1,)], "k int")
    table = spark.range(50).select(F.col("id").cast("int").alias("k"))
    assert "BroadcastHashJoin" in plan_of(one.join(session.broadcast_if_small(table, table), "k"))
    assert "Broadcast" not in plan_of(one.join(session.broadcast_if_small(table, table, limit=49), "k"))


def test_long_question_log_equals_the_plain_loop(spark):
    rng = random.Random(3)
    asked = ["ISO 9001 certification held?", "Are you ISO 9001 certified?", "Rejection rate", "Capacity", "Monthly capacity above 15,000 units", "SLA"]
    log = [(r, n, "remove_question" if rng.random() < 0.25 else "add_question", rng.choice(asked)) for r in ("a", "b") for n in range(150)]
    events = spark.createDataFrame(log, "request_id string, event_ord bigint, op string, question string").withColumns(
        {c: F.lit(None).cast(t) for c, t in (("threshold", "double"), ("direction", "string"), ("unit", "string"), ("requirement", "string"), ("weight", "double"))}
    )
    same = {(r["stands"], r["asked"]) for r in requests.same_questions(events.select("question")).collect()}
    left = set()
    for request in ("a", "b"):
        standing = []
        for _, n, op, q in (e for e in log if e[0] == request):
            if op == "remove_question":
                standing = [(m, s) for m, s in standing if (s, q) not in same]
            elif not any((s, q) in same for _, s in standing):
                standing.append((n, q))
        left |= {(request, n, q) for n, q in standing}
    assert {(r["request_id"], r["event_ord"], r["question"]) for r in requests.fold_question_events(events).collect()} == left


def test_acceptance_goes_by_groups(spark):
    """What an event meets is a group of lives, one row however many lives the group holds."""
    kind = "request_id string, event_ord bigint, question string, gone bigint"
    lives = spark.createDataFrame([("a", n, "q", None) for n in range(40)], kind)
    assert requests._first_come(lives, lives).collect() == [("a", 0)]


def test_lines_meet_a_long_item_list_part_by_part(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 1)
    items = spark.createDataFrame([("BX-001", "a"), ("BX-002", "b")], "sku string, description string")
    lines = spark.createDataFrame([("l1", "BX-001", None), ("l2", "bx 002", None), ("l3", None, "no code")], "line_id string, vendor_sku string, description string")
    matched = matching.match_by_code(lines, items).select("line_id", "rfx_sku", "match_confidence")
    assert sorted(tuple(r) for r in matched.collect()) == [("l1", "BX-001", 1.0), ("l2", "BX-002", 0.97)]
    assert "ShuffledHashJoin" in plan_of(matched) and "Broadcast" not in plan_of(matched)
    # Beside its code a line takes along whether it was written so, not the cell that it was read from.
    travels = matched._jdf.queryExecution().optimizedPlan().children().head().left().output().mkString(" ")
    assert "verbatim#" in travels and "vendor_sku#" not in travels and "description#" not in travels


def counting(spark, df):
    """The same rows, and how many of them were ever read."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return df.mapInArrow(counted, df.schema), read


def test_a_plan_leaves_out_coverage_that_it_does_not_show(spark):
    lines, read = counting(spark, spark.createDataFrame([("a",), ("b",)], "vendor string"))
    vendors = spark.createDataFrame([("a", 1), ("b", 2)], "vendor string, vendor_ord bigint").withColumns({"quality_score": F.lit(1.0), "meets_requirements": F.lit(True)})
    vendors = vendors.join(lines.groupBy("vendor").agg(F.count("*").alias("lines_read")), "vendor", "left")
    cells = spark.createDataFrame([("S", "a", 2.0, 1), ("S", "b", 1.0, 1)], "rfx_sku string, vendor string, canonical_value double, comparable int")
    items = spark.createDataFrame([("S", "s", 3, "per box")], "sku string, description string, quantity bigint, canonical_unit string")
    plan = award.recommend(cells, items, vendors)
    assert [r["winner"] for r in plan.lines.collect()] == ["b"] and plan.summary.first()["awarded_lines"] == 1
    assert read.value == 0
    assert {r["lines_read"] for r in plan.shortlist.collect()} == {1}


def test_a_line_does_not_take_its_reply_along(spark):
    raw = spark.createDataFrame([
        ("f1", '{"vendor": "Acme", "lines": [{"vendor_sku": "a", "quoted_value": NaN}, {}, 7, null, "x", [1]], "terms": ["net 30", {"kind": "Tax"}]}'),
        ("f2", '[{"description": "NaN is no number", "quantity": 2}]'), ("f3", "not json"), ("f4", '{"lines": {"vendor_sku": "b"}}'), ("f5", None),
    ], "file string, value string")
    read = replies.parse_replies(raw)
    assert sorted((r.file, r.vendor, r.line_ord, r.vendor_sku, r.quantity) for r in read.lines.collect()) == [("f1", "Acme", 1, "a", None), ("f1", "Acme", 2, None, None), ("f2", "f2", 1, None, 2.0)]
    assert {(r.vendor, r.kind, r.text) for r in read.terms.collect()} == {("Acme", "other", "net 30"), ("Acme", "tax", "")}
    assert {(r.file, r.lines_found) for r in read.responses.collect()} == {("f1", 2), ("f2", 1), ("f3", 0), ("f4", 0), ("f5", 0)}
    above = read.lines._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "doc#" not in above


def test_merged_questions_gather_the_lines_once(spark, tmp_path):
    from __spark_entry__ import merged_questions

    spark.range(60).selectExpr(
        "id % 7 AS l_orderkey", "cast(id % 5 AS int) AS l_linenumber", "id AS l_partkey", "1.0D * (id % 9) AS l_quantity", "timestamp '2000-01-01 00:00:00' AS l_shipdate",
        "if(id % 2 = 0, 'R', 'N') AS l_returnflag", "if(id % 3 = 0, 'F', 'O') AS l_linestatus").write.parquet(str(tmp_path / "lineitem.parquet"))
    merged = merged_questions(spark, str(tmp_path))
    assert {r.part for r in merged.select("part").distinct().collect()} == {"question", "file"}
    assert not any("lineitem.parquet" in f for f in merged.inputFiles())


def test_consolidation_reads_the_offers_twice(spark):
    offers = [("S1", "a", 1.0), ("S1", "b", 2.0), ("S2", "b", 1.0), ("S3", "b", 1.0), ("S3", "a", 3.0)]
    priced, read = counting(spark, spark.createDataFrame(offers, "rfx_sku string, vendor string, price double"))
    vendors = spark.createDataFrame([("a", 1), ("b", 2)], "vendor string, vendor_ord bigint")
    done = award.dropped_for_size(priced, vendors, 2)
    assert [tuple(r) for r in done.dropped.collect()] == [("a", 1)] and not done.stopped
    assert read.value == 2 * len(offers)
