"""Reading codes, units, currencies, questions, answers and references."""

import json

import pytest
from pyspark.sql import functions as F

from bidloom.sources import catalogues, documents
from bidloom.functions import dates, labels, questions, references, text, units


def values(spark, inputs, column, schema="x string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, {schema}")
    return [r.v for r in frame.select("i", column.alias("v")).orderBy("i").collect()]


def test_item_codes(spark):
    raw = ["CP-001", "BX 004", "For BX-001, 5-ply box", "5-ply box, 400 x 300 x 250 mm", "kraft 180 GSM, MM 400", "ISO-9001 and CP_12345", "bx1", None]
    assert values(spark, raw, text.item_code("x")) == ["CP-001", "BX-004", "BX-001", None, None, "CP-12345", "BX-001", None]


def test_tokens_ignore_how_words_are_joined(spark):
    tokens = values(spark, ["16GB", "16 GB", "16-GB", "5 ply die-cut box, size 9"], text.description_tokens("x"))
    assert all({"16", "gb"} <= set(t) for t in tokens[:3])
    assert set(tokens[3]) == {"5", "ply", "5-ply", "die", "cut", "die-cut", "box", "9"}


@pytest.mark.parametrize(
    "unit, family, pack",
    [
        ("per 5 ply carton", "discrete", 1.0), ("per 250 gsm box", "discrete", 1.0), ("per 2024 price list", None, 1.0),
        ("per 100 pcs", "discrete", 100.0), ("/ 1,000", None, 1000.0), ("per 100 rolls", "roll", 100.0), ("per meters", "length", 1.0),
        ("INR / box", "discrete", 1.0), ("/ kg", "weight", 1.0), ("nos.", "discrete", 1.0), (None, None, 1.0),
    ],
)
def test_units(spark, unit, family, pack):
    frame = spark.createDataFrame([(unit,)], "x string")
    row = units.with_unit(frame, "x").withColumn("s", units.unit_spec("x")).first()
    assert (row.quoted_family, row.unit_pack) == (family, pack)
    assert (row.s.family, row.s.pack, row.s.noun) == (row.quoted_family, row.unit_pack, row.unit_noun)


def test_request_units_and_currencies(spark):
    assert [tuple(v) for v in values(spark, ["per 100 sheets", "Nos", None], units.request_unit("x"))] == [
        ("per 100 sheets", "sheet"), ("per unit", "discrete"), ("per unit", "discrete")]
    assert values(spark, ["₹", "Rs.", "INR ", "$", "usd ", "JPY", "", None], units.currency_code("x")) == ["INR", "INR", "INR", "USD", "USD", "JPY", None, None]


def test_tolerant_numbers_and_names(spark):
    assert values(spark, ["30-35 days", "1,250.50", "none", "1.2 to 1.4 mm"], text.tolerant_number("x")) == [30.0, 1250.5, None, 1.2]
    assert values(spark, ["sales@prime-pack.example", "NORTH-PACK LTD", '"Acme"', ""], text.supplier_name("x", F.lit("f.pdf"))) == [
        "Prime Pack", "North-Pack Ltd", "Acme", "f.pdf"]


def test_questions(spark):
    asked = ["Monthly bottling capacity above 40,000 units?", "Label misprint rate below 2%?", "Able to keep to a 45-day delivery promise?", "ISO 22000 certification held?"]
    got = [(r.kind, r.direction, r.threshold, r.unit) for r in values(spark, asked, questions.question_reading("x"))]
    assert got == [
        ("threshold", "higher_better", 40000.0, " units/month"), ("threshold", "lower_better", 2.0, "%"),
        ("threshold", "lower_better", 45.0, " days"), ("certification", "boolean", None, None)]
    label = questions.criterion_label(F.lit(asked[0]), F.lit("higher_better"), F.lit(30000.0), F.lit("units/month"))
    assert values(spark, [""], label) == ["Monthly bottling capacity greater than 30,000 units/month"]
    assert values(spark, [204500 / 12.0, 10000.0], questions.suggested_threshold(F.lit(" units/month"), F.col("x")), "x double") == [25000.0, 15000.0]


def test_answers(spark):
    reading = questions.answer_reading(F.col("x"), F.lit("96.4% for FY 2025-26"), F.lit("certificate no 12"), F.lit(None).cast("string"))
    got = values(spark, ["yes", "in part", None], reading)
    assert [(r.verdict, r.value, r.evidence) for r in got] == [("Yes", 96.4, "documented"), ("Partial", 96.4, "documented"), ("Unanswered", 96.4, "none")]


def test_references(spark):
    token = values(spark, ["Prime Packaging Ltd", "Prime Packers"], references.reply_token(F.lit("RFX/1"), F.lit(None).cast("string"), F.col("x"), F.lit(3)))
    assert token[0] != token[1] and token[0][:-4] == token[1][:-4]
    assert values(spark, [f"re: {token[0].lower()} thanks", "nothing"], references.quoted_token("x")) == [token[0].upper(), None]


def test_windows_and_ratings(spark):
    days = dates.window_days(F.lit("2026-09-09T17:00"), F.col("x"))
    assert values(spark, ["2026-09-12T16:59", "2026-09-08T17:00", "soon", None], days) == [2, -1, None, None]
    assert values(spark, ["2026-09-09T17:00", "soon"], dates.stamp(F.col("x"))) == ["9 Sep 2026, 17:00", "soon"]
    scores = F.create_map(F.lit("quality"), F.lit(9.0), F.lit("delivery"), F.lit(8.5), F.lit("commercial"), F.lit(7.0))
    assert values(spark, [""], labels.rating(scores)) == [8.2]
    assert values(spark, [""], labels.rating_reason(scores, F.lit(True), F.lit(""))) == ["Incumbent. strongest on quality (9), weakest on commercial (7)."]


def test_requests_of_any_shape_are_read_and_nothing_is_lost(spark, tmp_path):
    good = {"title": " Annual list ", "window_days": "21 days", "terms": {"payment": "30 days", "tax": None}, "notes": "Delivered rates only", "currency": "INR", "basis": {"year": 2026},
            "questions": [{"question": "MOQ?", "threshold": "500 units", "weight": 2}, "Test lab on site?", {"question": " "}, 7],
            "lines": [{"sku": "BX-1", "description": "Box", "quantity": "1,200", "unit": "box", "moq": 500}, "Loose tape", {"description": "", "quantity": 3}, {"description": "Roll", "quantity": -1}],
            "optional_lines": {"description": "One alone", "quantity": True}}
    for name, body in {"a.json": json.dumps(good), "b.json": "[1, 2]", "c.json": "not json", "d.json": "{}", "e.json": " "}.items():
        (tmp_path / name).write_text(body)
    read = catalogues.read_requests(spark, str(tmp_path))
    heads = {r.request_id: r for r in read.header.collect()}
    assert set(heads) == set("abcde") and (heads["a"].title, heads["a"].window_days, heads["a"].rescued) == ("Annual list", 21, {"basis": '{"year":2026}'})
    assert all(heads[k].title is None and not heads[k].rescued for k in "bcde")
    lines = sorted((r.optional, r.line_no, r.sku, r.description, r.quantity, r.canonical_unit, r.note) for r in read.lines.collect())
    assert [x[:5] for x in lines] == [(False, 1, "BX-1", "Box", 1200), (False, 2, None, "Loose tape", None), (False, 4, None, "Roll", None), (True, 1, None, "One alone", None)]
    assert lines[0][5:] == ("per box", "Minimum order quantity 500.")
    assert [(r.question, r.threshold, r.weight) for r in read.questions.orderBy("question_ord").collect()] == [("MOQ?", 500.0, 2.0), ("Test lab on site?", None, None)]
    assert {(r.kind, r.text) for r in read.terms.collect()} == {("payment", "30 days"), ("charges", "Delivered rates only")}


def test_directories_of_any_shape(spark):
    doc = {"functional_area": "Packaging", "score_names": {"quality": "How good"}, "categories": [
        {"key": "box", "name": "Boxes", "vendors": [{"name": "Acme", "incumbent": "True", "scores": {"quality": 8, "delivery": "7.5", "odd": "n/a"}, "fax": 1}, {"name": " "}, "text"]}, {"key": "tape", "vendors": {"name": "Solo", "incumbent": 1}}, 5]}
    raw = spark.createDataFrame([(json.dumps(doc),), ("[]",), ("broken",), (None,)], "value string")
    got = {r.vendor: r for r in catalogues.parse_directory(raw).collect()}
    assert set(got) == {"Acme", "Solo"} and got["Acme"].scores == {"quality": 8.0, "delivery": 7.5} and got["Acme"].incumbent and got["Acme"].rescued == {"fax": "1"}
    assert (got["Solo"].category_key, got["Solo"].incumbent, got["Solo"].scores) == ("tape", False, {})
    assert catalogues.find_category(catalogues.parse_directory(raw), " BOXES ").count() == 1
    assert [tuple(r) for r in catalogues.score_names(raw).collect()] == [("quality", "How good")]


def test_a_mixed_folder_is_taken_in_file_by_file(spark, tmp_path):
    long = "".join(f"line {i} £\n" for i in range(1, 5001))
    bodies = {"a.txt": "£4.20 – ok\r\nnext".encode("cp1252"), "b b.csv": "\ufeffé₹\n\nlast\n".encode(), "empty.txt": b"", "blank.eml": b" \n \n", "broken.txt": b"x\x00y", "odd.xyz": b"1", "scan.pdf": b"%PDF",
              "sub/long.txt": long.encode(), "sub/old.txt": long.encode("cp1252")}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        taken = documents.intake(spark, str(tmp_path), whole_bytes=20_000)
        got = {(r.file, r.line_no): r.line for r in taken.lines.collect()}
        outcomes = {r.file: r for r in taken.outcomes.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = {("a.txt", 1): "£4.20 – ok", ("a.txt", 2): "next", ("b b.csv", 1): "é₹", ("b b.csv", 2): "", ("b b.csv", 3): "last", ("blank.eml", 1): " ", ("blank.eml", 2): " "}
    wanted |= {(f, i): f"line {i} £" for f in ("sub/long.txt", "sub/old.txt") for i in range(1, 5001)}
    assert got == wanted
    assert {f: (r.ok, r.lines_found) for f, r in outcomes.items()} == {
        "a.txt": (True, 2), "b b.csv": (True, 2), "empty.txt": (False, 0), "blank.eml": (False, 0), "broken.txt": (False, 0), "odd.xyz": (False, 0), "scan.pdf": (False, 0),
        "sub/long.txt": (True, 5000), "sub/old.txt": (True, 5000)}
    assert all(bool(r.error) != r.ok for r in outcomes.values()) and "zero bytes" in outcomes["broken.txt"].error and "xyz" in outcomes["odd.xyz"].error
