"""Request catalogues and the approved-vendor directory (JSON), read field by field.

Files drift: a number comes as text, a list as one value, a section under a new name.
Every document is parsed to a VARIANT and each field is taken in the shape it has; what
has no reading there is null, and what no field is named for is kept as `rescued`, JSON
text by name, so that nothing a file says is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions.common import blank_to_null, finite
from bidloom.functions.text import tolerant_number
from bidloom.functions.units import request_unit
from bidloom.sources.documents import decode_text

HEADER = ("title", "reference", "scope", "currency", "delivery_location", "vendor_category", "issuer_notes")
SECTIONS = ("window_days", "terms", "notes", "questions", "lines", "optional_lines")
DIRECTORY = ("functional_area", "note", "score_names", "categories")


@dataclass
class RequestCatalogue:
    header: DataFrame
    lines: DataFrame
    questions: DataFrame
    terms: DataFrame


def _documents(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+?)(?:\.json)?$", 1).alias("file"), decode_text(F.col("content")).alias("value"))


def _kind(x: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0), F.lit("VOID"))


def _field(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", "variant")


def _text(doc: Column, name: str) -> Column:
    return blank_to_null(F.trim(F.try_variant_get(doc, f"$.{name}", "string")))


def _number(doc: Column, name: str) -> Column:
    """A number, or the first number in a text; neither for a flag, a list or an object."""
    kind = _kind(_field(doc, name))
    plain = finite(F.try_variant_get(doc, f"$.{name}", "double"))
    return F.when(kind == "STRING", tolerant_number(F.try_variant_get(doc, f"$.{name}", "string"))).when(~kind.isin("BOOLEAN", "ARRAY", "OBJECT"), plain)


def _whole(doc: Column, name: str) -> Column:
    number = _number(doc, name)
    return F.when(F.abs(number) < 1e15, number.cast("bigint"))


def _list(doc: Column, name: str) -> Column:
    """A list; a lone value is a list of one."""
    kind = _kind(_field(doc, name))
    none = F.array().cast("array<variant>")
    return F.when(kind == "ARRAY", F.try_variant_get(doc, f"$.{name}", "array<variant>")).when(kind.isin("VOID"), none).otherwise(F.array(_field(doc, name)))


def _named(doc: Column, name: str) -> Column:
    """An object's members as a map of variants, empty where there is no object."""
    return F.coalesce(F.try_variant_get(doc, f"$.{name}", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def _rescued(doc: Column, known: tuple[str, ...]) -> Column:
    members = F.coalesce(F.try_variant_get(doc, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    left = F.map_filter(members, lambda k, v: ~k.isin(*known))
    return F.transform_values(left, lambda k, v: F.to_json(v))


def read_requests(spark: SparkSession, path: str) -> RequestCatalogue:
    """Request files -> header, item lines (standing and optional), questions and terms. A file without a byte is no document."""
    return parse_requests(_documents(spark, path).withColumnRenamed("file", "request_id"))


def parse_requests(raw: DataFrame) -> RequestCatalogue:
    """`raw` has request_id and value. A document that is no JSON object has a header without fields and nothing else.

    An item or question given as plain text is one with that description or wording; a blank one is
    none. Terms are an object of texts, notes a list of texts. A quantity below one is not stated.
    """
    doc = F.col("doc")
    docs = raw.select("request_id", F.try_parse_json("value").alias("doc")).withColumn("doc", F.when(_kind(doc) == "OBJECT", doc))
    header = docs.select("request_id", *[_text(doc, c).alias(c) for c in HEADER], _whole(doc, "window_days").alias("window_days"), _rescued(doc, (*HEADER, *SECTIONS)).alias("rescued"))

    x = F.col("x")
    spoken = F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string"))

    def entries(section: str) -> DataFrame:
        return docs.select("request_id", F.posexplode(_list(doc, section)).alias("pos", "x"))

    def items(section: str, optional: bool) -> DataFrame:
        return entries(section).select(
            "request_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), F.lit(optional).alias("optional"), _text(x, "sku").alias("sku"),
            F.trim(F.coalesce(spoken, _text(x, "description"))).alias("description"), _whole(x, "quantity").alias("quantity"), _text(x, "unit").alias("unit"), _whole(x, "moq").alias("moq"),
        )

    moq = F.when(F.col("moq") != 0, F.concat(F.lit("Minimum order quantity "), F.format_number("moq", 0), F.lit(".")))
    lines = items("lines", False).unionByName(items("optional_lines", True)).where(F.col("sku").isNotNull() | blank_to_null("description").isNotNull())
    lines = lines.withColumn("u", request_unit(F.coalesce("unit", F.lit("per unit")))).select(
        "request_id", "line_no", "optional", "sku", "description", F.when(F.col("quantity") > 0, F.col("quantity")).alias("quantity"),
        F.col("u.label").alias("canonical_unit"), F.col("u.family").alias("unit_family"), F.coalesce(moq, F.lit("")).alias("note"),
    )
    questions = entries("questions").select(
        "request_id", (F.col("pos") + 1).cast("bigint").alias("question_ord"), F.trim(F.coalesce(spoken, _text(x, "question"))).alias("question"), _number(x, "threshold").alias("threshold"),
        *[_text(x, c).alias(c) for c in ("direction", "unit", "requirement")], _number(x, "weight").alias("weight"),
    ).where(blank_to_null("question").isNotNull())
    named = docs.select("request_id", F.explode(_named(doc, "terms")).alias("kind", "x")).select("request_id", "kind", F.trim(F.try_variant_get(x, "$", "string")).alias("text"))
    notes = entries("notes").select(
        "request_id", F.when(F.col("pos") == 0, F.lit("charges")).otherwise(F.concat(F.lit("note "), F.col("pos").cast("string"))).alias("kind"), F.trim(F.try_variant_get(x, "$", "string")).alias("text")
    )
    return RequestCatalogue(header, lines, questions, named.unionByName(notes).where(blank_to_null("text").isNotNull()))


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    return parse_directory(_documents(spark, path))


def parse_directory(raw: DataFrame) -> DataFrame:
    """One row per (category, vendor) of the documents in `value`, scores as a map of the numbers among them.

    A vendor without a name is none; an incumbent is one whose flag is true, as a flag or a text.
    """
    doc, c, v = F.col("doc"), F.col("c"), F.col("v")
    docs = raw.select(F.try_parse_json("value").alias("doc"))
    categories = docs.select(_text(doc, "functional_area").alias("functional_area"), F.explode(_list(doc, "categories")).alias("c"))
    vendors = categories.select("functional_area", _text(c, "key").alias("category_key"), _text(c, "name").alias("category"), _text(c, "covers").alias("covers"), F.explode(_list(c, "vendors")).alias("v"))
    scores = F.map_filter(F.transform_values(_named(v, "scores"), lambda k, x: finite(F.try_variant_get(x, "$", "double"))), lambda k, x: x.isNotNull())
    return vendors.select(
        "functional_area", "category_key", "category", "covers", _text(v, "name").alias("vendor"), _text(v, "email").alias("email"), _text(v, "location").alias("location"),
        F.coalesce(F.lower(_text(v, "incumbent")) == "true", F.lit(False)).alias("incumbent"), scores.alias("scores"), _text(v, "note").alias("note"),
        _rescued(v, ("name", "email", "location", "incumbent", "scores", "note")).alias("rescued"),
    ).where(F.col("vendor").isNotNull())


def find_category(directory: DataFrame, key_or_name: str) -> DataFrame:
    wanted = F.lower(F.trim(F.lit(key_or_name)))
    return directory.where((F.lower("category_key") == wanted) | (F.lower("category") == wanted))


def score_names(raw: DataFrame) -> DataFrame:
    """What each score is called, from the documents in `value`."""
    names = raw.select(F.explode(_named(F.try_parse_json("value"), "score_names")).alias("score", "x"))
    return names.select("score", F.try_variant_get(F.col("x"), "$", "string").alias("meaning")).distinct()
