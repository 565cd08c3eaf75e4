"""Files and text documents: routing, decoding, located lines, HTML bodies and triage."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidloom import vocabulary as V
from bidloom.functions.common import as_col, lookup
from bidloom.functions.labels import format_name
from bidloom.functions.text import file_extension
from bidloom.session import empty_files

LINE_BREAK = "\r\n|\n|\r"
# The printable half of the Windows code page that Latin-1 leaves as controls.
_CP1252_FROM = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_CP1252_TO = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


#: Files up to this size are read in one piece; of a longer one, byte ranges are read apart.
WHOLE_BYTES = 16 << 20


@dataclass
class Intake:
    """Lines (file, line_no, line) of what could be read, and one outcome per file."""

    lines: DataFrame
    outcomes: DataFrame


def intake(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> Intake:
    """A folder of mixed files: every text's lines, and what became of each file.

    `outcomes` has file (its path below the folder), extension, reader, length, ok, lines_found and
    error. Unreadable files are set apart there and never stop the others: unsupported types,
    files without content, and texts that hold zero bytes. A long text is read by byte ranges,
    and its lines are numbered by adding up the lines of the ranges before.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.regexp_replace(F.regexp_replace(F.url_decode("path"), "^file:/+", "/"), "^" + re.escape(re.sub("^file:/+", "/", path).rstrip("/")) + "/", "")
    bare = spark.createDataFrame([(f, 0) for f in empty_files(spark, path)], "path string, length bigint")
    listed = route(files.select("path", "length").unionAll(bare).select(below.alias("file"), "length"))
    texts = F.col("reader").isin("text", "email")

    small = route(files.where(F.col("length") <= whole_bytes).select(below.alias("file"), "length", "content")).where(texts)
    broken = F.locate("00", F.regexp_replace(F.hex("content"), "(..)", "$1 ")) > 0
    small = small.select("file", broken.alias("broken"), decode_text(F.col("content")).alias("text"))
    parts = _by_ranges(spark, path, whole_bytes, below)
    lines = located_lines(small.where(~F.col("broken")), "file", "text").select("file", "line_no", "line").unionByName(parts)

    counted = lines.groupBy("file").agg(F.count_if(F.trim("line") != "").alias("lines_found"))
    read = listed.join(small.select("file", "broken"), "file", "left").join(counted, "file", "left")
    found = F.coalesce("lines_found", F.lit(0).cast("bigint"))
    error = (
        F.when(F.col("warning").isNotNull(), F.col("warning"))
        .when(~texts, F.concat(F.lit("The "), F.col("reader"), F.lit(" reader is not part of this library.")))
        .when(F.col("broken"), F.lit("This file holds zero bytes and is no text."))
        .when(found == 0, F.lit("No readable content could be extracted from this file."))
    )
    outcomes = read.select("file", "extension", "reader", "length", error.isNull().alias("ok"), found.alias("lines_found"), F.coalesce(error, F.lit("")).alias("error"))
    return Intake(lines, outcomes)


def _by_ranges(spark: SparkSession, path: str, whole_bytes: int, below: Column) -> DataFrame:
    """(file, line_no, line) of the texts longer than `whole_bytes`, each range of bytes by a task of its own."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).where(F.col("_metadata.file_size") > whole_bytes)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn"), F.col("value").cast("binary").alias("value"))
    named = route(raw.select(below.alias("file"), "block", "turn", "value")).where(F.col("reader").isin("text", "email")).select("file", "block", "turn", "value")
    sizes = named.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", "block", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("turn"))
    numbered = named.withColumn("place", place).join(starts, ["file", "block"])
    return numbered.select("file", (F.col("before") + F.col("place")).cast("bigint").alias("line_no"), decode_text(F.col("value")).alias("line"))


def route(files: DataFrame, file: str = "file") -> DataFrame:
    """Which reader a file goes to, and what people call its format."""
    extension = file_extension(file)
    warning = F.when(
        extension == "msg", F.lit("Outlook .msg is a different format from .eml and cannot be read here.")
    ).when(
        lookup(extension, V.READERS).isNull(), F.concat(F.lit("Unsupported file type '."), extension, F.lit("'."))
    )
    return files.withColumns(
        {
            "extension": extension,
            "reader": lookup(extension, V.READERS, F.lit("unsupported")),
            "format": format_name(extension),
            "warning": warning,
        }
    )


def decode_text(content: Column) -> Column:
    """Bytes to text without losing a currency sign: UTF-8 (with or without mark), then the Windows code page."""
    as_text = content.cast("string")
    latin = F.translate(F.decode(content, "ISO-8859-1"), _CP1252_FROM, _CP1252_TO)
    text = F.when(F.is_valid_utf8(as_text), as_text).otherwise(latin)
    return F.regexp_replace(text, "^﻿", "")


def located_lines(docs: DataFrame, key: str, text: str, kind: str = "line", keep_blank: bool = True) -> DataFrame:
    """Every line of every document with its number in front, so any value can be pointed at.

    `kind="row"` with `keep_blank=False` is the spreadsheet form: blank rows go, numbering stays.
    """
    body = F.regexp_replace(as_col(text), f"(?:{LINE_BREAK})$", "")
    rows = docs.where(F.length(text) > 0).select(key, F.posexplode(F.split(body, LINE_BREAK)).alias("pos", "line"))
    if not keep_blank:
        rows = rows.where(F.trim("line") != "")
    number = (F.col("pos") + 1).cast("bigint")
    return rows.select(
        key, number.alias("line_no"), "line", F.concat(F.lit(f"[{kind} "), number.cast("string"), F.lit("] "), F.col("line")).alias("located")
    )


def html_to_text(html: Column | str) -> Column:
    """A mail's HTML body as text: breaks become line ends, other tags become a space."""
    return F.regexp_replace(F.regexp_replace(as_col(html), r"<br\s*/?>", "\n"), "<[^>]+>", " ")


def triage(text: Column | str) -> Column:
    """STRUCT(rejected, reason): whether an extracted text layer can be trusted."""
    t = as_col(text)
    marks = F.length(t) - F.length(F.translate(t, "�■□", ""))
    # The replacement character is listed twice among the markers, so it counts twice.
    marks = marks + F.length(t) - F.length(F.translate(t, "�", ""))
    empty = F.trim(F.regexp_replace(t, r"\s+", " ")) == ""
    lost = t.rlike("[0-9]") & ~t.rlike("(?i)[₹$€£]|INR|USD|EUR|GBP") & (marks > 0)
    reason = (
        F.when(empty, F.lit("no extractable text layer (likely a scan)"))
        .when(marks >= 3, F.concat(marks.cast("string"), F.lit(" unmapped glyphs in the text layer (currency symbols are probably being lost)")))
        .when(lost, F.lit("prices present but no currency marker survived extraction"))
    )
    return F.struct(reason.isNotNull().alias("rejected"), F.coalesce(reason, F.lit("")).alias("reason"))


def in_parts(text: Column | str, limit: int = V.MAX_DOC_CHARS) -> Column:
    """STRUCT(parts, over_limit): the whole text in parts that a reader with a size limit takes one by one, each with its offset."""
    t = F.coalesce(as_col(text), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(limit))
    parts = F.transform(starts, lambda i: F.struct(i.alias("offset"), F.substr(t, i + 1, F.lit(limit)).alias("text")))
    return F.struct(parts.alias("parts"), (F.length(t) > limit).alias("over_limit"))
