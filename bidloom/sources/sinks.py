"""Persisting a comparison as tables, replacing its award, and exporting the report set.

A stored comparison is a folder of tables that are never overwritten and of
commits. A commit is one small file that names the folder of every table; it is
written after them and appears as a whole, so a reader sees the state of one commit
or of the one before, on a file system or an object store. What a supplier did not
quote is stored as runs of lines and expanded only when it is read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.operators.grid import comparison_view, not_quoted_cells
from bidloom.session import delete_folder

AWARD_SCHEMA = (
    "rfx_sku string, description string, quantity bigint, winner string, price double, extended double, runner_up string, "
    "runner_up_price double, saving_per_unit double, extended_saving double, contenders bigint, status string, reason string"
)
AWARD_COLUMNS = tuple(c.split()[0] for c in AWARD_SCHEMA.split(", "))
#: What a reader is given.
TABLES = ("rfx_lines", "vendors", "questionnaire", "terms", "quotes", "award", "comparison")
COMMIT = "number bigint, id string, folders map<string,string>"


def edge_form(df: DataFrame) -> DataFrame:
    """Lists joined with commas and flags as 0/1, the way the SQL surface shows them."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            F.array_join(c, ",").alias(c) if kinds[c].startswith("array") else (F.col(c).cast("int").alias(c) if kinds[c] == "boolean" else F.col(c))
            for c in df.columns
        ]
    )


def empty_award(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], AWARD_SCHEMA)


def write_comparison(tables: dict[str, DataFrame], path: str) -> None:
    """Store the tables of `Comparison.stored()`. The award starts empty: it belongs to the next recommendation."""
    spark = next(iter(tables.values())).sparkSession
    folders = {name: _write(frame, path, name) for name, frame in tables.items()}
    _commit(spark, path, folders | {"award": _write(empty_award(spark), path, "award")})


def write_award(lines: DataFrame, path: str) -> None:
    """Replace the stored recommendation only; the other tables are those of the last commit."""
    last = _last_commit(lines.sparkSession, path)
    if last is None:
        raise ValueError(f"no comparison is stored in {path}")
    _commit(lines.sparkSession, path, last["folders"] | {"award": _write(lines.select(*AWARD_COLUMNS), path, "award")})


def open_comparison(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the last commit, by the names users query; what was not stored is left out."""
    last = _last_commit(spark, path)
    if last is None:
        raise ValueError(f"no comparison is stored in {path}")
    t = {name: spark.read.parquet(folder) for name, folder in last["folders"].items()}
    cells, gaps = t.pop("cells"), t.pop("gaps")
    t["quotes"] = cells.unionByName(edge_form(not_quoted_cells(gaps, t["rfx_lines"])))
    t["comparison"] = comparison_view(t["quotes"], t["rfx_lines"], t["vendors"])
    return {name: t[name] for name in TABLES if name in t}


def prune(spark: SparkSession, path: str) -> None:
    """Delete the table folders that the last commit does not name. Readers of older commits must be done."""
    commits = _commits(spark, path)
    kept = set(_last_commit(spark, path)["folders"].values())
    for folder in {f for c in commits.collect() for f in c["folders"].values()} - kept:
        delete_folder(spark, folder)


def _write(frame: DataFrame, path: str, name: str) -> str:
    folder = f"{path}/tables/{name}-{uuid.uuid4().hex}"
    edge_form(frame).write.parquet(folder)
    return folder


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMIT).option("recursiveFileLookup", True).json(f"{path}/commits")


def _last_commit(spark: SparkSession, path: str) -> dict | None:
    try:
        top = _commits(spark, path).agg(F.max_by(F.struct("number", "folders"), F.struct("number", "id")).alias("top")).first()["top"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return top and {"number": top["number"], "folders": dict(top["folders"])}


def _commit(spark: SparkSession, path: str, folders: dict[str, str]) -> None:
    last = _last_commit(spark, path)
    number, name = (last["number"] + 1 if last else 1), uuid.uuid4().hex
    spark.createDataFrame([(number, name, folders)], COMMIT).coalesce(1).write.json(f"{path}/commits/{number:09d}-{name}")


def export_reports(reports: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """The report set (audit trail, grids, needs attention, quality, suppliers), one folder each."""
    for name, frame in reports.items():
        writer = edge_form(frame).write.mode("overwrite")
        writer.option("header", True).csv(f"{path}/{name}") if fmt == "csv" else writer.parquet(f"{path}/{name}")
