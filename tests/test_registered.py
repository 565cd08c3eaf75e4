"""Registered queries beside their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, compare

DATA = Path("/root/testdata/sf0.001")
CHECKED = [
    "award_lines", "normalized_quotes", "coverage_gaps", "scorecards", "dimension_match", "reply_attribution", "edit_log_fold", "consolidated_award", "invite_tokens",
    "unique_item_codes", "document_limits", "guarded_sql", "price_matrix", "question_log_fold", "merged_questions", "document_lines", "placeholder_codes",
    "credited_replies", "stored_comparison", "sql_shown", "ladder_cells", "consolidated_suppliers", "effect_of_quality", "derived_criteria", "folder_lines",
    "request_catalogue", "vendor_directory",
]


@pytest.mark.skipif(not DATA.exists(), reason="test tables not present")
@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rows, problems = compare(spark, con, str(DATA), name, entry.oracle_sql()[name])
    assert rows > 0 and not problems


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="test tables not present")
def test_consolidation_of_the_whole_comparison(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rows, problems = compare(spark, con, str(DATA), "consolidated_plan", entry.oracle_sql()["consolidated_plan"])
    assert not problems and rows == 2 * con.sql("SELECT count(*) FROM part").fetchall()[0][0]
