"""A corpus pipeline over `documents`: each stage works on everything its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. All stages but
the last return the columns of `documents`; extra columns of the input travel
along. Null ids, null sources, null and empty texts, repeated rows and an empty
table have the results that the operators define.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from bidloom.llm import mixing, ngram_join, pieces, quality_rules, suffix_dedup
from bidloom.llm.tables import table
from bidloom.session import Scratch, delete_folder

#: Folders of intermediate tables that earlier stages made.
_left: list[str] = []


def stage(function):
    """A stage that first clears what earlier stages left behind, unless `docs` is still read from it.

    A stage's result is written before the next one reads it, so its intermediate tables are of no use then.
    """

    @wraps(function)
    def run_stage(spark, docs, sf_dir):
        read = docs.inputFiles() if _left else []
        for root in [r for r in _left if not any("/" + r.rsplit("/", 1)[1] + "/" in f for f in read)]:
            delete_folder(spark, root)
            _left.remove(root)
        mark = len(Scratch.roots)
        out = function(spark, docs, sf_dir)
        _left.extend(Scratch.roots[mark:])
        return out

    return run_stage


@stage
def good_documents(spark, docs, sf_dir):
    """Documents that the quality rules do not reject."""
    return quality_rules.filter_documents(docs)


@stage
def one_of_each_group(spark, docs, sf_dir):
    """One row, of the least id, of every group linked by five-word shingles at similarity 0.8 or more."""
    return ngram_join.keep_one_row(docs)


@stage
def without_repeated_passages(spark, docs, sf_dir):
    """Documents without the byte strings of 400 or more that occur elsewhere; `n_chars` follows the text."""
    return suffix_dedup.remove_repeats(docs, length="n_chars")


@stage
def mix(spark, docs, sf_dir):
    """Documents once per copy that the mix of sources takes."""
    return mixing.mix_documents(docs)


@stage
def tokens(spark, docs, sf_dir):
    """Every document's piece numbers beside its columns."""
    done = pieces.encoded(docs, keep=tuple(docs.columns))
    return done.select("doc.*", F.size("ids").cast("bigint").alias("n_pieces"), "ids")


STAGES = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeated_passages),
    ("mixing sources", mix),
    ("SentencePiece encoding", tokens),
]

#: The byte spans and the pieces have no SQL form; tests/llm compares run() with plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, function in STAGES[:-1]:
        docs = scratch.save(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
