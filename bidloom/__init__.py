"""bidloom: supplier-quotation comparison as Spark jobs.

Every job takes DataFrames and returns DataFrames. Nothing is collected to the
driver except one-row summaries, loop tests and explicit pivot column lists.
"""

from bidloom.session import checkpoint, spark_session

__all__ = ["checkpoint", "spark_session"]
__version__ = "0.1.0"
