"""The queries on the words of documents, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.heavy import heavy_hitters
from millrace.sources.tables import table

#: The share of all words beyond which one is heavy.
SHARE = 0.002


def heavy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that make up more than a five-hundredth of all words of all documents."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))
    return heavy_hitters(table(spark, sf_dir, "documents"), words, SHARE)


_FOUND = {
    "heavy_words": (
        heavy_words,
        f"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS value FROM documents)
        SELECT value, count(*) AS n, (SELECT count(*) FROM w) AS total FROM w GROUP BY value HAVING count(*) > {SHARE} * (SELECT count(*) FROM w)""",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items()}
