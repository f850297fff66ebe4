"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dunegrid.session import ensure_on_executors, materialize

#: What separates words everywhere in this subpackage: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows per Arrow batch.  Rows hold whole documents, so the default of 10,000 is
#: too many for a worker's memory; a session that sets its own value keeps it.
ARROW_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Make the package importable on the workers and bound the Arrow batches."""
    ensure_on_executors(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def word_count(col: str = "text") -> Column:
    """Number of words of a text (NULL: 0)."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def slices(n: int, weights: Sequence[int], limit: int):
    """Ranges [a, b) over n rows whose weights sum to about ``limit`` at most."""
    a, w = 0, 0
    for i in range(n):
        if i > a and w + weights[i] > limit:
            yield a, i
            a, w = i, 0
        w += weights[i]
    if n > a:
        yield a, n


def stored(df: DataFrame, name: str, rows: int, rows_per_task: int = 25_000) -> DataFrame:
    """``materialize`` with about one task per ``rows_per_task`` of the ``rows``
    expected, so that small tables of an iteration are not hundreds of files."""
    return materialize(df.coalesce(max(1, -(-int(rows) // rows_per_task))), name)
