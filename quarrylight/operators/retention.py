"""Latest rows and retention caps, overall and per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SESSIONS, CHANGES = 10, 20


def latest(df: DataFrame, time_col: str, tie_col: str, n: int) -> DataFrame:
    """The n latest rows (rows without a time last): a top-k, not a sort."""
    return df.orderBy(F.col(time_col).desc_nulls_last(), F.col(tie_col).desc()).limit(n)


def latest_per_key(df: DataFrame, key: str, time_col: str, tie_col: str, n: int) -> DataFrame:
    """The n latest rows of every key, with their rank as ``pos``. The rank
    filter lets Spark cut groups before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(time_col).desc_nulls_last(), F.col(tie_col).desc())
    return df.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)
