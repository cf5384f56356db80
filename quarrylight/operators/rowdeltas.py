"""Row deltas: a table as a base and the rows that have changed since."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQ, GONE = "_seq", "_gone"


def as_upserts(rows: DataFrame, columns: list[str], seq: int) -> DataFrame:
    """Whole rows that replace those of the same key."""
    return rows.select(*columns, F.lit(seq).cast("long").alias(SEQ), F.lit(False).alias(GONE))


def as_tombstones(keys: DataFrame, key_columns: list[str], schema, seq: int) -> DataFrame:
    """Rows that end a key."""
    columns = [F.col(f.name) if f.name in key_columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return keys.select(*key_columns).distinct().select(*columns, F.lit(seq).cast("long").alias(SEQ), F.lit(True).alias(GONE))


def latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of every key: its columns and ``_gone``."""
    columns = [c for c in changes.columns if c not in (*keys, SEQ)]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*columns), SEQ).alias("_row"))
    return last.select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def merged(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table as it is now: base rows that no change names, and the last
    change of every key unless it ends it.

    changes: the columns of base, ``_seq`` (later changes have greater numbers)
    and ``_gone``. Filters on the keys reach the scan of the base and of the
    changes. Keys are not null."""
    now = latest(changes, keys)
    kept = base.join(changes.select(*keys).distinct(), keys, "left_anti")
    return kept.select(base.columns).unionByName(now.filter(~F.col(GONE)).select(base.columns))
