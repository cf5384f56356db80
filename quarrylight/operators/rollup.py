"""Counts, histograms and directory roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.scalar import confidence_bucket, path_parent, path_prefixes


def directory_rollup(files: DataFrame, path_col: str = "path") -> DataFrame:
    """path, file_count of every folder above a file, '.' for the root. A
    file's folders are counted map-side, so one row a folder and task moves."""
    spread = files.select(F.explode(F.concat(F.array(F.lit(".")), path_prefixes(F.col(path_col)))).alias("path"))
    return spread.groupBy("path").agg(F.count("*").alias("file_count"))


def group_counts(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows per non-null key."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))


def confidence_histogram(df: DataFrame, column: str = "confidence") -> DataFrame:
    return df.groupBy(confidence_bucket(F.col(column)).alias("bucket")).agg(F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: each table scanned once, without columns."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def condition_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """All conditional counts in one pass."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def delta_counts(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """What has been removed per count, never below zero; both inputs are one
    row."""
    a = before.select(*[F.col(c).alias(f"_{c}") for c in columns])
    return a.join(after, F.lit(True)).select(*[F.greatest(F.lit(0), F.col(f"_{c}") - F.col(c)).alias(c) for c in columns])


def folded_tree(files: DataFrame, target: str, path_col: str = "path", directories: DataFrame | None = None) -> DataFrame:
    """line_no-ordered entries (kind, entry) of a folded tree: the direct files
    of the target's folder, the target marked, and every other top-level folder
    as one entry with its number of files and, where known, its summary."""
    own = target.rpartition("/")[0] or "."
    top = target.split("/")[0] if "/" in target else "."
    p = F.col(path_col)
    here = files.filter(path_parent(p) == own).select(F.lit("file").alias("kind"), F.concat(p, F.when(p == target, F.lit(" (TARGET)")).otherwise("")).alias("entry"))
    rest = files.filter(F.instr(p, "/") > 0).select(F.substring_index(p, "/", 1).alias("dir")).filter(F.col("dir") != top).groupBy("dir").agg(F.count("*").alias("n"))
    if directories is not None:
        rest = rest.join(directories.select(F.col("path").alias("dir"), "summary"), "dir", "left")
    else:
        rest = rest.withColumn("summary", F.lit(None).cast("string"))
    note = F.concat(F.lit(" ["), F.col("n").cast("string"), F.lit(" files"), F.coalesce(F.concat(F.lit(" — "), F.nullif("summary", F.lit(""))), F.lit("")), F.lit("]"))
    return here.unionByName(rest.select(F.lit("folder").alias("kind"), F.concat("dir", F.lit("/"), note).alias("entry")))
