"""Change detection and merges between an old and a new state of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.scalar import decayed, patched


def hash_diff(old: DataFrame, new: DataFrame, key: str, content: str, semantic: str) -> DataFrame:
    """key, status, and both states' hashes: new, unchanged, formatting (only
    the bytes differ), changed, or removed. One full outer join on the key."""
    a, b = old.select(key, F.col(content).alias("old_content"), F.col(semantic).alias("old_semantic"), F.lit(True).alias("_a")), new.select(key, F.col(content).alias("new_content"), F.col(semantic).alias("new_semantic"), F.lit(True).alias("_b"))
    status = (
        F.when(F.col("_a").isNull(), "new")
        .when(F.col("_b").isNull(), "removed")
        .when(F.col("old_content").eqNullSafe(F.col("new_content")), "unchanged")
        .when(F.col("old_semantic").eqNullSafe(F.col("new_semantic")), "formatting")
        .otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, status.alias("status"), "old_content", "new_content", "old_semantic", "new_semantic")


def carry_over(old: DataFrame, new: DataFrame, key: str, semantic: str, meta: list[str], now: Column, reset_taint: bool = False) -> DataFrame:
    """The new state with the old one's descriptions.

    New rows start without descriptions, at full confidence and stale; rows of
    the same semantic hash keep everything; changed rows keep their
    descriptions, decay once and turn stale. ``meta`` names the carried columns.
    """
    o = old.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in [*meta, semantic, "confidence", "is_stale", "updated_at"]], F.lit(True).alias("_known"))
    joined = new.join(o, key, "left")
    known, same = F.col("_known").isNotNull(), F.col(f"_{semantic}").eqNullSafe(F.col(semantic))
    out = {c: F.col(f"_{c}") for c in meta}
    out["confidence"] = F.when(~known, F.lit(1.0)).when(same, F.col("_confidence")).otherwise(decayed(F.col("_confidence")))
    out["is_stale"] = F.when(known & same, F.col("_is_stale")).otherwise(F.lit(True))
    out["updated_at"] = F.when(known & same, F.col("_updated_at")).otherwise(now)
    keep = [c for c in new.columns if c not in out]
    return joined.select(*keep, *[v.alias(c) for c, v in out.items()])


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table plus those rows whose key it lacks, one a key."""
    fresh = rows.dropDuplicates(keys).join(table.select(*keys).distinct(), keys, "left_anti")
    return table.unionByName(fresh.select(table.columns))


def patch(table: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Text columns replaced where the update has a non-empty value."""
    u = updates.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = table.join(u, key, "left")
    return joined.select(*[patched(F.col(f"_{c}"), table[c]).alias(c) if c in columns else table[c] for c in table.columns])


def replace_group(table: DataFrame, rows: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """Rows of the given groups deleted and replaced."""
    return table.join(groups.select(key).distinct(), key, "left_anti").unionByName(rows.select(table.columns))


def cache_hits(disk: DataFrame, index: DataFrame, key: str, mtime: str, size: str, tolerance: float = 0.01) -> DataFrame:
    """key, hit: True where the index has the file at this size and, within the
    tolerance, this time of change. Unknown files and nulls are misses."""
    i = index.select(key, F.col(mtime).alias("_mtime"), F.col(size).alias("_size"))
    same = (F.abs(F.col(mtime) - F.col("_mtime")) < tolerance) & (F.col(size) == F.col("_size"))
    return disk.join(i, key, "left").select(key, F.coalesce(same, F.lit(False)).alias("hit"))


def validation(staged: DataFrame, index: DataFrame, key: str, semantic: str, stale: str | None = None) -> DataFrame:
    """key, status of staged files: skipped (not parseable: no hash), not
    indexed, stale or checked."""
    i = index.select(key, F.col(semantic).alias("_h"), *([F.col(stale).alias("_s")] if stale else []), F.lit(True).alias("_known"))
    is_stale = ~F.col("_h").eqNullSafe(F.col(semantic))
    if stale:
        is_stale = is_stale | F.coalesce(F.col("_s"), F.lit(False))
    status = F.when(F.col(semantic).isNull(), "skipped").when(F.col("_known").isNull(), "not_indexed").when(is_stale, "stale").otherwise("checked")
    return staged.join(i, key, "left").select(key, status.alias("status"))
