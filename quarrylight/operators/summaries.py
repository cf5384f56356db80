"""Selection of what needs a summary, and the payloads for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.scalar import stripped_answer


def with_members(groups: DataFrame, members: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """groups with an ordered array of their members' columns, empty for none."""
    lists = members.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("members"))
    kind = lists.schema["members"].dataType
    return groups.join(lists, key, "left").withColumn("members", F.coalesce("members", F.array().cast(kind)))


def needing_summary(files: DataFrame, tainted: DataFrame, key: str, force: bool = False, only: Column | None = None) -> DataFrame:
    """Files that are stale, lack a summary or hold something tainted;
    ``purpose_needs_update`` is False where taint is the only reason."""
    t = tainted.select(key).distinct().withColumn("_tainted", F.lit(True))
    rows = (files if only is None else files.filter(only)).join(t, key, "left")
    own = F.coalesce(F.col("is_stale"), F.lit(False)) | F.col("summary").isNull()
    if force:
        own = F.lit(True)
    return rows.withColumn("purpose_needs_update", own).filter(own | F.col("_tainted").isNotNull()).drop("_tainted")


#: What a summariser answers, per file.
ANSWER = "array<struct<path:string,purpose:string,summary:string,danger:string,purpose_needs_update:boolean,functions:array<struct<id:string,summary:string,summary_long:string,danger:string>>>>"


def parsed_answers(answers: DataFrame, column: str = "answer") -> DataFrame:
    """One row a file from answer texts; ``error`` says why an answer gave none."""
    text = stripped_answer(F.col(column))
    parsed = answers.select(text.alias("text"), F.from_json(text, ANSWER).alias("files"))
    bad = F.when(F.length("text") == 0, "empty answer").when(F.col("files").isNull(), "not a JSON list")
    return parsed.select(bad.alias("error"), F.explode_outer("files").alias("file")).select("error", "file.*")
