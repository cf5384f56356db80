"""A training-corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it
as Parquet in the shared folder and hands the read of it to the next stage. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm import decontam, lines, packing, simhash, toxicity
from quarrylight.llm.common import settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold. A null, empty
    or wordless text has the base score and stays; rows that share an id, or have
    none, are judged one by one. Without labels nothing is dropped."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document holds; n_chars follows
    the text. A document that loses every line stays, with an empty text, as
    does a null text. Rows without an id own and lose no lines; rows that share
    one are one document."""
    out = lines.deduplicate_lines(docs)
    return out.select(*[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near copies:
    in each link the sets of five-word shingles are similar to 0.8 or more.
    Rows that share an id are judged each by its own text; of rows that share
    id and text one stays. Wordless texts are copies of each other. Rows without
    an id link others and stay."""
    keep = simhash.near_copies(docs, width=5, similarity=0.8).toDF("ql_id", "ql_th")
    th = next(c for n in range(9) if (c := f"ql_text_{n}") not in docs.columns)
    own = docs.filter("doc_id IS NOT NULL").withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    own = own.join(keep, (F.col("doc_id") == F.col("ql_id")) & (F.col(th) == F.col("ql_th")), "left_semi")
    rank = F.row_number().over(Window.partitionBy("doc_id", th).orderBy(F.xxhash64(*[c for c in docs.columns if c != "text"])))
    one = own.select(*docs.columns, rank.alias(th)).filter(F.col(th) == 1)
    return one.select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none;
    rows that share an id, or have none, are searched one by one. An empty
    benchmark drops nothing."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences: as operator 7, with a digest of the ids.
    A null or empty text is the end id alone; rows that share an id, or have
    none, are documents of their own."""
    return packing.pack(docs, payload="crc32").drop("ids")


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("simhash_near_dedup", dedup_near), ("decontamination", decontaminate), ("packing", pack)]

#: Scores, fingerprints and token ids are beyond SQL; tests hold run() against
#: a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
