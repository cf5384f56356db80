"""A full-text index in immutable segments, ranked with early termination.

A segment holds the postings of the texts that one commit has added, in blocks of
texts of like length; for every term and block the greatest frequency and the
least length; what the commit adds to, or takes from, each term's number of texts;
and the keys whose earlier postings it has ended. Statistics are sums over all
segments, so they are exact at any time. A search bounds the score in each block,
reads the most promising ones, and then only those that the worst of the best so
far does not exclude.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.incremental import only_keys
from quarrylight.operators.search import B, K1, LIMIT, query_terms, tokens_of
from quarrylight.scratch import remove

#: Segments before the newest are merged.
MOST = 8
#: 2^BLOCK_BITS texts are a block.
BLOCK_BITS = 6
#: Blocks that a search reads at first.
FIRST = 32


def in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, dl and more) with ``block``: texts of like length together."""
    placed = rows.repartitionByRange("dl", key).sortWithinPartitions("dl", key)
    return placed.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))


def write_postings(postings: DataFrame, path: str) -> None:
    """term, block, key, tf, dl, seq in the order of terms and blocks, and the
    bounds of every block."""
    spark = postings.sparkSession
    postings.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(f"{path}/postings")
    bounds = spark.read.schema(postings.schema).parquet(f"{path}/postings").groupBy("term", "block", "seq").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"))
    bounds.repartitionByRange("term").sortWithinPartitions("term", "block").write.parquet(f"{path}/blocks")


def counted(rows: DataFrame, path: str, key: str, text_cols: list[str]) -> DataFrame:
    """key, dl, terms (term, tf) of texts, which are dealt out to all tasks and
    tokenised once: written to path."""
    tokens = rows.select(key, *text_cols).repartition(key).select(key, tokens_of(text_cols).alias("tokens"))
    # A text without a term stays, by a null one.
    each = tokens.select(key, F.size("tokens").cast("long").alias("dl"), F.explode_outer("tokens").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    whole = each.groupBy(key, "dl").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("terms"))
    whole.write.parquet(path)
    return rows.sparkSession.read.schema(whole.schema).parquet(path)


def write(added: DataFrame, removed: DataFrame | None, path: str, seq: int, key: str, text_cols: list[str]) -> int:
    """A segment of the texts ``added`` and of the former ones ``removed``;
    returns the number of texts added. Keys are unique in each."""
    spark = added.sparkSession
    new = counted(added, f"{path}/added", key, text_cols)
    old = None if removed is None else counted(removed, f"{path}/removed", key, text_cols)
    each = in_blocks(new, key).select(key, "dl", "block", F.explode("terms").alias("t"))
    write_postings(each.select("t.term", "block", key, "t.tf", "dl", F.lit(seq).cast("long").alias("seq")), path)

    def counts(df: DataFrame, sign: int) -> DataFrame:
        terms = df.select(F.explode("terms.term").alias("term"), F.lit(0).cast("long").alias("dl"))
        both = terms.unionByName(df.select(F.lit("").alias("term"), "dl"))
        return both.groupBy("term").agg((sign * F.count("*")).alias("df"), (sign * F.sum("dl")).alias("length"))

    stats = counts(new, 1)
    if old is not None:
        stats = stats.unionByName(counts(old, -1)).groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))
    stats.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    ended = (new if old is None else old).select(key, F.lit(seq).cast("long").alias("seq"))
    (ended.limit(0) if old is None else ended).write.parquet(f"{path}/gone")
    n = new.count()
    for name in ("added", "removed"):
        remove(spark, f"{path}/{name}")
    return n


class Index:
    """Segments (path, seq) from the oldest to the newest."""

    def __init__(self, spark: SparkSession, key: str, parts: list[tuple[str, int]]):
        self.spark, self.key, self.parts = spark, key, parts
        #: Blocks with all terms, and those that the last search has read.
        self.matching = self.read_blocks = 0

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{path}/{name}" for path, _ in self.parts])

    def live(self, postings: DataFrame) -> DataFrame:
        """Postings that no later segment has ended."""
        ended = self.table("gone").groupBy(self.key).agg(F.max("seq").alias("_ended"))
        return postings.join(ended, self.key, "left").filter("_ended IS NULL OR _ended <= seq").drop("_ended")

    def statistics(self, terms: list[str]) -> dict[str, tuple[int, int]]:
        rows = self.table("terms").filter(F.col("term").isin(["", *terms])).groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))
        return {r.term: (r.df, r.length) for r in rows.collect()}  # a row a term of the query

    def search(self, query: str, limit: int | None = LIMIT, k1: float = K1, b: float = B) -> DataFrame:
        """key, score of the texts that hold every term, best first: as
        ``search.bm25`` over the texts as they are now."""
        terms = query_terms(query)
        known = self.statistics(terms) if terms and self.parts else {}
        if not terms or any(known.get(t, (0, 0))[0] <= 0 for t in terms):
            kind = self.table("gone").schema[self.key].dataType.simpleString() if self.parts else "string"
            return self.spark.createDataFrame([], f"`{self.key}` {kind}, score double")
        n, length = known[""]
        idf = {t: max(math.log((n - known[t][0] + 0.5) / (known[t][0] + 0.5)), 1e-6) for t in terms}

        def part(t: str, tf: Column, dl: Column) -> Column:
            tf = tf.cast("double")
            return F.lit(idf[t]) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (length / n)))

        def scored(postings: DataFrame) -> DataFrame:
            tf = [F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(terms)]
            rows = self.live(postings).groupBy(self.key).agg(F.max("dl").alias("dl"), *tf).filter(" AND ".join(f"tf{i} > 0" for i in range(len(terms))))
            score = F.lit(0.0)
            for i, t in enumerate(terms):
                score = score + part(t, F.col(f"tf{i}"), F.col("dl"))
            return rows.select(self.key, F.round(score, 6).alias("score"))

        postings = self.table("postings").filter(F.col("term").isin(terms))
        order = [F.desc("score"), F.asc(self.key)]
        if limit is None:
            return scored(postings).orderBy(*order)
        bound = F.lit(None).cast("double")
        for t in terms:
            bound = F.when(F.col("term") == t, part(t, F.col("tf"), F.col("dl"))).otherwise(bound)
        blocks = self.table("blocks").filter(F.col("term").isin(terms)).groupBy("seq", "block").agg(F.sum(bound).alias("bound"), F.count("*").alias("n")).filter(F.col("n") == len(terms)).persist()
        try:
            self.matching = blocks.count()
            # Blocks of other segments with the same number only add to what is read.
            head = [r.block for r in blocks.orderBy(F.desc("bound")).limit(FIRST).collect()]
            best = scored(postings.filter(F.col("block").isin(head))).orderBy(*order).limit(limit)
            found = best.collect()  # at most ``limit``
            best = self.spark.createDataFrame(found, best.schema)
            least = found[-1].score - 2e-6 if len(found) == limit else -1.0
            rest = blocks.filter((F.col("bound") >= least) & ~F.col("block").isin(head)).select("block")
            more = rest.count()
            self.read_blocks = len(head) + more
            if more:
                best = best.unionByName(scored(only_keys(postings, "block", rest)))
        finally:
            blocks.unpersist()
        return best.groupBy(self.key).agg(F.max("score").alias("score")).orderBy(*order).limit(limit)

    def merge(self, path: str, older: bool) -> int:
        """Writes one segment for all of these, without what has ended; returns
        its number of texts. older: there are segments before these, so ended
        keys are kept. The segments follow each other."""
        seq = self.parts[-1][1]
        postings = self.live(self.table("postings"))
        texts = in_blocks(postings.groupBy(self.key).agg(F.max("dl").alias("dl")), self.key).select(self.key, "block")
        write_postings(postings.drop("block").join(texts, self.key).select("term", "block", self.key, "tf", "dl", F.lit(seq).cast("long").alias("seq")), path)
        stats = self.table("terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).filter("df <> 0 OR term = ''")
        stats.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        gone = self.table("gone").select(self.key).distinct().withColumn("seq", F.lit(seq).cast("long"))
        (gone if older else gone.limit(0)).write.parquet(f"{path}/gone")
        return max(0, self.spark.read.parquet(f"{path}/terms").filter("term = ''").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0])
