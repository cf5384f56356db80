"""Substring search by trigrams.

Texts are numbered in blocks of 63; for every trigram and block a long says which
texts of the block hold it. The texts that hold all trigrams of a pattern come
from the conjunction of these; they alone are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.search import holds
from quarrylight.scratch import settle

#: Texts of a block: the bits of a long without its sign.
BLOCK = 63
#: Bits of a character; three of them are a long without its sign.
CHAR = 21


def grams_of(text: str) -> np.ndarray:
    """The distinct trigrams of a text, each packed into a long."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 2 * CHAR | c[1:-1] << CHAR | c[2:])


def postings_of(block: int, slots: list[np.ndarray], grams: list[np.ndarray]) -> pd.DataFrame:
    """gram, block, texts of one block."""
    gram = np.concatenate(grams)
    order = np.argsort(gram, kind="stable")
    gram, bit = gram[order], np.int64(1) << np.concatenate(slots)[order]
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    return pd.DataFrame({"gram": gram[first], "block": block, "texts": np.bitwise_or.reduceat(bit, first)})


def block_postings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Postings from rows (block, slot, lower-cased texts), whose blocks follow
    each other; one block is held at a time."""
    now, slots, grams = None, [], []
    for frame in frames:
        for block, slot, *texts in frame.itertuples(index=False, name=None):
            if block != now and grams:
                yield postings_of(now, slots, grams)
                slots, grams = [], []
            now = block
            for text in texts:
                if text is not None and len(text) > 2:
                    grams.append(grams_of(text))
                    slots.append(np.full(len(grams[-1]), slot, np.int64))
    if grams:
        yield postings_of(now, slots, grams)


class TrigramIndex:
    """Postings of some text columns of a table; key tells rows apart.

    A null text holds nothing. Patterns under three characters have no trigram:
    for these every text is looked at. The texts are dealt out to all tasks and
    kept with their numbers, so that a search has no need to join by key."""

    def __init__(self, docs: DataFrame, key: str, columns: list[str]):
        self.names, self.key, self.columns = docs.columns, key, columns
        spread = docs.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, key).withColumn("_id", F.monotonically_increasing_id())
        numbered = spread.select(*self.names, F.expr(f"_id div {BLOCK}").alias("_block"), (F.col("_id") % BLOCK).cast("int").alias("_slot"))
        self.docs = settle(numbered, "trigram-texts")
        # A block whose file is read by two tasks gives a gram two rows.
        low = self.docs.select("_block", "_slot", *[F.lower(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
        bits = low.mapInPandas(block_postings, "gram long, block long, texts long")
        self.postings = settle(bits.repartition("gram").sortWithinPartitions("gram", "block"), "trigrams")

    def near(self, pattern: str) -> DataFrame:
        """_block and the texts of it that hold every trigram of the pattern, in
        any of the columns and order. It is written, so that its size decides
        whether the texts have to be moved to join it."""
        low = pattern.lower()
        grams = sorted({int(g) for g in grams_of(low)})
        each = self.postings.filter(F.col("gram").isin(grams)).groupBy("block", "gram").agg(F.bit_or("texts").alias("texts"))
        own = each.groupBy("block").agg(F.bit_and("texts").alias("_texts"), F.count("*").alias("n")).filter((F.col("n") == len(grams)) & (F.col("_texts") != 0))
        return settle(own.select(F.col("block").alias("_block"), "_texts"), "trigram-blocks")

    def candidates(self, pattern: str) -> DataFrame:
        """Keys of the texts that hold every trigram of the pattern."""
        return self.docs.join(self.near(pattern), "_block").filter(self.marked()).select(self.key)

    def marked(self) -> Column:
        return F.getbit("_texts", "_slot") == 1

    def search(self, pattern: str) -> DataFrame:
        """Rows with the pattern as a substring of a column, ignoring case."""
        hit = holds(pattern, self.columns)
        if len(pattern.lower()) < 3:
            return self.docs.filter(hit).select(self.names)
        # Both in one condition: alone, the second would move below the join and
        # look at every text.
        found = self.docs.join(self.near(pattern), "_block").filter(F.when(self.marked(), hit).otherwise(False))
        return found.select(self.names)
