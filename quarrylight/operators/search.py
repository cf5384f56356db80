"""Full-text ranking, substring search and merged results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.scratch import settle

TOKEN = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75
LIMIT, MOST = 10, 50


def query_terms(query: str) -> list[str]:
    """The distinct terms of a query; characters with a meaning in query
    languages are separators."""
    import re

    return sorted(set(re.findall(r"[^\W_]+", query.lower())))


def equals(term: str):
    return lambda t: t == F.lit(term)


def tokens_of(text_cols: list[str]) -> Column:
    """The lower-cased letter and digit runs of all columns."""
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols])), F.lit(TOKEN), F.lit(0))


def postings(docs: DataFrame, key: str, text_cols: list[str]) -> DataFrame:
    """term, key, tf, dl for every distinct term of a row; a row with the empty
    term stands for each text itself, so that all of them count."""
    rows = docs.select(key, tokens_of(text_cols).alias("tokens")).select(key, "tokens", F.size("tokens").cast("long").alias("dl"))
    each = rows.select(key, "dl", F.explode("tokens").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    whole = rows.select(F.lit("").alias("term"), key, F.lit(0).cast("long").alias("tf"), "dl")
    return each.select("term", key, "tf", "dl").unionByName(whole)


def ranked(counts: DataFrame, stats: DataFrame, key: str, n_terms: int, k1: float, b: float) -> DataFrame:
    """key, score from rows that hold every term: tf0, tf1, ... and dl; stats is
    one row: n, avgdl, df0, df1, ..."""
    joined = counts.join(F.broadcast(stats), F.lit(True))  # one row
    score = F.lit(0.0)
    for i in range(n_terms):
        tf, df = F.col(f"tf{i}").cast("double"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return joined.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), F.asc(key))


def bm25(docs: DataFrame, query: str, key: str, text_cols: list[str], limit: int | None = LIMIT, k1: float = K1, b: float = B) -> DataFrame:
    """key, score of the rows that hold every term, best first.

    Lengths and frequencies run over all named columns. Texts are tokenised
    once: a narrow table of lengths and frequencies of the query's terms is kept
    for the statistics and the ranking. No posting list is shuffled.
    """
    terms = query_terms(query)
    if not terms:
        return docs.filter("false").select(key, F.lit(0.0).alias("score"))
    counts = [F.size(F.filter("tokens", equals(x))).cast("long").alias(f"tf{i}") for i, x in enumerate(terms)]
    rows = settle(docs.select(key, tokens_of(text_cols).alias("tokens")).select(key, F.size("tokens").cast("long").alias("dl"), *counts), "bm25")
    stats = rows.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hits = rows.filter(" AND ".join(f"tf{i} > 0" for i in range(len(terms))))
    best = ranked(hits, stats, key, len(terms), k1, b)
    return best if limit is None else best.limit(min(limit, MOST))


def bm25_indexed(index: DataFrame, query: str, key: str, limit: int | None = LIMIT, k1: float = K1, b: float = B) -> DataFrame:
    """As bm25, from postings: the terms' filter reaches the scan."""
    terms = query_terms(query)
    if not terms:
        return index.filter("false").select(key, F.lit(0.0).alias("score"))
    own = index.filter(F.col("term").isin(terms))
    tf = [F.sum(F.when(F.col("term") == x, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, x in enumerate(terms)]
    hits = own.groupBy(key).agg(F.max("dl").alias("dl"), *tf).filter(" AND ".join(f"tf{i} > 0" for i in range(len(terms))))
    whole = index.filter("term = ''").agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    df = own.agg(*[F.count_if(F.col("term") == x).alias(f"df{i}") for i, x in enumerate(terms)])
    best = ranked(hits, whole.join(df, F.lit(True)), key, len(terms), k1, b)
    return best if limit is None else best.limit(min(limit, MOST))


def holds(query: str, columns: list[str]) -> Column:
    """Whether the query is a substring of any column, ignoring case; the
    query's wildcards are ordinary characters."""
    pattern = "%" + query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return hit


def contains(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows with the query as a substring of any column."""
    return df.filter(holds(query, columns))


def merge_results(*results: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """Result lists one after the other without repeats: pos, key."""
    union = None
    for i, r in enumerate(results):
        w = Window.orderBy(*[F.col(c.lstrip("-")).desc() if c.startswith("-") else F.col(c).asc() for c in order if c.lstrip("-") in r.columns] or [F.col(key)])
        part = r.limit(limit).select(F.lit(i).alias("src"), F.row_number().over(w).alias("rank"), F.col(key))
        union = part if union is None else union.unionByName(part)
    best = union.groupBy(key).agg(F.min(F.struct("src", "rank")).alias("at"))
    return best.orderBy("at.src", "at.rank", key).limit(limit).select(key, F.row_number().over(Window.orderBy("at.src", "at.rank", key)).alias("pos"))
