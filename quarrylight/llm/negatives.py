"""Hard-negative mining by blocked dense matrix products (operator 12).

Anchors are dealt into blocks of bounded bytes; each block is broadcast and met
by every row, in batches, as one float64 product (exact: the components are
integers and every sum stays far below 2^53). A first pass keeps each anchor's
best positives, a second the best negatives inside the window of scores that
each positive opens. A task keeps only the best so far; what tasks keep is merged
by a ranked window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import settle, table

#: Bytes of the float64 components of one broadcast block of anchors.
ANCHOR_BYTES = 16 << 20
#: Rows of a product: anchors x candidates.
TILE_ANCHORS, TILE_ROWS = 512, 2048
#: Sums below this leave room for the column number behind the score.
EXACT = 1 << 46
LOW, NONE = -(1 << 62), (1 << 63) - 1


def matrix(column, dims: int) -> np.ndarray:
    """The vectors of a list column as float64; missing components are zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def quantised(vectors: np.ndarray, scale: float) -> np.ndarray:
    most = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.floor(np.clip(vectors * scale, -most, most))


def exact_integers(vectors: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in vectors], dtype=object).reshape(vectors.shape)


class Best:
    """For each anchor and slot the ``k`` best scores with their ids."""

    def __init__(self, anchors: int, slots: int, k: int, wide: bool):
        self.k, self.wide = k, wide
        self.score = np.full((anchors, slots, k), LOW, dtype=object if wide else np.int64)
        self.id = np.full((anchors, slots, k), NONE, dtype=np.int64)

    def floor(self, rows: slice, slot: int) -> np.ndarray:
        """What a score must reach to be among the best."""
        return self.score[rows, slot, -1]

    def offer(self, start: int, slot: int, scores: np.ndarray, good: np.ndarray, ids: np.ndarray) -> None:
        """scores: anchors from ``start`` x candidates, which are in order of ids."""
        rows = np.flatnonzero(good.any(axis=1))
        if not len(rows):
            return
        if self.wide:
            for r in rows:
                own = [(-s, i) for s, i in zip(self.score[start + r, slot], self.id[start + r, slot]) if i != NONE or s != LOW]
                own = sorted(own + [(-scores[r, c], int(ids[c])) for c in np.flatnonzero(good[r])])[: self.k]
                for at, (s, i) in enumerate(own):
                    self.score[start + r, slot, at], self.id[start + r, slot, at] = -s, i
            return
        n = scores.shape[1]
        keys = np.where(good[rows], scores[rows] * n + np.arange(n - 1, -1, -1), LOW)
        if n > self.k:
            cols = np.argpartition(keys, n - self.k, axis=1)[:, -self.k :]
        else:
            cols = np.broadcast_to(np.arange(n), (len(rows), n))
        real = np.take_along_axis(good[rows], cols, axis=1)
        new_scores = np.where(real, np.take_along_axis(scores[rows], cols, axis=1), LOW)
        new_ids = np.where(real, ids[cols], NONE)
        at = start + rows
        s, i = np.concatenate([self.score[at, slot], new_scores], axis=1), np.concatenate([self.id[at, slot], new_ids], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[at, slot], self.id[at, slot] = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)


def products(batches, pack: dict, dims: int, scale: float, wide: bool):
    """start, scores, labels, ids for tiles of anchors and rows (vec_id, label, vec)."""
    anchors = pack["vectors"]
    for batch in batches:
        for at in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(at, TILE_ROWS)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            ids, labels = ids[order], part.column(1).to_numpy(zero_copy_only=False)[order]
            rows = quantised(matrix(part.column(2), dims), scale)[order]
            rows = exact_integers(rows) if wide else rows
            for start in range(0, len(anchors), TILE_ANCHORS):
                scores = anchors[start : start + TILE_ANCHORS] @ rows.T
                yield start, np.clip(scores, -NONE, NONE) if wide else scores.astype(np.int64), labels, ids


def load_block(anchors: DataFrame, positives: DataFrame | None, block: int, dims: int, scale: float, slots: int, window: tuple[int, int], wide: bool) -> dict:
    """One block of anchors (bounded), for a broadcast; with the windows that
    their positives open."""
    own = anchors.filter(F.col("block") == block).select("tag", "vec_id", "label", "vec").toArrow()
    vectors = quantised(matrix(own.column("vec"), dims), scale)
    pack = {c: own.column(c).to_numpy() for c in ("tag", "vec_id", "label")} | {"vectors": exact_integers(vectors) if wide else vectors}
    if positives is None:
        return pack
    shape, kind = (own.num_rows, slots), object if wide else np.int64
    pack |= {"low": np.full(shape, NONE, kind), "high": np.full(shape, LOW, kind), "score": np.zeros(shape, np.int64), "positive": np.zeros(shape, np.int64)}
    place = {t: i for i, t in enumerate(pack["tag"].tolist())}
    for row in positives.filter(F.col("block") == block).select("tag", "pno", "id", "score").collect():
        at = (place[row.tag], row.pno)
        pack["score"][at], pack["positive"][at] = row.score, row.id
        pack["low"][at], pack["high"][at] = -((-row.score * window[0]) // 100), (row.score * window[1]) // 100
    return pack


def kept(best: Best, pack: dict, block: int):
    """What a task has found, in batches: tag, block, slot, id, score."""
    for slot in range(best.id.shape[1]):
        found = best.id[:, slot] != NONE
        r, _ = np.nonzero(found)
        if len(r):
            parts = [pa.array(pack["tag"][r]), pa.array(np.full(len(r), block, np.int32)), pa.array(np.full(len(r), slot, np.int32)), pa.array(best.id[:, slot][found]), pa.array(best.score[:, slot][found].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(parts, ["tag", "block", "slot", "id", "score"])


FOUND = "tag long, block int, slot int, id long, score long"


def passes(spark: SparkSession, rows: DataFrame, anchors: DataFrame, blocks: int, k: int, search, load) -> DataFrame:
    """The ``k`` best of each anchor and slot (rank from 1): one pass over the
    rows for each block of anchors."""
    parts = []
    for block in range(blocks):
        pack = load(block)
        if not len(pack["tag"]):
            continue
        shared = spark.sparkContext.broadcast(pack)

        def run(batches, shared=shared, block=block):
            pack = shared.value
            yield from kept(search(batches, pack), pack, block)

        found = rows.mapInArrow(run, FOUND)
        order = Window.partitionBy("tag", "slot").orderBy(F.desc("score"), "id")
        parts.append(settle(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "negatives"))
        shared.unpersist()
    if not parts:
        return spark.createDataFrame([], FOUND + ", rank int")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, scale: float = 256, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); scores are inner products of these;
    higher scores come first, ties by the smaller id. Anchors are the rows whose
    id is divisible by ``every``. Each has its first ``positives`` rows of the
    same label with another id; for each of these the first ``negatives`` rows of
    another label whose score lies within ``window`` per cent of the positive's.

    Cases: rows with a null id, label or vector, or with a null or non-finite
    component, take no part. A vector with fewer components than the longest has
    zeros for the rest; an empty one has score 0 with all. Repeated ids are rows
    of their own: each anchor row has its own results, and no row that shares the
    anchor's id is its positive. Components so large that float64 is not exact
    are multiplied as Python integers (far slower); scores beyond a long are the
    nearest long. An empty table, or one without anchors, gives no rows; other
    columns are not read.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = own.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").filter(~odd)
    chosen = own.filter(F.col("vec_id") % every == 0)
    size = F.coalesce(F.max(F.size("vec")), F.lit(0))
    most = F.coalesce(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))), F.lit(0.0))
    dims, top, n = own.agg(size, most, F.count_if(F.col("vec_id") % every == 0)).first()
    wide = dims * (abs(top) * scale + 1) ** 2 >= EXACT
    blocks = max(1, -(-n * max(1, dims) * 8 // anchor_bytes))
    tagged = chosen.withColumn("tag", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("tag"), F.lit(blocks)).cast("int"))
    anchors = settle(tagged, "negatives-tags")
    if blocks > 1:  # in the order of blocks, so that a pass reads few row groups
        anchors = settle(anchors.repartitionByRange("block").sortWithinPartitions("block"), "negatives-anchors")

    def same_label(batches, pack):
        best = Best(len(pack["tag"]), 1, positives, wide)
        for start, scores, labels, ids in products(batches, pack, dims, scale, wide):
            at = slice(start, start + len(scores))
            good = (pack["label"][at, None] == labels) & (pack["vec_id"][at, None] != ids)
            best.offer(start, 0, scores, good & (scores >= best.floor(at, 0)[:, None]), ids)
        return best

    def other_label(batches, pack):
        best = Best(len(pack["tag"]), positives, negatives, wide)
        for start, scores, labels, ids in products(batches, pack, dims, scale, wide):
            at = slice(start, start + len(scores))
            other = pack["label"][at, None] != labels
            for slot in range(positives):
                low = np.maximum(pack["low"][at, slot], best.floor(at, slot))
                best.offer(start, slot, scores, other & (scores >= low[:, None]) & (scores <= pack["high"][at, slot][:, None]), ids)
        return best

    load = lambda found: lambda block: load_block(anchors, found, block, dims, scale, positives, window, wide)
    near = passes(spark, own, anchors, blocks, positives, same_label, load(None)).withColumn("pno", F.col("rank") - 1)
    far = passes(spark, own, anchors, blocks, negatives, other_label, load(near))
    of = near.select("tag", F.col("pno").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select("tag", F.col("vec_id").alias("anchor_id"))
    joined = far.join(of, ["tag", "slot"]).join(names, "tag")
    return joined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir):
    """Hard negatives over ``embeddings``, whose labels are shifted in every
    seventh row."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor, other, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
), n AS (
  SELECT p.anchor AS anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
