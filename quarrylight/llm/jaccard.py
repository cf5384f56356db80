"""Exact Jaccard joins of word n-gram sets by a count-vector R-tree (operator 13).

A set is a point: shingles are hashed to groups, a coordinate is the number of
shingles in a group. Two sets share at most the sum, over the groups, of the
lesser count; this bounds their overlap, and of a box of points the upper corner
bounds that of all points inside.

The tree's upper level are boxes without width. Groups lie in bands; sets of up
to M shingles that are similar enough differ in at most D elements, so with D + 1
bands they have equal counts in all groups of some band (pigeonhole). Every value
of a band's counts, within a class of sizes, is a box, in which linked sets meet.
In each box the first set is compared with all others; where that leaves a box
divided, an R-tree over its points, by tiles of bounded size, names the pairs that
the bound cannot exclude. Survivors are verified on their whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import settle, table, text_parts
from quarrylight.llm.simhash import components, shared_only, shingle_set

#: Groups of a point, and groups of a band.
GROUPS, BAND = 256, 64
#: Points of a tile; pairs of tiles cover a box of any size.
TILE = 1024
FANOUT = 16
#: Bytes of text in one slice of a task's work.
SLICE = 1 << 22
SALTS = 64
STEP, MIX2, MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 pseudo-random bits for each number."""
    x = (x + np.uint64(1)) * STEP
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * MIX3
    return x ^ (x >> np.uint64(31))


def size_class(n: int, num: int, den: int) -> tuple[int, int, int]:
    """The class of a set of n shingles, the largest size in it and in the next.
    A set that is similar to one of a class lies in that class or beside it."""
    k, low = 0, 1
    while True:
        following = low * den // num + 1
        if n < following:
            return k, following - 1, following * den // num
        k, low = k + 1, following


def differing(most: int, num: int, den: int) -> int:
    """How many elements two similar sets of up to ``most`` shingles differ in:
    at most (a + b) * (den - num) / (den + num)."""
    return 2 * most * (den - num) // (den + num)


def point(hashes: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def band_keys(hashes: np.ndarray, kind: int, bands: int) -> np.ndarray:
    """One number for each band: of the size class and of the counts in the
    band's groups. Equal counts have equal numbers."""
    band = ((hashes >> np.uint64(8)) % np.uint64(bands)).astype(np.int64)
    group = (hashes >> np.uint64(40)) & np.uint64(BAND - 1)
    parts = mixed(band.astype(np.uint64) * np.uint64(BAND) + group)
    order = np.argsort(band, kind="stable")
    sums = np.zeros(bands, np.uint64)
    found, starts = np.unique(band[order], return_index=True)
    sums[found] = np.add.reduceat(parts[order], starts)
    salt = np.array([kind], np.uint64) << np.uint64(32)
    return mixed(sums ^ mixed(salt + np.arange(bands, dtype=np.uint64)))


def described(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """For every row doc_id, th (a hash of the text), s1 and s2 (two of its set),
    n, point (the counts, two bytes each), keys (of its bands) and own (how many
    of these are of its own size class; the others are of the next)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    ids = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            for part in text_parts(batch, 2, SLICE):
                names, sizes, points, keys, own = [], [], [], [], []
                for text in part.column(2):
                    hashes = shingle_set(text.as_py(), width)
                    n = len(hashes)
                    names.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    sizes.append(n)
                    # Two different sets can be similar only if one element
                    # more or less leaves them so.
                    if n and n * den >= (n + 1) * num:
                        kind, top, beyond = size_class(n, num, den)
                        mine = band_keys(hashes, kind, differing(top, num, den) + 1)
                        keys.append(np.concatenate([mine, band_keys(hashes, kind + 1, differing(beyond, num, den) + 1)]).view(np.int64))
                        own.append(len(mine))
                        points.append(np.minimum(point(hashes), 65535).astype("<u2").tobytes())
                    else:
                        keys.append(np.empty(0, np.int64))
                        own.append(0)
                        points.append(None)
                names = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
                offsets = np.cumsum([0, *map(len, keys)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys)))
                arrays = [part.column(0), part.column(1), pa.array(np.ascontiguousarray(names[:, 0])), pa.array(np.ascontiguousarray(names[:, 1])), pa.array(sizes, pa.int64()), pa.array(points, pa.binary()), lists, pa.array(own, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "th", "s1", "s2", "n", "point", "keys", "own"])

    return rows.mapInArrow(run, f"doc_id {ids}, th long, s1 long, s2 long, n long, point binary, keys array<long>, own int")


def bounded(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of sizes a and b with at most that overlap may be similar.
    ``overlap * (den + num) >= num * (a + b)`` is the same as a Jaccard
    similarity of num / den or more."""
    return overlap * (den + num) >= num * (a + b)


def boxes(points: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The levels of a packed R-tree over points in their order, leaves first:
    each box's upper corner, its least size and its greatest."""
    levels = [(points, sizes, sizes)]
    while len(levels[-1][0]) > FANOUT:
        corner, least, most = levels[-1]
        starts = np.arange(0, len(corner), FANOUT)
        levels.append((np.maximum.reduceat(corner, starts, axis=0), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)))
    return levels


def tree_pairs(points: np.ndarray, sizes: np.ndarray, queries: np.ndarray, query_sizes: np.ndarray, num: int, den: int):
    """query, point: pairs (in order of queries) that the bound cannot exclude,
    by descent from the root's boxes to single points."""
    levels = boxes(points, sizes)
    for at in range(0, len(queries), 64):
        own, n = queries[at : at + 64], query_sizes[at : at + 64]
        q = np.repeat(np.arange(len(own)), len(levels[-1][0]))
        node = np.tile(np.arange(len(levels[-1][0])), len(own))
        for depth in range(len(levels) - 1, -1, -1):
            corner, least, most = levels[depth]
            # A similar set is no smaller than num / den of the query and no larger than den / num.
            near = (most[node] * den >= n[q] * num) & (least[node] * num <= n[q] * den)
            q, node = q[near], node[near]
            good = np.zeros(len(q), bool)
            for s in range(0, len(q), 8192):
                part = slice(s, s + 8192)
                overlap = np.minimum(own[q[part]], corner[node[part]]).sum(axis=1, dtype=np.int64)
                # The overlap is no more than either set.
                good[part] = bounded(np.minimum(overlap, n[q[part]]), n[q[part]], least[node[part]], num, den)
            q, node = q[good], node[good]
            if depth:
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q = np.repeat(q, FANOUT)
                inside = node < len(levels[depth - 1][0])
                q, node = q[inside], node[inside]
        if len(q):
            yield q + at, node


def unpacked(points) -> np.ndarray:
    return np.frombuffer(b"".join(points), "<u2").reshape(len(points), -1)


def surviving(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose overlap, as bounded by their points, suffices."""
    one = sets.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa"))
    two = sets.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 4))
                overlap = np.minimum(unpacked(batch.column(3).to_pylist()), unpacked(batch.column(5).to_pylist())).sum(axis=1, dtype=np.int64)
                yield batch.select([0, 1]).filter(pa.array(bounded(overlap, na, nb, num, den)))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "pa", "nb", "pb").mapInArrow(run, "a long, b long")


def divided_pairs(members: DataFrame, num: int, den: int, tile: int) -> DataFrame:
    """a, b: pairs of members of a box (box, uid, root, n, point, size) that lie
    in different components so far and that the bound cannot exclude.

    A box is dealt into tiles; each pair of tiles is a task's work of bounded
    size, whatever the size of the box."""
    tiles = F.ceil(F.col("size") / tile).cast("int")
    own = members.withColumn("x", F.pmod(F.xxhash64("uid"), tiles).cast("int"))
    spread = own.withColumn("y", F.explode(F.sequence(F.lit(0), tiles - 1)))
    placed = spread.select("box", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.struct("n", "uid", "root", "x", "point").alias("m"))
    groups = placed.groupBy("box", "i", "j").agg(F.sort_array(F.collect_list("m")).alias("own"), F.min("m.root").alias("least"), F.max("m.root").alias("most")).filter("least < most").select("i", "j", "own")

    def run(batches):
        for batch in batches:
            for i, j, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                flat = own.values
                n, uid, root, x = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("n", "uid", "root", "x"))
                points = unpacked(flat.field("point").to_pylist())
                # With two tiles, those of one ask for those of the other.
                asked, asking = (np.flatnonzero(x == i), np.flatnonzero(x == j)) if i != j else (np.arange(len(x)), np.arange(len(x)))
                if not len(asked) or not len(asking):
                    continue
                for q, p in tree_pairs(points[asked], n[asked], points[asking], n[asking], num, den):
                    a, b = asking[q], asked[p]
                    good = root[a] != root[b]
                    if i == j:
                        good &= a < b
                    a, b = uid[a[good]], uid[b[good]]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return groups.mapInArrow(run, "a long, b long").distinct()


def similar_sets(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * den >= num * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of texts (uid, text) that are similar by their whole
    sets. A text with very many pairs meets them in several groups, one at a
    time."""
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("part"))
    first = dealt.select("a", "part").distinct().join(texts, F.col("a") == F.col("uid")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    second = dealt.join(texts, F.col("b") == F.col("uid")).select("a", "part", "b", "text")
    ordered = first.unionByName(second).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def run(batches):
        own = None
        for batch in batches:
            good = []
            for b, text in zip(batch.column(2).to_pylist(), batch.column(3)):
                now = shingle_set(text.as_py(), width)
                if b is None:
                    own = now
                good.append(b is not None and similar_sets(own, now, num, den))
            yield batch.select([0, 2]).filter(pa.array(good, pa.bool_()))

    return ordered.mapInArrow(run, "a long, b long")


def texts_of(pairs: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid, text of one row of each set that stands in a pair."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    named = needed.join(sets, "uid").select("uid", F.col("some.doc_id").alias("own"), F.col("some.th").alias("th"))
    whole = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    return whole.join(named, F.col("doc_id").eqNullSafe(F.col("own")) & (whole["th"] == named["th"])).groupBy("uid").agg(F.first("text").alias("text"))


def jaccard_links(sets: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, tile: int = TILE) -> DataFrame:
    """a, b: verified links between distinct sets (uid, some, n, point, keys,
    own) that connect all sets which any links connect."""
    spread = sets.select(F.posexplode("keys").alias("at", "box"), "uid", "own").select("box", "uid", (F.col("at") < F.col("own")).alias("own"))
    members = settle(spread.repartition("box").sortWithinPartitions("box").mapInArrow(shared_only, spread.schema), "jaccard-members")
    # Boxes often hold the same sets, and each is asked once. Where all sets are
    # of the class below, they meet in its own boxes.
    sizes = members.groupBy("box").agg(F.count("*").alias("size"), F.min("uid").alias("first"), F.max("uid").alias("last"), F.sum(F.xxhash64("uid").cast("decimal(38,0)")).alias("who"), F.max("own").alias("own"))
    boxes_once = settle(sizes.filter("own").groupBy("size", "first", "last", "who").agg(F.min("box").alias("box")), "jaccard-boxes")
    pairs = members.join(boxes_once.select("box", F.col("first").alias("a")), "box").filter("uid != a").select("a", F.col("uid").alias("b")).distinct()
    pairs = settle(surviving(pairs, sets, num, den), "jaccard-first")
    links = settle(verified(pairs, settle(texts_of(pairs, sets, docs, id_col, text_col), "jaccard-texts"), width, num, den), "jaccard-links")
    roots = components(links)
    # The first set of a box has met all others; what is left are pairs of these.
    rest = members.join(boxes_once.filter("size > 2").select("box", "first", "size"), "box").filter("uid != first")
    known = settle(rest.join(roots, F.col("uid") == F.col("node"), "left").select("box", "uid", "size", F.coalesce("root", "uid").alias("root")), "jaccard-rest")
    split = known.groupBy("box").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("box")
    left = known.join(split, "box").join(sets.select("uid", "n", "point"), "uid")
    more = settle(divided_pairs(left, num, den, tile), "jaccard-pairs")
    further = verified(more, settle(texts_of(more, sets, docs, id_col, text_col), "jaccard-texts"), width, num, den)
    return links.unionByName(settle(further, "jaccard-links"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 9, den: int = 10, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Two rows link when the sets of their distinct ``width``-word shingles (A-Z
    lower-cased) have a Jaccard similarity of num / den or more; component_id is
    the least id reachable.

    Cases: a text with fewer words than ``width`` is one shingle; one without
    words (null, empty, blank) has an empty set and links with nothing. A row with
    a null id has the component of its group, to which it lends no id (null where
    no row has one). Rows that share an id are judged each by its own text. An
    empty table gives no rows; other columns of docs are not read.
    """
    rows = settle(described(docs, id_col, text_col, width, num, den), "jaccard-rows")
    full = rows.filter("n > 0")
    per_set = full.groupBy("s1", "s2").agg(F.first("n").alias("n"), F.first("point").alias("point"), F.first("keys").alias("keys"), F.first("own").alias("own"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("some"))
    sets = settle(per_set.withColumn("uid", F.monotonically_increasing_id()), "jaccard-sets")
    roots = components(jaccard_links(sets, docs, id_col, text_col, width, num, den, tile))
    grouped = sets.select("uid", "s1", "s2", "least").join(roots, F.col("uid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "uid"))
    names = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = settle(grouped.join(names, "root").select("s1", "s2", "component_id"), "jaccard-labels")
    joined = full.select("doc_id", "n", "s1", "s2").join(labels, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return joined.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op13_jaccard_join(spark, sf_dir):
    """Sets of three-word shingles and their components over ``documents``."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 2], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS pos FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, b AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(seen) AS least FROM r GROUP BY node) m USING (doc_id)
"""
