"""SimHash near-duplicates by covering locality-sensitive hashing (operator 4).

A fingerprint is cut into blocks of 64 bits. In each block every bit position
has a vector of radius+1 bits; table v (every non-zero vector of that length)
keeps the positions whose vector has an odd inner product with v. Up to
``radius`` differing positions span less than the whole space, so some v is
orthogonal to all of them: in that table the two blocks agree, whatever the
positions. 2^(radius+1)-1 tables a block thus miss no pair; with several blocks,
a pair is missed only if it differs in more than ``radius`` bits of each of them.
Crowded buckets are split by tables with other vectors, to which the same holds.
Exact copies are one fingerprint before any table is built.
"""

from __future__ import annotations

import functools
import math
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import settle, table
from quarrylight.scratch import remove

BITS = 64
#: Buckets up to this size are compared inside one task; larger ones are split.
BUCKET = 2048
#: How often a crowded bucket is split; by then its members agree in all bits
#: but a few of a block.
SPLITS = 5
#: Blocks of the fingerprints by which shingle similarity is measured.
BLOCKS = 10
#: Members of a divided bucket that meet in one task, of each of two tiles.
TILE = 1024
CHUNK = 1 << 13
SALTS = 64
STEP, MIX2, MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8; white space is ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int, seed: int = 42):
    """XXH64 of the word shingles, repeats included, in blocks."""
    if not words:
        return
    joined = b" ".join(words)
    if len(words) < width:
        yield np.array([xxhash.xxh64_intdigest(joined, seed)], dtype="<u8")
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(stops), CHUNK):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])], dtype="<u8")


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes; empty where the text has no words."""
    parts = list(shingle_hashes(words_of(text), width))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, "<u8")


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity; empty ones do."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def bit_block(h: np.ndarray, blocks: int) -> np.ndarray:
    """blocks x 64 pseudo-random bits for each hash; the first are its own."""
    x = h[:, None] + STEP * np.arange(1, blocks, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * MIX3
    wide = np.concatenate([h[:, None], x ^ (x >> np.uint64(31))], axis=1)
    return np.unpackbits(np.ascontiguousarray(wide, "<u8").view(np.uint8), axis=1, bitorder="little")


def fingerprint(hashes, blocks: int = 1) -> np.ndarray:
    """The SimHash of the hashes, given in parts: a bit is 1 if set in over half
    of them. Zeros where there are none."""
    total, ones = 0, np.zeros(BITS * blocks, dtype=np.int64)
    for h in hashes:
        for start in range(0, len(h), CHUNK):
            bits = bit_block(h[start : start + CHUNK], blocks)
            for at in range(0, len(bits), 255):
                ones += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
        total += len(h)
    return np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) for every row."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(words_of(t.as_py()), width, seed))[0] for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {ids}, fp long").withColumn("doc_id", F.col("doc_id").cast(kind))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@functools.lru_cache(maxsize=None)
def covering_masks(radius: int = 4, seed: int = 20) -> tuple[int, ...]:
    """The 2^(radius+1)-1 masks over 64 bits. The non-zero vectors are dealt out
    in turn, so all of them are in use."""
    rng = random.Random(seed)
    vectors = [1 + i % ((1 << (radius + 1)) - 1) for i in range(BITS)]
    rng.shuffle(vectors)
    return tuple(sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, 1 << (radius + 1)))


def spanning_links(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, distance: a minimum spanning forest of the links of up to ``most``
    differing bits. fps: a row a member. What is linked at any lower distance is
    linked by the forest's edges of that distance too."""
    left = np.arange(1, len(fps))
    near = np.bitwise_count(fps[1:] ^ fps[0]).sum(axis=1, dtype=np.int64)
    by = np.zeros(len(left), np.int64)
    out = []
    while len(left):
        k = int(near.argmin())
        at, d, parent = int(left[k]), int(near[k]), int(by[k])
        if d <= most:
            out.append((parent, at, d))
        left, near, by = np.delete(left, k), np.delete(near, k), np.delete(by, k)
        now = np.bitwise_count(fps[left] ^ fps[at]).sum(axis=1, dtype=np.int64)
        closer = now < near
        near[closer], by[closer] = now[closer], at
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def dealt(rows: DataFrame, level: int, radius: int) -> DataFrame:
    """uid, fp, bucket: every row in each table of each of its blocks, inside the
    bucket that it is in already."""
    blocks = rows.select("uid", "bucket", F.posexplode("fp").alias("block", "x")) if level == 0 else rows
    each = blocks.select("uid", "bucket", "block", "x", F.explode(tables(radius, level)).alias("t"))
    return each.select(bucket_key().alias("bucket"), "uid", *([] if level == 0 else ["block", "x"]))


def bucket_key() -> Column:
    """A bucket's number, from its table t of a block and the bits kept there."""
    return F.xxhash64("bucket", "block", "t.v", F.col("x").bitwiseAND(F.col("t.m")))


def shared_only(batches):
    """Of rows sorted by bucket, those whose bucket another row has."""
    held, twin = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = batch.column(0).to_numpy(zero_copy_only=False)
        same = key[1:] == key[:-1]
        keep = np.zeros(len(key), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= twin
        held, twin = batch.slice(batch.num_rows - 1, 1), bool(keep[-1])
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
    if held is not None and twin:
        yield held


def near_links(distinct: DataFrame, radius: int = 4, most: int = 4, bucket: int = BUCKET) -> DataFrame:
    """a, b, distance: links of up to ``most`` differing bits between distinct
    fingerprints (uid long, fp array<long>) that share a bucket of some table;
    in each bucket a minimum spanning forest of them.

    Every group of fingerprints chained by up to ``radius`` differing bits in a
    block is thus spanned, whatever the sizes of the buckets.
    """
    found = []
    rows = distinct.select("uid", "fp", F.lit(0).cast("long").alias("bucket"))
    for level in range(SPLITS + 1):
        spread = dealt(rows, level, radius)
        members = settle(spread.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared_only, spread.schema), "simhash-members")
        sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("uid").alias("a"), F.max("uid").alias("b"), F.sum(F.xxhash64("uid").cast("decimal(38,0)")).alias("who"))
        # Tables often show the same members; each set of them is compared once.
        once = settle(sizes.groupBy("n", "a", "b", "who").agg(F.min("bucket").alias("bucket")), "simhash-buckets")
        last = level == SPLITS
        found.append(pair_links(once.filter("n = 2").select("a", "b").distinct(), distinct, most))
        small = once.filter((F.col("n") > 2) & (F.lit(last) | (F.col("n") <= bucket))).select("bucket")
        found.append(bucket_links(members.join(small, "bucket").select("bucket", "uid").join(distinct, "uid"), most))
        crowded = once.filter(F.col("n") > bucket)
        if last or not crowded.limit(1).count():
            break
        again = members.join(crowded.select("bucket"), "bucket")
        if level == 0:
            again = with_block(again, distinct, radius)
        rows = again.select("uid", "block", "x", "bucket")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def shared_buckets(distinct: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """bucket, uid of the fingerprints that share a bucket of some covering
    table; and bucket, first, size of the buckets, one for each set of members."""
    spread = dealt(distinct.select("uid", "fp", F.lit(0).cast("long").alias("bucket")), 0, radius)
    members = settle(spread.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared_only, spread.schema), "simhash-members")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("uid").alias("first"), F.max("uid").alias("last"), F.sum(F.xxhash64("uid").cast("decimal(38,0)")).alias("who"))
    return members, settle(sizes.groupBy("size", "first", "last", "who").agg(F.min("bucket").alias("bucket")).select("bucket", "first", "size"), "simhash-buckets")


def divided_members(members: DataFrame, buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """bucket, uid, root, size of the buckets that hold more than one component
    so far, without their first members, which have met all others."""
    rest = members.join(buckets.filter("size > 2"), "bucket").filter("uid != first").select("bucket", "uid", "size")
    known = settle(rest.join(roots, F.col("uid") == F.col("node"), "left").select("bucket", "uid", "size", F.coalesce("root", "uid").alias("root")), "simhash-rest")
    split = known.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("bucket")
    return settle(known.join(split, "bucket"), "simhash-divided")


def across(fps: np.ndarray, root: np.ndarray, x: np.ndarray, i: int, j: int, most: int, best: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, distance: pairs of a tile of up to ``most`` differing bits between
    different roots; ``best``: for each root only its nearest."""
    ours, theirs = (np.flatnonzero(x == i), np.flatnonzero(x == j)) if i != j else (np.arange(len(x)), np.arange(len(x)))
    found = []
    for start in range(0, len(ours), 64):
        a = ours[start : start + 64]
        d = np.zeros((len(a), len(theirs)), np.int64)
        for block in range(fps.shape[1]):
            d += np.bitwise_count(fps[a, None, block] ^ fps[theirs, block])
        good = (d <= most) & (root[a, None] != root[theirs])
        if i == j:
            good &= a[:, None] < theirs
        r, c = np.nonzero(good)
        found.append(np.stack([a[r], theirs[c], d[r, c]]))
    a, b, d = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    if best and len(a):
        ends = np.concatenate([root[a], root[b]])
        order = np.lexsort((np.tile(d, 2), ends))
        _, first = np.unique(ends[order], return_index=True)
        keep = np.unique(order[first] % len(a))
        a, b, d = a[keep], b[keep], d[keep]
    return a, b, d


def divided_pairs(members: DataFrame, distinct: DataFrame, most: int, best: bool, tile: int) -> DataFrame:
    """a, b, distance: pairs of divided buckets (``across``). A bucket is dealt
    into tiles; a pair of tiles is a task's work of bounded size, whatever the
    size of the bucket."""
    tiles = F.ceil(F.col("size") / tile).cast("int")
    own = members.withColumn("x", F.pmod(F.xxhash64("uid"), tiles).cast("int"))
    spread = own.withColumn("y", F.explode(F.sequence(F.lit(0), tiles - 1))).join(distinct, "uid")
    placed = spread.select("bucket", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "root", F.struct("uid", "root", "x", "fp").alias("m"))
    groups = placed.groupBy("bucket", "i", "j").agg(F.sort_array(F.collect_list("m")).alias("own"), F.min("root").alias("least"), F.max("root").alias("top")).filter("least < top").select("i", "j", "own")

    def run(batches):
        for batch in batches:
            for i, j, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                flat = own.values
                uid, root, x = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("uid", "root", "x"))
                fps = flat.field("fp").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(uid), -1)
                a, b, d = across(fps, root, x, i, j, most, best)
                if len(a):
                    a, b = uid[a], uid[b]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d)], ["a", "b", "distance"])

    return groups.mapInArrow(run, "a long, b long, distance long").distinct()


def tables(radius: int, level: int) -> Column:
    """The numbered masks of one level."""
    return F.array(*[F.struct(F.lit(v).alias("v"), F.lit(signed(m)).alias("m")) for v, m in enumerate(covering_masks(radius, 20 + level))])


def with_block(members: DataFrame, distinct: DataFrame, radius: int) -> DataFrame:
    """uid, bucket, block, x: the block that made a bucket of level 0."""
    some = members.join(distinct, "uid").select("uid", F.col("bucket").alias("own"), F.lit(0).cast("long").alias("bucket"), F.posexplode("fp").alias("block", "x"))
    each = some.select("uid", "own", "bucket", "block", "x", F.explode(tables(radius, 0)).alias("t"))
    return each.filter(bucket_key() == F.col("own")).select("uid", F.col("own").alias("bucket"), "block", "x")


def apart(a: Column, b: Column) -> Column:
    """The differing bits of two fingerprints."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def pair_links(pairs: DataFrame, distinct: DataFrame, most: int) -> DataFrame:
    one = distinct.select(F.col("uid").alias("a"), F.col("fp").alias("x"))
    two = distinct.select(F.col("uid").alias("b"), F.col("fp").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", apart(F.col("x"), F.col("y")).cast("long").alias("distance")).filter(F.col("distance") <= most)


def bucket_links(members: DataFrame, most: int) -> DataFrame:
    """Spanning links of each bucket (bucket, uid, fp); its size is bounded."""
    groups = members.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("uid", "fp"))).alias("own")).select("own")

    def run(batches):
        for batch in batches:
            for own in batch.column(0):
                flat = own.values
                uid = flat.field(0).to_numpy(zero_copy_only=False)
                fps = flat.field(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(uid), -1)
                i, j, d = spanning_links(fps, most)
                a, b = uid[i], uid[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d)], ["a", "b", "distance"])

    return groups.mapInArrow(run, "a long, b long, distance long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node with a link: root is the least node of its
    connected component.

    Alternates large-star and small-star until the links are stars; each round
    is written to the shared folder, so lineage stays short.
    """
    edges = settle(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are combined map-side and joined back, so that a hub with very
        # many links is split like any skewed join.
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lower.select("u", F.col("m").alias("v")).unionByName(large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct()
        done, edges = edges, settle(small, "links")
        for path in {f.rpartition("/")[0] for f in done.inputFiles()}:  # the round before is read no more
            remove(edges.sparkSession, path)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)), F.countDistinct("u")).first()
        if now[0] == now[2] and now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id for every row of docs.

    component_id is the least id reachable over links of at most ``radius``
    differing bits. Cases: a text with fewer words than ``width`` is one
    shingle; one without words (null, empty, blank) has fingerprint zero and
    links like any other. A row with a null id has a fingerprint and the
    component of its group, to which it lends no id (null where no row has
    one). Rows that share an id are judged each by its own text. An empty table
    gives no rows; other columns of docs are not read.
    """
    salt = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(SALTS)).cast("int")
    fps = settle(fingerprints(docs, id_col, text_col, width), "simhash").withColumn("salt", salt)
    distinct = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")), "simhash-distinct")
    roots = components(near_links(distinct.select(F.col("fp").alias("uid"), F.array("fp").alias("fp")), radius, radius, bucket))
    grouped = roots.join(distinct, roots["node"] == distinct["fp"])
    names = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    chained = roots.join(names, "root").select(F.col("node").alias("fp"), "component_id")
    # A fingerprint that very many rows share is joined salt by salt.
    places = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col("salts"), i) == 1)
    labels = distinct.join(chained, "fp", "left").select("fp", F.explode(places).alias("salt"), F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(labels, ["fp", "salt"]).select("doc_id", "fp", "component_id")


def op4_simhash(spark, sf_dir):
    """Fingerprints and components over ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distances(similarity: float, blocks: int) -> tuple[int, int]:
    """The differing bits up to which, and beyond which, two fingerprints leave
    no doubt whether their sets have that Jaccard similarity: the mean of sets of
    equal size, less 2.6 and plus 3.3 standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    mean, spread = share * BITS * blocks, math.sqrt(share * (1 - share) * BITS * blocks)
    return math.floor(mean - 2.6 * spread), math.ceil(mean + 3.3 * spread)


def described(docs: DataFrame, id_col: str, text_col: str, width: int, blocks: int) -> DataFrame:
    """doc_id, th (a hash of the text), s1, s2 (two of its shingle set) and fp
    (array<long>, of the set) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    ids = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                names, fps = [], []
                for text in part.column(2):
                    own = shingle_set(text.as_py(), width)
                    names.append(xxhash.xxh3_128_digest(own.tobytes()))
                    fps.append(fingerprint([own], blocks))
                names = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
                flat = np.concatenate(fps).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, blocks), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.ascontiguousarray(names[:, 0])), pa.array(np.ascontiguousarray(names[:, 1])), lists], ["doc_id", "th", "s1", "s2", "fp"])

    return rows.mapInArrow(run, f"doc_id {ids}, th long, s1 long, s2 long, fp array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts (uid, text) that are similar by their whole sets.
    A text with very many pairs meets them in several groups, one at a time."""
    dealt_out = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("part"))
    first = dealt_out.select("a", "part").distinct().join(texts, F.col("a") == F.col("uid")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    second = dealt_out.join(texts, F.col("b") == F.col("uid")).select("a", "part", "b", "text")
    ordered = first.unionByName(second).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def run(batches):
        own = None
        for batch in batches:
            good = []
            for b, text in zip(batch.column(2).to_pylist(), batch.column(3)):
                now = shingle_set(text.as_py(), width)
                if b is None:
                    own = now
                good.append(b is not None and similar(own, now, similarity))
            yield batch.select([0, 2]).filter(pa.array(good, pa.bool_()))

    return ordered.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, blocks: int = BLOCKS, radius: int = 4, tile: int | None = None) -> DataFrame:
    """doc_id, th for one row of each group of near copies: the one with the
    least id and, of those, the least ``th`` (xxhash64 of the text, a null text
    being empty).

    Groups are chained by links of Jaccard similarity ``similarity`` or more
    between sets of ``width``-word shingles. Candidates share a bucket: a covering
    table of some block of their fingerprints. In each bucket the first member
    meets all others; in what that leaves divided each component meets the nearest
    other; then whatever still lies in different components meets. Pairs that the
    fingerprints leave in doubt are checked on the whole sets. What is missed are
    pairs without a common bucket, none that differ in up to ``radius`` bits of a
    block, and pairs so far apart, or so near, by their fingerprints that no check
    is made (``distances``).

    Cases: a text with fewer words than ``width`` is one shingle; texts without
    words are copies of each other. A row with a null id links others and stands
    for no group. Rows that share an id are judged each by its own text. An empty
    table gives no rows; other columns of docs are not read.
    """
    rows = settle(described(docs, id_col, text_col, width, blocks), "simhash-rows")
    per_set = rows.groupBy("s1", "s2").agg(F.first("fp").alias("fp"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))).alias("least"), F.min(F.struct("doc_id", "th")).alias("some"))
    distinct = settle(per_set.withColumn("uid", F.monotonically_increasing_id()), "simhash-sets")
    fps = distinct.select("uid", "fp")
    sure, most = distances(similarity, blocks)
    members, buckets = shared_buckets(fps, radius)

    def judged(pairs: DataFrame, links: DataFrame | None) -> DataFrame:
        """links, and the pairs (a, b, distance) that are links and join more."""
        certain = pairs.filter(F.col("distance") <= sure).select("a", "b")
        certain = certain if links is None else links.unionByName(certain)
        roots = components(certain)
        one, two = roots.toDF("a", "ra"), roots.toDF("b", "rb")
        doubt = pairs.filter(F.col("distance") > sure).join(one, "a", "left").join(two, "b", "left")
        doubt = settle(doubt.filter("coalesce(ra, a) != coalesce(rb, b)").select("a", "b"), "simhash-doubt")
        needed = doubt.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
        named = needed.join(distinct, "uid").select("uid", F.col("some.doc_id").alias("own"), F.col("some.th").alias("th"))
        whole = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
        texts = settle(whole.join(named, F.col("doc_id").eqNullSafe(F.col("own")) & (whole["th"] == named["th"])).groupBy("uid").agg(F.first("text").alias("text")), "simhash-texts")
        return settle(certain.unionByName(confirmed(doubt, texts, width, similarity)), "simhash-links")

    stars = members.join(buckets.select("bucket", F.col("first").alias("a")), "bucket").filter("uid != a").select("a", F.col("uid").alias("b")).distinct()
    links = judged(settle(pair_links(stars, fps, most), "simhash-pairs"), None)
    for best in (True, False):
        roots = components(links)
        left = divided_members(members, buckets, roots)
        pairs = settle(divided_pairs(left, fps, most, best, tile or TILE), "simhash-pairs")
        if pairs.isEmpty():
            break
        links = judged(pairs, links)
    else:
        roots = components(links)
    grouped = distinct.join(roots, F.col("uid") == F.col("node"), "left").select(F.coalesce("root", "uid").alias("root"), "least")
    return grouped.groupBy("root").agg(F.min("least").alias("least")).filter("least IS NOT NULL").select("least.doc_id", "least.th")
