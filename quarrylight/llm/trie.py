"""The prefix trie of conversations by heavy-path decomposition (operator 11).

A node is a prefix of turns. Its key is the sum of hashes of (depth, turn) over
the prefix, in two lanes of 62 bits, so keys are running sums, which long
conversations share out over tasks. A node's heavy child is the one with the most
members. Along a path from the root every light step at least halves the number
of members: with paths classed by the binary logarithm of the members of their
first node, a path hangs below one of a higher class. Classes are settled from
the least up. In each, weights and what light paths have brought are summed from
the end of the path arrays; the totals of first nodes go to their parents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import settle, table

#: Sums of hashes are kept modulo 2^62: two of them fit a long.
MASK = (1 << 62) - 1
#: Nodes of a path in one array.
CHUNK = 4096
#: Bytes of joined ids that move at once.
BLOCK = 1 << 20


def running_sums(rows: DataFrame, key: str, order: list, values: list[str]) -> DataFrame:
    """rows with each of ``values`` (non-negative) replaced by its sum, modulo
    2^62, over the key's rows so far in the given order.

    Rows are range-partitioned by key and order, so a key with very many rows
    lies in many tasks; what its earlier tasks add is carried over in one row a
    task."""
    spark = rows.sparkSession
    names = rows.columns
    at = [names.index(c) for c in [key, *values]]
    placed = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)

    def run(batches):
        pid, first, last, totals, held = TaskContext.get().partitionId(), None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            keys = batch.column(at[0]).to_numpy(zero_copy_only=False)
            first = keys[0] if first is None else first
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            lengths = np.diff(np.append(starts, len(keys)))
            columns, now = list(batch.columns), []
            for i, c in enumerate(at[1:]):
                x = batch.column(c).to_numpy(zero_copy_only=False).astype(np.uint64)
                total = np.cumsum(x)
                total -= np.repeat(total[starts] - x[starts], lengths)
                if last is not None and keys[0] == last:
                    total[: lengths[0]] += np.uint64(totals[i])
                total &= np.uint64(MASK)
                columns[c] = pa.array(total.astype(np.int64))
                now.append(int(total[-1]))
            last, totals = keys[-1], now
            n = len(keys)
            held = pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, pid, np.int32)), pa.nulls(n, pa.int64())], [*names, "pid", "opens"])
        if held is not None:  # the last row of a task also names its first key
            opens = pa.array([None] * (held.num_rows - 1) + [int(first)], pa.int64())
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], opens], held.schema.names)

    kinds = ", ".join(f"`{c}` {'long' if c in values else t}" for c, t in rows.dtypes)
    done = settle(placed.mapInArrow(run, f"{kinds}, pid int, opens long"), "running-sums")
    ends = sorted(done.filter("opens IS NOT NULL").select("pid", "opens", key, *values).collect())
    carried, before, total = [], None, [0] * len(values)
    for end in ends:  # one row a task
        opens, closes, own = end["opens"], end[key], [end[v] for v in values]
        if before is not None and opens == before:
            carried.append((end["pid"], opens, *total))
        total = [(a + b) & MASK for a, b in zip(own, total)] if opens == closes == before else own
        before = closes
    if not carried:
        return done.drop("pid", "opens")
    carry = spark.createDataFrame(carried, ", ".join(f"`{c}` long" for c in ["pid", key, *[f"_{v}" for v in values]])).withColumn("pid", F.col("pid").cast("int"))
    joined = done.join(F.broadcast(carry), ["pid", key], "left")
    return joined.select(*[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).bitwiseAND(F.lit(MASK)).alias(c) if c in values else F.col(c) for c in rows.columns])


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations, (conv_id, depth, digest, bytes,
    is_end), and one row a conversation, (conv_id, length).

    turns: conv_id, turn, digest, bytes."""
    rows = turns.withColumn("pos", F.lit(1).cast("long"))
    placed = running_sums(rows, "conv_id", [F.asc_nulls_first("turn"), F.asc("digest")], ["pos"])
    numbered = settle(placed.select("conv_id", "pos", "digest", "bytes"), "trie-turns")
    base, share = F.col("conv_id") - F.col("conv_id") % 5, F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(9))
    heads = numbered.filter("pos <= 8 AND conv_id % 5 = 0").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("head"))
    convs = numbered.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", base.alias("base"), share.alias("share"))
    joined = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    given = F.least("share", F.coalesce(F.size("head"), F.lit(0)).cast("long"))
    plan = joined.select("conv_id", "share", given.alias("given"), (given + F.greatest(F.col("n") - F.col("share"), F.lit(0))).alias("length"), F.slice("head", 1, given.cast("int")).alias("head"))
    plan = settle(plan, "trie-plan")
    shared = plan.select("conv_id", "length", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.digest", "t.bytes", (F.col("t.pos") == F.col("length")).alias("is_end"))
    depth = F.col("pos") - F.col("share") + F.col("given")
    own = numbered.join(plan.select("conv_id", "share", "given", "length"), "conv_id").filter("pos > share").select("conv_id", depth.alias("depth"), "digest", "bytes", (depth == F.col("length")).alias("is_end"))
    return shared.unionByName(own), plan.select("conv_id", "length")


def joined_ids(ends: DataFrame) -> DataFrame:
    """k1, k2, sha (binary): the SHA-256 of each key's conv_ids, ascending and
    comma-joined.

    Rows are range-partitioned by key and id. Short lists that lie inside one
    task are hashed there; of others, blocks of joined ids follow each other
    through one digest, so that only their bytes meet."""
    placed = ends.select("k1", "k2", "conv_id").repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    schema = "k1 long, k2 long, pid int, seq long, block binary, sha binary"

    def run(batches):
        pid, key, ids, size, cut, out = TaskContext.get().partitionId(), None, [], 0, True, []
        number = 0

        def flush(whole):
            nonlocal number
            if ids:
                joined = ",".join(ids).encode()
                number += 1
                out.append((*key, pid, number, None, hashlib.sha256(joined).digest()) if whole else (*key, pid, number, joined, None))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["k1", "k2", "pid", "seq", "block", "sha"])

        for batch in batches:
            for k1, k2, c in zip(*(x.to_pylist() for x in batch.columns)):
                if (k1, k2) != key:
                    # The task's first and last key may go on in its neighbours.
                    flush(not cut)
                    cut, key, ids, size = key is None, (k1, k2), [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
                if size > BLOCK:
                    flush(False)
                    ids, size, cut = [], 0, True
            if out:
                yield batch_of(out)
                out = []
        flush(False)
        if out:
            yield batch_of(out)

    done = settle(placed.mapInArrow(run, schema), "trie-ends")
    whole = done.filter("block IS NULL").select("k1", "k2", "sha")
    parts = done.filter("block IS NOT NULL").select("k1", "k2", "pid", "seq", "block").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "pid", "seq")

    def follow(batches):
        key, digest = None, None
        one = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([digest.digest()], pa.binary())], ["k1", "k2", "sha"])
        for batch in batches:
            for k1, k2, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4)):
                if (k1, k2) == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        yield one()
                    key, digest = (k1, k2), hashlib.sha256()
                digest.update(block.as_buffer())
        if key is not None:
            yield one()

    return whole.unionByName(parts.mapInArrow(follow, "k1 long, k2 long, sha binary"))


def trie_nodes(rebuilt: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, next
    (its heavy child's conv_id), is_head (of a heavy path), saved, sha."""
    lane = lambda i: F.xxhash64(F.lit(i), "depth", "digest").bitwiseAND(F.lit(MASK))
    rows = rebuilt.select("conv_id", "depth", "bytes", "is_end", lane(1).alias("x1"), lane(2).alias("x2"), lane(1).alias("k1"), lane(2).alias("k2"))
    keyed = settle(running_sums(rows, "conv_id", [F.asc("depth")], ["k1", "k2"]), "trie-keys")
    before = lambda i: (F.col(f"k{i}") - F.col(f"x{i}") + F.lit(MASK + 1)).bitwiseAND(F.lit(MASK)).alias(f"p{i}")
    below = keyed.select("k1", "k2", before(1), before(2), "depth", "conv_id", "bytes").groupBy("k1", "k2", "p1", "p2", "depth")
    nodes = below.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    none = F.lit(None).cast("long")
    root = root.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("depth"), "n_convs", "conv_id", F.lit(0).cast("long").alias("bytes"))
    nodes = settle(nodes.unionByName(root), "trie-nodes")
    ends = keyed.filter("is_end").select("k1", "k2", "conv_id").unionByName(convs.filter("length = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id"))
    # Of children with as many members the one with the least conv_id is heavy.
    best = F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("other")))
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"), best.alias("best"))
    children = children.select("k1", "k2", "n_children", F.bitwise_not(F.col("best.other")).alias("next"))
    own = nodes.join(children, ["k1", "k2"], "left").join(joined_ids(ends), ["k1", "k2"], "left")
    own = settle(own.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-children")
    above = own.filter("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("next").alias("heavy"))
    joined = own.join(above, ["p1", "p2"], "left")
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "next", (~F.col("heavy").eqNullSafe(F.col("conv_id"))).alias("is_head"), saved.alias("saved"), "sha")


def heavy_paths(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, path: the conv_id of the leaf at the end of the heavy path
    through each node, by doubled jumps."""
    leaf = F.col("next").isNull()
    jumps = nodes.select("conv_id", "depth", F.coalesce("next", "conv_id").alias("to_conv"), F.when(leaf, F.col("depth")).otherwise(F.col("depth") + 1).alias("to_depth"), leaf.alias("done"))
    jumps = settle(jumps, "trie-jumps")
    while jumps.filter("NOT done").limit(1).count():
        target = jumps.select(F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), F.col("to_conv").alias("far_conv"), F.col("to_depth").alias("far_depth"), F.col("done").alias("far_done"))
        further = jumps.filter("NOT done").join(target, ["to_conv", "to_depth"]).select("conv_id", "depth", F.col("far_conv").alias("to_conv"), F.col("far_depth").alias("to_depth"), F.col("far_done").alias("done"))
        jumps = settle(jumps.filter("done").unionByName(further), "trie-jumps")
    return jumps.select("conv_id", "depth", F.col("to_conv").alias("path"))


CHUNKS = "path long, chunk long, class int, head_depth long, up_path long, up_depth long, up_class int, nodes array<struct<depth:long,conv_id:long,parent_conv_id:long,n_convs:long,n_children:long,saved:long,sha:binary>>"


def path_arrays(nodes: DataFrame, chunk: int) -> DataFrame:
    """The nodes of each heavy path as arrays of at most ``chunk``, in order of
    depth, with the path's class and the node above it."""
    placed = settle(nodes.join(heavy_paths(nodes), ["conv_id", "depth"]), "trie-paths")
    kind = F.length(F.bin("n_convs")) - 1  # the binary logarithm
    heads = placed.filter("is_head").select("path", kind.alias("class"), F.col("depth").alias("head_depth"), "parent_conv_id", (F.col("depth") - 1).alias("up_depth"))
    classes = heads.select("path", "class")
    ups = heads.join(placed.select(F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("up_depth"), F.col("path").alias("up_path")), ["parent_conv_id", "up_depth"], "left")
    heads = settle(ups.join(classes.select(F.col("path").alias("up_path"), F.col("class").alias("up_class")), "up_path", "left"), "trie-heads").drop("parent_conv_id")
    node = F.struct("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "saved", "sha")
    arrays = placed.groupBy("path", F.floor(F.col("depth") / chunk).alias("chunk")).agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    out = arrays.join(heads, "path").select("path", "chunk", "class", "head_depth", "up_path", "up_depth", "up_class", "nodes")
    return settle(out.repartitionByRange("class", "path", "chunk").sortWithinPartitions("class"), "trie-arrays")


def suffix_sums(batches):
    """path, chunk, leaves, saved: the sums from each node of an array to its
    end, of its own weight and of what light paths have brought (brought)."""
    for batch in batches:
        nodes, brought = batch.column(2), batch.column(3)
        if not batch.num_rows:
            continue
        lengths = nodes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        flat = nodes.flatten()
        field = lambda s, name: s.field(name).to_numpy(zero_copy_only=False)
        depth = field(flat, "depth")
        weights = [(field(flat, "n_children") == 0).astype(np.int64), field(flat, "saved").astype(np.int64)]
        counts = brought.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if counts.any():
            extra = brought.flatten()
            row = np.repeat(np.arange(len(counts)), counts)
            place = starts[row] + field(extra, "depth") - depth[starts[row]]
            weights[0][place] += field(extra, "leaves")
            weights[1][place] += field(extra, "saved")
        sums = []
        for w in weights:
            run = np.cumsum(w)
            sums.append(np.repeat(run[starts + lengths - 1], lengths) - run + w)
        offsets = pa.array(np.append(starts, starts[-1] + lengths[-1]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(s)) for s in sums]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["path", "chunk", "leaves", "saved"])


def settle_class(arrays: DataFrame, brought: DataFrame | None, several: bool, chunk: int) -> DataFrame:
    """The arrays of one class with the sums ``leaves`` and ``saved`` of their
    nodes' subtrees."""
    if brought is None:
        brought = arrays.select("path", "chunk", F.array().cast("array<struct<depth:long,leaves:long,saved:long>>").alias("brought")).limit(0)
    else:
        sums = brought.groupBy("path", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        brought = sums.groupBy("path", F.floor(F.col("depth") / chunk).alias("chunk")).agg(F.collect_list(F.struct("depth", "leaves", "saved")).alias("brought"))
    met = arrays.select("path", "chunk", "nodes").join(brought, ["path", "chunk"], "left")
    sums = met.mapInArrow(suffix_sums, "path long, chunk long, leaves array<long>, saved array<long>")
    if several:
        sums = settle(sums, "trie-sums")
        later = Window.partitionBy("path").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
        carry = sums.select("path", "chunk", F.element_at("leaves", 1).alias("l"), F.element_at("saved", 1).alias("s"))
        carry = carry.select("path", "chunk", F.coalesce(F.sum("l").over(later), F.lit(0)).alias("l"), F.coalesce(F.sum("s").over(later), F.lit(0)).alias("s"))
        added = lambda c, by: F.transform(c, lambda x: x + F.col(by)).alias(c)
        sums = sums.join(carry, ["path", "chunk"]).select("path", "chunk", added("leaves", "l"), added("saved", "s"))
    return settle(arrays.join(sums, ["path", "chunk"]), "trie-class")


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row a node of the trie of rebuilt conversations: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation c is rebuilt from the first h turns of conversation c - c % 5
    and its own after the first h, where h is the unsigned crc32 of its decimal
    id modulo 9. A node stands for the conversations that begin with its turns;
    conv_id is the least of them.

    Cases: turns are ordered by ``turn``, nulls first, and of equal ones by a
    digest of role and text; repeated rows are turns of their own. A null role or
    text is empty. Rows without a conv_id take no part. A conversation of which
    nothing is left ends at the root. An empty table gives no rows; other columns
    are not read.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rebuilt, convs = rebuilt_turns(settle(rows.filter("conv_id IS NOT NULL"), "trie-rows"))
    arrays = path_arrays(settle(trie_nodes(rebuilt, convs), "trie-nodes"), chunk)
    several = bool(arrays.filter("chunk > 0").limit(1).count())
    classes = sorted(r[0] for r in arrays.select("class").distinct().collect())  # at most 64
    done = []
    for c in classes:
        totals = [d.filter((F.col("up_class") == c) & (F.col("nodes")[0]["depth"] == F.col("head_depth"))).select(F.col("up_path").alias("path"), F.col("up_depth").alias("depth"), F.col("leaves")[0].alias("leaves"), F.col("saved")[0].alias("saved")) for d in done]
        brought = None
        for t in totals:
            brought = t if brought is None else brought.unionByName(t)
        done.append(settle_class(arrays.filter(F.col("class") == c), brought, several, chunk))
    if not done:
        done = [arrays.withColumn("leaves", F.array().cast("array<long>")).withColumn("saved", F.array().cast("array<long>"))]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    each = out.select(F.explode(F.arrays_zip("nodes", "leaves", "saved")).alias("x"))
    none = hashlib.sha256(b"").hexdigest()
    return each.select(
        F.col("x.nodes.conv_id").alias("conv_id"),
        F.col("x.nodes.depth").alias("depth"),
        F.col("x.nodes.parent_conv_id").alias("parent_conv_id"),
        F.col("x.nodes.n_convs").alias("n_convs"),
        F.col("x.nodes.n_children").alias("n_children"),
        F.col("x.leaves").alias("n_leaves"),
        F.col("x.saved").alias("saved_tokens"),
        F.coalesce(F.lower(F.hex("x.nodes.sha")), F.lit(none)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark, sf_dir):
    """The trie of ``conversations``."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), t AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, turns, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]))) % 9 AS h
  FROM t, crc
), r AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
  FROM h a LEFT JOIN t b ON b.conv_id = a.conv_id - a.conv_id % 5
), m AS (
  SELECT conv_id, d AS depth, turns[1:d] AS prefix, CASE WHEN d > 0 THEN turns[1:d - 1] END AS above, d = len(turns) AS is_end
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)
), n AS (
  SELECT depth, prefix, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM m GROUP BY depth, prefix
), w AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children,
         CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(prefix[depth].text) END AS saved
  FROM n LEFT JOIN (SELECT above, depth AS d, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL) k ON k.above = n.prefix AND k.d = n.depth + 1
), s AS (
  SELECT d AS depth, prefix[1:d] AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM w) GROUP BY ALL
)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN s ON s.depth = w.depth AND s.prefix = w.prefix LEFT JOIN w p ON p.depth = w.depth - 1 AND p.prefix = w.above
"""
