"""Graph operators over edge tables: lookups, fan-in, ranking, resolution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.seeds import PIECE, Graph, Held, leading
from quarrylight.scratch import settle

DAMPING, ITERATIONS = 0.85, 5
TOP, COMPRESS = 12, 15
#: Rows that a task holds to find the first ones of groups.
HELD = 200_000


def callers_of(edges: DataFrame, nodes: DataFrame, callee, caller_col: str, callee_col: str, node_key: str, attributes: list[str]) -> DataFrame:
    """Distinct callers of one callee with their attributes. The callee filter
    reaches the scan of the edges; the rest is a semi-sized join."""
    who = edges.filter(F.col(callee_col) == callee).select(F.col(caller_col).alias(node_key)).distinct()
    return who.join(nodes.select(node_key, *attributes), node_key)


def fan_in(edges: DataFrame, callee_col: str, name: str = "fan_in") -> DataFrame:
    """Call sites per callee."""
    return edges.filter(F.col(callee_col).isNotNull()).groupBy(callee_col).agg(F.count("*").alias(name))


def reverse_edges(edges: DataFrame, src: str, dst: str, name: str = "used_by") -> DataFrame:
    """Per target the sorted distinct sources and their number; no self-loops."""
    return edges.filter(F.col(src) != F.col(dst)).groupBy(dst).agg(F.array_sort(F.collect_set(src)).alias(name)).withColumn(f"{name}_count", F.size(name).cast("long"))


def first_of_groups(rows: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """Rows among which are the first of every group without repeats: each task
    leaves out what cannot be one. A task holds few rows at a time."""
    columns = [group, *order]

    def least(table: pa.Table) -> pa.Table:
        table = table.group_by(columns).aggregate([]).select(columns)
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in columns], null_placement="at_start"))
        code = table[group].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        begins = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        pos = np.arange(len(code)) - np.repeat(begins, np.diff(np.r_[begins, len(code)]))
        return table.filter(pa.array(pos < limit))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                held = least(pa.Table.from_batches(held)).to_batches()
                n = sum(b.num_rows for b in held)
                if n > HELD // 2:  # groups of few rows: nothing is gained by holding them
                    yield from held
                    held, n = [], 0
        if n:
            yield from least(pa.Table.from_batches(held)).to_batches()

    some = rows.select(columns)
    return some.mapInArrow(firsts, some.schema)


def external_callers(edges: DataFrame, members: DataFrame, caller_col: str, callee_col: str, member_col: str, group_col: str, limit: int | None = None) -> DataFrame:
    """Calls into a group from outside it: (group, callee, caller).

    members maps a node to its group (a file). With a limit, the first callers
    of each group in key order.
    """
    inside = edges.join(members.select(F.col(member_col).alias(callee_col), F.col(group_col).alias("grp")), callee_col)
    home = members.select(F.col(member_col).alias(caller_col), F.col(group_col).alias("home"))
    out = inside.join(home, caller_col, "left").filter(~F.col("grp").eqNullSafe(F.col("home"))).select("grp", callee_col, caller_col)
    if limit is None:
        return out.distinct()
    w = Window.partitionBy("grp").orderBy(caller_col, callee_col)
    few = first_of_groups(out, "grp", [caller_col, callee_col], limit).distinct().select("grp", callee_col, caller_col)
    return few.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit)


def call_targets(edges: DataFrame, group_col: str, target_cols: list[str], limit: int) -> DataFrame:
    """The first distinct targets of every group, in order."""
    w = Window.partitionBy(group_col).orderBy(*[F.col(c).asc_nulls_first() for c in target_cols])
    return edges.select(group_col, *target_cols).distinct().withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit)


def seeded_centrality(nodes: DataFrame, edges: DataFrame, seed, node: str = "node", src: str = "src", dst: str = "dst", iterations: int = ITERATIONS, damping: float = DAMPING, personalised: bool = False) -> DataFrame:
    """node, score: a few rounds of power iteration from a start vector that is
    1 at the seed (uniform where the seed is no node).

    The teleport is uniform unless ``personalised``; mass at nodes without
    out-edges is lost; repeated edges count. The rounds are unrolled into one
    plan in which the partitioned edges are one reused exchange.
    """
    n = nodes.agg(F.count("*").cast("double")).scalar()
    known = nodes.filter(F.col(node) == seed).agg(F.count("*")).scalar()
    start = F.when(known == 0, 1.0 / n).when(F.col(node) == seed, 1.0).otherwise(0.0)
    degrees = edges.groupBy(src).agg(F.count("*").alias("deg"))
    weighted = edges.join(degrees, src).select(src, dst, (F.lit(damping) / F.col("deg")).alias("w"))
    jump = F.when(F.col(node) == seed, F.lit(1.0 - damping)).otherwise(0.0) if personalised else (1.0 - damping) / n
    scores = nodes.select(node, start.alias("score"))
    for _ in range(iterations):
        given = weighted.join(scores.withColumnRenamed(node, src), src).groupBy(dst).agg(F.sum(F.col("score") * F.col("w")).alias("given"))
        scores = nodes.select(node).join(given.withColumnRenamed(dst, node), node, "left").select(node, (jump + F.coalesce("given", F.lit(0.0))).alias("score"))
    return scores


def shared_centrality(nodes: DataFrame, edges: DataFrame, node: str, src: str, dst: str, iterations: int, damping: float) -> DataFrame:
    """node, score: what teleports give, which no seed has a part in."""
    n = nodes.agg(F.count("*").cast("double")).scalar()
    degrees = edges.groupBy(src).agg(F.count("*").alias("_deg"))
    weighted = edges.join(degrees, src).select(F.col(src).alias("_src"), F.col(dst).alias("_dst"), (F.lit(damping) / F.col("_deg")).alias("_w")).repartition("_src")
    every = nodes.select(F.col(node).alias("node")).repartition("node")
    base = every.withColumn("score", F.lit(0.0))
    for _ in range(iterations):
        moved = weighted.join(base, F.col("_src") == F.col("node")).select(F.col("_dst").alias("node"), (F.col("score") * F.col("_w")).alias("score"))
        given = moved.repartition("node").groupBy("node").agg(F.sum("score").alias("given"))
        base = every.join(given, "node", "left").select("node", ((1.0 - damping) / n + F.coalesce("given", F.lit(0.0))).alias("score"))
    return base


def seed_states(parts: Graph, nodes: DataFrame, seeds: DataFrame, iterations: int) -> DataFrame:
    """What each seed (by its number; -1 for those that are no nodes) adds after
    the rounds, as rows of ``seeds.SCHEMA``; of a node there may be several."""
    names = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct()
    own = names.join(parts.nodes, "node").select(parts.block_of("idx").alias("block"), F.col("idx").alias("key"), F.array("idx").alias("idx"), F.array(F.lit(1.0)).alias("score"))
    strangers = names.join(parts.nodes, "node", "left_anti").limit(1).select(F.lit(-1).cast("long").alias("key"))
    all_ = parts.nodes.groupBy(parts.block_of("idx").alias("block"), F.floor(F.col("idx") / PIECE).alias("_piece")).agg(F.collect_list("idx").alias("idx"))
    anywhere = all_.crossJoin(F.broadcast(strangers)).select("block", "key", "idx", F.transform("idx", lambda _: F.lit(1.0) / F.lit(nodes.count())).alias("score"))  # one row at most
    state = own.unionByName(anywhere)
    for _ in range(iterations):
        state = parts.round(state)
    return state


def seeded_centralities(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, node: str = "node", src: str = "src", dst: str = "dst", iterations: int = ITERATIONS, damping: float = DAMPING) -> tuple[DataFrame, DataFrame]:
    """As seeded_centrality for many seeds (one column) at once: (node, score),
    which no seed has a part in, and (seed, node, score), what a seed adds to it.

    The iteration is linear: teleports give the same to all seeds, and a seed's
    own start vector spreads over the nodes it reaches only, in blocks of the
    graph. Seeds that are no nodes start everywhere: their part is that of seed
    null.
    """
    parts = Graph(nodes, edges, node, src, dst, damping)
    state = seed_states(parts, nodes, seeds, iterations).select("key", F.explode(F.arrays_zip("idx", "score")).alias("x"))
    added = state.groupBy("key", "x.idx").agg(F.sum("x.score").alias("score")).join(parts.nodes, "idx")
    numbers = parts.nodes.select(F.col("idx").alias("key"), F.col("node").alias("seed"))
    return shared_centrality(nodes, edges, node, src, dst, iterations, damping), added.join(numbers, "key", "left").select("seed", "node", "score")


def best_centralities(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, top: int = TOP, node: str = "node", src: str = "src", dst: str = "dst", iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """seed, node, score, rank: as best_of_seeds over seeded_centralities, without
    a row for each seed and node; seeds are nodes."""
    parts = Graph(nodes, edges, node, src, dst, damping)
    if parts.is_small:
        named, base = held_bests(parts, nodes, seeds, top, iterations)
    else:
        base = settle(shared_centrality(nodes, edges, node, src, dst, iterations, damping), "scores")
        named = parts.best(seed_states(parts, nodes, seeds, iterations), base, top)
    numbers = parts.nodes.select(F.col("idx").alias("key"), F.col("node").alias("seed"))
    return ranked_of_seeds(named.join(parts.nodes, "idx").join(numbers, "key").select("seed", "node", "score"), base, seeds, top)


def held_bests(parts: Graph, nodes: DataFrame, seeds: DataFrame, top: int, iterations: int) -> tuple[DataFrame, DataFrame]:
    """(key, idx, score) as of Graph.best, and (node, score) of the nodes that can be
    the best without any seed, from a graph that every task holds. Each seed goes
    through its rounds in one task, and only its best nodes leave it."""
    spark = nodes.sparkSession
    held = Held(parts)
    base = held.shared(nodes.count(), iterations, parts.damping)
    shared = spark.sparkContext.broadcast((held, base))

    def run(batches):
        for batch in batches:
            graph, plain = shared.value
            keys = batch.column(0).to_numpy()
            bests = [graph.best(int(k), iterations, plain, top) for k in keys]
            each = np.repeat(keys, [len(idx) for idx, _ in bests])
            idx, score = (np.concatenate([np.empty(0, t), *(b[i] for b in bests)]) for i, t in ((0, np.int64), (1, np.float64)))
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.int64()), pa.array(idx, pa.int64()), pa.array(score)], ["key", "idx", "score"])

    keys = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().join(parts.nodes, "node").select(F.col("idx").alias("key"))
    named = keys.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, "key long, idx long, score double")
    idx, score = leading(np.arange(1, len(base)), base[1:], top)
    plain = spark.createDataFrame(list(zip(idx.tolist(), score.tolist())), "idx long, score double")
    return named, plain.join(parts.nodes, "idx").select("node", "score")


def best_of_seeds(base: DataFrame, parts: DataFrame, seeds: DataFrame, top: int = TOP) -> DataFrame:
    """seed, node, score, rank: the best nodes of every seed, from
    seeded_centralities; seeds are nodes."""
    added = parts.join(base.withColumnRenamed("score", "_base"), "node").select("seed", "node", (F.col("score") + F.col("_base")).alias("score"))
    return ranked_of_seeds(added, base, seeds, top)


def ranked_of_seeds(added: DataFrame, base: DataFrame, seeds: DataFrame, top: int) -> DataFrame:
    """The best of (seed, node, score). A node that a seed adds nothing to is
    among its best only if it is among the best without any seed."""
    name = seeds.columns[0]
    common = base.orderBy(F.round("score", 9).desc(), F.asc("node")).limit(top).collect()
    listed = F.array(*[F.struct(F.lit(r.node).alias("node"), F.lit(r.score).alias("score")) for r in common])
    plain = seeds.select(F.col(name).alias("seed")).distinct().select("seed", F.explode(listed).alias("x")).select("seed", "x.node", "x.score")
    all_ = added.unionByName(plain).groupBy("seed", "node").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.round("score", 9).desc(), F.asc("node")))
    return all_.withColumn("rank", rank).filter(F.col("rank") <= top)


def ranked_dependents(scores: DataFrame, candidates: DataFrame, fan_ins: DataFrame, node: str = "node", top: int = TOP, threshold: int = COMPRESS) -> DataFrame:
    """The best-scored candidates with their fan-in, and whether it is large
    enough to show the node in short."""
    best = candidates.join(scores, node).orderBy(F.round("score", 9).desc(), F.col(node).asc()).limit(top)
    return best.join(fan_ins, node, "left").select(node, F.round("score", 6).alias("score"), F.coalesce("fan_in", F.lit(0)).cast("long").alias("fan_in"), (F.coalesce("fan_in", F.lit(0)) > threshold).alias("compressed"))


def ancestor_closure(parents: DataFrame, child: str, parent: str, depth: int | None = None) -> DataFrame:
    """node, ancestor, distance (of the shortest chain) for chains of up to
    ``depth`` steps, or of any length; a node is no ancestor of itself, so loops
    are harmless.

    Each round doubles the distance: pairs at exactly the distance so far are
    carried on by all pairs known, so chains of n steps take log2(n) rounds. Each
    round's new pairs are written to the shared folder."""
    step = parents.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).filter("ancestor IS NOT NULL AND node <> ancestor").distinct()
    known = settle(step.withColumn("distance", F.lit(1)), "closure")
    span = 1
    while depth is None or span < depth:
        ahead = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"), F.col("distance").alias("more"))
        further = known.filter(F.col("distance") == span).join(ahead, "ancestor").filter("node <> far")
        if depth is not None:
            further = further.filter(F.lit(span) + F.col("more") <= depth)
        shortest = further.groupBy("node", F.col("far").alias("ancestor")).agg((F.min("more") + span).cast("int").alias("distance"))
        new = settle(shortest.join(known, ["node", "ancestor"], "left_anti"), "closure")
        if new.isEmpty():
            break
        known, span = known.unionByName(new), span * 2
    return known


def first_rule(*rules: DataFrame, key: list[str], value: str, name: str = "rule") -> DataFrame:
    """A cascade: of the rules' answers (key, value), the one of the first rule
    that has any; within a rule the least value."""
    union = None
    for i, rule in enumerate(rules, 1):
        part = rule.select(*key, F.col(value), F.lit(i).alias(name))
        union = part if union is None else union.unionByName(part)
    best = F.min(F.struct(name, value))
    return union.filter(F.col(value).isNotNull()).groupBy(*key).agg(best.alias("best")).select(*key, f"best.{value}", f"best.{name}")


def by_unique_name(nodes: DataFrame, key: str, name: str, most: int = 5) -> DataFrame:
    """name -> target where one node has it; else the first candidates. Of a
    name that very many nodes have no more than ``most`` keys a task are moved."""
    counts = nodes.groupBy(name).agg(F.count("*").alias("n_matches"), F.min(key).alias("least"))
    rank = F.row_number().over(Window.partitionBy("_name").orderBy(key))
    first = nodes.select(F.col(name).alias("_name"), key).distinct().withColumn("_rank", rank).filter(F.col("_rank") <= most)
    lists = first.groupBy("_name").agg(F.array_sort(F.collect_list(key)).alias("candidates"))
    joined = counts.join(lists, F.col(name).eqNullSafe(F.col("_name")), "left")
    return joined.select(name, "n_matches", F.when(F.col("n_matches") == 1, F.col("least")).alias("target"), (F.col("n_matches") > 1).alias("is_ambiguous"), F.coalesce("candidates", F.array().cast(lists.schema["candidates"].dataType)).alias("candidates"))


def bearers(nodes: DataFrame, key: str, name: str, most: int = 5) -> DataFrame:
    """As by_unique_name without the number of nodes. One shuffle, to which a task
    gives no more than the first ``most`` keys of a name."""
    rank = F.dense_rank().over(Window.partitionBy(name).orderBy(key))
    first = nodes.select(name, key).withColumn("_rank", rank).filter(F.col("_rank") <= most)
    found = first.groupBy(name).agg(F.count("*").alias("_n"), F.min(key).alias("_least"), F.array_sort(F.collect_set(key)).alias("candidates"))
    return found.select(name, F.when(F.col("_n") == 1, F.col("_least")).alias("target"), (F.col("_n") > 1).alias("is_ambiguous"), "candidates")


def rebuild_scope(edges: DataFrame, callers: DataFrame, callees: DataFrame, caller_col: str, callee_col: str) -> DataFrame:
    """id of every caller whose edges must be made again: the callers that are
    in ``callers`` themselves and those of anything in ``callees``, once each."""
    own = edges.join(callers.select(caller_col).distinct(), caller_col, "left_semi")
    others = edges.join(callees.select(callee_col).distinct(), callee_col, "left_semi")
    return own.select(F.col(caller_col).alias("id")).unionByName(others.select(F.col(caller_col).alias("id"))).distinct()


def first_candidate(wanted: DataFrame, key: str, candidates: Column, known: DataFrame, known_col: str, name: str = "resolved") -> DataFrame:
    """Of an ordered array of candidate values per key the first that is known;
    null where none is."""
    each = wanted.select(key, F.posexplode(candidates).alias("prio", "candidate"))
    found = each.join(known.select(F.col(known_col).alias("candidate")).distinct(), "candidate").groupBy(key).agg(F.min(F.struct("prio", "candidate")).alias("hit"))
    return wanted.select(key).distinct().join(found, key, "left").select(key, F.col("hit.candidate").alias(name), F.col("hit.prio").alias("prio"))
