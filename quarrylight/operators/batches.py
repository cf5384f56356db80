"""Greedy batches under two limits, budget cascades and paging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.scan import running_sums
from quarrylight.scratch import settle

#: Items of a group in one array.
CHUNK = 1 << 15
MAX_ITEMS, MAX_TOKENS, BUDGET = 20, 50_000, 8_000


def followers(tokens: np.ndarray, own: int, max_items: int, max_tokens: int) -> np.ndarray:
    """For each of the first ``own`` items the place after the batch that starts
    with it, by binary search on prefix sums."""
    sums = np.concatenate([[0], np.cumsum(tokens)])
    fits = np.searchsorted(sums, sums[:own] + max_tokens, side="right") - 1
    starts = np.arange(own)
    return np.minimum(np.maximum(fits, starts + 1), starts + max_items)


def exits(follow: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """For each of the first ``most`` places of an array, where the chain of
    batches that enters there leaves it, and how many start inside."""
    own, to = len(follow), follow.tolist()
    leave, n = [0] * own, [0] * own
    for i in range(own - 1, -1, -1):
        j = to[i]
        leave[i], n[i] = (j - own, 1) if j >= own else (leave[j], n[j] + 1)
    # Places behind the end of a group's last chunk are never entered.
    return (leave + [0] * most)[:most], (n + [0] * most)[:most]


def greedy_batches(df: DataFrame, group: str, order: str, tokens: Column, max_items: int = MAX_ITEMS, max_tokens: int = MAX_TOKENS, chunk: int = CHUNK) -> DataFrame:
    """group, order, tokens, batch (from 0): items of a group in order; a batch
    closes when it is full or the next item would exceed the token limit. An
    item above the limit is a batch of its own. Null tokens count as none.

    Where a batch ends depends on where it starts alone, and it reaches at most
    ``max_items`` places on. A group is numbered by a scan over many tasks and cut
    into chunks; each chunk says for every place where it can be entered where it
    is left; these maps are composed over doubled distances, in as many rounds as
    the number of chunks has binary digits. So a group may be any size.
    """
    chunk = max(chunk, max_items)
    rows = df.select(F.col(group).alias("g"), F.col(order).alias("o"), tokens.cast("long").alias("tokens"))
    placed = running_sums(rows.withColumn("pos", F.lit(1).cast("long")), ["g"], [F.asc("o"), F.asc("tokens")], ["pos"])
    placed = placed.withColumn("pos", F.col("pos") - 1).withColumn("chunk", F.floor((F.col("pos")) / chunk))
    # A batch may reach into the next chunk: its first items are shown to both.
    near = placed.filter((F.col("chunk") > 0) & (F.col("pos") % chunk < max_items)).withColumn("chunk", F.col("chunk") - 1)
    item = F.struct("pos", F.coalesce("tokens", F.lit(0)).alias("size"), "o", "tokens")
    arrays = placed.unionByName(near).groupBy("g", "chunk").agg(F.sort_array(F.collect_list(item)).alias("items"))
    arrays = settle(arrays, "batches")
    types = dict(arrays.dtypes)

    def chunks(batch):
        for i in range(batch.num_rows):
            items = batch.column(2)[i].values
            pos, size = (items.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "size"))
            own = int(np.searchsorted(pos, (pos[0] // chunk + 1) * chunk))
            yield i, items, own, followers(size, own, max_items, max_tokens)

    def maps(batches):
        for batch in batches:
            out = [exits(follow, max_items) for _, _, _, follow in chunks(batch)]
            lists = [pa.array([m[k] for m in out], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["g", "chunk", "leave", "n"])

    # leave[e], n[e]: from the entrance e of the first of a stretch of chunks.
    last = arrays.agg(F.coalesce(F.max("chunk"), F.lit(0))).first()[0]
    # Of groups of one chunk no maps are needed: a first chunk with a next one shows
    # items of it.
    steps = arrays.filter((F.col("chunk") > 0) | (F.element_at("items", -1)["pos"] >= chunk))
    steps = settle(steps.mapInArrow(maps, f"g {types['g']}, chunk long, leave array<long>, n array<long>"), "batches-maps")
    # at: the entrance of each chunk reached so far; every round doubles the chunks behind.
    reach, span = steps.withColumn("from", F.col("chunk")), 1
    while span <= last:
        left = reach.select(F.col("g").alias("lg"), F.col("from").alias("lf"), (F.col("chunk") + 1).alias("lc"), F.col("leave").alias("ll"), F.col("n").alias("ln"))
        joined = reach.join(left, F.col("g").eqNullSafe(F.col("lg")) & (F.col("from") == F.col("lc")), "left")
        step = lambda a, b: F.when(F.col("lf").isNull(), F.col(b)).otherwise(F.transform(F.col("ll"), lambda e: F.get(F.col(b), e.cast("int"))) if a is None else F.transform(F.arrays_zip("ll", "ln"), lambda x: x["ln"] + F.get(F.col(b), x["ll"].cast("int"))))
        reach = settle(joined.select("g", "chunk", step(None, "leave").alias("leave"), step(1, "n").alias("n"), F.coalesce("lf", "from").alias("from")), "batches-maps")
        span *= 2
    enter = reach.select(F.col("g").alias("eg"), (F.col("chunk") + 1).alias("ec"), F.col("leave")[0].alias("enter"), F.col("n")[0].alias("base"))
    entered = arrays.join(enter, F.col("g").eqNullSafe(F.col("eg")) & (F.col("chunk") == F.col("ec")), "left").select("g", "chunk", "items", F.coalesce("enter", F.lit(0)).alias("enter"), F.coalesce("base", F.lit(0)).alias("base"))

    def numbered(batches):
        for batch in batches:
            enters, bases = (batch.column(c).to_pylist() for c in (3, 4))
            for i, items, own, follow in chunks(batch):
                starts, at = [], enters[i]
                while at < own:
                    starts.append(at)
                    at = int(follow[at])
                number = bases[i] - 1 + np.searchsorted(np.array(starts, np.int64), np.arange(own), side="right")
                part = items.slice(0, own)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * own, batch.column(0).type), part.field("o"), part.field("tokens"), pa.array(number.astype(np.int32))], [group, order, "tokens", "batch"])

    kinds = dict(rows.dtypes)
    return entered.mapInArrow(numbered, f"`{group}` {types['g']}, `{order}` {kinds['o']}, tokens long, batch int")


def cost_estimate(batches: DataFrame, group: str, prompt_chars: int, answer_chars: int = 500) -> DataFrame:
    """Tokens in and out per group, from the characters in its batches."""
    return batches.groupBy(group).agg(F.countDistinct("batch").alias("n_batches"), F.floor((F.sum(F.col("tokens") * 4) + F.countDistinct("batch") * prompt_chars) / 4).cast("long").alias("tokens_in"), F.floor(F.count("*") * answer_chars / 4).cast("long").alias("tokens_out"))


def budget_cascade(df: DataFrame, key: str, zones: list[tuple[str, str | None]], budget: int = BUDGET) -> DataFrame:
    """key, step, tokens: how far a document must be shortened.

    zones: (length, shorter length or None to drop) columns of characters, in
    the order in which they are shortened. Step 0 keeps all; each step shortens
    one zone more until the estimate fits; the last step is taken in any case.
    """
    full = [F.col(a) for a, _ in zones]
    short = [F.col(b) if b else F.lit(0) for _, b in zones]
    totals = []
    for s in range(len(zones) + 1):
        parts = [short[i] if i < s else full[i] for i in range(len(zones))]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        totals.append(F.floor(total / 4).cast("long"))
    step, tokens = F.lit(len(zones)), totals[-1]
    for s in range(len(zones) - 1, -1, -1):
        step, tokens = F.when(totals[s] <= budget, s).otherwise(step), F.when(totals[s] <= budget, totals[s]).otherwise(tokens)
    return df.select(key, step.alias("step"), tokens.alias("tokens"), (tokens > budget).alias("over"))


def page_rows(df: DataFrame, group: str, start: str, end: str | None = None, line: int | None = None, above: int = 30, show: int = 20) -> DataFrame:
    """Rows with ``pos`` and ``total``: groups of more than ``above`` rows are cut
    to ``show``, what contains the line first, then in line order."""
    total = F.count("*").over(Window.partitionBy(group))
    holds = ((F.col(start) <= line) & (F.col(end or start) >= line)).cast("int") if line is not None else F.lit(0)
    w = Window.partitionBy(group).orderBy(holds.desc(), F.col(start).asc())
    out = df.withColumn("total", total).withColumn("pos", F.row_number().over(w))
    return out.filter((F.col("total") <= above) | (F.col("pos") <= show))
