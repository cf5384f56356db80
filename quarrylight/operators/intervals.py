"""Points in intervals, without any key that both sides share: all pairs, or what
the points of each interval come to."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.scratch import settle

#: Points of a bin that are met by its intervals in one group.
HOT = 100_000
#: Places of a slab; intervals that one share of a slab answers; rows of a task.
SLAB, SHARE, ROWS = 1 << 15, 250_000, 1_000_000
#: The least and the greatest of no values.
NO_LEAST, NO_MOST = (1 << 63) - 1, -(1 << 63)


def level_of(start: Column, end: Column) -> Column:
    """The least level whose bins, 2^level wide, are no shorter than the interval."""
    return F.length(F.bin(end - start)) - F.when(end == start, 1).otherwise(0)


def contained(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, hot: int = HOT) -> DataFrame:
    """All columns of both for every point inside an interval (start <= at <=
    end; whole numbers). Nulls, and intervals that end before they start, hold
    nothing.

    An interval lies in at most two bins of its own level, where bins are no
    shorter than it; a point looks up one bin at each level that occurs (64 at
    most). Bins with more than ``hot`` points are dealt out by points, and their
    intervals repeated as often. Column names of the two sides differ.
    """
    real = intervals.filter(F.col(start) <= F.col(end)).withColumn("_level", level_of(F.col(start), F.col(end)).cast("int"))
    cell = lambda x: F.expr(f"shiftright({x}, _level)")
    binned = real.withColumn("_bin", F.explode(F.array_distinct(F.array(cell(f"`{start}`"), cell(f"`{end}`")))))
    levels = sorted(r[0] for r in real.select("_level").distinct().collect())  # at most 64
    seen = points.filter(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_bin", cell(f"`{at}`"))
    used = binned.select("_level", "_bin").distinct()
    crowded = seen.groupBy("_level", "_bin").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).join(used, ["_level", "_bin"], "left_semi")
    shares = crowded.select("_level", "_bin", F.ceil(F.col("_n") / hot).cast("int").alias("_shares"))
    one = F.coalesce("_shares", F.lit(1))
    left = seen.join(shares, ["_level", "_bin"], "left").withColumn("_share", F.floor(F.rand(7) * one).cast("int")).drop("_shares")
    right = binned.join(shares, ["_level", "_bin"], "left").withColumn("_share", F.explode(F.sequence(F.lit(0), one - 1))).drop("_shares")
    inside = left.join(right, ["_level", "_bin", "_share"]).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    return inside.drop("_level", "_bin", "_share")


class Ranges:
    """Sums, least and greatest values of any stretches of a few arrays."""

    def __init__(self, n: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.upto = np.concatenate([[0], np.cumsum(n)])
        self.least, self.most, span = [least], [most], 1
        while 2 * span <= len(n):  # of stretches of 1, 2, 4, ...
            for tables, pick in ((self.least, np.minimum), (self.most, np.maximum)):
                tables.append(pick(tables[-1][:-span], tables[-1][span:]))
            span *= 2

    def over(self, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From places a up to, not including, z; nothing where z <= a."""
        least, most = np.full(len(a), NO_LEAST), np.full(len(a), NO_MOST)
        some = z > a
        level = np.frexp(np.maximum(z - a, 1).astype(float))[1] - 1
        for k in np.unique(level[some]):
            at = np.flatnonzero(some & (level == k))
            left, right = a[at], z[at] - (1 << int(k))
            least[at] = np.minimum(self.least[k][left], self.least[k][right])
            most[at] = np.maximum(self.most[k][left], self.most[k][right])
        return np.where(some, self.upto[np.maximum(z, a)] - self.upto[a], 0), least, most


def slabs_of(points: DataFrame, at: str, value: str) -> DataFrame:
    """first, last, n, least, most, held: the places that have points, in order, up
    to SLAB of them a row; ``held`` has four arrays of longs, the places and what
    lies at each."""
    own, size = F.col(value).cast("long"), SLAB
    places = points.filter(F.col(at).isNotNull()).groupBy(F.col(at).cast("long").alias("at"))
    places = places.agg(F.count("*").alias("n"), F.coalesce(F.min(own), F.lit(NO_LEAST)).alias("least"), F.coalesce(F.max(own), F.lit(NO_MOST)).alias("most"))
    names = ["first", "last", "n", "least", "most", "held"]

    def slab(columns):
        ats, ns, leasts, mosts = columns
        one = [ats[0], ats[-1], ns.sum(), leasts.min(), mosts.max()]
        return pa.RecordBatch.from_arrays([*(pa.array([int(x)], pa.int64()) for x in one), pa.array([np.concatenate(columns).tobytes()], pa.binary())], names)

    def cut(batches):
        held = [np.empty(0, np.int64)] * 4
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            while len(held[0]) >= size:
                yield slab([h[:size] for h in held])
                held = [h[size:] for h in held]
        if len(held[0]):
            yield slab(held)

    kinds = ", ".join(f"{c} {'long' if i < 5 else 'binary'}" for i, c in enumerate(names))
    return settle(places.repartitionByRange("at").sortWithinPartitions("at").mapInArrow(cut, kinds), "slabs")


def summaries(points: DataFrame, intervals: DataFrame, at: str, value: str, key: str, start: str, end: str) -> DataFrame:
    """key, n, least, most: of all points inside intervals of a key their number and
    the least and greatest value (whole numbers), as contained() grouped by the key
    would give them, but without a row for each point and interval.

    The places of points are cut into slabs. An interval asks the slabs in which it
    starts and ends; what lies between is known from a row for each slab. So work
    grows with points and intervals, however many points an interval holds. Slabs
    that very many intervals ask are repeated, and the intervals dealt out.
    """
    spark = points.sparkSession
    slabs = slabs_of(points, at, value)
    rows = sorted(slabs.select("first", "last", "n", "least", "most").collect())  # one a slab
    first, last, *held = (np.array([r[i] for r in rows], np.int64) for i in range(5))
    between, share = Ranges(*held), SHARE
    real = intervals.filter(F.col(start) <= F.col(end)).select(F.col(key).alias("key"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    kind = dict(real.dtypes)["key"]

    def asked(batch):
        """(interval, slab or -1, what is known already) by the row of the batch."""
        s, e = (batch.column(c).to_numpy() for c in ("s", "e"))
        i, j = np.searchsorted(first, s, "right") - 1, np.searchsorted(first, e, "right") - 1
        past = np.append(last, 0)  # place -1, before the first slab, is of no meaning
        left = (i >= 0) & (past[i] >= s)
        right = (j > i) & (past[j] > e)
        known = between.over(i + 1, np.where(right, j, j + 1))
        alone = ~left & ~right & (known[0] > 0)
        parts = [np.flatnonzero(m) for m in (left, right, alone)]
        row, slab = np.concatenate(parts), np.concatenate([i[parts[0]], j[parts[1]], np.full(len(parts[2]), -1)])
        # What lies between is told once.
        tells = np.concatenate([np.ones(len(parts[0]), bool), ~left[parts[1]], np.ones(len(parts[2]), bool)])
        return row, slab, [np.where(tells, x[row], no) for x, no in zip(known, (0, NO_LEAST, NO_MOST))]

    def counts(batches):
        total = np.zeros(len(first) + 1, np.int64)
        for batch in batches:
            total += np.bincount(asked(batch)[1] + 1, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some - 1, pa.int64()), pa.array(total[some], pa.int64())], ["slab", "n"])

    met = {r[0]: r[1] for r in real.mapInArrow(counts, "slab long, n long").groupBy("slab").agg(F.sum("n")).collect()}  # one a slab
    shares = np.ones(len(first) + 1, np.int64)  # at the end those that ask no slab
    for k, n in met.items():
        shares[k] = -(-n // share)

    def questions(batches):
        turn = 0
        for batch in batches:
            row, slab, known = asked(batch)
            deal = (turn + np.arange(len(row))) % shares[slab]
            turn += len(row)
            names = pa.array(np.append(first, 0)[slab], mask=slab < 0)
            yield pa.RecordBatch.from_arrays([names, pa.array(deal), *(batch.column(c).take(pa.array(row)) for c in ("key", "s", "e")), *map(pa.array, known)], ["slab", "share", "key", "s", "e", "n", "least", "most"])

    ask = real.mapInArrow(questions, f"slab long, share long, key {kind}, s long, e long, n long, least long, most long")
    ask = ask.select("slab", "share", F.lit(1).alias("kind"), "key", "s", "e", "n", "least", "most", F.lit(None).cast("binary").alias("held"))
    dealt = spark.createDataFrame([(int(first[k]), int(shares[k])) for k in met if k >= 0], "first long, shares long")
    each = slabs.join(F.broadcast(dealt), "first").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    each = each.select(F.col("first").alias("slab"), "share", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("key"), *(F.lit(0).cast("long").alias(c) for c in ("s", "e", "n", "least", "most")), "held")
    tasks = max(4 * spark.sparkContext.defaultParallelism, sum(met.values()) // ROWS + 1)
    both = each.unionByName(ask).repartition(tasks, "slab", "share").sortWithinPartitions("slab", "share", "kind")

    def answers(batches):
        ats = inside = None
        for batch in batches:
            heads = np.flatnonzero(batch.column("kind").to_numpy() == 0)
            for k, (a, z) in enumerate(zip(np.append(0, heads), np.append(heads, batch.num_rows))):
                part = batch.slice(a, z - a)
                if k:
                    ats, *own = np.frombuffer(part.column("held")[0].as_py(), np.int64).reshape(4, -1)
                    inside = Ranges(*own)
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                s, e, n, least, most = (part.column(c).to_numpy() for c in ("s", "e", "n", "least", "most"))
                if inside is not None:  # rows that ask no slab come before all others
                    more = inside.over(np.searchsorted(ats, s, "left"), np.searchsorted(ats, e, "right"))
                    n, least, most = n + more[0], np.minimum(least, more[1]), np.maximum(most, more[2])
                some = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n), pa.array(least), pa.array(most)], ["key", "n", "least", "most"]).filter(some)

    found = both.mapInArrow(answers, f"key {kind}, n long, least long, most long")
    total = found.groupBy("key").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    real_value = F.col("least") <= F.col("most")  # else all values are null
    return total.select(F.col("key").alias(key), "n", F.when(real_value, F.col("least")).alias("least"), F.when(real_value, F.col("most")).alias("most"))
