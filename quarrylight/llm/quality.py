"""Quality rules from compression bands (operator 6).

zstandard's ratio (compressed bytes / bytes) of a whole text and of fixed
chunks tells repetitive text (low) from text that looks like noise (high).
Short texts compress worse, so the limits are bands by length. Where rows are
labelled, the bands are fitted: to nearly all texts that are labelled good, in
classes of length; beyond the lengths that the labels show, fixed ones hold.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import SPACE_CHARS, settle, table

#: (bytes from, least ratio, greatest ratio) for whole texts; below the first
#: row a text is too short to judge. Prose at level 3 lies well inside.
BANDS = ((128, 0.40, 1.00), (256, 0.33, 0.90), (512, 0.30, 0.85), (1024, 0.28, 0.80), (2048, 0.26, 0.75), (4096, 0.25, 0.72), (16384, 0.22, 0.70))
CHUNK = 4096
#: Least and greatest ratio of a chunk, and the share of chunks outside that a
#: text may have.
CHUNK_BAND = (0.20, 0.80)
CHUNK_SHARE = 0.25
LEVEL = 3
#: A class of length has so many labelled good rows at least; the share of them
#: that lies beyond either limit before it is moved out by a part of its distance
#: from the median.
LEAST, LOST, MARGIN = 100, 0.005, 0.25
#: Bins of the unit interval in which order statistics are looked for.
BINS = 1 << 16
SYMBOLS = "#*$%&|<>"


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in a window of ``width`` words that the text has twice
    or more. Exact: windows are named by pairs, never by a hash."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    bits = max(1, (len(seen) - 1).bit_length())
    name = ids[:n].copy()
    used = bits
    for k in range(1, width):
        if used + bits > 62:
            distinct, name = np.unique(name, return_inverse=True)
            used = max(1, (len(distinct) - 1).bit_length())
        name = (name << bits) | ids[k : k + n]
        used += bits
    order = np.argsort(name, kind="stable")
    x = name[order]
    same = x[1:] == x[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = Counter(x for x in text.split("\n") if x.strip(SPACE_CHARS))
    dup = sum(lines.values()) - len(lines)
    chars = len(text) - sum(map(text.count, SPACE_CHARS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeat_words(words)


def limits(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    """The band of a text of n_bytes."""
    low, high = 0.0, float("inf")
    for start, a, b in bands:
        if n_bytes >= start:
            low, high = a, b
    return low, high


def class_starts() -> list[int]:
    """Where classes of length may start: powers of the square root of two."""
    return [round(128 * 2 ** (k / 2)) for k in range(60)]


def band_of(low: float, middle: float, high: float, margin: float = MARGIN) -> tuple[float, float]:
    """The limits that these quantiles of the ratios of good texts give."""
    return low - margin * (middle - low), high + margin * (high - middle)


def quantiles(rows: DataFrame, counts: dict[int, int], shares: list[float]) -> dict[int, list[float]]:
    """Exact quantiles, with linear interpolation, of v for every g (rows g, v; as
    many of each as counts says). Counts by bin come to the driver, no more than
    the bins; then the distinct values of the bins that hold what is looked for."""
    binned = rows.withColumn("bin", F.floor(F.col("v") * BINS).cast("long"))
    wanted = {g: sorted({k for q in shares for k in (int((n - 1) * q), min(int((n - 1) * q) + 1, n - 1))}) for g, n in counts.items()}
    sizes: dict[int, list] = {}
    for r in binned.groupBy("g", "bin").count().collect():
        sizes.setdefault(r.g, []).append((r.bin, r["count"]))
    holds: dict[tuple[int, int], int] = {}  # a bin that holds a wanted value, and how many come before
    for g, ranks in wanted.items():
        before = 0
        for at, n in sorted(sizes.get(g, [])):
            if any(before <= k < before + n for k in ranks):
                holds[g, at] = before
            before += n
    if not holds:
        return {}
    some = F.broadcast(rows.sparkSession.createDataFrame(list(holds), "g int, bin long"))  # six a group at most
    found: dict[tuple[int, int], float] = {}
    upto = dict(holds)
    for r in sorted(binned.join(some, ["g", "bin"]).groupBy("g", "bin", "v").count().collect(), key=lambda r: (r.g, r.bin, r.v)):
        start = upto[r.g, r.bin]
        upto[r.g, r.bin] = start + r["count"]
        found.update({(r.g, k): r.v for k in wanted[r.g] if start <= k < start + r["count"]})

    def between(g: int, q: float) -> float:
        at = (counts[g] - 1) * q
        k, t = int(at), at - int(at)
        a, b = found[g, k], found[g, min(k + 1, counts[g] - 1)]
        return b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t

    return {g: [between(g, q) for q in shares] for g in counts}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: int = LEAST, lost: float = LOST, margin: float = MARGIN) -> dict:
    """The bands for ``judge`` from all rows labelled good (1); rows whose
    crc32(id) is 2 modulo 4 are left out, to measure by.

    Bands are one a class of length; classes with fewer than ``least`` texts are
    joined with the next, and lengths that no full class shows keep the fixed
    ones. Cases: ids that are labelled both ways, null ids and labels teach
    nothing. Without enough labels the fixed bands hold. Sizes and ratios are
    written to the shared folder, a small row a text; texts are not moved.
    """
    teaches = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4 != 2
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    own = own.filter(teaches("doc_id")).groupBy("doc_id").agg(F.min("y").alias("low")).filter("low = 1").select("doc_id")
    rows = judge(docs.filter(teaches(id_col)), id_col, text_col, size=True).filter("ratio IS NOT NULL AND NOT base_failed")
    starts = class_starts()
    kind = sum((F.col("n_bytes") >= x).cast("int") for x in starts) - 1
    rows = rows.select("doc_id", "n_bytes", "ratio", "chunk_low", "chunk_high").join(own, "doc_id", "left_semi").withColumn("class", kind)
    good = settle(rows.drop("doc_id"), "ratios")
    classes = good.groupBy("class").agg(F.count("*").alias("n"), F.min("n_bytes").alias("first"), F.max("n_bytes").alias("last"), F.count("chunk_low").alias("chunks")).orderBy("class").collect()  # a row a class
    group_of, groups, held = {}, [], []
    for r in [r for r in classes if r["class"] >= 0]:
        held.append(r)
        if sum(h.n for h in held) >= least:
            group_of.update({h["class"]: len(groups) for h in held})
            groups.append((held[0].first, held[-1].last, sum(h.n for h in held)))
            held = []
    counts = {g: n for g, (_, _, n) in enumerate(groups)}
    chunks = sum(r.chunks for r in classes)
    parts = []
    if groups:
        of = F.create_map(*[F.lit(x) for kv in group_of.items() for x in kv])
        parts.append(good.select(of[F.col("class")].cast("int").alias("g"), F.col("ratio").alias("v")).filter("g IS NOT NULL"))
    if chunks >= least:
        counts |= {-1: chunks, -2: chunks}
        parts += [good.select(F.lit(g).alias("g"), F.col(c).alias("v")).filter("v IS NOT NULL") for g, c in ((-1, "chunk_low"), (-2, "chunk_high"))]
    if not parts:
        return {"bands": BANDS, "chunk_band": CHUNK_BAND}
    limits_of = {g: band_of(*q, margin) for g, q in quantiles(reduce(DataFrame.unionByName, parts), counts, [lost, 0.5, 1 - lost]).items()}
    bands = BANDS
    if groups:
        out = [(first, *limits_of[g]) for g, (first, _, _) in enumerate(groups)]
        stop = groups[-1][1] + 1
        bands = (*[b for b in BANDS if b[0] < out[0][0]], *out, (stop, *limits(stop)), *[b for b in BANDS if b[0] > stop])
    return {"bands": bands, "chunk_band": (limits_of[-1][0], limits_of[-2][1]) if chunks >= least else CHUNK_BAND}


class Judge:
    """Ratios and verdict of one text; chunks bound the memory."""

    def __init__(self, level=LEVEL, chunk=CHUNK, bands=BANDS, chunk_band=CHUNK_BAND, share=CHUNK_SHARE):
        self.packer = zstandard.ZstdCompressor(level=level)
        self.chunk, self.bands, self.chunk_band, self.share = chunk, bands, chunk_band, share

    def __call__(self, text: str | None) -> tuple[float | None, float | None, float | None, int, bool]:
        """ratio, least and greatest chunk ratio, chunks outside, verdict."""
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data:
            return None, None, None, 0, True
        ratio = len(self.packer.compress(data)) / len(data)
        low, high = limits(len(data), self.bands)
        starts = list(range(0, len(data) - self.chunk + 1, self.chunk))
        if starts and len(data) % self.chunk:
            starts.append(len(data) - self.chunk)  # the tail, as the last whole chunk
        parts = [len(self.packer.compress(data[at : at + self.chunk])) / self.chunk for at in starts]
        outside = sum(not self.chunk_band[0] <= x <= self.chunk_band[1] for x in parts)
        return ratio, min(parts, default=None), max(parts, default=None), outside, low <= ratio <= high and outside <= self.share * len(parts)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, repeat_percent: int = 20, size: bool = False, **options) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, the
    compression ratios, band_kept and kept; with ``size`` n_bytes too.

    Cases: a null or empty text has no words, so it fails the base rules; its
    ratios are null. Texts under 128 bytes are not judged by ratio, those under
    a chunk by their whole ratio alone; the last chunk of others ends with the
    text and may overlap the one before. Rows that share an id, or have none, are
    judged one by one. An empty table gives no rows; other columns of docs are
    not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = dict(rows.dtypes)["doc_id"]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "chunk_low", "chunk_high", "chunks_outside", "band_kept"]
    types = [pa.int64()] * 5 + [pa.float64()] * 3 + [pa.int64(), pa.bool_()]

    def run(batches):
        verdict = Judge(**options)
        for batch in batches:
            found = [base_counts(t) + verdict(t) for t in (x.as_py() for x in batch.column(1))]
            columns = list(zip(*found)) or [[]] * len(names)
            more = [pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())] if size else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types)), *more], ["doc_id", *names, *["n_bytes"] * size])

    schema = f"doc_id {ids}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, chunk_low double, chunk_high double, chunks_outside long, band_kept boolean"
    out = rows.mapInArrow(run, schema + (", n_bytes long" if size else ""))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("band_kept"))


def op6_quality(spark, sf_dir):
    """Base counts and verdicts over ``documents``, by bands fitted to ``labels``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bands = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, **bands).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunk_low", "chunk_high")
