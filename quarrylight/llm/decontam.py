"""Benchmark decontamination by pigeonhole edit matching (operator 10).

A test item of m words may differ by e = floor(rate * m) word edits. Cut into
e + 1 pieces, at least one piece survives any e edits; an automaton finds exact
piece hits in whole texts, and Myers' bit-parallel distance over words decides
around each hit. Items of very few words are no evidence inside a sentence; they
count where a whole line of the text consists of them.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import table

RATE = 0.2
MIN_WORDS = 5
#: Characters of test items that one automaton may hold; more items make more
#: blocks, each of which scans all texts.
BLOCK_CHARS = 8 << 20
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Lower-cased letter and digit runs."""
    return WORD.findall((text or "").lower())


def pieces(m: int, e: int) -> list[tuple[int, int]]:
    """e + 1 near-equal ranges over m words."""
    bounds = [i * m // (e + 1) for i in range(e + 2)]
    return list(zip(bounds, bounds[1:]))


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """(least edit distance of pattern to any part of text, the part's end),
    the first end where several are as good. One bit a pattern word."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    up, down, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        # The first row stays 0: a match may start anywhere.
        ph, mh = ph << 1 & full, mh << 1 & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def match(item: list[str], e: int, text: list[str], around: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the item near text[around:], or None."""
    lo, hi = max(0, around - e), min(len(text), around + len(item) + e)
    best, end = myers(item, text[lo:hi])
    if best > e:
        return None
    back, length = myers(item[::-1], text[lo : lo + end][::-1])
    return best, lo + end - length, lo + end


class Matcher:
    """Test items, their pieces and the automaton over them."""

    def __init__(self, items: list[tuple], rate: float, min_words: int):
        import ahocorasick

        self.items, self.short, found = [], {}, {}
        for name, text in items:
            w = words(text)
            if not w:
                continue
            if len(w) < min_words:
                self.short.setdefault(tuple(w), []).append(len(self.items))
                self.items.append((name, w, 0))
                continue
            e = int(rate * len(w))
            n = len(self.items)
            self.items.append((name, w, e))
            for a, b in pieces(len(w), e):
                found.setdefault(" " + " ".join(w[a:b]) + " ", []).append((n, a, b - a))
        self.tree = ahocorasick.Automaton()
        for key, value in found.items():
            self.tree.add_word(key, value)
        if found:
            self.tree.make_automaton()
        self.longest = max(map(len, self.short), default=0)

    def find(self, text: str | None) -> list[tuple]:
        """(item, distance, start word, end word), best match per item."""
        if not self.items:
            return []
        own = words(text)
        line = " " + " ".join(own) + " "
        best = self.whole_lines(text) if self.short else {}
        tried = set()
        at, count = 0, 0
        for end, uses in self.tree.iter(line) if len(self.tree) else ():
            count += line.count(" ", at, end)
            at = end
            for n, a, length in uses:
                # count words end before the space at ``end``.
                around = count - length - a
                if (n, around) in tried:
                    continue
                tried.add((n, around))
                name, w, e = self.items[n]
                hit = match(w, e, own, around)
                if hit and (n not in best or hit < best[n]):
                    best[n] = hit
        return [(self.items[n][0], *hit) for n, hit in sorted(best.items())]


    def whole_lines(self, text: str | None) -> dict[int, tuple]:
        """The short items that are a whole line, at their first place."""
        best: dict[int, tuple] = {}
        at = 0
        for line in (text or "").split("\n"):
            own = words(line)
            for n in self.short.get(tuple(own), ()) if own and len(own) <= self.longest else ():
                best.setdefault(n, (0, at, at + len(own)))
            at += len(own)
        return best


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, limit: int):
    """The test items, in blocks of at most ``limit`` characters (or one item),
    of which the driver holds one at a time; one empty block where there are none."""
    block, held = [], 0
    for row in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).orderBy("i", "t").toLocalIterator():
        n = len(row.t or "")
        if block and held + n > limit:
            yield block
            block, held = [], 0
        block.append((row.i, row.t))
        held += n
    yield block


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, n_words, start_word, end_word: every test item
    found in a text within floor(rate * n_words) word edits, at its best place.

    Cases: null, empty and wordless texts or items match nothing; items of
    fewer than ``min_words`` words are found where they are a whole line. Rows
    that share an id, or have none, are searched one by one; repeated items are
    reported each. Empty tables give no rows. The benchmark is the query set: it
    is dealt in blocks of a checked size, each broadcast and held by one
    automaton a task; each block is one more pass over the texts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = dict(rows.dtypes)["doc_id"]
    item_type = dict(benchmark.dtypes)[item_col]
    schema = f"doc_id {ids}, item_id {item_type}, distance int, n_words int, start_word int, end_word int"
    out = None
    for items in blocks_of(benchmark, item_col, item_text_col, block_chars):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, held=held):
            block = held.value
            matcher = Matcher([(i, t) for i, (_, t) in enumerate(block)], rate, min_words)
            for batch in batches:
                found = [(d, *hit) for d, t in zip(range(batch.num_rows), batch.column(1)) for hit in matcher.find(t.as_py())]
                take = pa.array([f[0] for f in found], pa.int64())
                sizes = {name: len(w) for name, w, _ in matcher.items}
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).take(take),
                        "item_id": pa.array([block[f[1]][0] for f in found], item_arrow),
                        "distance": pa.array([f[2] for f in found], pa.int32()),
                        "n_words": pa.array([sizes[f[1]] for f in found], pa.int32()),
                        "start_word": pa.array([f[3] for f in found], pa.int32()),
                        "end_word": pa.array([f[4] for f in found], pa.int32()),
                    }
                )

        from pyspark.sql.pandas.types import to_arrow_type

        item_arrow = to_arrow_type(benchmark.schema[item_col].dataType)
        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns, in which no test item is found.

    Cases as in find_items: null, empty and wordless texts stay, and rows that
    share an id, or have none, are judged one by one. An empty benchmark keeps
    every row.
    """
    at = docs.columns.index(text_col)
    for items in blocks_of(benchmark, item_col, item_text_col, block_chars):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, held=held):
            matcher = Matcher(held.value, rate, min_words)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontaminate(spark, sf_dir):
    """Every ``benchmark`` item found in ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_items(docs, table(spark, sf_dir, "benchmark"))
