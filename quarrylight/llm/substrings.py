"""Repeated word passages by recompression (operator 8).

Rounds of recompression rename pairs of symbols. Which neighbours pair depends
on one pseudo-random side of each name, and a name is a hash of what it stands
for, so it is the same in every document and every task: naming is global
without a dictionary that rounds would have to exchange, and all rounds run in
one Spark stage. Equal passages thus get equal symbols in their interior. Every
symbol knows the words that decide it; a window of ``width`` words is
represented by the symbols that its own words decide at the highest level that
has them, whatever surrounds it, and a window inside a run of one word by that
run. Windows whose symbols no other document shows cannot be repeats. The others
are verified by 128 bits of hashes of their words.

Runs are named for single words only: naming the runs of symbols in every round
needs both neighbours of each symbol, so that windows of 13 words reach two
levels instead of four (README has the figures).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import settle, table

WIDTH = 13
ROUNDS = 4
SALTS = 64
#: Bytes of text per block of the parse; a longer document is a block of its own.
BLOCK = 1 << 20
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def mix(a: np.ndarray, b) -> np.ndarray:
    """A 64-bit name from two; order matters."""
    x = (a ^ (a >> np.uint64(29))) * M1 + (b ^ (b >> np.uint64(32))) * M2
    x ^= x >> np.uint64(31)
    x *= M3
    return x ^ (x >> np.uint64(30))


def anchors(names: np.ndarray, docs: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS, least: int = 2) -> np.ndarray:
    """For each word the anchor of the window that starts there; 0 where the
    window would leave the document.

    names: a hash per word, documents one after the other; docs: the number of
    the document that each word is in, ascending. A window's anchor joins the
    first and the last symbol that its words decide, at the highest level with
    ``least`` such symbols; the words themselves are level 0. A window that
    lies in a run of one word is named by that word.
    """
    n = len(names)
    out = np.zeros(n, np.uint64)
    if n < width:
        return out
    at = np.flatnonzero(docs[: n - width + 1] == docs[width - 1 :])
    edge = np.flatnonzero(np.diff(docs)) + 1
    begins, stops = np.concatenate([[0], edge]), np.append(edge, n)
    # [lo, hi) are the words that decide a symbol; a document's edge is no word,
    # so what depends on it is decided by no window.
    doc, name = np.searchsorted(begins, np.arange(n), side="right") - 1, names
    lo, hi = np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64)
    levels = [(name, lo, hi)]
    for r in range(1, rounds + 1):
        left = (mix(name, np.full(1, 977 + r, np.uint64)) & np.uint64(1)) == 0
        same = doc[1:] == doc[:-1]
        pair = np.append(left[:-1] & ~left[1:] & same, False)
        keep = np.concatenate([[True], ~pair[:-1]])
        # A pair needs both of its symbols; one that stays alone needs the
        # neighbour that it might have paired with.
        lo_n, hi_n = np.append(np.where(same, lo[1:], n), n), np.append(np.where(same, hi[1:], stops[doc[:-1]] + 1), n + 1)
        lo_p, hi_p = np.concatenate([[-1], np.where(same, lo[:-1], begins[doc[1:]] - 1)]), np.concatenate([[0], np.where(same, hi[:-1], 0)])
        lo, hi = np.minimum(lo, np.where(left, lo_n, lo_p)), np.maximum(hi, np.where(left, hi_n, hi_p))
        name = np.where(pair, mix(name, np.append(name[1:], name[:1])), name)
        name, doc, lo, hi = name[keep], doc[keep], lo[keep], hi[keep]
        levels.append((name, lo, hi))
    # How many symbols start before, and end by, each word: both ascend.
    ranks = []
    for _, lo, hi in levels:
        before = np.cumsum(np.bincount(np.clip(lo + 1, 0, n + 1), minlength=n + 2))
        until = np.cumsum(np.bincount(np.clip(hi, 0, n + 1), minlength=n + 2))
        ranks.append((before, until))
    for need in (least, 1):
        for level in range(rounds, -1, -1):
            if not len(at):
                break
            name = levels[level][0]
            first, last = ranks[level][0][at], ranks[level][1][at + width] - 1
            ok = last - first >= need - 1
            f, z = first[ok], last[ok]
            out[at[ok]] = mix(mix(name[f], name[z]), np.full(1, level + 1, np.uint64)) | np.uint64(1)
            at = at[~ok]
    alone = np.zeros(n, np.int64)
    alone[1:] = (names[1:] != names[:-1]) | (docs[1:] != docs[:-1])
    changes = np.cumsum(alone)
    inside = np.flatnonzero((changes[: n - width + 1] == changes[width - 1 :]))
    out[inside] = mix(names[inside], np.full(1, width, np.uint64)) | np.uint64(1)
    return out


def hashed_words(texts: pa.Array, seeds: tuple[int, ...] = (0,)):
    """Blocks of (names, rows): for each seed a hash per word of whole texts, and
    the index of the row that each word is in. A row is never cut."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    digest, at = xxhash.xxh64_intdigest, 0
    while at < len(texts):
        total = np.cumsum(sizes[at:])
        end = at + max(1, int(np.searchsorted(total, BLOCK, side="right")))
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.slice(at, end - at), "").cast(pa.large_string()))
        words = pc.dictionary_encode(lists.flatten())
        rows = np.repeat(np.arange(at, end), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        known = words.dictionary.cast(pa.large_binary()).to_pylist()
        index = words.indices.to_numpy(zero_copy_only=False)
        if b"" in known:
            keep = index != known.index(b"")
            index, rows = index[keep], rows[keep]
        if len(index):
            yield [np.array([digest(w, seed) for w in known], dtype=np.uint64)[index] for seed in seeds], rows
        at = end


#: A spot is a window's first word and how many windows from there on have the
#: same anchor, in one number.
SPAN = 16


def anchor_rows(docs: DataFrame, width: int, rounds: int) -> DataFrame:
    """key, doc, spot, known: the anchors of documents (doc, text).

    known: another document of the same block has the anchor too, so it is
    shared. Of such an anchor one row a block goes on to be compared, the others
    need no comparing; a very common anchor thus stays small.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for (names,), rows in hashed_words(batch.column(1)):
                keys = anchors(names, rows, width, rounds)
                begins = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
                first = begins[np.searchsorted(begins, np.arange(len(rows)), side="right") - 1]
                pos = np.arange(len(rows)) - first
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
                head = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
                start = np.flatnonzero((keys > 0) & ((np.arange(len(keys)) - head) % (SPAN - 1) == 0))
                ends = np.append(start[1:], len(keys))
                stop = np.flatnonzero(np.append(new[1:], True)) + 1
                ends = np.minimum(ends, stop[np.searchsorted(stop, start, side="right")])
                key, doc, spot = keys[start].view(np.int64), ids[rows[start]], pos[start] * SPAN + (ends - start)
                order = np.lexsort((doc, key))
                key, doc, spot = key[order], doc[order], spot[order]
                fresh = np.ones(len(key), bool)
                fresh[1:] = key[1:] != key[:-1]
                at = np.flatnonzero(fresh)
                counts = np.diff(np.append(at, len(key)))
                many = np.repeat(doc[at] != doc[at + counts - 1], counts)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(spot.astype(np.int64)), pa.array(many), pa.array(fresh | ~many)], ["key", "doc", "spot", "known", "compared"])

    return docs.mapInArrow(run, "key long, doc long, spot long, known boolean, compared boolean")


def shared(batches):
    """Of rows sorted by key and doc, (doc, spot) of those that are known to be
    shared or whose key more than one document shows. A batch's first and last
    keys pass unseen: their groups may go on in another batch, and a needless
    candidate does no harm."""
    for batch in batches:
        key, doc, spot, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(key)) - 1
        many = doc[first] != doc[last]
        many[0] = many[-1] = True
        keep = np.repeat(many, last - first + 1) | known
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(spot[keep])], ["doc", "spot"])


def rolling(names: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the width names from each on; the last width - 1 places
    have none."""
    n = max(0, len(names) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        x = names[k : k + n]
        out += (x ^ (x >> np.uint64(31))) * (M1 * np.uint64(2 * k + 1))
    return mix(out, np.full(1, width, np.uint64))


def window_hashes(width: int):
    """h1, h2, doc, row, pos of the windows at a row's spots."""

    def run(batches):
        for batch in batches:
            docs, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            spots = batch.column(3)
            for names, rows in hashed_words(batch.column(2), (0, 1)):
                first, second = (rolling(x, width) for x in names)
                begins = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1, [len(rows)]])
                places, firsts = [], []
                for begin, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
                    some = spots[int(rows[begin])].values.to_numpy(zero_copy_only=False)
                    start, n = some // SPAN, some % SPAN
                    at = np.unique(np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()))
                    at = at[at + width <= end - begin]
                    places.append(begin + at)
                    firsts.append(np.full(len(at), begin))
                at, begin = np.concatenate(places), np.concatenate(firsts)
                own_rows = rows[at]
                yield pa.RecordBatch.from_arrays([pa.array(first[at].view(np.int64)), pa.array(second[at].view(np.int64)), pa.array(docs[own_rows]), pa.array(own[own_rows]), pa.array((at - begin).astype(np.int32))], ["h1", "h2", "doc", "row", "pos"])

    return run


LOST, OPEN, HEAD = 0, 1, 2


def first_owners(batches):
    """kind, h1, h2, doc, row, pos from windows sorted by hash and document.

    LOST: a smaller document owns the window. A partition's first group may
    have begun in the one before, so its rows are OPEN; and its last group's
    first document is told as HEAD.
    """
    schema = pa.schema([("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("pos", pa.int32())])
    key, owner, opening = None, None, True
    for batch in batches:
        h1, h2, doc, row, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if not len(h1):
            continue
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        goes_on = key == (h1[0], h2[0])
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        owners = doc[at].copy()
        if goes_on:
            owners[0] = owner
        is_open = group == 0 if opening and (goes_on or key is None) else np.zeros(len(h1), bool)
        lost = (doc > owners[group]) & ~is_open
        opening = bool(opening and (goes_on or key is None) and len(at) == 1)
        key, owner = (h1[-1], h2[-1]), owners[-1]
        keep = lost | is_open
        kind = np.where(is_open, OPEN, LOST).astype(np.int8)[keep]
        yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(x[keep]) for x in (h1, h2, doc, row, pos))], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"kind": HEAD, "h1": int(key[0]), "h2": int(key[1]), "doc": int(owner), "row": 0, "pos": -1}], schema)


def lost_windows(windows: DataFrame) -> DataFrame:
    """doc, row, pos of the windows that a smaller document has too.

    Ranges over (hash, document) cut even one very common window across tasks.
    Groups that a cut divides are settled by the partitions' first and last
    groups.
    """
    sorted_ = windows.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc")
    found = settle(sorted_.mapInArrow(first_owners, "kind byte, h1 long, h2 long, doc long, row long, pos int"), "owners")
    # At most two keys a partition come to the driver: its first and its last.
    divided = found.filter(F.col("kind") != LOST).groupBy("h1", "h2").agg(F.min("doc").alias("owner"), F.max(F.col("kind") == OPEN).alias("open")).filter("open")
    owners = {(r.h1, r.h2): r.owner for r in divided.select("h1", "h2", "owner").collect()}

    def settle_open(batches):
        for batch in batches:
            kind, h1, h2, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            keep = kind == LOST
            at = np.flatnonzero(kind == OPEN)
            if len(at):
                pairs, which = np.unique(np.stack([h1[at], h2[at]], 1), axis=0, return_inverse=True)
                least = np.array([owners[int(a), int(b)] for a, b in pairs], np.int64)
                keep[at] = least[which.ravel()] < doc[at]
            yield batch.select(["doc", "row", "pos"]).filter(pa.array(keep))

    return found.mapInArrow(settle_open, "doc long, row long, pos int")


def passage_spans(positions: np.ndarray, width: int) -> list[dict]:
    """Word ranges that the windows at these positions cover."""
    p = np.unique(positions)
    if not len(p):
        return []
    cut = np.flatnonzero(np.diff(p) > width) + 1
    return [{"start": int(x[0]), "end": int(x[-1]) + width} for x in np.split(p, cut)]


def kept_words(words: list[bytes], spans) -> tuple[int, bytes]:
    """(words removed, the other words joined by one space)."""
    out, at, gone = [], 0, 0
    for s in spans or ():
        out += words[at : s["start"]]
        gone += s["end"] - s["start"]
        at = s["end"]
    out += words[at:]
    return gone, b" ".join(out)


def final(joined: bytes, keep: str) -> str:
    return hashlib.sha256(joined).hexdigest() if keep == "sha256" else joined.decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, rounds: int = ROUNDS, keep: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (word ranges removed), kept (the other
    words, or with keep="sha256" their digest) for every row of docs.

    A word goes if a window of ``width`` words that covers it also starts in a
    document with a smaller id. Ids are integers. Cases: null, empty and short
    texts have no window and lose nothing. Rows with a null id own nothing and
    lose nothing. Rows that share an id are one document: they own windows
    together and each loses its own. An empty table gives no rows. Other
    columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    salt = F.pmod(F.xxhash64(F.lit(7), id_col), F.lit(SALTS)).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("row"), F.xxhash64(F.lit(1), text).alias("row2"), salt.alias("salt"), text.alias("text"))
    known = rows.filter(F.col("doc").isNotNull())

    # A text that a smaller document has whole needs no windows. One that very
    # many documents have meets its owner salt by salt.
    owners = known.groupBy("row", "row2").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")).filter("owner < last")
    places = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col("salts"), i) == 1)
    owners = owners.select("row", "row2", "owner", F.explode(places).alias("salt"))
    copies = settle(known.select("doc", "row", "row2", "salt").join(owners, ["row", "row2", "salt"]).filter("owner < doc").groupBy("doc").agg(F.collect_set("row").alias("copies")), "copies")
    left = known.select("doc", "row", "text").join(copies, "doc", "left").filter(~F.coalesce(F.array_contains("copies", F.col("row")), F.lit(False))).select("doc", "text")

    keyed = anchor_rows(left, width, rounds)
    place = F.when(F.col("compared"), F.col("key")).otherwise(F.xxhash64("doc"))
    dealt = keyed.select("key", "doc", "spot", "known", place.alias("place")).repartition("place").drop("place").sortWithinPartitions("key", "doc")
    wanted = settle(dealt.mapInArrow(shared, "doc long, spot long"), "anchors")

    # Rows that share an id all get its spots; a needless one does no harm.
    spots = wanted.groupBy("doc").agg(F.collect_list("spot").alias("spots"))
    some = known.select("doc", "row", "text").join(spots, "doc").select("doc", "row", "text", "spots")
    windows = settle(some.mapInArrow(window_hashes(width), "h1 long, h2 long, doc long, row long, pos int"), "windows")
    lost = settle(lost_windows(windows).groupBy("doc", "row").agg(F.collect_list("pos").alias("lost")), "lost")

    gone = lost.select(F.col("doc").alias("noted"), F.col("row").alias("own"), "lost", F.lit(False).alias("copy"))
    whole = copies.select(F.col("doc").alias("noted"), F.explode("copies").alias("own"), F.lit(None).cast("array<int>").alias("lost"), F.lit(True).alias("copy"))
    notes = gone.unionByName(whole).groupBy("noted", "own").agg(F.first("lost", ignorenulls=True).alias("lost"), F.max("copy").alias("copy"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches):
        for batch in batches:
            out = []
            for text, lost, copy in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                words = split(text.as_py())
                spans = []
                if copy and len(words) >= width:
                    spans = [{"start": 0, "end": len(words)}]
                elif lost.is_valid:
                    spans = passage_spans(lost.values.to_numpy(zero_copy_only=False), width)
                out.append((len(words), *kept_words(words, spans), spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)), pa.array([o[3] for o in out], kind), pa.array([final(o[2], keep) for o in out], pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    joined = known.join(notes, (F.col("doc") == F.col("noted")) & (F.col("row") == F.col("own")), "left").select("doc", "text", "lost", "copy")
    free = rows.filter(F.col("doc").isNull()).select("doc", "text", F.lit(None).cast("array<int>").alias("lost"), F.lit(False).alias("copy"))
    return joined.unionByName(free).mapInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string")


def op8_substring_dedup(spark, sf_dir):
    """Repeated passages of 13 words or more, removed from ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, keep="sha256").select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM w WHERE len(words) >= 13)
), o AS (SELECT gram, min(doc_id) AS owner FROM g GROUP BY gram),
c AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS i FROM g JOIN o USING (gram) WHERE owner < doc_id
), x AS (
  SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)
), k AS (
  SELECT x.doc_id, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE c.i IS NULL) AS kept
  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
