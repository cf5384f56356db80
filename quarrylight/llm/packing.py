"""Bounded-space online packing of token sequences (operator 7).

Each partition keeps a fixed number of open windows. A document's full windows
leave at once; its remainder goes, whole, to the open window that it fills
best. When none can take it, the fullest is filled up with a cut of the piece
and emitted. The windows still open when a partition ends are few; they are
packed again, group by group of partitions, until one group is left.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import settle, table

WINDOW = 1024
OPEN = 32
#: Partitions whose leftovers one task packs together.
FAN_IN = 32
SPECIAL = "<|endoftext|>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids, the ids that the tokenizers file at path gives without
    added special tokens.

    For a byte-level BPE file with the usual split, the faster BPE of tiktoken
    runs on the file's own vocabulary and merges; the strings of special tokens
    inside a text are their own ids, as in tokenizers. Other files run in
    tokenizers itself.
    """
    import json

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if not plain or model.get("type") not in ("BPE", None) or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import tiktoken

    ranks = bpe_ranks(model["vocab"], special)
    ids = {i: model["vocab"][w] for w, i in ranks[1].items()}
    fast = tiktoken.Encoding("byte-bpe", pat_str=SPLIT, mergeable_ranks=ranks[0], special_tokens={})
    same = all(a == b for a, b in ids.items())

    def encode(text: str) -> list[int]:
        parts, out = [text], []
        if special and any(s in text for s in special):
            parts = re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text)
        for part in parts:
            if part in special:
                out.append(special[part])
            elif part:
                found = encode_runs(fast, part)
                out += found if same else [ids[x] for x in found]
        return out

    for probe in ("It's 12,5 °C — naïve\n\n  \tx<|endoftext|> y ", "Äö üß 東京 🙂 don't  stop"):
        if encode(probe) != slow.encode(probe, add_special_tokens=False).ids:
            return lambda text: slow.encode(text, add_special_tokens=False).ids
    return encode


#: The split of byte-level BPE, as public_tokenizers states it. Fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: White space as the split sees it (the Unicode property). Fixed value.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"[{SPACES}]{{4096,}}")


def encode_runs(fast, text: str) -> list[int]:
    """The ids of a text, whose very long white-space runs are given to the BPE
    as the pieces that the split makes of them: it would recurse once a
    character there. The last character of a run goes with what follows."""
    out, at = [], 0
    for run in LONG_RUN.finditer(text) if len(text) >= 4096 else ():
        end = run.end() - (run.end() < len(text))
        out += fast.encode_ordinary(text[at : run.start()])
        out += fast._encode_single_piece(text[run.start() : end])
        at = end
    return out + fast.encode_ordinary(text[at:])


def bpe_ranks(vocab: dict[str, int], special: dict[str, int]):
    """(bytes -> rank, word -> rank) from a byte-level vocabulary, whose ids
    follow the order of merges."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    words = {w: i for w, i in vocab.items() if w not in special}
    return {bytes(letters[c] for c in w): i for w, i in words.items()}, words


class Windows:
    """The open windows of one task. A piece is (doc, start, doc_tokens, ids)."""

    def __init__(self, size: int, limit: int, first: int):
        self.size, self.limit, self.next = size, limit, first
        self.open: list[list] = []
        self.room: list[int] = []

    def emit(self, pieces):
        """Rows of one window, which closes."""
        number, at = self.next, 0
        self.next += 1
        for doc, start, total, ids in pieces:
            yield doc, start, ids, total, number, at
            at += len(ids)

    def add(self, piece):
        """Places a piece shorter than a window; yields rows of closed windows."""
        doc, start, total, ids = piece
        while len(ids):
            fits = [(r, i) for i, r in enumerate(self.room) if r >= len(ids)]
            if fits:
                left, i = min(fits)
                self.open[i].append((doc, start, total, ids))
                self.room[i] = left - len(ids)
                if not self.room[i]:
                    yield from self.close(i)
                return
            if len(self.open) < self.limit:
                self.open.append([(doc, start, total, ids)])
                self.room.append(self.size - len(ids))
                return
            i = min(range(len(self.room)), key=lambda k: (self.room[k], k))
            cut = self.room[i]
            self.open[i].append((doc, start, total, ids[:cut]))
            yield from self.close(i)
            start, ids = start + cut, ids[cut:]

    def close(self, i):
        pieces = self.open.pop(i)
        self.room.pop(i)
        yield from self.emit(pieces)


def batches_of(rows, kind: pa.DataType, digest: bool):
    """Arrow batches of bounded size from rows (…, open)."""
    cols: list[list] = [[] for _ in range(8)]
    held = 0

    def flush():
        ids, crc = cols[2], cols[3]
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array([len(x) for x in cols[7]], pa.int64()), pa.array(ids, pa.binary()), pa.array(crc, pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.int64())],
            ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )

    for doc, start, ids, total, number, at in rows:
        raw = ids.astype("<u4").tobytes()
        is_open = number < 0
        for c, v in zip(cols, (doc, start, None if digest and not is_open else raw, zlib.crc32(raw), total, number, at, ids)):
            c.append(v)
        held += len(raw)
        if held >= 8 << 20 or len(cols[0]) >= 16384:
            yield flush()
            cols, held = [[] for _ in range(8)], 0
    yield flush()


FIELDS = "start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, windows: int = OPEN, end_id: int = 0, payload: str = "ids", fan_in: int = FAN_IN) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian unsigned
    32-bit; null where payload is "crc32"), ids_crc32, doc_tokens, sequence_id,
    offset. Every document ends with ``end_id``.

    Cases: a null or empty text is the end id alone. Rows that share an id, or
    have none, are documents of their own. An empty table gives no rows. Other
    columns of docs are not read. Memory per task: the open windows and one
    batch of documents.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    digest = payload == "crc32"
    schema = f"doc_id {kind}, {FIELDS}"

    def first(batches):
        part = TaskContext.get().partitionId()
        encode, held = encoder(path), Windows(size, windows, part << 32)
        types = []

        def rows_of():
            for batch in batches:
                types.append(batch.schema.field(0).type)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = np.array(encode(text.as_py() or "") + [end_id], dtype=np.uint32)
                    total = len(ids)
                    whole = total - total % size
                    for at in range(0, whole, size):
                        yield from held.emit([(doc, at, total, ids[at : at + size])])
                    if whole < total:
                        yield from held.add((doc, whole, total, ids[whole:]))
            yield from leftovers(held, part)

        yield from typed(rows_of(), types, digest)

    placed = settle(rows.mapInArrow(first, schema), "packing")
    done = placed.filter("sequence_id >= 0")
    rest = placed.filter("sequence_id < 0")
    level = 1
    while True:
        groups = rest.agg(F.count_distinct((-1 - F.col("sequence_id")).cast("long"))).first()[0]
        last = groups <= fan_in
        merged = settle(merge_round(rest, schema, size, windows, level, fan_in, last, digest), "packing")
        done = done.unionByName(merged.filter("sequence_id >= 0"))
        if last:
            return done
        rest, level = merged.filter("sequence_id < 0"), level + 1


def leftovers(held: Windows, part: int):
    """Rows of the windows that stay open: sequence_id -1-part, offset their
    place in the task's order."""
    at = 0
    for pieces in held.open:
        for doc, start, total, ids in pieces:
            yield doc, start, ids, total, -1 - part, at
            at += 1


def typed(rows, types, digest):
    """batches_of, with the id type that the first input batch shows."""
    import itertools

    head = list(itertools.islice(rows, 1))
    yield from batches_of(itertools.chain(head, rows), types[0] if types else pa.int64(), digest) if types else ()


def merge_round(rest: DataFrame, schema: str, size: int, windows: int, level: int, fan_in: int, last: bool, digest: bool) -> DataFrame:
    """Packs the leftovers of up to fan_in partitions in one group. A group's
    input is bounded: fan_in times the open windows."""
    grouped = rest.withColumn("g", F.floor((-1 - F.col("sequence_id")) / fan_in))

    def one(key, table):
        g = int(key[0].as_py())
        kind = table.schema.field("doc_id").type
        rows = sorted(zip(table["sequence_id"].to_pylist(), table["offset"].to_pylist(), range(len(table))), key=lambda r: (-r[0], r[1]))
        docs, starts, totals, ids = (table[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))
        # Large pieces first: best fit then wastes least.
        order = sorted((i for *_, i in rows), key=lambda i: -len(ids[i]))
        held = Windows(size, max(1, windows), (level << 56) | (g << 32))

        def out():
            for i in order:
                yield from held.add((docs[i], starts[i], totals[i], np.frombuffer(ids[i], dtype="<u4")))
            if last:
                yield from fill(held)
            else:
                yield from leftovers(held, g)

        return pa.Table.from_batches(batches_of(out(), kind, digest))

    return grouped.groupBy("g").applyInArrow(one, schema)


def fill(held: Windows):
    """Closes what is left: the emptiest window's pieces, cut where needed,
    fill up the others; only the last window may stay short."""
    while len(held.open) > 1:
        i = max(range(len(held.room)), key=lambda k: (held.room[k], k))
        pieces = held.open.pop(i)
        held.room.pop(i)
        held.limit = len(held.open)
        for piece in pieces:
            if not held.open:
                held.limit = 1
            yield from held.add(piece)
        held.limit = max(1, len(held.open))
    if held.open:
        yield from held.close(0)


def op7_packing(spark, sf_dir):
    """All of ``documents`` packed into sequences of 1024 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, payload="crc32").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
