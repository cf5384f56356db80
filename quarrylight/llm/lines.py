"""Exact line deduplication with keep bitmaps (operator 5, native).

Line hashes are range-partitioned and sorted by document and position, so a
running first value names the document that owns a line as rows stream by. A
hash that many documents share is cut into salted ranges; the owner found by a
map-side combined minimum is put at the head of each of them. What leaves the
operator per document is a run-length keep bitmap, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import SPACE_CHARS, ascii_lower

SALTS = 64


def split_lines(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """doc, row, pos, h1, h2: the hashed keys of all lines that can be repeats.

    ``row`` tells rows apart that share an id. Two independently seeded 64-bit
    hashes stand for the key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # What stands beside a generator is computed anew for every row that it makes,
    # and carried along: the text's hash comes first, the text stays behind.
    lines = (
        docs.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("row"), split_lines(F.col(text_col)).alias("lines"))
        .select("doc", "row", F.posexplode("lines").alias("pos", "line"))
        .filter(F.char_length("line") >= min_chars)
        .select("doc", "row", "pos", F.btrim("line", F.lit(SPACE_CHARS)).alias("line"))
        .filter(F.char_length("line") >= min_chars)
    )
    key = ascii_lower(F.col("line"))
    return lines.select("doc", "row", "pos", key.alias("key")).select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, salts: int = SALTS) -> DataFrame:
    """doc, row, pos of every line whose key a document with a smaller id holds."""
    if not 1 <= salts <= 64:
        raise ValueError("salts must lie between 1 and 64")
    salt = F.pmod(F.xxhash64(F.lit(7), "doc"), F.lit(salts)).cast("int")
    keyed = line_keys(docs, id_col, text_col, min_chars).withColumn("salt", salt)
    # One row a key leaves each map task: the owner and the salts seen, as bits.
    seen = keyed.groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    places = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: F.getbit(F.col("salts"), i) == 1)
    heads = seen.filter(F.bit_count("salts") > 1).select(
        "doc", F.lit(0).cast("long").alias("row"), F.lit(-1).alias("pos"), "h1", "h2", F.explode(places).alias("salt")
    )
    stream = keyed.unionByName(heads).repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "doc", "pos")
    first = F.first("doc").over(Window.partitionBy("h1", "h2", "salt").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stream.withColumn("owner", first).filter((F.col("pos") >= 0) & (F.col("owner") < F.col("doc"))).select("doc", "row", "pos")


def flips_of(positions: Column) -> Column:
    """Sorted dropped positions -> the line numbers at which the keep bit flips."""
    n = F.size(positions)
    starts = F.filter(positions, lambda p, i: (i == 0) | (F.get(positions, i - 1) != p - 1))
    ends = F.filter(positions, lambda p, i: (i == n - 1) | (F.get(positions, i + 1) != p + 1))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.array(a, b + 1)))


def encode_bitmap(flips: Column) -> Column:
    """The keep bitmap, run-length coded: the line numbers at which the bit
    flips (it starts as 1), as big-endian unsigned 32-bit numbers."""
    return F.unhex(F.array_join(F.transform(flips, lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")), ""))


def decode_bitmap(bitmap: Column) -> Column:
    """The flips that encode_bitmap wrote; null gives none."""
    found = F.transform(F.regexp_extract_all(F.hex(bitmap), F.lit("[0-9A-F]{8}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))
    return F.coalesce(found, F.array().cast("array<int>"))


def run_bounds(n_lines: Column, flips: Column) -> Column:
    """The line numbers at which runs of kept and of dropped lines begin and end."""
    return F.concat(F.array(F.lit(0)), flips, F.array(n_lines))


def kept_lines(lines: Column, bounds: Column) -> Column:
    """The lines whose keep bit is 1, in order. Both must be plain columns: what
    a lambda refers to is computed anew for each run."""

    def run(i):
        first, after = F.get(bounds, i), F.get(bounds, i + 1)
        return F.when(first < after, F.sequence(first, after - 1)).otherwise(F.array().cast("array<int>"))

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(bounds) - 2, F.lit(2)), run))
    return F.transform(kept, lambda i: F.get(lines, i))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, salts: int = SALTS) -> DataFrame:
    """doc_id, row, n_dropped, keep_bitmap for every document that loses a line.

    Cases: a null or empty text is one empty line, which always stays. Rows
    with a null id own nothing and lose nothing. Rows that share an id are one
    document: none is a repeat of another, and ``row`` (xxhash64 of the text)
    tells their bitmaps apart. A very long text is one row of one task when it is
    split and put together again, in time and memory in proportion to its length.
    An empty table gives no rows. Columns of docs other than the two named are
    not read.
    """
    lost = dropped_lines(docs, id_col, text_col, min_chars, salts)
    per_doc = lost.groupBy("doc", "row").agg(F.sort_array(F.collect_set("pos")).alias("positions"))
    return per_doc.select(F.col("doc").alias("doc_id"), "row", F.size("positions").cast("long").alias("n_dropped"), encode_bitmap(flips_of(F.col("positions"))).alias("keep_bitmap"))


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, salts: int = SALTS) -> DataFrame:
    """Every row of docs with its text after line deduplication.

    Returns the columns of docs (text_col replaced), then ``ql_n_lines``,
    ``ql_n_dropped`` and ``ql_keep_bitmap`` (null: all lines stay). Cases as
    in keep_bitmaps.
    """
    if clash := {"ql_n_lines", "ql_n_dropped", "ql_keep_bitmap"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are names of results")
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars, salts).toDF("doc", "row", "dropped", "bitmap")
    # The columns of docs travel as one, so that none of them can clash.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    own_text, own_id = F.col("own").getField(text_col), F.col("own").getField(id_col)
    joined = packed.join(bitmaps, (own_id == F.col("doc")) & (F.xxhash64(F.coalesce(own_text, F.lit(""))) == F.col("row")), "left")
    lines = split_lines(own_text)
    # Only texts that lose lines are held as lines, next to the bounds of runs.
    cut = joined.select("own", "dropped", "bitmap", F.when(F.col("bitmap").isNotNull(), lines).alias("lines"))
    cut = cut.select("own", "dropped", "bitmap", "lines", F.when(F.col("bitmap").isNotNull(), run_bounds(F.size("lines"), decode_bitmap(F.col("bitmap")))).alias("bounds"))
    whole = F.col("bitmap").isNull()
    text = F.when(whole, F.coalesce(own_text, F.lit(""))).otherwise(F.array_join(kept_lines(F.col("lines"), F.col("bounds")), "\n"))
    return cut.select(
        *[text.alias(c) if c == text_col else F.col("own").getField(c).alias(c) for c in docs.columns],
        F.when(whole, F.size(lines)).otherwise(F.size("lines")).cast("long").alias("ql_n_lines"),
        F.coalesce("dropped", F.lit(0)).cast("long").alias("ql_n_dropped"),
        F.col("bitmap").alias("ql_keep_bitmap"),
    )


def op5_line_dedup(spark, sf_dir):
    """The digest of line deduplication over ``documents``."""
    from quarrylight.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicate_lines(docs).select(
        "doc_id", F.col("ql_n_lines").alias("n_lines"), F.col("ql_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, min(doc_id) AS owner, count(DISTINCT doc_id) AS n FROM k WHERE length(key) >= 10 GROUP BY key
), j AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(f.n >= 2 AND f.owner <> k.doc_id, false) AS lost
  FROM k LEFT JOIN f ON k.key = f.key AND length(k.key) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
