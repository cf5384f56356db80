"""WARC archives as a PySpark data source (operator 2).

Writer: one gzip member a record, each with the skip length of the whole member
in its gzip header, in archives of bounded size; a manifest that is written
last names the archives of a finished write. Reader: whole archives are dealt to
partitions by size; archives of other writers count beside those that a manifest
names, and parts of a write whose manifest is not there are an error. Predicates on the record type and on other header columns
are taken over from Spark; headers are inflated first, and a record that the
predicates refuse, or whose payload nobody asked for, is stepped over without
inflating the rest of it. Archives of other writers are read too: plain ones,
and gzip members that hold several records or parts of one.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from quarrylight.llm.common import scratch_path, table

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_length long, refers_to string, http_status int, content_type string, archive string, position long, payload binary"
HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")
BLOCK = 1 << 16
HEAD = 1 << 13
#: Names of this writer's archives: the write, then the archive.
OWN = re.compile(r"part-([0-9a-f]{32})-[0-9a-f]{32}\.warc\.gz")
SALTS = 64


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(path: str):
    """The file system of a path or URI, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri("file://" + path)


def clean(value) -> str:
    """A header value: no line breaks."""
    return " ".join(str(value).split("\r")).replace("\n", " ")


def record_bytes(row: dict) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP headers, without the payload."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    length = len(payload) if row.get("payload_length") is None else row["payload_length"]
    http = f"HTTP/1.1 {row.get('http_status') or 200} OK\r\nContent-Type: {clean(row.get('content_type') or 'text/html; charset=utf-8')}\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{clean(row['record_id'])}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row.get("target_uri") is not None:
        head.append(f"WARC-Target-URI: {clean(row['target_uri'])}")
    head.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{clean(row['refers_to'])}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field "sl" holds its own and the plain length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    end = body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if max(size, len(data)) >> 32:  # beyond the field
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + end
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + end


def member_lengths(head: bytes) -> tuple[int, int] | None:
    """The length of the gzip member that starts with head and that of what it
    holds, where it says so."""
    if len(head) < 12 or head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
        return None
    size = struct.unpack_from("<H", head, 10)[0]
    at, end = 12, min(len(head), 12 + size)
    while at + 4 <= end:
        name, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"sl" and n >= 8 and at + 12 <= len(head):
            return struct.unpack_from("<II", head, at + 4)
        at += 4 + n
    return None


def parse_headers(data: bytes) -> dict[str, str] | None:
    """Lower-cased WARC headers if data holds them all."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    out = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    out[""] = str(end + 4)
    return out


def header_row(headers: dict[str, str]) -> dict:
    ident = lambda x: x.strip("<>") if x is not None else None
    digest = headers.get("warc-payload-digest")
    return {
        "record_id": ident(headers.get("warc-record-id")),
        "record_type": headers.get("warc-type"),
        "target_uri": headers.get("warc-target-uri"),
        "payload_digest": digest.split(":", 1)[-1] if digest else None,
        "refers_to": ident(headers.get("warc-refers-to")),
    }


class Archive(InputPartition):
    def __init__(self, files):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("splitBytes", 64 << 20))
        self.taken: list[tuple] = []

    def pushFilters(self, filters):
        """Takes over what the header columns decide; the rest goes back."""
        kinds = {EqualTo: "eq", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains", IsNull: "null", IsNotNull: "set"}
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if type(f) in kinds and name in HEADER_COLUMNS:
                self.taken.append((kinds[type(f)], name, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        fs, base = filesystem(self.path)
        from pyarrow.fs import FileSelector, FileType

        infos = [x for x in fs.get_file_info(FileSelector(base, recursive=True)) if x.type == FileType.File]
        named, jobs = set(), set()
        for m in infos:
            if m.base_name.startswith("_manifest-"):
                jobs.add(m.base_name.removeprefix("_manifest-").removesuffix(".json"))
                with fs.open_input_stream(m.path) as f:
                    named.update(json.loads(f.read()))
        found, unknown = [], []
        for x in infos:
            own = OWN.fullmatch(x.base_name)
            if own and x.base_name not in named:
                # Of a finished write these are attempts that did not count.
                unknown += [] if own[1] in jobs else [x.path]
            elif x.base_name.endswith((".warc", ".warc.gz")):
                # An archive is never cut: where a member begins inside it cannot
                # be told from a compressed archive that is somebody's payload.
                found.append((x.size, x.path))
        if unknown:
            raise ValueError(f"{len(unknown)} archives belong to writes without a manifest here, such as {unknown[0]}: move the manifest along, or remove what an unfinished write has left")
        groups: list[list] = []
        for size, path in sorted(found, reverse=True):
            if groups and groups[-1][0] + size <= self.split:
                groups[-1][0] += size
                groups[-1][1].append(path)
            else:
                groups.append([size, [path]])
        return [Archive(g[1]) for g in groups] or [Archive([])]

    def wanted(self, row: dict) -> bool:
        for kind, name, value in self.taken:
            x = row[name]
            if kind == "null":
                ok = x is None
            elif x is None:
                ok = False
            else:
                ok = {"eq": lambda: x == value, "in": lambda: x in value, "starts": lambda: x.startswith(value), "ends": lambda: x.endswith(value), "contains": lambda: value in x, "set": lambda: True}[kind]()
            if not ok:
                return False
        return True

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])
        rows, held = [], 0
        for path in partition.files:
            fs, base = filesystem(self.path)
            with fs.open_input_file(path) as f:
                for row in read_archive(f, path.rsplit("/", 1)[-1], self.wanted, self.payload):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= 4096 or held >= 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_archive(f, name: str, wanted, payload: bool):
    """Rows of one archive; position is where the record, or the gzip member
    that it starts in, begins."""
    size, at = f.size(), 0
    while at < size:
        f.seek(at)
        raw = f.read(min(HEAD, size - at))
        if raw[:2] == b"\x1f\x8b":
            members = Members(f, at)
            for row, position in member_records(members, wanted, payload):
                yield row | {"archive": name, "position": position}
            at = max(at + 1, members.at)
        else:
            row, used = read_plain(f, raw, wanted, payload)
            if row is not None:
                yield row | {"archive": name, "position": at}
            at += max(1, used)


def http_end(block: bytes) -> int:
    """Where the HTTP headers end; -1 where the block does not show it."""
    return block.find(b"\r\n\r\n")


def finish(row: dict, block: bytes, length: int, payload: bool) -> dict:
    """Adds what the HTTP headers say, and the payload where it is asked for."""
    row |= {"http_status": None, "content_type": None, "payload_length": None, "payload": None}
    end = http_end(block)
    if block[:5] == b"HTTP/" and end >= 0:
        head = block[:end].decode("latin-1").split("\r\n")
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        status = head[0].split(" ")[1:2]
        row["http_status"] = int(status[0]) if status and status[0].isdigit() else None
        row["content_type"] = named.get("content-type")
        row["payload_length"] = int(named["content-length"]) if named.get("content-length", "").isdigit() else length - end - 4
        body = block[end + 4 : length]
    else:
        row["payload_length"], body = length, block[:length]
    if payload and row["record_type"] != "revisit":
        row["payload"] = body
    return row


class Members:
    """What consecutive gzip members hold, inflated a bounded piece at a time."""

    def __init__(self, f, at: int):
        self.f, self.data = f, bytearray()
        self.open(at)

    def open(self, at: int) -> None:
        """Goes to the member at ``at``; the end where none starts there."""
        self.f.seek(at)
        self.at, self.pending, self.fresh = at, self.f.read(HEAD), True
        self.lengths = member_lengths(self.pending)
        self.unpack = zlib.decompressobj(31) if self.pending[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        """Adds to ``data``; False at the end."""
        while self.unpack is not None:
            if self.unpack.eof:
                self.open(self.f.tell() - len(self.unpack.unused_data))
                continue
            piece = self.unpack.unconsumed_tail or self.pending or self.f.read(BLOCK)
            self.pending = b""
            found = self.unpack.decompress(piece, HEAD if self.fresh else BLOCK * 4)
            if not piece and not found and not self.unpack.eof:
                raise EOFError("a WARC member ends early")
            self.fresh = False
            self.data += found
            if found:
                return True
        return False

    def drop(self, n: int) -> None:
        """Steps over n bytes of what the members hold."""
        while len(self.data) < n:
            n -= len(self.data)
            self.data.clear()
            if not self.more():
                return
        del self.data[:n]


def member_records(members: Members, wanted, payload: bool):
    """(row, position) of every wanted record from the members on."""
    data = members.data
    while True:
        while True:
            del data[: len(data) - len(data.lstrip(b"\r\n"))]
            if data:
                whole = None
                break
            if not members.more():
                return
            if data[:1] not in b"\r\n":
                whole = members.lengths  # the record starts with its member
                break
        position = members.at
        while (headers := parse_headers(data)) is None:
            if not members.more():
                return
        start, length = int(headers[""]), int(headers.get("content-length", 0))
        row = header_row(headers)
        if wanted(row):
            need = start + length
            while len(data) < need and not enough(data, start, row, payload):
                if not members.more():
                    raise EOFError("a WARC record ends early")
            yield finish(row, bytes(data[start:need]), length, payload), position
        if whole and members.at == position and start + length + 4 >= whole[1]:
            data.clear()
            members.open(position + whole[0])
        else:
            members.drop(start + length)


def enough(data: bytes, start: int, row: dict, payload: bool) -> bool:
    """Whether what was read of a record will do: without the payload, the HTTP
    headers to their end."""
    if payload and row["record_type"] != "revisit":
        return False
    return (len(data) >= start + 5 and data[start : start + 5] != b"HTTP/") or data.find(b"\r\n\r\n", start) >= 0


def read_plain(f, raw: bytes, wanted, payload: bool):
    """(row, bytes used) of the record that raw begins; f stands behind raw."""
    lead = len(raw) - len(raw.lstrip(b"\r\n"))
    data = raw[lead:]
    if not data:
        return None, len(raw)
    while (headers := parse_headers(data)) is None:
        piece = f.read(BLOCK)
        if not piece:
            return None, lead + len(data)
        data += piece
    start, length = int(headers[""]), int(headers.get("content-length", 0))
    row = header_row(headers)
    used = lead + start + length
    if not wanted(row):
        return None, used
    while len(data) < start + length and not enough(data, start, row, payload):
        whole = payload and row["record_type"] != "revisit"
        piece = f.read(start + length - len(data) if whole else BLOCK)
        if not piece:
            raise EOFError("a WARC record ends early")
        data += piece
    return finish(row, data[start : start + length], length, payload), used


class Written(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.limit = int(options.get("maxArchiveBytes", 64 << 20))
        self.level = int(options.get("level", 1))
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        """Archives under names of this attempt; the manifest decides which count."""
        fs, base = filesystem(self.path)
        fs.create_dir(base, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                names = batch.schema.names
                for values in zip(*(batch.column(i) for i in range(len(names)))):
                    if out is None or size >= self.limit:
                        if out is not None:
                            out.close()
                        files.append(f"part-{self.job}-{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{base}/{files[-1]}", compression=None), 0
                    size += out.write(gzip_member(record_bytes(dict(zip(names, (v.as_py() for v in values)))), self.level)) or 0
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        fs, base = filesystem(self.path)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/_manifest-{self.job}.json") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages):
        fs, base = filesystem(self.path)
        for m in messages:
            for x in m.files if m else ():
                try:
                    fs.delete_file(f"{base}/{x}")
                except OSError:
                    pass


class WarcSource(DataSource):
    """spark.read.format("warc"): options path, payload (false: headers only),
    splitBytes. df.write.format("warc"): path, maxArchiveBytes, level."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known and lets Spark push predicates into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32_of_hex(column):
    """The bare upper-case base32 form of a 40-digit hex column."""
    letters = F.array(*[F.lit(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"])
    quads = [F.conv(F.substring(column, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.get(letters, F.shiftright(q, s).bitwiseAND(F.lit(31))) for q in quads for s in (15, 10, 5, 0)])


def revisit_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = 0) -> DataFrame:
    """Record rows for the writer: of equal payloads of at least ``min_payload``
    bytes the one with the least id is the response, the others are revisits.

    Cases: a null payload is an empty one. Rows that share the least id of a
    payload are all responses. A row with a null id is a revisit where its
    payload has an id, else a response. A null url gives no target header.
    """
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    salt = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(SALTS)).cast("int")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("payload")).withColumn("sha", F.sha1("payload")).withColumn("salt", salt)
    large = rows.filter(F.octet_length("payload") >= min_payload)
    seen = large.groupBy("sha").agg(F.min("id").alias("owner"), F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")).filter("n > 1 AND owner IS NOT NULL")
    # A payload that very many rows share meets its owner salt by salt.
    places = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col("salts"), i) == 1)
    owners = seen.select("sha", "owner", F.explode(places).alias("salt"))
    joined = rows.join(owners, ["sha", "salt"], "left")
    revisit = F.col("owner").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("owner")))
    return joined.select(
        F.coalesce(F.concat(F.lit("urn:page:"), F.col("id").cast("string")), F.lit("urn:page:none")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        base32_of_hex(F.col("sha")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.when(revisit, F.concat(F.lit("urn:page:"), F.col("owner").cast("string"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def op2_warc(spark, sf_dir):
    """Writes ``pages`` as WARC archives and reads them back: the responses with
    their payloads, from which digest and length are taken, and the revisits by
    their headers alone."""
    register(spark)
    path = scratch_path(spark, "warc")
    revisit_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS BIGINT)")
    own = spark.read.format("warc").load(path).filter("record_type = 'response'")
    own = own.select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = spark.read.format("warc").option("payload", "false").load(path).filter("record_type = 'revisit'")
    return own.unionByName(again.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to")))


OP2_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS sha FROM p
), o AS (
  SELECT page_id, payload_bytes, sha, min(page_id) OVER (PARTITION BY sha) AS owner FROM d
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(sha, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM o
"""
