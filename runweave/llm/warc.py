"""WARC archives: a writer with revisit records, and a Python data source that prunes records by their headers."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

from .common import checkpoint, fresh_path

MIN_REVISIT = 1000
FILE_BYTES = 32 << 20
MANIFEST = "manifest.json"
SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, http_length long, headers map<string,string>, payload binary"
#: Columns that a pushed equality or IN can be decided on from the headers alone.
BY_HEADER = ("record_type", "record_id", "target_uri", "payload_digest", "refers_to")


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder that driver and executors share."""
    from pyarrow import fs

    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


# --- writing ---------------------------------------------------------------------------------


def member(data: bytes) -> bytes:
    """One gzip member whose extra field SL holds its whole length, so that readers can skip it without inflating it."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    extra = b"SL" + struct.pack("<HI", 4, 12 + 8 + len(body) + 8)
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def safe(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if any(c in value for c in "\r\n%") else value


def unsafe(value: str) -> str:
    return value.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%") if "%" in value else value


def record(kind: str, record_id: str, uri: str | None, payload: bytes, length: int, digest: str, refers_to: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {safe(uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str):
    def run(batches):
        fs, path = filesystem(folder)
        out, name, size, n = None, "", 0, 0

        def close():
            out.close()
            return pa.RecordBatch.from_pylist([{"file": name, "bytes": size, "records": n}], pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    name, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                m = member(record(r["record_type"], r["record_id"], r["target_uri"], r["payload"] or b"", r["payload_bytes"], r["payload_digest"], r["refers_to"]))
                out.write(m)
                size, n = size + len(m), n + 1
                if size >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write(records: DataFrame, folder: str) -> str:
    """Writes record_type, record_id, target_uri, payload, payload_bytes, payload_digest, refers_to rows; returns the folder.

    Each attempt of a task writes files of its own names; the manifest holds those of the attempts that counted.
    """
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    files = checkpoint(records.mapInArrow(_write(folder), "file string, bytes long, records long")).collect()  # a row for every 32 MB
    with fs.open_output_stream(f"{path}/{MANIFEST}") as f:
        f.write(json.dumps([[r.file, r.bytes] for r in sorted(files)]).encode())
    return folder


def archived(pages: DataFrame) -> DataFrame:
    """The rows that write() takes, of page_id, url, html.

    Of payloads that are equal and of at least MIN_REVISIT bytes, the one with the largest page_id is a
    response, the others revisit it. Null html is an empty payload.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    groups = p.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select(F.col("payload_digest").alias("digest"), "last")
    d = p.join(groups, p["payload_digest"] == groups["digest"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return d.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        name("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(revisit, name("last")).alias("refers_to"),
    )


# --- reading ---------------------------------------------------------------------------------


class Part(InputPartition):
    def __init__(self, file: str):
        self.file = file


class Stream:
    """Records of an archive, plain or with a gzip member each; headers first, the rest only on demand."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at = f, size, 0

    def records(self):
        while self.at < self.size:
            self.f.seek(self.at)
            start = self.f.read(min(1 << 16, self.size - self.at))
            if not start.strip(b"\r\n"):
                return
            if start[:2] == b"\x1f\x8b":
                yield from self._member(start)
            else:
                yield self._plain(start)

    def _member(self, start: bytes):
        length = None
        if start[3] & 4 and start[12:14] == b"SL" and start[10:12] == b"\x08\0":
            length = struct.unpack("<I", start[16:20])[0]
        z = zlib.decompressobj(31)
        head, fed = z.decompress(start, 1 << 13), len(start)

        def more(limit: int) -> bytes:
            nonlocal fed
            if z.unconsumed_tail:
                return z.decompress(z.unconsumed_tail, limit)
            if z.eof or self.at_fed + fed >= self.size:
                return b""
            chunk = self.f.read(1 << 18)
            fed += len(chunk)
            return z.decompress(chunk, limit)

        self.at_fed = self.at
        while b"\r\n\r\n" not in head and (x := more(1 << 16)):
            head += x
        lines, _, rest = head.partition(b"\r\n\r\n")
        here = self.at
        state = {"rest": rest, "done": False}

        def block(limit: int | None = None) -> bytes:
            while limit is None or len(state["rest"]) < limit:
                x = more(1 << 20)
                if not x:
                    state["done"] = True
                    break
                state["rest"] += x
            return state["rest"]

        yield lines, block
        if length is None:
            while not z.eof and more(1 << 20):
                pass
            while not z.eof:
                chunk = self.f.read(1 << 18)
                if not chunk:
                    break
                fed += len(chunk)
                z.decompress(chunk)
            length = fed - len(z.unused_data)
        self.at = here + length

    def _plain(self, start: bytes):
        skip = len(start) - len(start.lstrip(b"\r\n"))
        head = start[skip:]
        while b"\r\n\r\n" not in head and (x := self.f.read(1 << 16)):
            head += x
        lines = head.partition(b"\r\n\r\n")[0]
        begin = self.at + skip + len(lines) + 4
        n = int(next((x.split(b":", 1)[1] for x in lines.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"0"))
        self.at = begin + n + 4

        def block(limit: int | None = None) -> bytes:
            self.f.seek(begin)
            return self.f.read(n if limit is None else min(n, limit))

        return lines, block


def fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "surrogatepass").strip()
    return out


def hex_digest(value: str | None) -> str | None:
    if not value:
        return None
    kind, _, v = value.rpartition(":")
    if kind.lower() == "sha1" and len(v) == 32:
        return base64.b32decode(v.upper()).hex()
    return v.lower()


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.payload, self.verify = options["path"], options.get("payload", "true").lower() == "true", options.get("verify", "false").lower() == "true"
        self.equal: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in BY_HEADER:
                self.equal.append((f.attribute[0], frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f

    def partitions(self):
        fs, path = filesystem(self.folder)
        from pyarrow import fs as pfs

        if fs.get_file_info(path).type == pfs.FileType.File:
            return [Part(path)]
        if fs.get_file_info(f"{path}/{MANIFEST}").type == pfs.FileType.File:
            with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
                return [Part(f"{path}/{n}") for n, _ in json.loads(f.read())]
        return [Part(x.path) for x in sorted(fs.get_file_info(pfs.FileSelector(path)), key=lambda x: x.path) if x.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition):
        if partition is None:  # no files
            return
        fs, _ = filesystem(self.folder)
        types = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("http_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        rows, held = [], 0
        with fs.open_input_file(partition.file) as f:
            for lines, block in Stream(f, f.size()).records():
                h = fields(lines)
                uri = h.get("warc-target-uri")
                row = {"record_type": h.get("warc-type"), "record_id": h.get("warc-record-id", "").strip("<>") or None, "target_uri": uri and unsafe(uri), "payload_digest": hex_digest(h.get("warc-payload-digest")), "refers_to": (h.get("warc-refers-to") or "").strip("<>") or None}
                if any(row[c] not in values for c, values in self.equal):
                    continue  # the payload stays as it is
                row["headers"], row["http_length"], row["payload"] = list(h.items()), None, None
                if "http" in h.get("content-type", ""):
                    http, _, rest = block(4096).partition(b"\r\n\r\n")
                    while not _ and len(got := block(len(http) + (1 << 16))) > len(http):
                        http, _, rest = got.partition(b"\r\n\r\n")
                    n = next((x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                    row["http_length"] = int(n) if n else None
                    skip = len(http) + 4
                else:
                    skip = 0
                if (self.payload or self.verify) and row["record_type"] != "revisit":
                    payload = block()[skip : int(h.get("content-length", 0))]
                    if self.verify and row["payload_digest"] and hashlib.sha1(payload).hexdigest() != row["payload_digest"]:
                        raise ValueError(f"{row['record_id']}: the payload does not match its digest")
                    if self.payload:
                        row["payload"] = payload
                        held += len(payload)
                rows.append(row)
                if len(rows) >= 2000 or held >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, types)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, types)


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder or file); options payload (false: headers only) and verify (check SHA-1 digests).

    Spark keeps the filters that a query pushed with the frame that load() returned: load anew for each query.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return WarcReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, folder: str, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(folder)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as an archive in the shared folder and returns, from what is read back, page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload is read and held against its digest; a revisit has none, its length and digest are in its headers.
    Null html counts as empty, null url has no target header, rows that repeat are records of their own, an empty table
    makes an archive without files.
    """
    spark = pages.sparkSession
    back = read(spark, write(archived(pages), fresh_path(spark, "warc")), payload=False, verify=True).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS long)")
    return back.select(number("record_id").alias("page_id"), F.col("http_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> last THEN last END AS refers_to FROM g"""
