"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by URL over the whole table; ranges hold about equal bytes by exact running totals, so they do
not depend on partitions, samples or retries. A task streams a range into gzip members, rolls its files by compressed
size, and gives them their names when whole; the archive exists once its manifest does."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, written

#: Ranges grow beyond the given bytes rather than exceed this number, which bounds the list of their first keys.
MOST_RANGES = 65_536
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_ROWS = 200
MANIFEST = "file string, range int, records long, compressed_bytes long, sha256 string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(key, id, url, sha, n, payload). The key orders by URL, id and payload digest, is at most 306 bytes long, and is
    equal for equal rows alone: a long URL counts with its first 256 bytes and its digest."""
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        payload.alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    signed = F.hex(F.col("id").bitwiseXOR(F.lit(-1 << 63)))  # so that bytes sort as the numbers do
    number = F.when(F.col("id").isNull(), F.lit("00" * 9)).otherwise(F.concat(F.lit("01"), F.lpad(signed, 16, "0")))
    key = F.concat(F.substring(F.coalesce("url", F.lit("")).cast("binary"), 1, 256), F.unhex(F.concat(
        F.lit("00"), F.coalesce(F.sha1(F.col("url").cast("binary")), F.lit("00" * 20)), number, F.col("sha"))))
    return rows.select(key.alias("key"), "id", "url", "sha", "n", "payload")


def planned(rows: DataFrame, range_bytes: int, min_revisit_bytes: int) -> DataFrame:
    """What the archive will hold, without payloads: a row per distinct key with its number of copies, its range and
    its role. ``each``: all copies are responses; ``first``: the first is, the others revisit it; ``revisit``: all
    revisit the record ``ref_key`` of page ``ref_id``.

    Copies are folded before any shuffle. Running totals are taken inside sorted partitions and carried over by one row
    per partition. The join on the digest moves keys alone, and only digests that repeat are on its other side."""
    names = ["key", "id", "url", "sha", "n"]
    keys = rows.select(*names).groupBy(*names).agg(F.count("*").alias("copies"))
    at = F.shiftrightunsigned(F.monotonically_increasing_id(), 33)
    keys = written(keys.repartitionByRange("key").sortWithinPartitions("key").withColumn("piece", at), "warc-keys")
    size = F.col("copies") * F.col("n")
    pieces = keys.groupBy("piece").agg(F.sum(size).alias("size"))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.select("piece", (F.sum("size").over(before) - F.col("size")).alias("start"))  # a row per partition
    total = keys.agg(F.sum(size)).first()[0] or 0
    width = max(range_bytes, -(-total // MOST_RANGES), 1)
    inside = Window.partitionBy("piece").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = F.col("start") + F.sum(size).over(inside) - size
    placed = (keys.join(pieces, "piece").withColumn("offset", offset)
              .withColumn("range", F.expr(f"offset div {width}").cast("int")).drop("offset", "start", "piece"))
    repeated = (keys.where(F.col("n") >= min_revisit_bytes).groupBy(F.col("sha").alias("ref_sha"))
                .agg(F.max(F.struct("id", "key", "url")).alias("ref"), F.count("*").alias("keys"))
                .where("keys > 1").select("ref_sha", F.col("ref.id").alias("ref_id"), F.col("ref.key").alias("ref_key"),
                                          F.col("ref.url").alias("ref_url")))
    own = F.col("ref_key").isNull() | (F.col("ref_key") == F.col("key"))
    role = F.when(F.col("n") < min_revisit_bytes, "each").when(own, "first").otherwise("revisit")
    return placed.join(repeated, F.col("sha") == F.col("ref_sha"), "left").withColumn("role", role).drop("ref_sha")


def record_id(key: bytes, copy: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(key + copy.to_bytes(8, 'big')).digest()[:16], version=5)}>"


def uri(url: str | None) -> str | None:
    """The URL as a header can hold it: control characters, spaces and what is not ASCII are percent-encoded."""
    if url is None:
        return None
    return re.sub(rb'[^\x21-\x7e]|[<>]', lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "surrogatepass")).decode()


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record with its length and block digest; headers without a value are left out."""
    headers = [*headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    lines = [VERSION, *[f"{k}: {v}".encode() for k, v in headers if v is not None]]
    return b"".join((b"\r\n".join(lines), b"\r\n\r\n", block, b"\r\n\r\n"))


def page_record(plan: dict, copy: int, payload: bytes | None, date: str) -> bytes:
    """The response (with the payload) or revisit (``payload`` None) of one copy of a planned row."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {plan['n']}\r\n\r\n").encode()
    digest = base64.b32encode(bytes.fromhex(plan["sha"])).decode()
    target = {"key": plan["ref_key"], "id": plan["ref_id"], "url": plan["ref_url"]} if plan["role"] == "revisit" else plan
    text = lambda x: None if x is None else str(x)
    headers = [("WARC-Type", "revisit" if payload is None else "response"),
               ("WARC-Record-ID", record_id(plan["key"], copy)), ("WARC-Date", date),
               ("WARC-Target-URI", uri(plan["url"])), ("WARC-Payload-Digest", f"sha1:{digest}"),
               ("Content-Type", "application/http;msgtype=response"), ("X-Page-Id", text(plan["id"]))]
    if payload is None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(target["key"], 0)),
                    ("WARC-Refers-To-Target-URI", uri(target["url"])), ("X-Refers-To-Page-Id", text(target["id"]))]
    return record(headers, http + (payload or b""))


def member(data: bytes, level: int) -> bytes:
    """``data`` as a gzip member without a time, so equal data give equal bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class Shards:
    """The files of one task: written under names of this attempt, renamed when whole. Another attempt writes the same
    bytes, so it does not matter which of them renames last."""

    root: str
    file_bytes: int
    level: int
    date: str

    def __post_init__(self) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(self.root)
        self.range, self.number, self.out = -1, 0, None

    def add(self, range_number: int, data: bytes) -> Iterator[tuple]:
        """Append a record; yields the manifest row of a file that it closes."""
        if range_number != self.range:
            yield from self.close()
            self.range, self.number = range_number, 0
        if self.out is None:
            self.name = f"part-{self.range:05d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.path}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.size, self.records, self.hash = 0, 0, hashlib.sha256()
            info = f"format: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
            self.put(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(self.name.encode(), 0)),
                             ("WARC-Date", self.date), ("WARC-Filename", self.name),
                             ("Content-Type", "application/warc-fields")], info))
        self.put(data)
        self.records += 1
        if self.size >= self.file_bytes:
            yield from self.close()

    def put(self, data: bytes) -> None:
        packed = member(data, self.level)
        self.out.write(packed)
        self.hash.update(packed)
        self.size += len(packed)

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.path}/{self.name}")
            self.out, self.number = None, self.number + 1
            yield self.name, self.range, self.records, self.size, self.hash.hexdigest()


def write_archive(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  range_bytes: int = 16 << 20, file_bytes: int = 256 << 20, min_revisit_bytes: int = 0, level: int = 6,
                  date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every row as a WARC record below ``root``, a folder that driver and executors share; returns the manifest
    (file, range, records, compressed_bytes, sha256), which is written last.

    A row's payload is its html in UTF-8, null as empty. Of records with equal payloads of at least
    ``min_revisit_bytes``, that with the largest id (null ids are smallest, ties go to the last URL) is the response,
    and the others revisit it, repeated rows too; shorter payloads are all responses. The same rows and arguments give
    the same files, byte for byte, whatever the partitions. An empty table gives a manifest without rows. Null URLs have
    no target header. Other columns are not read. A folder that already holds an archive raises an error.

    Only keys are sorted over the whole table; payloads are shuffled once, to the range that holds their key, and equal
    rows of an input partition once together. A range is a stream: a task holds one record at a time."""
    spark = pages.sparkSession
    store, path = pafs.FileSystem.from_uri(root)
    if store.get_file_info(f"{path}/manifest").type != pafs.FileType.NotFound:
        raise ValueError(f"{root} holds an archive")
    store.create_dir(f"{path}/_temporary", recursive=True)
    small_batches(spark, BATCH_ROWS)
    rows = keyed(pages, id_col, url_col, html_col)
    plan = written(planned(rows, range_bytes, min_revisit_bytes), "warc-plan")
    firsts = plan.groupBy("range").agg(F.min("key").alias("key")).orderBy("range").collect()  # at most MOST_RANGES
    numbers, first_keys = [r["range"] for r in firsts], [bytes(r["key"]) for r in firsts]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of this input partition
        for batch in batches:
            ranges, keep = [], []
            for i, key in enumerate(batch.column(0).to_pylist()):
                mark = hashlib.blake2b(key, digest_size=16).digest()
                if mark not in seen:
                    seen.add(mark)
                    keep.append(i)
                    ranges.append(numbers[bisect_right(first_keys, key) - 1])
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), *kept.columns], names=["range", "key", "payload"])

    bodies = rows.select("key", "payload").mapInArrow(send, "range int, key binary, payload binary")
    both = plan.withColumn("body", F.lit(0)).unionByName(bodies.withColumn("body", F.lit(1)), allowMissingColumns=True)
    names = ["range", "key", "body", "payload", "id", "url", "sha", "n", "copies", "role", "ref_id", "ref_key", "ref_url"]
    sorted_rows = both.select(*names).repartition(max(1, len(firsts)), "range").sortWithinPartitions("range", "key", "body")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, plan, files = Shards(root, file_bytes, level, date), {}, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(c)[i] for c, name in enumerate(names) if name != "payload"}
                row = {name: value.as_py() for name, value in row.items()}
                if not row["body"]:
                    plan = row
                    if plan["role"] == "revisit":
                        for copy in range(plan["copies"]):
                            files.extend(shards.add(plan["range"], page_record(plan, copy, None, date)))
                elif row["key"] == plan["key"] and plan["role"] != "revisit" and plan["copies"]:
                    payload = batch.column(3)[i].as_py()  # the first of the equal payloads that the input partitions sent
                    for copy in range(plan["copies"]):
                        body = payload if not copy or plan["role"] == "each" else None
                        files.extend(shards.add(plan["range"], page_record(plan, copy, body, date)))
                    plan["copies"] = 0
        files.extend(shards.close())
        columns = list(zip(*files)) or [[]] * 5
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         names=[f.split()[0] for f in MANIFEST.split(", ")])

    sorted_rows.mapInArrow(write, MANIFEST).write.parquet(f"{root}/_temporary/manifest")
    store.move(f"{path}/_temporary/manifest", f"{path}/manifest")
    store.delete_dir(f"{path}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def members(stream: pa.NativeFile) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    unzip, parts = zlib.decompressobj(31), []
    data = stream.read(1 << 20)
    while data:
        parts.append(unzip.decompress(data))
        data = unzip.unused_data
        if unzip.eof:
            yield b"".join(parts)
            unzip, parts = zlib.decompressobj(31), []
        data = data or stream.read(1 << 20)
    if parts:
        raise ValueError("a gzip member is cut")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, with its version, length, end and block digest checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    headers = dict(line.decode().split(": ", 1) for line in lines)
    block, end = rest[:int(headers["Content-Length"])], rest[int(headers["Content-Length"]):]
    if version != VERSION or end != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("a record is broken")
    return headers, block


RECORDS = ("file string, page_id long, url string, record_id string, record_type string, payload_bytes long, "
           "payload_digest string, refers_to long, refers_to_id string")


def read_archive(spark: SparkSession, root: str, payloads: bool = False) -> DataFrame:
    """The response and revisit records of the files that the manifest of ``root`` lists: file, page_id, url,
    record_id, record_type, payload_bytes, payload_digest (bare), refers_to (the page id of the record that a revisit
    refers to), refers_to_id, and with ``payloads`` the payload (null for revisits). Files without a manifest entry are
    not read. A file whose size, digest or number of records differs, or a record whose block or payload digest or
    length does, raises an error. URLs are as the header holds them. Files are read in parallel, records one at a time."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    small_batches(spark, BATCH_ROWS)
    schema = RECORDS + (", payload binary" if payloads else "")
    kinds = [pa.int64() if f.endswith(" long") else pa.binary() if f.endswith("binary") else pa.string() for f in schema.split(", ")]
    number = lambda x: None if x is None else int(x)

    def rows(path: str, store: pafs.FileSystem, entry: dict) -> Iterator[tuple]:
        count, digest = 0, hashlib.sha256()
        with store.open_input_stream(f"{path}/{entry['file']}", compression=None) as stream:
            while data := stream.read(1 << 20):
                digest.update(data)
        if digest.hexdigest() != entry["sha256"]:
            raise ValueError(f"{entry['file']} is not the file of the manifest")
        with store.open_input_stream(f"{path}/{entry['file']}", compression=None) as stream:
            for data in members(stream):
                headers, block = parsed(data)
                if headers["WARC-Type"] == "warcinfo":
                    continue
                count += 1
                http, _, payload = block.partition(b"\r\n\r\n")
                length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                found = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                whole = headers["WARC-Type"] == "response"
                if whole and (len(payload) != length or base32_sha1(payload) != found):
                    raise ValueError(f"{entry['file']}: the payload of {headers['WARC-Record-ID']} is broken")
                yield (entry["file"], number(headers.get("X-Page-Id")), headers.get("WARC-Target-URI"),
                       headers["WARC-Record-ID"], headers["WARC-Type"], length, found,
                       number(headers.get("X-Refers-To-Page-Id")), headers.get("WARC-Refers-To"),
                       *([payload if whole else None] if payloads else []))
        if count != entry["records"]:
            raise ValueError(f"{entry['file']} has {count} records, not {entry['records']}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(root)
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for entry in batch.to_pylist():
                held: list[tuple] = []
                size = 0
                for row in rows(path, store, entry):
                    held.append(row)
                    size += row[5]
                    if len(held) == 1000 or payloads and size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, schema)


def archived(pages: DataFrame, root: str, **options) -> DataFrame:
    """Write ``pages`` to ``root`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    write_archive(pages, root, **options)
    return read_archive(pages.sparkSession, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows from the table alone.
ORACLE = r"""
WITH p AS (SELECT row_number() OVER () AS k, page_id, url, coalesce(html, '') AS body FROM pages),
d AS (SELECT *, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS sha,
  array_to_string(list_transform(string_split(sha1(body), ''), lambda x: ['0000', '0001', '0010', '0011', '0100', '0101', '0110',
    '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', x)]), '') AS bits FROM p),
w AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS place,
  first_value(page_id) OVER (PARTITION BY sha ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS kept FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * CAST(substr(bits, CAST(i * 5 + 1 AS BIGINT), 1) AS INTEGER) + 8 * CAST(substr(bits, CAST(i * 5 + 2 AS BIGINT), 1) AS INTEGER)
    + 4 * CAST(substr(bits, CAST(i * 5 + 3 AS BIGINT), 1) AS INTEGER) + 2 * CAST(substr(bits, CAST(i * 5 + 4 AS BIGINT), 1) AS INTEGER)
    + CAST(substr(bits, CAST(i * 5 + 5 AS BIGINT), 1) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN kept END AS refers_to
FROM w
"""
