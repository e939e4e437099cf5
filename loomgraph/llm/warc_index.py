"""WARC archives with a two-level capture index.

Archives are written by Spark's text writer, a record a row, so they go through the
commit protocol of any file system. The index is made from the archives: capture
lines sorted by reversed-host URL key, in compressed blocks, and a sparse directory
with each block's first key. A look-up binary-searches the directory, opens one
block, and reads the record's bytes alone from its archive.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import forget, scratch_path, shuffle_partitions, stored

SMALLEST_SHARED = 100  # payloads of fewer bytes are never revisits
BLOCK_LINES = 3000
#: An archive is read as a whole, so it has to stay small: as many records as stay within these bytes, by classes
#: of record sizes (up to 16 KB, 64 KB, 256 KB ...) that are written apart.
ARCHIVE_BYTES, SMALL_RECORD = 80 << 20, 16 << 10
DIRECTORY_ROWS = 1_000_000  # rows of a directory that every executor may hold
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Rows of (page_id, response) that may be sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def url_key(url: Column) -> Column:
    """Reversed-host key: ``https://www.a.example/x?b`` is ``example,a)/x?b``; null is empty.

    Scheme, user, a leading ``www`` label, the default ports and the fragment don't
    count; host and path are lower-cased.
    """
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^([^/?]*)", 1), "^.*@", ""), ":(80|443)?$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*(.*)$", 1), r"^(\?|$)", "/$1")
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_bytes, payload_digest and refers_to (null: a response).

    Only captures that share a payload are joined back; the digest's smallest
    page_id is an aggregate, so a payload that a third of all pages have is no hot key
    in the shuffle. Rows that repeat a page_id are as one capture: none revisits itself.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html").withColumns({"payload_bytes": F.length(payload).cast("long"), "payload_digest": F.sha2(payload, 256)})
    large = rows.where(F.col("payload_bytes") >= SMALLEST_SHARED).select("page_id", "payload_digest")
    shared = large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    revisits = large.join(shared, "payload_digest").where("page_id > first").groupBy("page_id", "payload_digest").agg(F.min("first").alias("refers_to"))
    revisits = stored(revisits, "revisits")
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    return rows.join(revisits, ["page_id", "payload_digest"], "left")


def warc_rows(pages: DataFrame, date: str = DATE) -> DataFrame:
    """One row a record, without the two line ends that follow each."""
    rows, html = with_revisits(pages), F.coalesce(F.col("html"), F.lit(""))
    is_revisit = F.col("refers_to").isNotNull()
    block = F.when(is_revisit, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), html))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(_line("WARC-Target-URI", F.regexp_replace(F.col("url"), r"[\r\n]+", "%0A"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(is_revisit, F.concat(_line("WARC-Refers-To", _record_id(F.col("refers_to"))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        _line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"), _size_class("html").alias("size_class"))


def _size_class(text: str) -> Column:
    """0 for records of up to ``SMALL_RECORD`` bytes, then one more for each factor of four."""
    over = F.coalesce(F.octet_length(text), F.lit(0)) / F.lit(SMALL_RECORD)
    return F.when(over <= 1, 0).otherwise(F.ceil(F.log(4.0, over))).cast("int")


def write_warc(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Archives of at most about ``ARCHIVE_BYTES``, or of one record; records of very different sizes lie apart."""
    classes = sorted(r["c"] for r in pages.select(_size_class("html").alias("c")).distinct().collect())  # a dozen at most
    rows = warc_rows(pages, date)
    for k in classes or [0]:
        records = max(1, ARCHIVE_BYTES // (SMALL_RECORD * 4**k))
        own = rows.where(F.col("size_class") == k) if len(classes) > 1 else rows
        own.select("value").write.mode("append").option("lineSep", END).option("maxRecordsPerFile", records).text(path)


def parse_record(data: bytes | memoryview, at: int) -> tuple[dict[str, str], int, int]:
    """Headers of the record at ``at``, and where its block begins and ends."""
    data = memoryview(data)
    size, head = 4096, -1
    while head < 0:
        chunk = bytes(data[at : at + size])
        head = chunk.find(b"\r\n\r\n")
        if head < 0 and at + size >= len(data):
            raise ValueError(f"no WARC record at {at}")
        size *= 4
    lines = chunk[:head].decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    begin = at + head + 4
    return fields, begin, begin + int(fields["Content-Length"])


_CAPTURE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def _id(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return None if number in ("", "none") else int(number)


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split(" ")[0] for c in _CAPTURE.split(", ")]
    for frame in frames:
        for archive, content in zip(frame["path"], frame["content"], strict=True):
            data, at, rows = memoryview(content), 0, []
            while at < len(data):
                fields, begin, end = parse_record(data, at)
                kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                length = int(fields["X-Payload-Length"])
                if kind == "response":
                    payload = data[begin + len(HTTP_HEAD) : end]
                    digest, length = hashlib.sha256(payload).hexdigest(), len(payload)
                    if digest != stated:
                        raise ValueError(f"{archive} at {at}: payload is not what its digest says")
                rows.append((_id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), length, stated, kind, _id(fields.get("WARC-Refers-To")), archive, at, end - at))
                at = end + len(END)
            out = pd.DataFrame(rows, columns=names, dtype=object)
            yield out.astype({"payload_bytes": "int64", "offset": "int64", "length": "int64"}).astype({"page_id": "Int64", "refers_to": "Int64"})


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Reads the archives back: a row a record, with where it lies; payloads are checked against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInPandas(_scan, _CAPTURE)


_FIELDS = ["key", *(c.split(" ")[0] for c in _CAPTURE.split(", "))]


def write_index(found: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> None:
    """Blocks (sorted by key) and their directory: part, block, first, last, lines, packed."""
    n = shuffle_partitions(found.sparkSession)
    # no key alone decides the order, so that a key that very many captures share is cut
    lines = found.withColumn("key", url_key(F.col("url"))).repartitionByRange(n, "key", "archive", "offset").sortWithinPartitions("key", "archive", "offset")
    rows = lines.select("key", F.to_json(F.struct(*_FIELDS[1:])).alias("line"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        keys: list[str] = []
        text: list[str] = []

        def packed() -> pa.RecordBatch:
            body = zlib.compress("\n".join(f"{k}\t{t}" for k, t in zip(keys, text, strict=True)).encode("utf-8", "surrogatepass"), 6)
            return pa.record_batch([pa.array([x]) for x in (part, block, keys[0], keys[-1], len(keys), body)], names=["part", "block", "first", "last", "lines", "packed"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(k)
                text.append(t)
                if len(keys) == block_lines:
                    yield packed()
                    block, keys, text = block + 1, [], []
        if keys:
            yield packed()

    blocks = rows.mapInArrow(pack, "part long, block long, first string, last string, lines long, packed binary")
    blocks.write.option("parquet.block.size", str(1 << 20)).parquet(f"{path}/blocks")
    found.sparkSession.read.parquet(f"{path}/blocks").select("part", "block", "first", "last", "lines").coalesce(1).write.parquet(f"{path}/directory")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Every capture line of every block."""
    blocks = spark.read.parquet(f"{path}/blocks").select("packed")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                lines = _unpacked_lines(body)
                yield pa.record_batch([pa.array([x[i] for x in lines]) for i in (0, 1)], names=["key", "line"])

    lines = blocks.mapInArrow(unpack, "key string, line string")
    return lines.select("key", F.from_json("line", _CAPTURE).alias("c")).select("key", "c.*")


def _span(firsts: list[str], key: str) -> range:
    """Blocks that may hold ``key``: from the last that begins before it to the last that begins with it."""
    return range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key))


class CaptureIndex:
    """Look-ups in a written index: directory by binary search, one block a key, one range a record."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/directory").orderBy("first", "part", "block").collect()  # a row for 3000 captures
        self.firsts = [r["first"] for r in rows]
        self.rows = rows

    def blocks_of(self, key: str) -> list[tuple[int, int]]:
        return [(r["part"], r["block"]) for r in (self.rows[i] for i in _span(self.firsts, key)) if r["last"] >= key]

    def lookup(self, url: str) -> list[dict]:
        key = self.spark.range(1).select(url_key(F.lit(url)).alias("k")).first()["k"]
        found = []
        for part, block in self.blocks_of(key):
            for row in self.spark.read.parquet(f"{self.path}/blocks").where((F.col("part") == part) & (F.col("block") == block)).select("packed").collect():
                found += [json.loads(line) for k, line in _unpacked_lines(row["packed"]) if k == key]
        return found

    def record(self, capture: dict) -> bytes:
        """The record's bytes: one range of its archive, through Hadoop's file system."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(capture["archive"])
        stream = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(where)
        try:
            stream.seek(capture["offset"])
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, capture["length"])))
        finally:
            stream.close()


def _unpacked_lines(body: bytes) -> list[tuple[str, str]]:
    return [tuple(x.split("\t", 1)) for x in zlib.decompress(body).decode("utf-8", "surrogatepass").split("\n")]


def lookup_all(spark: SparkSession, path: str, urls: DataFrame, column: str = "url") -> DataFrame:
    """Every capture of every url in ``urls``: key and capture columns. Urls that share a key are one question; null is one.

    Each key binary-searches the directory for the blocks that may hold it, each block
    that is asked for is opened once, and its lines are held against the keys asked of it.
    A directory too large for every executor is left out, and keys are joined with all lines.
    """
    keys = urls.select(url_key(F.col(column)).alias("key")).distinct()
    directory = spark.read.parquet(f"{path}/directory")
    if directory.limit(DIRECTORY_ROWS + 1).count() > DIRECTORY_ROWS:
        return read_index(spark, path).join(keys, "key", "left_semi")
    rows = directory.orderBy("first", "part", "block").collect()
    held = spark.sparkContext.broadcast(([r["first"] for r in rows], [r["last"] for r in rows], [(r["part"], r["block"]) for r in rows]))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, places = held.value
        for batch in batches:
            found = [(*places[i], key) for key in batch.column(0).to_pylist() for i in _span(firsts, key) if lasts[i] >= key]
            yield pa.record_batch([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["part", "block", "key"])

    def opened(key: tuple, questions: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        wanted = set(questions["key"])
        lines = [x for body in blocks["packed"] if wanted for x in _unpacked_lines(body) if x[0] in wanted]
        return pd.DataFrame({"key": [x[0] for x in lines], "line": [x[1] for x in lines]}, dtype=object)

    blocks = spark.read.parquet(f"{path}/blocks").select("part", "block", "packed")
    lines = keys.mapInArrow(asked, "part long, block long, key string").groupBy("part", "block").cogroup(blocks.groupBy("part", "block")).applyInPandas(opened, "key string, line string")
    return lines.select("key", F.from_json("line", _CAPTURE).alias("c")).select("key", "c.*")


def digest(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Writes archives and index to the shared folder; the contract's columns as look-ups of the pages' urls give them."""
    spark = pages.sparkSession
    root = scratch_path(spark, "warc")
    write_warc(pages, f"{root}/archives", date)
    found = stored(captures(spark, f"{root}/archives"), "captures")  # the archives are read once
    write_index(found, f"{root}/index")
    forget(found)
    return lookup_all(spark, f"{root}/index", pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
