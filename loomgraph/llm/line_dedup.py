"""Line dedup: lines are exploded, normalised and hashed, the documents of each hash counted, and texts put together without the lines that too many share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import forget, fresh, stored

MIN_CHARS = 20  # shorter keys are never counted
MIN_DOCS = 3  # documents that make a line a repeated one
ADDED = ("n_lines", "n_dropped")
#: Lines in more than one of so many rows of lines are joined by broadcast: there can't be more of them than this.
FREQUENT = 100_000
BATCH_BYTES = 4 << 20  # of text that is put together at once; a longer text is taken alone

_SPACE = " \t\n\x0b\x0c\r"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(_SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _CAPITALS, _SMALL))


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, row0, row1, place, line0, line1) of every line whose key has ``min_chars`` code points.

    row0 and row1 are 128 bits of hash of the document's id and text, line0 and line1 of
    the line's key; ``place`` counts from 0.
    """
    rows = docs.select(F.col(key).alias("doc"), *[F.xxhash64(F.lit(k), key, text).alias(f"row{k}") for k in (0, 1)], F.coalesce(F.col(text), F.lit("")).alias("text"))
    lines = rows.select("doc", "row0", "row1", F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("line", line_key(F.col("line")))
    return lines.where(F.length("line") >= min_chars).select("doc", "row0", "row1", "place", *[F.xxhash64(F.lit(k), "line").alias(f"line{k}") for k in (0, 1)])


def repeated_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(line0, line1, docs, last): lines of ``min_docs`` or more documents, and the largest id among those."""
    return lines.groupBy("line0", "line1").agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("last")).where(F.col("docs") >= min_docs)


def dropped_places(lines: DataFrame, repeats: DataFrame) -> DataFrame:
    """(row0, row1, gone): the places of each document's lines that go.

    Lines so frequent that only ``FREQUENT`` of them can exist are looked up by
    broadcast; what is left has no frequent key and is joined by a shuffle.
    """
    least = -(-lines.count() // FREQUENT)
    on = ["line0", "line1"]
    repeats = repeats.select(*on, "docs", "last")
    often = F.broadcast(repeats.where(F.col("docs") > least).drop("docs"))
    seldom = repeats.where(F.col("docs") <= least).drop("docs")
    others = ~F.col("doc").eqNullSafe(F.col("last"))
    by_broadcast = lines.join(often, on).where(others)
    by_shuffle = lines.join(often.drop("last"), on, "left_anti").join(seldom, on).where(others)
    every = by_broadcast.select("row0", "row1", "place").unionByName(by_shuffle.select("row0", "row1", "place"))
    return every.groupBy("row0", "row1").agg(F.collect_set("place").alias("gone"))


def kept_text(text: bytes, gone: list[int]) -> bytes:
    out = set(gone)
    return b"\n".join(line for i, line in enumerate(text.split(b"\n")) if i not in out)


def kept_lines(batch: pa.RecordBatch, at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A batch whose last column has the places of lines to drop, cut where its texts reach ``BATCH_BYTES``; ``ADDED`` stand in their place.

    Texts stay the bytes they are, and only those that lose lines are taken apart, so
    little more than ``BATCH_BYTES`` is held besides the batch.
    """
    total, first = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while first < batch.num_rows:
        before = total[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(total, before + BATCH_BYTES, "right")))
        part = batch.slice(first, end - first)
        texts, gone = part.column(at), part.column(len(names))
        n_lines = pc.add(pc.fill_null(pc.count_substring(texts, "\n"), 0).cast(pa.int64()), 1)
        n_dropped = pc.fill_null(pc.list_value_length(gone), 0).cast(pa.int64())
        lose = pc.and_(pc.greater(n_dropped, 0), texts.is_valid())
        raw = texts.cast(pa.binary() if texts.type == pa.string() else pa.large_binary())
        cut = [kept_text(t, g) for t, g in zip(raw.filter(lose).to_pylist(), gone.filter(lose).to_pylist(), strict=True)]
        if cut:
            raw = pc.replace_with_mask(raw, lose, pa.array(cut, raw.type))
        columns = [part.column(i) for i in range(len(names))]
        columns[at] = raw.cast(texts.type, safe=False)
        yield pa.record_batch([*columns, n_lines, n_dropped], names=[*names, *ADDED])
        first = end


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` whose texts lack repeated lines, with ``n_lines`` (before) and ``n_dropped``.

    A key of ``min_chars`` code points or more that ``min_docs`` documents hold stays only
    in that of the largest id, there as often as it occurs. Null and empty texts are one
    empty line and stay as they are. Rows that repeat an id are one document; a row
    without an id adds to no count and loses what the others repeat. Repeated rows all
    stay, an empty table gives an empty result. Columns of ``docs`` that are named like
    those added are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ADDED])
    lines = stored(line_table(docs, key, text, min_chars), "lines")
    repeats = stored(repeated_lines(lines, min_docs), "repeated-lines")
    places = stored(dropped_places(lines, repeats), "dropped-lines")
    forget(lines, repeats)
    names = [fresh(n, docs.columns) for n in ("_row0", "_row1", "_gone")]
    rows = docs.withColumns({names[k]: F.xxhash64(F.lit(k), key, text) for k in (0, 1)})
    rows = rows.join(places.toDF(*names), names[:2], "left").select(*docs.columns, names[2])
    columns = docs.columns
    at, schema = columns.index(text), T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from kept_lines(batch, at, columns)

    return rows.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    rows = without_repeated_lines(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
