"""Best-fit packing into bins of several permitted lengths.

Documents are cut into pieces no longer than the longest permitted length, and the
pieces are packed by best fit, longest first. A piece that fits no open bin opens a
bin of the size that costs least for a token it can be expected to hold; in the end
each bin becomes the smallest permitted length that holds its contents.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import stored

LENGTHS = (256, 512, 1024, 2048, 4096)
#: Pieces that one task packs; each group leaves a few bins unfilled, so it is large.
GROUP_PIECES = 40_000


def bin_cost(length: int | np.ndarray) -> float | np.ndarray:
    """Relative cost of a sequence: linear in its length, with attention's square and a fixed share."""
    return 64.0 + length + length * length / 8192.0


def opening_sizes(sizes: np.ndarray, lengths: Sequence[int]) -> dict[int, int]:
    """The length to open for a piece of each size: least cost a token it can be expected to hold.

    What is expected follows from the pieces at hand: what remains of a bin is
    filled as far as there are pieces that small.
    """
    ordered = np.sort(sizes)
    below = np.r_[0, np.cumsum(ordered)]
    total = max(1, int(below[-1]))
    out = {}
    for size in np.unique(sizes):
        best = None
        for length in (x for x in lengths if x >= size):
            small = below[np.searchsorted(ordered, length - size, "right")] / total  # share of tokens in pieces that would fit
            cost = bin_cost(length) / (size + (length - size) * small)
            if best is None or cost < best[0]:
                best = (cost, length)
        out[int(size)] = best[1]
    return out


def best_fit(sizes: np.ndarray, lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset within it) of each piece, and each bin's final length."""
    lengths = sorted(lengths)
    opening = opening_sizes(sizes, lengths) if len(sizes) else {}
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # open bins by what remains
    rooms: list[int] = []  # the remainders that some bin has, sorted
    filled: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        k = bisect.bisect_left(rooms, size)
        if size and k < len(rooms):
            room = rooms[k]
            number = free[room].pop()
            if not free[room]:
                del rooms[k]
        else:
            room, number = opening[size], len(filled)
            filled.append(0)
        bins[i], offsets[i] = number, filled[number]
        filled[number] += size
        left = room - size
        if left:
            if not free[left]:
                bisect.insort(rooms, left)
            free[left].append(number)
    return bins, offsets, [lengths[bisect.bisect_left(lengths, f)] for f in filled]


_BLANKS = r"[\x20\x09-\x0D]+"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words() -> Column:
    """The text's words; none of a null or blank text."""
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _BLANKS, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """(doc_id, copy, piece, size): a document's words and an end mark, cut at every ``longest``.

    A null or wordless text has the end mark alone. ``copy`` is a hash of the text, which tells rows of one doc_id apart.
    """
    sized = docs.select("doc_id", F.xxhash64("text").alias("copy"), (F.size(_words()) + 1).alias("n"))
    cut = sized.select("doc_id", "copy", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / longest).cast("int"))).alias("piece"))
    return cut.select("doc_id", "copy", "piece", F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("int").alias("size"))


_PLAN = "doc_id long, copy long, turn long, piece int, size int, bin_id long, bin_length int, bin_offset int"


def plan(docs: DataFrame, lengths: Sequence[int] = LENGTHS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every piece with its bin, as ``pack``, with the ``copy`` (hash of the text) and ``turn`` (number among equal rows) of its document."""
    rows = pieces(docs, max(lengths)).groupBy("doc_id", "copy", "piece", "size").agg(F.count("*").alias("copies"))
    rows = stored(rows, "pieces")
    groups = max(1, -(-(rows.agg(F.sum("copies")).first()[0] or 0) // group_pieces))
    each = rows.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    dealt = each.withColumn("group", F.pmod(F.xxhash64("doc_id", "copy", "piece", "turn", F.lit(23)), F.lit(groups)).cast("int"))
    lengths = tuple(sorted(lengths))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "doc_id", "piece", "copy", "turn"], kind="stable").reset_index(drop=True)
        bins, offsets, final = best_fit(frame["size"].to_numpy(), lengths)
        return frame.drop(columns="group").assign(bin_id=bins + (int(key[0]) << 32), bin_length=np.array(final, np.int32)[bins], bin_offset=offsets.astype(np.int32))[[x.split()[0] for x in _PLAN.split(", ")]]

    return dealt.groupBy("group").applyInPandas(run, _PLAN)


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every piece with its bin: doc_id, piece, size, bin_id, bin_length, bin_offset.

    Pieces are dealt to groups of bounded size by a seeded hash of document, piece and
    turn among equal rows, so one task never holds more of them than fit, however many
    rows share an id, a source or a text, and the same rows in any files and partitions
    get the same bins. No piece is dropped or cut further; an empty table has no bins.
    """
    return plan(docs, lengths, group_pieces).drop("copy", "turn")


def sequences(docs: DataFrame, lengths: Sequence[int] = LENGTHS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The rows of ``pack`` with the ``words`` of each piece, joined by one space; the last piece of a document ends with the end mark, which is no word.

    Sort by bin_id and bin_offset to write the sequences.
    """
    longest = max(lengths)
    placed = stored(plan(docs, lengths, group_pieces), "plan").withColumn("_key", F.xxhash64("doc_id", "copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _WORD.findall(text or "")  # a text is split once, whatever its length
                parts = [" ".join(words[i : i + longest]) for i in range(0, len(words) + 1, longest)]
                for at in range(0, len(parts), 1000):
                    some = parts[at : at + 1000]
                    yield pa.record_batch([pa.array([key] * len(some), pa.int64()), pa.array(range(at, at + len(some)), pa.int32()), pa.array(some, pa.string())], names=["_key", "piece", "words"])

    cut = docs.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("_key"), "text").mapInArrow(run, "_key long, piece int, words string").dropDuplicates(["_key", "piece"])
    return placed.join(cut, ["_key", "piece"]).select("doc_id", "piece", "size", "bin_id", "bin_length", "bin_offset", "words")
