"""What the training-data operators share: scratch tables, fixed-size filters, text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; in a local session that has none set, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


_FOLDER = "_scratch_folder"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _FOLDER, path)
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the folders of ``stored`` tables that nothing will read again, through Hadoop's file system."""
    for table in tables:
        if path := getattr(table, _FOLDER, None):
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that none of ``taken`` equals, in capitals or not."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(text: str) -> Column:
    """UTF-8 bytes of a text column, null as none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def give_back() -> None:
    """Returns what a finished task has freed to the system: Spark keeps Python workers for the tasks that follow."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


FEW_REPEATS = 200_000  # rows of hashes and counts that every executor may hold


def counted_turns(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a hash of the whole row, and ``_turn``, its number (0, 1, 2 ...) among rows equal to it.

    Equal rows are counted, one of them is kept, and made as many again as there were:
    no window, and nothing depends on how the rows lie. Rows count as equal by 128 bits.
    """
    hashes = {f"_row{k or ''}": F.xxhash64(F.lit(k), *docs.columns) for k in (0, 1)}
    rows = docs.withColumns(hashes)
    keys = list(hashes)
    repeats = stored(rows.groupBy(*keys).agg(F.count("*").alias("_copies")).where("_copies > 1"), "repeats")
    few = repeats.count()
    if not few:
        return rows.withColumn("_turn", F.lit(0).cast("long")).drop("_row1")
    held = F.broadcast(repeats) if few <= FEW_REPEATS else repeats
    once = rows.join(held, keys, "left_anti").withColumn("_turn", F.lit(0).cast("long"))
    first = rows.join(held, keys, "left_semi").groupBy(*keys).agg(*[F.first(c).alias(c) for c in docs.columns])
    many = first.join(held, keys).withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    return once.select(*docs.columns, "_row", "_turn").unionByName(many.select(*docs.columns, "_row", "_turn"))


# ---------------------------------------------------------------- fixed-size bit filters


def bit_filter(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bitmap of ``2**bits`` bits in which each hashed 64-bit key of ``column`` sets two: by its top and its low bits.

    Its size is fixed by ``bits``, whatever the number of keys: it may be sent to
    every executor. Set bits can also come from other keys, so what passes may have
    to be joined with the keys themselves.
    """
    low = min(bits, 15)  # bits within one word of the map: 4 KB blocks
    sparse = 1 << low >> 4  # set bits of a block that are no longer as places of two bytes than as a map

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a task's keys set, one row a block: their union needs no key a second time."""
        own = np.zeros(1 << max(0, bits - 3), np.uint8)

        def take(keys: np.ndarray) -> None:
            slots = np.unique(np.concatenate([keys >> np.uint64(64 - bits), keys & np.uint64((1 << bits) - 1)])).astype(np.int64)
            if len(slots):
                new = np.flatnonzero(np.r_[True, slots[1:] >> 3 != slots[:-1] >> 3])
                own[slots[new] >> 3] |= np.bitwise_or.reduceat((128 >> (slots & 7)).astype(np.uint8), new)

        held, many = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            many += batch.num_rows
            if many > 1 << 20:
                take(np.concatenate(held))
                held, many = [], 0
        if held:
            take(np.concatenate(held))
        parts = own.reshape(-1, max(1, (1 << low) // 8))
        at = np.flatnonzero(parts.any(axis=1))
        for k in range(0, len(at), 1024):
            maps = []
            for i in at[k : k + 1024]:
                places = np.flatnonzero(np.unpackbits(parts[i]))
                maps.append(places.astype("<u2").tobytes() if len(places) < sparse else parts[i].tobytes())
            yield pa.record_batch([pa.array(at[k : k + 1024]), pa.array(maps, pa.binary())], names=["block", "map"])

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = seen.setdefault(i, np.zeros(max(1, (1 << low) // 8), np.uint8))
                if len(raw) == len(whole):
                    whole |= np.frombuffer(raw, np.uint8)
                else:
                    places = np.zeros(len(whole) * 8, bool)
                    places[np.frombuffer(raw, "<u2")] = True
                    whole |= np.packbits(places)
        if seen:
            yield pa.record_batch([pa.array(list(seen), pa.int64()), pa.array([v.tobytes() for v in seen.values()], pa.binary())], names=["block", "map"])

    out = np.zeros((1 << (bits - low), max(1, (1 << low) // 8)), np.uint8)
    rows = keys.select(F.col(column).cast("long")).mapInArrow(blocks, "block long, map binary")
    for row in rows.repartition("block").mapInArrow(union, "block long, map binary").collect():
        out[row["block"]] |= np.frombuffer(row["map"], np.uint8)
    return out.reshape(-1)


def passes(filter_map: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit ``keys`` may be in a ``bit_filter``."""

    def is_set(slot: np.ndarray) -> np.ndarray:
        slot = slot.astype(np.int64)
        return (filter_map[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1

    out = is_set(keys >> np.uint64(64 - bits))
    at = np.flatnonzero(out)
    out[at] = is_set(keys[at] & np.uint64((1 << bits) - 1))
    return out


# ---------------------------------------------------------------- texts as byte buffers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without copying, and n + 1 offsets; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)), at




_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, made as far as they are asked for."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, _PIECE + 1)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            cls.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)], dtype=np.uint64)
            cls.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inverse, np.uint64)], dtype=np.uint64)
        return cls.up, cls.down


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Word hashes of consecutive texts: (first text, hashes, n + 1 word offsets), about 1 MB of text at a time.

    A word is a run of bytes other than space and 0x09-0x0D; ``lower`` maps A-Z to
    a-z first. Equal words have equal hashes everywhere.
    """
    for first, _, _, _, hashes, at in placed_words(data, offsets, lower):
        yield first, hashes, at


def placed_words(data: np.ndarray, offsets: np.ndarray, lower: bool, cuts: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """As ``hashed_words``, with the bytes and each word's first and last place in them: (first text, bytes, starts, ends, hashes, offsets).

    ``cuts`` marks, of bytes in which texts begin at given places, those that begin a word without white space before them.
    """
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _PIECE, "right")) - 1)
        part = data[offsets[i] : offsets[j]]
        part = _LOWER[part] if lower else part
        bounds = offsets[i : j + 1] - offsets[i]
        space = _SPACE[part]
        first = np.ones(len(part) + 1, bool)
        first[1:] = np.r_[space, True][: len(part)]
        first[bounds] = True  # a text's first byte begins a word
        last = np.r_[space[1:], True] | first_at(bounds, len(part))
        if cuts:
            inside = cuts(part, bounds)
            first[:-1] |= inside
            last[:-1] |= inside[1:]
        begins = ~space & first[:-1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(~space & last) + 1
        if len(part) <= 4 * _PIECE:
            hashes = _hash_words(part, starts, ends)
        else:  # one long text: its words in runs, so that the tables of powers stay small
            cuts = [0, *np.searchsorted(starts, np.arange(_PIECE, len(part), _PIECE)), len(starts)]
            runs = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
            hashes = np.concatenate([_hash_words(part[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a]) for a, b in runs]) if runs else np.zeros(0, np.uint64)
        yield i, part, starts, ends, hashes, np.searchsorted(starts, bounds)
        i = j


def first_at(bounds: np.ndarray, n: int) -> np.ndarray:
    """Marks the byte before each text's end."""
    out = np.zeros(n, bool)
    ends = bounds[1:] - 1
    out[ends[(ends >= 0) & (ends < n)]] = True
    return out


def sequence_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words, by its first word's place."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = 1
    for k in range(length):
        factor = factor * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D & (1 << 64) - 1
        total += words[k : k + n] * np.uint64(factor | 1)
    return mix(total)
