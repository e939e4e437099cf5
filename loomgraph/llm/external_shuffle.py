"""Sharding by a two-pass external shuffle.

Pass one scatters records into memory-sized buckets with seeded hashes, pass two
Fisher-Yates shuffles each bucket and writes it. The shard of a record follows
from its key and the number of shards alone (the shard with the highest seeded
hash of the two wins), so one more shard takes rows only into itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import counted_turns, stored, text_bytes

ROW_BYTES = 16
ADDED = ("size", "text_crc32", "shard", "grown_shard", "slot")
FEW_BUCKETS = 100_000  # a row a bucket, which every executor may hold


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash with ``key`` is highest; ties go to the higher shard."""
    best = F.array_max(F.array(*[F.struct(F.xxhash64(key, F.lit(seed), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]))
    return best["s"].cast("int")


def buckets_of(docs: DataFrame, shards: int, bucket_bytes: int) -> int:
    """Buckets of a shard, as many as its bytes ask for."""
    total = docs.select(F.sum(text_bytes("text") + F.lit(ROW_BYTES)).alias("b")).first()["b"] or 0
    return max(1, -(-total // (shards * bucket_bytes)))


def scatter(docs: DataFrame, shards: int, buckets: int, seed: int = 17, key: str = "doc_id") -> DataFrame:
    """Pass one: adds ``size``, ``text_crc32``, ``shard``, ``grown_shard``, and ``_bucket`` within the shard.

    The bucket is a seeded hash of the whole row and its turn among rows equal to it,
    so it does not depend on how rows lie in files, and a row repeated without end
    fills no single bucket.
    """
    return counted_turns(docs).withColumns({
        "size": text_bytes("text") + F.lit(ROW_BYTES),
        "text_crc32": F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))),
        "shard": shard_of(F.col(key), shards, seed),
        "grown_shard": shard_of(F.col(key), shards + 1, seed),
        "_bucket": F.pmod(F.xxhash64("_row", "_turn", F.lit(seed + 1)), F.lit(buckets)).cast("int"),
    })


def _shuffled(seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, bucket = (int(x) for x in key)
        # an order that does not depend on how the rows arrived, then Fisher-Yates over it
        rows = rows.sort_values(["_row", "_turn", "text_crc32", "size"], kind="stable")
        rows = rows.iloc[np.random.default_rng([seed, shard, bucket]).permutation(len(rows))]
        return rows.assign(_place=np.arange(len(rows), dtype=np.int64)).drop(columns=["_row", "_turn"])

    return run


def external_shuffle(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = 64 << 20, key: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with its ``shard``, ``slot`` (0, 1, 2 ... within the shard), ``size``, ``text_crc32`` and ``grown_shard``.

    ``columns`` are those of ``docs`` that go along (all by default). Null texts count
    as none, null keys are one key like any other, repeated rows each get a slot of
    their own, an empty table gives an empty result. The same rows in any files and
    partitions get the same slots. Columns of ``docs`` that are named like those added
    are replaced.
    """
    columns = [c for c in columns or docs.columns if c not in ADDED]
    docs = docs.select(*dict.fromkeys([*columns, key, "text"]))
    buckets = buckets_of(docs, shards, bucket_bytes)
    rows = scatter(docs, shards, buckets, seed, key)
    rows = rows.select(*columns, *[c for c in ADDED if c in rows.columns], "_bucket", "_row", "_turn")
    schema = T.StructType([*rows.drop("_row", "_turn").schema.fields, T.StructField("_place", T.LongType())])
    placed = stored(rows.groupBy("shard", "_bucket").applyInPandas(_shuffled(seed), schema), "shuffled")
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("n")).drop("n")
    before = F.broadcast(before) if shards * buckets <= FEW_BUCKETS else before
    return placed.join(before, ["shard", "_bucket"]).withColumn("slot", F.col("_place") + F.col("_before")).select(*columns, *ADDED)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes the shuffled records as Parquet, a folder a shard, in slot order within each file."""
    rows = external_shuffle(docs, **options)
    rows.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """The contract's columns, from the shuffled records as written: where each went, under the law ``key``."""
    rows = external_shuffle(docs.select("doc_id", "text"), shards, seed)
    crc = F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    return rows.select("doc_id", (text_bytes("text") + F.lit(ROW_BYTES)).alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
