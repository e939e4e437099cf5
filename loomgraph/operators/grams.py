"""Runs of three bytes as keys: which texts may match an expression, and which hold which of many strings, without looking at all pairs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import retrieval as R
from loomgraph.sources.tables import checkpointed

GRAM = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE = 1 << 20  # bytes of a text whose grams are made at once
ROWS = 1 << 18  # rows of grams that are sent on at once


def grams_of(raw: bytes, lower: bool = False, short: bool = False) -> np.ndarray:
    """Distinct grams of a text's bytes as numbers, those that span a line's end left out; ``short`` adds runs of one and two bytes. ``lower`` takes A-Z as a-z."""
    data = np.frombuffer(raw, np.uint8)
    data = _LOWER[data] if lower else data
    found = [np.zeros(0, np.int64)]
    for at in range(0, max(1, len(data)), _PIECE):
        part = data[at : at + _PIECE + GRAM - 1].astype(np.int64)
        for n in range(1 if short else GRAM, GRAM + 1):
            value = np.full(max(0, len(part) - n + 1), n << 24, np.int64)
            plain = np.ones(len(value), bool)
            for k in range(n):
                value += part[k : k + len(value)] << (8 * k)
                plain &= part[k : k + len(value)] != 10
            found.append(np.unique(value[plain]))
    return np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]


def gram_rows(texts: DataFrame, key: str, text: str, lower: bool = False, short: bool = False) -> DataFrame:
    """(key, gram): every text's distinct grams, a row each; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, np.ndarray]] = []
            many = 0

            def made(batch: pa.RecordBatch, found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
                rows = np.repeat([i for i, _ in found], [len(g) for _, g in found])
                return pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(np.concatenate([g for _, g in found]))], names=["key", "gram"])

            for i, raw in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                grams = grams_of(raw, lower, short) if raw else ()
                for at in range(0, len(grams), ROWS):
                    found.append((i, grams[at : at + ROWS]))
                    many += len(found[-1][1])
                    if many >= ROWS:
                        yield made(batch, found)
                        found, many = [], 0
            if found:
                yield made(batch, found)

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(run, f"key {kind}, gram long")


# ---------------------------------------------------------------- many strings in many texts


def contained(texts: DataFrame, needles: DataFrame, key: str = "key", text: str = "text", needle: str = "needle") -> DataFrame:
    """(key, needle): which distinct ``needles`` each text holds, byte for byte; no limit on either.

    Of each needle the gram that fewest texts have is its key: only texts with that gram
    are looked at. Nulls hold and are held by nothing; an empty needle is in every text.
    Keys of ``texts`` must be unique and not null.
    """
    asked = checkpointed(needles.select(F.col(needle).alias("needle")).where("needle is not null").distinct())
    whole = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    short = not asked.where(F.octet_length("needle").between(1, GRAM - 1)).isEmpty()
    wanted = gram_rows(asked.where("needle not like '%\\n%'"), "needle", "needle", short=short).withColumnRenamed("key", "needle")
    length = F.least(F.octet_length("needle"), F.lit(GRAM))
    wanted = checkpointed(wanted.where(F.shiftright("gram", 24) == length))  # of a short needle itself alone
    held = checkpointed(gram_rows(whole, "key", "text", short=short).join(wanted.select("gram").distinct(), "gram", "left_semi"))
    many = held.groupBy("gram").agg(F.count("*").alias("many"))
    # a gram that no text has is rarest of all: its needle is nowhere
    rarest = wanted.join(many, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "gram"))["gram"].alias("gram"))
    pairs = held.join(rarest, "gram").select("key", "needle")
    pairs = pairs.unionByName(whole.select("key").crossJoin(F.broadcast(asked.where("needle = ''"))))  # one row at most
    lines = asked.where("needle like '%\\n%'")  # rare: grams don't span lines, so their first line's do for all
    if not lines.isEmpty():
        heads = contained(whole, lines.select(F.substring_index("needle", "\n", 1).alias("needle")), "key", "text", "needle").withColumnRenamed("needle", "head")
        pairs = pairs.unionByName(heads.join(lines.withColumn("head", F.substring_index("needle", "\n", 1)), "head").select("key", "needle"))
    return whole.join(pairs, "key").where(F.contains("text", F.col("needle"))).select("key", "needle")


# ---------------------------------------------------------------- expressions


@dataclass(frozen=True)
class Needs:
    """What a text must have to match: all of some grams and of other needs (``every``), or one of these; nothing if empty and ``every``."""

    grams: frozenset[int] = frozenset()
    parts: tuple[Needs, ...] = ()
    every: bool = True

    def all_grams(self) -> frozenset[int]:
        return self.grams.union(*(p.all_grams() for p in self.parts))

    @property
    def free(self) -> bool:
        return self.every and not self.grams and not self.parts

    def met_by(self, held: Column) -> Column:
        own = [F.array_contains(held, F.lit(g)) for g in sorted(self.grams)] + [p.met_by(held) for p in self.parts]
        return reduce(lambda a, b: (a & b) if self.every else (a | b), own) if own else F.lit(True)


def needs_of(pattern: str) -> Needs:
    """Grams (A-Z as a-z) that every line which matches an expression has; nothing where the expression can't be read or says too little."""
    try:
        return _needs(_parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return Needs()


def _needs(parsed) -> Needs:
    runs, parts, run = [], [], []

    def walk(items) -> None:
        for op, value in items:
            if op is C.LITERAL and value < 128:
                run.append(value)
            elif op is C.AT:  # has no width
                continue
            elif op is C.SUBPATTERN:
                walk(value[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] >= 1:
                cut()
                parts.append(_needs(value[2]))
            elif op is C.BRANCH:
                cut()
                ways = [_needs(w) for w in value[1]]
                if not any(w.free for w in ways):
                    parts.append(Needs(parts=tuple(ways), every=False))
            elif op is C.ATOMIC_GROUP:
                walk(value)
            elif op in (C.ASSERT, C.ASSERT_NOT):
                cut()  # what is looked at is not matched
            else:
                cut()

    def cut() -> None:
        runs.append(bytes(run))
        run.clear()

    walk(parsed)
    cut()
    grams = frozenset(int(g) for r in runs if len(r) >= GRAM for g in grams_of(r, lower=True))
    return Needs(grams, tuple(p for p in parts if not p.free))


class GramIndex:
    """Grams of texts, sorted: a look-up opens the row groups of its grams, and then only the texts that may match."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def write(self, docs: DataFrame, text: str = "text") -> GramIndex:
        """Of texts with unique ids, to a new folder."""
        rows = gram_rows(docs, self.key, text, lower=True).withColumnRenamed("key", self.key)
        rows.repartitionByRange("gram", self.key).sortWithinPartitions("gram", self.key).write.option("parquet.block.size", str(8 << 20)).parquet(self.path)
        return self

    def candidates(self, pattern: str, is_regex: bool = False) -> DataFrame | None:
        """(key) of the texts that may have a line that matches; None if any may."""
        needs = needs_of(pattern if is_regex else re.escape(pattern))
        if needs.free:
            return None
        asked = sorted(needs.all_grams())
        held = self.spark.read.parquet(self.path).where(F.col("gram").isin(asked)).groupBy(self.key).agg(F.collect_set("gram").alias("held"))
        return held.where(needs.met_by(F.col("held"))).select(self.key)

    def grep(self, docs: DataFrame, pattern: str, is_regex: bool = False, case_sensitive: bool = False) -> DataFrame:
        """As ``retrieval.grep``, over texts that may match."""
        few = self.candidates(pattern, is_regex)
        return R.grep(docs if few is None else docs.join(few, self.key, "left_semi"), pattern, is_regex, case_sensitive, self.key)

