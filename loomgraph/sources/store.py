"""Tables in versions: a folder of immutable Parquet segments and one small manifest for each version.

A version is there when its manifest is, which is written beside and renamed: what a
failed job leaves is in no manifest and is never read. Every row carries the version
that wrote it (``_version``), so that readers can tell which rows later ones replace.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources.tables import small_text

BUCKETS = 256  # folders of a segment, by a hash of the table's bucket column
CUT_ROWS = 1_000_000  # segments of fewer rows are not cut in folders


@dataclass(frozen=True)
class Table:
    """A table's columns, the column its segments are cut by or those they are laid in order of, and what rows of older schemas have in columns they lack (SQL)."""

    schema: str
    bucket: str | None = None
    order: tuple[str, ...] = ()
    defaults: Mapping[str, str] = field(default_factory=dict)


def bucket_of(column: Column | str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


class StoreError(RuntimeError):
    """The folder holds what this library can't read, or another writer was faster."""


class Store:
    """``tables`` in versions below ``path``; ``schema`` is the number of their present form.

    A store of an older schema is taken over once, by a manifest alone: its segments
    stay as they are, and their rows get the defaults of columns that they lack. One
    writer at a time is assumed; a second one that commits the same version gets an error.
    """

    def __init__(self, spark: SparkSession, path: str, tables: Mapping[str, Table], schema: int = 1, merge_at: int = 8, cut_rows: int = CUT_ROWS):
        self.spark, self.path, self.tables, self.schema, self.merge_at, self.cut_rows = spark, path.rstrip("/"), dict(tables), schema, merge_at, cut_rows
        self.last = self._newest()
        if self.last and self.last["schema"] > schema:
            raise StoreError(f"{path} has schema {self.last['schema']}, this library knows {schema}")
        if self.last and self.last["schema"] < schema:
            self._write({**self.last, "version": self.last["version"] + 1, "schema": schema, "segments": {**{t: [] for t in self.tables}, **self.last["segments"]}})

    # ------------------------------------------------------------ manifests

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        fs, where = self._fs(f"{self.path}/versions/*.json")
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.globStatus(where) or ())

    def manifest(self, version: int) -> dict:
        return json.loads(small_text(self.spark, f"{self.path}/versions/{version:010d}.json"))

    def _newest(self) -> dict:
        found = self.versions()
        return self.manifest(found[-1]) if found else {}

    def refresh(self) -> Store:
        """Sees what other sessions have committed since."""
        self.last = self._newest()
        return self

    @property
    def version(self) -> int:
        return self.last.get("version", 0)

    def _write(self, manifest: dict) -> None:
        name = f"{self.path}/versions/{manifest['version']:010d}.json"
        fs, target = self._fs(name)
        _, beside = self._fs(f"{name}.{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if fs.exists(target) or not fs.rename(beside, target):
            fs.delete(beside, False)
            raise StoreError(f"version {manifest['version']} of {self.path} was committed by another writer")
        self.last = manifest

    # ------------------------------------------------------------ rows

    def _schema(self, table: str) -> T.StructType:
        return T.StructType([*T._parse_datatype_string(self.tables[table].schema).fields, T.StructField("_version", T.LongType())])

    def read(self, table: str, of: DataFrame | None = None) -> DataFrame:
        """Rows of all segments with ``_version``, replaced ones too.

        ``of`` has one column of values of the bucket column: only folders that may hold
        one of those are opened (their numbers, at most ``BUCKETS``, go to the driver).
        """
        rows = self._rows(table, self.last.get("segments", {}).get(table, []))
        if of is None:
            return rows.drop("_bucket")
        wanted = sorted(r[0] for r in of.select(bucket_of(of.columns[0])).distinct().collect())
        return rows.where(F.col("_bucket").isin(wanted) | F.col("_bucket").isNull()).drop("_bucket")

    def _rows(self, table: str, segments: Sequence[dict]) -> DataFrame:
        """Segments as one table, with the ``_bucket`` folder a row lies in (null in segments without folders)."""
        spec, schema = self.tables[table], self._schema(table)
        empty = self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())]))
        out = None
        for old in sorted({s["schema"] for s in segments}):
            for cut in (True, False):
                paths = [f"{self.path}/{table}/{s['name']}" for s in segments if s["schema"] == old and s["cut"] == cut]
                if not paths:
                    continue
                if cut:
                    rows = self.spark.read.schema(empty.schema).option("basePath", f"{self.path}/{table}").parquet(*paths)
                    rows = rows.select(*empty.columns)
                else:
                    rows = self.spark.read.schema(schema).parquet(*paths).withColumn("_bucket", F.lit(None).cast("int"))
                if old < self.schema:
                    rows = rows.withColumns({c: F.coalesce(F.col(c), F.expr(d).cast(schema[c].dataType)) for c, d in spec.defaults.items()})
                out = rows if out is None else out.unionByName(rows)
        return empty if out is None else out

    def _segment(self, table: str, rows: DataFrame) -> dict | None:
        """Writes rows that have ``_version`` already; None if there are none."""
        name, spec = f"segment={uuid.uuid4().hex}", self.tables[table]
        where, rows = f"{self.path}/{table}/{name}", rows.select(*self._schema(table).names)
        cut = bool(spec.bucket) and rows.limit(self.cut_rows).count() >= self.cut_rows
        if spec.order:
            rows.repartitionByRange(*spec.order).sortWithinPartitions(*spec.order).write.option("parquet.block.size", str(8 << 20)).parquet(where)
        elif cut:
            laid = rows.withColumn("_bucket", bucket_of(spec.bucket)).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", spec.bucket)
            laid.write.partitionBy("_bucket").parquet(where)
        else:
            rows = rows.hint("rebalance")
            (rows.sortWithinPartitions(spec.bucket) if spec.bucket else rows).write.parquet(where)
        count = self.spark.read.schema(self._schema(table)).parquet(where).count()  # from the files' footers
        if not count:
            fs, path = self._fs(where)
            fs.delete(path, True)
            return None
        return {"name": name, "rows": count, "schema": self.schema, "cut": cut}

    def commit(self, added: Mapping[str, DataFrame], note: Mapping | None = None) -> int:
        """Adds one segment to each of some tables and makes that the next version; ``note`` entries are kept in its manifest.

        The tables of ``added`` are read several times: store them first. Small segments
        are merged as a counter carries: a segment that isn't twice as large as the next
        goes into it, once there are ``merge_at``. Each row is so written again some
        log2(rows) times at most.
        """
        version = self.version + 1
        segments = {t: list(self.last.get("segments", {}).get(t, [])) for t in self.tables}
        for table, rows in added.items():
            if new := self._segment(table, rows.withColumn("_version", F.lit(version).cast("long"))):
                segments[table].append(new)
                segments[table] = self._merged(table, segments[table])
        self._write({**self.last, **(note or {}), "version": version, "schema": self.schema, "segments": segments})
        return version

    def _merged(self, table: str, segments: list[dict]) -> list[dict]:
        if len(segments) < self.merge_at:
            return segments
        first, rows = len(segments) - 1, segments[-1]["rows"]
        while first and segments[first - 1]["rows"] < 2 * rows:
            first -= 1
            rows += segments[first]["rows"]
        if first == len(segments) - 1:
            return segments
        whole = self._segment(table, self._rows(table, segments[first:]).drop("_bucket"))
        return [*segments[:first], *([whole] if whole else [])]

    def compact(self, live: Mapping[str, DataFrame]) -> int:
        """Replaces all segments of some tables by one with the rows of ``live`` (with ``_version``), as the next version."""
        segments = {t: list(self.last.get("segments", {}).get(t, [])) for t in self.tables}
        for table, rows in live.items():
            new = self._segment(table, rows)
            segments[table] = [new] if new else []
        self._write({**self.last, "version": self.version + 1, "schema": self.schema, "segments": segments})
        return self.version

    def vacuum(self, keep: int = 1) -> int:
        """Deletes segments and manifests that the last ``keep`` versions don't name; readers of older versions must be gone. How many segments went."""
        versions = self.versions()
        kept = versions[-max(1, keep) :]
        named = {(t, s["name"]) for v in kept for t, found in self.manifest(v)["segments"].items() for s in found}
        gone = 0
        for table in self.tables:
            fs, where = self._fs(f"{self.path}/{table}/segment=*")
            for status in fs.globStatus(where) or ():
                if (table, status.getPath().getName()) not in named:
                    gone += bool(fs.delete(status.getPath(), True))
        for v in versions:
            if v not in kept:
                fs, where = self._fs(f"{self.path}/versions/{v:010d}.json")
                fs.delete(where, False)
        return gone


def newest(rows: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Of rows with equal keys those of the last version."""
    keys = list(keys)
    names = [f"_key{i}" for i in range(len(keys))]
    last = rows.groupBy(*keys).agg(F.max("_version").alias("_last")).toDF(*names, "_last")
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return rows.join(last, [*same, F.col("_version") == F.col("_last")], "left_semi")
