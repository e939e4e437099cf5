"""Text indexes that are kept up by segments, and those whose postings lie in blocks that a search can pass over."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators import retrieval as R
from loomgraph.sources.store import Store, Table, newest
from loomgraph.sources.tables import checkpointed, forget

TABLES = {
    "rows": Table("key long, len long, gone boolean", "key"),
    "postings": Table("key long, term string, wtf double, len long", order=("term", "key")),
    "dead": Table("key long", "key"),
}


class SegmentIndex:
    """Postings in immutable segments: what changes is one more segment, and a row that is replaced or gone is only marked.

    A search gives what an index made anew gives. Once more than ``dead_share`` of the
    rows ever written are dead, all segments are put together without them.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", fields: Mapping[str, float] = R.WEIGHTS, dead_share: float = 0.5, **options):
        self.spark, self.key, self.fields, self.dead_share = spark, key, dict(fields), dead_share
        self.store = Store(spark, path, TABLES, 1, **options)

    def update(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> dict:
        """Lays rows (key and fields; ids unique) over what is there and takes out those of ``gone`` (key); returns the version's manifest."""
        none = self.spark.createDataFrame([], "key long")
        new = checkpointed(rows.withColumnRenamed(self.key, "key")) if rows is not None else None
        size = R.lengths(new, self.fields, "key").select("key", F.col("len").cast("long").alias("len")) if new is not None else none.withColumn("len", F.lit(0).cast("long"))
        out = gone.select(F.col(self.key).cast("long").alias("key")).distinct().join(size.select("key"), "key", "left_anti") if gone is not None else none
        touched = checkpointed(size.withColumn("gone", F.lit(False)).unionByName(out.select("key", F.lit(0).cast("long").alias("len"), F.lit(True).alias("gone"))))
        held = self.store.read("rows", touched.select("key")).join(touched.select("key"), "key", "left_semi")
        old = checkpointed(newest(held, ["key"]).where("not gone").select("key", "len"))
        post = R.postings(new, self.fields, "key").join(size, "key") if new is not None else self.store.read("postings").limit(0)
        post = checkpointed(post.select("key", "term", "wtf", "len"))
        a, b = (t.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("t")).first() for t in (touched.where("not gone"), old))
        now = self.store.last
        note = {"n": now.get("n", 0) + a["n"] - b["n"], "total": now.get("total", 0) + a["t"] - b["t"], "ever": now.get("ever", 0) + a["n"], "wrote": {"rows": a["n"], "postings": post.count()}}
        known = touched.join(old.select(F.col("key"), F.lit(True).alias("_live")), "key", "left").where("_live or not gone").drop("_live")
        known = checkpointed(known)
        self.store.commit({"rows": known, "postings": post, "dead": old.select("key")}, note)
        forget(*([new] if new is not None else []), touched, old, post, known)  # all that counts is in the store
        if note["ever"] - note["n"] > self.dead_share * max(1, note["ever"]):
            self.compact()
        return self.store.last

    def _live(self, post: DataFrame) -> DataFrame:
        dead = self.store.read("dead").groupBy("key").agg(F.max("_version").alias("_since"))
        return post.join(dead, "key", "left").where("_since is null or _version >= _since").drop("_since")

    def compact(self) -> int:
        rows = newest(self.store.read("rows"), ["key"]).where("not gone")
        live = {"rows": checkpointed(rows), "postings": checkpointed(self._live(self.store.read("postings"))), "dead": self.store.read("dead").limit(0)}
        self.store.last = {**self.store.last, "ever": self.store.last["n"]}
        version = self.store.compact(live)
        forget(*live.values())
        return version

    @property
    def corpus(self) -> DataFrame:
        n, total = self.store.last.get("n", 0), self.store.last.get("total", 0)
        return self.spark.createDataFrame([(n, total / n if n else None)], "n_rows long, avg_len double")

    def search(self, queries: DataFrame) -> DataFrame:
        """As ``retrieval.bm25`` over all that is there; only the row groups of the queries' terms are read."""
        asked = queries.select("term", "prefix").distinct().limit(R.QUERY_WORDS + 1).collect()
        post = self.store.read("postings")
        if len(asked) <= R.QUERY_WORDS:
            exact = [r["term"] for r in asked if not r["prefix"]]
            wanted = F.col("term").isin(exact) if exact else F.lit(False)
            for stem in (r["term"] for r in asked if r["prefix"]):
                wanted = wanted | F.col("term").startswith(stem)
            post = post.where(wanted)
        return R._scored(self._live(post).drop("_version"), self.corpus, queries, "key").withColumnRenamed("key", self.key)


# ---------------------------------------------------------------- blocks with what their rows can add at most

BLOCK = 1024
FIRST_BLOCKS = 4  # whose rows set the mark that other blocks have to reach
_SLACK = 1 + 1e-9  # bounds are sums of floats


class BlockIndex:
    """Postings in blocks of rows of like length; each block of a term knows how many rows have it and the most it adds to a score."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def write(self, rows: DataFrame, fields: Mapping[str, float] = R.WEIGHTS, block: int = BLOCK) -> BlockIndex:
        """Makes the index, in a new folder."""
        size = checkpointed(R.lengths(rows, fields, self.key).withColumn("kind", F.floor(F.log2(F.col("len") + 1) * 4).cast("int")))
        corpus = checkpointed(size.agg(F.count("*").alias("n_rows"), F.avg("len").alias("avg_len")).coalesce(1))
        kinds = size.groupBy("kind").agg(F.ceil(F.count("*") / block).alias("parts"))  # lengths on a scale: some hundred kinds at most
        placed = size.join(F.broadcast(kinds), "kind").select(self.key, "len", (F.col("kind").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64(self.key), F.col("parts"))).alias("block"))
        adds = F.col("wtf") * (R.K1 + 1) / (F.col("wtf") + R.K1 * (1 - R.B + R.B * F.col("len") / F.col("avg_len")))
        post = R.postings(rows, fields, self.key).join(placed, self.key).crossJoin(F.broadcast(corpus.select("avg_len"))).withColumn("adds", adds)  # one row
        held = F.array_sort(F.collect_list(F.struct(F.col(self.key).alias("key"), "wtf", "len")))
        blocks = post.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("adds").alias("most"), held.alias("held"))
        blocks.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.option("parquet.block.size", str(8 << 20)).parquet(f"{self.path}/blocks")
        corpus.write.parquet(f"{self.path}/corpus")
        return self

    def _met(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query, slot, required, block, n, most) of blocks that may meet a slot, without their rows; and the slots' row counts."""
        rows = queries.select("term", "prefix").distinct().limit(R.QUERY_WORDS + 1).collect()
        if len(rows) > R.QUERY_WORDS:
            raise ValueError(f"no more than {R.QUERY_WORDS} words at a time")
        exact = [r["term"] for r in rows if not r["prefix"]]
        wanted = F.col("term").isin(exact) if exact else F.lit(False)
        for stem in (r["term"] for r in rows if r["prefix"]):
            wanted = wanted | F.col("term").startswith(stem)
        self._wanted = self.spark.read.parquet(f"{self.path}/blocks").where(wanted)
        asked = F.broadcast(queries.withColumnRenamed("term", "word"))  # counted above
        on = F.when(F.col("prefix"), F.col("term").startswith(F.col("word"))).otherwise(F.col("term") == F.col("word"))
        met = self._wanted.join(asked, on)
        # several terms with one beginning may be of one row: only its key tells
        terms = met.select("query", "slot", "term").distinct().groupBy("query", "slot").agg(F.count("*").alias("terms"))
        one = met.join(F.broadcast(terms.where("terms = 1")), ["query", "slot"]).groupBy("query", "slot").agg(F.sum("n").alias("df"))
        many = met.join(F.broadcast(terms.where("terms > 1")), ["query", "slot"]).select("query", "slot", F.explode("held.key").alias("key")).distinct().groupBy("query", "slot").agg(F.count("*").alias("df"))
        return met, checkpointed(one.unionByName(many))

    def blocks(self, queries: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """((query, block, bound, read), scores of the rows of those read, slots' counts): which blocks can hold one of a query's ``limit`` best rows."""
        met, df = self._met(queries)
        corpus = self.spark.read.parquet(f"{self.path}/corpus")
        idf = F.greatest(F.log((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        slots = met.groupBy("query", "slot", "required", "block").agg(F.sum("most").alias("most")).join(df, ["query", "slot"]).crossJoin(F.broadcast(corpus)).withColumn("bound", idf * F.col("most") * _SLACK)
        needed = queries.groupBy("query").agg(F.count(F.when(F.col("required"), 1)).alias("needed"))
        bounds = slots.groupBy("query", "block").agg(F.sum("bound").alias("bound"), F.count(F.when(F.col("required"), 1)).alias("have"), F.count(F.when(~F.col("required"), 1)).alias("extra")).join(F.broadcast(needed), "query")
        bounds = checkpointed(bounds.where(((F.col("have") == F.col("needed")) & (F.col("needed") > 0)) | (F.col("extra") > 0)).select("query", "block", "bound"))
        order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))
        first = checkpointed(bounds.withColumn("place", order).where(F.col("place") <= FIRST_BLOCKS).select("query", "block"))
        found = self._scores(met, first, df, corpus, queries)
        mark = R.top_by(found, "bm25", "key", limit).where(F.col("rank") == limit).select("query", F.col("bm25").alias("mark"))
        judged = bounds.join(mark, "query", "left").join(first.withColumn("first", F.lit(True)), ["query", "block"], "left")
        judged = checkpointed(judged.select("query", "block", "bound", F.coalesce(F.col("first"), F.col("mark").isNull() | (F.col("bound") >= F.col("mark"))).alias("read")))
        return judged, self._scores(met, judged.where("read").select("query", "block"), df, corpus, queries), df

    def _scores(self, met: DataFrame, of: DataFrame, df: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
        rows = met.join(of, ["query", "block"]).select("query", "slot", "required", F.inline("held"))
        slots = rows.groupBy("query", "slot", "required", "key").agg(F.sum("wtf").alias("wtf"), F.first("len").alias("len"))
        return R.scored_slots(slots, df, corpus, queries, "key")

    def top(self, queries: DataFrame, limit: int = 30) -> DataFrame:
        """(query, key, bm25, rank) of each query's ``limit`` best rows, ties to the smaller key: those of ``retrieval.bm25``, from the blocks that can hold them."""
        _, scores, _ = self.blocks(queries, limit)
        # sums of floats in another order may differ in their last digits; ranks go by what is left without them
        return R.top_by(scores.withColumn("bm25", F.round("bm25", 9)), "bm25", "key", limit).withColumnRenamed("key", self.key)
