"""The graph model's tables, derived from the star schema, for Spark and, as the same text, for SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.sources.tables import checkpointed


class Graph:
    """Tables of the property graph and its knowledge layers; each is a plan, read when it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def files(self) -> DataFrame:
        """One row a document: id, path, lang, size_bytes, line_count, content_hash."""
        return self.raw("documents").select(
            F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "lang", F.col("n_chars").alias("size_bytes"),
            S.line_count(F.col("text")).alias("line_count"), F.md5(F.col("text").cast("binary")).alias("content_hash"),
        )

    @cached_property
    def file_refs(self) -> DataFrame:
        """id, path and lang alone: nothing here reads a text."""
        return self.raw("documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "lang")

    @cached_property
    def symbols(self) -> DataFrame:
        n_files = self.raw("documents").agg(F.count("*").alias("n_files"))
        name = F.translate("p_name", " ", "_")
        return self.raw("part").crossJoin(F.broadcast(n_files)).select(  # a table of one row
            F.col("p_partkey").alias("id"), (F.col("p_partkey") % F.col("n_files")).alias("file_id"), name.alias("name"), F.concat_ws("_", name, F.col("p_partkey").cast("string")).alias("qualified_name"),
            F.col("p_type").alias("kind"), F.col("p_size").cast("long").alias("start_line"), (F.col("p_size") + F.col("p_partkey") % 40).alias("end_line"),
            F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("signature"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Made by "), F.col("p_brand"))).alias("doc"),
            S.name_tokens(name).alias("name_tokens"), F.lit(0.0).alias("centrality"), F.col("p_brand").alias("brand"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        """Distinct (source_id, target_id, kind) between parts of neighbouring lines of an order."""
        lines = self.raw("lineitem")
        a = lines.where((F.col("l_quantity") <= 10) & F.col("l_returnflag").isin("R", "A")).select(
            F.col("l_orderkey").alias("k"), (F.col("l_linenumber") + 1).alias("n"), F.col("l_partkey").alias("source_id"), F.when(F.col("l_returnflag") == "R", "CALLS").otherwise("DI_INJECT").alias("kind")
        )
        b = lines.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("target_id"))
        return a.join(b, ["k", "n"]).select("source_id", "target_id", "kind").distinct()

    @cached_property
    def stored_edges(self) -> DataFrame:
        """The edges as a table of the shared folder, for walks that read them again and again."""
        return checkpointed(self.edges)

    @cached_property
    def calls(self) -> DataFrame:
        return self.edges.where("kind = 'CALLS'")

    @cached_property
    def domains(self) -> DataFrame:
        by_brand = self.raw("part").groupBy(F.col("p_brand").alias("name")).agg(F.array_sort(F.collect_set("p_type")).alias("keywords"))
        return by_brand.select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("id"), "name", "keywords")

    @cached_property
    def domain_symbols(self) -> DataFrame:
        return self.raw("part").select(F.col("p_brand").alias("domain"), F.col("p_partkey").alias("symbol_id"), F.translate("p_name", " ", "_").alias("symbol_name"))

    @cached_property
    def constraints(self) -> DataFrame:
        severity = F.when(F.col("n_regionkey") == 0, "ERROR").when(F.col("n_regionkey") == 1, "WARNING").otherwise("INFO")
        return self.raw("nation").join(F.broadcast(self.raw("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("NATION_"), F.translate("n_name", " ", "_")).alias("code"), F.concat(F.lit("Ships within "), F.col("r_name")).alias("statement"),
            severity.alias("severity"), F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 1).cast("string")).alias("domain"),
        )

    @cached_property
    def decisions(self) -> DataFrame:
        """One row an order that has lines: its functions are the names of its parts."""
        parts = self.raw("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey")).distinct()
        names = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("_", F.translate("p_name", " ", "_"), F.col("p_partkey").cast("string")).alias("q"))
        functions = parts.join(names, "l_partkey").groupBy("id").agg(F.array_sort(F.collect_set("q")).alias("functions"))
        orders = self.raw("orders").select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("domain"), F.concat(F.lit("Priority "), F.col("o_orderpriority")).alias("reason"),
            F.when(F.col("o_orderstatus") == "F", "LOW").when(F.col("o_orderstatus") == "O", "MEDIUM").otherwise("HIGH").alias("revert_risk"), F.col("o_orderdate").alias("created_at"),
        )
        return orders.join(functions, "id")

    @cached_property
    def tool_calls(self) -> DataFrame:
        return self.raw("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("project"), F.col("event_type").alias("tool"), "ts", "value", "props")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("symbol_id"), F.col("embedding").alias("vector"))


_TOKENS = "nullif(trim(lower(replace(regexp_replace({0}, '([^A-Z])([A-Z])', '\\1 \\2', 'g'), '_', ' '))), lower({0}))"

SQL_VIEWS = f"""
files AS (
  SELECT doc_id AS id, source || '/' || lang || '/' || doc_id AS path, lang, n_chars AS size_bytes, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS line_count, md5(text) AS content_hash FROM documents),
symbols AS (
  SELECT p_partkey AS id, p_partkey % (SELECT count(*) FROM documents) AS file_id, replace(p_name, ' ', '_') AS name, replace(p_name, ' ', '_') || '_' || p_partkey AS qualified_name,
    p_type AS kind, CAST(p_size AS BIGINT) AS start_line, p_size + p_partkey % 40 AS end_line, p_brand || ' ' || p_type || ' ' || p_name AS signature,
    CASE WHEN p_size % 2 = 0 THEN 'Made by ' || p_brand END AS doc, {_TOKENS.format("replace(p_name, ' ', '_')")} AS name_tokens, 0.0::DOUBLE AS centrality, p_brand AS brand FROM part),
edges AS (
  SELECT DISTINCT a.l_partkey AS source_id, b.l_partkey AS target_id, CASE a.l_returnflag WHEN 'R' THEN 'CALLS' ELSE 'DI_INJECT' END AS kind
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity <= 10 AND a.l_returnflag IN ('R', 'A')),
calls AS (SELECT * FROM edges WHERE kind = 'CALLS'),
domains AS (SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS id, p_brand AS name, list_sort(list(DISTINCT p_type)) AS keywords FROM part GROUP BY p_brand),
domain_symbols AS (SELECT p_brand AS domain, p_partkey AS symbol_id, replace(p_name, ' ', '_') AS symbol_name FROM part),
constraints AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, 'NATION_' || replace(n_name, ' ', '_') AS code, 'Ships within ' || r_name AS statement,
    CASE n_regionkey WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity, 'Brand#' || (n_nationkey + 1) AS domain FROM nation JOIN region ON n_regionkey = r_regionkey),
decisions AS (
  SELECT o_orderkey AS id, 'Brand#' || (o_custkey % 25 + 1) AS domain, 'Priority ' || o_orderpriority AS reason,
    CASE o_orderstatus WHEN 'F' THEN 'LOW' WHEN 'O' THEN 'MEDIUM' ELSE 'HIGH' END AS revert_risk, o_orderdate AS created_at, functions
  FROM orders JOIN (SELECT l_orderkey, list_sort(list(DISTINCT replace(p_name, ' ', '_') || '_' || p_partkey)) AS functions FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey) f ON f.l_orderkey = o_orderkey),
tool_calls AS (SELECT event_id AS id, user_id AS project, event_type AS tool, ts, value, props FROM events),
vectors AS (SELECT vec_id AS symbol_id, embedding AS vector FROM embeddings)
"""
