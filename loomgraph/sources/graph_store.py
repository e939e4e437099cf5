"""The graph and its knowledge layers in a folder: versions, a schema that grows, and the tables that the workspace asks for."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import knowledge as K
from loomgraph.sources.store import Store, Table
from loomgraph.sources.tables import checkpointed, exists, forget

#: Schema 1 had neither hashes of files, words of names, centrality nor vectors.
SCHEMA = 2
TABLES = {
    "files": Table("id long, path string, lang string, size_bytes long, line_count long, content_hash string", "path", defaults={"content_hash": "''"}),
    "symbols": Table("id long, file_id long, name string, qualified_name string, kind string, start_line long, end_line long, signature string, doc string, name_tokens string, centrality double", "id", defaults={"centrality": "0.0"}),
    "edges": Table("source_id long, target_id long, kind string, confidence string", "source_id", defaults={"confidence": "'name_match'"}),
    "domains": Table("id long, name string, keywords array<string>"),
    "domain_symbols": Table("domain string, symbol_id long, symbol_name string"),
    "constraints": Table("id long, code string, statement string, severity string, domain string"),
    "decisions": Table("id long, domain string, functions array<string>, reason string, revert_risk string, status string, superseded_by long, created_at timestamp_ntz", defaults={"status": "'active'", "revert_risk": "'LOW'"}),
    "scratchpad": Table("agent_role string, current_goal string, completed_steps array<string>, current_errors array<string>, blockers array<string>, updated_at timestamp_ntz"),
    "vectors": Table("symbol_id long, vector array<float>", "symbol_id"),
}


class GraphStore:
    """The tables of a graph as of the last version; a workspace works on it as on any graph.

    Opening takes over stores of older schemas, once, and folders of plain Parquet tables
    (``{table}.parquet``) that no version is known of. ``save`` replaces whole tables by
    their next states, all at once.
    """

    def __init__(self, spark: SparkSession, path: str, create: bool = True, **options):
        self.spark, self.path = spark, path.rstrip("/")
        plain = [t for t in TABLES if exists(spark, f"{self.path}/{t}.parquet")]
        self.store = Store(spark, path, TABLES, SCHEMA, **options)
        if not self.store.version:
            if plain:
                self.save(**{t: spark.read.parquet(f"{self.path}/{t}.parquet") for t in plain})
            elif not create:
                raise FileNotFoundError(f"no store at {path}")

    def table(self, name: str) -> DataFrame:
        return self.store.read(name).drop("_version")

    def save(self, **tables: DataFrame) -> GraphStore:
        """The next version, with these tables in place of what they were; columns they lack get the defaults of the schema."""
        version, laid = self.store.version + 1, {}
        for name, rows in tables.items():
            spec = TABLES[name]
            schema = self.store._schema(name)
            given = {c.lower() for c in rows.columns}
            columns = [F.col(f.name).cast(f.dataType) if f.name.lower() in given else F.expr(spec.defaults.get(f.name, "null")).cast(f.dataType) for f in schema.fields[:-1]]
            laid[name] = checkpointed(rows.select(*[c.alias(f.name) for c, f in zip(columns, schema.fields, strict=False)], F.lit(version).cast("long").alias("_version")))
        self.store.compact(laid)
        forget(*laid.values())
        for name in ("files", "symbols", "edges", "domains", "domain_symbols", "constraints", "decisions", "vectors", "file_refs", "calls"):
            self.__dict__.pop(name, None)
        return self

    def drop_files(self, gone: DataFrame) -> GraphStore:
        """Files (id) leave with their symbols and those symbols' edges and vectors."""
        left = K.without_files(gone, self.files, self.symbols, self.edges)
        vectors = self.vectors.join(left["symbols"].select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi")
        return self.save(**left, vectors=vectors)

    files = cached_property(lambda self: self.table("files"))
    edges = cached_property(lambda self: self.table("edges"))
    domains = cached_property(lambda self: self.table("domains"))
    domain_symbols = cached_property(lambda self: self.table("domain_symbols"))
    constraints = cached_property(lambda self: self.table("constraints"))
    decisions = cached_property(lambda self: self.table("decisions"))
    vectors = cached_property(lambda self: self.table("vectors"))

    @cached_property
    def symbols(self) -> DataFrame:
        rows = self.table("symbols")
        return rows.withColumns({"qualified_name": F.coalesce("qualified_name", "name"), "name_tokens": F.coalesce("name_tokens", S.name_tokens(F.col("name")))})

    @cached_property
    def file_refs(self) -> DataFrame:
        return self.files.select("id", "path", "lang")

    @cached_property
    def calls(self) -> DataFrame:
        return self.edges.where("kind = 'CALLS'")
