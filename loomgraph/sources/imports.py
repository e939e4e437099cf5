"""Knowledge from elsewhere: Markdown trees, other stores, the project registry, folders of decision records."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import knowledge as K
from loomgraph.sources.tables import exists, small_text

#: Folders of a tree whose index file holds rules, and names of bullets that are none.
RULE_FOLDERS: Sequence[str] = ("conventions", "architecture", "standards", "rules")
NO_RULES: Sequence[str] = ("reference", "see also", "note", "example", "related", "source")
#: Folders where decision records are looked for when none are named.
RECORD_FOLDERS: Sequence[str] = ("logs/decisions", "docs/decisions", "docs/adr", "docs/rules", "decisions", "adr")

REGISTRY = "id string, name string, path string, symbol_count long, last_indexed string"


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(folder, at, line) of index files, one a folder; their names may begin with what Spark's readers pass over."""
    files = spark.createDataFrame([(p.rstrip("/").split("/")[-2], small_text(spark, p)) for p in paths], "folder string, value string")
    return files.select("folder", F.posexplode(F.split("value", "\r?\n")).alias("at", "raw")).select("folder", "at", F.trim("raw").alias("line"))


def tree_domains(spark: SparkSession, root: str, index: str = "_index.md") -> DataFrame:
    """(name, keywords) of the folders that the front matter of a tree's index file covers; none without such a file.

    ``covers: [some_thing/_index.md, ...]`` gives the domain ``Some Thing`` with the keywords some and thing.
    """
    where = f"{root.rstrip('/')}/{index}"
    if not exists(spark, where):
        return spark.createDataFrame([], "name string, keywords array<string>")
    rows = _lines(spark, [where])
    fences = rows.where("line = '---'").agg(F.sort_array(F.collect_list("at")).alias("f"))  # an index file has a few
    head = rows.crossJoin(F.broadcast(fences)).where((F.size("f") > 0) & (F.col("at") > F.col("f")[0]) & (F.col("at") < F.coalesce(F.try_element_at("f", F.lit(2)), F.lit(1 << 30))))
    inner = F.regexp_replace(F.trim(F.regexp_replace("line", "^covers:", "")), r"^\[+|\]+$", "")
    parts = head.where(F.col("line").startswith("covers:")).select(F.explode(F.split(inner, ",")).alias("part"))
    folder = F.trim(F.split(F.regexp_replace(F.trim("part"), "^[\"']+|[\"']+$", ""), "/")[0])
    found = parts.select(folder.alias("folder")).where("folder <> '' and not startswith(folder, '_')").distinct()
    words = F.filter(F.split(F.translate("folder", "_", " "), r"\s+"), lambda w: w != "")
    name = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")
    return found.select(name.alias("name"), F.transform(F.split("folder", "_"), F.lower).alias("keywords"))


def tree_rules(spark: SparkSession, root: str, index: str = "_index.md", folders: Sequence[str] = RULE_FOLDERS) -> DataFrame:
    """(code, severity, statement) of the bullets ``* **Name:** statement`` in the folders' index files; bullets that only lead on are none."""
    paths = [p for f in folders if exists(spark, p := f"{root.rstrip('/')}/{f}/{index}")]
    if not paths:
        return spark.createDataFrame([], "code string, severity string, statement string")
    form = r"^[*-] \*\*(.*?)\*\*(.*)$"
    rows = _lines(spark, paths).where(F.col("line").rlike(form))
    rows = rows.select("folder", F.trim(F.regexp_replace(F.regexp_extract("line", form, 1), ":+$", "")).alias("name"), F.trim(F.regexp_replace(F.regexp_extract("line", form, 2), "^:+", "")).alias("statement"))
    noise = [F.lower("name").startswith(w) for w in NO_RULES]
    rows = rows.where("name <> '' and statement <> ''").where(~F.greatest(*noise))
    return rows.select(S.code_norm(F.col("folder"), F.col("name")).alias("code"), F.lit("WARNING").alias("severity"), "statement")


def from_store(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Another store's ``domains``, ``constraints`` and ``decisions``, as far as it has them, without unusable rows and with defaults where it says nothing."""

    def filled(rows: DataFrame, columns: dict[str, str], needed: Sequence[str]) -> DataFrame:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in columns if c not in rows.columns})
        rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in columns.items() if v})
        for c in needed:
            rows = rows.where(F.col(c).isNotNull() & (F.col(c) != ""))
        return rows

    out = {}
    if "domains" in tables:
        out["domains"] = filled(tables["domains"], {}, ["name"]).select("name", "keywords")
    if "constraints" in tables:
        out["constraints"] = filled(tables["constraints"], {"severity": "WARNING"}, ["code", "statement"]).select("code", "severity", "statement")
    if "decisions" in tables:
        out["decisions"] = filled(tables["decisions"], {"revert_risk": "LOW", "status": "active"}, ["reason"]).select("domain", "functions", "reason", "revert_risk", "status", "created_at")
    return out


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registered projects of a JSON file; none if it is missing or broken."""
    if not exists(spark, path):
        if not exists(spark, f"{path}.before"):
            return spark.createDataFrame([], REGISTRY)
        path = f"{path}.before"  # a save was cut short
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':') for c in REGISTRY.split(', '))}>>")).alias("r"))
    return rows.select("r.*").where("path is not null")


def save_registry(projects: DataFrame, path: str) -> None:
    """The registry as one JSON array, a row a project; written beside and switched, so ``projects`` may come from the same path."""
    rows = projects.select([F.col(c.split(" ")[0]) for c in REGISTRY.split(", ")])
    beside = f"{path}.{uuid.uuid4().hex}"
    rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rows.columns)))).alias("value")).coalesce(1).write.text(beside)
    spark = projects.sparkSession
    new, now, before = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path, f"{path}.before"))
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(now):
        fs.delete(before, True)
        fs.rename(now, before)
    fs.rename(new, now)
    fs.delete(before, True)


def registered(projects: DataFrame, given: DataFrame) -> DataFrame:
    """The next registry: projects of ``given`` (name, path, symbol_count, last_indexed) by their path, with ids that follow from it."""
    new = given.withColumn("id", S.stable_id(F.col("path"))).select(*projects.columns)
    return K.upserted(projects, new, "path").select(*projects.columns)


def record_folders(spark: SparkSession, root: str, given: str | None = None, configured: Sequence[str] = (), usual: Sequence[str] = RECORD_FOLDERS) -> list[str]:
    """Folders of decision records that exist: the one asked for, else those configured, else the usual ones."""
    return [p for f in ([given] if given else configured or usual) if exists(spark, p := f"{root.rstrip('/')}/{f}")]


def export(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes a table as ``json``, ``csv`` or ``parquet``; lists and structs are JSON text in csv."""
    if form not in ("json", "csv", "parquet"):
        raise ValueError(f"no format {form!r}")
    if form == "csv":
        rows = rows.select([F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in rows.dtypes])
        rows.write.option("header", True).csv(path)
    else:
        rows.write.format(form).save(path)
