"""Source trees, rule texts and hint files as DataFrames."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.sources import tree
from loomgraph.sources.tables import exists

#: Folders whose files are never indexed.
DENIED: Sequence[str] = ("node_modules", "target", "dist", "build", ".git", ".venv", "venv", "__pycache__", ".cache", ".next", ".nuxt", "vendor", "tmp", "temp", ".tmp", "coverage", ".nyc_output")
#: Language by file extension.
LANGUAGES: dict[str, str] = {
    "rs": "rust", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "jsx": "tsx", "js": "tsx", "mjs": "tsx", "cjs": "tsx", "py": "python", "pyi": "python", "go": "go", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "java": "java", "cs": "csharp", "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "php": "php", "php7": "php", "php8": "php",
    "kt": "kotlin", "kts": "kotlin", "swift": "swift", "dart": "dart", "lua": "lua",
}


def glob_pattern(glob: str) -> str:
    """Regular expression of a path glob: ``**`` is any path, ``*`` and ``?`` stay within a segment."""
    out = re.sub(r"\\\*\\\*/?|\\\*|\\\?", lambda m: {"\\*": "[^/]*", "\\?": "[^/]"}.get(m[0], ".*"), re.escape(glob))
    return f"^{out}$"


#: Ignore files of a folder; later ones count more.
IGNORE_FILES: Sequence[str] = (".gitignore", ".ignore")


def scan_files(spark: SparkSession, root: str, denied: Sequence[str] = DENIED, ignore_files: Sequence[str] = IGNORE_FILES, ignore_text: str = "", languages: Sequence[str] | None = None, below: str = "", partition_bytes: int = tree.PARTITION_BYTES) -> DataFrame:
    """path (relative), lang, size_bytes, line_count, content_hash and text of every source file below ``root``.

    Hidden and denied folders, and what ignore files name, are never entered or opened;
    an ignore file counts in its own folder and below, deeper ones count more, and what
    lies in an ignored folder can't be taken back. ``ignore_text`` has rules of a user's
    own, which count least; ``languages`` and ``below`` (a folder or file) keep the scan to
    a part of the tree, with the ignore files of all of it. Files of unknown extension and links are left out.
    """
    spark.dataSource.register(tree.SourceTree)
    known = {k: v for k, v in LANGUAGES.items() if languages is None or v in languages}
    options = {"languages": json.dumps(known), "below": below, "denied": json.dumps(list(denied)), "ignore_files": json.dumps(list(ignore_files)), "ignore_text": ignore_text, "partition_bytes": str(partition_bytes)}
    rows, text = spark.read.format("source_tree").options(**options).load(root), F.col("content").cast("string")
    return rows.select("path", "lang", "size_bytes", S.line_count(text).alias("line_count"), F.md5("content").alias("content_hash"), text.alias("text"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of text files, a line each: ``CODE:SEVERITY:statement``, ``HINT_X: statement``, or a statement alone.

    A line that is neither of the first two keeps its whole text and gets its
    file's name and its number as code. Blank lines and those that begin with ``#`` are left out.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("value"), F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"))
    rows = files.select("stem", F.posexplode(F.split("value", "\r?\n")).alias("at", "raw")).withColumn("line", F.trim("raw")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    full, hint = r"^([^:]*):\s*([^:]*?)\s*:(.*)$", r"^([^:]*):([^:]*)$"
    severity = F.upper(F.regexp_extract("line", full, 2))
    is_full = severity.isin("ERROR", "WARNING", "WARN", "INFO")
    is_hint = F.upper(F.trim(F.regexp_extract("line", hint, 1))).startswith("HINT_")
    return rows.select(
        F.when(is_full, F.upper(F.trim(F.regexp_extract("line", full, 1)))).when(is_hint, F.upper(F.trim(F.regexp_extract("line", hint, 1)))).otherwise(S.auto_code(F.col("stem"), F.col("at") + 1)).alias("code"),
        F.when(is_full, F.when(severity == "WARN", "WARNING").otherwise(severity)).otherwise("INFO").alias("severity"),
        F.when(is_full, F.trim(F.regexp_extract("line", full, 3))).when(is_hint, F.trim(F.regexp_extract("line", hint, 2))).otherwise(F.col("line")).alias("statement"),
        F.col("stem").alias("source_file"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Decision records: Markdown files with ``code``, ``severity`` and ``statement`` at their head."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select("value", F.input_file_name().alias("source_file"))
    field = {k: F.trim(F.regexp_extract("value", rf"(?m)^{k}:[ \t]*\"?(.*?)\"?[ \t]*$", 1)) for k in ("code", "severity", "statement")}
    rows = files.select(*[v.alias(k) for k, v in field.items()], "source_file")
    return rows.where("code <> '' and statement <> ''").withColumn("severity", F.when(F.col("severity") == "", "INFO").otherwise(F.upper("severity")))


_HINTS = "macro_expansions array<struct<pattern:string,resolves_to:string>>, di_annotations array<string>, extra_calls array<struct<`from`:string,`to`:string>>"
HINTS = "lang string, hint string, pattern string, resolves_to string"


def tree_hints(spark: SparkSession, root: str, folder: str = ".context/hints") -> DataFrame:
    """(lang, hint, pattern, resolves_to) of the hint files ``{lang}.json`` in a folder of ``root``; none where there are no such files.

    ``hint`` is ``macro`` (pattern stands for what it resolves to), ``annotation`` (pattern
    injects what it stands at) or ``call`` (symbols named pattern call what it resolves to).
    """
    where = f"{root.rstrip('/')}/{folder}/*.json"
    return read_hints(spark, where) if exists(spark, where) else spark.createDataFrame([], HINTS)


def read_hints(spark: SparkSession, path: str) -> DataFrame:
    """Hints of JSON files, named by language; broken files and entries that lack a part give none."""
    files = spark.read.schema(_HINTS).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)

    def pairs(column: str, hint: str, a: str, b: str):
        return F.transform(F.coalesce(column, F.array().cast(files.schema[column].dataType)), lambda x: F.struct(F.lit(hint).alias("hint"), x[a].alias("pattern"), x[b].alias("resolves_to")))

    marks = F.transform(F.coalesce("di_annotations", F.array().cast("array<string>")), lambda x: F.struct(F.lit("annotation").alias("hint"), F.regexp_replace(F.trim(x), "^@", "").alias("pattern"), F.lit(None).cast("string").alias("resolves_to")))
    every = F.concat(pairs("macro_expansions", "macro", "pattern", "resolves_to"), pairs("extra_calls", "call", "from", "to"), marks)
    rows = files.select(F.regexp_extract(F.input_file_name(), r"([^/]*)\.json$", 1).alias("lang"), F.inline(every))
    return rows.where("lang not like '\\_%' and pattern <> '' and (hint = 'annotation' or resolves_to <> '')")
