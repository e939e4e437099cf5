"""The index job: source files to symbols, call sites and edges, anew or from what has changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loomgraph.jobs.graph_queries import NOISE
from loomgraph.operators import graph as G
from loomgraph.operators import knowledge as K
from loomgraph.sources import extract
from loomgraph.sources.store import Store, StoreError, Table, newest
from loomgraph.sources.tables import checkpointed, forget


@dataclass
class Index:
    files: DataFrame  # path, lang, content_hash
    symbols: DataFrame  # id, path, name, kind, start_line, end_line, signature, doc, qualified_name
    call_sites: DataFrame  # path, line, callee, edge_kind
    edges: DataFrame  # source_id, target_id, kind, confidence
    errors: DataFrame  # path, lang, error, line, message


def symbol_id(*columns: str) -> Column:
    """Ids follow from where a symbol is, so that they are the same whenever a file is read."""
    return F.xxhash64(*columns)


def attributed(symbols: DataFrame, call_sites: DataFrame) -> DataFrame:
    """(path, callee, edge_kind, source_id, own): call sites with the innermost symbol around each, and whether their own file defines what they call."""
    ids = symbols.select(F.col("path").alias("file_id"), "id", "start_line", "end_line")
    wanted = call_sites.where(~F.lower("callee").isin(NOISE) & (F.octet_length("callee") >= 3))
    places = wanted.withColumn("place_id", F.xxhash64("path", "line", "callee", "edge_kind")).dropDuplicates(["place_id"])
    at = G.enclosing(places.select("place_id", F.col("path").alias("file_id"), "line"), ids).select("place_id", F.col("symbol_id").alias("source_id"))
    own = symbols.select("path", F.col("name").alias("callee")).distinct().withColumn("own", F.lit(True))
    rows = at.join(places, "place_id").select("path", "callee", "edge_kind", "source_id").distinct()
    return rows.join(own, ["path", "callee"], "left").withColumn("own", F.coalesce("own", F.lit(False)))


def edges_of(symbols: DataFrame, call_sites: DataFrame) -> DataFrame:
    """Call sites resolved: the innermost symbol around the line calls a symbol of that name, of its own file first."""
    ids = symbols.select(F.col("path").alias("file_id"), "id", "name", "start_line", "end_line")
    calls = attributed(symbols, call_sites).select("source_id", F.col("path").alias("file_id"), F.col("callee").alias("target_name"), F.col("edge_kind").alias("kind"), "own")
    return G.resolve_local(calls.where("own"), ids).unionByName(G.resolve_names(calls.where("not own"), ids, ("file_id", "start_line")))


def hinted_sites(symbols: DataFrame, files: DataFrame, hints: DataFrame) -> DataFrame:
    """(path, callee, edge_kind, source_id, own): what hints (``scan.tree_hints``) add to the call sites of files.

    A macro is as if the first symbol of each file of its language called both its names;
    a call is one from every symbol of that name in the language's files.
    """
    if "hint" not in hints.columns:
        hints = hints.withColumn("hint", F.lit("macro"))
    macros = hints.where("hint = 'macro'").select("lang", F.explode(F.array("resolves_to", "pattern")).alias("callee")).where("callee is not null").distinct()
    of = files.select("path", "lang")
    first = symbols.groupBy("path").agg(F.min(F.struct("start_line", "id"))["id"].alias("source_id"))
    expanded = first.join(of, "path").join(macros, "lang").select("path", "callee", F.lit("MACRO_EXPAND").alias("edge_kind"), "source_id")
    calls = hints.where("hint = 'call'").select("lang", F.col("pattern").alias("name"), F.col("resolves_to").alias("callee")).distinct()
    called = symbols.select("path", "name", F.col("id").alias("source_id")).join(of, "path").join(calls, ["lang", "name"]).select("path", "callee", F.lit("CALLS").alias("edge_kind"), "source_id")
    return expanded.unionByName(called).distinct().withColumn("own", F.lit(False))


def hinted_edges(symbols: DataFrame, files: DataFrame, hints: DataFrame) -> DataFrame:
    """Edges of hints, to the first symbol of each name."""
    calls = hinted_sites(symbols, files, hints).select("source_id", F.col("callee").alias("target_name"), F.col("edge_kind").alias("kind"))
    return G.resolve_names(calls, symbols.select(F.col("path").alias("file_id"), "id", "name", "start_line", "end_line"), ("file_id", "start_line"))


def annotations_of(hints: DataFrame | None) -> dict[str, frozenset[str]]:
    """Annotations that inject, by language: settings of a tree, read by the driver."""
    if hints is None or "hint" not in hints.columns:
        return {}
    rows = hints.where("hint = 'annotation'").select("lang", "pattern").distinct().limit(MOST_ANNOTATIONS + 1).collect()
    if len(rows) > MOST_ANNOTATIONS:
        raise ValueError(f"more than {MOST_ANNOTATIONS} annotations are hinted at")
    return {lang: frozenset(r["pattern"] for r in rows if r["lang"] == lang) for lang in {r["lang"] for r in rows}}


MOST_ANNOTATIONS = 10_000


def build(files: DataFrame, before: Index | None = None, hints: DataFrame | None = None) -> Index:
    """Index of ``files`` (path, lang, content_hash, text), with edges of ``hints`` (``scan.tree_hints``).

    With ``before`` only new and changed files are read; files that are gone take
    their symbols along, and all call sites are resolved again, so that the result is
    that of a full run.
    """
    state = files.select("path", "lang", "content_hash")
    if before is None:
        todo = files
    else:
        todo = files.join(K.changed_files(before.files, state).select("path"), "path", "left_semi")
    read = checkpointed(extract.parsed(todo, annotations_of(hints)))  # a source is parsed once
    symbols = extract.symbols_in(read).withColumn("id", symbol_id("path", "start_line", "name", "kind"))
    sites, errors = extract.calls_in(read), extract.errors_in(read)
    if before is not None:
        same = before.files.join(state, ["path", "content_hash"], "left_semi").select("path")
        symbols = symbols.unionByName(before.symbols.join(same, "path", "left_semi").select(*symbols.columns))
        sites = sites.unionByName(before.call_sites.join(same, "path", "left_semi").select(*sites.columns))
        errors = errors.unionByName(before.errors.join(same, "path", "left_semi").select(*errors.columns))
    symbols, sites = checkpointed(symbols), checkpointed(sites)
    edges = edges_of(symbols, sites)
    if hints is not None:
        edges = edges.unionByName(hinted_edges(symbols, state, hints)).distinct()
    return Index(checkpointed(state), symbols, sites, checkpointed(edges), checkpointed(errors))


#: The stored index. A row counts if no later version of its path, or of the name it was resolved by, is known.
TABLES = {
    "files": Table("path string, lang string, content_hash string, names array<string>, gone boolean", "path"),
    "symbols": Table("id long, path string, name string, kind string, start_line long, end_line long, signature string, doc string, qualified_name string", "name"),
    "sites": Table("path string, callee string, edge_kind string, source_id long, own boolean", "callee"),
    "edges": Table("path string, callee string, source_id long, target_id long, kind string, confidence string", "callee"),
    "names": Table("name string", "name"),
    "errors": Table("path string, lang string, error string, line long, message string", "path"),
}


class StoredIndex:
    """An index in a folder, kept up by what changes.

    Each batch of file versions is one version of the store: it is there whole or not at
    all, and a batch that comes again after a restart is known by its stream and number.
    A batch reads the call sites of its own files, and of other files only those that
    call a name whose first symbol changes with it.
    """

    def __init__(self, spark: SparkSession, path: str, hints: DataFrame | None = None, **options):
        self.spark, self.hints = spark, hints
        self.store = Store(spark, path, TABLES, 1, **options)

    def _files(self) -> DataFrame:
        """Every path's last version, those that are gone too."""
        return newest(self.store.read("files"), ["path"])

    def _of_files(self, rows: DataFrame) -> DataFrame:
        """Rows that their file's last version wrote, or a later one."""
        last = self._files().select("path", F.col("_version").alias("_since"))
        return rows.join(last, "path").where("_version >= _since").drop("_since")

    @property
    def files(self) -> DataFrame:
        return self._files().where("not gone").select("path", "lang", "content_hash")

    def symbols(self, names: DataFrame | None = None) -> DataFrame:
        """Symbols of all files, or of some ``names`` (one column)."""
        rows = self.store.read("symbols", names)
        if names is not None:
            rows = rows.join(names.toDF("name").distinct(), "name", "left_semi")
        return self._of_files(rows).drop("_version")

    @property
    def errors(self) -> DataFrame:
        return self._of_files(self.store.read("errors")).drop("_version")

    @property
    def edges(self) -> DataFrame:
        rows = self._of_files(self.store.read("edges"))
        again = self.store.read("names").groupBy(F.col("name").alias("callee")).agg(F.max("_version").alias("_since"))
        held = rows.join(again, "callee", "left").where("_since is null or _version >= _since or confidence = 'exact'")
        return held.select("source_id", "target_id", "kind", "confidence").distinct()

    def _changed(self, batch: DataFrame) -> DataFrame:
        """Of a batch's files those that differ from what is known: path, lang, content_hash, text (null: gone), old_names."""
        new = batch.groupBy("path").agg(F.max(F.struct("content_hash", "lang", "text")).alias("v")).select("path", "v.lang", "v.content_hash", "v.text")
        known = self._files().where("not gone").select("path", F.col("content_hash").alias("was"), F.col("names").alias("old_names"))
        both = new.join(known, "path", "left")
        return both.where(F.when(F.col("text").isNull(), F.col("was").isNotNull()).otherwise(~F.col("content_hash").eqNullSafe(F.col("was")))).drop("was")

    def apply(self, batch: DataFrame, number: int | None = None, stream: str = "stream") -> dict:
        """Lays file versions (path, lang, content_hash, text; null text: the file is gone) over the index; returns the version's manifest.

        Of a path that comes twice in a batch the greater hash counts; a hash that is known
        already changes nothing. ``number`` tells batches of ``stream`` apart, one that was
        laid before changes nothing. Null paths are left out.
        """
        done = self.store.last.get("streams", {})
        if number is not None and done.get(stream, -1) >= number:
            return self.store.last
        hinted = None
        if self.hints is not None:
            hinted = self.hints.agg(F.sum(F.xxhash64(*self.hints.columns).cast("decimal(38,0)")).cast("string")).first()[0]
            if self.store.version and self.store.last.get("hints") != hinted:
                raise StoreError("the hints are not those that the index was made with: make it anew")
        changed = checkpointed(self._changed(batch.where("path is not null").select("path", "lang", "content_hash", "text")))
        read = checkpointed(extract.parsed(changed.where("text is not null"), annotations_of(self.hints)))  # a source is parsed once
        symbols = checkpointed(extract.symbols_in(read).withColumn("id", symbol_id("path", "start_line", "name", "kind")))
        sites = attributed(symbols, extract.calls_in(read))
        if self.hints is not None:
            sites = sites.unionByName(hinted_sites(symbols, changed, self.hints))
        sites = checkpointed(sites)

        touched = changed.select(F.explode("old_names").alias("name")).unionByName(symbols.select("name")).distinct()
        needed = checkpointed(touched.withColumn("touched", F.lit(True)).unionByName(sites.where("not own").select(F.col("callee").alias("name"), F.lit(False).alias("touched"))).groupBy("name").agg(F.max("touched").alias("touched")))
        first = F.min(F.struct("path", "start_line", "id"))["id"]
        old = self.symbols(needed.select("name"))
        staying = old.join(changed.select("path"), "path", "left_anti")
        before = old.groupBy("name").agg(first.alias("was"))
        after = staying.select("name", "path", "start_line", "id").unionByName(symbols.select("name", "path", "start_line", "id")).groupBy("name").agg(first.alias("target_id"))
        firsts = checkpointed(needed.join(before, "name", "left").join(after, "name", "left"))
        names = firsts.where(F.col("touched") & ~F.col("was").eqNullSafe(F.col("target_id"))).select("name")

        held = self.store.read("sites", names)
        elsewhere = self._of_files(held.where("not own").join(names.select(F.col("name").alias("callee")), "callee", "left_semi")).join(changed.select("path"), "path", "left_anti")
        unresolved = sites.where("not own").unionByName(elsewhere.select(*sites.columns))
        away = unresolved.join(firsts.where("target_id is not null").select(F.col("name").alias("callee"), "target_id"), "callee")
        away = away.select("path", "callee", "source_id", "target_id", F.col("edge_kind").alias("kind"), F.lit("name_match").alias("confidence"))
        ids = symbols.select(F.col("path").alias("file_id"), F.col("name").alias("target_name"), F.col("id").alias("target_id"))
        last = ids.groupBy("file_id", "target_name").agg(F.max("target_id").alias("target_id"))
        local = sites.where("own").join(last.toDF("path", "callee", "target_id"), ["path", "callee"]).where("source_id <> target_id")
        local = local.select("path", "callee", "source_id", "target_id", F.col("edge_kind").alias("kind"), F.lit("exact").alias("confidence"))
        files = changed.join(symbols.groupBy("path").agg(F.collect_set("name").alias("names")), "path", "left")
        added = {
            "files": files.select("path", "lang", "content_hash", F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.col("text").isNull().alias("gone")), "symbols": symbols, "sites": sites,
            "edges": local.unionByName(away).distinct(), "names": names, "errors": extract.errors_in(read),
        }
        added = {k: rows if k in ("symbols", "sites") else checkpointed(rows) for k, rows in added.items()}
        counts = {"sites_new": sites.count(), "sites_read": held.count(), "sites_held": sum(s["rows"] for s in self.store.last.get("segments", {}).get("sites", []))}
        self.store.commit(added, {"counts": counts, "hints": hinted, "streams": {**done, **({stream: number} if number is not None else {})}})
        forget(changed, read, symbols, sites, needed, firsts, *added.values())  # all that counts is in the store
        return self.store.last

    def compact(self) -> int:
        """Leaves one segment a table, without the rows that later versions have replaced."""
        again = self.store.read("names").groupBy(F.col("name").alias("callee")).agg(F.max("_version").alias("_since"))
        edges = self._of_files(self.store.read("edges")).join(again, "callee", "left").where("_since is null or _version >= _since or confidence = 'exact'")
        live = {"files": self._files(), "edges": edges, "names": newest(self.store.read("names"), ["name"])}
        live |= {t: self._of_files(self.store.read(t)) for t in ("symbols", "sites", "errors")}
        stored = {t: checkpointed(rows.select(*self.store.read(t).columns)) for t, rows in live.items()}
        version = self.store.compact(stored)
        forget(*stored.values())
        return version


def index_stream(files: DataFrame, index: StoredIndex, name: str = "stream") -> DataStreamWriter:
    """A stream of file versions (path, lang, content_hash, text) laid over a stored index batch by batch.

    All state is in the store and the stream's checkpoint: after a loss the batch that was
    under way is laid again, or found to be there.
    """
    return files.writeStream.foreachBatch(lambda batch, number: index.apply(batch, number, name) and None)
