"""The entry points of the library, one for each tool that a user of the graph calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.jobs import index
from loomgraph.operators import graph as G
from loomgraph.operators import knowledge as K
from loomgraph.operators import retrieval as R
from loomgraph.operators.text_store import SegmentIndex
from loomgraph.sources import imports, scan
from loomgraph.sources.views import Graph


class Workspace:
    """Answers about one graph (any object with the tables of ``Graph``)."""

    def __init__(self, graph: Graph):
        self.g = graph

    def named(self, name: str, file: str | None = None) -> DataFrame:
        """Symbols of that name or qualified name; ``file`` is a path or a part of one."""
        rows = self.g.symbols.where((F.col("name") == name) | (F.col("qualified_name") == name))
        if file is None:
            return rows
        return G.with_files(rows, self.g.file_refs.where((F.col("path") == file) | F.contains(F.lower("path"), F.lit(file.lower())))).drop("path")

    def projects(self, registry: DataFrame) -> DataFrame:
        return registry.select("id", "name", "path").orderBy("name", "id")

    def brief(self) -> DataFrame:
        counts = K.table_counts({"files": self.g.file_refs, "symbols": self.g.symbols, "edges": self.g.edges, "domains": self.g.domains, "constraints": self.g.constraints, "decisions": self.g.decisions})
        return K.knowledge_score(counts, ("domains", "constraints", "decisions"))

    def build_graph(self, root: str, before: index.Index | None = None) -> index.Index:
        return index.build(scan.scan_files(self.g.spark, root), before, scan.tree_hints(self.g.spark, root))

    def update_graph(self, root: str, store: str) -> index.StoredIndex:
        """The stored index of a tree, brought up to what the tree is now: changed files are read, those that are gone leave."""
        kept = index.StoredIndex(self.g.spark, store, scan.tree_hints(self.g.spark, root))
        files = scan.scan_files(self.g.spark, root).select("path", "lang", "content_hash", "text")
        gone = kept.files.join(files.select("path"), "path", "left_anti").withColumn("text", F.lit(None).cast("string"))
        kept.apply(files.unionByName(gone.select(files.columns)))
        return kept

    def text_index(self, path: str, stems: bool = False) -> R.TextIndex:
        """The stored index of all symbols' names, signatures and comments, made anew."""
        return R.TextIndex(self.g.spark, path, stems=stems).write(self.g.symbols)

    def kept_index(self, path: str) -> SegmentIndex:
        """An index in segments, which ``update`` keeps up; where there is none yet it is made of all symbols."""
        index = SegmentIndex(self.g.spark, path)
        if not index.store.version:
            index.update(self.g.symbols)
        return index

    def lookup(self, text: str, kind: str | None = None, limit: int = 30, index: R.TextIndex | SegmentIndex | None = None) -> DataFrame:
        """Best symbols for a text: all words, the last as a prefix, or a keyword of its domain; from a stored ``index``, if there is one."""
        asked = self.g.spark.createDataFrame([(text,)], "query string")
        terms = asked.select("query", F.explode(R.query_terms(F.col("query"))).alias("t")).select("query", "t.*")
        extra = R.synonyms(self.g.domains, asked).select("query", F.explode(R.words_of(F.col("term"))).alias("term")).distinct()
        extra = extra.select("query", (F.lit(1000) + F.row_number().over(_by_term())).alias("slot"), "term", F.lit(False).alias("prefix"), F.lit(False).alias("required"))
        rows = self.g.symbols.where(F.col("kind") == kind) if kind else self.g.symbols
        asked = terms.unionByName(extra)
        hits = index.search(asked) if index else R.bm25(self.g.symbols, asked)  # scores are those among all symbols
        hits = hits.join(rows.select("id"), "id", "left_semi") if kind else hits
        found = R.top_by(hits, "bm25", "id", min(limit, 100))
        return found.join(G.with_files(rows, self.g.file_refs), "id").select("rank", "id", "name", "kind", "path", "start_line", "bm25")

    def outline(self, path: str, kinds: list[str] | None = None, limit: int = 100) -> DataFrame:
        """Symbols below a path; where none is, those whose path holds it."""
        def below(hit: Callable) -> DataFrame:
            rows = G.with_files(self.g.symbols, self.g.file_refs.where(hit(F.col("path"))))
            return rows.where(F.col("kind").isin(kinds)) if kinds else rows

        exact = below(lambda p: (p == path) | p.startswith(path.rstrip("/") + "/"))
        if not exact.isEmpty():
            return exact.orderBy("path", "start_line", "id").limit(limit).withColumn("relevance", F.lit(1.0))
        return below(lambda p: F.contains(p, F.lit(path))).orderBy(F.length("path"), "start_line", "path", "id").limit(limit).withColumn("relevance", F.lit(0.8))

    def inspect(self, name: str, file: str | None = None) -> dict[str, DataFrame]:
        """A symbol with its callers, callees, decisions and rules; several of the name come all, to choose from."""
        of = self.named(name, file)
        called = of.select(F.col("id").alias("symbol_id"), F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("function"))
        decisions = self.g.decisions.withColumn("function", F.explode("functions")).join(called, "function").drop("function").dropDuplicates(["symbol_id", "id"])
        return {
            "symbols": G.with_files(of, self.g.file_refs), "callers": G.neighbours(self.g.symbols, self.g.file_refs, self.g.edges, of, "upstream"), "callees": G.neighbours(self.g.symbols, self.g.file_refs, self.g.edges, of, "downstream"),
            "decisions": K.newest(decisions, "symbol_id", 10),
            "constraints": K.rules_of(of, self.g.domain_symbols, self.g.constraints).withColumnRenamed("id", "symbol_id").join(self.g.constraints, "code"),
        }

    def impact(self, target: str, depth: int = 3, direction: str = "both") -> tuple[DataFrame, DataFrame]:
        """What a change reaches, ``upstream``, ``downstream`` or both, and its risk; a way that isn't walked counts as empty."""
        ways = {"both": (G.UPSTREAM, G.DOWNSTREAM), G.UPSTREAM: (G.UPSTREAM,), G.DOWNSTREAM: (G.DOWNSTREAM,)}
        if direction not in ways:
            raise ValueError(f"no direction {direction!r}; there are {', '.join(ways)}")
        rows = G.impact(self.g.symbols, self.g.file_refs, self.g.edges, self.named(target).select("id"), depth, *ways[direction])
        return rows, G.impact_risk(rows)

    def trace(self, entry: str, depth: int = 4, direction: str = "downstream", budget: int | None = None) -> DataFrame:
        first = self.named(entry).agg(F.min("id").alias("id"))
        rows = G.trace(self.g.symbols, self.g.file_refs, self.g.edges, first, depth, direction)
        if budget is None:
            return rows
        return G.within_budget(rows, S.route_tokens(F.col("name"), F.col("kind"), F.col("path")), [F.col(c) for c in ("depth", "name", "path", "edge_kind", "id")], budget, least=S.ROUTE_LEAST)

    def grep(self, pattern: str, path: str | None = None, includes: list[str] | None = None, context: int = 0, limit: int = 50, **options) -> tuple[DataFrame, DataFrame]:
        """Lines that match (path, match_line, line_no, line), the first ``limit`` matches with ``context`` lines around, and how many files of each folder have one.

        ``path`` is a folder or file, ``includes`` are globs of paths or of file names.
        """
        files = self.g.file_refs.select(F.col("id").alias("doc_id"), "path")
        if path:
            files = files.where((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))
        if includes:
            globs = [scan.glob_pattern(g if "/" in g else f"**/{g}") for g in includes]
            files = files.where(F.greatest(F.lit(False), *[F.col("path").rlike(g) for g in globs]))
        docs = self.g.raw("documents").select("doc_id", "text").join(files, "doc_id")
        every = R.grep(docs, pattern, key="path", **options)
        first = every.select("path", "line_no").orderBy("path", "line_no").limit(limit).withColumnRenamed("line_no", "match_line")
        near = R.grep_context(docs.join(F.broadcast(first.select("path").distinct()), "path", "left_semi"), pattern, context, key="path", **options)
        return near.join(F.broadcast(first), ["path", "match_line"], "left_semi"), R.by_directory(every)

    def gaps(self, template: str, **names: str) -> DataFrame:
        """``orphans``, ``self_loops``, ``path`` or ``shared_callers`` (first, second)."""
        ids = {k: self.named(v).select("id") for k, v in names.items()}
        templates: dict[str, Callable[[], DataFrame]] = {
            "orphans": lambda: G.orphans(self.g.symbols, self.g.file_refs, self.g.calls), "self_loops": lambda: G.self_loops(self.g.symbols, self.g.calls),
            "path": lambda: G.path_exists(self.g.edges, ids["first"], ids["second"]), "shared_callers": lambda: G.shared_callers(self.g.calls, ids["first"], ids["second"]).join(self.g.symbols, "id"),
        }
        if template not in templates:
            raise ValueError(f"no template {template!r}; there are {', '.join(templates)}")
        return templates[template]()

    def domains(self, name: str | None = None) -> DataFrame:
        rows = K.catalog(self.g.domains, self.g.domain_symbols, self.g.constraints)
        return rows if name is None else rows.where(F.col("name") == name)

    def assign(self, given: DataFrame, links: DataFrame | None = None, rules: DataFrame | None = None) -> dict[str, DataFrame]:
        """The next states of the domains, with ``given`` (name, keywords) merged in, of their ``links`` (domain, symbol_name) and of the ``rules`` (code, severity, statement, domain)."""
        out = {"domains": K.merged_domains(self.g.domains.select("name", "keywords"), given)}
        if links is not None:
            out["domain_symbols"] = K.inserted(self.g.domain_symbols, K.linked_symbols(links, self.g.symbols), ["domain", "symbol_id", "symbol_name"])
        if rules is not None:
            out["constraints"] = K.upserted(self.g.constraints.select("code", "severity", "statement", "domain"), rules.select("code", "severity", "statement", "domain"), "code")
        return out

    def constraints_from(self, path: str) -> DataFrame:
        """The next state of the rules, with those of a text file merged in."""
        read = scan.read_rules(self.g.spark, path).dropDuplicates(["code"]).select("code", "severity", "statement")
        return K.upserted(self.g.constraints.select("code", "severity", "statement"), read, "code")

    def record_decision(self, new: DataFrame, sources: DataFrame | None = None) -> DataFrame:
        """Decisions with ``new`` ones added and validated, by ``sources`` (path, text) too if there are some; those that a new one's ``supersedes_id`` names are historical, and no others."""
        names = self.g.symbols.select(F.col("qualified_name").alias("name")).unionByName(self.g.symbols.select("name"))
        columns = ["id", "domain", "reason", "revert_risk", "created_at", "functions"]
        given = new.withColumn("revert_risk", F.coalesce("revert_risk", F.lit("LOW")))
        return K.superseded(K.validated(self.g.decisions.select(*columns).unionByName(given.select(*columns)), names, sources), new.select("id", "supersedes_id"))

    def import_tree(self, root: str) -> dict[str, DataFrame]:
        """The next states of domains, links and rules, with those of a Markdown tree."""
        domains, rules = imports.tree_domains(self.g.spark, root), imports.tree_rules(self.g.spark, root)
        mapped = K.keyword_symbols(domains.select(F.col("name").alias("domain"), F.explode("keywords").alias("keyword")), self.g.symbols)
        out = self.assign(domains, mapped, rules.dropDuplicates(["code"]).withColumn("domain", F.lit(None).cast("string")))
        return out

    def import_knowledge(self, tables: dict[str, DataFrame], dry_run: bool = False) -> dict[str, DataFrame]:
        """What another store's domains, constraints and decisions have and this one lacks is added; a dry run gives the counts alone."""
        given = imports.from_store(tables)
        own = {"domains": (self.g.domains.select("name", "keywords"), ["name"]), "constraints": (self.g.constraints.select("code", "severity", "statement"), ["code"])}
        own["decisions"] = (self.g.decisions.select("domain", "functions", "reason", "revert_risk", F.lit("active").alias("status"), "created_at"), ["domain", "reason", "created_at"])
        tables = {k: (own[k][0], rows.select(*own[k][0].columns), own[k][1]) for k, rows in given.items()}
        if dry_run:
            return {k: new.join(old, key, "left_anti").select(*key).distinct().agg(F.count("*").alias("added")) for k, (old, new, key) in tables.items()}
        return {k: K.inserted(old, new, key) for k, (old, new, key) in tables.items()}


def _by_term():
    from pyspark.sql import Window

    return Window.partitionBy("query").orderBy("term")
