"""Knowledge layers: domains, constraints, decisions, scratchpad, and functional updates of their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators.grams import contained
from loomgraph.sources.tables import checkpointed


def catalog(domains: DataFrame, links: DataFrame, constraints: DataFrame) -> DataFrame:
    """name, symbol_count, constraint_count of every domain; each side is counted before the join."""
    symbols = links.groupBy(F.col("domain").alias("name")).agg(F.countDistinct("symbol_id").alias("symbol_count"))
    rules = constraints.groupBy(F.col("domain").alias("name")).agg(F.countDistinct("id").alias("constraint_count"))
    out = domains.select("name").join(symbols, "name", "left").join(rules, "name", "left")
    return out.select("name", F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"), F.coalesce("constraint_count", F.lit(0)).alias("constraint_count"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: a count for each table."""
    out = None
    for name, table in tables.items():
        n = table.agg(F.count("*").alias(name))
        out = n if out is None else out.crossJoin(n)  # one row each
    return out


def knowledge_score(counts: DataFrame, layers: tuple[str, ...]) -> DataFrame:
    """25 for every layer that holds anything."""
    score = sum((F.when(F.col(c) > 0, 25).otherwise(0) for c in layers), F.lit(0))
    return counts.withColumn("layer_score", score).withColumn("status", S.health(F.col("symbols"), F.col("layer_score"))).withColumn("needs_knowledge", F.col("layer_score") < 50)


def newest(rows: DataFrame, by: str, limit: int) -> DataFrame:
    """The ``limit`` newest rows of each key (created_at, then id)."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def superseded(decisions: DataFrame, given: DataFrame) -> DataFrame:
    """``decisions`` after ``given`` (id, supersedes_id) were recorded: those that one of them names are historical, by the last that does.

    A decision that was historical before stays so; names of unknown decisions change nothing.
    """
    by = given.where("supersedes_id is not null").groupBy(F.col("supersedes_id").alias("id")).agg(F.max(F.col("id")).alias("by"))
    had = F.col("superseded_by") if "superseded_by" in decisions.columns else F.lit(None).cast("long")
    status = F.col("status") if "status" in decisions.columns else F.lit("active")
    out = decisions.join(by, "id", "left")
    return out.withColumns({"superseded_by": F.coalesce("by", had), "status": F.when(F.col("by").isNotNull(), "historical").otherwise(status)}).drop("by")


def rules_of(asked: DataFrame, links: DataFrame, constraints: DataFrame) -> DataFrame:
    """(id, code) of the rules of every domain that an ``asked`` symbol (id, name) is linked to by its id or by its name.

    An OR of two keys is two equi-joins; names are joined once each, however many symbols have one.
    """
    by_id = asked.select("id").join(links.where("symbol_id is not null").select(F.col("symbol_id").alias("id"), "domain"), "id")
    named = links.select(F.col("symbol_name").alias("name"), "domain").distinct()
    both = by_id.unionByName(asked.select("id", "name").join(named, "name").select("id", "domain")).distinct()
    return both.join(constraints.select("domain", "code"), "domain").select("id", "code").distinct()


def linked_symbols(given: DataFrame, symbols: DataFrame) -> DataFrame:
    """Links of ``given`` (domain, symbol_name), with the first symbol of that name or null: one may be linked before it is known."""
    first = symbols.groupBy(F.col("name").alias("symbol_name")).agg(F.min("id").alias("symbol_id"))
    return given.select("domain", "symbol_name").distinct().join(first, "symbol_name", "left").select("domain", "symbol_id", "symbol_name")


ASKED_ROWS = 10_000  # rows that every executor may hold


def keyword_symbols(given: DataFrame, symbols: DataFrame) -> DataFrame:
    """(domain, symbol_name) of the symbols whose name or name's words hold a keyword of ``given`` (domain, keyword), in any case."""
    held = symbols.select(F.col("name").alias("symbol_name"), F.lower(F.concat_ws("\n", "name", "name_tokens")).alias("held")).where("symbol_name is not null")
    names = held.groupBy("symbol_name").agg(F.array_join(F.collect_set("held"), "\n").alias("held"))
    asked = given.select("domain", F.lower("keyword").alias("keyword")).distinct()
    found = contained(names, asked, "symbol_name", "held", "keyword").toDF("symbol_name", "keyword")
    return found.join(asked, "keyword").select("domain", "symbol_name").distinct()


def stale(changed: DataFrame, asked: DataFrame) -> DataFrame:
    """(target, path): changed paths that hold an ``asked`` target or that it holds."""
    paths, targets = changed.select("path").where("path is not null").distinct(), asked.select("target").where("target is not null").distinct()
    held = contained(paths.withColumn("text", F.col("path")), targets, "path", "text", "target").toDF("path", "target")
    holding = contained(targets.withColumn("text", F.col("target")), paths, "target", "text", "path").toDF("target", "path")
    return held.select("target", "path").union(holding.select("target", "path")).distinct()


def upserted(old: DataFrame, new: DataFrame, key: str | list[str], keep_null: bool = True) -> DataFrame:
    """The next snapshot: rows of ``new`` replace those of ``old`` with their key; a null in ``new`` keeps what was there."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in rest])
    b = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in rest], F.lit(True).alias("is_new"))
    both = a.join(b, keys, "full_outer")
    value = (lambda c: F.coalesce(f"new_{c}", f"old_{c}")) if keep_null else (lambda c: F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")))
    return both.select(*keys, *[value(c).alias(c) for c in rest])


def merged_domains(old: DataFrame, new: DataFrame) -> DataFrame:
    """Domains by name: keywords are the old ones, then the new ones that weren't there."""
    both = old.select("name", F.col("keywords").alias("had")).join(new.select("name", F.col("keywords").alias("given")), "name", "full_outer")
    none = F.array().cast("array<string>")
    return both.select("name", F.array_distinct(F.concat(F.coalesce("had", none), F.coalesce("given", none))).alias("keywords"))


def inserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks, each key once; null keys match null keys."""
    fresh = new.dropDuplicates(key)
    met = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key]
    return old.unionByName(fresh.alias("n").join(old.alias("o"), met, "left_anti").select(*old.columns))


def without_files(gone: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Files that are gone (id) take their symbols along, and those their edges."""
    kept = symbols.join(gone.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    dead = symbols.join(gone.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id")
    left = edges.join(dead.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(dead.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return {"files": files.join(gone, "id", "left_anti"), "symbols": kept, "edges": left.select(*edges.columns)}


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """Rows of ``now`` (path, content_hash) that are new or have other contents."""
    was = before.select("path", F.col("content_hash").alias("was"))
    return now.join(was, "path", "left").where(F.col("was").isNull() | (F.col("was") != F.col("content_hash"))).withColumn("state", F.when(F.col("was").isNull(), "new").otherwise("changed")).drop("was")


def deleted_files(before: DataFrame, now: DataFrame) -> DataFrame:
    return before.select("path").join(now.select("path"), "path", "left_anti")


def validated(decisions: DataFrame, names: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Decisions with whether any of their functions is a known symbol (name) or, where ``sources`` (path, text) are given, stands in a source; ``validated_by`` then says which: index, text or null."""
    asked = decisions.select("id", F.explode("functions").alias("name")).distinct()
    known = asked.join(names.select("name").distinct(), "name", "left_semi").select("id").distinct()
    if sources is None:
        return decisions.join(known.withColumn("validated", F.lit(True)), "id", "left").withColumn("validated", F.coalesce("validated", F.lit(False)))
    rest = asked.join(known, "id", "left_anti").where("name <> ''")
    written = contained(sources, rest, "path", "text", "name").select(F.col("needle").alias("name")).distinct()
    by = known.withColumn("validated_by", F.lit("index")).unionByName(rest.join(written, "name", "left_semi").select("id").distinct().withColumn("validated_by", F.lit("text")))
    return decisions.join(by, "id", "left").withColumn("validated", F.col("validated_by").isNotNull())


def scratchpad(pads: DataFrame, role: str) -> DataFrame:
    """The role's row, its JSON lists decoded; a list that is none is empty."""
    rows = pads.where(F.col("agent_role") == role)
    return rows.withColumns({c: S.json_strings(F.col(c)) for c in ("completed_steps", "current_errors", "blockers") if c in rows.columns})


def resolve_project(projects: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, id) of the project that each key means; null if none or if several do.

    Tiers: id, path, name, end of path, unique part of name, unique part of the last
    path segment. The first tier that any project meets decides.
    """
    keys = keys.select("key").distinct()
    rows = projects.select("id", "path", "name")
    ends = rows.select("id", F.explode(F.expr("transform(sequence(1, greatest(1, size(split(path, '/')) - 1)), k -> array_join(slice(split(path, '/'), k + 1, 1000000), '/'))")).alias("end"))
    met = (
        rows.join(keys, F.col("id") == F.col("key")).select("key", "id", F.lit(1).alias("tier"))
        .unionByName(rows.join(keys, F.col("path") == F.col("key")).select("key", "id", F.lit(2).alias("tier")))
        .unionByName(rows.join(keys, F.lower("name") == F.lower("key")).select("key", "id", F.lit(3).alias("tier")))
        .unionByName(ends.join(keys, F.col("end") == F.col("key")).select("key", "id", F.lit(4).alias("tier")))
    )
    met = checkpointed(met.distinct())
    # only what no equality finds is looked for within names: a few of the keys that a user asks for
    left = keys.join(met, "key", "left_anti")
    low, last = F.lower("key"), F.lower(F.element_at(F.split("path", "/"), -1))
    tier = F.when(F.contains(F.lower("name"), low), 5).when(F.contains(last, low), 6)
    left = F.broadcast(left) if left.limit(ASKED_ROWS + 1).count() <= ASKED_ROWS else left
    at = met.unionByName(rows.join(left, tier.isNotNull()).select("key", "id", tier.alias("tier")))
    best = at.groupBy("key", "tier").agg(F.count("*").alias("n"), F.min("id").alias("id")).groupBy("key").agg(F.min(F.struct("tier", "n", "id")).alias("b"))
    chosen = best.select("key", F.when((F.col("b.n") == 1) | (F.col("b.tier") < 5), F.col("b.id")).alias("id"))
    return keys.join(chosen, "key", "left").select("key", "id")
