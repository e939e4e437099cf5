"""Graph operators over symbols, files and edges (source_id, target_id, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.sources.tables import checkpointed, forget

UPSTREAM, DOWNSTREAM = "upstream", "downstream"
MAX_DEPTH = 50


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """(at, to, kind): steps of a walk against the edges (upstream) or along them."""
    a, b = ("target_id", "source_id") if direction == UPSTREAM else ("source_id", "target_id")
    return edges.select(F.col(a).alias("at"), F.col(b).alias("to"), "kind")


def _depth(depth: int, least: int) -> int:
    if not least <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be {least} to {MAX_DEPTH}")
    return depth


FRONTIER_ROWS = 100_000  # rows of a walk's level that every executor may hold


def _step(level: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """A level joined with the steps from it; few rows go to where the steps are, more are shuffled."""
    return steps.join(F.broadcast(level) if level.limit(FRONTIER_ROWS + 1).count() <= FRONTIER_ROWS else level, keys)


def impact_levels(edges: DataFrame, seeds: DataFrame, depth: int, *directions: str) -> DataFrame:
    """(direction, id, depth): least level of every symbol within ``depth`` further steps of the seeds' neighbours.

    Level 0 are the neighbours over edges of any kind; further levels follow calls
    only. A symbol that was met isn't walked from again: its first arrival has most
    steps left. The edges are read once and all directions are walked together; each
    level is one join whose state lies in the shared folder.
    """
    _depth(depth, 0)
    directions = directions or (UPSTREAM, DOWNSTREAM)
    ends = {UPSTREAM: ("target_id", "source_id"), DOWNSTREAM: ("source_id", "target_id")}
    ways = F.array(*[F.struct(F.lit(d).alias("direction"), *[F.col(c).alias(n) for c, n in zip(ends[d], ("at", "to"), strict=True)]) for d in directions])
    steps = checkpointed(edges.select("kind", F.inline(ways)))
    calls = steps.where("kind = 'CALLS'").select("direction", "at", "to")
    seeds = seeds.select(F.col("id").alias("at")).distinct()
    level = checkpointed(_step(seeds, steps, ["at"]).select("direction", F.col("to").alias("id")).distinct())
    found = level.withColumn("depth", F.lit(0))
    for k in range(1, depth + 1):
        met = _step(level.select("direction", F.col("id").alias("at")), calls, ["direction", "at"]).select("direction", F.col("to").alias("id")).distinct()
        level = checkpointed(met.join(found, ["direction", "id"], "left_anti"))
        if level.isEmpty():
            break
        found = found.unionByName(level.withColumn("depth", F.lit(k)))
    forget(steps)  # the levels are tables of their own
    return found


def impact(symbols: DataFrame, files: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3, *directions: str) -> DataFrame:
    """direction, id, name, kind, path, start_line, depth of all that the seeds' change reaches."""
    return impact_levels(edges, seeds, depth, *directions).join(with_files(symbols, files), "id").select("direction", "id", "name", "kind", "path", "start_line", "depth")


def impact_risk(levels: DataFrame) -> DataFrame:
    """upstream_count, downstream_count and risk, one row."""
    up, down = (F.count(F.when(F.col("direction") == d, True)) for d in (UPSTREAM, DOWNSTREAM))
    return levels.agg(up.alias("upstream_count"), down.alias("downstream_count")).withColumn("risk", S.risk(F.col("upstream_count"), F.col("downstream_count")))


def trace(symbols: DataFrame, files: DataFrame, edges: DataFrame, entry: DataFrame, depth: int = 4, direction: str = DOWNSTREAM) -> DataFrame:
    """Levels 1 to ``depth`` of a walk over edges of every kind; a symbol comes once for each level and edge kind it is met at. Depth 0 meets none."""
    _depth(depth, 0)
    steps = checkpointed(oriented(edges, direction))
    level = entry.select("id").distinct()
    found = steps.select(F.col("to").alias("id"), F.col("kind").alias("edge_kind"), F.lit(0).alias("depth")).limit(0)
    for k in range(1, depth + 1):
        met = _step(level.select(F.col("id").alias("at")), steps, ["at"]).select(F.col("to").alias("id"), F.col("kind").alias("edge_kind")).distinct()
        met = checkpointed(met.withColumn("depth", F.lit(k)))
        found = met if k == 1 else found.unionByName(met)
        level = met.select("id").distinct()
        if level.isEmpty():
            break
    if depth:
        forget(steps)  # the levels are tables of their own
    return found.join(with_files(symbols, files), "id").select("id", "name", "kind", "path", "start_line", "depth", "edge_kind")


def within_budget(rows: DataFrame, cost: Column, order: list[Column], budget: int, by: list[str] | None = None, least: int = 0) -> DataFrame:
    """The first rows, in ``order``, whose costs add up to no more than ``budget``; ``by`` gives each key its own.

    If no row costs less than ``least``, the budget bounds how many rows can come, and only so many are looked at.
    """
    if least and not by:
        rows = rows.orderBy(*order).limit(budget // least + 1)
    window = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running_cost", F.sum(cost).over(window)).where(F.col("running_cost") <= budget)


def numbered(rows: DataFrame, order: list[str], by: str | None = None, name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) in ``order``, among those equal in ``by`` if given, a task numbering one range of the order.

    The rows are laid in ranges and stored; what comes before a range follows from the
    ranges' counts. ``order`` has to tell rows apart, or equal ones are numbered in any order.
    """
    keys = [*([by] if by else []), *order]
    laid = checkpointed(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    groups = ["_range", *([by] if by else [])]
    counts = laid.groupBy(*groups).agg(F.count("*").alias("_n"))  # a row for each range, and for each key that begins in it
    window = Window.partitionBy(by) if by else Window.partitionBy()
    before = counts.withColumn("_before", F.sum("_n").over(window.orderBy("_range")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    at = laid.withColumn("_at", inside)
    same = [at[g].eqNullSafe(before[g]) for g in groups]
    return at.join(before, same).select(*[at[c] for c in rows.columns], (F.col("_before") + F.col("_at")).alias(name))


def with_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")


def neighbours(symbols: DataFrame, files: DataFrame, edges: DataFrame, of: DataFrame, direction: str, limit: int = 20) -> DataFrame:
    """Symbols one step from those in ``of`` (id), by name, at most ``limit`` for each."""
    steps = oriented(edges, direction).join(of.select(F.col("id").alias("at")), "at").select(F.col("at").alias("of_id"), F.col("to").alias("id"), F.col("kind").alias("edge_kind"))
    named = steps.join(with_files(symbols, files), "id").select("of_id", "id", "name", "kind", "path", "start_line", "edge_kind")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("of_id").orderBy("name", "id", "edge_kind")))
    return ranked.where(F.col("rank") <= limit)


def orphans(symbols: DataFrame, files: DataFrame, calls: DataFrame) -> DataFrame:
    """Symbols that no call begins or ends at."""
    touched = calls.select(F.col("source_id").alias("id")).union(calls.select("target_id"))
    return symbols.join(touched, "id", "left_anti").join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "name", "kind", "path", "start_line")


def self_loops(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    return calls.where("source_id = target_id").select(F.col("source_id").alias("id")).distinct().join(symbols, "id").select("id", "name", "kind")


def shared_callers(calls: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Ids that call a symbol of ``first`` and one of ``second``."""
    def callers(of: DataFrame) -> DataFrame:
        return calls.join(of.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id"))

    return callers(first).intersect(callers(second))


def path_exists(edges: DataFrame, first: DataFrame, second: DataFrame, hops: int = 1) -> DataFrame:
    """One row: whether up to ``hops`` edges of any kind lead from a symbol of ``first`` to one of ``second``."""
    _depth(hops, 0)
    steps = checkpointed(edges.select(F.col("source_id").alias("id"), "target_id")) if hops > 1 else edges.select(F.col("source_id").alias("id"), "target_id")
    at = first.select("id").distinct()
    seen = at.limit(0)
    for k in range(hops):
        at = checkpointed(_step(at, steps, ["id"]).select(F.col("target_id").alias("id")).distinct().join(seen, "id", "left_anti"))  # what was met leads nowhere new
        seen = at if not k else seen.union(at)
        if at.isEmpty():
            break
    return seen.join(second.select("id"), "id", "left_semi").agg((F.count("*") > 0).alias("path_exists"))


def degree_centrality(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges at a symbol over the number of other symbols."""
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).groupBy("id").agg(F.count("*").alias("degree"))
    n = symbols.agg((F.count("*") - 1).alias("others"))
    return symbols.select("id").join(ends, "id", "left").crossJoin(F.broadcast(n)).select("id", F.coalesce("degree", F.lit(0)).alias("degree"), (F.coalesce("degree", F.lit(0)) / F.col("others")).alias("centrality"))


def most_connected(edges: DataFrame, kind: str | None = "CALLS") -> DataFrame:
    """(id): the symbol with most outgoing edges, the smaller id on ties; one row."""
    own = edges.where(F.col("kind") == kind) if kind else edges
    return own.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


def resolve_names(unresolved: DataFrame, symbols: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Deferred calls (source_id, target_name, kind) to the first symbol of that name in ``order`` (then by id), each edge once."""
    first = symbols.groupBy(F.col("name").alias("target_name")).agg(F.min(F.struct(*order, "id"))["id"].alias("target_id"))
    return unresolved.join(first, "target_name").select("source_id", "target_id", "kind").distinct().withColumn("confidence", F.lit("name_match"))


def resolve_local(unresolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """Deferred calls (source_id, file_id, target_name, kind) to the last symbol of that name in the same file; none to itself."""
    last = symbols.groupBy("file_id", F.col("name").alias("target_name")).agg(F.max("id").alias("target_id"))
    return unresolved.join(last, ["file_id", "target_name"]).where("source_id <> target_id").select("source_id", "target_id", "kind").distinct().withColumn("confidence", F.lit("exact"))


def enclosing(places: DataFrame, symbols: DataFrame, block: int = 64) -> DataFrame:
    """Places (place_id, file_id, line) with the innermost symbol around them, or the file's first one.

    Places meet only the symbols that reach into their block of lines, so a long file
    is many keys. Ties go to the smaller span, then the smaller id; a file without
    symbols gives none. A null line is within no symbol.
    """
    spans = symbols.select("file_id", F.col("id").alias("symbol_id"), "start_line", "end_line")
    blocks = F.sequence(F.floor(F.col("start_line") / block), F.floor(F.col("end_line") / block))
    laid = spans.where("start_line <= end_line").withColumn("block", F.explode(blocks))
    around = (F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line"))
    at = places.withColumn("block", F.floor(F.col("line") / block)).join(laid, ["file_id", "block"]).where(around)
    inner = at.groupBy("place_id", "file_id", "line").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), F.col("symbol_id").alias("id")))["id"].alias("inner"))
    first = spans.groupBy("file_id").agg(F.min(F.struct(F.col("start_line").alias("line"), F.col("symbol_id").alias("id")))["id"].alias("first"))
    picked = places.select("place_id", "file_id", "line").distinct().join(first, "file_id").join(inner, ["place_id", "file_id", "line"], "left")
    return picked.select("place_id", "file_id", "line", F.coalesce("inner", "first").alias("symbol_id"), F.col("inner").isNotNull().alias("enclosed"))
