"""Graph, join and window queries over the model's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.jobs.catalogue import query
from loomgraph.operators import graph as G
from loomgraph.operators import knowledge as K
from loomgraph.sources.tables import checkpointed
from loomgraph.sources.views import Graph

_TOP = """
top AS (SELECT source_id AS id FROM calls GROUP BY 1 ORDER BY count(*) DESC, source_id LIMIT 1)"""
_COMMON = """
common AS (SELECT name FROM symbols GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)"""
_TWO = """
two AS (SELECT target_id AS id, row_number() OVER (ORDER BY count(*) DESC, target_id) AS r FROM calls GROUP BY 1 ORDER BY r LIMIT 2)"""


def _common(g: Graph) -> DataFrame:
    """The name that most symbols have, the first on ties; one row."""
    return g.symbols.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(1).select("name")


def _named(g: Graph) -> DataFrame:
    return g.symbols.join(F.broadcast(_common(g)), "name")


def _called(g: Graph, rank: int) -> DataFrame:
    """(id) of the symbol that is called most often, or second most; one row."""
    top = g.calls.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(rank)
    return top.orderBy("n", F.desc("id")).limit(1).select("id")


_LEVELS = """
walk(direction, id, depth) AS (
  SELECT 'upstream', e.source_id, 0 FROM edges e JOIN top ON e.target_id = top.id UNION SELECT 'downstream', e.target_id, 0 FROM edges e JOIN top ON e.source_id = top.id
  UNION
  SELECT w.direction, CASE w.direction WHEN 'upstream' THEN c.source_id ELSE c.target_id END, w.depth + 1
  FROM walk w JOIN calls c ON w.id = CASE w.direction WHEN 'upstream' THEN c.target_id ELSE c.source_id END WHERE w.depth < 3),
levels AS (SELECT direction, id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY 1, 2)"""
_WITH_SYMBOL = "JOIN symbols s ON s.id = l.id JOIN files f ON f.id = s.file_id"


@query(f"SELECT l.direction, l.id, s.name, s.kind, f.path, s.start_line, l.depth FROM levels l {_WITH_SYMBOL}", f"{_TOP},{_LEVELS}")
def impact(g: Graph) -> DataFrame:
    return G.impact(g.symbols, g.file_refs, g.stored_edges, G.most_connected(g.stored_edges), 3)


@query("SELECT id, direction, depth FROM levels", f"{_TOP},{_LEVELS}")
def impact_cte(g: Graph) -> DataFrame:
    return G.impact_levels(g.stored_edges, G.most_connected(g.stored_edges), 3)


@query("SELECT depth, direction, count(*) AS symbols FROM levels GROUP BY 1, 2", f"{_TOP},{_LEVELS}")
def agg_min_depth(g: Graph) -> DataFrame:
    return impact_cte(g).groupBy("depth", "direction").agg(F.count("*").alias("symbols"))


@query(
    """SELECT u AS upstream_count, d AS downstream_count, CASE WHEN u + d <= 2 THEN 'LOW' WHEN u + d <= 10 THEN 'MEDIUM' WHEN u + d <= 30 THEN 'HIGH' ELSE 'CRITICAL' END AS risk
    FROM (SELECT count(*) FILTER (direction = 'upstream') AS u, count(*) FILTER (direction = 'downstream') AS d FROM levels)""",
    f"{_TOP},{_LEVELS}",
)
def agg_risk(g: Graph) -> DataFrame:
    return G.impact_risk(impact_cte(g))


@query(
    f"""SELECT * EXCLUDE (r) FROM (SELECT l.direction, l.id, s.name, f.path, l.depth, count(*) OVER (PARTITION BY l.direction) AS total,
      row_number() OVER (PARTITION BY l.direction ORDER BY l.depth, f.path, l.id) AS r FROM levels l {_WITH_SYMBOL}) WHERE r <= 100""",
    f"{_TOP},{_LEVELS}",
)
def cap_impact(g: Graph) -> DataFrame:
    rows = checkpointed(impact(g))
    total = rows.groupBy("direction").agg(F.count("*").alias("total"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("direction").orderBy("depth", "path", "id"))).where("r <= 100")  # each task keeps its own first 100
    return first.join(F.broadcast(total), "direction").select("direction", "id", "name", "path", "depth", "total")


@query(
    f"SELECT l.direction, l.id, row_number() OVER (PARTITION BY l.direction ORDER BY l.depth, f.path, l.id) AS place FROM levels l {_WITH_SYMBOL}", f"{_TOP},{_LEVELS}"
)
def sort_multi(g: Graph) -> DataFrame:
    return G.numbered(impact(g), ["depth", "path", "id"], "direction").select("direction", "id", "place")


_TRACE = """
walk(id, depth, edge_kind) AS (
  SELECT e.target_id, 1, e.kind FROM edges e JOIN top ON e.source_id = top.id
  UNION SELECT e.target_id, w.depth + 1, e.kind FROM walk w JOIN edges e ON e.source_id = w.id WHERE w.depth < 4)"""


@query("SELECT w.id, s.name, s.kind, f.path, s.start_line, CAST(w.depth AS INTEGER) AS depth, w.edge_kind FROM walk w JOIN symbols s ON s.id = w.id JOIN files f ON f.id = s.file_id", f"{_TOP},{_TRACE}")
def trace(g: Graph) -> DataFrame:
    return G.trace(g.symbols, g.file_refs, g.stored_edges, G.most_connected(g.stored_edges), 4)


@query("SELECT id, CAST(depth AS INTEGER) AS depth FROM (SELECT DISTINCT id, depth FROM walk)", f"{_TOP},{_TRACE}")
def set_union_distinct(g: Graph) -> DataFrame:
    return trace(g).select("id", "depth").distinct()


_BUDGET = """
costed AS (SELECT w.id, w.depth, w.edge_kind, s.name, f.path, CAST(floor((strlen(s.name) + strlen(s.kind) + strlen(f.path)) / 4) + 8 AS BIGINT) AS cost
  FROM walk w JOIN symbols s ON s.id = w.id JOIN files f ON f.id = s.file_id)"""


@query(
    """SELECT id, CAST(depth AS INTEGER) AS depth, edge_kind, CAST(running_cost AS BIGINT) AS running_cost FROM (
      SELECT *, sum(cost) OVER (ORDER BY depth, name, path, edge_kind, id ROWS UNBOUNDED PRECEDING) AS running_cost FROM costed) WHERE running_cost <= 120""",
    f"{_TOP},{_TRACE},{_BUDGET}",
)
def win_token_budget(g: Graph) -> DataFrame:
    rows = trace(g)
    order = [F.col(c) for c in ("depth", "name", "path", "edge_kind", "id")]
    return G.within_budget(rows, S.route_tokens(F.col("name"), F.col("kind"), F.col("path")), order, 120, least=S.ROUTE_LEAST).select("id", "depth", "edge_kind", "running_cost")


@query(
    """SELECT id, file_id, name, start_line FROM (SELECT *, lag(name) OVER (PARTITION BY file_id ORDER BY start_line, id) AS before FROM symbols) WHERE before IS NULL OR before <> name"""
)
def win_consecutive_dedup(g: Graph) -> DataFrame:
    before = F.lag("name").over(Window.partitionBy("file_id").orderBy("start_line", "id"))
    return g.symbols.withColumn("before", before).where("before is null or before <> name").select("id", "file_id", "name", "start_line")


_NEAR = """SELECT * EXCLUDE (r) FROM (SELECT top.id AS of_id, s.id, s.name, s.kind, f.path, s.start_line, e.kind AS edge_kind,
  row_number() OVER (ORDER BY s.name, s.id, e.kind) AS r FROM edges e JOIN top ON e.{at} = top.id JOIN symbols s ON s.id = e.{to} JOIN files f ON f.id = s.file_id) WHERE r <= 20"""


@query(_NEAR.format(at="target_id", to="source_id"), _TOP)
def callers(g: Graph) -> DataFrame:
    return G.neighbours(g.symbols, g.file_refs, g.edges, G.most_connected(g.edges), "upstream").drop("rank")


@query(_NEAR.format(at="source_id", to="target_id"), _TOP)
def callees(g: Graph) -> DataFrame:
    return G.neighbours(g.symbols, g.file_refs, g.edges, G.most_connected(g.edges), "downstream").drop("rank")


@query("SELECT e.source_id, a.name AS source_name, e.target_id, b.name AS target_name, f.path AS target_path, e.kind AS edge_kind FROM edges e JOIN symbols a ON a.id = e.source_id JOIN symbols b ON b.id = e.target_id JOIN files f ON f.id = b.file_id")
def join_edges_2hop(g: Graph) -> DataFrame:
    a = g.symbols.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    b = G.with_files(g.symbols, g.file_refs).select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.col("path").alias("target_path"))
    return g.edges.join(a, "source_id").join(b, "target_id").select("source_id", "source_name", "target_id", "target_name", "target_path", F.col("kind").alias("edge_kind"))


@query(
    """SELECT * EXCLUDE (r) FROM (SELECT e.source_id AS of_id, s.id, s.name, CAST(row_number() OVER (PARTITION BY e.source_id ORDER BY s.name, s.id) AS INTEGER) AS r, r AS rank
    FROM calls e JOIN symbols s ON s.id = e.target_id) WHERE rank <= 20"""
)
def limit_neighbours(g: Graph) -> DataFrame:
    every = g.calls.select(F.col("source_id").alias("id")).distinct()
    return G.neighbours(g.symbols, g.file_refs, g.calls, every, "downstream").select("of_id", "id", "name", "rank")


@query("SELECT s.id, s.name, s.kind, f.path, s.start_line FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.id NOT IN (SELECT source_id FROM calls UNION SELECT target_id FROM calls)")
def anti_orphans(g: Graph) -> DataFrame:
    return G.orphans(g.symbols, g.file_refs, g.calls)


@query("SELECT kind, count(*) AS orphans FROM symbols WHERE id NOT IN (SELECT source_id FROM calls UNION SELECT target_id FROM calls) GROUP BY kind")
def orphans(g: Graph) -> DataFrame:
    return G.orphans(g.symbols, g.file_refs, g.calls).groupBy("kind").agg(F.count("*").alias("orphans"))


@query("SELECT s.id, s.name, s.kind FROM symbols s WHERE s.id IN (SELECT source_id FROM looped WHERE source_id = target_id)", "looped AS (SELECT source_id, target_id FROM calls UNION ALL SELECT id, id FROM symbols WHERE id % 50 = 0)")
def self_loops(g: Graph) -> DataFrame:
    """Symbols that call themselves; every fiftieth is made to."""
    looped = g.calls.select("source_id", "target_id").union(g.symbols.where("id % 50 = 0").select("id", "id"))
    return G.self_loops(g.symbols, looped)


_PAIR = """
pair AS (SELECT target_id AS id, row_number() OVER (ORDER BY target_id) AS r FROM (SELECT DISTINCT target_id FROM calls JOIN top ON top.id = source_id) QUALIFY r <= 2)"""
_SHARED = "SELECT source_id AS id FROM calls WHERE target_id IN (SELECT id FROM pair WHERE r = 1) INTERSECT SELECT source_id FROM calls WHERE target_id IN (SELECT id FROM pair WHERE r = 2)"


def _pair(g: Graph, rank: int) -> DataFrame:
    """(id) of the first or second symbol that the one with most calls calls."""
    met = g.calls.join(F.broadcast(G.most_connected(g.calls).withColumnRenamed("id", "source_id")), "source_id").select(F.col("target_id").alias("id")).distinct()
    return met.orderBy("id").limit(rank).orderBy(F.desc("id")).limit(1)


@query(_SHARED, f"{_TOP},{_PAIR}")
def set_intersect(g: Graph) -> DataFrame:
    return G.shared_callers(g.calls, _pair(g, 1), _pair(g, 2))


@query(
    """SELECT c.source_id, count(DISTINCT c.target_id) AS met FROM calls c JOIN symbols t ON t.id = c.target_id
    WHERE t.name IN (SELECT name FROM symbols s JOIN two ON two.id = s.id) GROUP BY 1 HAVING count(DISTINCT CASE WHEN t.name = (SELECT name FROM symbols s JOIN two ON two.id = s.id AND r = 1) THEN 1 END) = 1
      AND count(DISTINCT CASE WHEN t.name = (SELECT name FROM symbols s JOIN two ON two.id = s.id AND r = 2) THEN 1 END) = 1""",
    _TWO,
)
def semi_shared_callers(g: Graph) -> DataFrame:
    """Callers of any symbol of one name and of any of another, with how many of those they call: one pass over the calls, no pairs."""
    two = g.calls.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(2)
    ranked = two.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "id")))  # two rows
    names = g.symbols.join(F.broadcast(ranked.select("id", "r")), "id").select("name", "r")
    asked = g.symbols.join(F.broadcast(names), "name").select(F.col("id").alias("target_id"), "r")
    met = g.calls.select("source_id", "target_id").join(asked, "target_id").groupBy("source_id").agg(F.countDistinct("target_id").alias("met"), F.countDistinct("r").alias("names"))
    return met.where("names = 2").select("source_id", "met")


@query(f"SELECT id, name FROM symbols WHERE id IN ({_SHARED})", f"{_TOP},{_PAIR}")
def shared_callers(g: Graph) -> DataFrame:
    return G.shared_callers(g.calls, _pair(g, 1), _pair(g, 2)).join(g.symbols, "id").select("id", "name")


@query("SELECT count(*) > 0 AS path_exists FROM edges WHERE source_id IN (SELECT id FROM top) AND target_id IN (SELECT id FROM two WHERE r = 1)", f"{_TOP},{_TWO}")
def path_1hop(g: Graph) -> DataFrame:
    return G.path_exists(g.edges, G.most_connected(g.edges), _called(g, 1))


@query("SELECT a.name AS first_name, b.name AS second_name, count(*) AS edges FROM edges e JOIN symbols a ON a.id = e.source_id JOIN symbols b ON b.id = e.target_id GROUP BY 1, 2")
def self_path_1hop(g: Graph) -> DataFrame:
    """Which names any edge leads from and to."""
    a, b = (g.symbols.select(F.col("id").alias(k), F.col("name").alias(n)) for k, n in (("source_id", "first_name"), ("target_id", "second_name")))
    return g.edges.join(a, "source_id").join(b, "target_id").groupBy("first_name", "second_name").agg(F.count("*").alias("edges"))


@query("SELECT count(*) > 0 AS path_exists FROM walk WHERE id IN (SELECT id FROM two WHERE r = 1)", f"{_TOP},{_TWO},{_TRACE}")
def path_khop(g: Graph) -> DataFrame:
    return G.path_exists(g.stored_edges, G.most_connected(g.stored_edges), _called(g, 1), hops=4)


@query(
    """SELECT s.id, coalesce(d.degree, 0) AS degree, round(coalesce(d.degree, 0) / (SELECT count(*) - 1 FROM symbols), 9) AS centrality
    FROM symbols s LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id) d ON d.id = s.id"""
)
def centrality(g: Graph) -> DataFrame:
    return G.degree_centrality(g.symbols, g.edges).select("id", "degree", F.round("centrality", 9).alias("centrality"))


# ---------------------------------------------------------------- names and places


@query("SELECT s.id, f.path, s.start_line FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name IN (SELECT name FROM common)", _COMMON)
def sym_by_name(g: Graph) -> DataFrame:
    return G.with_files(_named(g), g.file_refs).select("id", "path", "start_line")


@query("SELECT name, count(*) AS definitions, count(*) > 1 AS ambiguous FROM symbols GROUP BY name")
def sym_count_by_name(g: Graph) -> DataFrame:
    return g.symbols.groupBy("name").agg(F.count("*").alias("definitions")).withColumn("ambiguous", F.col("definitions") > 1)


@query("SELECT s.name, min(s.id) AS id FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.path ILIKE '%/EN/%' GROUP BY s.name")
def sym_by_name_file(g: Graph) -> DataFrame:
    return G.with_files(g.symbols, g.file_refs.where(S.like_any_case(F.col("path"), "%/EN/%"))).groupBy("name").agg(F.min("id").alias("id"))


_DIR = """
dir AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' AS prefix FROM files GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""


def _dir(g: Graph) -> DataFrame:
    """The directory with most files; one row."""
    by = g.file_refs.groupBy(F.concat(S.parent_dir(F.col("path")), F.lit("/")).alias("prefix")).agg(F.count("*").alias("n"))
    return by.orderBy(F.desc("n"), "prefix").limit(1).select("prefix")


@query("SELECT s.id, s.name, s.kind, f.path, s.start_line, 1.0::DOUBLE AS relevance FROM symbols s JOIN files f ON f.id = s.file_id JOIN dir ON starts_with(f.path, dir.prefix) ORDER BY f.path, s.start_line, s.id LIMIT 100", _DIR)
def outline(g: Graph) -> DataFrame:
    at = g.file_refs.join(F.broadcast(_dir(g)), F.col("path").startswith(F.col("prefix")))
    return G.with_files(g.symbols, at).orderBy("path", "start_line", "id").limit(100).select("id", "name", "kind", "path", "start_line", F.lit(1.0).alias("relevance"))


@query("SELECT s.id, s.name, s.kind, f.path, s.start_line, 0.8::DOUBLE AS relevance FROM symbols s JOIN files f ON f.id = s.file_id WHERE contains(f.path, '/de/') ORDER BY length(f.path), s.start_line, f.path, s.id LIMIT 100")
def outline_fuzzy(g: Graph) -> DataFrame:
    at = G.with_files(g.symbols, g.file_refs.where(F.contains("path", F.lit("/de/"))))
    return at.orderBy(F.length("path"), "start_line", "path", "id").limit(100).select("id", "name", "kind", "path", "start_line", F.lit(0.8).alias("relevance"))


@query("SELECT id, name, kind FROM symbols WHERE kind IN (SELECT kind FROM symbols GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)")
def filter_kind(g: Graph) -> DataFrame:
    kind = g.symbols.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(1).select("kind")
    return g.symbols.join(F.broadcast(kind), "kind").select("id", "name", "kind")


@query("SELECT symbol_id FROM vectors WHERE symbol_id IN (SELECT target_id FROM calls)")
def filter_in_list(g: Graph) -> DataFrame:
    return g.vectors.select("symbol_id").join(g.calls.select(F.col("target_id").alias("symbol_id")), "symbol_id", "left_semi")


@query("SELECT id, code FROM constraints WHERE code ILIKE 'NATION_%'")
def filter_hint(g: Graph) -> DataFrame:
    """Codes of one kind; ``_`` is any character, as in LIKE."""
    return g.constraints.where(S.like_any_case(F.col("code"), "NATION_%")).select("id", "code")


@query("SELECT d.id, s.id AS symbol_id FROM decisions d, symbols s WHERE s.id IN (SELECT id FROM top) AND list_contains(d.functions, s.qualified_name)", _TOP)
def filter_mentions(g: Graph) -> DataFrame:
    name = F.broadcast(g.symbols.join(G.most_connected(g.edges), "id").select(F.col("id").alias("symbol_id"), "qualified_name"))
    return g.decisions.join(name, F.array_contains("functions", F.col("qualified_name"))).select("id", "symbol_id")


#: Call names that say nothing about a program.
NOISE = (
    "new clone fmt from into default drop len is_empty iter map filter unwrap expect ok err some none push pop get insert remove to_string as_str send recv lock read write flush close open parse format print println then catch resolve append extend update keys values items copy"
).split()
_NOISE_SQL = ", ".join(f"'{w}'" for w in NOISE)


@query(f"SELECT word, count(*) AS calls FROM (SELECT lower(unnest(string_split(p_name, ' '))) AS word FROM part) WHERE word NOT IN ({_NOISE_SQL}) AND strlen(word) >= 3 GROUP BY word")
def filter_noise(g: Graph) -> DataFrame:
    words = g.raw("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return words.where(~F.col("word").isin(NOISE) & (F.octet_length("word") >= 3)).groupBy("word").agg(F.count("*").alias("calls"))


@query("SELECT source_id, target_id FROM edges WHERE kind = 'DI_INJECT'")
def filter_di(g: Graph) -> DataFrame:
    return g.edges.where(F.col("kind").isin("DI_INJECT")).select("source_id", "target_id")


@query("SELECT id, path, size_bytes FROM files WHERE size_bytes <= 1000000 AND NOT regexp_matches(path, '[.](min[.]js|min[.]css|map|svg)$')")
def filter_minified(g: Graph) -> DataFrame:
    return g.files.where((F.col("size_bytes") <= 1_000_000) & ~F.col("path").rlike(r"\.(min\.js|min\.css|map|svg)$")).select("id", "path", "size_bytes")


@query("SELECT id, path FROM files WHERE regexp_matches(path, '^src1[^/]*/[^/]*/[^/]*$')")
def filter_glob(g: Graph) -> DataFrame:
    from loomgraph.sources.scan import glob_pattern

    return g.file_refs.where(F.col("path").rlike(glob_pattern("src1*/*/*"))).select("id", "path")


@query("SELECT s.id, s.name, f.path, f.lang FROM symbols s JOIN files f ON f.id = s.file_id")
def join_symbol_file(g: Graph) -> DataFrame:
    return g.symbols.join(g.file_refs.select(F.col("id").alias("file_id"), "path", "lang"), "file_id").select("id", "name", "path", "lang")


@query("SELECT id, name FROM symbols WHERE id NOT IN (SELECT symbol_id FROM vectors)")
def anti_missing_embedding(g: Graph) -> DataFrame:
    return g.symbols.join(g.vectors.select(F.col("symbol_id").alias("id")), "id", "left_anti").select("id", "name")


_UNRESOLVED = """
unresolved AS (SELECT e.source_id, t.name AS target_name, e.kind, s.file_id FROM edges e JOIN symbols t ON t.id = e.target_id JOIN symbols s ON s.id = e.source_id)"""


def _unresolved(g: Graph) -> DataFrame:
    names = g.symbols.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    return g.edges.join(names, "target_id").join(g.symbols.select(F.col("id").alias("source_id"), "file_id"), "source_id").select("source_id", "target_name", "kind", "file_id")


@query("SELECT DISTINCT u.source_id, n.id AS target_id, u.kind, 'name_match' AS confidence FROM unresolved u JOIN (SELECT name, min(id) AS id FROM symbols GROUP BY name) n ON n.name = u.target_name", _UNRESOLVED)
def join_resolve_names(g: Graph) -> DataFrame:
    return G.resolve_names(_unresolved(g), g.symbols)


@query(
    "SELECT DISTINCT u.source_id, n.id AS target_id, u.kind, 'exact' AS confidence FROM unresolved u JOIN (SELECT file_id, name, max(id) AS id FROM symbols GROUP BY 1, 2) n ON n.name = u.target_name AND n.file_id = u.file_id WHERE u.source_id <> n.id",
    _UNRESOLVED,
)
def join_resolve_local(g: Graph) -> DataFrame:
    return G.resolve_local(_unresolved(g), g.symbols)


_PLACES = """
places AS (SELECT event_id AS place_id, event_id % (SELECT count(*) FROM documents) AS file_id, user_id % 100 AS line FROM events)"""


def _places(g: Graph) -> DataFrame:
    n = g.raw("documents").agg(F.count("*").alias("n"))
    return g.raw("events").crossJoin(F.broadcast(n)).select(F.col("event_id").alias("place_id"), (F.col("event_id") % F.col("n")).alias("file_id"), (F.col("user_id") % 100).alias("line"))


@query(
    """SELECT p.place_id, p.file_id, p.line, coalesce(i.id, f.id) AS symbol_id, i.id IS NOT NULL AS enclosed FROM places p
    JOIN (SELECT file_id, arg_min(id, (start_line, id)) AS id FROM symbols GROUP BY file_id) f ON f.file_id = p.file_id
    LEFT JOIN (SELECT p.place_id, arg_min(s.id, (s.end_line - s.start_line, s.id)) AS id FROM places p JOIN symbols s ON s.file_id = p.file_id AND p.line BETWEEN s.start_line AND s.end_line GROUP BY 1) i ON i.place_id = p.place_id""",
    _PLACES,
)
def range_enclosing(g: Graph) -> DataFrame:
    return G.enclosing(_places(g), g.symbols)


@query(
    """SELECT place_id, id AS symbol_id FROM (SELECT p.place_id, s.id, row_number() OVER (PARTITION BY p.place_id ORDER BY s.end_line - s.start_line, s.id) AS r
    FROM places p JOIN symbols s ON s.file_id = p.file_id AND p.line BETWEEN s.start_line AND s.end_line) WHERE r = 1""",
    _PLACES,
)
def win_innermost(g: Graph) -> DataFrame:
    return G.enclosing(_places(g), g.symbols).where("enclosed").select("place_id", "symbol_id")


@query("SELECT name, min(id) AS id FROM symbols GROUP BY name")
def win_first_by_name(g: Graph) -> DataFrame:
    return g.symbols.groupBy("name").agg(F.min("id").alias("id"))


@query("SELECT file_id, name, max(id) AS id FROM symbols GROUP BY file_id, name")
def win_last_local(g: Graph) -> DataFrame:
    return g.symbols.groupBy("file_id", "name").agg(F.max("id").alias("id"))


@query("SELECT DISTINCT name, kind FROM symbols")
def set_distinct(g: Graph) -> DataFrame:
    return g.symbols.select("name", "kind").distinct()


# ---------------------------------------------------------------- incremental index

_SCANS = """
before AS (SELECT id, path, content_hash FROM files WHERE id % 7 <> 0),
now AS (SELECT id, path, CASE WHEN id % 5 = 0 THEN md5(content_hash) ELSE content_hash END AS content_hash FROM files WHERE id % 11 <> 0)"""


def _scans(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Two states of the files: the second lacks some of the first, has others, and changed some."""
    rows = g.files.select("id", "path", "content_hash")
    other = F.when(F.col("id") % 5 == 0, F.md5(F.col("content_hash").cast("binary"))).otherwise(F.col("content_hash"))
    return rows.where(F.col("id") % 7 != 0), rows.where(F.col("id") % 11 != 0).withColumn("content_hash", other)


@query("SELECT n.id, n.path, CASE WHEN b.path IS NULL THEN 'new' ELSE 'changed' END AS state FROM now n LEFT JOIN before b ON b.path = n.path WHERE b.path IS NULL OR b.content_hash <> n.content_hash", _SCANS)
def join_changed_files(g: Graph) -> DataFrame:
    return K.changed_files(*_scans(g)).select("id", "path", "state")


@query("SELECT path FROM before WHERE path NOT IN (SELECT path FROM now)", _SCANS)
def anti_deleted_files(g: Graph) -> DataFrame:
    return K.deleted_files(*_scans(g))


@query("SELECT path FROM before EXCEPT SELECT path FROM now", _SCANS)
def set_except(g: Graph) -> DataFrame:
    before, now = _scans(g)
    return before.select("path").subtract(now.select("path"))


@query("SELECT coalesce(n.path, b.path) AS path, coalesce(n.id, b.id) AS id, coalesce(n.content_hash, b.content_hash) AS content_hash FROM before b FULL JOIN now n ON n.path = b.path", _SCANS)
def sink_upsert_files(g: Graph) -> DataFrame:
    before, now = _scans(g)
    return K.upserted(before, now, "path")


@query(
    """SELECT (SELECT count(*) FROM now) AS files_total, (SELECT count(*) FROM now n LEFT JOIN before b ON b.path = n.path WHERE b.path IS NULL OR b.content_hash <> n.content_hash) AS files_indexed,
    (SELECT count(*) FROM before WHERE path NOT IN (SELECT path FROM now)) AS files_deleted, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges""",
    _SCANS,
)
def agg_index_stats(g: Graph) -> DataFrame:
    before, now = _scans(g)
    return K.table_counts({"files_total": now, "files_indexed": K.changed_files(before, now), "files_deleted": K.deleted_files(before, now), "symbols": g.symbols, "edges": g.edges})


@query(
    "SELECT source_id, target_id, kind FROM edges WHERE source_id NOT IN (SELECT id FROM dead) AND target_id NOT IN (SELECT id FROM dead)",
    f"{_SCANS},\ngone AS (SELECT id FROM before WHERE path NOT IN (SELECT path FROM now)), dead AS (SELECT id FROM symbols WHERE file_id IN (SELECT id FROM gone))",
)
def del_cascade(g: Graph) -> DataFrame:
    before, now = _scans(g)
    gone = K.deleted_files(before, now).join(before, "path").select("id")
    return K.without_files(gone, before, g.symbols, g.edges)["edges"]


@query(
    """SELECT DISTINCT t.target, c.path FROM (SELECT n.path FROM now n JOIN before b ON b.path = n.path WHERE b.content_hash <> n.content_hash) c
    JOIN asked t ON contains(c.path, t.target) OR contains(t.target, c.path)""",
    f"{_SCANS},\nasked AS (SELECT min(path) AS target FROM files UNION SELECT 'root/' || path FROM files WHERE id IN (5, 10, 16, 20) UNION SELECT '/' || lang || '/' FROM files WHERE id < 40)",
)
def stale_join(g: Graph) -> DataFrame:
    """Changed paths that hold a target that is asked about (a path, a folder of it), or that it holds."""
    files = g.file_refs
    asked = files.agg(F.min("path").alias("target")).union(files.where("id in (5, 10, 16, 20)").select(F.concat(F.lit("root/"), "path"))).union(files.where("id < 40").select(F.concat(F.lit("/"), "lang", F.lit("/"))))
    return K.stale(K.changed_files(*_scans(g)).where("state = 'changed'"), asked.distinct())


# ---------------------------------------------------------------- extraction, over sources written from the tables

_SOURCES = """
blocks AS (SELECT s.file_id, s.id, s.qualified_name AS name, coalesce(c.n, 0) AS n FROM symbols s LEFT JOIN (SELECT source_id, count(*) AS n FROM calls GROUP BY 1) c ON c.source_id = s.id),
spans AS (SELECT file_id, id, name, CAST(1 + sum(n + 2) OVER (PARTITION BY file_id ORDER BY id ROWS UNBOUNDED PRECEDING) - (n + 2) AS BIGINT) AS start_line, CAST(sum(n + 2) OVER (PARTITION BY file_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_line FROM blocks)"""


def _sources(g: Graph) -> DataFrame:
    """Each file as Python source: a function for every symbol of it, with a line for every call."""
    names = g.symbols.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("callee"))
    called = g.calls.join(names, "target_id").groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("    "), "callee", F.lit("()\n")))), "").alias("body"))
    block = F.concat(F.lit("def "), "qualified_name", F.lit("():\n"), F.coalesce("body", F.lit("")), F.lit("    return 1\n"))
    written = g.symbols.join(called, "id", "left").groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", block.alias("text")))), lambda b: b["text"]), "").alias("text"))
    return written.join(g.file_refs.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", F.lit("python").alias("lang"), "text", F.md5(F.col("text").cast("binary")).alias("content_hash"))


@query("SELECT f.path, s.name, 'function' AS kind, s.start_line, s.end_line FROM spans s JOIN files f ON f.id = s.file_id", _SOURCES)
def extract_symbols(g: Graph) -> DataFrame:
    from loomgraph.sources import extract

    return extract.symbols_of(_sources(g)).select("path", "name", "kind", "start_line", "end_line")


@query("SELECT f.path, t.qualified_name AS callee, 'CALLS' AS edge_kind, count(*) AS sites FROM calls c JOIN symbols s ON s.id = c.source_id JOIN symbols t ON t.id = c.target_id JOIN files f ON f.id = s.file_id GROUP BY 1, 2", _SOURCES)
def extract_calls(g: Graph) -> DataFrame:
    from loomgraph.sources import extract

    return extract.calls_of(_sources(g)).groupBy("path", "callee", "edge_kind").agg(F.count("*").alias("sites"))


@query("SELECT s.qualified_name AS source, t.qualified_name AS target, 'CALLS' AS kind, CASE WHEN s.file_id = t.file_id THEN 'exact' ELSE 'name_match' END AS confidence FROM calls c JOIN symbols s ON s.id = c.source_id JOIN symbols t ON t.id = c.target_id WHERE s.id <> t.id")
def st_incremental_index(g: Graph) -> DataFrame:
    """The index job from sources to edges, in two runs: a part of the files first, then all."""
    from loomgraph.jobs import index

    files = _sources(g)
    first = index.build(files.where(F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(3)) != 0))
    out = index.build(files, first)
    a, b = (out.symbols.select(F.col("id").alias(k), F.col("name").alias(n)) for k, n in (("source_id", "source"), ("target_id", "target")))
    return out.edges.join(a, "source_id").join(b, "target_id").select("source", "target", "kind", "confidence")


@query("SELECT s.qualified_name AS source, t.qualified_name AS target, 'CALLS' AS kind, CASE WHEN s.file_id = t.file_id THEN 'exact' ELSE 'name_match' END AS confidence FROM calls c JOIN symbols s ON s.id = c.source_id JOIN symbols t ON t.id = c.target_id WHERE s.id <> t.id AND s.file_id % 7 <> 3 AND t.file_id % 7 <> 3")
def st_stored_index(g: Graph) -> DataFrame:
    """The stored index after three batches: two thirds of the files; the rest, with a fifth of the others emptied; those as they were, and a seventh of all gone."""
    from loomgraph.jobs import index
    from loomgraph.sources.tables import scratch

    files = checkpointed(_sources(g).join(g.file_refs.select("path", F.col("id").alias("file_id")), "path"))
    stored = index.StoredIndex(g.spark, scratch(g.spark, "index"))
    columns, part = ["path", "lang", "content_hash", "text"], F.col("file_id") % 3 != 0
    emptied, gone = part & (F.col("file_id") % 5 == 1), F.col("file_id") % 7 == 3
    stored.apply(files.where(part).select(columns), 0)
    stored.apply(files.where(emptied | ~part).withColumn("text", F.when(emptied, F.lit("")).otherwise(F.col("text"))).withColumn("content_hash", F.md5("text")).select(columns), 1)
    stored.apply(files.where(emptied | gone).withColumn("text", F.when(~gone, F.col("text"))).select(columns), 2)
    a, b = (stored.symbols().select(F.col("id").alias(k), F.col("name").alias(n)) for k, n in (("source_id", "source"), ("target_id", "target")))
    return stored.edges.join(a, "source_id").join(b, "target_id").select("source", "target", "kind", "confidence")


# ---------------------------------------------------------------- other languages: each file in one of twelve, with decoys in comments and strings

#: Language: comment with a decoy, first line, line with a decoy in a string, call, last line, kind; {0} is a name.
_WRITTEN: dict[str, tuple[str, str, str, str, str, str]] = {
    "rust": ("/* fn no_{0}() { /* } */ */", "fn {0}() {", '    let s = r#"fn fake() { " "#; // {', "    {0}();", "} // */", "function"),
    "typescript": ("// function no_{0}() {", "export async function {0}(): Promise<void> {", "    const s = `function fake() {`; const r = /\\{\"/;", "    {0}();", "}", "function"),
    "tsx": ("/* function no_{0}() { */", "function {0}() {", "    const s = 'class Fake {';", "    {0}();", "}", "function"),
    "go": ("// func no_{0}() {", "func {0}() {", "    s := `func fake() {`", "    {0}()", "}", "function"),
    "c": ("#define NO_{0}(x) int no_{0}(void) {", "static int {0}(void) {", '    char c = \'{\'; const char *s = "int fake(void) {";', "    {0}();", "}", "function"),
    "cpp": ("// class no_{0} {", "int {0}() noexcept {", '    auto s = R"x(int fake() { )x";', "    {0}();", "}", "function"),
    "php": ("<?php # function no_{0}() {", "function {0}() {", '    $s = "function fake() {";', "    {0}();", "}", "function"),
    "kotlin": ("/* fun no_{0}() { /* } */ */", "fun {0}(): Int {", '    val s = """fun fake() { """', "    {0}()", "}", "function"),
    "swift": ("// func no_{0}() {", "func {0}() {", '    let s = "func fake() {"', "    {0}()", "}", "function"),
    "ruby": ("# def no_{0}", "def {0}", '    s = "def fake" if busy', "    {0}()", "end", "method"),
    "lua": ("--[[ function no_{0}() ]]", "local function {0}()", "    local s = [[function fake()]]", "    {0}()", "end", "function"),
    "dart": ("/* void no_{0}() { */", "void {0}() {", "    var s = 'void fake() {';", "    {0}();", "}", "function"),
}
_WRITTEN_SQL = (
    "kinds AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{lang}', '{w[-1]}')" for k, (lang, w) in enumerate(_WRITTEN.items())) + f") k(k, lang, kind)), {_SOURCES.strip()},\n"
    f"written AS (SELECT s.file_id, f.path, k.lang, k.kind, s.name, s.start_line + 2 * (row_number() OVER (PARTITION BY s.file_id ORDER BY s.id) - 1) + 1 AS start_line, s.n FROM (SELECT spans.*, blocks.n FROM spans JOIN blocks USING (id)) s JOIN files f ON f.id = s.file_id JOIN kinds k ON k.k = s.file_id % {len(_WRITTEN)})"
)


def _foreign_sources(g: Graph) -> DataFrame:
    """As ``_sources``, in the language that a file's number picks; each symbol has a comment and a string that define nothing."""
    which = F.col("file_id") % len(_WRITTEN)

    def line(at: int, name: str | None = None):
        texts = F.element_at(F.array(*[F.lit(w[at]) for w in _WRITTEN.values()]), (which + 1).cast("int"))
        return F.replace(texts, F.lit("{0}"), F.col(name)) if name else texts

    names = g.symbols.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("callee"))
    called = g.calls.join(names, "target_id").groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list("callee")).alias("callees"))
    rows = g.symbols.join(called, "id", "left")
    calls = F.transform(F.coalesce("callees", F.array().cast("array<string>")), lambda c: F.replace(line(3), F.lit("{0}"), c))
    block = F.array_join(F.concat(F.array(line(0, "qualified_name"), line(1, "qualified_name"), line(2)), calls, F.array(line(4))), "\n")
    written = rows.withColumn("block", block).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "block"))), lambda b: b["block"]), "\n").alias("text"))
    lang = F.element_at(F.array(*[F.lit(k) for k in _WRITTEN]), (which + 1).cast("int"))
    return written.join(g.file_refs.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", lang.alias("lang"), "text", F.md5("text").alias("content_hash"))


@query("SELECT path, name, kind, start_line, start_line + n + 2 AS end_line FROM written", _WRITTEN_SQL)
def extract_symbols_languages(g: Graph) -> DataFrame:
    from loomgraph.sources import extract

    return extract.symbols_of(_foreign_sources(g)).select("path", "name", "kind", "start_line", "end_line")


@query("SELECT f.path, t.qualified_name AS callee, 'CALLS' AS edge_kind, count(*) AS sites FROM calls c JOIN symbols s ON s.id = c.source_id JOIN symbols t ON t.id = c.target_id JOIN files f ON f.id = s.file_id GROUP BY 1, 2", _SOURCES)
def extract_calls_languages(g: Graph) -> DataFrame:
    from loomgraph.sources import extract

    return extract.calls_of(_foreign_sources(g)).groupBy("path", "callee", "edge_kind").agg(F.count("*").alias("sites"))


@query("SELECT path, lang, 'SyntaxError' AS error, start_line + n + 2 AS line FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_line DESC) AS last FROM written) WHERE last = 1 AND lang NOT IN ('ruby', 'lua')", _WRITTEN_SQL)
def extract_errors(g: Graph) -> DataFrame:
    """Files that close one bracket more than they open, on their last line; in Ruby and Lua a word closes, so they don't."""
    from loomgraph.sources import extract

    broken = _foreign_sources(g).where(~F.col("lang").isin("ruby", "lua")).withColumn("text", F.regexp_replace("text", r"\}( // \*/)?$", "}}"))
    return extract.errors_in(extract.parsed(broken)).select("path", "lang", "error", "line")


@query(
    """SELECT d.id, t.id IS NOT NULL OR x.id IS NOT NULL AS validated, CASE WHEN t.id IS NOT NULL THEN 'index' WHEN x.id IS NOT NULL THEN 'text' END AS validated_by FROM decisions d
    LEFT JOIN (SELECT DISTINCT f.id FROM asked f JOIN symbols s ON s.qualified_name = f.function WHERE s.name > 'c') t ON t.id = d.id
    LEFT JOIN (SELECT DISTINCT f.id FROM asked f JOIN (SELECT function FROM (SELECT DISTINCT function FROM asked) a WHERE EXISTS (SELECT 1 FROM written w WHERE contains(w.name, a.function))) USING (function)) x ON x.id = d.id""",
    """asked AS (SELECT id, unnest(functions) AS function FROM decisions),
here AS (SELECT id, qualified_name AS name FROM symbols WHERE file_id % 3 = 0),
written AS (SELECT name FROM here UNION SELECT t.qualified_name FROM here JOIN calls c ON c.source_id = here.id JOIN symbols t ON t.id = c.target_id)""",
)
def ins_decision_text(g: Graph) -> DataFrame:
    """Decisions whose functions an index of some symbols knows, or else stand in one of a third of the sources."""
    known = g.symbols.where("name > 'c'").select(F.col("qualified_name").alias("name"))
    third = g.file_refs.where("id % 3 = 0").select("path")
    return K.validated(g.decisions, known, _sources(g).join(third, "path", "left_semi").select("path", "text")).select("id", "validated", "validated_by")


@query("SELECT s.id, s.name, f.path, '' AS content_hash, s.name_tokens, 0.0::DOUBLE AS centrality, count(e.target_id) AS calls, 2 AS schema, 2 AS version FROM symbols s JOIN files f ON f.id = s.file_id LEFT JOIN calls e ON e.source_id = s.id GROUP BY ALL")
def open_store(g: Graph) -> DataFrame:
    """A store written by the first schema, without hashes, words of names and centrality, is opened and taken over."""
    from loomgraph.sources import graph_store
    from loomgraph.sources.store import Store, Table
    from loomgraph.sources.tables import scratch

    path = scratch(g.spark, "store")
    old = {"files": Table("id long, path string, lang string, size_bytes long, line_count long", "path"), "symbols": Table("id long, file_id long, name string, qualified_name string, kind string, start_line long, end_line long, signature string, doc string", "id"), "edges": Table("source_id long, target_id long, kind string", "source_id")}
    tables = {"files": g.files, "symbols": g.symbols, "edges": g.edges}
    Store(g.spark, path, old, 1).commit({k: checkpointed(rows.select(*[c.split(" ")[0] for c in old[k].schema.split(", ")])) for k, rows in tables.items()})
    s = graph_store.GraphStore(g.spark, path, create=False)
    calls = s.calls.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("calls"))
    rows = s.symbols.join(s.files.select(F.col("id").alias("file_id"), "path", "content_hash"), "file_id").join(calls, "id", "left")
    return rows.select("id", "name", "path", "content_hash", "name_tokens", "centrality", F.coalesce("calls", F.lit(0)).alias("calls"), F.lit(s.store.last["schema"]).alias("schema"), F.lit(s.store.version).alias("version"))
