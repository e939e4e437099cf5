"""Knowledge-layer queries: catalogues, scores, decisions, updates, telemetry."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.jobs.catalogue import query
from loomgraph.operators import graph as G
from loomgraph.operators import knowledge as K
from loomgraph.sources.views import Graph
from loomgraph.streaming import events as E
from loomgraph.streaming import pool as P
from loomgraph.streaming import telemetry as T

_CATALOG = """SELECT d.name, coalesce(s.n, 0) AS symbol_count, coalesce(c.n, 0) AS constraint_count FROM domains d
LEFT JOIN (SELECT domain, count(DISTINCT symbol_id) AS n FROM domain_symbols GROUP BY 1) s ON s.domain = d.name
LEFT JOIN (SELECT domain, count(DISTINCT id) AS n FROM constraints GROUP BY 1) c ON c.domain = d.name"""


@query(_CATALOG)
def left_join_catalog(g: Graph) -> DataFrame:
    return K.catalog(g.domains, g.domain_symbols, g.constraints)


@query("SELECT domain, count(DISTINCT symbol_id) AS symbol_count, count(DISTINCT symbol_name) AS name_count FROM domain_symbols GROUP BY domain")
def agg_catalog(g: Graph) -> DataFrame:
    return g.domain_symbols.groupBy("domain").agg(F.countDistinct("symbol_id").alias("symbol_count"), F.countDistinct("symbol_name").alias("name_count"))


_LINKS = """
links AS (SELECT domain, CASE WHEN symbol_id % 3 = 0 THEN NULL ELSE symbol_id END AS symbol_id, symbol_name FROM domain_symbols)"""


def _links(g: Graph) -> DataFrame:
    """Links of which a third were made before their symbol was known: they have its name only."""
    return g.domain_symbols.withColumn("symbol_id", F.when(F.col("symbol_id") % 3 != 0, F.col("symbol_id")))


@query("SELECT DISTINCT s.id, c.code FROM symbols s JOIN links l ON l.symbol_id = s.id OR l.symbol_name = s.name JOIN constraints c ON c.domain = l.domain", _LINKS)
def inner_join_or(g: Graph) -> DataFrame:
    """Rules of every symbol, by domains linked to its id or to its name."""
    return K.rules_of(g.symbols, _links(g), g.constraints)


@query(
    """SELECT DISTINCT c.code, c.severity, c.statement FROM constraints c LEFT JOIN links l ON l.domain = c.domain
    WHERE l.symbol_id IN (SELECT id FROM top) OR l.symbol_name IN (SELECT name FROM symbols WHERE id IN (SELECT id FROM top)) OR c.code LIKE 'NATION\\_U%' ESCAPE '\\'""",
    f"{_LINKS},\ntop AS (SELECT source_id AS id FROM calls GROUP BY 1 ORDER BY count(*) DESC, source_id LIMIT 1)",
)
def left_join_or(g: Graph) -> DataFrame:
    """Rules of the domains that a symbol belongs to by id or name, and those with a code that always counts."""
    asked = g.symbols.join(F.broadcast(G.most_connected(g.edges)), "id")
    codes = K.rules_of(asked, _links(g), g.constraints).select("code", F.lit(True).alias("linked")).distinct()
    rows = g.constraints.join(codes, "code", "left").where(F.col("linked") | F.col("code").startswith("NATION_U"))
    return rows.select("code", "severity", "statement").distinct()


_COUNTS = "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM domains) AS domains, (SELECT count(*) FROM constraints) AS constraints, (SELECT count(*) FROM decisions) AS decisions"


def _counts(g: Graph) -> DataFrame:
    return K.table_counts({"files": g.file_refs, "symbols": g.symbols, "edges": g.edges, "domains": g.domains, "constraints": g.constraints, "decisions": g.decisions})


@query(_COUNTS)
def agg_table_counts(g: Graph) -> DataFrame:
    return _counts(g)


_SCORE = f"SELECT *, CAST(CASE WHEN domains > 0 THEN 25 ELSE 0 END + CASE WHEN constraints > 0 THEN 25 ELSE 0 END + CASE WHEN decisions > 0 THEN 25 ELSE 0 END AS INTEGER) AS layer_score FROM ({_COUNTS})"


@query(f"SELECT layer_score, layer_score < 50 AS needs_knowledge FROM ({_SCORE})")
def agg_knowledge_score(g: Graph) -> DataFrame:
    return K.knowledge_score(_counts(g), ("domains", "constraints", "decisions")).select("layer_score", "needs_knowledge")


@query(f"SELECT symbols, CASE WHEN symbols = 0 THEN 'empty' WHEN layer_score >= 75 THEN 'healthy' WHEN layer_score >= 40 THEN 'partial' ELSE 'sparse' END AS status FROM ({_SCORE})")
def agg_health_status(g: Graph) -> DataFrame:
    return K.knowledge_score(_counts(g), ("domains", "constraints", "decisions")).select("symbols", "status")


@query(
    """SELECT d.name, coalesce(s.symbols, '') AS symbols, coalesce(c.codes, '') AS codes, coalesce(n.newest, '') AS newest FROM domains d
    LEFT JOIN (SELECT domain, string_agg(DISTINCT symbol_name, ',' ORDER BY symbol_name) AS symbols FROM domain_symbols GROUP BY 1) s ON s.domain = d.name
    LEFT JOIN (SELECT domain, string_agg(code, ',' ORDER BY code) AS codes FROM constraints GROUP BY 1) c ON c.domain = d.name
    LEFT JOIN (SELECT domain, string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) AS newest FROM (SELECT domain, id, row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, id DESC) AS r FROM decisions) WHERE r <= 20 GROUP BY 1) n ON n.domain = d.name"""
)
def domain_detail(g: Graph) -> DataFrame:
    symbols = g.domain_symbols.groupBy(F.col("domain").alias("name")).agg(F.array_join(F.array_sort(F.collect_set("symbol_name")), ",").alias("symbols"))
    codes = g.constraints.groupBy(F.col("domain").alias("name")).agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
    newest = K.newest(g.decisions, "domain", 20).groupBy(F.col("domain").alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",").alias("newest"))
    out = g.domains.select("name").join(symbols, "name", "left").join(codes, "name", "left").join(newest, "name", "left")
    return out.fillna("", ["symbols", "codes", "newest"])


@query("SELECT domain, id, CAST(r AS INTEGER) AS rank FROM (SELECT domain, id, row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, id DESC) AS r FROM decisions) WHERE r <= 10")
def topk_decisions(g: Graph) -> DataFrame:
    return K.newest(g.decisions, "domain", 10).select("domain", "id", "rank")


@query(
    """SELECT d.id, d.domain, n.id AS superseded_by, CASE WHEN n.id IS NULL THEN 'active' ELSE 'historical' END AS status
    FROM decisions d LEFT JOIN (SELECT supersedes_id, max(id) AS id FROM (SELECT id, id - id % 4 AS supersedes_id FROM decisions WHERE id % 4 > 1) GROUP BY 1) n ON n.supersedes_id = d.id"""
)
def win_supersede(g: Graph) -> DataFrame:
    """Decisions that name an earlier one replace it, and no other of its domain."""
    given = g.decisions.where("id % 4 > 1").select("id", (F.col("id") - F.col("id") % 4).alias("supersedes_id"))
    return K.superseded(g.decisions, given).select("id", "domain", "superseded_by", "status")


@query(
    """SELECT s.id, s.name, f.path, coalesce(u.n, 0) AS callers, coalesce(v.n, 0) AS callees, coalesce(d.n, 0) AS decisions, coalesce(c.n, 0) AS constraints FROM symbols s JOIN files f ON f.id = s.file_id
    LEFT JOIN (SELECT target_id, count(*) AS n FROM calls GROUP BY 1) u ON u.target_id = s.id LEFT JOIN (SELECT source_id, count(*) AS n FROM calls GROUP BY 1) v ON v.source_id = s.id
    LEFT JOIN (SELECT fn, count(*) AS n FROM (SELECT unnest(functions) AS fn FROM decisions) GROUP BY 1) d ON d.fn = s.qualified_name LEFT JOIN (SELECT domain, count(*) AS n FROM constraints GROUP BY 1) c ON c.domain = s.brand"""
)
def context_360(g: Graph) -> DataFrame:
    """What is known around every symbol: callers, callees, decisions that name it, rules of its domain."""
    callers = g.calls.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("callers"))
    callees = g.calls.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("callees"))
    named = g.decisions.select(F.explode("functions").alias("qualified_name")).groupBy("qualified_name").agg(F.count("*").alias("decisions"))
    rules = g.constraints.groupBy(F.col("domain").alias("brand")).agg(F.count("*").alias("constraints"))
    out = G.with_files(g.symbols, g.file_refs).join(callers, "id", "left").join(callees, "id", "left").join(named, "qualified_name", "left").join(rules, "brand", "left")
    return out.fillna(0, ["callers", "callees", "decisions", "constraints"]).select("id", "name", "path", "callers", "callees", "decisions", "constraints")


@query("SELECT s.name, count(*) > 0 AS mentioned FROM symbols s WHERE s.qualified_name IN (SELECT unnest(functions) FROM decisions) GROUP BY s.name")
def agg_exists(g: Graph) -> DataFrame:
    mentioned = g.decisions.select(F.explode("functions").alias("qualified_name"))
    return g.symbols.join(mentioned, "qualified_name", "left_semi").groupBy("name").agg((F.count("*") > 0).alias("mentioned"))


@query("SELECT d.id, d.id IN (SELECT x.id FROM (SELECT id, unnest(functions) AS fn FROM decisions) x JOIN symbols s ON s.qualified_name = x.fn AND s.name NOT LIKE 'a%') AS validated FROM decisions d")
def ins_decision(g: Graph) -> DataFrame:
    """A decision is valid if a symbol that it names is known; here those whose name begins with ``a`` are not."""
    return K.validated(g.decisions, g.symbols.where(~F.col("name").startswith("a")).select(F.col("qualified_name").alias("name"))).select("id", "validated")


_NEW_DOMAINS = """
given AS (SELECT 'Brand#' || (1 + r_regionkey) AS name, [lower(r_name), 'STANDARD'] AS keywords FROM region UNION ALL SELECT 'Market ' || c_mktsegment, [lower(c_mktsegment)] FROM (SELECT DISTINCT c_mktsegment FROM customer))"""


def _given(g: Graph) -> DataFrame:
    a = g.raw("region").select(F.concat(F.lit("Brand#"), (F.col("r_regionkey") + 1).cast("string")).alias("name"), F.array(F.lower("r_name"), F.lit("STANDARD")).alias("keywords"))
    b = g.raw("customer").select("c_mktsegment").distinct().select(F.concat(F.lit("Market "), F.col("c_mktsegment")).alias("name"), F.array(F.lower("c_mktsegment")).alias("keywords"))
    return a.unionByName(b)


_MERGED = """SELECT coalesce(o.name, n.name) AS name, array_to_string(list_concat(coalesce(o.keywords, []), list_filter(coalesce(n.keywords, []), lambda k: NOT list_contains(coalesce(o.keywords, []), k))), ',') AS keywords
FROM domains o FULL JOIN given n ON n.name = o.name"""


@query(_MERGED, _NEW_DOMAINS)
def set_keywords_union(g: Graph) -> DataFrame:
    return K.merged_domains(g.domains, _given(g)).select("name", F.array_join("keywords", ",").alias("keywords"))


_GIVEN_LINKS = """
given_links AS (SELECT 'Brand#' || (1 + r_regionkey) AS domain, symbol_name FROM region, (SELECT DISTINCT symbol_name FROM domain_symbols WHERE symbol_id < 30) UNION SELECT 'Market ' || c_mktsegment, lower(c_name) FROM customer WHERE c_custkey < 20)"""


@query(
    """SELECT DISTINCT domain, symbol_id, symbol_name FROM (SELECT domain, symbol_id, symbol_name FROM domain_symbols
    UNION ALL SELECT g.domain, n.id, g.symbol_name FROM given_links g LEFT JOIN (SELECT name, min(id) AS id FROM symbols GROUP BY 1) n ON n.name = g.symbol_name)""",
    _GIVEN_LINKS,
)
def domain_links(g: Graph) -> DataFrame:
    """The next state of the links, with those of names: a name that no symbol has yet is linked without an id."""
    names = g.domain_symbols.where("symbol_id < 30").select("symbol_name").distinct()
    given = g.raw("region").select(F.concat(F.lit("Brand#"), (F.col("r_regionkey") + 1).cast("string")).alias("domain")).crossJoin(F.broadcast(names))  # five domains
    given = given.unionByName(g.raw("customer").where("c_custkey < 20").select(F.concat(F.lit("Market "), "c_mktsegment").alias("domain"), F.lower("c_name").alias("symbol_name")))
    return K.inserted(g.domain_symbols, K.linked_symbols(given, g.symbols), ["domain", "symbol_id", "symbol_name"])


@query(
    """SELECT coalesce(o.name, n.name) AS name, o.name IS NULL AS is_new, coalesce(l.linked, 0) AS linked, coalesce(l.unknown, 0) AS unknown FROM domains o FULL JOIN given n ON n.name = o.name
    LEFT JOIN (SELECT domain, count(*) AS linked, count(*) FILTER (symbol_id IS NULL) AS unknown FROM (SELECT DISTINCT domain, symbol_id, symbol_name FROM (SELECT * FROM domain_symbols
      UNION ALL SELECT g.domain, n.id, g.symbol_name FROM given_links g LEFT JOIN (SELECT name, min(id) AS id FROM symbols GROUP BY 1) n ON n.name = g.symbol_name)) GROUP BY 1) l ON l.domain = coalesce(o.name, n.name)""",
    f"{_NEW_DOMAINS},{_GIVEN_LINKS}",
)
def ups_domain(g: Graph) -> DataFrame:
    """Domains after an upsert by name, with how many symbols are linked to each by then, known or not."""
    merged = K.merged_domains(g.domains, _given(g)).join(g.domains.select("name", F.lit(False).alias("is_new")), "name", "left").withColumn("is_new", F.coalesce("is_new", F.lit(True)))
    linked = domain_links(g).groupBy(F.col("domain").alias("name")).agg(F.count("*").alias("linked"), F.count(F.when(F.col("symbol_id").isNull(), 1)).alias("unknown"))
    return merged.join(linked, "name", "left").select("name", "is_new", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("unknown", F.lit(0)).alias("unknown"))


@query(
    """SELECT DISTINCT k.domain, s.name AS symbol_name FROM symbols s JOIN (SELECT name AS domain, unnest(keywords) AS keyword FROM given) k
    ON contains(lower(s.name), lower(k.keyword)) OR contains(coalesce(s.name_tokens, ''), lower(k.keyword))
    UNION SELECT 'Colour', name FROM symbols WHERE contains(lower(name), 'al') OR contains(lower(name), 'green')""",
    _NEW_DOMAINS,
)
def import_automap(g: Graph) -> DataFrame:
    """Symbols that the keywords of given domains map to them."""
    given = _given(g).select(F.col("name").alias("domain"), F.explode("keywords").alias("keyword"))
    colours = g.raw("region").where("r_regionkey < 2").select(F.lit("Colour").alias("domain"), F.when(F.col("r_regionkey") == 0, "AL").otherwise("Green").alias("keyword"))
    return K.keyword_symbols(given.unionByName(colours), g.symbols)


@query(
    """SELECT coalesce(n.code, o.code) AS code, coalesce(n.severity, o.severity) AS severity, coalesce(n.statement, o.statement) AS statement FROM constraints o
    FULL JOIN (SELECT 'NATION_' || upper(r_name) AS code, 'ERROR' AS severity, 'Region ' || r_name AS statement FROM region UNION ALL SELECT code, 'ERROR', NULL FROM constraints WHERE id < 3) n ON n.code = o.code"""
)
def ups_constraint(g: Graph) -> DataFrame:
    new = g.raw("region").select(F.concat(F.lit("NATION_"), F.upper("r_name")).alias("code"), F.lit("ERROR").alias("severity"), F.concat(F.lit("Region "), F.col("r_name")).alias("statement"))
    new = new.unionByName(g.constraints.where("id < 3").select("code", F.lit("ERROR").alias("severity"), F.lit(None).cast("string").alias("statement")))
    return K.upserted(g.constraints.select("code", "severity", "statement"), new, "code")


@query("SELECT coalesce(n.symbol_id, o.symbol_id) AS symbol_id, CAST(CASE WHEN n.symbol_id IS NULL THEN o.label ELSE n.label END AS INTEGER) AS label FROM (SELECT vec_id AS symbol_id, label FROM embeddings) o FULL JOIN (SELECT p_partkey AS symbol_id, -1 AS label FROM part WHERE p_size > 25) n ON n.symbol_id = o.symbol_id")
def ups_embedding(g: Graph) -> DataFrame:
    old = g.raw("embeddings").select(F.col("vec_id").alias("symbol_id"), "label")
    return K.upserted(old, g.raw("part").where("p_size > 25").select(F.col("p_partkey").alias("symbol_id"), F.lit(-1).alias("label")), "symbol_id", keep_null=False)


_PADS = """
pads AS (SELECT c_mktsegment AS agent_role, 'serve ' || min(c_name) AS current_goal, CAST(max(c_acctbal) AS VARCHAR) AS blockers FROM customer GROUP BY 1),
updates AS (SELECT c_mktsegment AS agent_role, CASE WHEN count(*) % 2 = 0 THEN 'count ' || count(*) END AS current_goal, CAST(NULL AS VARCHAR) AS blockers FROM customer GROUP BY 1 UNION ALL SELECT r_name, 'new', 'none' FROM region)"""


def _pads(g: Graph) -> tuple[DataFrame, DataFrame]:
    customer = g.raw("customer").groupBy(F.col("c_mktsegment").alias("agent_role"))
    n = F.count("*")
    old = customer.agg(F.concat(F.lit("serve "), F.min("c_name")).alias("current_goal"), F.max("c_acctbal").cast("string").alias("blockers"))
    new = customer.agg(F.when(n % 2 == 0, F.concat(F.lit("count "), n.cast("string"))).alias("current_goal"), F.lit(None).cast("string").alias("blockers"))
    return old, new.unionByName(g.raw("region").select(F.col("r_name").alias("agent_role"), F.lit("new").alias("current_goal"), F.lit("none").alias("blockers")))


@query("SELECT coalesce(o.agent_role, n.agent_role) AS agent_role, coalesce(n.current_goal, o.current_goal) AS current_goal, coalesce(n.blockers, o.blockers) AS blockers FROM pads o FULL JOIN updates n ON n.agent_role = o.agent_role", _PADS)
def ups_scratchpad(g: Graph) -> DataFrame:
    return K.upserted(*_pads(g), "agent_role")


@query(
    """SELECT agent_role, current_goal, array_to_string(list_sort(steps), '|') AS completed_steps, 0 AS errors FROM (
      SELECT c_mktsegment AS agent_role, 'serve ' || min(c_name) AS current_goal, list(DISTINCT c_name) AS steps FROM customer GROUP BY 1 HAVING c_mktsegment = 'BUILDING')"""
)
def get_scratchpad(g: Graph) -> DataFrame:
    """One role's row, whose lists are JSON; one of them is broken."""
    pads = g.raw("customer").groupBy(F.col("c_mktsegment").alias("agent_role")).agg(
        F.concat(F.lit("serve "), F.min("c_name")).alias("current_goal"), F.to_json(F.array_sort(F.collect_set("c_name"))).alias("completed_steps"), F.max(F.lit("[broken")).alias("current_errors"), F.max(F.lit(None).cast("string")).alias("blockers"),
    )
    row = K.scratchpad(pads, "BUILDING")
    return row.select("agent_role", "current_goal", F.array_join("completed_steps", "|").alias("completed_steps"), (F.size("current_errors") + F.size("blockers")).alias("errors"))


@query("SELECT id AS event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM tool_calls")
def decode_props(g: Graph) -> DataFrame:
    """Decodes the JSON that a row carries."""
    return g.tool_calls.select(F.col("id").alias("event_id"), F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN s_suppkey IS NULL THEN c_acctbal ELSE s_acctbal END AS balance FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def ups_registry(g: Graph) -> DataFrame:
    old = g.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    new = g.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("given"), F.col("s_acctbal").alias("balance"))
    known = new.join(old.select("id", F.col("name").alias("had")), "id", "left").select("id", F.coalesce("had", "given").alias("name"), "balance")
    return K.upserted(old, known, "id")


@query("SELECT code, severity FROM constraints UNION ALL SELECT DISTINCT 'BRAND_' || p_size, 'INFO' FROM part UNION ALL SELECT 'NATION_' || upper(r_name), 'INFO' FROM region WHERE 'NATION_' || upper(r_name) NOT IN (SELECT code FROM constraints)")
def ins_ignore(g: Graph) -> DataFrame:
    new = g.raw("part").select(F.concat(F.lit("BRAND_"), F.col("p_size").cast("string")).alias("code"), F.lit("INFO").alias("severity"))
    new = new.unionByName(g.raw("region").select(F.concat(F.lit("NATION_"), F.upper("r_name")).alias("code"), F.lit("INFO").alias("severity")))
    return K.inserted(g.constraints.select("code", "severity"), new, ["code"])


_KEYS = """
projects AS (SELECT 'P' || c_custkey AS id, '/work/' || lower(c_mktsegment) || '/' || lower(c_name) AS path, c_name AS name FROM customer),
keys AS (SELECT 'P' || n_nationkey AS key FROM nation UNION ALL SELECT n_name FROM nation UNION ALL SELECT min(path) FROM projects UNION ALL SELECT max(lower(name)) FROM projects UNION ALL SELECT 'building/' || lower(min(name)) FROM projects UNION ALL SELECT substr(max(name), 6) FROM projects)"""


@query(
    """SELECT k.key, CASE WHEN n = 1 OR tier < 5 THEN id END AS id FROM keys k LEFT JOIN (
      SELECT key, tier, count(*) AS n, min(id) AS id FROM (SELECT *, min(tier) OVER (PARTITION BY key) AS best FROM (
        SELECT k.key, p.id, CASE WHEN p.id = k.key THEN 1 WHEN p.path = k.key THEN 2 WHEN lower(p.name) = lower(k.key) THEN 3 WHEN ends_with(p.path, '/' || k.key) THEN 4
          WHEN contains(lower(p.name), lower(k.key)) THEN 5 WHEN contains(lower(regexp_extract(p.path, '([^/]*)$', 1)), lower(k.key)) THEN 6 END AS tier FROM projects p, keys k) WHERE tier IS NOT NULL)
      WHERE tier = best GROUP BY key, tier) m ON m.key = k.key""",
    _KEYS,
)
def resolve_project(g: Graph) -> DataFrame:
    name = F.col("c_name")
    projects = g.raw("customer").select(F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("/work/"), F.lower("c_mktsegment"), F.lit("/"), F.lower(name)).alias("path"), name.alias("name"))
    nation = g.raw("nation")
    keys = nation.select(F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("key")).union(nation.select("n_name"))
    for extra in (F.min("path"), F.max(F.lower("name")), F.concat(F.lit("building/"), F.lower(F.min("name"))), F.expr("substr(max(name), 6)")):
        keys = keys.union(projects.agg(extra))
    return K.resolve_project(projects, keys)


# ---------------------------------------------------------------- telemetry


@query("SELECT project, tool, count(*) AS calls FROM tool_calls GROUP BY 1, 2")
def st_call_counts(g: Graph) -> DataFrame:
    return T.call_counts(g.tool_calls)


@query("SELECT project, count(*) AS calls FROM tool_calls GROUP BY ROLLUP (project)")
def agg_call_counts(g: Graph) -> DataFrame:
    return T.total_counts(g.tool_calls)


@query(
    """SELECT project, min(ts) AS session_start, max(ts) + INTERVAL 10 MINUTE AS session_end, count(*) AS calls FROM (
      SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY ts, id) AS session
      FROM (SELECT *, lag(ts) OVER (PARTITION BY project ORDER BY ts, id) AS before FROM tool_calls)) GROUP BY project, session"""
)
def st_idle_ttl(g: Graph) -> DataFrame:
    return T.idle_sessions(g.tool_calls)


_LAST = "SELECT project, last_ts, CAST(row_number() OVER (ORDER BY last_ts DESC, project) AS INTEGER) AS place FROM (SELECT project, max(ts) AS last_ts FROM tool_calls GROUP BY 1)"


@query(f"SELECT * FROM ({_LAST}) WHERE place <= 4")
def win_lru(g: Graph) -> DataFrame:
    return T.most_recent(g.tool_calls)


@query("SELECT project, max(ts) AS last_ts, count(*) AS calls FROM tool_calls GROUP BY project HAVING project IN (SELECT project FROM (SELECT project, max(ts) AS t FROM tool_calls GROUP BY 1 ORDER BY t DESC, project LIMIT 4))")
def st_lru4(g: Graph) -> DataFrame:
    kept = F.broadcast(T.most_recent(g.tool_calls).select("project"))
    return g.tool_calls.join(kept, "project").groupBy("project").agg(F.max("ts").alias("last_ts"), F.count("*").alias("calls"))


@query("SELECT project, id, tool, value FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, id DESC) AS r FROM tool_calls) WHERE r = 1")
def st_latest_state(g: Graph) -> DataFrame:
    return T.latest_state(g.tool_calls)


@query(
    """SELECT project, tool, count(*) AS run, min(ts) AS first_ts FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts, id) - row_number() OVER (PARTITION BY project, tool ORDER BY ts, id) AS island FROM tool_calls)
    GROUP BY project, tool, island HAVING count(*) >= 4"""
)
def st_doom_loop(g: Graph) -> DataFrame:
    return T.repeated_calls(g.tool_calls)


@query("SELECT id, project, round(sum(value) OVER w, 4) AS running_cost, count(*) OVER w AS turn FROM tool_calls WINDOW w AS (PARTITION BY project ORDER BY ts, id ROWS UNBOUNDED PRECEDING)")
def st_running_cost(g: Graph) -> DataFrame:
    return T.running_cost(g.tool_calls)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, tool, count(*) AS calls FROM tool_calls GROUP BY 1, 2")
def st_event_kinds(g: Graph) -> DataFrame:
    return T.event_kinds(g.tool_calls)


@query("SELECT conv_id, role, CAST(sum(ceil(strlen(text) / 4)) AS BIGINT) AS tokens, count(*) AS turns FROM conversations GROUP BY 1, 2")
def agg_token_usage(g: Graph) -> DataFrame:
    return g.raw("conversations").groupBy("conv_id", "role").agg(F.sum(S.estimated_tokens(F.col("text"))).alias("tokens"), F.count("*").alias("turns"))


@query("SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(ceil(strlen(text) / 4)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 60")
def fit_to_budget(g: Graph) -> DataFrame:
    """The first turns of each conversation that fit a budget of tokens."""
    rows = g.raw("conversations").withColumn("text", F.coalesce("text", F.lit("")))
    order = [F.col(c) for c in ("turn", "role", "text")]
    return G.within_budget(rows, S.estimated_tokens(F.col("text")), order, 60, ["conv_id"]).select("conv_id", "turn", F.col("running_cost").alias("used"))


# ---------------------------------------------------------------- pools of open projects: one for each kind of call, in which user 8 is the default and stays

_POOL = """
WITH RECURSIVE c AS (SELECT tool AS pool, project, ts, row_number() OVER (PARTITION BY tool ORDER BY ts, id) AS n FROM tool_calls),
walk AS (
  SELECT pool, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(p BIGINT, t TIMESTAMP)[]) AS opened, CAST([] AS STRUCT(p BIGINT, t TIMESTAMP, r VARCHAR, e TIMESTAMP)[]) AS ended FROM (SELECT DISTINCT pool FROM c)
  UNION ALL
  SELECT pool, n,
    CASE WHEN project = 8 THEN fresh ELSE list_append(CASE WHEN len(others) < len(fresh) THEN others WHEN len(fresh) >= 3 THEN fresh[2:] ELSE fresh END, {'p': project, 't': ts}) END,
    list_concat(list_transform(idle, lambda x: {'p': x.p, 't': x.t, 'r': 'idle', 'e': x.t + INTERVAL 6 HOUR}),
      CASE WHEN project <> 8 AND len(others) = len(fresh) AND len(fresh) >= 3 THEN [{'p': fresh[1].p, 't': fresh[1].t, 'r': 'evicted', 'e': ts}] ELSE [] END)
  FROM (
    SELECT c.pool, c.n, c.project, c.ts, list_filter(w.opened, lambda x: x.t >= c.ts - INTERVAL 6 HOUR) AS fresh, list_filter(w.opened, lambda x: x.t < c.ts - INTERVAL 6 HOUR) AS idle,
      list_filter(w.opened, lambda x: x.t >= c.ts - INTERVAL 6 HOUR AND x.p <> c.project) AS others
    FROM walk w JOIN c ON c.pool = w.pool AND c.n = w.n + 1))
"""


@query(
    f"""SELECT pool, e.p AS project, e.t AS last_at, e.r AS reason, e.e AS ended_at FROM ({_POOL} SELECT pool, unnest(ended) AS e FROM walk) UNION ALL
    SELECT pool, o.p, o.t, 'idle', o.t + INTERVAL 6 HOUR FROM ({_POOL} SELECT pool, unnest(arg_max(opened, n)) AS o FROM walk GROUP BY pool) WHERE o.t < (SELECT max(ts) FROM tool_calls) - INTERVAL 6 HOUR"""
)
def st_pool_closings(g: Graph) -> DataFrame:
    """What closes or makes room, and when; a user counts as a project."""
    return P.closings(g.tool_calls.withColumn("pool", F.col("tool")), 6 * 3600, 4, 8)


@query(
    """SELECT pool, project, last_at, CAST(CASE WHEN project = 8 THEN 0 ELSE row_number() OVER (PARTITION BY pool, project = 8 ORDER BY last_at DESC) END AS INTEGER) AS place
    FROM (SELECT tool AS pool, project, max(ts) AS last_at FROM tool_calls GROUP BY 1, 2) WHERE project = 8 OR last_at >= (SELECT max(ts) FROM tool_calls) - INTERVAL 6 HOUR
    QUALIFY place <= 3"""
)
def win_lru_default(g: Graph) -> DataFrame:
    """What is open in the end."""
    return P.open_projects(g.tool_calls.withColumn("pool", F.col("tool")), 6 * 3600, 4, 8)


# ---------------------------------------------------------------- events as a tagged union, written from the events' own values; some are made not to fit

_PLAIN = {"text": "x", "flag": True, "u8": 7, "u32": 70, "u64": 700, "f64": 0.5}


def _template(kind: str) -> str:
    out: dict = {"type": kind}
    for name, t in E.KINDS[kind]:
        where, _, last = name.rpartition(".")
        (out.setdefault(where, {}) if where else out)[last] = _PLAIN[t.rstrip("?")]
    return json.dumps(out)


_TEMPLATES = [_template(k) for k in E.KINDS]
_EVENT_SQL = (
    "fields AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {i}, '{n}', '{t}')" for k, parts in E.KINDS.items() for i, (n, t) in enumerate(parts)) + ") f(kind, place, field, type)),\n"
    "templates AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_TEMPLATES)) + ") t(i, template)),\n"
    """payloads AS (
  SELECT id, ts, CASE WHEN id % 11 = 0 THEN replace(p, '70', '-70') WHEN id % 13 = 0 THEN replace(p, '"x"', '17') WHEN id % 17 = 0 THEN replace(p, 'true', '"true"') WHEN id % 23 = 0 THEN substr(p, 1, length(p) - 1)
    WHEN id % 29 = 0 THEN replace(p, '"type"', '"kind"') WHEN id % 31 = 0 THEN replace(p, '"type": "', '"type": "un') WHEN id % 37 = 0 THEN replace(p, '7', '7' || CAST(value AS BIGINT)) ELSE p END AS payload
  FROM (SELECT id, ts, value, template AS p FROM tool_calls JOIN templates ON i = id % 19)),
read AS (SELECT id, ts, payload, json_valid(payload) AS ok, CASE WHEN json_valid(payload) AND json_type(payload, '$.type') = 'VARCHAR' THEN payload ->> '$.type' END AS kind FROM payloads),
wrong AS (
  SELECT id, arg_min(field, place) AS field FROM (SELECT *, json_type(payload, '$.' || field) AS t, payload ->> ('$.' || field) AS v FROM read JOIN fields USING (kind) WHERE ok)
  WHERE NOT coalesce(CASE WHEN type = 'text' THEN t = 'VARCHAR' WHEN type = 'flag' THEN t = 'BOOLEAN' WHEN type LIKE 'f64%' THEN t IN ('DOUBLE', 'UBIGINT', 'BIGINT') OR type LIKE '%?' AND t = 'NULL'
    ELSE t = 'UBIGINT' AND CAST(v AS HUGEINT) <= CASE type WHEN 'u8' THEN 255 WHEN 'u32' THEN 4294967295 ELSE 18446744073709551615 END END, type LIKE '%?')
  GROUP BY id),
judged AS (
  SELECT r.*, CASE WHEN NOT ok THEN 'not json' WHEN r.kind IS NULL THEN 'no type' WHEN r.kind NOT IN (SELECT kind FROM fields) THEN 'unknown type' WHEN w.field IS NOT NULL THEN 'field ' || w.field END AS reason
  FROM read r LEFT JOIN wrong w USING (id))"""
)


def _events(g: Graph) -> DataFrame:
    p, i = F.element_at(F.array(*[F.lit(t) for t in _TEMPLATES]), (F.col("id") % 19 + 1).cast("int")), F.col("id")
    payload = (
        F.when(i % 11 == 0, F.replace(p, F.lit("70"), F.lit("-70"))).when(i % 13 == 0, F.replace(p, F.lit('"x"'), F.lit("17"))).when(i % 17 == 0, F.replace(p, F.lit("true"), F.lit('"true"')))
        .when(i % 23 == 0, F.substring(p, F.lit(1), F.length(p) - 1)).when(i % 29 == 0, F.replace(p, F.lit('"type"'), F.lit('"kind"'))).when(i % 31 == 0, F.replace(p, F.lit('"type": "'), F.lit('"type": "un')))
        .when(i % 37 == 0, F.replace(p, F.lit("7"), F.concat(F.lit("7"), F.rint("value").cast("long").cast("string")))).otherwise(p)
    )
    return E.read_events(g.tool_calls.select("id", "ts", payload.alias("payload")))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, CASE WHEN kind IN (SELECT kind FROM fields) THEN kind END AS kind, reason, count(*) AS events FROM judged GROUP BY 1, 2, 3", _EVENT_SQL)
def st_event_union(g: Graph) -> DataFrame:
    """Events of all kinds by day, with those set aside and why."""
    return E.counted(_events(g))


@query("SELECT id, payload ->> '$.tool_name' AS tool_name, CAST(payload ->> '$.success' AS BOOLEAN) AS success, CAST(payload ->> '$.duration_ms' AS BIGINT) AS duration_ms FROM judged WHERE kind = 'tool_executed' AND reason IS NULL", _EVENT_SQL)
def st_event_fields(g: Graph) -> DataFrame:
    """One kind's own fields."""
    return E.of_kind(_events(g), "tool_executed", "id").withColumn("duration_ms", F.col("duration_ms").cast("long"))
