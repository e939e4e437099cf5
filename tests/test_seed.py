"""The seed of two symbols and the cases around it: cycles, diamonds, ties, nulls."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import graph as G
from loomgraph.operators import knowledge as K
from loomgraph.operators import retrieval as R

SYMBOLS = "id long, file_id long, name string, kind string, start_line long, end_line long, signature string, doc string, name_tokens string, centrality double"


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(1, "src/gateway.rs"), (2, "src/other.rs")], "id long, path string")


@pytest.fixture(scope="module")
def symbols(spark):
    rows = [
        (1, 1, "run_gateway", "fn", 10, 50, "pub fn run_gateway()", "Main gateway loop", "run gateway", 0.0), (2, 1, "check_quota", "fn", 55, 70, "fn check_quota() -> bool", None, "check quota", 0.0),
        (3, 2, "a", "fn", 1, 30, None, None, None, 0.0), (4, 2, "b", "fn", 2, 9, None, None, None, 0.0), (5, 2, "c", "fn", 40, 41, None, None, None, 0.0), (6, 2, "check_quota", "fn", 60, 61, None, None, None, 0.0), (7, 2, "alone", "fn", 70, 71, None, None, None, 0.0),
    ]
    return spark.createDataFrame(rows, SYMBOLS)


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(1, 2, "CALLS"), (3, 4, "CALLS"), (4, 5, "CALLS"), (5, 3, "CALLS"), (3, 5, "CALLS"), (6, 6, "CALLS"), (1, 3, "DI_INJECT"), (3, 6, "DI_INJECT")]
    return spark.createDataFrame(rows, "source_id long, target_id long, kind string")


def ids(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_search_finds_the_gateway(spark, symbols):
    asked = spark.createDataFrame([("gateway", 0, "gate", True, True)], "query string, slot int, term string, prefix boolean, required boolean")
    assert [r["id"] for r in R.bm25(symbols, asked).collect()] == [1]


def test_every_required_word_counts(spark, symbols):
    asked = [("q", 0, "run", False, True), ("q", 1, "quota", False, True)]
    schema = "query string, slot int, term string, prefix boolean, required boolean"
    assert R.bm25(symbols, spark.createDataFrame(asked, schema)).count() == 0
    assert R.bm25(symbols, spark.createDataFrame([*asked, ("q", 9, "check", False, False)], schema)).count() == 2


def test_context(spark, symbols, files, edges):
    of = symbols.where("name = 'run_gateway'")
    near = G.neighbours(symbols, files, edges, of, "downstream").collect()
    assert of.first()["kind"] == "fn" and [r["name"] for r in near] == ["a", "check_quota"]


def test_impact_keeps_the_least_depth(spark, symbols, files, edges):
    seeds = spark.createDataFrame([(3,)], "id long")
    down = G.impact_levels(edges, seeds, 3, "downstream")
    assert ids(down, "id", "depth") == [(3, 1), (4, 0), (5, 0), (6, 0)]
    assert ids(G.impact_levels(edges, seeds, 0, "upstream"), "id", "depth") == [(1, 0), (5, 0)]
    # further levels follow calls only: 6 is met from 3 by another kind at level 0, never deeper
    assert (6, 1) not in ids(G.impact_levels(edges, spark.createDataFrame([(5,)], "id long"), 3, "downstream"), "id", "depth")
    for depth in range(3):
        less, more = (dict(ids(G.impact_levels(edges, seeds, d, "downstream"), "id", "depth")) for d in (depth, depth + 1))
        assert less.items() <= more.items()
    risk = G.impact_risk(G.impact(symbols, files, edges, seeds, 3)).first()
    assert (risk["upstream_count"], risk["downstream_count"], risk["risk"]) == (4, 4, "MEDIUM")
    with pytest.raises(ValueError):
        G.impact_levels(edges, seeds, 99, "upstream")


def test_upstream_is_downstream_reversed(spark, edges):
    for a in range(1, 7):
        seeds = spark.createDataFrame([(a,)], "id long")
        calls = edges.where("kind = 'CALLS'")
        flipped = calls.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "kind")
        assert ids(G.impact_levels(calls, seeds, 2, "upstream"), "id", "depth") == ids(G.impact_levels(flipped, seeds, 2, "downstream"), "id", "depth")


def test_trace_meets_a_symbol_at_several_depths(spark, symbols, files, edges):
    rows = ids(G.trace(symbols, files, edges, spark.createDataFrame([(3,)], "id long"), 3), "id", "depth", "edge_kind")
    assert (5, 1, "CALLS") in rows and (5, 2, "CALLS") in rows and (6, 1, "DI_INJECT") in rows


def test_gaps(spark, symbols, files, edges):
    calls = edges.where("kind = 'CALLS'")
    assert ids(G.orphans(symbols, files, calls), "name") == [("alone",)]
    assert ids(G.self_loops(symbols, calls), "id") == [(6,)]
    one = lambda i: spark.createDataFrame([(i,)], "id long")
    assert ids(G.shared_callers(calls, one(4), one(5)), "id") == [(3,)]
    assert G.path_exists(edges, one(1), one(5)).first()[0] is False and G.path_exists(edges, one(1), one(5), hops=2).first()[0] is True


def test_enclosing_and_resolution(spark, symbols):
    places = spark.createDataFrame([(1, 2, 5), (2, 2, 35), (3, 1, 12)], "place_id long, file_id long, line long")
    assert ids(G.enclosing(places, symbols), "place_id", "symbol_id", "enclosed") == [(1, 4, True), (2, 3, False), (3, 1, True)]
    wanted = spark.createDataFrame([(3, 2, "check_quota", "CALLS"), (3, 2, "check_quota", "CALLS"), (6, 2, "check_quota", "CALLS")], "source_id long, file_id long, target_name string, kind string")
    assert ids(G.resolve_names(wanted, symbols), "source_id", "target_id") == [(3, 2), (6, 2)]
    assert ids(G.resolve_local(wanted, symbols), "source_id", "target_id") == [(3, 6)]


def test_empty_tables_score_nothing(spark):
    empty = spark.createDataFrame([], "name string, keywords array<string>, domain string, symbol_id long, id long")
    assert K.catalog(empty, empty, empty).count() == 0
    counts = K.table_counts({"symbols": empty, "domains": empty})
    assert K.knowledge_score(counts, ("domains",)).first()["layer_score"] == 0


def test_supersession(spark):
    t = datetime.datetime(2024, 1, 1)
    old = spark.createDataFrame([(1, "d", t), (2, "d", t), (3, "e", t), (None, "e", t)], "id long, domain string, created_at timestamp")
    given = spark.createDataFrame([(4, 1), (5, 1), (6, None), (7, 99)], "id long, supersedes_id long")
    rows = K.superseded(old, given)
    assert ids(rows.where("id is not null"), "id", "superseded_by", "status") == [(1, 5, "historical"), (2, None, "active"), (3, None, "active")] and rows.count() == 4
    again = K.superseded(rows, spark.createDataFrame([(8, 2)], "id long, supersedes_id long"))
    assert ids(again.where("id < 3"), "id", "superseded_by", "status") == [(1, 5, "historical"), (2, 8, "historical")]


def test_truncation_ends_with_a_character(spark):
    rows = spark.createDataFrame([("é" * 300,), ("a" + "€" * 200,), ("x" * 400,), ("😀" * 101,), (None,)], "text string").select(S.truncate_tokens(F.col("text"), 100).alias("t"))
    got = [r["t"] for r in rows.collect()]
    assert got == ["é" * 200 + "… [truncated]", "a" + "€" * 133 + "… [truncated]", "x" * 400, "😀" * 100 + "… [truncated]", None]


def test_line_expressions_see_lines(spark):
    docs = spark.createDataFrame([(1, "x\ndef f():\n  y = 1:\nend"), (2, "abc"), (3, None), (4, "")], "doc_id long, text string")

    def found(pattern, **options):
        return ids(R.grep(docs, pattern, **options), "doc_id", "line_no")

    assert found("^def", is_regex=True) == [(1, 2)] and found(":$", is_regex=True) == [(1, 2), (1, 3)]
    assert found("^(?!x|def).", is_regex=True) == [(1, 3), (1, 4), (2, 1)] and found("DEF f()") == [(1, 2)] and found("DEF f()", case_sensitive=True) == []
    near = R.grep_context(docs, "^def", 1, is_regex=True)
    assert ids(near, "match_line", "line_no", "line") == [(2, 1, "x"), (2, 2, "def f():"), (2, 3, "  y = 1:")]
    assert R.grep_context(docs, "abc", 0).first()["line_no"] == 1


def test_links_may_come_before_symbols(spark):
    old = spark.createDataFrame([("Authentication", ["auth"])], "name string, keywords array<string>")
    new = spark.createDataFrame([("Authentication", ["jwt", "auth"]), ("Billing", None)], "name string, keywords array<string>")
    merged = {r["name"]: r["keywords"] for r in K.merged_domains(old, new).collect()}
    assert merged == {"Authentication": ["auth", "jwt"], "Billing": []}
    links = spark.createDataFrame([("Authentication", None, "verify_token")], "domain string, symbol_id long, symbol_name string")
    assert K.inserted(links, links, ["domain", "symbol_id", "symbol_name"]).count() == 1


def test_roles_stay_apart(spark):
    schema = "agent_role string, current_goal string, blockers string"
    old = spark.createDataFrame([("coder", "write", None), ("reviewer", "read", "x")], schema)
    out = K.upserted(old, spark.createDataFrame([("coder", None, "y"), ("architect", "plan", None)], schema), "agent_role")
    assert ids(out, "agent_role", "current_goal", "blockers") == [("architect", "plan", None), ("coder", "write", "y"), ("reviewer", "read", "x")]
    assert ids(K.upserted(out, out, "agent_role"), *out.columns) == ids(out, *out.columns)


def test_token_arithmetic(spark):
    row = spark.createDataFrame([("", "hello", "hello world", "x" * 1000)], "a string, b string, c string, d string")
    got = row.select(*[S.estimated_tokens(F.col(c)) for c in "abc"], S.truncate_tokens(F.col("d"), 10)).first()
    assert tuple(got)[:3] == (0, 2, 3) and "[truncated]" in got[3] and len(got[3].encode()) < 100


@pytest.mark.parametrize(("n", "budget", "kept"), [(10, 20, 6), (3, 100, 3)])
def test_budget(spark, n, budget, kept):
    rows = spark.range(n).withColumn("text", F.lit("item text"))
    assert G.within_budget(rows, S.estimated_tokens(F.col("text")), [F.col("id")], budget).count() == kept


@pytest.mark.parametrize(
    ("name", "tokens"),
    [("runGateway", "run gateway"), ("run_gateway", "run gateway"), ("plain", None), ("HTTPServer", None), ("a_B", "a  b"), ("__init__", "init"), ("getURLNow", "get urlnow"), ("x1Y", "x1 y")],
)
def test_name_tokens(spark, name, tokens):
    assert spark.createDataFrame([(name,)], "n string").select(S.name_tokens(F.col("n"))).first()[0] == tokens


def test_project_tiers(spark):
    projects = spark.createDataFrame([("p1", "/w/api", "Api"), ("p2", "/w/api-client", "Client"), ("p3", "/w/web", "Web Api")], "id string, path string, name string")
    keys = spark.createDataFrame([(k,) for k in ("p2", "/w/web", "api", "clie", "web", "w/api", "i", "none")], "key string")
    got = {r["key"]: r["id"] for r in K.resolve_project(projects, keys).collect()}
    assert got == {"p2": "p2", "/w/web": "p3", "api": "p1", "clie": "p2", "web": "p3", "w/api": "p1", "i": None, "none": None}


def test_grep(spark):
    docs = spark.createDataFrame([(1, "a.b\nA.B\nacb"), (2, None)], "doc_id long, text string")
    assert ids(R.grep(docs, "a.b"), "line_no") == [(1,), (2,)]
    assert ids(R.grep(docs, "a.b", case_sensitive=True), "line_no") == [(1,)]
    assert ids(R.grep(docs, "a.b", is_regex=True), "line_no") == [(1,), (2,), (3,)]
    assert ids(R.grep_context(docs, "acb", 1), "match_line", "line_no") == [(3, 2), (3, 3)]
