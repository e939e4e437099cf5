"""Each entry point of the workspace, over the smallest tables."""

import pytest
from pyspark.sql import functions as F

from loomgraph.jobs.api import Workspace
from loomgraph.operators import graph as G
from loomgraph.sources.tables import scratch
from loomgraph.sources.views import Graph

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def work(spark):
    return Workspace(Graph(spark, DIR))


@pytest.fixture(scope="module")
def busy(work):
    """A symbol with many edges."""
    return work.g.symbols.join(G.most_connected(work.g.edges), "id").first()


def test_projects_and_brief(spark, work):
    registry = spark.createDataFrame([("p2", "b", "/b"), ("p1", "a", "/a")], "id string, name string, path string")
    assert [r["id"] for r in work.projects(registry).collect()] == ["p1", "p2"]
    brief = work.brief().first()
    assert (brief["layer_score"], brief["status"], brief["symbols"]) == (75, "healthy", work.g.symbols.count())


def test_build_graph(work, tmp_path):
    (tmp_path / "a.py").write_text("def one():\n    two_of()\n\n\ndef two_of():\n    pass\n")
    assert work.build_graph(str(tmp_path)).edges.count() == 1


def test_lookup_from_a_stored_index(spark, work, busy):
    text = busy["name"].replace("_", " ")
    plain = [tuple(r) for r in work.lookup(text).orderBy("rank").collect()]
    stored = [tuple(r) for r in work.lookup(text, index=work.text_index(scratch(spark, "index"))).orderBy("rank").collect()]
    assert plain and [p[:6] for p in plain] == [s[:6] for s in stored]
    assert {r["kind"] for r in work.lookup(text, kind=busy["kind"]).collect()} <= {busy["kind"]}


def test_index_by_stems_reads_few_terms(spark, work):
    from loomgraph.operators import retrieval as R

    rows = spark.createDataFrame([(1, "Connections of the café"), (2, "connecting pipes"), (3, "nothing here")], "id long, name string")
    index = R.TextIndex(spark, scratch(spark, "index"), stems=True).write(rows, {"name": 1.0})
    ask = spark.createDataFrame([("q", 0, "connected", False, True)], "query string, slot int, term string, prefix boolean, required boolean")
    assert sorted(r["id"] for r in index.search(ask).collect()) == [1, 2]
    cafe = spark.createDataFrame([("q", 0, "café", False, True)], ask.schema)
    assert [r["id"] for r in index.search(cafe).collect()] == [1]
    plan = index.postings(["connect"], ["ca"])._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(" in plan and "StringStartsWith(term,ca)" in plan


def test_outline(work):
    path = work.g.file_refs.join(work.g.symbols, work.g.file_refs["id"] == work.g.symbols["file_id"]).agg(F.min("path")).first()[0]
    assert work.outline(path).where("relevance = 1.0").count() == work.outline(path).count() > 0
    fuzzy = work.outline(path.split("/")[1], limit=5)
    assert 0 < fuzzy.count() <= 5 and {r["relevance"] for r in fuzzy.collect()} == {0.8}


def test_inspect(work, busy):
    found = work.inspect(busy["qualified_name"])
    assert found["symbols"].count() == 1 and found["callees"].count() == min(20, work.g.edges.where(F.col("source_id") == busy["id"]).count())
    decisions = found["decisions"].collect()
    mentions = work.g.decisions.where(F.array_contains("functions", busy["qualified_name"])).count()
    assert len(decisions) == min(10, mentions) and {r["symbol_id"] for r in decisions} <= {busy["id"]}
    several = work.inspect(busy["name"])
    counts = {r["symbol_id"]: r["count"] for r in several["decisions"].groupBy("symbol_id").count().collect()}
    assert all(n <= 10 for n in counts.values())
    assert found["constraints"].where(F.col("symbol_id") == busy["id"]).count() > 0


def test_impact_and_trace(work, busy):
    rows, risk = work.impact(busy["qualified_name"])
    assert risk.first()["upstream_count"] + risk.first()["downstream_count"] == rows.count() > 0
    near = work.impact(busy["qualified_name"], 0)[0]
    assert {r["depth"] for r in near.collect()} == {0}
    route = work.trace(busy["qualified_name"], budget=120)
    assert max(r["running_cost"] for r in route.collect()) <= 120
    assert work.trace(busy["qualified_name"], depth=0).count() == 0
    for bad in (-1, 51):
        with pytest.raises(ValueError, match="depth"):
            work.trace(busy["qualified_name"], depth=bad)


def test_grep(work):
    near, folders = work.grep("licen[sc]ed under", is_regex=True, context=1, limit=3)
    rows = near.collect()
    assert len({(r["path"], r["match_line"]) for r in rows}) <= 3 and rows and all(abs(r["line_no"] - r["match_line"]) <= 1 for r in rows)
    assert folders.agg(F.sum("files")).first()[0] >= len({r["path"] for r in rows})
    folder = folders.first()["dir"]
    inside, _ = work.grep("e", path=folder, limit=10)
    assert all(r["path"].startswith(folder) for r in inside.collect())
    assert work.grep("e", includes=["no_such_*"])[0].count() == 0


def test_gaps(work, busy):
    assert work.gaps("orphans").count() == G.orphans(work.g.symbols, work.g.file_refs, work.g.calls).count()
    assert work.gaps("self_loops").count() >= 0
    one = work.g.edges.where(F.col("source_id") == busy["id"]).join(work.g.symbols, F.col("target_id") == F.col("id")).first()
    assert work.gaps("path", first=busy["qualified_name"], second=one["qualified_name"]).first()["path_exists"]
    assert work.gaps("shared_callers", first=one["qualified_name"], second=one["qualified_name"]).count() >= 0
    assert not G.path_exists(work.g.edges, G.most_connected(work.g.edges), G.most_connected(work.g.edges), 0).first()["path_exists"]
    with pytest.raises(ValueError, match="no template"):
        work.gaps("other")


def test_domains_and_assign(spark, work, busy):
    assert work.domains("Brand#11").count() == 1
    given = spark.createDataFrame([("New", ["a"]), ("Brand#11", ["b"])], "name string, keywords array<string>")
    links = spark.createDataFrame([("New", busy["name"]), ("New", "not_there")], "domain string, symbol_name string")
    rules = spark.createDataFrame([("R1", "ERROR", "Do", "New")], "code string, severity string, statement string, domain string")
    out = work.assign(given, links, rules)
    assert "b" in out["domains"].where("name = 'Brand#11'").first()["keywords"] and out["domains"].where("name = 'New'").count() == 1
    linked = {r["symbol_name"]: r["symbol_id"] for r in out["domain_symbols"].where("domain = 'New'").collect()}
    assert linked["not_there"] is None and linked[busy["name"]] == work.g.symbols.where(F.col("name") == busy["name"]).agg(F.min("id")).first()[0]
    assert out["constraints"].where("code = 'R1'").first()["domain"] == "New" and out["constraints"].count() == work.g.constraints.count() + 1


def test_constraints_from(work, tmp_path):
    (tmp_path / "style.txt").write_text("X_1: error: Never\n")
    assert work.constraints_from(str(tmp_path / "style.txt")).where("code = 'X_1'").first()["severity"] == "ERROR"


def test_record_decision(spark, work, busy):
    old = work.g.decisions.agg(F.min("id")).first()[0]
    schema = "id long, domain string, reason string, revert_risk string, created_at date, functions array<string>, supersedes_id long"
    nothing = work.record_decision(spark.createDataFrame([], schema))
    assert nothing.where("status <> 'active'").count() == 0
    out = work.record_decision(spark.createDataFrame([(-1, "D", "why", None, None, [busy["name"]], old), (-2, "D", "why", "HIGH", None, ["nobody"], None)], schema))
    rows = {r["id"]: r for r in out.where("id < 0 or status <> 'active'").collect()}
    assert (rows[old]["status"], rows[old]["superseded_by"]) == ("historical", -1) and len(rows) == 3
    assert rows[-1]["validated"] and rows[-1]["revert_risk"] == "LOW" and not rows[-2]["validated"]


def test_imports(spark, work, tmp_path):
    domains = spark.createDataFrame([("Brand#11", ["x"]), ("Other", ["y"]), (None, ["z"]), ("", None)], "name string, keywords array<string>")
    rules = spark.createDataFrame([("Z_1", "Do", None), ("Z_2", None, "INFO")], "code string, statement string, severity string")
    decisions = spark.createDataFrame([("D", ["f"], "why", None), ("D", ["f"], None, None)], "domain string, functions array<string>, reason string, created_at date")
    given = {"domains": domains, "constraints": rules, "decisions": decisions}
    assert {k: v.first()[0] for k, v in work.import_knowledge(given, dry_run=True).items()} == {"domains": 1, "constraints": 1, "decisions": 1}
    out = work.import_knowledge(given)
    assert out["constraints"].where("code = 'Z_1'").first()["severity"] == "WARNING" and out["domains"].where("name = 'Other'").count() == 1
    added = out["decisions"].where("domain = 'D'").first()
    assert (added["revert_risk"], added["status"]) == ("LOW", "active")
    assert set(work.import_knowledge({"domains": domains})) == {"domains"}
    word = work.g.symbols.first()["name"].split("_")[0].lower()
    (tmp_path / "_index.md").write_text(f"---\ncovers: [{word}/_index.md]\n---\n")
    state = work.import_tree(str(tmp_path))
    assert state["domains"].where(F.lower("name") == word).count() == 1 and state["domain_symbols"].where(F.lower("domain") == word).count() > 0


def test_long_and_deep_places(spark):
    symbols = spark.createDataFrame([(1, 7, 1, 500), (2, 7, 100, 130), (3, 7, 120, 125), (4, 8, 5, 4)], "id long, file_id long, start_line long, end_line long")
    places = spark.createDataFrame([(1, 7, 122), (2, 7, 499), (3, 7, 900), (4, 8, 4), (5, 9, 1), (6, 7, None)], "place_id long, file_id long, line long")
    got = {r["place_id"]: (r["symbol_id"], r["enclosed"]) for r in G.enclosing(places, symbols).collect()}
    assert got == {1: (3, True), 2: (1, True), 3: (1, False), 4: (4, False), 6: (1, False)}


def test_lookup_by_kind_scores_among_all(spark, work, busy):
    text = busy["name"].replace("_", " ")
    columns = ["rank", "id", "kind", "bm25"]

    def rows(index):
        return [(r["rank"], r["id"], r["kind"], round(r["bm25"], 9)) for r in work.lookup(text, kind=busy["kind"], index=index).select(columns).orderBy("rank").collect()]

    plain = rows(None)
    assert plain and plain == rows(work.text_index(scratch(spark, "index"))) == rows(work.kept_index(scratch(spark, "segments")))
    every = {r["id"]: round(r["bm25"], 9) for r in work.lookup(text, limit=100).collect()}
    assert all(every.get(i, s) == s for _, i, _, s in plain)


def test_impact_of_one_direction(work, busy):
    both, _ = work.impact(busy["qualified_name"], 2)
    rows = sorted(map(tuple, both.collect()))
    for direction in ("upstream", "downstream"):
        part, risk = work.impact(busy["qualified_name"], 2, direction)
        assert sorted(map(tuple, part.collect())) == [r for r in rows if r[0] == direction]
        assert risk.first()["downstream_count" if direction == "upstream" else "upstream_count"] == 0
    with pytest.raises(ValueError, match="direction"):
        work.impact(busy["qualified_name"], 2, "sideways")


def test_update_graph_follows_a_tree(spark, work, tmp_path):
    (tmp_path / "a.py").write_text("def one():\n    two_of()\n")
    (tmp_path / "b.py").write_text("def two_of():\n    pass\n")
    store = scratch(spark, "graph")
    assert work.update_graph(str(tmp_path), store).edges.count() == 1
    (tmp_path / "b.py").unlink()
    (tmp_path / "c.py").write_text("def three():\n    one()\n")
    kept = work.update_graph(str(tmp_path), store)
    assert sorted(r["name"] for r in kept.symbols().collect()) == ["one", "three"] and kept.edges.count() == 1
    assert work.update_graph(str(tmp_path), store).store.last["counts"]["sites_new"] == 0


def test_an_index_in_use_can_be_made_again(spark, work, busy):
    path = scratch(spark, "index")
    first = work.text_index(path)
    asked = spark.createDataFrame([("q", 0, "no_such_word", False, True), ("p", 0, busy["name"].split("_")[0], False, True)], "query string, slot int, term string, prefix boolean, required boolean")
    found = first.search(asked)
    work.text_index(path)
    assert found.count() > 0 and first.store.refresh().version == 2


def test_registry_saved_over_itself(spark, tmp_path):
    from loomgraph.sources import imports

    where = str(tmp_path / "registry.json")
    given = spark.createDataFrame([("a", "/a", 1, None)], "name string, path string, symbol_count long, last_indexed timestamp")
    for k in range(2):
        more = spark.createDataFrame([(f"p{k}", f"/p{k}", k, None)], given.schema)
        imports.save_registry(imports.registered(imports.load_registry(spark, where), given.unionByName(more)), where)
    assert sorted(r["name"] for r in imports.load_registry(spark, where).collect()) == ["a", "p0", "p1"]
    (tmp_path / "registry.json").rename(tmp_path / "registry.json.before")  # as if a save had been cut short
    assert imports.load_registry(spark, where).count() == 3
