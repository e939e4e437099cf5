"""The graph in a folder: opened, taken over from older forms, saved whole, asked by a workspace; rows numbered by ranges."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.jobs.api import Workspace
from loomgraph.operators import graph as G
from loomgraph.sources.graph_store import GraphStore
from loomgraph.sources.store import Store, Table


def test_open_save_and_ask(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        GraphStore(spark, str(tmp_path / "none"), create=False)
    store = GraphStore(spark, str(tmp_path / "s"))
    assert store.symbols.collect() == [] and Workspace(store).brief().first()["layer_score"] == 0
    store.save(
        files=spark.createDataFrame([(1, "src/gateway.rs", "rust"), (2, "src/b.rs", "rust")], "id long, path string, lang string"),
        symbols=spark.createDataFrame([(1, 1, "run_gateway", "fn", 10, 50, "Main gateway loop"), (2, 1, "check_quota", "fn", 55, 70, None), (3, 2, "other", "fn", 1, 2, None)], "id long, file_id long, name string, kind string, start_line long, end_line long, doc string"),
        edges=spark.createDataFrame([(1, 2, "CALLS"), (3, 2, "CALLS")], "source_id long, target_id long, kind string"),
        domains=spark.createDataFrame([(1, "Gate", ["gateway"])], "id long, name string, keywords array<string>"),
        vectors=spark.createDataFrame([(1, [1.0]), (3, [0.5])], "symbol_id long, vector array<float>"),
    )
    work = Workspace(GraphStore(spark, str(tmp_path / "s"), create=False))
    assert [r["name"] for r in work.lookup("gateway").collect()] == ["run_gateway"]
    assert sorted(map(tuple, work.impact("check_quota")[0].select("direction", "name").collect())) == [("upstream", "other"), ("upstream", "run_gateway")]
    assert work.g.symbols.where("id = 1").select("qualified_name", "name_tokens", "centrality").first() == ("run_gateway", "run gateway", 0.0)
    again = work.g.drop_files(spark.createDataFrame([(2,)], "id long"))
    assert [r["id"] for r in again.symbols.orderBy("id").collect()] == [1, 2] and again.edges.count() == again.vectors.count() == 1 and again.domains.count() == 1
    decisions = spark.createDataFrame([(1, "Gate", "so", None, ["check_quota"], None)], "id long, domain string, reason string, revert_risk string, functions array<string>, supersedes_id long").withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    again.save(decisions=Workspace(again).record_decision(decisions))
    assert GraphStore(spark, again.path).decisions.select("id", "status", "revert_risk").first() == (1, "active", "LOW")


def test_older_forms_are_taken_over_once(spark, tmp_path):
    old = {"files": Table("id long, path string, lang string, size_bytes long, line_count long", "path"), "symbols": Table("id long, file_id long, name string, kind string, start_line long, end_line long, signature string, doc string", "id")}
    Store(spark, str(tmp_path / "old"), old, 1).commit({"files": spark.createDataFrame([(1, "a.py", "python", 3, 1)], old["files"].schema), "symbols": spark.createDataFrame([(1, 1, "runIt", "fn", 1, 1, None, None)], old["symbols"].schema)})
    store = GraphStore(spark, str(tmp_path / "old"))
    assert store.files.first()["content_hash"] == "" and store.symbols.select("name", "qualified_name", "name_tokens", "centrality").first() == ("runIt", "runIt", "run it", 0.0)
    assert store.vectors.collect() == [] and (store.store.version, GraphStore(spark, str(tmp_path / "old")).store.version) == (2, 2)
    spark.createDataFrame([(1, 2, "CALLS")], "source_id int, target_id int, kind string").write.parquet(str(tmp_path / "plain" / "edges.parquet"))
    assert [tuple(r) for r in GraphStore(spark, str(tmp_path / "plain"), create=False).edges.collect()] == [(1, 2, "CALLS", "name_match")]


@pytest.mark.parametrize("by", [None, "g"])
def test_places_by_ranges(spark, by):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, id int").repartition(5)
    got = {r["id"]: r["place"] for r in G.numbered(df, ["x", "id"], by).collect()}
    groups = {}
    for g, x, i in sorted(rows, key=lambda r: r[1:]):
        groups.setdefault(g if by else 0, []).append(i)
    assert got == {i: k + 1 for ids in groups.values() for k, i in enumerate(ids)}
