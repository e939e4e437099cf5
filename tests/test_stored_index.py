"""The stored index: versions, restarts, what a batch reads, schemas, merges, against index runs made anew."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.jobs import index
from loomgraph.sources.store import Store, StoreError, Table
from loomgraph.sources.tables import shared_folder

FILES = "path string, lang string, content_hash string, text string"


def source(rng, names=12):
    """A Python file whose functions call names that several files define."""
    out = []
    for name in sorted(rng.sample(range(names), rng.randint(1, 4))):
        out.append(f"def name_{name}():\n" + "".join(f"    name_{rng.randrange(names)}()\n" for _ in range(3)) + "    return 1\n")
    return "\n".join(out)


def frame(spark, texts):
    return spark.createDataFrame([(p, "python", None if t is None else str(hash(t)), t) for p, t in texts.items()], FILES)


def edges(rows):
    return sorted(map(tuple, rows.select("source_id", "target_id", "kind", "confidence").collect()))


def same_as_anew(spark, stored, texts, hints=None):
    full = index.build(frame(spark, {p: t for p, t in texts.items() if t is not None}), hints=hints)
    assert edges(stored.edges) == edges(full.edges)
    columns = ["id", "path", "name", "kind", "start_line", "end_line", "signature", "doc"]
    assert sorted(map(str, stored.symbols().select(columns).collect())) == sorted(map(str, full.symbols.select(columns).collect()))
    assert sorted(r["path"] for r in stored.files.collect()) == sorted(r["path"] for r in full.files.collect())
    assert sorted(r["path"] for r in stored.errors.collect()) == sorted(r["path"] for r in full.errors.collect())


@pytest.mark.parametrize("hinted", [True])
def test_batches_give_what_a_run_anew_gives(spark, tmp_path, hinted):
    rng = random.Random(4)
    hints = spark.createDataFrame([("python", "name_3", "name_7"), ("rust", "x", "name_1")], "lang string, pattern string, resolves_to string") if hinted else None
    known = {f"f{k:02}.py": source(rng) for k in range(12)}
    stored = index.StoredIndex(spark, str(tmp_path / "s"), hints, merge_at=3, cut_rows=20)
    stored.apply(frame(spark, known))
    for step in range(2):
        batch = {p: source(rng) for p in rng.sample(sorted(known), 2)} | {f"g{step}.py": source(rng), f"f{step:02}.py": None, "never.py": None}
        batch |= {"broken.py": "def f(:\n"} if step == 1 else {}
        batch |= {"f05.py": known["f05.py"]} if step == 0 else {}  # the same as before
        known |= batch
        stored.apply(frame(spark, batch))
    same_as_anew(spark, stored, known, hints)
    before = edges(stored.edges)
    stored.compact()
    assert stored.store.vacuum() > 0 and stored.store.versions() == [stored.store.version]
    again = index.StoredIndex(spark, str(tmp_path / "s"), hints)
    assert edges(again.edges) == before and {len(s) for t, s in again.store.last["segments"].items() if t != "errors"} == {1}
    again.apply(frame(spark, {"f05.py": None}))
    same_as_anew(spark, again, known | {"f05.py": None}, hints)
    if hinted:
        with pytest.raises(StoreError, match="hints"):
            index.StoredIndex(spark, str(tmp_path / "s"), hints.limit(1)).apply(frame(spark, {"h.py": "def h():\n    pass\n"}))


def test_a_small_batch_reads_few_call_sites(spark, tmp_path):
    texts = {f"m{k:03}.py": f"def only_{k}():\n    only_{(k + 1) % 90}()\n    only_{(k + 7) % 90}()\n" for k in range(90)}
    stored = index.StoredIndex(spark, str(tmp_path), cut_rows=100)
    assert stored.apply(frame(spark, texts))["counts"]["sites_new"] == 180
    steps = len(glob.glob(f"{shared_folder(spark)}/step-*"))
    counts = stored.apply(frame(spark, {"m000.py": "def only_0():\n    only_5()\n"}))["counts"]
    assert len(glob.glob(f"{shared_folder(spark)}/step-*")) == steps  # nothing is left behind
    assert counts == {"sites_new": 1, "sites_read": 0, "sites_held": 180}  # no name has another first symbol
    counts = stored.apply(frame(spark, {"m003.py": "\n\ndef only_3():\n    only_5()\n"}))["counts"]
    assert counts["sites_new"] == 1 and 2 <= counts["sites_read"] < 25
    same_as_anew(spark, stored, texts | {"m000.py": "def only_0():\n    only_5()\n", "m003.py": "\n\ndef only_3():\n    only_5()\n"})


def test_a_batch_that_comes_again_and_one_that_is_lost(spark, tmp_path, monkeypatch):
    stored = index.StoredIndex(spark, str(tmp_path))
    one = {"a.py": "def aaa():\n    bbb()\n", "b.py": "def bbb():\n    pass\n"}
    stored.apply(frame(spark, one), 0)
    with monkeypatch.context() as m:  # killed when everything but the manifest is written
        m.setattr(Store, "_write", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            stored.apply(frame(spark, {"a.py": "def aaa():\n    pass\n"}), 1)
    again = index.StoredIndex(spark, str(tmp_path))
    assert again.store.version == 1 and len(edges(again.edges)) == 1
    again.apply(frame(spark, {"a.py": "def aaa():\n    pass\n"}), 1)
    again.apply(frame(spark, {"a.py": "never laid"}), 1)
    again.apply(frame(spark, {"a.py": "never laid"}), 0)
    assert again.store.version == 2 and edges(again.edges) == []
    with pytest.raises(StoreError, match="another writer"):
        stored.apply(frame(spark, {"c.py": "def ccc():\n    pass\n"}), 7)
    assert again.store.vacuum() > 0 and edges(again.edges) == []


def test_stream_that_is_killed_between_batches(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    known = {}

    def run():
        stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = index.index_stream(stream, index.StoredIndex(spark, str(tmp_path / "s")), "sources")
        query = query.option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()

    for k in range(3):
        batch = {f"f{j}.py": source(rng) for j in range(3 * k, 3 * k + 5)}
        known |= batch
        frame(spark, batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole, calls = index.StoredIndex.apply, []

    def dies(self, batch, number=None, stream="stream"):
        calls.append(number)
        out = whole(self, batch, number, stream)
        if len(calls) == 2:
            raise RuntimeError("killed after its commit, before the stream's own")
        return out

    with monkeypatch.context() as m:
        m.setattr(index.StoredIndex, "apply", dies)
        with pytest.raises(Exception, match="killed"):
            run()
    run()
    stored = index.StoredIndex(spark, str(tmp_path / "s"))
    assert stored.store.version == 3 and stored.store.last["streams"] == {"sources": 2}
    rows = spark.read.parquet(str(tmp_path / "in"))
    assert rows.count() == 15
    same_as_anew(spark, stored, known)


# ---------------------------------------------------------------- schemas

OLD = {"files": Table("path string, lang string", "path")}
NEW = {"files": Table("path string, lang string, content_hash string, centrality double", "path", defaults={"content_hash": "''", "centrality": "0.0"}), "meta": Table("key string, value string")}


def test_a_store_of_an_older_schema_is_taken_over_once(spark, tmp_path):
    Store(spark, str(tmp_path), OLD, 1, cut_rows=2).commit({"files": spark.createDataFrame([("a", "x"), ("b", None)], "path string, lang string")}, {"owner": "me"})
    store = Store(spark, str(tmp_path), NEW, 2)
    assert (store.version, store.last["schema"], store.last["owner"]) == (2, 2, "me")
    assert sorted(map(tuple, store.read("files").collect())) == [("a", "x", "", 0.0, 1), ("b", None, "", 0.0, 1)] and store.read("meta").collect() == []
    store.commit({"files": spark.createDataFrame([("c", "y", None, None)], "path string, lang string, content_hash string, centrality double"), "meta": spark.createDataFrame([("k", "v")], "key string, value string")})
    again = Store(spark, str(tmp_path), NEW, 2)
    assert again.version == 3  # no second time
    assert sorted(map(str, again.read("files").collect())) == sorted(map(str, store.read("files").collect()))
    assert [tuple(r) for r in again.read("files").where("path = 'c'").collect()] == [("c", "y", None, None, 3)]  # null where it was written so
    with pytest.raises(StoreError, match="schema 2"):
        Store(spark, str(tmp_path), OLD, 1)


def test_merges_write_in_proportion_to_what_comes(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"t": Table("k long", "k")}, merge_at=3)
    for i in range(12):
        store.commit({"t": spark.range(10 * i, 10 * i + 10).select(F.col("id").alias("k"))})
    sizes = [s["rows"] for s in store.last["segments"]["t"]]
    assert sum(sizes) == 120 and len(sizes) <= 5 and all(a >= 2 * b for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    assert sorted(r["k"] for r in store.read("t").collect()) == list(range(120))
    assert dict(store.read("t").groupBy("_version").count().collect()) == {i: 10 for i in range(1, 13)}


def test_only_folders_of_the_values_asked_for_are_read(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"t": Table("k long", "k")}, cut_rows=10)
    store.commit({"t": spark.range(1000).select(F.col("id").alias("k"))})
    rows = store.read("t", spark.createDataFrame([(7,), (8,)], "k long"))
    assert 2 <= rows.count() < 40 and {7, 8} <= {r["k"] for r in rows.collect()}
    assert store.read("t", spark.createDataFrame([], "k long")).count() == 0
