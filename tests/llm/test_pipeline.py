"""The pipeline over the smallest tables, stage by stage against plain rules."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, before, DIR), name)
        seen[name] = after.count()
        if name != "packed":
            assert after.columns == docs.columns
            assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
        else:
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}
        before = after
    assert docs.count() >= seen["quality"] >= seen["near_duplicates"] == seen["repeated_passages"] >= seen["contamination"] > 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_stages(rows, items, accepted):
    """Ids and texts after each of the first four stages, pair by pair and window by window."""
    rows = [r for r in rows if r[0] in accepted]
    yield {d: t for d, t in rows}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for w in (words_of((t or "").translate({c: c + 32 for c in range(65, 91)})) for _, t in rows)]
    label = {d: d for d, _ in rows}
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            label[rows[a][0]] = label[rows[b][0]] = min(label[rows[a][0]], label[rows[b][0]])
    rows = [(d, t) for d, t in rows if label[d] == d]
    yield {d: t for d, t in rows}
    first = {}
    for d, t in sorted(rows):
        w = words_of(t)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    kept = []
    for d, t in rows:
        w = words_of(t)
        gone = {i + k for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for k in range(50)}
        kept.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
    yield dict(kept)
    normal = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {tuple(w[i : i + 13]) for w in map(normal, items) if w for i in range(max(1, len(w) - 12))}
    clean = {}
    for d, t in kept:
        w = normal(t)
        hit = {i + k for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(n)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean[d] = t
    yield clean


def test_every_stage_against_a_plain_version(spark):
    from loomgraph.llm import quality_mil

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    accepted = {r["doc_id"] for r in quality_mil.digest(docs, labels).where("predicted = 1").collect()}
    want = plain_stages([(r["doc_id"], r["text"]) for r in docs.collect()], items, accepted)
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = corpus_pipeline.stored(stage(spark, docs, DIR), name)
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == plain, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    joined = {}
    for r in sorted(packed.collect(), key=lambda r: r["piece"]):
        joined.setdefault(r["doc_id"], []).extend(words_of(r["words"]))
    assert joined == {d: words_of(t) for d, t in plain.items()}


def test_stages_take_any_rows(spark):
    """Nulls in every column, empty and very long texts, repeats, ties, clashing columns, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, node string, key string, spans string, words string"
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, long), (2, long), (3, None), (4, ""), (5, "a b c"), (5, "a b c"), (None, "a b c"), (None, None), (6, " \n")]
    docs = spark.createDataFrame([(i, t, None, None, None, "s", "n", "k", "p", "w") for i, t in rows], schema).repartition(3)
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.stored(stage(spark, frame, DIR), name)
            if name == "packed":
                assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in frame.collect()}
            else:
                assert out.columns == docs.columns and out.count() <= frame.count()
                assert {r["key"] for r in out.collect()} <= {"k"}
