"""Indexes in segments and in blocks against searches without an index; expressions by grams; strings in texts against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import grams, text_store
from loomgraph.operators import knowledge as K
from loomgraph.operators import retrieval as R
from loomgraph.sources.tables import scratch

FIELDS = "id long, name string, name_tokens string, signature string, doc string"


def symbols(spark, ids, seed):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(40)] + ["common"] * 20

    def row(i):
        return (i, "_".join(rng.sample(words, 2)), None, " ".join(rng.choices(words, k=rng.choice([2, 3, 30]))), " ".join(rng.choices(words, k=rng.choice([0, 1, 60]))) or None)

    return spark.createDataFrame([row(i) for i in ids], FIELDS)


def queries(spark, *texts):
    rows = spark.createDataFrame([(t,) for t in texts], "query string")
    return rows.select("query", F.explode(R.query_terms(F.col("query"))).alias("t")).select("query", "t.*")


ASKED = ("common word3", "word1", "word7 word", "nowhere", "word12 common word2", "com")


def found(df, key="id"):
    return sorted((r["query"], r[key], round(r["bm25"], 9)) for r in df.collect())


def test_segments_give_what_a_new_index_gives(spark):
    index = text_store.SegmentIndex(spark, scratch(spark, "segments"), merge_at=3, dead_share=0.6)
    rows = {r["id"]: r for r in symbols(spark, range(120), 1).collect()}
    asked = queries(spark, *ASKED)
    wrote = [index.update(symbols(spark, range(120), 1))["wrote"]]
    for step, (ids, gone) in enumerate([(range(110, 130), [3, 4, 999]), ([3, 50], [50, 60])]):
        new = symbols(spark, ids, 10 + step)
        wrote.append(index.update(new, spark.createDataFrame([(i,) for i in gone], "id long"))["wrote"])
        rows |= {r["id"]: r for r in new.collect()}
        rows = {i: r for i, r in rows.items() if i not in gone or i in ids}
        assert found(index.search(asked)) == found(R.bm25(spark.createDataFrame(list(rows.values()), FIELDS), asked))
    assert [w["rows"] for w in wrote] == [120, 20, 2] and wrote[2]["postings"] < wrote[0]["postings"] / 10
    again = text_store.SegmentIndex(spark, index.store.path)
    before = found(again.search(asked))
    again.compact()
    assert found(again.search(asked)) == before and again.store.read("dead").isEmpty()
    assert again.store.read("postings").select("key").distinct().count() == len(rows) == again.store.last["n"]
    index = text_store.SegmentIndex(spark, index.store.path)
    index.update(gone=spark.createDataFrame([(i,) for i in rows], "id long"))
    assert index.search(asked).collect() == [] and index.store.read("postings").isEmpty()  # mostly dead: put together by itself


def test_many_words_at_once_are_not_broadcast(spark, monkeypatch):
    rows, asked = symbols(spark, range(60), 2), queries(spark, *ASKED)
    want = found(R.bm25(rows, asked))
    monkeypatch.setattr(R, "QUERY_WORDS", 2)
    assert found(R.bm25(rows, asked)) == want


def test_blocks_give_the_best_rows_and_pass_over_others(spark):
    rows, asked = symbols(spark, range(1500), 3), queries(spark, *ASKED)
    optional = asked.unionByName(spark.createDataFrame([("word1", 1000, "word5", False, False)], asked.schema))
    index = text_store.BlockIndex(spark, scratch(spark, "blocks")).write(rows, block=20)
    for limit, these in ((5, asked), (5, optional), (10_000, asked)):
        full = R.top_by(R.bm25(rows, these).withColumn("bm25", F.round("bm25", 9)), "bm25", "id", limit)
        want = sorted((r["query"], r["rank"], r["id"]) for r in full.collect())
        assert sorted((r["query"], r["rank"], r["id"]) for r in index.top(these, limit).collect()) == want
    judged = index.blocks(asked, 5)[0].groupBy("query").agg(F.count("*").alias("blocks"), F.count(F.when(F.col("read"), 1)).alias("read")).collect()
    counts = {r["query"]: (r["read"], r["blocks"]) for r in judged}
    assert all(read <= blocks for read, blocks in counts.values()) and sum(r for r, _ in counts.values()) < 0.75 * sum(b for _, b in counts.values())


TEXTS = ["def foo(bar):\n    return FooBar\n", "class Öl:\n  pass # foo.bar", "", "abcabc\nabd", "foo\nbar", "x" * 5000 + "needle", "hay\nNEEDLE stack", "colour and color", "a.b", None, "tab\tseparated foo bar"]
PATTERNS = [
    "foo", "^foo", "foo$", "foo|needle", "(?:foo|nee)dle", "col(ou|o)r", "a[bc]d", "fo+b?ar", "[a-z]+", "ab{2,}c", "(abc){2}", "n..dle", "foo.bar", r"foo\.bar", r"\bclass\b", "(?i)NEEDLE", "Öl", "(foo|b).*(bar|x)", "(?=foo)foo", "(?!foo)bar", "x*needle", "retu?rn", "(", "", "a|", "s{0}tab",
]


@pytest.mark.parametrize("sensitive", [False, True])
def test_expressions_by_grams(spark, sensitive):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    index = grams.GramIndex(spark, scratch(spark, "grams")).write(docs)
    opened = {}
    for pattern in PATTERNS:
        for is_regex in (True, False):
            try:
                re.compile(pattern)
            except re.error:
                if is_regex:
                    continue
            want = sorted(map(tuple, R.grep(docs, pattern, is_regex, sensitive).collect()))
            assert sorted(map(tuple, index.grep(docs, pattern, is_regex, sensitive).collect())) == want, pattern
            if is_regex and (few := index.candidates(pattern, True)) is not None:
                opened[pattern] = few.count()
        if sensitive:
            break  # once is enough for the second parameter
    if not sensitive:
        assert opened["foo|needle"] == 6 and opened["(?:foo|nee)dle"] <= 3 and opened["foo.bar"] <= 4 and "[a-z]+" not in opened and "a[bc]d" not in opened and opened["retu?rn"] == 1


def test_what_expressions_need():
    assert grams.needs_of("a.b").free and grams.needs_of("(abc|x)").free and not grams.needs_of("(abc|xyz)").free
    gram = {int(g) for g in grams.grams_of(b"abc")}
    assert grams.needs_of("^ABC$").all_grams() == gram and grams.needs_of("(?:abc)+").all_grams() == gram and grams.needs_of("abc*").free
    assert list(grams.grams_of(b"ab\ncd")) == [] and len(grams.grams_of(b"ab", short=True)) == 3


def test_strings_in_texts_match_all_pairs(spark):
    rng = random.Random(5)
    texts = [(f"k{i}", "".join(rng.choice("abcé \n") for _ in range(rng.choice([0, 3, 40, 3000])))) for i in range(80)] + [("none", None)]
    needles = [None, "", "a", "é", "\n", "ab", "abc", "c\na", "\nb", "aé", "nowhere", "zzz"] + ["".join(rng.choice("abcé") for _ in range(n)) for n in range(1, 9) for _ in range(6)] + ["abc"]
    df = grams.contained(spark.createDataFrame(texts, "key string, text string").repartition(3), spark.createDataFrame([(n,) for n in needles], "needle string"))
    want = sorted((k, n) for k, t in texts for n in set(needles) if t is not None and n is not None and n in t)
    assert sorted(map(tuple, df.collect())) == want
    plan = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("BroadcastNestedLoopJoin") <= 2 and "CartesianProduct" not in plan  # the empty needle's one row


def test_many_targets_and_keywords(spark):
    paths = [(f"src/mod{i}/file_{i % 7}.py",) for i in range(300)]
    targets = [(f"mod{i}/file",) for i in range(0, 12_000)] + [("src/mod7/file_0.py/deep",), (None,)]
    got = sorted(map(tuple, K.stale(spark.createDataFrame(paths, "path string"), spark.createDataFrame(targets, "target string")).collect()))
    want = sorted({(t, p) for (t,) in targets if t for (p,) in paths if t in p or p in t})
    assert got == want and len(got) == 301


def test_decisions_by_index_or_by_text(spark):
    decisions = spark.createDataFrame([(1, ["known"]), (2, ["written_only", "other"]), (3, ["nowhere"]), (4, []), (5, ["nowhere", "known"]), (6, [""]), (7, None)], "id long, functions array<string>")
    sources = spark.createDataFrame([("a.py", "def x():\n    written_only()\n"), ("b.py", None)], "path string, text string")
    rows = K.validated(decisions, spark.createDataFrame([("known",)], "name string"), sources).collect()
    assert {r["id"]: (r["validated"], r["validated_by"]) for r in rows} == {1: (True, "index"), 2: (True, "text"), 3: (False, None), 4: (False, None), 5: (True, "index"), 6: (False, None), 7: (False, None)}
