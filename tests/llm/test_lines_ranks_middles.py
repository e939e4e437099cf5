"""Line dedup, ranked lexical search and fill-in-middle against plain versions, on nulls, ties, repeats, long texts, extra columns and empty tables."""

import hashlib
import math
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import fill_middle, lexical_rank, line_dedup

SCHEMA = "doc_id long, text string, n long, Output string, `rank` string, place string, n_dropped string, _row0 string, _h0 string"
COMMON, OTHER = "The same line in all of these documents", "ÄÖ another line, which three of them hold"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts():
    rows = [
        (0, f"{COMMON}\nshort\nOnly here, but long enough to count"), (1, f"  \t{COMMON.upper()}\x0b\n{OTHER}\nshort"), (2, f"{COMMON} \n\nx\n{OTHER}"), (3, f"{OTHER}\r\n{COMMON}\n{COMMON}\ntail\n"), (4, None), (5, ""), (6, "\n"), (7, "\n\n  \n"),
        (8, " " + COMMON), (8, "repeated id\n" + COMMON), (9, "twice in one document, twice\n" * 5), (10, "twice in one document, twice"), (11, "exactly-20-characters\nexactly 20 code äöü.."), (12, "exactly 20 code äöü.."), (13, "exactly 20 code äöü.."),
        (14, "nineteen characters\nä"), (15, "nineteen characters"), (16, "nineteen characters"), (None, f"no id\n{COMMON}\n{OTHER}"), (None, "no id and alone in that, really"), (17, "same row\n" + OTHER), (17, "same row\n" + OTHER), (17, "same row\n" + OTHER),
        (18, "<P> is a mark\nso this stays"), (19, "a < P > b\n<p>\n<\nP>"), (-3, "a\nb\nc\nd\ne"), (20, "word " * 30_000 + "\n" + (COMMON + "\n") * 3_000), (21, "line one\nline two\n" * 4_000),
    ]
    return rows + [(100 + i, f"{i % 7} of seven lines that many have\nown line number {i} of this document") for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x", "y", "z", "w", "v", "u") for i, t in texts()], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- line dedup


def plain_lines(rows):
    def key(line):
        return re.sub("[A-Z]+", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20 and i is not None:
                held[key(line)].add(i)
    gone = {k: max(ids) for k, ids in held.items() if len(ids) >= 3}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def in_order(rows):
    return sorted(rows, key=str)


def test_lines_match_a_plain_version(docs):
    got = line_dedup.without_repeated_lines(docs)
    assert got.columns == [c for c in docs.columns if c != "n_dropped"] + ["n_lines", "n_dropped"]
    rows = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()]
    want = plain_lines(texts())
    assert in_order((i, n, d, t or "") for i, n, d, t in rows) == in_order(want)
    assert [t for i, _, _, t in rows if i == 4] == [None]
    assert sum(d for *_, d, _ in rows) > 60
    digest = [tuple(r) for r in line_dedup.digest(docs).collect()]
    assert in_order(digest) == in_order((i, n, d, sha(t)) for i, n, d, t in want)


def test_lines_too_many_for_a_broadcast(docs, monkeypatch):
    want = in_order(map(tuple, line_dedup.digest(docs).collect()))
    for most in (1, 100):  # all, or most, repeated lines are joined by a shuffle
        monkeypatch.setattr(line_dedup, "FREQUENT", most)
        assert in_order(map(tuple, line_dedup.digest(docs.repartition(2, "text")).collect())) == want


def test_other_limits_of_lines(spark):
    docs = spark.createDataFrame([(1, "ab\ncd"), (2, "AB \nef"), (3, "ef")], "doc_id long, text string")
    rows = line_dedup.without_repeated_lines(docs, min_chars=2, min_docs=2).collect()
    assert sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in rows) == [(1, "cd", 1), (2, "AB ", 1), (3, "ef", 0)]


def test_lines_of_a_large_batch_are_put_together_in_pieces():
    """A batch of 64 MB is what Spark hands over at most; the pieces and what is held at once stay far below."""
    line = "ein längerer Satz – много слов и знаков, 漢字 und so weiter\n"
    long = line * 13_000  # some 1 MB
    rows = [long if i % 2 else None if i % 8 == 0 else f"{i}\n{long}" for i in range(64)] + [long * 6]
    gone = [None if i % 3 else [0, 2] for i in range(65)]
    batch = pa.record_batch([pa.array(range(65)), pa.array(rows), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "text", "gone"])
    tracemalloc.start()
    kept, made = 0, []
    before = pa.total_allocated_bytes()
    for part in line_dedup.kept_lines(batch, 1, ["doc_id", "text"]):
        assert part.num_rows == 1 or len("".join(t or "" for t in part["text"].to_pylist()).encode()) <= line_dedup.BATCH_BYTES
        made += [(r["doc_id"], r["n_lines"], r["n_dropped"], sha(r["text"] or "")) for r in part.to_pylist()]
        kept = max(kept, pa.total_allocated_bytes() - before)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    cut = [(t or "").split("\n") for t in rows]
    assert made == [(i, len(c), len(g or ()), sha("\n".join(x for k, x in enumerate(c) if k not in (g or ())))) for i, (c, g) in enumerate(zip(cut, gone, strict=True))]
    assert kept < 16 << 20 and most < 64 << 20


def test_lines_that_are_no_utf8_stay_as_they_are(spark):
    docs = spark.createDataFrame([(i, b"\xff\xfe%d\n" % i + COMMON.encode()) for i in range(3)], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    rows = line_dedup.without_repeated_lines(docs).select("doc_id", F.hex("text").alias("text"), "n_lines", "n_dropped").collect()
    assert sorted((r["doc_id"], bytes.fromhex(r["text"]), r["n_lines"], r["n_dropped"]) for r in rows) == [(i, b"\xff\xfe%d" % i + (b"\n" + COMMON.encode()) * (i == 2), 2, int(i < 2)) for i in range(3)]


def test_no_lines(none):
    assert line_dedup.digest(none).collect() == []
    assert line_dedup.digest(none).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


# ---------------------------------------------------------------- ranked search


def terms(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def plain_ranks(docs, items, top=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    size, total, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            n = sum(c.values())
            m = 100 - 75 + 75 * n * size // total
            score = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return in_order(out)


def corpus(seed=5, n=300):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(120)] + ["Straße", "x²", "don", "t", "É1", "ILL"]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    rows = [(int(rng.integers(0, 250)), " ".join(rng.choice(vocabulary, int(rng.integers(1, 60)), p=weight / weight.sum()))) for _ in range(n)]
    rows += [(900 + k, "tie of the same words") for k in range(30)] + [(5, "tie of the same words"), (None, "tie of the same words"), (None, None), (901, ""), (902, "!!! --"), (903, "Don't, ILL! straße x² " * 4_000)]
    return rows, [(1, "w3 w17 W40 w99"), (2, "tie, TIE of words"), (3, None), (4, ""), (5, "... !"), (6, "nowhere at all"), (7, "w1 " * 50 + "w2"), (7, "another item of that id: w80 straße É1"), (None, "x² don't"), (9, "w3 w17 W40 w99"), (9, "w3 w17 W40 w99")] + [(20 + k, " ".join(rng.choice(vocabulary, 12))) for k in range(150)]


@pytest.fixture(scope="module")
def searched(spark):
    docs, items = corpus()
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, item_id long").repartition(7), spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id long, `rank` string"), plain_ranks(docs, items)


def test_ranks_match_a_plain_version(searched):
    docs, items, want = searched
    got = lexical_rank.search(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.schema["rank"].dataType.simpleString() == "int"
    assert in_order(map(tuple, got.collect())) == want
    assert sum(1 for r in want if r[0] == 2) == 10 and want.count(want[0]) >= 1


def test_ranks_in_small_tiles_and_several_passes(searched, monkeypatch):
    docs, items, want = searched
    assert in_order(map(tuple, lexical_rank.search(docs.repartition(2), items, pass_items=60).collect())) == want
    assert in_order(map(tuple, lexical_rank.search(docs.repartition(3), items, pass_bytes=1_500).collect())) == want


def test_tiles_hold_partial_sums_under_the_bound():
    rng = np.random.default_rng(1)
    texts = [(k, 0, " ".join(rng.choice([f"t{j}" for j in range(5_000)], 400))) for k in range(100)] + [(100, 0, "often " * 50 + "t1"), (101, 0, "")]
    items = lexical_rank.read_items(texts)
    weights = rng.integers(0, 30_000, len(items.vocabulary))
    heavy = int(np.searchsorted(items.vocabulary, next(lexical_rank.hashed_terms(pa.array(["often"])))[1][0]))
    weights[heavy] = lexical_rank.EXACT // lexical_rank.MOST_IMPACT // 7  # times 50: more than one column may hold
    total = np.zeros((len(items.keys), len(items.vocabulary)), np.int64)
    for a, _, parts in lexical_rank.tiles(items, weights):
        for columns, item, column, weight in parts:
            sums = np.bincount(item, weight, minlength=1)
            assert sums.max(initial=0) * lexical_rank.MOST_IMPACT < lexical_rank.EXACT and len(columns) <= lexical_rank.TERM_TILE
            np.add.at(total, (a + item, columns[column]), weight)
    for k in range(len(items.keys)):
        cells = slice(items.first[k], items.first[k + 1])
        assert (total[k, items.terms[cells]] == items.times[cells] * weights[items.terms[cells]]).all()
    assert total[100, heavy] == 50 * weights[heavy]


def test_best_keeps_ties_by_id_and_nulls_last():
    best = lexical_rank.Best(1, 3)
    for ids, scores, missing in (([9, 8, 7], [5, 5, 5], [False] * 3), ([1, 0, 6], [5, 5, 4], [False, True, False]), ([2], [6], [False])):
        best.take(0, np.array([scores]), np.array(ids), np.array(missing))
    score, none, doc = best.held[0]
    assert list(zip(score.tolist(), none.tolist(), doc.tolist(), strict=True)) == [(6, False, 2), (5, False, 1), (5, False, 7)]


def test_length_parts_beyond_64_bits():
    n, documents, total = np.array([1, 10**7]), 10**12, 10**15
    assert lexical_rank.length_parts(n, documents, total).tolist() == [25 + 75 * k * documents // total for k in n.tolist()]


def test_ranks_of_empty_tables(spark, searched):
    docs, items, _ = searched
    assert lexical_rank.search(docs.limit(0), items).collect() == []
    assert lexical_rank.search(docs, items.limit(0)).collect() == []
    assert lexical_rank.search(docs.where("text is null"), items).collect() == []


# ---------------------------------------------------------------- fill-in-middle


def plain_middle(i, text, fim=100, spm=50):
    text = text or ""
    unit = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(unit) + 1) for x in h[:2])
    p, m, s = "".join(unit[:a]), "".join(unit[a:b]), "".join(unit[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return i, len(unit), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return i, len(unit), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_middles_match_a_plain_version(docs):
    rows = fill_middle.fill_middle(docs)
    assert rows.columns == ["doc_id", "text", "rank", "place", "n_dropped", "_row0", "_h0", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = [tuple(r) for r in rows.select("doc_id", *fill_middle.ADDED).collect()]
    want = [plain_middle(i, t) for i, t in texts()]
    assert in_order(got) == in_order(want)
    assert {f for _, _, f, *_ in got} == {"plain", "spm", "psm"}
    back = rows.select("text", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all((r["text"] or "") == r["back"] for r in back)
    digest = [tuple(r) for r in fill_middle.digest(docs).collect()]
    assert in_order(digest) == in_order((*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, texts(), strict=True))


def test_middles_of_some_texts_only(spark):
    docs = spark.createDataFrame([(i, "one\ntwo\nthree\n") for i in range(200)], "doc_id long, text string")
    got = fill_middle.fill_middle(docs, fim_percent=40, spm_percent=90).select("doc_id", *fill_middle.ADDED).collect()
    assert in_order(map(tuple, got)) == in_order(plain_middle(i, "one\ntwo\nthree\n", 40, 90) for i in range(200))
    assert 90 < sum(r["form"] == "plain" for r in got) < 150


def test_texts_that_a_batch_is_cut_at(docs, monkeypatch):
    batch = pa.record_batch([pa.array([t for _, t in texts()])], names=["text"])
    monkeypatch.setattr(fill_middle, "BATCH_BYTES", 100)
    parts = list(fill_middle._slices(batch, 0))
    assert len(parts) > 10 and pa.Table.from_batches(parts)["text"].to_pylist() == batch["text"].to_pylist()


def test_no_middles(none):
    assert fill_middle.digest(none).collect() == []
