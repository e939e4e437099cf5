"""Ranked lexical search by dense blocked matrix products.

Items and documents meet as matrices: a tile of items times the vocabulary of those
items, and that vocabulary times a tile of documents, whose entries are the terms'
impacts. All are whole numbers in float64; vocabulary tiles end where a partial sum
could reach 2**53, so every product is exact, whatever order BLAS adds in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import forget, give_back, hashed_words, stored, text_buffers

TOP = 10
K_PART, B_PART = 8, 75  # impact: 10**9 * tf div (1000 * tf + K_PART * m), m = 100 - B_PART + (B_PART * n * N) div L
ITEM_TILE, TERM_TILE, DOC_TILE = 64, 2048, 512
EXACT = 2**53
MOST_IMPACT = 10**6
#: Items that one pass over the documents answers; more take more passes.
PASS_BYTES, PASS_ITEMS = 4 << 20, 20_000

#: Digits, letters and bytes beyond ASCII make terms, A-Z become a-z, all else separates.
_TERMS = np.full(256, 0x20, np.uint8)
_TERMS[0x30:0x3A] = np.arange(0x30, 0x3A)
_TERMS[0x41:0x5B] = np.arange(0x61, 0x7B)
_TERMS[0x61:0x7B] = np.arange(0x61, 0x7B)
_TERMS[0x80:] = np.arange(0x80, 0x100)


def hashed_terms(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """64-bit hashes of consecutive texts' terms: (first text, hashes, n + 1 offsets)."""
    data, offsets = text_buffers(texts)
    if len(offsets) > 1:
        low, high = int(offsets[0]), int(offsets[-1])
        yield from hashed_words(_TERMS[data[low:high]], offsets - low, False)


@dataclass
class Items:
    """What one pass asks for: item texts as counts of terms, numbered in ``vocabulary``."""

    keys: list[tuple[int, int]]
    vocabulary: np.ndarray  # sorted hashes
    first: np.ndarray  # n + 1 offsets into terms
    terms: np.ndarray
    times: np.ndarray


def read_items(texts: list[tuple[int, int, str]]) -> Items:
    """Items of (key, key, text), with the terms of each and how often it has them."""
    texts = sorted(texts)
    counts: list[tuple[np.ndarray, np.ndarray]] = []
    for _, hashes, at in hashed_terms(pa.array([t for _, _, t in texts], pa.string())):
        counts += [np.unique(hashes[a:b], return_counts=True) for a, b in zip(at, at[1:], strict=False)]
    every = np.concatenate([t for t, _ in counts]) if counts else np.zeros(0, np.uint64)
    vocabulary = np.unique(every)
    return Items([(a, b) for a, b, _ in texts], vocabulary, np.r_[0, np.cumsum([len(t) for t, _ in counts], dtype=np.int64)].astype(np.int64), np.searchsorted(vocabulary, every), np.concatenate([n for _, n in counts]) if counts else np.zeros(0, np.int64))


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tf) of every document: its number of terms, and those of the vocabulary with their occurrences."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        for batch in batches:
            for first, hashes, at in hashed_terms(batch.column(1)):
                rows, n = len(at) - 1, np.diff(at)
                of = np.repeat(np.arange(rows), n)
                place = np.minimum(np.searchsorted(words, hashes), max(0, len(words) - 1))
                hit = words[place] == hashes if len(words) else np.zeros(len(hashes), bool)
                cells, tf = np.unique(of[hit] * len(words) + place[hit], return_counts=True)
                offsets = np.searchsorted(cells, np.arange(rows + 1) * len(words)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in ((cells % max(1, len(words))).astype(np.int32), tf.astype(np.int64))]
                yield pa.record_batch([batch.column(0).slice(first, rows), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tf"])
        give_back()

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


def term_weights(found: DataFrame, size: int, documents: int) -> np.ndarray:
    """Weight of each of ``size`` terms by the documents that hold it."""
    df = np.zeros(size, np.int64)
    for row in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator():  # at most ``size`` rows
        df[row["term"]] = row["df"]
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def tiles(items: Items, weights: np.ndarray) -> list[tuple[int, int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]]:
    """(first item, end, parts): each part has its terms and the cells (item, column, weight) of a matrix whose products stay under 2**53.

    A weight that could reach that by itself is put into several columns of one term.
    """
    most = (EXACT - 1) // MOST_IMPACT
    out = []
    for a in range(0, len(items.keys), ITEM_TILE):
        b = min(a + ITEM_TILE, len(items.keys))
        cells = slice(items.first[a], items.first[b])
        item = np.repeat(np.arange(b - a), np.diff(items.first[a : b + 1]))
        term, weight = items.terms[cells], items.times[cells] * weights[items.terms[cells]]
        parts = []
        while len(term):
            columns, column = np.unique(term, return_inverse=True)
            heaviest = np.zeros(len(columns), np.int64)
            np.maximum.at(heaviest, column, np.minimum(weight, most))
            place = 0
            while place < len(columns):
                end = max(place + 1, min(place + TERM_TILE, int(np.searchsorted(np.cumsum(heaviest[place:]), most, "right")) + place))
                inside = (column >= place) & (column < end)
                parts.append((columns[place:end], item[inside], column[inside] - place, np.minimum(weight[inside], most)))
                place = end
            left = weight > most
            item, term, weight = item[left], term[left], weight[left] - most
        out.append((a, b, parts))
    return out


def length_parts(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents with ``n`` terms."""
    if len(n) and B_PART * int(n.max()) * documents >= 2**63:
        return np.array([100 - B_PART + (B_PART * k * documents) // total for k in n.tolist()], np.int64)
    return 100 - B_PART + (B_PART * n.astype(np.int64) * documents) // max(1, total)


class Best:
    """The ``top`` best documents of each item seen so far; ties go to smaller ids, null ids come last."""

    def __init__(self, n: int, top: int):
        self.top, self.least = top, np.ones(n, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * n

    def take(self, first: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """``scores`` of items from ``first`` on (rows) and documents (columns)."""
        for row in np.flatnonzero((scores >= self.least[first : first + len(scores), None]).any(axis=1)):
            item = first + int(row)
            at = np.flatnonzero(scores[row] >= self.least[item])  # what equals the least may have a smaller id
            score, none, doc = (np.concatenate([old, new]) for old, new in zip(self.held[item], (scores[row][at], missing[at], ids[at]), strict=True))
            order = np.lexsort((doc, none, -score))[: self.top]
            self.held[item] = (score[order], none[order], doc[order])
            if len(order) == self.top:
                self.least[item] = score[order[-1]]


def _scored(found: DataFrame, items: Items, weights: np.ndarray, documents: int, total: int, top: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of every item."""
    spark = found.sparkSession
    held = spark.sparkContext.broadcast((tiles(items, weights), len(items.keys)))

    def impacts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms in order, documents, impacts) of a tile of documents."""
        n = batch.column(1).to_numpy()
        lists = batch.column(2)
        of = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
        term, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        impact = (10**9 * tf) // (1000 * tf + K_PART * length_parts(n, documents, total)[of])
        order = np.argsort(term, kind="stable")
        return term[order], of[order], impact[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, n_items = held.value
        best = Best(n_items, top)
        for whole in batches:
            for start in range(0, whole.num_rows, DOC_TILE):
                batch = pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(start, DOC_TILE)]) for c in whole.columns], names=whole.schema.names)
                missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = batch.column(0).fill_null(0).to_numpy()
                term, of, impact = impacts(batch)
                for a, b, parts in every:
                    scores = np.zeros((b - a, batch.num_rows), np.int64)
                    for columns, item, column, weight in parts:
                        begin, end = np.searchsorted(term, columns, "left"), np.searchsorted(term, columns, "right")
                        many = end - begin
                        cells = np.repeat(begin - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                        if not len(cells):
                            continue
                        asked = np.zeros((b - a, len(columns)))
                        asked[item, column] = weight
                        has = np.zeros((len(columns), batch.num_rows))
                        has[np.repeat(np.arange(len(columns)), many), of[cells]] = impact[cells]
                        scores += (asked @ has).astype(np.int64)
                    best.take(a, scores, ids, missing)
        rows = [(i, *best.held[i]) for i in range(n_items) if len(best.held[i][0])]
        for k in range(0, len(rows), 1000):
            some = rows[k : k + 1000]
            item = np.repeat([i for i, *_ in some], [len(s) for _, s, _, _ in some])
            yield pa.record_batch([pa.array(item.astype(np.int64)), pa.array(np.concatenate([d for *_, d in some]), mask=np.concatenate([m for _, _, m, _ in some])), pa.array(np.concatenate([s for _, s, _, _ in some]))], names=["item", "doc_id", "score"])
        give_back()

    return found.mapInArrow(run, "item long, doc_id long, score long")


def _one_pass(docs: DataFrame, texts: list[tuple[int, int, str]], top: int) -> DataFrame:
    """(key0, key1, rank, doc_id, score) of the item texts, which one task can hold."""
    spark, items = docs.sparkSession, read_items(texts)
    found = stored(postings(docs, items.vocabulary), "postings")
    size = found.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("total")).first()
    weights = term_weights(found, len(items.vocabulary), size["documents"])
    scored = _scored(found.where(F.size("terms") > 0), items, weights, size["documents"], size["total"] or 0, top)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    keys = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(items.keys)], "item long, key0 long, key1 long")
    out = stored(ranked.join(F.broadcast(keys), "item").select("key0", "key1", "rank", "doc_id", "score"), "ranked")  # keys: at most PASS_ITEMS rows
    forget(found)
    return out


def search(docs: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", top: int = TOP, pass_bytes: int = PASS_BYTES, pass_items: int = PASS_ITEMS) -> DataFrame:
    """(item key, rank, doc_id, score): the ``top`` best documents of each item with a score above 0.

    Every row of ``docs`` is a document, every row of ``items`` an item; those of equal
    text are ranked once. Null texts and those without terms match nothing and count
    for nothing. Equal scores go by ascending doc_id, null ids last; rows that repeat a
    doc_id each have a rank. Either table may be empty, the result then is too. Terms
    are told apart by 64-bit hashes. Items beyond ``pass_bytes`` or ``pass_items`` are
    answered in several passes over the documents.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    keyed = items.where(F.length(text) > 0).select(F.col(key).alias("_item"), F.col(text).alias("_text"), *[F.xxhash64(F.lit(k), text).alias(f"key{k}") for k in (0, 1)])
    texts = stored(keyed.groupBy("key0", "key1").agg(F.first("_text").alias("text")), "items")
    size = texts.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    passes = max(1, -(-(size["b"] or 0) // pass_bytes), -(-size["n"] // pass_items))
    passes = passes if passes == 1 else 2 * passes  # hashes deal unevenly
    ranked = None
    for p in range(passes):
        rows = texts.where(F.pmod("key0", F.lit(passes)) == p).collect() if passes > 1 else texts.collect()
        part = _one_pass(docs, [(r["key0"], r["key1"], r["text"]) for r in rows], top)
        ranked = part if ranked is None else ranked.unionByName(part)
    forget(texts)
    out = keyed.drop("_text").join(ranked, ["key0", "key1"])
    return out.select(F.col("_item").alias(key), "rank", "doc_id", "score")
