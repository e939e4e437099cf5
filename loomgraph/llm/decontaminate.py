"""Benchmark decontamination with one Aho-Corasick automaton over normalised items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


WINDOW = 13
#: Benchmark text that one automaton may hold (measured: some 145 MB of memory and 5 s to build for each MB);
#: for more, each row is scanned by as many automata as it takes.
AUTOMATON_BYTES = 2 << 20
#: Rows that several automata scan in turn: each automaton is built once for so much of a task's input.
HELD_BYTES = 64 << 20

#: Bytes that separate words become a space, A-Z become a-z; digits, letters and all other bytes stay.
_NORMAL = bytearray(b" " * 256)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _NORMAL[_b] = _b
for _b in range(0x41, 0x5B):
    _NORMAL[_b] = _b + 32
_NORMAL = bytes(_NORMAL)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split(b" ") if text else []


def _words(text: str | None) -> list[bytes]:
    return [w for w in normal_words(text) if w]


class WindowAutomaton:
    """All windows of all items as sequences of word numbers; scans a text once, word by word."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set[int]] = {}
        self.items: list[object] = []
        for item, text in items:
            words = _words(text)
            if not words:
                continue
            code = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            at = len(self.items)
            self.items.append(item)
            for i in range(max(1, len(code) - window + 1)):
                patterns.setdefault(tuple(code[i : i + window]), set()).add(at)
        self.shortest = min(map(len, patterns), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, owners in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(owners)))
        if patterns:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit runs of word places [first, last), in order and apart, and the items met."""
        runs: list[list[int]] = []
        met: set[int] = set()
        if self.shortest and len(words) >= self.shortest:
            known = self.numbers.get
            for last, (length, owners) in self.automaton.iter(tuple([known(w, 0) for w in words])):
                met.update(owners)
                first = last - length + 1
                while runs and first <= runs[-1][0]:  # a longer window may begin before what was found
                    runs.pop()
                if runs and first <= runs[-1][1]:
                    runs[-1][1] = last + 1
                else:
                    runs.append([first, last + 1])
        return [(a, b) for a, b in runs], met


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places in the original text of runs of words: offsets of characters, end exclusive."""
    if not runs:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    word = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 32
    begins = np.flatnonzero(word & np.r_[True, ~word[:-1]])
    ends = np.flatnonzero(word & np.r_[~word[1:], True]) + 1
    chars = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]  # characters before each byte
    return [(int(chars[begins[a]]), int(chars[ends[b - 1]])) for a, b in runs]


_HITS = "n_words long, runs array<struct<a:int,b:int>>, items array<string>"


def joined(runs: list[tuple[int, int]], more: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of two automata over one text as those of a single one: in order and apart."""
    if not runs or not more:
        return runs or more
    out: list[tuple[int, int]] = []
    for first, end in sorted(runs + more):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about ``limit`` bytes."""
    group: list[pa.RecordBatch] = []
    for batch in batches:
        group.append(batch)
        if sum(b.nbytes for b in group) >= limit:
            yield group
            group = []
    if group:
        yield group


#: What this worker built last, with what it was built from: its next task may need the same.
_LAST: list[tuple[Broadcast, int, WindowAutomaton]] = []


def _automaton(part: Broadcast, window: int) -> WindowAutomaton:
    path = getattr(part, "_path", None)
    if not _LAST or _LAST[0][1] != window or not (_LAST[0][0] is part or path and getattr(_LAST[0][0], "_path", None) == path):
        _LAST.clear()  # freed before the next is built
        _LAST.append((part, window, WindowAutomaton(part.value, window)))
        if path:  # can be read again: a worker needn't hold the whole benchmark
            vars(part).pop("_value", None)
    return _LAST[0][2]


def _scanned(batches: Iterator[pa.RecordBatch], parts: list[Broadcast], window: int, at: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, list[tuple[int, int]], set[str]]]]]:
    """Each batch with (words, runs, items met) of every row, whose text is column ``at``; one automaton is held at a time.

    What the automata find is put together row by row, so ids decide nothing.
    """
    for group in _groups(batches, HELD_BYTES if len(parts) > 1 else 0):
        found: list[list] = [[(0, [], set())] * b.num_rows for b in group]
        for part in parts:
            automaton = _automaton(part, window)
            for batch, rows in zip(group, found, strict=True):
                for i, text in enumerate(batch.column(at).to_pylist()):
                    words = _words(text)
                    got, met = automaton.scan(words)
                    rows[i] = (len(words), joined(rows[i][1], got), rows[i][2] | {str(automaton.items[k]) for k in met})
        yield from zip(group, found, strict=True)


def _scan(docs: DataFrame, parts: list[Broadcast], window: int, spans: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

        def pairs(runs: list[list[tuple[int, int]]]) -> pa.Array:
            return pa.array([[{"a": a, "b": b} for a, b in r] for r in runs], pair)

        for batch, rows in _scanned(batches, parts, window, 1):
            columns = [batch.column(0), pa.array([n for n, _, _ in rows], pa.int64()), pairs([r for _, r, _ in rows]), pa.array([sorted(m) for _, _, m in rows], pa.list_(pa.string()))]
            if spans:
                columns.append(pairs([char_spans(t or "", r) for t, (_, r, _) in zip(batch.column(1).to_pylist(), rows, strict=True)]))
            yield pa.record_batch(columns, names=["doc_id", "n_words", "runs", "items"] + ["spans"] * spans)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {_HITS}" + ", spans array<struct<a:int,b:int>>" * spans)


def _blocks(benchmark: DataFrame, limit: int) -> list[Broadcast]:
    """The benchmark in parts whose text fits one automaton, by a hash of the item."""
    benchmark = benchmark.select("item_id", "text")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-2 * size // limit)) if size > limit else 1
    slot = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    held = []
    for p in range(parts):
        rows = (benchmark.where(slot == p) if parts > 1 else benchmark).collect()
        held.append(benchmark.sparkSession.sparkContext.broadcast(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (str(x[0]), x[1] or ""))))
    return held


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, spans: bool = False, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Every document with n_words, n_hit, n_items, items (sorted strings), contaminated; ``spans`` adds the hit characters' places.

    Null and empty texts have no words; an item without words takes no part; one of
    fewer words than ``window`` is one window. An item that occurs twice counts
    once. A benchmark beyond ``automaton_bytes`` is scanned in parts, one automaton
    after another over each row, with the same result; ids may repeat or be null.
    """
    hits = _scan(docs, _blocks(benchmark, automaton_bytes), window, spans)
    words = F.aggregate(
        F.array_sort("runs"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["upto"]))).cast("long").alias("n"), F.greatest(s["upto"], r["b"]).alias("upto")),
        lambda s: s["n"],
    )
    hits = hits.withColumn("n_hit", words)
    return hits.select("doc_id", "n_words", "n_hit", F.size(F.array_distinct("items")).cast("long").alias("n_items"), F.array_distinct("items").alias("items"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *(["spans"] if spans else []))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows = contamination(docs, benchmark)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The documents that aren't contaminated, unchanged; decided row by row, without a shuffle."""
    parts = _blocks(benchmark, automaton_bytes)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _scanned(batches, parts, window, at):
            hits = [(n, sum(b - a for a, b in runs)) for n, runs, _ in rows]
            yield batch.filter(pa.array([hit == 0 or 20 * hit < n for n, hit in hits], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
