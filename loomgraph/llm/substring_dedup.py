"""Exact substring dedup by prefix-partitioned suffix trees.

A suffix is the text from some word on, read to a depth of 50 words. Only suffixes that
may repeat are kept: a window's anchor is the least hash of its 16-word runs, and a
window whose anchor is met in one document alone does not repeat. Runs of such suffixes
that are equal as a whole (copies of documents) are one.

What is left is split by prefixes of variable length into groups that fit into memory.
The shortest is the anchor's run of words (equal suffixes have it at the same place, and
neighbours mostly share it, so their words travel once); where too many suffixes have
it, it is followed by the suffix's own first 1, 2, 4 ... words. Each group's subtree is
made as a sorted suffix array over word numbers with the longest common prefix of
neighbours: leaves between places where that is less than 50 hang from one deep
internal node, a repeat, and all but those of its smallest doc_id are removed. Removed
windows that follow each other make up the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import bit_filter, forget, fresh, give_back, hashed_words, mix, passes, sequence_hashes, shuffle_partitions, stored, text_buffers

WINDOW = 50
ANCHOR = 16
SPAN = WINDOW - ANCHOR + 1  # anchors in a window
PREFIXES = (0, 1, 2, 4, 8, 16, 32, WINDOW)  # words of its own by which a suffix may be dealt, after the anchor
GROUP_SUFFIXES, TASK_SUFFIXES, ROW_SUFFIXES = 60_000, 120_000, 1 << 14  # in a group, in a task at a time, in a packed row
BUCKET_BYTES = 64 << 20  # text whose anchors one group takes
FILTER_BITS = (18, 28)
#: Keys that a filter of the largest size holds well; more are taken in as many slices.
FILTER_KEYS = 1 << 23

_RUNS = "doc_id long, start int, stop int"


def _sliding(x: np.ndarray, size: int, op: np.ufunc) -> np.ndarray:
    """``op`` over every ``size`` neighbours."""
    n = len(x) - size + 1
    rows = np.r_[x, np.full(-len(x) % size, x[-1])].reshape(-1, size)
    left = op.accumulate(rows, axis=1).reshape(-1)
    right = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(right[:n], left[size - 1 : size - 1 + n])


def anchors(words: np.ndarray) -> np.ndarray:
    """Each window's anchor: the least hash of its 16-word runs. Equal windows have equal anchors, and neighbours mostly share theirs."""
    return _sliding(sequence_hashes(words, ANCHOR), SPAN, np.minimum)


def _long_texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, word hashes) of the texts of a window or more; a null doc_id neither removes nor loses words."""
    ids = batch.column(0).to_pylist()
    for k in range(0, len(ids), 512):
        for first, hashes, at in hashed_words(*text_buffers(batch.column(1).slice(k, 512)), lower=False):
            for i in range(len(at) - 1):
                if at[i + 1] - at[i] >= WINDOW and ids[k + first + i] is not None:
                    yield ids[k + first + i], hashes[at[i] : at[i + 1]]


def _packed(bucket: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    columns = tuple(c[order] for c in columns)
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), [c[cuts[k] : cuts[k + 1]].tobytes() for c in columns]


def _joined(frame: pd.DataFrame, column: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in frame[column]])


def _keys(rows: DataFrame) -> DataFrame:
    """Packed 64-bit keys, one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                keys = np.frombuffer(raw.as_py(), np.int64)
                for i in range(0, len(keys), 1 << 16):
                    yield pa.record_batch([pa.array(keys[i : i + (1 << 16)])], names=["key"])

    return rows.select("keys").mapInArrow(run, "key long")


# ---------------------------------------------------------------- anchors that two documents share


def _shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """Hashes of the anchors that occur in two documents or more, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            key, doc = np.concatenate(found), np.concatenate(ids)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.r_[True, key[1:] != key[:-1]]
            starts = np.flatnonzero(new)
            last = doc[np.r_[starts[1:], len(doc)] - 1]
            key, doc = key[starts], doc[starts]
            sure = doc != last
            rows = [(k, *one, two) for k, one, two in _with_sure(key, doc, sure, buckets)]
            return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "keys", "docs", "sure"])

        for batch in batches:
            for doc, words in _long_texts(batch):
                least = anchors(words)
                key = np.unique(least[np.r_[True, least[1:] != least[:-1]]])
                found.append(key)
                ids.append(np.full(len(key), doc, np.int64))
                held += len(key)
                if held > 1 << 21:
                    yield flush()
                    found, ids, held = [], [], 0
        if found:
            yield flush()

    def shared(frame: pd.DataFrame) -> pd.DataFrame:
        key, doc = _joined(frame, "keys", np.uint64), _joined(frame, "docs", np.int64)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        twice = key[1:][(key[1:] == key[:-1]) & (doc[1:] != doc[:-1])]
        return pd.DataFrame({"keys": [np.union1d(twice, _joined(frame, "sure", np.uint64)).tobytes()]})

    rows = docs.select("doc_id", "text").mapInArrow(run, "bucket int, keys binary, docs binary, sure binary")
    return rows.groupBy("bucket").applyInPandas(shared, "keys binary")


def _with_sure(key: np.ndarray, doc: np.ndarray, sure: np.ndarray, buckets: int) -> Iterator[tuple[int, list[bytes], bytes]]:
    """By bucket: keys of one document with it, and keys that two documents of the task share."""
    bucket = (key >> np.uint64(20)) % np.uint64(buckets)
    alone = dict(_packed(bucket[~sure].astype(np.int64), buckets, key[~sure], doc[~sure]))
    both = dict(_packed(bucket[sure].astype(np.int64), buckets, key[sure]))
    for k in alone.keys() | both.keys():
        yield k, alone.get(k, [b"", b""]), both.get(k, [b""])[0]


# ---------------------------------------------------------------- runs of suffixes that may repeat


def _runs(words: np.ndarray, known: np.ndarray, bits: int, part: int, parts: int) -> list[tuple[int, int]]:
    """[start, stop) of the windows whose anchor is shared."""
    keys = anchors(words)
    hit = passes(known, bits, keys)
    if parts > 1:
        hit &= (keys >> np.uint64(1)) % np.uint64(parts) == part
    edges = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _run_key(words: np.ndarray, run: tuple[int, int]) -> np.uint64:
    part = words[run[0] : run[1] + WINDOW - 1]
    ranks = np.arange(1, len(part) + 1, dtype=np.uint64)
    return mix(np.array([mix(part + ranks * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)]))[0]


def _owned(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Number of a run together with the document that stands for it."""
    return mix(key ^ mix(doc.astype(np.uint64)))


def _later(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of rows in order of key, then document: which are not of their key's first document."""
    if not len(key):
        return np.zeros(0, bool)
    new = np.r_[True, key[1:] != key[:-1]]
    return doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]


def _run_rows(docs: DataFrame, known, bits: int, part: int, parts: int, buckets: int) -> DataFrame:
    """Runs packed by the hash of all their words; grouped: ``keys`` of the runs that stand for their equals, and ``gone`` the others.

    Of equal runs that a task holds, those of the smallest document alone go to the bucket
    of their key, each once; the others are gone whatever else there is, and pass by the
    groups under negative numbers. So a run that is copied without end is a row a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            key = np.array([r[0] for r in rows], np.uint64)
            doc, start, stop = (np.array([r[i] for r in rows], kind) for i, kind in ((1, np.int64), (2, np.int32), (3, np.int32)))
            order = np.lexsort((stop, start, doc, key))
            key, doc, start, stop = key[order], doc[order], start[order], stop[order]
            gone = _later(key, doc)
            again = np.r_[False, (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1]) & (stop[1:] == stop[:-1])]
            first, past = ~gone & ~again, gone & ~again
            out = list(_packed(((key[first] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), buckets, key[first], doc[first], start[first], stop[first]))
            if past.any():
                number = int(mix(key[past][:1] ^ doc[past][:1].astype(np.uint64))[0] >> np.uint64(34))
                out.append((-1 - number, (b"", doc[past].tobytes(), start[past].tobytes(), stop[past].tobytes())))
            return pa.record_batch([pa.array([k for k, _ in out], pa.int32())] + [pa.array([c[i] for _, c in out], pa.binary()) for i in range(4)], names=["bucket", "keys", "docs", "starts", "stops"])

        for batch in batches:
            for doc, words in _long_texts(batch):
                rows += [(_run_key(words, r), doc, *r) for r in _runs(words, known.value, bits, part, parts)]
                if len(rows) > 1 << 17:
                    yield flush()
                    rows.clear()
        if rows:
            yield flush()

    def pick(at: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if at[0] < 0:
            return frame[["keys", "docs", "starts", "stops"]]
        key, doc = _joined(frame, "keys", np.uint64), _joined(frame, "docs", np.int64)
        start, stop = _joined(frame, "starts", np.int32), _joined(frame, "stops", np.int32)
        order = np.lexsort((doc, key))
        key, doc, start, stop = key[order], doc[order], start[order], stop[order]
        gone = _later(key, doc)
        return pd.DataFrame({"keys": [np.unique(_owned(key, doc)[~gone]).tobytes()], "docs": [doc[gone].tobytes()], "starts": [start[gone].tobytes()], "stops": [stop[gone].tobytes()]})

    schema = "keys binary, docs binary, starts binary, stops binary"
    return docs.select("doc_id", "text").mapInArrow(run, f"bucket int, {schema}").groupBy("bucket").applyInPandas(pick, schema)


# ---------------------------------------------------------------- suffixes and their subtrees


def suffix_array(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ``words[a : a + 50]`` in the order of their words: (order, words shared with the neighbour before)."""
    ranks = np.unique(words, return_inverse=True)[1].astype(">u4")  # big-endian: bytes sort as numbers do
    rows = np.lib.stride_tricks.sliding_window_view(ranks, WINDOW)[at]
    order = np.argsort(rows.view(f"V{4 * WINDOW}").reshape(-1), kind="stable")
    rows = rows[order]
    differs = np.ones((len(rows), WINDOW + 1), bool)
    np.not_equal(rows[1:], rows[:-1], out=differs[1:, :WINDOW])
    shared = differs.argmax(axis=1)
    shared[:1] = 0
    return order, shared


def _repeated(same: np.ndarray, order: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of sorted leaves, ``same`` where one hangs from the node of the one before: whether a smaller doc_id hangs there too."""
    starts = np.flatnonzero(~same)
    least = np.minimum.reduceat(doc[order], starts)
    gone = np.zeros(len(doc), bool)
    gone[order] = doc[order] > np.repeat(least, np.diff(np.r_[starts, len(order)]))
    return gone


def _spans(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows as spans (doc, start, stop)."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)]) if len(doc) else np.zeros(0, int)
    return doc[cut], place[cut], (place[np.r_[cut[1:], len(place)] - 1] + 1 if len(cut) else place)


_SUFFIXES = "rows int, words binary, leaves binary, gone_docs binary, gone_starts binary, gone_stops binary"


class Suffixes:
    """Suffixes by the place of their first word in ``words``, with document, place there, and anchor."""

    def __init__(self, words: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray, anchor: np.ndarray):
        self.words, self.at, self.doc, self.place, self.anchor = words, at, doc, place, anchor

    def taken(self, rows: np.ndarray) -> Suffixes:
        """Some of the suffixes, in order, with no words but theirs."""
        at = self.at[rows]
        edges = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + WINDOW, -1)
        held = np.cumsum(edges[:-1]) > 0
        return Suffixes(self.words[held], (np.cumsum(held) - 1)[at], self.doc[rows], self.place[rows], self.anchor[rows])

    def packed(self) -> tuple[int, bytes, bytes]:
        """Rows, words, and the rest: what changes little from row to row is written as differences and compressed."""
        columns = [self.doc, self.anchor.view(np.int64), self.at.astype(np.int64), self.place.astype(np.int64)]
        leaves = b"".join(np.diff(c, prepend=np.int64(0)).astype("<i8").tobytes() for c in columns)
        return len(self.at), pa.compress(self.words.astype("<u8").tobytes(), "zstd", asbytes=True) if len(self.words) else b"", pa.compress(leaves, "zstd", asbytes=True) if leaves else b""

    @classmethod
    def joined(cls, rows: list[tuple[int, int, bytes, bytes]]) -> Suffixes:
        """Of packed ones, as (rows, words, ...)."""
        parts, base = [], 0
        for n, length, words, leaves in rows:
            if n:
                doc, anchor, at, place = np.cumsum(np.frombuffer(pa.decompress(leaves, 32 * n, "zstd"), "<i8").reshape(4, n), axis=1)
                parts.append((np.frombuffer(pa.decompress(words, 8 * length, "zstd"), "<u8"), at + base, doc, place, anchor.view(np.uint64)))
                base += length
        return cls(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _suffix_rows(docs: DataFrame, known, bits: int, owners, owner_bits: int, part: int, parts: int) -> DataFrame:
    """Suffixes of the runs that stand for their equals, without those that the task itself finds to be removed."""
    names = ["rows", "length", *[x.split(" ")[0] for x in _SUFFIXES.split(", ")[1:]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashes, many, base = [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            every, window = Suffixes(*(np.concatenate(c) for c in zip(*held, strict=True))), np.concatenate(hashes)
            order = np.argsort(window, kind="stable")
            gone = _repeated(np.r_[False, window[order][1:] == window[order][:-1]], order, every.doc)
            stay, spans = np.flatnonzero(~gone), _spans(every.doc[gone], every.place[gone].astype(np.int32))
            for k in range(0, max(len(stay), len(spans[0])), ROW_SUFFIXES):
                some = every.taken(stay[k : k + ROW_SUFFIXES])
                n, words, leaves = some.packed()
                yield pa.record_batch([pa.array([n], pa.int32()), pa.array([len(some.words)], pa.int32()), *[pa.array([c], pa.binary()) for c in (words, leaves, *[c[k : k + ROW_SUFFIXES].tobytes() for c in spans])]], names=names)

        for batch in batches:
            for doc, words in _long_texts(batch):
                runs = _runs(words, known.value, bits, part, parts)
                if not runs:
                    continue
                keys = np.array([_run_key(words, r) for r in runs], np.uint64)
                own = passes(owners.value, owner_bits, _owned(keys, np.full(len(keys), doc, np.int64)))
                if not own.any():
                    continue
                least = anchors(words)
                for (a, b), mine in zip(runs, own, strict=True):
                    if mine:
                        text = words[a : b + WINDOW - 1]
                        held.append((text, np.arange(base, base + b - a), np.full(b - a, doc, np.int64), np.arange(a, b), least[a:b]))
                        hashes.append(sequence_hashes(text, WINDOW))
                        base += len(text)
                        many += b - a
                if many > TASK_SUFFIXES:
                    yield from flush()
                    held, hashes, many, base = [], [], 0, 0
        if held:
            yield from flush()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, _SUFFIXES.replace("rows int", "rows int, length int"))


def _prefix_slots(s: Suffixes, depth: int, slots: int) -> np.ndarray:
    """Slot of each suffix's prefix: its anchor and as many words of its own as ``depth`` says."""
    code = s.anchor
    if n := PREFIXES[depth]:
        code = code ^ sequence_hashes(s.words, n)[s.at]
    return (mix(code) % np.uint64(slots)).astype(np.int64)


def _group_of(s: Suffixes, plan: list[np.ndarray]) -> np.ndarray:
    """Group of each suffix: by the shortest prefix whose slot is no larger than a group; -1 while none of ``plan`` is."""
    group = np.full(len(s.at), -1, np.int64)
    for depth, groups in enumerate(plan):
        left = group < 0
        if not left.any():
            break
        group[left] = groups[_prefix_slots(s, depth, len(groups))[left]]
    return group


def _plan(suffixes: DataFrame, least: int) -> list[np.ndarray]:
    """Groups by prefix slot, for the shortest prefixes, and for longer ones where a slot is too large.

    Slots are counted, four for each group that the suffixes ask for, so what comes to
    the driver is a number for tens of thousands of suffixes. The longest prefix is the
    whole window, of which each task leaves one suffix for so many that it takes at a time.
    """
    plan: list[np.ndarray] = []
    groups = 0
    total = suffixes.agg(F.sum("rows")).first()[0] or 0
    slots = max(1 << 12, 1 << int(4 * total // GROUP_SUFFIXES).bit_length())
    for depth in range(len(PREFIXES)):
        so_far = list(plan)

        def count(batches: Iterator[pa.RecordBatch], depth=depth, so_far=so_far) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(slots, np.int64)
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if row[0]:
                        s = Suffixes.joined([row])
                        slot = _prefix_slots(s, depth, slots)
                        sums += np.bincount(slot[_group_of(s, so_far) < 0] if so_far else slot, minlength=slots)
            at = np.flatnonzero(sums)
            yield pa.record_batch([pa.array(at), pa.array(sums[at])], names=["slot", "n"])

        sizes = np.zeros(slots, np.int64)
        for row in suffixes.select("rows", "length", "words", "leaves").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
            sizes[row["slot"]] = row["n"]
        limit = max(1, min(GROUP_SUFFIXES, int(sizes.sum()) // least)) if depth == 0 else GROUP_SUFFIXES
        fits = (sizes <= GROUP_SUFFIXES) | (depth == len(PREFIXES) - 1)
        number = groups + np.cumsum(np.where(fits, sizes, 0)) // limit
        plan.append(np.where(fits, number, -1))
        groups = int(number.max()) + 1
        if fits.all():
            break
    return plan


def _tree_rows(suffixes: DataFrame, plan: list[np.ndarray]) -> DataFrame:
    """Spans that the groups' subtrees remove."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not row[0]:
                    continue
                s = Suffixes.joined([row])
                group = _group_of(s, plan)
                order = np.argsort(group, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
                out = []
                for a, b in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
                    some = s.taken(order[a:b])
                    n, words, leaves = some.packed()
                    out.append((group[order[a]], n, len(some.words), words, leaves))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["group", "rows", "length", "words", "leaves"])

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        s = Suffixes.joined(list(frame[["rows", "length", "words", "leaves"]].itertuples(index=False, name=None)))
        order, shared = suffix_array(s.words, s.at)
        gone = _repeated(shared >= WINDOW, order, s.doc)
        spans = _spans(s.doc[gone], s.place[gone].astype(np.int32))
        return pd.DataFrame({"docs": [spans[0].tobytes()], "starts": [spans[1].tobytes()], "stops": [spans[2].tobytes()]})

    dealt = suffixes.select("rows", "length", "words", "leaves").mapInArrow(deal, "group long, rows int, length int, words binary, leaves binary")
    return dealt.groupBy("group").applyInPandas(grow, "docs binary, starts binary, stops binary")


def _unpacked(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in zip(*(batch.column(i) for i in range(3)), strict=True):
                columns = [np.frombuffer(x.as_py(), k) for x, k in zip(raw, (np.int64, np.int32, np.int32), strict=True)]
                for i in range(0, len(columns[0]), 1 << 16):
                    yield pa.record_batch([pa.array(c[i : i + (1 << 16)]) for c in columns], names=["doc_id", "start", "stop"])

    return rows.mapInArrow(run, _RUNS)


def _held(docs: DataFrame, keys: DataFrame) -> tuple[object, int]:
    bits = int(np.clip(np.ceil(np.log2(max(1, keys.count()))) + 5, *FILTER_BITS))
    return docs.sparkSession.sparkContext.broadcast(bit_filter(keys, "key", bits)), bits


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop): windows of 50 words, by the place of their first word, that also start in a document with a smaller doc_id.

    Windows that follow each other in a document are one row, so that ``start`` to
    ``stop + 49`` is a maximal repeat, or the part of one that a task or a group has seen.
    """
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(docs.sparkSession), int(size // BUCKET_BYTES) + 1)
    shared = stored(_shared_anchors(docs, buckets), "anchors")
    keys = _keys(shared)
    parts = max(1, -(-keys.count() // FILTER_KEYS))
    out, done = None, [shared]
    for part in range(parts):
        own = keys if parts == 1 else keys.where(F.pmod(F.shiftrightunsigned("key", 1), F.lit(parts)) == part)
        known, bits = _held(docs, own)
        runs = stored(_run_rows(docs, known, bits, part, parts, buckets), "runs")
        owners, owner_bits = _held(docs, _keys(runs))
        suffixes = stored(_suffix_rows(docs, known, bits, owners, owner_bits, part, parts), "suffixes")
        packed = runs.select("docs", "starts", "stops").unionByName(suffixes.select(F.col("gone_docs").alias("docs"), F.col("gone_starts").alias("starts"), F.col("gone_stops").alias("stops")))
        packed = packed.unionByName(_tree_rows(suffixes, _plan(suffixes, shuffle_partitions(docs.sparkSession))))
        out = packed if out is None else out.unionByName(packed)
        done += [runs, suffixes]
    spans = stored(out, "spans")
    forget(*done)
    return _unpacked(spans)


def _cut(text: str | None, spans: list | None) -> tuple[str, int, int]:
    """Kept words joined by one space, number of words, number removed."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_BLANK).split(b" ")
    words = [w for w in words if w]
    kept, upto = [], 0
    for start, stop in sorted(spans or []):
        kept += words[upto : max(upto, start)]
        upto = max(upto, stop + WINDOW - 1)
    kept += words[upto:]
    return b" ".join(kept).decode("utf-8", "surrogatepass"), len(words), len(words) - len(kept)


_BLANK = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def deduplicated(docs: DataFrame, names: tuple[str, str, str] = ("kept", "n_words", "n_removed")) -> DataFrame:
    """Every row of ``docs`` with its text without what is removed, its words, and how many of them are removed.

    They are called as ``names`` says, and replace columns of such names. A null text
    has no words; texts of fewer than 50 words lose none; a null doc_id neither removes
    nor loses. Rows that repeat a doc_id are one document, and don't remove from each
    other. Texts that surely lose nothing aren't shuffled.
    """
    own = [c for c in docs.columns if c not in names]
    key, found = fresh("key", docs.columns), fresh("spans", docs.columns)
    spans = repeated_windows(docs.select("doc_id", "text")).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias(found))
    spans = stored(spans, "removed")
    keyed = spans.select(F.xxhash64("doc_id").alias("key"))
    bits = int(np.clip(np.ceil(np.log2(max(1, keyed.count()))) + 5, *FILTER_BITS))
    held = docs.sparkSession.sparkContext.broadcast(bit_filter(keyed, "key", bits))
    at = own.index("text")

    def chosen(batches: Iterator[pa.RecordBatch], may: bool) -> Iterator[pa.RecordBatch]:
        """Rows that may lose something, or the others, without their key."""
        for batch in batches:
            keys = batch.column(len(own)).to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint64)
            yield pa.record_batch(batch.columns[:-1], names=own).filter(pa.array(passes(held.value, bits, keys) == may))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                spans = part.column(len(own)).to_pylist() if part.num_columns > len(own) else [None] * part.num_rows
                rows = [_cut(t, s and [(x["start"], x["stop"]) for x in s]) for t, s in zip(part.column(at).to_pylist(), spans, strict=True)]
                added = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
                yield pa.record_batch([*part.columns[: len(own)], *added], names=[*own, *names])
        give_back()

    keyed_docs = docs.select(*own, F.xxhash64("doc_id").alias(key))
    plain = T.StructType([docs.schema[c] for c in own])
    touched = keyed_docs.mapInArrow(lambda batches: chosen(batches, True), plain).join(spans, "doc_id", "left").select(*own, found)
    out = T.StructType([*plain.fields, T.StructField(names[0], T.StringType()), *[T.StructField(c, T.LongType()) for c in names[1:]]])
    return touched.mapInArrow(cut, out).unionByName(keyed_docs.mapInArrow(lambda batches: cut(chosen(batches, False)), out))


def digest(docs: DataFrame) -> DataFrame:
    rows = deduplicated(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` whose texts have lost what repeats; texts that lose nothing stay as they are, byte by byte, and so do all other columns but ``n_chars``."""
    kept, words, removed = (fresh(c, docs.columns) for c in ("kept", "n_words", "n_removed"))
    rows = deduplicated(docs, (kept, words, removed))
    lost = F.col(removed) > 0
    rows = rows.withColumn("text", F.when(lost, F.col(kept)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(lost, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
