"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on document ids.

Documents are dealt by ranges of ``doc_id``, sorted, encoded and written as ORC.
Stripes are small enough to be read by tasks of their own; ORC keeps minima, maxima
and a Bloom filter of ``doc_id`` for each row group, so that a lookup skips the rest.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import placed_words, shuffle_partitions, stored, text_buffers

STRIPE_BYTES = 16 << 20
WORDS = 1_500_000  # what a worker remembers at most
FENCE, FENCED = b"\x01", 500  # stands between words that are encoded as one text, so many at once

_SIGN, _ALNUM, _LEAD = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c not in b"'_"]] = _SIGN
_KIND[[c for c in range(0x80) if chr(c).isalnum()]] = _ALNUM
_KIND[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = _LEAD  # of letters in two bytes, up to U+027F and from U+0400 to U+047F


def cuts(part: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Marks bytes that begin a piece within a word: where letters or digits meet ASCII signs, no token spans both.

    An apostrophe, an underscore and every sign, mark or letter that isn't sure to be
    one (also after NFC and in lower case, as U+0130 is not) has no cut beside it.
    """
    kind = _KIND[part]
    sign, start, end, out = kind == _SIGN, kind == _ALNUM, kind == _ALNUM, np.zeros(len(part), bool)
    at = np.flatnonzero(kind[:-1] == _LEAD)
    inside = np.ones(len(part) + 1, bool)
    inside[bounds] = False
    at = at[inside[at + 1]]  # both bytes in one text
    lead, then = part[at], part[at + 1]
    at = at[(then & 0xC0 == 0x80) & ~((lead == 0xC3) & ((then == 0x97) | (then == 0xB7))) & ~((lead == 0xC4) & (then == 0xB0))]
    start[at] = end[at + 1] = True
    out[1:] = sign[:-1] & start[1:] | end[:-1] & sign[1:]
    return out


#: What shows whether a vocabulary's ids of a text are those of its words: cases, spaces, signs, digits, other scripts.
PROBES = ("Hello WORLD hello", "two  spaces\n\tand\r\nlines ", " x", "it's (3.5%) e-mail: a_b #1,000!", "naïve Ärger ß 東京 Москва ½", "A.B.C. don't--stop ... 'quoted' \"text\"", "Ärger,(ß)=Москва-9é!%%% ×é,İ. e\u0301-'s")


class WordEncoder:
    """Encodes texts through ``tokenizers``, each distinct piece of a word once while it is remembered.

    For vocabularies that lower-case, drop white space and split letters from signs
    before they merge. Pieces (``cuts``, A-Z in lower case) are known by their 64-bit
    hashes, and a batch's ids are put together from the remembered ones. Texts with a
    special token's string are encoded as they are, and so are all texts with a
    vocabulary of another kind, which shows on ``PROBES``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fence = np.frombuffer(self._ids([FENCE.decode()])[0], "<u4")
        self._forget()
        self.by_words = True
        found = [ids[:-1].tobytes() for p in PROBES for ids, _ in self.encode(pa.array([p]), 0)]
        self.by_words = len(self.fence) == 1 and found == self._ids(list(PROBES))
        self._forget()

    def _forget(self) -> None:
        # remembered pieces: sorted hashes, and where the ids of each begin in ``flat`` and how many they are
        self.keys, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has. Where a word's own ids include the fence's, a run is encoded word by word."""
        runs = [words[i : i + FENCED] for i in range(0, len(words), FENCED)]
        between = b" " + FENCE + b" "
        flat, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for run in runs:
            ids = np.frombuffer(self._ids([between.join(run).decode("utf-8", "replace")])[0], "<u4")
            fences = np.flatnonzero(ids == self.fence[0])
            if len(fences) == len(run) - 1:
                flat.append(np.delete(ids, fences))
                counts.append(np.diff(np.r_[-1, fences, len(ids)]) - 1)
            else:
                made = self._ids([w.decode("utf-8", "replace") for w in run])
                flat.append(np.frombuffer(b"".join(made), "<u4"))
                counts.append(np.array([len(m) // 4 for m in made]))
        return np.concatenate(flat), np.concatenate(counts)

    def _found(self, keys: np.ndarray, part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, begin, count) of the pieces with these distinct sorted hashes; ``starts`` and ``ends`` are one place of each."""
        at = np.searchsorted(self.keys, keys)
        inside = np.minimum(at, max(0, len(self.keys) - 1))
        known = self.keys[inside] == keys if len(self.keys) else np.zeros(len(keys), bool)
        begin, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        begin[known], count[known] = self.begin[inside[known]], self.count[inside[known]]
        new = np.flatnonzero(~known)
        raw = part.tobytes()
        made, count[new] = self._encode_words([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        begin[new] = len(self.flat) + np.cumsum(count[new]) - count[new]
        flat = np.concatenate([self.flat, made])
        if len(self.keys) < WORDS and len(new):
            self.flat = flat
            self.keys, self.begin, self.count = (np.insert(old, at[new], x[new]) for old, x in ((self.keys, keys), (self.begin, begin), (self.count, count)))
        return flat, begin, count

    def encode(self, column: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of about 1 MB of texts at a time: all ids with ``end`` after each text, and how many each text has."""
        data, offsets = text_buffers(column)
        for first, part, starts, ends, hashes, at in placed_words(data, offsets, True, cuts):
            raw = data[offsets[first] : offsets[first + len(at) - 1]].tobytes()
            if not self.by_words or any(x in raw for x in self.special):
                texts = [(t or "") for t in column.slice(first, len(at) - 1).to_pylist()]
                ids = [np.frombuffer(i + np.array([end], "<u4").tobytes(), "<u4") for i in self._ids(texts)]
                yield np.concatenate(ids), np.array([len(i) for i in ids])
                continue
            keys, where, which = np.unique(hashes, return_index=True, return_inverse=True)
            flat, begin, count = self._found(keys, part, starts[where], ends[where])
            counts = count[which]
            upto = np.r_[0, np.cumsum(counts)]
            ids = flat[np.repeat(begin[which] - upto[:-1], counts) + np.arange(upto[-1])]
            sizes = np.diff(upto[at])  # ids of each text
            out = np.full(len(ids) + len(sizes), end, np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
            yield out, sizes + 1


@functools.cache
def encoder(path: str) -> WordEncoder:
    """A worker's encoder: what it remembers serves the tasks that follow."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """(doc_id, ids) of every whole text, null as empty, with ``end_id`` appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in batches:
            at = 0
            for ids, sizes in own.encode(batch.column(1), end_id):
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                yield pa.record_batch([batch.column(0).slice(at, len(sizes)), pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32)))], names=["doc_id", "ids"])
                at += len(sizes)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, partitions: int | None = None) -> None:
    """Writes ``part`` (ascending with doc_id), ``doc_id`` and ``ids``.

    Documents are dealt before they are encoded: their texts are smaller than their
    ids. A hash of the text follows doc_id in the order, so that an id that many rows
    share is split between parts. Null ids come first.
    """
    n = partitions or shuffle_partitions(docs.sparkSession)
    dealt = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = encoded(dealt, tokenizer_path, end_id).select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    rows.write.option("orc.stripe.size", str(STRIPE_BYTES)).option("orc.row.index.stride", "1000").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.encoding.strategy", "COMPRESSION").option("compression", "zstd").orc(path)


def read_token_orc(spark, path: str) -> DataFrame:
    """Stripes are read in parallel; a filter on doc_id reaches the stripes' statistics and Bloom filters."""
    return spark.read.schema("part int, doc_id long, ids array<int>").orc(path)


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        at = lists.offsets.to_numpy()
        ids = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
        crcs = [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:], strict=False)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crcs, pa.int64())], names=["part", "doc_id", "n_tokens", "ids_crc32"])


def token_offsets(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read_token_orc`` gives.

    ``start`` counts the ids of all documents before, in the order of the files: a
    running sum within each part, and the sums of the parts before it (a row a part).
    Repeated ids are ordered by their contents. The ids are read once: what is
    counted of each document is stored.
    """
    counted = stored(rows.mapInArrow(_crcs, "part int, doc_id long, n_tokens long, ids_crc32 long"), "token-counts")
    sums = counted.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = Window.partitionBy("part").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.withColumn("upto", F.sum("n_tokens").over(within)).join(before, "part").select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
