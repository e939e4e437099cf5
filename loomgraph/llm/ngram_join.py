"""N-gram Jaccard join by filters under several global token orders.

Two sets of n and m tokens, similar by t or more, overlap in c = ceil(t (n + m) / (1 + t))
tokens at least. Whatever the order of tokens, they then share one among the first
n - ceil(t n) + 1 of each, and the first that they share, at places i and j, leaves
min(n - i, m - j) >= c. Under an order in which prefixes are p and q long, the prefixes
share min(p + c - n, q + c - m) tokens or more.

Three orders are used. Sets meet in the groups of the prefix tokens of the first order
(rare tokens first, by a frequency sketch of fixed size). A pair comes out of a group
only if its sizes and its places in the first order allow the similarity and if the
prefixes under the second and third order (seeded hashes) can share enough: 128-bit
maps of those prefixes bound from above what they share. Of sets too large for such
maps more comes through; so before whole sets are compared, the second and third order
are asked again with prefixes of half the set, whose maps grow with them (four bits a
token): that bound holds for prefixes of any length, and is the sharper the longer they
are. What all three orders let through is verified on the whole sets.

Documents with equal sets are one node. Groups of near copies aren't expanded into
pairs: a first round compares every member of a token's group with one hub, the member
whose shared token stands first. What is then in one component needs no further
comparison, and the last round compares members of different components, those of the
group's largest component against the others only. So no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bit_filter, forget, give_back, hashed_words, mix, passes, sequence_hashes, shuffle_partitions, stored, text_buffers
from loomgraph.llm.components import components

WORDS, PERCENT = 5, 80
SKETCH_BITS = (16, 23)  # counters of the frequency sketch: as many as the text asks for, within these
FILTER_BITS = (15, 28)
LOCAL_GROUP = 256  # a task sends on no more members of one token's group than these
SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D)
MAPS = [f"map{order}{half}" for order in (2, 3) for half in "ab"]  # 128 bits for each further order
HALVES = [f"half{order}" for order in (2, 3)]  # maps of half the set under each further order
HALF_BITS = 4  # for each token of that half
_BLOCK = 1 << 16  # counters in one row of the sketch


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes); a text of fewer words has one for the whole."""
    for k in range(0, len(column), 512):
        for first, hashes, at in hashed_words(*text_buffers(column.slice(k, 512)), lower=True):
            grams = sequence_hashes(hashes, words)
            for i in range(len(at) - 1):
                a, b = at[i], at[i + 1]
                if b - a >= words:
                    yield k + first + i, np.unique(grams[a : b - words + 1])
                elif b > a:
                    yield k + first + i, sequence_hashes(hashes[a:b], int(b - a))
                else:
                    yield k + first + i, np.zeros(0, np.uint64)


def _node(items: np.ndarray) -> int:
    """The set's own number: a 64-bit hash of its sorted tokens, by which equal sets are known."""
    ranks = np.arange(1, len(items) + 1, dtype=np.uint64)
    return int(mix(np.array([mix(items ^ (ranks * np.uint64(SEEDS[0]))).sum(dtype=np.uint64) + np.uint64(len(items))]))[0].astype(np.int64))


def _prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _prefix(items: np.ndarray, keys: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens by their ``keys``, and those keys; in no order."""
    size = _prefix_size(len(items), percent)
    if size >= len(items):
        return items, keys
    at = np.argpartition(keys, size - 1)[:size]
    return items[at], keys[at]


def _maps(items: np.ndarray, percent: int) -> list[int]:
    """128 bits for each of the second and third order: which of them the prefix's tokens set."""
    out = []
    for seed in SEEDS[1:]:
        slot = _prefix(items, mix(items ^ np.uint64(seed)), percent)[1] & np.uint64(127)
        for half in (slot[slot < 64], slot[slot >= 64] - np.uint64(64)):
            out.append(int(np.bitwise_or.reduce(np.uint64(1) << half, initial=np.uint64(0)).astype(np.int64)))
    return out


def _half_size(n: int | np.ndarray) -> int | np.ndarray:
    return (n + 1) // 2


def half_maps(items: np.ndarray) -> list[bytes]:
    """For each of the second and third order a map of the first half of the tokens, of ``HALF_BITS`` bits a token or up to twice as many."""
    size = _half_size(len(items))
    bits = 1 << max(6, (HALF_BITS * size - 1).bit_length())
    out = []
    for seed in SEEDS[1:]:
        keys = mix(items ^ np.uint64(seed))
        first = np.partition(keys, size - 1)[:size] if size < len(keys) else keys
        slots = np.zeros(bits, bool)
        slots[(mix(first) & np.uint64(bits - 1)).astype(np.int64)] = True
        out.append(np.packbits(slots, bitorder="little").tobytes())
    return out


def halves_allow(n: int, a: list[bytes], m: int, b: list[bytes], percent: int) -> bool:
    """Whether sets of n and m tokens can be similar by their half maps: each order has its say."""
    need = (percent * (n + m) + 99 + percent) // (100 + percent)
    p, q = _half_size(n), _half_size(m)
    least = min(p + need - n, q + need - m)
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        while len(x) != len(y):  # slots are low bits of a hash, so the halves of the larger map fall together
            if len(x) > len(y):
                x = x.reshape(2, -1)[0] | x.reshape(2, -1)[1]
            else:
                y = y.reshape(2, -1)[0] | y.reshape(2, -1)[1]
        lacks = int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum())
        if min(p - lacks[0], q - lacks[1]) < least:
            return False
    return True


# ---------------------------------------------------------------- sizes, nodes, frequency sketch


def _measured(docs: DataFrame, words: int, percent: int, bits: int) -> DataFrame:
    """Rows of documents (doc_id, copy, n, node, maps, half maps), and of sketch blocks (block, counts): one pass.

    ``copy`` is a hash of the text, which tells rows of one doc_id apart.
    """
    shift = np.uint64(64 - bits)
    names = ["doc_id", "copy", "n", "node", *MAPS, *HALVES, "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pending, held, seen = np.zeros(1 << bits, np.uint32), [], 0, set()

        def count() -> None:
            slots = np.sort((np.concatenate(pending) >> shift).astype(np.uint32))
            starts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
            counts[slots[starts]] += np.diff(np.r_[starts, len(slots)]).astype(np.uint32)

        for batch in batches:
            n, node, maps = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros((len(MAPS), batch.num_rows), np.int64)
            halves: list[list[bytes | None]] = [[None] * batch.num_rows for _ in HALVES]
            for row, items in _sets(batch.column(2), words):
                if not len(items):
                    continue
                n[row], node[row], maps[:, row] = len(items), _node(items), _maps(items, percent)
                if (key := int(node[row])) not in seen:
                    seen.add(key)
                    for column, made in zip(halves, half_maps(items), strict=True):  # one row of a node in each task has them
                        column[row] = made
                    pending.append(items)
                    held += len(items)
                if held > 1 << 20:
                    count()
                    pending, held = [], 0
            none = batch.num_rows
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n), pa.array(node), *map(pa.array, maps), *[pa.array(h, pa.binary()) for h in halves], pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names=names)
        if pending:
            count()
        blocks = np.minimum(counts, 65535).astype("<u2").reshape(-1, min(_BLOCK, 1 << bits))
        parts = [(i, pa.compress(b.tobytes(), "zstd", asbytes=True)) for i, b in enumerate(blocks) if b.any()]
        yield pa.record_batch([pa.nulls(len(parts), pa.int64())] * (4 + len(MAPS)) + [pa.nulls(len(parts), pa.binary())] * len(HALVES) + [pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=names)
        give_back()

    kinds = ", ".join([f"{c} long" for c in names[: 4 + len(MAPS)]] + [f"{c} binary" for c in HALVES])
    return docs.select("doc_id", F.xxhash64("text").alias("copy"), "text").mapInArrow(run, f"{kinds}, block int, counts binary")


def _levels(measured: DataFrame, bits: int) -> np.ndarray:
    """Frequency classes 0-63 of the sketch's counters, two for each power of two: as many bytes as ``bits`` say."""
    size = min(_BLOCK, 1 << bits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(pa.decompress(raw, 2 * size, "zstd"), "<u2").astype(np.int64)
        if sums:
            levels = [np.clip(2 * np.log2(np.maximum(v, 1)), 0, 63).astype(np.uint8).tobytes() for v in sums.values()]
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["block", "levels"])

    out = np.zeros(1 << bits, np.uint8)
    for row in measured.where("block is not null").select("block", "counts").repartition("block").mapInArrow(add, "block int, levels binary").collect():
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["levels"], np.uint8)
    return out


# ---------------------------------------------------------------- groups of the first order


def _packed(*columns: np.ndarray) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def _small(*columns: np.ndarray) -> bytes:
    """Columns of small numbers, compressed."""
    return pa.compress(b"".join(c.astype("<u4").tobytes() for c in columns), "zstd", asbytes=True)


def _small_from(raw: bytes, columns: int, rows: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, 4 * columns * rows, "zstd"), "<u4").reshape(columns, rows).astype(np.int64)


def _fits(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m tokens whose first shared token is at i and j may be similar."""
    need = (percent * (n + m) + 99 + percent) // (100 + percent)
    return np.minimum(n - i, m - j) >= need


def _hubs(token: np.ndarray, node: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in any order: an order by token, then place and node; where tokens begin in it, each row's group and its hub's row."""
    rank = np.lexsort((node, place, token))
    new = np.r_[True, token[rank][1:] != token[rank][:-1]]
    group = np.cumsum(new) - 1
    return rank, new, group, np.flatnonzero(new)[group]


def _prefix_rows(docs: DataFrame, levels, bits: int, words: int, percent: int, buckets: int) -> DataFrame:
    """Packed rows of first-order prefixes: (bucket, rows, tokens, nodes, small: size and place, crowds, a and b: pairs of a crowd).

    A token's upper half chooses the bucket, its lower half is sent. Of a token that is
    crowded within a task its hub alone goes to the bucket; all its members, and their
    pairs with the hub, are packed under a negative number and pass by the groups.
    """
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen, held, many = levels.value, set(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            token, node, n, place = (np.concatenate([h[k] for h in held]) for k in range(4))
            rank, new, group, hub = _hubs(token, node, place)
            token, node, n, place = token[rank], node[rank], n[rank], place[rank]
            crowded = np.bincount(group)[group] > LOCAL_GROUP
            bucket = ((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            send = np.flatnonzero(~crowded | new)
            send = send[np.argsort(bucket[send], kind="stable")]
            cuts = np.searchsorted(bucket[send], np.arange(buckets + 1))
            rows = []
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if b > a:
                    at = send[a:b]
                    short = (token[at] & np.uint64(0xFFFFFFFF)).astype("<u4")
                    rows.append((k, b - a, _packed(short), _packed(node[at]), _small(n[at], place[at]), _packed(short[crowded[at]]), b"", b""))
            at = np.flatnonzero(crowded)
            for a in range(0, len(at), 65536):  # these pass by the groups: each is a group of its own
                x = at[a : a + 65536]
                pair = x[_fits(n[x], place[x], n[hub[x]], place[hub[x]], percent) & (x != hub[x])]
                key = int(mix(token[x[:1]] ^ node[:1].astype(np.uint64))[0] >> np.uint64(34))
                full = (bucket[x].astype(np.uint64) << np.uint64(32)) | (token[x] & np.uint64(0xFFFFFFFF))
                rows.append((-1 - key, len(x), _packed(full), _packed(node[x]), _small(n[x], place[x]), b"", _packed(node[pair]), _packed(node[hub[pair]])))
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 6)
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["bucket", "rows", "tokens", "nodes", "small", "crowds", "a", "b"])

        for batch in batches:
            for _, items in _sets(batch.column(0), words):
                if not len(items) or (node := _node(items)) in seen:
                    continue
                seen.add(node)
                keys = (mix(items ^ np.uint64(SEEDS[0])) >> np.uint64(6)) | (level[(items >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(58))
                first, keys = _prefix(items, keys, percent)
                place = np.empty(len(first), np.int64)
                place[np.argsort(keys)] = np.arange(len(first))
                held.append((first, np.full(len(first), node, np.int64), np.full(len(first), len(items), np.int64), place))
                many += len(first)
                if many > 1 << 20:
                    yield from flush()
                    held, many = [], 0
        if held:
            yield from flush()
        give_back()

    return docs.select("text").mapInArrow(run, "bucket int, rows int, tokens binary, nodes binary, small binary, crowds binary, a binary, b binary")


_GROUPED = "rows int, tokens binary, nodes binary, small binary, a binary, b binary"


def _grouped(percent: int):
    def group(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Of one bucket: pairs of members with their group's hub (a, b), and the members of groups of three or more."""
        if key[0] < 0:
            return frame[["rows", "tokens", "nodes", "small", "a", "b"]]

        def joined(column: str, kind: str) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, kind) for x in frame[column]])

        token, node = joined("tokens", "<u4").astype(np.int64), joined("nodes", "<i8")
        n, place = np.concatenate([_small_from(raw, 2, rows) for raw, rows in zip(frame["small"], frame["rows"], strict=True)], axis=1)
        crowds = np.unique(joined("crowds", "<u4").astype(np.int64))
        rank, new, _, _ = _hubs(token, node, place)
        token, node, n, place = token[rank], node[rank], n[rank], place[rank]
        keep = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]  # a node that two tasks have seen
        token, node, n, place, new = token[keep], node[keep], n[keep], place[keep], np.r_[True, token[keep][1:] != token[keep][:-1]]
        group = np.cumsum(new) - 1
        size, hub = np.bincount(group)[group], np.flatnonzero(new)[group]
        near = np.flatnonzero(~new & (node != node[hub]) & _fits(n, place, n[hub], place[hub], percent))
        pairs = np.unique(np.stack([node[near], node[hub[near]]]), axis=1)
        # a crowded token has members elsewhere, and keeps its number; of other groups with the
        # same members that of the first token says it all, under a number made from the members
        crowded = np.isin(token, crowds)
        kept, number = [np.flatnonzero(crowded)], [token[crowded] | (np.int64(key[0]) << np.int64(32))]
        if (plain := np.flatnonzero((size > 2) & ~crowded)).size:
            starts = np.flatnonzero(np.r_[True, group[plain][1:] != group[plain][:-1]])
            sizes = np.diff(np.r_[starts, len(plain)])
            sign = np.add.reduceat(mix(node[plain].astype(np.uint64)), starts)
            first = np.lexsort((place[plain][starts], sign))
            first = first[np.r_[True, sign[first][1:] != sign[first][:-1]]]
            chosen = np.zeros(len(starts), bool)
            chosen[first] = True
            stay = np.repeat(chosen, sizes)
            kept.append(plain[stay])
            number.append(np.repeat(sign.astype(np.int64), sizes)[stay])
        at = np.concatenate(kept)
        return pd.DataFrame({"rows": [len(at)], "tokens": [_packed(np.concatenate(number))], "nodes": [_packed(node[at])], "small": [_small(n[at], place[at])], "a": [_packed(pairs[0])], "b": [_packed(pairs[1])]})

    return group


def _members(grouped: DataFrame) -> DataFrame:
    """(token, node, n, place), a row for each; of one number's repeats those of its first token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, tokens, nodes, small in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows:
                    n, place = _small_from(small, 2, rows)
                    columns = [np.frombuffer(tokens, "<i8"), np.frombuffer(nodes, "<i8"), n, place]
                    for i in range(0, rows, 1 << 16):
                        yield pa.record_batch([pa.array(c[i : i + (1 << 16)]) for c in columns], names=["token", "node", "n", "place"])

    rows = grouped.select("rows", "tokens", "nodes", "small").mapInArrow(run, "token long, node long, n long, place long")
    return rows.groupBy("token", "node").agg(F.first("n").alias("n"), F.min("place").alias("place"))


def _hub_pairs(grouped: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                columns = [np.frombuffer(x, "<i8") for x in (left, right)]
                for i in range(0, len(columns[0]), 1 << 16):
                    yield pa.record_batch([pa.array(c[i : i + (1 << 16)]) for c in columns], names=["a", "b"])

    pairs = grouped.select("a", "b").mapInArrow(run, "a long, b long").where("a <> b")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


# ---------------------------------------------------------------- the orders' say on a pair


def _need(percent: int) -> Column:
    return F.expr(f"({percent} * (a_n + b_n) + {99 + percent}) div {100 + percent}")


def _other_orders(percent: int) -> Column:
    """Whether the prefixes of a and b under the second and third order can share enough.

    A bit that a's prefix sets and b's doesn't is a token of a's that b's lacks.
    """
    size = {x: F.expr(f"{x}_n - ({percent} * {x}_n + 99) div 100 + 1") for x in "ab"}
    least = F.least(*[size[x] + _need(percent) - F.col(f"{x}_n") for x in "ab"])
    out = F.lit(True)
    for order in (2, 3):
        halves = [f"map{order}{half}" for half in "ab"]
        lacks = {x: sum((F.bit_count(F.col(f"{x}_{h}").bitwiseAND(F.bitwise_not(F.col(f"{y}_{h}")))) for h in halves), F.lit(0)) for x, y in ("ab", "ba")}
        out &= F.least(*[size[x] - lacks[x] for x in "ab"]) >= least
    return out


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in rows.columns if c not in ("node", "token", "part")], *[c for c in ("token", "part") if c in rows.columns])


def _passed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that the second and third order let through."""
    return pairs.join(_side(nodes, "a"), "a").join(_side(nodes, "b"), "b").where(_other_orders(percent)).select("a", "b")


def _halves_pass(pairs: DataFrame, measured: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the second and third order let through by their half maps."""
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    maps = measured.where(F.col(HALVES[0]).isNotNull()).select("node", "n", *HALVES).join(needed, "node", "left_semi").dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            keep = [halves_allow(n, [a2, a3], m, [b2, b3], percent) for n, a2, a3, m, b2, b3 in rows]
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    columns = ["a", "b", *[f"{side}_{c}" for side in "ab" for c in ("n", *HALVES)]]
    return pairs.join(_side(maps, "a"), "a").join(_side(maps, "b"), "b").select(columns).mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- verification


def _whole_sets(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(node, n, items) of the nodes in ``needed``.

    Texts are read again, and a filter of fixed size lets few others through; so no
    text is shuffled.
    """
    spark = docs.sparkSession
    bits = int(np.clip(np.ceil(np.log2(max(1, needed.count()))) + 5, *FILTER_BITS))
    held = spark.sparkContext.broadcast(bit_filter(needed, "node", bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        rows: list[tuple[int, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            at = np.r_[0, np.cumsum([len(r[1]) for r in rows])].astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([r[1] for r in rows]).view(np.int64)))
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array(np.diff(at).astype(np.int64)), items], names=["node", "n", "items"])

        for batch in batches:
            for _, items in _sets(batch.column(0), words):
                if len(items) and (node := _node(items)) not in seen and passes(held.value, bits, np.array([node], np.int64).astype(np.uint64))[0]:
                    seen.add(node)
                    rows.append((node, items))
                    if len(rows) == 200:
                        yield flush()
                        rows.clear()
        if rows:
            yield flush()
        give_back()

    found = docs.select("text").mapInArrow(run, "node long, n long, items array<long>")
    return found.join(needed, "node", "left_semi").dropDuplicates(["node"])


def _linked(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those of similarity ``percent`` or more, by their whole sets; stored."""
    nodes = stored(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "nodes")
    whole = stored(_whole_sets(docs, nodes, words), "sets")
    both = pairs.join(_side(whole, "a"), "a").join(_side(whole, "b"), "b")
    common = F.size(F.array_intersect("a_items", "b_items"))
    out = stored(both.where(100 * common >= percent * (F.col("a_n") + F.col("b_n") - common)).select("a", "b"), "links")
    forget(nodes, whole)
    return out


def _mixed(members: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of the groups whose nodes are in several components, with the maps of the other orders."""
    at = members.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    mixed = at.groupBy("token").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("token")
    return at.join(mixed, "token", "left_semi").join(nodes.drop("n"), "node")


def _across(at: DataFrame, percent: int) -> DataFrame:
    """Pairs of one group whose nodes are in different components, as far as all orders let them through.

    Those of the group's largest component are not paired with each other. Sets meet
    only in their own size class or the next: similar sizes are in such classes.
    """
    sizes = at.groupBy("token", "label").agg(F.count("*").alias("c"))
    most = sizes.groupBy("token").agg(F.max(F.struct("c", "label"))["label"].alias("most"))
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(104 / percent)).cast("int")
    every = at.withColumn("part", part)
    few = every.join(most, "token").where("label <> most").drop("most").withColumn("part", F.explode(F.array(*[F.col("part") + k for k in (-1, 0, 1)])))
    places = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) >= _need(percent)
    pairs = _side(few, "a").join(_side(every, "b"), ["token", "part"]).where((F.col("a_label") != F.col("b_label")) & places & _other_orders(percent))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def similar_nodes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, copy, n, node) of every row, and (node, component) of the nodes that have links."""
    spark, n = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    size = docs.select(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, size / 50))), *SKETCH_BITS))
    measured = stored(_measured(docs, words, percent, bits), "measured")
    levels = spark.sparkContext.broadcast(_levels(measured, bits))
    ids = measured.where("block is null").select("doc_id", "copy", "n", "node")
    nodes = measured.where("block is null and n > 0").select("node", "n", *MAPS).dropDuplicates(["node"])

    buckets = max(n, int(size // (64 << 20)) + 1)
    packed = _prefix_rows(docs, levels, bits, words, percent, buckets)
    grouped = stored(packed.groupBy("bucket").applyInPandas(_grouped(percent), _GROUPED), "groups")
    pairs = stored(_passed(_hub_pairs(grouped), nodes, percent), "pairs")
    likely = stored(_halves_pass(pairs, measured, percent), "pairs")
    members = stored(_members(grouped), "members")
    forget(grouped)
    links = _linked(docs, likely, words, percent)
    labels = stored(components(links), "labels")
    mixed = stored(_mixed(members, labels, nodes), "mixed")
    forget(members)
    rest = stored(_halves_pass(_across(mixed, percent).join(pairs, ["a", "b"], "left_anti"), measured, percent), "pairs")
    forget(mixed, pairs, likely)
    if rest.isEmpty():
        return ids, labels
    more = _linked(docs, rest, words, percent)
    return ids, components(links.unionByName(more))


def _found(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Every row's doc_id, copy, n and the smallest doc_id of its component."""
    ids, labels = similar_nodes(docs, words, percent)
    at = ids.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    least = at.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    some = at.where("n > 0").join(least, "label").select("doc_id", "copy", "n", "least")
    return some.unionByName(at.where("n = 0").select("doc_id", "copy", "n", F.col("doc_id").alias("least")))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Every row's doc_id, n_shingles and component_id, the smallest doc_id that its links reach.

    A null or wordless text has no shingles and is alone. Rows that share a set are
    linked to each other; a null doc_id is never the smallest, so a component without
    any other has a null id. Repeated rows stay; an empty table gives an empty result.
    """
    return _found(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the near copies: of each component the document with the smallest doc_id stays.

    Rows are known by doc_id and text together. Rows that repeat both are one document,
    which stays or goes as a whole; a row without an id goes if its component has a row
    with one. Wordless texts stay, and so do components without any id.
    """
    found = _found(docs, words, percent)
    gone = found.where("least is not null and not doc_id <=> least").select(F.col("doc_id").alias("_gone_id"), F.col("copy").alias("_gone_copy")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_copy"]), "left_anti")
