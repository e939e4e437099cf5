"""Approximate nearest neighbours by learned partitions of a neighbour graph.

The exact neighbour graph of a bounded sample is cut into balanced parts; a small
classifier learns in which parts a vector's neighbours lie. It places every row in
a part and routes each query to its most probable parts, where candidates are ranked
by their exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import stored

TOP, EVERY = 20, 20
SAMPLE, PART_SAMPLE = 12_000, 32  # vectors that partition and router are learned from, at most: so many, or so many for each part
NEIGHBOURS = 16
PART_ROWS = 5_000  # rows a part should have
PARTS = (4, 1_024)
MASS = 0.93  # probability that the parts searched for a query make up
BLOCK_ROWS = 20_000  # rows of one part that one task ranks
ASKED_BLOCKS = 8  # its queries are those of so many blocks at most, a twentieth of their rows


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) without null, zero, or non-finite vectors; null ids take no part.

    Nor do vectors of another length than most; of lengths as frequent, the greatest
    holds. Rows that repeat id and vector are one.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", v.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    lengths = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return rows.where(F.size("embedding") == (lengths["n"] if lengths else 0)).dropDuplicates(["vec_id", "embedding"])


# ---------------------------------------------------------------- partition and router


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product of every row, itself left out."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        scores = x[a : a + 512] @ x.T
        scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -np.inf
        out[a : a + 512] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 3, rounds: int = 12) -> np.ndarray:
    """A part for every row, none over a tenth above its share: balanced centroids, then rows move to where most of their neighbours are."""
    n, rng = len(x), np.random.default_rng(seed)
    limit = int(np.ceil(1.1 * n / parts))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(8):
        scores = unit @ centres.T
        part = _fill(scores, limit)
        sums = np.zeros_like(centres)
        np.add.at(sums, part, unit)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    edges = np.concatenate([graph.reshape(-1), np.repeat(np.arange(n), graph.shape[1])]), np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.reshape(-1)])
    for _ in range(rounds):
        votes = np.bincount(edges[1] * parts + part[edges[0]], minlength=n * parts).reshape(n, parts).astype(float)
        votes[np.arange(n), part] += 0.5  # staying is better than a tie
        new = _fill(votes + 1e-6 * (unit @ centres.T), limit)
        if (new == part).all():
            break
        part = new
    return part


def _fill(scores: np.ndarray, limit: int) -> np.ndarray:
    """Each row's best part with room, those with most to lose first."""
    n, parts = scores.shape
    ranked = np.argsort(-scores, axis=1, kind="stable")
    best = np.take_along_axis(scores, ranked[:, :2], axis=1)
    order = np.argsort(-(best[:, 0] - best[:, -1]), kind="stable")
    room, out = np.full(parts, limit), np.full(n, -1)
    for i in order:
        for p in ranked[i]:
            if room[p]:
                room[p] -= 1
                out[i] = p
                break
    return out


@dataclass
class Router:
    """One hidden layer from a vector to the probability of each part."""

    weights: list[np.ndarray]
    scale: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        W, b, V, c = self.weights
        out = np.maximum((x / self.scale) @ W + b, 0) @ V + c
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def learn_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 5) -> Router:
    """Learns ``target``, the share of each row's neighbours in each part."""
    rng, scale = np.random.default_rng(seed), float(np.sqrt((x**2).mean())) or 1.0
    shapes = [(x.shape[1], hidden), (hidden,), (hidden, target.shape[1]), (target.shape[1],)]
    weights = [rng.normal(0, np.sqrt(2 / s[0]), s) if len(s) > 1 else np.zeros(s) for s in shapes]
    m, v, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
    router = Router(weights, scale)
    for epoch in range(epochs):
        rate = 3e-3 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(len(x))
        for k in range(0, len(x), 256):
            pick = order[k : k + 256]
            a = x[pick] / scale
            pre = a @ weights[0] + weights[1]
            h = np.maximum(pre, 0)
            d = (router.probabilities(x[pick]) - target[pick]) / len(pick)
            dh = (d @ weights[2].T) * (pre > 0)
            step += 1
            for j, g in enumerate([a.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0)]):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                weights[j] -= rate * (m[j] / (1 - 0.9**step) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8) + 1e-4 * weights[j])
    return router


def fit(rows: DataFrame, sample: int = SAMPLE) -> Router | None:
    """Partition and router from at most about ``sample`` distinct vectors (``PART_SAMPLE`` for each part, if that is more), chosen by a hash of their ids."""
    n = rows.count()
    parts = int(np.clip(n // PART_ROWS, *PARTS))
    sample = max(sample, PART_SAMPLE * parts)
    share = rows if n <= sample else rows.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    x = np.array([r["embedding"] for r in share.select("vec_id", "embedding").limit(2 * sample).collect()])
    x = np.unique(x, axis=0) if len(x) else x
    if len(x) < 4 * parts:
        return None
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].reshape(-1)), 1 / graph.shape[1])
    return learn_router(x, target)


# ---------------------------------------------------------------- search


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _placed(rows: DataFrame, router: Router | None, mass: float) -> DataFrame:
    """(vec_id, embedding, part): one part a row, or for queries (``mass`` > 0) every part that makes up the mass."""
    held = rows.sparkSession.sparkContext.broadcast(router)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if held.value is None or not batch.num_rows:
                yield pa.record_batch([*batch.columns, pa.array(np.zeros(batch.num_rows, np.int32))], names=["vec_id", "embedding", "part"])
                continue
            p = held.value.probabilities(_matrix(batch.column(1)))
            if mass:
                order = np.argsort(-p, axis=1, kind="stable")
                before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
                row, rank = np.nonzero(before < mass)
                part = order[row, rank]
            else:
                row, part = np.arange(batch.num_rows), p.argmax(axis=1)
            yield pa.record_batch([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(part.astype(np.int32))], names=["vec_id", "embedding", "part"])

    return rows.mapInArrow(run, "vec_id long, embedding array<double>, part int")


def _ranked(top: int):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy())
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        begins = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])  # an id of several vectors counts by the nearest of them
        every, ends = ids[begins], np.r_[begins[1:], len(ids)]
        out = []
        for a in range(0, len(queries), 256):
            q = queries.iloc[a : a + 256]
            own, y = q["vec_id"].to_numpy(), np.stack(q["embedding"].to_numpy())
            rough = y @ x.T
            if len(every) < len(ids):
                rough = np.maximum.reduceat(rough, begins, axis=1)
            rough[own[:, None] == every[None, :]] = -np.inf
            k = min(top, len(every))
            # equal scores all come along, so that ties go to the smaller vec_id
            floor = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
            for i in range(len(own)):
                near = np.flatnonzero((rough[i] >= floor[i] - 1e-9 * abs(floor[i])) & (rough[i] > -np.inf))
                exact = np.array([(x[begins[j] : ends[j]] * y[i]).sum(axis=1).max() for j in near])
                best = np.lexsort((every[near], -exact))[:k]
                out.append(pd.DataFrame({"query_id": own[i], "vec_id": every[near[best]], "score": exact[best]}))
        return pd.concat(out, ignore_index=True)[columns]

    return run


def nearest(rows: DataFrame, is_query: Column, top: int = TOP, router: Router | None = None, mass: float = MASS) -> DataFrame:
    """Of each query (rows of ``is_query``) the ``top`` nearest found: query_id, rank, vec_id, score.

    A part of more than ``BLOCK_ROWS`` rows, as a vector repeated without end makes
    it, is ranked in blocks, and what the blocks find is put together: each block
    gives ``top`` rows a query at most. Without a router all rows are one part. A
    query for which fewer than ``top`` rows are found is searched in all parts.
    """
    placed = stored(_placed(rows, router, 0), "placed")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).collect()  # a row a part
    blocks = {r["part"]: -(-r["n"] // BLOCK_ROWS) for r in sizes}
    counts = F.create_map(*[F.lit(x) for p, b in blocks.items() for x in (p, b)]) if blocks else None
    if counts is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_blocks = counts[F.col("part")]
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), n_blocks).cast("int"))
    asked = _placed(rows.where(is_query), router, mass).where(n_blocks.isNotNull())
    found = stored(_search(asked, dealt, n_blocks, top), "found")
    if router is not None:
        # a query whose parts hold too few rows for a full answer gets all the other rows
        have = found.groupBy("query_id").agg(F.count("*").alias("n"))
        short = rows.where(is_query).join(have.where(F.col("n") >= top), F.col("vec_id") == F.col("query_id"), "left_anti")
        short = stored(short, "short")
        if not short.isEmpty():
            every = short.select("vec_id", "embedding", F.explode(F.array(*[F.lit(p) for p in sorted(blocks)])).alias("part"))
            rest = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
            found = rest.unionByName(_search(every, dealt, n_blocks, top))
    return found


def _search(asked: DataFrame, dealt: DataFrame, n_blocks: Column, top: int) -> DataFrame:
    # queries of a large part are in blocks too, and its rows go to each of them
    n_asked = F.ceil(n_blocks / ASKED_BLOCKS)
    asked = asked.withColumns({"block": F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))), "asked": F.pmod(F.xxhash64("vec_id"), n_asked).cast("int")})
    dealt = dealt.withColumn("asked", F.explode(F.sequence(F.lit(0), (n_asked - 1).cast("int"))))
    each = asked.groupBy("part", "block", "asked").cogroup(dealt.groupBy("part", "block", "asked")).applyInPandas(_ranked(top), "query_id long, vec_id long, score double")
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = EVERY, top: int = TOP, mass: float = MASS, sample: int = SAMPLE) -> DataFrame:
    """The contract's search: rows whose vec_id is divisible by ``every`` against all others.

    Rows that repeat a vec_id are one candidate and one query, near by the nearest of
    their vectors; none is a candidate of its own id. Null, zero and non-finite vectors
    and those of another length than most take no part; an empty table has no answers.
    """
    rows = usable(vectors)
    found = nearest(rows, F.col("vec_id") % every == 0, top, fit(rows, sample), mass)
    return found.select("query_id", "rank", "vec_id", "score")
