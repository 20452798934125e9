"""Nearest neighbours by inner product over learned partitions.

Largest inner products become nearest directions by one more component: a row is
divided by the largest norm of all rows and filled up to length one, a query is
divided by its own norm and gets a zero. A bounded sample's neighbour graph is cut
into parts of equal size: recursive halving along principal directions, then moves
of single vectors to the part that holds most of their neighbours, within a slack
of the size. A small network learns the parts of sampled rows, and how the
neighbours of sampled queries spread over the parts. It files every row under its
most probable part and sends a query to the most probable ones, where all rows are
compared exactly. How many it visits is measured: sampled queries that the network
has not learned must find TARGET of their neighbours. The number of parts grows
with the root of the rows, and large parts are dealt into blocks, so no part, however popular,
has to fit one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import hash_unit

#: Rows of the sample at least and for each part, neighbours of each in the graph, and hidden units of the network.
SAMPLE, SAMPLE_EACH, NEIGHBOURS, HIDDEN = 6000, 64, 16, 96
#: There are as many parts as the root of the rows holds this, about, and at least and at most so many.
PART_ROOT, LEAST_PARTS, MOST_PARTS = 7, 8, 256
#: Share of their neighbours that sampled queries must find, and of the sample one row in so many is such a query.
TARGET, ASKING = 0.94, 8
#: Candidates and queries of one block.
BLOCK, QUERIES = 16_384, 4_096


def neighbour_graph(queries: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product for each query, the row of the same place left out."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = queries[at : at + 512] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.15) -> np.ndarray:
    """Part of each row: equal halvings, then moves that keep more edges inside parts."""
    label = np.zeros(len(x), np.int64)
    pieces = [np.arange(len(x))]
    while len(pieces) < parts:
        pieces.sort(key=len, reverse=True)
        piece = pieces.pop(0)
        if len(piece) < 2:
            pieces.append(piece)
            break
        centred = x[piece] - x[piece].mean(axis=0)
        side = np.linalg.svd(centred, full_matrices=False)[2][0]
        order = np.argsort(centred @ side, kind="stable")
        pieces += [piece[order[: len(piece) // 2]], piece[order[len(piece) // 2 :]]]
    for i, piece in enumerate(pieces):
        label[piece] = i
    most = math.ceil(slack * len(x) / parts)
    source = np.repeat(np.arange(len(x)), graph.shape[1])
    both = np.concatenate([np.stack([source, graph.ravel()]), np.stack([graph.ravel(), source])], axis=1)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (both[0], label[both[1]]), 1)
        size = np.bincount(label, minlength=parts)
        gain = votes.max(axis=1) - votes[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: (gain > 0).sum()].tolist():
            for to in np.argsort(-votes[i], kind="stable")[:4].tolist():
                if votes[i, to] <= votes[i, label[i]]:
                    break
                if size[to] < most:
                    size[label[i]] -= 1
                    size[to] += 1
                    label[i] = to
                    moved += 1
                    break
        if not moved:
            break
    return label


@dataclass
class Router:
    """A two-layer network from a vector to the log-probabilities of parts."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.a + self.b, 0) @ self.c + self.d


def train_router(x: np.ndarray, target: np.ndarray, epochs: int = 40, seed: int = 3) -> Router:
    """Cross-entropy to ``target`` distributions by Adam."""
    rng = np.random.default_rng(seed)
    dims, parts = x.shape[1], target.shape[1]
    p = [rng.normal(0, (2 / dims) ** 0.5, (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    step = 0
    for epoch in range(epochs):
        rate = 3e-3 * 0.5 * (1 + math.cos(math.pi * epoch / epochs))
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            i = order[at : at + 256]
            h = np.maximum(x[i] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            e = (z / z.sum(axis=1, keepdims=True) - target[i]) / len(i)
            back = (e @ p[2].T) * (h > 0)
            step += 1
            for k, g in enumerate((x[i].T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


def as_row(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows divided by the largest norm, with a component that fills them up to length one."""
    x = x / longest
    return np.c_[x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))]


def as_query(x: np.ndarray) -> np.ndarray:
    """Queries of length one, with a zero where rows are filled up."""
    return np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))]


def fit(x: np.ndarray, longest: float, parts: int, k: int = 20, target: float = TARGET) -> tuple[Router, int]:
    """Learn the parts of a sample and their router; also the parts that a query has to visit."""
    parts = max(1, min(parts, len(x) // 16))
    if parts == 1:
        return Router(np.zeros((x.shape[1] + 1, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1
    asks = np.arange(len(x)) % ASKING == ASKING - 1
    rows, queries = as_row(x[~asks], longest), as_query(x[~asks])
    graph = neighbour_graph(queries, rows, NEIGHBOURS)
    label = balanced_parts(rows, graph, parts)
    filed = np.full((len(rows), parts), 1e-3)
    filed[np.arange(len(rows)), label] = 1
    spread = np.full((len(rows), parts), 1e-3)
    np.add.at(spread, (np.repeat(np.arange(len(rows)), graph.shape[1]), label[graph.ravel()]), 1.0)
    target_ = np.r_[filed / filed.sum(axis=1, keepdims=True), spread / spread.sum(axis=1, keepdims=True)]
    router = train_router(np.r_[rows, queries], target_)
    # how far down its list each neighbour of an unlearned query stands
    own = router.logits(rows).argmax(axis=1)
    asked = as_query(x[asks])
    order = np.argsort(-router.logits(asked), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :], axis=1)
    found = np.argpartition(-(asked @ rows.T), min(k, len(rows) - 1), axis=1)[:, : min(k, len(rows))]
    depth = np.take_along_axis(place, own[found], axis=1)
    share = np.cumsum(np.bincount(depth.ravel(), minlength=parts)) / depth.size
    return router, int(np.searchsorted(share, target)) + 1


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def nearest(queries: tuple[np.ndarray, np.ndarray], candidates: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of each query's k best candidates, ties to the smaller id, its own id left out.

    A matrix product finds all candidates that may be among the best; their scores
    are then added up in one fixed order, so that equal vectors have equal scores.
    """
    (qid, q), (cid, c) = queries, candidates
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    k_here = k + len(cid) - len(np.unique(cid))  # rows that repeat an id may stand in the way
    out = ([], [], [])
    room = 1e-9 * (1 + np.abs(c).max(initial=0.0) * np.abs(q).max(initial=0.0) * q.shape[1])
    for at in range(0, len(q), 256):
        s = q[at : at + 256] @ c.T
        for row, (low, high) in enumerate(zip(np.searchsorted(cid, qid[at : at + 256]), np.searchsorted(cid, qid[at : at + 256], side="right"))):
            s[row, low:high] = -np.inf
        least = np.partition(s, len(cid) - k_here, axis=1)[:, len(cid) - k_here] if len(cid) > k_here else np.full(len(s), -np.inf)
        for row in range(len(s)):
            may = np.flatnonzero((s[row] >= least[row] - room) & (s[row] > -np.inf))
            exact = (c[may] * q[at + row]).sum(axis=1)
            best = np.lexsort((cid[may], -exact))
            _, first = np.unique(cid[may[best]], return_index=True)
            best = best[np.sort(first)[:k]]
            out[0].append(np.full(len(best), qid[at + row]))
            out[1].append(cid[may[best]])
            out[2].append(exact[best])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def valid(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of the rows that take part: finite components, none null, not all zero, an id."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ok)


def search(df: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, parts: int | None = None, visits: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest of all other rows found.

    ``is_query`` is a condition on ``id``. Vectors that are null, zero, or hold null
    or non-finite components take no part. Only vectors of one length have an inner
    product, so each length is searched by itself. A vec_id that several rows have
    counts once, with its best score. With fewer than ``k`` candidates all that were
    visited are returned; equal scores go to the smaller vec_id, and an empty table, or one
    without a query, gives no rows. Other columns are not read. ``parts`` and ``visits`` are set by the rows unless given.
    """
    spark = df.sparkSession
    rows = valid(df, vec_id, embedding)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    lengths = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(norm).alias("longest")).orderBy("dims").collect()  # one row a length
    found = None
    for r in lengths:
        one = _found(rows.filter(F.size("v") == r["dims"]), is_query, r["dims"], r["n"], r["longest"], k, parts, visits)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(rows: DataFrame, is_query, dims: int, n: int, longest: float, k: int, parts: int | None, visits: int | None) -> DataFrame:
    """(query_id, vec_id, score) of the k best in each part that a query visits; ``rows`` are n vectors of ``dims`` components."""
    spark = rows.sparkSession
    out = "query_id long, vec_id long, score double"
    parts = parts or min(MOST_PARTS, max(LEAST_PARTS, 1 << max(0, round(math.log2(n**0.5 / PART_ROOT)))))
    sample = rows.orderBy(hash_unit("id", 3), "id").limit(max(SAMPLE, SAMPLE_EACH * parts)).toArrow()  # of bounded size
    x = np.unique(_matrix(sample["v"], dims), axis=0)
    router, needed = fit(np.random.default_rng(5).permutation(x), longest, parts, k)
    visits = visits or needed
    shared = spark.sparkContext.broadcast(router)  # of fixed size

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            m, query = _matrix(batch.column(1), dims), batch.column(2).to_numpy(zero_copy_only=False)
            own = shared.value.logits(as_row(m, longest)).argmax(axis=1)
            asks = np.flatnonzero(query)
            order = np.argsort(-shared.value.logits(as_query(m[asks])), axis=1, kind="stable")[:, :visits]
            at = np.r_[np.arange(len(m)), np.repeat(asks, order.shape[1])]
            part = np.r_[own, order.ravel()]
            role = np.r_[np.zeros(len(m), bool), np.ones(len(at) - len(m), bool)]
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(role), batch.column(0).take(take), batch.column(1).take(take)], ["part", "asks", "id", "v"])

    filed = rows.withColumn("q", is_query).mapInArrow(file, "part int, asks boolean, id long, v array<double>")
    count = {(r["part"], r["asks"]): r["count"] for r in filed.groupBy("part", "asks").count().collect()}  # two rows a part
    most = max([p for p, _ in count], default=0) + 1
    shape = [(p, max(1, math.ceil(count.get((p, False), 0) / BLOCK)), max(1, math.ceil(count.get((p, True), 0) / QUERIES))) for p in range(most)]
    blocks = spark.createDataFrame(shape, "part int, cb int, qb int")
    dealt = filed.join(F.broadcast(blocks), "part")
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    each = lambda n: F.sequence(F.lit(0), n - 1)
    dealt = dealt.withColumn("c", F.explode(F.when(F.col("asks"), each(F.col("cb"))).otherwise(F.array(own(F.col("cb"))))))
    dealt = dealt.withColumn("b", F.explode(F.when(F.col("asks"), F.array(own(F.col("qb")))).otherwise(each(F.col("qb")))))

    def compare(table: pa.Table) -> pa.Table:
        ask, rest = table.filter(table["asks"]), table.filter(pc.invert(table["asks"]))
        if not len(ask) or not len(rest):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, c, s = nearest((ask["id"].to_numpy(), _matrix(ask["v"], dims)), (rest["id"].to_numpy(), _matrix(rest["v"], dims)), k)
        return pa.table({"query_id": pa.array(q.astype(np.int64)), "vec_id": pa.array(c.astype(np.int64)), "score": pa.array(s.astype(float))})

    return dealt.select("part", "c", "b", "asks", "id", "v").groupBy("part", "c", "b").applyInArrow(compare, out)
