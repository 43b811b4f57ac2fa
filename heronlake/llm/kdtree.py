"""Exact top-k inner products with a KD-tree per shard.

Vectors are dealt to shards of bounded size; each shard becomes a KD-tree by median splits, and every node
keeps the tight bounding box of its vectors. For a query q and a box, sum(max(q*lo, q*hi)) bounds every
inner product inside. Nodes are visited best bound first, and the search of a tree ends when the best
bound left is below the k-th score found so far; that k-th score is handed on from shard to shard of a
group. Queries go in blocks: a task holds one block of queries and one group of shards.

Components are integers after quantisation; products are summed in float64 where that is exact, else in
Python integers. Vectors that are null or hold null or non-finite components take no part; only vectors
of equal length meet. Candidates with the query's own id are left out. Rows with equal ids are all
candidates; of queries with equal ids the one with the smallest vector is kept. Ties go to smaller ids.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_floats(*arrays: np.ndarray) -> bool:
    """Whether inner products of such integers are exact in float64."""
    top = math.prod(float(np.abs(a).max(initial=0)) + 1 for a in arrays)
    return top * arrays[0].shape[1] < 2**53


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int):
        order = np.arange(len(ids))
        self.left, self.right, self.span, lo, hi = [], [], [], [], []
        todo = [(0, len(ids), None, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            me = len(self.span)
            if parent is not None:
                (self.left, self.right)[side][parent] = me
            box = vectors[order[a:b]]
            lo.append(box.min(axis=0))
            hi.append(box.max(axis=0))
            self.span.append((a, b))
            self.left.append(-1)
            self.right.append(-1)
            axis = int(np.argmax(hi[-1] - lo[-1]))
            if b - a > leaf and hi[-1][axis] > lo[-1][axis]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(box[:, axis], mid)]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.lo, self.hi = np.array(lo), np.array(hi)
        self.ids, self.vectors = ids[order], vectors[order]

    @classmethod
    def of(cls, parts: dict) -> Tree:
        tree = cls.__new__(cls)
        vars(tree).update(parts)
        return tree

    def search(self, qids: np.ndarray, queries: np.ndarray, best: list[list[tuple[int, int]]], k: int) -> None:
        """best: for each query a heap of (score, -id), the k-th at its top; it is brought up to date."""
        kind = np.float64 if exact_floats(queries, self.vectors) else object
        q, vectors = queries.astype(kind), self.vectors.astype(kind)
        bounds = np.maximum(q, 0) @ self.hi.astype(kind).T + np.minimum(q, 0) @ self.lo.astype(kind).T
        for i in range(len(q)):
            heap, own, mine = best[i], bounds[i], qids[i]
            todo = [(-own[0], 0)]
            while todo:
                bound, node = heapq.heappop(todo)
                if len(heap) == k and -bound < heap[0][0]:
                    break
                if self.left[node] >= 0:
                    for child in (self.left[node], self.right[node]):
                        heapq.heappush(todo, (-own[child], child))
                    continue
                a, b = self.span[node]
                scores, ids = vectors[a:b] @ q[i], self.ids[a:b]
                fit = ids != mine
                if len(heap) == k:
                    fit &= scores >= heap[0][0]
                at = np.flatnonzero(fit)
                if len(at) > k:
                    at = np.array(sorted(at, key=lambda j: (-scores[j], ids[j]))[:k]) if kind is object else at[np.lexsort((ids[at], -scores[at]))][:k]
                for j in at:
                    entry = (int(scores[j]), -int(ids[j]))
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)


def narrow(a: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if np.abs(a).max(initial=0) <= np.iinfo(kind).max:
            return a.astype(kind)
    return a


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, v array<long>, dim): floor(scale * x) of each component; bad vectors go."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(fine).select("vec_id", F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"), F.size(v).alias("dim"))


def packed(rows: DataFrame, keys: list[str], leaf: int | None) -> DataFrame:
    """Each group of (vec_id, v) as one binary: a tree, or where leaf is None a block of queries."""

    def build(key, table):
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        width = key[-1].as_py()
        vectors = narrow(table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), width)[order])
        data = pickle.dumps(vars(Tree(ids[order], vectors, leaf)) if leaf else (ids[order], vectors))
        return pa.table({**{k: pa.array([x.as_py()], pa.int64()) for k, x in zip(keys, key)}, "data": pa.array([data], pa.binary())})

    return rows.groupBy(*keys).applyInArrow(build, ", ".join(f"{k} long" for k in keys) + ", data binary")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 8192, group_shards: int = 4, block_rows: int = 4096, leaf: int = 128) -> DataFrame:
    """Quantised candidates and queries (vec_id, v, dim) -> query_id, rank, vec_id, score."""
    n, nq = candidates.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-nq // block_rows))
    groups = -(-shards // group_shards)
    long_dim = F.col("dim").cast("long").alias("dim")
    sharded = candidates.where("dim > 0").select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).alias("shard"), long_dim)
    asked = queries.where("dim > 0").groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.size("v").cast("long").alias("dim"))
    trees = packed(sharded, ["shard", "dim"], leaf).withColumns({"g": F.expr(f"shard div {group_shards}"), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
    asks = packed(asked, ["block", "dim"], None).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def search(left, right):
        rows: list[tuple] = []
        for block in right.column("data").to_pylist():
            ids, vectors = pickle.loads(block)
            best: list[list] = [[] for _ in ids]
            for _, tree in sorted(zip(left.column("shard").to_pylist(), left.column("data").to_pylist())):
                Tree.of(pickle.loads(tree)).search(ids, vectors, best, k)
            rows += [(int(q), -v, s) for q, heap in zip(ids, best) for s, v in heap]
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 3)], names=["query_id", "vec_id", "score"])

    keys = ["g", "block", "dim"]
    found = trees.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
