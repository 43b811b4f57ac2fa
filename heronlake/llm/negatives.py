"""Hard-negative mining by segment summary filtering.

A vector's components are cut into halves, quarters and so on. Of each segment of m components its summary is
stored: the mean, times the root of m, and the deviation, the root of the sum of squared differences from the mean.
The inner product of two segments lies within the product of their means, plus or minus the product of their
deviations, so sums over segments bound a score. All pairs of a tile are bounded by the whole vector's summary; those
that may still matter by the halves', the quarters' and so on; only what is left is scored exactly.

Rows are dealt to shards of bounded size that hold vectors and summaries, anchors to blocks; a task holds a block and
a group of shards, and what it has found so far narrows the search in the next shard. In the first search a pair
matters if its upper bound reaches the anchor's k-th positive so far. In the second it matters if for some positive
the bounds meet the span of scores that its negatives may have, from the k-th negative so far upwards.

Scores must fit in a long. Rows with a null id, label or vector, or a null or non-finite component take no part; only
vectors of equal length meet; rows with the anchor's own id are left out. Repeated rows are all candidates; of anchors
with equal ids the one with the smallest vector, then label, is kept. Ties go to smaller ids. An anchor without
positives, or a positive without negatives, has no rows; empty tables give an empty result. Extra columns play no part.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronlake.llm.common import stored
from heronlake.llm.kdtree import exact_floats, narrow

#: Anchors and rows of a tile that is bounded at a time.
TILE_ANCHORS, TILE_ROWS = 128, 2048
#: The least number of components of a segment.
LEAST_SEGMENT = 4


def borders(dim: int) -> list[list[int]]:
    """Where segments begin, by level, each level halving the one before; the last border is dim."""
    levels = [[0, dim]]
    while min(b - a for a, b in zip(levels[-1], levels[-1][1:])) >= 2 * LEAST_SEGMENT:
        last = levels[-1]
        levels.append(sorted({*last, *((a + b) // 2 for a, b in zip(last, last[1:]))}))
    return levels


def summaries(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By level, of every vector's segments: means times the root of the length, and deviations."""
    x = vectors.astype(np.float64)
    out = []
    for at in borders(x.shape[1]):
        size = np.diff(at)
        mean = np.add.reduceat(x, at[:-1], axis=1) / size
        apart = x - np.repeat(mean, size, axis=1)
        out.append((mean * np.sqrt(size), np.sqrt(np.add.reduceat(apart * apart, at[:-1], axis=1))))
    return out


class Rows:
    """Ids, labels, vectors and summaries of a shard or a block."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, narrow(vectors)
        self.levels = summaries(vectors)
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))

    @classmethod
    def of(cls, data: bytes) -> Rows:
        rows = cls.__new__(cls)
        vars(rows).update(pickle.loads(data))
        return rows


class Best:
    """The first `keep` candidates of each slot, higher scores first, then smaller ids."""

    def __init__(self, slots: int, keep: int):
        self.keep, self.slot, self.score, self.id = keep, *(np.zeros(0, np.int64) for _ in range(3))
        #: Of each slot the score that a further candidate must reach.
        self.least = np.full(slots, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        near = score >= self.least[slot]
        slot, score, ids = np.append(self.slot, slot[near]), np.append(self.score, score[near]), np.append(self.id, ids[near])
        order = np.lexsort((ids, ~score, slot))
        slot = slot[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        order, slot = order[rank < self.keep], slot[rank < self.keep]
        self.slot, self.score, self.id = slot, score[order], ids[order]
        full = self.keep - 1 == rank[rank < self.keep]
        self.least[slot[full]] = self.score[full]


def surviving(anchors: Rows, rows: Rows, pick: slice, among: slice, meet: np.ndarray, matters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a tile, the pairs (anchor, row) that meet and still matter by all levels of summaries, and their exact scores.

    matters(anchor, low, high): whether pairs with such bounds may matter; anchor is an array of indices. While a tenth
    of the tile or more is left, a level is computed for the whole tile at once, else for the pairs that are left.
    """
    # sums of floats are off by less than this part of the vectors' lengths
    slack = 1e-12 * np.outer(anchors.norms[pick], rows.norms[among])
    every = np.arange(pick.start, pick.stop)[:, None]
    a = r = None
    many = True
    for (ma, da), (mr, dr) in zip(anchors.levels, rows.levels):
        if many:
            middle, reach = ma[pick] @ mr[among].T, da[pick] @ dr[among].T + slack
            meet = meet & matters(every, middle - reach, middle + reach)
            many = np.count_nonzero(meet) * 10 >= meet.size
            if not many:
                a, r = np.nonzero(meet)
        else:
            i, j = a + pick.start, r + among.start
            middle, reach = np.einsum("ij,ij->i", ma[i], mr[j]), np.einsum("ij,ij->i", da[i], dr[j]) + slack[a, r]
            fine = matters(i, middle - reach, middle + reach)
            a, r = a[fine], r[fine]
    exact = exact_floats(anchors.vectors, rows.vectors)
    if many and exact:
        score = anchors.vectors[pick].astype(np.float64) @ rows.vectors[among].astype(np.float64).T
        a, r = np.nonzero(meet & matters(every, score, score))
        return a + pick.start, r + among.start, score[a, r].astype(np.int64)
    if many:
        a, r = np.nonzero(meet)
    a, r = a + pick.start, r + among.start
    kind = np.float64 if exact else np.int64
    return a, r, np.einsum("ij,ij->i", anchors.vectors[a].astype(kind), rows.vectors[r].astype(kind)).astype(np.int64)


def tiles(anchors: Rows, rows: Rows):
    for i in range(0, len(anchors.ids), TILE_ANCHORS):
        pick = slice(i, min(len(anchors.ids), i + TILE_ANCHORS))
        for j in range(0, len(rows.ids), TILE_ROWS):
            yield pick, slice(j, min(len(rows.ids), j + TILE_ROWS))


def positives_in(anchors: Rows, shards: list[bytes], keep: int) -> Best:
    """Each anchor's first rows of its own label."""
    best = Best(len(anchors.ids), keep)
    for data in shards:
        rows = Rows.of(data)
        for pick, among in tiles(anchors, rows):
            meet = (anchors.labels[pick, None] == rows.labels[among]) & (anchors.ids[pick, None] != rows.ids[among])
            a, r, score = surviving(anchors, rows, pick, among, meet, lambda i, low, high: ~(high < best.least[i]))
            best.add(a, score, rows.ids[r])
    return best


def negatives_in(anchors: Rows, positives: list[list[int]], shards: list[bytes], keep: int, num: int, den: int) -> Best:
    """Of each anchor's positives (scores) the first rows of other labels within num/den of the score and the score; slot: anchor * most + place of the positive."""
    most = max(map(len, positives), default=0)
    best = Best(len(anchors.ids) * most, keep)
    wanted, there = np.zeros((len(positives), most), np.int64), np.zeros((len(positives), most), bool)
    for i, scores in enumerate(positives):
        wanted[i, : len(scores)], there[i, : len(scores)] = scores, True
    top = np.where(there, wanted, -np.inf)
    # an absent positive has an empty span, as a negative one has
    floor = np.where(there, wanted * (num / den) - np.abs(wanted) * 1e-12, np.inf)

    def matters(i: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros(np.broadcast_shapes(i.shape, low.shape), bool)
        least = best.least.reshape(-1, most)
        for k in range(most):
            out |= ~((high < floor[i, k]) | (high < least[i, k]) | (low > top[i, k]))
        return out

    for data in shards:
        rows = Rows.of(data)
        for pick, among in tiles(anchors, rows):
            meet = (anchors.labels[pick, None] != rows.labels[among]) & (anchors.ids[pick, None] != rows.ids[among])
            a, r, score = surviving(anchors, rows, pick, among, meet, matters)
            for k in range(most):
                held = there[a, k]
                i, got, mark = a[held], score[held], wanted[a[held], k]
                # 64 bits hold the products, or Python's numbers do
                if len(got) and max(int(np.abs(got).max()), int(np.abs(mark).max())) * den >= 2**62:
                    fit = np.array([num * int(q) <= den * int(x) and x <= q for q, x in zip(mark, got)], bool)
                else:
                    fit = (num * mark <= den * got) & (got <= mark)
                best.add(i[fit] * most + k, got[fit], rows.ids[r[held][fit]])
    return best


def prepared(vectors: DataFrame, label: Column, scale: float = 256.0) -> DataFrame:
    """(vec_id, embedding, label) -> (vec_id, v array<long>, label long, dim long): floor(scale * x) of each component; bad rows go."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.col("vec_id").isNotNull() & label.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.where(fine).select("vec_id", whole.alias("v"), label.cast("long").alias("label"), F.size(v).cast("long").alias("dim"))


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, num: int = 80, den: int = 100, shard_rows: int = 4096, group_shards: int = 2, block_rows: int = 4096) -> DataFrame:
    """(vec_id, v, label, dim) twice -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A positive's negatives score at least num/den of it and at most as much.
    """
    n, asked = rows.count(), anchors.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // block_rows))
    groups = -(-shards // group_shards)
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))

    def shard(key, table):
        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
        ids, labels, vectors = columns(table, key[-1].as_py())
        data = pickle.dumps(vars(Rows(ids[order], labels[order], vectors[order])))
        return pa.table({"shard": pa.array([key[0].as_py()]), "dim": pa.array([key[1].as_py()]), "data": pa.array([data], pa.binary())})

    # a row repeated many times goes to all shards
    place = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(shards))
    held = stored(rows.withColumn("shard", place).groupBy("shard", "dim").applyInArrow(shard, "shard long, dim long, data binary"), "negatives-shards")
    spread = held.withColumns({"g": F.expr(f"shard div {group_shards}"), "block": every(blocks)})

    one = anchors.groupBy("vec_id").agg(F.min(F.struct("v", "label", "dim")).alias("x")).select("vec_id", "x.*")
    one = stored(one.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "negatives-anchors")
    keys = ["g", "block", "dim"]

    def first(key, left, right):
        ids, labels, vectors = columns(right, key[2].as_py())
        best = positives_in(Rows(ids, labels, vectors), ordered(left), positives)
        return pa.table({"anchor_id": ids[best.slot], "id": best.id, "score": best.score})

    def ordered(left):
        return [data for _, data in sorted(zip(left.column("shard").to_pylist(), left.column("data").to_pylist()))]

    def search(asks: DataFrame, find, types: str) -> DataFrame:
        return spread.groupBy(*keys).cogroup(asks.withColumn("g", every(groups)).groupBy(*keys)).applyInArrow(find, types)

    found = search(one, first, "anchor_id long, id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    top = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    lists = top.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("p"))
    lists = lists.select(F.col("anchor_id").alias("vec_id"), F.col("p.id").alias("p_id"), F.col("p.score").alias("p_score"))
    with_positives = stored(one.join(lists, "vec_id"), "negatives-positives")

    def second(key, left, right):
        ids, labels, vectors = columns(right, key[2].as_py())
        scores, of = right.column("p_score").to_pylist(), right.column("p_id").to_pylist()
        best = negatives_in(Rows(ids, labels, vectors), scores, ordered(left), negatives, num // math.gcd(num, den), den // math.gcd(num, den))
        most = max(map(len, scores), default=1) or 1
        a, k = best.slot // most, best.slot % most
        pairs = list(zip(a.tolist(), k.tolist()))
        return pa.table({"anchor_id": ids[a], "place": k, "positive_id": pa.array([of[i][j] for i, j in pairs], pa.int64()), "positive_score": pa.array([scores[i][j] for i, j in pairs], pa.int64()), "negative_id": best.id, "negative_score": best.score})

    mined = search(with_positives, second, "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    mined = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def columns(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of a group; an empty side has none."""
    n = table.num_rows
    vectors = table.column("v").combine_chunks().flatten().to_numpy() if n else np.zeros(0, np.int64)
    return table.column("vec_id").to_numpy(), table.column("label").to_numpy(), vectors.reshape(n, dim)
