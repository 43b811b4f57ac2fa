"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word shingles, as 64-bit hashes. Under one order of all shingles
(rare before frequent) two sets with Jaccard similarity of at least t share one of the first
n - ceil(t*n) + 1 shingles of each, the prefix. Documents of equal size and equal prefix form a group;
within it, documents of equal sets form a class. Prefix shingles of groups are joined, group pairs are
filtered by size, and the pairs that remain are expanded to classes and verified on whole sets.

Candidate pairs are not written out for every pair of a large group of copies. Each shingle's groups are first
verified against one pivot of their size band, the one that has the fewest rarer shingles and so is likest to
the text that the others were copied from. What then remains are pairs of different components: rows outside
a shingle's largest component against all its rows, with further pivots before that while such pairs
outnumber the postings and pivots settle most of them. A pair is bounded before its row is made, by sizes, by the
places of the shingle it meets at and by parity sketches of what follows that shingle in the order. In the last turn
a pair needs to be met only at its first common shingle, before which the two sets have nothing in common: all that
precedes counts as differences, so pairs that share many shingles hardly come again under each. So every link
between documents of different components would have been found, and no row is dropped.

The order puts first a quarter of all shingles, by hash, whose documents are counted, as far as they are not
frequent; then the others; then the frequent ones, more frequent later. As a prefix is a fifth of a set,
it comes from the counted quarter but for sets that largely consist of frequent shingles. The order affects
cost and not results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import drop_stored, enter, perhaps_in, release, stored
from heronlake.llm.components import components
from heronlake.llm.wordhash import buffers, mixed

#: The bound of the table of frequent shingles that is broadcast.
MOST_FREQUENT = 1 << 22
WORD_BITS = np.uint64(0x9E3779B97F4A7C15)
#: Words of a parity sketch: 64 bits each.
SKETCH = tuple(f"s{i}" for i in range(8))
SKETCH_BITS = 64 * len(SKETCH)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` codes: a polynomial, mixed at the end."""
    n = len(codes) - width + 1
    acc = np.full(n, np.uint64(width), np.uint64)
    for i in range(width):
        acc *= WORD_BITS
        acc += codes[i : n + i]
    return mixed(acc)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; words are lower-cased (A-Z)."""
    out = []
    for _, w in buffers(texts, lower=True):
        all_ = window_hashes(w.hashes, size) if len(w.hashes) >= size else w.hashes[:0]
        for a, b in zip(w.at.tolist(), w.at[1:].tolist()):
            n = b - a
            own = np.sort(all_[a : b - size + 1] if n >= size else window_hashes(w.hashes[a:b], n) if n else all_[:0])
            out.append(own[np.append(True, own[1:] != own[:-1])] if n else own)
    return out


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def sampled(hashes: np.ndarray) -> np.ndarray:
    """Whether each shingle is among the quarter, by hash, whose documents are counted."""
    return hashes >> np.uint64(62) == 0


def frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the sampled shingles met in most documents, at most MOST_FREQUENT, and the level of each.

    Levels are quarter octaves of the number of documents, so those of a level come or stay together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                flat = np.concatenate([*shingle_sets(batch.column("text").slice(i, 1000).to_pylist(), size), np.zeros(0, np.uint64)])
                yield pa.RecordBatch.from_arrays([pa.array(flat[sampled(flat)].view(np.int64))], ["h"])

    met = docs.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    counted = stored(met.select("h", F.floor(F.log2("n") * 4).cast("int").alias("level")), "jaccard-frequent")
    release(docs.sparkSession)
    least, total = 1 << 30, 0
    for level, n in sorted(map(tuple, counted.groupBy("level").count().collect()), reverse=True):
        if (total := total + n) > MOST_FREQUENT:
            break
        least = level
    table = counted.where(F.col("level") >= least).toArrow().sort_by("h")
    h = table.column("h").to_numpy().view(np.uint64)
    return h, table.column("level").to_numpy().astype(np.uint8)


def in_order(sets: list[np.ndarray], late: tuple[np.ndarray, np.ndarray]) -> Iterator[np.ndarray]:
    """The members of each set in the order of all shingles."""
    known, levels = late
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    rank = np.where(sampled(flat), 0, 1).astype(np.uint8)
    if len(known):
        few = np.flatnonzero(rank == 0)
        at = np.minimum(np.searchsorted(known, flat[few]), len(known) - 1)
        met = known[at] == flat[few]
        rank[few[met]] = 2 + levels[at[met]]
    at = 0
    for s in sets:
        yield s[np.argsort(rank[at : at + len(s)], kind="stable")]
        at += len(s)


def shares(hashes: np.ndarray) -> np.ndarray:
    """The bit of a sketch that each shingle turns."""
    return ((hashes >> np.uint64(40)) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SKETCH_BITS bits of each set, as words: the parity of its members in each share of the hashes.

    Two sets differ in at least as many members as their sketches do in bits.
    """
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    odd = np.bincount(of * SKETCH_BITS + shares(flat), minlength=len(sets) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, SKETCH_BITS), axis=1, bitorder="little").view(np.int64)


def sketches_before(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of lists that lie one after the other from `starts` on: for each member, the sketch of those before it in its list."""
    bit, n = shares(flat), len(flat)
    turned = np.zeros((n + 1, len(SKETCH)), np.uint64)
    turned[np.arange(1, n + 1), bit >> 6] = np.uint64(1) << (bit & 63).astype(np.uint64)
    np.bitwise_xor.accumulate(turned, axis=0, out=turned)
    sizes = np.diff(np.append(starts, n))
    return (turned[:n] ^ np.repeat(turned[starts], sizes, axis=0)).view(np.int64)


def prefix_postings(heads: DataFrame) -> DataFrame:
    """gid, pos, h and the sketch of the shingles before h, for each shingle of each prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200)
                sizes = np.array([len(x) for x in some.column("prefix")], np.int64)
                starts = np.cumsum(sizes) - sizes
                h = some.column("prefix").flatten().to_numpy(zero_copy_only=False)
                before = np.ascontiguousarray(sketches_before(h.view(np.uint64), starts).T)
                pos = np.arange(len(h)) - np.repeat(starts, sizes)
                gid = np.repeat(some.column("gid").to_numpy(zero_copy_only=False), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(gid), pa.array(pos.astype(np.int32)), pa.array(h), *map(pa.array, before)], ["gid", "pos", "h", *SKETCH])

    return heads.select("gid", "prefix").mapInArrow(run, f"gid long, pos int, h long, {', '.join(f'{c} long' for c in SKETCH)}")


def prefixes(docs: DataFrame, size: int, num: int, den: int, often) -> DataFrame:
    """id, n, set_hash, prefix_hash, sketch, prefix: the first shingles in the order of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        import xxhash

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                some = batch.slice(i, 1000)
                sets = shingle_sets(some.column("text").to_pylist(), size)
                ns, whole, first, lists = [], [], [], []
                for s, ordered in zip(sets, in_order(sets, often.value)):
                    prefix = ordered[: prefix_length(len(s), num, den)] if len(s) else s
                    ns.append(len(s))
                    whole.append(xxhash.xxh128_digest(s.tobytes()))
                    first.append(xxhash.xxh128_digest(prefix.tobytes()))
                    lists.append(prefix.view(np.int64))
                sketch = [pa.array(c) for c in np.ascontiguousarray(sketches(sets).T)]
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(ns, pa.int64()), pa.array(whole, pa.binary()), pa.array(first, pa.binary()), *sketch, pa.array(lists, pa.list_(pa.int64()))], ["id", "n", "set_hash", "prefix_hash", *SKETCH, "prefix"])

    return docs.select("id", "text").mapInArrow(run, f"id long, n long, set_hash binary, prefix_hash binary, {', '.join(f'{c} long' for c in SKETCH)}, prefix array<long>")


def wide_sketch(s: np.ndarray) -> bytes:
    """The parity sketch of a set in at least twice as many bits as it has members."""
    bits = 64 << max(0, (2 * len(s) - 1).bit_length() - 6)
    return np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def far_apart(x: bytes, y: bytes, most: int) -> bool:
    """Whether two sets, by their wide sketches, differ in more than `most` members. A longer sketch folds to the shorter's size."""
    size = min(len(x), len(y))
    a, b = (np.bitwise_xor.reduce(np.frombuffer(v, np.uint64).reshape(-1, size // 8), axis=0) for v in (x, y))
    return int(np.bitwise_count(a ^ b).sum()) > most


def verified(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of ids whose whole sets are similar enough. Sketches go first, so that few texts move."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                some = batch.slice(i, 1000)
                sets = shingle_sets(some.column("text").to_pylist(), size)
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(wide_sketch, sets)), pa.binary())], ["id", "n", "wide"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "wa", "wb")))
            keep = [not far_apart(x, y, (na + nb) * (den - num) // (den + num)) for na, nb, x, y in rows]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                ta, tb = some.column("ta").to_pylist(), some.column("tb").to_pylist()
                distinct = list({*ta, *tb})
                sets = dict(zip(distinct, shingle_sets(distinct, size)))
                keep = []
                for x, y in zip(ta, tb):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    keep.append(both > 0 and den * both >= num * (len(sets[x]) + len(sets[y]) - both))
                yield pa.RecordBatch.from_arrays([some.column("a"), some.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def some_of(docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        needed = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "jaccard-needed")
        return stored(perhaps_in(docs, needed, ["id"]).where("perhaps").drop("perhaps"), name)

    def beside(pairs: DataFrame, rows: DataFrame, **columns: str) -> DataFrame:
        """The pairs with columns of both documents, those of a under the names ending in a."""
        for side in "ba":
            pairs = pairs.join(rows.select(F.col("id").alias(side), *[F.col(c).alias(f"{short}{side}") for c, short in columns.items()]).hint("merge"), side)
        return pairs

    texts = some_of(docs, pairs, "jaccard-texts")
    wide = stored(texts.mapInArrow(sketched, "id long, n long, wide binary"), "jaccard-wide")
    close = stored(beside(pairs, wide, n="n", wide="w").mapInArrow(near, "a long, b long").distinct(), "jaccard-close")
    fewer = some_of(texts, close, "jaccard-texts")
    found = stored(beside(close, fewer, text="t").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "jaccard-links")
    for done in (texts, wide, fewer):
        drop_stored(done)
    return found


def postings(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The prefix table, its documents with the class each belongs to (id, rep), and the postings of
    classes under keys that several classes share: h, id, n, pos, band, and the sketch of the set from h on; and how
    many pairs meet under them.
    """
    spark = docs.sparkSession
    often = spark.sparkContext.broadcast(frequent(docs, size))
    pre = stored(prefixes(docs, size, num, den, often), "jaccard-prefixes")
    often.unpersist()
    real = pre.where("n > 0 and id is not null").select("id", "n", "set_hash", "prefix_hash", *SKETCH)

    # classes of equal sets, then groups of classes with equal prefix and size; named by their smallest document.
    # A repeated doc_id may stand for several sets; each gives its own postings under the same node.
    classes = stored(real.groupBy("set_hash").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "jaccard-classes")
    member = stored(real.join(classes.hint("merge"), "set_hash", "left").withColumn("rep", F.coalesce("rep", "id")), "jaccard-members")
    reps = member.where("id = rep").drop("rep").distinct()
    groups = stored(reps.groupBy("n", "prefix_hash").agg(F.min("id").alias("gid"), F.count("*").alias("c")).where("c > 1").drop("c"), "jaccard-groups")
    inner = stored(reps.join(groups.hint("merge"), ["n", "prefix_hash"]).select("gid", "id", "n", "set_hash", *SKETCH), "jaccard-inner")
    behind = stored(member.where("id <> rep").select("id", "set_hash").unionByName(inner.where("id <> gid").select("id", "set_hash")), "jaccard-behind")
    lists = perhaps_in(pre.where("n > 0 and id is not null").select("id", "n", "set_hash", "prefix", *SKETCH), behind, ["id", "set_hash"])
    unsure = lists.where("perhaps").join(behind.hint("merge"), ["id", "set_hash"], "left_anti")
    heads = lists.where("not perhaps").unionByName(unsure).select(F.col("id").alias("gid"), "n", "prefix", *SKETCH)
    heads = stored(heads, "jaccard-heads")

    shared = stored(heads.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "jaccard-shared")
    meetings = shared.agg(F.sum(F.col("c") * (F.col("c") - 1))).first()[0] or 0
    shared = shared.select("h")
    release(spark)
    posts = perhaps_in(prefix_postings(heads), shared, ["h"]).where("perhaps").drop("perhaps")
    before = [F.col(c).alias(f"before_{c}") for c in SKETCH]
    posts = stored(posts.join(shared.hint("merge"), "h", "left_semi").select("gid", "pos", "h", *before), "jaccard-shared-postings")
    drop_stored(shared)
    # groups expand to their classes, and the group itself is a key of its classes
    of_group = heads.select("gid", F.col("gid").alias("id"), "n", *SKETCH).unionByName(inner.where("id <> gid").select("gid", "id", "n", *SKETCH))
    after = [F.col(c).bitwiseXOR(F.col(f"before_{c}")).alias(c) for c in SKETCH]
    keys = posts.join(of_group.hint("merge"), "gid").select("h", "id", "n", "pos", *after)
    whole = inner.select(F.xxhash64("gid", "n", F.lit("group")).alias("h"), "id", "n", F.lit(0).alias("pos"), *SKETCH)
    banded = keys.unionByName(whole).withColumn("band", F.floor(F.log("n") / F.log(F.lit(den / num))).cast("int"))
    keys = stored(banded, "jaccard-keys")
    for done in (posts, heads):
        drop_stored(done)
    return pre, member.select("id", "rep"), keys, meetings


def similar_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, pivots: int = 7) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id: components of links with den*both >= num*union.

    Words are lower-cased (A-Z). A document of fewer than `size` words is one shingle; one without words has
    none and links with nothing. Rows with null doc_id come out with their size and no component. Rows that share
    a doc_id are one node: their sets link it wherever any of them does. pivots: turns at most, of which
    the last compares what is left without pivots.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    pre, member, keys, before = postings(rows, size, num, den)
    # a repeated doc_id that belongs to several classes links them
    several = member.groupBy("id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("id")
    links = stored(member.join(several.hint("merge"), "id", "left_semi").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), "jaccard-links")

    def candidates(left: DataFrame, right: DataFrame, first: bool) -> DataFrame:
        """Distinct pairs of documents of different components that may be similar, by their postings under one key.

        first: only where it may be their first key in common. Else a pair may come under other keys too, as it must where
        not all rows of a key are compared.
        """
        right = right.select("h", "band", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "pos", "comp", *SKETCH)])
        both = F.col("n") + F.col("n2")
        # up to the first shingle in common, in the order of all shingles, neither has any of the other's
        most = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
        # members that differ: of those that come before this key, at least the difference in number; of the others, by sketch
        apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}2"))) for c in SKETCH), F.lit(0))
        apart += F.col("pos") + F.col("pos2") if first else F.abs(F.col("pos") - F.col("pos2"))
        near = (F.col("comp") != F.col("comp2")) & (most * (den + num) >= both * num) & (apart * (den + num) <= both * (den - num))
        met = left.join(right.hint("merge"), ["h", "band"]).where(near)
        return stored(met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct(), "jaccard-pairs")

    def merged(links: DataFrame) -> DataFrame:
        return stored(components(links).select(F.col("node").alias("id"), "component"), "jaccard-components")

    def near_pivots(state: DataFrame, turn: int) -> DataFrame:
        # pivots of further turns are drawn by hash
        rank = F.col("pos") if turn == 0 else F.xxhash64("id", F.lit(turn))
        lead = state.groupBy("h", "band").agg(F.min(F.struct(rank.alias("r"), "id", "comp", "n", "pos", *SKETCH)).alias("p"))
        return candidates(state, lead.select("h", F.explode(F.array("band", F.col("band") + 1)).alias("band"), "p.*"), first=False)

    def with_found(links: DataFrame, pairs: DataFrame) -> DataFrame:
        found = verified(pairs, rows, size, num, den)
        release(spark)
        return links.unionByName(found)

    links = with_found(links, near_pivots(keys.withColumn("comp", F.col("id")), 0))
    comp = merged(links)
    for turn in range(1, pivots + 1):
        linked = perhaps_in(keys, comp, ["id"])
        inside = linked.where("perhaps").join(comp.hint("merge"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        state = stored(inside.unionByName(linked.where("not perhaps").withColumn("comp", F.col("id"))).drop("perhaps"), "jaccard-state")
        # keys that more than one component shares, each with the component that has most rows there
        per = state.groupBy("h", "comp").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.sum("c").alias("n"), F.max("c").alias("most"))
        top = stored(per.where("n > most"), "jaccard-tops")
        left, there = top.agg(F.sum(F.col("n") * (F.col("n") - F.col("most"))), F.sum("n")).first()
        if left is None:
            break
        opened = perhaps_in(state, top, ["h"]).where("perhaps").drop("perhaps")
        # no further pivots where few pairs are left, or where the last ones settled few of them
        last = turn == pivots or left <= 4 * there or 2 * left > before
        before = left
        if last:
            outside = opened.join(top.select("h", "top").hint("merge"), "h").where("comp <> top").drop("top")
            pairs = candidates(outside.withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1))), opened, first=True)
        else:
            pairs = near_pivots(opened.join(top.select("h").hint("merge"), "h", "left_semi"), turn)
        links = with_found(links, pairs)
        drop_stored(state)
        comp = merged(links)
        if last:
            break

    by_rep = member.select("id", "rep").join(comp.select(F.col("id").alias("rep"), "component").hint("merge"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component")).groupBy("id").agg(F.min("component").alias("component"))
    out = pre.select("id", "n").join(by_rep.hint("merge"), "id", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
