"""Language-model scoring by a probabilistic suffix tree over words.

The tree grows level by level. A context of d words is a candidate where it was met `min_count` times in training,
its suffix of d-1 words is a state, and its prefix of d-1 words was a candidate. It is retained as a state when
the log-likelihood that its next-symbol distribution gains over its suffix's (count times divergence) exceeds
the cost of naming its distinct next symbols, log(V+1) each. So the divergence test alone ends the growth, at
the level that has no candidate. Distributions are smoothed towards the suffix's by as much mass as there are
distinct next symbols; the root is the additive unigram model. A token is scored by the longest suffix of its
history that is a state; histories begin anew with each document.

Counting runs over blocks of documents. A block's words are kept once, as a file in the shared folder; what
travels is each block's sorted distinct keys with its counts, cut by key ranges, delta-coded and compressed.
A key range is summed in one task and the sums go back to the blocks, in key order. As a block gives each
key once, frequent words weigh no more than others. Of the blocks that met a key in training the first owns it
and answers for it in the sums of its context. A key met `min_count` times comes back with its rank among those
of its range; as a context it then travels by that rank alone, with the gain and the number of the distinct next
symbols that its block owns, and what comes back is that number over all blocks, or 0 where the context is no
state. A level's candidates are kept until the next one's are found, and beyond that the tokens scored by its
states. All documents are counted and scored whole.

Training documents are those whose crc32(doc_id as text) mod 10 is not 0; a null doc_id is the empty text,
which is held out. Null texts are empty and hold the end alone. Repeated rows count as often as they occur.
Other columns are not read. Keys are 64-bit hashes.
"""

from __future__ import annotations

import io
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import drop_folder, drop_stored, open_fs, put_file, release, scratch, stored
from heronlake.llm.jaccard import WORD_BITS
from heronlake.llm.wordhash import mixed, text_hashes

END = np.uint64(0x5EED0FD0C5)
#: Rows that travel: keys with counts; or ranks of contexts with gains and, as `more`, numbers of distinct next symbols.
ROWS = "bucket long, block long, keys binary, vals binary, more binary"
ROW_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
ROW_NAMES = ["bucket", "block", "keys", "vals", "more"]
#: Rows that come back: sums; of keys also which of those met more than once are the block's own, and the ranks of frequent ones.
#: `distinct`: how many keys of the range were met in training, in one of its rows. `sent`: how many the block sent.
BACK = "bucket long, block long, vals binary, own binary, ranks binary, distinct long, sent long"
BACK_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
BACK_NAMES = ["bucket", "block", "vals", "own", "ranks", "distinct", "sent"]


def squeezed(a: np.ndarray) -> bytes:
    """An array's bytes, transposed into byte planes and compressed."""
    import zstandard

    width = a.dtype.itemsize
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, width).T) if len(a) else np.zeros(0, np.uint8)
    return np.array([len(a)], "<u8").tobytes() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueezed(data: bytes, kind) -> np.ndarray:
    import zstandard

    n, width = int(np.frombuffer(data[:8], "<u8")[0]), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=n * width), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).reshape(-1)


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    out = io.BytesIO()
    np.savez(out, **{f"{a.dtype.str}{k}": np.frombuffer(squeezed(a), np.uint8) for k, a in arrays.items()})
    put_file(uri, out.getvalue())


def load(uri: str) -> dict[str, np.ndarray]:
    system, path = open_fs(uri)
    with system.open_input_file(path) as f:
        held = np.load(io.BytesIO(f.read()))
        return {k[3:]: unsqueezed(held[k].tobytes(), k[:3]) for k in held.files}


def steps(a: np.ndarray, kind) -> np.ndarray:
    """An ascending array as its first value and the differences."""
    return np.concatenate([a[:1], np.diff(a)]).astype(kind)


def key_rows(block: int, keys: np.ndarray, bits: int, row) -> list[tuple]:
    """A row per key range that holds some of a block's sorted keys; row(x, y): what is sent of the keys from x to y."""
    cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return [(b, block, *row(int(x), int(y))) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]


def count_rows(block: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple]:
    return key_rows(block, keys, bits, lambda x, y: (squeezed(steps(keys[x:y], np.uint64)), squeezed(counts[x:y].astype(np.uint32)), b""))


def table(rows: list[tuple], types=ROW_TYPES, names=ROW_NAMES) -> pa.Table:
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)


def exchange(rows: DataFrame, total, name: str) -> DataFrame:
    """What total makes of a key range's rows, sent back to each block in the order of its keys."""

    def run(key, group):
        sent = sorted(zip(*(group.column(c).to_pylist() for c in ("block", "keys", "vals", "more"))))
        return table([(key[0].as_py(), *r) for r in total(*zip(*sent))], BACK_TYPES, BACK_NAMES)

    return stored(rows.groupBy("bucket").applyInArrow(run, BACK), name)


def counted(min_count: int):
    """Each key's count over all blocks, its owner, and its rank among those met min_count times."""

    def total(blocks, keys, vals, more):
        lists = [np.cumsum(unsqueezed(k, np.uint64), dtype=np.uint64) for k in keys]
        at = np.cumsum([0, *map(len, lists)])
        of, place = np.unique(np.concatenate(lists), return_inverse=True)
        own = np.concatenate([unsqueezed(v, np.uint32) for v in vals])
        n = np.bincount(place, own, len(of)).astype(np.uint64)
        met = np.flatnonzero(own)[::-1]
        first = np.full(len(of), -1)
        first[place[met]] = met
        often = n >= min_count
        rank = np.cumsum(often) - 1
        for i, (block, a, b) in enumerate(zip(blocks, at, at[1:])):
            here = place[a:b]
            mine = (first[here] == np.arange(a, b))[n[here] > 1]
            yield block, squeezed(n[here]), squeezed(np.packbits(mine)), squeezed(steps(rank[here[often[here]]], np.uint32)), 0 if i else int((n > 0).sum()), int(b - a)

    return total


def judged(cost: float):
    """Each context's number of distinct next symbols over all blocks, or 0 where its gain does not exceed their cost."""

    def total(blocks, keys, vals, more):
        lists = [np.cumsum(unsqueezed(k, np.uint32), dtype=np.int64) for k in keys]
        place = np.concatenate(lists)
        gain = np.bincount(place, np.concatenate([unsqueezed(v, np.float32) for v in vals]))
        kinds = np.bincount(place, np.concatenate([unsqueezed(m, np.uint32) for m in more])).astype(np.int64)
        kinds[gain <= kinds * cost] = 0
        for block, ranks in zip(blocks, lists):
            yield block, squeezed(kinds[ranks]), b"", b"", 0, len(ranks)

    return total


def returned(group: pa.Table) -> list[tuple]:
    """The rows that came back to a block, in key order: vals, own, ranks."""
    rows = sorted(zip(*(group.column(c).to_pylist() for c in ("bucket", "vals", "own", "ranks"))))
    return [r[1:] for r in rows if r[0] >= 0]


def joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def returned_counts(group: pa.Table, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's keys, with the block's own counts: counts over all blocks, whether the block owns them, ranks of the frequent ones."""
    rows = returned(group)
    parts = [unsqueezed(v, np.int64) for v, _, _ in rows]
    n = joined(parts, np.int64)
    own = (n == 1) & (local > 0)
    own[n > 1] = joined([np.unpackbits(unsqueezed(o, np.uint8), count=int((p > 1).sum())) for p, (_, o, _) in zip(parts, rows)], np.uint8) > 0
    return n, own, joined([np.cumsum(unsqueezed(r, np.uint32), dtype=np.uint32) for _, _, r in rows], np.uint32)


def shifted(a: np.ndarray, first: np.ndarray, fill) -> np.ndarray:
    """Each position's left neighbour in its document."""
    out = np.empty_like(a)
    out[1:] = a[:-1]
    out[first] = fill
    return out


class Block:
    """A block's words, with the levels of the tree that are known; its tokens once they are opened."""

    def __init__(self, folder: str, block: int):
        self.folder, self.block = folder, block
        self.uni = self.kept("vocabulary")["uni"]

    def open(self) -> Block:
        vars(self).update(self.kept("tokens"))
        self.starts = np.cumsum(self.lens) - self.lens
        self.train = np.repeat(self.train_doc, self.lens).astype(bool)
        return self

    def keep(self, name: str, **arrays: np.ndarray) -> None:
        save(f"{self.folder}/{name}/{self.block}", arrays)

    def kept(self, name: str) -> dict[str, np.ndarray]:
        return load(f"{self.folder}/{name}/{self.block}")

    def level(self, level: int, min_count: int) -> Level:
        """The tokens whose contexts are candidates at a level."""
        if level > 1:
            found = self.kept(f"level{level}")
            return Level(level, np.cumsum(found.pop("at")), **found)
        self.open()
        words = self.kept("words")
        first = np.zeros(len(self.index), bool)
        first[self.starts] = True
        at = np.flatnonzero(shifted((words["c"] >= min_count)[self.index], first, False))
        return following(1, at, self.index[at], self.train[at], self.index[at - 1], self.uni, words["c"], words["rank"], min_count)

    def grams(self, now: Level) -> np.ndarray:
        """Each token's key of context and token."""
        return mixed(mixed(now.keys + np.uint64(now.level - 1))[now.context] * WORD_BITS + self.uni[now.word])

    def best(self, level: int, floor: float) -> np.ndarray:
        """Each token's probability by the longest state of its history, up to a level. The tokens are open."""
        p = ((self.kept("words")["c"] + 0.1) / floor)[self.index]
        for d in range(1, level + 1):
            by = self.kept(f"states{d}")
            at = np.cumsum(by["at"])
            p[at] = (by["n"] + by["kinds"] * p[at]) / (by["met"] + by["kinds"])
        return p

    def suffix(self, now: Level, some: np.ndarray, floor: float) -> np.ndarray:
        """The probability of some of a level's tokens at their suffix, which is a state, as are all shorter ones."""
        p = (self.kept("words")["c"][now.word[some]] + 0.1) / floor
        for d in range(1, now.level):
            by = self.kept(f"states{d}")
            x = np.searchsorted(np.cumsum(by["at"]), now.at[some])
            p = (by["n"][x] + by["kinds"][x] * p) / (by["met"][x] + by["kinds"][x])
        return p


class Level:
    """Of the tokens `at` whose contexts are candidates at one level: which word, whether in training, and which context;
    of the contexts, in the order of their keys: key, how often met, and rank in the key range."""

    def __init__(self, level, at, word, train, context, keys, met, rank):
        self.level, self.at, self.word, self.train, self.context, self.keys, self.met, self.rank = level, at, word, train, context, keys, met, rank

    def arrays(self) -> dict[str, np.ndarray]:
        return {"at": steps(self.at, np.uint32)} | {k: getattr(self, k) for k in ("word", "train", "context", "keys", "met", "rank")}


def following(level: int, at: np.ndarray, word: np.ndarray, train: np.ndarray, place: np.ndarray, keys: np.ndarray, n: np.ndarray, ranks: np.ndarray, min_count: int) -> Level:
    """A level whose contexts are those of the keys that places name. ranks: of the keys met min_count times."""
    used = np.zeros(len(keys), bool)
    used[place] = True
    some = np.flatnonzero(used)
    context = (np.cumsum(used, dtype=np.uint32) - np.uint32(1))[place]
    return Level(level, at, word, train, context, keys[some], n[some], ranks[(np.cumsum(n >= min_count) - 1)[some]])


def tokenised(docs: DataFrame, folder: str, block_tokens: int) -> DataFrame:
    """Write the blocks; a row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, made = TaskContext.get().partitionId(), 0, []
        words, ids, n = [], [], 0

        def close():
            nonlocal seq, words, ids, n
            block = (part << 20) + seq
            uni, index = np.unique(np.concatenate(words), return_inverse=True)
            text = ["" if i is None else str(i) for i in ids]
            save(f"{folder}/tokens/{block}", {
                "ids": np.array([0 if i is None else i for i in ids], np.int64), "null": np.array([i is None for i in ids], np.uint8),
                "train_doc": np.array([zlib.crc32(t.encode()) % 10 != 0 for t in text], np.uint8),
                "lens": np.array(list(map(len, words)), np.int64), "index": index.astype(np.uint32),
            })
            save(f"{folder}/vocabulary/{block}", {"uni": uni})
            made.append(block)
            seq, words, ids, n = seq + 1, [], [], 0

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                some = batch.slice(i, 1000)
                for doc_id, h in zip(some.column("doc_id").to_pylist(), text_hashes(some.column("text").to_pylist())):
                    words.append(np.append(h, END))
                    ids.append(doc_id)
                    n += len(h) + 1
                    if n >= block_tokens:
                        close()
        if ids:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.int64())], ["block"])

    return stored(docs.select("doc_id", "text").mapInArrow(run, "block long"), "suffix-blocks")


def score(docs: DataFrame, min_count: int = 8, block_tokens: int = 4_500_000, rounds: int = 3, depth: int | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    rounds: in how many parts, by key ranges, most of a level's keys travel; what lies on disk at once depends on it, no result does.
    depth: a level at which to stop, if any.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "suffix")
    blocks = tokenised(docs, folder, block_tokens)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(3, math.ceil(math.log2(max(tasks, 1))))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block").to_pylist():
                b = Block(folder, block).open()
                yield from table(count_rows(block, b.uni, np.bincount(b.index, b.train, len(b.uni)), bits)).to_batches()

    sums = exchange(blocks.repartition(tasks).mapInArrow(words, ROWS), counted(min_count), "suffix-words")
    release(spark)
    known = sums.agg(F.sum("distinct")).first()[0] or 0

    def count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = []
            for block in batch.column("block").to_pylist():
                b = load(f"{folder}/tokens/{block}")
                of.append(int(b["lens"][b["train_doc"] > 0].sum()))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64())], ["n"])

    total = blocks.repartition(tasks).mapInArrow(count_all, "n long").agg(F.sum("n")).first()[0] or 0
    floor = total + 0.1 * (known + 1)
    empty = [F.lit(b"").alias(c) for c in ("vals", "own", "ranks")]
    nothing = blocks.select(F.lit(-1).cast("long").alias("bucket"), "block", *empty, *(F.lit(0).cast("long").alias(c) for c in ("distinct", "sent")))
    # by a number of partitions: a block takes time, however few rows it gets
    per_block = lambda *dfs: reduce(DataFrame.unionByName, dfs, nothing).repartition(tasks, "block").groupBy("block")

    def counting(level: int, part: int, parts: int):
        """Store what came back for the level before; send how often each token follows each candidate, for a part of the key ranges."""

        def run(key, group):
            b = Block(folder, key[0].as_py())
            if part:
                now = b.level(level, min_count)
            elif level == 1:
                c, _, rank = returned_counts(group, np.zeros(len(b.uni)))
                b.keep("words", c=c, rank=rank)
                now = b.level(1, min_count)
            else:
                last = b.level(level - 1, min_count)
                grams, place = np.unique(b.grams(last), return_inverse=True)
                n, ranks = (b.kept(f"counts{level - 1}")[k] for k in ("n", "rank"))
                kinds = joined([unsqueezed(v, np.int64) for v, _, _ in returned(group)], np.int64)
                state = (kinds > 0)[last.context]
                by = last.context[state]
                b.keep(f"states{level - 1}", at=steps(last.at[state], np.uint32), n=n[place[state]], met=last.met[by], kinds=kinds[by])
                # the next level's contexts: this one's, at the token before, where it is followed often enough
                before = np.flatnonzero(state[1:] & (np.diff(last.at) == 1) & (n >= min_count)[place[:-1]])
                now = following(level, *(x[before + 1] for x in (last.at, last.word, last.train)), place[before], grams, n, ranks, min_count)
                b.keep(f"level{level}", **now.arrays())
            grams, train = b.grams(now), now.train
            if parts > 1:
                ranges = grams >> np.uint64(64 - bits)
                here = (ranges >= (part << bits) // parts) & (ranges < (part + 1 << bits) // parts)
                grams, train = grams[here], train[here]
            keys, place = np.unique(grams, return_inverse=True)
            return table(count_rows(b.block, keys, np.bincount(place, train, len(keys)), bits))

        return run

    def judging(level: int):
        """Store the counts; send each candidate's gain and distinct next symbols, as sums over what the block owns."""

        def run(key, group):
            b = Block(folder, key[0].as_py())
            now = b.level(level, min_count)
            grams, place = np.unique(b.grams(now), return_inverse=True)
            n, own, ranks = returned_counts(group, np.bincount(place, now.train, len(grams)))
            b.keep(f"counts{level}", n=n, rank=ranks)
            one = np.zeros(len(grams), np.int64)
            one[place] = np.arange(len(place))
            one, n = one[own], n[own]
            by = now.context[one]
            gain = np.bincount(by, n * (np.log(n / now.met[by]) - np.log(b.suffix(now, one, floor))), len(now.keys)).astype(np.float32)
            kinds = np.bincount(by, minlength=len(now.keys)).astype(np.uint32)
            return table(key_rows(b.block, now.keys, bits, lambda x, y: (squeezed(steps(now.rank[x:y], np.uint32)), squeezed(gain[x:y]), squeezed(kinds[x:y]))))

        return run

    level, parts = 1, rounds
    while True:
        counts = []
        for part in range(parts):
            rows = per_block(*([] if part else [sums])).applyInArrow(counting(level, part, parts), ROWS)
            counts.append(exchange(rows, counted(min_count), f"suffix-counts{level}"))
            if not part:
                drop_stored(sums)
                for name in (f"level{level - 1}", f"counts{level - 1}"):
                    drop_folder(spark, f"{folder}/{name}")
            release(spark)
        sent = reduce(DataFrame.unionByName, counts).agg(F.sum("sent")).first()[0]
        if not sent or (depth is not None and level > depth):
            break
        sums = exchange(per_block(*counts).applyInArrow(judging(level), ROWS), judged(math.log(known + 1)), f"suffix-contexts{level}")
        for df in counts:
            drop_stored(df)
        release(spark)
        # the next level sends hardly more than this one
        level, parts = level + 1, min(rounds, math.ceil(rounds * sent / max(total, 1)))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block").to_pylist():
                b = Block(folder, block).open()
                c = b.kept("words")["c"][b.index]
                best = b.best(level - 1, floor)
                add = lambda x: np.add.reduceat(x, b.starts)
                ids = pa.array(b.ids, mask=b.null.astype(bool))
                columns = [ids, pa.array(b.train_doc == 0), pa.array(b.lens), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(b.lens), total)), pa.array(add(np.log10((c + 0.1) / floor))), pa.array(add(np.log10(best)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return blocks.repartition(tasks).mapInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
