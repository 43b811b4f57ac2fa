"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Only sizes and keys move. Items are dealt at random to tasks of bounded size; each task packs its items
by best fit, largest first. Bins filled to the limit, or nearly, are final; underfull bins become items
of the next round, dealt to a `fan_in`-th of the tasks as far as these hold them, until one task has seen all
that is left or a round no longer merges anything. Documents are cut only where they exceed the capacity: the first piece takes the
remainder, so that all further pieces fill a sequence each.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import give_back, stored
from heronlake.llm.tokens import encode


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: largest first, each into the fullest bin that still takes it."""
    bins, offs = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, b, made = capacity, made, made + 1
        bins[i], offs[i] = b, capacity - room
        left = room - size
        if left:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins, offs


def pack(items: DataFrame, capacity: int, slack: int | None = None, task_items: int = 100_000, fan_in: int = 8) -> DataFrame:
    """(item, size) with 0 < size <= capacity -> (item, sequence_id, offset), gapless within a sequence.

    item: a unique long. slack: a bin with at most so much room is final at once, a 512th of the capacity if
    None. task_items: what a task packs at a time. Sizes must be positive; an empty table gives an empty result.
    """
    spark = items.sparkSession

    def one_round(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, held, count, seq = TaskContext.get().partitionId(), [], 0, 0

            def emit():
                t = pa.Table.from_batches(held)
                sizes = t.column("size").to_numpy()
                bins, offs = best_fit(sizes, capacity)
                used = np.bincount(bins, weights=sizes).astype(np.int64)
                ids = (np.int64(level) << 55) + (np.int64(part) << 35) + (np.int64(seq) << 26) + bins
                return pa.RecordBatch.from_arrays([t.column("item").combine_chunks(), pa.array(ids), pa.array(offs), pa.array(used[bins])], ["item", "bin", "offset", "used"])

            for batch in batches:
                for i in range(0, batch.num_rows, task_items):
                    some = batch.slice(i, task_items)
                    if count and count + some.num_rows > task_items:
                        yield emit()
                        held, count, seq = [], 0, seq + 1
                    held.append(some)
                    count += some.num_rows
            if count:
                yield emit()

        return run

    slack = capacity // 512 if slack is None else slack
    left, n, placed = items.select("item", "size"), items.count(), []
    tasks = max(1, -(-n * 4 // task_items))
    while n:
        if len(placed) > 254:
            raise RuntimeError("packing does not end")
        dealt = left.repartition(tasks, F.xxhash64("item", F.lit(len(placed)))).sortWithinPartitions("item")
        got = stored(dealt.mapInArrow(one_round(len(placed) + 1), "item long, bin long, offset long, used long"), "packing-round")
        placed.append(got)
        bins = got.groupBy("bin").agg(F.first("used").alias("size"), F.count("*").alias("items"))
        left = stored(bins.where(F.col("size") < capacity - slack).select(F.col("bin").alias("item"), "size"), "packing-left")
        merged, n = bins.agg(F.max("items")).first()[0] > 1, left.count()
        fewer = max(-(-tasks // fan_in), -(-n // task_items))
        if tasks == 1 or not merged and fewer >= tasks:
            break
        tasks = fewer
    if not placed:
        return items.select("item", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    out = placed[0].select("item", F.col("bin").alias("sequence_id"), "offset")
    for later in placed[1:]:
        up = later.select(F.col("item").alias("sequence_id"), "bin", F.col("offset").alias("_by"))
        out = out.join(up, "sequence_id", "left").select("item", F.coalesce("bin", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("_by", F.lit(0))).alias("offset"))
    return out


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32 and, if wanted, ids.

    Null texts count as empty and give the end id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                ids, starts = encode(batch.column("text"), tokenizer)
                rows: list[tuple] = []
                lists = []
                for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    own = np.append(ids[starts[k] : starts[k + 1]], np.uint32(end_id)).astype("<u4")
                    first = len(own) % capacity or capacity
                    at, piece = 0, 0
                    while at < len(own):
                        size = first if piece == 0 else capacity
                        part = own[at : at + size]
                        rows.append((doc_id, piece, at, size, zlib.crc32(part.tobytes())))
                        lists.append(part.astype(np.int64)) if with_ids else None
                        at, piece = at + size, piece + 1
                cols = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(lists, pa.list_(pa.int64()))] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            give_back()

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, slack: int | None = None, with_ids: bool = False) -> DataFrame:
    """All documents' pieces with the sequence each lies in and its offset there.

    Rows with equal doc_id are packed one by one. Extra columns of `docs` play no part.
    """
    spark = docs.sparkSession
    cut = stored(token_pieces(docs, tokenizer, end_id, capacity, with_ids).withColumn("item", F.monotonically_increasing_id()), "packing-pieces")
    full = cut.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("item"), "offset": F.lit(0).cast("long")})
    part = cut.where(F.col("length") < capacity)
    placed = pack(part.select("item", F.col("length").alias("size")), capacity, slack)
    return part.join(placed, "item").select(*full.columns).unionByName(full).drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """The filled sequences themselves, from pieces packed with their ids: sequence_id, ids, doc_ids.

    A group is one sequence, so no group exceeds the capacity.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
