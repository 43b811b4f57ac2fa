"""Token-id files by bit-plane shuffling.

A file holds fixed-size blocks of ids. Each block is transposed into its four byte planes (or 32 bit
planes), each plane is compressed with zstandard on its own, and a chunk index at the file's end
says where every plane lies, so that a reader can fetch any block alone:

    8 bytes magic | planes ... | Arrow stream: documents | Arrow stream: blocks | footer (4 x uint64) | magic

Ids stand in ascending (doc_id, text) order over all files; null doc_ids come first. A null or empty
text gives the end id alone. Rows with equal doc_id keep one entry each.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.llm.common import open_fs, put_file, scratch, stored
from heronlake.llm.tokens import encode

MAGIC = b"HLPLANE1"


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """A block's planes, most significant last. unit: byte or bit."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return [np.ascontiguousarray(rows[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    if unit == "byte":
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


def arrow_bytes(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue()


class ShardWriter:
    """Gathers one file: whole documents, cut into blocks whose planes are compressed as soon as they are full."""

    def __init__(self, unit: str, block_ids: int, level: int):
        import zstandard

        self.unit, self.block_ids, self.zstd = unit, block_ids, zstandard.ZstdCompressor(level=level)
        self.out, self.rest, self.n_rest, self.n_ids = io.BytesIO(), [], 0, 0
        self.docs: list[tuple] = []
        self.blocks: list[tuple] = []
        self.out.write(MAGIC)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.rest.append(ids)
        self.n_rest += len(ids)
        self.n_ids += len(ids)
        if self.n_rest >= self.block_ids:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, "<u4")
        stop = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for i in range(0, stop, self.block_ids):
            block = ids[i : min(i + self.block_ids, stop)]
            at, sizes = self.out.tell(), []
            for plane in to_planes(block, self.unit):
                packed = self.zstd.compress(plane)
                sizes.append(len(packed))
                self.out.write(packed)
            self.blocks.append((at, len(block), sizes))
        self.rest, self.n_rest = [ids[stop:]], len(ids) - stop

    def close(self) -> bytes:
        self.flush(True)
        docs = arrow_bytes(pa.table({"doc_id": pa.array([d for d, _ in self.docs], pa.int64()), "n_tokens": pa.array([n for _, n in self.docs], pa.int64())}))
        blocks = arrow_bytes(pa.table({"at": pa.array([b[0] for b in self.blocks], pa.int64()), "n": pa.array([b[1] for b in self.blocks], pa.int64()), "sizes": pa.array([b[2] for b in self.blocks], pa.list_(pa.int64()))}))
        docs_at = self.out.tell()
        self.out.write(docs + blocks)
        footer = np.array([docs_at, docs_at + len(docs), docs_at + len(docs) + len(blocks), 1 if self.unit == "bit" else 0], "<u8")
        self.out.write(footer.tobytes() + MAGIC)
        return self.out.getvalue()


def open_shard(uri: str):
    """The file, its document table, its chunk index and its unit; only the footer and the two tables are read."""
    system, path = open_fs(uri)
    f = system.open_input_file(path)
    size = f.size()
    tail = f.read_at(40, size - 40)
    if tail[32:] != MAGIC:
        raise ValueError(f"{uri} is no plane file")
    docs_at, blocks_at, end, bit = (int(x) for x in np.frombuffer(tail[:32], "<u8"))
    docs = pa.ipc.open_stream(f.read_at(blocks_at - docs_at, docs_at)).read_all()
    blocks = pa.ipc.open_stream(f.read_at(end - blocks_at, blocks_at)).read_all()
    return f, docs, blocks.to_pylist(), "bit" if bit else "byte"


def read_block(f, block: dict, unit: str) -> np.ndarray:
    import zstandard

    data, planes, at = f.read_at(sum(block["sizes"]), block["at"]), [], 0
    for size in block["sizes"]:
        planes.append(zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=4 * block["n"] + 64))
        at += size
    return from_planes(planes, block["n"], unit)


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int, unit: str = "byte", block_ids: int = 1 << 16, shard_ids: int = 1 << 22, level: int = 1, partitions: int | None = None) -> DataFrame:
    """Encode (doc_id, text) and write the files below out_dir. Returns the manifest, a row per file.

    Documents are dealt by ranges of (doc_id, hash of the text), so file order is doc_id order. A file is
    closed at shard_ids ids: a task holds one compressed file at most. Files appear by renaming, under
    names that depend on the data alone, so a repeated task replaces its own files with the same bytes.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, shard, made = TaskContext.get().partitionId(), 0, None, []

        def close():
            nonlocal seq, shard
            path = f"{out_dir}/part-{part:06d}-{seq:05d}.planes"
            data = shard.close()
            put_file(path, data)
            made.append((part, seq, path, len(shard.docs), shard.n_ids, len(data)))
            seq, shard = seq + 1, None

        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                some = batch.slice(i, 2000)
                ids, starts = encode(some.column("text"), tokenizer)
                for k, doc_id in enumerate(some.column("doc_id").to_pylist()):
                    shard = shard or ShardWriter(unit, block_ids, level)
                    shard.add(doc_id, np.append(ids[starts[k] : starts[k + 1]], np.uint32(end_id)))
                    if shard.n_ids >= shard_ids:
                        close()
        if shard:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made) if made else [[]] * 6, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["part", "seq", "path", "n_docs", "n_ids", "n_bytes"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    cols = (F.col("doc_id"), F.col("_h"))
    dealt = keyed.repartitionByRange(partitions, *cols) if partitions else keyed.repartitionByRange(*cols)
    files = dealt.sortWithinPartitions("doc_id", "_h").select("doc_id", "text").mapInArrow(write, "part long, seq long, path string, n_docs long, n_ids long, n_bytes long")
    return stored(files, "planes-manifest")


def with_first_id(manifest: DataFrame) -> DataFrame:
    """The manifest with `first`, the ids in all files before. Sums run per writing task, then over tasks."""
    tasks = manifest.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = tasks.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return manifest.withColumn("_own", own).join(before, "part").withColumn("first", F.col("_before") + F.col("_own")).drop("_before", "_own")


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents read back from the files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                f, docs, blocks, unit = open_shard(path)
                with f:
                    held, at, b = np.zeros(0, "<u4"), 0, 0
                    lens = docs.column("n_tokens").to_numpy()
                    starts = first + np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
                    crcs, lists = [], []
                    for n in lens:
                        while len(held) - at < n:
                            held, at, b = np.concatenate([held[at:], read_block(f, blocks[b], unit)]), 0, b + 1
                        own = held[at : at + n]
                        crcs.append(zlib.crc32(own.tobytes()))
                        lists.append(own.astype(np.int64)) if with_ids else None
                        at += n
                    cols = [docs.column("doc_id").combine_chunks(), pa.array(starts, pa.int64()), pa.array(lens, pa.int64()), pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array(lists, pa.list_(pa.int64()))] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    n = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = with_first_id(manifest).select("path", "first").repartition(int(n))
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_files_digest(docs: DataFrame, tokenizer: str, end_id: int, unit: str = "byte") -> DataFrame:
    """Write and read back; per document where its ids lie, how many they are and their crc32."""
    out = scratch(docs.sparkSession, "planes")
    return read_token_files(write_token_files(docs, out, tokenizer, end_id, unit), with_ids=False)
