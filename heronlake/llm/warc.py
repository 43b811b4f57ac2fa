"""WARC archives as seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each holding whole WARC/1.1 records, then a
skippable frame with a seek table (compressed and plain size of every frame, in the public seekable
format), then a skippable frame with an Arrow table that maps each record identifier to its frame and
its offset in the plain frame. Any Zstandard reader sees the plain WARC file; a reader of one record
decompresses one frame.

Of records with equal payloads of at least `min_dedup` bytes the one with the smallest id is a response
and the others are revisits that refer to it; smaller payloads are always responses. Null payloads are
empty. Rows with equal ids: all are written; where their payloads are equal too, each is a response.
Rows with a null id are written as responses and never referred to.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import open_fs, put_file, scratch, stored

SKIPPABLE, SEEKABLE, INDEX = 0x184D2A5E, 0x8F92EAB1, 0x184D2A5D


def skippable(magic: int, data: bytes) -> bytes:
    return np.array([magic, len(data)], "<u4").tobytes() + data


class BundleWriter:
    def __init__(self, frame_bytes: int, level: int):
        import zstandard

        self.zstd, self.frame_bytes = zstandard.ZstdCompressor(level=level, write_checksum=True), frame_bytes
        self.out, self.frame, self.sizes, self.index = io.BytesIO(), io.BytesIO(), [], []

    def add(self, record_id: str, head: list[str], payload: bytes) -> None:
        self.index.append((record_id, len(self.sizes), self.frame.tell()))
        self.frame.write(("\r\n".join(["WARC/1.1", *head, f"WARC-Record-ID: {record_id}", f"Content-Length: {len(payload)}"]) + "\r\n\r\n").encode())
        self.frame.write(payload)
        self.frame.write(b"\r\n\r\n")
        if self.frame.tell() >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if plain := self.frame.getvalue():
            packed = self.zstd.compress(plain)
            self.out.write(packed)
            self.sizes.append((len(packed), len(plain)))
            self.frame = io.BytesIO()

    def size(self) -> int:
        return self.out.tell() + self.frame.tell()

    def close(self) -> bytes:
        self.flush()
        index = io.BytesIO()
        ids, frames, offsets = zip(*self.index)
        table = pa.table({"record_id": pa.array(ids), "frame": pa.array(frames, pa.int64()), "offset": pa.array(offsets, pa.int64())})
        with pa.ipc.new_stream(index, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        self.out.write(skippable(INDEX, index.getvalue() + np.array([len(index.getvalue())], "<u4").tobytes()))
        seek = np.array(self.sizes, "<u4").reshape(-1, 2).tobytes() + np.array([len(self.sizes)], "<u4").tobytes() + b"\0" + np.array([SEEKABLE], "<u4").tobytes()
        self.out.write(skippable(SKIPPABLE, seek))
        return self.out.getvalue()


class Bundle:
    """A bundle opened for reading: the two tables at the end are read, frames on demand."""

    def __init__(self, uri: str):
        system, path = open_fs(uri)
        self.f = system.open_input_file(path)
        size = self.f.size()
        tail = self.f.read_at(9, size - 9)
        n, magic = int(np.frombuffer(tail[:4], "<u4")[0]), int(np.frombuffer(tail[5:], "<u4")[0])
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        at = size - 9 - 8 * n
        self.sizes = np.frombuffer(self.f.read_at(8 * n, at), "<u4").reshape(-1, 2).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[:, 0])])
        end = at - 8
        length = int(np.frombuffer(self.f.read_at(4, end - 4), "<u4")[0])
        self.index = pa.ipc.open_stream(self.f.read_at(length, end - 4 - length)).read_all()

    def frame(self, i: int) -> bytes:
        import zstandard

        packed, plain = self.sizes[i]
        return zstandard.ZstdDecompressor().decompress(self.f.read_at(int(packed), int(self.starts[i])), max_output_size=int(plain))

    def record(self, record_id: str) -> tuple[dict[str, str], bytes]:
        """The first record of that identifier, by its frame and offset."""
        i = self.index.column("record_id").index(record_id).as_py()
        if i < 0:
            raise KeyError(record_id)
        row = self.index.slice(i, 1).to_pylist()[0]
        return parse(self.frame(row["frame"]), row["offset"])[:2]


def parse(plain: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and payload of the record at an offset, and the offset of the next."""
    end = plain.index(b"\r\n\r\n", at)
    lines = plain[at:end].decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    stop = end + 4 + int(head["Content-Length"])
    return head, plain[end + 4 : stop], stop + 4


def dedup_plan(rows: DataFrame, min_dedup: int = 100) -> DataFrame:
    """(id, url, payload) -> those with payload_bytes, payload_digest, record_type, refers_to.

    The smallest id of a digest is found by a grouped minimum over ids and digests alone, which combines before the
    shuffle. Payloads are dealt once, by id and digest, to meet the revisits; so equal payloads spread over tasks.
    """
    rows = rows.withColumn("payload", F.coalesce("payload", F.lit("").cast("binary")))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    large = rows.where((F.col("payload_bytes") >= min_dedup) & F.col("id").isNotNull()).select("id", F.col("payload_digest").alias("_d"))
    first = stored(large.groupBy("_d").agg(F.min("id").alias("_first"), F.max("id").alias("_last")).where("_first < _last").drop("_last"), "warc-first")
    again = stored(large.distinct().join(first.hint("merge"), "_d").where("id <> _first").withColumnRenamed("id", "_id"), "warc-revisits")
    joined = rows.join(again.hint("merge"), (F.col("id") == F.col("_id")) & (F.col("payload_digest") == F.col("_d")), "left")
    return joined.withColumns({"record_type": F.when(F.col("_first").isNotNull(), "revisit").otherwise("response"), "refers_to": F.col("_first")}).drop("_id", "_d", "_first")


def write_bundles(plan: DataFrame, out_dir: str, frame_bytes: int = 1 << 20, bundle_bytes: int = 1 << 25, level: int = 3, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the archives; returns a row per bundle: path, records, bytes.

    A payload goes with a response alone. Bundles are closed at bundle_bytes, so a task holds one at most; each
    task of the plan writes its own.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, out, made = TaskContext.get().partitionId(), 0, None, []

        def close():
            nonlocal seq, out
            path = f"{out_dir}/part-{part:06d}-{seq:05d}.warc.zst"
            data = out.close()
            put_file(path, data)
            made.append((path, len(out.index), len(data)))
            seq, out = seq + 1, None

        for batch in batches:
            for r in batch.to_pylist():
                out = out or BundleWriter(frame_bytes, level)
                record_id = f"<urn:record:{r['id']}>"
                head = [f"WARC-Type: {r['record_type']}", f"WARC-Date: {date}", "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha256:{r['payload_digest']}", f"X-Payload-Length: {r['payload_bytes']}"]
                if r["url"] is not None:
                    head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r["url"]))
                if r["refers_to"] is not None:
                    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:record:{r['refers_to']}>"]
                out.add(record_id, head, r["payload"] if r["record_type"] == "response" else b"")
                if out.size() >= bundle_bytes:
                    close()
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made) if made else [[]] * 3, (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    cols = plan.select("id", "url", F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", "record_type", "refers_to")
    return stored(cols.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def read_bundles(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records read back: page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact, payload.

    Of a response, length and digest are taken from its payload; of a revisit, from its headers, as the
    payload is stored with the response it refers to. intact: a response's payload fits its headers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = re.compile(r"-?\d+")
        for batch in batches:
            for path in batch.column("path").to_pylist():
                bundle = Bundle(path)
                with bundle.f:
                    for i in range(len(bundle.sizes)):
                        plain, at, rows = bundle.frame(i), 0, []
                        while at < len(plain):
                            head, payload, at = parse(plain, at)
                            said, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                            own = number.search(head["WARC-Record-ID"])
                            to = number.search(head.get("WARC-Refers-To", ""))
                            response = head["WARC-Type"] == "response"
                            got, n = (hashlib.sha256(payload).hexdigest(), len(payload)) if response else (said, size)
                            rows.append((int(own[0]) if own else None, head.get("WARC-Target-URI"), head["WARC-Type"], int(to[0]) if to else None, n, got, got == said and n == size, payload if with_payload else None))
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()))], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact", "payload"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n).mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean, payload binary")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write (page_id, url, html) to archives and read them back."""
    rows = pages.select(F.col("page_id").alias("id"), "url", F.encode("html", "UTF-8").alias("payload"))
    out = scratch(pages.sparkSession, "warc")
    back = read_bundles(write_bundles(dedup_plan(rows), out), with_payload=False)
    return back.drop("payload")
