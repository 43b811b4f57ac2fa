"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers spell the same bytes, so each gives an increasing array of byte ends. Where both arrays hold an end,
a group of tokens closes. The arrays are walked together. At the index shift of the moment, slices of doubling, then
halving length are compared: a stretch in which all ends are equal is one-to-one and is passed as a whole. At the
first difference the tokens of both sides are taken one by one, smaller end first, until the ends meet; that is an
irregular group, after which the shift has changed. In it, each place between neighbouring ends of either side is a
pair of tokens whose bytes overlap, and so is each place of a one-to-one stretch: these are the links.

How often two ids are linked in the whole corpus is summed from blocks of documents: a block of about BLOCK_BYTES of
text sends each of its distinct pairs once, and gets each pair's sum back. No task holds more than a block's pairs.

The first tokenizer is a `tokenizers` file with a byte-level alphabet and gets a space and the text; the second is a
sentencepiece model that adds that space itself. Strings of special tokens in a text are ordinary text. A text that
is null or empty, or that one of the two spells otherwise, has no tokens, groups or links. Repeated rows are aligned
row by row, a null doc_id stays, extra columns play no part, and an empty table gives an empty result. A text is one
row and its arrays are held at once, some 100 bytes a token.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import give_back, stored, worker_state
from heronlake.llm.tokens import REMEMBERED, encode

#: Bytes of text whose distinct pairs travel together, and that are aligned at a time.
BLOCK_BYTES, SLICE_BYTES = 16 << 20, 2 << 20
#: Tokens of both sides that are spelled out at a time.
SPELLED = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Spelling:
    """The bytes of every id of a vocabulary, and the ids as decimal text."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        digits = [str(i).encode() for i in range(len(tokens))]
        self.width = max(map(len, digits)) + 1
        self.decimal = np.frombuffer(b"".join(d.ljust(self.width) for d in digits), np.uint8).reshape(-1, self.width)
        self.digits = np.array([len(d) for d in digits])

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[ids] - (ends - size), size)]


def byte_level_spelling(path: str) -> Spelling:
    from tokenizers import Tokenizer

    tok, alphabet = Tokenizer.from_file(path), byte_alphabet()
    special = {i for i, t in tok.get_added_tokens_decoder().items() if t.special}
    tokens = [b""] * tok.get_vocab_size()
    for token, i in tok.get_vocab().items():
        tokens[i] = token.encode() if i in special else bytes(alphabet[c] for c in token)
    return Spelling(tokens)


def both_decimals(a: Spelling, b: Spelling) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.width, b.width)
    return np.concatenate([np.pad(x.decimal, ((0, 0), (0, width - x.width))) for x in (a, b)]), np.concatenate([a.digits, b.digits])


class Pieces:
    """A sentencepiece model whose pieces begin no word inside, so that texts can be cut before each run of spaces."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.cut = not any("▁" in x.lstrip("▁") for x in names)
        self.begins = np.array([x.startswith("▁") for x in names])
        self.spelling = Spelling([bytes([int(x[1:-1], 16)]) if sp.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)])

    def encoded(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of distinct chunks, each of which begins with a space; words after one space go joined, many to a call."""
        out: dict[str, bytes] = {}
        words = [c for c in chunks if len(c) > 1 and " " not in c[1:] and "▁" not in c]
        for i in range(0, len(words), 512):
            some = words[i : i + 512]
            ids = np.array(self.sp.encode("".join(some)[1:], num_threads=1), "<u4")
            at = np.flatnonzero(self.begins[ids])
            if len(at) == len(some):
                data, at = ids.tobytes(), [*(at * 4).tolist(), len(ids) * 4]
                out.update((c, data[a:b]) for c, a, b in zip(some, at, at[1:]))
        # a lone space at a text's end is a piece, which the model does not give for an empty text
        out.update((c, np.array([self.sp.piece_to_id("▁")], "<u4").tobytes()) for c in chunks if c == " ")
        rest = [c for c in chunks if c not in out]
        out.update((c, np.array(x, "<u4").tobytes()) for c, x in zip(rest, self.sp.encode([c[1:] for c in rest], num_threads=1)))
        return out


def space_chunks(texts: pa.Array, cut: bool) -> tuple[pa.Array, np.ndarray]:
    """The texts cut before each run of spaces, without a copy, and where each text's chunks begin and the last end."""
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if offs[-1] > offs[0] else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    mark = raw == 32
    mark[1:] &= raw[:-1] != 32
    if not cut:
        mark[:] = False
    mark[offs[:-1][offs[1:] > offs[:-1]]] = True
    starts = np.flatnonzero(mark)
    chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(raw))
    return chunks, np.searchsorted(starts, offs)


def piece_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each of which begins with the space that the model adds, and each text's bounds."""
    pieces = worker_state(f"pieces {path}", lambda: Pieces(path), "tokens")
    known: dict[str, bytes] = worker_state(f"piece chunks {path}", dict, "tokens")
    chunks, bounds = space_chunks(texts, pieces.cut)
    coded = chunks.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    new = pieces.encoded([c for c in distinct if c not in known])
    found = [new[c] if c in new else known[c] for c in distinct]
    if len(known) + len(new) <= REMEMBERED:
        known.update(new)
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    pool = np.frombuffer(b"".join(found), "<u4")
    index = coded.indices.to_numpy(zero_copy_only=False)
    lens = size[index]
    ends = np.cumsum(lens)
    ids = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(size) - size)[index] - (ends - lens), lens)]
    return ids, np.concatenate([[0], ends])[bounds]


def stretch(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... of lengths[k] numbers each, one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two increasing arrays of ends with the same last end -> the number of tokens of each side up to each group's end, and
    the indices of linked tokens."""
    ea, eb = [*a.tolist(), -1], [*b.tolist(), -2]
    n, i, j = len(a), 0, 0
    runs: list[int] = []  # where a one-to-one stretch begins in a and in b, and ends in a
    odd: list[int] = []  # where an irregular group begins and ends in a and in b
    while i < n:
        x, y = ea[i], eb[j]
        if x == y:
            runs += (i, j)
            i, j, step = i + 1, j + 1, 2
            while ea[i : i + step] == eb[j : j + step]:  # probe ahead at this shift, twice as far each time
                i, j, step = i + step, j + step, 2 * step
            while step > 1:  # the difference lies within the last probe
                step >>= 1
                if ea[i : i + step] == eb[j : j + step]:
                    i, j = i + step, j + step
            runs.append(i)
            if i == n:
                break
            x, y = ea[i], eb[j]
        odd += (i, j)
        while x != y:
            if x < y:
                i += 1
                x = ea[i]
            else:
                j += 1
                y = eb[j]
        i, j = i + 1, j + 1
        odd += (i, j)
    run = np.array(runs, np.int64).reshape(-1, 3)
    first, other, last, end = np.array(odd, np.int64).reshape(-1, 4).T
    lengths = run[:, 2] - run[:, 0]
    same_a, same_b = stretch(run[:, 0], lengths), stretch(run[:, 1], lengths)
    cuts = [np.sort(np.concatenate([same + 1, cut]), kind="stable") for same, cut in ((same_a, last), (same_b, end))]
    # within irregular groups each place between two neighbouring ends of either side lies in one token of each
    odd_a, odd_b = stretch(first, last - first), stretch(other, end - other)
    places = np.sort(np.concatenate([a[odd_a], b[odd_b]]), kind="stable")
    places = places[np.append(places[1:] != places[:-1], True)] if len(places) else places
    link_a, link_b = odd_a[np.searchsorted(a[odd_a], places)], odd_b[np.searchsorted(b[odd_b], places)]
    return *cuts, np.concatenate([same_a, link_a]), np.concatenate([same_b, link_b])


class Aligned:
    """A slice of texts: ids and bounds of both sides, group ends and links, over the texts that both sides spell alike."""

    def __init__(self, texts: pa.Array, a: str, b: str):
        sa = worker_state(f"spelling {a}", lambda: byte_level_spelling(a), "tokens")
        sb = worker_state(f"pieces {b}", lambda: Pieces(b), "tokens").spelling
        self.sa, self.sb, self.names = sa, sb, (a, b)
        filled = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar("", pa.large_string()), filled, pa.scalar(" ", pa.large_string()))])
        ia, at_a = encode(whole, a, plain=True)
        ib, at_b = piece_ids(whole, b)
        _, offsets, data = whole.buffers()
        offs = np.frombuffer(offsets, np.int64)[: len(whole) + 1]
        raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if len(whole) else np.zeros(0, np.uint8)
        offs = offs - offs[0] if len(whole) else np.zeros(1, np.int64)
        fine = np.diff(offs) > 1
        for spelling, ids, at in ((sa, ia, at_a), (sb, ib, at_b)):
            ends = np.concatenate([[0], np.cumsum(spelling.size[ids])])[at]
            said = spelling.spelled(ids)
            if len(said) != len(raw) or (ends != offs).any() or (said != raw).any():
                fine &= [said[ends[i] : ends[i + 1]].tobytes() == raw[offs[i] : offs[i + 1]].tobytes() for i in range(len(fine))]
        sizes_a, sizes_b = np.diff(at_a) * fine, np.diff(at_b) * fine
        if not fine.all():
            ia, ib = ia[np.repeat(fine, np.diff(at_a))], ib[np.repeat(fine, np.diff(at_b))]
        self.ia, self.ib = ia.astype(np.int64), ib.astype(np.int64)
        self.at_a, self.at_b = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes_a, sizes_b))
        # one walk over all texts: each text's end is an end of both sides
        self.cut_a, self.cut_b, self.link_a, self.link_b = align(np.cumsum(sa.size[self.ia]), np.cumsum(sb.size[self.ib]))
        self.n = len(fine)
        self.groups = np.searchsorted(self.cut_a, self.at_a, "right")

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups, spelled as a1,a2|b1;a3|b2,b3; the empty string for texts without tokens."""
        na, nb = len(self.ia), len(self.ib)
        ends = [np.zeros(n, bool) for n in (na, nb)]
        ends[0][self.cut_a - 1] = True
        ends[1][self.cut_b - 1] = True
        group = [np.cumsum(e) - e for e in ends]
        place_a = np.arange(na) + np.concatenate([[0], self.cut_b])[group[0]]
        place_b = np.arange(nb) + self.cut_a[group[1]] if nb else np.zeros(0, np.int64)
        # ids of the second side come after those of the first in one table of decimals
        decimal, digits = worker_state(f"decimals {self.names}", lambda: both_decimals(self.sa, self.sb), "tokens")
        ids, mark = np.empty(na + nb, np.int32), np.empty(na + nb, np.uint8)
        ids[place_a], ids[place_b] = self.ia, self.ib + len(self.sa.size)
        mark[place_a], mark[place_b] = np.where(ends[0], 124, 44), np.where(ends[1], 59, 44)
        width, bounds = np.arange(decimal.shape[1]), self.at_a + self.at_b
        mark[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = 0  # nothing follows a text's last token
        hashes = [hashlib.sha256() for _ in range(self.n)]
        for at in range(0, na + nb, SPELLED):
            some = slice(at, min(na + nb, at + SPELLED))
            text, size = decimal[ids[some]], digits[ids[some]]
            text[np.arange(len(text)), size] = mark[some]
            size = size + (mark[some] > 0)
            spelled = memoryview(text[width < size[:, None]])
            to = np.concatenate([[0], np.cumsum(size)])
            first = int(np.searchsorted(bounds, at, "right")) - 1
            while first < self.n and bounds[first] < some.stop:
                hashes[first].update(spelled[to[max(bounds[first], at) - at] : to[min(bounds[first + 1], some.stop) - at]])
                first += 1
        return [h.hexdigest() if b > a else "" for h, a, b in zip(hashes, bounds, bounds[1:])]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about SLICE_BYTES of text, a whole row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def align_documents(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, text) -> doc_id, a_ids, b_ids, a_cuts, b_cuts (tokens up to each group's end), link_a, link_b (places of linked tokens)."""
    lists = ("a_ids", "b_ids", "a_cuts", "b_cuts", "link_a", "link_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                x = Aligned(some.column("text"), a, b)
                order = np.argsort(x.link_a, kind="stable")
                link_a, link_b = x.link_a[order], x.link_b[order]
                at = np.searchsorted(link_a, x.at_a)
                g = x.groups
                rows = [[x.ia[p:q], x.ib[r:s], x.cut_a[u:v] - p, x.cut_b[u:v] - r, link_a[k:m] - p, link_b[k:m] - r] for p, q, r, s, u, v, k, m in zip(x.at_a, x.at_a[1:], x.at_b, x.at_b[1:], g, g[1:], at, at[1:])]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *(pa.array(list(c), pa.list_(pa.int64())) for c in zip(*rows))], ["doc_id", *lists])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} array<long>" for c in lists))


def squeezed(numbers: np.ndarray) -> bytes:
    """Small numbers in byte planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


class Block:
    """Documents whose distinct pairs travel together."""

    def __init__(self):
        self.bytes, self.columns, self.doc, self.code, self.times, self.docs = 0, [], [], [], [], 0

    def add(self, ids: pa.Array, x: Aligned, size: int) -> None:
        of = np.searchsorted(x.at_a, x.link_a, "right") - 1
        most = len(x.sa.size) * len(x.sb.size)
        key, times = np.unique(of * most + x.ia[x.link_a] * len(x.sb.size) + x.ib[x.link_b], return_counts=True)
        self.doc.append(key // most + self.docs)
        self.code.append(key % most)
        self.times.append(times)
        per = [np.diff(v) for v in (x.at_a, x.at_b, x.groups)] + [np.bincount(of, minlength=x.n)]
        self.columns.append([ids, *map(pa.array, per), pa.array(x.digests(), pa.string())])
        self.docs += x.n
        self.bytes += size

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """A row for each document, and one for the block's pairs. A document's links are places in the block's sorted pairs."""
        doc, code, times = (np.concatenate(v) for v in (self.doc, self.code, self.times))
        codes, place = np.unique(code, return_inverse=True)
        at = np.searchsorted(doc, np.arange(self.docs + 1))
        step = np.diff(place, prepend=0)
        step[at[:-1][at[1:] > at[:-1]]] = place[at[:-1][at[1:] > at[:-1]]]
        links = [squeezed(np.concatenate([step[p:q], times[p:q]])) for p, q in zip(at, at[1:])]
        columns = [pa.concat_arrays([c[k] for c in self.columns]) for k in range(6)]
        none = lambda n, t: pa.nulls(n, t)
        longs = pa.list_(pa.int64())
        n = self.docs
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *columns, pa.array(links, pa.binary()), none(n, longs), none(n, longs)], NAMES)
        if len(codes):
            sums = np.bincount(place, weights=times).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([block]), *(none(1, t) for t in [pa.int64()] * 5 + [pa.string(), pa.binary()]), pa.array([codes], longs), pa.array([sums], longs)], NAMES)


NAMES = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "codes", "sums"]
TYPES = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, codes array<long>, sums array<long>"


def alignment_digest(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair's corpus-wide count is the highest of its second id's; count_sum: the sum of the pairs' counts over links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for some in slices(batch):
                text = some.column("text")
                block.add(some.column("doc_id"), Aligned(text, a, b), pc.sum(pc.binary_length(text)).as_py() or 0)
                if block.bytes >= BLOCK_BYTES:
                    yield from block.rows(number)
                    number, block = number + 1, Block()
        if block.docs:
            yield from block.rows(number)
        give_back()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("code").to_numpy(), kind="stable")
        count, best = (right.column(c).to_numpy()[order] for c in ("count", "best"))
        sums = []
        for data in left.column("links").to_pylist():
            step, times = unsqueezed(data).reshape(2, -1)
            at = np.cumsum(step)
            sums.append((int((times * best[at]).sum()), int((times * count[at]).sum())))
        out = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        for name, column in zip(("n_best", "count_sum"), zip(*sums)):
            out = out.append_column(name, pa.array(column, pa.int64()))
        return out.append_column("groups_sha256", left.column("groups_sha256"))

    second = _vocabulary(b)
    rows = stored(docs.select("doc_id", "text").mapInArrow(run, TYPES), "alignment-blocks")
    pairs = rows.where("codes is not null").select("block", F.explode(F.arrays_zip("codes", "sums")).alias("p")).select("block", F.col("p.codes").alias("code"), F.col("p.sums").alias("n"))
    counts = stored(pairs.groupBy("code").agg(F.sum("n").alias("count")).withColumn("b", F.col("code") % second), "alignment-counts")
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    known = counts.join(top, "b").select("code", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))
    back = pairs.select(F.col("block").alias("of"), "code").join(known, "code")
    whole = rows.where("codes is null").drop("codes", "sums")
    types = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return whole.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(finish, types)


def _vocabulary(model: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
