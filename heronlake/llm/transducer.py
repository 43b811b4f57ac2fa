"""Token counts by a compiled finite-state transducer, with chunk state maps composed in parallel.

The piece model merges neighbours whose joint text is a piece, best score first. Of such a tokenizer two
facts hold: a sequence of pieces is the encoding of its text just when each adjacent pair is the
encoding of its own text; and prefixes of an encoding are encodings. So after each character there is
one possible last piece, and the machine that reads characters needs to know only the last pieces at
positions where a later piece can still begin. Its states hold just these; they are compiled when first
met. Every transition is annotated with the change in the number of emitted tokens.

Where two neighbouring characters stand together in no piece, no token spans them: there the machine
returns to its start state. A chunk's state map is (characters before the first such place, tokens
between, characters after the last), and the maps of a document's chunks compose by an associative
operation, in a tree, whatever the chunk borders are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import worker_state

#: Compiled states and remembered words of a worker; tables are emptied beyond, which changes no result.
MOST_STATES, MOST_WORDS = 200_000, 600_000


class Transducer:
    """scores: piece -> score. A character outside the pieces emits a token for each of its bytes.

    A state is the text since the first open position and, for each open position: the characters since
    then, the last piece before it, and the tokens up to it less the tokens up to now. A position is open
    while the text since then begins some piece.
    """

    START = ("", ((0, "", 0),))

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.begins = {p[:i] for p in scores for i in range(1, len(p))}
        self.together = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states, self.keys, self.moves = {self.START: 0}, [self.START], [{}]

    def merged(self, text: str) -> list[str]:
        """The merges carried out one by one; used on texts of one or two pieces while compiling."""
        parts, scores = list(text), self.scores
        while True:
            best = max(((scores[x], -i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, a: str, b: str) -> bool:
        key = (a, b)
        if key not in self.pairs:
            if len(self.pairs) > 4 * MOST_STATES:
                self.pairs.clear()
            self.pairs[key] = self.merged(a + b) == ([a, b] if a else [b])
        return self.pairs[key]

    def compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition: the state after `char`, and the change in the number of tokens."""
        text, opened = self.keys[state]
        text += char
        for since, last, back in opened:
            piece = text[len(text) - since - 1 :]
            if (since == 0 or piece in self.scores) and self.fits(last, piece):
                break
        else:
            raise AssertionError(f"no last piece after {text!r}")
        change = back + (1 if piece in self.scores else len(piece.encode("utf-8", "surrogatepass")))
        still = [(since + 1, last, back - change) for since, last, back in opened if text[len(text) - since - 1 :] in self.begins]
        key = (text[len(text) - still[0][0] :] if still else "", (*still, (0, piece, 0)))
        if (to := self.states.get(key)) is None:
            to = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        return to, change

    def count(self, text: str) -> int:
        """Tokens of a text that is read from the start state."""
        if len(self.keys) > MOST_STATES:
            self.reset()
        state = total = 0
        moves = self.moves
        for char in text:
            step = moves[state].get(char)
            if step is None:
                step = moves[state][char] = self.compile(state, char)
            state, change = step
            total += change
        return total

    def breaks(self, text: str) -> list[int]:
        """Places in a text that no token can span."""
        together = self.together
        return [i + 1 for i in range(len(text) - 1) if text[i : i + 2] not in together]

    def chunk_map(self, text: str) -> tuple[str, bool, int, str]:
        """(characters before the first break, whether there is one, tokens between, characters after the last)."""
        at = self.breaks(text)
        if not at:
            return text, False, 0, ""
        return text[: at[0]], True, sum(map(self.count, (text[a:b] for a, b in zip(at, at[1:])))), text[at[-1] :]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks: associative."""
        if not a[1]:
            return (*self.chunk_map(a[0]), ) if b[0] == "" and not b[1] else self._join(("", False, 0, a[0]), b, a[0])
        return self._join(a, b, None)

    def _join(self, a: tuple, b: tuple, head: str | None) -> tuple:
        middle = self.chunk_map(a[3] + b[0])
        if head is not None:  # no break in a: the joint head runs to the first break of the middle
            if not middle[1]:
                return (middle[0], b[1], b[2], b[3])
            return (middle[0], True, middle[2] + (self.count(middle[3]) if b[1] else 0) + b[2], b[3] if b[1] else middle[3])
        inside = self.count(middle[0]) + middle[2] + self.count(middle[3])
        if b[1]:
            return (a[0], True, a[2] + inside + b[2], b[3])
        if middle[1]:
            return (a[0], True, a[2] + self.count(middle[0]) + middle[2], middle[3])
        return (a[0], True, a[2], middle[0])

    def total(self, m: tuple) -> int:
        return self.count(m[0]) + m[2] + self.count(m[3])


def load(path: str):
    """The library's normalizer of a piece model and the transducer compiled from its pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return sp, Transducer({sp.id_to_piece(i): sp.get_score(i) for i in usable})


def word_starts(texts: pa.Array) -> tuple[pa.Array, "object"]:
    """Normalized texts cut before each blank mark that follows another character, without a copy."""
    import numpy as np

    n = len(texts)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[: n + 1]
    end = int(offs[-1])
    raw = np.frombuffer(data, np.uint8)[:end] if end else np.zeros(0, np.uint8)
    mark = np.zeros(end, bool)
    if end > 2:
        mark[:-2] = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)
    cut = mark.copy()
    cut[3:] &= ~mark[:-3]
    cut[offs[:-1][offs[1:] > offs[:-1]]] = True
    starts = np.flatnonzero(cut)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, end).astype(np.int64)), pa.py_buffer(raw)), np.searchsorted(starts, offs)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, chunk_chars: int = 1 << 16) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of (doc_id, text); a null text counts as empty.

    Texts of up to chunk_chars are one chunk. Longer ones are cut into chunks that are dealt to all tasks
    and whose maps are composed in a tree, 64 at a time. Repeated rows are counted row by row.
    """
    import math

    from heronlake.llm.common import stored

    def machine():
        return worker_state(f"transducer {model}", lambda: load(model), "transducer")

    def counts_of(normal: list[str], m: Transducer, memo: dict[str, int]):
        import numpy as np

        words, bounds = word_starts(pa.array(normal, pa.large_string()))
        coded = words.dictionary_encode()
        inner = "\u2581" in {p[i] for p in m.scores for i in range(1, len(p)) if p[i - 1] != "\u2581"}
        if inner:
            raise ValueError("this model has pieces that span words")
        each = []
        for w in coded.dictionary.to_pylist():
            k = memo.get(w)
            if k is None:
                k = m.count(w)
                if len(memo) < MOST_WORDS:
                    memo[w] = k
            each.append(k)
        sums = np.concatenate([[0], np.cumsum(np.array(each, np.int64)[coded.indices.to_numpy(zero_copy_only=False)])]) if each else np.zeros(1, np.int64)
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, m = machine()
        memo = worker_state(f"counts {model}", dict, "transducer")
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                texts = batch.column("text").to_pylist()
                counted = counts_of([sp.normalize(t) if t else "" for t in texts], m, memo)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counted, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = machine()
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                normal = sp.normalize(text)
                parts = [normal[k : k + chunk_chars] for k in range(0, len(normal), chunk_chars)]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())], ["row", "chunk", "part"])

    map_type = "row long, chunk long, m struct<head: string, broken: boolean, inside: long, tail: string>"
    map_arrow = pa.struct([("head", pa.string()), ("broken", pa.bool_()), ("inside", pa.int64()), ("tail", pa.string())])

    def as_maps(rows, chunks, maps):
        keys = ("head", "broken", "inside", "tail")
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(chunks, pa.int64()), pa.array([dict(zip(keys, x)) for x in maps], map_arrow)], ["row", "chunk", "m"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, m = machine()
        for batch in batches:
            yield as_maps(batch.column("row").to_pylist(), batch.column("chunk").to_pylist(), [m.chunk_map(t) for t in batch.column("part").to_pylist()])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import functools

        _, m = machine()
        for batch in batches:
            lists = [[tuple(x["m"].values()) for x in sorted(some, key=lambda x: x["chunk"])] for some in batch.column("maps").to_pylist()]
            yield as_maps(batch.column("row").to_pylist(), batch.column("chunk").to_pylist(), [functools.reduce(m.compose, some) for some in lists])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, m = machine()
        for batch in batches:
            counted = [m.total(tuple(x.values())) for x in batch.column("m").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(counted, pa.int64())], ["row", "n_tokens"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    out = rows.where(~long).select("doc_id", "text", "n_bytes").mapInArrow(short, "doc_id long, n_bytes long, n_tokens long")
    over = stored(rows.where(long).withColumn("row", F.monotonically_increasing_id()), "transducer-long")
    most = over.agg(F.max(F.length("text"))).first()[0]
    if most:
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chunks = over.select("row", "text").mapInArrow(cut, "row long, chunk long, part string").repartition(tasks, "row", "chunk")
        level = chunks.mapInArrow(maps, map_type)
        for _ in range(max(1, math.ceil(math.log(most * 2 / chunk_chars + 2, 64)))):
            level = level.groupBy("row", F.expr("chunk div 64").alias("chunk")).agg(F.collect_list(F.struct("chunk", "m")).alias("maps")).mapInArrow(composed, map_type)
        counted = level.select("row", "m").mapInArrow(totals, "row long, n_tokens long")
        out = out.unionByName(over.select("doc_id", "n_bytes", "row").join(counted, "row").drop("row"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
