"""Benchmark decontamination by template canonicalisation.

Words lose punctuation at their ends and become lower case; numbers, names and units become typed placeholders. A run
of spelled-out number words is one number. Windows of `width` canonical words of the benchmark are hash-joined with
those of the documents, in two readings of both: one with names as placeholders, and one without regard to case, in
which names are words, so that copies in other case meet too.

For each document and item that meet, their shared windows are found on whole texts, by alignment (diagonal). Windows
of which at least half the words are literal, or where an item has no such window those with a literal word, may stand
for other values: along an alignment one item value maps to one document value of its type and the other way round.
All other windows count where their words are equal. A pair is a leak if the words of such windows, over all
alignments of one reading, are at least `cover` of the item's words, so re-parameterised questions are leaks too, and
an inconsistent instance of a template hides no other one of the document. `covered_words` counts the words of all
shared windows.

Windows of the documents pass a bitmap of fixed size before they are joined, so only documents that may meet an item
are written and shuffled; the join decides exactly. Items shorter than `width` use windows of their own length; items
without words match nothing. Null and empty texts hold no windows. Documents and items are treated row by row: of two
benchmark rows with one item_id each is judged by itself and has a row of its own. Rows with a null item_id take no part.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import stored, worker_state
from heronlake.llm.jaccard import window_hashes
from heronlake.llm.wordhash import buffers

#: Bits of the map of windows that is broadcast, and how many bits a window sets.
BITS, SETS = 1 << 26, 3
# Units of measure and currency, as written after a number or alone.
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres gal gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years hz khz mhz ghz w kw kwh v kv a b kb mb gb tb usd eur gbp dollar dollars euro euros pound pounds cent cents percent % $ € £ °c °f".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:e[+-]?\d+)?(?:st|nd|rd|th)?[%$€£]?")
# Words of spelled-out numbers.
SPELLED = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion".split())
NAME, NUM, UNIT = (np.uint64(x) for x in (1, 2, 3))
#: Codes of distinct words that a worker remembers; the table is emptied beyond.
MOST_KNOWN = 250_000
EDGE = re.compile(r"^[^\w$€£%°+-]+|[^\w$€£%°]+$")


def word_code(word: str) -> int:
    """A word's code above three flags: ends a sentence (1), capitalised (2), spelled-out number (4)."""
    import xxhash

    ends = word[-1:] in ".!?:;\"”»)" and word.rstrip("\"”»)")[-1:] in (".", "!", "?", ":")
    core = EDGE.sub("", word) or word
    low = core.lower()
    if NUMBER.fullmatch(low):
        return int(NUM) << 3 | ends
    if low in SPELLED or "-" in low and all(x in SPELLED for x in low.split("-")):
        return int(NUM) << 3 | 4 | ends
    if low in UNITS and len(low) > 1:
        return int(UNIT) << 3 | ends
    return (xxhash.xxh64_intdigest(low) >> 3 | 1 << 40) << 3 | core[:1].isupper() << 1 | ends


class Reading:
    """Of a text the canonical codes with names as placeholders and without regard to case, and its words."""

    def __init__(self, named: np.ndarray, blind: np.ndarray, word: Callable[[int], str]):
        self.named, self.blind, self.word = named, blind, word

    def value(self, i: int) -> str:
        return EDGE.sub("", self.word(i)).lower()


class Canonical:
    """The canonical words of a buffer of texts: codes of both readings, and where each text's begin and the last end."""

    def __init__(self, w):
        known: dict[int, int] = worker_state("template words", dict, "templates")
        distinct, first, index = np.unique(w.hashes, return_index=True, return_inverse=True)
        codes = [known.get(h) for h in distinct.tolist()]
        new = [i for i, c in enumerate(codes) if c is None]
        if len(known) + len(new) > MOST_KNOWN:
            known.clear()
        for i in new:
            codes[i] = known[int(distinct[i])] = word_code(w.word(first[i]))
        code = np.array(codes, np.uint64)[index] if len(index) else np.zeros(0, np.uint64)
        blind = code >> np.uint64(3)
        flags = code.astype(np.uint8) & 7
        begins = w.after_newline()
        begins[1:] |= (flags[:-1] & 1) == 1
        begins[w.at[:-1][w.at[:-1] < len(begins)]] = True
        named = np.where((flags & 2 > 0) & ~begins, NAME, blind)
        # a run of spelled-out number words within a text is one number
        more = flags & 4 > 0
        more[1:] &= more[:-1]
        more[:1] = False
        more[w.at[:-1][w.at[:-1] < len(more)]] = False
        self.words, self.at, self.kept = w, w.at, None
        if more.any():
            self.kept = np.append(np.flatnonzero(~more), len(more))
            self.at = np.searchsorted(self.kept, w.at)
            named, blind = named[self.kept[:-1]], blind[self.kept[:-1]]
        self.named, self.blind = named, blind

    def word(self, i: int) -> str:
        if self.kept is None:
            return self.words.word(i)
        return " ".join(self.words.word(k) for k in range(self.kept[i], self.kept[i + 1]))


def canonical_texts(texts: list[str | None]) -> list[Reading]:
    out = []
    for _, w in buffers(texts, lower=False):
        c = Canonical(w)
        out += [Reading(c.named[a:b], c.blind[a:b], lambda i, a=a, c=c: c.word(a + i)) for a, b in zip(c.at.tolist(), c.at[1:].tolist())]
    return out


def canonical(text: str | None) -> Reading:
    return canonical_texts([text])[0]


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window."""
    return window_hashes(codes, width) if 0 < width <= len(codes) else np.zeros(0, np.uint64)


def free_windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Whether each window's placeholders may stand for other values."""
    slots = np.concatenate([[0], np.cumsum(codes <= UNIT)])
    slots = slots[width:] - slots[:-width]
    rich = slots * 2 <= width
    return rich if rich.any() else slots < width


def judged_reading(doc: np.ndarray, item: np.ndarray, there: Callable[[int], str], here: Callable[[int], str], width: int) -> tuple[int, int, int] | None:
    """Of one reading: words of shared windows, words of those that count, and where the document's stretch begins."""
    own = min(width, len(item))
    ih, dh = windows(item, own), windows(doc, own)
    hits = np.flatnonzero(np.isin(dh, ih))
    if not len(hits):
        return None
    places = defaultdict(list)
    for at, h in enumerate(ih.tolist()):
        places[h].append(at)
    free = free_windows(item, own)
    covered = np.zeros(len(item), bool)
    by_diagonal: dict[int, list[int]] = defaultdict(list)
    for p in hits.tolist():
        for at in places[int(dh[p])]:
            covered[at : at + own] = True
            by_diagonal[p - at].append(at)
    slots = {i: here(i) for i in np.flatnonzero(item <= UNIT).tolist()}

    def counted(diagonal: int, starts: list[int]) -> list[int]:
        """Words of an alignment's windows that count."""
        values = {i: there(i + diagonal) for s in starts for i in range(s, s + own) if i in slots}
        words = {i for s in starts if free[s] for i in range(s, s + own)}
        forth: dict[tuple, str] = {}
        back: dict[tuple, str] = {}
        for i in sorted(words & values.keys()):
            kind, a, b = int(item[i]), slots[i], values[i]
            if forth.setdefault((kind, a), b) != b or back.setdefault((kind, b), a) != a:
                words = set()
                break
        equal = {i for i in values if values[i] == slots[i]}
        for s in starts:
            if not free[s] and all(i not in slots or i in equal for i in range(s, s + own)):
                words.update(range(s, s + own))
        return sorted(words)

    # most windows first, then the earliest; the stretch told is the first that counts
    agreed = np.zeros(len(item), bool)
    first = None
    ranked = sorted(by_diagonal.items(), key=lambda x: (-len(x[1]), x[0]))
    for diagonal, starts in ranked:
        words = counted(diagonal, starts)
        if words and not agreed[words].all():
            agreed[words] = True
            first = diagonal + min(starts) if first is None else first
            if agreed.sum() == covered.sum():
                break
    if first is None:
        first = ranked[0][0] + min(ranked[0][1])
    return int(covered.sum()), int(agreed.sum()), first


def judge(doc: Reading, item: Reading, width: int) -> tuple[int, int, int, int] | None:
    """Words covered, the item's words, where the document's stretch begins, and words that count: of the reading in which most count."""
    found = [judged_reading(d, i, doc.value, item.value, width) for d, i in ((doc.named, item.named), (doc.blind, item.blind))]
    found = [x for x in found if x]
    if not found:
        return None
    covered, agreed, first = max(found, key=lambda x: (x[1], x[0], -x[2]))
    return covered, len(item.named), first, agreed


OUT = "doc_id long, item_id long, item_words long, covered_words long, first_word long, agreed_words long"


def rows_out(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 6)], ["doc_id", "item_id", "item_words", "covered_words", "first_word", "agreed_words"])


def bitmap(index: DataFrame) -> np.ndarray:
    """Which windows some item may have: at most BITS bits reach the driver, whatever the benchmark's size."""
    place = F.explode(F.array(*[F.shiftrightunsigned("h", i * 19).bitwiseAND(F.lit(BITS - 1)) for i in range(SETS)]))
    words = index.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    map_ = np.zeros(BITS // 64, np.int64)
    map_[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return map_.view(np.uint8)


def may_hold(map_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places of those window hashes that the map does not rule out."""
    left = np.arange(len(h))
    for i in range(SETS):
        p = (h[left] >> np.uint64(i * 19)) & np.uint64(BITS - 1)
        left = left[(map_[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return left


def meetings(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """Every document and item that share a window, judged on whole texts."""
    spark = docs.sparkSession
    items = stored(benchmark.select("item_id", "text").where("text is not null and item_id is not null").withColumn("item_row", F.monotonically_increasing_id()), "template-items")

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, item in zip(batch.column("item_row").to_pylist(), canonical_texts(batch.column("text").to_pylist())):
                own = min(width, len(item.named))
                h = np.unique(np.concatenate([windows(c, own) for c in (item.named, item.blind)])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), row)), pa.array(np.full(len(h), own)), pa.array(h)], ["item_row", "width", "h"])

    index = stored(items.select("item_row", "text").mapInArrow(table, "item_row long, width long, h long"), "template-windows")
    widths = [r[0] for r in index.select("width").distinct().collect()]  # at most `width` of them
    held = spark.sparkContext.broadcast(bitmap(index))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                some = batch.slice(i, 1000)
                docs_met, met = [], []
                for first, w in buffers(some.column("text").to_pylist(), lower=False):
                    c = Canonical(w)
                    for own in widths:
                        for codes in (c.named, c.blind):
                            h = windows(codes, own)
                            place = may_hold(held.value, h)
                            doc = np.searchsorted(c.at, place, "right") - 1
                            within = place + own <= c.at[doc + 1]
                            docs_met.append(doc[within] + first)
                            met.append(h[place[within]])
                doc, h = np.concatenate([*docs_met, np.zeros(0, np.int64)]), np.concatenate([*met, np.zeros(0, np.uint64)])
                if len(doc):
                    keep = np.unique(doc)
                    order = np.argsort(doc, kind="stable")
                    lists = [np.unique(x).view(np.int64) for x in np.split(h[order], np.searchsorted(doc[order], keep[1:]))]
                    part = some.take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "text", "hs"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200)
                texts = {t: None for c in ("text", "item_text") for t in some.column(c).to_pylist()}
                texts = dict(zip(texts, canonical_texts(list(texts))))
                rows = []
                for doc_id, item_id, text, item_text in zip(*(some.column(c).to_pylist() for c in ("doc_id", "item_id", "text", "item_text"))):
                    if r := judge(texts[text], texts[item_text], width):
                        rows.append((doc_id, item_id, r[1], r[0], r[2], r[3]))
                yield rows_out(rows)

    near = docs.select("doc_id", "text").mapInArrow(probe, "doc_id long, text string, hs array<long>")
    near = stored(near.withColumn("row", F.monotonically_increasing_id()), "template-near")
    pairs = near.select("row", F.explode("hs").alias("h")).join(index.select("h", "item_row"), "h").select("row", "item_row").distinct()
    whole = pairs.join(near.select("row", "doc_id", "text").hint("merge"), "row").join(items.select("item_row", "item_id", F.col("text").alias("item_text")), "item_row")
    return whole.select("doc_id", "item_id", "text", "item_text").mapInArrow(judged, OUT)


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, cover: float = 0.5) -> DataFrame:
    """A row for each document and benchmark item that it leaks: doc_id, item_id, item_words, covered_words, first_word."""
    met = meetings(docs, benchmark, width)
    return met.where(F.col("agreed_words") >= F.col("item_words") * cover).drop("agreed_words")


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, cover: float = 0.5) -> DataFrame:
    """The documents that leak no item; columns as they were. A row with null doc_id is kept or goes by its text."""
    key = F.xxhash64("doc_id", "text")
    tagged = docs.select(key.alias("doc_id"), "text")
    bad = stored(leaks(tagged, benchmark, width, cover).select(F.col("doc_id").alias("_leak")).distinct(), "template-leaks")
    return docs.join(bad, key == F.col("_leak"), "left_anti")
