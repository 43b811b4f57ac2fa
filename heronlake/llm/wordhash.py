"""Hashes of all words of many texts at once, by vectorised prefix sums.

A word is a maximal run outside blank and tab to carriage return. Its hash is a polynomial in its bytes, each
replaced by a fixed random number, modulo 2**64, and mixed. Prefix sums over a whole buffer give every
word's polynomial by two look-ups.
"""

from __future__ import annotations

import numpy as np

from heronlake.llm.common import worker_state

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BASE = 0x9E3779B97F4A7C15
#: A dozen arrays of eight bytes for each byte of a buffer live in a worker at once.
BUFFER = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and BASE**-k modulo 2**64 for k < n."""

    def table(base: int) -> np.ndarray:
        out = np.full(n, np.uint64(base), np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    return table(BASE), table(pow(BASE, -1, 1 << 64))


class Words:
    """Of a buffer of texts: the bytes, where each word begins and ends, its hash, and the words of each text."""

    def __init__(self, texts: list[bytes], lower: bool):
        data = b"\n".join(texts)
        self.raw = np.frombuffer(data.translate(LOWER) if lower else data, np.uint8)
        n = len(self.raw)
        blank = np.ones(n + 2, bool)
        blank[1:-1] = (self.raw == 32) | ((self.raw >= 9) & (self.raw <= 13))
        self.starts = np.flatnonzero(blank[:-2] & ~blank[1:-1])
        self.ends = np.flatnonzero(~blank[1:-1] & blank[2:]) + 1
        # a byte's number is drawn from a fixed stream
        numbers = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        up, down = worker_state("word powers", lambda: powers(BUFFER + 1)) if n <= BUFFER else powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(numbers[self.raw] * up[:n], out=sums[1:])
        size = (self.ends - self.starts).astype(np.uint64)
        self.hashes = mixed((sums[self.ends] - sums[self.starts]) * down[self.starts] + size)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.at = np.searchsorted(self.starts, bounds)

    def word(self, i: int) -> str:
        return self.raw[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "surrogatepass")

    def after_newline(self) -> np.ndarray:
        """Whether a line break stands between each word and the one before."""
        lines = np.concatenate([[0], np.cumsum(self.raw == 10)])
        out = np.ones(len(self.starts), bool)
        out[1:] = lines[self.starts[1:]] > lines[self.ends[:-1]]
        return out


def buffers(texts: list[str | None], lower: bool):
    """The texts in buffers of about BUFFER bytes, a whole text at least: (index of the first text, Words)."""
    some, size, first = [], 0, 0
    for i, t in enumerate(texts):
        data = t.encode("utf-8", "surrogatepass") if t else b""
        if some and size + len(data) + 1 > BUFFER:
            yield first, Words(some, lower)
            some, size, first = [], 0, i
        some.append(data)
        size += len(data) + 1
    if some:
        yield first, Words(some, lower)


def text_hashes(texts: list[str | None], lower: bool = True) -> list[np.ndarray]:
    """The word hashes of each text."""
    out: list[np.ndarray] = []
    for _, w in buffers(texts, lower):
        out += [w.hashes[a:b] for a, b in zip(w.at, w.at[1:])]
    return out
