"""Token ids of whole texts by the `tokenizers` library, each distinct chunk encoded once per worker.

A chunk is a run of white space with the non-blank run that follows. Both public tokenizers
handled here end every pre-token where a non-blank is followed by white space, so encoding the
chunks one by one gives the ids of the whole text. Texts with white space outside ASCII are not cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from heronlake.llm.common import worker_state

#: White space outside ASCII; a text with any of these is encoded in one piece.
WIDE_SPACE = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Stems and whole chunks a worker remembers; beyond, it encodes without remembering.
REMEMBERED, WHOLE = 250_000, 150_000


def tokenizer_path(name: str) -> str:
    """Where the environment keeps a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def chunked(texts: pa.Array, lead: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts as one array (no copy), and where each text's chunks begin and the last end."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    n = len(texts)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    base, end = int(offs[0]), int(offs[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[base:end] if end > base else np.zeros(0, np.uint8)
    offs = offs - base
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    cut = blank.copy()
    cut[1:] &= ~blank[:-1]
    wide = pc.match_substring_regex(texts, WIDE_SPACE).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(wide):
        cut[offs[i] : offs[i + 1]] = False
    filled = offs[:-1][offs[1:] > offs[:-1]]
    cut[filled] = True
    starts = np.flatnonzero(cut)
    bounds = np.searchsorted(starts, offs)
    chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, end - base).astype(np.int64)), pa.py_buffer(raw))
    return chunks, bounds


class Letters(dict):
    """By character: whether the library takes it for a letter after which a full stop begins a pre-token of its own.

    It is asked, as normalisation turns some letters into a letter with a mark and its tables are of another Unicode version.
    """

    def __init__(self, tok):
        self.tok = tok

    def __missing__(self, c: str) -> bool:
        text = f"a{c}."
        plain = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        pieces = self.tok.pre_tokenizer.pre_tokenize_str(plain)
        self[c] = c.isalpha() and len(pieces) == 2 and pieces[1][0] == "."
        return self[c]


def stem_of(chunk: str, lower: bool, letters: Letters) -> tuple[str, str]:
    """A chunk as a stem and trailing full stops and commas: after a letter these are a pre-token of their own."""
    core = chunk.lstrip(" \n\t\r\x0b\x0c") if lower else chunk
    stem = core.rstrip(".,")
    if stem and stem != core and letters[stem[-1]]:
        tail = core[len(stem) :]
    else:
        stem, tail = core, ""
    if lower and stem.isascii() and stem.isalpha():
        stem = stem.lower()
    return stem, tail


def shapes(tok) -> tuple[np.ndarray, np.ndarray]:
    """By token id: whether it closes a word, and how many bytes it stands for (byte-level alphabets)."""
    closes, width = np.zeros(tok.get_vocab_size(), bool), np.zeros(tok.get_vocab_size(), np.int64)
    for token, i in tok.get_vocab().items():
        closes[i], width[i] = token.endswith("</w>"), len(token)
    return closes, width


def encode_new(tok, stems: list[str], lower: bool, letters: Letters, closes: np.ndarray, width: np.ndarray) -> dict[str, bytes]:
    """Ids of distinct stems as bytes. Plain words go through the library joined, many to a call.

    Their ids are told apart by the tokens that close a word or by the bytes that tokens stand for;
    if these do not fit, the words are encoded one by one.
    """
    ids: dict[str, bytes] = {}
    words = [(x, x if lower else x[1:]) for x in stems if lower or x[:1] == " "]
    plain = [x for x, w in words if w.isalpha() and (w.isascii() or all(letters[c] for c in set(w)))]
    for i in range(0, len(plain), 512):
        some = plain[i : i + 512]
        got = np.array(tok.encode_batch_fast([(" " if lower else "").join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
        if lower:
            ends = np.flatnonzero(closes[got]) + 1
            sure = len(ends) == len(some) and len(got) == ends[-1]
        else:
            have, want = np.cumsum(width[got]), np.cumsum([len(x.encode()) for x in some])
            ends = np.searchsorted(have, want) + 1
            sure = len(got) == ends[-1] and bool((have[ends - 1] == want).all())
        if sure:
            data, ends = got.tobytes(), (ends * 4).tolist()
            ids.update((x, data[a:b]) for x, a, b in zip(some, [0, *ends], ends))
    rest = [x for x in stems if x not in ids]
    for i in range(0, len(rest), 4096):
        some = rest[i : i + 4096]
        ids.update((x, np.array(e.ids, dtype="<u4").tobytes()) for x, e in zip(some, tok.encode_batch_fast(some, add_special_tokens=False)))
    return ids


def load(path: str, plain: bool = False):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = plain
    return tok


def encode(texts: pa.Array, path: str, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in one array, and where each text's ids begin and the last end. Null counts as empty.

    plain: strings of special tokens in a text are ordinary text.
    """
    as_text = " plain" if plain else ""
    tok = worker_state(f"tokenizer {path}{as_text}", lambda: load(path, plain), "tokens")
    known: dict[str, bytes] = worker_state(f"stems {path}{as_text}", dict, "tokens")
    lower = worker_state(f"lower {path}", lambda: '"Lowercase"' in tok.to_str()[:2000] and '"Removed"' in tok.to_str()[:2000], "tokens")
    chunks, bounds = chunked(texts)
    coded = chunks.dictionary_encode()
    letters = worker_state(f"letters {path}", lambda: Letters(tok), "tokens")
    # whole chunks are looked up first; what is not known is taken apart into stems
    whole: dict[str, bytes] = worker_state(f"chunks {path}{as_text}", dict, "tokens")
    values = coded.dictionary.to_pylist()
    found = list(map(whole.get, values))
    missing = [i for i, x in enumerate(found) if x is None]
    pairs = [stem_of(values[i], lower, letters) for i in missing]
    needed = {x for pair in pairs for x in pair}
    new = [x for x in needed if x not in known]
    ids = known
    if new:
        more = encode_new(tok, new, lower, letters, *worker_state(f"shapes {path}", lambda: shapes(tok), "tokens"))
        if len(known) + len(more) <= REMEMBERED:
            known.update(more)
        else:
            ids = {x: known[x] for x in needed if x in known} | more
    room = WHOLE - len(whole)
    for n, (i, (stem, tail)) in enumerate(zip(missing, pairs)):
        found[i] = ids[stem] + ids[tail] if tail else ids[stem]
        if n < room:
            whole[values[i]] = found[i]
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
    pool = np.frombuffer(b"".join(found), dtype="<u4")
    at = np.concatenate([[0], np.cumsum(size)])
    index = coded.indices.to_numpy(zero_copy_only=False)
    lens = size[index]
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    where = np.arange(total, dtype=np.int64) + np.repeat(at[:-1][index] - (ends - lens), lens)
    starts = np.concatenate([[0], ends])[bounds]
    return pool[where], starts
