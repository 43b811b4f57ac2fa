"""Cross-tokenizer alignment against brute force over occurrences."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("heronlake.llm")
from heronlake.llm import alignment, tokens  # noqa: E402

BYTE = tokens.tokenizer_path("byte_bpe_50k.json")
PIECE = tokens.tokenizer_path("piece_bpe_32k.model")
ODD = ["", "  a", "a  b \n\n c", "don't it's <|endoftext|>X", None, "a\r\n\r\nb", "Σας ΣΑΣ", "a▁b", "▁", "<s> </s><0x41>", "İstanbul.", "x\x1c y", "́a ́ e", "日本語のテキスト", "end. ", "😀" * 50, "word " * 3000, " ", "a\xa0 b", "\x00", "x" * 20_000]


def brute(text):
    """Groups as lists of ids, and linked ids; nothing where the two spell the text otherwise."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = brute.__dict__.setdefault("tok", Tokenizer.from_file(BYTE)), brute.__dict__.setdefault("sp", sentencepiece.SentencePieceProcessor(model_file=PIECE))
    tok.encode_special_tokens = True
    if not text:
        return [], [], [], []
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    alphabet = alignment.byte_alphabet()
    sa = [bytes(alphabet[c] for c in tok.id_to_token(i)) for i in a]
    sb = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(sa) == b"".join(sb) == (" " + text).encode():
        return [], [], [], []
    ea, eb = ([0, *np.cumsum([len(x) for x in s]).tolist()] for s in (sa, sb))
    at_a, at_b = ({e: i for i, e in enumerate(x)} for x in (ea, eb))
    cuts = sorted(at_a.keys() & at_b.keys())
    groups = [(a[at_a[x] : at_a[y]], b[at_b[x] : at_b[y]]) for x, y in zip(cuts, cuts[1:])]
    links, j = [], 0
    for i, x in enumerate(a):
        while eb[j + 1] <= ea[i]:
            j += 1
        k = j
        while k < len(b) and eb[k] < ea[i + 1]:
            links.append((x, b[k]))
            k += 1
    return a, b, groups, links


def spelled(groups):
    return hashlib.sha256(";".join("|".join(",".join(map(str, side)) for side in g) for g in groups).encode()).hexdigest() if groups else ""


def test_align_any_ends():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ([*sorted(rng.sample(range(1, 90), rng.randint(0, 60))), 90] for _ in range(2))
        if rng.random() < 0.6:
            b = [x for x in a if rng.random() < 0.9 or x == 90]
        cut_a, cut_b, link_a, link_b = alignment.align(np.array(a), np.array(b))
        common = sorted(set(a) & set(b))
        assert cut_a.tolist() == [a.index(c) + 1 for c in common] and cut_b.tolist() == [b.index(c) + 1 for c in common]
        a0, b0 = [0, *a], [0, *b]
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(a0[i], b0[j]) < min(a[i], b[j])]
        assert sorted(zip(link_a.tolist(), link_b.tolist())) == want
    nothing = np.zeros(0, np.int64)
    assert all(len(x) == 0 for x in alignment.align(nothing, nothing))


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, code string, block long").coalesce(2)
    found = [(doc_id, *brute(t)) for doc_id, t in rows]
    count = collections.Counter(link for *_, links in found for link in links)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    want = [(d, len(a), len(b), len(g), len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), spelled(g)) for d, a, b, g, x in found]
    got = [tuple(r) for r in alignment.alignment_digest(frame, BYTE, PIECE).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return frame, found


def test_digest(spark, monkeypatch):
    """Odd, empty, null and very long texts, repeated rows, null ids, clashing columns; many small blocks."""
    real = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [(1000 + i, t) for i, t in enumerate(ODD)] + [(1003, ODD[3]), (None, "no id"), (None, None), *real]
    frame, found = check(spark, rows)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 700)
    monkeypatch.setattr(alignment, "SPELLED", 64)
    check(spark, rows[: len(ODD) + 40])
    got = alignment.align_documents(frame, BYTE, PIECE).collect()
    for r, (d, a, b, groups, links) in zip(got, found):
        assert (r.doc_id, r.a_ids, r.b_ids) == (d, a, b)
        cuts = list(zip([0, *r.a_cuts], r.a_cuts, [0, *r.b_cuts], r.b_cuts))
        assert [(a[p:q], b[s:t]) for p, q, s, t in cuts] == groups
        assert sorted((a[i], b[j]) for i, j in zip(r.link_a, r.link_b)) == sorted(links)
    assert alignment.alignment_digest(frame.limit(0), BYTE, PIECE).count() == 0


def test_texts_not_spelled_alike_have_no_tokens():
    x = alignment.Aligned(pa.array(["a▁b", "plain text", None, ""]), BYTE, PIECE)
    assert np.diff(x.at_a).tolist() == [0, len(brute("plain text")[0]), 0, 0] and x.digests()[0] == ""
