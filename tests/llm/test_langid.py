"""Evidence fusion against the formulas, row by row in plain Python."""

import collections
import math

import pyarrow as pa
import pytest

pytest.importorskip("heronlake.llm")
from heronlake.llm import langid  # noqa: E402

SCHEMA = "doc_id long, text string, declared string, host string, suffix string, lang string, ll string, keep int"


def softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def brute(rows, temper=0.6, least=0.5, kappa=5.0):
    """doc_id, text -> language and confidence by all four kinds of evidence; models of all labelled rows."""
    codes = []
    for _, text, *_ in rows:
        c, _ = langid.trigram_codes(pa.array([text], pa.string()))
        codes.append([x for x in c.tolist() if x < langid.CODES])
    langs = sorted({r[5] for r, c in zip(rows, codes) if r[5] is not None and c})
    counts = {x: collections.Counter(k for r, c in zip(rows, codes) if r[5] == x for k in c) for x in langs}
    used = max(1, len({k for c in counts.values() for k in c}))
    models = []
    for x in langs:
        total = sum(counts[x].values())
        add = min(0.5, 0.05 * total / used)
        models.append(lambda k, c=counts[x], t=total, a=add: math.log((c[k] + a) / (t + a * used)))
    shares = [{k: n / sum(counts[x].values()) for k, n in counts[x].items()} for x in langs]
    # the model's own smoothed shares of what it has seen
    seen = [{k: math.exp(m(k)) for k in s} for s, m in zip(shares, models)]
    seen = [{k: v / sum(s.values()) for k, v in s.items()} for s in seen]
    under = [[sum(p * m(k) for k, p in s.items()) for m in models] for s in seen]
    own = [under[i][i] for i in range(len(langs))]
    spread = [math.sqrt(sum(p * (models[i](k) - own[i]) ** 2 for k, p in seen[i].items())) for i in range(len(langs))]
    far = [min(u[j] for u in under) for j in range(len(langs))]
    floor = [own[j] - langid.FOREIGN * max(own[j] - far[j], 2 * spread[j]) for j in range(len(langs))]

    evidence = []
    for c in codes:
        n = len(c)
        raw = [sum(m(k) for k in c) for m in models]
        known = n > 0 and any(r / n >= floor[j] - 2 * spread[j] / n ** (temper / 2) for j, r in enumerate(raw))
        ll = [r * n ** (temper - 1) if n else 0.0 for r in raw]
        evidence.append((ll, softmax(ll), known))

    def mass(where):
        return [sum(p[j] for r, (_, p, known) in zip(rows, evidence) if known and where(r)) for j in range(len(langs))]

    whole = [x + 1 for x in mass(lambda r: True)]
    out = []
    for r, (ll, p, known) in zip(rows, evidence):
        mine = [x if known else 0.0 for x in p]

        def rest(column, r=r, mine=mine):
            if r[column] is None:
                return [0.0] * len(langs)
            return [max(0.0, a - b) for a, b in zip(mass(lambda q: q[column] == r[column]), mine)]

        smooth = lambda n, up: [(a + kappa * b) / (sum(n) + kappa) for a, b in zip(n, up)]
        prior = smooth(rest(3), smooth(rest(4), [x / sum(whole) for x in whole]))
        said = [0.0] * len(langs) if r[2] is None else [math.log((a + 0.5) / (b + 0.5)) for a, b in zip(rest(2), whole)]
        post = softmax([a + math.log(b) + c for a, b, c in zip(ll, prior, said)])
        top = max(post)
        out.append((r[0], langs[post.index(top)] if known and top >= least else "und", top))
    return out


def compare(spark, rows, **evidence):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).coalesce(2)
    got = sorted(((r.doc_id, r.lang_id, r.confidence) for r in langid.identify(frame, label="lang", **evidence).collect()), key=repr)
    blank = [tuple(None if name in ("declared", "host", "suffix") and evidence.get(name) is None else v for name, v in zip(("doc_id", "text", "declared", "host", "suffix", "lang"), r)) for r in rows]
    want = sorted(brute(blank), key=repr)
    assert [g[:2] for g in sorted(got, key=lambda x: repr(x[:2]))] == [w[:2] for w in sorted(want, key=lambda x: repr(x[:2]))]
    for key in {g[0] for g in got}:
        assert sorted(g[2] for g in got if g[0] == key) == pytest.approx(sorted(w[2] for w in want if w[0] == key), abs=2e-4)
    return dict((g[0], g[1]) for g in got)


def test_fusion_equals_the_formulas(spark):
    """Null and empty texts, no letters, repeated rows, null ids, ties, clashing columns, a text of no known language."""
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(90).collect()
    rows = [(r.doc_id, (r.text or "")[:400], r.lang if r.doc_id % 5 else None, f"h{r.doc_id % 7}.example", "de" if r.lang == "de" else "com" if r.doc_id % 2 else None, r.lang) for r in real]
    rows += [(9001, None, "en", None, None, None), (9002, "", None, "h1.example", "com", None), (9003, "12345 67890", "de", "h2.example", None, None), (9004, "zxq wvk jjq xxz " * 40, None, None, None, None), (9005, "a", None, None, None, None), rows[3], rows[3], (None, rows[5][1], None, None, None, None)]
    found = compare(spark, rows, declared="declared", host="host", suffix="suffix")
    assert found[9001] == found[9002] == found[9003] == "und"
    compare(spark, rows, declared=None, host=None)


def test_equal_posteriors_go_to_the_first_name(spark):
    rows = [(1, "one two three", None, None, None, "b"), (2, "one two three", None, None, None, "a")]
    assert set(compare(spark, rows, declared=None, host=None).values()) <= {"a", "und"}


def test_very_long_text_and_empty_tables(spark):
    text = "these are quite plain words of a language that is known "
    frame = spark.createDataFrame([(1, text * 20_000, "en"), (2, text, "en"), (3, "andere worte einer anderen sprache sind auch da", "de")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_id for r in langid.identify(frame, declared=None, host=None).collect()}[1] == "en"
    assert langid.identify(frame.limit(0), declared="lang", host=None).count() == 0
