"""The ten operators and the pipeline against brute force, round trips and odd inputs."""

import collections
import functools
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("heronlake.llm")
from heronlake.llm import bitplane, components, jaccard, kdtree, langid, linewinnow, packing, suffixtree, templates, tokens, transducer, warc  # noqa: E402
from heronlake.llm.common import scratch, stored  # noqa: E402

WORD = tokens.tokenizer_path("word_bpe_49k.json")
BYTE = tokens.tokenizer_path("byte_bpe_50k.json")
PIECE = tokens.tokenizer_path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = ["", "  a", "a  b \n\n c", "a   b", "don't it's <|endoftext|>X", None, "a\r\n\r\nb", "Σας ΣΑΣ", "İstanbul.", "x\x1c y", "1.5, 2.", "́a ́ e", "日本語のテキスト", "end. ", "😀" * 50, "word " * 3000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


loaded = functools.lru_cache(tokens.load)


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, a null id, and extra columns whose names clash with those used inside."""
    rows = [(i, t, "en", i, "k") for i, t in enumerate(ODD)] + [(3, ODD[3], "en", 3, "k"), (None, "no id here", None, None, None)]
    return docs(spark, rows, "doc_id long, text string, lang string, n long, piece string")


# 1 and 3: tokens


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_equal_the_librarys(path, real):
    tok = tokens.load(path)
    texts = [t for t in ODD] + [r.text for r in real.collect()]
    ids, starts = tokens.encode(pa.array(texts), path)
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_after_any_letter(path):
    tok = loaded(path)
    texts = [f"ab{c}{end} {c}b{c}." for c in map(chr, range(0x110000)) if c.isalpha() for end in ("., z", ".", ",")]
    texts += ["TÜRKİYE CUMHURİYETİ.", "DİYARBAKIR, ŞEHRİ, BELEDİYESİ."]
    for i in range(0, len(texts), 50_000):
        some = texts[i : i + 50_000]
        ids, starts = tokens.encode(pa.array(some), path)
        want = [e.ids for e in tok.encode_batch_fast(some, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abT.,'s \n\t\r é1<|", max_size=40), max_size=4))
def test_ids_of_any_text(texts):
    for path in (WORD, BYTE):
        ids, starts = tokens.encode(pa.array(texts, pa.string()), path)
        tok = loaded(path)
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_planes_round_trip(unit):
    for n in (0, 1, 7, 1000):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        assert (bitplane.from_planes(bitplane.to_planes(ids, unit), n, unit) == ids).all()


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_op1(spark, odd, unit):
    tok = tokens.load(WORD)
    want, start = [], 0
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    manifest = bitplane.write_token_files(odd, scratch(spark, "t"), WORD, 2, unit, block_ids=64, shard_ids=60, partitions=3)
    assert manifest.count() > 3
    got = [tuple(r) for r in bitplane.read_token_files(manifest, with_ids=False).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    back = bitplane.read_token_files(manifest).where("doc_id = 13").first()
    assert back.ids == tok.encode("end. ", add_special_tokens=False).ids + [2]
    assert bitplane.token_files_digest(odd.limit(0), WORD, 2).count() == 0


def test_best_fit():
    bins, offs = packing.best_fit(np.array([5, 3, 7, 2, 3]), 10)
    used = collections.Counter()
    for b, o, s in sorted(zip(bins, offs, [5, 3, 7, 2, 3])):
        assert o == used[b]
        used[b] += s
    assert sorted(used.values()) == [10, 10]


def gapless(rows, cap):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= cap
    return len(by)


def test_pack_in_rounds(spark):
    """Many small tasks first: residual bins meet in later rounds, and the result is near the bound."""
    r = random.Random(1)
    sizes = [r.randint(1, 100) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size long")
    out = packing.pack(items, 100, task_items=200).join(items, "item").withColumn("length", F.col("size")).collect()
    assert len(out) == 3000 and gapless(out, 100) <= sum(sizes) / 100 * 1.08
    one = packing.pack(items.where("item < 5").withColumn("size", F.lit(60).cast("long")), 100, task_items=2).collect()
    assert len({x.sequence_id for x in one}) == 5


def test_op3(spark, odd):
    tok = tokens.load(BYTE)
    out = packing.pack_documents(odd, BYTE, 0, 64, with_ids=True)
    got = out.collect()
    gapless(got, 64)
    for r in odd.where("doc_id <> 3").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        mine = sorted((x for x in got if x.doc_id == r.doc_id), key=lambda x: x.piece)
        assert [i for x in mine for i in x.ids] == ids and [x.piece for x in mine] == list(range(len(mine)))
        assert all(x.length == 64 for x in mine[1:]) and all(x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) for x in mine)
        assert [x.start for x in mine] == [0, *itertools.accumulate(x.length for x in mine)][:-1]
    seq = packing.sequences(out).collect()
    assert sum(len(s.ids) for s in seq) == sum(x.length for x in got)
    assert packing.pack_documents(odd.limit(0), BYTE, 0).count() == 0


# 2: exact search


def test_op2(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(700, 8)).round(3).astype(np.float32)
    v[100:140] = v[100]
    rows = [(i, [float(x) for x in e], "x") for i, e in enumerate(v)]
    rows += [(900, None, "x"), (950, [1.0, None, *[0.0] * 6], "x"), (1000, [math.nan] * 8, "x"), (1050, [math.inf] * 8, "x"), (1100, [0.5, 0.25], "x"), (1101, [1.0, 1.0], "x"), (None, [1.0] * 8, "x"), (150, [float(x) for x in v[150]], "x"), (1150, [], "x")]
    q = kdtree.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string"))
    got = collections.defaultdict(list)
    for x in kdtree.top_k(q, q.where("vec_id % 50 = 0"), shard_rows=100, group_shards=2, block_rows=8, leaf=4).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    ints = [(x.vec_id, x.v) for x in q.collect()]
    for i in {i for i, _ in ints if i % 50 == 0}:
        e = next(e for k, e in ints if k == i)
        want = sorted(((k, sum(a * b for a, b in zip(e, f))) for k, f in ints if k != i and len(f) == len(e)), key=lambda t: (-t[1], t[0]))[:5]
        assert got.get(i, []) == want
    assert kdtree.top_k(q.limit(0), q.limit(0)).count() == 0


def test_tree_bounds_are_exact_for_large_integers():
    v = np.array([[2**40, 1], [2**40, 2], [-(2**40), 3]], dtype=np.int64)
    best = [[]]
    kdtree.Tree(np.arange(3), v, 1).search(np.array([9]), np.array([[2**40, 1]], dtype=np.int64), best, 2)
    assert sorted((s, -i) for s, i in best[0]) == [(2**80 + 1, 0), (2**80 + 2, 1)]


# 4: language model


def brute_scores(rows, m):
    tok = [(i, words(t) + [None]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [w for i, w in tok if not held(i)]
    c = collections.Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    p0 = lambda x: (c[x] + 0.1) / (n + 0.1 * (v + 1))
    grams = [collections.Counter(tuple(w[k : k + d]) for w in train for k in range(len(w) - d + 1)) for d in range(12)]
    states, counted = [{(): None}], {()}

    def p(context, x):
        if not context:
            return p0(x)
        d = states[len(context)][context]
        return (d.get(x, 0) + len(d) * p(context[1:], x)) / (grams[len(context)][context] + len(d))

    while states[-1]:
        depth = len(states)
        nexts = collections.defaultdict(dict)
        for g, k in grams[depth + 1].items():
            if grams[depth][g[:-1]] >= m and g[1:-1] in states[-1] and g[:-2] in counted:
                nexts[g[:-1]][g[-1]] = k
        counted = set(nexts)
        states.append(nexts)
        gain = {g: sum(k * math.log(k / grams[depth][g] / p(g[1:], x)) for x, k in d.items()) for g, d in nexts.items()}
        states[-1] = {g: d for g, d in nexts.items() if gain[g] > len(d) * math.log(v + 1)}
    brute_scores.depth = len(states) - 2
    out = []
    for i, w in tok:
        score = 0.0
        for k, x in enumerate(w):
            d = max(d for d in range(min(k, len(states) - 1) + 1) if tuple(w[k - d : k]) in states[d])
            q = p(tuple(w[k - d : k]), x)
            score += math.log10(q)
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(p0(x)) for x in w), score))
    return out


def test_op4(spark, real, odd):
    # sentences that fork after three and four words make contexts of that many words states
    fork = [(2000 + i, " ".join(f"{a} red {b} fox {'runs' if a == 'one' else 'sleeps'} {'far' if a == 'one' else 'deep'} and {a} {b} ends" for a in ("one", "two") for b in ("big", "old"))) for i in range(150)]
    df = real.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 1000).alias("doc_id"), "text")).unionByName(docs(spark, fork))
    df = df.withColumns({"kind": F.lit("x"), "block": F.lit(1), "ids": F.lit(2)})
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[6])
    got = sorted(map(tuple, suffixtree.score(df, min_count=4, block_tokens=20_000).collect()), key=key)
    want = sorted(brute_scores([(r.doc_id, r.text) for r in df.collect()], 4), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    assert brute_scores.depth >= 3
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)
    assert suffixtree.score(df.limit(0)).count() == 0


# 5: transducer


@pytest.fixture(scope="module")
def machine():
    return transducer.load(PIECE)


def test_counts_of_real_texts(machine, real):
    sp, m = machine
    for r in real.collect():
        n = sp.normalize(r.text)
        b = m.breaks(n)
        assert sum(m.count(n[i:k]) for i, k in zip([0, *b], [*b, len(n)])) == len(sp.encode(r.text))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcthe ▁\nèé日1.<>😀", max_size=60), st.integers(1, 9), st.randoms())
def test_maps_compose_in_any_tree(machine, text, size, rnd):
    sp, m = machine
    n = sp.normalize(text)
    maps = [m.chunk_map(n[i : i + size]) for i in range(0, len(n), size)]
    while len(maps) > 1:
        i = rnd.randrange(len(maps) - 1)
        maps[i : i + 2] = [m.compose(maps[i], maps[i + 1])]
    assert (m.total(maps[0]) if maps else 0) == len(sp.encode(text))


@pytest.mark.parametrize("chunk", [1 << 16, 50])
def test_op5(spark, odd, machine, chunk):
    got = sorted(map(tuple, transducer.count_tokens(odd, PIECE, limit=100, chunk_chars=chunk).collect()), key=repr)
    want = []
    for r in odd.collect():
        n = len(machine[0].encode(r.text or ""))
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 100))
    assert got == sorted(want, key=repr)
    assert transducer.count_tokens(odd.limit(0), PIECE).count() == 0


# 6: decontamination

ITEM = "A train leaves Boston at 60 miles per hour and meets Anna after 3 hours near the old mill by the river bank"


def test_op6(spark, monkeypatch):
    fill = " ".join(f"w{i}" for i in range(40))
    bench = spark.createDataFrame([(1, ITEM, "z"), (2, "short item here", "z"), (3, "", "z"), (4, None, "z"), (5, "7 8 9 10 11 12 13 14 15 16", "z")], "item_id long, text string, row string")
    other = ITEM.replace("60", "75").replace("Boston", "Paris").replace("Anna", "Omar").replace("3 hours", "5 hours")
    rows = [(1, f"{fill} {ITEM} {fill}"), (2, f"{fill}. {other}. {fill}"), (3, fill), (4, None), (5, ""), (6, "so short item here ends"), (1, f"{fill} {ITEM} {fill}"), (None, ITEM), (8, " ".join(ITEM.split()[:9]) + " " + fill), (9, "it cost 1 2 3 4 5 6 7 8 9 10 11 12 dollars")]
    df = docs(spark, [(i, t, "x") for i, t in rows], "doc_id long, text string, h string")
    want = sorted([(1, 1), (1, 1), (2, 1), (None, 1), (6, 2)], key=repr)
    got = lambda: sorted(((r.doc_id, r.item_id) for r in templates.leaks(df, bench.where("item_id < 5")).collect()), key=repr)
    assert got() == want
    monkeypatch.setattr(templates, "may_hold", lambda m, h: templates.np.arange(len(h)))  # the join alone decides
    assert got() == want
    assert {r.doc_id for r in templates.decontaminated(df, bench.where("item_id < 5")).collect()} == {3, 4, 5, 8, 9}
    assert templates.leaks(df.limit(0), bench).count() == 0 and templates.leaks(df, bench.limit(0)).count() == 0


def test_slots_must_agree():
    item = "the box holds 5 red balls and the bag holds 5 blue balls so how many does the shop have"
    swap = item.replace("5 red", "7 red").replace("5 blue", "7 blue")
    mixed = item.replace("5 red", "7 red").replace("5 blue", "8 blue")
    judge = lambda t: templates.judge(templates.canonical(t), templates.canonical(item), 8)
    assert judge(swap)[3] and not judge(mixed)[3]


def test_any_instance_is_a_leak(spark, monkeypatch):
    """An inconsistent instance of the template before or after a copy, or between two halves, hides no leak."""
    wrong = ITEM.replace("60", "9").replace("after 3", "after 9")
    other = ITEM.replace("60", "75").replace("after 3", "after 5")
    split = ITEM.replace("and meets", "and then finally meets")
    fill = "Here is some filler text that stands between the questions"
    texts = [f"{wrong}. {fill}. {ITEM}", f"{ITEM}. {fill}. {wrong}", f"{wrong}. {fill}. {other}. {fill}. {wrong}", f"{wrong}. {fill}. {wrong}", wrong, f"{wrong}. {fill}. {split}", split]
    df, bench = docs(spark, list(enumerate(texts))), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    size = len(ITEM.split())
    for size_ in (templates.BITS, 64):
        monkeypatch.setattr(templates, "BITS", size_)
        got = {r.doc_id: r for r in templates.leaks(df, bench).collect()}
        assert set(got) == {0, 1, 2, 5, 6}
        assert got[0].first_word == size + len(fill.split()) and got[1].first_word == 0 and got[0].covered_words == size
    assert {r.doc_id for r in templates.decontaminated(df, bench).collect()} == {3, 4}


def test_leaks_of_real_texts(spark, real):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    flat = lambda t: f" {' '.join((t or '').lower().split())} "
    want = {(r.doc_id, b.item_id) for r in real.collect() for b in bench.collect() if flat(b.text) in flat(r.text)}
    assert {(r.doc_id, r.item_id) for r in templates.leaks(real, bench).collect()} == want


# 7: language


def test_op7(spark, real):
    label = F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("lang"))
    df = real.withColumns({"label": label, "declared": label, "p": F.lit(1)})
    out = {r.doc_id: r for r in langid.identify(df, declared="declared", host="source", label="label").collect()}
    hidden = [r for r in real.where("doc_id % 5 = 0").collect()]
    assert sum(out[r.doc_id].lang_id == r.lang for r in hidden) >= 0.97 * len(hidden)
    assert all(r.keep for r in out.values())


def test_op7_odd_rows(spark, real, odd):
    df = real.select("doc_id", "text", "lang", "source").unionByName(odd.select((F.col("doc_id") + 5000).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")))
    out = {r.doc_id: r for r in langid.identify(df, declared="lang", host="source").where("doc_id >= 5000").collect()}
    assert not out[5000].keep and not out[5005].keep and out[5000].lang_id == "und"
    none = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")), declared="lang", host=None).collect()
    assert len(none) == odd.count() and not any(r.keep for r in none)
    assert langid.identify(df.limit(0), declared="lang", host="source").count() == 0
    assert langid.known_language(df, declared="lang", host="source").columns == df.columns


def test_op7_rare_languages(spark):
    """A language of fewer than 1 of 500 labelled rows has a model."""
    r = random.Random(0)
    text = lambda k, n: " ".join("".join(chr(0x4E00 + 40 * k + r.randrange(12)) for _ in range(r.randint(2, 5))) for _ in range(n))
    rows = [(i, text(0, 20), "big") for i in range(700)] + [(1000 + k, text(k, 300), f"l{k:03}") for k in range(1, 4)]
    rows += [(5000 + k, text(k, 60), None) for k in range(1, 4)] + [(6000, text(0, 60), None)]
    df = docs(spark, rows, "doc_id long, text string, lang string")
    out = {x.doc_id: x.lang_id for x in langid.identify(df, declared=None, host=None).where("doc_id >= 5000").collect()}
    assert out == {5000 + k: f"l{k:03}" for k in range(1, 4)} | {6000: "big"}


def test_op7_unknown_language(spark, real):
    """Text of a language without labels is undetermined; the others' documents stay."""
    lang = F.when(F.col("lang") != "es", F.col("lang"))
    out = {r.doc_id: r for r in langid.identify(real.withColumn("label", lang), declared="label", host="source", label="label").collect()}
    es, rest = ([out[r.doc_id] for r in real.where(x).collect()] for x in ("lang = 'es'", "lang <> 'es'"))
    assert es and sum(not r.keep and r.lang_id == "und" for r in es) >= 0.9 * len(es)
    assert all(r.keep for r in rest)


def test_pages(spark):
    rows = [(1, "https://u@a.example.de:80/x", '<html lang="de"><script>x</script><p>und der &amp; die'), (2, None, None)]
    got = [tuple(r) for r in langid.page_rows(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert got[0][0] == 1 and got[0][1].split() == ["und", "der", "die"] and got[0][2:] == ("de", "a.example.de", "de") and got[1][2:] == (None, None, None)


# 8: Jaccard join


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i in sets for s in sets[i])


def near_rows(seed=0):
    """Copies, chains of edits, groups with a shared passage, boundary cases."""
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.choice([3, 6, 20, 60, 120]))] for _ in range(12)]
    rows, passage = [], [r.choice(vocab) for _ in range(30)]
    for b in base:
        for _ in range(r.randint(1, 8)):
            w = list(b)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append(" ".join(w + passage * (r.random() < 0.3)))
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(900, None), (901, ""), (902, "  \n"), (903, "One two"), (904, "one TWO"), (905, "one"), (906, rows[0])]


@pytest.mark.parametrize("seed, pivots", [(0, 4), (1, 1), (2, 7)])
def test_op8(spark, seed, pivots):
    rows = near_rows(seed)
    df = docs(spark, [(i, t, "q", 5) for i, t in rows], "doc_id long, text string, id string, n int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_components(df, pivots=pivots).collect())
    assert got == brute_components(rows)


def test_op8_odd(spark):
    df = docs(spark, [(1, "a b c d e f"), (1, "x y z"), (2, "x y z"), (None, "x y z")])
    got = sorted(map(tuple, jaccard.similar_components(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 1, 1), (2, 1, 1), (None, 1, None)], key=repr)
    assert jaccard.similar_components(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(50), 100 + r.randrange(50)) for _ in range(40)] + [(7, 7)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {k: v for k, v in up.items() if any(k in e and e[0] != e[1] for e in edges)}


# 9: line dedup


def brute_lines(rows, least=50):
    seq = [(k, [(i, x.strip(" "), len(x.split())) for i, x in enumerate(t.split("\n")) if x.split()]) for k, t in sorted(rows) if t is not None]
    first, gone, by = {}, collections.defaultdict(set), dict(seq)
    for d, lines in seq:
        for s in range(len(lines)):
            n, e = 0, s
            while e < len(lines) and n < least:
                n, e = n + lines[e][2], e + 1
            if n < least:
                break
            run = tuple(x for _, x, _ in lines[s:e])
            od, o = first.setdefault(run, (d, s))
            if (od, o) != (d, s):
                a, b, other = s, e, by[od]
                while a and o - (s - a) and lines[a - 1][1] == other[o - (s - a) - 1][1]:
                    a -= 1
                while b < len(lines) and o + b - s < len(other) and lines[b][1] == other[o + b - s][1]:
                    b += 1
                gone[d].update(i for i, _, _ in lines[a:b])
    return {d: "\n".join(x for i, x in enumerate(by_text.split("\n")) if i not in gone[d]) for d, by_text in rows if by_text is not None}


def line_rows(seed):
    r = random.Random(seed)
    line = lambda n: " ".join(f"t{r.randrange(3000)}" for _ in range(n))
    passages = [[line(r.randint(5, 40)) for _ in range(r.randint(2, 6))] for _ in range(4)] + [[line(60)]]
    rows = []
    for i in range(30):
        body = []
        for _ in range(r.randint(1, 4)):
            body += r.choice(passages) if r.random() < 0.4 else [line(r.randint(1, 30)) for _ in range(r.randint(1, 3))]
        rows.append((i, "\n".join(body)))
    return rows + [(50, rows[3][1]), (51, "same words\n" * 40 + "end"), (52, ""), (53, None), (54, "x " * 30000)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_op9(spark, seed):
    rows = line_rows(seed)
    df = docs(spark, [(i, t, 1, "p") for i, t in rows], "doc_id long, text string, pos int, key string")
    out = linewinnow.dedup_lines(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got.pop(53) is None and got == brute_lines(rows)


def test_op9_odd(spark):
    long = " ".join(f"u{i}" for i in range(60))
    df = docs(spark, [(1, long), (1, long), (None, long), (2, f"{long}\n\n{long}\nshort"), (1, f"a\n{long}")])
    got = sorted(((r.doc_id, r.text, r.k) for r in linewinnow.dedup_lines(df, removed="k").collect()), key=repr)
    texts = {(d, t) for d, t, _ in got}
    assert len(got) == 5 and (None, long) in texts and (2, "\nshort") in texts and sum(long in t for _, t in texts) == 1
    assert linewinnow.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_op9_first_parts(spark, seed):
    """Earlier documents hold parts of a passage, each of under 50 words; the whole passage comes later, more than once."""
    r = random.Random(seed)
    line = lambda n: " ".join(f"t{r.randrange(3000)}" for _ in range(n))
    rows, top = [], 1000
    for _ in range(25):
        passage = [line(r.randint(3, 14)) for _ in range(r.randint(8, 11))]
        for i in range(r.randint(1, 4)):
            a = r.randrange(len(passage))
            b = a + 1
            while b < len(passage) and sum(len(x.split()) for x in passage[a : b + 1]) < 50:
                b += 1
            rows.append((len(rows), "\n".join([line(9), *passage[a:b], line(9)])))
        for _ in range(3):
            rows.append((top := top + 1, "\n".join([line(8), *passage, line(8)])))
    got = {x.doc_id: x.text for x in linewinnow.dedup_lines(docs(spark, rows)).collect()}
    assert got == brute_lines(rows)


# 10: WARC


def test_op10(spark):
    big, html = "x" * 200, "é" * 50
    rows = [(5, "u", big, 1), (2, "http://a/ b\n", big, 1), (9, None, big, 1), (3, "u", None, 1), (4, "u", "", 1), (6, "u", "tiny", 1), (7, "u", "tiny", 1), (8, "u", html, 1), (10, "u", html, 1), (2, "u", big, 1), (None, "u", big, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _d int")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_pages(pages).collect()), key=repr)
    want = [(5, "revisit", 2, 200), (2, "response", None, 200), (9, "revisit", 2, 200), (3, "response", None, 0), (4, "response", None, 0), (6, "response", None, 4), (7, "response", None, 4), (8, "response", None, 100), (10, "revisit", 8, 100), (2, "response", None, 200), (None, "response", None, 200)]
    assert got == sorted(want, key=repr)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_bundle_seeks(spark):
    import zstandard

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 40) for i in range(50)], "id long, url string, html string")
    rows = pages.select("id", "url", F.encode("html", "UTF-8").alias("payload"))
    manifest = warc.write_bundles(warc.dedup_plan(rows), scratch(spark, "w"), frame_bytes=2000, bundle_bytes=6000)
    back = warc.read_bundles(manifest)
    assert {(r.page_id, bytes(r.payload).decode()) for r in back.collect()} == {(r.id, r.html) for r in pages.collect()} and back.where("not intact").count() == 0
    path = manifest.first().path
    b = warc.Bundle(path)
    assert len(b.sizes) > 1
    one = b.index.column("record_id").to_pylist()[-1]
    assert b.record(one)[0]["WARC-Record-ID"] == one
    with pytest.raises(KeyError):
        b.record("<urn:record:none>")
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(open(path.removeprefix("file://"), "rb"), read_across_frames=True).readall() for _ in [0])
    assert plain.startswith(b"WARC/1.1\r\n") and plain.count(b"WARC/1.1\r\n") == len(b.index)


# the pipeline


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in pipeline.STAGES:
        before = d
        d = stored(stage(spark, d, SF), "stage")
        columns = columns or before.columns
        if name == "line_dedup":
            want = brute_lines([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id: r.text for r in d.collect()} == {k: v for k, v in want.items() if v.strip(" ") or not next(r.text for r in before.collect() if r.doc_id == k).strip(" ")}
        if name == "near_duplicates":
            want = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in before.collect()]) if i == c}
            assert {r.doc_id for r in d.collect()} == want
        if name != "best_fit_packing":
            assert d.columns == columns
    packed = d.collect()
    assert packed and gapless(packed, 2048)


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
