"""Template decontamination against brute force over all alignments."""

import random
import re

import pytest

pytest.importorskip("heronlake.llm")
from heronlake.llm import templates  # noqa: E402

NUMBERS = "Compute the sum of all of the following numbers listed here: " + " ".join(map(str, range(100, 150)))
EDGE = re.compile(r"^[^\w$€£%°+-]+|[^\w$€£%°]+$")


def readings(text):
    """Of a text its words with their codes, with and without names, one list entry a word or run of spelled numbers."""
    words = [(line, w) for line, row in enumerate((text or "").split("\n")) for w in re.findall(r"[^\x20\x09-\x0D]+", row)]
    out, before, line = [], True, 0
    for at, w in words:
        core = EDGE.sub("", w) or w
        low = core.lower()
        first = before or at != line
        ends = w[-1] in ".!?:;\"”»)" and w.rstrip("\"”»)")[-1:] in (".", "!", "?", ":")
        spelled = low in templates.SPELLED or "-" in low and all(x in templates.SPELLED for x in low.split("-"))
        code = "<num>" if templates.NUMBER.fullmatch(low) or spelled else "<unit>" if low in templates.UNITS and len(low) > 1 else low
        named = "<name>" if core[:1].isupper() and not code.startswith("<") and not first else code
        if core[:1].isupper() and not first and code == low:
            named = "<name>"
        if spelled and out and out[-1][3]:
            out[-1][2] += " " + w
        else:
            out.append([named, code, w, spelled])
        before, line = ends, at
    return out


def brute(doc, item, width=8):
    d, i = readings(doc), readings(item)
    best = 0
    for which in (0, 1):
        dc, ic = [x[which] for x in d], [x[which] for x in i]
        n = min(width, len(ic))
        slot = [c in ("<num>", "<unit>", "<name>") for c in ic]
        value = lambda words, k: EDGE.sub("", words[k][2]).lower()
        rich = [sum(slot[s : s + n]) * 2 <= n for s in range(len(ic) - n + 1)]
        free = rich if any(rich) else [sum(slot[s : s + n]) < n for s in range(len(ic) - n + 1)]
        counted = set()
        for diagonal in range(-len(ic), len(dc)):
            starts = [s for s in range(len(ic) - n + 1) if n and 0 <= s + diagonal <= len(dc) - n and dc[s + diagonal : s + diagonal + n] == ic[s : s + n]]
            loose = {k for s in starts if free[s] for k in range(s, s + n)}
            pairs = {(ic[k], value(i, k), value(d, k + diagonal)) for k in loose if slot[k]}
            if len(pairs) == len({p[:2] for p in pairs}) == len({(p[0], p[2]) for p in pairs}):
                counted |= loose
            for s in starts:
                if not free[s] and all(not slot[k] or value(i, k) == value(d, k + diagonal) for k in range(s, s + n)):
                    counted |= set(range(s, s + n))
        best = max(best, len(counted))
    return best >= 0.5 * len(i) and best > 0


def test_verbatim_copies_of_number_heavy_items_are_leaks(spark):
    items = [(1, NUMBERS), (2, "7 8 9 10 11 12 13 14 15 16"), (3, "What is 5 + 7?"), (1, NUMBERS.replace("100", "99")), (4, "one two three")]
    texts = [(10, f"some words before it. {NUMBERS} and after"), (11, NUMBERS.upper()), (12, "it lists 7 8 9 10 11 12 13 14 15 16 in order"), (13, "it lists 1 2 3 4 5 6 7 8 9 10 11 12 13"), (14, "so what is 8 + 3? tell me"), (15, " ".join(map(str, range(500, 560)))), (None, NUMBERS)]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in templates.leaks(d, b).collect()), key=repr)
    want = sorted(((i, k) for i, t in texts for k, x in items if brute(t, x)), key=repr)
    assert got == want
    # both rows of item 1 are judged and have rows of their own
    assert got.count((10, 1)) == 2 and (11, 1) in got and (12, 2) in got and (14, 3) in got
    assert not any(i == 15 for i, _ in got)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(templates, "BITS", 1 << 12)  # a map that lets much pass
    rng = random.Random(seed)
    vocabulary = ["the", "box", "holds", "red", "balls", "and", "Anna", "Omar", "Paris", "5", "7", "9", "km", "hours", "two", "twenty-one", "three hundred", "runs", "to", "mill.", "near", "so", "how", "many"]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k % 9, item(rng.randint(1, 24))) for k in range(12)] + [(20, None), (21, ""), (None, item(9)), (22, "5 7 9 5 7 9 5 7 9 7")]
    texts = []
    for k in range(60):
        base = rng.choice([t for _, t in items if t])
        changed = re.sub(r"\b[579]\b", lambda m: rng.choice([m[0], "11", "13"]) if rng.random() < 0.5 else m[0], base)
        if rng.random() < 0.3:
            changed = changed.replace("Anna", "Maria").replace("Paris", "Rome")
        if rng.random() < 0.3:
            changed = rng.choice([str.lower, str.upper, str.title])(changed)
        words = changed.split(" ")
        if rng.random() < 0.3 and len(words) > 4:
            words.insert(rng.randrange(len(words)), "inserted")
        texts.append((k, item(rng.randint(0, 6)) + rng.choice([" ", "\n", ". "]) + " ".join(words) + " " + item(rng.randint(0, 30))))
    texts += [(100, None), (101, ""), (0, texts[0][1]), (None, texts[1][1]), (102, " ".join(t for _, t in texts[:20]) * 3)]
    d = spark.createDataFrame([(*t, "k", 1) for t in texts], "doc_id long, text string, h string, item_row long").coalesce(2)
    b = spark.createDataFrame([(*t, "k") for t in items], "item_id long, text string, width string").coalesce(2)
    got = sorted(((r.doc_id, r.item_id) for r in templates.leaks(d, b).collect()), key=repr)
    assert got == sorted(((i, k) for i, t in texts for k, x in items if k is not None and brute(t, x)), key=repr)
    clean = templates.decontaminated(d, b)
    bad = {t for _, t in texts if any(k is not None and brute(t, x) for k, x in items)}
    assert clean.columns == d.columns and sorted(map(repr, (r.text for r in clean.collect()))) == sorted(repr(t) for _, t in texts if t not in bad)


def test_spelled_numbers_and_case():
    item = "A train leaves Boston at 60 miles per hour and meets Anna after 3 hours near the old mill"
    judge = lambda t: templates.judge(templates.canonical(t), templates.canonical(item), 8)
    size = len(item.split())
    for copy in (item, item.lower(), item.upper(), item.replace("60", "sixty"), item.replace("60", "one hundred and five").replace("and five", "five"), item.replace("Boston", "Rome").replace("3", "twenty-one")):
        assert judge(copy)[3] == size, copy
    assert judge(item.replace("hour and meets", "hour but passes"))[3] < size
    assert judge("") is None and judge(None) is None


def test_very_long_text():
    item = "the box holds 5 red balls and the bag holds 7 blue balls"
    long = "some filler words of no matter " * 50_000
    assert templates.judge(templates.canonical(f"{long}{item} {long}"), templates.canonical(item), 8)[3] == len(item.split())
