"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes its leaf blocks in order: runs of text that no block element parts, each with the elements around it.
Scripts, styles, the head, form controls and other elements that hold no prose give no blocks. A block's features are
the tags and the words of class, id and role of its ancestors, and of its text the length, the share of linked and of
capital letters, digits, the marks it ends with, and the same of its neighbours. Each block is content or not; the
field has a weight for every hashed feature and label and for every pair of neighbouring labels, and the best
sequence of labels is found by Viterbi.

The field is trained here, by gradient ascent on the likelihood of labelled pages. Labels come from pages that mark
their own parts: blocks below article, main or the like are content, those below nav, header, footer, aside, form or
the names of CHROME are not. So that the field also reads pages which mark parts otherwise or not at all, every
labelled page is used again in other layouts: with plain containers, with other names, with its marks left out, and
with parts of other pages put in as menus, notices, sidebars and comments. At most `train_pages` pages of at most
TRAIN_BYTES, and TRAIN_BLOCKS blocks of each, are used, those with the smallest hash of id and html; this bounds the fit alone. Without labelled pages
the field is fitted on the layouts alone, filled with blocks of any page, long ones as content.

A null or empty page has no text. Entities are decoded; white space, line breaks among it, becomes one space; nothing
of the blocks that are chosen is dropped. A page is one row; work grows with its length. Repeated rows are treated row
by row, pages with a null id stay, extra columns play no part.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import enter

#: Bounds of the fit: bytes of a page, and blocks of it from the first on.
TRAIN_BYTES, TRAIN_BLOCKS = 200_000, 200
#: Hashed features.
SPACE = 1 << 16

# Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head template noscript iframe object svg math canvas audio video map select datalist textarea button option title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img input".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: An element that ends an open one of these when it begins, up to the barrier.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",))}

# Names by which pages mark what is the article, and what is not.
CONTENT = frozenset("article main content post entry story body text articlebody post-content entry-content article-body story-body main-content".split())
CHROME = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar banner footer colophon legal copyright sidebar aside widget related recommended ad ads advert advertisement adverts sponsor sponsored promo promotion cookie cookies consent notice gdpr popup modal newsletter subscribe signup share sharing social comment comments disqus respond reply replies discussion form search login tags pagination pager toolbar".split()
)
ARTICLE_TAGS, CHROME_TAGS = frozenset(("article", "main")), frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog", "search"))

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACES = re.compile(r"\s+")


class Block:
    """Text of a leaf block, letters of it within links, and (tag, names) of its ancestors, outermost first."""

    __slots__ = ("text", "linked", "path")

    def __init__(self, text: str, linked: int, path: tuple):
        self.text, self.linked, self.path = text, linked, path


def names_of(attributes: str) -> tuple[str, ...]:
    out: list[str] = []
    for _, a, b, c in NAMED.findall(attributes):
        for name in (a or b or c).split():
            out += [name.lower(), *(w.lower() for w in WORDS.findall(name))]
    return tuple(dict.fromkeys(out))


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, tuple[str, ...]]] = []
    inline = links = linked = 0
    parts: list[str] = []

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, linked, tuple(stack)))
            parts.clear()
        linked = 0

    def close(names: tuple[str, ...], barrier: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in barrier:
                return
            if stack[k][0] in names:
                flush()
                del stack[k:]
                return

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at:
            raw = page[at:end]
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:-3])
            continue
        tag = tag.lower()
        if m[1]:  # an end
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    flush()
                    del stack[k:]
                    break
            else:
                if tag == "p":
                    flush()
            continue
        if tag in SILENT:
            if tag not in INLINE and tag != "button":
                flush()
            if not m[3].endswith("/") or tag in ("script", "style", "head", "title", "textarea"):
                if tag == "head":
                    stop = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                    # a head that never ends still ends where prose may begin
                    at = (stop.end() if stop and stop[0][1] == "/" else stop.start()) if stop else at
                else:
                    stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = stop.end() if stop else size if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if tag == "a":
            links = 1
            continue
        if tag in INLINE:
            continue
        flush()
        if tag in CLOSES_P:
            close(("p",), ("table", "td", "th", "li", "div", "section", "article", "main", "body", "blockquote"))
        if tag in ENDS:
            close(*ENDS[tag])
        if tag not in VOID and not (m[3].endswith("/") and tag not in CLOSES_P):
            # names of the whole page say nothing of a block
            stack.append((tag, names_of(m[3]) if m[3] and tag not in ("html", "body") else ()))
            links = 0
    flush()
    return out


def known_label(path: tuple) -> int | None:
    """What a page itself says of the blocks of a path: content (1), not content (0), or nothing. Chrome within an article is chrome."""
    inside = None
    for tag, names in path:
        if tag in CHROME_TAGS and not (tag == "header" and inside == 1) or CHROME & set(names):
            return 0
        if tag in ARTICLE_TAGS or CONTENT & set(names):
            inside = 1
    return inside


def hashed(name: str) -> int:
    return zlib.crc32(name.encode()) % SPACE


def text_features(b: Block) -> list[str]:
    t = b.text
    n = len(t)
    words = t.count(" ") + 1
    share = b.linked / n
    return [
        f"n{min(9, n.bit_length())}", f"w{min(7, words.bit_length())}", f"l{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
        f"e{t[-1] if not t[-1].isalnum() else 'a'}", f"u{t[0].isupper()}", f"d{any(c.isdigit() for c in t[:64])}", f"s{min(3, t.count('. '))}", f"c{min(2, t.count(','))}",
        f"m{'©' in t or '·' in t or '|' in t[:200]}",
    ]


def features(page: list[Block], untold: random.Random | None = None) -> list[np.ndarray]:
    """Hashed features of each block of a page. With `untold`, in training, a third of marked blocks go without those of texts, so that marks weigh by themselves."""
    shape = [text_features(b) for b in page]
    out = []
    seen: dict[tuple, list[str]] = {}
    for i, b in enumerate(page):
        around = seen.get(b.path)
        if around is None:
            around = []
            for tag, names in b.path:
                around.append(f"t:{tag}")
                around += [f"k:{x}" for x in names]
            tags = [tag for tag, _ in b.path]
            mark = known_label(b.path)
            around += [f"p:{tags[-1] if tags else ''}", f"q:{'>'.join(tags[-2:])}", f"mark:{mark}", f"mark:{mark}{tags[-1] if tags else ''}", f"mark:{mark} again"]
            around = seen[b.path] = list(dict.fromkeys(around))
        if untold and known_label(b.path) is not None and untold.random() < 0.33:
            out.append(np.array([hashed(x) for x in (*around, "bias")], np.int64))
            continue
        mine = shape[i]
        short = mine[:3]
        names = [*around, *mine, f"x:{b.path[-1][0] if b.path else ''}{mine[0]}{mine[2]}", "bias"]
        names += [f"-{x}" for x in (shape[i - 1][:3] if i else [])] + [f"+{x}" for x in (shape[i + 1][:3] if i + 1 < len(page) else [])]
        names += [f"z:{''.join(short)}"]
        out.append(np.array([hashed(x) for x in names], np.int64))
    return out


class Field:
    """Weights [feature, label], weights of neighbouring labels [from, to], and of the first label."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, begin: np.ndarray):
        self.weights, self.moves, self.begin = weights, moves, begin

    def scores(self, feats: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(f) for f in feats])
        return np.add.reduceat(self.weights[np.concatenate(feats)], np.cumsum(size) - size, axis=0)

    def decode(self, feats: list[np.ndarray]) -> np.ndarray:
        """The labels of the best sequence; ties go to content."""
        if not feats:
            return np.zeros(0, np.int64)
        s = self.scores(feats).tolist()
        (a, b), (c, d) = self.moves.tolist()
        p, q = s[0][0] + float(self.begin[0]), s[0][1] + float(self.begin[1])
        back = []
        for x, y in s[1:]:
            from0, from1 = p + a > q + c, p + b > q + d
            back.append((0 if from0 else 1, 0 if from1 else 1))
            p, q = (p + a if from0 else q + c) + x, (p + b if from1 else q + d) + y
        out = [0 if p > q else 1]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return np.array(out[::-1])


def train(pages: list[tuple[list[np.ndarray], list[int]]], rounds: int = 70, rate: float = 0.15, decay: float = 3e-4) -> Field:
    """The field that makes the labels of the pages likeliest: gradient ascent with adaptive steps, all pages at once."""
    pages = [p for p in pages if p[0]]
    field = Field(np.zeros((SPACE, 2)), np.zeros((2, 2)), np.zeros(2))
    if not pages:
        return field
    longest, count = max(len(f) for f, _ in pages), len(pages)
    size = np.array([len(f) for f, _ in pages])
    mask = np.arange(longest) < size[:, None]
    gold = np.zeros((count, longest), np.int64)
    for i, (_, y) in enumerate(pages):
        gold[i, : len(y)] = y
    flat = [f for fs, _ in pages for f in fs]
    width = np.array([len(f) for f in flat])
    feats, used = np.unique(np.concatenate(flat), return_inverse=True)
    of = np.repeat(np.arange(len(flat)), width)
    starts = np.cumsum(width) - width
    theta = np.zeros(len(feats) * 2 + 6)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    ones = np.eye(2)
    weight = 1.0 / count
    for step in range(1, rounds + 1):
        w, moves, begin = theta[:-6].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:]
        s = np.zeros((count, longest, 2))
        s[mask] = np.add.reduceat(w[used], starts, axis=0)
        s[:, 0] += begin
        forward, behind = np.zeros_like(s), np.zeros_like(s)
        forward[:, 0] = s[:, 0]
        for t in range(1, longest):
            step_in = np.logaddexp(forward[:, t - 1, None, 0] + moves[0], forward[:, t - 1, None, 1] + moves[1]) + s[:, t]
            forward[:, t] = np.where(mask[:, t, None], step_in, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = s[:, t + 1] + behind[:, t + 1]
            step_out = np.logaddexp(moves[:, 0] + ahead[:, None, 0], moves[:, 1] + ahead[:, None, 1])
            behind[:, t] = np.where(mask[:, t + 1, None], step_out, 0.0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        at = np.exp(forward + behind - total[:, None, None]) * mask[:, :, None]
        apart = (ones[gold] * mask[:, :, None] - at)[mask]
        both = mask[:, 1:]
        pairs = np.exp(forward[:, :-1, :, None] + moves + (s + behind)[:, 1:, None, :] - total[:, None, None, None])[both].sum(axis=0)
        seen = np.zeros((2, 2))
        np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        grad = np.empty_like(theta)
        for label in (0, 1):
            grad[:-6].reshape(-1, 2)[:, label] = np.bincount(used, weights=apart[of, label], minlength=len(feats))
        grad[-6:-2] = (seen - pairs).ravel()
        grad[-2:] = (ones[gold[:, 0]] - at[:, 0]).sum(axis=0)
        grad = grad * weight - decay * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    field.weights[feats] = theta[:-6].reshape(-1, 2)
    field.moves, field.begin = theta[-6:-2].reshape(2, 2).copy(), theta[-2:].copy()
    return field


# Layouts: by part, the elements that a page may mark it with.
LAYOUTS = {
    "article": ["article", "main", "div class=content", "div class=post-content", "div class=entry-content", "div id=article-body", "section class=story", "div itemprop=articleBody", "div id=main", "div class=text", "div", "section", "div class=page"],
    "menu": ["nav", "div class=nav", "div id=menu", "ul class=menu", "div class=navbar", "div role=navigation", "div", "ul"],
    "header": ["header", "div class=header", "div id=masthead", "div class=topbar", "div"],
    "footer": ["footer", "div class=footer", "div id=footer", "div class=copyright", "div"],
    "sidebar": ["aside", "div class=sidebar", "div id=sidebar", "div class=widget", "div class=related"],
    "notice": ["div class=cookie-notice", "div id=cookie-banner", "div class=notice", "div role=dialog", "div class=consent", "div class=newsletter", "aside class=popup"],
    "advert": ["div class=ad", "div class=advert", "div class=ads", "div class=sponsored", "aside class=promo", "div id=banner-ad"],
    "form": ["form", "form class=search", "form id=login", "form class=subscribe"],
    "comments": ["section class=comments", "div id=comments", "div class=comment-list", "ol class=comments", "div id=disqus_thread", "div class=discussion"],
}


def path_of(element: str) -> tuple[str, tuple[str, ...]]:
    tag, _, rest = element.partition(" ")
    return tag, names_of(rest) if rest else ()


def layouts(content: list[Block], chrome: list[Block], prose: list[Block], rng: random.Random) -> tuple[list[Block], list[int]]:
    """A page of other marks: the content in another container, and parts of chrome and of other prose around it."""
    out: list[Block] = []
    labels: list[int] = []
    outer: tuple = (("html", ()), ("body", ()))
    unmarked = rng.random() < 0.3
    if rng.random() < 0.5:
        outer += (path_of(rng.choice(["div id=page", "div class=wrapper", "div class=container", "div"])),)

    def part(kind: str, some: list[tuple[str, int, str]]) -> None:
        path = (*outer, ("div", ()) if unmarked else path_of(rng.choice(LAYOUTS[kind])))
        if kind in ("comments", "sidebar", "form", "notice") and not unmarked and rng.random() < 0.5:
            some = [(brief(3), 0, rng.choice(["h2", "h3", "h4"])), *some]
        for text, linked, inner in some:
            if text:
                out.append(Block(text, linked, (*path, *[(t, ()) for t in inner.split()])))
                labels.append(0)

    def brief(most: int) -> str:
        words = rng.choice(prose).text.split() if prose else ["more"]
        at = rng.randrange(len(words))
        return " ".join(words[at : at + rng.randint(1, most)])

    def link_list(n: int) -> list[tuple[str, int, str]]:
        return [(t, len(t), "ul li") for t in (brief(3) for _ in range(n))]

    long = lambda: rng.choice(prose).text if prose else "more"
    if not unmarked and rng.random() < 0.4:
        part("notice", [(brief(30), 0, rng.choice(["p", "div", ""]))])
    if rng.random() < 0.7:
        part("header", [(brief(6), 0, rng.choice(["h1", "div", "p"]))] + (link_list(2) if rng.random() < 0.3 else []))
    if rng.random() < 0.85:
        part("menu", link_list(rng.randint(2, 8)))
    if rng.random() < 0.3:
        part("form", [(brief(4), 0, rng.choice(["p", "div", ""]))])
    if not unmarked and rng.random() < 0.5:
        part("advert", [(brief(25), rng.choice([0, 0, 10]), rng.choice(["", "p"]))])
    if rng.random() < 0.4:
        part("sidebar", link_list(rng.randint(1, 5)) + ([(long(), 0, "p")] if not unmarked and rng.random() < 0.5 else []))
    before = outer
    container = ("div", ()) if unmarked else path_of(rng.choice(LAYOUTS["article"]))
    extra = (path_of(rng.choice(["div", "section", "div class=row", "div class=body"])),) if rng.random() < 0.3 else ()
    for b in content:
        inner = b.path[-1][0] if b.path and b.path[-1][0] not in ("body", "html", "article", "main", "div", "section") else "p"
        if inner == "p" and rng.random() < 0.2:
            inner = rng.choice(["ul li", "ul li", "ol li", "blockquote", "h2", "table tr td", "pre"])
        some = [b.text]
        if " " in inner and rng.random() < 0.7:
            some = [brief(8) for _ in range(rng.randint(1, 5))]
        for text in some:
            out.append(Block(text, b.linked if text is b.text else 0, (*before, container, *extra, *[(t, ()) for t in inner.split()])))
            labels.append(1)
        if rng.random() < 0.02:
            nested = path_of(rng.choice(LAYOUTS[rng.choice(["advert", "sidebar", "notice"])]))
            out.append(Block(brief(25), 0, (*before, container, *extra, nested)))
            labels.append(0)
    # comments that nothing marks are told from prose by nobody
    if not unmarked and rng.random() < 0.5:
        if rng.random() < 0.4:
            outer = (*before, container)
        part("comments", [(brief(60) if rng.random() < 0.7 else long(), 0, rng.choice(["p", "div", "div p", "li p"])) for _ in range(rng.randint(1, 6))])
        outer = before
    if rng.random() < 0.3:
        part("sidebar", link_list(rng.randint(1, 5)))
    if chrome and rng.random() < 0.5:
        part("footer", [(b.text, b.linked, "p") for b in chrome[-1:]])
    else:
        part("footer", [("© " + brief(8), 0, rng.choice(["p", "", "div"]))] + (link_list(2) if rng.random() < 0.4 else []))
    if rng.random() < 0.15:  # a page of an article alone, or of its beginning
        kept = [b for b, y in zip(out, labels) if y][: rng.choice([1, 2, None])]
        return kept, [1] * len(kept)
    return out, labels


def labelled(pages: list[list[Block]], again: int = 2, seed: int = 7) -> list[tuple[list[np.ndarray], list[int]]]:
    """Training pages: those whose blocks all have labels as they are, and all in other layouts."""
    rng = random.Random(seed)
    prose = [b for page in pages for b in page if len(b.text) > 60 and b.linked == 0]
    out = []
    for page in pages:
        labels = [known_label(b.path) for b in page]
        content = [b for b, y in zip(page, labels) if y == 1]
        chrome = [b for b, y in zip(page, labels) if y == 0]
        if content and None not in labels:
            out.append((features(page, rng), labels))
        if not content:
            content = [b for b, y in zip(page, labels) if y is None and len(b.text) > 120 and b.linked * 2 < len(b.text)]
        for _ in range(again if content else 0):
            blocks_, ys = layouts(content, chrome, prose, rng)
            out.append((features(blocks_, rng), ys))
    return out


def fitted(pages: DataFrame, train_pages: int = 300) -> Field:
    """The field of a bounded sample of the pages."""
    small = pages.select("page_id", "html").where(F.octet_length("html").between(1, TRAIN_BYTES))
    some = small.orderBy(F.xxhash64("page_id", "html"), "page_id").limit(train_pages)
    # by id, so that order, and with it the layouts, follow from the rows alone
    rows = sorted((r.page_id if r.page_id is not None else -1, r.html) for r in some.collect())
    return train(labelled([blocks(h)[:TRAIN_BLOCKS] for _, h in rows]))


def extracted(pages: DataFrame, field: Field) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars by a fitted field."""
    held = pages.sparkSession.sparkContext.broadcast((field.weights, field.moves, field.begin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("htmlcrf")
        known = Field(*held.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200)
                texts = []
                for page in some.column("html").to_pylist():
                    found = blocks(page)
                    texts.append("\n\n".join(b.text for b, y in zip(found, known.decode(features(found))) if y))
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def main_text(pages: DataFrame, train_pages: int = 300) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text (content blocks joined by empty lines), n_chars."""
    return extracted(pages, fitted(pages, train_pages))
