"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are combined for each document: the likelihood of its text under byte-trigram
models of the languages; the declared (markup) language; the address suffix; and the host. How far
declarations and suffixes agree with texts is estimated from all rows by grouped counts. The host's
prior is smoothed hierarchically: host towards suffix, suffix towards the whole corpus. A document's own
text is taken out of its host's counts. Text likelihoods are tempered by length, as neighbouring
trigrams are not independent.

The trigram models are fitted on labelled rows: about `train_rows` of them, and about `language_rows` of each
language or all it has, chosen by a hash of the id (a bound on the fit alone). Every labelled language with
text gets a model. All counts, priors and decisions cover all rows. Without labelled rows every document is
undetermined. A document is rejected when it holds no letters, when its text lies below the floor of every
language (text of no known language; its confidence is among the known ones), or when no language reaches
`least` of the posterior. Null declarations, addresses and hosts are no evidence. Repeated rows are
treated row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import enter, stored

CODES = 1 << 16
#: Share of the way from a language's own text to foreign text at which text counts as foreign.
FOREIGN = 0.6


def trigram_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all byte trigrams of lower-cased letters (others count as one blank), and each text's bounds."""
    data = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    raw = np.frombuffer(b"".join(b"  " + d + b"  " for d in data), np.uint8).astype(np.uint32)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    raw = np.where(letter, raw, 32)
    code = (raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA6B) ^ raw[2:] * np.uint32(0xC2B2AE35)) if len(raw) > 2 else np.zeros(0, np.uint32)
    code = (code ^ (code >> np.uint32(15))) & np.uint32(CODES - 1)
    blank = (raw[:-2] == 32) & (raw[1:-1] == 32)
    code[blank] = CODES  # of no weight
    return np.append(code, [CODES, CODES]).astype(np.int64), np.concatenate([[0], np.cumsum([len(d) + 4 for d in data])])


def fit(rows: DataFrame, label: str, train_rows: int, language_rows: int) -> tuple[list[str], np.ndarray]:
    """Every labelled language with text and its log probabilities [language, code], from about train_rows rows, and language_rows of each language."""
    sizes = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not sizes:
        return [], np.zeros((0, CODES + 1), np.float32)
    total, names = sum(sizes.values()), sorted(sizes)
    rates = [min(1.0, max(train_rows / total, language_rows / sizes[x])) for x in names]
    # as an Arrow table, which executors read without Python: rows from a list would keep workers of their own there
    rates = rows.sparkSession.createDataFrame(pa.table({"label": pa.array(names, pa.string()), "lang": pa.array(range(len(names)), pa.int64()), "rate": pa.array(rates, pa.float64())}))
    some = rows.select("doc_id", "text", F.col(label).alias("label")).join(F.broadcast(rates), "label")
    some = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("rate") * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("langid")
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                code, at = trigram_codes(part.column("text"))
                of = part.column("lang").to_numpy()
                key, n = np.unique(np.repeat(of, np.diff(at)) * (CODES + 1) + code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key // (CODES + 1)), pa.array(key % (CODES + 1)), pa.array(n)], ["lang", "code", "n"])

    counted = some.select("text", "lang").mapInArrow(count, "lang long, code long, n long").where(F.col("code") < CODES).groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    lang, code, n = (counted.column(c).to_numpy() for c in ("lang", "code", "n"))
    with_text, lang = np.unique(lang, return_inverse=True)
    used = max(1, len(np.unique(code)))
    logs = np.zeros((len(with_text), CODES + 1), np.float32)
    for i in range(len(with_text)):
        mine = lang == i
        in_all = n[mine].sum()
        # a small sample is smoothed by a share of itself: a flat model would attract all strange text
        add = min(0.5, 0.05 * in_all / used)
        seen = np.full(CODES, add)
        seen[code[mine]] += n[mine]
        logs[i, :CODES] = np.log(seen / (in_all + add * used))
    return [names[i] for i in with_text], logs


def floors(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each language the least log likelihood a trigram at which text is taken for that language, and the spread of a trigram's.

    The floor lies FOREIGN of the way from the language's own text to the farthest other language's; with
    one language alone, to text of its trigrams in equal shares.
    """
    size = len(logs)
    codes = logs[:, :CODES]
    p = np.where(codes > codes.min(axis=1, keepdims=True) + 1e-6, np.exp(codes), 0).astype(np.float32)
    p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-30)
    under = (p @ codes.T).astype(np.float64)  # of one language's text, under another's model
    own = under.diagonal()
    spread = np.sqrt([np.float64(a @ (b - o) ** 2) for a, b, o in zip(p, codes, own)])
    far = under.min(axis=0) if size > 1 else np.array([b[a > 0].mean() if (a > 0).any() else o for a, b, o in zip(p, codes, own)])
    return own - FOREIGN * np.maximum(own - far, 2 * spread), spread


def text_evidence(rows: DataFrame, langs: list[str], logs: np.ndarray, temper: float) -> DataFrame:
    """rows with `letters`, `known` (whether any language's floor is reached) and `ll`, the tempered log likelihood by language, in place of the text."""
    held = rows.sparkSession.sparkContext.broadcast((logs, *floors(logs)))
    others = [c for c in rows.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("langid")
        logs, low, spread = held.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                code, at = trigram_codes(part.column("text"))
                n = np.add.reduceat(code < CODES, at[:-1]).astype(np.int64)
                # a text of n trigrams counts as n**temper independent ones
                weight = np.where(n > 0, np.maximum(n, 1) ** (temper - 1.0), 0)
                raw = np.stack([np.add.reduceat(row[code], at[:-1]) for row in logs], axis=1).astype(np.float64)
                some = np.maximum(n, 1)[:, None]
                # short texts vary more: two standard errors are granted
                known = (raw / some >= low - 2 * spread / some ** (temper / 2)).any(axis=1) & (n > 0)
                lists = pa.array(list(raw * weight[:, None]), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in others] + [pa.array(n), pa.array(known), lists], [*others, "letters", "known", "ll"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text") + ", letters long, known boolean, ll array<double>"
    return rows.select(*others, "text").mapInArrow(score, schema)


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def identify(docs: DataFrame, declared: str | None, host: str | None, suffix: str | None = None, label: str = "lang", train_rows: int = 20_000, language_rows: int = 200, temper: float = 0.6, least: float = 0.5, kappa: float = 5.0) -> DataFrame:
    """(doc_id, text and the named columns) -> doc_id, row_hash, lang_id, confidence, keep.

    declared, host, suffix: columns of evidence, or None; label: the column of the labelled rows that models
    are fitted on. row_hash is the hash of doc_id and text, by which rows can be matched again.
    """
    none = F.lit(None).cast("string")
    pick = lambda c: F.col(c).cast("string") if c else none
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), pick(declared).alias("declared"), pick(host).alias("host"), pick(suffix).alias("suffix"), "text")
    langs, logs = fit(docs.select("doc_id", "text", pick(label).alias("label")), "label", train_rows, language_rows)
    if not langs:
        return rows.select("doc_id", "row_hash", F.lit("und").alias("lang_id"), F.lit(0.0).alias("confidence"), F.lit(False).alias("keep"))
    ll = stored(text_evidence(rows, langs, logs, temper), "langid-evidence").withColumn("p", softmax(F.col("ll")))
    size, weight = len(langs), F.when(F.col("known"), 1.0).otherwise(0.0)
    sums = [F.sum(F.get("p", F.lit(i)) * weight).alias(f"s{i}") for i in range(size)]
    vector = F.array(*[F.col(f"s{i}") for i in range(size)])

    def table(key: str) -> DataFrame:
        return stored(ll.where(F.col(key).isNotNull()).groupBy(key).agg(*sums).select(key, vector.alias(f"{key}_n")), f"langid-{key}")

    everything = ll.agg(*sums).select(vector).first()[0] or [0.0] * size
    whole = np.array([x or 0.0 for x in everything]) + 1.0
    whole_p = F.array(*[F.lit(float(x)) for x in whole / whole.sum()])
    lang_n = F.array(*[F.lit(float(x)) for x in whole])
    zeros = F.array(*[F.lit(0.0)] * size)
    out = ll
    for key in ("declared", "suffix", "host"):
        out = out.join(table(key), key, "left")
    own = F.transform("p", lambda v: v * weight)
    less = lambda v, w: F.zip_with(v, w, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    mass = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    smooth = lambda n, up: F.zip_with(n, up, lambda a, b: (a + kappa * b) / (mass(n) + kappa))
    out = out.withColumns({f"{k}_n": F.when(F.col(f"{k}_n").isNull(), zeros).otherwise(less(F.col(f"{k}_n"), own)) for k in ("declared", "suffix", "host")})
    out = out.withColumn("suffix_p", smooth(F.col("suffix_n"), whole_p)).withColumn("prior", smooth(F.col("host_n"), F.col("suffix_p")))
    # P(declared | language), from how texts and declarations meet; no declaration, no evidence
    said = F.zip_with("declared_n", lang_n, lambda a, b: F.log((a + 0.5) / (b + 0.5)))
    fused = F.zip_with(F.zip_with("ll", "prior", lambda a, b: a + F.log(b)), F.when(F.col("declared").isNull(), zeros).otherwise(said), lambda a, b: a + b)
    out = out.withColumn("post", softmax(fused)).withColumn("confidence", F.array_max("post"))
    best = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("post", F.col("confidence")).cast("int"))
    keep = F.col("known") & (F.col("confidence") >= least)
    return out.select("doc_id", "row_hash", F.when(keep, best).otherwise("und").alias("lang_id"), "confidence", keep.alias("keep"))


def known_language(docs: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected; columns as they were."""
    bad = stored(identify(docs, **options).where("not keep").select(F.col("row_hash").alias("_rejected")).distinct(), "langid-rejected")
    return docs.join(bad, F.xxhash64("doc_id", "text") == F.col("_rejected"), "left_anti")


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) as doc_id, text (tags taken out), declared, host and suffix."""
    html = F.coalesce("html", F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&\w+;", " ")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    said = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select(F.col("page_id").alias("doc_id"), plain.alias("text"), blank(said).alias("declared"), blank(host).alias("host"), blank(F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"))
