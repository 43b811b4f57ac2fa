"""Removal of repeated passages by winnowing over line hashes. DataFrame functions only.

Blank lines aside, a document is a sequence of line hashes. A gram is the shortest run of lines from a line
on that holds `gram_words` words; a window is the shortest run that holds `min_words`. Of the grams
inside each window the one with the smallest hash is selected, so two documents that share a run of at
least `min_words` words share a selected gram. A selected gram's occurrences are joined with its first
occurrence (by doc_id, then position), alone and together with the line before or the gram after; a later
occurrence within one document is joined with the one before it. The first occurrence of a gram may stand
in a document that shares too few words, so each line's whole window is a fingerprint as well: places that
share one share a run of `min_words` words, and none but its first occurrence stays. Each such alignment is
extended over equal lines both ways; a run of at least `min_words` words goes from the later place, the
earlier stays.

Lines are compared without blanks at their ends. Null texts pass unchanged. Rows with equal doc_id and text
are one document and stay as equal rows; rows with equal doc_id and other texts are told apart. Null
doc_ids come first. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.llm.common import stored


def line_table(docs: DataFrame) -> DataFrame:
    """k (doc_id and hash of the text), n (index among lines with words), pos, h, w (words), c (words before), t (words in all)."""
    line = F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(F.trim(x)).alias("h"), F.regexp_count(x, F.lit(r"\S+")).alias("w")))
    rows = docs.where("text is not null").select(F.struct(F.col("doc_id"), F.xxhash64("text").alias("x")).alias("k"), line.alias("ls"))
    one = rows.groupBy("k").agg(F.first("ls").alias("ls"))
    flat = one.select("k", F.posexplode("ls").alias("pos", "l")).where("l.w > 0").select("k", "pos", "l.h", "l.w")
    by = Window.partitionBy("k").orderBy("pos")
    before = F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    return flat.select("k", "pos", "h", "w", F.row_number().over(by).alias("n"), before.alias("c"), F.sum("w").over(Window.partitionBy("k")).alias("t"), F.lag("pos").over(by).alias("prev_pos"), F.lag("h").over(by).alias("prev_h"))


def fingerprints(lines: DataFrame, min_words: int, gram_words: int) -> DataFrame:
    """k, n, key: the selected grams, each under up to three keys, and the whole window from each line."""
    by = Window.partitionBy("k").orderBy("c")
    whole = F.col("c") + gram_words <= F.col("t")
    gram = F.when(whole, F.xxhash64(F.collect_list("h").over(by.rangeBetween(0, gram_words - 1))))
    window = F.when(F.col("c") + min_words <= F.col("t"), F.xxhash64(F.collect_list("h").over(by.rangeBetween(0, min_words - 1)), F.lit(3)))
    grams = lines.select("k", "n", "c", "t", "prev_h", gram.alias("g"), window.alias("window"))
    grams = grams.withColumn("next_g", F.lead("g").over(by))
    least = F.min(F.when(F.col("g").isNotNull(), F.struct("g", "n", "prev_h", "next_g"))).over(by.rangeBetween(0, min_words - gram_words))
    found = grams.select("k", "n", "c", "window", least.alias("s"))
    # selected places only move forward, so each is new once
    fresh = F.coalesce(F.lag("s.n").over(by) != F.col("s.n"), F.lit(True))
    keys = [F.col("s.g"), F.xxhash64("s.g", "s.prev_h", F.lit(1)), F.xxhash64("s.g", "s.next_g", F.lit(2))]
    own = F.struct("n", F.col("window").alias("key"))
    picked = [F.struct(F.col("s.n").alias("n"), key.alias("key")) for key in keys]
    found = found.withColumn("fresh", fresh).where("window is not null")
    return found.select("k", F.explode(F.when(F.col("fresh"), F.array(own, *picked)).otherwise(F.array(own))).alias("p")).select("k", "p.*")


def repeated_lines(docs: DataFrame, min_words: int = 50, gram_words: int = 25) -> DataFrame:
    """k, positions: for each document the positions of the lines to delete."""
    lines = stored(line_table(docs), "winnow-lines")
    prints = stored(fingerprints(lines, min_words, gram_words), "winnow-prints")
    in_doc = Window.partitionBy("k", "key").orderBy("n")
    seen = prints.withColumn("before", F.lag("n").over(in_doc))
    own = seen.where("before is not null").select("k", F.col("k").alias("ok"), (F.col("n") - F.col("before")).alias("d"))
    heads = seen.where("before is null").select("k", "n", "key")
    first = stored(heads.groupBy("key").agg(F.min(F.struct("k", "n")).alias("o"), F.count("*").alias("c")).where("c > 1").select("key", "o"), "winnow-first")
    cross = heads.join(first, "key").where("k != o.k").select("k", F.col("o.k").alias("ok"), (F.col("n") - F.col("o.n")).alias("d"))
    aligned = stored(own.unionByName(cross).distinct(), "winnow-aligned")

    mine = aligned.join(lines.select("k", "n", "h", "w", "pos", "prev_pos"), "k").withColumn("on", F.col("n") - F.col("d"))
    theirs = lines.select(F.col("k").alias("ok"), F.col("n").alias("on"), F.col("h").alias("oh"))
    equal = mine.join(theirs, ["ok", "on"]).where("h = oh")
    run = Window.partitionBy("k", "ok", "d").orderBy("n")
    islands = equal.withColumn("run", F.col("n") - F.row_number().over(run))
    same = Window.partitionBy("k", "ok", "d", "run")
    gone = islands.withColumns({"words": F.sum("w").over(same), "start": F.min("n").over(same)}).where(F.col("words") >= min_words)
    places = F.when(F.col("n") > F.col("start"), F.sequence(F.col("prev_pos") + 1, "pos")).otherwise(F.array("pos"))
    return gone.select("k", F.explode(places).alias("pos")).distinct().groupBy("k").agg(F.collect_list("pos").alias("positions"))


def dedup_lines(docs: DataFrame, min_words: int = 50, gram_words: int = 25, removed: str | None = None) -> DataFrame:
    """The documents without later repeated runs. removed: name of a column to add, the number of lines deleted."""
    gone = stored(repeated_lines(docs, min_words, gram_words), "winnow-gone")
    keyed = docs.withColumn("_winnow_k", F.struct(F.col("doc_id"), F.xxhash64("text").alias("x")))
    # the deletions grow with the documents: one plan at every size, without a broadcast that only small inputs get
    joined = keyed.hint("merge").join(gone.select(F.col("k").alias("_winnow_k"), F.col("positions").alias("_winnow_gone")), "_winnow_k", "left")
    parts = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_winnow_gone")
    text = F.when(F.col("_winnow_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    out = joined.withColumn("text", text)
    if removed:
        out = out.withColumn(removed, F.coalesce(F.size("_winnow_gone"), F.lit(0)).cast("long"))
    return out.select(*docs.columns, *[removed] * bool(removed))
