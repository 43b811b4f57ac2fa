"""Settling divergent copies: made the head, kept apart, reopened; copies that a new head extends are superseded.

Decisions change artifacts, resolutions, sessions and the log of heads together. `decide` computes the state after a
batch of decisions; `apply` publishes it as one version, once for each batch id.

Whether one blob's bytes begin another's is told by digests: a blob is cut into blocks, each with the digest of the
digest before it and its own bytes, so equal digests of two blocks mean equal bytes up to there. Only the last, partial
block of the shorter blob is compared with the longer one's block as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronlake.sources.manifest import Tables

BLOCK = 1 << 16
HEAD_LOG = "session_uid string, artifact_id long, old_sha256 string, new_sha256 string, new_size long, at_ns long"
# Kinds of files that can be a session's head.
HEAD_KINDS = ("transcript", "cursor_state", "cursor_cli_store", "opencode_export")
ACTIONS = ("made_head", "kept_head", "not_a_conflict", "reopen")


class State(NamedTuple):
    """artifacts: artifact_id, session_uid, kind, relpath, sha256, size, relation, current; sessions: session_uid, head_sha256
    and others; resolutions: artifact_id, resolution; log: HEAD_LOG."""

    artifacts: DataFrame
    sessions: DataFrame
    resolutions: DataFrame
    log: DataFrame


class Decided(NamedTuple):
    outcomes: DataFrame
    state: State


def block_table(blobs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(sha256, content binary) -> sha256, n, chain, bytes, full: blocks in order with chained digests. An empty blob has one empty block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, content in zip(batch.column("sha256").to_pylist(), batch.column("content").to_pylist()):
                chain, rows = b"", []
                for n, at in enumerate(range(0, max(1, len(content or b"")), size)):
                    part = (content or b"")[at : at + size]
                    chain = hashlib.sha256(chain + part).digest()
                    rows.append((sha, n, chain, part, len(part) == size))
                types = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["sha256", "n", "chain", "bytes", "full"])

    return blobs.select("sha256", "content").mapInArrow(run, "sha256 string, n long, chain binary, bytes binary, full boolean")


def extensions(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Those pairs (longer, shorter) of digests of which the longer blob begins with the shorter one's bytes; equal blobs too."""
    last = blocks.groupBy("sha256").agg(F.max("n").alias("n")).join(blocks, ["sha256", "n"]).select(F.col("sha256").alias("shorter"), F.col("n").alias("_n"), F.col("bytes").alias("_tail"))
    before = blocks.where("full").select(F.col("sha256").alias("shorter"), F.col("n").alias("_b"), F.col("chain").alias("_chain"))
    asked = pairs.select("longer", "shorter").distinct().join(last, "shorter")
    first = asked.where("_n = 0")
    # the blocks before the last must agree, which the digest of the one before it tells
    rest = asked.where("_n > 0").withColumn("_b", F.col("_n") - 1).join(before, ["shorter", "_b"])
    same = blocks.where("full").select(F.col("sha256").alias("longer"), F.col("n").alias("_b"), F.col("chain").alias("_chain"))
    agreed = rest.join(same, ["longer", "_b", "_chain"], "left_semi").select(first.columns).unionByName(first)
    ends = blocks.select(F.col("sha256").alias("longer"), F.col("n").alias("_n"), F.col("bytes").alias("_other"))
    return agreed.join(ends, ["longer", "_n"]).where(F.startswith("_other", "_tail")).select("longer", "shorter")


def below(path: Column, head: Column) -> Column:
    """Whether a path lies in the folder that belongs to a file, as a subagent's transcript does."""
    return F.coalesce(F.startswith(path, F.concat(F.regexp_replace(head, r"\.[^./]*$", ""), F.lit("/"))), F.lit(False))


def decide(state: State, decisions: DataFrame, blocks: DataFrame) -> Decided:
    """The outcome of each decision, and the state with those that are done.

    decisions: artifact_id, action (made_head, kept_head, not_a_conflict or reopen), expect_head (the head that the
    one who decides has seen; for made_head), at_ns. Of several decisions on a session the earliest counts, the others
    wait (outcome `waits`) for the next batch. Outcomes: done, waits, no_conflict (not a divergent copy), resolved
    (settled before), open (nothing to reopen), is_head (reopen of what is the head now), head_moved, not_candidate
    (a kind that is no head, another kind than the head, or a companion of it), unknown_action.
    """
    a, s = state.artifacts, state.sessions
    heads = a.where("current").join(s.select("session_uid", F.col("head_sha256").alias("sha256")), ["session_uid", "sha256"])
    head_row = heads.groupBy("session_uid").agg(F.min(F.struct("relpath", "artifact_id", "kind")).alias("_head"))
    copies = a.where("relation = 'divergent_copy'").select("artifact_id", "session_uid", "kind", "relpath", "sha256", "size", "current")
    asked = decisions.select("artifact_id", "action", "expect_head", "at_ns").distinct()
    j = asked.join(copies, "artifact_id", "left").join(s.select("session_uid", "head_sha256"), "session_uid", "left").join(head_row, "session_uid", "left")
    j = j.join(state.resolutions.select("artifact_id", F.lit(True).alias("_settled")), "artifact_id", "left").withColumn("_settled", F.col("_settled").isNotNull())
    nth = F.row_number().over(Window.partitionBy("session_uid").orderBy("at_ns", "artifact_id", "action"))
    is_head = F.col("current") & (F.col("sha256") == F.col("head_sha256"))
    candidate = F.col("kind").isin(*HEAD_KINDS) & (F.col("_head").isNull() | (F.col("_head.kind") == F.col("kind")) & ~below(F.col("relpath"), F.col("_head.relpath")))
    outcome = (
        F.when(~F.col("action").isin(*ACTIONS), "unknown_action").when(F.col("session_uid").isNull(), "no_conflict").when(F.col("_nth") > 1, "waits")
        .when(F.col("action") == "reopen", F.when(is_head, "is_head").when(~F.col("_settled"), "open").otherwise("done"))
        .when(F.col("_settled"), "resolved").when(F.col("action") != "made_head", "done")
        .when(~F.coalesce(F.col("head_sha256") == F.col("expect_head"), F.lit(False)), "head_moved").when(~candidate, "not_candidate").otherwise("done")
    )
    told = j.withColumn("_nth", nth).withColumn("outcome", outcome)
    done = told.where("outcome = 'done'")
    made = done.where("action = 'made_head'").select("session_uid", F.col("artifact_id").alias("made"), F.col("relpath").alias("made_path"), F.col("sha256").alias("made_sha"), F.col("size").alias("made_size"), F.col("head_sha256").alias("old_sha256"), F.col("_head.relpath").alias("head_path"), "at_ns")

    # at the copy's path and the old head's path nothing else stays current
    moved = a.join(made.select("session_uid", "made", "made_path", "head_path"), "session_uid", "left")
    touched = F.coalesce((F.col("relpath") == F.col("made_path")) | (F.col("relpath") == F.col("head_path")), F.lit(False))
    current = F.when(F.col("artifact_id") == F.col("made"), True).when(touched, False).otherwise(F.col("current"))
    artifacts = moved.withColumn("current", current).select(*a.columns)
    new_head = made.select("session_uid", "made_sha")
    sessions = s.join(new_head, "session_uid", "left").withColumn("head_sha256", F.coalesce("made_sha", "head_sha256"))
    if "gen" in s.columns:  # the session is to be read anew
        sessions = sessions.withColumn("gen", F.col("gen") + F.col("made_sha").isNotNull().cast("int"))
    sessions = sessions.select(*s.columns)

    others = copies.join(made, "session_uid").where("relpath = made_path and artifact_id <> made").join(state.resolutions, "artifact_id", "left_anti")
    extended = extensions(others.select(F.col("made_sha").alias("longer"), F.col("sha256").alias("shorter")), blocks)
    superseded = others.join(extended, (F.col("longer") == F.col("made_sha")) & (F.col("shorter") == F.col("sha256")), "left_semi").select("artifact_id", F.lit("superseded").alias("resolution"))
    settled = done.where("action <> 'reopen'").select("artifact_id", F.col("action").alias("resolution")).unionByName(superseded)
    reopened = done.where("action = 'reopen'").select("artifact_id")
    kept = state.resolutions.join(reopened, "artifact_id", "left_anti").select("artifact_id", "resolution")
    change = made.select("session_uid", F.col("made").alias("artifact_id"), "old_sha256", F.col("made_sha").alias("new_sha256"), F.col("made_size").alias("new_size"), "at_ns")
    return Decided(told.select("artifact_id", "action", "outcome"), State(artifacts, sessions, kept.unionByName(settled), state.log.unionByName(change)))


def publish(spark: SparkSession, root: str, batch: str, state: State) -> dict:
    """Write all tables of a state as one version."""

    def write(folder: str, before: dict) -> dict:
        for name, df in state._asdict().items():
            df.write.parquet(f"{root}/{folder}/{name}")
        return {"tables": {name: [f"{folder}/{name}"] for name in state._fields}}

    return Tables(spark, root).publish(batch, write)


def load(spark: SparkSession, root: str, version: int | None = None) -> State:
    tables = Tables(spark, root)
    return State(*(tables.read(name, version) for name in State._fields))


def apply(spark: SparkSession, root: str, batch: str, decisions: DataFrame, blocks: DataFrame) -> dict:
    """Publish the state after a batch of decisions. A batch that is published already changes nothing."""
    tables = Tables(spark, root)
    if batch in tables.manifest()["batches"]:
        return tables.manifest()
    return publish(spark, root, batch, decide(load(spark, root), decisions, blocks).state)
