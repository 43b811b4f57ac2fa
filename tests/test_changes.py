"""Closures, purges and settled conflicts against brute force."""

import random

import pytest

from heronlake.operators import closure, resolve
from heronlake.plans.scratch import folder

ARTIFACTS = "artifact_id long, session_uid string, kind string, relpath string, sha256 string, size long, relation string, current boolean"


def reached(roots, edges):
    seen, todo = set(), [r for r in roots if r is not None]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += [b for a, b in edges if a == n and b is not None]
    return seen


@pytest.mark.parametrize("seed,nodes,edges", [(1, 30, 40), (2, 30, 12), (3, 12, 60)])
def test_reachable_random_graphs_with_cycles(spark, monkeypatch, seed, nodes, edges):
    monkeypatch.setattr(closure, "ROUNDS", 2)
    rng = random.Random(seed)
    name = lambda: f"n{rng.randrange(nodes)}"
    graph = [(name(), name()) for _ in range(edges)] + [("n0", "n1"), ("n1", "n0"), ("n2", "n2"), ("n3", None), (None, "n4")]
    roots = [("s", name()) for _ in range(2)] + [("s", None), ("s", "n0"), ("t", name()), ("u", "absent"), ("u", "absent")]
    e = spark.createDataFrame(graph, "node string, reads string").coalesce(1)
    r = spark.createDataFrame(roots, "owner string, node string").coalesce(1)
    got = sorted(map(tuple, closure.reachable(r, e, by=["owner"]).collect()))
    assert got == sorted((o, n) for o in "stu" for n in reached([x for p, x in roots if p == o], graph))
    plan = closure.purge(r.withColumnRenamed("node", "sha256"), e, "owner", "s").collect()
    mine, keep = (reached([x for p, x in roots if (p == "s") == own], graph) for own in (True, False))
    assert sorted(map(tuple, plan)) == sorted((n, n in keep) for n in mine)


def test_reachable_of_nothing(spark):
    none = spark.createDataFrame([], "node string, reads string")
    assert closure.reachable(none.select("node"), none).count() == 0
    assert [r.node for r in closure.reachable(spark.createDataFrame([("a",)], "node string"), none).collect()] == ["a"]


def test_extensions_are_prefixes(spark):
    rng = random.Random(5)
    base = bytes(rng.randrange(256) for _ in range(40))
    blobs = {f"b{n}": base[:n] for n in (0, 1, 7, 8, 9, 16, 17, 39, 40)}
    blobs |= {f"c{n}": base[:n] + b"?" + base[n + 1 :] for n in (0, 7, 8, 15, 31, 39)}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in blobs.items()], "sha256 string, content binary").coalesce(2)
    pairs = spark.createDataFrame([(a, b) for a in blobs for b in blobs], "longer string, shorter string").coalesce(2)
    got = {tuple(r) for r in resolve.extensions(pairs, resolve.block_table(rows, size=8)).collect()}
    assert got == {(a, b) for a in blobs for b in blobs if blobs[a].startswith(blobs[b])}


def setting(spark):
    """Session s: head h1 at main.jsonl, four copies of it at the same path; t: a head at a path that another file's copies share."""
    text = {"h1": b"one two", "c1": b"one two three four", "c2": b"one two thr", "c3": b"one other", "c4": b"one two three four", "t1": b"tt", "t2": b"tt more", "x": b"x"}
    a = [
        (1, "s", "transcript", "main.jsonl", "h1", 7, "unchanged", True), (2, "s", "transcript", "main.jsonl", "c1", 18, "divergent_copy", False), (3, "s", "transcript", "main.jsonl", "c2", 11, "divergent_copy", False),
        (4, "s", "transcript", "main.jsonl", "c3", 9, "divergent_copy", False), (5, "s", "transcript", "main.jsonl", "c4", 18, "divergent_copy", False), (6, "s", "transcript", "main/subagents/a.jsonl", "x", 1, "divergent_copy", False),
        (7, "s", "notes", "other.txt", "x", 1, "divergent_copy", False), (8, "s", "cursor_state", "state.json", "x", 1, "divergent_copy", False),
        (20, "t", "transcript", "b.jsonl", "t1", 2, "unchanged", True), (21, "t", "transcript", "moved.jsonl", "t2", 7, "divergent_copy", False), (22, "t", "transcript", "moved.jsonl", "x", 1, "grown_from", True), (23, "t", "transcript", "c.jsonl", "x", 1, "unchanged", True),
    ]
    state = resolve.State(
        spark.createDataFrame(a, ARTIFACTS).coalesce(1), spark.createDataFrame([("s", "h1", 4), ("t", "t1", 1)], "session_uid string, head_sha256 string, gen long"),
        spark.createDataFrame([(3, "kept_head")], "artifact_id long, resolution string"), spark.createDataFrame([], resolve.HEAD_LOG),
    )
    blocks = resolve.block_table(spark.createDataFrame([(k, bytearray(v)) for k, v in text.items()], "sha256 string, content binary").coalesce(1), size=4)
    return state, blocks


def decided(spark, state, blocks, *rows):
    return resolve.decide(state, spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "artifact_id long, action string, expect_head string, at_ns long").coalesce(1), blocks)


@pytest.mark.parametrize(
    "decision,outcome",
    [((2, "made_head", "h1"), "done"), ((2, "made_head", "h0"), "head_moved"), ((2, "made_head", None), "head_moved"), ((3, "made_head", "h1"), "resolved"), ((1, "kept_head", None), "no_conflict"), ((99, "kept_head", None), "no_conflict"),
     ((6, "made_head", "h1"), "not_candidate"), ((7, "made_head", "h1"), "not_candidate"), ((8, "made_head", "h1"), "not_candidate"), ((4, "not_a_conflict", None), "done"), ((3, "kept_head", None), "resolved"), ((3, "reopen", None), "done"),
     ((4, "reopen", None), "open"), ((4, "dropped", None), "unknown_action")],
)
def test_outcomes(spark, decision, outcome):
    state, blocks = setting(spark)
    assert [tuple(r) for r in decided(spark, state, blocks, decision).outcomes.collect()] == [(*decision[:2], outcome)]


def test_made_head_supersedes_and_is_published_once(spark):
    state, blocks = setting(spark)
    root = folder(spark, "conflicts")
    resolve.publish(spark, root, "start", state)
    batch = spark.createDataFrame([(2, "made_head", "h1", 10), (4, "kept_head", None, 11), (21, "made_head", "t1", 12)], "artifact_id long, action string, expect_head string, at_ns long")
    made = resolve.apply(spark, root, "one", batch, blocks)
    assert made["version"] == 2
    for _ in range(2):  # replayed
        assert resolve.apply(spark, root, "one", batch, blocks) == made
    now = resolve.load(spark, root)
    # 5 has the same bytes and 3 was settled before; 4 waits, as one decision a session counts
    assert sorted(map(tuple, now.resolutions.collect())) == [(2, "made_head"), (3, "kept_head"), (5, "superseded"), (21, "made_head")]
    assert sorted(map(tuple, now.sessions.collect())) == [("s", "c1", 5), ("t", "t2", 2)]
    # of t neither the old head nor what was current at the copy's path stays so
    assert sorted(r.artifact_id for r in now.artifacts.where("current").collect()) == [2, 21, 23]
    assert sorted(map(tuple, now.log.collect())) == [("s", 2, "h1", "c1", 18, 10), ("t", 21, "t1", "t2", 7, 12)]
    assert now.artifacts.count() == state.artifacts.count()
    # the copy that is the head now cannot be reopened, the superseded one can
    again = decided(spark, now, blocks, (2, "reopen", None))
    assert [r.outcome for r in again.outcomes.collect()] == ["is_head"]
    opened = decided(spark, now, blocks, (5, "reopen", None))
    assert sorted(map(tuple, opened.state.resolutions.collect())) == [(2, "made_head"), (3, "kept_head"), (21, "made_head")]
    # a session that nothing decides stays as it was
    none = resolve.decide(now, batch.limit(0), blocks)
    assert none.outcomes.count() == 0 and sorted(map(tuple, none.state.sessions.collect())) == sorted(map(tuple, now.sessions.collect()))
