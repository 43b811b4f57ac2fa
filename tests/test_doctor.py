"""Rule containment against all pairs, and every code of the doctor."""

import random

import pytest

from heronlake.operators import doctor, rules

FIELDS = ", ".join(f"{f} string" for f in rules.FIELDS)


def table(spark, rows):
    return spark.createDataFrame([(i, *(r.get(f) for f in rules.FIELDS)) for i, r in rows], f"rule_id long, {FIELDS}").coalesce(1)


def below(value, root):
    return value is not None and (value == root or value.startswith(root.rstrip("/") + "/"))


def covers(wide, narrow):
    tests = {"cwd_prefix": lambda w: below(narrow.get("cwd_prefix"), w), "cwd_glob": lambda w: narrow.get("cwd_glob") == w, "cwd_hash": lambda w: (narrow.get("cwd_hash") or "").lower() == w.lower(), "remote": lambda w: narrow.get("remote") == w, "remote_prefix": lambda w: below(narrow.get("remote_prefix") or narrow.get("remote"), w)}
    return bool(wide) and all(tests[f](v) for f, v in wide.items())


@pytest.mark.parametrize("seed", range(3))
def test_containment_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    path = lambda: "/" + "/".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) + rng.choice(["", "", "/"])
    repo = lambda n: "/".join(["h", *(rng.choice("xyz") for _ in range(n))])
    made = {"cwd_prefix": path, "cwd_glob": lambda: rng.choice(["/a/*", "/b*"]), "cwd_hash": lambda: rng.choice(["AB", "ab", "cd"]), "remote": lambda: repo(2), "remote_prefix": lambda: repo(rng.randint(0, 2))}
    some = [(i, {f: made[f]() for f in rng.sample(list(made), rng.choice([0, 1, 1, 1, 2, 2, 3]))}) for i in range(90)]
    t = table(spark, some)
    want = sorted((i, j) for i, a in some for j, b in some if i != j and covers(b, a))
    assert sorted(map(tuple, doctor.within(t, t).collect())) == want
    assert sorted(map(tuple, rules.covers(t).collect())) == want


def findings(spark, allow, deny=(), projects=(), pending=(), unlisted=(), **options):
    frame = lambda rows: spark.createDataFrame(list(rows), "project_cwd string, project_remote string").coalesce(1)
    out = doctor.examine(table(spark, list(enumerate(allow))), table(spark, list(enumerate(deny))), frame(projects), frame(pending), spark.createDataFrame([(u,) for u in unlisted], "machine_id string"), **options)
    return {(r.code, r.rule_id, r.by_rule, r.group, r.n) for r in out.collect()}


def test_first_finding_of_a_rule(spark):
    p = lambda c: {"cwd_prefix": c}
    allow = [p("/srv/a"), p("/srv/a/b"), p("/srv/a/"), p("/srv/d/x"), p("/"), p("/home/me"), p("/root"), p("/opt"), {"remote_prefix": "host"}, p("/tmp/t"), p("/x/tmp.AbC123/y"), p("/srv/seen"), p("/srv/none"), {"cwd_prefix": "/srv/z", "remote": "h/o/r"}, {}]
    got = findings(spark, [a for a in allow if a != p("/")], [p("/srv/d")], [("/srv/seen/in", "")])
    by_rule = {r: (c, b) for c, r, b, _, _ in got if r is not None}
    assert by_rule == {1: ("covered", 0), 2: ("covered", 0), 0: ("unmatched", None), 3: ("shadowed", 0), 4: ("home_folder", None), 5: ("home_folder", None), 6: ("broad_folder", None), 7: ("host_wide", None), 8: ("temporary", None), 9: ("temporary", None), 11: ("unmatched", None), 12: ("unmatched", None), 13: ("unmatched", None)}
    assert ("home_folder", 0, None, None, None) in findings(spark, [p("/")])


def test_folds_groups_and_limits(spark):
    p = lambda c: {"cwd_prefix": c}
    allow = [p(f"/srv/w/{x}/in") for x in "abc"] + [p(f"/home/me/{x}") for x in "abc"] + [p(f"/srv/two/{x}") for x in "ab"] + [{"remote": f"h/o/{x}"} for x in "abc"] + [{"remote": f"h/p/{x}"} for x in "abc"] + [{"remote_prefix": "h/p"}]
    pending = [(f"/work/q/{i}", "") for i in range(4)] + [("/elsewhere", f"h/new/{i}") for i in range(3)] + [("/e", f"h/p/{i}") for i in range(5)] + [(f"/home/x{i}", None) for i in range(4)]
    got = {x[0]: x for x in findings(spark, allow, pending=pending, unlisted=["m1", "m2"], cap=20) if x[1] is None and x[0] != "review_group"}
    assert got == {"folder_fold": ("folder_fold", None, None, "/srv/w", 3), "owner_fold": ("owner_fold", None, None, "h/o", 3), "near_cap": ("near_cap", None, None, None, 15), "unlisted_devices": ("unlisted_devices", None, None, None, 2)}
    assert {x[3:] for x in findings(spark, allow, pending=pending) if x[0] == "review_group"} == {("/work/q", 4), ("h/new", 3)}
    assert ("at_cap", None, None, None, 15) in findings(spark, allow, cap=15)
    assert findings(spark, []) == set()
