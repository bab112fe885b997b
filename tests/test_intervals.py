"""Nested folders by a sweep, and statistics, against plain answers."""

import random

import pytest

from pathloom.operators import intervals, search, statistics


def holds(root, path):
    bare = root.rstrip("/")
    return path is not None and (path.startswith("/") if not bare else path == bare or path.startswith(bare + "/"))


@pytest.mark.parametrize("innermost", [False, True])
@pytest.mark.parametrize("sweeps,stretches", [(1, 1), (3, 7)])
def test_holder_as_plain(spark, innermost, sweeps, stretches):
    rng = random.Random(sweeps)
    names = ["a", "b", "a-b", "a.b", "é", "\x01", "A", "a b", "\U0001f600", "zz"]
    some = lambda: "/" + "/".join(rng.choice(names) for _ in range(rng.randint(1, 4)))
    folders = [(i, f"r{i}", some() + rng.choice(["", "", "/", "//"])) for i in rng.sample(range(1000), 40)]
    folders += [(2000, "top", "/") if innermost else (2000, "none", None), (2001, "empty", ""), (5, "again", folders[0][2])]
    paths = [some() for _ in range(300)] + [f[2].rstrip("/") for f in folders if f[2]] + [None, "", "/", "relative/a", "/a/b", "/a/b"]
    rows = spark.createDataFrame([(p, i, i) for i, p in enumerate(paths)], "path string, at long, sweep long")
    got = {r["sweep"]: r.root for r in intervals.holder(rows, spark.createDataFrame(folders, "ord long, value string, path string"), "root", innermost, sweeps, stretches).collect()}
    known = {}
    for ord_, value, path in sorted(folders, key=lambda f: f[0]):
        if path:
            known.setdefault(path.rstrip("/"), (ord_, value))
    for i, p in enumerate(paths):
        held = [(o, v, r) for r, (o, v) in known.items() if holds(r or "/", p)]
        want = None if not held else max(held, key=lambda h: len(h[2]))[1] if innermost else min(held)[1]
        assert got[i] == want, (p, want, got[i])
    assert len(got) == len(paths)


def test_many_roots_as_few(spark):
    rows = spark.createDataFrame([(p, False, 1, 1) for p in ("/a/x", "/a/b/y", "/ab", "/c", "/none/3/z")], "path string, is_dir boolean, mtime long, size long")
    roots = [("b", "/a/b/"), ("a", "/a"), ("late", "/a/x"), ("c", "/c")] + [(f"n{i}", f"/none/{i}") for i in range(200)]
    got = {r.path: r.bookmark for r in search.attribute(rows, roots).collect()}
    assert got == {"/a/x": "a", "/a/b/y": "b", "/c": "c", "/none/3/z": "n3"}
    assert {r.path: r.bookmark for r in search.attribute(rows, roots, outside=True).collect()} == got | {"/ab": ""}


def test_summary(spark):
    rows = [("a", v) for v in [5, 1, 1, 9, 3, None]] + [("b", v) for v in range(100)]
    got = {r.k: tuple(r)[1:] for r in statistics.summary(spark.createDataFrame(rows, "k string, v long"), "v", "k").collect()}
    assert got == {"a": (5, 1, 3, 9, 9, 9), "b": (100, 0, 49, 94, 98, 99)}
