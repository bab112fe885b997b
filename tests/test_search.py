"""The compiled column against a plain predicate, and searches from end to end."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pathloom.operators import index, search
from pathloom.plans import compile as plan
from pathloom.plans import patterns
from pathloom.plans.language import FOLDERS, FUZZY, GLOB, REGEX, parse

ROWS = "path string, is_dir boolean, mtime long, size long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain(q, path, is_dir):
    name = path.rsplit("/", 1)[-1]
    dotted = name.rfind(".") > 0
    ext, stem = (name.rsplit(".", 1)[1], name.rsplit(".", 1)[0]) if dotted else (None, name)
    if q.kind == FOLDERS and not is_dir:
        return False
    if q.extension is not None and (ext is None or ext.lower() != q.extension.lower()):
        return False
    low = path.lower()
    if q.segments:
        at = 0
        for part in low.split("/")[:-1]:
            if at < len(q.segments) - 1 and q.segments[at].lower() in part:
                at += 1
        if at < len(q.segments) - 1 or q.segments[-1].lower() not in name.lower():
            return False
    if q.mode == REGEX:
        return re.search(q.text, path, re.I) is not None
    if q.mode == GLOB:
        r = re.compile(patterns.glob_regex(f"*{q.text}*"))
        return bool(r.match(name) or r.match(path))
    if q.mode == FUZZY:
        t, s, d = q.text.lower(), stem.lower(), q.distance
        if t in name.lower():
            return True
        if len(t) >= len(s):
            return distance(t, s) <= d
        return any(distance(t, s[i : i + w]) <= d for w in range(len(t) - d, min(len(t) + d, len(s)) + 1) for i in range(len(s) - w + 1))
    return q.text.lower() in (name.lower() if q.kind == FOLDERS else low)


def test_columns_as_plain_predicate(spark):
    rng = random.Random(12)
    words = ["src", "Config", "main", "été", "DOC", "a.b", ".hidden", "x", "target", "gear_1", "a.", "README"]
    exts = ["", ".md", ".RS", ".tar.gz", "."]
    rows = {"/" + "/".join(rng.choice(words) for _ in range(rng.randint(1, 4))) + rng.choice(exts): rng.random() < 0.3 for _ in range(250)}
    lines = ["", "config", "CONFIG *.md", "folder:src", "src/main", "a/b/x", "~confg", "~maen", "~readmee", "~geer_1", "/^/src.*md$", "/ÉTÉ", "m?in", "*a*[0-9]", "été", "*.gz", "~x", "x y", "src/é"]
    lines += [f"{rng.choice(['', '~', 'folder:', '/'])}{rng.choice(words).lower().strip('.')[:rng.randint(1, 6)]}{rng.choice(['', ' *.md', '/x'])}" for _ in range(40)]
    lines = list(dict.fromkeys(lines))
    catalog = spark.createDataFrame([(p, d, 0, 0) for p, d in rows.items()], ROWS)
    got = catalog.select("path", *(plan.row_filter(parse(line)).alias(f"q{i}") for i, line in enumerate(lines))).collect()
    for r in got:
        for i, line in enumerate(lines):
            assert r[f"q{i}"] == plain(parse(line), r.path, rows[r.path]), (line, r.path)
    numbered = catalog.withColumn("id", F.xxhash64("path"))
    postings = index.postings(numbered).cache()
    for line in lines[:19]:
        want = {p for p, d in rows.items() if plain(parse(line), p, d)}
        assert {r.path for r in index.search_indexed(numbered, postings, line).collect()} == want, line


@pytest.fixture(scope="module")
def small(spark):
    rows = [("/pool/photos/one.txt", False, 10, 5), ("/pool/photos-raw/two.txt", False, 20, 1), ("/pool/photos", True, 5, 0), ("/pool/photos/sub/File.md", False, 10, 9), ("/home/x.txt", False, 1, 2)]
    return spark.createDataFrame(rows, ROWS)


def test_scope_stops_at_names(small):
    got = search.search_all(small, "", [("d", "/pool/photos/")]).collect()
    assert [r.path for r in got] == ["/pool/photos/one.txt", "/pool/photos/sub/File.md", "/pool/photos"]
    assert [r["rank"] for r in got] == [1, 2, 3] and {r.bookmark for r in got} == {"d"}
    assert search.search_root(small, "", "").count() == 5
    assert search.search_all(small, "", [("none", "")]).count() == 0
    assert search.search_all(small, "", [("all", "/")]).count() == 5


def test_first_root_names_the_row(small):
    got = {r.path: r.bookmark for r in search.search_all(small, "", [("sub", "/pool/photos/sub"), ("pool", "/pool")]).collect()}
    assert got["/pool/photos/sub/File.md"] == "sub" and got["/pool/photos/one.txt"] == "pool" and "/home/x.txt" not in got


def test_cut_and_sorts(small):
    roots = [("all", "/")]
    assert [r.path for r in search.search_all(small, "*.txt", roots, most=2).collect()] == ["/pool/photos-raw/two.txt", "/pool/photos/one.txt"]
    names = lambda sort: [r.path.rsplit("/", 1)[1] for r in search.search_all(small, parse("", sort), roots).collect()]
    assert names(2) == ["File.md", "one.txt", "photos", "two.txt", "x.txt"] and names(3) == names(2)[::-1]
    assert names(4)[0] == "File.md" and names(5)[0] == "photos" and names(1)[0] == "x.txt"


def test_frecency_order(spark, small):
    access = spark.createDataFrame([("/home/x.txt", 3, 900), ("/pool/photos/one.txt", 40, -10_000_000), ("/gone", 9, 900)], "file string, open_count long, last_opened long")
    got = search.search_all(small, parse("*.txt", 7), [("all", "/")], access=access, now=1000).collect()
    assert [r.path for r in got] == ["/home/x.txt", "/pool/photos/one.txt", "/pool/photos-raw/two.txt"]


def test_tagged_search(spark, small):
    entries = spark.createDataFrame([("/pool/photos", "one.txt", ["paid", "old invoice"]), ("/pool/photos", "gone.txt", ["paid"]), ("/home", "x.txt", ["Paid twice"])], "root string, rel string, tags array<string>")
    find = lambda line: {(r.path, r.bookmark) for r in search.search_tagged(entries, small, line, [("d", "/pool/photos")]).collect()}
    assert find("t:paid") == {("/pool/photos/one.txt", "d"), ("/home/x.txt", "")}
    assert find("t:paid&old") == {("/pool/photos/one.txt", "d")}
    assert find("t:") == find("t:paid") and find("folder: t:paid") == set() and find("one t:paid") == {("/pool/photos/one.txt", "d")}


def test_requests(small):
    assert [r.path for r in search.request_search(small, "folder:ONE t:x *.md", "/pool/photos", "txt").collect()] == ["/pool/photos/one.txt"]
    got = search.request_search_all(small, "", [("pool", "/pool")], ["/pool/photos", "/pool"]).collect()
    assert {r.path for r in got} == {"/pool/photos-raw/two.txt"}
    text = search.answer(search.search_root(small, "two"), 5, 1).first().json
    assert text == '{"results":[{"path":"/pool/photos-raw/two.txt","is_dir":false,"mtime":20,"size":1}],"total_indexed":5,"search_time_ms":1}'


def test_engine_refines_from_its_cache(small):
    engine = search.Engine(small, [("all", "/")], ["/home"], cache=True)
    assert engine.file_count() == 4 and engine.search("one").count() == 1
    kept = engine.cache.rows
    assert {r.path for r in engine.search("one.t").collect()} == {"/pool/photos/one.txt"} and engine.cache.query.text == "one.t" and kept is not engine.cache.rows
    engine.remove_bookmark("/")
    assert engine.bookmarks() == [] and engine.cache.query is None


def test_engine_keeps_roots_and_rows(spark, tmp_path, capsys):
    from pathloom.sources.config import Settings
    from pathloom.streaming.feed import PartTable

    for name in ("a/one.md", "b/two.md", "b/three.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("x")
    table = PartTable(spark, str(tmp_path / "t"), ROWS, least=2)
    engine = search.Engine(spark.createDataFrame([], ROWS), [], table=table, settings=str(tmp_path / "s.json"))
    engine.add_bookmark("first", str(tmp_path / "a"))
    engine.add_bookmark("second", str(tmp_path / "b"), is_network=True)
    assert engine.file_count() == 5 and table.read().count() == 5
    assert [(b["name"], b["is_network"]) for b in Settings.load(str(tmp_path / "s.json")).bookmarks] == [("first", False), ("second", True)]
    (tmp_path / "b/four.md").write_text("x")
    assert engine.rescan_path(str(tmp_path / "b")) == 4 and engine.rescan_all() == 6
    assert engine.test_search("*.md") == 3 and "3 found" in capsys.readouterr().out
    assert engine.record_file_open(str(tmp_path / "b/two.md"), 900) and engine.record_file_open(str(tmp_path / "b/two.md"), 950) and not engine.record_file_open("/none", 1)
    assert [tuple(r) for r in engine.access.collect()] == [(str(tmp_path / "b/two.md"), 2, 950)]
    assert engine.search("*.md", 7, now=1000).first().path.endswith("two.md")
    engine.rename_bookmark("second", "other")
    engine.remove_bookmark("first")
    assert engine.bookmarks() == [("other", str(tmp_path / "b"))] and table.read().count() == 4


def test_request_lines(spark, small, tmp_path):
    import json
    import socket

    from pathloom.operators.requests import answer_line, serve

    (tmp_path / "new").mkdir()
    (tmp_path / "new/z.md").write_text("x")
    engine = search.Engine(small, [("pool", "/pool"), ("home", "/home")])
    ask = lambda line: json.loads(answer_line(engine, line))
    got = ask('SEARCH {"bookmark_path": "/pool", "mode": "gotofile", "query": "o", "extension": "txt"}')
    assert [r["path"] for r in got["results"]] == ["/pool/photos-raw/two.txt", "/pool/photos/one.txt"] and got["total_indexed"] == 5
    assert [r["bookmark"] for r in ask('SEARCH_ALL {"query": "x.txt"}')["results"]] == ["home"]
    assert [r["path"] for r in ask('SEARCH_ALL {"query": "", "bookmark_paths": ["/home"]}')["results"]] == ["/home/x.txt"]
    assert ask('SEARCH {"bookmark_path": "/pool", "mode": "gotodir", "query": ""}')["results"] == [{"path": "/pool/photos", "is_dir": True, "mtime": 5, "size": 0}]
    assert ask("PING") == {"status": "pong"}
    for wrong in ("", "ping", "SEARCH", "PING x", "NOPE {}"):
        assert ask(wrong) == {"error": "unknown command"}
    for wrong in ("SEARCH {", "SEARCH []", 'SEARCH {"mode": "edit"}', 'SEARCH_ALL {"query": 4}'):
        assert list(ask(wrong)) == ["error"]
    folder = str(tmp_path / "new")
    assert ask("ADD_BOOKMARK " + json.dumps({"name": "n", "path": folder, "is_network": False})) == {"status": "ok", "indexed": 7}
    assert ask(f"RESCAN {folder} ") == {"status": "ok", "indexed": 2} and ask("STATS")["bookmarks"] == 3 and ask("STATS")["files"] == 7
    server = serve(engine, str(tmp_path / "s"))
    with socket.socket(socket.AF_UNIX) as client:
        client.connect(str(tmp_path / "s"))
        client.sendall(b"PING\nNOPE\n")
        lines = client.makefile()
        assert [json.loads(lines.readline()) for _ in range(2)] == [{"status": "pong"}, {"error": "unknown command"}]
    server.shutdown()
    server.server_close()


def test_index_narrows_fuzzy_and_glob():
    need = lambda line: index.needed_trigrams(parse(line))
    assert need("~abcdef") == [[b"abc"], [b"def"]] and need("~abcde") == [] and len(need("~abcdefghi")) == 3
    assert need("abc*def?g") == [[b"abc", b"def"]] and need("a*b") == [] and need("x[abc]yzw*") == [[b"yzw"]] and need("{abc,def}*") == []


def test_top_k_is_planned_as_such(small, capsys):
    search.search_all(small, "txt", [("all", "/")]).explain("formatted")
    assert "TakeOrderedAndProject" in capsys.readouterr().out
