"""Tag documents, fingerprints, stores, trees, maintenance and the change feed."""

import hashlib
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from pathloom import cli
from pathloom.functions import fingerprint, formats
from pathloom.operators import catalog as cat
from pathloom.operators import previews, tags
from pathloom.sources import tagdoc, tree
from pathloom.sources.config import Settings, clean_path
from pathloom.sources.store import TagStore, TagStoreError, lock
from pathloom.streaming import feed

ROWS = "path string, is_dir boolean, mtime long, size long"


# Digests that other programs' tag stores hold for these contents.
@pytest.mark.parametrize(
    ("content", "digest"),
    [
        (b"", "c804ce198ec337e3dc762bdd1a09aece"),
        (b"hello world", "67279e3d124274782e66b2f4d3d079a5"),
        (bytes(range(256)) * 512, "d27ae5f600820bb3c7a1d6c3b77959a1"),
        (bytes.fromhex("ab515a7837") * 40960, "b3e89dbcfcd186a2709fea950342a317"),
    ],
)
def test_fingerprints(tmp_path, content, digest):
    assert fingerprint.of_bytes(content) == digest
    (tmp_path / "f").write_bytes(content)
    assert fingerprint.of_file(tmp_path / "f") == digest


DOCUMENT = """{
  "entries": {
    "Zürich 2021/maße.ods": {
      "fp": "%s",
      "mtime_ns": 1612345678000000009,
      "size": 4096,
      "tags": [
        "floor plan",
        "year:2021"
      ]
    },
    "notes": {
      "fp": "ff",
      "mtime_ns": 77,
      "size": 1,
      "tags": [
        "draft"
      ]
    }
  },
  "version": 1
}
""" % hashlib.md5(b"x").hexdigest()


def test_document_round_trip(tmp_path):
    entries = tagdoc.parse_document(DOCUMENT)
    assert tagdoc.dump_document(entries) == DOCUMENT
    tagdoc.save_document(str(tmp_path / "i.json"), entries)
    assert (tmp_path / "i.json").read_text("utf-8") == DOCUMENT


def test_documents_are_written_in_tasks(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"{tmp_path}/r{i % 3}", f"é{rng.randrange(10**6)}/\"x\".txt", "f", i, 2 * i, rng.choice([[], ["b", "a"], ["ü", "\n"]])) for i in range(60)]
    written = {r.root: r.n for r in tagdoc.write_documents(spark.createDataFrame(rows, tagdoc.ENTRIES)).collect()}
    assert written == {f"{tmp_path}/r{i}": 20 for i in range(3)}
    for root in written:
        mine = {rel: {"fp": fp, "mtime_ns": m, "size": s, "tags": sorted(t, key=str.encode)} for r, rel, fp, m, s, t in rows if r == root}
        with open(f"{root}/.tagstore/index.json", encoding="utf-8") as f:
            assert f.read() == tagdoc.dump_document(mine)
        assert os.listdir(f"{root}/.tagstore") == ["index.json"]
    again = tagdoc.read_documents(spark, list(written))
    assert sorted((r.root, r.rel, r["size"]) for r in again.collect()) == sorted((r[0], r[1], r[4]) for r in rows)
    assert tagdoc.write_documents(again.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["{\"version\"", "[]", '{"entries": {}}', '{"version": 2, "entries": {}}', '{"version": 1}', '{"version": 1, "entries": {"a": {"fp": "", "mtime_ns": 1, "size": 1, "tags": 5}}}', '{"version": 1, "entries": {"a": {"fp": "", "mtime_ns": 1, "size": -1, "tags": []}}}'])
def test_bad_documents(text):
    with pytest.raises(tagdoc.TagDocumentError):
        tagdoc.parse_document(text)


@pytest.fixture
def store(tmp_path):
    for name, text in {"a.txt": "one", "b.txt": "two!", "sub/c.txt": "three", "sub/.h": "x"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    return TagStore.init(str(tmp_path))


def test_store_changes(spark, store, tmp_path):
    a, c = str(tmp_path / "a.txt"), str(tmp_path / "sub/c.txt")
    assert store.add([a, c], ["blue", " big "]) == {"a.txt": ["big", "blue"], "sub/c.txt": ["big", "blue"]}
    assert store.remove([a], ["big"]) == {"a.txt": ["blue"]} and store.get(a) == ["blue"]
    assert TagStore.discover(str(tmp_path / "sub")).root == store.root
    with pytest.raises(TagStoreError):
        store.add([a, str(tmp_path / "none")], ["x"])
    with pytest.raises(TagStoreError):
        store.add([a], ["x,y"])
    with pytest.raises(TagStoreError):
        store.rel(str(tmp_path / ".tagstore/index.json"))
    assert store.get(a) == ["blue"]
    rows = tagdoc.read_documents(spark, [store.root]).orderBy("rel").collect()
    assert [(r.root, r.rel, r.tags) for r in rows] == [(store.root, "a.txt", ["blue"]), (store.root, "sub/c.txt", ["big", "blue"])]
    assert store.move(a, str(tmp_path / "sub/d.txt")) == ("a.txt", "sub/d.txt") and store.get(str(tmp_path / "sub/d.txt")) == ["blue"]
    with pytest.raises(TagStoreError):
        store.move(c, str(tmp_path / "b.txt"))
    os.remove(c)
    with pytest.raises(TagStoreError):
        store.remove([c], ["big"])
    assert store.remove([c], [], True) == {"sub/c.txt": []}


def test_repair_and_check(spark, store, tmp_path):
    paths = {n: tmp_path / n for n in ("a.txt", "b.txt", "sub/c.txt")}
    store.add(list(map(str, paths.values())), ["t"])
    assert {r.status for r in store.check(spark, True).collect()} == {"ok", "untracked"}
    os.rename(paths["a.txt"], tmp_path / "moved.txt")
    paths["b.txt"].write_text("two changed")
    os.remove(paths["sub/c.txt"])
    status = {r.rel: r.status for r in store.check(spark).collect()}
    assert status == {"a.txt": "missing", "b.txt": "modified", "sub/c.txt": "missing", "moved.txt": "untracked", "sub/.h": "untracked"}
    want = [("missing", "sub/c.txt", None, []), ("refreshed", "b.txt", None, []), ("relinked", "a.txt", "moved.txt", [])]
    assert store.repair(spark, dry_run=True) == want and "a.txt" in store.load()
    assert store.repair(spark, prune=True) == [("pruned", "sub/c.txt", None, []), *want[1:]]
    assert sorted(store.load()) == ["b.txt", "moved.txt"] and store.load()["moved.txt"]["tags"] == ["t"]
    assert store.repair(spark) == []


def test_ambiguous_copies(spark):
    entries = spark.createDataFrame([("/r", "old", ["t"], 3, 1, "f"), ("/r", "old2", ["t"], 3, 1, "g"), ("/r", "old1", ["u"], 3, 1, "g")], "root string, rel string, tags array<string>, size long, mtime_ns long, fp string")
    disk = spark.createDataFrame([("x", 3, 1, "f"), ("y", 3, 1, "f"), ("z", 3, 1, "g")], "rel string, size long, mtime_ns long, fp string")
    got = {r.rel: (r.status, r.new_rel) for r in tags.repair_plan(entries, disk).collect()}
    assert got == {"old": ("ambiguous", None), "old1": ("relinked", "z"), "old2": ("missing", None)}
    assert sorted((r["size"], r.fp, r.candidate) for r in tags.repair_candidates(entries, disk).collect()) == [(3, "f", "x"), (3, "f", "y")]


def test_ambiguous_copies_in_a_store(spark, store, tmp_path):
    a = tmp_path / "a.txt"
    store.add([str(a)], ["t"])
    (tmp_path / "sub/copy").write_text("one")
    os.rename(a, tmp_path / "moved")
    assert store.repair(spark, dry_run=True) == [("ambiguous", "a.txt", None, ["moved", "sub/copy"])]
    assert store.find(["t"]) == {"a.txt": ["t"]} and store.find(exclude=["t"]) == {} and store.tag_counts() == {"t": 1}
    assert [(n, d, t) for n, d, t, _ in store.list_dir(str(tmp_path))] == [("b.txt", False, []), ("moved", False, []), ("sub", True, [])]


def test_entries_are_read_again_when_the_file_changes(store, tmp_path):
    from pathloom.sources import store as module

    store.add([str(tmp_path / "a.txt")], ["t"])
    held = module._READ[store.file]
    store.load()["a.txt"]["tags"] = []
    store.load().clear()
    assert store.load()["a.txt"]["tags"] == ["t"]
    store.add([str(tmp_path / "b.txt")], ["u"])
    assert sorted(store.load()) == ["a.txt", "b.txt"] and module._READ[store.file] is not held
    (tmp_path / "sub/.tagstore").mkdir()
    assert TagStore.discover(str(tmp_path / "sub")).root == store.root
    TagStore.init(str(tmp_path / "sub"))
    assert TagStore.discover(str(tmp_path / "sub")).root == store.root  # as found a moment ago
    assert TagStore.discover(str(tmp_path / "sub"), lifetime=-1).root == str(tmp_path / "sub")


def test_lock(tmp_path):
    with lock(str(tmp_path)):
        with pytest.raises(TagStoreError), lock(str(tmp_path), timeout=0.2):
            pass
        os.utime(tmp_path / "lock", (1, 1))
        with lock(str(tmp_path), timeout=0.2):
            pass
    assert not (tmp_path / "lock").exists()


def test_cli(store, tmp_path, spark):
    top, a = str(tmp_path), str(tmp_path / "a.txt")
    assert cli.run(["add", a, "x", "y"]) == (0, ["a.txt: x, y"])
    assert cli.run(["--store", top, "add", "-t", "z", a, str(tmp_path / "b.txt")]) == (0, ["a.txt: x, y, z", "b.txt: z"])
    assert cli.run(["--store", top, "find", "z", "--not", "x"]) == (0, ["b.txt"])
    assert cli.run(["--store", top, "find", "--any", "x", "q", "--show-tags"]) == (0, ["a.txt: x, y, z"])
    assert cli.run(["--store", top, "tags"]) == (0, ["1  x", "1  y", "2  z"])
    assert cli.run(["--store", top, "ls", "--plain", top]) == (0, ["a.txt  x, y, z", "b.txt  z", "sub/"])
    assert cli.run(["--store", top, "ls", top])[1][0].startswith("total ")
    assert cli.run(["--store", top, "rm", "--all", a]) == (0, ["a.txt: "])
    assert cli.run(["--store", top, "check"]) == (0, ["entries: 1  untracked files: 3", "ok"])
    os.remove(tmp_path / "b.txt")
    code, lines = cli.run(["--store", top, "repair"])
    assert code == 1 and lines == ["missing: b.txt (--prune drops it)"]
    with pytest.raises(TagStoreError):
        cli.run(["nonsense"])


def test_tree(spark, tmp_path):
    for name in ("x/a.txt", "x/build/b.txt", "x/sub/.h", ".Trash-1/c", "y/build", "skip/z", "top.md"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    os.symlink(tmp_path / "x", tmp_path / "link")
    rows = {os.path.relpath(r.path, tmp_path): r for r in tree.scan(spark, str(tmp_path), exclude_paths=[str(tmp_path / "skip")]).collect()}
    assert set(rows) == {".", "x", "x/a.txt", "x/sub", "x/sub/.h", "y", "y/build", "top.md", "link"}
    assert rows["x"].is_dir and rows["x"]["size"] == 0 and not rows["link"].is_dir and rows["top.md"]["size"] == 6
    assert tree.scan(spark, str(tmp_path), exclude=False).count() > len(rows)


def test_ids_are_gapless_and_never_given_again(spark):
    rows = spark.range(500).select(F.concat(F.lit("/p"), "id").alias("path"))
    ids = sorted(r.id for r in cat.assign_ids(rows, 41, 16).collect())
    assert ids == list(range(42, 542))


def test_saved_index_is_brought_up_to_date(spark, tmp_path):
    from pathloom.operators import index

    rows = spark.createDataFrame([(1, "/data/alpha"), (2, "/data/beta"), (3, "/data/gone")], "id long, path string")
    index.save(index.postings(rows), rows, str(tmp_path))
    now = rows.filter("id < 3").unionByName(spark.createDataFrame([(4, "/data/new")], "id long, path string"))
    pairs = lambda x: sorted((bytes(r.trigram), r.id) for r in x.collect())
    assert pairs(index.load(now, str(tmp_path))) == pairs(index.postings(now))
    assert not index.cache_is_usable(1000, 1101) and index.cache_is_usable(20000, 20200)


def test_subtree_delete_takes_names_as_they_are(spark):
    rows = [("/srv/50%_off/x", False, 1, 1), ("/srv/50%_off", True, 1, 0), ("/srv/50%-off/y", False, 1, 1), ("/srv/500_off/z", False, 1, 1)]
    left = cat.delete_subtree(spark.createDataFrame(rows, ROWS), "/srv/50%_off").collect()
    assert sorted(r.path for r in left) == ["/srv/50%-off/y", "/srv/500_off/z"]


def test_upsert_keeps_ids(spark):
    rows = spark.createDataFrame([(7, "/a", False, 1, 1), (8, "/b", False, 1, 1)], f"id long, {ROWS}")
    got = {r.path: tuple(r) for r in cat.upsert(rows, spark.createDataFrame([("/b", True, 5, 0), ("/c", False, 2, 2)], ROWS)).collect()}
    assert got == {"/a": (7, "/a", False, 1, 1), "/b": (8, "/b", True, 5, 0), "/c": (None, "/c", False, 2, 2)}


def test_stream_as_batch(spark, tmp_path):
    start = spark.createDataFrame([("/a", False, 1, 1), ("/b", False, 1, 1)], ROWS)
    events = [(1, "2024-01-01T00:00:01Z", "create", "/c", False, 5, 5), (2, "2024-01-01T00:00:02Z", "remove", "/a", False, None, None), (3, "2024-01-01T00:00:03Z", "modify", "/c", False, 6, 7), (4, "2024-01-01T00:00:04Z", "modify", "/b", False, None, None), (5, "2024-01-01T00:00:05Z", "create", "/build/x", False, 1, 1), (6, "2024-01-01T00:00:06Z", "other", "/z", False, 1, 1)]
    keys = ("seq", "ts", "kind", "path", "is_dir", "mtime", "size")
    (tmp_path / "log").mkdir()
    for i in range(0, 6, 2):
        (tmp_path / "log" / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(keys, e))) for e in events[i : i + 2]))
        os.utime(tmp_path / "log" / f"{i}.json", (time.time() - 100 + i, time.time() - 100 + i))
    table = feed.PartTable(spark, str(tmp_path / "t"), ROWS)
    table.write(start)
    query = feed.follow(feed.event_stream(spark, str(tmp_path / "log"), maxFilesPerTrigger=1), table, str(tmp_path / "cp"))
    assert query.awaitTermination(120)
    batch = feed.apply_events(start, spark.read.schema(feed.EVENTS).json(str(tmp_path / "log")))
    got = sorted(map(tuple, table.read().select("path", "is_dir", "mtime", "size").collect()))
    assert got == sorted(map(tuple, batch.select("path", "is_dir", "mtime", "size").collect())) == [("/c", False, 6, 7)]
    # Batches that come again, by another checkpoint, change nothing.
    again = feed.follow(feed.event_stream(spark, str(tmp_path / "log"), maxFilesPerTrigger=1), table, str(tmp_path / "cp2"))
    assert again.awaitTermination(120) and sorted(map(tuple, table.read().select("path", "is_dir", "mtime", "size").collect())) == got


def test_table_parts(spark, tmp_path):
    table = feed.PartTable(spark, str(tmp_path / "t"), ROWS, part_rows=10, least=4)
    assert table.parts() == 0 and table.read().count() == 0
    rows = spark.createDataFrame([(f"/d{i % 20}/p{i}", False, i, i) for i in range(40)], ROWS)
    table.write(rows)
    assert table.parts() == 4
    files = lambda: {os.path.relpath(os.path.join(d, f), tmp_path) for d, _, names in os.walk(tmp_path / "t") for f in names if f.startswith("part-")}
    before, one = files(), table.touched(rows.filter("path = '/d3/p3'"))
    assert len(one) == 1
    parts = table.update(rows.filter("path = '/d3/p3'"), lambda held: held.filter("mtime % 2 = 0"))
    assert parts == one and {f for f in before - files()} and all(f"part={one[0]}/" in f for f in before ^ files())
    inside = {r.path for r in rows.filter(table.part_of(F.col("path")) == one[0]).collect()}
    gone = {p for p in inside if int(p.rsplit("p", 1)[1]) % 2}
    assert {r.path for r in table.read().collect()} == {f"/d{i % 20}/p{i}" for i in range(40)} - gone
    table.write(table.read(one).filter("false"), one)  # a part without rows goes
    assert {r.path for r in table.read().collect()} == {f"/d{i % 20}/p{i}" for i in range(40)} - inside
    table.write(spark.range(170).selectExpr("concat('/x/', id) as path", "false as is_dir", "id as mtime", "id as size"))
    assert table.parts() == 32 and table.read().count() == 170 and sorted(os.listdir(tmp_path / "t")) == ["of=32"]
    table.write(table.read().filter("size < 100"))  # a table may be rewritten from itself
    assert table.parts() == 16 and table.read().count() == 100
    assert table.touched(spark.range(60).selectExpr("concat('/x/', id) as path")) == table.touched(table.read().limit(1))


def test_jobs(spark, tmp_path):
    for name in ("here/a", "here/b", "net/c"):
        path = tmp_path / "disk" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    disk, away = str(tmp_path / "disk"), "/no/such/root"
    table = feed.PartTable(spark, str(tmp_path / "t"), ROWS, least=4)
    rows = tree.scan(spark, f"{disk}/here").select("path", "is_dir", "mtime", "size")
    table.write(rows.unionByName(spark.createDataFrame([(f"{disk}/here/gone{i}", False, 1, 1) for i in range(6)] + [(f"{away}/x", False, 1, 1), ("/elsewhere", False, 1, 1)], ROWS)))
    names = lambda: {os.path.relpath(r.path, disk) if r.path.startswith(disk) else r.path for r in table.read().collect()}
    looked = []
    look = lambda rows: looked.append(rows.count()) or tree.look_up(rows)
    turn = feed.integrity_job(table, [f"{disk}/here", away], look, share=4)
    sweeps = feed.sweeps_for(table.read().count(), 4)
    assert sweeps == 3
    for number in range(2 * sweeps):
        turn(number)
    assert names() == {"here", "here/a", "here/b", f"{away}/x", "/elsewhere"}
    assert sum(looked[:3]) <= 9 and max(looked) < 9  # a turn looks at its own share, and all shares at each row once
    feed.network_job(table, lambda r: tree.scan(spark, r), [f"{disk}/net", away])(0)
    assert names() == {"here", "here/a", "here/b", "net", "net/c", f"{away}/x", "/elsewhere"}
    turns = []
    query = feed.every(spark, 0.2, turns.append, str(tmp_path / "cp"))
    until = time.monotonic() + 60
    while len(turns) < 2 and time.monotonic() < until:
        time.sleep(0.1)
    query.stop()
    assert turns[:2] == [0, 1]


def test_previews(spark):
    import io
    import tarfile
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as out:
        out.writestr("plans/", "")
        out.writestr("plans/roof.csv", "a,b\n1,2")
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as out:
        info = tarfile.TarInfo("logs/day1")
        info.size = 2000
        out.addfile(info, io.BytesIO(b"." * 2000))
    rows = [("/a.zip", z.getvalue()), ("/b.tar.gz", t.getvalue()), ("/c.txt", b"text \xff"), ("/d", b"\x00\x01" * 9), ("/e.bz2", b""), ("/f.md", b"# A *b*\n\n- c"), ("/g.png", b"123"), ("/h.txt", b"x" * 60000)]
    frame = spark.createDataFrame([(p, False, len(c), bytearray(c)) for p, c in rows], "path string, is_dir boolean, size long, content binary")
    got = {r.path: (r.preview_type, r.text) for r in previews.previews(frame).collect()}
    assert got["/a.zip"] == ("archive", "ZIP Archive: 2 entries\n\n  [dir]     plans/\n       7 B  plans/roof.csv")
    assert got["/b.tar.gz"] == ("archive", "TAR.GZ Archive:\n\n   2.0 KiB  logs/day1")
    assert got["/c.txt"] == ("text", "text �") and got["/d"][1].startswith("Binary file (18 B)") and got["/e.bz2"] == ("archive", "Unsupported archive format: .bz2")
    assert got["/f.md"] == ("markdown", "<h1>A <em>b</em></h1>\n<ul><li>c</li></ul>") and got["/g.png"] == ("image", "g.png\nSize: 3 B")
    assert got["/h.txt"][1].endswith("\n\n--- Truncated (showing 50KB of 58.6 KiB) ---")
    children = spark.createDataFrame([("/f", f"n{i:02}", i == 0, i) for i in range(91)], "folder string, name string, is_dir boolean, size long")
    text = previews.folder_text(children).first().text
    assert text.startswith("91 items\n\n[dir]  n00/\n     1 B  n01") and text.endswith("\n\n... and 11 more items")


def test_other_archives(tmp_path):
    import io
    import tarfile

    import zstandard

    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as out:
        folder = tarfile.TarInfo("in")
        folder.type = tarfile.DIRTYPE
        out.addfile(folder)
        info = tarfile.TarInfo("in/x")
        info.size = 3
        out.addfile(info, io.BytesIO(b"abc"))
    packed = zstandard.ZstdCompressor().compress(t.getvalue())
    assert previews.archive_listing("/a.tar.zst", packed) == "ZSTD Archive:\n\n  [dir]     in/\n       3 B  in/x"
    assert previews.archive_listing("/a.zst", b"no archive") == "ZSTD Archive:\n"
    assert previews.archive_listing("/none.7z", b"") == "This archive needs 7z to be listed"
    tool = tmp_path / "tool"
    tool.write_text("#!/bin/sh\nseq 100\n")
    tool.chmod(0o755)
    assert previews.listed_by_tool(str(tool), str(tool)).splitlines() == [str(i) for i in range(1, 56)]


def test_previews_of_files_read_only_what_they_show(spark, tmp_path):
    import zipfile

    (tmp_path / "long.txt").write_bytes(b"y" * 70000)
    (tmp_path / "a.md").write_text("# T")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("inside", "12")
    rows = [(str(tmp_path / n), False, s) for n, s in (("long.txt", 70000), ("a.md", 3), ("z.zip", 1), ("none.txt", 5), ("p.png", 3))]
    frame = spark.createDataFrame(rows, "path string, is_dir boolean, size long")
    got = {os.path.basename(r.path): (r.preview_type, r.text) for r in previews.preview_files(frame).collect()}
    assert got["long.txt"][1].startswith("y" * 50000 + "\n\n--- Truncated") and got["a.md"] == ("markdown", "<h1>T</h1>")
    assert got["z.zip"][1] == "ZIP Archive: 1 entries\n\n       2 B  inside"
    assert got["none.txt"][1].startswith("Unable to read file") and got["p.png"] == ("image", "p.png\nSize: 3 B")


def test_a_deep_tree_is_split(spark, tmp_path):
    for i in range(40):
        path = tmp_path / "only" / f"d{i % 8}" / f"e{i}" / "f"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    whole = sorted(r.path for r in tree.scan(spark, str(tmp_path)).collect())
    assert len(whole) == 1 + 1 + 8 + 40 + 40
    for most in (1, 3, 12, 500):
        reader = tree.TreeReader(str(tmp_path), True, (), most)
        parts = reader.partitions()
        assert sorted(row[0] for p in parts for row in reader.read(p)) == whole and len(parts) >= min(most, 50)


def test_tables_of_roots_and_opens(spark, tmp_path):
    from pathloom.sources import tables

    assert tables.load_roots(spark, str(tmp_path / "none")).collect() == [] and tables.load_access(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([(1, "b", "/b", False), (0, "a", "/a", True), (2, None, "/c", False)], tables.ROOTS).write.parquet(str(tmp_path / "r"))
    assert tables.roots_of(tables.load_roots(spark, str(tmp_path / "r"))) == [("a", "/a"), ("b", "/b")]
    spark.createDataFrame([("/a", 2, 5), ("/a", 1, 9), ("/gone", 1, 1), (None, 1, 1)], tables.ACCESS).write.parquet(str(tmp_path / "o"))
    rows = spark.createDataFrame([("/a", False, 1, 1)], ROWS)
    assert [tuple(r) for r in tables.load_access(spark, str(tmp_path / "o"), rows).collect()] == [("/a", 3, 9)]


def test_a_watched_root(spark, tmp_path):
    for name in ("kept", "old", "sub/x"):
        path = tmp_path / "top" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("1")
    root, table = str(tmp_path / "top"), feed.PartTable(spark, str(tmp_path / "t"), ROWS, least=4)
    scan = lambda r: tree.scan(spark, r).select("path", "is_dir", "mtime", "size")
    table.write(scan(root).unionByName(spark.createDataFrame([("/other", False, 1, 1)], ROWS)))
    os.remove(tmp_path / "top/old")
    (tmp_path / "top/new").write_text("22")
    (tmp_path / "top/sub/x").write_text("333")
    kinds = {os.path.basename(r.path): r.kind for r in feed.changes(table.read(), scan(root), root).collect() if not r.is_dir}
    assert kinds == {"old": "remove", "new": "create", "x": "modify"}
    turn = feed.watch_job(table, scan, [root, "/absent"])
    turn(0)
    want = sorted(map(tuple, scan(root).collect())) + [("/other", False, 1, 1)]
    assert sorted(map(tuple, table.read().collect())) == sorted(want)
    files = lambda: sorted(os.path.join(d, f) for d, _, names in os.walk(tmp_path / "t") for f in names)
    before = files()
    turn(1)
    assert files() == before


def test_formats(spark):
    sizes = [(0, "0 B", "0"), (1023, "1023 B", "1023"), (1024, "1.0 KiB", "1.0K"), (1025, "1.0 KiB", "1.1K"), (5 << 20, "5.0 MiB", "5.0M"), (3 << 30, "3.0 GiB", "3.0G"), (583680, "570.0 KiB", "570K"), (10239, "10.0 KiB", "10K")]
    frame = spark.createDataFrame(sizes, "n long, a string, b string")
    for r in frame.select("*", formats.size_text(F.col("n")).alias("x"), formats.listing_size(F.col("n")).alias("y")).collect():
        assert (r.x, r.y) == (r.a, r.b)
    dates = spark.createDataFrame([(0,), (1706659200,), (1705000000,), (1600000000,)], "t long")
    assert [r.x for r in dates.select(formats.date_text(F.col("t"), 1706659300).alias("x")).collect()] == ["", "12:00 am", "Jan 11 7:06 pm", "2020-09-13 12:26 pm"]


def test_settings(tmp_path):
    path = str(tmp_path / "c.json")
    assert Settings.load(path) == Settings()
    Settings([{"name": "d", "path": "/data/", "is_network": False}], 9999, ["~/x/"]).save(path)
    got = Settings.load(path)
    assert got.roots() == [("d", "/data")] and got.results() == 2000 and got.exclude_paths == [os.path.expanduser("~/x")]
    (tmp_path / "c.json").write_text("{bad")
    assert Settings.load(path) == Settings() and (tmp_path / "c.json").read_text() == "{bad" and clean_path("/") == "/"
