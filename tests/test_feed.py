"""Keyed state, the change log source, scans led by the catalog, filters of the tree source, order by use, bucketed tables."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import catalog as cat
from pathloom.operators import index, search, tags
from pathloom.plans.language import parse
from pathloom.sources import changelog, tables, tree
from pathloom.streaming import feed, keyed

ROWS = "path string, is_dir boolean, mtime long, size long"
KEYS = ("seq", "ts", "kind", "path", "is_dir", "mtime", "size")


def line(*event):
    return json.dumps(dict(zip(KEYS, event))) + "\n"


def plain(df):
    return sorted(map(tuple, df.select("path", "is_dir", "mtime", "size").collect()))


def many_events(seed, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["create", "modify", "modify", "remove", "other"])
        out.append((i, f"2024-01-01T00:{rng.randrange(60):02}:00+00:00", kind, rng.choice(["/a/x", "/a/y", "/b", "/c/d", "/build/z", "/e"]), rng.choice([False, None]), i, None if rng.random() < 0.1 else i))
    return out


def test_a_stream_in_any_order_ends_as_the_batch(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    events = many_events(4)
    start = spark.createDataFrame([("/a/x", False, 0, 0), ("/q", False, 0, 0)], ROWS)
    table = feed.PartTable(spark, str(tmp_path / "t"), ROWS)
    table.write(start)
    for turn in range(3):  # a stream that is stopped and started again; older events come in later batches
        with open(log / f"{turn % 2}.jsonl", "a") as f:
            f.write("".join(line(*e) for e in events[turn * 20 : turn * 20 + 20]))
        query = keyed.follow(changelog.stream_log(spark, str(log)), table, str(tmp_path / "cp"))
        assert query.awaitTermination(180)
    want = feed.apply_events(start, changelog.read_log(spark, str(log)))
    assert plain(table.read()) == plain(want) and want.count() > 2


def test_a_removed_folder_is_swept_after_a_while(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    table = feed.PartTable(spark, str(tmp_path / "t"), ROWS)
    table.write(spark.createDataFrame([("/a", True, 1, 0), ("/a/x", False, 1, 1), ("/b", True, 1, 0), ("/b/y", False, 1, 1), ("/ab", False, 1, 1)], ROWS))
    run = lambda: keyed.follow(changelog.stream_log(spark, str(log)), table, str(tmp_path / "cp"), grace_ms=1).awaitTermination(180)
    with open(log / "l.jsonl", "a") as f:
        f.write(line(1, "2024-01-01T00:00:01Z", "remove", "/a", True, None, None) + line(2, "2024-01-01T00:00:02Z", "remove", "/b", True, None, None) + line(3, "2024-01-01T00:00:03Z", "create", "/b", True, 9, 0))
    assert run()
    assert {r.path for r in table.read().collect()} >= {"/a/x", "/b", "/b/y", "/ab"}
    with open(log / "l.jsonl", "a") as f:
        f.write(line(4, "2024-01-01T00:00:04Z", "create", "/new", False, 1, 1))
    assert run()
    assert {r.path for r in table.read().collect()} == {"/b", "/b/y", "/ab", "/new"}


def test_the_log_source_goes_on_where_it_was(spark, tmp_path):
    log, out = tmp_path / "log", tmp_path / "out"
    log.mkdir()

    def run():
        stream = changelog.stream_log(spark, str(log), split_bytes=100)
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(out)).trigger(availableNow=True).start()
        assert query.awaitTermination(180)
        return sorted(r.seq for r in spark.read.parquet(str(out)).collect())

    first = "".join(line(i, "2024-01-01T00:00:00Z", "create", f"/é{i}", False, i, i) for i in range(20))
    half = line(20, None, "modify", "/later", False, 1, 1)
    (log / "one.jsonl").write_text(first + half[:17])
    (log / "notes.txt").write_text("no log")
    assert run() == list(range(20))
    (log / "one.jsonl").write_text(first + half + "no json\n[]\n" + line(21, "x", "create", "/p", 7, "y", 1.5))
    (log / "two.jsonl").write_text(line(22, "2024-01-01", "remove", "/q", None, None, None))
    assert run() == list(range(23)) == run()
    (log / "two.jsonl").write_text("")
    os.remove(log / "one.jsonl")
    assert run() == list(range(23))
    (log / "two.jsonl").write_text(line(23, None, "remove", "/q", None, None, None))
    assert run() == list(range(24))
    odd = spark.read.parquet(str(out)).filter("seq = 21").first()
    assert odd.ts is None and odd.is_dir is None and odd.mtime is None and odd["size"] is None


def test_ranges_of_a_log_meet_each_line_once(tmp_path):
    rows = [line(i, None, "create", "/" + "x" * (i % 7), False, 1, 1) for i in range(50)]
    (tmp_path / "l.jsonl").write_text("".join(rows))
    for split in (1, 10, 97, 10**6):
        logs = changelog._Logs({"path": str(tmp_path), "split_bytes": str(split)})
        assert [r[0] for part in logs.ranges({}, logs.ends()) for r in logs.read(part)] == list(range(50))


@pytest.fixture
def disk(tmp_path):
    for name in ("a/one", "a/two", "b/sub/three", "c/four", "c/deep/five", "d/six"):
        path = tmp_path / "top" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    for folder, _, _ in os.walk(tmp_path / "top"):
        os.utime(folder, (1_000_000, 1_000_000))
    return tmp_path / "top"


def test_only_changed_folders_are_listed(spark, disk):
    root = str(disk)
    before = tree.scan(spark, root).select("path", "is_dir", "mtime", "size").persist()
    before.count()
    assert tree.changed_below(before, root).count() == 0
    os.remove(disk / "a/one")
    (disk / "c/new/deeper").mkdir(parents=True)
    (disk / "c/new/deeper/seven").write_text("7")
    for name in ("b/sub/three", "b/sub", "b"):
        (os.remove if name.endswith("three") else os.rmdir)(disk / name)
    known = before.filter("is_dir").select("path", "mtime")
    states = {(r.state, os.path.relpath(r.path, root)) for r in tree.listed_again(known).collect()}
    assert {p for s, p in states if s == "changed"} == {"a", "c", "."} and {p for s, p in states if s == "gone"} == {"b", "b/sub"}
    events = tree.changed_below(before, root)
    assert plain(feed.apply_events(before, events)) == plain(tree.scan(spark, root))
    assert {(r.kind, os.path.relpath(r.path, root)) for r in events.collect() if r.kind != "modify"} == {("remove", "a/one"), ("remove", "b"), ("remove", "b/sub"), ("remove", "b/sub/three"), ("create", "c/new"), ("create", "c/new/deeper"), ("create", "c/new/deeper/seven")}
    after = feed.apply_events(before, events).persist()
    (disk / "d/six").write_text("longer than before")  # alters no folder
    assert tree.changed_below(after, root).count() == 0
    assert plain(feed.apply_events(after, tree.changed_below(after, root, files=True))) == plain(tree.scan(spark, root))
    assert plain(feed.apply_events(after.limit(0), tree.changed_below(after.limit(0), root))) == plain(tree.scan(spark, root))


def test_a_led_job(spark, disk, tmp_path):
    table = feed.PartTable(spark, str(tmp_path / "t"), ROWS)
    table.write(tree.scan(spark, str(disk)).select("path", "is_dir", "mtime", "size"))
    (disk / "a/more").write_text("x")
    turn = feed.led_job(table, [str(disk), "/no/such/root"])
    turn(0)
    assert plain(table.read()) == plain(tree.scan(spark, str(disk)))


def test_a_begin_cuts_subtrees(spark, disk):
    root = str(disk)
    reader = tree.TreeReader(root, True, (), 4, f"{root}/c/d")
    opened = []
    children = reader._children
    reader._children = lambda folder: (opened.append(folder) or children(folder)) if reader._leads_on(folder) else iter(())
    found = {os.path.relpath(r[0], root) for p in reader.partitions() for r in reader.read(p)}
    assert found == {"c/deep", "c/deep/five"} and {os.path.relpath(o, root) for o in opened} <= {".", "c", "c/deep"}
    assert {os.path.relpath(r.path, root) for r in tree.scan(spark, root, begins=f"{root}/c/d").collect()} == found
    assert [os.path.relpath(r.path, root) for r in tree.scan(spark, root, begins=f"{root}/b/sub").collect()] == ["b/sub", "b/sub/three"]
    assert tree.scan(spark, root).count() == 13 and tree.scan(spark, root, begins="/none").count() == 0


@pytest.mark.parametrize("used", [1, 2, 9000])
def test_order_by_use_from_the_uses(spark, used, monkeypatch, capsys):
    monkeypatch.setattr(search, "USED", used)
    rng = random.Random(used)
    rows = spark.createDataFrame([(f"/f{i}", False, i, i) for i in range(40)], ROWS)
    access = spark.createDataFrame([(f"/f{rng.randrange(60)}", rng.choice([0, 1, 5]), 900) for i in range(12)] + [(None, 3, 900)], "file string, open_count long, last_opened long").dropDuplicates(["file"])
    score = {r.file: r.score for r in access.select("file", search.frecency.score(F.col("open_count"), F.col("last_opened"), 1000).alias("score")).collect()}
    want = sorted((f"/f{i}" for i in range(40)), key=lambda p: (-(score.get(p) or 0), p))
    for most in (1, 2, 9, 40):
        got = search.search_all(rows, parse("f", 7), [("all", "/")], most, access=access, now=1000)
        assert [r.path for r in got.orderBy("rank").collect()] == want[:most]
    if used > 12:
        capsys.readouterr()
        search.search_all(rows, parse("f", 7), [("all", "/")], 5, access=access, now=1000).explain()
        shown = capsys.readouterr().out
        assert "SortMergeJoin" not in shown and "BroadcastHashJoin" in shown
    assert search.search_all(rows, parse("f", 7), [("all", "/")], 3, access=access.limit(0), now=1000).count() == 3


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(i, f"/d/p{i}", False, i, i) for i in range(1, 200)], f"id long, {ROWS}")
        catalog = tables.save_bucketed(rows, "bucketed_catalog", "path", 4, str(tmp_path / "c"))
        fresh = tables.save_bucketed(rows.filter("id % 3 = 0").select("path", "is_dir", (F.col("mtime") + 1).alias("mtime"), "size"), "bucketed_changes", "path", 4, str(tmp_path / "f"))
        by_id = tables.save_bucketed(rows, "catalog_by_id", "id", 4, str(tmp_path / "i"))
        held = tables.save_bucketed(index.postings(rows), "bucketed_postings", "id", 4, str(tmp_path / "p"))
        entries = rows.filter("id % 2 = 0").select(F.lit("/d").alias("root"), F.expr("substring(path, 4)").alias("rel"), F.array(F.lit("t")).alias("tags"))
        for name, joined in {
            "upsert": cat.upsert(catalog, fresh),
            "delete": cat.delete(catalog, fresh),
            "reconcile": cat.unknown(fresh, catalog),
            "postings": held.join(by_id.select("id"), "id", "left_semi"),
        }.items():
            capsys.readouterr()
            joined.explain()
            shown = capsys.readouterr().out
            assert "SortMergeJoin" in shown and "Exchange" not in shown, (name, shown)
        assert cat.upsert(catalog, fresh).filter("mtime = id + 1").count() == 66
        assert tags.decorate(catalog, entries).filter("size(tags) > 0 or tags_text <> ''").count() >= 99 if "tags" in tags.decorate(catalog, entries).columns else tags.decorate(catalog, entries).filter("tags_text <> ''").count() == 99
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("bucketed_catalog", "bucketed_changes", "catalog_by_id", "bucketed_postings"):
            spark.sql(f"drop table if exists {name}")
