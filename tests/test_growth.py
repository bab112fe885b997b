"""Work that grows with the rows is done once a row."""

import re
import uuid

from pyspark.sql import functions as F

from pathloom import fixtures, queries
from pathloom.operators import blocks, index, intervals, previews
from pathloom.streaming.parts import PartTable


def plan_of(frame, capsys) -> str:
    capsys.readouterr()
    frame.explain("extended")
    return capsys.readouterr().out.split("Optimized Logical Plan")[1].split("Physical Plan")[0]


def test_a_probe_is_parsed_once(spark, capsys):
    rows = spark.createDataFrame([('{"format": {"filename": "/m/a.mp3", "tags": {"TITLE": "t"}}, "streams": [{"codec_type": "audio"}]}', "/p"), ("{}", "/p"), (None, "/q"), ("{", None)], "json string, path string")
    shown = rows.select(previews.media_text(F.col("json"), F.col("path")).alias("shown"))
    assert [r.shown for r in shown.collect()] == ["File: a.mp3\n\nTitle: t\n\nStreams:\n  Audio: unknown (?Hz, 0 ch)", "Media file: /p", "Media file: /q", None]
    assert plan_of(shown, capsys).count("from_json(") == 1


def test_bitmaps_are_made_of_distinct_bits(spark, capsys):
    rows = spark.createDataFrame([("f", f"/abab/{i % 2}/ababa") for i in range(50)] + [("g", "/x")], "file string, path string")
    made = blocks.signatures(rows)
    assert {r.file: sum(bin(byte).count("1") for byte in r.bits) for r in made.collect()} == {"f": 2, "g": 0}
    assert re.search(r"Aggregate \[file#\d+, page#\d+, bit#\d+L?\]", plan_of(made, capsys))


def test_a_catalog_is_dealt_before_it_is_sorted(spark, capsys):
    shown = plan_of(fixtures.catalog(spark, "/root/testdata/sf0.001"), capsys)
    assert re.search(r"Aggregate \[path#\d+\][^\n]*max_by[^\n]*\n\W*RepartitionByExpression \[path#\d+\]", shown), shown


def test_bytes_are_made_once_for_their_trigrams(spark, capsys):
    odd = ["/\u00c4\u00d6\u00fc/\u0391\u03a3/\u0391\u03a3/x", "/abcabcabc/abc", "/\U0001f600/\x00\x00\x00\x00", "//aaa//", "ab", "", None]
    grams = spark.createDataFrame([(p,) for p in odd], "path string").select("path", index.path_trigrams(F.col("path")).alias("trigrams"))
    names = lambda p: [c.lower().encode() for c in (p or "").split("/")]
    for path, got in grams.collect():
        assert (None if got is None else [bytes(t) for t in got]) == (None if path is None else list(dict.fromkeys(c[i : i + 3] for c in names(path) for i in range(len(c) - 2))))
    assert plan_of(grams, capsys).count("lower(") == 1


def test_stretches_are_chosen_in_one_reading_of_the_folders(spark, tmp_path):
    def seen(batches):
        (tmp_path / uuid.uuid4().hex).touch()
        yield from batches

    names = [(i, f"r{i}", f"/{i % 7}" + f"/{i}" * (i % 3)) for i in range(50)]
    folders = spark.createDataFrame(names, "ord long, value string, path string").coalesce(1).mapInArrow(seen, "ord long, value string, path string")
    rows = spark.createDataFrame([(f"/{i % 9}/{i}/x",) for i in range(60)], "path string")
    held = intervals.holder(rows, folders, "root")
    assert len(list(tmp_path.iterdir())) == 1
    first = lambda path: min((o, v) for o, v, p in names if (path + "/").startswith(p + "/"))[1] if int(path[1]) < 7 else None
    assert {r.path: r.root for r in held.collect()} == {r.path: first(r.path) for r in rows.collect()}


def test_a_small_part_is_one_file(spark, tmp_path):
    table = PartTable(spark, str(tmp_path / "t"), "path string, is_dir boolean, mtime long, size long", least=4)
    rows = spark.range(400).select(F.concat(F.lit("/"), F.col("id") % 40, F.lit("/"), "id").alias("path"), F.lit(False).alias("is_dir"), F.col("id").alias("mtime"), F.lit(1).cast("long").alias("size"))
    table.write(rows)
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, rows.collect()))
    assert len(list((tmp_path / "t").glob("of=*/part=*/*.parquet"))) == len(list((tmp_path / "t").glob("of=*/part=*")))


def test_a_saved_index_is_read_and_its_catalog_made_once(spark, tmp_path, monkeypatch):
    def seen(batches):
        (tmp_path / uuid.uuid4().hex).touch()
        yield from batches

    made = spark.range(3000).coalesce(1).select(F.concat(F.lit("/data/x"), F.col("id") * 7, F.lit("/ab")).alias("path"), F.lit(False).alias("is_dir"), F.lit(1).alias("mtime"), F.lit(1).alias("size"))
    monkeypatch.setattr(fixtures, "catalog", lambda spark, d: made.mapInArrow(seen, made.schema))
    got = queries.saved_index(spark, "")
    rows = {tuple(r) for r in got.collect()}
    assert len(list(tmp_path.iterdir())) == 1
    assert any("/postings/" in file for file in got.inputFiles())
    names = {r.id: set(r.path.split("/")) for r in fixtures.with_id(made).collect() if r.id % 10 != 3}
    assert rows == {(i, len({c[k : k + 3] for c in some for k in range(len(c) - 2)})) for i, some in names.items()}


def test_saved_postings_are_not_shuffled(spark, tmp_path, monkeypatch, capsys):
    pairs = lambda x: sorted((bytes(r.trigram), r.id) for r in x.collect())
    rows = spark.createDataFrame([(i, f"/data/n{i}/abc") for i in range(200)] + [(None, "/none")], "id long, path string")
    old, now = rows.filter("id is null or id < 150"), rows.filter("id % 5 <> 3")
    dealt = index.dealt(old, 150)
    assert dealt.rdd.getNumPartitions() == 1 and index.dealt(old, 3 * index.TASK_FILES + 1).rdd.getNumPartitions() == 4 and index.dealt(old, 0).count() == 151
    index.save(index.postings(dealt), dealt, str(tmp_path))
    want = pairs(index.postings(now))
    by_size = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(by_size, "-1")
    for held in (index.GONE_HELD, 0):
        monkeypatch.setattr(index, "GONE_HELD", held)
        brought = index.load(now, str(tmp_path))
        capsys.readouterr()
        brought.explain()
        assert capsys.readouterr().out.count("BroadcastHashJoin") == (held > 0)
        assert pairs(brought) == want
    spark.conf.unset(by_size)
