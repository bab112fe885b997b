"""Block signatures, bitmap postings, typo search and many lines in one pass, against plain answers."""

import random

import pytest
from pyspark.sql import functions as F
from test_search import ROWS, plain

from pathloom.operators import bitmaps, blocks, index, many, search
from pathloom.plans import compile as plan
from pathloom.plans.language import parse

WORDS = ["src", "Config", "main", "été", "DOC", "gear_1", "target-2", "README", "blue", "archive"]
LINES = ["config", "CONFIG *.md", "folder:src", "src/main", "~confg", "~raedme", "~gear_", "/doc.*md$", "m?in", "*a*[0-9]*", "été", "*.gz", "", "x y", "/^/(src|doc)", "blue", "~archvie *.rs"]


@pytest.fixture(scope="module")
def catalog(spark):
    rng = random.Random(5)
    paths = {"/" + "/".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) + f"-{rng.randrange(60)}" + rng.choice(["", ".md", ".RS", ".tar.gz"]): rng.random() < 0.2 for _ in range(600)}
    rows = spark.createDataFrame([(p, d, rng.randrange(90), rng.randrange(50)) for p, d in paths.items()], ROWS).cache()
    return rows, paths


def matching(paths, line):
    return {p for p, is_dir in paths.items() if plain(parse(line), p, is_dir)}


@pytest.mark.parametrize("pages,held", [(1, 4096), (3, 4096), (2, 0)])
def test_blocks_give_the_rows_of_a_scan(catalog, tmp_path, pages, held):
    rows, paths = catalog
    table = blocks.Blocks.create(rows.filter("mtime < 80"), str(tmp_path / "b"), block_rows=20, pages=pages, held=held)
    table.append(rows.filter("mtime >= 80"), block_rows=20)
    for line in LINES:
        assert {r.path for r in table.search(line).collect()} == matching(paths, line), line
    assert table.read().count() == len(paths)
    narrow, wide, none = table.report("target-2-17"), table.report("*.md"), table.report("no such thing")
    assert 0 < narrow["rows"] < narrow["all_rows"] / 2 and wide["rows"] == wide["all_rows"] == len(paths) and none["blocks"] == 0


def test_a_block_read_touches_its_files_only(catalog, tmp_path):
    table = blocks.Blocks.create(catalog[0], str(tmp_path / "b"), block_rows=20)
    found = table.find("target-2-17")
    assert {f.rsplit("/", 1)[1] for f in table.candidates("target-2-17").inputFiles()} == {f.rsplit("/", 1)[1] for f, _ in found}


def test_no_blocks(spark, tmp_path):
    table = blocks.Blocks.create(spark.createDataFrame([], ROWS), str(tmp_path / "b"))
    assert table.search("x").count() == 0 and table.find("") == []


@pytest.mark.parametrize("sparse", [0, 5, 1 << 15])
def test_bitmaps_as_sets(spark, sparse):
    rng = random.Random(sparse)
    grams = [b"aaa", b"bbb", b"ccc", b"ddd"]
    has = {g: set(rng.sample(range(1, 100_000), n)) for g, n in zip(grams, (60, 900, 20_000, 70_000))}
    has[b"aaa"] |= {1, 32768, 32769, 65536}
    rows = spark.createDataFrame([(bytearray(g), i) for g, ids in has.items() for i in ids] + [(bytearray(b"aaa"), 1)], "trigram binary, id long")
    lists = bitmaps.containers(rows, sparse).cache()
    ids = lambda df: sorted(r.id for r in df.collect())
    for some in (grams[:1], grams[:2], grams[2:], grams, [b"ddd", b"zzz"]):
        assert ids(bitmaps.intersect(lists, some)) == sorted(set.intersection(*(has.get(g, set()) for g in some)))
        assert ids(bitmaps.union(lists, some)) == sorted(set.union(*(has.get(g, set()) for g in some)))
    assert {bytes(r.trigram): r.n for r in bitmaps.counts(lists).collect()} == {g: len(x) for g, x in has.items()}
    size = bitmaps.size(lists).first()
    assert size.ids == sum(map(len, has.values())) and (size.bitmap_bytes == 0) == (sparse > 32767) and (size.place_bytes == 0) == (sparse == 0)


def test_typos_in_one_pass(spark):
    rng = random.Random(3)
    paths = {"/a/" + "".join(rng.choice("abcé😀d") for _ in range(rng.randint(1, 40))) + rng.choice(["", ".x"]): False for _ in range(300)}
    texts = ["".join(rng.choice("abcé😀d") for _ in range(n)) for n in (1, 2, 4, 6, 7, 9, 13, 20, 61, 62, 63)]
    rows = spark.createDataFrame([(p, d, 0, 0) for p, d in paths.items()], ROWS)
    for r in rows.select("path", *(plan.row_filter(parse("~" + t)).alias(f"q{i}") for i, t in enumerate(texts))).collect():
        for i, t in enumerate(texts):
            assert r[f"q{i}"] == plain(parse("~" + t), r.path, False), (t, r.path)


def test_many_lines_as_one_by_one(spark, catalog, capsys):
    rows, _ = catalog
    roots = [("first", "/src"), ("all", "/")]
    lines = [*LINES, "parts/none", "folder:", "~x", "{a,b}*"]
    got = search.cut  # the same order as a single search
    asked = spark.createDataFrame([(f"{i}", line) for i, line in enumerate(lines)], "request string, line string")
    for per_pass in (1000, 7):
        found = many.search_many(rows, asked, roots, 9, per_pass).collect()
        for i, line in enumerate(lines):
            own = sorted(tuple(r)[1:] for r in found if r.request == f"{i}")
            assert own == [tuple(r) for r in search.search_all(rows, line, roots, 9).collect()], line
    sorted_too = many.search_lines(rows, [("r", "md")], roots, 5).select("rank", "path").collect()
    assert len(sorted_too) == 5 and got
    many.search_lines(rows, [(line, line) for line in lines], roots, 9).explain()
    plan_text = capsys.readouterr().out
    assert plan_text.count("InMemoryTableScan") == 1 and "WindowGroupLimit" in plan_text
    assert many.search_many(rows, asked.limit(0), roots).count() == 0
    with pytest.raises(ValueError):
        many.search_lines(rows, [("r", "~" + "x" * 63)], roots)


def test_saved_postings_are_dealt_by_ids_too(spark, tmp_path):
    rows = spark.range(0, 200_000, 5000).select(F.col("id"), F.lit("/abc").alias("path"), F.lit(False).alias("is_dir"), F.lit(1).alias("mtime"), F.lit(1).alias("size"))
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")
    index.save(index.postings(rows), rows, str(tmp_path))
    spark.conf.unset(merged)
    files = spark.read.parquet(f"{tmp_path}/postings").select(F.input_file_name()).distinct().count()
    assert files > 1 and index.load(rows, str(tmp_path)).count() == 40
