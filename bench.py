"""Headline searches over the derived catalog; prints one JSON line.

The catalog and the trigram index are made and stored once (catalog_build,
index_build), then loaded and held in memory, as a finder does (catalog_load,
index_load). Every search has warm-up runs and then timed ones; its figure is
the median. Beside the total: "index", the same selective search with the block
signatures (of the files on disk, with the rows read), with postings (in memory)
and as a scan (in memory); "many", some hundred lines in one pass; "scaling",
files and total of the searches at the next smaller size, if it is there;
"large", some searches over a catalog of millions of files, copies of this one
under other folders, read from disk. BENCH_SF_DIR: the tables (default sf0.1);
BENCH_CPUS: threads; BENCH_COPIES: how many copies (default 60).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import tempfile
import time

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pathloom import fixtures as fx
from pathloom.functions import frecency
from pathloom.operators import catalog as cat
from pathloom.operators import blocks, index, many, search, tags
from pathloom.plans.language import parse
from pathloom.streaming import feed

DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
COPIES = int(os.environ.get("BENCH_COPIES", "60"))
WARM, RUNS = 3, 7

LINES = {
    "substring_short": "doc",
    "substring_selective": "blue_gear",
    "extension": "*.md",
    "extension_text": "gear *.json",
    "regex": "/doc-[0-9]*[05]1?\\.(md|txt)$",
    "glob": "doc-1?.*",
    "fuzzy": "~geer",
    "path_aware": "parts/gear",
    "no_hit": "xyzzyplugh",
    "two_characters": "ab",
    "folders": "folder:src",
}


def timed(run, warm: int = WARM, runs: int = RUNS) -> dict[str, float]:
    for _ in range(warm):
        run()
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    took.sort()
    at = lambda p: took[min(len(took) - 1, int(len(took) * p))]
    return {k: round(v, 4) for k, v in {"min": took[0], "median": statistics.median(took), "p95": at(0.95), "p99": at(0.99), "max": took[-1]}.items()}


def searches(spark: SparkSession, catalog, folder: str, runs: int = RUNS) -> dict[str, dict[str, float]]:
    rows, stats = catalog.drop("id"), {}
    entries, access = fx.tag_entries(spark, folder).cache(), frecency.roll_up(fx.opens(spark, folder)).cache()
    entries.count(), access.count()
    for name, line in LINES.items():
        stats[name] = timed(lambda line=line: search.search_all(rows, line, fx.ROOTS).collect(), runs=runs)
    stats["frecency_top"] = timed(lambda: search.search_all(rows, parse("doc", 7), fx.ROOTS, access=access, now=fx.NOW).collect(), runs=runs)
    stats["tag"] = timed(lambda: search.search_tagged(entries, rows, "t:toxic&en", fx.ROOTS).collect(), runs=runs)
    stats["tag_counts"] = timed(lambda: tags.counts(entries).collect(), runs=runs)
    entries.unpersist()
    access.unpersist()
    return stats


def clocked(run):
    began = time.perf_counter()
    out = run()
    return out, {"median": round(time.perf_counter() - began, 4)}


def held(spark: SparkSession, folder: str, store: str):
    """(catalog in memory, seconds to make and store it, seconds to load it)"""
    _, made = clocked(lambda: fx.with_id(fx.catalog(spark, folder)).write.parquet(store))
    catalog = spark.read.parquet(store).repartition(int(CPUS)).cache()
    return catalog, made, clocked(catalog.count)[1]


def large(spark: SparkSession, store: str, top: str) -> dict:
    """Searches over copies of the stored catalog under other folders: from plain files, and from blocks with signatures."""
    copy = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))
    rows = spark.read.parquet(store).drop("id").withColumn("copy", copy).select(F.concat(F.lit("/copy-"), "copy", "path").alias("path"), "is_dir", "mtime", "size")
    _, plain = clocked(lambda: rows.repartition(4 * int(CPUS)).write.parquet(f"{top}/large"))
    table, built = clocked(lambda: blocks.Blocks.create(rows, f"{top}/large-blocks", block_rows=16384))
    scan = spark.read.parquet(f"{top}/large")
    out = {"files": scan.count(), "write": plain["median"], "blocks_build": built["median"]}
    for name, line in {"selective": "copy-17/blue_gear", "phrase": "doc-4711", "regex": "/copy-3/data/docs/.*doc-471[0-9]", "fuzzy": "~dok-4711", "no_hit": "xyzzyplugh"}.items():
        count = lambda rows: rows.agg(F.count("*")).collect()
        report = table.report(line)
        out[name] = {
            "scan": timed(lambda line=line: count(scan.filter(search.plan.row_filter(parse(line)))), 1, 3)["median"],
            "blocks": timed(lambda line=line: count(table.search(line)), 1, 3)["median"],
            "rows_read": report["rows"],
        }
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory(prefix="pathloom-bench-") as top:
        stats = {}
        catalog, stats["catalog_build"], stats["catalog_load"] = held(spark, DIR, f"{top}/catalog")
        n = catalog.count()
        _, stats["index_build"] = clocked(lambda: index.save(index.postings(catalog), catalog, f"{top}/index"))
        postings, stats["index_load"] = clocked(lambda: index.load(catalog, f"{top}/index").cache())
        loaded = clocked(postings.count)[1]["median"]
        stats["index_load"]["median"] = round(stats["index_load"]["median"] + loaded, 4)
        own = searches(spark, catalog, DIR)
        stats |= own
        rows = catalog.drop("id")
        stats["upsert"] = timed(lambda: cat.upsert(rows, rows.filter("size % 3 = 0")).agg(F.sum("size")).collect(), 1, 3)
        stats["events_replay"] = timed(lambda: feed.apply_events(rows, fx.fs_events(spark, DIR)).agg(F.sum("size")).collect(), 1, 3)
        table, built = clocked(lambda: blocks.Blocks.create(rows, f"{top}/blocks", block_rows=1024))
        report = table.report("blue_gear")
        stored, count = spark.read.parquet(f"{top}/catalog"), lambda rows: rows.agg(F.count("*")).collect()
        one = lambda rows: rows.filter(F.contains(F.lower("path"), F.lit("doc-4711")))
        beside = {
            "one_file": {
                "with_index": timed(lambda: count(table.search("doc-4711")), 3, 5)["median"],
                "scan": timed(lambda: count(one(stored)), 3, 5)["median"],
                "scan_in_memory": timed(lambda: count(one(rows)), 3, 5)["median"],
                "rows_read": table.report("doc-4711")["rows"],
            },
            "with_index": timed(lambda: table.search("blue_gear").agg(F.count("*")).collect(), 3, 5)["median"],
            "blocks_build": built["median"],
            "rows_read": report["rows"],
            "all_rows": report["all_rows"],
            "with_postings": timed(lambda: index.search_indexed(catalog, postings, "blue_gear").agg(F.count("*")).collect(), 1, 3)["median"],
            "scan": timed(lambda: catalog.filter(F.contains(F.lower("path"), F.lit("blue_gear"))).agg(F.count("*")).collect(), 3, 5)["median"],
        }
        part = spark.read.parquet(f"{DIR}/part.parquet")
        lines = [(r.line, r.line) for r in part.select(F.explode(F.array(F.replace("p_name", F.lit(" "), F.lit("_")), F.concat("p_brand", F.lit(" *.md")), F.concat("p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_"))))).alias("line")).distinct().collect()]
        in_one = {"lines": len(lines), "seconds": timed(lambda: many.search_lines(rows, lines, fx.ROOTS, 50).collect(), 1, 3)["median"]}
        postings.unpersist()
        catalog.unpersist()
        scale = re.search(r"sf([\d.]+)", DIR)
        scaling, smaller = {}, DIR.replace("sf0.1", "sf0.01")
        if smaller != DIR and os.path.isdir(smaller):
            few, _, _ = held(spark, smaller, f"{top}/few")
            total = lambda x: round(sum(v["median"] for v in x.values()), 4)
            scaling = {"files": [few.count(), n], "searches": [total(searches(spark, few, smaller, 3)), total(own)]}
        huge = large(spark, f"{top}/catalog", top)
        queries = {k: v["median"] for k, v in stats.items()}
        line = {"metric": "catalog_search_total", "value": round(sum(queries.values()), 4), "unit": "sec", "queries": queries, "sf": float(scale[1]) if scale else None, "files": n, "index": beside, "many": in_one, "scaling": scaling, "large": huge, "statistics": stats}
        print(json.dumps(line))
        spark.stop()


if __name__ == "__main__":
    main()
