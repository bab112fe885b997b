"""The trigram index: an optional accelerator. Results are always those of the whole predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import compile as plan
from ..plans.language import GLOB, REGEX, SUBSTRING, Query, parse
from ..plans.patterns import glob_literals, required_literals


def _grams(raw: Column) -> Column:
    n = F.octet_length(raw)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(raw, i, F.lit(3)))).otherwise(F.array().cast("array<binary>"))


def byte_trigrams(text: Column) -> Column:
    """Byte trigrams of a lower-cased text, as an array of binary; empty below three bytes."""
    return F.flatten(F.transform(F.array(F.encode(F.lower(text), "UTF-8")), _grams))


def path_trigrams(path: Column) -> Column:
    """Distinct trigrams of the components of a path; none reaches across a slash.

    The bytes are a lambda's variable, so that they aren't made again for each trigram. Strings are
    told apart by hash, binary values only pair by pair.
    """
    raw = F.transform(F.split(F.lower(path), "/"), lambda name: F.encode(name, "UTF-8"))
    return F.array_distinct(F.flatten(F.transform(raw, _grams)).cast("array<string>")).cast("array<binary>")


def postings(catalog: DataFrame) -> DataFrame:
    """(trigram, id), one row for each trigram of a file."""
    return catalog.select("id", F.explode(path_trigrams(F.col("path"))).alias("trigram")).select("trigram", "id")


PART_IDS = 1 << 16
TASK_FILES = 1 << 15  # files whose postings a task sorts: some two million rows
GONE_HELD = 1 << 20  # ids of deleted files up to which each executor is given all of them


def dealt(catalog: DataFrame, files: int) -> DataFrame:
    """A catalog of so many files in tasks of about TASK_FILES, so that none makes more postings as it grows."""
    return catalog.repartition(max(1, -(-files // TASK_FILES)), "id")


def posting_lists(rows: DataFrame, part_ids: int = PART_IDS) -> DataFrame:
    """(trigram, part, ids sorted): a part holds the ids from part * part_ids on, so no list grows with the catalog."""
    part = F.floor(F.col("id") / part_ids).cast("long")
    return rows.groupBy("trigram", part.alias("part")).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def backfill(cached: DataFrame, catalog: DataFrame, next_id: int) -> DataFrame:
    """Cached postings with those of the files whose id is next_id or more."""
    return cached.unionByName(postings(catalog.filter(F.col("id") >= next_id)))


def cache_is_usable(n_files: int, cached_files: int) -> bool:
    """Whether a stored index is near enough to the catalog: within a hundredth, or a hundred files."""
    return abs(n_files - cached_files) <= max(n_files // 100, 100)


def save(rows: DataFrame, catalog: DataFrame, folder: str, facts: DataFrame | None = None) -> None:
    """Postings, the ids they were made of, and as facts the number of files and the next free id they stand for.

    The facts are those of the catalog unless others are given. They are written last: without them nothing is there.
    Each task sorts and writes the postings it makes: they aren't shuffled, and a trigram of all paths isn't one task's.
    """
    rows.sortWithinPartitions("trigram").write.mode("overwrite").parquet(f"{folder}/postings")
    catalog.select("id").write.mode("overwrite").parquet(f"{folder}/ids")
    if facts is None:
        facts = catalog.agg(F.count("*").alias("files"), (F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))
    facts.write.mode("overwrite").parquet(f"{folder}/facts")


def load(catalog: DataFrame, folder: str) -> DataFrame:
    """Saved postings brought up to the catalog: rows of deleted files go, those of newer files come. Too far off: made anew.

    The deleted ids are found among ids; the postings, far more rows, are shuffled only if more than GONE_HELD are deleted.
    """
    spark = catalog.sparkSession
    facts = spark.read.parquet(f"{folder}/facts").first()
    if not cache_is_usable(catalog.count(), facts.files):
        return postings(catalog)
    gone = spark.read.parquet(f"{folder}/ids").join(catalog.select("id"), "id", "left_anti")
    if gone.count() <= GONE_HELD:
        gone = F.broadcast(gone)
    kept = spark.read.parquet(f"{folder}/postings").filter("id is not null").join(gone, "id", "left_anti").select("trigram", "id")
    return backfill(kept, catalog, facts.next_id)


def rebuild(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, trigrams): stored ones where there are any, else computed."""
    return files.join(stored.select("id", F.col("trigrams").alias("__stored")), "id", "left").select("id", F.coalesce("__stored", path_trigrams(F.col("path"))).alias("trigrams"))


def query_trigrams(text: str) -> list[bytes]:
    raw = text.lower().encode()
    return list(dict.fromkeys(raw[i : i + 3] for i in range(len(raw) - 2)))


def intersect(rows: DataFrame, trigrams: list[bytes]) -> DataFrame:
    """Ids that have all of the trigrams."""
    wanted = rows.filter(F.col("trigram").isin(*trigrams))
    return wanted.groupBy("id").agg(F.count_distinct("trigram").alias("n")).filter(F.col("n") == len(trigrams)).select("id")


def union(rows: DataFrame, trigrams: list[bytes]) -> DataFrame:
    """Ids that have any of them."""
    return rows.filter(F.col("trigram").isin(*trigrams)).select("id").distinct()


def needed_trigrams(query: Query) -> list[list[bytes]]:
    """Alternatives: a matching path's components have all trigrams of one of them. None at all: the index can't help."""
    if query.mode == SUBSTRING:
        alternatives = [[*query.text.split("/"), *(query.segments or ())]]  # a segment lies in one component
    elif query.mode == REGEX:
        alternatives = [required_literals(query.text)]
    elif query.mode == GLOB:
        alternatives = [glob_literals(query.text)]
    else:
        alternatives = [[piece] for piece in plan.typo_pieces(query.text.lower(), query.distance)] if "/" not in query.text else [[]]
    out = [list(dict.fromkeys(t for text in texts for t in query_trigrams(text))) for texts in alternatives]
    return out if all(out) else []


def candidates(catalog: DataFrame, rows: DataFrame, query: Query | str) -> DataFrame:
    """Catalog rows that may match: a semi-join with the postings where that is sound, else all."""
    query = parse(query) if isinstance(query, str) else query
    needed = needed_trigrams(query)
    if not needed:
        return catalog
    if len(needed) == 1:
        return catalog.join(intersect(rows, needed[0]), "id", "left_semi")
    met = rows.filter(F.col("trigram").isin(*{t for alternative in needed for t in alternative})).groupBy("id")
    whole = [(F.count_distinct(F.when(F.col("trigram").isin(*a), F.col("trigram"))) == len(a)).alias(f"a{i}") for i, a in enumerate(needed)]
    hit = met.agg(*whole).filter(" or ".join(f"a{i}" for i in range(len(needed))))
    return catalog.join(hit, "id", "left_semi")


def search_indexed(catalog: DataFrame, rows: DataFrame, query: Query | str) -> DataFrame:
    query = parse(query) if isinstance(query, str) else query
    return candidates(catalog, rows, query).filter(plan.row_filter(query))


def statistics(catalog: DataFrame, rows: DataFrame, n_roots: int) -> DataFrame:
    """One row: files, trigrams, roots."""
    files = catalog.agg(F.count("*").alias("files"))
    grams = rows.agg(F.count_distinct("trigram").alias("trigrams"))
    return files.join(grams, how="cross").withColumn("roots", F.lit(n_roots).cast("long"))  # two single rows
