"""A file catalog, tags, opens and events derived from the test tables by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths

NOW = 1706659200  # 2024-01-31T00:00:00Z
ROOTS = [("docs", "/data/docs"), ("data", "/data"), ("web", "/mnt/web")]
DOC_ROOT = "/data/docs"
EXTENSIONS = (".md", ".txt", ".JSON", "", ".tar.gz")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _suffix(key) -> F.Column:
    return F.element_at(F.array(*map(F.lit, EXTENSIONS)), (key % 5 + 1).cast("int"))


def doc_rel() -> F.Column:
    return F.concat("lang", F.lit("/"), "source", F.lit("/doc-"), F.col("doc_id").cast("string"), _suffix(F.col("doc_id")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, is_dir, mtime, size"""
    t = lambda name: _table(spark, sf_dir, name)
    no = F.lit(False).alias("is_dir")
    docs = t("documents").select(F.concat(F.lit(DOC_ROOT + "/"), doc_rel()).alias("path"), no, (F.lit(1704067200) + F.col("doc_id") * 61).alias("mtime"), F.col("n_chars").alias("size"))
    key = F.col("p_partkey").cast("long")
    parts = t("part").select(
        F.concat(F.lit("/data/parts/"), "p_brand", F.lit("/"), "p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), key.cast("string"), _suffix(key)).alias("path"),
        no,
        (F.lit(1600000000) + key * 97).alias("mtime"),
        (F.col("p_size").cast("long") * 1024).alias("size"),
    )
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/+$", "")
    pages = t("pages").select(F.concat(F.lit("/mnt/web/"), bare).alias("path"), "page_id", F.length("html").cast("long").alias("size"))
    pages = pages.groupBy("path").agg(F.min("page_id").alias("page_id"), F.max("size").alias("size")).select("path", no, (F.lit(1650000000) + F.col("page_id") * 13).alias("mtime"), "size")
    s = F.col("s_suppkey").cast("long")
    suppliers = t("supplier").select(F.concat(F.lit("/data/docs-archive/supplier-"), s.cast("string"), F.lit(".csv")).alias("path"), no, (F.lit(1500000000) + s).alias("mtime"), (s * 10).alias("size"))
    n = F.col("n_nationkey").cast("long")
    nations = t("nation").select(F.concat(F.lit("/data/src/"), F.when(n % 2 == 0, "main").otherwise("target"), F.lit("/nation_"), n.cast("string"), F.lit(".rs")).alias("path"), no, (F.lit(1550000000) + n).alias("mtime"), n.alias("size"))
    return docs.unionByName(parts).unionByName(pages).unionByName(suppliers).unionByName(nations)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and the folders above them; a folder's time is the latest below it.

    Times go by folder before they go up, and files are dealt by path before equal paths meet, so that no
    task sorts what it has read with all the folders above it.
    """
    own = files(spark, sf_dir).filter("path is not null").withColumn("own", F.lit(True))
    folders = own.groupBy(paths.parent(F.col("path")).alias("folder")).agg(F.max("mtime").alias("mtime")).filter("folder <> ''")
    above = folders.select(F.explode(F.array_append(paths.ancestors(F.col("folder")), F.col("folder"))).alias("path"), "mtime").groupBy("path").agg(F.max("mtime").alias("mtime"))
    above = above.select("path", F.lit(True).alias("is_dir"), "mtime", F.lit(0).cast("long").alias("size"), F.lit(False).alias("own"))
    best = F.max_by(F.struct("is_dir", "mtime", "size"), F.struct("own", "mtime")).alias("best")
    return own.unionByName(above).repartition("path").groupBy("path").agg(best).select("path", "best.*")


def with_id(rows: DataFrame) -> DataFrame:
    """An id for tests: a hash of the path."""
    return rows.withColumn("id", F.conv(F.substring(F.md5(F.encode("path", "UTF-8")), 1, 12), 16, 10).cast("long"))


def tag_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root, rel, tags, size, mtime_ns, fp"""
    marked = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents"), "doc_id")
    tags = F.array_sort(F.filter(F.array(F.when(F.col("quality") == 1, "high quality").otherwise("low quality"), F.when(F.col("toxic") == 1, "toxic"), F.col("lang")), lambda t: t.isNotNull()))
    return marked.select(
        F.lit(DOC_ROOT).alias("root"),
        doc_rel().alias("rel"),
        tags.alias("tags"),
        F.col("n_chars").alias("size"),
        ((F.lit(1704067200) + F.col("doc_id") * 61) * 1_000_000_000 + 5).alias("mtime_ns"),
        F.md5(F.encode("text", "UTF-8")).alias("fp"),
        "doc_id",
    )


def stale_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag entries behind the tree: every seventh under an old path, every eleventh of another size."""
    out = tag_entries(spark, sf_dir)
    out = out.withColumn("rel", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("old/"), "rel")).otherwise(F.col("rel")))
    return out.withColumn("size", F.when((F.col("doc_id") % 11 == 0) & (F.col("doc_id") % 7 != 0), F.col("size") + 1).otherwise(F.col("size"))).drop("doc_id")


def disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel, size, mtime_ns, fp of the tree under the tags, every thirty-fifth document gone."""
    docs = _table(spark, sf_dir, "documents").filter("doc_id % 35 <> 0")
    return docs.select(doc_rel().alias("rel"), F.col("n_chars").alias("size"), ((F.lit(1704067200) + F.col("doc_id") * 61) * 1_000_000_000 + 5).alias("mtime_ns"), F.md5(F.encode("text", "UTF-8")).alias("fp"))


def seconds(ts) -> F.Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp")) if isinstance(ts, str) else F.unix_timestamp(ts.cast("timestamp"))


def opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file (path), ts: the views among the events, of the document of the user's number."""
    seen = _table(spark, sf_dir, "events").filter("event_type = 'view'")
    docs = _table(spark, sf_dir, "documents")
    return seen.join(docs, seen["user_id"] == docs["doc_id"]).select(F.concat(F.lit(DOC_ROOT + "/"), doc_rel()).alias("file"), seconds("ts").alias("ts"))


def fs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, kind, path, is_dir, mtime, size"""
    seen = _table(spark, sf_dir, "events").filter("event_type <> 'view'")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "remove").otherwise("modify")
    both = seen.join(docs, seen["user_id"] == docs["doc_id"])
    return both.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.concat(F.lit(DOC_ROOT + "/"), doc_rel()).alias("path"), F.lit(False).alias("is_dir"), seconds("ts").alias("mtime"), F.floor("value").cast("long").alias("size"))
