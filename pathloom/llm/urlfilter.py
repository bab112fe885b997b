"""URL allow and block rules by sort-merge range joins.

Native: DataFrame expressions only. Hosts become reversed canonical keys
("com.example.www."), so that a rule's host and all its subdomains are one
interval of keys, and intervals nest or are disjoint. Each interval bound
carries the stack of rule hosts that are active from there on, at most one for
each label of a host, whatever the number of rules. Urls and bounds are sorted
together, and a sweep hands every url the latest stack. For each of its hosts a
second sweep goes over that host's rule paths: what begins with a path is an
interval, too, whose start carries the path itself and whose end the next one
around it, so that the latest bound is the longest path that fits. The longest
rule of the hosts decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import n_partitions

SPREAD = 16  # sweeps over a host's paths
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without "://"."""
    whole = F.coalesce(url, F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(whole, shape, 1), _UPPER, _SMALL), F.regexp_extract(whole, shape, 2)


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(rules: DataFrame) -> DataFrame:
    """(at_host, prefix, verdict) of rules (host, path, verdict), one row a host and path; a block comes before an allow. Rules with a null or without a host are left out."""
    rules = rules.select(F.translate("host", _UPPER, _SMALL).alias("at_host"), F.col("path").alias("prefix"), "verdict").dropna().filter("at_host <> ''")
    first = F.min(F.struct(F.when(F.col("verdict") == "block", 0).otherwise(1).alias("kind"), "verdict")).alias("first")
    return rules.groupBy("at_host", "prefix").agg(first).select("at_host", "prefix", "first.verdict")


def host_bounds(rules: DataFrame) -> DataFrame:
    """Interval bounds (key, stack) of the hosts of a rule_table: the stack has the hosts with rules that are active from there on."""
    hosts = rules.select("at_host").distinct()
    labels = F.split("at_host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    above = hosts.select(F.col("at_host").alias("own"), F.explode(above).alias("at_host"))
    stacks = above.join(hosts, "at_host").groupBy("own").agg(F.collect_list("at_host").alias("stack")).withColumn("key", host_key(F.col("own")))  # a host has as many as labels
    closing = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))  # "/" follows "."
    return stacks.select("key", "stack").unionByName(stacks.select(closing.alias("key"), F.array_remove("stack", F.col("own")).alias("stack")))


def path_bounds(rules: DataFrame) -> DataFrame:
    """Interval bounds (at_host, at, fits) of the paths of a rule_table: fits has the longest path from there on and its verdict, or null fields."""
    n = F.length("prefix")
    shorter = rules.select("at_host", "prefix", F.explode(F.sequence(F.lit(0), n - 1)).alias("k")).filter(n > 0)
    shorter = shorter.select("at_host", F.col("prefix").alias("whole"), F.expr("substring(prefix, 1, k)").alias("prefix"))
    around = shorter.join(rules, ["at_host", "prefix"]).groupBy("at_host", "whole").agg(F.max_by(F.struct("prefix", "verdict"), F.length("prefix")).alias("outer"))
    both = rules.join(around.withColumnRenamed("whole", "prefix"), ["at_host", "prefix"], "left")
    none = F.struct(F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("string").alias("verdict"))
    at = F.hex(F.encode("prefix", "UTF-8"))
    start = F.struct(at.alias("at"), F.struct("prefix", "verdict").alias("fits"))
    end = F.struct(F.concat(at, F.lit("G")).alias("at"), F.coalesce("outer", none).alias("fits"))  # "G" follows all hexadecimal digits
    return both.select("at_host", F.inline(F.array(start, end)))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int | None = None) -> DataFrame:
    """Every row of `pages` (page_id, url) with host, path, rule and verdict; other columns are left out.

    rule: host and path of the longest rule that fits (of equal length, the one
    of the longer host), else null; verdict: the rule's, else `default`. A null
    url has empty host and path and fits no rule. Without rules all urls get
    `default`. Rows that repeat stay. Urls are dealt by hash to `salts` sweeps,
    each with all host bounds, so a host that holds most rows is split. By
    default there are so many that the bounds' copies aren't more than the urls,
    but a sweep for each partition at least. Work and memory grow with the urls
    and the rules, not with their product, nor with the rules of a host times the hosts below it.
    """
    rules = rule_table(rules)
    found, parts = host_bounds(rules), n_partitions(pages.sparkSession)
    if salts is None:
        salts = min(max(1024, 8 * parts), max(parts, pages.count() // max(1, found.count())))
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).groupBy("page_id", "host", "path").agg(F.count("*").alias("times"))
    spot = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    urls = urls.withColumn("salt", spot(salts, "page_id", "path")).withColumn("key", host_key(F.col("host"))).withColumn("is_url", F.lit(True))
    both = urls.unionByName(found.withColumn("salt", copies(salts)).withColumn("is_url", F.lit(False)), allowMissingColumns=True)
    sweep = Window.partitionBy("salt").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("hosts", F.last("stack", ignorenulls=True).over(sweep)).filter("is_url")

    # Without a host the url stays, too: it asks for none. The paths of a host are copied to few sweeps, its urls are dealt to them.
    asked = swept.select("page_id", "host", "path", "times", F.explode_outer("hosts").alias("at_host"), F.hex(F.encode("path", "UTF-8")).alias("at"))
    asked = asked.withColumn("salt", spot(SPREAD, "page_id", "path")).withColumn("is_url", F.lit(True))
    both = asked.unionByName(path_bounds(rules).withColumn("salt", copies(SPREAD)).withColumn("is_url", F.lit(False)), allowMissingColumns=True)
    sweep = Window.partitionBy(spot(parts, "at_host"), "salt").orderBy("at_host", "at", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = both.withColumn("fits", F.last("fits", ignorenulls=True).over(sweep)).filter("is_url")
    rule = F.concat("at_host", "fits.prefix")
    best = F.when(rule.isNotNull(), F.struct(F.length(rule).alias("n"), F.length("at_host").alias("host_n"), rule.alias("rule"), F.col("fits.verdict").alias("verdict")))
    out = fits.groupBy("page_id", "host", "path", "times").agg(F.max(best).alias("best"))
    out = out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("time"))
    return out.drop("time")
