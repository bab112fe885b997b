"""One query for each operator over the derived catalog, and the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import formats, frecency, paths
from .operators import catalog as cat
from .operators import bitmaps, blocks, index, intervals, many, previews, requests, search, statistics, tags
from .plans import compile as plan
from .plans.language import EDIT, FILES, Query, Sort, parse
from .sources import changelog, tables, tagdoc, tree
from .streaming import feed, keyed
from .streaming.parts import PartTable

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


# -- SQL of the derived tables

_EXT = "case cast({k} as bigint) % 5 when 0 then '.md' when 1 then '.txt' when 2 then '.JSON' when 3 then '' else '.tar.gz' end"
_REL = "concat(lang, '/', source, '/doc-', cast(doc_id as varchar), " + _EXT.format(k="doc_id") + ")"
_BASE = f"""
files as (
    select concat('/data/docs/', {_REL}) as path, false as is_dir, 1704067200 + doc_id * 61 as mtime, n_chars as size from documents
    union all
    select concat('/data/parts/', p_brand, '/', p_type, '/', replace(p_name, ' ', '_'), '-', cast(p_partkey as varchar), {_EXT.format(k="p_partkey")}),
           false, 1600000000 + cast(p_partkey as bigint) * 97, cast(p_size as bigint) * 1024 from part
    union all
    select path, false, 1650000000 + page_id * 13, size from (
        select concat('/mnt/web/', regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/+$', '')) as path,
               min(page_id) as page_id, max(cast(length(html) as bigint)) as size from pages group by 1) v
    union all
    select concat('/data/docs-archive/supplier-', cast(s_suppkey as varchar), '.csv'), false, 1500000000 + cast(s_suppkey as bigint), cast(s_suppkey as bigint) * 10 from supplier
    union all
    select concat('/data/src/', case when n_nationkey % 2 = 0 then 'main' else 'target' end, '/nation_', cast(n_nationkey as varchar), '.rs'),
           false, 1550000000 + cast(n_nationkey as bigint), cast(n_nationkey as bigint) from nation),
ups as (select unnest(list_transform(range(2, len(parts)), lambda i: array_to_string(parts[1:i], '/'))) as path, mtime
        from (select string_split(path, '/') as parts, mtime from files) x),
dirs as (select path, true as is_dir, max(mtime) as mtime, cast(0 as bigint) as size from ups where path not in (select path from files) group by path),
raw_catalog as (select * from files union all select * from dirs),
catalog as (
    select *, regexp_extract(path, '[^/]*$') as name,
           case when regexp_matches(regexp_extract(path, '[^/]*$'), '^.+[.]') then regexp_extract(regexp_extract(path, '[^/]*$'), '^.+[.]([^.]*)$', 1) end as ext,
           regexp_replace(regexp_extract(path, '[^/]*$'), '(.)[.][^.]*$', '\\1') as stem,
           case when path = '/data/docs' or starts_with(path, '/data/docs/') then 'docs'
                when path = '/data' or starts_with(path, '/data/') then 'data'
                when path = '/mnt/web' or starts_with(path, '/mnt/web/') then 'web' end as bookmark,
           cast(concat('0x', substr(md5(path), 1, 12)) as bigint) as id
    from raw_catalog),
entries as (
    select '/data/docs' as root, {_REL} as rel, doc_id, n_chars as size, (1704067200 + doc_id * 61) * 1000000000 + 5 as mtime_ns, md5(text) as fp, lang,
           list_sort(list_filter([case when quality = 1 then 'high quality' else 'low quality' end, case when toxic = 1 then 'toxic' end, lang], lambda t: t is not null)) as tags
    from labels join documents using (doc_id)),
opens as (select concat('/data/docs/', {_REL}) as file, cast(floor(epoch(ts)) as bigint) as ts from events join documents on user_id = doc_id where event_type = 'view'),
access as (select file, count(*) as open_count, max(ts) as last_opened from opens group by file),
scores as (select *, case when open_count > 0 then ln(1.0 + open_count) * case when {fx.NOW} - last_opened < 3600 then 4.0 when {fx.NOW} - last_opened < 86400 then 2.0
           when {fx.NOW} - last_opened < 604800 then 1.5 when {fx.NOW} - last_opened < 2592000 then 1.0 else 0.5 end else 0.0 end as score from access),
stale as (select root, case when doc_id % 7 = 0 then concat('old/', rel) else rel end as rel, tags, case when doc_id % 11 = 0 and doc_id % 7 <> 0 then size + 1 else size end as size, mtime_ns, fp from entries),
disk as (select {_REL} as rel, n_chars as size, (1704067200 + doc_id * 61) * 1000000000 + 5 as mtime_ns, md5(text) as fp from documents where doc_id % 35 <> 0)
"""
_TAGS = "array_to_string(tags, ',')"


def _sql(body: str) -> str:
    return f"with {_BASE} {body}"


def _found(where: str, order: str = "mtime desc", most: int = 500, table: str = "catalog", scope: str = "bookmark is not null", columns: str = "path, is_dir, mtime, size, bookmark") -> str:
    return _sql(
        f"select * from (select cast(row_number() over (order by {order}, path) as int) as rank, {columns} from {table} where ({where}) and ({scope})) r where rank <= {most}"
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table that a query makes: below spark.checkpoint.dir, or in local mode a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            own = tempfile.TemporaryDirectory(prefix="pathloom-")
            atexit.register(own.cleanup)
            _OWN.append(own.name)
        named = _OWN[0]
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_OWN: list[str] = []


def query(name: str, sql: str | None = None):
    def keep(make):
        QUERIES[name] = make
        if sql is not None:
            ORACLE[name] = sql
        return make

    return keep


def _all(spark: SparkSession, sf_dir: str, text: str, sort: int = 0, most: int = 500, **order) -> DataFrame:
    return search.search_all(fx.catalog(spark, sf_dir), parse(text, sort), fx.ROOTS, most, **order)


# -- filters, scopes and sorts: (name, line, sort, what SQL asks for, its order, how many)

_SEARCHES = [
    ("substr_search", "GEAR", 0, "contains(lower(path), 'gear')", "mtime desc", 2000),
    ("substr_top_recent", "doc", 0, "contains(lower(path), 'doc')", "mtime desc", 20),
    ("ext_filter", "*.json", 0, "lower(ext) = 'json'", "mtime desc", 2000),
    ("ext_and_text", "gear *.MD", 0, "lower(ext) = 'md' and contains(lower(path), 'gear')", "mtime desc", 2000),
    ("regex_search", "/DOC-[0-9]*[05]1?\\.(md|txt)$", 0, "regexp_matches(path, '(?i)doc-[0-9]*[05]1?\\.(md|txt)$')", "mtime desc", 2000),
    ("glob_search", "doc-1?.*", 0, "regexp_matches(name, '(?s)^.*doc-1.\\..*$') or regexp_matches(path, '(?s)^.*doc-1.\\..*$')", "mtime desc", 2000),
    ("path_aware", "parts/SMALL/gear", 0, "contains(lower(name), 'gear') and regexp_matches(lower(path), '^(.*/)?[^/]*parts[^/]*/(.*/)?[^/]*small[^/]*/')", "mtime desc", 2000),
    ("folder_only", "folder:src", 0, "is_dir and contains(lower(name), 'src')", "mtime desc", 2000),
    ("sort_mtime_asc", "", 1, "true", "mtime", 300),
    ("sort_name_asc", "", 2, "true", "name", 300),
    ("sort_name_desc", "", 3, "true", "name desc", 300),
    ("sort_size_desc", "", 4, "true", "size desc", 300),
    ("sort_size_asc", "", 5, "true", "size", 300),
    ("sort_path", "", 6, "true", "path", 300),
]
for _name, _line, _sort, _where, _order, _most in _SEARCHES:
    query(_name, _found(_where, _order, _most))(lambda spark, d, line=_line, sort=_sort, most=_most: _all(spark, d, line, sort, most))


def _renamed(spark, d, line: str, before: str, after: str, most: int) -> DataFrame:
    rows = fx.catalog(spark, d).withColumn("path", F.replace("path", F.lit(before), F.lit(after)))
    return search.search_all(rows, line, fx.ROOTS, most)


def _renamed_sql(text: str, before: str, after: str, most: int) -> str:
    table = f"(select replace(path, '{before}', '{after}') as path, is_dir, mtime, size, bookmark from catalog) c"
    return _found(f"contains(lower(path), '{text}')", most=most, table=table)


@query("regex_invalid", _renamed_sql("/doc-(?=1", "/doc-1", "/doc-(?=1", 2000))
def regex_invalid(spark, d):
    """A pattern that isn't valid is looked for as it stands; here the names hold it."""
    return _renamed(spark, d, "/doc-(?=1", "/doc-1", "/doc-(?=1", 2000)


@query("two_words_one_phrase", _renamed_sql("src1 doc", "/doc-", " doc-", 500))
def two_words_one_phrase(spark, d):
    return _renamed(spark, d, "src1  doc", "/doc-", " doc-", 500)


_FUZZY = """contains(lower(name), 'geer') or case when length(stem) < 3 then false when length(stem) <= 4 then levenshtein('geer', lower(stem)) <= 1
    else len(list_filter(range(3, least(5, length(stem)) + 1), lambda w: len(list_filter(range(0, length(stem) - w + 1), lambda i: levenshtein('geer', substr(lower(stem), i + 1, w)) <= 1)) > 0)) > 0 end"""


@query("fuzzy_window", _found(_FUZZY, most=2000))
def fuzzy_window(spark, d):
    return _all(spark, d, "~geer", 0, 2000)


@query("fuzzy_stem", _sql("select path from catalog where contains(lower(name), 'dok-12') or levenshtein('dok-12', lower(stem)) <= 1"))
def fuzzy_stem(spark, d):
    return fx.catalog(spark, d).filter(plan.text_filter(parse("~dok-12"), tagged=True)).select("path")


@query("mode_gotofile", _found("not is_dir and contains(lower(path), 'src')", most=2000))
def mode_gotofile(spark, d):
    return search.search_all(fx.catalog(spark, d), Query(text="src", kind=FILES), fx.ROOTS, 2000)


@query("mode_edit", _found("not is_dir and coalesce(lower(ext) not in ({}), true) and contains(lower(path), 'doc')".format(", ".join(f"'{e}'" for e in plan.BINARY_EXTENSIONS)), most=2000))
def mode_edit(spark, d):
    return search.search_all(fx.catalog(spark, d), Query(text="doc", kind=EDIT), fx.ROOTS, 2000)


@query("scope_first_match", _sql("select path, bookmark from catalog where bookmark is not null"))
def scope_first_match(spark, d):
    return search.attribute(fx.catalog(spark, d), fx.ROOTS).select("path", "bookmark")


@query("scope_many_roots", _sql("select path, bookmark from catalog where bookmark is not null"))
def scope_many_roots(spark, d):
    return search.attribute(fx.catalog(spark, d), fx.ROOTS + [(f"none{i}", f"/none/{i}") for i in range(search.LITERAL_ROOTS)]).select("path", "bookmark")


_NESTED = "roots as (select path as root, id as ord from catalog where starts_with(path, '/data/parts/') or starts_with(path, '/mnt/web/') or path in ('/data/docs/en', '/data'))"


def _nested(spark, d) -> tuple[DataFrame, DataFrame]:
    """The catalog, and some thousand roots in one another: files and folders of it, in the order of their ids."""
    rows = fx.with_id(fx.catalog(spark, d))
    inside = F.startswith("path", F.lit("/data/parts/")) | F.startswith("path", F.lit("/mnt/web/")) | F.col("path").isin("/data/docs/en", "/data")
    return rows.drop("id"), rows.filter(inside).select(F.col("id").alias("ord"), F.col("path").alias("value"), "path")


@query("scope_nested_roots", _sql("").rstrip() + "," + _NESTED + "select c.path, min_by(root, ord) as bookmark from catalog c left join roots on c.path = root or starts_with(c.path, root || '/') group by c.path")
def scope_nested_roots(spark, d):
    return intervals.holder(*_nested(spark, d), "bookmark").select("path", "bookmark")


@query("scope_innermost_root", _sql("").rstrip() + "," + _NESTED + "select c.path, max_by(root, length(root)) as bookmark from catalog c left join roots on c.path = root or starts_with(c.path, root || '/') group by c.path")
def scope_innermost_root(spark, d):
    return intervals.holder(*_nested(spark, d), "bookmark", innermost=True).select("path", "bookmark")


@query("scope_single_root", _found("true", most=2000, scope="path = '/data/docs' or starts_with(path, '/data/docs/')", columns="path, is_dir, mtime, size"))
def scope_single_root(spark, d):
    return search.search_root(fx.catalog(spark, d), "", "/data/docs/", 2000)


@query("sort_frecency", _found("true", "score desc", 300, "(select c.*, coalesce(s.score, 0.0) as score from catalog c left join scores s on c.path = s.file)"))
def sort_frecency(spark, d):
    return _all(spark, d, "", 7, 300, access=frecency.roll_up(fx.opens(spark, d)), now=fx.NOW)


@query("frecency_of_search", _found("contains(lower(path), 'doc-1') and lower(ext) = 'md'", "score desc", 60, "(select c.*, coalesce(s.score, 0.0) as score from catalog c left join scores s on c.path = s.file)"))
def frecency_of_search(spark, d):
    return _all(spark, d, "doc-1 *.md", 7, 60, access=frecency.roll_up(fx.opens(spark, d)), now=fx.NOW)


@query("request_search", _found("contains(lower(path), 'gear') and lower(ext) = 'txt'", scope="path = '/data' or starts_with(path, '/data/')", columns="path, is_dir, mtime, size"))
def request_search(spark, d):
    return search.request_search(fx.catalog(spark, d), "folder:gear *.md t:toxic", "/data", "txt")


@query(
    "request_search_all",
    _found(
        "contains(lower(path), 'doc') and not regexp_matches(path, '^/data/(parts|docs-archive)(/|$)')",
        scope="bookmark in ('docs', 'data')",
    ),
)
def request_search_all(spark, d):
    return search.request_search_all(fx.catalog(spark, d), "doc *.zip", fx.ROOTS, ["/data/parts", "/data/docs", "/data/docs-archive", "/data"])


# -- tags

_TAGGED = """(select c.path, false as is_dir, c.mtime, c.size, coalesce(c.bookmark, '') as bookmark, tags, c.name, c.ext from entries e join catalog c on c.path = concat(e.root, '/', e.rel))"""


def _tagged(spark, d, line: str) -> DataFrame:
    return search.search_tagged(fx.tag_entries(spark, d), fx.catalog(spark, d), line, fx.ROOTS, 2000)


def _has(name: str) -> str:
    return f"len(list_filter(tags, lambda t: contains(lower(t), '{name}'))) > 0"


for _name, _line, _where in [
    ("tag_or", "t: toxic FR", f"{_has('toxic')} or {_has('fr')}"),
    ("tag_and", "t:high&en", f"{_has('high')} and {_has('en')}"),
    ("tag_multi_group", "t:quality AND es t:low OR toxic", f"{_has('quality')} and {_has('es')} and ({_has('low')} or {_has('toxic')})"),
    ("tag_any", "t:", "len(tags) > 0"),
    ("tag_text_refine", "doc-1 *.md t:quality", f"{_has('quality')} and lower(ext) = 'md' and contains(lower(path), 'doc-1')"),
]:
    query(_name, _found(_where, most=2000, table=_TAGGED))(lambda spark, d, line=_line: _tagged(spark, d, line))


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("rel", F.array_join("tags", ",").alias("tags"))


@query("tag_find_and_not", _sql(f"select rel, {_TAGS} as tags from entries where list_contains(tags, 'en') and not list_contains(tags, 'toxic')"))
def tag_find_and_not(spark, d):
    return _texts(tags.find(fx.tag_entries(spark, d), ["en"], [], ["toxic"]))


@query("tag_find_any", _sql(f"select rel, {_TAGS} as tags from entries where list_contains(tags, 'high quality') and (list_contains(tags, 'fr') or list_contains(tags, 'de'))"))
def tag_find_any(spark, d):
    return _texts(tags.find(fx.tag_entries(spark, d), ["high quality"], ["fr", "de"]))


@query("tag_counts", _sql("select tag, count(*) as n from (select unnest(tags) as tag from entries) t group by tag"))
def tag_counts(spark, d):
    return tags.counts(fx.tag_entries(spark, d))


def _english(spark, d) -> DataFrame:
    """The entries that the changes below touch: all files of a folder."""
    return fx.tag_entries(spark, d).filter("startswith(rel, 'en/')").select("rel")


@query("tags_add", _sql("select rel, case when lang = 'en' then array_to_string(list_sort(list_distinct(list_concat(tags, ['new', 'en']))), ',') else " + _TAGS + " end as tags from entries"))
def tags_add(spark, d):
    return _texts(tags.add(fx.tag_entries(spark, d), _english(spark, d), ["new", "en"]))


@query("tags_remove", _sql("select rel, array_to_string(tags, ',') as tags from (select rel, case when lang = 'en' then list_filter(tags, lambda t: t not in ('en', 'high quality', 'low quality')) else tags end as tags from entries) e where len(tags) > 0"))
def tags_remove(spark, d):
    return _texts(tags.remove(fx.tag_entries(spark, d), _english(spark, d), ["en", "high quality", "low quality"]))


@query("tags_set", _sql("select rel, case when lang = 'en' then 'a,b' else " + _TAGS + " end as tags from entries"))
def tags_set(spark, d):
    return _texts(tags.set_tags(fx.tag_entries(spark, d), _english(spark, d), ["b", "a", "b"]))


@query("tags_clear", _sql("select rel, " + _TAGS + " as tags from entries where lang <> 'en'"))
def tags_clear(spark, d):
    return _texts(tags.remove(fx.tag_entries(spark, d), _english(spark, d)))


@query(
    "list_dir",
    _sql("""select name, is_dir, mtime, c.size, coalesce(array_to_string(tags, ', '), '') as tags_text from catalog c left join entries e on c.path = concat(e.root, '/', e.rel)
            where regexp_matches(path, '^/data/docs/en/src1/[^/]+$')"""),
)
def list_dir(spark, d):
    return tags.list_dir(fx.catalog(spark, d), fx.tag_entries(spark, d), "/data/docs/en/src1/")


@query("tags_decorate", _sql("select path, coalesce(array_to_string(tags, ', '), '') as tags_text from catalog c left join entries e on c.path = concat(e.root, '/', e.rel)"))
def tags_decorate(spark, d):
    return tags.decorate(fx.catalog(spark, d), fx.tag_entries(spark, d)).select("path", "tags_text")


_REPAIR = """
orphans as (select *, row_number() over (partition by size, fp order by rel) as place from stale where rel not in (select rel from disk)),
loose as (select size, fp, count(*) as n, list_sort(list(rel)) as candidates from disk where rel not in (select rel from stale) group by size, fp),
planned as (select o.rel, o.size, o.fp, case when coalesce(n, 0) > 1 then 'ambiguous' when n = 1 and place = 1 then 'relinked' else 'missing' end as status, candidates
            from orphans o left join loose l on o.size = l.size and o.fp = l.fp)
"""


@query(
    "repair_plan",
    _sql("").rstrip() + "," + _REPAIR + "select rel, status, case when status = 'relinked' then candidates[1] end as new_rel, size, fp from planned",
)
def repair_plan(spark, d):
    return tags.repair_plan(fx.stale_entries(spark, d), fx.disk(spark, d))


@query("repair_candidates", _sql("").rstrip() + "," + _REPAIR + "select size, fp, unnest(candidates) as candidate from (select distinct size, fp, candidates from planned where status = 'ambiguous') a")
def repair_candidates(spark, d):
    return tags.repair_candidates(fx.stale_entries(spark, d), fx.disk(spark, d))


@query("repair_refreshed", _sql("select s.rel, t.size, t.mtime_ns, t.fp from stale s join disk t on s.rel = t.rel where s.size <> t.size or s.mtime_ns <> t.mtime_ns"))
def repair_refreshed(spark, d):
    return tags.refreshed(fx.stale_entries(spark, d), fx.disk(spark, d))


@query(
    "repair_entries",
    _sql("").rstrip() + "," + _REPAIR + """select coalesce(case when status = 'relinked' then candidates[1] end, s.rel) as rel, array_to_string(s.tags, ',') as tags, coalesce(t.size, s.size) as size
        from stale s left join planned p on s.rel = p.rel left join disk t on t.rel = coalesce(case when status = 'relinked' then candidates[1] end, s.rel) where coalesce(status, '') <> 'missing'""",
)
def repair_entries(spark, d):
    after, _ = tags.repair(fx.stale_entries(spark, d), fx.disk(spark, d), prune=True)
    return after.select("rel", F.array_join("tags", ",").alias("tags"), "size")


@query(
    "check_report",
    _sql("""select coalesce(s.rel, t.rel) as rel, case when s.rel is null then 'untracked' when t.rel is null then 'missing' when s.size <> t.size or s.mtime_ns <> t.mtime_ns then 'modified'
            when s.fp is distinct from t.fp then 'mismatch' else 'ok' end as status from stale s full join disk t on s.rel = t.rel"""),
)
def check_report(spark, d):
    return tags.check(fx.stale_entries(spark, d), fx.disk(spark, d), verify=True)


@query(
    "check_summary",
    _sql("""select count(s.rel) as entry_count, count(*) filter (s.rel is null) as untracked_count, count(*) filter (t.rel is null) as missing_count,
            count(*) filter (s.size <> t.size or s.mtime_ns <> t.mtime_ns) as modified_count, count(*) filter (false) as mismatch_count from stale s full join disk t on s.rel = t.rel"""),
)
def check_summary(spark, d):
    return tags.check_summary(fx.stale_entries(spark, d), fx.disk(spark, d))


@query("tag_store_roots", _sql("select distinct '/data/docs/' || lang as root from documents"))
def tag_store_roots(spark, d):
    rows = fx.catalog(spark, d)
    stores = rows.filter("startswith(path, '/data/docs/') and not is_dir").select(F.concat(paths.parent(paths.parent(F.col("path"))), F.lit("/.tagstore/index.json")).alias("path"))
    other = rows.filter("startswith(path, '/data/src/')").select(F.concat("path", F.lit("/.tagstore-old/.tagstore/x")).alias("path"))
    return cat.tag_store_roots(stores.unionByName(other))


@query("discover_root", _sql("select path, case when path = '/data/docs/en' or starts_with(path, '/data/docs/en/') then '/data/docs/en' else '/data' end as root from catalog where path = '/data' or starts_with(path, '/data/')"))
def discover_root(spark, d):
    roots = spark.createDataFrame([("/data",), ("/data/docs/en",), ("/data/doc",)], "root string")
    return cat.discover_root(fx.catalog(spark, d), roots)


# -- catalog maintenance

_NAMES = "|".join(n.replace(".", "\\.") for n in cat.EXCLUDED_NAMES)


@query(
    "exclude_builtin",
    _sql(f"select path from catalog where not ((is_dir and (regexp_matches(name, '^({_NAMES})$') or starts_with(name, '.Trash'))) or regexp_matches(path, '/({_NAMES}|\\.Trash[^/]*)/'))"),
)
def exclude_builtin(spark, d):
    return cat.without_excluded(fx.catalog(spark, d)).select("path")


@query("exclude_user", _sql("select path from catalog where not (path = '/data/docs' or starts_with(path, '/data/docs/') or path = '/mnt' or starts_with(path, '/mnt/'))"))
def exclude_user(spark, d):
    return cat.without_user_excluded(fx.catalog(spark, d), ["/data/docs/", "/mnt"]).select("path")


@query("subtree_delete", _sql("select path, is_dir, mtime, size from catalog where not (path = '/data/docs' or starts_with(path, '/data/docs/'))"))
def subtree_delete(spark, d):
    return cat.delete_subtree(fx.catalog(spark, d), "/data/docs")


def _changes(spark, d) -> DataFrame:
    """Part files with new sizes, and copies under a new folder."""
    parts = fx.files(spark, d).filter("startswith(path, '/data/parts/') and size % 3 = 0")
    return parts.withColumn("size", F.col("size") + 7).unionByName(parts.withColumn("path", F.concat(F.lit("/new"), "path")))


_CHANGES = "(select path, is_dir, mtime, size + 7 as size from files where starts_with(path, '/data/parts/') and size % 3 = 0 union all select '/new' || path, is_dir, mtime, size from files where starts_with(path, '/data/parts/') and size % 3 = 0)"


@query("upsert_latest", _sql(f"select * from {_CHANGES} n union all select path, is_dir, mtime, size from catalog where path not in (select path from {_CHANGES} n)"))
def upsert_latest(spark, d):
    return cat.upsert(fx.catalog(spark, d), _changes(spark, d))


@query("reconcile_new", _sql(f"select * from {_CHANGES} n where path not in (select path from catalog)"))
def reconcile_new(spark, d):
    return cat.unknown(_changes(spark, d), fx.catalog(spark, d))


@query("integrity_missing", _sql("select path, is_dir, mtime, size from catalog where not starts_with(path, '/mnt/web/') and path <> '/mnt/web' and size % 4 = 1"))
def integrity_missing(spark, d):
    rows = fx.catalog(spark, d)
    return cat.vanished(rows, rows.filter("size % 4 <> 1"), ["/mnt/web"])


@query("integrity_sweeps", _sql("select path from catalog where size % 4 <> 1"))
def integrity_sweeps(spark, d):
    rows = fx.catalog(spark, d)
    scanned = rows.filter("size % 4 <> 1")
    kept = [feed.sweep(cat.sweep_share(rows, number, 3), scanned, number, 3) for number in range(3)]
    return kept[0].unionByName(kept[1]).unionByName(kept[2]).select("path")


@query("id_highwater", _sql("select greatest(max(id), 5) as max_id from catalog"))
def id_highwater(spark, d):
    return cat.high_water(fx.with_id(fx.catalog(spark, d)), 5)


@query("id_assignment", _sql("select cast(1000 + row_number() over (order by path) as bigint) as id from catalog"))
def id_assignment(spark, d):
    return cat.assign_ids(fx.catalog(spark, d), 1000).select(F.col("id").cast("long"))


@query("delete_paths", _sql("select path from catalog where path not in (select '/data/docs/en' union all select path from catalog where size % 5 = 0 and not is_dir)"))
def delete_paths(spark, d):
    rows = fx.catalog(spark, d)
    gone = rows.filter("size % 5 = 0 and not is_dir").select("path").unionByName(spark.createDataFrame([("/data/docs/en",)], "path string"))
    return cat.delete(rows, gone).select("path")


_LANG_ROOTS = "select distinct lang as name, '/data/docs/' || lang as path from documents"
_OLD_ROOTS = "select distinct lang as name, '/stored/' || lang as path from documents where lang < 'es' union all select distinct source, '/gone/' || source from documents"


@query("roots_merge", f"with c as ({_LANG_ROOTS}), s as ({_OLD_ROOTS}) select name, path, 'kept' as state from s where name in (select name from c) union all select name, path, 'new' from c where name not in (select name from s)")
def roots_merge(spark, d):
    """A root for each language is configured; some of these and one for each source are stored."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    root = lambda rows, name, top: rows.select(F.col(name).alias("name"), F.concat(F.lit(top), name).alias("path")).distinct()
    stored = root(docs.filter("lang < 'es'"), "lang", "/stored/").unionByName(root(docs, "source", "/gone/"))
    return cat.merge_roots(root(docs, "lang", "/data/docs/"), stored)


@query("loaded_roots", "select cast(row_number() over (order by lang) as int) as ord, lang as name, '/data/docs/' || lang as path from (select distinct lang from documents) l")
def loaded_roots(spark, d):
    """Roots of a stored table, in order; rows without a name or path don't count."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("lang").distinct()
    order = F.row_number().over(Window.orderBy("lang"))  # the languages
    rows = docs.select(order.alias("ord"), F.col("lang").alias("name"), F.concat(F.lit("/data/docs/"), "lang").alias("path"), F.lit(False).alias("is_network"))
    folder = scratch(spark, "roots")
    rows.unionByName(rows.withColumn("name", F.lit(None).cast("string"))).write.parquet(folder)
    return tables.load_roots(spark, folder).select("ord", "name", "path")


@query("loaded_access", _sql("select file, open_count, last_opened from access where file in (select path from catalog where lower(ext) = 'md')"))
def loaded_access(spark, d):
    """Stored opens, one row an open, of the files that a catalog has."""
    folder = scratch(spark, "access")
    fx.opens(spark, d).select("file", F.lit(1).cast("long").alias("open_count"), F.col("ts").alias("last_opened")).write.parquet(folder)
    return tables.load_access(spark, folder, fx.catalog(spark, d).filter(plan.extension_filter("md")))


@query("engine_roots", _sql("select path, is_dir, mtime, size from catalog where path not in ('/data/docs', '/data/docs-archive') and not starts_with(path, '/data/docs/') union all select '/new' || path, is_dir, mtime, size from files where starts_with(path, '/data/parts/')"))
def engine_roots(spark, d):
    """A root is added with its rows, another one removed, in a stored table."""
    rows = fx.catalog(spark, d)
    table = _kept(spark, rows.filter("path <> '/data/docs-archive'"))
    engine = search.Engine(table.read(), fx.ROOTS, table=table)
    engine.add_bookmark("new", "/new", fx.files(spark, d).filter("startswith(path, '/data/parts/')").withColumn("path", F.concat(F.lit("/new"), "path")))
    engine.remove_bookmark("docs")
    return engine.catalog.select(*cat.FIELDS)


@query("engine_opens", _sql("select path from catalog where starts_with(path, '/data/src/') and not is_dir order by path limit 1"))
def engine_opens(spark, d):
    """An open that is recorded puts a file first."""
    engine = search.Engine(fx.catalog(spark, d), fx.ROOTS, most=1)
    first = engine.catalog.filter("startswith(path, '/data/src/') and not is_dir").agg(F.min("path")).first()[0]
    engine.record_file_open(first, fx.NOW)
    engine.record_file_open("/not/there", fx.NOW)
    return engine.search("", int(Sort.FRECENCY), fx.NOW).select("path")


@query("request_lines", _sql("").rstrip() + ", grams as (select distinct substr(hex(encode(c)), 2 * i - 1, 6) as g from (select c, unnest(range(1, strlen(c) - 1)) as i from (select lower(unnest(string_split(path, '/'))) as c from catalog) a where strlen(c) >= 3) b) "
       "select 'STATS' as line, '{\"files\": ' || (select count(*) from catalog) || ', \"trigrams\": ' || (select count(*) from grams) || ', \"bookmarks\": 3}' as answer union all select 'PING', '{\"status\": \"pong\"}'")
def request_lines(spark, d):
    engine = search.Engine(fx.catalog(spark, d), fx.ROOTS)
    return spark.createDataFrame([(line, requests.answer_line(engine, line)) for line in ("STATS", "PING")], "line string, answer string")


@query("access_rollup", _sql("select file, open_count, last_opened from access"))
def access_rollup(spark, d):
    return frecency.roll_up(fx.opens(spark, d))


@query("frecency_score", _sql("select file, round(score, 9) as score from scores"))
def frecency_score(spark, d):
    rows = frecency.roll_up(fx.opens(spark, d))
    return rows.select("file", F.round(frecency.score(F.col("open_count"), F.col("last_opened"), fx.NOW), 9).alias("score"))


_MOUNTS = ["/dev/sda / ext4 rw", "srv:/x /data/docs nfs4 rw", "tmp /data tmpfs rw", "srv:/y /data/docs cifs rw", "srv:/z /mnt/web/ fuse.sshfs rw", "short"]


@query(
    "mount_longest_prefix",
    _sql("""select path, case when path = '/data/docs' or starts_with(path, '/data/docs/') then 'cifs' when path = '/data' or starts_with(path, '/data/') then 'tmpfs'
            when path = '/mnt/web' or starts_with(path, '/mnt/web/') then 'fuse.sshfs' else 'ext4' end as fs,
            path = '/data/docs' or starts_with(path, '/data/docs/') or path = '/mnt/web' or starts_with(path, '/mnt/web/') as is_network from catalog"""),
)
def mount_longest_prefix(spark, d):
    lines = spark.createDataFrame(list(enumerate(_MOUNTS)), "line int, value string")
    return cat.mount_of(fx.catalog(spark, d), cat.mounts(lines))


# -- index

_GRAMS = """
components as (select id, lower(unnest(string_split(path, '/'))) as c from catalog),
grams as (select distinct id, substr(hex(encode(c)), 2 * i - 1, 6) as trigram from (select id, c, unnest(range(1, strlen(c) - 1)) as i from components where strlen(c) >= 3) g)
"""


@query("trigram_postings", _sql("").rstrip() + "," + _GRAMS + "select trigram, count(*) as n, min(id) as first_id from grams group by trigram")
def trigram_postings(spark, d):
    lists = index.posting_lists(index.postings(fx.with_id(fx.catalog(spark, d))))
    return lists.groupBy(F.hex("trigram").alias("trigram")).agg(F.sum(F.size("ids")).alias("n"), F.min(F.col("ids")[0]).alias("first_id"))


@query("trigram_rows", _sql("").rstrip() + "," + _GRAMS + "select id, trigram from grams")
def trigram_rows(spark, d):
    return index.postings(fx.with_id(fx.catalog(spark, d))).select("id", F.hex("trigram").alias("trigram"))


@query("posting_intersection", _sql("").rstrip() + "," + _GRAMS + "select id from grams where trigram in ('676561', '656172') group by id having count(*) = 2")
def posting_intersection(spark, d):
    return index.intersect(index.postings(fx.with_id(fx.catalog(spark, d))), index.query_trigrams("gear"))


@query("posting_union", _sql("").rstrip() + "," + _GRAMS + "select distinct id from grams where trigram in ('676561', '656172')")
def posting_union(spark, d):
    return index.union(index.postings(fx.with_id(fx.catalog(spark, d))), index.query_trigrams("gear"))


@query("index_backfill", _sql("").rstrip() + "," + _GRAMS + "select id, count(*) as n from grams group by id")
def index_backfill(spark, d):
    rows = fx.with_id(fx.catalog(spark, d))
    half = 1 << 47
    cached = index.postings(rows.filter(F.col("id") < half))
    return index.backfill(cached, rows, half).groupBy("id").agg(F.count("*").alias("n"))


@query("index_rebuild", _sql("").rstrip() + "," + _GRAMS + "select id, count(*) as n from grams group by id")
def index_rebuild(spark, d):
    rows = fx.with_id(fx.catalog(spark, d))
    stored = rows.filter("id % 2 = 0").select("id", index.path_trigrams(F.col("path")).alias("trigrams"))
    return index.rebuild(rows, stored).filter("size(trigrams) > 0").select("id", F.size("trigrams").cast("long").alias("n"))


@query("indexed_search", _sql("select path from catalog where contains(lower(path), 'blue_gear')"))
def indexed_search(spark, d):
    rows = fx.with_id(fx.catalog(spark, d))
    return index.search_indexed(rows, index.postings(rows), "blue_gear").select("path")


@query("indexed_glob", _sql("select path from catalog where regexp_matches(name, '(?s)^.*blue.gear-[0-9].*5.*$') or regexp_matches(path, '(?s)^.*blue.gear-[0-9].*5.*$')"))
def indexed_glob(spark, d):
    rows = fx.with_id(fx.catalog(spark, d))
    return index.search_indexed(rows, index.postings(rows), "blue?gear-[0-9]*5").select("path")


@query("indexed_fuzzy", _sql("""select path from catalog where contains(lower(name), 'blue_gaer') or case when length(stem) < 9 then levenshtein('blue_gaer', lower(stem)) <= 2
    else len(list_filter(range(7, least(11, length(stem)) + 1), lambda w: len(list_filter(range(0, length(stem) - w + 1), lambda i: levenshtein('blue_gaer', substr(lower(stem), i + 1, w)) <= 2)) > 0)) > 0 end"""))
def indexed_fuzzy(spark, d):
    rows = fx.with_id(fx.catalog(spark, d))
    return index.search_indexed(rows, index.postings(rows), "~blue_gaer").select("path")


@query("index_stats", _sql("").rstrip() + "," + _GRAMS + "select (select count(*) from catalog) as files, (select count(distinct trigram) from grams) as trigrams, cast(3 as bigint) as roots")
def index_stats(spark, d):
    rows = fx.with_id(fx.catalog(spark, d))
    return index.statistics(rows, index.postings(rows), len(fx.ROOTS))


def _blocks(spark, d, rows: DataFrame) -> blocks.Blocks:
    return blocks.Blocks.create(rows, scratch(spark, "blocks"), block_rows=512)


@query("block_search", ORACLE["indexed_search"])
def block_search(spark, d):
    return _blocks(spark, d, fx.catalog(spark, d)).search("blue_gear").select("path")


@query("block_glob", ORACLE["indexed_glob"])
def block_glob(spark, d):
    return _blocks(spark, d, fx.catalog(spark, d)).search("blue?gear-[0-9]*5").select("path")


@query("block_fuzzy", ORACLE["indexed_fuzzy"])
def block_fuzzy(spark, d):
    return _blocks(spark, d, fx.catalog(spark, d)).search("~blue_gaer").select("path")


@query("block_backfill", _sql("select path, is_dir, mtime, size from catalog where contains(lower(path), 'hot_ring')"))
def block_backfill(spark, d):
    """Half of the catalog in blocks, the other half appended: the signatures of the first stay as they are."""
    rows = fx.catalog(spark, d)
    out = _blocks(spark, d, rows.filter("mtime % 2 = 0"))
    out.append(rows.filter("mtime % 2 = 1"))
    return out.search("HOT_ring")


def _containers(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = cat.assign_ids(fx.catalog(spark, d), 0)
    return rows, bitmaps.containers(index.postings(rows))


@query("bitmap_counts", _sql("").rstrip() + "," + _GRAMS + "select trigram, count(*) as n from grams group by trigram")
def bitmap_counts(spark, d):
    return bitmaps.counts(_containers(spark, d)[1]).select(F.hex("trigram").alias("trigram"), "n")


@query("bitmap_intersection", _sql("").rstrip() + "," + _GRAMS + "select path from catalog where id in (select id from grams where trigram in ('676561', '656172', '617264') group by id having count(*) = 3)")
def bitmap_intersection(spark, d):
    rows, lists = _containers(spark, d)
    return rows.join(bitmaps.intersect(lists, [b"gea", b"ear", b"ard"]), "id", "left_semi").select("path")


@query("bitmap_dense_intersection", _sql("").rstrip() + "," + _GRAMS + "select path from catalog where id in (select id from grams where trigram in ('646F63', '6F632D') group by id having count(*) = 2)")
def bitmap_dense_intersection(spark, d):
    rows, lists = _containers(spark, d)
    return rows.join(bitmaps.intersect(lists, [b"doc", b"oc-"]), "id", "left_semi").select("path")


@query("bitmap_union", _sql("").rstrip() + "," + _GRAMS + "select path from catalog where id in (select id from grams where trigram in ('676561', '646F63', '7A7A7A'))")
def bitmap_union(spark, d):
    rows, lists = _containers(spark, d)
    return rows.join(bitmaps.union(lists, [b"gea", b"doc", b"zzz"]), "id", "left_semi").select("path")


@query("block_regex", _sql("select path from catalog where regexp_matches(path, '(?i)hot_gear-[0-9]*7\\.(txt|json)$')"))
def block_regex(spark, d):
    return _blocks(spark, d, fx.catalog(spark, d)).search("/hot_gear-[0-9]*7\\.(txt|json)$").select("path")


@query("block_path_aware", _sql("select path from catalog where contains(lower(name), 'gear') and regexp_matches(lower(path), '/[^/]*brand#1[^/]*/')"))
def block_path_aware(spark, d):
    return _blocks(spark, d, fx.catalog(spark, d)).search("brand#1/gear").select("path")


@query("saved_index", _sql("").rstrip() + "," + _GRAMS + "select id, count(*) as n from grams where id % 10 <> 3 group by id")
def saved_index(spark, d):
    """Postings of part of the catalog, saved and brought up to date: rows that went, and newer ones.

    The facts are those of a catalog as large as today's, so that the saved postings are taken.
    """
    folder, high = scratch(spark, "index"), 1 << 47
    fx.with_id(fx.catalog(spark, d)).select("id", "path").write.parquet(f"{folder}/catalog")  # made once for all jobs below
    rows = spark.read.schema("id long, path string").parquet(f"{folder}/catalog")
    old, now = rows.filter((F.col("id") < high) | (F.col("id") % 100 == 3)), rows.filter("id % 10 <> 3")
    old = index.dealt(old, old.count())
    index.save(index.postings(old), old, folder, now.agg(F.count("*").alias("files"), F.lit(high).alias("next_id")))
    return index.load(now, folder).groupBy("id").agg(F.count("*").alias("n"))


_LINES = """
part_names as (select distinct replace(p_name, ' ', '_') as t from part), brands as (select distinct p_brand as t from part), langs as (select distinct lang as t from documents),
lines as (select t as line, lower(t) as low, '' as dir, '' as want from part_names union all select t || ' *.md', lower(t), '', 'md' from brands union all select '*.JSON ' || t, lower(t), '', 'json' from brands
          union all select distinct p_type || '/' || replace(p_name, ' ', '_'), lower(replace(p_name, ' ', '_')), lower(p_type), '' from part union all select t || '/doc-', 'doc-', lower(t), '' from langs),
hits as (select line, path, is_dir, mtime, size, bookmark from lines join catalog on contains(lower(path), low) and (want = '' or lower(ext) = want)
         and (dir = '' or (contains(lower(name), low) and regexp_matches(lower(path), '/[^/]*' || dir || '[^/]*/'))) where bookmark is not null)
"""


@query(
    "requests_in_one_scan",
    _sql("").rstrip() + "," + _LINES + "select * from (select line as request, cast(row_number() over (partition by line order by mtime desc, path) as int) as rank, path, is_dir, mtime, size, bookmark from hits) r where rank <= 50",
)
def requests_in_one_scan(spark, d):
    """Some hundred lines from the part and document tables, all answered in one pass."""
    part, docs = spark.read.parquet(f"{d}/part.parquet"), spark.read.parquet(f"{d}/documents.parquet")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    parts = [F.concat(name), F.concat("p_brand", F.lit(" *.md")), F.concat(F.lit("*.JSON "), "p_brand"), F.concat("p_type", F.lit("/"), name)]
    lines = part.select(F.explode(F.array(*parts)).alias("line")).unionByName(docs.select(F.concat("lang", F.lit("/doc-")).alias("line"))).distinct()
    return many.search_many(fx.catalog(spark, d), lines.select(F.col("line").alias("request"), "line"), fx.ROOTS, 50)


# -- change feed

_EVENTS = f"""
fs_events as (select event_id as seq, e.ts, case event_type when 'signup' then 'create' when 'error' then 'remove' else 'modify' end as kind, concat('/data/docs/', {_REL}) as path,
              cast(floor(epoch(e.ts)) as bigint) as mtime, cast(floor(value) as bigint) as size from events e join documents on user_id = doc_id where event_type <> 'view'),
last_event as (select * from (select *, row_number() over (partition by path order by ts desc, seq desc) as n from fs_events) r where n = 1)
"""


@query("events_latest", _sql("").rstrip() + "," + _EVENTS + "select path, seq, case when kind = 'remove' then 'remove' else 'upsert' end as kind from last_event")
def events_latest(spark, d):
    return feed.last_events(fx.fs_events(spark, d)).select("path", "seq", "kind")


@query(
    "events_replay",
    _sql("").rstrip() + "," + _EVENTS + """select path, false as is_dir, mtime, size from last_event where kind <> 'remove'
        union all select path, is_dir, mtime, size from catalog where path not in (select path from last_event)""",
)
def events_replay(spark, d):
    return feed.apply_events(fx.catalog(spark, d), fx.fs_events(spark, d))


_CATALOG = "path string, is_dir boolean, mtime long, size long"


def _kept(spark, rows: DataFrame, part_rows: int = 2000) -> PartTable:
    """A table of its own that holds the rows."""
    table = PartTable(spark, scratch(spark, "table"), _CATALOG, part_rows)
    table.write(rows)
    return table


def _local(path: str) -> str:
    return path.removeprefix("file://")


@query("stream_in_order", ORACLE["events_replay"])
def stream_in_order(spark, d):
    """The events as a stream of JSON files, a batch each, the earlier ones first."""
    log = scratch(spark, "events")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)  # of a turn
    dealt = fx.fs_events(spark, d).repartitionByRange(3 * tasks, "ts", "seq").withColumn("turn", F.least(F.floor(F.spark_partition_id() / tasks), F.lit(2)).cast("int"))
    dealt.write.partitionBy("turn").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(log)
    table = _kept(spark, fx.catalog(spark, d))
    for turn in range(3):
        one = spark.readStream.schema(feed.EVENTS).option("recursiveFileLookup", "true").json(f"{log}/turn={turn}")
        feed.follow(one, table, f"{log}/checkpoint-{turn}").awaitTermination()
    return table.read()


@query("stream_in_any_order", ORACLE["events_replay"])
def stream_in_any_order(spark, d):
    """The events as growing logs, dealt to three turns by hash: a stream that is stopped and started, with older events in later batches."""
    log, checkpoint = _local(scratch(spark, "logs")), scratch(spark, "checkpoint")
    os.makedirs(log)
    table = _kept(spark, fx.catalog(spark, d))
    dealt = fx.fs_events(spark, d).withColumn("turn", F.pmod(F.xxhash64("seq"), F.lit(3))).withColumn("line", F.to_json(F.struct(*feed_columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}))
    lines = scratch(spark, "lines")
    dealt.select("turn", "line").write.partitionBy("turn").text(lines)
    for turn in range(3):
        for i, name in enumerate(sorted(n for n in os.listdir(f"{_local(lines)}/turn={turn}") if n.startswith("part-"))):
            with open(f"{_local(lines)}/turn={turn}/{name}", "rb") as new, open(f"{log}/{i}.jsonl", "ab") as grown:
                shutil.copyfileobj(new, grown)
        keyed.follow(changelog.stream_log(spark, log), table, checkpoint).awaitTermination()
    return table.read()


feed_columns = ("seq", "ts", "kind", "path", "is_dir", "mtime", "size")

_ON_DISK = "select concat(lang, '/', source, '/', doc_id, '.txt') as rel, doc_id, cast(length(cast(doc_id as varchar)) as bigint) as size from documents"


def _tree(spark, d, where: str = "true", root: str | None = None) -> str:
    """A folder with a small file for each document, below folders of its language and source; the documents may be added to one that is there."""
    root = root or _local(scratch(spark, "tree"))

    def put(batches):
        for batch in batches:
            for rel, text in zip(batch.column("rel").to_pylist(), batch.column("text").to_pylist()):
                os.makedirs(os.path.dirname(f"{root}/{rel}"), exist_ok=True)
                with open(f"{root}/{rel}", "w") as f:
                    f.write(text)
            yield batch.select(["rel"])

    docs = spark.read.parquet(f"{d}/documents.parquet").filter(where)
    docs.select(F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("rel"), F.col("doc_id").cast("string").alias("text")).mapInArrow(put, "rel string").count()
    return root


def _below(rows: DataFrame, root: str) -> DataFrame:
    return rows.filter("not is_dir").select(F.substring("path", F.lit(len(root) + 2), F.length("path")).alias("rel"), "size")


@query("tree_scan", f"select rel, size from ({_ON_DISK}) t")
def tree_scan(spark, d):
    root = _tree(spark, d)
    return _below(tree.scan(spark, root), root)


def _stores(spark, d) -> DataFrame:
    """A tag store for each language, its entries those of the documents."""
    top = _local(scratch(spark, "stores"))
    return fx.tag_entries(spark, d).withColumn("root", F.concat(F.lit(f"{top}/"), F.substring_index("rel", "/", 1)))


def _reread(spark, written: DataFrame) -> DataFrame:
    return tagdoc.read_documents(spark, sorted(r.root for r in written.collect()))  # the roots


@query("tag_documents", _sql(f"select rel, {_TAGS} as tags, size, mtime_ns, fp from entries"))
def tag_documents(spark, d):
    """Tag entries written as documents, one a store, and read again."""
    return _reread(spark, tagdoc.write_documents(_stores(spark, d))).select("rel", F.array_join("tags", ",").alias("tags"), "size", "mtime_ns", "fp")


@query("tag_documents_changed", _sql("select rel, case when lang = 'en' then array_to_string(list_sort(list_distinct(list_concat(tags, ['checked', 'en']))), ',') else " + _TAGS + " end as tags from entries"))
def tag_documents_changed(spark, d):
    """Tags are added in one of several stores, and all documents written again."""
    kept = _reread(spark, tagdoc.write_documents(_stores(spark, d)))
    after = tags.add(kept, kept.filter("startswith(rel, 'en/')").select("rel"), ["checked", "en"])
    table = scratch(spark, "entries")
    after.write.parquet(table)  # the documents that it was read from are written anew
    return _texts(_reread(spark, tagdoc.write_documents(spark.read.parquet(table))))


@query("tree_scan_of_folders", "select distinct lang as rel from documents union select distinct lang || '/' || source from documents")
def tree_scan_of_folders(spark, d):
    root = _tree(spark, d)
    return tree.scan(spark, root).filter("is_dir and path <> '" + root + "'").select(F.substring("path", F.lit(len(root) + 2), F.length("path")).alias("rel"))


@query("tag_tree_scan", f"select rel, size from ({_ON_DISK}) t")
def tag_tree_scan(spark, d):
    return tree.tag_tree(spark, _tree(spark, d)).select("rel", "size")


@query("tree_led_by_catalog", f"select rel, size from ({_ON_DISK}) t")
def tree_led_by_catalog(spark, d):
    """The documents of some languages are known; the others are found by looking at the known folders alone."""
    root = _tree(spark, d, "lang < 'es'")
    earlier = F.when(F.col("is_dir"), F.col("mtime") - 1).otherwise(F.col("mtime"))  # the clock may not have moved on
    known = _kept(spark, tree.scan(spark, root).select("path", "is_dir", earlier.alias("mtime"), "size")).read()
    _tree(spark, d, "lang >= 'es'", root)
    return _below(feed.apply_events(known, tree.changed_below(known, root)), root)


@query("integrity_turns", f"select rel, size from ({_ON_DISK}) t where doc_id % 3 <> 0")
def integrity_turns(spark, d):
    """All documents are in the table, a third of them isn't on disk: after all shares these are gone."""
    root = _tree(spark, d, "doc_id % 3 <> 0")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    path = F.concat(F.lit(f"{root}/"), "lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".txt"))
    table = _kept(spark, docs.select(path.alias("path"), F.lit(False).alias("is_dir"), F.lit(0).cast("long").alias("mtime"), F.length(F.col("doc_id").cast("string")).cast("long").alias("size")))
    turns = feed.sweeps_for(docs.count(), docs.count() // 3 + 1)
    job = feed.integrity_job(table, [root], share=docs.count() // 3 + 1)
    for number in range(2 * turns):  # shares are a little uneven as rows go
        job(number)
    return _below(table.read(), root)


@query("network_rescan", f"select rel, size from ({_ON_DISK}) t")
def network_rescan(spark, d):
    """Two roots in one another and one that is absent, scanned again into a table that has only old sizes."""
    root = _tree(spark, d)
    table = _kept(spark, tree.scan(spark, root).filter("not is_dir").select("path", "is_dir", "mtime", (F.col("size") + 9).alias("size")))
    feed.network_job(table, lambda r: tree.scan(spark, r), [root, f"{root}/en", "/no/such/root"])(0)
    return _below(table.read(), root)


@query("watched_root", f"select rel, size from ({_ON_DISK}) t where not starts_with(rel, 'en/')")
def watched_root(spark, d):
    """The table has the English documents alone, which aren't on disk any more."""
    root = _tree(spark, d, "lang <> 'en'")
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("lang = 'en'")
    old = docs.select(F.concat(F.lit(f"{root}/en/"), "doc_id").alias("path"), F.lit(False).alias("is_dir"), F.lit(1).cast("long").alias("mtime"), F.lit(1).cast("long").alias("size"))
    table = _kept(spark, old)
    feed.watch_job(table, lambda r: tree.scan(spark, r).select(*cat.FIELDS), [root])(0)
    return _below(table.read(), root)


@query("previews_of_files", f"select rel, 'text' as preview_type, cast(doc_id as varchar) as text from ({_ON_DISK}) t")
def previews_of_files(spark, d):
    root = _tree(spark, d)
    shown = previews.preview_files(tree.scan(spark, root).filter("not is_dir").select("path", "is_dir", "size"))
    return shown.select(F.substring("path", F.lit(len(root) + 2), F.length("path")).alias("rel"), "preview_type", "text")


@query("event_rate", _sql("").rstrip() + "," + _EVENTS + "select cast(floor(epoch(ts) / 3600) as bigint) as hour, kind, count(*) as n from fs_events group by 1, 2")
def event_rate(spark, d):
    return feed.event_rate(fx.fs_events(spark, d), "1 hour").select(F.floor(F.unix_timestamp("start") / 3600).cast("long").alias("hour"), "kind", "n")


# -- functions and previews


@query(
    "path_parts",
    _sql("select path, name, ext, stem, regexp_replace(path, '/[^/]*$', '') as parent from catalog"),
)
def path_parts(spark, d):
    p = F.col("path")
    return fx.catalog(spark, d).select("path", paths.name(p).alias("name"), paths.extension(p).alias("ext"), paths.stem(p).alias("stem"), paths.parent(p).alias("parent"))


@query("relative_path", _sql("select path, substr(path, 12) as rel from catalog where starts_with(path, '/data/docs/')"))
def relative_path(spark, d):
    rows = fx.catalog(spark, d).select("path", paths.relative(F.col("path"), "/data/docs/").alias("rel"))
    return rows.filter("rel is not null")


_SIZES = "(select path, size * size * 37 as size from catalog)"


@query(
    "format_size",
    _sql(f"""select path, case when size < 1024 then concat(cast(size as varchar), ' B') when size < 1048576 then concat(format('{{:.1f}}', size / 1024.0), ' KiB')
             when size < 1073741824 then concat(format('{{:.1f}}', size / 1048576.0), ' MiB') else concat(format('{{:.1f}}', size / 1073741824.0), ' GiB') end as shown from {_SIZES} s"""),
)
def format_size(spark, d):
    return fx.catalog(spark, d).select("path", formats.size_text(F.col("size") * F.col("size") * 37).alias("shown"))


def _human(power: int, unit: str) -> str:
    value = f"(size / {float(1 << (10 * power))})"
    tenths = f"cast(ceil({value} * 10) as bigint)"
    return f"concat(case when {tenths} < 100 then concat(cast({tenths} // 10 as varchar), '.', cast({tenths} % 10 as varchar)) else cast(cast(ceil({value}) as bigint) as varchar) end, '{unit}')"


@query(
    "human_size",
    _sql(f"select path, case when size < 1024 then cast(size as varchar) when size < 1048576 then {_human(1, 'K')} when size < 1073741824 then {_human(2, 'M')} when size < 1099511627776 then {_human(3, 'G')} else {_human(4, 'T')} end as shown from {_SIZES} s"),
)
def human_size(spark, d):
    return fx.catalog(spark, d).select("path", formats.listing_size(F.col("size") * F.col("size") * 37).alias("shown"))


@query(
    "listing_time",
    _sql(f"""select path, concat(strftime(to_timestamp(mtime) at time zone 'UTC', '%b '), lpad(strftime(to_timestamp(mtime) at time zone 'UTC', '%-d'), 2, ' '),
             case when mtime >= {fx.NOW} - 15768000 and mtime <= {fx.NOW} + 60 then strftime(to_timestamp(mtime) at time zone 'UTC', ' %H:%M') else strftime(to_timestamp(mtime) at time zone 'UTC', '  %Y') end) as shown from catalog"""),
)
def listing_time(spark, d):
    return fx.catalog(spark, d).select("path", formats.listing_time(F.col("mtime"), fx.NOW).alias("shown"))


@query(
    "mode_text",
    _sql("""select path, concat(case when is_dir then 'd' else '-' end, case when size % 2 = 1 then 'r' else '-' end, case when is_dir then 'w' else '-' end, 'x',
            case when size % 2 = 1 then 'r' else '-' end, '-', case when is_dir then 'S' else '-' end, 'r--') as shown from catalog"""),
)
def mode_text(spark, d):
    odd = (F.col("size") % 2).cast("int")
    mode = F.when(F.col("is_dir"), F.lit(0o040000 | 0o200 | 0o2000)).otherwise(F.lit(0o100000)) + odd * (0o400 + 0o040) + F.lit(0o100 + 0o004)
    return fx.catalog(spark, d).select("path", formats.mode_text(mode.cast("int")).alias("shown"))


@query(
    "date_text",
    _sql(f"""select path, case when strftime(t, '%Y-%m-%d') = '2024-01-31' then clock when strftime(t, '%Y') = '2024' then concat(strftime(t, '%b %-d '), clock) else concat(strftime(t, '%Y-%m-%d '), clock) end as shown
             from (select path, t, lower(strftime(t, '%-I:%M %p')) as clock from (select path, to_timestamp(mtime + 2000000) at time zone 'UTC' as t from catalog) a) b"""),
)
def date_text(spark, d):
    return fx.catalog(spark, d).select("path", formats.date_text(F.col("mtime") + 2_000_000, fx.NOW).alias("shown"))


@query("duration_text", _sql("select path, concat(cast(size // 60 as varchar), ':', lpad(cast(size % 60 as varchar), 2, '0')) as shown from catalog"))
def duration_text(spark, d):
    return fx.catalog(spark, d).select("path", formats.duration_text(F.col("size")).alias("shown"))


@query("owner_name", _sql("select path, case size % 4 when 0 then 'root' when 1 then 'daemon' else cast(size % 4 as varchar) end as owner from catalog"))
def owner_name(spark, d):
    return fx.catalog(spark, d).select("path", formats.owner_name(F.col("size") % 4, {0: "root", 1: "daemon"}).alias("owner"))


@query("open_counts", _sql("select concat('user-', user_id) as file, count(*) as open_count, max(cast(floor(epoch(ts)) as bigint)) as last_opened from events where event_type = 'view' group by user_id"))
def open_counts(spark, d):
    seen = spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'view'")
    return feed.open_counts(seen.select(F.concat(F.lit("user-"), "user_id").alias("file"), F.col("ts").cast("timestamp").alias("ts")))


@query("refined_search", _found("contains(lower(path), 'blue_gear')", most=2000))
def refined_search(spark, d):
    """The second search is answered from the rows of the first."""
    engine = search.Engine(fx.catalog(spark, d), fx.ROOTS, most=2000, cache=True)
    engine.search("blue_ge")
    return engine.search("blue_gear")


@query("tag_input", "select doc_id, array_to_string(list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> ''), '|') as parsed, not regexp_matches(source, '[,]') as valid from (select doc_id, source, concat(lang, ', ', source, ',,  ', lang, ' x ,') as t from documents) s")
def tag_input(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet")
    text = F.concat("lang", F.lit(", "), "source", F.lit(",,  "), "lang", F.lit(" x ,"))
    return rows.select("doc_id", F.array_join(formats.tag_list(text), "|").alias("parsed"), formats.valid_tag(F.col("source")).alias("valid"))


@query(
    "preview_type",
    _sql("select path, case when is_dir then 'directory' " + " ".join(f"when lower(coalesce(ext, '')) in ({', '.join(repr(x) for x in e.split())}) then '{k}'" for k, e in previews.KINDS.items()) + " else 'text' end as preview_type from catalog"),
)
def preview_type(spark, d):
    return fx.catalog(spark, d).select("path", previews.kind(F.col("path"), F.col("is_dir")).alias("preview_type"))


@query("text_preview_flag", "select page_id, false as binary from pages union all select page_id, true from pages")
def text_preview_flag(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    plain = F.encode("html", "UTF-8")
    odd = F.encode(F.concat(F.repeat(F.lit("\x01"), 60), F.lit("text")), "UTF-8")
    return pages.select("page_id", previews.looks_binary(plain).alias("binary")).unionByName(pages.select("page_id", previews.looks_binary(odd).alias("binary")))


@query(
    "media_format_json",
    """select event_id, concat('File: ', user_id, '.mp3', chr(10), 'Duration: ', n // 60, ':', lpad(cast(n % 60 as varchar), 2, '0'), chr(10), 'Bitrate: ', event_id // 1000, ' kbps', chr(10), chr(10), 'Title: ', event_type,
        chr(10), chr(10), 'Streams:', chr(10), '  Audio: mp3 (44100Hz, 2 ch)') as shown from (select *, cast(json_extract(props, '$.k') as bigint) as n from events) e""",
)
def media_format_json(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("n", F.get_json_object("props", "$.k"))
    probe = F.concat(
        F.lit('{"format": {"filename": "/m/'), "user_id", F.lit('.mp3", "duration": "'), "n", F.lit('.0", "bit_rate": "'), "event_id", F.lit('", "tags": {"TITLE": "'), "event_type",
        F.lit('"}}, "streams": [{"codec_type": "audio", "codec_name": "mp3", "sample_rate": "44100", "channels": 2}, {"codec_type": "data"}]}'),
    )
    return rows.select("event_id", previews.media_text(probe, F.lit("x")).alias("shown"))


@query("text_preview", "select doc_id, text as shown from documents where strlen(text) between 1 and 50000 and not regexp_matches(text, '[\\x00-\\x08\\x0E-\\x1F\\x7F]')")
def text_preview(spark, d):
    """Texts of up to 50,000 bytes without control characters are shown as they stand."""
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("octet_length(text) between 1 and 50000").filter(~F.col("text").rlike(r"[\x00-\x08\x0E-\x1F\x7F]"))
    rows = docs.select(F.concat(F.lit("/t/"), "doc_id", F.lit(".txt")).alias("path"), F.lit(False).alias("is_dir"), F.octet_length("text").cast("long").alias("size"), F.encode("text", "UTF-8").alias("content"))
    return previews.previews(rows).select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("doc_id"), F.col("text").alias("shown"))


@query("markdown_preview", "select doc_id, '<h2>' || lang || '</h2>' || chr(10) || '<ul><li>' || source || chr(10) || '<ol><li>' || n_chars || '</li></ol></li></ul>' || chr(10) || '<blockquote><p>' || doc_id || '</p></blockquote>' as shown from documents")
def markdown_preview(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = F.format_string("## %s\n- %s\n  1. %s\n\n> %s\n", "lang", "source", F.col("n_chars").cast("string"), F.col("doc_id").cast("string"))
    rows = docs.select(F.concat(F.lit("/t/"), "doc_id", F.lit(".md")).alias("path"), F.lit(False).alias("is_dir"), F.lit(1).cast("long").alias("size"), F.encode(text, "UTF-8").alias("content"))
    return previews.previews(rows).select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("doc_id"), F.col("text").alias("shown"))


@query("file_info_preview", _sql("select path, concat(name, chr(10), 'Size: ', case when size < 1024 then concat(cast(size as varchar), ' B') when size < 1048576 then concat(format('{:.1f}', size / 1024.0), ' KiB') else concat(format('{:.1f}', size / 1048576.0), ' MiB') end) as shown from (select path || '.png' as path, name || '.png' as name, size from catalog where not is_dir) c"))
def file_info_preview(spark, d):
    rows = fx.catalog(spark, d).filter("not is_dir").select(F.concat("path", F.lit(".png")).alias("path"), "is_dir", "size", F.lit(None).cast("binary").alias("content"))
    return previews.previews(rows).select("path", F.col("text").alias("shown"))


def _children(rows: DataFrame) -> DataFrame:
    p = F.col("path")
    return rows.select(paths.parent(p).alias("folder"), paths.name(p).alias("name"), "is_dir", "size").filter("folder <> ''")


@query(
    "directory_preview",
    _sql("""select folder, place, line, total from (
        select folder, line, cast(row_number() over (partition by folder order by is_dir desc, lower(line), line) as int) as place, count(*) over (partition by folder) as total from (
            select regexp_replace(path, '/[^/]*$', '') as folder, is_dir, case when is_dir then concat('[dir]  ', name, '/') else concat(lpad(
                case when size < 1024 then concat(cast(size as varchar), ' B') when size < 1048576 then concat(format('{:.1f}', size / 1024.0), ' KiB') else concat(format('{:.1f}', size / 1048576.0), ' MiB') end, 8, ' '), '  ', name) end as line from catalog) l
        where folder <> '') r where place <= 80"""),
)
def directory_preview(spark, d):
    return previews.folder_lines(_children(fx.catalog(spark, d)))


@query(
    "json_results",
    _sql("select concat('{\"results\":[', string_agg(row_text, ',' order by rank), '],\"total_indexed\":0,\"search_time_ms\":0}') as json from ("
         "select rank, concat('{\"path\":\"', path, '\",\"is_dir\":', is_dir, ',\"mtime\":', mtime, ',\"size\":', size, ',\"bookmark\":\"', bookmark, '\"}') as row_text from ("
         "select row_number() over (order by mtime desc, path) as rank, * from catalog where contains(lower(path), 'gear') and lower(ext) = 'md' and bookmark is not null) a where rank <= 20) b"),
)
def json_results(spark, d):
    return search.answer(_all(spark, d, "gear *.md", most=20), 0, 0)


@query("fingerprint_b2", None)
def fingerprint_b2(spark, d):
    from .functions import fingerprint

    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", fingerprint.content_fingerprint(F.encode("text", "UTF-8")).alias("fp"))


@query(
    "archive_listing",
    "select concat('/z/', doc_id, '.zip') as path, 'archive' as preview_type, concat('ZIP Archive: 2 entries', chr(10), chr(10), '  [dir]     ', lang, '/', chr(10), '  ', lpad(concat(length(cast(doc_id as varchar)) + 4, ' B'), 8, ' '), '  ', lang, '/', doc_id, '.txt') as text from documents",
)
def archive_listing(spark, d):
    """A zip for each document, with a folder and a file that holds its own name, listed again."""
    import io
    import zipfile

    @F.pandas_udf("binary")
    def packed(folder: pd.Series, name: pd.Series) -> pd.Series:
        def one(f, n):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr(zipfile.ZipInfo(f + "/"), "")
                z.writestr(zipfile.ZipInfo(f + "/" + n), n)
            return out.getvalue()

        return pd.Series([one(f, n) for f, n in zip(folder, name)])

    docs = spark.read.parquet(f"{d}/documents.parquet")
    content = packed("lang", F.concat("doc_id", F.lit(".txt")))
    rows = docs.select(F.concat(F.lit("/z/"), "doc_id", F.lit(".zip")).alias("path"), F.lit(False).alias("is_dir"), F.lit(0).cast("long").alias("size"), content.alias("content"))
    return previews.previews(rows).select("path", "preview_type", "text")


@query(
    "benchmark_statistics",
    _sql("""select bookmark, count(*) as n, min(size) as least, quantile_disc(size, 0.5) as median, quantile_disc(size, 0.95) as p95, quantile_disc(size, 0.99) as p99, max(size) as most
            from catalog where bookmark is not null group by bookmark"""),
)
def benchmark_statistics(spark, d):
    """The sizes below each root as samples."""
    return statistics.summary(search.attribute(fx.catalog(spark, d), fx.ROOTS), "size", "bookmark")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


