"""The queries of this subpackage, thin over its operators, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import contaminated
from .divergence import source_divergence
from .jaccard import jaccard_classes
from .lm import score_documents
from .mixing import mix_sources
from .neardup import near_duplicates
from .session import table
from .sharding import shard_documents
from .spelling import spelling_variants
from .suffix import remove_repeats
from .tokencount import count_tokens, load_pieces
from .topk import top_k
from .toxicity import score_toxicity
from .urlfilter import judge_urls

#: (host, path, verdict)
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = lambda r: F.struct(*(F.lit(x).alias(n) for n, x in zip(("host", "path", "verdict"), r)))
    rules = spark.range(1).select(F.inline(F.array(*map(rule, URL_RULES))))
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_token_counts(spark: SparkSession, sf_dir: str, model: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), load_pieces(model))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("evidence", F.to_json("evidence"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


ORACLE = {
    "op1_suffix_dedup": """
        with b as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
        w as (select doc_id, s, md5(substr(h, 2 * s + 1, 200)) as k from (select doc_id, h, unnest(range(0, greatest(n - 99, 0))) as s from b) x),
        r as (select doc_id, s from (select doc_id, s, row_number() over (partition by k order by doc_id, s) as place from w) x where place > 1),
        i as (select doc_id, s, sum(new) over (partition by doc_id order by s) as span from (
              select doc_id, s, case when s - lag(s) over (partition by doc_id order by s) <= 100 then 0 else 1 end as new from r) x),
        p as (select doc_id, min(s) as lo, max(s) + 100 as hi from i group by doc_id, span),
        q as (select *, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as before from p),
        g as (select q.doc_id, sum(hi - lo) as gone, count(*) as spans, max(hi) as last, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' order by lo) as kept
              from q join b on q.doc_id = b.doc_id group by q.doc_id)
        select b.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans,
               sha256(unhex(case when g.doc_id is null then h else kept || substr(h, 2 * last + 1) end)) as kept_sha256
        from b left join g on b.doc_id = g.doc_id
    """,
    "op2_jaccard_join": r"""
        with recursive t as (select doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
              else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle from t),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
        l as (select x, y from p join n nx on x = nx.doc_id join n ny on y = ny.doc_id where c * 5 >= 4 * (nx.n + ny.n - c)),
        e as (select x, y from l union all select y, x from l),
        reach as (select x, y from e union select r.x, e.y from reach r join e on r.y = e.x),
        c as (select x, min(y) as least from reach group by x),
        k as (select x, count(*) as links from e group by x),
        d as (select text, count(*) as n from t where len(w) > 0 group by text)
        select t.doc_id, least(t.doc_id, coalesce(c.least, t.doc_id)) as class_id, cast(coalesce(k.links, 0) as bigint) as n_links, cast(coalesce(d.n, 1) as bigint) as n_copies
        from t left join c on t.doc_id = c.x left join k on t.doc_id = k.x left join d on t.text = d.text
    """,
    "op3_url_filters": r"""
        with u as (select page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1) as h,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
        v as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from u),
        w as (select *, case
            when ('.' || host) like '%.www.example.com' and starts_with(path, '/en/') then 'www.example.com/en/'
            when ('.' || host) like '%.example.com' and starts_with(path, '/en/') then 'example.com/en/'
            when ('.' || host) like '%.net' and starts_with(path, '/es/') then 'net/es/'
            when ('.' || host) like '%.net' and starts_with(path, '/fr/') then 'net/fr/'
            when ('.' || host) like '%.com' and starts_with(path, '/') then 'com/' end as rule from v)
        select page_id, host, path, rule,
               case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict from w
    """,
    "op10_top_k": """
        with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
              from e q join e c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20
    """,
    "op11_source_divergence": r"""
        with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
        t as (select row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
        k as (select lang, term, count(*) as n from t group by lang, term having count(distinct row) >= 3),
        g as (select distinct lang, source from d),
        c as (select lang, source, term, count(*) as n from t group by lang, source, term),
        x as (select g.lang, g.source, k.term, k.n as lang_n, coalesce(c.n, 0) as n from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
        s as (select *, sum(n) over (partition by lang, source) as total, sum(lang_n) over (partition by lang, source) as lang_total, count(*) over (partition by lang, source) as v from x),
        p as (select lang, source, term, n, cast(1 + (cast(1000000000 as hugeint) * (n + 1)) // (total + v) as hugeint) as p, cast(1 + (cast(1000000000 as hugeint) * (lang_n + 1)) // (lang_total + v) as hugeint) as q from s),
        a as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
        r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(v.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
              left join a v on v.lang = a.lang and v.source = a.source and v.item = b.source
              union all select lang, source, 'term', term, (p - q) * (p - q) // q from p where n > 0 and p > q),
        o as (select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as int) as rank from r)
        select lang, source, part, item, value, rank from o where part = 'pair' or rank <= 200
    """,
    "op12_spelling_variants": r"""
        with recursive bits as (select i, 0 as k, i as v from range(256) x(i) union all select i, k + 1, xor(v >> 1, case when v & 1 = 1 then 3988292384 else 0 end) from bits where k < 8),
        steps as (select list(v order by i) as t from bits where k = 8),
        r as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents),
        c as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as n from r group by 1, 2),
        e as (select w, n, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || w)) as x from c),
        h as (select w, n, xor(4294967295, list_reduce(list_transform(range(1, len(x), 2), lambda i: cast((instr('123456789ABCDEF', x[i]) * 16 + instr('123456789ABCDEF', x[i + 1])) as bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295)) as h from e, steps),
        s as (select case when h % 97 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, n from h),
        v as (select word, cast(sum(n) as bigint) as n from s where length(word) >= 5 group by word having sum(n) >= 3),
        g as (select word, n, length(word) as size, unnest(range(1, length(word) + 1)) as i from v),
        d as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as less, substr(word, 1, i - 1) || chr(0) || substr(word, i + 1) as gap from g),
        p as (select a.word as a, b.word as b from d a join d b on a.gap = b.gap and a.word <> b.word
              union select a.word, b.word from d a join v b on a.less = b.word union select b.word, a.word from d a join v b on a.less = b.word),
        m as (select p.a as word, count(*) as n_near, max(b.n) as most from p join v b on p.b = b.word group by p.a),
        f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when most >= 2 * v.n then most end as form_n,
              (select min(p.b) from p join v b on p.b = b.word where p.a = v.word and b.n = m.most and m.most >= 2 * v.n) as form from v left join m on v.word = m.word),
        u as (select word, form as root, 1 as k from f where form is not null union all select u.word, f.form, k + 1 from u join f on u.root = f.word where f.form is not null),
        o as (select word, arg_max(root, k) as root from u group by word)
        select f.word, form, coalesce(o.root, f.word) as root, n, cast(n_near as bigint) as n_near, cast(form_n as bigint) as form_n from f left join o on f.word = o.word
    """,
    "op13_near_dedup": r"""
        with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
              else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as shingle from t),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
        l as (select x, y from p join n nx on x = nx.doc_id join n ny on y = ny.doc_id where 100 * c >= 85 * (nx.n + ny.n - c)),
        e as (select x, y from l union all select y, x from l),
        reach as (select x, y from e union select r.x, e.y from reach r join e on r.y = e.x),
        c as (select x, min(y) as least from reach group by x)
        select t.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(t.doc_id, coalesce(c.least, t.doc_id)) as component_id, t.doc_id = least(t.doc_id, coalesce(c.least, t.doc_id)) as kept
        from t left join n on t.doc_id = n.doc_id left join c on t.doc_id = c.x
    """,
}


def oracle_sql() -> dict[str, str]:
    return ORACLE
