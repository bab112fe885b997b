"""Nulls, empty tables, long texts, ties, repeated rows and clashing names, for every operator and stage."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_audit import components_by_hand, divergence_by_hand, variants_by_hand

import corpus_pipeline
from pathloom.llm import queries, tokencount

LONG = "lorem ipsum dolor sit amet consectetur " * 4000
EXTRA = "size long, node long, key long, label int, shard int, score double, rank int, kind string"


def extra(rows, n):
    return [(*r, *([1, 2, 3, 4, 5, 6.0, 7, "x"] if i % 2 else [None] * 8)) for i, r in enumerate(rows)]


def tables(full):
    docs = [(i, t, "en", s, 1) for i, (t, s) in enumerate([("one two three four five six seven", "a"), (None, "a"), ("", None), (LONG, "b"), (LONG, "b"), ("x", None), ("x", "c")])]
    docs += [(1, "repeat me", None, "a", None), (1, "repeat me", None, "a", None), (None, "no id here", "en", "a", 1), (None, None, None, None, None)]
    vectors = [(i, [float(i % 3), 1.0], 0) for i in range(45)] + [(None, [1.0, 1.0], 0), (40, None, None), (40, [1.0, 1.0], 0)]
    pages = [(1, "http://a.com/", "h"), (1, "http://a.com/", "h"), (None, None, None), (2, LONG, None)]
    marks = [(0, 1, 1), (0, 1, 0), (3, None, 1), (None, 0, 1), (4, 0, 0), (4, 0, 0)]
    items = [(0, "one two three four five six seven"), (0, "one two three four five six seven"), (1, None), (None, "repeat me now or then"), (2, "")]
    keep = lambda rows: extra(rows, 8) if full else []
    return {
        "documents": (keep(docs), f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"),
        "embeddings": (keep([(i, v, y) for i, v, y in vectors]), f"vec_id long, embedding array<float>, group int, {EXTRA}"),
        "pages": (keep(pages), f"page_id long, url string, html string, {EXTRA}"),
        "labels": (keep(marks), f"doc_id long, quality int, toxic int, {EXTRA}"),
        "benchmark": (keep(items), f"item_id long, text string, {EXTRA}"),
    }


@pytest.fixture(scope="module", params=[True, False], ids=["odd rows", "no rows"])
def folder(request, spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    for name, (rows, schema) in tables(request.param).items():
        spark.createDataFrame(rows, schema).write.parquet(f"{top}/{name}.parquet")
    return str(top), request.param


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, folder, name):
    path, full = folder
    rows = queries.queries()[name](spark, path).collect()
    if not full:
        assert rows == []
        return
    n = {"pages": 4, "documents": 11}
    if name.startswith("op3_"):
        assert len(rows) == n["pages"]
    elif name.startswith("op10_"):
        assert all(r["rank"] <= 20 and r.query_id != r.vec_id for r in rows) and rows
    elif name.startswith("op4_"):
        assert {(r.doc_id, r.item_id) for r in rows} == {(0, 0)} and len(rows) == 2
    elif name.startswith("op11_"):
        docs = [(r[0], r[1], r[2], r[3]) for r in tables(True)["documents"][0]]
        assert sorted(map(tuple, rows), key=repr) == divergence_by_hand(docs) and {r.part for r in rows} == {"pair"}
    elif name.startswith("op12_"):
        assert sorted(map(tuple, rows), key=repr) == variants_by_hand([(r[0], r[1]) for r in tables(True)["documents"][0]]) and len(rows) == 5
    elif name.startswith("op13_"):
        assert sorted(map(tuple, rows), key=repr) == components_by_hand([(r[0], r[1]) for r in tables(True)["documents"][0]])
    else:
        assert len(rows) == n["documents"]
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted([(False, i) for i in range(7)] + [(False, 1)] * 2 + [(True, 0)] * 2)


@pytest.mark.parametrize("step", range(5))
def test_stage(spark, folder, step):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = corpus_pipeline.STAGES[step][1](spark, docs, path)
    if step < 4:
        assert out.columns == docs.columns
    out.collect()


def test_repeated_rows_are_judged_alike(spark, folder):
    path, full = folder
    if full:
        got = queries.op1_suffix_dedup(spark, path).filter("doc_id in (3, 4)").orderBy("doc_id").collect()
        assert got[1].n_removed == got[1].n_bytes and got[0].n_removed < got[0].n_bytes
        same = queries.op2_jaccard_join(spark, path).filter("doc_id in (3, 4)").collect()
        assert {(r.class_id, r.n_links) for r in same} == {(3, 1)}


def test_pipeline_on_small_tables(spark):
    path = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, path).select("doc_id", "shard", "slot").collect()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = docs
    for _, step in corpus_pipeline.STAGES[:3]:
        kept = step(spark, kept, path)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {r.doc_id for r in rows} <= ids and len(ids) > 0.5 * docs.count()
    for shard in range(8):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert kept.filter(F.col("doc_id").isNull()).count() == 0


@pytest.mark.parametrize("step", range(5))
def test_any_column_name_may_be_there(spark, folder, step):
    path, full = folder
    names = ["mix_id", "mix_size", "mix_times", "MIX_COPY", "mix_words", "class_doc", "class_t1", "class_t2", "slot_bucket", "slot_rank", "slot_ahead", "slot_rows", "t1", "t2", "h", "bucket", "upto", "plan", "own", "__id", "__node", "__rank", "clean", "did", "th"]
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", *(f"doc_id * 10 + {i} as `{n}`" for i, n in enumerate(names)))
    out = corpus_pipeline.STAGES[step][1](spark, docs, path)
    made = ["size", "text_crc32", "shard", "slot", "grown_shard"] if step == 4 else []
    assert sorted(out.columns) == sorted({*docs.columns, *made})
    rows = out.collect()
    assert (len(rows) > 0) is full or step == 0  # of the few labels there half are toxic, so nothing is sure to stay
    assert all(r[n] == (None if r.doc_id is None else r.doc_id * 10 + i) for r in rows for i, n in enumerate(names))


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from pathloom.llm.session import shared_dir

    session = lambda master, **conf: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(session("yarn", spark_checkpoint_dir="hdfs:/x/")) == "hdfs:/x"
    assert shared_dir(session("local[3]"))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Two texts of 4 MB that differ in one word, and a short one."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(700_000)]
    words[400_000] = "hello"
    other = [*words[:400_000], "#####", *words[400_001:]]
    texts = [" ".join(words), " ".join(other), "short and plain"]
    top = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 0, i % 2) for i in range(3)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(7, " ".join(words[399_990:400_030]))], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, words, texts


@pytest.mark.parametrize("name", [n for n in sorted(queries.queries()) if n.split("_")[0] not in ("op3", "op10")])
def test_very_long_texts(spark, long_texts, name):
    top, words, texts = long_texts
    rows = queries.queries()[name](spark, top).collect()
    if name.startswith("op11_"):
        assert rows == []  # one source alone, which has each term as often as its language
        return
    if name.startswith("op12_"):
        want = Counter()
        for i, text in enumerate(texts):
            for w, k in Counter(re.findall("[a-z]+", text)).items():
                h = zlib.crc32(f"{i}:{w}".encode())
                want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += k
        assert {r.word: r.n for r in rows} == {w: k for w, k in want.items() if len(w) >= 5 and k >= 3} and any(r.n_near for r in rows)
        return
    rows = {r.doc_id: r for r in rows}
    n = len(texts[0])
    if name.startswith("op1_"):
        assert [(rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans) for i in range(3)] == [(n, 0, 0), (n, n - 5, 2), (15, 0, 0)]
        assert rows[1].kept_sha256 == hashlib.sha256(b"#####").hexdigest()
    elif name.startswith("op2_"):
        assert [(rows[i].class_id, rows[i].n_links) for i in range(3)] == [(0, 1), (0, 1), (2, 0)]
    elif name.startswith("op13_"):
        sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
        assert [tuple(rows[i]) for i in range(3)] == [(0, len(sets[0]), 0, True), (1, len(sets[1]), 0, False), (2, 1, 2, True)]
    elif name.startswith("op4_"):
        assert {(i, r.item_id, r.score) for i, r in rows.items()} == {(0, 7, 1.0), (1, 7, 38 / 40)}
    elif name.startswith("op5_"):
        assert [rows[i].n_tokens for i in range(3)] == [len(words) + 1, len(words) + 1, 4] and all(r.score < 0 and r.n_known <= r.n_tokens for r in rows.values())
    elif name.startswith("op6_"):
        assert [rows[i]["size"] for i in range(3)] == [len(words), len(words), 3] and sum(r.taken for r in rows.values()) == 2 * len(words) + 3
    elif name.startswith("op7_"):
        assert [(rows[i]["size"], rows[i].text_crc32) for i in range(3)] == [(len(t) + 1, zlib.crc32(t.encode())) for t in texts]
    elif name.startswith("op8_"):
        counter = tokencount.Counter(tokencount.load_pieces("/opt/tokenizers/piece_bpe_32k.model"))
        parts = [counter.text(" ".join(words[s : s + 70_000])) for s in range(0, len(words), 70_000)]
        assert rows[0].n_tokens == sum(parts)
    else:
        assert set(rows) == {0, 1, 2} and all(0 <= r.score <= 1 for r in rows.values())
