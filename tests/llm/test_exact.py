"""Operators against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from math import exp, lgamma, log

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pathloom.llm import jaccard, lm, suffix, textkit
from pathloom.llm.decontam import Items, _found, align, contaminated, drop_contaminated
from pathloom.llm.mixing import apply_mix, mix_sources, shard_plan, shard_quotas, source_targets
from pathloom.llm.sharding import jump_hash, shard_documents
from pathloom.llm.tokencount import Counter as TokenCounter
from pathloom.llm.tokencount import count_tokens, load_pieces
from pathloom.llm.topk import top_k
from pathloom.llm.toxicity import Index, drop_toxic, score_toxicity
from pathloom.llm.urlfilter import host_bounds, judge_urls, path_bounds, rule_table

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def word_list(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(ASCII_LOWER))


# -- suffix arrays


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            string = raw[s : s + length]
            if string in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(string)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (not j or not gone[j - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("most", [4096, 2])
def test_repeats_as_brute_force(spark, most):
    rng = random.Random(most)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 250)))) for i in range(50)]
    rows += [(100 + i, ("ab" * rng.randint(1, 90))[rng.randint(0, 1) :] + "".join(rng.choice("xyzé") for _ in range(20)) + "a" * rng.randint(0, 9000)) for i in range(12)]
    rows += [(200, None), (201, ""), (202, rows[3][1]), (203, rows[3][1]), (204, "\0\1" * 40)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 16, 9, most).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(rows, 16)


def test_two_stage_sort_is_a_suffix_array():
    rng = random.Random(5)
    for _ in range(30):
        contents = [bytes(rng.choice(b"aab\0\xff") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        raw = b"\0".join(contents) + b"\0"
        edge = np.cumsum([len(c) + 1 for c in contents])
        text = np.frombuffer(raw, np.uint8).astype(np.uint16) + 1
        text[edge - 1] = 0
        ends = np.repeat(edge - 1, np.diff(np.concatenate([[0], edge])))
        got = suffix.two_stage_sort(text, raw, ends)
        assert got.tolist() == sorted(range(len(raw)), key=lambda i: (raw[i : ends[i]], i))


# -- n-gram Jaccard


def brute_classes(rows, n=5):
    sets = {}
    for i, text in rows:
        w = word_list(text)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    up, links = {i: i for i in sets}, Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both * 5 >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: (root(i), links[i]) for i in ids}


def near_copies(rng, n_groups=12, most=14):
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, most)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([" ", "\n"]).join(text)))
    return rows


@pytest.mark.parametrize("tile", [256, 4])
def test_classes_as_brute_force(spark, tile):
    rows = near_copies(random.Random(tile)) + [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one")]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_classes(rows)


@pytest.mark.parametrize("bucket", [1, 3])
def test_large_buckets_lose_no_link(spark, bucket):
    rows = near_copies(random.Random(31), 6, 20)
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), tile=8, bucket=bucket).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_classes(rows)


def test_forest_is_the_components():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, 40))))
        label = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b):
                label[x] = label[y] = min(label[x], label[y])
        assert jaccard.forest(n, a, b).tolist() == label


def test_one_per_class_keeps_the_first(spark):
    rows = near_copies(random.Random(8), 5) + [(900, None), (901, ""), (902, " ")]
    want = {i for i, (c, _) in brute_classes(rows).items() if c == i}
    got = jaccard.one_per_class(spark.createDataFrame(rows + rows[:3], "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)


def test_least_matches_is_the_posterior_tail():
    floors = jaccard.least_matches(0.8, 1e-6, 32)
    for n, floor in floors.items():
        grid = np.linspace(0, 1, 200_001)
        tail = lambda m: np.sum((grid**m * (1 - grid) ** (n - m))[grid >= 0.8]) / np.sum(grid**m * (1 - grid) ** (n - m))
        assert tail(floor) >= 1e-6 * 0.99 and (floor == 0 or tail(floor - 1) < 1e-6 * 1.01)


# -- urls


def test_urls_as_brute_force(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/x", "allow"), ("b.net", "/", "block")]
    rng = random.Random(3)
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?b#c", "x://y://z/", "http://example.com", "http://notexample.com/en/", "http://com/", "a://É.net/es/"]
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "net", "b.net", "a.b.net", "bb.net", "org", "example.com.org", "com.", ".net", "com/x"]
    urls += [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/es/', '/es/xy', '/en', '?/en/', '#/es/'])}" for _ in range(300)]
    got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"), salts=7)
    for r in got.collect():
        url = urls[r.page_id] or ""
        host = path = ""
        if "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, 0, None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[2], best[3]), url


def test_nested_rules_as_brute_force(spark):
    rng = random.Random(9)
    hosts = ["com", "a.com", "b.a.com", "ab.com", "net", "x.b.a.com", "é.com"]
    path = lambda: "".join(rng.choice(["/", "a", "b", "é", "/a", ""]) for _ in range(rng.randint(0, 5)))
    rules = [(rng.choice(hosts), path(), rng.choice(["allow", "block"])) for _ in range(120)] + [("com", None, "block"), (None, "/", "block"), ("", "/", "block"), ("NET", "/a", "block")]
    urls = [f"h://{rng.choice([*hosts, 'y.net', 'org'])}{'/' if (p := path()) else ''}{p}" for _ in range(400)]
    urls += urls[:3]
    pages = spark.createDataFrame([(i % 390, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    known = {}
    for h, p, v in rules:
        if h and p is not None:
            known[h.lower(), p] = "block" if "block" in (v, known.get((h.lower(), p))) else v
    want = []
    for i, u in enumerate(urls):
        host, _, p = u.removeprefix("h://").partition("/")
        p = "/" + p if "/" in u.removeprefix("h://") else ""
        fits = [(len(h + q), len(h), h + q, v) for (h, q), v in known.items() if (host == h or host.endswith("." + h)) and p.startswith(q)]
        best = max(fits) if fits else (0, 0, None, "allow")
        want.append((i % 390, host, p, best[2], best[3]))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_bounds_grow_with_the_rules_alone(spark):
    rules = [("com", f"/p{i}", "block") for i in range(3000)] + [(f"h{i}.com", "/", "allow") for i in range(3000)]
    table = rule_table(spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert host_bounds(table).count() == 2 * 3001 and path_bounds(table).count() == 2 * 6000
    assert host_bounds(table).filter("size(stack) > 2").count() == 0
    pages = spark.createDataFrame([(i, f"h://h{i}.com/p{i}/x") for i in range(500)] + [(999, "h://none.com/p2999")], "page_id long, url string")
    got = {r.page_id: r.rule for r in judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert all(got[i] == (f"h{i}.com/" if len(f"h{i}.com/") >= len(f"com/p{i}") else f"com/p{i}") for i in range(500)) and got[999] == "com/p2999"


# -- decontamination


def brute_align(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, above[j] + (1 if x == y else -1), above[j + 1] - 1, now[j] - 1))
        best, above = max(best, max(now)), now
    return best


def test_alignment_as_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.integers(1, 5, (6, 9)).astype(np.uint64), rng.integers(1, 5, (6, 15)).astype(np.uint64)
        lengths, widths = rng.integers(1, 10, 6), rng.integers(1, 16, 6)
        a[np.arange(9) >= lengths[:, None]] = 0
        b[np.arange(15) >= widths[:, None]] = 0
        want = [brute_align(x[:n].tolist(), y[:m].tolist()) for x, y, n, m in zip(a, b, lengths, widths)]
        assert align(a, lengths, b).tolist() == want


def test_contaminated_finds_edited_copies_only(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(40))) for i in range(20)]
    docs, want = [], set()
    for d in range(120):
        text = prose(200)
        if d % 3 == 0:
            item = items[d % 20][1].split()
            if d % 2:  # every eighth word replaced, one left out
                item[::8] = [rng.choice(vocabulary) for _ in item[::8]]
                del item[11]
            at = rng.randrange(200)
            text[at:at] = item
            want.add((d, d % 20))
        docs.append((d, " ".join(text).upper() + "."))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items + [(90, None), (91, "short one")], "item_id long, text string")
    for block_bytes in (8 << 20, 1500):
        got = contaminated(docs, items, block_bytes=block_bytes).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert all(r.score == 1.0 for r in got if r.doc_id % 2 == 0)
        kept = drop_contaminated(docs, items, block_bytes=block_bytes)
        assert {r.doc_id for r in kept.collect()} == set(range(120)) - {d for d, _ in want}


@pytest.mark.parametrize("copies", [8, 50, 1000])
def test_copies_that_share_one_edit_are_all_found(spark, copies):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    item = prose(40)
    edited = list(item)
    edited[::8] = [rng.choice(vocabulary) for _ in item[::8]]
    del edited[11]
    docs = [(d, " ".join(prose(20) + (edited if d < copies else []) + prose(20))) for d in range(copies + 50)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert sorted(r.doc_id for r in contaminated(docs, items).collect()) == list(range(copies))
    assert sorted(r.doc_id for r in drop_contaminated(docs, items).collect()) == list(range(copies, copies + 50))


def test_all_that_the_threshold_accepts_is_found():
    import pyarrow as pa

    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(30)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    gapped = prose(40)
    items = [gapped, ["lone"], ["two", "words"], ["three", "words", "here"], []] + [prose(rng.randint(4, 30)) for _ in range(40)]
    docs = [prose(20) + [w for i, x in enumerate(gapped) for w in ([x, "new"] if i % 3 == 2 else [x])] + prose(20)]
    docs += [["lone"], ["two", "words"], prose(9) + ["three", "words", "here"], ["three", "words"], []]
    docs += [prose(rng.randint(1, 80)) for _ in range(30)]
    for item in items[5:] * 3:  # edited all over
        text = []
        for x in item:
            text += rng.choices([[x], [rng.choice(vocabulary)], [], [x, rng.choice(vocabulary)]], [6, 1, 1, 1])[0]
        docs.append(prose(5) + text + prose(5))
    items, docs = [" ".join(x) for x in items], [" ".join(x) for x in docs]
    for share, least in ((0.5, 8), (0.3, 3), (0.02, 1)):
        block = Items(list(range(len(items))), items, share, least)
        block.keep_rare(np.array([rng.randint(0, 9) for _ in block.seeds]))
        doc, item, score, *_ = _found(pa.array(docs), block)
        want = {}
        for d, text in enumerate(docs):
            for i, asked in enumerate(items):
                n, best = len(asked.split()), brute_align(asked.split(), text.split())
                if n and best >= max(share * n, min(least, n)):
                    want[d, i] = best / n
        assert dict(zip(zip(doc.tolist(), item.tolist()), score.tolist())) == pytest.approx(want) and len(doc) == len(want)
        assert share < 0.5 or {(0, 0), (1, 1), (2, 2), (3, 3)} <= want.keys()


def test_the_aligned_words_are_named(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(60)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    item = [f"i{i}" for i in range(20)]
    cut = item[:5] + item[6:]  # a word is missing
    more = item[:9] + ["new"] + item[9:]
    mixed = [prose(30) for _ in range(25)]
    edited = [prose(rng.randint(0, 9)) + [x if rng.random() < 0.8 else rng.choice(vocabulary) for x in m] + prose(rng.randint(0, 9)) for m in mixed]
    texts = [prose(50) + item + prose(60), item, prose(7) + cut, more + prose(3), prose(4) + item + prose(9) + item, *edited]
    items = [item, *mixed]
    docs = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(texts)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, asked).collect()}
    assert [(got[d, 0].from_word, got[d, 0].to_word) for d in range(5)] == [(50, 70), (0, 20), (7, 26), (0, 21), (4, 24)]
    assert len(got) > 20
    for (d, i), r in got.items():
        inside, best = texts[d][r.from_word : r.to_word], round(r.score * len(items[i]))
        assert brute_align(items[i], inside) == best > max(brute_align(items[i], inside[1:]), brute_align(items[i], inside[:-1]))


def test_gapped_copies_and_short_items_are_found(spark):
    gapped = [f"g{i}" for i in range(40)]
    text = [w for i, x in enumerate(gapped) for w in ([x, f"new{i}"] if i % 3 == 2 else [x])]
    docs = [(0, " ".join(text)), (1, "a lone word"), (2, "these two words"), (3, "or three words here"), (4, "three of the words here")]
    items = [(0, " ".join(gapped)), (1, "Lone"), (2, "two words"), (3, "three words here")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(docs, items).collect()}
    assert got == {(0, 0): 0.675, (1, 1): 1.0, (2, 2): 1.0, (3, 3): 1.0}


def test_blocks_of_the_benchmark_change_nothing(spark):
    shared = [f"s{i}" for i in range(20)]
    items = [(i, " ".join(shared + [f"own{i}x{j}" for j in range(20)])) for i in range(20)]
    docs = spark.createDataFrame([(0, " ".join(shared)), (1, items[3][1]), (2, "none of it")], "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i): 1.0 if (d, i) == (1, 3) else 0.5 for d in (0, 1) for i in range(20)}
    for block_bytes in (8 << 20, 2000):
        assert {(r.doc_id, r.item_id): r.score for r in contaminated(docs, items, block_bytes=block_bytes).collect()} == want


# -- language model


def brute_ctw(rows, depth=lm.DEPTH):
    count, below = defaultdict(lambda: [0, 0]), defaultdict(set)

    def steps(raw):
        x = bytes(depth) + raw + b"\0"
        for p in range(depth, len(x)):
            for t in range(8):
                yield x[p - depth : p], (1 << t) | (x[p] >> (8 - t)), (x[p] >> (7 - t)) & 1

    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for c, node, bit in steps((text or "").encode()):
                for d in range(depth + 1):
                    count[c[depth - d :], node][bit] += 1
                    if d:
                        below[c[depth - d + 1 :], node].add(c[depth - d :])
    kt = lambda a, b: lgamma(a + 0.5) + lgamma(b + 0.5) - log(math.pi) - lgamma(a + b + 1)
    memo = {}

    def weighted(c, node):
        if (c, node) not in memo:
            own = kt(*count[c, node])
            if len(c) == depth:
                memo[c, node] = own, own, own
            else:
                children = sum(weighted(x, node)[0] for x in below[c, node])
                top = max(own, children)
                memo[c, node] = top + log(exp(own - top) + exp(children - top)) - log(2), own, children
        return memo[c, node]

    def one(c, node, d=0):
        zeros, ones = count.get((c[depth - d :], node), (0, 0))
        p = (ones + 0.5) / (zeros + ones + 1)
        if d == depth or (c[depth - d - 1 :], node) not in count:
            return p
        _, own, children = weighted(c[depth - d :], node)
        w = 1 / (1 + exp(max(-700, min(700, children - own))))
        return w * p + (1 - w) * one(c, node, d + 1)

    return {i: sum(math.log10(one(c, node) if bit else 1 - one(c, node)) for c, node, bit in steps((text or "").encode())) for i, text in rows}


def test_scores_as_brute_force(spark):
    rows = [(i, "The cat sat on the mat. " * (i % 4) + f"é{i}" + "zq" * (i % 3)) for i in range(12)] + [(12, ""), (13, "\n"), (14, None)]
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_ctw(rows)
    assert got.keys() == want.keys()
    learned = Counter(t for i, x in rows if zlib.crc32(str(i).encode()) % 5 != 1 for t in [*word_list(x), None])
    total = sum(learned.values())
    for i, text in rows:
        tokens = [*word_list(text), None]
        r = got[i]
        assert r.score == pytest.approx(want[i], abs=1e-8)
        n = len((text or "").encode())
        assert r.n_bytes == n and (r.bits_per_byte == pytest.approx(-want[i] / math.log10(2) / n, abs=1e-8) if n else r.bits_per_byte is None)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(tokens), total)
        assert r.n_known == sum(learned[t] > 0 for t in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((learned[t] + 0.5) / (total + 0.5 * (len(learned) + 1))) for t in tokens), abs=1e-9)


def test_contexts_in_parts_are_as_whole():
    rng = np.random.default_rng(9)
    key = np.unique(rng.integers(0, 6, (4000, 6)) @ (256 ** np.arange(6)))
    n = rng.integers(0, 4, len(key))
    whole, cut = lm.Levels(key, n, len(key)), lm.Levels(key, n, 40)
    assert len(cut.cuts) > 10 and len(list(whole.parts())) == 1
    for x, y in zip(whole.up(), cut.up()):
        assert np.allclose(x, y, rtol=1e-12)
    p, seen = whole.one(whole.only)
    parts = [cut.one(x) for x in cut.parts()]
    assert np.allclose(p, np.concatenate([x[0] for x in parts]), rtol=1e-12) and (seen == np.concatenate([x[1] for x in parts])).all()


# -- mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = sum(w[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * w[s] / share for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_as_brute_force(spark):
    rng = random.Random(6)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 10, 1000, rng.randint(1, 10**6)]) for s in rng.sample([None, "", "a", "B", "é", "src1", "src10", "src2", "z"], rng.randint(1, 9))}
        got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = brute_targets(sizes)
        for r in got:
            assert r.target == pytest.approx(want[r.source], rel=1e-9)


def test_quotas_go_to_the_highest_quotients(spark):
    rows = [("a", 1, 500, 0, 0, 400.0), ("b", 2, 90, 0, 0, 200.0), ("c", 3, 30, 0, 0, 30.0), ("d", 4, 10, 0, 0, 0.0)]
    frame = spark.createDataFrame([(*r[:3], 630, 4, r[5]) for r in rows], "source string, rank int, source_size long, total long, n_sources long, target double")
    got = {(r.rank, r.shard): r.seats for r in shard_quotas(frame, 5, 7).collect()}
    won, seats = [0] * 4, Counter()
    for s in range(35):
        best = max(range(4), key=lambda i: (rows[i][5] / (2 * won[i] + 1), -i))
        won[best] += 1
        seats[best + 1, s // 7] += 1
    assert got == dict(seats)


def mix_rows(rng, n=400):
    return [(i, None if i % 50 == 0 else " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), rng.choice([None, "a", "b", "c", "big", "big", "big"])) for i in range(n)]


def test_mix_comes_near_its_targets(spark):
    rows = mix_rows(random.Random(7))
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(frame).collect()
    again = mix_sources(frame.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    size = {i: len((t or "").split()) for i, t, _ in rows}
    by = defaultdict(list)
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size
        by[r.source].append(r)
    want = brute_targets({s: sum(r.size for r in x) for s, x in by.items()})
    for s, x in by.items():
        assert x[0].target == pytest.approx(want[s]) and x[0].source_size == sum(r.size for r in x)
        assert abs(sum(r.taken for r in x) - want[s]) <= 0.01 * want[s] + 5


@pytest.mark.parametrize("blocks", [32768, 8])
def test_each_source_comes_to_its_target_in_whole_words(spark, blocks):
    if blocks == 8:  # few blocks, targets that break them
        rows = mix_rows(random.Random(8))
    else:  # 8 million words, a block is 244 words: small sources beside a large one
        rows = [(i, "w " * 20000, "big") for i in range(400)] + [(1000 + i, "w " * 10, s) for i, s in enumerate(["a", "b", "b", "b", None, None])]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=1, blocks_per_shard=blocks).collect()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert {s: taken[s] for s in target} == pytest.approx(target, abs=0.5 + 1e-6)


def spark_hash(*values):
    """xxhash64 over columns: int, long (as ("long", n)), string; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v[1].to_bytes(8, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(4, "little", signed=True)
            h = xxhash.xxh64(raw, h).intdigest()
    return h - 2**64 if h >= 2**63 else h


def brute_taken(rows, shards=64, blocks=512, buckets=4096):
    """(words taken, by place in rows; seats by source and shard) from plain lists of words."""
    line = defaultdict(list)
    for place, (i, t, s) in enumerate(rows):
        h = spark_hash(17, None if i is None else ("long", i), t)
        line[s].append(((h % 2**64 >> 20) % buckets, h, i is not None, i or 0, len(word_list(t)), place))
    target = brute_targets({s: sum(d[4] for d in x) for s, x in line.items()})
    order = sorted(line, key=lambda s: (s is None, (s or "").encode()))
    seats, won, total = Counter(), Counter(), sum(d[4] for x in line.values() for d in x)
    for seat in range(shards * blocks if total else 0):
        s = max(order, key=lambda s: (target[s] / (2 * won[s] + 1), -order.index(s)))
        won[s] += 1
        seats[s, seat // blocks] += 1
    out = [0] * len(rows)
    for rank, s in enumerate(order, 1):
        docs = sorted(line[s])
        words = [d[5] for d in docs for _ in range(d[4])]
        share = [seats[s, j] for j in range(shards)] if won[s] else [int(spark_hash(17, rank) % shards == j) for j in range(shards)]
        taken, goal = Counter(), round(target[s])
        edge = [math.floor(len(words) * (sum(share[:j]) / sum(share))) for j in range(shards + 1)]
        cut = [math.floor(goal * (e / max(1, len(words))) + 0.5) for e in edge]
        for j in range(shards):
            stretch, quota = words[edge[j] : edge[j + 1]], cut[j + 1] - cut[j]
            for _ in range(quota // len(stretch) if stretch else 0):
                taken.update(stretch)
            part = quota % len(stretch) if stretch else 0
            length = max(1, min(total // (shards * blocks), len(stretch)))
            n = max(1, len(stretch) // length)
            chosen = min(part // length, n)
            turn = spark_hash(17, rank, j) % n
            mine = [b for b in range(n) if ((b + 1) * chosen + turn) // n > (b * chosen + turn) // n]
            for b in mine:
                taken.update(stretch[b * length : (b + 1) * length])
            rest = part - len(mine) * length
            taken.update(stretch[min(b for b in range(n + 1) if b not in mine) * length :][:rest])
        assert sum(taken.values()) == goal
        for *_, n, place in docs:
            assert taken[place] <= 3 * n
            out[place] = taken[place]
    return out, seats


@pytest.mark.parametrize("shards, blocks, buckets", [(4, 16, 4096), (64, 512, 3), (1, 3, 7)])
def test_taken_as_brute_force(spark, shards, blocks, buckets):
    rows = mix_rows(random.Random(shards), 300) + [(900, "a few words only", "tiny"), (901, "w " * 3000, "b"), (901, "w " * 3000, "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, r["size"], r.source, r.taken) for r in mix_sources(frame, shards=shards, blocks_per_shard=blocks, buckets=buckets).collect())
    taken, seats = brute_taken(rows, shards, blocks, buckets)
    assert got == Counter((i, len(word_list(t)), s, n) for (i, t, s), n in zip(rows, taken))
    size = Counter()
    for _, t, s in rows:
        size[s] += len(word_list(t))
    plan = {(r.source, r.shard): r.seats for r in shard_plan(source_targets(spark.createDataFrame(list(size.items()), "source string, source_size long")), shards, blocks).collect()}
    assert plan == {(s, j): seats[s, j] for s in size for j in range(shards)}


def test_apply_mix_repeats_documents(spark):
    rows = mix_rows(random.Random(9))
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.doc_id: (r.size, r.taken) for r in mix_sources(frame).collect()}
    times = Counter(r.doc_id for r in apply_mix(frame).collect())
    for i, (size, words) in taken.items():
        assert (times[i] == 0) if not size else abs(times[i] - words / size) < 1


# -- sharding


def test_jump_hash_moves_rows_only_into_the_new_shard(spark):
    keys = spark.range(3000).select("id", *(jump_hash(F.col("id"), n).alias(f"s{n}") for n in range(1, 13))).toPandas()
    for n in range(1, 12):
        moved = keys[keys[f"s{n}"] != keys[f"s{n + 1}"]]
        assert (moved[f"s{n + 1}"] == n).all() and abs(len(moved) / 3000 - 1 / (n + 1)) < 0.04
        assert keys[f"s{n}"].between(0, n - 1).all()
        assert keys.groupby(f"s{n}").size().min() > 0.8 * 3000 / n


def brute_shards(rows, shards, buckets):
    """(doc_id, size, text_crc32, shard, slot, grown_shard), counted, of rows (doc_id, text)."""

    def jump(doc_id, n):
        key, at, to, draw = spark_hash("shard", None if doc_id is None else ("long", doc_id)), -1, 0, 0
        while to < n:
            draw += 1
            at, to = to, (to + 1) * 2**31 // ((spark_hash(("long", key), draw) % 2**64 >> 33) + 1)
        return at

    line = defaultdict(list)
    for i, t in rows:
        raw = (t or "").encode()
        size, crc = len(raw) + 1, zlib.crc32(raw)
        bucket = spark_hash(None if i is None else ("long", i), ("long", crc), ("long", size)) % buckets
        line[jump(i, shards)].append((bucket, i is not None, i or 0, crc, size, jump(i, shards + 1)))
    return Counter((i if known else None, size, crc, shard, slot, grown) for shard, x in line.items() for slot, (_, known, i, crc, size, grown) in enumerate(sorted(x)))


def test_shards_and_slots_as_brute_force(spark):
    rows = [(i % 97 if i % 13 else None, None if i % 7 == 0 else "é" * (i % 5)) for i in range(400)]
    for shards in (1, 8, 11, 64, 300):
        got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards, buckets=16).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot, r.grown_shard) for r in got) == brute_shards(rows, shards, 16)


def test_jumps_beyond_the_first_draws(spark, monkeypatch):
    from pathloom.llm import sharding

    keys = spark.range(500)
    want = [r[0] for r in keys.select(jump_hash(F.col("id"), 50)).collect()]
    monkeypatch.setattr(sharding, "AT_ONCE", 2)
    assert [r[0] for r in keys.select(jump_hash(F.col("id"), 50)).collect()] == want


def test_slots_are_gapless(spark):
    rows = [(i % 97 if i % 13 else None, None if i % 7 == 0 else "é" * (i % 5)) for i in range(700)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8, buckets=16).toPandas()
    for _, x in got.groupby("shard"):
        assert sorted(x.slot) == list(range(len(x)))
    assert got.groupby("doc_id", dropna=False).shard.nunique().max() == 1
    want = Counter((None if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((None if i != i else int(i), s, c) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32)) == want


# -- token counts


@pytest.mark.parametrize("scores", ["zipf", "ties"])
def test_counts_as_the_tokenizer(spark, scores):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = load_pieces(PIECES)
    if scores == "ties":
        pieces = [(p, -float(1 + i % 3)) for i, (p, _) in enumerate(pieces)]
    tokenizer = Tokenizer(models.Unigram(pieces, 0, True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    texts = ["", " ", "  a  b ", "Hello world, hello!", "naïve façade 日本語 😀", "\n\t x", "▁ already", "a" * 300, "supercalifragilistic " * 3]
    rng = random.Random(1)
    texts += ["".join(rng.choice("abcdefghij é\n.,日") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    counter = TokenCounter(pieces)
    assert [counter.text(t) for t in texts] == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    if scores == "zipf":
        got = count_tokens(spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string"), pieces).collect()
        assert {r.doc_id: r.n_tokens for r in got} == {i: counter.text(t or "") for i, t in enumerate([*texts, None])}


@pytest.mark.parametrize("fallback", [True, False])
def test_long_words_are_walked_as_short_ones(fallback):
    rng = random.Random(4)
    pieces = [("▁", -2.0), ("▁a", -2.5), *(("".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))), -float(rng.randint(1, 9))) for _ in range(60))]
    pieces += [(f"<0x{b:02X}>", -12.0) for b in range(256)] if fallback else []
    counter = TokenCounter(pieces)
    assert counter.byte_fallback is fallback
    for _ in range(40):
        word = "▁" + "".join(rng.choice("abcdeé😀") for _ in range(rng.randint(0, 150)))
        chars = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
        assert counter._alone(chars) == counter._together(chars, np.array([0]), np.array([len(chars)]))[0]


# -- toxicity


def test_index_finds_the_nearest():
    rng = np.random.default_rng(1)
    examples = rng.random((300, 12)) * (rng.random((300, 12)) < 0.3)
    examples = examples[examples.any(axis=1)]
    examples = np.unique(examples / np.linalg.norm(examples, axis=1, keepdims=True), axis=0)
    parts = [(np.flatnonzero(e), e[e > 0]) for e in examples]
    index = Index(parts, np.ones((len(parts), 2)), np.arange(len(parts)), 12, block=16)
    queries = examples[:40] + 0.1 * (rng.random((40, 12)) < 0.5)
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    row, col = np.nonzero(queries)
    sims, found = index.nearest(row, col, queries[row, col], 40, 5)
    cosine = queries @ examples.T
    assert np.allclose(sims, np.maximum(-np.sort(-cosine, axis=1)[:, :5], 0) - (np.sort(-cosine, axis=1)[:, :5] == 0), atol=1e-9)
    assert np.allclose(sims, np.take_along_axis(cosine, index.ids[found], 1), atol=1e-9)


def toxic_rows(rng, n=600):
    vocabulary = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["vile", "nasty", "scummy"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxic_documents_are_told_apart(spark):
    rows, labels = toxic_rows(random.Random(2))
    docs = spark.createDataFrame(rows + [(9000, None), (9001, "")], "doc_id long, text string")
    marked = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, marked).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i].held_out} >= {i for i, _ in held}
    assert all(got[i].predicted == y and 0 <= got[i].score <= 1 for i, y in held)
    assert got[9000].predicted == got[9001].predicted == 0
    # labels that are held out aren't learned from
    turned = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels], "doc_id long, toxic int")
    assert {r.doc_id: r.score for r in score_toxicity(docs, turned).collect()} == {i: r.score for i, r in got.items()}
    assert {r.doc_id for r in drop_toxic(docs, marked).collect()} == {i for i, r in got.items() if not r.predicted}


def brute_toxicity(rows, labels, k=16, softness=0.05, chance=0.01):
    """Scores and the nearest voters' cosines by plain loops."""
    learn = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 5}
    plain = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().translate(ASCII_LOWER))
    bags = {i: Counter(x for w in plain(t) for x in [(0, w), *((n, w[:n]) for n in (3, 4, 5, 6, 7) if len(w) > n)]) for i, t in rows}
    n = [sum(y == v for y in learn.values()) for v in (0, 1)]
    seen = defaultdict(lambda: [0, 0])
    for i, y in learn.items():
        for x in bags[i]:
            seen[x][y] += 1

    def g(x):
        b, a = seen[x]
        cells = ((a, a + b, n[1]), (b, a + b, n[0]), (n[1] - a, sum(n) - a - b, n[1]), (n[0] - b, sum(n) - a - b, n[0]))
        return 2 * sum(c * log(c * sum(n) / (m * label)) for c, m, label in cells if c)

    terms = {x for x, (b, a) in seen.items() if a > 1 and a * n[0] >= 4 * b * n[1] and g(x) > 2 * log(len(seen) / chance)}
    idf = {x: log((1 + len(rows)) / (1 + sum(x in bag for bag in bags.values()))) + 1 for x in terms}

    def vector(bag):
        v = {x: (1 + log(c)) * idf[x] for x, c in bag.items() if x in terms}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {x: w / norm for x, w in v.items()}

    votes, vectors, prior = defaultdict(lambda: [0, 0]), {}, n[1] / sum(n)
    for i, y in learn.items():
        v = vector(bags[i])
        key = tuple(sorted((x, round(w, 9)) for x, w in v.items()))
        vectors[key] = v
        votes[key][y] += 1
    alone = [i for i in learn if not vector(bags[i])]
    known = {x for i in alone for x in bags[i] if x[0] == 0}
    rare = {x: log((1 + len(rows)) / (1 + sum(x in bag for bag in bags.values()))) + 1 for x in known}

    def words(bag):
        v = {x: (1 + log(c)) * rare[x] for x, c in bag.items() if x in known}
        norm = math.sqrt(sum(w * w for w in v.values())) or 1
        return {x: w / norm for x, w in v.items()}

    plain = {}
    for i in alone:
        if v := words(bags[i]):
            at = plain.setdefault(tuple(sorted((x, round(w, 9)) for x, w in v.items())), (v, [0, 0]))
            at[1][learn[i]] += 1
    out = {}
    for i, _ in rows:
        v = vector(bags[i])
        near, start = [(sum(w * e.get(x, 0) for x, w in v.items()), votes[key]) for key, e in vectors.items()], prior
        if not v:  # by all words, among the examples without a term
            none = votes.get((), [0, 0])
            v, start = words(bags[i]), (none[1] + prior) / (sum(none) + 1)
            near = [(sum(w * e.get(x, 0) for x, w in v.items()), n) for e, n in plain.values()]
        if not v:
            out[i] = (start, [])
            continue
        near = [x for x in sorted(near, key=lambda c: -c[0]) if x[0] > 0]
        assert len(near) <= k or near[k - 1][0] - near[k][0] > 1e-9 or near[k - 1][1] == near[k][1] or start != prior  # no tie decides here
        w = [1 / (1 - min(c, 1) + softness) for c, _ in near[:k]]
        out[i] = ((sum(x * e[1] for x, (_, e) in zip(w, near)) + start) / (sum(x * sum(e) for x, (_, e) in zip(w, near)) + 1), [c for c, _ in near[:k]])
    return out


def test_toxicity_scores_as_brute_force(spark):
    rows, labels = toxic_rows(random.Random(5), 300)
    rows += [(9000, None), (9001, ""), (9002, "Vile, NASTY; nasty scummy nastiness")]
    got = score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), k=400, evidence=400).collect()
    want = brute_toxicity(rows, labels, k=400)
    assert {r.doc_id for r in got} == want.keys()
    for r in got:
        score, cosines = want[r.doc_id]
        assert r.score == pytest.approx(score, abs=1e-9) and r.predicted == (score >= 0.5)
        assert [e.cosine for e in r.evidence] == pytest.approx(cosines, abs=1e-9)
        assert all(0 <= e.toxic <= 1 and e.weight == pytest.approx(1 / (1 - min(e.cosine, 1) + 0.05)) and zlib.crc32(str(e.doc_id).encode()) % 5 for e in r.evidence)


# -- top k


def test_top_k_as_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-2, 2)]) for _ in range(10)]) for i in range(300)]
    rows += [(300, None), (320, [float("nan")] * 10), (340, [None] * 10), (301, [1.0] * 4), (360, [1.0] * 4), (None, [0.5] * 10)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=7, query_block=6, rows=64, step=3).collect()
    whole = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in whole:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:7])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_top_k_is_exact_for_large_components(spark):
    rng = random.Random(13)
    rows = [(i, [rng.choice([1.0, -1.0]) * rng.choice([1e-3, 1.5, 1e7, 3e7 + 0.5, 5e8, 1e9, 1e17]) * rng.random() for _ in range(6)]) for i in range(200)]
    rows += [(i, [rng.choice([1e7, 1e7 + 1 / 64, 1e7 + 2 / 64]) for _ in range(6)]) for i in range(200, 260)]
    rows += [(300, [1.0, 1.0]), (301, [5e8, 2.0]), (302, [1e9, 2.0]), (320, [3e7 + 0.5, 1.0])]
    rows += [(340, []), (341, []), (360, [1e300] * 3), (361, [1e300, 1.0, 1.0]), (362, [-1e300, 1.0, 1.0]), (363, [1e307] * 3)]
    rows += [rows[20], (20, rows[21][1]), (20, rows[22][1])]  # ids that repeat
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=7, query_block=9, candidate_block=50, rows=16, step=2).collect()
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if all(math.isfinite(64 * x) for x in v)]
    want = []
    for at, (q, own) in enumerate(whole):
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for j, (i, v) in enumerate(whole) if j != at and len(v) == len(own))
            want += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scores[:7])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


# -- the pipeline


def test_pipeline_as_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    vocabulary = [f"word{i}" for i in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [prose(n) for n in (30, 12, 9, 2, 25)]
    docs, labels = [], []
    for i in range(260):
        text = prose(rng.randint(10, 60))
        if i % 9 == 0:
            for word in ("vile", "nasty", "scummy"):
                text.insert(rng.randrange(len(text)), word)
        elif i % 11 == 0:
            item = list(rng.choice(items))
            if len(item) > 10:
                item[5] = "changed"
            text[3:3] = item
        elif i % 5 == 0 and docs:
            text = docs[rng.randrange(len(docs))][1].split()
            if rng.random() < 0.5:
                text[len(text) // 2] = "other"
        docs.append((i, " ".join(text), "en", rng.choice(["a", "b", "c", None]), 1))
        if i % 4:
            labels.append((i, int("vile" in text)))
    docs += [(900, None, None, "a", None), (901, "", None, None, 1), (None, "no id and vile nasty scummy", None, "b", 1), (None, "no id but fine", None, "b", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    key = lambda d: (d[0], d[1])
    kept = [d for d in docs]
    scores = brute_toxicity([(j, d[1]) for j, d in enumerate(docs[:260])], labels)
    kept = [d for d in docs if not {"vile", "nasty", "scummy"} <= set((d[1] or "").split())]
    assert all((scores[d[0]][0] < 0.5) == (d in kept) for d in docs[:260])
    with_words = [d for d in kept if word_list(d[1])]
    classes = brute_classes([(j, d[1]) for j, d in enumerate(with_words)])
    first = {}
    for j, d in enumerate(with_words):
        known = first.get(classes[j][0])
        if known is None or (d[0] is None, d[0] or 0) < (known[0] is None, known[0] or 0):
            first[classes[j][0]] = d
    kept = list(first.values()) + [d for d in kept if not word_list(d[1])]
    plain = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    found = lambda d: any(brute_align(x, plain(d[1])) >= max(0.5 * len(x), min(8, len(x))) for x in items)
    clean = [d for d in kept if not found(d)]
    assert 0 < len(clean) < len(kept) < len(docs)
    taken, _ = brute_taken([(d[0], d[1], d[3]) for d in clean])
    out = []
    for d, n in zip(clean, taken):
        size = len(word_list(d[1]))
        same = [m for e, m in zip(clean, taken) if e[0] == d[0] and len(word_list(e[1])) == size]
        draw = spark_hash(17, "draw", None if d[0] is None else ("long", d[0])) % (1 << 20) / (1 << 20)
        out += [key(d)] * (math.floor(sum(same) / len(same) / size + draw) if size else 0)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot, r.grown_shard) for r in got) == brute_shards(out, 8, 4096)


def test_long_texts_in_pieces_are_as_whole(monkeypatch):
    import pyarrow as pa

    from pathloom.llm import toxicity

    rng = random.Random(2)
    texts = ["", "ab  cd " * 3, " ".join("x" * rng.randint(1, 30) + rng.choice(["", "é", "\t"]) for _ in range(900)), "y" * 5000, None, "  tail ", "last one"]
    raw, offsets = textkit.flat(pa.array(texts))
    whole = textkit.word_hashes(raw, offsets)
    counter = TokenCounter(load_pieces(PIECES))
    counts = counter.texts(pa.array(texts))
    doc, h = (np.concatenate(x) for x in zip(*toxicity.features(pa.array(texts))))
    keys = [lm.byte_strings(raw[s:e], np.array([0, e - s]))[0] for s, e in zip(offsets[:-1], offsets[1:])]
    for target in (50, 700):
        monkeypatch.setattr(textkit.word_pieces, "__defaults__", (target, textkit._IS_SPACE))
        assert len(list(textkit.word_pieces(raw, offsets))) > 10 and b"".join(bytes(b) for _, b, _ in textkit.word_pieces(raw, offsets)) == bytes(raw)
        for x, y in zip(textkit.word_hashes(raw, offsets), whole):
            assert (x == y).all()
        assert (counter.texts(pa.array(texts)) == counts).all()
        parts = [np.concatenate(x) for x in zip(*toxicity.features(pa.array(texts)))]
        assert sorted(zip(parts[0].tolist(), parts[1].tolist())) == sorted(zip(doc.tolist(), h.tolist()))
        for i, key in enumerate(keys):
            pieces = list(lm.gram_pieces(raw[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), target))
            assert (np.concatenate([x[0] for x in pieces]) == key).all() and all(x[1][-1] == len(x[0]) for x in pieces)


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["a b", None, "", " x\n", "one  two three four five six", "É é"]
    raw, offsets = textkit.flat(pa.array(texts))
    start, end, first = textkit.words(raw, offsets)
    assert np.diff(first).tolist() == [len((t or "").split()) for t in texts]
    assert [bytes(raw[a:b]).decode() for a, b in zip(start, end)] == [w for t in texts for w in (t or "").split()]
    h, at = textkit.shingles(*textkit.word_hashes(raw, offsets), 5)
    assert np.diff(at).tolist() == [1, 0, 0, 1, 2, 1]
