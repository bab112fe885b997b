"""Source divergence, spelling variants and near duplicates against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import bytetokens as bt
from pathloom.llm import divergence, neardup, spelling

SCHEMA = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- tokens --


@given(st.lists(st.text(alphabet="aBz \n\x00@[`{\x7fé×ÿĀ中"), max_size=8))
@settings(deadline=None)
def test_tokens_are_the_runs_of_the_pattern(texts):
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    for inside, pattern in ((bt.IS_TERM[buf], r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), (bt.latin_letters(buf), r"[A-Za-zÀ-ÿ]+")):
        start, end, first = bt.spans(inside, offsets)
        got = [[buf[s:e].tobytes().decode() for s, e in zip(start[a:b], end[a:b])] for a, b in zip(first, first[1:])]
        assert got == [re.findall(pattern, t) for t in texts]


def test_slices_of_one_hash_are_told_apart():
    words = [b"one", b"two", b"one", b"three", b"two", b"six"]
    buf = np.frombuffer(b"".join(words), dtype=np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    for digest in (bt.xxh3_64_intdigest, lambda raw: len(raw), lambda raw: 7):
        ids, rep = bt.group(buf, start, end, digest)
        assert [words[rep[i]] for i in ids] == words and len(set(ids.tolist())) == 4


# -- source divergence --


def divergence_by_hand(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for _, _, words in mine for t in set(words))
        kept = [t for t, n in held.items() if n >= least]
        counts = {s: Counter(t for _, s2, words in mine if s2 == s for t in words) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        gap = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(ranked, 1) if part == "pair" or r <= top]
    return sorted(out, key=repr)


def audit_rows(seed):
    rng = random.Random(seed)
    words = [rng.choice("abcXYZé中") + rng.choice(["", "a", "Ü", "zz"]) for _ in range(30)]
    rows = [(i, " ,.\n\x00"[i % 5].join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "a", "a", "é", None])) for i in range(60)]
    return rows + [rows[3], rows[3], (None, None, None, None), (61, "only here", "fr", "a"), (62, "12 34", "fr", "b"), (63, "word " * 900, "en", "long"), (64, "x", "xx", "alone")]


@pytest.mark.parametrize("top", [3, 200])
def test_divergence_as_by_hand(spark, top):
    rows = audit_rows(top)
    assert rows_of(divergence.source_divergence(spark.createDataFrame(rows, SCHEMA), top=top)) == divergence_by_hand(rows, top=top)


def test_divergence_of_no_rows(spark):
    assert rows_of(divergence.source_divergence(spark.createDataFrame([], SCHEMA))) == []


def test_shares_of_large_counts():
    n, total = np.array([3 * 10**12, 0]), np.array([4 * 10**13, 4 * 10**13])
    assert divergence.share(n, total, np.array([7, 7])).tolist() == [1 + 10**9 * (x + 1) // (4 * 10**13 + 7) for x in n.tolist()]


def test_pairs_of_long_rows_come_in_blocks():
    row = np.array([0, 0, 1, 2, 2, 2])
    got = [(a, b) for i, j in divergence.row_pairs(row, 2) for a, b in zip(i.tolist(), j.tolist())]
    assert sorted(got) == [(a, b) for a in range(6) for b in range(6) if a != b and row[a] == row[b]]


def test_a_long_document_counts_once_for_a_term():
    text = np.frombuffer(b"one two, one\n" * 500, dtype=np.uint8)
    doc, term, n, terms = divergence._slice_terms(text, np.array([0, len(text)]), 100)
    assert {terms[t]: k for t, k in zip(term, n.tolist())} == {b"one": 1000, b"two": 500} and len(doc) == 2


# -- spelling variants --


def near_by_hand(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if near_by_hand(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def misspelt(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aabbcdeéÿ") for _ in range(rng.randint(4, 9))) for _ in range(12)] + ["aaaaa", "aaaaaa", "aaaaaaa", "baaaaa"]
    words = list(base)
    for w in base * 6:
        i = rng.randrange(len(w))
        words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abÀ") + w[i:], w[:i] + rng.choice("abÿ") + w[i + 1 :]]))
    weights = [rng.choice([1, 2, 5, 20, 80]) for _ in words]
    rows = [(i, rng.choice([" ", "-", "·中"]).join(x.upper() if rng.random() < 0.1 else x for x in rng.choices(words, weights, k=60)), "en", "a") for i in range(60)]
    return rows + [rows[0], rows[0], (None, rows[1][1], None, None), (900, None, "en", "a"), (901, "", "en", "a"), (902, ("x" * 3000 + " " + "x" * 2999 + "y ") * 3 + "x" * 3001, "en", "a"), (903, "x" * 3001 + " " + "x" * 3001, "en", "a")]


@pytest.mark.parametrize("most", [4, 1024])
def test_variants_as_by_hand(spark, most):
    rows = misspelt(most)
    want = variants_by_hand(rows)
    assert sum(r[1] is not None for r in want) > 10 and any(r[1] != r[2] for r in want if r[1])
    assert rows_of(spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA), most=most)) == want


def test_variants_of_no_rows(spark):
    assert rows_of(spelling.spelling_variants(spark.createDataFrame([], SCHEMA))) == []


def test_checksums_are_combined():
    words, ids = [b"", b"a", "é".encode() * 30, b"z" * 500], [b"1:", b"-77:", b":"]
    doc, word = (x.ravel() for x in np.meshgrid(np.arange(3), np.arange(4)))
    assert spelling.checksums(ids, doc, words, word).tolist() == [zlib.crc32(ids[d] + words[w]) for d, w in zip(doc, word)]


@given(st.permutations(range(23)), st.lists(st.tuples(*[st.integers(0, 23)] * 4), min_size=1, max_size=20))
@settings(deadline=None)
def test_the_wavelet_tree_reports_rectangles(values, boxes):
    x0, x1, y0, y1 = (np.array(x) for x in zip(*boxes))
    query, value = spelling.WaveletTree(np.array(values)).report(x0, x1, y0, y1)
    got = defaultdict(list)
    for q, v in zip(query.tolist(), value.tolist()):
        got[q].append(v)
    for i, (a, b, c, d) in enumerate(boxes):
        assert sorted(got[i]) == sorted(v for v in values[a:b] if c <= v < d)


@given(st.sets(st.text(alphabet="ab", min_size=4, max_size=5), min_size=2))
@settings(deadline=None)
def test_near_pairs_of_a_group(words):
    words = sorted(words)
    size = np.full(len(words), 5)
    found = [p for a, b in spelling.near_pairs(np.zeros(len(words), np.int64), [w.encode() for w in words], size, np.zeros_like(size), size, 7) for p in zip(a.tolist(), b.tolist())]
    want = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near_by_hand(a, b) and 5 in (len(a), len(b))]
    assert sorted(found) == want


# -- near duplicates --


def components_by_hand(rows, n=3):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [shingles(r[1]) for r in rows]
    least = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = least[i], least[j]
                least = [min(x, y) if k in (x, y) else k for k in least]
    members = defaultdict(list)
    for i, k in enumerate(least):
        members[k].append(rows[i][0])
    known = lambda k: min((x for x in members[k] if x is not None), default=None)
    return sorted(((r[0], len(s), known(k), r[0] is not None and r[0] == known(k)) for r, s, k in zip(rows, sets, least)), key=repr)


def edited(seed, n_families, size):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n_families):
        text = rng.choices(vocab, k=120)
        for _ in range(size):
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                text = list(text)
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append((rng.randrange(10**6), " ".join(text).title() if rng.random() < 0.2 else " ".join(text), "en", "a"))
    rng.shuffle(rows)
    return rows + [rows[0], rows[0], (None, rows[1][1], None, None), (None, "alone without id", None, None), (7, None, "en", "a"), (8, " \t", "en", "a"), (9, "a b", "en", "a"), (10, "A  B", "en", "a"), (11, "a", "en", "a")]


@pytest.mark.parametrize("tile,bucket", [(4, 3), (512, 256)])
def test_components_as_by_hand(spark, tile, bucket):
    rows = edited(tile, 5, 25)
    want = components_by_hand(rows)
    assert len({r[2] for r in want}) > 12
    assert rows_of(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), tile=tile, bucket=bucket)) == want


def test_components_of_no_rows(spark):
    assert rows_of(neardup.near_duplicates(spark.createDataFrame([], SCHEMA))) == []


def test_links_within_and_across_are_verified():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 200 - 5 * k], rng.integers(0, 2**63, 5 * k, dtype=np.uint64)])) for k in range(9)]
    sig = neardup.signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])).astype(neardup.SENT)
    share = neardup.Fraction("0.85")
    label = neardup.resolve(np.arange(9), np.arange(9), sig, sets, neardup.floors_of(0.85, 1e-6), share)
    want = list(range(9))
    for i in range(9):
        for j in range(i):
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])):
                want = [min(want[i], want[j]) if k in (want[i], want[j]) else k for k in want]
    assert label.tolist() == want and len(set(want)) > 1
