"""Exact and near deduplication, and the helpers they share."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.llm import common, exact, near

DOCS = "doc_id bigint, text string, lang string"


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x or 0))


def test_pick_and_box(spark):
    d = spark.createDataFrame([(1, "a", "b", "c")], "doc_id int, text string, TEXT string, rid string")
    assert common.pick(d, "doc_id", "text").collect() == [(1, "a")]
    with pytest.raises(ValueError, match="missing"):
        common.pick(d, "source")
    two = d.select("doc_id", d["rid"].alias("x"), d["rid"].alias("x"))
    assert common.Boxed(two).open(common.Boxed(two).df).columns == ["doc_id", "x", "x"]


def test_exact_edges(spark):
    long = "x" * 70_000
    rows = [(5, "a", "en"), (3, "a", None), (None, "a", "en"), (3, "a", "zz"), (7, None, "en"), (7, None, "en"), (8, "", "en"), (9, "", "en"), (10, long + "1", ""), (11, long + "2", ""), (12, long + "1", ""), (13, "A", ""), (14, "a ", "")]
    d = spark.createDataFrame(rows, DOCS)
    got = exact.exact_dedup(d)
    assert ids(got) == [3, 7, 7, 8, 10, 11, 13, 14] and got.columns == d.columns
    assert ids(exact.exact_dedup(d, broadcast_bytes=0)) == [3, 7, 7, 8, 10, 11, 13, 14]
    assert exact.exact_dedup(d.limit(0)).count() == 0
    clash = d.selectExpr("doc_id", "text", "lang AS len", "lang AS head", "lang AS gid", "lang AS RID", "lang AS done", "lang AS n")
    assert exact.exact_dedup(clash).columns == clash.columns and exact.exact_dedup(clash).count() == 8


def test_exact_of_one_hot_text(spark):
    """A text of 5,000 copies among others, long enough for three rounds, and groups that part in each of them."""
    hot = "h" * 5000
    d = spark.range(8000).selectExpr("id AS doc_id", f"CASE WHEN id < 5000 THEN '{hot}' WHEN id < 6000 THEN concat('{hot[:-4]}', lpad(id % 7, 4, '0')) WHEN id < 7000 THEN concat(lpad(id % 5, 300, 'x'), '{hot}') ELSE concat(repeat('y', 400), lpad(id % 3, 9, 'z')) END AS text")
    for size in (0, 8 << 20):
        assert ids(exact.exact_dedup(d, broadcast_bytes=size)) == [0, *range(5000, 5007), *range(6000, 6005), 7000, 7001, 7002]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.one_of(st.none(), st.text("ab", max_size=4), st.sampled_from(["p" * 31, "p" * 32, "p" * 33, "p" * 290 + "a", "p" * 290 + "b", "é" * 144 + "x"]))), max_size=30))
def test_exact_against_brute_force(spark, rows):
    d = spark.createDataFrame(rows, "doc_id int, text string")
    want = sorted([i for i, t in rows if t is None] + [min(i for i, u in rows if u == t) for t in {t for _, t in rows} - {None}])
    assert sorted(r["doc_id"] for r in exact.exact_dedup(d).collect()) == want


def brute_elements(text, n=2):
    import unicodedata

    spaced = "".join(f" {c} " if "\u4e00" <= c <= "\u9fff" or "\u0e00" <= c <= "\u0eff" and unicodedata.category(c)[0] in "LMN" else c if unicodedata.category(c)[0] in "LMN" else " " for c in text.lower())
    words = spaced.split(" ")
    words = [w for w in words if w]
    return Counter(zip(*[words[i:] for i in range(n)], strict=False)) if len(words) >= n else Counter([tuple(words)] if words else [])


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_elements(spark):
    texts = ["a b a b c", "", "one", "é-É x", None, "  !! ", "a b", "«mot» — l’été\u00a0fini", "漢字漢字。漢", "สวัสดีครับ x", "ⅷ 𝒳𝒳 e\u0301a", "漢", "🙂 🙂", "x漢y"]
    arr = pa.array([t.lower() if t else "" for t in texts])
    raw = b"".join((t or "").lower().encode() for t in texts)
    ends = np.cumsum([len((t or "").lower().encode()) for t in texts])
    doc, h, n = near.elements(np.frombuffer(raw, np.uint8), ends, 2)
    for i, t in enumerate(texts):
        assert sorted(n[doc == i]) == sorted(brute_elements(t or "").values())
    assert set(h[doc == 6]) < set(h[doc == 0])
    sig = near.signatures(arr, 128, 2)
    assert not sig[[1, 4, 5]].any() and sig[[0, 2, 3, 6]].any(axis=1).all()
    assert (near.signatures(arr.slice(2, 2), 128, 2) == sig[2:4]).all()


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    for size in (3, 60, 900):
        e = rng.integers(0, 1 << 62, size).astype(np.uint64)
        a, b = rng.uniform(0.1, 6, size), rng.uniform(0.1, 6, size)
        keep = rng.uniform(size=size) < 0.8
        keep[0] = True
        true = np.minimum(a, np.where(keep, b, 0)).sum() / np.maximum(a, np.where(keep, b, 0)).sum()
        got = []
        for s in range(12):
            es = near.mix64(e + np.uint64(s * 1000003))
            sig = near.darts(2, np.concatenate([np.zeros(size, int), np.ones(int(keep.sum()), int)]), np.concatenate([es, es[keep]]), np.concatenate([a, b[keep]]), 128)
            got.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(got) - true) < 0.05


def test_near_of_unspaced_scripts_and_long_texts(spark):
    rng = random.Random(4)
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(840))
    other = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(840))
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(300_000))
    rows = [(1, han), (2, han[:-1] + "一"), (3, other), (4, "«" + " ".join(han[:300]) + "»"), (5, " ".join(han[:300])), (6, long), (7, long + " more")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert ids(near.near_dedup(d)) == [1, 3, 4, 6]


def test_near_in_a_large_bucket(spark):
    """Thousands of texts that share a passage and meet in the same buckets, three groups of near copies among them."""
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(10**6)}"
    passage = [word() for _ in range(45)]
    rows = [(i, " ".join(passage + [word() for _ in range(55)])) for i in range(3000)]
    for g, base in enumerate((100, 1500, 2900)):
        text = rows[base][1].split(" ")
        rows += [(10_000 + 10 * g + j, " ".join([*text[: 98 - j], *[word() for _ in range(2 + j)]])) for j in range(4)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert ids(near.near_dedup(d)) == [*range(3000)]


def near_docs():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    docs, groups = [], []
    shared = " ".join(rng.choice(vocab) for _ in range(60))
    for g in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([40, 120, 500]))]
        members = []
        for c in range(rng.choice([1, 1, 2, 3, 8])):
            words = [w if c == 0 or rng.random() > 0.05 else rng.choice(vocab) for w in base]
            members.append(len(docs))
            docs.append((len(docs), " ".join(words) + (" " + shared if g % 5 == 0 and len(base) == 500 else ""), "en"))
        groups.append(members)
    return docs, groups


def test_near_against_brute_force(spark):
    docs, groups = near_docs()
    d = spark.createDataFrame(docs, DOCS)
    kept = set(ids(near.near_dedup(d)))
    assert all(min(g) in kept for g in groups)
    bags = [brute_elements(t) for _, t, _ in docs]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2) if jaccard(bags[a], bags[b]) >= near.THRESHOLD + 0.1]
    caught = sum(not (a in kept and b in kept) for a, b in pairs)
    assert len(pairs) > 30 and caught >= 0.9 * len(pairs)
    with common.scratch():
        groups = near.grouped(near.signed(d))
        at = {r["gid"]: r["root"]["id"] for r in groups.collect()}
        found = [(at[r["a"]], at[r["b"]]) for r in near.similar(groups).collect()]
    assert not [(a, b) for a, b in found if jaccard(bags[a], bags[b]) < near.THRESHOLD - 0.2]
    # all pairs of equal bags have equal signatures, and pairs are those of comparing everyone who shares a band
    sigs = {r["rid"]["id"]: np.frombuffer(r["sig"], np.uint16) for r in near.signed(d).collect()}
    assert all((sigs[a] == sigs[b]).all() == (bags[a] == bags[b]) for a, b in itertools.combinations(sigs, 2))
    parent = {i: i for i in sigs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sigs), 2):
        if (sigs[a].reshape(near.BANDS, -1) == sigs[b].reshape(near.BANDS, -1)).all(axis=1).any() and (sigs[a] == sigs[b]).mean() >= near.THRESHOLD:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert kept == {i for i in sigs if find(i) == i}


def test_near_recall_at_the_threshold(spark):
    """Of all pairs of the test documents whose weighted sets are as similar as the threshold asks, however close to it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    kept = set(ids(near.near_dedup(docs)))
    bags = [(r["doc_id"], brute_elements(r["text"] or "")) for r in docs.collect()]
    bags = sorted(((b.total(), i, b) for i, b in bags), key=lambda t: t[:2])
    pairs, clean = [], {i for _, i, _ in bags}
    for x, (n, i, a) in enumerate(bags):
        for m, j, b in bags[x + 1 :]:
            if n < near.THRESHOLD * m:
                break
            shared = sum(min(k, b[e]) for e, k in a.items())
            if n and shared >= 0.4 * (n + m - shared):
                clean -= {i, j}
                if shared >= near.THRESHOLD * (n + m - shared):
                    pairs.append((i, j))
    caught = sum(not (i in kept and j in kept) for i, j in pairs)
    assert len(pairs) > 100 and caught >= 0.9 * len(pairs)
    assert len(clean) > 500 and clean <= kept


def test_near_edges(spark):
    t = " ".join(f"word{i}" for i in range(80))
    rows = [(4, t, "en"), (2, t.upper(), "en"), (None, t + " tail", "en"), (2, t.upper(), "de"), (9, None, "en"), (9, None, "en"), (10, "", "en"), (11, "?!", "en"), (12, "solo", "en"), (13, "Solo!", "en"), (20, "z " * 60_000, "en"), (21, "q other text here", "en"), (22, "q other text here", "en"), (22, "q other text here", "fr")]
    d = spark.createDataFrame(rows, DOCS)
    assert ids(near.near_dedup(d)) == [2, 9, 9, 10, 11, 12, 20, 21]
    assert ids(near.near_dedup(d, broadcast_bytes=0)) == [2, 9, 9, 10, 11, 12, 20, 21]
    assert near.near_dedup(d.limit(0)).count() == 0
    clash = d.selectExpr("doc_id", "text", "lang AS rid", "lang AS h1", "lang AS sig", "lang AS bands", "lang AS BAND", "lang AS root")
    assert near.near_dedup(clash).columns == clash.columns
    same = spark.createDataFrame([(1, "one row twice", "a"), (1, "one row twice", "b")], DOCS)
    assert near.near_dedup(same).count() == 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(100 + rng.randrange(20), 100 + rng.randrange(20)) for _ in range(15)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {(x, find(x)) for x in parent if find(x) != x}
    d = spark.createDataFrame([(b, a) if i % 2 else (a, b) for i, (a, b) in enumerate(edges)], "u int, v int")
    assert {tuple(r) for r in near.components(d).collect()} == want
    assert near.components(d.where(F.lit(False))).count() == 0
