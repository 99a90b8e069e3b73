"""Mixing, packing, the pipeline and the queries' SQL."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from docketry.llm import exact, language, mixing, near, packing, registry

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def canonical(rows, columns):
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(plain(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE[name])
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), list(want.columns))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def small(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"src{i % 4}" if i % 9 else None, 0) for i in range(120)] + [(None, "a b", "en", "src1", 0), (None, "c d", "en", "src1", 0), (5, None, "en", "src2", 0), (6, "", "en", "src3", 0), (7, "t t", "en", "src0", 0), (7, "t t", "en", "src0", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_mix(spark):
    d = small(spark)
    for rows in (5, 1000):
        order = [tuple(r) for r in mixing.mix_order(d, budget_share=0.5, bucket_rows=rows).collect()]
        assert order == sorted(order, key=lambda r: r[3]) and sum(r[2] for r in order) <= 0.5 * sum(r[2] for r in mixing.mix_order(d, budget_share=1).collect())
        kept = mixing.mix(d, budget_share=0.5, bucket_rows=rows)
        assert kept.columns == d.columns and sorted((r["doc_id"] or -1, r["source"] or "") for r in kept.collect()) == sorted((r[0] or -1, r[1] or "") for r in order)
        assert sorted(map(str, mixing.mix(d, budget_share=0.5, bucket_rows=rows, broadcast_rows=0).collect())) == sorted(map(str, kept.collect()))
    # while all sources last, tokens are shared by weight
    long = spark.createDataFrame([(i, "w " * 5, "en", f"src{i % 2}", 0) for i in range(4000)], DOCS)
    g = {r["source"]: r["count"] for r in mixing.mix(long, {"src1": 3}, 0.4).groupBy("source").count().collect()}
    assert 2.9 < g["src1"] / g["src0"] < 3.1
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.mix_order(d.limit(0)).count() == 0
    # one weight of a ten-thousandth, so nearly all finish within the first part of all times, and rows of no id
    skew = spark.createDataFrame([(None, f"w{i} " * (1 + i % 5), "en", f"src{i % 2}", 0) for i in range(3000)] + [(1, "", "en", "src0", 0)] * 40, DOCS)
    for share in (0.3, 0.62, 0.97):
        order = mixing.mix_order(skew, {"src1": 0.0001}, share, bucket_rows=20).collect()
        everything = mixing.mix_order(skew, {"src1": 0.0001}, 1.0, bucket_rows=10**6).collect()
        budget, n = int(share * sum(r["tokens"] for r in everything)), 0
        while sum(r["tokens"] for r in everything[: n + 1]) <= budget:
            n += 1
        assert sorted(map(str, order)) == sorted(map(str, everything[:n]))
    clash = d.selectExpr("*", "1 AS key", "2 AS PLACE", "3 AS tie", "4 AS last", "5 AS bucket")
    assert mixing.mix(clash).columns == clash.columns
    with pytest.raises(ValueError, match="weight"):
        mixing.mix(d, {"src0": 0})


def test_pack(spark):
    d = small(spark).union(spark.createDataFrame([(200, "w " * 45, "en", "s", 0), (201, "w " * 20, "en", "s", 0)], DOCS)).selectExpr("*", "1 AS piece", "2 AS SHARD", "3 AS bin")
    for shards in (1, 5, 32):
        rows = packing.pack(d, 10, shards).collect()
        assert {r["shard"] for r in rows} <= set(range(shards))
        bins = {}
        for r in rows:
            if r["bin"] is not None:
                bins.setdefault((r["shard"], r["fill_class"], r["bin"]), []).append(r)
        for (_, k, _), members in bins.items():
            assert sum(m["length"] for m in members) <= 10 and sorted(m["slot"] for m in members) == list(range(len(members))) and len(members) <= k
        short = [b for b, m in bins.items() if len(m) < b[1]]
        assert len(short) == len({b[:2] for b in short})  # one at most of each class and shard
        assert sum(r["length"] for r in rows) == sum(len((r["text"] or "").split()) for r in d.collect())
        assert sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 200) == [(i, 10 * i, min(10, 45 - 10 * i)) for i in range(5)]
        assert all(r["bin"] is None and r["fill_class"] is None for r in rows if r["length"] == 0)
    assert packing.pack(d.limit(0)).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        packing.pack(d, 0)
    long = packing.pack(spark.createDataFrame([(1, "漢" * 1600, "zh", "s", 0), (2, "b" * 17 + " c", "en", "s", 0)], DOCS), 60, 1).orderBy("doc_id", "piece").collect()
    assert [(r["doc_id"], r["start"], r["length"]) for r in long] == [(1, 0, 60), (1, 60, 40), (2, 0, 3)]
    nameless = spark.createDataFrame([(None, f"text {i}", "en", "s", 0) for i in range(200)], DOCS)
    assert len({r["shard"] for r in packing.pack(nameless, 10, 8).collect()}) == 8


def brute_pipeline(spark):
    """The stages one after the other on the driver, from each operator's own definition; the probabilities of the
    language model are the operator's, its scores are summed here letter by letter."""
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    at = {v: i for i, v in enumerate(language.vocabulary("/opt/tokenizers/piece_bpe_32k.model"))}
    longest, logs = max(map(len, at)), {}

    def word(w):
        if w not in logs:
            marked, sums = "▁" + w, [np.ones(model.p.shape[1])]
            for i in range(1, len(marked) + 1):
                sums.append(sum(sums[k] * model.p[at.get(marked[k:i], len(at))] for k in range(max(0, i - longest), i) if marked[k:i] in at or i - k == 1))
            logs[w] = np.log(sums[-1])
        return logs[w]

    def accepted(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        total = sum(map(word, words)) if words else None
        return total is not None and total[:-1].max() > total[-1]

    docs = [d for d in docs if d["text"] and accepted(d["text"])]
    first = {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        first.setdefault(d["text"], d)
    docs = [*first.values()]
    import hashlib

    import pyarrow as pa

    sig = near.signatures(pa.array([d["text"].lower() for d in docs]), near.COORDINATES, near.SHINGLE).astype("uint16")
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        same = (sig[: i + 1] == sig[i]).mean(axis=1)
        for j in range(i):
            if same[j] >= near.THRESHOLD:
                a, b = sorted((find(i), find(j)), key=lambda k: docs[k]["doc_id"])
                root[b] = a
    docs = [d for i, d in enumerate(docs) if find(i) == i]
    order, served = [], {}
    size = lambda d: sum(-(-len(w) // 16) for w in d["text"].split())
    digest = lambda d: hashlib.md5(d["text"].encode()).hexdigest()
    for d in sorted(docs, key=lambda d: hashlib.md5(f"7:{d['doc_id']}:{digest(d)}".encode()).hexdigest()[:16]):
        served[d["source"]] = served.get(d["source"], 0) + size(d)
        order.append((served[d["source"]] / mixing.WEIGHTS.get(d["source"], 1), d["source"], d["doc_id"], d))
    budget, kept = int(mixing.BUDGET_SHARE * sum(map(size, docs))), []
    for *_, d in sorted(order, key=lambda o: o[:3]):
        budget -= size(d)
        if budget < 0:
            break
        kept.append(d)
    out, place = [], {}
    for d in sorted(kept, key=lambda d: d["doc_id"]):
        n, start = size(d), 0
        while True:
            length = min(packing.CAPACITY, n - start)
            k = packing.CAPACITY // length
            shard = int(hashlib.md5(f"{d['doc_id']}:{digest(d)}".encode()).hexdigest()[:8], 16) % packing.SHARDS
            out.append((d["doc_id"], start // packing.CAPACITY, length, shard, k))
            start += length
            if start >= n:
                break
    for i, (_, _, _, shard, k) in enumerate(out):
        at = place[shard, k] = place.get((shard, k), -1) + 1
        out[i] = (*out[i], at // k, at % k)
    return sorted(out)


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"], r["shard"], r["fill_class"], r["bin"], r["slot"]) for r in got) == brute_pipeline(spark)
    assert len({r["shard"] for r in got}) > 1


def test_pipeline_leaves_one_table(spark):
    from docketry.llm import common

    with common.scratch():
        before = set(common._scratch)
        corpus_pipeline.run(spark, SF).count()
        left = set(common._scratch) - before
        assert len(left) == 1 and "pipeline-mix" in min(left)
    assert not set(common._scratch) - before


def test_stages_on_nulls_ties_and_clashing_columns(spark, tmp_path):
    text = "the thing and the other one, " * 20
    rows = [(i, f"{text} {i}", "en", "src1", 1) for i in range(4)] + [(None, None, None, None, None)] * 2 + [(None, text, "en", None, 1)] * 3 + [(7, "", "en", "src2", 0), (7, "der hund und die katze", "de", "src2", 9), (7, "der hund und die katze", "de", "src2", 9), (8, "12 34", "en", "src1", 3), (9, "one thing " * 30_000, "en", "src3", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS rid", "'x' AS TEXT_", "2 AS key", "3 AS Place", "4 AS len", "5 AS band", "6 AS share")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if name != "pack":
            assert after.columns == docs.columns
            kept[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "")[-9:]) for r in after.collect())
        docs = after
    assert len(kept["language"]) == 10  # null, empty and digits only go
    assert [k[:2] for k in kept["exact"]] == [(False, 0), (False, 1), (False, 2), (False, 3), (False, 7), (False, 9), (True, 0)]
    assert [k[:2] for k in kept["near"]] == [(False, 0), (False, 7), (False, 9)]
    assert docs.where("doc_id = 9").agg({"length": "sum"}).first()[0] in (None, 60_000)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "pack"] and corpus_pipeline.ORACLE_SQL is None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert exact.exact_dedup(docs).count() < docs.count()
