"""Every operator on one table of nulls, empty and very long texts, ties, repeated rows and clashing names, and on none."""

import pytest

from docketry.llm import chat, exact, language, licences, mixing, near, packing, pii, quality, tokens

LONG = "the long " * 40_000
ROWS = [
    *[(1, "the cat and the dog", "en", "s1")] * 2,
    *[(2, None, None, None)] * 2,
    (3, "", "en", "s1"),
    (4, " \n\t ", "en", None),
    (None, LONG, "en", "s2"),
    (None, "x" * 300_000, "xx", "s1"),
    (5, "the cat and the dog", "fr", "s3"),
]
#: Names that the operators use themselves, and one that differs from a column's in case only.
CLASH = ("rid", "gid", "h1", "sig", "band", "root", "len", "head", "digit", "first", "key", "tie", "place", "finish", "bucket", "words", "shard", "piece", "start", "lang_id", "accepted", "draw", "cell", "share", "n_tokens", "licence", "n_words", "_words", "failed", "keep", "TEXT")


@pytest.fixture(scope="module")
def table(spark):
    d = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")
    return d.selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate(CLASH)])


def model(d):
    return language.fit(d, rounds=1)


#: operator -> (how it is applied, rows that it gives of the table)
OPERATORS = {
    "pii": (lambda d: pii.pseudonyms(d, b"k"), 9),
    "language": (lambda d: language.identify(d, model(d)), 9),
    "keep_identified": (lambda d: language.keep_identified(d, rounds=1), 5),
    "near": (near.near_dedup, 7),
    "tokens": (tokens.token_counts, 9),
    "packing": (packing.pack, 57),
    "exact": (exact.exact_dedup, 7),
    "licences": (licences.licence_spans, 0),
    "finish_times": (mixing.finish_times, 9),
    "mix_order": (lambda d: mixing.mix_order(d, budget_share=1.0), 9),
    "mix": (lambda d: mixing.mix(d, budget_share=1.0), 9),
    "quality": (quality.quality, 9),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(table, name):
    apply, n = OPERATORS[name]
    assert len(apply(table).collect()) == n
    assert apply(table.limit(0)).collect() == []
    if name in ("near", "exact", "mix", "keep_identified"):
        assert apply(table).columns == table.columns


def test_values_at_the_edges(table):
    lengths = {(r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(table).select("doc_id", "n_tokens").collect()}
    assert {(2, None), (3, 0)} < lengths
    verdicts = [(r["doc_id"], r["failed"], r["n_words"]) for r in quality.quality(table).collect()]
    assert verdicts.count((2, "too_short", 0)) == 2 and (3, "too_short,word_length", 0) in verdicts and (None, "", 80_000) in verdicts and verdicts.count((1, "", 5)) == 2
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in exact.exact_dedup(table).collect()) == [(False, 1), (False, 2), (False, 2), (False, 3), (False, 4), (True, 0), (True, 0)]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in near.near_dedup(table).collect()) == [(False, 1), (False, 2), (False, 2), (False, 3), (False, 4), (True, 0), (True, 0)]
    unchanged = {(r["doc_id"], r["text"]) for r in pii.pseudonyms(table, b"k").collect()}
    assert unchanged == {(i, t) for i, t, _, _ in ROWS}


def test_chat_edges(spark):
    rows = [(1, 0, "user", "a")] * 2 + [(None, None, None, None)] * 2 + [(2, 5, "assistant", ""), (2, None, "user", "x" * 300_000), (3, 0, "nobody", "b")]
    d = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").selectExpr("*", "1 AS turns", "2 AS cost", "3 AS steps", "4 AS TEXT")
    got = sorted((r["conv_id"] is None, r["conv_id"] or 0, r["steps"]) for r in chat.chat_format(d).collect())
    assert [g[:2] for g in got] == [(False, 1), (False, 2), (False, 3), (True, 0), (True, 0)] and got[1][2] == "keep:user,keep:assistant"
    assert chat.chat_format(d.limit(0)).collect() == []
