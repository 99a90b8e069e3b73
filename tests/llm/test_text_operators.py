"""Pseudonyms, languages, token counts, chat, licences and quality rules."""

import base64
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.llm import chat, language, licences, pii, quality, tokens
from docketry.llm.licence_texts import TEMPLATES

SF = "/root/testdata/sf0.001"
KEY = b"test key"


# 1. pseudonyms


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 100, 1000, 1025])
def test_feistel_permutes(n):
    assert sorted(pii.feistel(i, n, KEY, "k") for i in range(n)) == list(range(n))


def test_formats():
    text = "card 4539 5787 6362 1486, bad 4539 5787 6362 1487; ip 97.51.17.173 not 300.1.1.1; mail a.b-9@mail7.example.com; +1 (017) 555-7713; 123-45-6789 but 000-12-3456; 2020-02-29 29/02/2020 02/29/2020 not 2021-02-29; GB82 WEST 1234 5698 7654 32; token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
    new, found = pii.pseudonymise(text, KEY)
    assert found == {"card": 1, "ipv4": 1, "email": 1, "phone": 1, "ssn": 1, "date": 3, "iban": 1, "secret": 1}
    for gone in ("4539 5787 6362 1486", "97.51.17.173", "a.b-9@mail7", "555-7713", "123-45-6789", " 2020-02-29", " 29/02/2020", "GB82 WEST", "04dbebab91"):
        assert gone not in new
    for left in ("4539 5787 6362 1487", "300.1.1.1", "000-12-3456", "not 2021-02-29"):
        assert left in new
    y, m, d = re.search(r"(\d{4})-(\d\d)-(\d\d) (\d\d/\d\d/\d{4})", new).group(1, 2, 3)
    assert f"{d}/{m}/{y}" in new  # one day, whatever the order of its parts
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", new).group(1).replace(" ", "")
    assert pii.luhn_digit(card[:-1]) == card[-1]
    assert pii.iban(re.search(r"[A-Z]{2}\d\d WEST [\d ]+", new).group(), KEY)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(10**11, 10**12 - 1), min_size=2, max_size=8, unique=True))
def test_cards_stay_apart_and_linked(bodies):
    cards = [f"{b}000"[:15] for b in bodies]
    cards = [c + pii.luhn_digit(c) for c in dict.fromkeys(cards)]
    out = [pii.card(c, KEY) for c in cards]
    assert len(set(out)) == len(cards) and out == [pii.card(c, KEY) for c in cards] and all(pii.luhn_digit(c[:-1]) == c[-1] for c in out)


def test_dates_before_a_time_and_of_one_digit():
    new = lambda t: pii.pseudonymise(t, KEY)[0]
    y, m, d = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", new("1984-05-17")).groups()
    assert new("1984-05-17T00:00:00Z") == f"{y}-{m}-{d}T00:00:00Z" and f"{y}-{m}-{d}" != "1984-05-17"
    assert new("17/5/1984, 17.05.1984, 5/17/1984, 05/17/1984 and 1984/5/17") == f"{d}/{int(m)}/{y}, {d}.{m}.{y}, {int(m)}/{d}/{y}, {m}/{d}/{y} and {y}/{int(m)}/{d}"
    y, m, d = re.fullmatch(r"(\d{4})-0(\d)-0(\d)", new("1984-07-05")).groups()
    assert new("5/7/1984 05/7/1984 1984-7-5") == f"{d}/{m}/{y} 0{d}/{m}/{y} {y}-{m}-{d}"
    assert new("31/2/1984 1984-2-31T10 0/7/1984 1984-05-17Q") == "31/2/1984 1984-2-31T10 0/7/1984 1984-05-17Q"
    days = [f"{i % 31 + 1}/{i % 12 + 1}/{1900 + i % 200}" for i in range(3000)]
    out = {t: pii.date(t, KEY) for t in days}
    assert len({v for v in out.values() if v}) == sum(v is not None for v in out.values()) > 2900
    assert all(v is None or [*map(len, v.split("/"))] == [*map(len, t.split("/"))] for t, v in out.items())


@pytest.mark.parametrize("n", [128, 129, 172, 1000, 60_000])
def test_secrets_of_any_length(n):
    rng = random.Random(n)
    for letters in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"):
        value = "7" + "".join(rng.choice(letters) for _ in range(n - 1))
        new, found = pii.pseudonymise(f"token = '{value}' end", KEY)
        got = re.fullmatch(r"token = '([A-Za-z0-9]+)' end", new).group(1)
        assert found == {"secret": 1} and len(got) == n
        # nothing of it stays in place but what chance lets stay, at either end and in the middle
        for part in (slice(0, 40), slice(n // 2 - 20, n // 2 + 20), slice(n - 40, n)):
            assert sum(a == b for a, b in zip(value[part], got[part], strict=True)) < 16
        other = value[:-1] + ("1" if value[-1] != "1" else "2")
        assert pii.secret(other, KEY) != got


def test_pii_table(spark):
    rows = [(1, "x 97.51.17.173", "k"), (2, "y 97.51.17.173", "k"), (3, None, "k"), (4, "", "k"), (None, "clean text, 12 items", "k"), (5, "a" * 200_000 + " 97.51.17.173", "k")]
    d = spark.createDataFrame(rows, "doc_id int, text string, pii_found string")
    got = {r["doc_id"]: r for r in pii.pseudonyms(d, KEY).collect()}
    assert got[1]["text"][2:] == got[2]["text"][2:] == got[5]["text"][-len(got[1]["text"][2:]) :] and got[1]["pii_found"] == {"ipv4": 1}
    assert got[3]["text"] is None and got[4]["text"] == "" and got[None]["text"] == "clean text, 12 items" and got[None]["pii_found"] == {}
    assert pii.pseudonyms(d.limit(0), KEY).count() == 0
    with pytest.raises(ValueError, match="key"):
        pii.pseudonyms(d, b"")
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) == 32
    spark.conf.set("spark.docketry.pii.key", "named")
    try:
        assert pii.session_key(spark) == pii.session_key(spark) != pii._SESSION_KEY
    finally:
        spark.conf.unset("spark.docketry.pii.key")


#: Values by kind, and texts that hold none; the spans to be replaced are known from how the text is put together.
HELD = {
    "email": ["a.b-9@mail7.example.com", "x" * 65 + "@mail.example.org", "q@" + "sub." * 17 + "example.net", "josé.müller@exämple.de", "иван@почта.рф", "n1@a-b.co"],
    "card": ["4539 5787 6362 1486", "4539578763621486", "378282246310005", "3782 822463 10005", "6011-1111-1111-1117"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    "ipv4": ["97.51.17.173", "8.8.4.4"],
    "date": ["2020-02-29", "29/02/2020", "5/17/1984", "1.5.1999"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (017) 555-7713", "+49 30 1234 5678", "(555) 555-1234", "555-555-1234"],
    "secret": ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "Ab3" * 2000],
}
CLEAR = ["some words", "4539 5787 6362 1487", "300.1.1.1", "000-12-3456", "2021-02-29", "@ here", "1234", "v1.2.3", "token = short", "12 items", "a@b", "GB83 WEST 1234 5698 7654 32"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([(None, c) for c in CLEAR]), st.sampled_from([(k, v) for k, vs in HELD.items() for v in vs])), max_size=8))
def test_spans_against_planted_values(parts):
    text = lambda k, v: f'token = "{v}"' if k == "secret" else v
    new, found = pii.pseudonymise(" ; ".join(text(k, v) for k, v in parts), KEY)
    want = {}
    for k, _ in parts:
        if k:
            want[k] = want.get(k, 0) + 1
    assert found == want
    got = new.split(" ; ")
    assert len(got) == max(1, len(parts))
    for (k, v), g in zip(parts, got, strict=False):
        if k is None:
            assert g == v
        else:
            assert g != text(k, v) and (k == "ipv4" or len(g) == len(text(k, v))) and g == pii.pseudonymise(text(k, v), KEY)[0]


def test_formats_that_stay():
    assert [pii.phone(s, KEY)[:4] for s in ("+49 30 1234 5678", "+351 21 123 4567", "+44 20 7946 0958")] == ["+49 ", "+351", "+44 "] and pii.phone("+7 495 123 4567", KEY)[:3] == "+7 "
    new = pii.email("josé.müller@exämple.de", KEY)
    assert new.endswith(".de") and re.fullmatch(r"[^\W\d_]{4}\.[^\W\d_]{6}@[^\W\d_]{7}\.de", new)
    assert all(a != b for a, b in zip("иван", pii.email("иван@почта.рф", KEY), strict=False)) or pii.email("иван@почта.рф", KEY)[:4] != "иван"
    linked = {"dmy": lambda y, m, d: f"{d:02d}/{m:02d}/{y}", "mdy": lambda y, m, d: f"{m:02d}/{d:02d}/{y}", "ymd": lambda y, m, d: f"{y}-{m:02d}-{d:02d}"}
    for i in range(2000):  # one day in any order of its parts has one pseudonym, wherever the order can be told
        y, m, d = 1950 + i % 120, 1 + i % 12, 13 + i % 16
        a, b, c = (pii.date(f(y, m, d), KEY) for f in linked.values())
        assert c.split("-") == a.split("/")[::-1] == [b.split("/")[2], b.split("/")[0], b.split("/")[1]]
    long = "k" * 500_000 + "@" + "d." * 3 + "example.com"
    assert pii.pseudonymise("x " + long, KEY)[0].endswith(".com") and "k" * 30 not in pii.pseudonymise("x " + long, KEY)[0]


# 2. languages


@pytest.fixture(scope="module")
def pieces():
    return language.Pieces(language.vocabulary("/opt/tokenizers/piece_bpe_32k.model"))


def brute_log(at, p, word):
    """Logarithm of the sum over all segmentations of a word of any length, letter by letter in logarithms."""
    word, longest = "▁" + word, max(map(len, at))
    out = []
    for j in range(p.shape[1]):
        logs = [0.0]
        for i in range(1, len(word) + 1):
            arcs = [logs[k] + np.log(p[at.get(word[k:i], len(at)), j]) for k in range(max(0, i - longest), i) if word[k:i] in at or i - k == 1]
            logs.append(max(arcs) + np.log(sum(np.exp(a - max(arcs)) for a in arcs)))
        out.append(logs[-1])
    return np.array(out)


def test_forward_sums_all_segmentations(pieces):
    vocab = language.vocabulary("/opt/tokenizers/piece_bpe_32k.model")
    at = {v: i for i, v in enumerate(vocab)}
    p = np.random.default_rng(0).uniform(1e-6, 1e-3, (len(vocab) + 1, 2))

    def brute(word):
        word, total = "▁" + word, np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, a = [], 0
            for i, c in enumerate([*cuts, 1]):
                if c:
                    parts.append(word[a : i + 1])
                    a = i + 1
            if all(x in at or len(x) == 1 for x in parts):
                total += np.prod([p[at.get(x, len(vocab))] for x in parts], axis=0)
        return np.log(total)

    words = ["the", "x", "élan", "zürich", "漢字", "aaaaaaaa", "wordsmith"]
    assert np.allclose(language.log_scores(pieces, words, p), [brute(w) for w in words])
    model = language.Model(["a"], pieces, p)
    rng = random.Random(8)
    long = ["q" * 95, "".join(rng.choice("abcdeéñß漢字仮名") for _ in range(3000)), "the" * 40, "x" * 31, "y" * 32, "z" * 33, "ab" * 32]
    texts = ["the x", None, "", "12 !", "élan the the", long[0] + " x", " ".join(long), long[1]]
    scores, letters = language.score(model, texts, language.Known(2))
    want = [sum((brute_log(at, p, w) for w in "".join(c if c.isalpha() else " " for c in (t or "")).split()), np.zeros(2)) for t in texts]
    assert np.allclose(scores, want, rtol=1e-9) and letters.tolist() == [4, 0, 0, 0, 10, 96, sum(map(len, long)), 3000]


def test_training_raises_likelihood(pieces):
    counts = [("the", [5, 0]), ("und", [0, 7]), ("shared", [1, 1])]
    last = -np.inf
    for rounds in (1, 2, 4):
        p = language.train(pieces, counts, rounds, 0.001)
        s = language.log_scores(pieces, [w for w, _ in counts], p)
        now = sum(c[0] * s[i, 0] for i, (_, c) in enumerate(counts))
        assert now >= last - 1e-6 and np.allclose(p[:-1].sum(axis=0), 1)
        last = now


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = language.fit(train, sample_rows=60, rounds=2)
    rows = language.identify(test, model).join(test.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_id"] == r["lang"] for r in rows) >= 0.98 * len(rows)
    assert sum(r["accepted"] for r in rows) >= 0.99 * len(rows)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 34 !!", "x"), (None, "the of and the", "x")], "doc_id int, text string, lang_id string")
    got = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert all(got[i]["lang_id"] is None and not got[i]["accepted"] for i in (1, 2, 3)) and got[None]["lang_id"] == "en"
    assert language.identify(odd.limit(0), model).count() == 0 and language.fit(odd.selectExpr("doc_id", "text", "cast(null as string) lang")) is None
    assert language.identify(odd, None).where("accepted").count() == 0


def test_keep_identified(spark):
    rows = [(i, t, "en" if i % 2 else "de", "z") for i, t in enumerate(["der hund und die katze", "the dog and the cat"] * 5)] + [(50, None, "en", "z"), (51, "", "en", "z"), (52, "!!", None, "z")]
    d = spark.createDataFrame(rows, "doc_id int, text string, lang string, LANG_ID string")
    got = language.keep_identified(d)
    assert got.columns == d.columns and sorted(r["doc_id"] for r in got.collect()) == list(range(10))
    assert language.keep_identified(d.limit(0)).count() == 0
    # nothing to learn from: only texts without letters go, and no more
    none = d.selectExpr("doc_id", "text", "cast(null as string) AS lang", "LANG_ID")
    assert sorted(r["doc_id"] for r in language.keep_identified(none).collect()) == list(range(10))


FOREIGN = (
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待" * 3,
    "qzxv jkwq vbnmx zzkq xjqv wqkz pqxz vkjq zxqw kqvj",
    "2AbfKq9zXv7Lm3RtYpWsDgHjKlQwErTyUiOpZxCvBnM0aSdFg",
)


def test_language_rejects_foreign_and_junk_texts(spark):
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(FOREIGN)], clean.schema)
    labelled = clean.where("doc_id % 2 = 0")
    kept = {r["doc_id"] for r in language.keep_identified(labelled.union(odd), rounds=2).collect()}
    assert not any(10**6 + i in kept for i in range(len(FOREIGN)))
    assert len(kept) >= 0.99 * labelled.count()
    # rows that the model has not seen
    model = language.fit(labelled, rounds=2)
    unseen = language.identify(clean.where("doc_id % 2 = 1").union(odd), model).collect()
    assert all(r["accepted"] == (r["doc_id"] < 10**6) for r in unseen if r["doc_id"] >= 10**6)
    assert sum(r["accepted"] for r in unseen) >= 0.99 * (len(unseen) - len(FOREIGN))


def test_language_of_equal_scores(pieces):
    p = np.full((pieces.unknown + 1, 3), 1e-5)
    model = language.Model(["aa", "bb"], pieces, p)
    scores, _ = language.score(model, ["tied text"] * 2, language.Known(3))
    assert (scores[0] == scores[1]).all() and len(set(scores[0])) == 1 and scores[0, :2].argmax() == 0


@pytest.mark.parametrize("equal", [False, True])
def test_sample_of_null_and_repeated_ids(spark, equal):
    n = 1500
    rows = [(i, None if i % 2 else 7, f"{t} {'x' if equal else chr(97 + i % 26) * (i // 26 + 1)}", lang) for i in range(n) for t, lang in (("der hund und die katze", "de"), ("the dog and the cat", "en"))]
    d = spark.createDataFrame(rows, "n int, doc_id int, text string, lang string")
    for some in (d, d.withColumn("doc_id", F.lit(None).cast("int")), d.withColumn("doc_id", F.lit(3))):
        model = language.fit(some, rounds=1)
        assert model is not None and model.languages == ["de", "en"]
        assert language.keep_identified(some, rounds=1).count() == 2 * n


def test_sample_is_full_and_of_least_hash(spark):
    texts = ["rare words", *["same text"] * 5000, *[f"own {i}" for i in range(30)]]
    d = spark.createDataFrame([(None, t, "en") for t in texts], "doc_id int, text string, lang string")
    for seed in range(4):
        counts = {s: dict(zip((f := language._sample_words(d, {"en": s}, 40, seed))["word"], f["n"], strict=True)).get("", 0) for s in (180 / len(texts), 1.0)}
        assert counts[1.0] == 40
        seen = []
        real = language._sample_words
        try:
            language._sample_words = lambda *a: seen.append(real(*a)) or seen[-1]
            assert language.fit(d, sample_rows=40, rounds=1, seed=seed).languages == ["en"]
        finally:
            language._sample_words = real
        last = dict(zip(seen[-1]["word"], seen[-1]["n"], strict=True))
        assert last[""] == 40
        whole = real(d, {"en": 1.0}, 40, seed)
        assert last == dict(zip(whole["word"], whole["n"], strict=True))


# 4. token counts

BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def encoder():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute_prefixes(encoder, text):
    return [len(encoder.encode_ordinary(text[:i])) for i in range(len(text) + 1)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "'", "'re", "'ll", " ", "  ", "\n", "\t", "\xa0", "é", "漢", "1", "23", "!", "😀", " of", "\r\n", "v", "’", "½", "𝒳"]), max_size=12).map("".join))
def test_prefix_counts(encoder, text):
    assert tokens.prefix_counts(tokens.changes(BPE, text)).tolist() == brute_prefixes(encoder, text)


def test_prefix_counts_of_documents(encoder):
    for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' LIMIT 40").fetchall():
        assert tokens.prefix_counts(tokens.changes(BPE, t[:300])).tolist() == brute_prefixes(encoder, t[:300])
        assert tokens.prefix_counts(tokens.changes(BPE, t))[-1] == len(encoder.encode_ordinary(t))


def test_pieces_that_are_forgotten(monkeypatch):
    other = BPE.replace("byte_bpe_50k", "byte_bpe_multi_50k")
    text = " ".join(f"word{i} épée{i % 7}" for i in range(300)) + " " + "x" * 90 + " tail" * 3
    want = {path: tokens.changes(path, text) for path in (BPE, other)}
    monkeypatch.setattr(tokens, "_KNOWN", 50)
    for path in (BPE, other):
        met = tokens.Met(tokens.encoding(path))
        for _ in range(2):
            assert b"".join(map(met.__getitem__, tokens.units(text))) == want[path]
            assert len(met) <= 50 and len(met.before) <= 50 and max(map(len, met)) <= 32


def test_counts_of_long_texts(encoder):
    rng = random.Random(9)
    for text in ("".join(rng.choice("ab c1!é漢\n") for _ in range(400_000)), "z" * 20_000, " " * 50_000 + "a"):
        assert tokens.prefix_counts(tokens.changes(BPE, text))[-1] == len(encoder.encode_ordinary(text))


def test_wide_changes():
    assert tokens.prefix_counts(tokens._pack([0, 1, 500, 2])).tolist() == [0, 1, 500, 2]


def test_token_table(spark, encoder):
    text = "Hello   world, it's\n\n fine. " * 40
    d = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0), (None, "one", 0)], "doc_id int, text string, n_tokens int")
    table = tokens.token_counts(d, budgets=(5, 50)).cache()
    got = {r["doc_id"]: r for r in table.collect()}
    assert got[1]["n_tokens"] == len(encoder.encode_ordinary(text)) and got[2]["n_tokens"] is None and got[3]["n_tokens"] == 0 and got[3]["fits_5"] == 0
    counts = brute_prefixes(encoder, text)
    assert got[1]["fits_50"] == max(i for i, c in enumerate(counts) if c <= 50)
    assert {r["doc_id"]: r["tokens"] for r in tokens.tokens_of_prefix(table, 33).collect()} == {1: counts[33], 2: None, 3: 0, None: 1}
    assert {r["doc_id"]: r["chars"] for r in tokens.longest_prefix(table, 7).collect()}[1] == max(i for i, c in enumerate(counts) if c <= 7)
    assert tokens.token_counts(d.limit(0)).count() == 0


# 7. chat


def brute_repair(roles, most=3):
    """Least cost over all sequences of actions."""
    best = None

    def legal(seq):
        return all(p in chat.LEGAL for p in zip([None, *seq], seq, strict=False)) and seq[-1] == chat.FINAL

    def go(i, out, cost, inserted):
        nonlocal best
        if best is not None and cost >= best:
            return
        if i == len(roles) and out and legal([r for r, _ in out]):
            best = cost
        if i < len(roles):
            for r in chat.ROLES:
                if (out[-1][0] if out else None, r) in chat.LEGAL:
                    go(i + 1, [*out, (r, True)], cost + (0 if roles[i] == r else chat.RELABEL), 0)
            if out and out[-1][1]:
                go(i + 1, out, cost + chat.MERGE + (0 if roles[i] == out[-1][0] else chat.RELABEL), 0)
        if inserted < most:
            for r in chat.ROLES:
                if (out[-1][0] if out else None, r) in chat.LEGAL:
                    go(i, [*out, (r, False)], cost + chat.INSERT, inserted + 1)

    go(0, [], 0, 0)
    return best


def test_repair_costs_least():
    for n in range(1, 5):
        for roles in itertools.product(["system", "user", "assistant", None], repeat=n):
            cost, steps = chat.repair(roles)
            assert cost == brute_repair(roles, 2), roles
            seq = [r for a, r, _ in steps if a != "merge"]
            assert all(p in chat.LEGAL for p in zip([None, *seq], seq, strict=False)) and seq[-1] == chat.FINAL
            assert [i for _, _, i in steps if i is not None] == list(range(n))
            price = {"keep": 0, "relabel": chat.RELABEL, "insert": chat.INSERT}
            assert cost == sum(price[a] if a != "merge" else chat.MERGE + (0 if roles[i] == r else chat.RELABEL) for a, r, i in steps)


def test_chat_table(spark):
    rows = [(1, 1, "assistant", "hi <|user|>"), (1, 0, "Human", "q"), (2, 0, "user", "a"), (2, 1, "user", "b"), (2, 2, "bot", None), (None, None, None, "?"), (3, 0, "user", "x"), (3, 0, "user", "x")]
    d = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").selectExpr("*", "1 AS turns", "2 AS cost")
    got = {r["conv_id"]: r for r in chat.chat_format(d).collect()}
    assert got[1]["rendered"] == "<|user|>\nq<|end|>\n<|assistant|>\nhi < |user|><|end|>\n" and got[1]["cost"] == 0
    assert got[2]["steps"] == "keep:user,merge:user,keep:assistant" and "a\nb" in got[2]["rendered"]
    assert got[None]["cost"] == 7 and got[3]["cost"] in (3, 6)
    nameless = chat.chat_format(spark.createDataFrame([(None, i % 2, "user", "same", i) for i in range(6)], "conv_id int, turn int, role string, text string, x int")).collect()
    assert [(r["conv_id"], r["cost"], r["rendered"]) for r in nameless] == [(None, 4, "<|user|>\nsame<|end|>\n<|assistant|>\n<|end|>\n")] * 6
    long = chat.chat_format(spark.createDataFrame([(1, i, "user" if i % 3 else "assistant", "" if i % 2 else "x" * 500) for i in range(6000)], "conv_id int, turn int, role string, text string")).collect()
    assert len(long) == 1 and long[0]["rendered"].count("x" * 500) == 3000
    assert chat.chat_format(d.limit(0)).count() == 0 and chat.repair([]) == (0, [])
    assert chat.repair(["user", "assistant"] * 500)[0] == 0


# 8. licences


def test_matching_statistics():
    rng = random.Random(2)
    templates = {str(i): " ".join(rng.choice("abcd") for _ in range(12)) for i in range(4)}
    a = licences.Automaton(templates)
    whole = [licences.tokens(t) for t in templates.values()]
    for _ in range(30):
        doc = [rng.choice("abcde") for _ in range(20)]
        ids = [a.words.get(w, 0) for w in doc]
        for i, (n, v) in enumerate(a.statistics(ids)):
            best = max(k for k in range(i + 2) if k == 0 or any(doc[i + 1 - k : i + 1] == t[j : j + k] for t in whole for j in range(len(t) - k + 1)))
            assert n == best
            if n:
                run = doc[i + 1 - n : i + 1]
                assert a.ends[v] == sorted((t, j + n - 1) for t, w in enumerate(whole) for j in range(len(w) - n + 1) if w[j : j + n] == run)


def test_spans():
    a = licences.Automaton(TEMPLATES)
    names = lambda t: [s.licence for s in licences.spans(a, t)]
    assert names("Prose. Released under the MIT License. More prose") == ["MIT notice"]
    assert names("x Licensed under the Apache License, Version 2.0. y") == ["Apache-2.0 notice"]
    assert names("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3 notice"]
    assert names("Licensed under CC BY-NC 4.0.") == ["CC BY-NC 4.0 notice"]
    words = TEMPLATES["MIT"].split()
    broken = " ".join(w if i % 40 else "XX" for i, w in enumerate(words))
    got = licences.spans(a, "intro " + broken + " outro")
    assert [s.licence for s in got] == ["MIT"] and got[0].start <= 2 and 0.9 < got[0].cover < 1
    assert names("the license of the work is under the version") == [] and licences.spans(a, None) == [] and licences.spans(a, "") == []
    assert names(TEMPLATES["BSD-3-Clause"]) == ["BSD-3-Clause"] and names(TEMPLATES["BSD-2-Clause"]) == ["BSD-2-Clause"]
    twice = licences.spans(a, "Released under the MIT License. filler words between these two notices are many. Released under the MIT License.")
    assert len(twice) == 2


def test_notice_beside_words_of_a_longer_template():
    a = licences.Automaton(TEMPLATES)
    names = lambda t: [s.licence for s in licences.spans(a, t)]
    assert licences.spans(a, "Licensed under the Apache License, Version 2.0. The code is old.") == [("Apache-2.0 notice", 0, 8, 8, 1.0)]
    assert names('Licensed under the Apache License, Version 2.0 (the "License"); see LICENSE for more.') == ["Apache-2.0 notice"]
    assert names(TEMPLATES["Apache-2.0"]) == ["Apache-2.0"]
    own = licences.Automaton({"long": "a b c d e f g h i j k l m n o p q r s t", "inner": "e f g h i"})
    got = lambda t: [tuple(s) for s in licences.spans(own, t)]
    assert got("x e f g h i j k x") == [("inner", 1, 6, 5, 1.0)]  # followed
    assert got("x c d e f g h i x") == [("inner", 3, 8, 5, 1.0)]  # preceded
    assert got("x c d e f g h i j x") == [("inner", 3, 8, 5, 1.0)]
    assert [s[0] for s in got("a b c d e f g h i j k l m n o p q r s t")] == ["long"]
    # a part that the template has twice doesn't take tokens from the run through both
    assert licences.spans(licences.Automaton({"t": "a b c d x a b c d y"}), "a b c d x a b c d y") == [("t", 0, 10, 10, 1.0)]


def test_runs_of_every_place():
    rng = random.Random(5)
    for _ in range(40):
        templates = {str(i): " ".join(rng.choice("abc") for _ in range(rng.randint(3, 14))) for i in range(4)}
        a = licences.Automaton(templates)
        whole = [licences.tokens(t) for t in templates.values()]
        doc = [rng.choice("abcd") for _ in range(25)]
        want = set()
        for t, w in enumerate(whole):
            for i, j in itertools.product(range(len(doc)), range(len(w))):
                if doc[i] == w[j] and (i == 0 or j == 0 or doc[i - 1] != w[j - 1]):
                    n = next(k for k in range(1, 26) if i + k == len(doc) or j + k == len(w) or doc[i + k] != w[j + k])
                    want |= {(t, i + n, j + n, n)} if n >= 2 else set()
        got = [(t, *run) for t, run in licences._runs(a, np.array([a.words.get(w, 0) for w in doc]), 2)]
        assert len(got) == len(want) and set(got) == want


def test_whole_legal_texts():
    from docketry.llm.licence_texts import templates

    a = licences.Automaton(templates())
    whole = [n for n in templates() if n.endswith(" text")]
    assert len(whole) == 13
    for name in whole:
        got = licences.spans(a, "Some prose before it. " + templates()[name] + " And after it.")
        assert [s.licence for s in got] == [name] and got[0].cover == 1.0, name
    # every ninth line gone: still found, as itself
    rng = random.Random(3)
    for name in ("Apache-2.0 text", "GPL-3 text", "MPL-2.0 text"):
        cut = "\n".join(line for i, line in enumerate(templates()[name].splitlines()) if i % 9)
        assert max(licences.spans(a, cut), key=lambda s: s.matched).licence == name
    many = "Released under the MIT License. " * 3000 + " ".join(rng.choice(["the", "license", "of", "work", "terms"]) for _ in range(100_000))
    assert len(licences.spans(a, many)) >= 3000


def brute_chain(runs, max_gap):
    """Most tokens of a chain that ends with each run."""
    best = []
    for i, (end, last, n) in enumerate(runs):
        most = n
        for j in range(i):
            e, la, _ = runs[j]
            new = min(n, end - e, last - la)
            if new > 0 and end - n - e <= max_gap and last - n - la <= max_gap:
                most = max(most, best[j] + new)
        best.append(most)
    return max(best, default=0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 40), st.integers(1, 6)), max_size=9), st.integers(0, 8))
def test_chains_against_brute_force(raw, gap):
    runs = sorted(licences.Run(e + n, p + n, n) for e, p, n in raw)
    chains = [*licences._chains(runs, gap)]
    assert max((m for _, _, m in chains), default=0) == brute_chain(runs, gap)
    assert sum(1 for _ in chains) <= len(runs) and all(a < b for a, b, _ in chains)


def test_licence_table(spark):
    d = spark.createDataFrame([(1, "Released under the MIT License.", "x"), (1, "Released under the MIT License.", "x"), (2, None, "x"), (3, "", "x")], "doc_id int, text string, licence string")
    assert [(r["doc_id"], r["licence"], r["start_token"], r["end_token"], r["cover"]) for r in licences.licence_spans(d).collect()] == [(1, "MIT notice", 0, 5, 1.0)] * 2
    assert licences.licence_spans(d.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "Released under the MIT License.")] * 2, "doc_id int, text string")
    assert [r["doc_id"] for r in licences.licence_spans(nameless).collect()] == [None, None]


# 10. quality


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (3, "the cat sat on a mat with some friends of his"), (4, "$$$ ### a&&& b%%% c***"), (5, "der " * 30), (6, "same line\n" * 9), (7, "- a b c\n- d e f\n* g h"), (8, " \n\n ")]
    d = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 AS n_words", "true AS keep", "'x' AS TEXT2")
    got = {r["doc_id"]: r for r in quality.quality(d).collect()}
    assert got[1]["failed"] == "too_short" and got[1]["symbol_ratio"] is None and got[2]["failed"].startswith("too_short") and got[8]["n_words"] == 0
    assert got[3]["keep"] and "symbols" in got[4]["failed"] and "repeated_words" in got[5]["failed"] and "stop_words" in got[5]["failed"]
    none = quality.quality(spark.createDataFrame([(1, " ".join(f"kw{i}" for i in range(50))), (2, " ".join(f"kw{i}" for i in range(49))), (3, "the " + " ".join(f"kw{i}" for i in range(49))), (3, "the " + " ".join(f"kw{i}" for i in range(49))), (4, "of a word " * 200_000)], "doc_id int, text string")).collect()
    assert sorted((r["doc_id"], r["failed"]) for r in none) == [(1, "no_stop_words"), (2, ""), (3, ""), (3, ""), (4, "")]
    assert got[6]["failed"] == "repeated_lines" and "bullet_lines" in got[7]["failed"]
    assert quality.quality(d.limit(0)).count() == 0
    plan = quality.quality(d)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
