"""Operator 2. Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary. A word's probability is the sum, by the
forward algorithm, over all ways to cut it into pieces; a document's score is the sum of its words' logarithms. Piece
probabilities are trained here by expectation-maximisation (forward-backward) on the words of labelled rows; beside the
languages there is a model that knows none, all pieces alike, and a document that it explains best is rejected.

Scale: training takes a bounded sample, ``sample_rows`` labelled rows a language, drawn by a hash over all rows; its
word counts are summed by Spark. Scoring is one narrow stage over Arrow batches: words that a worker has met are looked
up, the others of a batch go through the forward algorithm together in numpy. What is sent to workers is a matrix of
vocabulary size, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import partial
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm import common

SAMPLE_ROWS, ROUNDS, SMOOTHING, UNKNOWN = 400, 4, 0.02, 1e-6
#: In training, a longer run of letters counts as several words; in scoring, words of any length are one.
LONGEST = 40
#: The forward sums of a word are brought back to 1 after so many letters, so that no product underflows.
_RESCALE = 32
_KNOWN = 300_000
_WORDS_AT_ONCE = 10_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_CHARS_AT_ONCE = 1 << 19
_MARK = ord("▁")


def words(text: str) -> list[str]:
    """Runs of letters, lower case, those for training cut to LONGEST."""
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return [w[i : i + LONGEST] for w in runs for i in range(0, len(w), LONGEST)]


def vocabulary(path: str) -> list[str]:
    """The pieces of letters, lower case, with or without the mark of a word's beginning."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p == p.lower() and re.fullmatch(r"▁|▁?[^\W\d_]+", p)})


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_tables.get("up", ())) < n:
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(max(1 << 16, 1 << (n - 1).bit_length()), b, _U)
            p[0] = 1
            _tables[name] = np.multiply.accumulate(p)
    return _tables["up"], _tables["down"]


class Rolling:
    """Hashes of substrings of a string of code points."""

    def __init__(self, flat: np.ndarray) -> None:
        up, self.down = _powers(len(flat) + 1)
        salted = (flat.astype(_U) + _U(0x51ED)) * _U(0xD6E8FEB86659FD93)
        salted ^= salted >> _U(32)
        self.total = np.zeros(len(flat) + 1, _U)
        np.cumsum(salted * up[: len(flat)], dtype=_U, out=self.total[1:])

    def of(self, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return _mix((self.total[start + n] - self.total[start]) * self.down[start] + np.asarray(n).astype(_U))


class Pieces:
    """The vocabulary as a sorted array of hashes; finds the pieces within many words at once."""

    def __init__(self, pieces: Sequence[str]) -> None:
        self.longest = max(map(len, pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        h = Rolling(_code("".join(pieces))).of(np.cumsum(lengths) - lengths, lengths)
        order = np.argsort(h)
        self.hashes, self.ids, self.unknown = h[order], order, len(pieces)
        if (np.diff(self.hashes) == 0).any():
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(h >> _U(44)).astype(np.int64)] = True

    def lattice(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """First nodes, and arcs (from, to, piece), of words laid end to end in ``flat``, each with a mark in front.
        A word of n code points has n + 1 nodes. Arcs come in steps, by their place in the word, and the arcs of a
        step end at different nodes."""
        ends = np.cumsum(lengths)
        start = ends - lengths
        word = np.repeat(np.arange(len(lengths)), lengths)
        every = np.arange(len(flat))
        left = ends[word] - every
        roll = Rolling(flat)
        found_at, found_n, found_piece = [], [], []
        for n in range(1, min(self.longest, int(lengths.max())) + 1):
            at = every if n == 1 else at[left[at] >= n]  # noqa: F821
            h = roll.of(at, n)
            some = np.flatnonzero(self.maybe[(h >> _U(44)).astype(np.int64)])
            i = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            hit = self.hashes[i] == h[some]
            if n == 1:
                piece = np.full(len(at), self.unknown)
                piece[some[hit]] = self.ids[i[hit]]
                here = at
            else:
                here, piece = at[some[hit]], self.ids[i[hit]]
            found_at.append(here)
            found_n.append(np.full(len(here), n))
            found_piece.append(piece)
        at, n, piece = np.concatenate(found_at), np.concatenate(found_n), np.concatenate(found_piece)
        place = (every - start[word])[at].astype(np.int32)
        order = np.argsort(place, kind="stable")
        at, n, piece = at[order], n[order], piece[order]
        cuts = np.flatnonzero(np.diff(place[order])) + 1
        node = at + word[at]
        edges = [0, *cuts.tolist(), len(node)]
        return start + np.arange(len(lengths)), [(node[a:b], node[a:b] + n[a:b], piece[a:b]) for a, b in pairwise(edges)]


def _code(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _marked(batch: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    return _code("▁" + "▁".join(batch)), np.fromiter(map(len, batch), np.int64, len(batch)) + 1


def forward(lattice: tuple[np.ndarray, list], lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sum over all segmentations up to each node, one column a model; for words short enough not to underflow."""
    first, steps = lattice
    alpha = np.zeros((int(lengths.sum()) + len(lengths), p.shape[1]))
    alpha[first] = 1
    for a, b, piece in steps:
        alpha[b] += alpha[a] * p[piece]
    return alpha


def _logs(pieces: Pieces, flat: np.ndarray, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithms of whole words' sums: every _RESCALE letters the sums that later arcs may begin at are divided by
    the greatest of them, which is kept as a logarithm."""
    first, steps = pieces.lattice(flat, lengths)
    alpha = np.zeros((len(flat) + len(lengths), p.shape[1]))
    alpha[first] = 1
    scale = np.zeros((len(lengths), p.shape[1]))
    for i, (a, b, piece) in enumerate(steps, 1):
        alpha[b] += alpha[a] * p[piece]
        if i % _RESCALE == 0 and len(on := np.flatnonzero(lengths > i)):
            # nodes at and after place i that an arc has reached; no later arc begins before them
            ahead = np.minimum(i + np.arange(pieces.longest), lengths[on, None]) + first[on, None]
            most = alpha[ahead].max(axis=1)
            scale[on] += np.log(most)
            window = np.unique(ahead)
            alpha[window] /= most[np.searchsorted(first[on], window, "right") - 1]
    return np.log(alpha[first + lengths]) + scale


def log_scores(pieces: Pieces, batch: Sequence[str], p: np.ndarray) -> np.ndarray:
    """Logarithm of each word's probability (words x models), all segmentations summed."""
    return _logs(pieces, *_marked(batch), p) if batch else np.zeros((0, p.shape[1]))


def train(pieces: Pieces, counts: Sequence[tuple[str, Sequence[float]]], rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Piece probabilities (pieces + unknown x languages + 1) by expectation-maximisation from words and their counts
    in each language; the last column is the model that knows no language."""
    n = pieces.unknown
    languages = len(counts[0][1])
    parts = []
    for i in range(0, len(counts), _WORDS_AT_ONCE):
        some = counts[i : i + _WORDS_AT_ONCE]
        flat, lengths = _marked([w for w, _ in some])
        first, steps = pieces.lattice(flat, lengths)
        small = [tuple(x.astype(np.int32) for x in step) for step in steps]
        parts.append(((first, small), lengths, np.array([c for _, c in some], float)))
    p = np.full((n + 1, languages), 1 / n)
    p[n] = UNKNOWN
    for _ in range(rounds):
        seen = np.zeros_like(p)
        for lattice, lengths, weight in parts:
            alpha = forward(lattice, lengths, p)
            beta = np.zeros_like(alpha)
            last = lattice[0] + lengths
            beta[last] = weight / alpha[last]
            for a, b, piece in reversed(lattice[1]):
                arc = beta[b] * p[piece]
                for j in range(languages):
                    seen[:, j] += np.bincount(piece, alpha[a, j] * arc[:, j], n + 1)
                    beta[:, j] += np.bincount(a, arc[:, j], len(beta))
        seen[n] = 0
        p = (1 - smoothing) * seen / np.maximum(seen.sum(axis=0), 1e-300) + smoothing / n
        p[n] = UNKNOWN
    none = np.full((n + 1, 1), 1 / n)
    none[n] = UNKNOWN
    return np.concatenate([p, none], axis=1)


class Model:
    """Languages in alphabetical order, the pieces and the probabilities."""

    def __init__(self, languages: Sequence[str], pieces: Pieces, p: np.ndarray) -> None:
        self.languages, self.pieces, self.p = list(languages), pieces, p
        #: the same in all tasks that read it
        self.key = hashlib.blake2b(p.tobytes()).hexdigest()


class Known:
    """Hashes of words that a worker has met, sorted, and their scores; begun anew when there are too many."""

    def __init__(self, models: int) -> None:
        self.hashes, self.rows = np.zeros(0, _U), np.zeros((0, models))


_memory: dict[str, Known] = {}


def score(model: Model, texts: Sequence[str | None], known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities (texts x models) and numbers of letters."""
    low = [t.lower() if t else "" for t in texts]
    scores, letters = np.zeros((len(low), model.p.shape[1])), np.zeros(len(low))
    a = 0
    while a < len(low):
        b, size = a + 1, len(low[a])
        while b < len(low) and size + len(low[b]) <= _CHARS_AT_ONCE:
            size += len(low[b])
            b += 1
        scores[a:b], letters[a:b] = _score(model, low[a:b], known)
        a = b
    return scores, letters


def _score(model: Model, low: list[str], known: Known) -> tuple[np.ndarray, np.ndarray]:
    flat = _code("".join(low))
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))
    on = np.zeros(len(flat) + 2, bool)
    on[1:-1] = _letters()[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[ends] = True
    start = np.flatnonzero(on[1:-1] & (~on[:-2] | edge[:-1]))
    stop = np.flatnonzero(on[1:-1] & (~on[2:] | edge[1:])) + 1
    doc = np.searchsorted(ends, start, "right")
    letters = np.bincount(doc, stop - start, len(low))
    if not len(start):
        return np.zeros((len(low), model.p.shape[1])), letters
    h, at, each = np.unique(Rolling(flat).of(start, stop - start), return_index=True, return_inverse=True)
    new = np.flatnonzero(~np.isin(h, known.hashes, assume_unique=True))
    if len(new):
        if len(known.hashes) + len(new) > _KNOWN:
            known.hashes, known.rows, new = known.hashes[:0], known.rows[:0], np.arange(len(h))
        rows = []
        for i in range(0, len(new), 20_000):
            some = at[new[i : i + 20_000]]
            n = stop[some] - start[some] + 1
            where = np.repeat(start[some] - 1 - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            marked = flat[where]
            marked[np.cumsum(n) - n] = _MARK
            rows.append(_logs(model.pieces, marked, n, model.p))
        both = np.concatenate([known.hashes, h[new]])
        order = np.argsort(both, kind="stable")
        known.hashes, known.rows = both[order], np.concatenate([known.rows, *rows])[order]
    row = known.rows[np.searchsorted(known.hashes, h)][each]
    return np.stack([np.bincount(doc, row[:, j], len(low)) for j in range(row.shape[1])], axis=1), letters


def _identify(held: Broadcast, min_gain: float, min_margin: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model: Model = held.value
    if model.key not in _memory:
        _memory.clear()
        _memory[model.key] = Known(model.p.shape[1])
    known = _memory[model.key]
    for batch in batches:
        scores, letters = score(model, batch.column("text").to_pylist(), known)
        k = len(model.languages)
        some = letters > 0
        per = scores / np.maximum(letters, 1)[:, None]
        best = per[:, :k].argmax(axis=1)
        top = per[np.arange(len(per)), best]
        rest = per[:, :k].copy()
        rest[np.arange(len(per)), best] = -np.inf
        margin = top - rest.max(axis=1) if k > 1 else np.full(len(per), np.inf)
        gain = top - per[:, k]
        ok = some & (gain > min_gain) & (margin >= min_margin)
        name = pa.array([model.languages[b] if s else None for b, s in zip(best, some, strict=True)], pa.string())
        nulls = ~some
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in batch.schema.names if c != "text"], name, pa.array(np.round(gain, 6), pa.float64(), mask=nulls), pa.array(np.round(margin, 6), pa.float64(), mask=nulls | np.isinf(margin)), pa.array(ok)],
            [*[c for c in batch.schema.names if c != "text"], "lang_id", "gain", "margin", "accepted"],
        )


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by label; the empty word counts the rows."""
    total: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            total[lang, ""] += 1
            total.update((lang, w) for w in words(text))
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array([*total.values()], pa.int64())], ["lang", "word", "n"])


def _sample_words(d: DataFrame, shares: dict[str, float], sample_rows: int, seed: int) -> pd.DataFrame:
    """(lang, word, n) of the ``sample_rows`` rows of each label that come first by hash of seed, id and text, among
    those whose hash is within the label's share."""
    # one row a label, as many as the model has columns
    share = F.broadcast(d.sparkSession.createDataFrame([*shares.items()], "lang string, share double"))
    drawn = d.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "text")).withColumn("cell", F.pmod("draw", F.lit(1 << 30))).join(share, "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("cell", "draw", "doc_id"))
    sample = drawn.where(F.col("cell") < F.col("share") * float(1 << 30)).withColumn("place", place).where(F.col("place") <= sample_rows).select("lang", "text")
    return sample.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()


def fit(docs: DataFrame, vocabulary_path: str | None = None, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, smoothing: float = SMOOTHING, seed: int = 11) -> Model | None:
    """Trains on ``docs`` (doc_id, text, lang; as many languages as there are labels), on ``sample_rows`` rows of each label, or all where it has fewer: those
    of least hash of seed, id and text, whatever ids are null or repeated. Rows with null text or label don't take part;
    None if there is no word to learn from."""
    common.small_batches(docs.sparkSession)
    d = common.pick(docs, "doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    if not sizes:
        return None
    # a share a little above the bound is drawn by hash first, so that only about that many rows are ordered; where
    # many equal rows, which have one hash, leave fewer than the bound, a larger share is drawn
    shares = {lang: min(1.0, (2 * sample_rows + 100) / n) for lang, n in sizes.items()}
    while True:
        found = _sample_words(d, shares, sample_rows, seed)
        rows = {lang: n for lang, word, n in zip(found["lang"], found["word"], found["n"], strict=True) if word == ""}
        few = [lang for lang, n in sizes.items() if shares[lang] < 1 and rows.get(lang, 0) < min(n, sample_rows)]
        if not few:
            break
        shares |= {lang: min(1.0, 16 * shares[lang]) for lang in few}
    found = found[found["word"] != ""]
    if not len(found):
        return None
    languages = sorted(found["lang"].unique())
    column = {name: i for i, name in enumerate(languages)}
    table: dict[str, list[float]] = {}
    for lang, word, n in zip(found["lang"], found["word"], found["n"], strict=True):
        table.setdefault(word, [0.0] * len(languages))[column[lang]] += n
    pieces = Pieces(vocabulary(vocabulary_path or f"{common.tokenizer_dir()}/piece_bpe_32k.model"))
    return Model(languages, pieces, train(pieces, sorted(table.items()), rounds, smoothing))


def identify(docs: DataFrame, model: Model | None, min_gain: float = 0.0, min_margin: float = 0.0) -> DataFrame:
    """(doc_id, lang_id, gain, margin, accepted) for every row: the likeliest language, by how much a letter it is
    likelier than the model without a language and than the next language (nats, 6 places), and whether both are above
    the bounds.

    A text without letters (null, empty, digits) has null language, gain and margin and isn't accepted; nothing is
    accepted without a model. Equal scores go to the first language of the alphabet. Repeated rows each give a row;
    an empty table gives an empty table; further columns are ignored.
    """
    return _run(common.pick(docs, "doc_id", "text"), model, min_gain, min_margin)


def _run(d: DataFrame, model: Model | None, min_gain: float, min_margin: float) -> DataFrame:
    rest = [c for c in d.columns if c != "text"]
    schema = T.StructType([*[d.schema[c] for c in rest], T.StructField("lang_id", T.StringType()), T.StructField("gain", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    if model is None:
        return d.select(*rest, F.lit(None).cast("string").alias("lang_id"), F.lit(None).cast("double").alias("gain"), F.lit(None).cast("double").alias("margin"), F.lit(False).alias("accepted"))
    common.small_batches(d.sparkSession)
    held = d.sparkSession.sparkContext.broadcast(model)
    return d.mapInArrow(partial(_identify, held, min_gain, min_margin), schema)


def _accept(held: Broadcast, text: str, min_gain: float, min_margin: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        verdict = next(_identify(held, min_gain, min_margin, iter([pa.RecordBatch.from_arrays([batch.column(text)], ["text"])])))
        yield batch.filter(verdict.column("accepted"))


def keep_identified(docs: DataFrame, vocabulary_path: str | None = None, min_gain: float = 0.0, min_margin: float = 0.0, **training: float) -> DataFrame:
    """The rows of ``docs`` whose language ``identify`` accepts, with all their columns, by a model fitted to their own
    labels; in one narrow stage, the text being sent once. Where no row has both a label and a word there is nothing
    to fit, so only texts without letters are rejected."""
    model = fit(docs, vocabulary_path, **training)
    box = common.Boxed(docs)
    if model is None:
        return box.open(box.df.where(F.col(box["text"]).rlike("\\p{L}")))
    held = docs.sparkSession.sparkContext.broadcast(model)
    return box.open(box.df.mapInArrow(partial(_accept, held, box["text"], min_gain, min_margin), box.df.schema))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return identify(docs, fit(docs))


QUERIES = {"op2_language": op2_language}
