"""Operator 4. Exact token counts of every prefix, by dynamic programming over prefixes.

A byte-level BPE text is first cut by a fixed pattern, then each piece is merged on its own. Within a piece the last
token of every prefix is unique: of the vocabulary's tokens that end there, the one that stays apart from the last
token of the prefix before it when both are encoded together. So one pass from left to right, over byte places, gives
each prefix's count as one more than that of the prefix before its last token; no prefix is encoded by itself. White
space is the one place where a prefix is cut otherwise than the text: a run of it at the end is a single piece.

Stored for each document: its count, and the change of the count at every code point, one signed byte each, or more by
escape; their running sum is the exact count of every prefix. Truncation and budgets are answered from these alone.

Scale: one narrow stage over Arrow batches, no shuffle; a worker keeps the changes of short pieces that it has met, in
two generations, so that those in use stay when the oldest go.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache, partial
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm import common

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Contexts that the production query answers for.
BUDGETS = (512, 2048)


def _classes(pattern: str, last: int) -> str:
    """The pattern for the standard library, for texts of code points up to ``last``: its letters and numbers spelled
    out, as ``regex`` knows them."""
    every = "".join(chr(i) for i in range(last + 1) if not 0xD800 <= i < 0xE000)
    for name in (r"\p{L}", r"\p{N}"):
        runs = "".join(f"{m[0]}-{m[-1]}" if len(m) > 1 else m for m in regex.findall(name + "+", every))
        pattern = re.sub(rf"(?<!\}}){re.escape(name)}\+", lambda _, r=runs: f"[{r}]+", pattern).replace(name, runs)
    return pattern


_END, _REST = r"'s|'t|'re|'ve|'m|'ll|'d", r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
_PIECE = regex.compile(PATTERN)
#: A piece, or a whole run of white space with the piece after it: what changes of the count depend on.
_UNIT_PATTERN = rf"{_END}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s*[^\S ](?!\s)(?:{_END}|{_REST})?|\s* (?!\s)(?:{_REST})?"


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@cache
def _unit(last: int) -> re.Pattern:
    return re.compile(_classes(_UNIT_PATTERN, last))


def units(text: str) -> list[str]:
    """The text cut at the places that its count of tokens can be cut at."""
    return _unit(0x10FFFF if _ASTRAL.search(text) else 0xFFFF).findall(text)


#: Pieces of a generation, and the longest that are kept: together they bound a worker's memory.
_KNOWN, _SHORT = 200_000, 32


class Encoding:
    """A byte-level BPE vocabulary in rank order, the single bytes first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        #: the two tokens that each token was merged from, twice itself for single bytes; none where its own bytes
        #: give other tokens, so that it never occurs
        self.left, self.right = [*range(len(ranks))], [*range(len(ranks))]
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        self.tokens = dict(ranks)
        for t, r in ranks.items():
            if len(t) > 1:
                parts = self.merge(t, r)
                if len(parts) == 2:
                    self.left[r], self.right[r] = ranks[parts[0]], ranks[parts[1]]
                else:
                    del self.tokens[t]
        self.merged = {(self.left[r], self.right[r]): r for t, r in self.tokens.items() if len(t) > 1}
        self._apart: dict[int, bool] = {}
        #: at each place of a piece, the tokens that end there; bytes stand as the first 256 code points
        self.lengths, self.suffixes = [0] * len(ranks), ahocorasick.Automaton()
        for t, r in self.tokens.items():
            self.lengths[r] = len(t)
            self.suffixes.add_word(t.decode("latin-1"), r)
        self.suffixes.make_automaton()

    def merge(self, piece: bytes, below: int = 1 << 60) -> list[bytes]:
        """The piece's tokens by the definition: the pair of least rank is merged until none has one (below a rank)."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b, next to each other, stay as they are: their merges are undone from the last, and no
        pair across the seam may have come before the merge that is undone."""
        merged, left, right, limit = self.merged, self.left, self.right, 1 << 60
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Tokens of each prefix of a piece, of 0 bytes, 1 byte, and so on."""
        count, last, lengths, known, done = [0], [0], self.lengths, self._apart, -1
        if len(known) > 2_000_000:
            known.clear()
        for end, t in self.suffixes.iter(piece.decode("latin-1")):
            if end == done:
                continue
            i = end + 1 - lengths[t]
            if i:
                pair = last[i] << 32 | t
                ok = known.get(pair)
                if ok is None:
                    ok = known[pair] = self.apart(last[i], t)
                if not ok:
                    continue
            count.append(count[i] + 1)
            last.append(t)
            done = end
        return count


class Met(dict):
    """Changes of units by unit: a missing one is taken from the generation before, or computed."""

    def __init__(self, e: Encoding) -> None:
        self.e, self.before = e, {}

    def __missing__(self, unit: str) -> bytes:
        if len(unit) > _SHORT:
            return _unit_changes(self.e, unit)
        got = self.before.get(unit)
        if got is None:
            got = _unit_changes(self.e, unit)
        if len(self) >= _KNOWN:
            self.before = dict(self)
            self.clear()
        self[unit] = got
        return got


_encodings: dict[str, tuple[Encoding, Met]] = {}


def encoding(path: str) -> Encoding:
    return _loaded(path)[0]


def _loaded(path: str) -> tuple[Encoding, Met]:
    if path not in _encodings:
        with open(path, "rb") as f:
            e = Encoding({base64.b64decode(a): int(b) for a, b in (line.split() for line in f)})
        _encodings[path] = e, Met(e)
    return _encodings[path]


def _pack(counts: list[int]) -> bytes:
    """Changes between counts as signed bytes; -128 announces one of four bytes."""
    try:
        return bytes([b - a & 255 if -128 < b - a < 128 else 1 << 9 for a, b in pairwise(counts)])
    except ValueError:
        return b"".join((b - a & 255).to_bytes(1) if -128 < b - a < 128 else b"\x80" + (b - a).to_bytes(4, "little", signed=True) for a, b in pairwise(counts))


def prefix_counts(packed: bytes) -> np.ndarray:
    """Tokens of every prefix, of 0 code points first, from the stored changes."""
    raw = np.frombuffer(packed, np.int8)
    if not (raw == -128).any():
        return np.concatenate([[0], np.cumsum(raw, dtype=np.int64)])
    out, i = [0], 0
    while i < len(packed):
        wide = packed[i] == 0x80
        out.append(out[-1] + int.from_bytes(packed[i + wide : i + 1 + 4 * wide], "little", signed=True))
        i += 1 + 4 * wide
    return np.array(out, np.int64)


def _at_chars(e: Encoding, piece: str) -> list[int]:
    raw = piece.encode("utf-8", "surrogatepass")
    counts = e.prefix_counts(raw)
    if len(raw) == len(piece):
        return counts
    return [counts[0], *[counts[i] for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]]


def _piece_counts(e: Encoding, piece: str) -> list[int]:
    counts = _at_chars(e, piece)
    if piece in ("'re", "'ve", "'ll"):  # of its first two letters the pattern makes two pieces
        counts[2] = counts[1] + _at_chars(e, piece[1])[1]
    return counts


def _unit_changes(e: Encoding, unit: str) -> bytes:
    run = unit[: len(unit) - len(unit.lstrip())] if unit[0].isspace() else ""
    if len(run) < 2 and (run in ("", " ") or run == unit):
        counts = _piece_counts(e, unit)
    else:
        # within the run, and at its end, a prefix has it as one piece; beyond, as many as the text has
        *inner, last = _PIECE.findall(unit)
        counts = _at_chars(e, run)
        if not last.isspace():
            base = sum(_at_chars(e, p)[-1] for p in inner)
            counts += [base + c for c in _piece_counts(e, last)[1 + (last[0] == " ") :]]
    return _pack(counts)


def changes(path: str, text: str) -> bytes:
    """The change of the token count at every code point of ``text``, packed."""
    return b"".join(map(_loaded(path)[1].__getitem__, units(text)))


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of no more than ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def _count(path: str, budgets: tuple[int, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [None if t is None else changes(path, t) for t in batch.column("text").to_pylist()]
        n, fits = [], []
        for p in packed:
            c = None if p is None else prefix_counts(p)
            n.append(None if c is None else int(c[-1]))
            fits.append(None if c is None else [longest_within(c, b) for b in budgets])
        columns = [pa.array([None if f is None else f[i] for f in fits], pa.int32()) for i in range(len(budgets))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int32()), *columns, pa.array(packed, pa.binary())], ["doc_id", "n_tokens", *[f"fits_{b}" for b in budgets], "prefix_changes"])


def token_counts(docs: DataFrame, vocabulary_path: str | None = None, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """(doc_id, n_tokens, fits_<budget> for each budget, prefix_changes) for every row of ``docs`` (doc_id, text).

    ``fits_b`` is the length in code points of the longest prefix of at most b tokens; ``prefix_changes`` holds the
    exact count of every prefix (see ``prefix_counts``). A null text has nulls; an empty one has 0 tokens and no
    changes. Repeated rows each give a row; an empty table gives an empty table; further columns are ignored.
    ``vocabulary_path`` names the ranks of a byte-level BPE that cuts texts by PATTERN, as both of the public ones do.
    """
    common.small_batches(docs.sparkSession)
    d = common.pick(docs, "doc_id", "text")
    whole = T.IntegerType()
    schema = T.StructType([d.schema["doc_id"], T.StructField("n_tokens", whole), *[T.StructField(f"fits_{b}", whole) for b in budgets], T.StructField("prefix_changes", T.BinaryType())])
    return d.mapInArrow(partial(_count, vocabulary_path or f"{common.tokenizer_dir()}/byte_bpe_50k.tiktoken", tuple(budgets)), schema)


def tokens_of_prefix(counted: DataFrame, chars: int) -> DataFrame:
    """(doc_id, tokens) of the first ``chars`` code points of each counted text, of all of a shorter one; from the
    stored changes, without the text. Null where the text was null."""
    return _ask(counted, lambda c: int(c[min(max(chars, 0), len(c) - 1)]), "tokens")


def longest_prefix(counted: DataFrame, budget: int) -> DataFrame:
    """(doc_id, chars): code points of the longest prefix of at most ``budget`` tokens, from the stored changes."""
    return _ask(counted, lambda c: longest_within(c, budget), "chars")


def _ask(counted: DataFrame, question, name: str) -> DataFrame:
    @F.pandas_udf(T.LongType())
    def answer(packed):
        return packed.map(lambda p: None if p is None else question(prefix_counts(bytes(p))))

    d = common.pick(counted, "doc_id", "prefix_changes")
    return d.select("doc_id", answer("prefix_changes").alias(name))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.documents(spark, sf_dir))


QUERIES = {"op4_token_counts": op4_token_counts}
