"""Operator 8. Licence scans by a generalised suffix automaton of licence tokens.

All templates are put into one suffix automaton over their tokens. A document's tokens are streamed through it, which
gives the matching statistics: at each token the length of the longest run ending there that occurs in any template,
and where in which templates; the states up its suffix links have the shorter runs that other places of templates match.
Runs of ``min_run`` tokens or more, each as long as its own place in its own template allows, are chained, for each
template, into spans with rising template places; a span is reported if it covers enough of its template.

Scale: one narrow stage over Arrow batches. The automaton has fewer states than twice the templates' tokens, whatever
the corpus, and is broadcast once; a token that no template has costs one look-up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from docketry.llm import common, licence_texts

_TOKEN = re.compile(r"[^\W_]+")
#: Production bounds: tokens of a run, tokens between chained runs, least share of the template covered.
MIN_RUN, MAX_GAP, MIN_COVER = 4, 8, 0.7
#: Long templates may lack a line here and there: their runs may be so much of the template apart.
GAP_SHARE = 0.02


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Automaton:
    """A generalised suffix automaton with the end places of every state's strings."""

    def __init__(self, templates: Mapping[str, str]) -> None:
        self.names = list(templates)
        self.words: dict[str, int] = {}
        self.sizes: list[int] = []
        self.ids: list[list[int]] = []
        self._places: dict[tuple[int, int], tuple[list, list]] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for t, text in enumerate(templates.values()):
            last, ids = 0, [self.words.setdefault(w, len(self.words) + 1) for w in tokens(text)]
            self.sizes.append(len(ids))
            self.ids.append(ids)
            for place, c in enumerate(ids):
                last = self._extend(last, c, ends)
                ends[last].add((t, place))
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            ends[self.link[v]] |= ends[v]
        self.ends = [sorted(e) for e in ends]

    def _extend(self, last: int, c: int, ends: list) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c, ends)
        new = self._state(self.length[last] + 1, {}, ends)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c, ends)
        return new

    def _clone(self, p: int, q: int, c: int, ends: list) -> int:
        r = self._state(self.length[p] + 1, dict(self.next[q]), ends)
        self.link[r], self.link[q] = self.link[q], r
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = r
            p = self.link[p]
        return r

    def _state(self, length: int, arcs: dict[int, int], ends: list) -> int:
        self.next.append(arcs)
        self.link.append(0)
        self.length.append(length)
        ends.append(set())
        return len(self.link) - 1

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(length, state) of the longest run ending at each token that occurs in a template."""
        v = n = 0
        for c in ids:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            yield n, v

    def places(self, v: int, min_run: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
        """(template, place, token that follows) of the state's own strings, and (template, place, token that follows,
        length) of the places that only its suffixes of ``min_run`` tokens or more have; -1 follows a template's end."""
        got = self._places.get((v, min_run))
        if got is None:
            follows = lambda t, place: self.ids[t][place + 1] if place + 1 < self.sizes[t] else -1
            seen, short, u = set(self.ends[v]), [], self.link[v]
            while u > 0 and self.length[u] >= min_run:
                short += [(t, place, follows(t, place), self.length[u]) for t, place in self.ends[u] if (t, place) not in seen]
                seen.update(self.ends[u])
                u = self.link[u]
            got = self._places[v, min_run] = ([(t, place, follows(t, place)) for t, place in self.ends[v]], short)
        return got


class Span(NamedTuple):
    """Tokens start to end (exclusive) of a document, the runs' tokens in it and their share of the template."""

    licence: str
    start: int
    end: int
    matched: int
    cover: float


class Run(NamedTuple):
    """``length`` tokens up to ``end`` (exclusive) of a document that are those up to ``last`` (exclusive) of a template."""

    end: int
    last: int
    length: int


def _runs(a: Automaton, ids: np.ndarray, min_run: int) -> Iterator[tuple[int, Run]]:
    """(template, run) for each place of each template, where document and template can't be followed further, by end;
    only stretches of known tokens are streamed."""
    known = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]])))
    for lo, hi in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
        if hi - lo < min_run:
            continue
        some = ids[lo:hi].tolist()
        for i, (n, v) in enumerate(a.statistics(some), 1):
            if n < min_run:
                continue
            then = some[i] if i < len(some) else 0
            own, short = a.places(v, min_run)
            for t, place, follows in own:
                if follows != then:
                    yield t, Run(lo + i, place + 1, n)
            for t, place, follows, length in short:
                if follows != then:
                    yield t, Run(lo + i, place + 1, length)


def _chains(runs: list[Run], max_gap: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, matched) of one template's chains: each run after the chain that gives it most tokens, or alone if
    none gives more; a run belongs to the chain of most tokens that it is in."""
    score: list[int] = []
    back: list[int] = []
    for i, (end, last, n) in enumerate(runs):
        best, before, j = n, -1, i - 1
        while j >= 0 and runs[j].end >= end - n - max_gap:
            # overlapping runs count their new tokens only
            new = min(n, end - runs[j].end, last - runs[j].last)
            if new > 0 and last - n - runs[j].last <= max_gap and score[j] + new > best:
                best, before = score[j] + new, j
            j -= 1
        score.append(best)
        back.append(before)
    used = [False] * len(runs)
    for i in sorted(range(len(runs)), key=score.__getitem__, reverse=True):
        if used[i]:
            continue
        used[i], first = True, i
        while back[first] >= 0 and not used[back[first]]:
            first = back[first]
            used[first] = True
        yield runs[first].end - runs[first].length, runs[i].end, score[i] - score[first] + runs[first].length


def spans(a: Automaton, text: str | None, min_run: int = MIN_RUN, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> list[Span]:
    """Covered spans of each template, by start, then template. Null and empty texts have none.

    A run joins a chain of its template whose last run ends at most ``max_gap`` tokens, or GAP_SHARE of the template
    where that is more, before it in the document and in the template, the one with which most tokens are matched.
    Where templates share a run each has its chain, a template within a longer one too; of spans of one place only those
    that no other span of more tokens contains are returned.
    """
    if not text:
        return []
    get = a.words.get
    ids = np.fromiter((get(w, 0) for w in tokens(text)), np.int64)
    runs: dict[int, list[Run]] = {}
    for t, run in _runs(a, ids, min_run):
        runs.setdefault(t, []).append(run)
    found = [Span(a.names[t], start, end, n, round(n / a.sizes[t], 6)) for t, all_of in runs.items() for start, end, n in _chains(all_of, max(max_gap, int(GAP_SHARE * a.sizes[t]))) if n >= min_cover * a.sizes[t]]
    # a span that contains another and has more comes before it
    found.sort(key=lambda s: (s.start, -s.matched, -s.cover, s.licence))
    kept: list[Span] = []
    reach: list[Span] = []
    for s in found:
        reach = [o for o in reach if o.end > s.start]
        if not any(s.end <= o.end and (o.matched, o.cover, s.licence) > (s.matched, s.cover, o.licence) for o in reach):
            kept.append(s)
            reach.append(s)
    return kept


def _scan(held: Broadcast, min_run: int, max_gap: int, min_cover: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a: Automaton = held.value
    for batch in batches:
        at: list[int] = []
        rows: list[Span] = []
        for i, text in enumerate(batch.column("text").to_pylist()):
            got = spans(a, text, min_run, max_gap, min_cover)
            at += [i] * len(got)
            rows += got
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *columns], ["doc_id", "licence", "start_token", "end_token", "matched_tokens", "cover"])


def licence_spans(docs: DataFrame, templates: Mapping[str, str] | None = None, min_run: int = MIN_RUN, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> DataFrame:
    """(doc_id, licence, start_token, end_token, matched_tokens, cover): a row for each covered span of each row of
    ``docs`` (doc_id, text). ``templates`` are texts by name, those of ``licence_texts`` unless given. Tokens are runs of letters and digits, lower case. Null, empty and unlicensed texts give
    no row; repeated rows each give theirs; an empty table gives an empty table; further columns are ignored."""
    common.small_batches(docs.sparkSession)
    d = common.pick(docs, "doc_id", "text")
    schema = T.StructType([d.schema["doc_id"], T.StructField("licence", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("start_token", "end_token", "matched_tokens")], T.StructField("cover", T.DoubleType())])
    held = d.sparkSession.sparkContext.broadcast(Automaton(licence_texts.templates() if templates is None else templates))
    return d.mapInArrow(partial(_scan, held, min_run, max_gap, min_cover), schema)


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_spans(common.documents(spark, sf_dir))


QUERIES = {"op8_licences": op8_licences}
