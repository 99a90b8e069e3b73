"""Operator 3. Near-duplicate removal by DartMinHash signatures and a banded join.

A document is a weighted set: its elements are pairs of adjacent words, weighted by their count. Words are runs of
letters, marks and digits of any script, lower case; in scripts written without blanks each sign is a word. Every element has a half-plane of weight and rank in which darts are thrown by hashing, one on average
for each unit of area, the same for every document. A document keeps the darts in its own region, under its elements'
weights and below a rank that lets about k ln k + 2k darts through; each dart belongs to one of k coordinates, and the
earliest of each coordinate, by rank, is the signature's entry. Two signatures agree in a coordinate with probability
equal to the weighted Jaccard similarity. See Christiani, "DartMinHash: Fast Sketching for Weighted Sets" (2020).

Signatures are cut into bands; documents that agree in a whole band meet. Within such a bucket everyone is compared
with the least, and whoever isn't similar to that with everyone else, but those whose similarity to the least differs
so much that the triangle inequality keeps them apart, so the groups are those of comparing all pairs; similarity is
the share of equal coordinates. Similar documents are joined into groups as connected components.

Scale: throwing darts is one narrow stage. Equal signatures are collapsed first (with partial sums), so thousands of
copies meet as one row. The banded join moves a hash and a number for each band; signatures follow only for pairs that
met; the least of a bucket is a partial minimum, and bands that one document has are dropped before anything is joined.
Components take a number of rounds that grows with the logarithm of a component's width.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, partial
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm import common

COORDINATES, BANDS, THRESHOLD, SHINGLE = 128, 32, 0.6, 2
_U = np.uint64
_BYTES_AT_ONCE = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Scripts written without blanks: Thai, Lao, Myanmar, Khmer, kana and ideographs.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x1B000, 0x1B16F), (0x20000, 0x323AF))
_BYTE_MIX = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if not _POWERS or len(_POWERS[0][0]) < n:
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, _U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[0] = both[0], both[1]
    return _POWERS[0]


@cache
def _kinds() -> np.ndarray:
    """Of every code point: 0 between words, 1 part of a word, 2 a word of its own."""
    kinds = np.fromiter((unicodedata.category(chr(i))[0] in "LMN" for i in range(sys.maxunicode + 1)), np.int8, sys.maxunicode + 1)
    for a, b in _UNSPACED:
        kinds[a : b + 1] *= 2
    return kinds


def _beyond_ascii(data: np.ndarray, word: np.ndarray, edge: np.ndarray) -> None:
    """Marks the bytes of words in ``word`` and the bounds of words of one sign in ``edge``, for signs of several bytes."""
    at = np.flatnonzero(data >= 0xC0)
    if not len(at):
        return
    lead = data[at].astype(np.int64)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    code = lead & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
    for i in range(1, 4):
        code = np.where(size > i, code << 6 | data[np.minimum(at + i, len(data) - 1)] & 0x3F, code)
    kind = _kinds()[np.minimum(code, sys.maxunicode)]
    for i in range(4):
        word[at[(kind > 0) & (size > i)] + i] = True
    own = kind == 2
    edge[at[own]] = True
    edge[at[own] + size[own]] = True


def elements(data: np.ndarray, ends: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of documents laid end to end in ``data``: (document, 64-bit hash, count), by document.

    ``ends``: where each document ends. A document of fewer words than ``shingle`` has one element, all its words.
    """
    word = _WORD_BYTE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends[:-1]] = True
    _beyond_ascii(data, word, edge)
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    start = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate([word[1:], [False]]) if len(word) else word
    stop = np.flatnonzero(word & (~after | edge[1:])) + 1
    power, inverse = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE_MIX[data] * power[: len(data)], dtype=_U)])
    h = mix64((total[stop] - total[start]) * inverse[start] + (stop - start).astype(_U))
    doc = np.searchsorted(ends, start, "right")
    n = np.bincount(doc, minlength=len(ends))
    few = (n > 0) & (n < shingle)
    last = len(h) - shingle + 1
    if last > 0:
        s = np.zeros(last, _U)
        for i in range(shingle):
            s = mix64(s * _U(3) + h[i : i + last])
        same = doc[:last] == doc[shingle - 1 :]
        doc1, h1 = doc[:last][same], s[same]
    else:
        doc1, h1 = doc[:0], h[:0]
    if few.any():
        short = np.flatnonzero(few[doc])
        acc = {}
        for i in short:
            acc[doc[i]] = mix64(np.array([acc.get(doc[i], _U(7)) * _U(5) + h[i]], _U))[0]
        doc1, h1 = np.concatenate([doc1, np.array([*acc], doc.dtype)]), np.concatenate([h1, np.array([*acc.values()], _U)])
    order = np.lexsort((h1, doc1))
    doc1, h1 = doc1[order], h1[order]
    new = np.flatnonzero(np.concatenate([[True], (doc1[1:] != doc1[:-1]) | (h1[1:] != h1[:-1])])) if len(doc1) else np.zeros(0, int)
    return doc1[new], h1[new], np.diff(np.append(new, len(doc1)))


#: A cell of area 1 holds so many darts by 16 bits of its hash: the distribution of Poisson with mean 1.
_POISSON = np.searchsorted(np.cumsum([np.exp(-1) / np.prod(np.arange(1, i + 1, dtype=float)) for i in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.int8)


def darts(docs: int, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Signatures (docs x k) of weighted sets given as (document, element, weight > 0) without repetition; documents
    with no element have 0 in all coordinates. Weights may be any positive numbers."""
    best = np.full(docs * k, np.iinfo(np.uint64).max, _U)
    sums = np.bincount(doc, weight, docs)
    todo, t = np.flatnonzero(sums > 0), k * log(k) + 2 * k
    while len(todo):
        reach = np.zeros(docs)
        reach[todo] = t / sums[todo]
        on = reach[doc] > 0
        d, e, w = doc[on], element[on], weight[on].astype(np.float64)
        # unit cells along the weight, then along the rank; cut in pieces of bounded memory
        up = np.ceil(w).astype(np.int64)
        across = np.ceil(reach[d]).astype(np.int64)
        for lo, hi in _slices(up * across):
            _throw(best, d[lo:hi], e[lo:hi], w[lo:hi], up[lo:hi], across[lo:hi], reach, k)
        table = best.reshape(docs, k)[todo]
        todo, t = todo[(table == np.iinfo(np.uint64).max).any(axis=1)], 2 * t
    sig = (best & _U(0xFFFFFFFF)).astype(np.uint32).reshape(docs, k)
    sig[sums <= 0] = 0
    return sig


def _slices(cells: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    part = (np.cumsum(cells) - 1) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), len(cells)]
    return ((a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def _throw(best: np.ndarray, d: np.ndarray, e: np.ndarray, w: np.ndarray, up: np.ndarray, across: np.ndarray, reach: np.ndarray, k: int) -> None:
    cells = up * across
    which = np.repeat(np.arange(len(d), dtype=np.int32), cells)
    at = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
    wide = int(across.max())
    row, col = np.divmod(at, across[which]) if wide > 1 else (at, np.zeros(len(at), np.int64))
    cell = mix64(e[which] + row.astype(_U) * _U(0xD1342543DE82EF95) + mix64(np.arange(1, wide + 1, dtype=_U))[col])
    count = _POISSON[(cell >> _U(48)).astype(np.int64)]
    hit = np.repeat(np.arange(len(cell), dtype=np.int32), count)
    nth = np.arange(len(hit)) - np.repeat(np.cumsum(count, dtype=np.int64) - count, count)
    dart = mix64(cell[hit] + (nth.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
    src = which[hit]
    doc = d[src]
    # bits of a dart: 7 or more low ones the coordinate, 32 above bit 8 its identity, 24 high ones its rank in the cell
    rank = (col[hit] + (dart >> _U(40)) * 2.0**-24).astype(np.float32)
    ok = rank < reach[doc]
    if (w != up).any():
        ok &= row[hit] + _uniform(mix64(dart + _U(2))) < w[src]
    doc, dart, rank = doc[ok], dart[ok], rank[ok]
    packed = (rank.view(np.uint32).astype(_U) << _U(32)) | ((dart >> _U(8)) & _U(0xFFFFFFFF))
    np.minimum.at(best, doc * k + (dart % _U(k)).astype(np.int64), packed)


def signatures(texts: pa.StringArray, k: int, shingle: int) -> np.ndarray:
    """Signatures of a batch of texts (lower case already), null or wordless ones all 0."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    out = np.zeros((len(texts), k), np.uint32)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _BYTES_AT_ONCE, "right")) - 1)
        doc, h, n = elements(data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a], shingle)
        out[a:b] = darts(b - a, doc, h, n, k)
        a = b
    return out


def _sign(k: int, bands: int, shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # the coordinates of a band side by side
    order = np.arange(k).reshape(k // bands, bands).T.ravel()
    for batch in batches:
        full = signatures(batch.column("text").cast(pa.string()), k, shingle)
        at = np.flatnonzero(full.any(axis=1))
        full = full[at].astype(_U)
        whole = np.zeros((len(at), 2), _U)
        for c in range(k):
            whole = mix64(whole * _U(5) + full[:, c : c + 1] + np.array([[1, 2]], _U))
        short = (full[:, order] & _U(0xFFFF)).astype(np.uint16)
        columns = [batch.column("rid").take(pa.array(at)), pa.array(whole[:, 0].view(np.int64)), pa.array(whole[:, 1].view(np.int64)), pa.array([x.tobytes() for x in short], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["rid", "h1", "h2", "sig"])


def _compare(threshold: float, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, k) for c in ("sa", "sb"))
        share = (a == b).mean(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share), pa.array(share >= threshold)], ["a", "b", "similarity", "near"])


def _compared(pairs: DataFrame, groups: DataFrame, threshold: float, k: int) -> DataFrame:
    """(a, b, similarity, near) for pairs (a, b) of groups: the share of coordinates in which their signatures agree."""
    side = lambda c: groups.select(F.col("gid").alias(c), F.col("sig").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(partial(_compare, threshold, k), "a bigint, b bigint, similarity double, near boolean")


def row_key(doc_id: str, text: str) -> F.Column:
    """What a row is known by: its id, nulls last, and a hash of its text for rows of equal ids."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("tie"))


def signed(docs: DataFrame, coordinates: int = COORDINATES, bands: int = BANDS, shingle: int = SHINGLE) -> DataFrame:
    """(rid, h1, h2, sig) of every row of ``docs`` that has a word: its key, two hashes of the whole signature, and the
    signature, 16 bits a coordinate, band by band."""
    if coordinates % bands:
        raise ValueError("bands must divide coordinates")
    common.small_batches(docs.sparkSession)
    d = common.pick(docs, "doc_id", "text").select(row_key("doc_id", "text").alias("rid"), F.lower("text").alias("text")).where("text IS NOT NULL")
    whole = T.LongType()
    schema = T.StructType([d.schema["rid"], T.StructField("h1", whole), T.StructField("h2", whole), T.StructField("sig", T.BinaryType())])
    return d.mapInArrow(partial(_sign, coordinates, bands, shingle), schema)


def grouped(sigs: DataFrame) -> DataFrame:
    """(gid, h1, h2, n, root, sig): one row a signature, with a number, how many rows have it and the least of them."""
    groups = sigs.groupBy("h1", "h2").agg(F.min(F.struct("rid", "sig")).alias("first"), F.count(F.lit(1)).alias("n"))
    return common.materialise(groups.select(F.monotonically_increasing_id().alias("gid"), "h1", "h2", "n", F.col("first.rid").alias("root"), F.col("first.sig").alias("sig")), "near-groups")[0]


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every node of ``edges`` (u, v) but the roots: the least node of its connected component.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)
    until nothing changes; each is a partial minimum and a join, written to the shared folder. Self-edges count for
    nothing; an empty table gives an empty table."""
    flat = edges.where("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("root")).distinct()
    now, path = common.materialise(flat, "components")
    seen = None
    while True:
        both = now.union(now.select("root", "v"))
        least = both.groupBy("v").agg(F.min("root").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("root > v").select(F.col("root").alias("v"), F.col("m").alias("root")).where("v <> root").distinct()
        down = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(down, "v").where("root <> m").select(F.col("root").alias("v"), F.col("m").alias("root"))
        table, new = common.materialise(small.union(down.select("v", F.col("m").alias("root"))).distinct(), "components")
        state = tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first())
        common.drop(path)
        if state == seen or state[0] == 0:
            return table
        now, path, seen = table, new, state


def similar(groups: DataFrame, threshold: float = THRESHOLD, coordinates: int = COORDINATES, bands: int = BANDS) -> DataFrame:
    """(a, b, similarity) for numbers of ``grouped`` rows, in part through the least of a bucket: it is compared with
    all of its bucket, and whoever isn't similar to it with all of them too. Reads tables that it writes to the shared
    folder; they are scratch."""
    width = 2 * (coordinates // bands)
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * width + 1, F.lit(width))))
    members = groups.select("gid", F.explode(band).alias("band"))
    least = members.groupBy("band").agg(F.min("gid").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "a")
    met = members.join(least.hint("merge"), "band").where("a <> gid").select("band", "a", F.col("gid").alias("b"))
    met, _ = common.materialise(met, "near-met")
    first, _ = common.materialise(_compared(met.select("a", "b").distinct(), groups, threshold, coordinates), "near-first")
    # who of a bucket isn't similar to its least, and all others of such buckets
    far = met.join(first.where("NOT near"), ["a", "b"]).select("band", F.col("b").alias("x"), F.col("similarity").alias("of_x"))
    far, _ = common.materialise(far, "near-far")
    others = met.join(far.select("band").distinct(), "band", "left_semi").join(first, ["a", "b"]).select("band", F.col("b").alias("y"), F.col("similarity").alias("of_y"))
    # shares of unequal coordinates are a metric: x and y can't be similar if theirs to the least differ by more
    close = F.abs(F.col("of_x") - F.col("of_y")) <= 1 - threshold + 1e-9
    rest = far.join(others, "band").where((F.col("x") != F.col("y")) & close).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    second = _compared(rest, groups, threshold, coordinates)
    return first.where("near").select("a", "b", "similarity").union(second.where("near").select("a", "b", "similarity"))


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, coordinates: int = COORDINATES, bands: int = BANDS, shingle: int = SHINGLE, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` (needs doc_id and text) with one document of each group of near duplicates: the least
    doc_id, nulls last, then the least hash of the text.

    All columns are returned. Two documents are near if their signatures agree in ``threshold`` of the coordinates;
    groups are connected components. Rows equal in id and text are one document, of which one row stays. Null, empty
    and wordless texts have no elements, are near to nothing and stay. An empty table gives an empty table.
    """
    with common.scratch():
        sigs, _ = common.materialise(signed(docs, coordinates, bands, shingle), "near-signatures")
        groups = grouped(sigs)
        with common.scratch():
            roots = components(similar(groups, threshold, coordinates, bands).select(F.col("a").alias("u"), F.col("b").alias("v")))
            # the least document of each component, among the least of each signature in it
            inside = roots.union(roots.select(F.col("root").alias("v"), "root").distinct())
            inside = inside.join(groups.select(F.col("gid").alias("v"), F.col("root").alias("rid")), "v").select("root", "rid")
            stays = inside.groupBy("root").agg(F.min("rid").alias("rid"))
            worse = common.keep(inside.join(stays, ["root", "rid"], "left_anti").select("rid"), "near-worse")
        copies, _ = common.materialise(sigs.select("rid", "h1", "h2").join(groups.where("n > 1").select("h1", "h2", "root"), ["h1", "h2"]).select("rid", "root"), "near-copies")
        lost = common.keep(copies.where("rid <> root").select("rid").union(worse).distinct(), "near-lost")
        again = common.keep(copies.groupBy("rid").count().where("count > 1").select("rid").join(lost, "rid", "left_anti"), "near-again")
    box = common.Boxed(docs)
    d = box.df.withColumn("rid", row_key(box["doc_id"], box["text"]))
    kept = d.join(common.sized(lost, broadcast_bytes), "rid", "left_anti")
    if not again.isEmpty():
        twice = common.sized(again, broadcast_bytes)
        kept = kept.join(twice, "rid", "left_anti").union(kept.join(twice, "rid", "left_semi").dropDuplicates(["rid"]))
    return box.open(kept)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(common.documents(spark, sf_dir))


QUERIES = {"op3_near_dedup": op3_near_dedup}
