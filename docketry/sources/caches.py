"""The content-addressed cache of documents: texts, bytes, sidecars, page archives."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry import ship
from docketry.functions import rules
from docketry.sources import logs


def _stem(path: Column, suffix: str) -> Column:
    return F.regexp_extract(path, f"([^/]*){suffix}$", 1)


def _names(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Paths only: the content column is pruned, no file is opened."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root).select("path")


def texts(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """(sha1, n_chars, has_elements, text, cache_path) of every cached text; with ``wanted`` (sha1) of those only.
    Files are decompressed by their ending; bytes that aren't UTF-8 become replacement signs."""
    rows = spark.read.option("pathGlobFilter", "*.txt.gz").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("cache_path"), F.col("value").alias("text"))
    rows = rows.withColumn("sha1", _stem(F.col("cache_path"), "\\.txt\\.gz"))
    if wanted is not None:
        rows = rows.join(wanted.select("sha1").distinct(), "sha1", "left_semi")
    marked = _names(spark, root, "*.elements.json.gz").select(_stem(F.col("path"), "\\.elements\\.json\\.gz").alias("sha1"), F.lit(True).alias("e"))
    return rows.join(marked, "sha1", "left").select("sha1", F.length("text").alias("n_chars"), F.coalesce("e", F.lit(False)).alias("has_elements"), "text", "cache_path")


def extractors(spark: SparkSession, root: str) -> DataFrame:
    """(sha1, extractor): the sidecar's trimmed text, null if it is empty."""
    rows = spark.read.option("pathGlobFilter", "*.extractor").text(root, wholetext=True)
    return rows.select(_stem(F.col("_metadata.file_path"), "\\.extractor").alias("sha1"), F.nullif(F.regexp_replace("value", "^\\s+|\\s+$", ""), F.lit("")).alias("extractor"))


def dismissals(spark: SparkSession, root: str) -> DataFrame:
    """(sha1, dismissed_at, reason); malformed sidecars are left out."""
    rows = spark.read.option("pathGlobFilter", "*.dismissed.json").text(root, wholetext=True).where(F.try_parse_json("value").isNotNull())
    return rows.withColumn("d", F.from_json("value", "dismissed_at string, reason string")).select(_stem(F.col("_metadata.file_path"), "\\.dismissed\\.json").alias("sha1"), "d.dismissed_at", "d.reason")


def on_disk(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(sha1) of the files of a kind, ``pdf`` or ``txt``, by listing."""
    return _names(spark, root, f"*.{kind}.gz").select(_stem(F.col("path"), f"\\.{kind}\\.gz").alias("sha1"))


def resolve(rows: DataFrame, cached: DataFrame, sidecars: DataFrame, prefix: str, sha1: str) -> DataFrame:
    """Puts the cache's text in ``<prefix>text`` where it has one, and the sidecar's extractor in ``<prefix>extractor``
    where there is a sidecar, even an empty one; else what the file said stays."""
    text, extractor = f"{prefix}text", f"{prefix}extractor"
    a = cached.select(F.col("sha1").alias(sha1), F.col("text").alias("_text"))
    b = sidecars.select(F.col("sha1").alias(sha1), F.col("extractor").alias("_extractor"), F.lit(True).alias("_hit"))
    joined = rows.join(a, sha1, "left").join(b, sha1, "left")
    return joined.withColumns({text: F.coalesce("_text", text), extractor: F.when(F.col("_hit"), F.col("_extractor")).otherwise(F.col(extractor))}).select(*rows.columns)


@F.pandas_udf(T.BinaryType())
def _gunzip_head(content: pd.Series) -> pd.Series:
    def head(b: bytes) -> bytes | None:
        try:
            with gzip.open(io.BytesIO(b)) as f:
                first = f.read(1024)
                last = first
                while chunk := f.read(1 << 20):
                    last = (last + chunk)[-1024:]
                return first[:16] + b"\0" + last[-32:]
        except (OSError, EOFError):
            return None

    return content.map(head)


def integrity(spark: SparkSession, root: str) -> DataFrame:
    """(sha1, state) of cached bytes: ok, truncated (a PDF without its end mark), bad_magic, empty or gzip_error."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,rtf}.gz").load(root)
    rows = rows.select(F.regexp_extract("path", "([^/.]*)\\.(pdf|rtf)\\.gz$", 1).alias("sha1"), "length", _gunzip_head("content").alias("h"))
    kind = rules.sniff(F.col("h"))
    tail = F.decode(F.substring(F.col("h"), 1, 1 << 20), "ISO-8859-1")
    state = F.when(F.col("h").isNull(), "gzip_error").when(F.length("h") <= 1, "empty").when(~kind.isin("pdf", "rtf"), "bad_magic").when((kind == "pdf") & ~tail.contains("%%EOF"), "truncated").otherwise("ok")
    return rows.select("sha1", state.alias("state"))


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                rows += [(path, m.name, tar.extractfile(m).read().decode("utf-8", "replace")) for m in tar if m.isfile()]
        yield pd.DataFrame(rows, columns=["path", "tab", "html"])


def html_archives(spark: SparkSession, root: str) -> DataFrame:
    """(path, tab, html) of every page within the .tar.gz archives under ``root``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(root).select("path", "content").mapInPandas(_members, "path string, tab string, html string")


_MANIFEST = "sha1 string, stratum string, doc_type string, n_pages int, gold_corrected boolean"
_RESULT = "sha1 string, provider string, n_pages int, wall_seconds double, dollars double"


def ocr_files(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """What a comparison of extractors left under ``root``: ``manifest`` and ``results`` (with their line's place; no
    results without a file), ``texts`` (sha1, provider, text) by the names <sha1>.<provider>.txt, and ``gold`` (sha1,
    text), the corrected ones. Malformed lines raise."""
    exists = lambda p: (at := spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{p}")).getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    lines = lambda name, schema: logs.read_jsonl(spark, f"{root}/{name}.jsonl", schema)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), "\\.txt$", "")

    def bodies(folder: str) -> DataFrame:
        if not exists(folder):
            return spark.createDataFrame([], "name string, text string")
        return spark.read.option("pathGlobFilter", "*.txt").text(f"{root}/{folder}", wholetext=True).select(name.alias("name"), F.col("value").alias("text"))

    texts = bodies("texts").where(F.col("name").contains(".")).select(F.substring_index("name", ".", 1).alias("sha1"), F.substring_index("name", ".", -1).alias("provider"), "text")
    empty = spark.createDataFrame([], _RESULT + ", file string, line bigint")
    return {"manifest": lines("manifest", _MANIFEST), "results": lines("results", _RESULT) if exists("results.jsonl") else empty, "texts": texts, "gold": bodies("gold").withColumnRenamed("name", "sha1")}


# bytes to text

_CONTROL = re.compile(r"\\(?:(?P<word>[A-Za-z]+)(?P<number>-?[0-9]+)? ?|'(?P<hex>[0-9A-Fa-f]{2})|(?P<sign>.))", re.S)
#: Groups whose text is none of the document's, and words that stand for signs.
_ASIDE = frozenset("colortbl filetbl fonttbl footer footerf footerl footerr footnote generator header headerf headerl headerr info listtable object pict rsidtbl stylesheet themedata".split())
_SIGNS = {"par": "\n", "line": "\n", "row": "\n", "sect": "\n\n", "page": "\n\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}


def rtf_text(raw: bytes) -> str:
    """The text of an RTF document: without control words, fonts, pictures, headers and hidden groups; bytes in the code
    page of Western Windows, code points by number with their stand-ins left out."""
    s = raw.decode("latin-1")
    out: list[str] = []
    groups: list[tuple[bool, int]] = []
    aside, stand_ins, left_out, i = False, 1, 0, 0
    while i < len(s):
        c = s[i]
        if c == "{":
            groups.append((aside, stand_ins))
        elif c == "}":
            aside, stand_ins = groups.pop() if groups else (False, 1)
            left_out = 0
        elif c == "\\" and (m := _CONTROL.match(s, i)):
            i = m.end() - 1
            word, number = m["word"], m["number"]
            if m["sign"] == "*" or word in _ASIDE:
                aside = True
            elif word == "uc":
                stand_ins = int(number or 1)
            elif word == "u" and number:
                if not aside:
                    out.append(chr(int(number) % 65536))
                left_out = stand_ins
            elif word == "bin" and number:
                i += int(number)
            elif not aside and (word in _SIGNS or m["hex"] or m["sign"]):
                sign = _SIGNS[word] if word in _SIGNS else bytes([int(m["hex"], 16)]).decode("cp1252", "replace") if m["hex"] else {"~": "\xa0", "-": "", "_": "-", "\n": "\n", "\r": "\n"}.get(m["sign"], m["sign"] if m["sign"] in "\\{}" else "")
                if left_out and not word:
                    left_out -= 1
                else:
                    out.append(sign)
        elif c not in "\r\n" and not aside:
            if left_out:
                left_out -= 1
            else:
                out.append(c)
        i += 1
    # surrogate pairs are written as two numbers
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()


def document_texts(spark: SparkSession, root: str, readers: Mapping[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(sha1, kind, text, status) of cached bytes, each by the reader of its kind: RTF by ``rtf_text``, PDF and others by
    what ``readers`` has under the kind's name, which wins. Status: ok, empty (a reader that found nothing),
    unknown_type (no reader), provider_error (a reader that raised), gzip_error. One narrow stage in Arrow batches."""
    known = {"rtf": rtf_text, **(readers or {})}
    names = {b"%PDF": "pdf", b"{\\rt": "rtf", b"PK\x03\x04": "zip"}

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for sha1, content in zip(frame["sha1"], frame["content"], strict=True):
                try:
                    raw = gzip.decompress(content)
                except (OSError, EOFError):
                    rows.append((sha1, None, None, "gzip_error"))
                    continue
                kind = names.get(raw[:4], "html" if raw[:1] == b"<" else "unknown")
                if kind not in known:
                    rows.append((sha1, kind, None, "unknown_type"))
                    continue
                try:
                    text = known[kind](raw)
                    rows.append((sha1, kind, text or None, "ok" if text else "empty"))
                except Exception:  # whatever a vendor's reader raises is this document's status
                    rows.append((sha1, kind, None, "provider_error"))
            yield pd.DataFrame(rows, columns=["sha1", "kind", "text", "status"])

    ship(spark)
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,rtf}.gz").load(root)
    return rows.select(F.regexp_extract("path", "([^/.]*)\\.(pdf|rtf)\\.gz$", 1).alias("sha1"), "content").mapInPandas(read, "sha1 string, kind string, text string, status string")
