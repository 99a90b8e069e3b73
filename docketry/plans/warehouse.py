"""The warehouse: a full rebuild from case files, caches and run states, published at once."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import legal
from docketry.operators import corpus, registry
from docketry.sources import caches, cases, logs


class ValidationError(RuntimeError):
    """A table's share of cases is below its floor."""


KEYS = {"cases": [], "partes": ["seq"], "andamentos": ["seq"], "pautas": ["seq"], "documentos": ["session_idx", "doc_seq"], "publicacoes_dje": ["seq"], "decisoes_dje": ["dje_seq", "dec_seq"]}


COUNTED = ("cases", "partes", "andamentos", "documentos", "pautas", "publicacoes_dje", "decisoes_dje", "pdfs")
VIEWS = ("pdfs_substantive", "missing_bytes", "missing_text", "orphan_cache_files")


def tables(spark: SparkSession, cases_root: str, texts_root: str | None = None, classes: Iterable[str] | None = None, id_range: tuple[int, int] | None = None, parsed: DataFrame | None = None, bytes_root: str | None = None) -> dict[str, DataFrame]:
    """All flat tables, and which files are on disk (texts under ``texts_root``, bytes under ``bytes_root``, the same
    unless given). With classes or a range only those texts come along that documents of the scope refer to. ``parsed``
    are the cases, if they have been read already."""
    if parsed is None:
        parsed = cases.cases(cases.scan(spark, cases_root, classes, id_range))
    out = {
        "cases": cases.flat_cases(parsed), "partes": cases.flat_partes(parsed), "andamentos": cases.flat_andamentos(parsed), "pautas": cases.flat_pautas(parsed),
        "documentos": cases.flat_documentos(parsed), "publicacoes_dje": cases.flat_publicacoes(parsed), "decisoes_dje": cases.flat_decisoes(parsed),
    }
    if texts_root is None:
        none = spark.createDataFrame([], "sha1 string")
        return out | {"pdfs": spark.createDataFrame([], "sha1 string, n_chars int, has_elements boolean, text string, cache_path string"), "disk_bytes": none, "disk_txt": none}
    scoped = classes is not None or id_range is not None
    wanted = out["documentos"].where("url_sha1 IS NOT NULL").select(F.col("url_sha1").alias("sha1")) if scoped else None
    pdfs, sidecars = caches.texts(spark, texts_root, wanted), caches.extractors(spark, texts_root)
    for name, prefix, sha1 in (("andamentos", "link_", "link_url_sha1"), ("documentos", "", "url_sha1"), ("decisoes_dje", "rtf_", "rtf_url_sha1")):
        out[name] = caches.resolve(out[name], pdfs, sidecars, prefix, sha1)
    return out | {"pdfs": pdfs, "disk_bytes": caches.on_disk(spark, bytes_root or texts_root, "pdf"), "disk_txt": caches.on_disk(spark, texts_root, "txt")}


def duplicates(table: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often; Spark enforces none."""
    return table.groupBy(*key).count().where("count > 1")


def build(spark: SparkSession, cases_root: str, out_root: str, texts_root: str | None = None, runs_root: str | None = None, classes: Iterable[str] | None = None, id_range: tuple[int, int] | None = None, strict: bool = False, bytes_root: str | None = None, commit: str | None = None) -> tuple[str, DataFrame]:
    """Writes all tables and the manifest, publishes them, and returns the version's folder and the population rates.
    Case files are read and parsed once, into a scratch table that all flat tables are made from. The manifest is one
    row: when and how long, from which ``commit`` (of the code), the classes, and the rows of each table. A case that
    occurs twice raises before anything is published; with ``strict`` so does, after it, a rate below its floor."""
    began = time.monotonic()
    parsed_path = f"{out_root}/.parsed-{uuid.uuid4().hex}"
    cases.cases(cases.scan(spark, cases_root, classes, id_range)).write.parquet(parsed_path)
    try:
        t = tables(spark, cases_root, texts_root, classes, id_range, spark.read.parquet(parsed_path), bytes_root)
        if (twice := duplicates(t["cases"], ["classe", "processo_id"]).limit(3).collect()):
            raise ValidationError(f"cases that occur more than once: {[tuple(r) for r in twice]}")
        if runs_root is not None:
            states = logs.state_cases(logs.read_states(spark, runs_root))
            none = lambda ddl: spark.createDataFrame([], ddl)
            ext = caches.extractors(spark, texts_root) if texts_root else none("sha1 string, extractor string")
            dis = caches.dismissals(spark, texts_root) if texts_root else none("sha1 string, dismissed_at string, reason string")
            meta = logs.meta_observations(states)
            t["peca_issues"] = registry.peca_issues(logs.url_observations(states), ext, dis, registry.document_types(t["andamentos"], t["documentos"]), t["pdfs"])
            t["case_issues"] = registry.case_issues(meta)
            t["unallocated_pids"] = registry.unallocated(meta)
        version = logs.publish(t, out_root, finish=lambda done: {"manifest": manifest(done, time.monotonic() - began, commit)})
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(parsed_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    done = open_tables(spark, version, [*t])
    rates = corpus.below_floor(corpus.population(done["cases"], {k: done[k] for k in ("partes", "andamentos", "pautas", "publicacoes_dje")} | {"sessao_virtual": done["documentos"]}))
    if strict and (low := rates.where("NOT ok").collect()):
        raise ValidationError("; ".join(f"{r['field']}: {r['rate']:.2%} is below {r['floor']:.1%}" for r in low))
    return version, rates


def manifest(done: dict[str, DataFrame], seconds: float, commit: str | None = None) -> DataFrame:
    """One row about the written tables: built_at, classes, n_<table>, n_unallocated, build_wall_s, commit."""
    row = done["cases"].agg(F.sort_array(F.collect_set("classe")).alias("classes"))
    for name in COUNTED:
        row = row.crossJoin(done[name].agg(F.count(F.lit(1)).cast("int").alias(f"n_{name}")))  # one row by one
    if "unallocated_pids" in done:
        row = row.crossJoin(done["unallocated_pids"].agg(F.count(F.lit(1)).cast("int").alias("n_unallocated")))
    else:
        row = row.withColumn("n_unallocated", F.lit(0))
    return row.select(F.current_timestamp().alias("built_at"), "*", F.lit(seconds).alias("build_wall_s"), F.lit(commit).cast("string").alias("commit"))


def open_tables(spark: SparkSession, version: str, names: Iterable[str] | None = None, views: bool = False) -> dict[str, DataFrame]:
    """The tables of a version and its four views of documents, as temporary views too if wanted, with the function
    ``is_suspicious_short`` for them. ``names`` asks for those tables alone."""
    wanted = [*names] if names is not None else [*KEYS, "pdfs", "disk_bytes", "disk_txt", "manifest"]
    out = {n: spark.read.parquet(f"{version}/{n}") for n in wanted}
    if names is None:
        out |= corpus.views(*(out[n] for n in ("andamentos", "documentos", "pdfs", "disk_bytes", "disk_txt")))
    if views:
        for n, df in out.items():
            df.createOrReplaceTempView(n)
        legal.register(spark)
    return out
