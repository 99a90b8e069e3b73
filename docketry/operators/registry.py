"""Registries over run histories: the last word on every document and case, and what is to be done next.

Last-write-wins is a partial aggregate (``max_by``), so a key's history is combined before the shuffle. Equal times are
broken by the run's name, then the status, so results don't depend on the order of input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import legal, rules

PROBLEMS = ("http_error", "unallocated_pid", "error", "fail")


def document_types(andamentos: DataFrame, documentos: DataFrame) -> DataFrame:
    """(url, doc_type): that of the docket before that of sessions; types that are null don't count."""
    rows = andamentos.where("link_url IS NOT NULL").select(F.col("link_url").alias("url"), F.col("link_tipo").alias("doc_type"), F.lit(1).alias("p"))
    rows = rows.unionByName(documentos.where("url IS NOT NULL").select("url", "doc_type", F.lit(2).alias("p"))).where("doc_type IS NOT NULL")
    return rows.groupBy("url").agg(F.min_by("doc_type", F.struct("p", "doc_type")).alias("doc_type"))


def peca_issues(observations: DataFrame, extractors: DataFrame, dismissals: DataFrame, types: DataFrame, pdfs: DataFrame) -> DataFrame:
    """One row a URL: who last saw it and how, its extractor, type, length, doubts and dismissal. ``first_seen_at`` skips
    empty times, ``last_seen_at`` doesn't; attempts count all observations."""
    last = F.max_by(F.struct("classe", "processo_id", "status", "run_dir"), F.struct("ts", "run_dir", "status")).alias("l")
    o = observations.groupBy("url", "sha1").agg(last, F.min(F.nullif("ts", F.lit(""))).alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.count(F.lit(1)).alias("n_attempts_seen"))
    j = o.join(extractors, "sha1", "left").join(dismissals, "sha1", "left").join(types, "url", "left").join(pdfs.select("sha1", "n_chars"), "sha1", "left")
    return j.select(
        "url", "sha1", "l.classe", "l.processo_id", "doc_type", F.col("l.status").alias("latest_status"), F.col("extractor").alias("latest_extractor"), "n_chars", legal.suspicious_short(F.col("n_chars"), F.col("doc_type")).alias("is_suspicious_short"),
        "n_attempts_seen", "first_seen_at", "last_seen_at", F.col("l.run_dir").alias("last_run_dir"), "dismissed_at", F.col("reason").alias("dismissed_reason"),
    )


def case_issues(observations: DataFrame, problems: tuple[str, ...] = PROBLEMS) -> DataFrame:
    """One row a case whose last status is a problem; the error is the last that was given."""
    g = observations.groupBy("classe", "processo_id").agg(
        F.max_by(F.struct("status", "run_dir"), F.struct("ts", "run_dir", "status")).alias("l"),
        F.expr("max_by(error, struct(ts, run_dir, status)) filter (where error is not null)").alias("latest_error"),
        F.count(F.lit(1)).alias("n_attempts_seen"),
        F.min(F.nullif("ts", F.lit(""))).alias("first_seen_at"),
        F.max("ts").alias("last_seen_at"),
    )
    g = g.where(F.col("l.status").isin(*problems))
    return g.select("classe", "processo_id", F.col("l.status").alias("latest_meta_status"), "latest_error", "n_attempts_seen", "first_seen_at", "last_seen_at", F.col("l.run_dir").alias("last_run_dir"))


def unallocated(observations: DataFrame, minimum: int = 2) -> DataFrame:
    """(classe, processo_id, n_observations, confirmed) of numbers seen unallocated."""
    g = observations.where("status = 'unallocated_pid'").groupBy("classe", "processo_id").agg(F.count(F.lit(1)).alias("n_observations"))
    return g.withColumn("confirmed", F.col("n_observations") >= minimum)


def error_rows(meta: DataFrame, urls: DataFrame) -> DataFrame:
    """(kind, classe, processo, url, status, error, stage_order): what isn't done and may be tried again, in the order of
    the stages; a document whose bytes failed has no row for its text."""
    fine = ("ok", "skipped_cached", "unallocated_pid")
    a = meta.where(~F.col("status").isin(*fine)).select(F.lit("fetch_meta").alias("kind"), "classe", F.col("processo_id").alias("processo"), F.lit(None).cast("string").alias("url"), "status", "error", F.lit(0).alias("stage_order"))
    bad = urls.where(~F.col("status").isin(*fine)).select(F.col("stage").alias("kind"), "classe", F.col("processo_id").alias("processo"), "url", "status", "error", F.when(F.col("stage") == "fetch_bytes", 1).otherwise(2).alias("stage_order"))
    first = bad.groupBy("classe", "processo", "url").agg(F.min_by(F.struct("kind", "status", "error", "stage_order"), "stage_order").alias("f"))
    return a.unionByName(first.select("f.kind", "classe", "processo", "url", "f.status", "f.error", "f.stage_order"))


def seeds(targets: DataFrame, meta: DataFrame, urls: DataFrame) -> DataFrame:
    """(classe, processo_id, kind, pool, url) of the tasks to begin with when a run is resumed: the case itself if its
    page isn't there, else bytes that aren't, else text on good bytes; each only if it may be tried again."""
    key = ["classe", "processo_id"]
    m = targets.select(*key).distinct().join(meta.select(*key, "status", "retry_count"), key, "left")
    again = lambda kind: rules.retryable(F.lit(kind), F.col("status")) & (F.coalesce("retry_count", F.lit(0)) < rules.RETRY_CAP)
    none = F.lit(None).cast("string").alias("url")
    cases = m.where(~F.coalesce(F.col("status") == "ok", F.lit(False)) & again("fetch_meta")).select(*key, F.lit("fetch_meta").alias("kind"), F.lit("portal").alias("pool"), none)
    done = m.where("status = 'ok'").select(*key)
    mine = urls.join(done, key, "left_semi")
    b = mine.where("stage = 'fetch_bytes'").select(*key, "url", "status", "retry_count")
    bytes_ = b.where(~F.coalesce(F.col("status") == "ok", F.lit(False)) & again("fetch_bytes")).select(*key, F.lit("fetch_bytes").alias("kind"), F.lit("sistemas").alias("pool"), "url")
    t = b.where("status = 'ok'").select(*key, "url").join(mine.where("stage = 'extract_text'").select(*key, "url", "status", "retry_count"), [*key, "url"], "left")
    texts = t.where(~F.coalesce(F.col("status") == "ok", F.lit(False)) & again("extract_text")).select(*key, F.lit("extract_text").alias("kind"), F.lit("ocr").alias("pool"), "url")
    return cases.unionByName(bytes_).unionByName(texts)


def residuals(rows: DataFrame) -> DataFrame:
    """(kind, status, n, action) of rows that aren't done: how many of each, and what to do about them."""
    g = rows.where(~F.col("status").isin("ok", "skipped_cached")).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    return g.withColumn("action", rules.recovery_bucket(F.col("kind"), F.col("status"), F.lit(0), none, F.lit(False)))


def recovery_plan(rows: DataFrame) -> DataFrame:
    """(run_dir, bucket, status, n, urls): one batch for each run, pile and status; URLs in order. Rows need kind,
    status, retry_count, extractor, dismissed, url and run_dir."""
    b = rows.withColumn("bucket", rules.recovery_bucket(F.col("kind"), F.col("status"), F.col("retry_count"), F.col("extractor"), F.col("dismissed"))).where("bucket IS NOT NULL")
    return b.groupBy("run_dir", "bucket", "status").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("url")).alias("urls"))


def progress(meta: DataFrame, urls: DataFrame) -> DataFrame:
    """(stage, status, n) over all stages."""
    a = meta.select(F.lit("fetch_meta").alias("stage"), "status")
    return a.unionByName(urls.select("stage", "status")).groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"))


def pecas_total(meta: DataFrame) -> DataFrame:
    """One row: the documents of all good cases, null if any of them doesn't say."""
    ok = meta.where("status = 'ok'")
    return ok.agg(F.when(F.bool_or(F.col("n_pecas").isNull()), F.lit(None).cast("bigint")).otherwise(F.coalesce(F.sum("n_pecas"), F.lit(0))).alias("pecas_total"))


def sweep_observations(files: DataFrame) -> DataFrame:
    """(sweep, classe, processo_id, status) of the older sweeps' state files given as (path, body): an object of records
    by any key. Malformed files, and records without class or whole number, are skipped."""
    fine = files.where(F.try_parse_json("body").isNotNull() & F.col("body").rlike("^\\s*\\{"))
    rows = fine.select(F.col("path").alias("sweep"), F.explode(F.from_json("body", "map<string,string>")).alias("key", "value")).where(F.col("value").rlike("^\\s*\\{"))
    r = rows.select("sweep", F.from_json("value", "classe string, status string").alias("r"), F.get_json_object("value", "$.processo").alias("n"))
    whole = F.when(F.col("n").rlike("^-?[0-9]+$"), F.col("n").try_cast("int"))
    return r.select("sweep", "r.classe", whole.alias("processo_id"), "r.status").where("classe IS NOT NULL AND processo_id IS NOT NULL")


def sweep_unallocated(observations: DataFrame, classe: str, minimum: int = 2) -> DataFrame:
    """(processo_id, n_observations, confirmed) of the numbers of a class that older sweeps saw unallocated, by number."""
    g = observations.where((F.col("classe") == classe) & (F.col("status") == "unallocated")).groupBy("processo_id").agg(F.count(F.lit(1)).alias("n_observations"))
    return g.withColumn("confirmed", F.col("n_observations") >= minimum).orderBy("processo_id")


#: Piles that another pass may empty.
ACTIONABLE = ("provider_switch", "refetch_upstream", "replay")


def actionable(rows: DataFrame) -> DataFrame:
    """(bucket, n) of the piles that another pass may empty; rows as for ``recovery_plan``."""
    b = rows.select(rules.recovery_bucket(F.col("kind"), F.col("status"), F.col("retry_count"), F.col("extractor"), F.col("dismissed")).alias("bucket"))
    return b.where(F.col("bucket").isin(*ACTIONABLE)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
