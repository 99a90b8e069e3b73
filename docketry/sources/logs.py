"""Run logs, pipeline state, lists and sheets: readers that skip or refuse bad rows as each kind requires, and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import text as tx
from docketry.sources.scratch import Folder

LOG_SCHEMA = "kind string, classe string, processo int, url string, status string, error string, doc_type string, extractor string, chars int, ts string"
STATE_FILES = ("pdfs.state.json", "executar.state.json")
_ENTRY = "struct<status:string,ts:string,error:string,retry_count:int,n_pecas:int,doc_type:string,extractor:string,chars:int>"
_CASE = f"struct<fetch_meta:{_ENTRY},fetch_bytes:map<string,string>,extract_text:map<string,string>>"


def state_cases(files: DataFrame) -> DataFrame:
    """(run_dir, classe, processo_id, r) of state files given as (path, body); malformed files are skipped, keys are cut
    at their first dash, those whose number isn't one are skipped."""
    fine = files.where(F.try_parse_json("body").isNotNull())
    rows = fine.select(F.element_at(F.split("path", "/"), -2).alias("run_dir"), F.explode(F.from_json(F.get_json_object("body", "$.cases"), "map<string,string>")).alias("key", "value"))
    pid = F.expr("try_cast(substr(key, instr(key, '-') + 1) as int)")
    return rows.select("run_dir", F.substring_index("key", "-", 1).alias("classe"), pid.alias("processo_id"), F.from_json("value", _CASE).alias("r")).where("processo_id IS NOT NULL")


def read_states(spark: SparkSession, root: str, names: Iterable[str] = STATE_FILES) -> DataFrame:
    pattern = "{" + ",".join(names) + "}"
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def url_observations(states: DataFrame) -> DataFrame:
    """(url, sha1, classe, processo_id, stage, status, error, ts, retry_count, extractor, doc_type, run_dir): bytes and text entries with
    a status; a missing time is the empty string."""
    stage = lambda name: states.select("run_dir", "classe", "processo_id", F.lit(name).alias("stage"), F.explode(f"r.{name}").alias("url", "e"))
    rows = stage("fetch_bytes").unionByName(stage("extract_text")).withColumn("e", F.from_json("e", _ENTRY)).where("e.status <> ''")
    return rows.select("url", F.sha1("url").alias("sha1"), "classe", "processo_id", "stage", "e.status", "e.error", F.coalesce("e.ts", F.lit("")).alias("ts"), F.coalesce("e.retry_count", F.lit(0)).alias("retry_count"), "e.extractor", "e.doc_type", "run_dir")


def meta_observations(states: DataFrame) -> DataFrame:
    """(classe, processo_id, status, error, ts, run_dir): entries of the first stage with a status."""
    return states.where("r.fetch_meta.status <> ''").select("classe", "processo_id", "r.fetch_meta.status", "r.fetch_meta.error", F.coalesce("r.fetch_meta.ts", F.lit("")).alias("ts"), "run_dir")


def read_jsonl(spark: SparkSession, path: str, schema: str = LOG_SCHEMA, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines file with their ``line``; blank lines are skipped, malformed ones raise if ``strict``, else
    are skipped. Order within a file is that of the byte offset, so no counter runs over the whole."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "")
    good = F.parse_json("value") if strict else F.try_parse_json("value")
    return raw.where(good.isNotNull()).select(F.from_json("value", schema).alias("r"), "file", "line").select("r.*", "file", "line")


def last_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a partial aggregate, not a sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def recover_state(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """State rebuilt from a snapshot and the log after it, both (kind, classe, processo, url, status, error, ..., line):
    the last row of a key wins, a document's type stays if a later row lacks it, ``retry_count`` is the number of rows
    but the first, plus the snapshot's. Rows without class, number, kind or status are skipped, and document rows
    without URL."""
    keys = ["kind", "classe", "processo", "url"]
    good = log.where("classe IS NOT NULL AND processo IS NOT NULL AND kind <> '' AND status <> '' AND (kind = 'fetch_meta' OR url <> '')")
    old = snapshot.select(*keys, "status", "error", "doc_type", F.lit(-1).cast("bigint").alias("line"), F.col("retry_count").alias("had"))
    rows = good.select(*keys, "status", "error", "doc_type", F.col("line").cast("bigint").alias("line"), F.lit(0).alias("had")).unionByName(old)
    rows = rows.withColumn("url", F.when(F.col("kind") == "fetch_meta", F.lit("")).otherwise(F.col("url")))
    out = rows.groupBy(*keys).agg(
        F.max_by("status", "line").alias("status"), F.max_by("error", "line").alias("error"), F.expr("max_by(doc_type, line) filter (where doc_type is not null)").alias("doc_type"), (F.count(F.lit(1)) - 1 + F.sum("had")).cast("int").alias("retry_count")
    )
    return out.withColumn("url", F.nullif("url", F.lit("")))


def candidates(lines: DataFrame, classe: str, minimum: int = 2) -> DataFrame:
    """(classe, processo_id, n_observations, confirmed) of a tab-separated sheet read with its header; without the two
    columns there are no rows, rows that aren't two whole numbers are skipped."""
    if not {"processo_id", "n_observations"} <= set(lines.columns):
        return lines.sparkSession.createDataFrame([], "classe string, processo_id int, n_observations int, confirmed boolean")
    n = [F.col(c).try_cast("int").alias(c) for c in ("processo_id", "n_observations")]
    return lines.select(F.lit(classe).alias("classe"), *n).where("processo_id IS NOT NULL AND n_observations IS NOT NULL").withColumn("confirmed", F.col("n_observations") >= minimum)


def merge_candidates(sheet: DataFrame, walked: DataFrame) -> DataFrame:
    """The higher count of each number; the sheet's on equal counts."""
    both = sheet.withColumn("own", F.lit(1)).unionByName(walked.withColumn("own", F.lit(0)))
    best = F.max_by(F.struct("n_observations", "confirmed"), F.struct("n_observations", "own")).alias("b")
    return both.groupBy("classe", "processo_id").agg(best).select("classe", "processo_id", "b.*")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """(classe, processo_id[, source]) of a sheet with the columns classe and processo or processo_id; other sheets, and
    numbers that aren't whole, raise; blank rows are skipped."""
    rows = spark.read.csv(path, header=True)
    number = next((c for c in ("processo_id", "processo") if c in rows.columns), None)
    if number is None or "classe" not in rows.columns:
        raise ValueError(f"{path}: columns classe and processo or processo_id are needed, not {rows.columns}")
    rows = rows.where("coalesce(trim(classe), '') <> '' OR coalesce(trim({0}), '') <> ''".format(number))
    checked = F.coalesce(F.col(number).try_cast("int"), F.raise_error(F.concat(F.lit(f"{path}: not a number: "), F.coalesce(number, F.lit("")))).cast("int"))
    return rows.select(F.trim("classe").alias("classe"), checked.alias("processo_id"), *([F.col("source")] if "source" in rows.columns else []))


def parity_columns(rows: DataFrame, lists: Iterable[str], numbers: Iterable[str], null_if_empty: Iterable[str] = ("numero_origem",)) -> DataFrame:
    """A sheet's texts as values: '' as null, lists from JSON, whole numbers; named lists are null when empty."""
    out = rows.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in rows.columns])
    for c in lists:
        items = F.from_json(c, "array<string>")
        out = out.withColumn(c, F.when(F.size(items) > 0, items) if c in null_if_empty else items)
    return out.withColumns({c: F.col(c).try_cast("int") for c in numbers})


def list_lines(lines: DataFrame) -> DataFrame:
    """(item) of a list file (value): what is before ``#``, trimmed, where there is something."""
    return lines.select(F.trim(F.substring_index("value", "#", 1)).alias("item")).where("item <> ''")


def watch_list(lines: DataFrame) -> DataFrame:
    """(classe, numero) of a list of ``CLASS NUMBER`` or ``CLASS-NUMBER``; other lines raise with their text."""
    p = "^([A-Za-z]+)[ -]+([0-9]+)$"
    bad = F.raise_error(F.concat(F.lit("not a case: "), F.col("item")))
    return list_lines(lines).select(F.when(F.col("item").rlike(p), F.upper(F.regexp_extract("item", p, 1))).otherwise(bad.cast("string")).alias("classe"), F.regexp_extract("item", p, 2).try_cast("int").alias("numero"))


def regime_events(rows: DataFrame) -> DataFrame:
    """(key, ts, regime) of log rows with a regime: the case, or the URL where there is no case."""
    return rows.where("regime IS NOT NULL").select(F.coalesce(F.when(F.col("classe").isNotNull(), F.concat_ws("_", "classe", F.col("processo").cast("string"))), F.col("url")).alias("key"), "ts", "regime")


def captured(names: DataFrame) -> DataFrame:
    """(processo_id) of the ranges lo-hi in file names (name), ends included; ranges that run backwards are skipped."""
    lo, hi = (F.expr(f"try_cast(regexp_extract(name, '_([0-9]+)-([0-9]+)[.]', {i}) as int)") for i in (1, 2))
    return names.select(lo.alias("lo"), hi.alias("hi")).where("lo <= hi").select(F.explode(F.sequence("lo", "hi")).alias("processo_id")).distinct()


# sinks


def publish(tables: dict[str, DataFrame], root: str, finish: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None) -> str:
    """Full rebuild that readers never see half of: tables go to a new version's folder, then the pointer is replaced by
    one rename. ``finish`` makes further tables of those that are written. Returns the version's folder."""
    spark = next(iter(tables.values())).sparkSession
    version = f"{root}/v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{version}/{name}")
    for name, df in (finish({n: spark.read.parquet(f"{version}/{n}") for n in tables}) if finish else {}).items():
        df.write.mode("overwrite").parquet(f"{version}/{name}")
    jvm = spark._jvm
    path = lambda s: jvm.org.apache.hadoop.fs.Path(s)
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fresh, current = path(f"{root}/.current-{uuid.uuid4().hex}"), path(f"{root}/CURRENT")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, current, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)) if not fs.exists(current) else _replace(spark, fs, fresh, current)
    return version


def _replace(spark: SparkSession, fs, fresh, current) -> None:
    jvm = spark._jvm
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, current, how)


def open_published(spark: SparkSession, root: str) -> str:
    """Folder of the version that readers use."""
    return spark.read.text(f"{root}/CURRENT").first()[0]


def exportable(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for sheets."""
    return rows.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes])


def export(rows: DataFrame, path: str, how: str = "all", overwrite: bool = False) -> None:
    """Writes csv, jsonl, json (both as JSON lines) or all, under ``path``; sheets and lines are appended to unless
    ``overwrite``."""
    if how not in ("csv", "jsonl", "json", "all"):
        raise ValueError(f"unknown format {how!r}")
    mode = "overwrite" if overwrite else "append"
    if how in ("csv", "all"):
        exportable(rows).write.mode(mode).csv(f"{path}/csv", header=True, escape='"')
    if how in ("jsonl", "all"):
        rows.write.mode(mode).json(f"{path}/jsonl")
    if how in ("json", "all"):
        rows.write.mode("overwrite").json(f"{path}/json")


def published(spark: SparkSession, root: str) -> str | None:
    """Folder of the version that readers use; None where nothing was published."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    return open_published(spark, root) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def url_list(spark: SparkSession, path: str, field: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """Rows of a JSON-lines file that have ``field``, whatever its value; blank lines are skipped, malformed ones raise."""
    raw = spark.read.text(path).where(F.trim("value") != "").where(F.parse_json("value").isNotNull())
    has = F.array_contains(F.json_object_keys("value"), field)
    return raw.where(has).select(F.from_json("value", schema).alias("r")).select("r.*")


def existing_output(spark: SparkSession, base: str, formats: Iterable[str] = ("csv", "jsonl", "json")) -> tuple[str, str] | None:
    """(path, format) of the output of an earlier run under ``base``: the first there is of csv, jsonl, json, among the
    formats that are asked for."""
    for how in (f for f in ("csv", "jsonl", "json") if f in set(formats)):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{base}.{how}")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return f"{base}.{how}", how
    return None


def existing_numbers(spark: SparkSession, base: str, formats: Iterable[str] = ("csv", "jsonl", "json")) -> DataFrame | None:
    """(processo_id) of an earlier run's output, as text, each once; None without an output or without that column. A
    JSON file holds an object or a list of them."""
    found = existing_output(spark, base, formats)
    if found is None:
        return None
    path, how = found
    if how == "csv":
        rows = spark.read.csv(path, header=True)
        return rows.select(F.col("processo_id").cast("string")).distinct() if "processo_id" in rows.columns else None
    text = spark.read.text(path, wholetext=how == "json").where(F.trim("value") != "")
    one = F.when(F.col("value").rlike("^\\s*\\["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    number = F.get_json_object("record", "$.processo_id")
    return text.select(F.explode(one).alias("record")).select(number.alias("processo_id")).where("processo_id IS NOT NULL").distinct()


def missing_numbers(spark: SparkSession, base: str, low: int, high: int, formats: Iterable[str] = ("csv", "jsonl", "json")) -> DataFrame:
    """(processo_id) of low to high that an earlier run's output lacks; none where there is no output to compare with."""
    have = existing_numbers(spark, base, formats)
    every = spark.range(low, high + 1).select(F.col("id").alias("processo_id"))
    if have is None:
        return every.where(F.lit(False))
    return every.join(have.select(F.col("processo_id").try_cast("bigint").alias("processo_id")), "processo_id", "left_anti")


def unallocated_numbers(lines: DataFrame) -> DataFrame:
    """(processo_id) of a list file (value): whole numbers, one a line; notes, blank lines and anything else are
    skipped."""
    return lines.select(F.trim("value").alias("v")).where(F.col("v").rlike("^-?[0-9]+$")).select(F.col("v").try_cast("int").alias("processo_id")).where("processo_id IS NOT NULL").distinct()


def _one_file(rows: DataFrame, path: str, how: str, **options: object) -> None:
    """Writes a small sorted table as a folder with one part."""
    writer = rows.coalesce(1).write.mode("overwrite")
    writer.options(**options).format(how).save(path)


def write_unallocated(found: DataFrame, root: str, classe: str) -> tuple[str, str]:
    """Writes ``<classe>.txt``, the confirmed numbers, and ``<classe>.candidates.tsv``, all with their counts, from
    (processo_id, n_observations, confirmed), both by number. Returns both paths; each is a folder with one part."""
    listed, sheet = f"{root}/{classe}.txt", f"{root}/{classe}.candidates.tsv"
    _one_file(found.where("confirmed").select(F.col("processo_id").cast("string").alias("value"), F.col("processo_id").alias("n")).repartition(1).sortWithinPartitions("n").select("value"), listed, "text")
    _one_file(found.select("processo_id", "n_observations").repartition(1).sortWithinPartitions("processo_id"), sheet, "csv", header=True, sep="\t")
    return listed, sheet


def write_gaps(gaps: DataFrame, path: str, classe: str = "HC") -> int:
    """Writes a sheet (classe, processo) of missing numbers, the highest first, and returns how many there are."""
    rows = gaps.select(F.lit(classe).alias("classe"), F.col("processo_id").alias("processo"))
    _one_file(rows.repartition(1).sortWithinPartitions(F.desc("processo")), path, "csv", header=True)
    return rows.count()


# what a command is about


def scope(retry: str | None = None, sheet: str | None = None, classe: str | None = None, first: int | None = None, last: int | None = None, **filters: str) -> tuple[str, dict]:
    """(mode, arguments) of the work that is asked for: a retry of an earlier run goes before a sheet, that before a range
    of a class (one end given is both), that before filters, comma-separated. Nothing at all raises, as it would mean
    the whole corpus."""
    if retry:
        return "retry", {"path": retry}
    if sheet:
        return "sheet", {"path": sheet}
    if classe and (first is not None or last is not None):
        low, high = first if first is not None else last, last if last is not None else first
        return "range", {"classe": classe, "first": low, "last": high}
    lists = {k: [x.strip() for x in v.split(",") if x.strip()] for k, v in filters.items() if v}
    lists = {k: v for k, v in lists.items() if v}
    if not classe and not lists:
        raise ValueError("name a scope: an earlier run, a sheet, a class with a range, or a filter")
    return "filters", {"classe": classe, **lists}


FORMATS = ("csv", "jsonl", "json", "all")


def valid_arguments(classe: str, first: int, last: int, how: str = "json", test: bool = False, classes: Iterable[str] | None = None) -> None:
    """Raises for a class that isn't known, a range that runs backwards, an unknown format, and for a test run in any
    format but json."""
    if classes is not None and classe not in set(classes):
        raise ValueError(f"unknown class {classe!r}")
    if first > last:
        raise ValueError(f"the range runs backwards: {first} to {last}")
    if how not in FORMATS:
        raise ValueError(f"unknown format {how!r}")
    if test and how != "json":
        raise ValueError("a test run writes json only")


def redacted_log(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, tx.redact_credentials(F.col(column)))


def shard(rows: DataFrame, n: int, order: list[Column], how: str = "interleave") -> DataFrame:
    """Adds ``shard``, 0 to n - 1: by position modulo n, or in n runs [i len / n, (i + 1) len / n)."""
    if how != "interleave" and how != "range":
        raise ValueError(f"{how!r} is no way to cut a list")
    placed, total = positions(rows, order)
    at = F.col("_at")
    # of runs the one that holds position p: the greatest i with floor(i len / n) <= p
    number = F.pmod(at, F.lit(n)) if how == "interleave" else F.least(F.floor(((at + 1) * n - 1) / F.lit(max(total, 1))), F.lit(n - 1))
    return placed.withColumn("shard", number.cast("int")).drop("_at")


def positions(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """``rows`` with their place in the order, from 0, in ``_at``, and how many there are. Sorted by ranges and written
    to the shared folder with partition and place in it; what the partitions before hold is added, a number for each."""
    spark = rows.sparkSession
    path = Folder(spark).path
    partition, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows.orderBy(*order).withColumns({"_part": partition, "_place": place}).write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    before, total = [], 0
    for part, k in sorted(stored.groupBy("_part").count().collect()):  # as many as a sort has partitions
        before.append((part, total))
        total += k
    sums = spark.createDataFrame(before, "_part int, _before bigint")
    return stored.join(F.broadcast(sums), "_part").withColumn("_at", F.col("_before") + F.col("_place")).select(*rows.columns, "_at"), total
