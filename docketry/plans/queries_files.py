"""Queries of what reads and writes files: scans, caches, sinks, the warehouse, streams and runs.

Each writes small files made from the first suppliers (a fixture, 60 rows at most), reads them back by the operator, and
is held against SQL over the same rows, whose expected values are written out.
"""

from __future__ import annotations

import gzip
import io
import json
import tarfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import legal, stats
from docketry.functions import text as tx
from docketry.operators import changes, corpus, registry, sequences
from docketry.plans import reports, scheduler, warehouse
from docketry.plans.inputs import LINK_TYPES, choose, plain, relation
from docketry.plans.queries_more import ORACLE, QUERIES
from docketry.sources import caches, cases, logs, portal
from docketry.sources.scratch import Folder
from docketry.streaming import pipeline
from docketry.streaming.store import Store, take_new

FEW = "SELECT CAST(s_suppkey AS INT) AS k, CAST(s_nationkey AS INT) AS n, s_name AS name FROM {supplier} WHERE s_suppkey <= 60"
_SHA = "lpad(cast(k as string), 40, '0')"


def _sha(k: int) -> str:
    return f"{k:040d}"


def _rows(spark: SparkSession, sf_dir: str) -> list:
    return relation(spark, sf_dir, FEW).orderBy("k").collect()  # 60 at most


def files(name: str, oracle: str | None):
    """Registers a query of (spark, few, folder): the fixture's rows and a new folder."""

    def wrap(f: Callable[[SparkSession, list, Folder], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(spark, _rows(spark, sf_dir), Folder(spark))
        if oracle is not None:
            ORACLE[name] = oracle.replace("{few}", f"({plain(FEW)})").replace("{sha}", "lpad(k::VARCHAR, 40, '0')")
        return f

    return wrap


def over(name: str, sql: str, oracle: str):
    """Registers a query of (spark, rows) over ``sql`` on the fixture's rows, named ``few``."""

    def wrap(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(relation(spark, sf_dir, sql.replace("few", f"({FEW}) few")))
        ORACLE[name] = oracle.replace("{few}", f"({plain(FEW)})")
        return f

    return wrap


# case files


def _case_files(few: list, folder: Folder) -> str:
    for r in few:
        classe = "HC" if r.k % 2 == 0 else "RE"
        case = {"classe": classe, "processo_id": r.k, "relator": r.name}
        body = json.dumps([case, {"classe": classe, "processo_id": r.k + 1000}] if r.k % 3 == 0 else case)
        folder.put(f"{classe}/case-mini_{classe}_{r.k}-{r.k}.json", body)
    return folder.path


def _keys(parsed: DataFrame) -> DataFrame:
    return parsed.select("c.classe", F.col("c.processo_id").cast("int").alias("processo_id"), "c.relator")


@files("sc1_scan", "SELECT 'HC' AS classe, k AS processo_id, name AS relator FROM {few} WHERE k % 2 = 0 AND k BETWEEN 4 AND 40")
def _(spark, few, folder):
    return _keys(cases.cases(cases.scan(spark, _case_files(few, folder), ["HC"], (4, 40))))


@files("sc2_first_record", "SELECT CASE k % 2 WHEN 0 THEN 'HC' ELSE 'RE' END AS classe, k AS processo_id, name AS relator FROM {few}")
def _(spark, few, folder):
    return _keys(cases.cases(cases.scan(spark, _case_files(few, folder))))


@files("sc3_all_records", "SELECT CASE k % 2 WHEN 0 THEN 'HC' ELSE 'RE' END AS classe, k + 1000 * m::INT AS processo_id, CASE m WHEN 0 THEN name END AS relator FROM {few}, range(0, 2) t(m) WHERE m = 0 OR k % 3 = 0")
def _(spark, few, folder):
    root = _case_files(few, folder)
    folder.put("HC/case-mini_HC_9000-9000.json", "{half a case")
    return _keys(cases.cases(cases.scan(spark, root), every_record=True))


@files("sc4_find", "SELECT k, CASE WHEN k % 3 = 2 THEN NULL ELSE k END AS found FROM {few} WHERE k <= 9")
def _(spark, few, folder):
    for r in few:
        if r.k % 3 != 2:
            name = f"case-mini_HC_{r.k}.json" if r.k % 3 == 0 else f"HC/case-mini_HC_{r.k}-{r.k}.json"
            folder.put(name, json.dumps({"classe": "HC", "processo_id": r.k}))
    found = [(r.k, cases.find(spark, [folder.path + "/none", folder.path], "HC", r.k)) for r in few if r.k <= 9]
    paths = spark.createDataFrame(found, "k int, path string")
    return paths.select("k", F.regexp_extract("path", "_([0-9]+)[.-][^_]*$", 1).try_cast("int").alias("found"))


@files("sk11_rewrite", "SELECT CASE k % 2 WHEN 0 THEN 'HC' ELSE 'RE' END AS classe, k AS processo_id, 8 AS schema_version, 200 AS status_http FROM {few}")
def _(spark, few, folder):
    cases.rewrite(cases.cases(cases.scan(spark, _case_files(few, folder))), f"{folder.path}/v8", F.lit("now"))
    again = spark.read.text(f"{folder.path}/v8").select(F.lit("/x").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modified"), F.col("value").alias("body"))
    return cases.flat_cases(cases.cases(again)).select("classe", "processo_id", "schema_version", "status_http")


# versions of the case format, slot by slot

_EVENTS = """SELECT k, CASE k % 5 WHEN 0 THEN '{{"index":"' || cast(k as string) || '"}}' WHEN 1 THEN '{{"index_num":' || cast(k as string) || '}}' WHEN 2 THEN '{{"id":"x"}}' WHEN 3 THEN '{{"link":"http://x/' || cast(k as string) || '.pdf","link_descricao":"VOTO"}}' ELSE '{{"link":{{"url":"u","tipo":"T","text":"t"}}}}' END AS e FROM few"""


@over("pj12_events", _EVENTS, """SELECT k AS processo_id, CASE WHEN k % 5 IN (0, 1) THEN k ELSE 0 END AS idx, CASE k % 5 WHEN 3 THEN 'VOTO' WHEN 4 THEN 'T' END AS tipo, CASE k % 5 WHEN 3 THEN 'http://x/' || k || '.pdf' WHEN 4 THEN 'u' END AS url, NULL::VARCHAR AS text FROM {few}""")
def _(d):
    body = F.concat(F.lit('{"classe":"HC","processo_id":'), F.col("k").cast("string"), F.lit(',"andamentos":['), "e", F.lit("]}"))
    rows = cases.cases(d.select(F.lit("/p").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modified"), body.alias("body")))
    e = cases.reshape(rows, F.lit("now")).select("processo_id", F.explode("andamentos").alias("e"))
    return e.select("processo_id", F.col("e.index").alias("idx"), "e.link.tipo", "e.link.url", "e.link.text")


@over("pj11_meta", """SELECT k, CASE k % 4 WHEN 0 THEN '"_meta":{{"schema_version":7,"status_http":"404","extraido":"2020-01-01T00:00:00"}}' WHEN 1 THEN '"schema_version":3,"status_http":201' WHEN 2 THEN '"extraido":"2019-01-01T00:00:00"' ELSE '"x":1' END AS m FROM few""",
      "SELECT k AS processo_id, CASE k % 4 WHEN 0 THEN 404 WHEN 1 THEN 201 ELSE 200 END AS status_http, CASE k % 4 WHEN 0 THEN '2020-01-01T00:00:00' WHEN 2 THEN '2019-01-01T00:00:00' ELSE 'now' END AS extraido FROM {few}")
def _(d):
    body = F.concat(F.lit('{"classe":"HC","processo_id":"'), F.col("k").cast("string"), F.lit('",'), "m", F.lit("}"))
    rows = cases.cases(d.select(F.lit("/p").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modified"), body.alias("body")))
    return cases.reshape(rows, F.lit("now")).select("processo_id", "_meta.status_http", "_meta.extraido")


@over("fl3_filters", """SELECT k, CASE k % 3 WHEN 0 THEN 'MIN. ALFA' ELSE 'MIN. BETA' END AS relator, CASE k % 4 WHEN 0 THEN 'IMPTE.(S)' ELSE 'PACTE.(S)' END AS tipo, CASE k % 5 WHEN 4 THEN 'CERTIDÃO' ELSE 'VOTO' END AS doc FROM few""",
      "SELECT 'http://x/' || k || '.pdf' AS url, k AS processo_id, 'VOTO' AS doc_type, 'andamento' AS surface FROM {few} WHERE k % 3 = 0 AND k % 4 = 0 AND k % 5 <> 4")
def _(d):
    url = F.concat(F.lit("http://x/"), F.col("k").cast("string"), F.lit(".pdf"))
    events = F.array(F.struct(F.struct(url.alias("url"), F.col("doc").alias("tipo")).alias("link")))
    body = F.to_json(F.struct(F.lit("HC").alias("classe"), F.col("k").alias("processo_id"), "relator", F.array(F.struct("tipo", F.lit("Ana Souza").alias("nome"))).alias("partes"), events.alias("andamentos")))
    rows = cases.cases(d.select(F.lit("/p").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modified"), body.alias("body")))
    return cases.targets(rows, "HC", impte=["souza"], relator=["alfa"], exclude=["CERTIDÃO"]).select("url", "processo_id", "doc_type", "surface")


# caches


def _cache(few: list, folder: Folder) -> str:
    heads = ("%PDF-1.4 x %%EOF", "%PDF-1.4 cut", "<html>", "", None)
    for r in few:
        s = _sha(r.k)
        if r.k % 2 == 0:
            folder.put(f"{s}.txt.gz", gzip.compress(f"texto {r.k}".encode()))
        if r.k % 4 == 0:
            folder.put(f"{s}.elements.json.gz", gzip.compress(b"[]"))
        head = heads[r.k % 5]
        folder.put(f"{s}.pdf.gz", b"raw" if head is None else gzip.compress(head.encode()))
        folder.put(f"{s}.extractor", " pypdf \n" if r.k % 3 else "  ")
        folder.put(f"{s}.dismissed.json", json.dumps({"reason": r.name, "dismissed_at": "t"}) if r.k % 7 else "{")
    return folder.path


@files("sc5_texts", "SELECT {sha} AS sha1, length('texto ' || k)::INT AS n_chars, k % 4 = 0 AS has_elements, 'texto ' || k AS text FROM {few} WHERE k % 2 = 0")
def _(spark, few, folder):
    return caches.texts(spark, _cache(few, folder)).drop("cache_path")


@files("sc9_sidecars", "SELECT {sha} AS sha1, CASE WHEN k % 3 <> 0 THEN 'pypdf' END AS extractor, CASE WHEN k % 7 <> 0 THEN name END AS reason FROM {few}")
def _(spark, few, folder):
    root = _cache(few, folder)
    return caches.extractors(spark, root).join(caches.dismissals(spark, root), "sha1", "left").select("sha1", "extractor", "reason")


@files("sc11_on_disk", "SELECT {sha} AS sha1, 'pdf' AS kind FROM {few} UNION ALL SELECT {sha}, 'txt' FROM {few} WHERE k % 2 = 0")
def _(spark, few, folder):
    root = _cache(few, folder)
    return caches.on_disk(spark, root, "pdf").withColumn("kind", F.lit("pdf")).union(caches.on_disk(spark, root, "txt").withColumn("kind", F.lit("txt")))


@files("sc21_integrity", "SELECT {sha} AS sha1, CASE k % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'truncated' WHEN 2 THEN 'bad_magic' WHEN 3 THEN 'empty' ELSE 'gzip_error' END AS state FROM {few}")
def _(spark, few, folder):
    return caches.integrity(spark, _cache(few, folder))


@files("sc22_archives", "SELECT k AS archive, tab, '<b>' || tab || k || '</b>' AS html FROM {few}, (VALUES ('abaPartes.html'), ('detalhe.html')) t(tab) WHERE k < 8")
def _(spark, few, folder):
    for r in few[:8]:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for tab in ("abaPartes.html", "detalhe.html"):
                page = f"<b>{tab}{r.k}</b>".encode()
                info = tarfile.TarInfo(tab)
                info.size = len(page)
                tar.addfile(info, io.BytesIO(page))
        folder.put(f"{r.k}.tar.gz", out.getvalue())
    return caches.html_archives(spark, folder.path).select(F.regexp_extract("path", "([0-9]+)[.]tar[.]gz$", 1).cast("int").alias("archive"), "tab", "html")


@files("st23_document_texts", """SELECT {sha} AS sha1, CASE k % 5 WHEN 0 THEN 'rtf' WHEN 1 THEN 'pdf' WHEN 2 THEN 'html' WHEN 3 THEN 'rtf' END AS kind, CASE k % 5 WHEN 0 THEN 'Acórdão ' || k || chr(10) || '€ {x}' WHEN 1 THEN 'pages ' || k END AS text,
 CASE k % 5 WHEN 2 THEN 'unknown_type' WHEN 3 THEN 'empty' WHEN 4 THEN 'gzip_error' ELSE 'ok' END AS status FROM {few}""")
def _(spark, few, folder):
    bodies = {0: "{{\\rtf1\\ansi{{\\fonttbl{{\\f0 Arial;}}}}{{\\*\\generator x;}}\\f0\\b Ac\\'f3rd\\'e3o {k}\\par\r\n\\u8364? \\{{x\\}}}}", 1: "%PDF pages {k}", 2: "<html>{k}", 3: "{{\\rtf1{{\\info secret}}}}"}
    for r in few:
        raw = bodies[r.k % 5].format(k=r.k).encode() if r.k % 5 in bodies else None
        folder.put(f"{_sha(r.k)}.pdf.gz", b"raw" if raw is None else gzip.compress(raw))
    return caches.document_texts(spark, folder.path, {"pdf": lambda raw: raw.decode().removeprefix("%PDF ")})


@files("sc25_ocr_report", """SELECT {sha} AS sha1, p AS provider, k % 3 AS stratum, CASE WHEN p = 'mistral' AND k % 4 <> 0 THEN 7 ELSE k % 5 END AS n_pages, length('texto ' || k)::INT AS n_chars,
 CASE WHEN k % 2 = 0 THEN round(CASE p WHEN 'pypdf' THEN 0 ELSE 1.0 / length('texto ' || k) END, 6)::DOUBLE END AS cer, CASE p WHEN 'mistral' THEN round(1 - 1.0 / length('texto ' || k), 6)::DOUBLE END AS similarity FROM {few}, (VALUES ('mistral'), ('pypdf')) t(p)""")
def _(spark, few, folder):
    lines = lambda rows: "\n".join(map(json.dumps, rows)) + "\n\n"
    folder.put("manifest.jsonl", lines({"sha1": _sha(r.k), "stratum": str(r.k % 3), "doc_type": "VOTO", "n_pages": r.k % 5, "gold_corrected": r.k % 2 == 0} for r in few))
    folder.put("results.jsonl", lines({"sha1": _sha(r.k), "provider": "mistral", "n_pages": n, "wall_seconds": 1.5} for r in few for n in (3, 7 if r.k % 4 else 0)))
    for r in few:
        folder.put(f"texts/{_sha(r.k)}.pypdf.txt", f"texto {r.k}")
        folder.put(f"texts/{_sha(r.k)}.mistral.txt", f"textO {r.k}")
        folder.put(f"gold/{_sha(r.k)}.txt", f" texto   {r.k}\n")
    report = corpus.ocr_report(caches.ocr_files(spark, folder.path))
    return report.select("sha1", "provider", F.col("stratum").cast("int").alias("stratum"), "n_pages", "n_chars", F.round("cer", 6).alias("cer"), F.round("similarity", 6).alias("similarity"))


# lists, sheets and logs


@files("sc12_targets", "SELECT 'HC' AS classe, k AS processo_id, name AS source FROM {few}")
def _(spark, few, folder):
    return logs.read_targets(spark, folder.put("t.csv", "classe,processo,source\n" + "".join(f"HC,{r.k},{r.name}\n,,\n" for r in few)))


@files("sc17_lines", "SELECT k AS processo, 'u' || k AS url, CASE k % 2 WHEN 0 THEN 'ok' ELSE 'empty' END AS status FROM {few} WHERE k % 3 <> 0")
def _(spark, few, folder):
    row = lambda r: {"kind": "fetch_bytes", "processo": r.k, "status": "ok" if r.k % 2 == 0 else "empty"} | ({"url": f"u{r.k}"} if r.k % 3 else {})
    return logs.url_list(spark, folder.put("e.jsonl", "\n\n".join(json.dumps(row(r)) for r in few)), "url").select("processo", "url", "status")


@files("sc17_malformed", "SELECT k AS processo FROM {few} WHERE k % 4 <> 0")
def _(spark, few, folder):
    path = folder.put("e.jsonl", "\n".join(json.dumps({"kind": "fetch_meta", "processo": r.k}) if r.k % 4 else '{"kind": "fetch' for r in few))
    return logs.read_jsonl(spark, path, strict=False).select("processo")


@over("sc18_regime_events", "SELECT k, CASE k % 3 WHEN 0 THEN NULL ELSE 'HC' END AS classe, k AS processo, 'u' || cast(k as string) AS url, 't' AS ts, CASE k % 4 WHEN 0 THEN NULL ELSE 'collapse' END AS regime FROM few", "SELECT CASE k % 3 WHEN 0 THEN 'u' || k ELSE 'HC_' || k END AS key, 't' AS ts, 'collapse' AS regime FROM {few} WHERE k % 4 <> 0")
def _(d):
    return logs.regime_events(d)


@files("sc20_missing", "SELECT how, k::BIGINT AS processo_id FROM {few}, (VALUES ('csv'), ('json'), ('jsonl')) t(how) WHERE k % CASE how WHEN 'csv' THEN 2 WHEN 'jsonl' THEN 3 ELSE 5 END = 0")
def _(spark, few, folder):
    top, out = few[-1].k, None
    for how, n in (("csv", 2), ("jsonl", 3), ("json", 5)):
        have = [r.k for r in few if r.k % n]
        body = {"csv": "processo_id,x\n" + "".join(f"{k},1\n" for k in have), "jsonl": "\n".join(json.dumps({"processo_id": k}) for k in have), "json": json.dumps([{"processo_id": str(k)} for k in have] + [3])}[how]
        folder.put(f"{how}/out.{how}", body)
        # what comes later in the order of formats isn't looked at
        folder.put(f"{how}/out.json", body if how == "json" else "[]")
        d = logs.missing_numbers(spark, f"{folder.path}/{how}/out", 0, top).select(F.lit(how).alias("how"), "processo_id")
        out = d if out is None else out.union(d)
    return out


@files("sk1_publish", "SELECT k, 'second' AS version FROM {few} WHERE k % 2 = 1")
def _(spark, few, folder):
    for version, some in (("first", few), ("second", few[1::2])):
        logs.publish({"t": spark.createDataFrame([(r.k, version) for r in some], "k int, version string")}, folder.path)
    return spark.read.parquet(f"{logs.open_published(spark, folder.path)}/t")


@files("sk4_export", "SELECT how, k, '[\"' || name || '\"]' AS items FROM {few}, (VALUES ('csv'), ('jsonl')) t(how) UNION ALL SELECT 'csv', k, '[\"' || name || '\"]' FROM {few}")
def _(spark, few, folder):
    rows = spark.createDataFrame([(r.k, [r.name]) for r in few], "k int, items array<string>")
    logs.export(rows, f"{folder.path}/out", "all", overwrite=True)
    logs.export(rows, f"{folder.path}/out", "csv")
    sheet = spark.read.csv(f"{folder.path}/out/csv", header=True, escape='"').select(F.lit("csv").alias("how"), F.col("k").cast("int").alias("k"), "items")
    lines = spark.read.schema("k int, items array<string>").json(f"{folder.path}/out/jsonl")
    return sheet.unionByName(lines.select(F.lit("jsonl").alias("how"), "k", F.to_json("items").alias("items")))


@files("sk8_gap_sheet", "SELECT 'HC' AS classe, k AS processo FROM {few} WHERE k % 3 <> 0 AND k % 5 <> 0")
def _(spark, few, folder):
    numbers = lambda n: spark.createDataFrame([(r.k,) for r in few if r.k % n == 0], "processo_id int")
    logs.write_gaps(changes.gaps(1, few[-1].k, numbers(3), numbers(5)), f"{folder.path}/gaps.csv")
    return logs.read_targets(spark, f"{folder.path}/gaps.csv").select("classe", F.col("processo_id").alias("processo"))


def _sweeps(few: list, folder: Folder) -> str:
    for run in range(3):
        state = {f"HC-{r.k}": {"classe": "HC" if r.k % 6 else "RE", "processo": r.k if r.k % 7 else str(r.k), "status": "unallocated" if r.k % 4 >= run else "ok"} for r in few}
        folder.put(f"run-{run}/sweep.state.json", json.dumps(state | {"odd": 1}))
    folder.put("run-9/sweep.state.json", "{half")
    return folder.path


_SEEN = "SELECT k AS processo_id, least(3, k % 4 + 1)::BIGINT AS n_observations, k % 4 >= 1 AS confirmed FROM {few} WHERE k % 6 <> 0"


@files("ag6_sweep_unallocated", _SEEN)
def _(spark, few, folder):
    found = logs.read_states(spark, _sweeps(few, folder), ["sweep.state.json"])
    return registry.sweep_unallocated(registry.sweep_observations(found), "HC")


@files("sk9_unallocated_lists", f"SELECT 'list' AS file, processo_id, NULL::INT AS n_observations FROM ({_SEEN}) WHERE confirmed UNION ALL SELECT 'sheet', processo_id, n_observations::INT FROM ({_SEEN})")
def _(spark, few, folder):
    found = registry.sweep_unallocated(registry.sweep_observations(logs.read_states(spark, _sweeps(few, folder), ["sweep.state.json"])), "HC")
    listed, sheet = logs.write_unallocated(found, f"{folder.path}/out", "HC")
    a = logs.unallocated_numbers(spark.read.text(listed)).select(F.lit("list").alias("file"), "processo_id", F.lit(None).cast("int").alias("n_observations"))
    b = logs.candidates(spark.read.csv(sheet, header=True, sep="\t"), "HC")
    return a.unionByName(b.select(F.lit("sheet").alias("file"), "processo_id", "n_observations"))


@over("fl11_scope", "SELECT k, 'HC' AS classe FROM few", "SELECT k AS processo_id FROM {few} WHERE k BETWEEN 3 AND 9")
def _(d):
    mode, what = logs.scope(classe="HC", first=3, last=9, relator="ignored beside a range")
    assert mode == "range" and logs.scope(retry="r", sheet="s")[0] == "retry" and logs.scope(sheet="s", classe="HC", first=1)[0] == "sheet"
    logs.valid_arguments(what["classe"], what["first"], what["last"], classes=("HC", "RE"))
    return d.where((F.col("classe") == what["classe"]) & F.col("k").between(what["first"], what["last"])).select(F.col("k").alias("processo_id"))


# the warehouse

_KINDS = ("DECISÃO MONOCRÁTICA", "DESPACHO", "CERTIDÃO", "MANIFESTAÇÃO DA PGR")


def _warehouse(spark: SparkSession, few: list, folder: Folder) -> str:
    import hashlib

    sha = lambda url: hashlib.sha1(url.encode()).hexdigest()
    for r in few:
        url = f"http://x/{r.k}.pdf"
        case = {"classe": "HC", "processo_id": r.k, "relator": r.name, "partes": [{"nome": r.name, "tipo": "IMPTE.(S)"}], "andamentos": [{"nome": "Decisão", "data": "2020-01-02", "link": {"tipo": _KINDS[r.k % 4], "url": url}}]}
        if r.k % 2 == 0:
            case["sessao_virtual"] = [{"documentos": [{"url": f"http://v/{r.k}.pdf", "tipo": "Voto"}]}]
        folder.put(f"cases/HC/case-mini_HC_{r.k}-{r.k}.json", json.dumps(case))
        if r.k % 3 == 0:
            folder.put(f"texts/{sha(url)}.txt.gz", gzip.compress(b"x" * (2000 if r.k % 2 else 10)))
        if r.k % 5 == 0:
            folder.put(f"bytes/{sha(url)}.pdf.gz", gzip.compress(b"%PDF"))
        if r.k % 6 == 0:
            folder.put(f"bytes/{_sha(r.k)}.pdf.gz", gzip.compress(b"%PDF"))
    for name in ("texts", "bytes"):
        folder.put(f"{name}/.keep", "")
    return warehouse.build(spark, f"{folder.path}/cases", f"{folder.path}/warehouse", f"{folder.path}/texts", bytes_root=f"{folder.path}/bytes", commit="abc")[0]


_SUB = """w AS (SELECT k, sha1('http://x/' || k || '.pdf') AS sha, k % 4 = 0 OR k % 4 IN (1, 3) AND (k % 3 <> 0 OR k % 2 = 1) AS kept FROM {few}),
s AS (SELECT k, sha, 'x' AS of FROM w WHERE kept UNION ALL SELECT k, sha1('http://v/' || k || '.pdf'), 'v' FROM w WHERE k % 2 = 0)"""


@files("sc23_warehouse_views", f"""WITH {_SUB}
SELECT 'pdfs_substantive' AS view, count(*) AS n FROM s UNION ALL SELECT 'missing_bytes', count(*) FROM s WHERE NOT (of = 'x' AND k % 5 = 0) UNION ALL SELECT 'missing_text', count(*) FROM s WHERE NOT (of = 'x' AND k % 3 = 0)
UNION ALL SELECT 'orphan_cache_files', (SELECT count(*) FROM w WHERE k % 5 = 0 AND NOT kept) + (SELECT count(*) FROM w WHERE k % 6 = 0) + (SELECT count(*) FROM w WHERE k % 3 = 0 AND NOT kept)""")
def _(spark, few, folder):
    t = warehouse.open_tables(spark, _warehouse(spark, few, folder))
    out = None
    for name in warehouse.VIEWS:
        d = t[name].agg(F.lit(name).alias("view"), F.count(F.lit(1)).alias("n"))
        out = d if out is None else out.union(d)
    return out


@files("ag9_manifest_written", "SELECT ['HC'] AS classes, count(*)::INT AS n_cases, count(*)::INT AS n_partes, count(*)::INT AS n_andamentos, count(*) FILTER (k % 2 = 0)::INT AS n_documentos, 0 AS n_pautas, 0 AS n_decisoes_dje, count(*) FILTER (k % 3 = 0)::INT AS n_pdfs, 0 AS n_unallocated, 'abc' AS commit FROM {few}")
def _(spark, few, folder):
    m = corpus.latest_manifest(warehouse.open_tables(spark, _warehouse(spark, few, folder), ["manifest"])["manifest"])
    return m.select("classes", "n_cases", "n_partes", "n_andamentos", "n_documentos", "n_pautas", "n_decisoes_dje", "n_pdfs", "n_unallocated", "commit")


@files("sk2_disk_tables", "SELECT 'bytes' AS kind, sha1('http://x/' || k || '.pdf') AS sha1 FROM {few} WHERE k % 5 = 0 UNION ALL SELECT 'bytes', {sha} FROM {few} WHERE k % 6 = 0 UNION ALL SELECT 'txt', sha1('http://x/' || k || '.pdf') FROM {few} WHERE k % 3 = 0")
def _(spark, few, folder):
    t = warehouse.open_tables(spark, _warehouse(spark, few, folder), ["disk_bytes", "disk_txt"])
    return t["disk_bytes"].select(F.lit("bytes").alias("kind"), "sha1").union(t["disk_txt"].select(F.lit("txt").alias("kind"), "sha1"))


@files("ag8_floors", "SELECT field, CASE field WHEN 'andamentos' THEN 1.0 WHEN 'partes' THEN 1.0 WHEN 'sessao_virtual' THEN (SELECT round(count(*) FILTER (k % 2 = 0) / count(*), 6) FROM {few}) ELSE 0.0 END::DOUBLE AS rate, field NOT IN ('pautas', 'publicacoes_dje') AS ok FROM (VALUES ('andamentos'), ('partes'), ('pautas'), ('publicacoes_dje'), ('sessao_virtual')) t(field)")
def _(spark, few, folder):
    t = warehouse.open_tables(spark, _warehouse(spark, few, folder))
    rates = corpus.population(t["cases"], {k: t[k] for k in ("partes", "andamentos", "pautas", "publicacoes_dje")} | {"sessao_virtual": t["documentos"]})
    return corpus.below_floor(rates).select("field", F.round("rate", 6).alias("rate"), "ok")


@files("jn10_scoped_texts", "SELECT sha1('http://v/' || k || '.pdf') AS sha1 FROM {few} WHERE k % 4 = 0 AND k BETWEEN 2 AND 20")
def _(spark, few, folder):
    import hashlib

    for r in few:
        url = f"http://v/{r.k}.pdf"
        folder.put(f"cases/HC/case-mini_HC_{r.k}-{r.k}.json", json.dumps({"classe": "HC", "processo_id": r.k, "sessao_virtual": [{"documentos": [{"url": url, "tipo": "Voto"}]}] if r.k % 2 == 0 else []}))
        if r.k % 4 == 0 or r.k % 3 == 0:
            folder.put(f"texts/{hashlib.sha1((url if r.k % 4 == 0 else url + 'x').encode()).hexdigest()}.txt.gz", gzip.compress(b"t"))
    folder.put("texts/.keep", "")
    return warehouse.tables(spark, f"{folder.path}/cases", f"{folder.path}/texts", ["HC"], (2, 20))["pdfs"].select("sha1")


@over("ud1_sql_function", f"SELECT k, CAST(k * 7 AS INT) AS n_chars, {choose('k', LINK_TYPES)} AS t FROM few", f"SELECT k, CASE WHEN t IS NOT NULL THEN t IN ('DESPACHO', 'INTEIRO TEOR DO ACÓRDÃO', 'Relatório', 'DECISÃO MONOCRÁTICA', 'Voto') AND k * 7 < 200 END AS short FROM (SELECT k, {choose('k', LINK_TYPES)} AS t FROM {{few}})")
def _(d):
    legal.register(d.sparkSession)
    return d.selectExpr("k", "is_suspicious_short(n_chars, t) AS short")


# statistics and forecasts


@over("dm4_posterior", "SELECT k, CAST(k % 9 + 1 AS INT) AS n, CASE k % 2 WHEN 1 THEN CAST(k % 9 + 1 AS INT) ELSE 0 END AS wins FROM few", """
SELECT k, round((1.0 + w) / (2 + n), 6)::DOUBLE AS shrunk_rate, round(CASE w WHEN 0 THEN 1 - pow(0.975, 1.0 / (n + 1)) ELSE pow(0.025, 1.0 / (n + 1)) END, 6)::DOUBLE AS ci_lo, round(CASE w WHEN 0 THEN 1 - pow(0.025, 1.0 / (n + 1)) ELSE pow(0.975, 1.0 / (n + 1)) END, 6)::DOUBLE AS ci_hi
FROM (SELECT k, k % 9 + 1 AS n, CASE k % 2 WHEN 1 THEN k % 9 + 1 ELSE 0 END AS w FROM {few})""")  # fmt: skip
def _(d):
    p = stats.posterior(d, 1.0, 1.0)
    return p.select("k", *[F.round(c, 6).alias(c) for c in ("shrunk_rate", "ci_lo", "ci_hi")])


@over("dm5_forecast", "SELECT k FROM few", "SELECT k, mode, round(CASE mode WHEN 'direct' THEN 3.0 * k ELSE 3.0 * k / 12.7 END, 6)::DOUBLE AS seconds, round(k * 0.1685 / 1024, 9)::DOUBLE AS gb, round(CASE mode WHEN 'direct' THEN 0 ELSE k * 0.1685 / 1024 * 3.65 END, 9)::DOUBLE AS usd FROM {few}, (VALUES ('direct'), ('16 shards')) t(mode)")
def _(d):
    f = d.select("k", F.explode(stats.forecast(F.col("k"), stats.PACES["documents"])).alias("f"))
    return f.select("k", "f.mode", F.round("f.seconds", 6).alias("seconds"), F.round("f.gb", 9).alias("gb"), F.round("f.usd", 9).alias("usd"))


@over("dm5_extraction", f"SELECT k, {choose('k', ('mistral', 'pypdf', 'surya'))} AS provider FROM few", "SELECT k, CASE k % 3 WHEN 0 THEN 3.5 * k WHEN 1 THEN 0.1 * k END::DOUBLE AS seconds, round(CASE k % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 0.0 ELSE 0.18 END * floor(k * 4.9) / 1000, 9)::DOUBLE AS usd FROM {few}")
def _(d):
    f = d.select("k", stats.extraction_forecast(F.col("k"), F.col("provider")).alias("f"))
    return f.select("k", F.round("f.seconds", 6).alias("seconds"), F.round("f.usd", 9).alias("usd"))


@over("ud3_providers", "SELECT k FROM few WHERE k = 1", """SELECT p AS provider, round(5 * c / 1000.0, 9)::DOUBLE AS usd, s::DOUBLE AS seconds, b AS has_batch FROM (VALUES ('pypdf', 0, 0.1, false), ('tesseract', 0, 3, false), ('tesseract_fly', 0.005, 3, false), ('paddle', 0.08, NULL, false), ('tesseract_modal', 0.14, NULL, false), ('surya', 0.18, NULL, false),
 ('chandra_runpod', 0.31, NULL, false), ('gemini', 0.66, 30, true), ('mistral', 1, 30, true), ('chandra', 3, 15, false), ('unstructured', 10, 25, false)) t(p, c, s, b)""")
def _(d):
    return stats.provider_table(d.sparkSession).withColumn("usd", F.round("usd", 9))


@over("ud2_masks", "SELECT k, CASE k % 3 WHEN 0 THEN 'alfa beta' WHEN 1 THEN 'Beta' ELSE 'gama' END AS t FROM few", "SELECT k, CASE k % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE '' END AS label FROM {few}")
def _(d):
    return d.select("k", legal.classify_event(F.col("t"), {"first": "^ALFA&BETA", "second": "=BETA"}).alias("label"))


# the archived analysis

_DOCKETS = {
    # newest first: (name, complement, date)
    0: [("LANCAMENTO INDEVIDO", "CANCELA VISTA", "3"), ("VISTA", "", "2"), ("AUTUADO", "", "1")],
    1: [("LANCAMENTO INDEVIDO", "DE 1, AUTUADO", "3"), ("VISTA", "", "2"), ("AUTUADO", "", "1")],
    2: [("LANCAMENTO INDEVIDO", "O TEOR XYZ DE 2", "4"), ("VISTA", "", "3"), ("DESPACHO", "TEOR XYZ", "2"), ("AUTUADO", "", "1")],
    3: [("LANCAMENTO INDEVIDO", "NADA DISSO", "3"), ("VISTA", "", "2"), ("AUTUADO", "", "1")],
    4: [("AUTUADO", "", "2"), ("LANCAMENTO INDEVIDO", "AUTUADO", "1")],
    5: [("VISTA", "", "1")],
}
_KEPT = {0: "AUTUADO", 1: "VISTA", 2: "VISTA,AUTUADO", 3: "AUTUADO", 4: "AUTUADO", 5: "VISTA"}


def _docket_sql(i: int) -> str:
    one = lambda e: f"named_struct('nome', '{e[0]}', 'complemento', '{e[1]}', 'data', '{e[2]}')"
    return f"array({', '.join(map(one, _DOCKETS[i]))})"


@over("wn10_retract", f"SELECT k, CASE k % 6 {' '.join(f'WHEN {i} THEN {_docket_sql(i)}' for i in _DOCKETS)} END AS e FROM few", f"SELECT k, {choose('k', tuple(_KEPT.values()))} AS kept, CASE WHEN k % 6 = 5 THEN 0 WHEN k % 6 = 4 THEN 1 ELSE 2 END AS n_removed FROM {{few}}")
def _(d):
    r = d.select("k", sequences.retract(F.col("e")).alias("r"))
    return r.select("k", F.array_join("r.kept.nome", ",").alias("kept"), F.size("r.removed").alias("n_removed"))


_ARCHIVED = (
    ("Decisão", "adotado o rito do art. 12 da lei", "art12"),
    ("PETICAO", "pede ingresso como amicus curiae", "amicus_curiae,excluidos"),
    ("Comunicado deferimento de liminar", "", "liminar_comunicada,excluidos"),
    ("Pedido de liminar", "", "excluidos"),
    ("Liminar indeferida", "", "liminar_decisao"),
    ("Rejeitado", "rejeito o pedido de medida cautelar", "liminar_decisao"),
    ("Provido", "O AG.REG. NO RE foi provido", "agravo"),
    ("Provido", "nos terceiros ED, por unanimidade", "embargo"),
    ("Autos", "nego provimento aos declaratórios", "embargo,excluidos"),
    ("Determinada a distribuição", "", "excluidos"),
    ("Vista", "", ""),
)


@over("st11_archived_labels", f"SELECT k, {choose('k', tuple(a for a, _, _ in _ARCHIVED))} AS a, {choose('k', tuple(b for _, b, _ in _ARCHIVED))} AS b FROM few", f"SELECT k, {choose('k', tuple(c for _, _, c in _ARCHIVED))} AS labels FROM {{few}}")
def _(d):
    return d.select("k", F.array_join(legal.archived_labels(F.col("a"), F.col("b")), ",").alias("labels"))


@over("st11_decision_by", f"SELECT k, {choose('k', ('Decisão do Relator', 'DECISAO DA PRESIDENCIA - Negado', 'Decisão do(a) Relator(a) - Deferido', 'Decisão da Presidência', 'Vista'))} AS a FROM few", f"SELECT k, {choose('k', ('DECISAO', 'NEGADO', 'DEFERIDO', 'DECISAO', 'VISTA'))} AS nome, {choose('k', ('RELATOR', 'PRESIDENCIA', 'RELATOR', 'PRESIDENCIA', None))} AS julgador FROM {{few}}")
def _(d):
    return d.select("k", legal.decision_by(F.col("a")).alias("r")).select("k", "r.nome", "r.julgador")


# snapshots, marks, reports


@files("df3_snapshots", "SELECT 'HC' AS classe, k AS numero, CASE WHEN k % 3 = 0 THEN 'new' ELSE name END AS relator, (SELECT max(k) FROM {few}) AS mark FROM {few}")
def _(spark, few, folder):
    table = lambda rows: spark.createDataFrame(rows, "classe string, numero int, relator string")
    assert changes.load_snapshots(spark, f"{folder.path}/s") is None and changes.load_marks(spark, f"{folder.path}/m") == (None, "")
    first, second = table([("HC", r.k, r.name) for r in few]), table([("HC", r.k, "new") for r in few if r.k % 3 == 0])
    for i, d in enumerate((first, second)):
        changes.save_snapshots(spark, d, f"{folder.path}/s")
        changes.save_marks(spark, changes.raise_marks(changes.load_marks(spark, f"{folder.path}/m")[0], d), f"{folder.path}/m", f"2024-01-0{i + 1}")
    marks, last = changes.load_marks(spark, f"{folder.path}/m")
    assert last == "2024-01-02"
    return changes.load_snapshots(spark, f"{folder.path}/s").join(marks.select("classe", F.col("max_numero").alias("mark")), "classe")


@over("sr6_daily_report", "SELECT k, name FROM few", """SELECT 1 AS part, k::BIGINT AS b, l::INT AS line, CASE l WHEN 0 THEN '### HC ' || k WHEN 1 THEN '- Rapporteur: ' || name WHEN 2 THEN '- First party: —' WHEN 3 THEN '- Events: 0' ELSE '' END AS text FROM {few}, range(0, 5) t(l)
UNION ALL SELECT 0, 0, l::INT, CASE l WHEN 0 THEN '# HC 2024-01-02' WHEN 2 THEN '**' || (SELECT count(*) FROM {few}) || ' new cases**' ELSE '' END FROM range(0, 4) t(l)
UNION ALL SELECT 2, 0, l::INT, CASE l WHEN 0 THEN '## Watched cases that changed (' || (SELECT count(*) FROM {few} WHERE k <= 5) || ')' ELSE '' END FROM range(0, 2) t(l)
UNION ALL SELECT 3, k, l::INT, CASE l WHEN 0 THEN '### HC ' || k WHEN 1 THEN '- relator: — → ' || name ELSE '' END FROM {few}, range(0, 3) t(l) WHERE k <= 5""")
def _(d):
    none = F.lit(None).cast("string")
    found = d.select(F.col("k").alias("processo_id"), F.col("name").alias("relator"), none.alias("primeiro_autor"), F.lit(None).cast("int").alias("n_andamentos"))
    changed = d.where("k <= 5").select(F.lit("HC").alias("classe"), F.col("k").alias("numero"), F.lit("relator").alias("field"), none.alias("old"), F.col("name").alias("new"), F.lit(False).alias("is_new"))
    return reports.daily(found, changed, "2024-01-02", "HC").select("part", "b", "line", "text")


# sessions and gazette


@over("pj19_session_entries", "SELECT k AS incidente, CASE k % 2 WHEN 0 THEN k END AS tema FROM few WHERE k <= 30", """
SELECT k AS incidente, i::INT AS place, CASE WHEN k % 2 = 0 AND i = 0 THEN 'tema' ELSE 'sessao' END AS tipo, CASE WHEN k % 2 = 0 AND i = 0 THEN 'Tema ' || k ELSE 'Agravo ' || (i - (k % 2 = 0)::INT) END AS title
FROM {few}, range(0, 3) t(i) WHERE k <= 30 AND i < 2 * (k % 5 <> 0)::INT + (k % 2 = 0)::INT""")  # fmt: skip
def _(d):
    def fetch(what: str, asked: DataFrame) -> DataFrame:
        v = F.col("value").cast("string")
        sitting = lambda i: F.concat(F.lit('{"objetoIncidente":{"id":'), v, F.lit(f'{i},"identificacaoCompleta":"Agravo '), F.lit(str(i)), F.lit('"}}'))
        body = {
            "tema": F.concat(F.lit('{"package":'), F.lit('{"repercussaoGeral":'), F.lit('{"processoLeadingCase":{"numeroTema":'), v, F.lit("}}}}")),
            # every fifth listing is malformed
            "oi": F.when(F.col("value") % 5 == 0, "{oops").otherwise(F.concat(F.lit("["), sitting(0), F.lit(","), sitting(1), F.lit("]"))),
            "sessaoVirtual": F.concat(F.lit('[{"objetoIncidente":{"id":'), v, F.lit(',"identificacaoCompleta":"Agravo '), F.right(v, F.lit(1)), F.lit('"},"listasJulgamento":[{"nomeLista":"L"}]}]')),
        }[what]
        return asked.withColumn("body", body)

    e = portal.session_entries(d, fetch).select("incidente", F.posexplode("fields").alias("place", "e"))
    return e.select("incidente", "place", "e.tipo", F.col("e.julgamento_item_titulo").alias("title"))


@over("pj24_gazette_entries", "SELECT k FROM few", "SELECT k AS incidente_id, i::INT AS place, 'T' || i AS titulo, CASE WHEN k % 3 <> 0 THEN 'HC' END AS classe, CASE WHEN k % 3 <> 0 THEN 1 ELSE 0 END AS n_decisoes FROM {few}, range(0, 2) t(i)")
def _(d):
    url = lambda i: F.concat(F.lit("u"), F.col("k").cast("string"), F.lit(f"-{i}"))
    listing = d.select(F.col("k").alias("incidente_id"), F.array(*[F.struct(F.lit(f"T{i}").alias("titulo"), url(i).alias("detail_url")) for i in (0, 1)]).alias("fields"))
    none, lists = F.lit(None).cast("string"), F.array().cast("array<string>")
    decision = F.array(F.struct(F.lit("ementa").alias("kind"), F.lit("t").alias("texto"), F.lit("r").alias("rtf_url")))
    fields = F.struct(F.lit("HC").alias("classe"), none.alias("procedencia"), none.alias("relator"), lists.alias("partes"), lists.alias("materia"), decision.alias("decisoes"))
    pages = d.where("k % 3 <> 0").select("k", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select(F.concat(F.lit("u"), F.col("k").cast("string"), F.lit("-"), F.col("i").cast("string")).alias("detail_url"), fields.alias("fields"))
    e = portal.gazette_entries(listing, pages).select("incidente_id", F.posexplode("fields").alias("place", "e"))
    return e.select("incidente_id", "place", "e.titulo", "e.classe", F.size("e.decisoes").alias("n_decisoes"))


@over("pj25_assembled", "SELECT k, name FROM few", "SELECT k AS incidente_id, 'HC' AS classe, name AS relator, CASE WHEN k % 2 = 0 THEN name END AS primeiro_autor, CASE WHEN k % 3 = 0 THEN 'denegado' END AS verdict, (k % 2 = 0)::INT AS n_partes, 0 AS n_sessoes FROM {few}")
def _(d):
    page = lambda html, kind, where="true": portal.extracted(d.where(where).select(F.col("k").alias("incidente_id"), html.alias("html")), kind)
    detail = page(F.concat(F.lit('<div class="processo-dados">Classe: HC</div><div class="processo-dados">Relator(a): '), "name", F.lit("</div>")), "detail")
    parties = page(F.concat(F.lit('<div id=todas-partes><p class=detalhe-parte>IMPTE.(S)</p><p class=nome-parte>'), "name", F.lit("</p></div>")), "parties", "k % 2 = 0")
    events = page(F.lit('<div class="andamento-item"><h5 class="andamento-nome">Denego a ordem</h5></div>'), "events", "k % 3 = 0")
    sessions = d.select(F.col("k").alias("incidente_id"), F.expr("cast(null as array<struct<metadata:struct<data_inicio:string,data_fim_prevista:string>,voto_relator:string>>)").alias("fields"))
    whole = portal.assembled(detail, page(F.lit(""), "info"), parties, events, sessao_virtual=sessions)
    return whole.select("incidente_id", "classe", "relator", "primeiro_autor", "outcome.verdict", F.size("partes").alias("n_partes"), F.size("sessao_virtual").alias("n_sessoes"))


@over("st2_exact_marks", f"SELECT k, {choose('k', ('Ångström  ﬁ', 'ªº ½ Ⅷ', '㎏ ＡＢＣ', 'ł đ 𝒳', None, 'Ĳssel ŉ'))} AS x FROM few", f"SELECT k, {choose('k', ('ANGSTROM FI', 'AO 12 VIII', 'KG ABC', 'X', '', 'IJSSEL N'))} AS name FROM {{few}}")
def _(d):
    return d.select("k", tx.normalize_name_exact(F.col("x")).alias("name"))


@over("st28_entities", f"SELECT k, {choose('k', ('<p>a &amp; b</p>', 'x&nbsp;&eacute;&#233;&#xE9;', '&bogus; &amp', 'no <b>marks</b>', None, '&#128512;&lt;i&gt;'))} AS x FROM few", f"SELECT k, {choose('k', ('a & b', 'x ééé', '&bogus; &amp', 'no marks', None, '😀<i>'))} AS t FROM {{few}}")
def _(d):
    return d.select("k", tx.strip_html(F.col("x")).alias("t"))


# streams and runs

_CLOCK = "'2024-01-01T' || lpad(cast(CAST(floor(event_id / 3600) AS INT) as string), 2, '0') || ':' || lpad(cast(CAST(floor(event_id % 3600 / 60) AS INT) as string), 2, '0') || ':' || lpad(cast(event_id % 60 as string), 2, '0')"
_EVENTS_LOG = f"SELECT CAST(event_id AS INT) AS id, 'fetch_meta' AS kind, 'HC' AS classe, CAST(user_id % 50 AS INT) AS processo, CAST(NULL AS STRING) AS url, CASE event_type WHEN 'error' THEN 'http_error' ELSE 'ok' END AS status, CAST(NULL AS STRING) AS error, {_CLOCK} AS ts, CAST(floor(value) AS DOUBLE) AS wall_s, 'p' || cast(event_id % 3 as string) AS pool FROM {{events}} WHERE event_id < 600"


def _stream(spark: SparkSession, sf_dir: str, query: Callable[[DataFrame], DataFrame], flush: bool = True) -> DataFrame:
    """Runs a query over the log as a stream of pieces that come in any order; a late last row lets the watermark pass."""
    folder = Folder(spark)
    rows = relation(spark, sf_dir, _EVENTS_LOG).drop("id").collect()  # 600 at most
    parts = [rows[i::4] for i in (2, 0, 3, 1)]
    for i, part in enumerate(parts):
        folder.put(f"in/{i}.json", "\n".join(json.dumps(r.asDict()) for r in part))
    if flush:
        for i in (8, 9):
            folder.put(f"in/{i}.json", json.dumps(rows[0].asDict() | {"ts": "2030-01-01T00:00:00", "pool": "end"}))
    out = f"{folder.path}/out"
    q = query(pipeline.follow(spark, f"{folder.path}/in")).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder.path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


_OF = "OVER (PARTITION BY pool ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
_STREAMED = f"""SELECT pool, ts, CASE WHEN n < 5 THEN 0 ELSE round(fr, 6) END AS fail_rate, CASE WHEN n < 10 THEN 0 ELSE list_sort(walls)[10] END AS p95_wall_s, n = 10 AND broken > 0.3 AS tripped FROM (SELECT *, count(*) {_OF} AS n, avg(CASE WHEN status <> 'ok' AND wall_s > 15 THEN 1.0 ELSE 0.0 END) {_OF} AS fr, list(wall_s) {_OF} AS walls, avg((status <> 'ok')::INT) {_OF} AS broken FROM ({plain(_EVENTS_LOG)}))"""


def _stream_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _stream(spark, sf_dir, lambda d: pipeline.regimes(d, window=10, warm=5, delay="1 hour", breaker_window=10, breaker_share=0.3))
    return got.where("pool <> 'end'").select("pool", "ts", F.round("fail_rate", 6).alias("fail_rate"), "p95_wall_s", "tripped")


def _stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _stream(spark, sf_dir, lambda d: pipeline.progress(d, "1 hour"))
    return got.where("window.start < '2029-01-01'").select(F.date_format("window.start", "HH:mm").alias("at"), "status", "n")


QUERIES |= {"sm5_stream_regimes": _stream_regimes, "sm9_stream_progress": _stream_progress}
ORACLE |= {
    "sm5_stream_regimes": _STREAMED,
    "sm9_stream_progress": f"SELECT substr(ts, 12, 5) AS at, status, count(*) AS n FROM ({plain(_EVENTS_LOG)}) GROUP BY 1, 2",
}


@files("sm1_growing_file", "SELECT k AS processo, CASE WHEN k % 2 = 0 THEN 'ok' ELSE 'empty' END AS status FROM {few}")
def _(spark, few, folder):
    line = lambda r: json.dumps({"kind": "fetch_meta", "processo": r.k, "status": "ok" if r.k % 2 == 0 else "empty"}) + "\n"
    whole = "".join(map(line, few))
    for end in (1, len(whole) // 3, len(whole) // 2, len(whole) // 2, len(whole)):  # a line is often half written
        path = folder.put("log.jsonl", whole[:end])
        take_new(spark, path, f"{folder.path}/pieces")
    return spark.read.schema(pipeline.LOG).json(f"{folder.path}/pieces").select("processo", "status")


@files("sm3_recovered_state", "SELECT k AS processo_id, CASE WHEN k % 2 = 1 THEN 'ok' ELSE 'empty' END AS status, CASE WHEN k % 2 = 1 THEN '2' ELSE '1' END AS ts FROM {few}")
def _(spark, few, folder):
    store = Store(spark, folder.path, "processo_id int, status string, ts string", ["processo_id"], ["ts"], every_records=10**9, every_seconds=1e9)
    rows = lambda some, status, ts: spark.createDataFrame([(r.k, status, ts) for r in some], "processo_id int, status string, ts string")
    store.append(rows(few, "empty", "1"))
    store.compact()
    store.append(rows(few[1::2], "http_error", "1"))
    store.append(rows(few[1::2], "ok", "2"))
    # another process, after a crash: the log is newer than the snapshot
    again = Store(spark, folder.path, "processo_id int, status string, ts string", ["processo_id"], ["ts"])
    assert again.stale()
    state = again.recover()
    assert not again.stale()
    return state


@files("sk5_store_errors", "SELECT k AS processo_id, 'http_error' AS status FROM {few} WHERE k % 3 = 1")
def _(spark, few, folder):
    clock = iter(range(0, 10_000, 4)).__next__
    store = Store(spark, folder.path, "processo_id int, status string, ts string", ["processo_id"], ["ts"], every_records=30, every_seconds=9, clock=lambda: float(clock()))
    for i in range(3):
        store.append(spark.createDataFrame([(r.k, ("ok", "http_error", "unallocated")[r.k % 3] if i == 2 else "fail", str(i)) for r in few], "processo_id int, status string, ts string"))
    assert logs.published(spark, f"{folder.path}/state") is not None  # compacted on the way
    return store.errors().select("processo_id", "status")


@files("sm4_rounds", """SELECT kind, status, count(*) AS n, sum(retry_count)::BIGINT AS retries FROM (
SELECT 'fetch_meta' AS kind, CASE WHEN k % 4 = 3 THEN 'http_error' ELSE 'ok' END AS status, CASE WHEN k % 4 = 3 THEN 2 ELSE 0 END AS retry_count FROM {few}
UNION ALL SELECT 'fetch_bytes', CASE WHEN k % 3 = 0 THEN 'empty' ELSE 'ok' END, CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END FROM {few} WHERE k % 4 <> 3
UNION ALL SELECT 'extract_text', 'ok', 0 FROM {few} WHERE k % 4 <> 3 AND k % 3 <> 0) GROUP BY 1, 2""")
def _(spark, few, folder):
    none, now = F.lit(None).cast("string"), F.lit("t").alias("ts")
    k = F.col("processo_id")
    row = lambda kind, url, status: (F.lit(kind).alias("kind"), "classe", "processo_id", url.alias("url"), status.alias("status"), none.alias("error"), now)

    def meta(tasks: DataFrame) -> DataFrame:
        done = tasks.select(*row("fetch_meta", none, F.when(k % 4 == 3, "http_error").otherwise("ok")))
        return done.unionByName(tasks.where("processo_id % 4 <> 3").select(*row("fetch_bytes", F.concat(F.lit("u"), k.cast("string")), none)))

    handlers = {
        "fetch_meta": meta,
        "fetch_bytes": lambda tasks: tasks.select(*row("fetch_bytes", F.col("url"), F.when(k % 3 == 0, "empty").otherwise("ok"))),
        "extract_text": lambda tasks: tasks.select(*row("extract_text", F.col("url"), F.lit("ok"))),
    }
    store = Store(spark, folder.path, scheduler.SCHEMA, scheduler.KEYS, ["retry_count"], every_seconds=1e9)
    targets = spark.createDataFrame([("HC", r.k) for r in few], "classe string, processo_id int")
    assert scheduler.run(store, targets, handlers, {"fetch_meta": 2}).finished
    return store.state().groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("retry_count").alias("retries"))


@files("sm8_until_stable", "SELECT 4 AS passes, 0 AS still_left, 'converged' AS why UNION ALL SELECT 2, (SELECT count(*)::INT FROM {few}), 'no progress' UNION ALL SELECT 2, (SELECT count(*) FILTER (k % 2 = 0)::INT FROM {few}), 'most passes'")
def _(spark, few, folder):
    def run(most: int, mends: Callable[[int], list]) -> tuple:
        left = [r.k for r in few]

        def recover(n: int) -> bool:
            gone = set(mends(n))
            left[:] = [k for k in left if k not in gone]
            return True

        return scheduler.until_stable(lambda: len(left), recover, most)

    numbers = [r.k for r in few]
    ends = [run(9, lambda n: numbers[: len(numbers) // 2] if n == 1 else numbers[:-1] if n == 2 else numbers), run(9, lambda n: []), run(2, lambda n: [k for k in numbers if k % 2])]
    return spark.createDataFrame([tuple(e) for e in ends], "passes int, still_left int, why string")
