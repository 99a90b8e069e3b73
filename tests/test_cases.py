"""Case files of all shapes, caches, state files, logs and the warehouse as a whole."""

import gzip
import hashlib
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from docketry.operators import registry
from docketry.plans import warehouse
from docketry.sources import caches, cases, logs


def sha(s):
    return hashlib.sha1(s.encode()).hexdigest()


CASE = {
    **dict(classe="HC", processo_id=1), "incidente": "77", "badges": ["a", 1, None], "data_protocolo": "03/02/2020", "volumes": "x", "outcome": dict(verdict="denegado", source="andamentos", source_index=3, date_iso="2021-01-02"),
    "_meta": dict(schema_version=8, status_http=200, extraido="2024-01-02T03:04:05"),
    "partes": [dict(tipo="IMPTE.(S)", nome="Ana Souza", index=1), dict(nome="Bob", tipo="PACTE.(S)")],
    "andamentos": [
        dict(data="2020-05-06", nome="Decisão", complemento="Denego a ordem", link=dict(text="inline", url="http://x/1.pdf", tipo="DESPACHO"), index=2),
        dict(data="31/02/2020", nome="Outro", link_descricao="CERTIDÃO", link="http://x/2.pdf", index=1),
        dict(data="05/06/2020 10:00", nome="Sem link", link=None),
    ],
    "pautas": [{"data": "2020-01-01", "nome": "P"}, {"data": "01/01/2020", "nome": "Q"}],
    "sessao_virtual": [
        {"documentos": {"Voto": "http://x/3.pdf", "Ementa": "texto da ementa", "Relatório": {"url": "http://x/4.pdf", "text": None}}},
        "junk",
        dict(documentos=[dict(url="http://x/5.pdf", tipo="Voto"), 7, dict(text="t", tipo="Voto", url=None)]),
        {"documentos": 5},
    ],
    "publicacoes_dje": ["junk", dict(numero="10", data="2020-02-02", classe="HC", partes=["A"], decisoes=[dict(texto="t", rtf=dict(tipo=None, url="http://x/servicos/dje/verDecisao.asp?n=1"), kind="decisao"), "no", dict(rtf="bad", kind="ementa")])],
}
OLD = {"classe": "HC", "processo_id": "2", "schema_version": 3, "status": 200, "outcome": "concedido", "data_protocolo": "10/11/2019", "data_protocolo_iso": None, "relator": "MIN. X", "andamentos": [{"index_num": "4", "data": "01/02/2020", "nome": "Concedo a ordem", "link": "http://x/1.pdf"}], "partes": [{"tipo": "AUTOR(A/S)", "nome": "Zé"}]}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("cases")
    (root / "HC").mkdir()
    (root / "RE").mkdir()
    (root / "HC/case-mini_HC_1-1.json").write_text(json.dumps([CASE, {"classe": "HC", "processo_id": 99}]))
    (root / "HC/case-mini_HC_2-2.json").write_text(json.dumps(OLD))
    (root / "RE/case-mini_RE_50-60.json").write_text(json.dumps(dict(processo_id=55, classe="RE")))
    (root / "RE/other.json").write_text("{}")
    return str(root)


@pytest.fixture(scope="module")
def parsed(spark, corpus):
    return cases.cases(cases.scan(spark, corpus)).cache()


def test_scan_scopes(spark, corpus):
    n = lambda **k: cases.scan(spark, corpus, **k).count()
    assert (n(), n(classes=["HC"]), n(id_range=(1, 1)), n(id_range=(2, 100)), n(id_range=(55, 60))) == (3, 2, 1, 2, 0)


def test_records(spark):
    files = spark.createDataFrame([("a", '[{"classe":"X","processo_id":1},{"classe":"Y","processo_id":2},3]'), ("b", '{"classe":"Z"}'), ("c", "[]"), ("d", "7")], "path string, body string").withColumn("modified", F.current_timestamp())
    assert sorted(r[0] for r in cases.cases(files).select("c.classe").collect()) == ["X", "Z"]
    broken = files.union(spark.createDataFrame([("e", "{oops")], "path string, body string").withColumn("modified", F.current_timestamp()))
    assert sorted(r[0] for r in cases.cases(broken, every_record=True).select("c.classe").collect()) == ["X", "Y", "Z"]
    with pytest.raises(Exception, match="(?i)malformed"):
        cases.cases(broken).collect()


def test_flat_cases(parsed):
    rows = {r["processo_id"]: r for r in cases.flat_cases(parsed).collect()}
    one, two, re = rows[1], rows[2], rows[55]
    assert (one["incidente"], one["volumes"], one["badges"], str(one["data_protocolo_iso"])) == (77, None, ["a", "1", None], "2020-02-03")
    assert (one["outcome_verdict"], one["outcome_source_index"], str(one["outcome_date_iso"]), one["schema_version"]) == ("denegado", 3, "2021-01-02", 8)
    assert (two["outcome_verdict"], two["outcome_source"], two["schema_version"], two["status_http"], str(two["data_protocolo_iso"])) == ("concedido", None, 3, 200, "2019-11-10")
    assert (re["schema_version"], re["badges"], re["outcome_verdict"], re["status_http"]) == (1, [], None, None)


def test_flat_children(parsed):
    a = {(r["processo_id"], r["seq"]): r for r in cases.flat_andamentos(parsed).collect()}
    assert (a[1, 0]["link_url"], a[1, 0]["link_tipo"], a[1, 0]["link_text"], a[1, 0]["link_url_sha1"]) == ("http://x/1.pdf", "DESPACHO", "inline", sha("http://x/1.pdf"))
    assert (a[1, 1]["link_url"], a[1, 1]["data_iso"]) == (None, None)
    assert str(a[1, 2]["data_iso"]) == "2020-06-05"
    assert [(r["seq"], str(r["data_iso"])) for r in cases.flat_pautas(parsed).orderBy("seq").collect()] == [(0, "2020-01-01"), (1, "None")]
    d = [tuple(r) for r in cases.flat_documentos(parsed).orderBy("session_idx", "doc_seq").select("session_idx", "doc_seq", "doc_type", "url", "text").collect()]
    assert d == [(0, 0, "Voto", "http://x/3.pdf", None), (0, 1, "Ementa", None, "texto da ementa"), (0, 2, "Relatório", "http://x/4.pdf", None), (2, 0, "Voto", "http://x/5.pdf", None), (2, 1, "Voto", None, "t")]
    p = cases.flat_publicacoes(parsed).collect()
    assert [(r["seq"], r["n_decisoes"], r["partes"], r["materia"], str(r["data_iso"])) for r in p] == [(1, 3, ["A"], [], "2020-02-02")]
    assert [(r["dje_seq"], r["dec_seq"], r["kind"], r["rtf_url"] is None) for r in cases.flat_decisoes(parsed).orderBy("dec_seq").collect()] == [(1, 0, "decisao", False), (1, 2, "ementa", True)]
    assert cases.flat_partes(parsed).count() == 3


def test_targets(parsed):
    t = {r["url"]: (r["processo_id"], r["doc_type"], r["surface"]) for r in cases.targets(parsed).collect()}
    assert t["http://x/1.pdf"] == (1, "DESPACHO", "andamento") and t["http://x/2.pdf"] == (1, "CERTIDÃO", "andamento")
    assert t["http://x/3.pdf"][2] == "sessao_virtual" and t["http://x/servicos/dje/verDecisao.asp?n=1"] == (1, "decisao", "dje") and len(t) == 6
    assert {r["url"] for r in cases.targets(parsed, relator=["min. x"]).collect()} == {"http://x/1.pdf"}
    assert cases.targets(parsed, impte=["souza"]).count() == 6 and cases.targets(parsed, impte=["nobody"]).count() == 0
    assert "http://x/2.pdf" not in {r["url"] for r in cases.targets(parsed, exclude=["CERTIDÃO"]).collect()}


def test_reshape(parsed):
    rows = {r["processo_id"]: r.asDict(True) for r in cases.reshape(parsed, F.lit("NOW")).collect()}
    assert rows[2]["_meta"] == dict(extraido="NOW", schema_version=8, status_http=200) and rows[2]["data_protocolo"] == "2019-11-10"
    assert rows[2]["outcome"] == dict(date_iso="2020-02-01", source="andamentos", source_index=4, verdict="concedido")
    assert rows[2]["andamentos"][0]["link"] == {"tipo": None, "url": "http://x/1.pdf", "text": None, "extractor": None}
    assert rows[2]["primeiro_autor"] == "Zé" and rows[1]["primeiro_autor"] == "Ana Souza"
    assert rows[1]["outcome"]["source_index"] == 3 and rows[55]["outcome"] is None and rows[55]["andamentos"] == []
    assert rows[1]["andamentos"][1]["data"] == "2020-02-31"


@pytest.fixture(scope="module")
def cache(tmp_path_factory):
    root = tmp_path_factory.mktemp("cache")
    s = sha("http://x/1.pdf")
    zipped = {f"{s}.txt": "olá\nmundo", f"{s}.elements.json": "[]", f"{s}.pdf": "%PDF-1.4 ... %%EOF", "cut.pdf": "%PDF-1.4 ...", "html.rtf": "<html>", "none.pdf": ""}
    for name, body in zipped.items():
        (root / f"{name}.gz").write_bytes(gzip.compress(body.encode()))
    plain = {f"{s}.extractor": " pypdf \n", f"{s}.dismissed.json": json.dumps(dict(reason="r", dismissed_at="t")), "bad.dismissed.json": "{", "raw.pdf.gz": "%PDF"}
    for name, body in plain.items():
        (root / name).write_text(body)
    return str(root)


def test_caches(spark, cache, tmp_path):
    s = sha("http://x/1.pdf")
    assert [(r["sha1"], r["n_chars"], r["has_elements"], r["text"]) for r in caches.texts(spark, cache).collect()] == [(s, 9, True, "olá\nmundo")]
    assert caches.texts(spark, cache, spark.createDataFrame([("zz",)], "sha1 string")).count() == 0
    assert [tuple(r) for r in caches.extractors(spark, cache).collect()] == [(s, "pypdf")]
    assert [tuple(r) for r in caches.dismissals(spark, cache).collect()] == [(s, "t", "r")]
    assert {r[0] for r in caches.on_disk(spark, cache, "pdf").collect()} == {s, "cut", "raw", "none"}
    assert {r[0]: r[1] for r in caches.integrity(spark, cache).collect()} == {s: "ok", "cut": "truncated", "raw": "gzip_error", "html": "bad_magic", "none": "empty"}
    page = tmp_path / "p.html"
    page.write_text("<b>x</b>")
    with tarfile.open(tmp_path / "1.tar.gz", "w:gz") as t:
        t.add(page, "detalhe.html")
    assert [(r["tab"], r["html"]) for r in caches.html_archives(spark, str(tmp_path)).collect()] == [("detalhe.html", "<b>x</b>")]


def test_rtf():
    read = lambda s: caches.rtf_text(s.encode("latin-1"))
    assert read(r"{\rtf1\ansi\deff0 {\fonttbl{\f0 A;}}{\colortbl;\red0;}a\tab b\line c{\b d} e\~f\_g}") == "a\tb\ncd e\xa0f-g"
    assert read(r"{\rtf1 \uc2\u960 xyz \uc0\u-10179\u-8704 .}") == "πz 😀."
    assert read(r"{\rtf1 {\pict\bin4 }}}}x}y}") == "y" and read("no rtf \\") == "no rtf \\" and read("") == ""
    assert read(r"{\rtf1 \'80 \'e7}") == "€ ç"


def put(folder, body):
    folder.mkdir()
    (folder / logs.STATE_FILES[1]).write_text(body)


@pytest.fixture(scope="module")
def runs(tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    e = lambda status, ts, **k: {"status": status, "ts": ts, **k}
    for name, state in {
        "a": {"cases": {"HC-1": {"fetch_meta": e("ok", "2024-01-01", n_pecas=2), "fetch_bytes": {"http://x/1.pdf": e("http_error", "2024-01-01"), "http://x/9.pdf": "junk"}}, "HC-x": {"fetch_meta": e("ok", "t")}, "HC-7": {"fetch_meta": e("unallocated_pid", "2024-01-01")}}},
        "b": {"cases": {"HC-1": {"fetch_bytes": {"http://x/1.pdf": e("ok", "2024-02-01")}, "extract_text": {"http://x/1.pdf": e("empty", "", extractor="pypdf")}}, "HC-7": {"fetch_meta": e("unallocated_pid", "2024-03-01", error="none")}}},
    }.items():
        put(root / name, json.dumps(state))
    put(root / "c", '{"cases": ')
    return str(root)


def test_registries(spark, runs, cache):
    states = logs.state_cases(logs.read_states(spark, runs)).cache()
    assert {(r["run_dir"], r["processo_id"]) for r in states.collect()} == {("a", 1), ("a", 7), ("b", 1), ("b", 7)}
    urls = logs.url_observations(states)
    assert sorted((r["status"], r["ts"]) for r in urls.collect()) == [("empty", ""), ("http_error", "2024-01-01"), ("ok", "2024-02-01")]
    types = spark.createDataFrame([("http://x/1.pdf", "DESPACHO")], "url string, doc_type string")
    p = registry.peca_issues(urls, caches.extractors(spark, cache), caches.dismissals(spark, cache), types, caches.texts(spark, cache)).collect()
    assert [(r["latest_status"], r["n_attempts_seen"], r["first_seen_at"], r["last_seen_at"], r["last_run_dir"], r["latest_extractor"], r["is_suspicious_short"], r["dismissed_reason"]) for r in p] == [("ok", 3, "2024-01-01", "2024-02-01", "b", "pypdf", True, "r")]
    meta = logs.meta_observations(states)
    assert [(r["processo_id"], r["latest_error"], r["n_attempts_seen"]) for r in registry.case_issues(meta).collect()] == [(7, "none", 2)]
    assert [tuple(r) for r in registry.unallocated(meta).collect()] == [("HC", 7, 2, True)]


def test_warehouse(spark, corpus, cache, runs, tmp_path):
    version, rates = warehouse.build(spark, corpus, str(tmp_path), cache, runs)
    assert logs.open_published(spark, str(tmp_path)) == version
    t = warehouse.open_tables(spark, version, views=True)
    m = spark.sql("SELECT * FROM manifest").first()
    assert (m["n_cases"], m["classes"], m["n_partes"], m["n_documentos"], m["n_pdfs"], m["n_unallocated"], m["commit"]) == (3, ["HC", "RE"], 3, 5, 1, 1, None) and m["build_wall_s"] > 0
    assert {r["sha1"] for r in spark.sql("SELECT sha1 FROM orphan_cache_files WHERE kind = 'bytes_only'").collect()} == {sha("http://x/1.pdf"), "cut", "raw", "none"} - {r["sha1"] for r in t["pdfs_substantive"].collect()}
    assert spark.table("missing_text").count() == spark.table("pdfs_substantive").where("sha1 NOT IN (SELECT sha1 FROM disk_txt)").count()
    assert spark.sql("SELECT is_suspicious_short(5, 'despacho'), is_suspicious_short(5, 'CERTIDÃO'), is_suspicious_short(NULL, 'Voto')").first() == (True, False, None)
    assert not list(tmp_path.glob(".parsed-*"))
    assert {r["link_text"] for r in t["andamentos"].where(F.col("link_url") == "http://x/1.pdf").collect()} == {"olá\nmundo"}
    assert {r["field"]: r["ok"] for r in rates.collect()} == {"partes": False, "andamentos": False, "pautas": True, "publicacoes_dje": True, "sessao_virtual": True}
    again, _ = warehouse.build(spark, corpus, str(tmp_path), cache, runs)
    assert logs.open_published(spark, str(tmp_path)) == again != version
    with pytest.raises(warehouse.ValidationError, match="partes"):
        warehouse.build(spark, corpus, str(tmp_path / "s"), strict=True)
    assert warehouse.tables(spark, corpus, cache, classes=["HC"])["pdfs"].count() == 0


def test_logs(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    row = lambda kind, status, **more: json.dumps(dict(status=status, kind=kind, classe="HC", processo=1, **more))
    p.write_text("\n".join([row("fetch_meta", "http_error"), "", row("fetch_meta", "ok"), row("fetch_bytes", "ok", url="u", doc_type="D"), row("fetch_bytes", "empty", url="u"), '{"half']))
    with pytest.raises(Exception, match="(?i)malformed"):
        logs.read_jsonl(spark, str(p)).collect()
    rows = logs.read_jsonl(spark, str(p), strict=False)
    assert rows.count() == 4
    got = {(r["kind"], r["url"]): (r["status"], r["doc_type"], r["retry_count"]) for r in logs.recover_state(rows.limit(0).withColumn("retry_count", F.lit(0)), rows).collect()}
    assert got == {("fetch_meta", None): ("ok", None, 1), ("fetch_bytes", "u"): ("empty", "D", 1)}


def test_sheets(spark, tmp_path):
    (tmp_path / "t.csv").write_text("classe,processo,source\nHC,1,a\n,,\nRE,2,b\n")
    assert [tuple(r) for r in logs.read_targets(spark, str(tmp_path / "t.csv")).collect()] == [("HC", 1, "a"), ("RE", 2, "b")]
    (tmp_path / "u.csv").write_text("classe,x\nHC,1\n")
    with pytest.raises(ValueError, match="processo"):
        logs.read_targets(spark, str(tmp_path / "u.csv"))
    sheet = spark.createDataFrame([("5", "2"), ("x", "1"), ("6", "1")], "processo_id string, n_observations string")
    assert sorted(tuple(r) for r in logs.candidates(sheet, "HC").collect()) == [("HC", 5, 2, True), ("HC", 6, 1, False)]
    assert logs.candidates(sheet.drop("processo_id"), "HC").count() == 0
    lines = spark.createDataFrame([("# c",), ("HC 12 # x",), ("re-7",), ("",)], "value string")
    assert [tuple(r) for r in logs.watch_list(lines).collect()] == [("HC", 12), ("RE", 7)]
    with pytest.raises(Exception, match="not a case"):
        logs.watch_list(spark.createDataFrame([("HC",)], "value string")).collect()
    names = spark.createDataFrame([("case-mini_HC_3-5.json",), ("case-mini_HC_9-8.json",), ("x",)], "name string")
    assert sorted(r[0] for r in logs.captured(names).collect()) == [3, 4, 5]
    parity = spark.createDataFrame([('["a"]', "[]", "7", "")], "assuntos string, numero_origem string, volumes string, relator string")
    r = logs.parity_columns(parity, ["assuntos", "numero_origem"], ["volumes"]).first()
    assert (r["assuntos"], r["numero_origem"], r["volumes"], r["relator"]) == (["a"], None, 7, None)
    logs.export(parity, str(tmp_path / "out"), "all")
    logs.export(parity, str(tmp_path / "out"), "jsonl")
    assert spark.read.json(str(tmp_path / "out/jsonl")).count() == 2 and spark.read.json(str(tmp_path / "out/json")).count() == 1


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_case_is_parsed_once(spark):
    one = spark.createDataFrame([(1, '{"classe":"HC","processo_id":1,"outcome":"x"}'), (2, "[7]")], "k int, body string")
    made = one.select(F.lit("/p").alias("path"), F.current_timestamp().alias("modified"), F.concat(F.lit(" "), "body").alias("body"))
    for read in (cases.flat_cases, cases.flat_andamentos, cases.flat_decisoes, cases.targets, cases.reshape):
        d = read(cases.cases(made))
        assert _plan(d).count("parseJson(") == 1 and "Filter isnotnull(CASE" not in _plan(d) and "(size(from_json" not in _plan(d), read.__name__
    assert cases.flat_cases(cases.cases(made)).count() == 1


def test_a_link_is_parsed_once(spark):
    text = '{"classe":"HC","processo_id":1,"andamentos":[{"link":{"url":"http://x/1.pdf","tipo":"T"}}]}'
    parsed = cases.cases(spark.createDataFrame([("/p", text)], "path string, body string").withColumn("modified", F.current_timestamp()))
    d = cases.flat_andamentos(parsed).select("link_tipo", "link_url", "link_url_sha1", "link_text", "link_extractor")
    assert _plan(d).count("from_json(") == 2  # the case, the link
    assert [tuple(r) for r in d.collect()] == [("T", "http://x/1.pdf", sha("http://x/1.pdf"), None, None)]


def test_events_after_the_first_verdict_are_unread(spark):
    text = {"classe": "HC", "processo_id": 1, "outcome": "x", "andamentos": [{"nome": "Nada"}, {"nome": "Denego a ordem", "index": 7}, {"nome": "Concedo a ordem", "index": 8}]}
    d = cases.reshape(cases.cases(spark.createDataFrame([("/p", json.dumps(text))], "path string, body string").withColumn("modified", F.current_timestamp())))
    assert "aggregate(" in _plan(d.select("outcome"))
    assert tuple(d.first()["outcome"]) == ("denegado", "andamentos", 7, None)
