"""Functions against values worked out by hand, and streaming against the batch operators."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docketry.functions import legal, rules, stats
from docketry.functions import text as tx
from docketry.operators import sequences
from docketry.sources import logs
from docketry.streaming import pipeline
from docketry.streaming.store import Store, should_compact, take_new


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "want"), [("17/08/2020 às 11:51", "2020-08-17T11:51:00"), ("20/08/2020 11:51:26", "2020-08-20T11:51:26"), ("em 20/08/2020", "2020-08-20"), ("20/13/2020", None), ("20/08/2020 25:00", None), ("", None), (None, None)])
def test_datetimes(spark, raw, want):
    assert one(spark, tx.to_iso_datetime(F.col("d")), d=raw) == want


def test_texts(spark):
    assert one(spark, tx.fold(F.col("x")), x=" Acórdãó ") == "ACORDAO" and one(spark, tx.fold(F.col("x")), x=None) == ""
    assert one(spark, tx.normalize_name_exact(F.col("x")), x="Ångström  ﬁ") == "ANGSTROM FI"
    assert one(spark, tx.strip_html(F.col("x")), x="<p>a&amp;b<br>c</p>") == "a&b c"
    assert one(spark, tx.clean_nome(F.col("x")), x=" Remessa , GUIA Nº 3/2020") == "Remessa"
    assert one(spark, tx.strip_actor(F.col("x"), "Enviado por"), x="Enviado por FULANO em 01/02/2020") == "FULANO"
    cleaned = one(spark, tx.clean_pdf_text(F.col("x")), x="A TODOS S UPREMO\nprosa com H abitual")
    assert cleaned == "A TODOS SUPREMO\nprosa com H abitual"
    assert one(spark, tx.similarity(F.col("a"), F.col("b")), a="", b="") == 1.0


def test_priority_of_rules(spark):
    assert one(spark, legal.verdict(F.col("x")), x="conheço em parte e, nesta, denego a ordem, prejudicado o agravo") == "denegado"
    assert one(spark, legal.classify_event(F.col("x"), {"first": "A", "second": "=AB"}), x="ab") == "first"
    r = lambda **k: one(spark, rules.recovery_action(*[F.col(c) for c in ("stage", "status", "error", "http_status", "url")]), **k)
    assert r(stage="extrair", status="empty", error=None, http_status=404, url="https://x" + rules.FINAL_404[0] + "1/conteudo.pdf") == "drop_terminal"
    assert r(stage="extrair", status="empty", error=None, http_status=200, url="u") == "switch_provider"
    assert r(stage="baixar", status="http_error", error="SSLEOF", http_status=500, url="u") == "replay"


def test_statistics(spark):
    lo, hi = stats.wilson(F.col("w"), F.col("n"))
    assert one(spark, F.array(F.round(lo, 4), F.round(hi, 4)), w=5, n=10) == [0.2366, 0.7634] and one(spark, F.array(lo, hi), w=0, n=0) == [0.0, 0.0]
    # Beta(2, 2): quantiles of the cubic 3x^2 - 2x^3
    x = stats.beta_quantile(0.025, 2, 2)
    assert abs(3 * x**2 - 2 * x**3 - 0.025) < 1e-9 and abs(stats.beta_quantile(0.5, 7, 7) - 0.5) < 1e-9
    g = spark.createDataFrame([(0, 0), (3, 4)], "wins int, n int")
    p = stats.posterior(g, 1.0, 1.0).orderBy("n").collect()
    assert p[0]["shrunk_rate"] == 0.5 and abs(p[0]["ci_lo"] - 0.025) < 1e-9 and abs(p[1]["shrunk_rate"] - 4 / 6) < 1e-12
    assert one(spark, stats.ocr_cost(F.col("p"), F.col("n")), p="mistral", n=500) == 1.0 and one(spark, stats.ocr_cost(F.col("p"), F.col("n")), p="?", n=5) is None
    assert one(spark, stats.ocr_wall(F.col("p"), F.col("n"), batch=True), p="mistral", n=500) == 30.0 and one(spark, stats.ocr_wall(F.col("p"), F.col("n")), p="surya", n=5) is None
    table = stats.provider_table(spark, 10, 1000)
    assert [r["provider"] for r in table.limit(3).collect()] == ["pypdf", "tesseract", "tesseract_fly"] and stats.cheapest(table).first()["provider"] == "tesseract"
    assert one(spark, stats.parsed_cost(F.col("x")), x="cost: ~$1.25  (3 MB)") == 1.25 and one(spark, stats.parsed_cost(F.col("x")), x="no") is None


@pytest.mark.parametrize("n", [1, 2, 3, 10, 37])
def test_percentiles(spark, n):
    import math
    import statistics

    rng = random.Random(n)
    groups = {g: [rng.choice([1, 2, 2, 5, 8, 13]) for _ in range(n)] for g in "ab"}
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in [*xs, None]] + [("none", None)], "g string, x int")
    wanted = {"near": ("nearest", 0.95), "floor": ("floor", 0.9), "low": ("low", 0.1), "nine": ("exclusive", 0.9), "one": ("exclusive", 0.1), "median": ("median", 0.5)}
    got = {r["g"]: r for r in stats.percentiles(rows, ["g"], "x", wanted).collect()}
    assert set(got) == {"a", "b"}
    for g, xs in groups.items():
        v = sorted(xs)
        assert (got[g]["near"], got[g]["floor"], got[g]["low"]) == (v[round(0.95 * (n - 1))], v[min(int(0.9 * n), n - 1)], v[max(int(0.1 * n) - 1, 0)])
        assert math.isclose(got[g]["median"], statistics.median(v))
        if n > 1:
            cuts = statistics.quantiles(v, n=10)
            assert math.isclose(got[g]["nine"], cuts[8], abs_tol=1e-9) and math.isclose(got[g]["one"], cuts[0], abs_tol=1e-9)
        else:
            assert got[g]["nine"] is None
    assert stats.percentiles(rows.drop("g"), [], "x", {"m": ("median", 0.5)}).first()["m"] == statistics.median(groups["a"] + groups["b"])


def test_many_anchors_and_providers(spark):
    anchors = spark.range(0, 600, 2).selectExpr("id * id AS x", "id AS y")
    rows = spark.createDataFrame([(i,) for i in (-5, 0, 1, 9, 40_000, 357_604, 400_000)] + [(None,)], "at bigint")
    small = {r["at"]: r["v"] for r in sequences.interpolate(rows, anchors, "at", "x", "y", "v").collect()}
    assert small == {r["at"]: r["v"] for r in sequences.interpolate(rows, anchors, "at", "x", "y", "v", broadcast_rows=3).collect()}
    assert small[40_000] == 200 and small[None] is None and len(small) == 8


def test_staged_functions_bind_once(spark):
    """Each step's value is computed once for a row, so a plan doesn't repeat expressions."""
    plan = spark.range(1).select(legal.classify_lawyer(F.col("id").cast("string")).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("OUTRO[AS]") <= 2 and plan.count("OAB[") <= 8
    names = ["José da Silva (12345/SP)", "O MESMO", "Silva & Advogados", "Ana, OAB/SP 148.022", None, ""]
    got = [one(spark, legal.classify_lawyer(F.col("x")), x=n) for n in names[:4]]
    assert [(g["kind"], g["key"], g["codes"]) for g in got] == [("with_oab", "JOSÉ DA SILVA", ["12345/SP"]), ("sentinel", "", []), ("juridical", "SILVA & ADVOGADOS", []), ("with_oab", "ANA, OAB/SP 148.022", ["148022/SP"])]


def test_cancelled_events(spark):
    d = spark.sql("SELECT array('Pedido de vista', 'Agravo', 'Desistência do agravo', 'Fim') AS n, array(NULL, NULL, 'Agravo', 'nada') AS c")
    assert d.select(sequences.cancel_events(F.col("n"), F.col("c")).alias("r")).first()["r"] == ["Pedido de vista"]


def test_streaming_equals_batch(spark, tmp_path):
    import json

    rows = [dict(ts=f"2024-01-01T00:{i:02d}:00", kind="fetch_meta", classe="HC", processo=i % 3, url=None, status="ok" if i % 4 else "http_error", error=None, wall_s=float(i % 40), pool=f"p{i % 2}") for i in range(60)]
    # files of any order, whose times tell nothing; the last one lets the watermark pass
    import os

    end = [rows[0] | dict(ts="2024-01-02T00:00:00", pool="end", processo=99)]
    for k, part in enumerate((rows[40:], rows[:20], rows[20:40], end, end)):
        (tmp_path / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(tmp_path / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    read = lambda: spark.readStream.schema(pipeline.LOG).option("maxFilesPerTrigger", 1).json(str(tmp_path))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = {(r["processo"]): (r["status"], r["ts"], r["retry_count"]) for r in run(pipeline.latest(pipeline.follow(spark, str(tmp_path))), "complete", "latest").collect()}
    want = {99: ("http_error", "2024-01-02T00:00:00", 1)}
    for r in rows:
        want[r["processo"]] = (r["status"], r["ts"], want.get(r["processo"], (0, 0, -1))[2] + 1)
    assert got == want
    streamed = {(r["pool"], r["ts"]): (round(r["fail_rate"], 9), r["p95_wall_s"], r["regime"]) for r in run(pipeline.regimes(read(), window=10, warm=5, delay="2 hours"), "append", "regimes").collect() if r["pool"] != "end"}
    batch = spark.createDataFrame(rows, pipeline.LOG).withColumns({"http_status": F.lit(None).cast("int"), "retries": F.lit(0)})
    expected = {(r["pool"], r["ts"]): (round(r["fail_rate"], 9), r["p95_wall_s"], r["regime"]) for r in sequences.regimes(batch, ["pool"], ["ts"], 10, 5).collect()}
    assert streamed == expected
    lines = []
    listener = pipeline.ProgressLines(lines.append)
    spark.streams.addListener(listener)
    try:
        n = run(pipeline.progress(read(), "2 hours"), "append", "progress")
        assert sum(r["n"] for r in n.collect()) == 60
        for _ in range(100):
            if any("done" in x for x in lines):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert any(x.startswith("[progress] batch 0: 20 rows") for x in lines) and any("done" in x for x in lines)


def test_stream_into_store_and_drain(spark, tmp_path):
    import json

    store = Store(spark, f"file://{tmp_path}/store", "processo int, status string, ts string", ["processo"], ["ts"], every_records=3)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/0.json").write_text("\n".join(json.dumps(dict(kind="fetch_meta", processo=i % 2, status=str(i), ts=str(i))) for i in range(4)))
    q = store.sink(pipeline.follow(spark, str(tmp_path / "in")).select("processo", "status", "ts"), f"file://{tmp_path}/checkpoint", "100 milliseconds").start()
    q.processAllAvailable()
    assert pipeline.drain(q) and not q.isActive
    assert sorted(tuple(r) for r in store.state().collect()) == [(0, "2", "2"), (1, "3", "3")] and not store.stale()
    # begun again, it goes on where it was
    (tmp_path / "in/1.json").write_text(json.dumps(dict(kind="fetch_meta", processo=1, status="late", ts="9")))
    q = store.sink(pipeline.follow(spark, str(tmp_path / "in")).select("processo", "status", "ts"), f"file://{tmp_path}/checkpoint", "100 milliseconds").start()
    q.processAllAvailable()
    pipeline.drain(q)
    assert {r["processo"]: r["status"] for r in store.recover().collect()} == {0: "2", 1: "late"} and len(store.pieces()) == 2


@pytest.mark.parametrize(("records", "seconds", "due"), [(499, 9.9, False), (500, 0, True), (0, 10, True)])
def test_compaction_thresholds(records, seconds, due):
    assert should_compact(records, seconds) is due


def test_growing_file(spark, tmp_path):
    log, pieces = tmp_path / "log.jsonl", f"file://{tmp_path}/pieces"
    take = lambda: take_new(spark, f"file://{log}", pieces)
    assert take() == 0
    log.write_text('{"a": 1}\n{"a"')
    assert take() == 9 and take() == 0
    log.write_text('{"a": 1}\n{"a": 2}\n')
    assert take() == 9
    log.write_text('{"b": 3}\n')  # begun anew
    assert take() == 9 and take() == 0
    log.write_text('{"b": 3}\n' + '{"b": "' + "x" * 200_000)
    assert take() == 0
    assert sorted(r[0] for r in spark.read.text(pieces).collect()) == ['{"a": 1}', '{"a": 2}', '{"b": 3}']


def test_scope_and_arguments():
    assert logs.scope(retry="x", sheet="y", classe="HC", first=1) == ("retry", {"path": "x"}) and logs.scope(sheet="y", classe="HC", first=1)[0] == "sheet"
    assert logs.scope(classe="HC", last=4) == ("range", {"classe": "HC", "first": 4, "last": 4})
    assert logs.scope(relator=" a, ,b") == ("filters", {"classe": None, "relator": ["a", "b"]}) and logs.scope(classe="HC") == ("filters", {"classe": "HC"})
    for bad in ({}, {"relator": " , "}, {"first": 3}):
        with pytest.raises(ValueError, match="scope"):
            logs.scope(**bad)
    for bad in (("XX", 1, 2, "json", False, ["HC"]), ("HC", 3, 2), ("HC", 1, 2, "xml"), ("HC", 1, 2, "csv", True)):
        with pytest.raises(ValueError):
            logs.valid_arguments(*bad)
    logs.valid_arguments("HC", 2, 2, "json", True, ["HC"])
