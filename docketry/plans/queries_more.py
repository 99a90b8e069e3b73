"""Further queries: readers of nested and portal data over inputs built from the tables, and plain relational ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import legal, rules, stats
from docketry.functions import text as tx
from docketry.operators import corpus, registry
from docketry.plans.inputs import CASES, DATE_BR, DOCKET, LOG, PARTES, choose, plain, relation
from docketry.plans.queries import ORACLE, QUERIES, query, query2
from docketry.sources import caches, logs, portal
from docketry.sources import cases as case_files
from docketry.streaming import pipeline

# plain relational


@query("fl1_scope", CASES, "SELECT classe, processo_id FROM {in} WHERE classe IN ('HC', 'RE') AND processo_id BETWEEN 100 AND 900")
def _(d):
    return corpus.scoped(d, ("HC", "RE"), 100, 900)


@query2("jn5_cases_partes", {"cases": CASES, "partes": PARTES}, "SELECT classe, processo_id, relator, nome FROM cases JOIN partes USING (classe, processo_id)")
def _(cases, partes):
    return corpus.with_parties(cases, partes)


@query2("jn6_exists", {"docket": DOCKET, "cases": CASES}, "SELECT processo_id, seq FROM docket d WHERE EXISTS (SELECT 1 FROM cases c WHERE c.processo_id = d.processo_id AND year(c.data_protocolo_iso) = 1996)")
def _(docket, cases):
    return corpus.events_of_year(docket, cases, 1996)


@query2("jn8_text_search", {"docket": DOCKET, "cases": CASES}, "SELECT c.classe, c.relator, count(*) AS n FROM docket d JOIN cases c USING (processo_id) WHERE lower(d.complemento) LIKE '%provimento%' GROUP BY 1, 2")
def _(docket, cases):
    return corpus.text_search(docket, cases, "provimento")


@query("fl9_replay", LOG, "SELECT DISTINCT classe, processo FROM {in} WHERE status = 'http_error' OR kind = 'fetch_bytes' AND status = 'empty'")
def _(d):
    return d.where(rules.unified_kind(F.col("kind"), F.col("status")) == "transient").select("classe", "processo").distinct()


@query("fl4_matches_fold", PARTES, "SELECT processo_id, nome FROM {in} WHERE contains(upper(strip_accents(nome)), 'JOAO') OR contains(upper(strip_accents(nome)), 'PUBLICA')")
def _(d):
    return d.where(tx.matches_fold(F.col("nome"), "joão") | tx.matches_fold(F.col("nome"), "Pública")).select("processo_id", "nome")


@query("ag13_walls", LOG, "SELECT run_dir, max(wall_s) AS slowest, round(sum(wall_s), 2) AS total, max(regexp_extract(run_dir, '([0-9]+)$', 1)::INT) AS shard FROM {in} GROUP BY 1")
def _(d):
    shard = F.regexp_extract("run_dir", "([0-9]+)$", 1).cast("int")
    return d.groupBy("run_dir").agg(F.max("wall_s").alias("slowest"), F.round(F.sum("wall_s"), 2).alias("total"), F.max(shard).alias("shard"))


@query("ag18_distinct", DOCKET, "SELECT DISTINCT link_tipo, link_url FROM {in}")
def _(d):
    return corpus.distinct_documents(d)


@query("wn13_eta", "SELECT event_id AS id, event_id % 50 AS done, CAST(value AS DOUBLE) AS elapsed FROM {events}", "SELECT id, CASE WHEN done > 0 AND elapsed > 0 THEN round((50 - done) * elapsed / done, 6) END AS eta FROM {in}")
def _(d):
    return d.select("id", F.round(stats.eta(F.col("done"), F.lit(50), F.col("elapsed")), 6).alias("eta"))


@query("dm6_costs", f"SELECT p_partkey AS id, {choose('p_partkey', ('pypdf', 'tesseract', 'mistral', 'chandra', 'unstructured', 'other'))} AS provider, p_size AS pages FROM {{part}}", """
SELECT id, round(CASE provider WHEN 'pypdf' THEN 0 WHEN 'tesseract' THEN 0 WHEN 'mistral' THEN 2 WHEN 'chandra' THEN 3 WHEN 'unstructured' THEN 10 END * pages / 1000.0, 6)::DOUBLE AS usd, round(CASE provider WHEN 'pypdf' THEN 0.1 WHEN 'tesseract' THEN 3.0 WHEN 'mistral' THEN 3.5 WHEN 'chandra' THEN 15.0 WHEN 'unstructured' THEN 25.0 END::DOUBLE * pages / 4, 6) AS seconds FROM {in}""")  # fmt: skip
def _(d):
    return d.select("id", F.round(stats.ocr_cost(F.col("provider"), F.col("pages")), 6).alias("usd"), F.round(stats.ocr_wall(F.col("provider"), F.col("pages"), 4), 6).alias("seconds"))


_OCR = f"SELECT 's' || cast(event_id % 60 as string) AS sha1, {choose('event_id', ('pypdf', 'mistral', 'chandra'))} AS provider, 'text ' || event_type || cast(event_id % 7 as string) AS text, CAST(value AS DOUBLE) AS wall_s, CAST(event_id % 9 AS INT) AS n_pages, event_id AS ts FROM {{events}}"
_GOLD = "SELECT DISTINCT 's' || cast(event_id % 60 as string) AS sha1, 'text signup' || cast(event_id % 60 % 7 as string) AS text FROM {events} WHERE event_id % 60 <> 3"


@query2("ag22_ocr_rollup", {"res": _OCR, "gold": _GOLD}, """
, l AS (SELECT sha1, provider, arg_max(text, ts) AS text, arg_max(wall_s, ts) AS wall_s, arg_max(n_pages, ts) AS n_pages FROM res GROUP BY 1, 2),
x AS (SELECT p.provider, levenshtein(l.text, g.text) / length(g.text) AS cer, CASE WHEN l.wall_s > 0 THEN l.n_pages / l.wall_s END AS pps FROM (SELECT DISTINCT sha1 FROM res) s CROSS JOIN (SELECT DISTINCT provider FROM res) p LEFT JOIN l USING (sha1, provider) LEFT JOIN gold g USING (sha1))
SELECT provider, count(cer) AS n, round(quantile_cont(cer, 0.5), 6) AS median_cer, round(avg(pps), 6) AS pages_per_s FROM x GROUP BY 1""")  # fmt: skip
def _(res, gold):
    s = corpus.ocr_rollup(corpus.ocr_scores(res, res, res, gold))
    return s.select("provider", "n", F.round("median_cer", 6).alias("median_cer"), F.round("pages_per_s", 6).alias("pages_per_s"))


@query2("so1_union_all", {"a": PARTES, "b": CASES}, "SELECT classe, processo_id FROM a UNION ALL SELECT classe, processo_id FROM b")
def _(a, b):
    return corpus.all_keys(a, b)


@query2("so2_except", {"a": "SELECT o_custkey AS id FROM {orders}", "b": "SELECT c_custkey AS id FROM {customer} WHERE c_nationkey < 12"}, "SELECT id FROM a EXCEPT SELECT id FROM b")
def _(a, b):
    return corpus.not_among(a, b)


@query("sr1_latest", CASES, "SELECT classe, processo_id FROM {in} ORDER BY data_protocolo_iso DESC, processo_id DESC LIMIT 1")
def _(d):
    return corpus.latest_case(d)


@query("sc24_request_log", LOG, "SELECT url, id, status FROM {in} WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, id DESC) <= 3")
def _(d):
    return corpus.last_requests(d, 3)


# lists and sheets


@query("sc10_candidates", f"SELECT {choose('o_orderkey', ('x', '7', '12', None, '99'))} AS n_observations, cast(o_orderkey as string) AS processo_id FROM {{orders}}", "SELECT 'HC' AS classe, processo_id::INT AS processo_id, n_observations::INT AS n_observations, n_observations::INT >= 10 AS confirmed FROM {in} WHERE n_observations NOT IN ('x') AND n_observations IS NOT NULL")
def _(d):
    return logs.candidates(d, "HC", 10)


@query("sc14_parity", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '[]' WHEN 1 THEN '' ELSE concat('[\"', c_mktsegment, '\"]') END AS numero_origem, cast(c_nationkey as string) AS volumes, CASE c_custkey % 2 WHEN 0 THEN '' ELSE c_name END AS relator FROM {customer}", """
SELECT id::VARCHAR AS id, CASE WHEN id % 3 = 2 THEN 1 END AS n, volumes::INT AS volumes, nullif(relator, '') AS relator FROM {in}""")  # fmt: skip
def _(d):
    p = logs.parity_columns(d.select(*[F.col(c).cast("string").alias(c) for c in d.columns]), ["numero_origem"], ["volumes"])
    return p.select("id", F.size("numero_origem").alias("n"), "volumes", "relator")


@query("sc19_list_lines", "SELECT CASE p_partkey % 4 WHEN 0 THEN '# note' WHEN 1 THEN '  ' || p_name || ' # x' WHEN 2 THEN '' ELSE p_brand END AS value FROM {part}", "SELECT trim(split_part(value, '#', 1)) AS item FROM {in} WHERE trim(split_part(value, '#', 1)) <> ''")
def _(d):
    return logs.list_lines(d)


@query("sc26_captured", "SELECT 'case-mini_HC_' || cast(o_orderkey * 10 as string) || '-' || cast(o_orderkey * 10 + o_custkey % 15 - 3 as string) || '.json' AS name, o_orderkey * 10 AS lo, o_orderkey * 10 + o_custkey % 15 - 3 AS hi FROM {orders}", "SELECT DISTINCT unnest(range(lo, hi + 1))::INT AS processo_id FROM {in} WHERE lo <= hi")
def _(d):
    return logs.captured(d.select("name"))


@query("st15_portal_texts", "SELECT o_orderkey AS id, ' Remessa  ' || o_orderpriority || ', GUIA Nº ' || cast(o_custkey as string) || '/2020' AS nome, 'Enviado por ' || o_orderpriority || ' em 01/02/2020' AS quem FROM {orders}", "SELECT id, 'Remessa ' || regexp_extract(nome, 'Remessa  (.*), GUIA', 1) AS nome, regexp_extract(quem, 'Enviado por (.*) em ', 1) AS quem FROM {in}")
def _(d):
    return d.select("id", tx.clean_nome(F.col("nome")).alias("nome"), tx.strip_actor(F.col("quem"), "Enviado por").alias("quem"))


@query("st4_fold", PARTES, "SELECT processo_id, trim(upper(strip_accents(nome))) AS folded FROM {in}")
def _(d):
    return d.select("processo_id", tx.fold(F.col("nome")).alias("folded"))


@query("st22_sniff", f"SELECT p_partkey AS id, {choose('p_partkey', ('%PDF-1.4 x', '{{rtf1 x', '<html>', 'PK34', '', 'plain', None))} AS head FROM {{part}}", f"SELECT id, {choose('id', ('pdf', 'unknown', 'html', 'zip', 'empty', 'unknown', 'empty'))} AS kind FROM {{in}}")
def _(d):
    return d.select("id", rules.sniff(F.encode("head", "UTF-8")).alias("kind"))


@query("st26_signals", LOG, "SELECT id, regexp_matches(lower(coalesce(error, '')), '403|500|502|503|504|5xx|auth triad|chunkedencodingerror|connectionerror|connectionreset|cookies|proxyerror|ssl|timed out|timeout') AS network FROM {in}")
def _(d):
    return d.select("id", tx.contains_any(F.col("error"), rules.NETWORK_SIGNS).alias("network"))


@query("st28_strip_html", "SELECT c_custkey AS id, '<p>' || c_name || '&amp;<br>' || c_mktsegment || '</p>' AS h FROM {customer}", "SELECT id, regexp_extract(h, '<p>([^&]*)', 1) || '& ' || regexp_extract(h, '<br>([^<]*)', 1) AS t FROM {in}")
def _(d):
    return d.select("id", tx.strip_html(F.col("h")).alias("t"))


@query("st2_normalize_name_exact", PARTES, "SELECT processo_id, upper(regexp_replace(replace(replace(strip_accents(nome), 'ª', 'a'), 'º', 'o'), '\\s+', ' ', 'g')) AS name FROM {in}")
def _(d):
    return d.select("processo_id", tx.normalize_name_exact(F.col("nome")).alias("name"))


@query("st30_primeiro_autor", PARTES, "SELECT processo_id, CASE WHEN tipo IN ('IMPTE.(S)', 'PACTE.(S)') THEN nome END AS autor FROM {in}")
def _(d):
    return d.select("processo_id", legal.primeiro_autor(F.array(F.struct(F.lit("ADV.(A/S)").alias("tipo"), F.lit("x").alias("nome")), F.struct("tipo", "nome"))).alias("autor"))


@query("sm2_latest", LOG, "SELECT kind, classe, processo, coalesce(url, '') AS url, arg_max(status, (ts, status)) AS status, max(ts) AS ts, count(*) - 1 AS retry_count FROM {in} GROUP BY 1, 2, 3, 4")
def _(d):
    return pipeline.latest(d).drop("error")


# nested case data: written as JSON, read back


def _as_cases(rows: DataFrame, **fields) -> DataFrame:
    body = F.to_json(F.struct("classe", "processo_id", *[c.alias(k) for k, c in fields.items()]))
    return case_files.cases(rows.select(F.lit("/p").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modified"), body.alias("body")))


@query("pj3_flat_partes", PARTES, "SELECT classe, processo_id, k::INT AS seq, CASE k WHEN 0 THEN tipo ELSE 'ADV.(A/S)' END AS tipo, CASE k WHEN 0 THEN nome ELSE 'x' END AS nome FROM {in}, range(0, 2) t(k)")
def _(d):
    return case_files.flat_partes(_as_cases(d, partes=F.array(F.struct("tipo", "nome"), F.struct(F.lit("ADV.(A/S)").alias("tipo"), F.lit("x").alias("nome")))))


@query("pj7_flat_pautas", f"SELECT classe, processo_id, relator, CAST(data_protocolo_iso AS string) AS day FROM ({CASES}) x", "SELECT classe, processo_id, k::INT AS seq, CASE k WHEN 0 THEN day ELSE '01/02/2020' END AS data, CASE k WHEN 0 THEN day::DATE END AS data_iso, relator AS julgador FROM {in}, range(0, 2) t(k)")
def _(d):
    one = lambda day: F.struct(day.alias("data"), F.col("relator").alias("julgador"))
    return case_files.flat_pautas(_as_cases(d, pautas=F.array(one(F.col("day")), one(F.lit("01/02/2020"))))).drop("nome", "complemento")


@query("pj8_flat_documentos", f"SELECT classe, processo_id, {choose('processo_id', ('Voto', 'Ementa'))} AS kind FROM ({CASES}) x", """
SELECT classe, processo_id, k::INT AS session_idx, 0 AS doc_seq, kind AS doc_type, CASE WHEN k = 2 THEN NULL ELSE 'http://x/' || processo_id || '.pdf' END AS url, CASE WHEN k = 2 THEN 'texto' END AS text FROM {in}, range(0, 3) t(k)""")  # fmt: skip
def _(d):
    url = F.concat(F.lit("http://x/"), F.col("processo_id").cast("string"), F.lit(".pdf"))
    listed = F.to_json(F.array(F.struct(F.col("kind").alias("tipo"), url.alias("url"))))
    objects, texts = F.to_json(F.create_map("kind", F.struct(url.alias("url")))), F.to_json(F.create_map("kind", F.lit("texto")))
    sessions = F.concat(F.lit('[{"documentos":'), listed, F.lit('},{"documentos":'), objects, F.lit('},{"documentos":'), texts, F.lit("}]"))
    rows = d.select(F.lit("/p").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modified"), F.concat(F.lit('{"classe":"'), "classe", F.lit('","processo_id":'), F.col("processo_id").cast("string"), F.lit(',"sessao_virtual":'), sessions, F.lit("}")).alias("body"))
    return case_files.flat_documentos(case_files.cases(rows)).select("classe", "processo_id", "session_idx", "doc_seq", "doc_type", "url", "text")


def _gazette(d: DataFrame) -> DataFrame:
    decisions = F.array(F.struct(F.lit("decisao").alias("kind"), F.col("relator").alias("texto"), F.struct(F.concat(F.lit("http://r/"), F.col("processo_id").cast("string")).alias("url")).alias("rtf")), F.struct(F.lit("ementa").alias("kind"), F.lit("e").alias("texto"), F.lit(None).cast("struct<url:string>").alias("rtf")))
    return _as_cases(d, publicacoes_dje=F.array(F.struct(F.lit("9").alias("numero"), F.col("data_protocolo_iso").cast("string").alias("data"), F.array("relator").alias("partes"), decisions.alias("decisoes"))))


@query("pj5_flat_publicacoes", CASES + " WHERE o_custkey % 4 <> 3", "SELECT classe, processo_id, 0 AS seq, '9' AS numero, data_protocolo_iso AS data_iso, relator AS parte, 0 AS n_materia, 2 AS n_decisoes FROM {in}")
def _(d):
    return case_files.flat_publicacoes(_gazette(d)).select("classe", "processo_id", "seq", "numero", "data_iso", F.col("partes")[0].alias("parte"), F.size("materia").alias("n_materia"), "n_decisoes")


@query("pj6_flat_decisoes", CASES, "SELECT classe, processo_id, 0 AS dje_seq, k::INT AS dec_seq, CASE k WHEN 0 THEN 'decisao' ELSE 'ementa' END AS kind, CASE k WHEN 0 THEN relator ELSE 'e' END AS texto, CASE k WHEN 0 THEN sha1('http://r/' || processo_id) END AS rtf_url_sha1 FROM {in}, range(0, 2) t(k)")
def _(d):
    return case_files.flat_decisoes(_gazette(d)).select("classe", "processo_id", "dje_seq", "dec_seq", "kind", "texto", "rtf_url_sha1")


@query("pj2_outcomes", CASES, "SELECT processo_id, outcome_verdict, CASE WHEN processo_id % 2 = 0 AND outcome_verdict IS NOT NULL THEN 'andamentos' END AS outcome_source, CASE WHEN processo_id % 2 = 0 AND outcome_verdict IS NOT NULL THEN 3 END AS outcome_source_index FROM {in}")
def _(d):
    as_object = F.to_json(F.struct(F.col("outcome_verdict").alias("verdict"), F.lit("andamentos").alias("source"), F.lit(3).alias("source_index")))
    o = F.when(F.col("outcome_verdict").isNull(), F.lit(None)).when(F.col("processo_id") % 2 == 0, as_object).otherwise(F.col("outcome_verdict"))
    return d.select("processo_id", o.alias("o")).select("processo_id", *case_files.outcome_columns(F.col("o"))).drop("outcome_date_iso")


def _state_files(d: DataFrame) -> DataFrame:
    """State files of runs, with cases and documents as maps by their keys."""
    entry = F.struct("status", "ts", "error", F.col("retries").alias("retry_count"))
    by_url = d.where("url IS NOT NULL AND kind <> 'fetch_meta'").groupBy("run_dir", "processo", "kind", "url").agg(F.max_by(entry, "ts").alias("e"))
    by_url = by_url.groupBy("run_dir", "processo").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("kind") == k, F.struct("url", "e")))).alias(k) for k in ("fetch_bytes", "extract_text")])
    meta = d.where("kind = 'fetch_meta'").groupBy("run_dir", "processo").agg(F.max_by(entry, "ts").alias("fetch_meta"))
    j = meta.join(by_url, ["run_dir", "processo"], "full")
    body = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("HC-"), F.col("processo").cast("string")), F.struct("fetch_meta", "fetch_bytes", "extract_text")))).alias("cases")))
    return j.groupBy("run_dir").agg(body.alias("body")).select(F.concat(F.lit("/runs/"), "run_dir", F.lit("/executar.state.json")).alias("path"), "body")


@query("sc7_state_urls", LOG, "SELECT run_dir, processo AS processo_id, kind AS stage, url, arg_max(status, ts) AS status, max(ts) AS ts FROM {in} WHERE url IS NOT NULL AND kind <> 'fetch_meta' GROUP BY 1, 2, 3, 4")
def _(d):
    return logs.url_observations(logs.state_cases(_state_files(d))).select("run_dir", "processo_id", "stage", "url", "status", "ts")


@query("sc8_state_meta", LOG, "SELECT run_dir, processo AS processo_id, arg_max(status, ts) AS status, max(ts) AS ts FROM {in} WHERE kind = 'fetch_meta' GROUP BY 1, 2")
def _(d):
    return logs.meta_observations(logs.state_cases(_state_files(d))).select("run_dir", "processo_id", "status", "ts")


# portal pages


def _pages(name: str, sql: str, kind: str, oracle: str, pick) -> None:
    @query(name, sql, oracle)
    def _(d):
        return pick(portal.extracted(d, kind))


_pages("pj20_detail", "SELECT o_orderkey AS id, '<input id=\"incidente\" value=\"' || cast(o_custkey as string) || '\"><span class=\"badge bg-danger\">Réu Preso</span><span class=\"badge\">Processo Físico</span><div class=\"processo-dados\">Classe: HC</div><div class=\"processo-dados\">Relator(a): MIN. ' || o_orderpriority || '</div>' AS html, o_custkey, o_orderpriority FROM {orders}", "detail",
       "SELECT id, o_custkey::INT AS incidente, 'HC' AS classe, regexp_replace(o_orderpriority, '\\s+', ' ', 'g') AS relator, 'FISICO' AS meio, 'Réu Preso' AS badge FROM {in}", lambda d: d.select("id", "fields.incidente", "fields.classe", "fields.relator", "fields.meio", F.col("fields.badges")[0].alias("badge")))
_pages("pj20_info", f"SELECT o_orderkey AS id, '<ul><li>' || o_orderpriority || '</li></ul><div class=\"processo-detalhes-bold\">Data de Protocolo:</div><div>' || {DATE_BR.format('o_orderdate')} || '</div><div class=\"processo-quadro\"><div class=\"numero\">' || cast(o_custkey % 9 as string) || '</div><div class=\"rotulo\">Folhas</div></div>' AS html, o_custkey, o_orderdate, o_orderpriority FROM {{orders}}", "info",
       "SELECT id, o_orderpriority AS assunto, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS data_protocolo, (o_custkey % 9)::INT AS folhas FROM {in}", lambda d: d.select("id", F.col("fields.assuntos")[0].alias("assunto"), "fields.data_protocolo", "fields.folhas"))
_pages("pj21_events", f"SELECT o_orderkey AS id, '<div class=\"andamento-item\"><div class=\"andamento-data\">' || {DATE_BR.format('o_orderdate')} || '</div><h5 class=\"andamento-nome\">Decisão ' || o_orderstatus || '</h5><a href=\"p.asp?id=' || cast(o_custkey as string) || '\">Despacho</a></div><div class=\"andamento-item\"><h5 class=\"andamento-nome\">Autuado</h5></div>' AS html, o_custkey, o_orderdate, o_orderstatus FROM {{orders}}", "events",
       "SELECT id, 2 AS idx, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS data, 'DECISÃO ' || o_orderstatus AS nome, 'DESPACHO' AS tipo, 'https://portal.stf.jus.br/processos/p.asp?id=' || o_custkey AS url FROM {in} UNION ALL SELECT id, 1, NULL, 'AUTUADO', NULL, NULL FROM {in}",
       lambda d: d.select("id", F.explode("fields").alias("e")).select("id", F.col("e.index").alias("idx"), "e.data", "e.nome", "e.link.tipo", "e.link.url"))
_pages("pj22_gazette_listing", f"SELECT o_orderkey AS id, '<strong>DJ Nr. ' || cast(o_custkey as string) || ' do dia ' || {DATE_BR.format('o_orderdate')} || '</strong><strong>Sec</strong><a onclick=\"abreDetalheDiarioProcesso(1, ''01/01/2020'', ' || cast(o_orderkey as string) || ', 2, 3, 4)\">T</a>' AS html, o_custkey, o_orderdate FROM {{orders}}".replace("''01/01/2020''", "' || chr(39) || '01/01/2020' || chr(39) || '"), "gazette_listing",
       "SELECT id, o_custkey::INT AS numero, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS data, 'Sec' AS secao, '' AS subsecao, id::INT AS incidente_linked FROM {in}", lambda d: d.select("id", F.explode("fields").alias("e")).select("id", "e.numero", "e.data", "e.secao", "e.subsecao", "e.incidente_linked"))
_pages("pj23_gazette_detail", "SELECT o_orderkey AS id, '<dl><dt>Partes:</dt><dd><ul><li>' || o_orderpriority || '</li></ul></dd><dt> Classe:</dt><dd>' || o_orderstatus || '</dd></dl> <div id=\"andamentos\"><p>EMENTA: ' || o_orderstatus || '</p><p class=\"text-right\"><a href=\"u' || cast(o_custkey as string) || '\">RTF</a></p></div>' AS html, o_custkey, o_orderstatus, o_orderpriority FROM {orders}", "gazette_detail",
       "SELECT id, o_orderstatus AS classe, o_orderpriority AS parte, 'ementa' AS kind, 'EMENTA: ' || o_orderstatus AS texto, 'u' || o_custkey AS rtf_url FROM {in}", lambda d: d.select("id", "fields.classe", F.col("fields.partes")[0].alias("parte"), F.explode("fields.decisoes").alias("x")).select("id", "classe", "parte", "x.kind", "x.texto", "x.rtf_url"))


def _sittings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = relation(spark, sf_dir, f"SELECT o_orderkey AS id, o_orderpriority, {DATE_BR.format('o_orderdate')} AS day, {choose('o_custkey', ('7', '8', '9', '3'))} AS code FROM {{orders}}")
    name = lambda c: F.struct(c.alias("descricao"))
    vote = F.struct(F.struct(F.col("code").alias("codigo")).alias("tipoVoto"), name(F.lit("M")).alias("ministro"), F.array(F.struct(F.lit("v.pdf").alias("link"))).alias("textos"))
    sitting = F.struct(F.lit("<b>x</b>").alias("cabecalho"), name(F.col("o_orderpriority")).alias("ministroRelator"), F.struct(F.col("day").alias("dataInicio")).alias("sessao"), F.array(vote).alias("votos"))
    body = F.to_json(F.array(F.struct(F.struct("id", F.lit("Agravo").alias("identificacaoCompleta")).alias("objetoIncidente"), F.array(sitting).alias("listasJulgamento"))))
    s = portal.sittings(d.select("id", body.alias("body")))
    n = lambda k: F.size(f"votes.{k}").alias(k)
    return s.select("id", "metadata.relator", "metadata.data_inicio", n("diverge_relator"), n("acompanha_divergencia"), n("acompanha_relator"), F.col("documentos")[0]["tipo"].alias("tipo"), "voto_relator", "julgamento_item_titulo")


QUERIES["pj18_sittings"] = _sittings
ORACLE["pj18_sittings"] = plain(
    "SELECT o_orderkey AS id, o_orderpriority AS relator, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS data_inicio, (o_custkey % 4 = 0)::INT AS diverge_relator, (o_custkey % 4 = 1)::INT AS acompanha_divergencia, (o_custkey % 4 = 2)::INT AS acompanha_relator, 'Voto' AS tipo, 'x' AS voto_relator, 'Agravo' AS julgamento_item_titulo FROM {orders}"
)


# joins with sidecars, counts of documents


@query2("sc6_resolve", {"docket": f"SELECT processo_id, seq, link_url, CASE WHEN link_url IS NOT NULL THEN sha1(link_url) END AS link_url_sha1, complemento AS link_text, 'old' AS link_extractor FROM ({DOCKET}) x", "pdfs": "SELECT sha1('https://portal.example/' || cast(p_partkey as string) || '.pdf') AS sha1, p_name AS text FROM {part} WHERE p_partkey % 3 <> 0", "side": "SELECT sha1('https://portal.example/' || cast(p_partkey as string) || '.pdf') AS sha1, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS extractor FROM {part} WHERE p_partkey % 2 = 0"}, """
SELECT d.processo_id, d.seq, coalesce(p.text, d.link_text) AS link_text, CASE WHEN s.sha1 IS NOT NULL THEN s.extractor ELSE d.link_extractor END AS link_extractor FROM docket d LEFT JOIN pdfs p ON p.sha1 = d.link_url_sha1 LEFT JOIN side s ON s.sha1 = d.link_url_sha1""")  # fmt: skip
def _(docket, pdfs, side):
    return caches.resolve(docket, pdfs, side, "link_", "link_url_sha1").select("processo_id", "seq", "link_text", "link_extractor")


@query2("jn17_document_types", {"a": f"SELECT link_url, link_tipo FROM ({DOCKET}) x", "b": f"SELECT 'https://portal.example/' || cast(p_partkey as string) || '.pdf' AS url, {choose('p_partkey', ('Voto', None, 'Ementa'))} AS doc_type FROM {{part}}"}, """
SELECT url, arg_min(t, (p, t)) AS doc_type FROM (SELECT link_url AS url, link_tipo AS t, 1 AS p FROM a WHERE link_url IS NOT NULL UNION ALL SELECT url, doc_type, 2 FROM b) WHERE t IS NOT NULL GROUP BY 1""")  # fmt: skip
def _(a, b):
    return registry.document_types(a, b)


@query2("jn18_fill_in", {"meta": f"SELECT processo AS processo_id, status, CASE WHEN id % 3 = 0 THEN id % 9 END AS n_pecas FROM ({LOG}) x WHERE kind = 'fetch_meta'", "side": "SELECT CAST(user_id AS INT) AS processo_id, CAST(max(event_id) % 100 AS INT) AS known FROM {events} GROUP BY 1"}, "SELECT processo_id, status, coalesce(n_pecas, known) AS n_pecas FROM meta LEFT JOIN side USING (processo_id)")
def _(meta, side):
    return meta.join(side, "processo_id", "left").select("processo_id", "status", F.coalesce("n_pecas", "known").alias("n_pecas"))


@query("pj26_n_pecas", DOCKET, "SELECT processo_id, count(DISTINCT link_url) AS n_pecas FROM {in} WHERE link_url IS NOT NULL AND coalesce(link_tipo, '') NOT IN ('CERTIDÃO', 'certidao', 'OUTRAS PEÇAS') GROUP BY 1")
def _(d):
    kept = d.where(F.col("link_url").isNotNull() & legal.keeps(F.col("link_tipo")))
    return kept.groupBy("processo_id").agg(F.count_distinct("link_url").alias("n_pecas"))


@query("sr5_providers", f"SELECT {choose('p_partkey', ('pypdf', 'mistral', 'unknown', 'chandra'))} AS provider, p_size AS pages, p_partkey AS id FROM {{part}}", "SELECT provider, round(min(CASE provider WHEN 'pypdf' THEN 0.0 WHEN 'mistral' THEN 2.0 WHEN 'chandra' THEN 3.0 END::DOUBLE * pages / 1000), 6) AS cheapest FROM {in} GROUP BY 1 ORDER BY cheapest NULLS LAST, provider")
def _(d):
    g = d.groupBy("provider").agg(F.round(F.min(stats.ocr_cost(F.col("provider"), F.col("pages"))), 6).alias("cheapest"))
    return g.orderBy(F.col("cheapest").asc_nulls_last(), "provider")


@query("ru7_non_ok", LOG, "SELECT kind, classe, processo, url, status, retries FROM {in} WHERE status NOT IN ('ok', 'skipped_cached')")
def _(d):
    return d.where(rules.unified_kind(F.col("kind"), F.col("status")) != "ok").select("kind", "classe", "processo", "url", "status", "retries")


@query("so4_outcome_partition", CASES, "SELECT outcome_verdict, outcome_verdict IN ('concedido', 'concedido_parcial', 'procedente', 'procedente_parcial', 'provido', 'provido_parcial') AS favourable, count(*) AS n FROM {in} WHERE outcome_verdict IS NOT NULL GROUP BY 1, 2")
def _(d):
    return d.where("outcome_verdict IS NOT NULL").groupBy("outcome_verdict", legal.won(F.col("outcome_verdict")).alias("favourable")).agg(F.count(F.lit(1)).alias("n"))
