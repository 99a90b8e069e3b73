"""One query for each operator over the test tables, with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import legal, rules, stats
from docketry.functions import text as tx
from docketry.operators import changes, corpus, registry, sequences
from docketry.plans.inputs import CASES, DATE_BR, DATE_ISO, DOCKET, LOG, PARTES, PARTIES, VERDICT_TEXTS, choose, plain, relation
from docketry.sources import cases as case_files
from docketry.sources import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str, oracle: str | None):
    """Registers ``f`` applied to the relation of ``sql``; ``{in}`` in the oracle is that relation."""

    def wrap(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(relation(spark, sf_dir, sql))
        if oracle is not None:
            ORACLE[name] = oracle.replace("{in}", f"({plain(sql)})")
        return f

    return wrap


def query2(name: str, sqls: dict[str, str], oracle: str | None):
    """The same for several relations, by name."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(**{k: relation(spark, sf_dir, s) for k, s in sqls.items()})
        if oracle is not None:
            ORACLE[name] = "WITH " + ", ".join(f"{k} AS ({plain(s)})" for k, s in sqls.items()) + " " + oracle
        return f

    return wrap


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# scalar functions

_DATES = f"""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN {DATE_BR.format("o_orderdate")} WHEN 1 THEN 'em ' || {DATE_BR.format("o_orderdate")} || ' 10:2' || cast(o_orderkey % 10 as string) || ':33'
  WHEN 2 THEN {DATE_ISO.format("o_orderdate")} WHEN 3 THEN '31/02/2020' WHEN 4 THEN {DATE_BR.format("o_orderdate")} || ' às 25:00' ELSE NULL END AS d FROM {{orders}}"""


@query("st12_to_iso", _DATES, """
SELECT id, d, CASE WHEN regexp_extract(d, '(\\d{2})/(\\d{2})/(\\d{4})', 2) BETWEEN '01' AND '12' THEN regexp_extract(d, '(\\d{2})/(\\d{2})/(\\d{4})', 3) || '-' || regexp_extract(d, '(\\d{2})/(\\d{2})/(\\d{4})', 2) || '-' || regexp_extract(d, '(\\d{2})/(\\d{2})/(\\d{4})', 1) END AS iso FROM {in}""")  # fmt: skip
def _(d):
    return d.select("id", "d", tx.to_iso(F.col("d")).alias("iso"))


@query("st13_to_iso_datetime", _DATES, """
SELECT id, CASE WHEN id % 6 = 4 THEN NULL WHEN id % 6 = 1 THEN substr(d, 10, 4) || '-' || substr(d, 7, 2) || '-' || substr(d, 4, 2) || 'T' || substr(d, 15, 8)
  WHEN id % 6 IN (0, 3) THEN substr(d, 7, 4) || '-' || substr(d, 4, 2) || '-' || substr(d, 1, 2) END AS iso FROM {in}""")  # fmt: skip
def _(d):
    return d.select("id", tx.to_iso_datetime(F.col("d")).alias("iso"))


@query("st14_date_to_iso", _DATES, """
SELECT id, CASE WHEN d LIKE '____-__-__' THEN d WHEN regexp_full_match(d, '\\d{2}/\\d{2}/\\d{4}') THEN substr(d, 7, 4) || '-' || substr(d, 4, 2) || '-' || substr(d, 1, 2) END AS iso FROM {in}""")  # fmt: skip
def _(d):
    return d.select("id", tx.date_to_iso(F.col("d")).alias("iso"))


_NAMES = f"SELECT o_orderkey AS id, {choose('o_orderkey', PARTIES)} AS nome FROM {{orders}}"


@query("st1_normalize_spaces", "SELECT c_custkey AS id, '  ' || c_name || chr(160) || '  x' || chr(9) || c_mktsegment || ' ' AS s FROM {customer}", """
SELECT id, trim(regexp_replace(replace(s, chr(160), ' '), '\\s+', ' ', 'g')) AS s FROM {in}""")  # fmt: skip
def _(d):
    return d.select("id", tx.normalize_spaces(F.col("s")).alias("s"))


@query("st2_normalize_name", _NAMES, "SELECT id, upper(regexp_replace(replace(replace(strip_accents(nome), 'ª', ''), 'º', ''), '\\s+', ' ', 'g')) AS name FROM {in}")
def _(d):
    return d.select("id", tx.normalize_name(F.col("nome")).alias("name"))


@query("st3_surname_key", _NAMES, """
SELECT id, coalesce(list_filter(w, lambda x: x NOT IN ('DA', 'DAS', 'DE', 'DO', 'DOS', 'E'))[-1], w[-1], '') AS key
FROM (SELECT id, string_split(upper(regexp_replace(replace(replace(strip_accents(nome), 'ª', ''), 'º', ''), '\\s+', ' ', 'g')), ' ') AS w FROM {in})""")  # fmt: skip
def _(d):
    return d.select("id", tx.surname_key(F.col("nome")).alias("key"))


@query("st5_lawyer_key", _NAMES, """
SELECT id, CASE WHEN regexp_full_match(k, 'I?[AO]S? *,? *MESM[A0O]S?') THEN '' ELSE k END AS key FROM (SELECT id, upper(trim(regexp_replace(trim(regexp_replace(nome, '\\s*\\(([^)]*)\\)\\s*', ' ', 'g')), '(?i)\\s+E\\s+OUTRO[AS]?S?\\s*$', ''))) AS k FROM {in})""")  # fmt: skip
def _(d):
    return d.select("id", legal.lawyer_key(F.col("nome")).alias("key"))


@query("st7_classify_lawyer", _NAMES, f"""
SELECT id, {choose("id", ("with_oab", "bare", "sentinel", "sentinel", "institutional", "institutional", "juridical", "court", "court", "pro_se", "placeholder", "with_oab", "with_oab", "juridical", "bare", "bare", "institutional", "with_oab", "juridical", "bare"))} AS kind,
 {choose("id", ("12345/SP", "", "", "", "", "", "", "", "", "", "", "148022/SP", "48215/PE", "", "", "", "", "1234A/RJ,99887/DF", "", ""))} AS codes FROM {{in}}""")  # fmt: skip
def _(d):
    r = d.select("id", legal.classify_lawyer(F.col("nome")).alias("r"))
    return r.select("id", "r.kind", F.array_join("r.codes", ",").alias("codes"))


_VERDICTS = f"SELECT o_orderkey AS id, {choose('o_orderkey', VERDICT_TEXTS)} AS t FROM {{orders}}"


@query("st8_verdict", _VERDICTS, f"""
SELECT id, {choose("id", ("denegado", "concedido", "concedido_parcial", "concedido_parcial", "nao_conhecido", "nao_conhecido", "prejudicado", "prejudicado", "nao_provido", "provido", "provido_parcial", "procedente", "improcedente", "procedente_parcial", "extinto", None, None, None, "nao_provido", "concedido"))} AS verdict FROM {{in}}""")  # fmt: skip
def _(d):
    return d.select("id", legal.verdict(F.col("t")).alias("verdict"))


@query("st9_derive_outcome", f"SELECT o_orderkey AS id, {choose('o_orderkey', VERDICT_TEXTS)} AS v, {choose('o_orderkey + 1', VERDICT_TEXTS)} AS a, {choose('o_orderkey + 4', VERDICT_TEXTS)} AS b FROM {{orders}}", f"""
SELECT id, coalesce(verdict, av, bv) AS verdict, CASE WHEN verdict IS NOT NULL THEN 'sessao_virtual' WHEN coalesce(av, bv) IS NOT NULL THEN 'andamentos' END AS source, CASE WHEN verdict IS NOT NULL THEN 0 WHEN av IS NOT NULL THEN 2 WHEN bv IS NOT NULL THEN 1 END AS source_index
FROM (SELECT id, CASE WHEN id % 20 IN (15, 16, 17) THEN NULL ELSE id END AS verdict0, {choose("id", ("denegado", "concedido", "concedido_parcial", "concedido_parcial", "nao_conhecido", "nao_conhecido", "prejudicado", "prejudicado", "nao_provido", "provido", "provido_parcial", "procedente", "improcedente", "procedente_parcial", "extinto", None, None, None, "nao_provido", "concedido"))} AS verdict,
 {choose("id + 1", ("denegado", "concedido", "concedido_parcial", "concedido_parcial", "nao_conhecido", "nao_conhecido", "prejudicado", "prejudicado", "nao_provido", "provido", "provido_parcial", "procedente", "improcedente", "procedente_parcial", "extinto", None, None, None, "nao_provido", "concedido"))} AS av,
 {choose("id + 4", ("denegado", "concedido", "concedido_parcial", "concedido_parcial", "nao_conhecido", "nao_conhecido", "prejudicado", "prejudicado", "nao_provido", "provido", "provido_parcial", "procedente", "improcedente", "procedente_parcial", "extinto", None, None, None, "nao_provido", "concedido"))} AS bv FROM {{in}})""")  # fmt: skip
def _(d):
    none = F.when(F.col("id") < 0, F.lit(""))
    held = F.array(F.struct(F.col("v").alias("voto_relator"), F.struct(none.alias("data_inicio"), none.alias("data_fim_prevista")).alias("metadata")))
    event = lambda i, c: F.struct(F.lit(i).alias("index"), none.alias("data"), F.lit("Decisão").alias("nome"), F.col(c).alias("complemento"))
    r = d.select("id", legal.derive_outcome(F.slice(held, 1, 1), F.slice(F.array(event(2, "a"), event(1, "b")), 1, 2)).alias("o"))
    return r.select("id", "o.verdict", "o.source", "o.source_index")


#: What each of EVENT_NAMES is, written out; "DISTRIBUIDO" in capitals is told, accented words aren't.
_EVENT_LABELS = (
    *("protocolo", "autuado", "distribuicao", "distribuicao", "conclusao", "vista", "pedido_vista", "despachos", "", "ordinatorio", "", "publicacao"),
    *("pauta", "pauta", "adiado", "destaque", "transito", "baixa", "agravo", "embargo", "interposto", "deferido", "indeferido", "qo"),
    *("decisao_merito", "decisao_merito", "decisao_merito", "excluidos", "excluidos", "excluidos", "suspensao_julgamento", "sustentacao_oral", "julgamento_virtual", "reconsideracao", "conexao", "cancelados"),
    *("audiencia", "agu", "vista", "imped_susp", "", "", "", "decisao_merito", "decisao_merito"),
)
_EVENT = choose("l_partkey", _EVENT_LABELS)


@query("st10_classify_event", DOCKET.replace("l_quantity", "l_partkey, l_quantity"), f"SELECT processo_id, seq, nome, {_EVENT} AS categoria FROM {{in}}")
def _(d):
    return d.select("processo_id", "seq", "nome", legal.classify_event(F.col("nome")).alias("categoria"))


@query("ag26_event_tally", DOCKET.replace("l_quantity", "l_partkey, l_quantity"), f"SELECT {_EVENT} AS categoria, count(*) AS n FROM {{in}} GROUP BY 1")
def _(d):
    return d.groupBy(legal.classify_event(F.col("nome")).alias("categoria")).agg(F.count(F.lit(1)).alias("n"))


_PDF = "SELECT p_partkey AS id, 'H C ' || cast(p_partkey as string) || '  N º 1' || chr(10) || 'S UPREMO T RIBUNAL E OUTRO' || chr(10) || chr(10) || chr(10) || chr(10) || 'texto  R E comum' AS t FROM {part}"


@query("st16_clean_pdf_text", _PDF, "SELECT id, 'HC ' || cast(id as string) || ' Nº 1' || chr(10) || 'SUPREMO TRIBUNAL E OUTRO' || chr(10) || chr(10) || 'texto RE comum' AS t FROM {in}")
def _(d):
    return d.select("id", tx.clean_pdf_text(F.col("t")).alias("t"))


@query("st17_join_lines", "SELECT p_partkey AS id, ' a ' || p_name || chr(10) || chr(10) || '  ' || p_type || chr(10) AS t FROM {part}", "SELECT id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS t FROM {in}")
def _(d):
    return d.select("id", tx.join_lines(F.col("t")).alias("t"))


@query("st18_url_keys", DOCKET, "SELECT processo_id, seq, sha1(link_url) AS sha1, regexp_extract(link_url, '^https?://([^/]+)', 1) AS host FROM {in} WHERE link_url IS NOT NULL")
def _(d):
    return d.where("link_url IS NOT NULL").select("processo_id", "seq", tx.url_sha1(F.col("link_url")).alias("sha1"), tx.url_host(F.col("link_url")).alias("host"))


#: The types of LINK_TYPES whose text can't be short, and the tiers of all of them, written out.
_SHORT = "'DESPACHO', 'INTEIRO TEOR DO ACÓRDÃO', 'Relatório', 'DECISÃO MONOCRÁTICA', 'Voto'"


@query("st19_suspicious_short", DOCKET, f"SELECT processo_id, seq, CASE WHEN link_tipo IS NOT NULL THEN link_tipo IN ({_SHORT}) AND l_quantity * 10 < 200 END AS short FROM {{in}}")
def _(d):
    return d.select("processo_id", "seq", legal.suspicious_short((F.col("l_quantity") * 10).cast("int"), F.col("link_tipo")).alias("short"))


def _tier_sql(c: str) -> str:
    a, b, z = ("INTEIRO TEOR DO ACÓRDÃO", "Relatório", "DECISÃO MONOCRÁTICA", "MANIFESTAÇÃO DA PGR", "Voto"), ("DESPACHO",), ("CERTIDÃO", "certidao", "OUTRAS PEÇAS")
    return f"CASE WHEN {c} IN ({_list(a)}) THEN 'A' WHEN {c} IN ({_list(b)}) THEN 'B' WHEN {c} IN ({_list(z)}) THEN 'C' END"


@query("ru1_tiers", DOCKET, f"SELECT processo_id, seq, {_tier_sql('link_tipo')} AS tier, CASE WHEN trim(upper(strip_accents(link_tipo))) = 'INTEIRO TEOR DO ACORDAO' THEN 'tesseract' ELSE 'pypdf' END AS provider FROM {{in}}")
def _(d):
    return d.select("processo_id", "seq", legal.tier(F.col("link_tipo")).alias("tier"), legal.pick_provider(F.col("link_tipo")).alias("provider"))


@query("fl5_substantive", DOCKET, f"SELECT processo_id, seq, link_tipo FROM {{in}} WHERE coalesce({_tier_sql('link_tipo')}, '') <> 'C'")
def _(d):
    return d.where(legal.keeps(F.col("link_tipo"))).select("processo_id", "seq", "link_tipo")


@query("ag10_top_types", DOCKET, "SELECT link_tipo AS doc_type, count(*) AS n FROM {in} GROUP BY 1 ORDER BY n DESC, doc_type NULLS LAST LIMIT 5")
def _(d):
    return corpus.top_types(d.withColumnRenamed("link_tipo", "doc_type"))


@query("ag10_unseen_types", DOCKET, f"SELECT link_tipo AS doc_type, count(*) AS n FROM {{in}} WHERE link_tipo IS NOT NULL AND {_tier_sql('link_tipo')} IS NULL GROUP BY 1")
def _(d):
    return corpus.unseen_types(d.withColumnRenamed("link_tipo", "doc_type"))


_URLS = f"SELECT p_partkey AS id, {choose('p_partkey', ('https://x/a.PDF', 'https://x/down?ext=RTF', 'https://x/repgeral/votacao?texto=1', 'https://x/servicos/dje/verDecisao.asp?n=1', 'https://x/page.html', None, '', 'https://x/a.rtf'))} AS url FROM {{part}}"


@query("fl2_supported_url", _URLS, "SELECT id, url, coalesce(regexp_matches(lower(url), '\\.(pdf|rtf)$|ext=rtf$|/repgeral/votacao\\?|/servicos/dje/verdecisao\\.asp\\?'), false) AS supported FROM {in}")
def _(d):
    return d.select("id", "url", legal.supported_url(F.col("url")).alias("supported"))


_PAIRS = "SELECT p_partkey AS id, p_name AS a, p_type || ' ' || p_brand AS b FROM {part}"


@query("st24_similarity", _PAIRS, "SELECT id, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS similarity, round(levenshtein(a, b) / length(b), 6) AS cer FROM {in}")
def _(d):
    return d.select("id", F.round(tx.similarity(F.col("a"), F.col("b")), 6).alias("similarity"), F.round(tx.character_error_rate(F.col("a"), F.col("b")), 6).alias("cer"))


@query("st25_formats", LOG, "SELECT id, classe || '-' || processo AS target, CASE WHEN id < 60 THEN id || 's' WHEN id < 3600 THEN printf('%dm%02ds', id // 60, id % 60) ELSE printf('%dh%02dm', id // 3600, id % 3600 // 60) END AS took FROM {in}")
def _(d):
    return d.select("id", tx.compact_id(F.col("classe"), F.col("processo")).alias("target"), tx.duration(F.col("id")).alias("took"))


@query("st31_split_lists", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN ' a, ' || c_mktsegment || ',,b ' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE c_name END AS s FROM {customer}", """
SELECT id, coalesce(list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x <> ''), []) AS items, CASE WHEN len(list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x <> '')) > 0 THEN len(list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x <> '')) END AS n_origem FROM {in}""")  # fmt: skip
def _(d):
    return d.select("id", tx.split_list(F.col("s")).alias("items"), F.size(tx.numero_origem(F.col("s"))).cast("bigint").alias("n_origem"))


@query("st29_redact", "SELECT s_suppkey AS id, 'http://user:pw' || cast(s_suppkey as string) || '@host.example/x' AS url FROM {supplier}", "SELECT id, 'http://***@host.example/x' AS url FROM {in}")
def _(d):
    return logs.redacted_log(d, "url")


# rules

_STAGED = f"SELECT *, {choose('id + processo', ('varrer', 'baixar', 'extrair'))} AS stage, {choose('id + 2 * processo', ('ok', 'http_error', 'fail', 'empty', 'no_bytes', 'provider_error', 'unallocated', 'cached', 'unknown_type', 'outlier_skipped', None))} AS st FROM ({LOG}) x"
_NET = "regexp_matches(lower(coalesce(error, '')), '403|500|502|503|504|5xx|auth triad|chunkedencodingerror|connectionerror|connectionreset|cookies|proxyerror|ssl|timed out|timeout')"
_KIND = f"""CASE stage WHEN 'varrer' THEN CASE WHEN st = 'ok' THEN 'ok' WHEN st IN ('unallocated', 'unallocated_pid') OR contains(lower(coalesce(error, '')), 'scrape returned none') OR coalesce(http_status = 404, false) OR contains(coalesce(error, ''), ' 404 ') OR starts_with(coalesce(error, ''), '404') THEN 'terminal' WHEN st IN ('http_error', 'fail', 'error') AND ({_NET}) THEN 'transient' ELSE 'terminal' END
 WHEN 'baixar' THEN CASE WHEN st IN ('ok', 'cached') THEN 'ok' WHEN st IN ('empty', 'empty_response', 'non_document_response') THEN 'transient' WHEN st = 'http_error' AND (coalesce(http_status = 404, false) OR contains(coalesce(error, ''), '404 ') OR contains(coalesce(error, ''), 'Not Found')) THEN 'terminal' WHEN st = 'http_error' AND ({_NET}) THEN 'transient' ELSE 'terminal' END
 ELSE CASE WHEN st IN ('ok', 'cached') THEN 'ok' WHEN st = 'no_bytes' THEN 'cross_stage' WHEN st = 'provider_error' THEN 'transient' ELSE 'terminal' END END"""  # fmt: skip


@query("ru2_classify_error", _STAGED, f"SELECT id, {_KIND} AS kind FROM {{in}}")
def _(d):
    return d.select("id", rules.classify_error(F.col("stage"), F.col("st"), F.col("error"), F.col("http_status")).alias("kind"))


@query("ru3_recovery_action", _STAGED, f"""SELECT id, CASE WHEN stage = 'extrair' AND st IN ('empty', 'outlier_skipped') THEN 'switch_provider' WHEN stage = 'extrair' AND st = 'unknown_type' THEN 'refetch_bytes' WHEN kind = 'ok' THEN 'none' WHEN kind = 'transient' THEN 'replay' WHEN kind = 'cross_stage' THEN 'refetch_upstream' ELSE 'drop_terminal' END AS action FROM (SELECT *, {_KIND} AS kind FROM (SELECT * EXCLUDE (kind) FROM {{in}}))""")
def _(d):
    return d.select("id", rules.recovery_action(F.col("stage"), F.col("st"), F.col("error"), F.col("http_status"), F.col("url")).alias("action"))


_RETRY = "(st IS NULL OR coalesce(st IN ('http_error', 'provider_error'), false) OR coalesce(kind = 'fetch_bytes' AND st = 'empty', false))"


@query("ru4_retryable", _STAGED, f"SELECT id, {_RETRY} AS again, coalesce(st = 'no_bytes', false) AS cross_stage, CASE WHEN coalesce(st IN ('ok', 'skipped_cached'), false) THEN 'ok' WHEN coalesce(st = 'no_bytes', false) THEN 'cross_stage' WHEN st IS NOT NULL AND {_RETRY} THEN 'transient' ELSE 'terminal' END AS unified FROM {{in}}")
def _(d):
    return d.select("id", rules.retryable(F.col("kind"), F.col("st")).alias("again"), rules.cross_stage(F.col("st")).alias("cross_stage"), rules.unified_kind(F.col("kind"), F.col("st")).alias("unified"))


@query("ru6_recovery_buckets", _STAGED, f"""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN id % 11 = 0 THEN 'dismissed' WHEN kind = 'extract_text' AND (st = 'empty' AND id % 4 = 0 OR st = 'outlier_skipped' AND id % 4 = 1) THEN NULL WHEN coalesce(st IN ('ok', 'skipped_cached'), false) THEN NULL
 WHEN st IS NOT NULL AND {_RETRY} AND NOT coalesce(st = 'no_bytes', false) THEN CASE WHEN retries >= 2 THEN 'cap_burnt' ELSE 'replay' END WHEN coalesce(st = 'no_bytes', false) THEN 'refetch_upstream' WHEN kind = 'extract_text' AND st IN ('empty', 'outlier_skipped') THEN 'provider_switch' WHEN kind = 'fetch_meta' AND st = 'unallocated_pid' THEN 'confirmed_unallocated' ELSE 'terminal_dropped' END AS bucket FROM {{in}}) WHERE bucket IS NOT NULL GROUP BY 1""")  # fmt: skip
def _(d):
    used = F.when(F.col("id") % 4 == 0, "chandra").when(F.col("id") % 4 == 1, "tesseract")
    b = rules.recovery_bucket(F.col("kind"), F.col("st"), F.col("retries"), used, F.col("id") % 11 == 0)
    return d.select(b.alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("ru14_migrate_status", _STAGED, "SELECT id, CASE WHEN st = 'fail' AND contains(lower(coalesce(error, '')), 'scrape returned none') THEN 'unallocated' ELSE st END AS status FROM {in}")
def _(d):
    return d.select("id", rules.migrate_status(F.col("st"), F.col("error")).alias("status"))


@query("ru12_outcome_fits", CASES, """SELECT classe, processo_id, CASE WHEN classe IN ('HC', 'MS') THEN outcome_verdict IN ('extinto', 'nao_conhecido', 'prejudicado', 'concedido', 'concedido_parcial', 'denegado')
 WHEN classe = 'RE' THEN outcome_verdict IN ('extinto', 'nao_conhecido', 'prejudicado', 'provido', 'provido_parcial', 'nao_provido') WHEN classe = 'ADI' THEN outcome_verdict IN ('extinto', 'nao_conhecido', 'prejudicado', 'procedente', 'procedente_parcial', 'improcedente') END AS fits,
 coalesce(outcome_verdict IN ('concedido', 'concedido_parcial', 'procedente', 'procedente_parcial', 'provido', 'provido_parcial'), false) AS won FROM {in}""")
def _(d):
    return d.select("classe", "processo_id", legal.outcome_fits(F.col("classe"), F.col("outcome_verdict")).alias("fits"), legal.won(F.col("outcome_verdict")).alias("won"))


@query("ru10_anomalies", CASES, """SELECT processo_id, array_to_string(list_filter([CASE WHEN processo_id <= 0 THEN 'no_number' END, CASE WHEN processo_id % 3 = 0 THEN 'no_parties' END, CASE WHEN processo_id % 5 = 0 THEN 'no_events' END, CASE WHEN relator IS NULL THEN 'no_rapporteur' END, 'no_subjects'], lambda x: x IS NOT NULL), ',') AS wrong FROM {in}""")
def _(d):
    p = F.col("processo_id")
    return d.select("processo_id", F.array_join(rules.anomalies(p % 3, p % 5, F.col("classe"), p, F.col("relator"), F.array().cast("array<string>")), ",").alias("wrong"))


# registries

_OBS = f"SELECT url, sha1(url) AS sha1, classe, processo AS processo_id, kind AS stage, status, error, ts, retries AS retry_count, run_dir FROM ({LOG}) x WHERE url IS NOT NULL AND kind <> 'fetch_meta'"
_META = f"SELECT classe, processo AS processo_id, status, error, ts, retries AS retry_count, run_dir, CASE WHEN id % 13 <> 0 THEN id % 7 END AS n_pecas FROM ({LOG}) x WHERE kind = 'fetch_meta'"


@query2("ag1_peca_issues", {"obs": _OBS, "docket": DOCKET}, f"""
SELECT o.*, dt.doc_type, o.sha1[1:1] AS latest_extractor, length(o.url) AS n_chars, CASE WHEN dt.doc_type IS NOT NULL THEN dt.doc_type IN ({_SHORT}) END AS is_suspicious_short
FROM (SELECT url, sha1, arg_max(classe, (ts, run_dir, status)) AS classe, arg_max(processo_id, (ts, run_dir, status)) AS processo_id, arg_max(status, (ts, run_dir, status)) AS latest_status, arg_max(run_dir, (ts, run_dir, status)) AS last_run_dir, min(nullif(ts, '')) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS n_attempts_seen FROM obs GROUP BY 1, 2) o
LEFT JOIN (SELECT link_url AS url, min(link_tipo) AS doc_type FROM docket WHERE link_url IS NOT NULL AND link_tipo IS NOT NULL GROUP BY 1) dt USING (url)""")  # fmt: skip
def _(obs, docket):
    shas = obs.select("sha1", "url").distinct()
    ext = shas.select("sha1", F.substring("sha1", 1, 1).alias("extractor"))
    none = F.lit(None).cast("string")
    dis = shas.limit(0).select("sha1", none.alias("dismissed_at"), none.alias("reason"))
    types = registry.document_types(docket, docket.limit(0).select(F.col("link_url").alias("url"), F.col("link_tipo").alias("doc_type")))
    return registry.peca_issues(obs, ext, dis, types, shas.select("sha1", F.length("url").alias("n_chars"))).drop("dismissed_at", "dismissed_reason")


@query("ag4_case_issues", _META, """
SELECT * FROM (SELECT classe, processo_id, arg_max(status, (ts, run_dir, status)) AS latest_meta_status, arg_max(error, (ts, run_dir, status)) FILTER (error IS NOT NULL) AS latest_error, count(*) AS n_attempts_seen, min(nullif(ts, '')) AS first_seen_at, max(ts) AS last_seen_at, arg_max(run_dir, (ts, run_dir, status)) AS last_run_dir FROM {in} GROUP BY 1, 2)
WHERE latest_meta_status IN ('http_error', 'unallocated_pid', 'error', 'fail')""")  # fmt: skip
def _(d):
    return registry.case_issues(d)


@query("ag5_unallocated", _META, "SELECT classe, processo_id, count(*) AS n_observations, count(*) >= 2 AS confirmed FROM {in} WHERE status = 'unallocated_pid' GROUP BY 1, 2")
def _(d):
    return registry.unallocated(d)


@query2("jn11_merge_candidates", {"a": "SELECT 'HC' AS classe, CAST(o_orderkey AS INT) AS processo_id, CAST(o_custkey % 4 AS INT) AS n_observations, true AS confirmed FROM {orders} WHERE o_orderkey % 3 <> 0", "b": "SELECT 'HC' AS classe, CAST(o_orderkey AS INT) AS processo_id, CAST(o_custkey % 5 AS INT) AS n_observations, false AS confirmed FROM {orders} WHERE o_orderkey % 2 = 0"}, """
SELECT coalesce(a.classe, b.classe) AS classe, coalesce(a.processo_id, b.processo_id) AS processo_id, CASE WHEN b.processo_id IS NULL OR a.n_observations >= b.n_observations THEN a.n_observations ELSE b.n_observations END AS n_observations, CASE WHEN b.processo_id IS NULL OR a.n_observations >= b.n_observations THEN a.confirmed ELSE b.confirmed END AS confirmed FROM a FULL JOIN b USING (classe, processo_id)""")  # fmt: skip
def _(a, b):
    return logs.merge_candidates(a, b)


@query("sc15_last_by_key", LOG, "SELECT kind, classe, processo, arg_max(status, id) AS status, max(id) AS id FROM {in} GROUP BY 1, 2, 3")
def _(d):
    return logs.last_by_key(d.select("kind", "classe", "processo", "status", "id"), ["kind", "classe", "processo"], ["id"])




@query2("sc16_recover_state", {"log": LOG}, """
SELECT kind, classe, processo, CASE WHEN kind <> 'fetch_meta' THEN url END AS url, arg_max(status, id) AS status, arg_max(error, id) FILTER (true) AS error0, count(*) - 1 AS retry_count FROM log WHERE kind = 'fetch_meta' OR url <> '' GROUP BY 1, 2, 3, 4""".replace(", arg_max(error, id) FILTER (true) AS error0", ""))  # fmt: skip
def _(log):
    rows = log.select("kind", "classe", "processo", "url", "status", "error", F.lit(None).cast("string").alias("doc_type"), F.col("id").alias("line"))
    return logs.recover_state(rows.limit(0).withColumn("retry_count", F.lit(0)), rows).select("kind", "classe", "processo", "url", "status", "retry_count")


@query2("sk6_error_rows", {"meta": _META, "urls": _OBS}, """
SELECT kind, classe, processo, url, status, stage_order FROM (SELECT 'fetch_meta' AS kind, classe, processo_id AS processo, NULL::VARCHAR AS url, status, 0 AS stage_order FROM meta WHERE status NOT IN ('ok', 'skipped_cached', 'unallocated_pid')
UNION ALL SELECT kind, classe, processo, url, status, stage_order FROM (SELECT stage AS kind, classe, processo_id AS processo, url, status, CASE WHEN stage = 'fetch_bytes' THEN 1 ELSE 2 END AS stage_order, row_number() OVER (PARTITION BY classe, processo_id, url ORDER BY CASE WHEN stage = 'fetch_bytes' THEN 1 ELSE 2 END) AS r FROM (SELECT stage, classe, processo_id, url, arg_max(status, ts) AS status FROM urls GROUP BY ALL) WHERE status NOT IN ('ok', 'skipped_cached', 'unallocated_pid')) WHERE r = 1)""")  # fmt: skip
def _(meta, urls):
    last = logs.last_by_key(urls.select("stage", "classe", "processo_id", "url", "status", "error", "ts"), ["stage", "classe", "processo_id", "url"], ["ts"])
    return registry.error_rows(meta, last).drop("error")


@query2("ru9_seeds", {"targets": "SELECT DISTINCT 'HC' AS classe, CAST(user_id AS INT) AS processo_id FROM {events}", "meta": _META, "urls": _OBS}, """
, m AS (SELECT classe, processo_id, arg_max(status, ts) AS status, arg_max(retry_count, ts) AS rc FROM meta GROUP BY 1, 2), u AS (SELECT stage, classe, processo_id, url, arg_max(status, ts) AS status, arg_max(retry_count, ts) AS rc FROM urls GROUP BY ALL),
t AS (SELECT t.classe, t.processo_id, m.status, m.rc FROM targets t LEFT JOIN m USING (classe, processo_id)), done AS (SELECT classe, processo_id FROM t WHERE status = 'ok'), b AS (SELECT u.* FROM u SEMI JOIN done USING (classe, processo_id) WHERE stage = 'fetch_bytes')
SELECT classe, processo_id, 'fetch_meta' AS kind, 'portal' AS pool, NULL AS url FROM t WHERE coalesce(status <> 'ok', true) AND (status IS NULL OR status IN ('http_error', 'provider_error')) AND coalesce(rc, 0) < 2
UNION ALL SELECT classe, processo_id, 'fetch_bytes', 'sistemas', url FROM b WHERE status IN ('http_error', 'provider_error', 'empty') AND coalesce(rc, 0) < 2
UNION ALL SELECT b.classe, b.processo_id, 'extract_text', 'ocr', b.url FROM b LEFT JOIN (SELECT * FROM u WHERE stage = 'extract_text') x USING (classe, processo_id, url) WHERE b.status = 'ok' AND (x.status IS NULL OR x.status IN ('http_error', 'provider_error')) AND coalesce(x.rc, 0) < 2""")  # fmt: skip
def _(targets, meta, urls):
    m = logs.last_by_key(meta.select("classe", "processo_id", "status", "retry_count", "ts"), ["classe", "processo_id"], ["ts"])
    u = logs.last_by_key(urls.select("stage", "classe", "processo_id", "url", "status", "retry_count", "ts"), ["stage", "classe", "processo_id", "url"], ["ts"])
    return registry.seeds(targets, m, u)


@query2("ag11_progress", {"meta": _META, "urls": _OBS}, "SELECT stage, status, count(*) AS n FROM (SELECT 'fetch_meta' AS stage, status FROM meta UNION ALL SELECT stage, status FROM urls) GROUP BY 1, 2")
def _(meta, urls):
    return registry.progress(meta, urls)


@query("ag11_pecas_total", _META, "SELECT CASE WHEN bool_or(n_pecas IS NULL) THEN NULL ELSE sum(n_pecas)::BIGINT END AS pecas_total FROM {in} WHERE status = 'ok'")
def _(d):
    return registry.pecas_total(d)


@query("ag12_residuals", LOG, """SELECT kind, status, count(*) AS n, CASE WHEN status = 'http_error' OR kind = 'fetch_bytes' AND status = 'empty' THEN 'replay' WHEN kind = 'extract_text' AND status = 'empty' THEN 'provider_switch' WHEN kind = 'fetch_meta' AND status = 'unallocated_pid' THEN 'confirmed_unallocated' ELSE 'terminal_dropped' END AS action FROM {in} WHERE status NOT IN ('ok', 'skipped_cached') GROUP BY ALL""")
def _(d):
    return registry.residuals(d)


@query("ru8_recovery_plan", LOG, """SELECT run_dir, bucket, status, count(*) AS n, array_to_string(list_sort(list_distinct(list(url))), ' ') AS urls FROM (SELECT *, CASE WHEN status = 'ok' THEN NULL WHEN status = 'http_error' OR kind = 'fetch_bytes' AND status = 'empty' THEN CASE WHEN retries >= 2 THEN 'cap_burnt' ELSE 'replay' END WHEN kind = 'extract_text' AND status = 'empty' THEN 'provider_switch' WHEN kind = 'fetch_meta' AND status = 'unallocated_pid' THEN 'confirmed_unallocated' ELSE 'terminal_dropped' END AS bucket FROM {in}) WHERE bucket IS NOT NULL GROUP BY ALL""")
def _(d):
    rows = d.select("kind", "status", F.col("retries").alias("retry_count"), F.lit(None).cast("string").alias("extractor"), F.lit(False).alias("dismissed"), "url", "run_dir")
    return registry.recovery_plan(rows).withColumn("urls", F.array_join("urls", " "))


# warehouse views

_ANDAMENTOS = f"SELECT classe, processo_id, seq, link_tipo, link_url, CASE WHEN link_url IS NOT NULL THEN sha1(link_url) END AS link_url_sha1 FROM ({DOCKET}) x"
_DOCS = f"SELECT 'HC' AS classe, CAST(o_orderkey AS INT) AS processo_id, 0 AS session_idx, CAST(o_custkey % 3 AS INT) AS doc_seq, {choose('o_custkey', ('Voto', 'Relatório', 'Voto Vogal', 'Outro'))} AS doc_type, 'https://votos.example/' || cast(o_orderkey as string) || '.pdf' AS url, sha1('https://votos.example/' || cast(o_orderkey as string) || '.pdf') AS url_sha1, o_orderpriority AS text FROM {{orders}}"
_PDFS = "SELECT sha1('https://portal.example/' || cast(p_partkey as string) || '.pdf') AS sha1, p_name AS text, CAST(p_partkey % 3000 AS INT) AS n_chars FROM {part} WHERE p_partkey % 3 <> 0"
_BYTES = "SELECT sha1('https://portal.example/' || cast(p_partkey as string) || '.pdf') AS sha1 FROM {part} WHERE p_partkey % 2 = 0"
_TXT = "SELECT sha1('https://votos.example/' || cast(o_orderkey as string) || '.pdf') AS sha1 FROM {orders} WHERE o_orderkey % 4 <> 0"
_SUB = """, s AS (SELECT e.classe, e.processo_id, e.seq, e.link_tipo doc_type, e.link_url url, e.link_url_sha1 sha1, 'andamento' source, if(e.link_tipo = 'DESPACHO', 'B', 'A') tier, t.text, t.n_chars FROM andamentos e LEFT JOIN pdfs t ON t.sha1 = e.link_url_sha1
 WHERE e.link_url IS NOT NULL AND (e.link_tipo IN ('INTEIRO TEOR DO ACÓRDÃO', 'DECISÃO MONOCRÁTICA') OR e.link_tipo = 'MANIFESTAÇÃO DA PGR' AND coalesce(t.n_chars > 1000, true) OR e.link_tipo = 'DESPACHO' AND coalesce(t.n_chars > 1500, true))
 UNION ALL SELECT classe, processo_id, doc_seq, doc_type, url, url_sha1, 'sessao_virtual', 'A', text, length(text) FROM documentos WHERE url IS NOT NULL AND doc_type IN ('Relatório', 'Voto Vista', 'Voto Vogal', 'Voto'))"""
_WH = {"andamentos": _ANDAMENTOS, "documentos": _DOCS, "pdfs": _PDFS}


@query2("jn1_substantive", _WH, _SUB + " SELECT * FROM s")
def _(andamentos, documentos, pdfs):
    return corpus.substantive(andamentos, documentos, pdfs)


@query2("jn2_missing_bytes", _WH | {"disk_bytes": _BYTES}, _SUB + " SELECT classe, processo_id, url, sha1, doc_type, tier FROM s ANTI JOIN disk_bytes USING (sha1)")
def _(andamentos, documentos, pdfs, disk_bytes):
    return corpus.missing(corpus.substantive(andamentos, documentos, pdfs), disk_bytes)


@query2("jn3_orphans", _WH | {"disk_bytes": _BYTES, "disk_txt": _TXT}, _SUB + " SELECT sha1, 'bytes_only' AS kind FROM disk_bytes ANTI JOIN s USING (sha1) UNION ALL SELECT sha1, 'text_only' FROM disk_txt ANTI JOIN s USING (sha1)")
def _(andamentos, documentos, pdfs, disk_bytes, disk_txt):
    return corpus.orphans(corpus.substantive(andamentos, documentos, pdfs), disk_bytes, disk_txt)


@query2("jn7_prefer_full", {"documentos": f"SELECT CAST(l_orderkey AS INT) AS processo_id, 'HC' AS classe, CAST(l_linenumber AS INT) AS seq, {choose('l_partkey', ('INTEIRO TEOR DO ACÓRDÃO', 'Voto', 'Relatório', 'DESPACHO', None))} AS doc_type FROM {{lineitem}}"}, """
SELECT * FROM documentos d WHERE NOT (coalesce(doc_type IN ('Relatório', 'Voto', 'Voto Vista', 'Voto Vogal'), false) AND EXISTS (SELECT 1 FROM documentos f WHERE f.classe = d.classe AND f.processo_id = d.processo_id AND f.doc_type = 'INTEIRO TEOR DO ACÓRDÃO'))""")  # fmt: skip
def _(documentos):
    return corpus.prefer_full(documentos)


@query2("sr3_spot_check", _WH | {"cases": CASES}, _SUB + """
, d AS (SELECT s.* FROM s SEMI JOIN (SELECT * FROM cases WHERE year(data_protocolo_iso) = 1997) c USING (classe, processo_id) WHERE tier = 'A')
SELECT classe, processo_id, doc_type, url, n_chars, substr(text, 1, 5) AS head FROM d ORDER BY md5('3|' || classe || '|' || processo_id || '|' || url || '|' || seq), classe, processo_id, url, seq LIMIT 25""")  # fmt: skip
def _(andamentos, documentos, pdfs, cases):
    # rows of the docket may be listed twice in the test table; the sample is of distinct ones
    s = corpus.substantive(andamentos, documentos, pdfs)
    return corpus.spot_check(s, cases, 25, seed=3, tier="A", year=1997, head=5)


@query("sr4_stratified", CASES, "SELECT classe, processo_id, relator FROM {in} QUALIFY row_number() OVER (PARTITION BY classe ORDER BY md5('5|' || processo_id), processo_id) <= 25")
def _(d):
    return corpus.stratified(d, "classe", 25, ["processo_id"], seed=5).select("classe", "processo_id", "relator")


@query2("ag7_population", {"cases": CASES, "partes": PARTES + " WHERE o_orderkey % 10 <> 0", "pautas": PARTES + " WHERE o_orderkey % 4 = 0"}, """
SELECT field, rate, floor, rate >= floor AS ok FROM (SELECT 'partes' AS field, avg(CASE WHEN (classe, processo_id) IN (SELECT (classe, processo_id) FROM partes) THEN 1.0 ELSE 0.0 END)::DOUBLE AS rate, 0.99::DOUBLE AS floor FROM cases UNION ALL SELECT 'pautas', avg(CASE WHEN (classe, processo_id) IN (SELECT (classe, processo_id) FROM pautas) THEN 1.0 ELSE 0.0 END)::DOUBLE, 0.15 FROM cases)""")  # fmt: skip
def _(cases, partes, pautas):
    return corpus.below_floor(corpus.population(cases, {"partes": partes, "pautas": pautas}))


@query("ag9_manifest", CASES, "SELECT count(*) AS n_cases, array_to_string(list_sort(list_distinct(list(classe))), ',') AS classes FROM {in}")
def _(d):
    return d.agg(F.count(F.lit(1)).alias("n_cases"), F.array_join(F.sort_array(F.collect_set("classe")), ",").alias("classes"))


@query("ag16_max_id", CASES, "SELECT classe, max(processo_id) AS max_id, count(*) AS n FROM {in} GROUP BY 1")
def _(d):
    return d.groupBy("classe").agg(F.max("processo_id").alias("max_id"), F.count(F.lit(1)).alias("n"))


@query2("ag17_lawyers", {"cases": CASES, "partes": PARTES}, """
SELECT lawyer, total, favourable, unfavourable, pending, CASE WHEN favourable + unfavourable > 0 THEN round(100.0 * favourable / (favourable + unfavourable), 6) END AS pct FROM (SELECT lawyer, count(*) AS total, count(*) FILTER (w) AS favourable, count(*) FILTER (outcome_verdict IS NOT NULL AND NOT w) AS unfavourable, count(*) FILTER (outcome_verdict IS NULL) AS pending
FROM (SELECT *, coalesce(outcome_verdict IN ('concedido', 'concedido_parcial', 'procedente', 'procedente_parcial', 'provido', 'provido_parcial'), false) AS w FROM cases JOIN (SELECT DISTINCT classe, processo_id, CASE WHEN contains(upper(strip_accents(nome)), 'JOSE DA SILVA') THEN 'Silva' WHEN contains(upper(strip_accents(nome)), 'DEFENSORIA') THEN 'Defensoria' WHEN contains(upper(strip_accents(nome)), 'SILVA') THEN 'Outros Silva' END AS lawyer FROM partes) p USING (classe, processo_id) WHERE lawyer IS NOT NULL) GROUP BY 1)""")  # fmt: skip
def _(cases, partes):
    return corpus.lawyer_summary(cases, partes, {"Silva": "JOSE DA SILVA", "Defensoria": "DEFENSORIA", "Outros Silva": "SILVA"}).withColumn("pct", F.round("pct", 6))


@query("ag20_grant_rates", CASES, f"""SELECT relator, n, wins, round(wins / n, 6) AS rate, round(greatest(0, (p + z2 / (2 * n) - h) / (1 + z2 / n)), 6) AS ci_lo, round(least(1, (p + z2 / (2 * n) + h) / (1 + z2 / n)), 6) AS ci_hi FROM (SELECT *, wins / n AS p, {stats.Z95 * stats.Z95} AS z2, {stats.Z95} * sqrt((wins / n * (1 - wins / n) + {stats.Z95 * stats.Z95} / (4 * n)) / n) AS h FROM (SELECT relator, count(*) AS n, count(*) FILTER (outcome_verdict IN ('concedido', 'concedido_parcial')) AS wins FROM {{in}} GROUP BY 1))""")
def _(d):
    g = stats.grant_rates(d, ["relator"], "outcome_verdict", ("concedido", "concedido_parcial"))
    return g.select("relator", "n", "wins", *[F.round(c, 6).alias(c) for c in ("rate", "ci_lo", "ci_hi")])


@query("ag21_beta_prior", CASES, """WITH g AS (SELECT count(*) FILTER (outcome_verdict = 'concedido') / count(*) AS r, count(*) AS m FROM {in} GROUP BY primeiro_autor), s AS (SELECT avg(r) AS mean, greatest(var_pop(r) - avg(r) * (1 - avg(r)) * avg(1 / m), 1e-6) AS v FROM g), k AS (SELECT mean, CASE WHEN mean * (1 - mean) / v - 1 <= 0 THEN 1 ELSE mean * (1 - mean) / v - 1 END AS k FROM s)
SELECT round(mean * k, 3) AS alpha, round((1 - mean) * k, 3) AS beta FROM k""")  # fmt: skip
def _(d):
    g = d.groupBy("primeiro_autor").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("outcome_verdict") == "concedido", F.lit(False))).alias("wins"))
    return stats.beta_prior(g).select(F.round("alpha", 3).alias("alpha"), F.round("beta", 3).alias("beta"))


@query2("ag23_yearly", {"cases": CASES, "docket": DOCKET}, """SELECT year(data_protocolo_iso)::INT AS year, count(*) AS n_cases, coalesce(sum(n), 0)::BIGINT AS n_andamentos, count(DISTINCT primeiro_autor) AS n_autores FROM cases LEFT JOIN (SELECT classe, processo_id, count(*) AS n FROM docket GROUP BY 1, 2) USING (classe, processo_id) GROUP BY 1""")
def _(cases, docket):
    return corpus.yearly(cases, docket)


_V = sorted(legal.VERDICTS)


@query("ag25_outcome_split", CASES, f"SELECT relator, count(*) AS n, {', '.join(f'count(*) FILTER (outcome_verdict = {chr(39)}{v}{chr(39)}) AS {v}' for v in _V)} FROM {{in}} WHERE outcome_verdict IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def _(d):
    return corpus.outcome_split(d, "relator")


@query("ag24_kappa", CASES, """WITH x AS (SELECT outcome_verdict AS a, CASE WHEN processo_id % 3 = 0 THEN 'concedido' ELSE outcome_verdict END AS b FROM {in} WHERE outcome_verdict IS NOT NULL), t AS (SELECT count(*) AS n, avg((a = b)::INT) AS po FROM x), e AS (SELECT sum(ca * cb) / max(t.n) / max(t.n) AS pe FROM (SELECT a AS v, count(*)::DOUBLE AS ca FROM x GROUP BY 1) JOIN (SELECT b AS v, count(*)::DOUBLE AS cb FROM x GROUP BY 1) USING (v), t)
SELECT n, round(po, 6) AS agreement, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa FROM t, e""")  # fmt: skip
def _(d):
    k = corpus.kappa(d.withColumn("b", F.when(F.col("outcome_verdict").isNotNull() & (F.col("processo_id") % 3 == 0), "concedido").otherwise(F.col("outcome_verdict"))), "outcome_verdict", "b")
    return k.select("n", *[F.round(c, 6).alias(c) for c in ("agreement", "expected", "kappa")])


_REQ = f"SELECT 'h' || cast(user_id % 5 as string) AS host, CAST(floor(value * 10) AS INT) AS elapsed_ms, event_id % 4 = 0 AS from_cache, {choose('event_id', ('200', '404', '200', '503', None), 'INT')} AS http_status FROM {{events}}"


@query("ag14_host_stats", _REQ, """SELECT host, n, n_cached, n_errors, v[round_even(0.5 * (len(v) - 1), 0)::INT + 1] AS p50_ms, v[round_even(0.95 * (len(v) - 1), 0)::INT + 1] AS p95_ms FROM (SELECT host, count(*) AS n, count(*) FILTER (from_cache) AS n_cached, count(*) FILTER (http_status >= 400) AS n_errors, list_sort(list(elapsed_ms) FILTER (NOT from_cache)) AS v FROM {in} GROUP BY 1)""")
def _(d):
    return corpus.host_stats(d)


@query("ag15_percentiles", _REQ, """SELECT host, v[least(floor(0.9 * len(v))::INT, len(v) - 1) + 1] AS p90, v[greatest(floor(0.1 * len(v))::INT - 1, 0) + 1] AS p10, quantile_cont(x, 0.5) AS median FROM (SELECT host, list_sort(list(elapsed_ms)) AS v, list(elapsed_ms) AS x FROM {in} GROUP BY 1) JOIN (SELECT host AS h, quantile_cont(elapsed_ms, 0.5) AS q FROM {in} GROUP BY 1) ON h = host""".replace("quantile_cont(x, 0.5) AS median", "q AS median"))
def _(d):
    return stats.percentiles(d, ["host"], "elapsed_ms", {"p90": ("floor", 0.9), "p10": ("low", 0.1), "median": ("median", 0.5)})


# sequences

_W = "OVER (PARTITION BY pool ORDER BY id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
_REGIMES = f"""SELECT id, pool, ts, status, wall_s, CASE WHEN n < 20 THEN 0 ELSE round(fr, 6) END AS fail_rate, CASE WHEN n < 50 THEN 0 ELSE walls[48] END AS p95_wall_s FROM (SELECT *, count(*) {_W} AS n, avg(CASE WHEN coalesce(status <> 'ok', true) AND (coalesce(wall_s > 15, false) OR coalesce(http_status IN (403, 429) OR http_status BETWEEN 500 AND 599, false) OR coalesce(retries > 0, false)) THEN 1.0 ELSE 0.0 END) {_W} AS fr, list_sort(list(wall_s) {_W}) AS walls FROM {{in}})"""
_LABEL = "CASE WHEN rn < 20 THEN 'warming' WHEN fail_rate > 0.3 OR p95_wall_s > 60 THEN 'collapse' WHEN fail_rate > 0.2 OR p95_wall_s > 30 THEN 'approaching_collapse' WHEN fail_rate > 0.1 OR p95_wall_s > 15 THEN 'l2_engaged' WHEN fail_rate > 0.05 THEN 'healthy' ELSE 'under_utilising' END"
_LABELLED = f"SELECT *, {_LABEL} AS regime FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY id) AS rn FROM ({_REGIMES}))"


@query("wn3_regimes", LOG, f"SELECT id, pool, fail_rate, p95_wall_s, regime FROM ({_LABELLED})")
def _(d):
    return sequences.regimes(d, ["pool"], ["id"]).select("id", "pool", F.round("fail_rate", 6).alias("fail_rate"), "p95_wall_s", "regime")


@query("wn6_transitions", LOG, f"SELECT id, pool, regime FROM ({_LABELLED}) QUALIFY rn = 1 OR regime IS DISTINCT FROM lag(regime) OVER (PARTITION BY pool ORDER BY id)")
def _(d):
    return sequences.transitions(sequences.regimes(d, ["pool"], ["id"]), ["pool"], ["id"], "regime").select("id", "pool", "regime")


@query("ag19_regime_summary", LOG, f"SELECT regime, count(*) AS n, min(ts) AS first_ts, arg_min('HC_' || processo, ts) AS first_key, regime IN ('collapse', 'approaching_collapse') AS severe FROM (SELECT x.*, l.processo FROM ({_LABELLED}) x JOIN {{in}} l USING (id)) GROUP BY 1")
def _(d):
    return sequences.regime_summary(logs.regime_events(sequences.regimes(d, ["pool"], ["id"])))


@query("wn5_breaker", LOG, "SELECT id, pool, count(*) OVER w = 30 AND sum((status = 'http_error')::INT) OVER w / 30 > 0.2 AS tripped FROM {in} WINDOW w AS (PARTITION BY pool ORDER BY id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def _(d):
    return sequences.breaker(d, ["pool"], ["id"], 30, 0.2, ("http_error",)).select("id", "pool", "tripped")


_PROBES = "SELECT 'C' || cast(user_id % 7 as string) AS classe, CAST(event_id AS INT) AS numero, event_id % 1000 < 600 AND value < 30 AS hit FROM {events}"


@query("wn9_discover", _PROBES, """WITH a AS (SELECT *, row_number() OVER (PARTITION BY classe ORDER BY numero) AS i FROM {in}), b AS (SELECT *, coalesce(max(CASE WHEN hit THEN i END) OVER (PARTITION BY classe ORDER BY numero), 0) AS lasthit FROM a), c AS (SELECT *, min(CASE WHEN i - lasthit >= 20 THEN i END) OVER (PARTITION BY classe) AS stop FROM b) SELECT classe, numero, hit FROM c WHERE hit AND i <= 1000 AND (stop IS NULL OR i < stop)""")
def _(d):
    return sequences.discover(d, ["classe"], "numero", "hit")


@query("wn7_keep_first", DOCKET, "SELECT DISTINCT ON (link_url) link_url, processo_id, seq FROM {in} WHERE link_url IS NOT NULL ORDER BY link_url, processo_id, seq")
def _(d):
    return sequences.keep_first(d.where("link_url IS NOT NULL").select("link_url", "processo_id", "seq"), ["link_url"], ["processo_id", "seq"])


@query("wn8_first_place_last_value", LOG, "SELECT processo, min(id) AS id, arg_max(status, id) AS status FROM {in} GROUP BY 1")
def _(d):
    return sequences.first_place_last_value(d.select("processo", "id", "status"), ["processo"], "id")


@query("wn2_reverse_index", DOCKET, "SELECT processo_id, seq, count(*) OVER (PARTITION BY processo_id) - (row_number() OVER (PARTITION BY processo_id ORDER BY seq, nome, link_url) - 1) AS idx FROM {in} QUALIFY count(*) OVER (PARTITION BY processo_id, seq) = 1")
def _(d):
    g = d.groupBy("processo_id").agg(F.array_sort(F.collect_list(F.struct("seq", "nome", "link_url"))).alias("x"))
    r = g.select("processo_id", F.size("x").cast("bigint").alias("n"), F.posexplode("x").alias("pos", "e")).select("processo_id", "e.seq", (F.col("n") - F.col("pos")).alias("idx"))
    from pyspark.sql import Window

    return r.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("processo_id", "seq"))).where("k = 1").drop("k")


@query("wn11_throttle", "SELECT 'h' || cast(user_id % 5 as string) AS host, event_id, value AS latency, event_type = 'error' AS failed FROM {events}", """
WITH RECURSIVE o AS (SELECT host, latency, failed, row_number() OVER (PARTITION BY host ORDER BY event_id) AS i, count(*) OVER (PARTITION BY host) AS n FROM {in}),
t AS (SELECT DISTINCT host, 0::BIGINT AS i, 1.0::DOUBLE AS cur FROM o UNION ALL SELECT t.host, o.i, greatest(0.05, least(30.0, CASE WHEN o.failed AND (t.cur + o.latency / 4) / 2 < t.cur THEN t.cur ELSE (t.cur + o.latency / 4) / 2 END)) FROM t JOIN o ON o.host = t.host AND o.i = t.i + 1)
SELECT host, round(arg_max(cur, i), 6) AS delay FROM t GROUP BY 1""")  # fmt: skip
def _(d):
    g = d.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("event_id", "latency", "failed"))).alias("x"))
    return g.select("host", F.round(sequences.throttle(F.col("x.latency"), F.col("x.failed"), 1.0, 4, 0.05, 30.0), 6).alias("delay"))


_ANCHORS = "SELECT CAST(n_nationkey * 700 + 100 AS BIGINT) AS id, CAST(n_nationkey * n_nationkey * 3 + 7000 AS BIGINT) AS day FROM {nation}"


@query2("jn16_calendar", {"orders": "SELECT o_orderkey FROM {orders}", "anchors": _ANCHORS}, """
, s AS (SELECT id AS x0, day AS y0, lead(id) OVER (ORDER BY id) AS x1, lead(day) OVER (ORDER BY id) AS y1, row_number() OVER (ORDER BY id) AS i, count(*) OVER () AS k FROM anchors)
SELECT o_orderkey, round_even(y0 + (o_orderkey - x0) / (x1 - x0) * (y1 - y0), 0)::BIGINT AS day FROM orders JOIN s ON x1 IS NOT NULL AND (o_orderkey >= x0 OR i = 1) AND (o_orderkey < x1 OR i = k - 1)""")  # fmt: skip
def _(orders, anchors):
    return sequences.interpolate(orders, anchors, "o_orderkey", "id", "day", "day")


# changes

_OLD = f"SELECT classe, processo_id, relator, outcome_verdict, priority FROM ({CASES}) x WHERE processo_id % 9 <> 0"
_NEW = f"SELECT classe, processo_id, CASE WHEN processo_id % 5 = 0 THEN 'MIN. DELTA' ELSE relator END AS relator, CASE WHEN processo_id % 7 = 0 THEN NULL ELSE outcome_verdict END AS outcome_verdict, priority FROM ({CASES}) x"


@query2("df2_field_changes", {"a": _OLD, "b": _NEW}, """
SELECT b.classe, b.processo_id, NULL::VARCHAR AS field, NULL::VARCHAR AS old, NULL::VARCHAR AS new, true AS is_new FROM b ANTI JOIN a USING (classe, processo_id)
UNION ALL SELECT classe, processo_id, 'relator', a.relator, b.relator, false FROM a JOIN b USING (classe, processo_id) WHERE a.relator IS DISTINCT FROM b.relator
UNION ALL SELECT classe, processo_id, 'outcome_verdict', a.outcome_verdict, b.outcome_verdict, false FROM a JOIN b USING (classe, processo_id) WHERE a.outcome_verdict IS DISTINCT FROM b.outcome_verdict""")  # fmt: skip
def _(a, b):
    return changes.field_changes(a, b, ["classe", "processo_id"])




@query("so3_added_items", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN array('a', 'b', 'a') WHEN 1 THEN array('x') ELSE NULL END AS old, array('a', 'a', 'b', 'a', c_mktsegment) AS new FROM {customer}", None)
def _(d):
    return d.select("id", F.array_join(changes.added_items(F.col("old"), F.col("new")), ",").alias("added"))


ORACLE["so3_added_items"] = "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'a,' || c_mktsegment ELSE 'a,a,b,a,' || c_mktsegment END AS added FROM customer"


@query("df1_growth", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN array('n', 'a', 'b') WHEN 1 THEN array('b') WHEN 2 THEN array('a', 'c') ELSE array('a', 'b') END AS now FROM {customer}", None)
def _(d):
    return d.select("id", changes.growth(F.col("now"), F.array(F.lit("a"), F.lit("b"))).alias("verdict"))


ORACLE["df1_growth"] = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'grown' WHEN 1 THEN 'shrunk' WHEN 2 THEN 'changed' ELSE 'same' END AS verdict FROM customer"


@query2("df4_gaps", {"a": "SELECT CAST(o_orderkey AS INT) AS processo_id FROM {orders} WHERE o_orderkey % 3 <> 0", "b": "SELECT CAST(o_orderkey AS INT) AS processo_id FROM {orders} WHERE o_orderkey % 5 = 0"}, "SELECT x AS processo_id FROM range(1, 5001) t(x) WHERE x NOT IN (SELECT processo_id FROM a) AND x NOT IN (SELECT processo_id FROM b)")
def _(a, b):
    return changes.gaps(1, 5000, a, b)


@query2("jn14_match_gold", {"names": "SELECT p_name || ' ' || cast(p_size as string) AS name FROM {part} WHERE p_partkey < 500", "gold": "SELECT DISTINCT p_name || ' ' || cast(p_size as string) AS name FROM {part} WHERE p_partkey % 7 = 0"}, """
SELECT name, name AS gold FROM names SEMI JOIN gold USING (name) UNION ALL SELECT n.name, min(g.name) AS gold FROM (SELECT DISTINCT name FROM names ANTI JOIN gold USING (name)) n JOIN gold g ON split_part(n.name, ' ', 1) = split_part(g.name, ' ', 1) GROUP BY 1""")  # fmt: skip
def _(names, gold):
    return changes.match_gold(names, gold)


# sinks and shards


@query("sk7_shard_interleave", "SELECT o_orderkey FROM {orders}", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS INT) AS shard FROM {in}")
def _(d):
    return logs.shard(d, 7, ["o_orderkey"])


@query("sk7_shard_range", "SELECT o_orderkey FROM {orders}", "SELECT o_orderkey, CAST(list_filter(range(0, 7), lambda i: i * n // 7 <= p)[-1] AS INT) AS shard FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM {in})")
def _(d):
    return logs.shard(d, 7, ["o_orderkey"], "range")


@query("sk3_exportable", DOCKET, "SELECT processo_id, seq, '[\"' || coalesce(link_tipo, '-') || '\",\"x\"]' AS items FROM {in}")
def _(d):
    return logs.exportable(d.select("processo_id", "seq", F.array(F.coalesce("link_tipo", F.lit("-")), F.lit("x")).alias("items")))


# case files: built from the tables as JSON, then read back by the tolerant readers


def _case_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = relation(spark, sf_dir, f"SELECT classe, processo_id, relator, outcome_verdict, {DATE_BR.format('data_protocolo_iso')} AS filed FROM ({CASES}) x")
    e = relation(spark, sf_dir, f"SELECT processo_id AS pid, seq, nome, complemento, link_tipo, link_url, {DATE_BR.format('l_shipdate')} AS data FROM ({DOCKET}) x")
    link = F.when(F.col("link_url").isNotNull(), F.struct(F.col("link_tipo").alias("tipo"), F.col("link_url").alias("url")))
    events = e.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("seq", "nome", "data", "complemento", link.alias("link")))).alias("andamentos"))
    j = c.join(events, F.col("pid") == F.col("processo_id"), "left")
    body = F.to_json(F.struct("classe", F.col("processo_id").cast("string").alias("processo_id"), "relator", F.col("outcome_verdict").alias("outcome"), F.col("filed").alias("data_protocolo"), "andamentos"))
    return j.select(F.concat(F.lit("/"), F.col("processo_id").cast("string")).alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modified"), F.concat(F.lit("["), body, F.lit("]")).alias("body"))


def _flat_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_files.flat_cases(case_files.cases(_case_docs(spark, sf_dir))).select("classe", "processo_id", "relator", "outcome_verdict", "data_protocolo_iso", "schema_version", F.size("badges").alias("n_badges"))


def _flat_andamentos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_files.flat_andamentos(case_files.cases(_case_docs(spark, sf_dir))).select("processo_id", "nome", "data_iso", "link_tipo", "link_url", "link_url_sha1")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_files.targets(case_files.cases(_case_docs(spark, sf_dir)), exclude=["DESPACHO"]).select("url", "surface")


def _reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = case_files.reshape(case_files.cases(_case_docs(spark, sf_dir)), F.lit("now"))
    return r.select("processo_id", "data_protocolo", "_meta.schema_version", "_meta.status_http", F.size("andamentos").alias("n_andamentos"), "outcome.verdict", "outcome.source_index")


_BY_TEXT = ("denegado", "concedido", "concedido_parcial", "concedido_parcial", "nao_conhecido", "nao_conhecido", "prejudicado", "prejudicado", "nao_provido", "provido", "provido_parcial", "procedente", "improcedente", "procedente_parcial", "extinto", None, None, None, "nao_provido", "concedido")
_TOLD = choose("l_suppkey + l_linenumber", _BY_TEXT)
_TOLD = f"CASE WHEN nome = 'Negado seguimento' AND coalesce({_TOLD}, '') NOT IN ('concedido_parcial', 'provido_parcial', 'procedente_parcial') THEN 'nao_conhecido' ELSE {_TOLD} END"

QUERIES |= {"pj1_flat_cases": _flat_cases, "pj4_flat_andamentos": _flat_andamentos, "pj17_targets": _targets, "pj10_reshape": _reshape}
ORACLE |= {
    "pj1_flat_cases": plain(f"SELECT classe, processo_id, relator, outcome_verdict, data_protocolo_iso, 1 AS schema_version, 0 AS n_badges FROM ({CASES})"),
    # a verdict written as text is derived anew from sessions and events; where they tell nothing it stays, with index -1
    "pj10_reshape": plain(f"""SELECT c.processo_id, CAST(data_protocolo_iso AS VARCHAR) AS data_protocolo, 8 AS schema_version, 200 AS status_http, coalesce(k, 0)::INT AS n_andamentos, CASE WHEN outcome_verdict IS NOT NULL THEN coalesce(v, outcome_verdict) END AS verdict, CASE WHEN outcome_verdict IS NOT NULL THEN CASE WHEN v IS NULL THEN -1 ELSE 0 END END AS source_index
 FROM ({CASES}) c LEFT JOIN (SELECT processo_id, count(*) AS k, arg_min(told, pos) FILTER (told IS NOT NULL) AS v FROM (SELECT processo_id, row_number() OVER (PARTITION BY processo_id ORDER BY seq, nome NULLS FIRST, strftime(CAST(l_shipdate AS DATE), '%d/%m/%Y'), complemento NULLS FIRST) AS pos, {_TOLD} AS told FROM ({DOCKET.replace("l_quantity", "l_partkey, l_suppkey, l_linenumber, l_quantity")})) GROUP BY 1) e USING (processo_id)"""),
    "pj4_flat_andamentos": plain(f"SELECT d.processo_id, nome, CAST(l_shipdate AS DATE) AS data_iso, CASE WHEN link_url IS NOT NULL THEN link_tipo END AS link_tipo, link_url, sha1(link_url) AS link_url_sha1 FROM ({DOCKET}) d SEMI JOIN ({CASES}) c USING (processo_id)"),
    "pj17_targets": plain(f"SELECT DISTINCT link_url AS url, 'andamento' AS surface FROM ({DOCKET}) d SEMI JOIN ({CASES}) c USING (processo_id) WHERE link_url IS NOT NULL AND coalesce(link_tipo <> 'DESPACHO', true)"),
}
