"""Inputs for the queries over test tables: dockets, parties, cases and run logs made from them by SQL that both engines
read alike. ``{orders}`` and the like stand for tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def choose(key: str, values: Sequence[str | None], kind: str = "string") -> str:
    """SQL for one of the values by ``key`` modulo their number."""
    arms = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'" if kind == "string" else str(v)) for i, v in enumerate(values))
    return f"CAST(CASE ({key}) % {len(values)} {arms} END AS {kind})"


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = {t for t in TABLES if re.search(r"\{" + t + r"\}", sql)}
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def plain(sql: str) -> str:
    """The same SQL with the tables' own names."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


DATE_BR = "lpad(cast(day({0}) as string), 2, '0') || '/' || lpad(cast(month({0}) as string), 2, '0') || '/' || cast(year({0}) as string)"
DATE_ISO = "cast(year({0}) as string) || '-' || lpad(cast(month({0}) as string), 2, '0') || '-' || lpad(cast(day({0}) as string), 2, '0')"

EVENT_NAMES = (
    "Protocolado", "Autuado", "Distribuído", "DISTRIBUIDO POR PREVENCAO", "Conclusos ao relator", "Vista à PGR", "Vista ao Ministro Fulano", "Despacho", "Despacho ordinatório", "DESPACHO ORDINATORIO", "Decisão publicada", "PUBLICADO ACORDAO",
    "Incluido em pauta", "INCLUIDO NA LISTA DE JULGAMENTO", "Adiado o julgamento", "Destaque", "Transitado em julgado", "Baixa definitiva", "Agravo regimental", "Embargos de declaração", "INTERPOSTO AGRAVO", "Deferido", "Indeferido o pedido", "Questao de ordem",
    "Negado seguimento", "NAO CONHECIDO", "Homologada a desistência", "Peticao", "Juntada", "Certidao", "Suspenso o julgamento", "Sustentacao oral", "Julgamento virtual iniciado", "Reconsideracao", "Apensado", "Cancelada a distribuicao", "Audiencia", "AGU", "Vista", "Impedimento/Suspeicao",
    "Sem categoria", None, "", "Decisao", "Extinto o processo",
)
VERDICT_TEXTS = (
    "Denego a ordem", "Concedo a ordem de ofício", "CONCEDO EM PARTE A ORDEM", "Ordem parcialmente concedida", "Não conheço do habeas corpus", "nego seguimento ao pedido", "Julgo prejudicado o writ", "perda de  objeto", "Nego provimento ao agravo", "dou provimento ao recurso",
    "DOU PARCIAL PROVIMENTO", "julgo procedente a ação", "Ação julgada improcedente", "parcialmente procedente", "extinto sem resolução do mérito", "Pedido de vista", None, "", "recurso  não provido", "Concessão da ordem",
)
LINK_TYPES = ("DESPACHO", "INTEIRO TEOR DO ACÓRDÃO", "CERTIDÃO", "Relatório", "DECISÃO MONOCRÁTICA", "certidao", "MANIFESTAÇÃO DA PGR", "Novidade", "Voto", None, "OUTRAS PEÇAS")
PARTIES = (
    "José da Silva (12345/SP)", "MARIA DE SOUZA E OUTRO(A/S)", "O MESMO", "OS MESMOS", "Defensoria Pública da União", "DEFENSORIA PUBLICA DO ESTADO", "Sindicato dos Metalúrgicos", "Juízo da 1ª Vara", "Tribunal de Justiça", "Em causa própria", "Sem representação nos autos", "Ana Luíza dos Santos, OAB/SP 148.022",
    "PEDRO GOMES OAB-PE 48215", "Silva Advogados Associados", "João   das Neves", "ANTONIO E OUTROS", "Ministério Público Federal", "Carla Dias (1234A/RJ, 99887/DF)", "Ordem dos Advogados do Brasil", "Paulo",
)

DOCKET = f"""SELECT 'HC' AS classe, CAST(l_orderkey AS INT) AS processo_id, CAST(l_linenumber AS INT) AS seq, {choose("l_partkey", EVENT_NAMES)} AS nome, {choose("l_suppkey + l_linenumber", VERDICT_TEXTS)} AS complemento,
  {choose("l_partkey + l_suppkey", LINK_TYPES)} AS link_tipo, CASE WHEN l_partkey % 7 <> 0 THEN 'https://portal.example/' || cast(l_partkey as string) || '.pdf' END AS link_url, l_quantity, l_shipdate
  FROM {{lineitem}}"""
CASES = f"""SELECT {choose("o_orderkey", ("HC", "RE", "ADI", "MS"))} AS classe, CAST(o_orderkey AS INT) AS processo_id, {choose("o_custkey", ("MIN. ALFA", "MIN. BETA", "MIN. GAMA", None))} AS relator, 'Autor ' || cast(o_custkey % 50 as string) AS primeiro_autor,
  {choose("o_custkey + o_orderkey", ("concedido", "denegado", "nao_conhecido", "prejudicado", "concedido_parcial", None, "provido", "extinto"))} AS outcome_verdict, CAST(o_orderdate AS DATE) AS data_protocolo_iso, o_orderpriority AS priority FROM {{orders}}"""
PARTES = f"""SELECT {choose("o_orderkey", ("HC", "RE", "ADI", "MS"))} AS classe, CAST(o_orderkey AS INT) AS processo_id, {choose("o_custkey", PARTIES)} AS nome, {choose("o_custkey", ("IMPTE.(S)", "PACTE.(S)", "ADV.(A/S)", "COATOR(A/S)(ES)"))} AS tipo FROM {{orders}}"""
LOG = f"""SELECT CAST(event_id AS INT) AS id, {choose("user_id", ("portal", "sistemas", "ocr"))} AS pool, {choose("event_id", ("fetch_meta", "fetch_bytes", "extract_text"))} AS kind, 'HC' AS classe, CAST(user_id AS INT) AS processo,
  CASE WHEN event_id % 3 <> 0 THEN 'https://portal.example/' || cast(user_id % 40 as string) || '.pdf' END AS url,
  CASE event_type WHEN 'error' THEN 'http_error' WHEN 'signup' THEN 'ok' WHEN 'view' THEN 'empty' WHEN 'click' THEN 'ok' ELSE 'unallocated_pid' END AS status, {choose("event_id", ("403 Forbidden", "SSLEOF", "404 Not Found", None, "Read timed out", "scrape returned None", "boom"))} AS error,
  {choose("event_id + user_id", ("403", "404", "500", None, "200"), "INT")} AS http_status, CAST(value AS DOUBLE) AS wall_s, CAST(event_id % 5 AS INT) AS retries, {DATE_ISO.format("ts")} || 'T' || lpad(cast(hour(ts) as string), 2, '0') || ':' || lpad(cast(event_id as string), 9, '0') AS ts,
  'run-' || cast(event_id % 9 as string) AS run_dir FROM {{events}}"""  # fmt: skip
