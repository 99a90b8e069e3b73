"""Views and analyses over the warehouse tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import legal, stats
from docketry.functions import text as tx

#: types of the docket, tier and least length; texts of unknown length pass
DOCKET_TYPES = (("DECISÃO MONOCRÁTICA", "A", None), ("INTEIRO TEOR DO ACÓRDÃO", "A", None), ("MANIFESTAÇÃO DA PGR", "A", 1000), ("DESPACHO", "B", 1500))
SESSION_TYPES = ("Relatório", "Voto", "Voto Vista", "Voto Vogal")
#: Rows of a narrow table up to which it is broadcast; beyond it is shuffled.
BROADCAST_ROWS = 10_000
#: least share of cases with a child row
FLOORS = {"andamentos": 0.99, "partes": 0.99, "pautas": 0.15, "publicacoes_dje": 0.05, "sessao_virtual": 0.15}


def substantive(andamentos: DataFrame, documentos: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Documents with argument: of the docket those of three types and long orders, of sessions reports and votes. The
    filter on type goes below the join with the texts, so only their hashes are shuffled."""
    tier, gate = F.lit(None).cast("string"), F.lit(False)
    for name, t, least in DOCKET_TYPES:
        is_it = F.col("link_tipo") == name
        tier = F.when(is_it, t).otherwise(tier)
        gate = gate | (is_it if least is None else is_it & (F.col("n_chars").isNull() | (F.col("n_chars") > least)))
    a = andamentos.where("link_url IS NOT NULL").where(F.col("link_tipo").isin(*[x for x, _, _ in DOCKET_TYPES]))
    a = a.join(pdfs.select(F.col("sha1").alias("link_url_sha1"), "text", "n_chars"), "link_url_sha1", "left").where(gate)
    a = a.select("classe", "processo_id", "seq", F.col("link_tipo").alias("doc_type"), F.col("link_url").alias("url"), F.col("link_url_sha1").alias("sha1"), F.lit("andamento").alias("source"), tier.alias("tier"), "text", "n_chars")
    d = documentos.where("url IS NOT NULL").where(F.col("doc_type").isin(*SESSION_TYPES))
    d = d.select("classe", "processo_id", F.col("doc_seq").alias("seq"), "doc_type", "url", F.col("url_sha1").alias("sha1"), F.lit("sessao_virtual").alias("source"), F.lit("A").alias("tier"), "text", F.length("text").alias("n_chars"))
    return a.unionByName(d)


def missing(documents: DataFrame, disk: DataFrame) -> DataFrame:
    """Documents whose file isn't on disk; each as often as it is listed. A null hash is on no disk."""
    return documents.join(disk.select("sha1"), "sha1", "left_anti").select("classe", "processo_id", "url", "sha1", "doc_type", "tier")


def orphans(documents: DataFrame, disk_bytes: DataFrame, disk_text: DataFrame) -> DataFrame:
    """(sha1, kind) of files that no document is for; a hash in both caches has two rows."""
    known = documents.select("sha1").distinct()
    side = lambda d, kind: d.select("sha1").join(known, "sha1", "left_anti").withColumn("kind", F.lit(kind))
    return side(disk_bytes, "bytes_only").unionByName(side(disk_text, "text_only"))


def prefer_full(documents: DataFrame, full: str = "INTEIRO TEOR DO ACÓRDÃO", parts: tuple[str, ...] = ("Relatório", "Voto", "Voto Vista", "Voto Vogal")) -> DataFrame:
    """Documents without the parts of cases that have the full text."""
    whole = documents.where(F.col("doc_type") == full).select("classe", "processo_id").distinct()
    is_part = F.coalesce(F.col("doc_type").isin(*parts), F.lit(False))
    return documents.where(~is_part).unionByName(documents.where(is_part).join(whole, ["classe", "processo_id"], "left_anti").select(*documents.columns))


def _draw(seed: int, *keys: str) -> Column:
    """A keyed random order that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def sample(rows: DataFrame, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows, or all if there are fewer: those first in a keyed random order. The top n of each partition
    meet, nothing is sorted as a whole."""
    return rows.orderBy(_draw(seed, *keys), *keys).limit(n)


def stratified(rows: DataFrame, by: str, quota: int, keys: list[str], seed: int = 0) -> DataFrame:
    """Up to ``quota`` rows of each stratum, first in a keyed random order; Spark's window limit cuts before the
    shuffle."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(_draw(seed, *keys), *keys))
    return rows.withColumn("_place", place).where(F.col("_place") <= quota).drop("_place")


def spot_check(documents: DataFrame, cases: DataFrame, n: int, seed: int = 0, doc_type: str | None = None, tier: str | None = None, year: int | None = None, head: int = 200) -> DataFrame:
    """(classe, processo_id, doc_type, url, n_chars, head) of a sample; filters that are None don't apply. Metadata are
    sampled first, texts follow for the sampled rows only."""
    d = documents
    if doc_type is not None:
        d = d.where(F.col("doc_type") == doc_type)
    if tier is not None:
        d = d.where(F.col("tier") == tier)
    if year is not None:
        d = d.join(cases.where(F.year("data_protocolo_iso") == year).select("classe", "processo_id").distinct(), ["classe", "processo_id"], "left_semi")
    thin = sample(d.select("classe", "processo_id", "doc_type", "url", "seq", "sha1"), n, ["classe", "processo_id", "url", "seq"], seed).drop("sha1")
    bodies = d.select("classe", "processo_id", "url", "seq", "text", "n_chars")
    return bodies.join(F.broadcast(thin) if n <= BROADCAST_ROWS else thin, ["classe", "processo_id", "url", "seq"]).select("classe", "processo_id", "doc_type", "url", "n_chars", F.substring("text", 1, head).alias("head"))


def population(cases: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """(field, rate): the share of cases with a child row in each table, 0 without cases."""
    key = ["classe", "processo_id"]
    out = None
    for name, child in sorted(children.items()):
        has = child.select(*key).distinct().withColumn("_has", F.lit(1))
        rate = cases.select(*key).join(has, key, "left").agg(F.coalesce(F.avg(F.coalesce("_has", F.lit(0)).cast("double")), F.lit(0.0)).alias("rate")).select(F.lit(name).alias("field"), "rate")
        out = rate if out is None else out.unionByName(rate)
    return out


def below_floor(rates: DataFrame, floors: dict[str, float] = FLOORS) -> DataFrame:
    """(field, rate, floor, ok)."""
    floor = F.lit(None).cast("double")
    for name, f in floors.items():
        floor = F.when(F.col("field") == name, F.lit(f)).otherwise(floor)
    return rates.withColumn("floor", floor).withColumn("ok", F.coalesce(F.col("rate") >= F.col("floor"), F.lit(True)))


def lawyer_summary(cases: DataFrame, partes: DataFrame, needles: dict[str, str]) -> DataFrame:
    """(lawyer, total, favourable, unfavourable, pending, pct) of cases in which a party's folded name has a lawyer's
    needle, the first that it has; most cases first."""
    who = F.lit(None).cast("string")
    folded = tx.fold(F.col("nome"))
    for label, needle in reversed(needles.items()):
        who = F.when(folded.contains(needle), label).otherwise(who)
    p = partes.select("classe", "processo_id", who.alias("lawyer")).where("lawyer IS NOT NULL").distinct()
    j = cases.select("classe", "processo_id", "outcome_verdict").join(p, ["classe", "processo_id"])
    good = legal.won(F.col("outcome_verdict"))
    g = j.groupBy("lawyer").agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("favourable"), F.count_if(F.col("outcome_verdict").isNotNull() & ~good).alias("unfavourable"), F.count_if(F.col("outcome_verdict").isNull()).alias("pending"))
    done = F.col("favourable") + F.col("unfavourable")
    return g.withColumn("pct", F.when(done > 0, 100.0 * F.col("favourable") / done)).orderBy(F.desc("total"), "lawyer")


def yearly(cases: DataFrame, andamentos: DataFrame) -> DataFrame:
    """(year, n_cases, n_andamentos, n_autores) by filing date."""
    key = ["classe", "processo_id"]
    events = andamentos.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    j = cases.withColumn("year", F.year("data_protocolo_iso")).join(events, key, "left")
    return j.groupBy("year").agg(F.count(F.lit(1)).alias("n_cases"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_andamentos"), F.count_distinct("primeiro_autor").alias("n_autores"))


def outcome_split(cases: DataFrame, by: str, least: int = 3) -> DataFrame:
    """(by, n, one column an outcome) for groups of at least ``least`` decided cases."""
    decided = cases.where("outcome_verdict IS NOT NULL")
    labels = sorted(legal.VERDICTS)
    g = decided.groupBy(by).pivot("outcome_verdict", labels).count().na.fill(0, labels)
    return g.withColumn("n", sum((F.col(x) for x in labels[1:]), F.col(labels[0]))).where(F.col("n") >= least)


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, agreement, expected, kappa) for two labellings; rows that lack either don't count. The table of pairs
    is summed first, so what meets has as many rows as pairs of labels."""
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("k"))
    total = pairs.agg(F.sum("k").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("k")).otherwise(0)).alias("same"))
    chance = pairs.groupBy(F.col("x").alias("v")).agg(F.sum("k").alias("kx")).join(pairs.groupBy(F.col("y").alias("v")).agg(F.sum("k").alias("ky")), "v").agg(F.sum(F.col("kx").cast("double") * F.col("ky")).alias("c"))
    j = total.crossJoin(chance).where("n > 0").select("n", (F.col("same") / F.col("n")).alias("agreement"), (F.coalesce("c", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))).alias("expected"))
    return j.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("agreement") - F.col("expected")) / (1 - F.col("expected"))).otherwise(1.0))


def top_types(rows: DataFrame, n: int = 5) -> DataFrame:
    """(doc_type, n) of the most frequent types, null included; equal counts by name."""
    return rows.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col("doc_type").asc_nulls_last()).limit(n)


def unseen_types(rows: DataFrame) -> DataFrame:
    """(doc_type, n) of types that no tier knows."""
    return rows.where(F.col("doc_type").isNotNull() & legal.tier(F.col("doc_type")).isNull()).groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))


def host_stats(requests: DataFrame) -> DataFrame:
    """(host, n, n_cached, n_errors, p50_ms, p95_ms): times are of requests that weren't answered from a cache."""
    cached = F.coalesce(F.col("from_cache"), F.lit(False))
    counts = requests.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(cached).alias("n_cached"), F.count_if(F.coalesce(F.col("http_status") >= 400, F.lit(False))).alias("n_errors"))
    times = stats.percentiles(requests.where(~cached), ["host"], "elapsed_ms", {"p50_ms": ("nearest", 0.5), "p95_ms": ("nearest", 0.95)})
    return counts.join(times.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")


def latest_manifest(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy(F.desc("built_at")).limit(1)


def ocr_scores(pages: DataFrame, providers: DataFrame, results: DataFrame, gold: DataFrame) -> DataFrame:
    """(sha1, provider, cer, pages_per_s) for every page and provider; a provider's last result counts. Providers are
    broadcast if there are ``BROADCAST_ROWS`` of them or fewer."""
    providers = providers.select("provider").distinct()
    if providers.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        providers = F.broadcast(providers)
    last = results.groupBy("sha1", "provider").agg(F.max_by(F.struct("text", "wall_s", "n_pages"), "ts").alias("r"))
    j = pages.select("sha1").distinct().crossJoin(providers).join(last, ["sha1", "provider"], "left").join(gold.select("sha1", F.col("text").alias("gold")), "sha1", "left")
    return j.select("sha1", "provider", tx.character_error_rate(F.col("r.text"), F.col("gold")).alias("cer"), F.when(F.col("r.wall_s") > 0, F.col("r.n_pages") / F.col("r.wall_s")).alias("pages_per_s"))


def ocr_rollup(scores: DataFrame) -> DataFrame:
    """(provider, n, median_cer, p10_cer, p90_cer, pages_per_s)."""
    means = scores.groupBy("provider").agg(F.count("cer").alias("n"), F.avg("pages_per_s").alias("pages_per_s"))
    ranks = stats.percentiles(scores, ["provider"], "cer", {"median_cer": ("median", 0.5), "p10_cer": ("low", 0.1), "p90_cer": ("floor", 0.9)})
    return means.join(ranks, "provider", "left").select("provider", "n", "median_cer", "p10_cer", "p90_cer", "pages_per_s")


def ocr_report(files: dict[str, DataFrame], baseline: str = "pypdf") -> DataFrame:
    """(sha1, provider, stratum, doc_type, n_pages, n_chars, wall_seconds, dollars, cer, similarity) of what
    ``caches.ocr_files`` read: a row for each text of a manifest's page. Errors count against the corrected text where the
    manifest says that there is one, similarity to the baseline's text is of the others; white space is folded."""
    flat = lambda c: tx.normalize_spaces(F.coalesce(c, F.lit("")))
    m, texts = files["manifest"].select("sha1", "stratum", "doc_type", "n_pages", "gold_corrected"), files["texts"]
    last = files["results"].groupBy("sha1", "provider").agg(F.max_by(F.struct("n_pages", "wall_seconds", "dollars"), "line").alias("r"))
    gold = files["gold"].select("sha1", flat(F.col("text")).alias("gold"))
    base = texts.where(F.col("provider") == baseline).select("sha1", flat(F.col("text")).alias("base"))
    j = m.join(texts, "sha1").join(last, ["sha1", "provider"], "left").join(gold, "sha1", "left").join(base, "sha1", "left")
    here = flat(F.col("text"))
    pages = F.coalesce(F.nullif(F.col("r.n_pages"), F.lit(0)), F.nullif("n_pages", F.lit(0)), F.lit(0))
    cer = F.when(F.coalesce("gold_corrected", F.lit(False)), tx.character_error_rate(here, F.col("gold")))
    alike = F.when(F.col("provider") != baseline, F.when((F.col("base") == "") != (here == ""), 0.0).otherwise(tx.similarity(F.col("base"), here)))
    return j.select("sha1", "provider", "stratum", "doc_type", pages.alias("n_pages"), F.length("text").alias("n_chars"), "r.wall_seconds", "r.dollars", cer.alias("cer"), alike.alias("similarity"))


def views(andamentos: DataFrame, documentos: DataFrame, pdfs: DataFrame, disk_bytes: DataFrame, disk_txt: DataFrame) -> dict[str, DataFrame]:
    """The four views of a warehouse by name."""
    documents = substantive(andamentos, documentos, pdfs)
    return {"pdfs_substantive": documents, "missing_bytes": missing(documents, disk_bytes), "missing_text": missing(documents, disk_txt), "orphan_cache_files": orphans(documents, disk_bytes, disk_txt)}


def scoped(cases: DataFrame, classes: Iterable[str], low: int, high: int) -> DataFrame:
    """(classe, processo_id) of the cases of some classes within a range, ends included."""
    return cases.where(F.col("classe").isin(*classes) & F.col("processo_id").between(low, high)).select("classe", "processo_id")


def with_parties(cases: DataFrame, partes: DataFrame) -> DataFrame:
    """(classe, processo_id, relator, nome): a row for each party of each case."""
    return cases.join(partes, ["classe", "processo_id"]).select("classe", "processo_id", "relator", "nome")


def events_of_year(andamentos: DataFrame, cases: DataFrame, year: int) -> DataFrame:
    """(processo_id, seq) of the events of cases filed in a year; a semi-join, so no event is doubled."""
    return andamentos.join(cases.where(F.year("data_protocolo_iso") == year), "processo_id", "left_semi").select("processo_id", "seq")


def text_search(andamentos: DataFrame, cases: DataFrame, needle: str) -> DataFrame:
    """(classe, relator, n): events whose complement has the needle, case aside, by class and rapporteur."""
    j = andamentos.where(F.lower("complemento").contains(needle.lower())).select("processo_id").join(cases.select("processo_id", "classe", "relator"), "processo_id")
    return j.groupBy("classe", "relator").agg(F.count(F.lit(1)).alias("n"))


def distinct_documents(andamentos: DataFrame) -> DataFrame:
    """(link_tipo, link_url), each once."""
    return andamentos.select("link_tipo", "link_url").distinct()


def all_keys(*tables: DataFrame) -> DataFrame:
    """(classe, processo_id) of every row of every table, repetitions included."""
    out = None
    for t in tables:
        keys = t.select("classe", "processo_id")
        out = keys if out is None else out.unionByName(keys)
    return out


def not_among(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of ``expected``, each once, that ``present`` doesn't have; null is equal to null."""
    return expected.subtract(present)


def latest_case(cases: DataFrame) -> DataFrame:
    """(classe, processo_id) of the case filed last; of several, that of the highest number."""
    return cases.orderBy(F.desc("data_protocolo_iso"), F.desc("processo_id")).limit(1).select("classe", "processo_id")


def last_requests(requests: DataFrame, n: int = 3) -> DataFrame:
    """(url, id, status): the last ``n`` requests of each URL by time, then id; the window's limit cuts before the
    shuffle."""
    k = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("ts"), F.desc("id")))
    return requests.where("url IS NOT NULL").withColumn("k", k).where(F.col("k") <= n).select("url", "id", "status")
