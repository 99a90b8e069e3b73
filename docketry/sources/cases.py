"""Case files: scanning, tolerant parsing and flattening into warehouse tables.

A case file is one JSON document, a case or a list of cases, of any of eight schema versions. Slots whose shape varied
over the versions (links, outcomes, documents of a session) are read as text and told apart afterwards; everything else
is read by an explicit schema, so a bad number is null and other scalars become text. Positions within lists are the
``seq`` of the tables. Flattening never shuffles: every function is a projection and a ``posexplode``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import legal
from docketry.functions import text as tx

FILE_PATTERN = "*-mini_*.json"
_S = "string"
_EVENT = "struct<`index`:string,index_num:string,id:string,data:string,data_iso:string,nome:string,complemento:string,julgador:string,link:string,link_descricao:string>"
_DOC = "struct<tipo:string,url:string,text:string,extractor:string>"
_PUB = f"struct<numero:string,data:string,secao:string,subsecao:string,titulo:string,detail_url:string,incidente_linked:string,classe:string,procedencia:string,relator:string,partes:array<string>,materia:array<string>,decisoes:array<string>>"
_DEC = "struct<kind:string,texto:string,rtf:string>"
_SESSION = "struct<metadata:string,voto_relator:string,documentos:string>"
_META = "struct<schema_version:string,status_http:string,extraido:string>"
#: text fields, integer fields and lists of text of a case
TEXTS = ("url", "numero_unico", "meio", "publicidade", "data_protocolo", "orgao_origem", "origem", "relator", "primeiro_autor")
WHOLE = ("incidente", "volumes", "folhas", "apensos")
LISTS = ("badges", "assuntos", "numero_origem")
CASE_SCHEMA = ", ".join(
    [f"{c} string" for c in ("classe", "processo_id", *TEXTS, *WHOLE, "data_protocolo_iso", "outcome", "schema_version", "status_http", "status", "extraido")]
    + [f"{c} array<string>" for c in LISTS]
    + [f"_meta {_META}", "partes array<struct<`index`:string,tipo:string,nome:string>>"]
    + [f"{c} array<{_EVENT}>" for c in ("andamentos", "pautas")]
    + [f"{c} array<string>" for c in ("sessao_virtual", "publicacoes_dje")]
)


def scan(spark: SparkSession, root: str, classes: Iterable[str] | None = None, id_range: tuple[int, int] | None = None) -> DataFrame:
    """(path, modified, body) of the case files under ``root``, at any depth, or in the folders of ``classes``.

    With ``id_range`` only files whose name ends in lo-hi within the range are read: the filter is on the file's name,
    so other files aren't opened. Names without a range are then left out. Malformed JSON fails later, in ``cases``.
    """
    paths = [root] if classes is None else [f"{root}/{c}" for c in classes]
    reader = spark.read.option("pathGlobFilter", FILE_PATTERN)
    files = (reader.option("recursiveFileLookup", True) if classes is None else reader).text(paths, wholetext=True)
    out = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("body"))
    if id_range is not None:
        lo, hi = (F.expr(f"try_cast(regexp_extract(name, '_([^_]*?)-([^_]*)[.]json$', {i}) as int)") for i in (1, 2))
        out = out.where((lo >= id_range[0]) & (hi <= id_range[1]))
    return out.drop("name")


def find(spark: SparkSession, roots: Iterable[str], classe: str, number: int, stem: str = "case-mini") -> str | None:
    """Path of a case's file: under each root in turn, for each of its two names, in the class's folder, then in the root
    itself. At most four probes a root and no listing; None where there is none, which is no error."""
    for root in roots:
        for name in (f"{stem}_{classe}_{number}.json", f"{stem}_{classe}_{number}-{number}.json"):
            for path in (f"{root}/{classe}/{name}", f"{root}/{name}"):
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                files = at.getFileSystem(spark._jsc.hadoopConfiguration())
                if files.exists(at) and files.getFileStatus(at).isFile():
                    return path
    return None


def _is_object(c: Column) -> Column:
    return F.coalesce(c.rlike("^\\s*\\{"), F.lit(False))


def first_record(body: Column) -> Column:
    """JSON text of the file's case: the document itself, or the first of a list; null for anything else. Malformed
    JSON raises."""
    # from the text itself: a variant would sort the keys, and documents of a session go by the order of theirs. What
    # follows a list's first object stays behind it, as a reader of one object stops at its end
    return F.when(F.parse_json(body).isNotNull() & body.rlike("^\\s*(\\[\\s*)?\\{"), F.regexp_replace(body, "^\\s*\\[\\s*", ""))


def all_records(body: Column) -> Column:
    """Array of the JSON texts of all cases of the file; none for malformed JSON."""
    fine = F.try_parse_json(body).isNotNull()
    many = F.filter(F.from_json(body, "array<string>"), _is_object)
    return F.when(fine & _is_object(body), F.array(body)).when(fine & body.rlike("^\\s*\\["), many).otherwise(F.array().cast("array<string>"))


def cases(files: DataFrame, every_record: bool = False) -> DataFrame:
    """(path, modified, c) with the parsed case c; by default the first record of a file, malformed files raising, else
    all records, malformed files giving none."""
    body = F.col("body")
    # exploded rather than filtered: a filter is pushed below the record's projection, so that a body is made and parsed
    # again for each place that names it
    records = all_records(body) if every_record else F.array_compact(F.array(first_record(body)))
    rows = files.select("path", "modified", F.explode(records).alias("record"))
    return rows.select("path", "modified", F.from_json("record", CASE_SCHEMA).alias("c"))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def outcome_columns(outcome: Column) -> list[Column]:
    """verdict, source, source_index, date: of an object its fields, of a text the verdict alone, else nulls."""
    parsed = F.from_json(outcome, "verdict string, source string, source_index string, date_iso string")
    is_object = _is_object(outcome)
    plain = F.when(~is_object & ~outcome.rlike("^\\s*[\\[0-9]|^(true|false)$"), outcome)
    return [
        F.when(is_object, parsed["verdict"]).otherwise(plain).alias("outcome_verdict"),
        F.when(is_object, parsed["source"]).alias("outcome_source"),
        F.when(is_object, _int(parsed["source_index"])).alias("outcome_source_index"),
        F.when(is_object, parsed["date_iso"]).try_cast("date").alias("outcome_date_iso"),
    ]


def _key(c: Column | None = None) -> list[Column]:
    return [F.col("c.classe").alias("classe"), _int(F.col("c.processo_id")).alias("processo_id")]


def _listed(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def flat_cases(parsed: DataFrame) -> DataFrame:
    """One row a case; lists are empty rather than null, dates that no calendar has are null."""
    c = F.col("c")
    raw = c["data_protocolo"]
    day = F.coalesce(F.nullif(c["data_protocolo_iso"], F.lit("")), F.when(raw.contains("-"), raw), tx.to_iso(raw)).try_cast("date")
    meta = lambda name, *more: F.coalesce(c["_meta"][name], *[c[m] for m in more])
    return parsed.select(
        *_key(),
        *[_int(c[x]).alias(x) for x in WHOLE],
        *[c[x].alias(x) for x in TEXTS],
        *[_listed(c[x]).alias(x) for x in LISTS],
        day.alias("data_protocolo_iso"),
        F.coalesce(_int(meta("schema_version", "schema_version")), F.lit(1)).alias("schema_version"),
        *outcome_columns(c["outcome"]),
        _int(meta("status_http", "status_http", "status")).alias("status_http"),
        meta("extraido", "extraido").try_cast("timestamp_ntz").alias("extraido"),
        F.col("path").alias("source_path"),
        F.col("modified").cast("timestamp_ntz").alias("source_mtime"),
    )


def _positions(rows: DataFrame, keep: list, items: Column, at: str, item: str) -> DataFrame:
    """As a posexplode, whose own filter on the list's size would be pushed below and parse everything a second time."""
    return rows.select(*keep, F.posexplode_outer(items).alias(at, item)).where(F.col(at).isNotNull())


def _exploded(parsed: DataFrame, field: str) -> DataFrame:
    return _positions(parsed, _key(), F.col(f"c.{field}"), "seq", "x")


def flat_partes(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, "partes").select("classe", "processo_id", "seq", "x.tipo", "x.nome")


def _link_object(link: Column) -> Column:
    """The fields of a link that is an object, all null for one that can't be read; null for any other. To be bound by
    ``tx.stages``: each use of the expression itself parses anew."""
    unread = F.struct(*[F.lit(None).cast(_S).alias(c) for c in ("tipo", "url", "text", "extractor")])
    return F.when(_is_object(link), F.coalesce(F.from_json(link, _DOC), unread))


def flat_andamentos(parsed: DataFrame) -> DataFrame:
    """Docket events. Only links that are objects have link columns; their text and extractor are those of the file
    until ``caches.resolve`` puts the cache's in their place."""
    rows = _exploded(parsed, "andamentos").withColumn("l", F.from_json(F.when(_is_object(F.col("x.link")), F.col("x.link")), _DOC))
    return rows.select(
        "classe", "processo_id", "seq", "x.data", tx.flexible_date(F.col("x.data_iso"), F.col("x.data")).try_cast("date").alias("data_iso"), "x.nome", "x.complemento", "x.julgador",
        F.col("l.tipo").alias("link_tipo"), F.col("l.url").alias("link_url"), tx.url_sha1(F.col("l.url")).alias("link_url_sha1"), F.col("l.text").alias("link_text"), F.col("l.extractor").alias("link_extractor"),
    )


def flat_pautas(parsed: DataFrame) -> DataFrame:
    """Hearing schedule; a date that isn't ISO is null, as the table began with version 6."""
    day = F.when(F.col("x.data").rlike("(?s)^.{4}-.{5}$"), F.col("x.data")).try_cast("date")
    return _exploded(parsed, "pautas").select("classe", "processo_id", "seq", "x.data", day.alias("data_iso"), "x.nome", "x.complemento", "x.julgador")


def _publications(parsed: DataFrame) -> DataFrame:
    """Entries that are no objects are left out, but keep their position."""
    return _exploded(parsed, "publicacoes_dje").where(_is_object(F.col("x"))).withColumn("x", F.from_json("x", _PUB))


def flat_publicacoes(parsed: DataFrame) -> DataFrame:
    day = F.when(F.col("x.data").rlike("(?s)^.{4}-.{5}$"), F.col("x.data")).try_cast("date")
    return _publications(parsed).select(
        "classe", "processo_id", "seq", "x.numero", "x.data", day.alias("data_iso"), "x.secao", "x.subsecao", "x.titulo", "x.detail_url", _int(F.col("x.incidente_linked")).alias("incidente_linked"),
        F.col("x.classe").alias("dje_classe"), "x.procedencia", "x.relator", _listed(F.col("x.partes")).alias("partes"), _listed(F.col("x.materia")).alias("materia"), F.coalesce(F.size("x.decisoes"), F.lit(0)).alias("n_decisoes"),
    )


def flat_decisoes(parsed: DataFrame) -> DataFrame:
    rows = _positions(_publications(parsed), ["classe", "processo_id", F.col("seq").alias("dje_seq")], F.col("x.decisoes"), "dec_seq", "d")
    rows = rows.where(_is_object(F.col("d"))).withColumn("d", F.from_json("d", _DEC)).withColumn("r", F.when(_is_object(F.col("d.rtf")), F.from_json("d.rtf", _DOC)))
    return rows.select("classe", "processo_id", "dje_seq", "dec_seq", "d.kind", "d.texto", F.col("r.tipo").alias("rtf_tipo"), F.col("r.url").alias("rtf_url"), tx.url_sha1(F.col("r.url")).alias("rtf_url_sha1"), F.col("r.text").alias("rtf_text"), F.col("r.extractor").alias("rtf_extractor"))


def normal_documents(docs: Column) -> Column:
    """Documents of a session as array<struct(tipo, url, text, extractor)>, in their order, from a list of objects, an
    object of objects or an object of texts (URLs or contents); anything else has none."""
    listed = F.transform(F.filter(F.from_json(docs, "array<string>"), _is_object), lambda e: F.from_json(e, _DOC))

    def entry(e: Column) -> Column:
        kind, v = e["key"], e["value"]
        o = F.from_json(v, _DOC)
        is_url = v.rlike("^https?://")
        plain = F.struct(kind.alias("tipo"), F.when(is_url, v).alias("url"), F.when(~is_url, v).alias("text"), F.lit(None).cast(_S).alias("extractor"))
        return F.when(_is_object(v), F.struct(kind.alias("tipo"), o["url"].alias("url"), o["text"].alias("text"), o["extractor"].alias("extractor"))).otherwise(plain)

    keyed = F.transform(F.filter(F.map_entries(F.from_json(docs, "map<string,string>")), lambda e: e["value"].isNotNull()), entry)
    none = F.array().cast(f"array<{_DOC}>")
    return F.coalesce(F.when(docs.rlike("^\\s*\\["), listed).when(_is_object(docs), keyed), none)


def flat_documentos(parsed: DataFrame) -> DataFrame:
    """Documents of sessions: ``session_idx`` counts all sessions, ``doc_seq`` the documents after normalisation."""
    sessions = parsed.select(*_key(), F.posexplode("c.sessao_virtual").alias("session_idx", "s")).where(_is_object(F.col("s")))
    rows = sessions.withColumn("s", F.from_json("s", _SESSION)).select("classe", "processo_id", "session_idx", F.posexplode(normal_documents(F.col("s.documentos"))).alias("doc_seq", "d"))
    return rows.select("classe", "processo_id", "session_idx", "doc_seq", F.col("d.tipo").alias("doc_type"), "d.text", "d.url", tx.url_sha1(F.col("d.url")).alias("url_sha1"), "d.extractor")


def targets(parsed: DataFrame, classe: str | None = None, impte: Iterable[str] = (), relator: Iterable[str] = (), doc_types: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """(url, classe, processo_id, doc_type, surface): every document's URL once, from events, sessions and gazette.

    Filters all apply together, an empty one not at all; those on types concern events only. Of a URL that occurs more
    than once the first stays, by path, then surface in the order given, then position.
    """
    rows = parsed
    if classe is not None:
        rows = rows.where(F.col("c.classe") == classe)
    if impte := [n.upper() for n in impte]:
        hit = lambda p: F.coalesce((p["tipo"] == "IMPTE.(S)") & F.array_contains(F.transform(F.array(*map(F.lit, impte)), lambda n: F.upper(p["nome"]).contains(n)), True), F.lit(False))
        rows = rows.where(F.exists("c.partes", hit))
    if relator := [n.upper() for n in relator]:
        up = F.upper(F.coalesce(F.col("c.relator"), F.lit("")))
        keep = F.lit(False)
        for n in relator:
            keep = keep | up.contains(n)
        rows = rows.where(keep)
    # every document of a case in one array, so that a case is read once and not for each of the three surfaces
    made = lambda n, surface, at, url, kind: F.struct(F.lit(n).alias("n"), F.lit(surface).alias("surface"), F.array(*at).alias("at"), url.alias("url"), kind.alias("doc_type"))
    none = F.array().cast("array<struct<n:int,surface:string,at:array<int>,url:string,doc_type:string>>")
    objects = lambda texts, kind, f: F.when(_is_object(texts), tx.stages(F.from_json(texts, kind), f))

    def event(x: Column, i: Column) -> Column:
        def linked(o: Column) -> Column:
            bare = F.when(o.isNull() & (x["link"] != ""), x["link"])
            return made(0, "andamento", [i], F.when(o.isNotNull(), o["url"]).otherwise(bare), F.when(o.isNotNull(), o["tipo"]).when(bare.isNotNull(), x["link_descricao"]))

        return tx.stages(_link_object(x["link"]), linked)

    session = lambda x, i: objects(x, _SESSION, lambda o: F.transform(normal_documents(o["documentos"]), lambda d, j: made(1, "sessao_virtual", [i, j], d["url"], d["tipo"])))
    rtf = lambda o: F.when(_is_object(o["rtf"]), F.from_json(o["rtf"], _DOC)["url"])
    published = lambda x, i: objects(x, "struct<decisoes:array<string>>", lambda o: F.transform(o["decisoes"], lambda d, j: objects(d, _DEC, lambda e: made(2, "dje", [i, j], rtf(e), e["kind"]))))
    nested = lambda name, f: F.coalesce(F.flatten(F.array_compact(F.transform(f"c.{name}", f))), none)
    every = F.concat(F.coalesce(F.transform("c.andamentos", event), none), nested("sessao_virtual", session), nested("publicacoes_dje", published))
    every = rows.select(*_key(), "path", F.inline(F.array_compact(every))).where(legal.supported_url(F.col("url")))
    of_event = F.col("surface") == "andamento"
    if doc_types := list(doc_types):
        every = every.where(~of_event | F.col("doc_type").isin(doc_types))
    if exclude := list(exclude):
        every = every.where(~of_event | ~F.coalesce(F.col("doc_type").isin(exclude), F.lit(False)))
    first = F.min_by(F.struct("classe", "processo_id", "doc_type", "surface"), F.struct("path", "n", "at")).alias("f")
    return every.groupBy("url").agg(first).select("url", "f.classe", "f.processo_id", "f.doc_type", "f.surface")


# migration to version 8


def _index(e: Column) -> Column:
    return F.coalesce(_int(e["index"]), _int(e["index_num"]), _int(e["id"]), F.lit(0))


def _iso_or_plain(e: Column) -> Column:
    return tx.date_to_iso(F.coalesce(F.nullif(e["data_iso"], F.lit("")), e["data"]))


def reshape(parsed: DataFrame, now: Column | None = None) -> DataFrame:
    """Cases of any version as version 8: (classe, processo_id, _meta, data_protocolo, andamentos, pautas, outcome,
    primeiro_autor). Idempotent. Dates become ISO or null, indexes whole numbers, links objects without text, a verdict
    written as text an object derived from sessions and events, or one with source_index -1; a missing time of scraping
    is ``now``."""
    c = F.col("c")
    nothing = F.lit(None).cast(_S)

    def link(e: Column) -> Column:
        def made(o: Column) -> Column:
            url = F.when(o.isNull(), e["link"]).otherwise(o["url"])
            return F.struct(F.coalesce(e["link_descricao"], o["tipo"]).alias("tipo"), url.alias("url"), nothing.alias("text"), nothing.alias("extractor"))

        return F.when(e["link"].isNotNull() | e["link_descricao"].isNotNull(), tx.stages(_link_object(e["link"]), made))

    event = lambda e: [_index(e).alias("index"), _iso_or_plain(e).alias("data"), F.coalesce(e["nome"], F.lit("")).alias("nome"), e["complemento"].alias("complemento"), e["julgador"].alias("julgador")]
    empty = lambda a, like: F.coalesce(a, F.array().cast(like))
    events = F.transform(empty(c["andamentos"], f"array<{_EVENT}>"), lambda e: F.struct(*event(e), link(e).alias("link")))
    hearings = F.transform(empty(c["pautas"], f"array<{_EVENT}>"), lambda e: F.struct(*event(e)))
    meta = F.struct(
        F.lit(8).alias("schema_version"),
        F.coalesce(_int(c["_meta"]["status_http"]), _int(c["status_http"]), F.lit(200)).alias("status_http"),
        F.coalesce(c["extraido"], c["_meta"]["extraido"], now if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).alias("extraido"),
    )
    session = "struct<metadata:struct<data_inicio:string,`data_início`:string,data_fim_prevista:string,data_prevista_fim:string>,voto_relator:string>"
    held = F.transform(F.filter(empty(c["sessao_virtual"], "array<string>"), _is_object), lambda s: F.from_json(s, session))
    held = F.transform(
        held,
        lambda s: F.struct(
            F.struct(
                tx.date_to_iso(F.coalesce(s["metadata"]["data_inicio"], s["metadata"]["data_início"])).alias("data_inicio"), tx.date_to_iso(F.coalesce(s["metadata"]["data_fim_prevista"], s["metadata"]["data_prevista_fim"])).alias("data_fim_prevista")
            ).alias("metadata"),
            s["voto_relator"].alias("voto_relator"),
        ),
    )
    given = F.from_json(c["outcome"], "verdict string, source string, source_index int, date_iso string")
    bare = F.struct(c["outcome"].alias("verdict"), F.lit("andamentos").alias("source"), F.lit(-1).alias("source_index"), nothing.alias("date_iso"))
    rows = parsed.select("c", events.alias("andamentos"), held.alias("held"))
    outcome = F.when(_is_object(c["outcome"]), given).when(c["outcome"].isNotNull(), F.coalesce(legal.derive_outcome(F.col("held"), F.col("andamentos")), bare))
    return rows.select(
        *_key(),
        meta.alias("_meta"),
        tx.date_to_iso(F.coalesce(F.nullif(c["data_protocolo_iso"], F.lit("")), c["data_protocolo"])).alias("data_protocolo"),
        "andamentos",
        hearings.alias("pautas"),
        outcome.alias("outcome"),
        F.coalesce(legal.primeiro_autor(c["partes"]), c["primeiro_autor"]).alias("primeiro_autor"),
    )


def rewrite(parsed: DataFrame, root: str, now: Column | None = None) -> None:
    """Writes every case as version 8, one JSON object a line, in a folder for each class; what ``reshape`` doesn't know
    isn't carried over. Reading it again gives the same cases."""
    rows = reshape(parsed, now)
    rows.select(F.col("classe").alias("folder"), F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").partitionBy("folder").text(root)
