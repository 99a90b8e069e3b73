"""Legal vocabulary: verdicts, docket events, parties, document types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from docketry.functions import text as tx

# verdicts: patterns over folded lower-case text with single blanks, tried in this order

VERDICTS: dict[str, str] = {
    "concedido_parcial": "ordem parcialmente concedida|conced(o parcialmente|o em parte) a ordem|concessao parcial",
    "provido_parcial": "parcial(mente)? provido|dou parcial provimento|provimento parcial",
    "procedente_parcial": "procedente em parte|parcialmente procedente",
    "nao_conhecido": "\\bnega?(do|o) seguimento\\b|nao conheco|nao conhecid[ao] (a|o|do) ",
    "denegado": "ordem denegada|denego (a )?ordem|denegad[ao] ?a? ?ordem",
    "concedido": "ordem concedida|concessao da ordem|concedo (a )?ordem|concedid[ao] ?a? ?ordem",
    "nao_provido": "recurso nao provido|nego provimento",
    "provido": "recurso provido|provimento ao recurso|dou provimento",
    "procedente": "\\bjulgo procedente\\b|acao julgada procedente",
    "improcedente": "acao julgada improcedente|julgo improcedente",
    "prejudicado": "perda de objeto|\\bprejudicad[ao]\\b",
    "extinto": "exti(ncao|nto) sem resolucao",
}
FAVOURABLE = ("concedido", "concedido_parcial", "procedente", "procedente_parcial", "provido", "provido_parcial")
_ANY_END = ("extinto", "nao_conhecido", "prejudicado")
#: Which merits end a class, beside those that end any.
FAMILIES = {
    "writ": ("Ext HC HD MI MS", "concedido concedido_parcial denegado"),
    "appeal": ("AI ARE AgR ED EDv RE RHC RMS", "nao_provido provido provido_parcial"),
    "action": ("ACO ADC ADI ADO ADPF AO AP Inq Rcl", "improcedente procedente procedente_parcial"),
}
OUTCOMES_OF_CLASS = {c: (*_ANY_END, *merits.split()) for classes, merits in FAMILIES.values() for c in classes.split()}


def verdict(c: Column) -> Column:
    """The first verdict of the ladder that the text has, whatever its case and accents; else null."""

    def first(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for label, pattern in reversed(VERDICTS.items()):
            out = F.when(low.rlike(pattern), F.lit(label)).otherwise(out)
        return out

    return tx.stages(F.lower(tx.strip_accents(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", " "))), first)


def won(outcome: Column) -> Column:
    """Whether an outcome is a success; null and unknown ones aren't."""
    return F.coalesce(outcome.isin(*FAVOURABLE), F.lit(False))


def outcome_fits(classe: Column, outcome: Column) -> Column:
    """Whether an outcome can end a case of the class; null for unknown classes."""
    fits = F.lit(None).cast("boolean")
    for classes, merits in FAMILIES.values():
        fits = F.when(classe.isin(*classes.split()), outcome.isin(*_ANY_END, *merits.split())).otherwise(fits)
    return fits


def derive_outcome(sessions: Column, events: Column) -> Column:
    """struct(verdict, source, source_index, date_iso) or null.

    ``sessions``: array of struct with voto_relator and metadata(data_inicio, data_fim_prevista); ``events``: array of
    struct with index, data, nome, complemento, newest first. The last session's vote decides, else the first event
    whose name and complement have a verdict. Arrays stay in their order, so nothing is shuffled.
    """
    last = F.try_element_at(sessions, F.lit(-1))
    # one text at a time within the array functions, so that it is folded once and no generated code grows
    of = lambda t: F.transform(F.array(t), lambda x: verdict(x))[0]
    by_vote = lambda: F.when(last["voto_relator"].isNotNull(), of(F.trim(last["voto_relator"])))
    held = lambda verdict_of: F.struct(
        verdict_of.alias("verdict"), F.lit("sessao_virtual").alias("source"), (F.size(sessions) - 1).alias("source_index"), F.coalesce(last["metadata"]["data_inicio"], last["metadata"]["data_fim_prevista"]).alias("date_iso")
    )
    told = lambda e: F.struct(of(F.concat_ws("\n", F.coalesce(e["nome"], F.lit("")), F.coalesce(e["complemento"], F.lit("")))).alias("verdict"), F.lit("andamentos").alias("source"), F.coalesce(e["index"], F.lit(0)).alias("source_index"), e["data"].alias("date_iso"))
    none = F.lit(None).cast("struct<verdict:string,source:string,source_index:int,date_iso:string>")
    # events after the first with a verdict are passed over unread
    of_events = F.aggregate(events, none, lambda found, e: F.when(found.isNotNull(), found).otherwise(tx.stages(told(e), lambda t: F.when(t["verdict"].isNotNull(), t))))
    return tx.stages(by_vote(), lambda v: F.when(v.isNotNull(), held(v)).otherwise(of_events))


# docket events: label -> tests on the upper-case text, tried in this order
# "^x" begins with, "=x" equals, "x" contains; "x&y" both; "@n:x" within the first n characters; "!" before any: not

EVENT_RULES: dict[str, str] = {
    "destaque": "DESTAQUE",
    "nusol": "NUSOL",
    "cancelados": "REAUTUADO|CANCELA",
    "conexao": "SOBRESTADO|RETORNO AO TRAMITE|APENSACAO|^CONEXAO|^CONEXO|^APENSA",
    "pedido_vista": "VISTA AO MINISTRO",
    "distribuicao": "REGISTRADO|SUBSTITUICAO DO RELATOR|DISTRIB",
    "transito": "^TRANSITAD",
    "reconsideracao": "^RECONSIDERA",
    "vista": "^PEDIDO DE VISTA RENOVADO|^VISTA",
    "baixa": "PROCESSO FINDO|DETERMINADO ARQUIVAMENTO|BAIXA",
    "conclusao": "@8:CONCLUS",
    "sustentacao_oral": "SUSTENTACAO",
    "interposto": "PET. AVULSA DE AGRAVO|VIDE EMBARGOS|OPOSTOS|INTERPOSTO",
    "agu": "^ADVOGADO-GERAL DA UNIAO|^ADVOGADO GERAL DA UNIAO|AGU",
    "pgr": "PGR",
    "protocolo": "=PROTOCOLADO",
    "autuado": "=AUTUADO",
    "ordinatorio": "ATO ORDINATORIO|DECISAO INTERLOCUTORIA|DESPACHO ORDINATORIO|EXPEDIDO OFICIO|PEDIDO DE INFORM|PEDIDO INFORM",
    "audiencia": "AUDIENCIA",
    "publicacao": "^DECISAO&PUBLICADA NO |DECISAO PUBLICADA|JULGAMENTO PUBLICADA|PUBLICACAO|PUBLICADA DECISAO|PUBLICADO",
    "imped_susp": "IMPEDIMENTO/SUSPEICAO",
    "suspensao_julgamento": "SUSPENSO O JULGAMENTO",
    "pauta": "APRESENTADO EM MESA|DIA PARA JULGAMENTO|EXCLUIDO DO CALENDARIO|INCLUIDO&JULGAMENTO|PAUTA|PROCESSO A JULGAMENTO|PROCESSO EM MESA|RETIRADO DA MESA|RETIRADO DE MESA",
    "adiado": "ADIADO O JULGAMENTO",
    "despachos": "=DESPACHO",
    "agravo": "AGRAVO",
    "embargo": "EMBARGO",
    "julgamento_virtual": "JULGAMENTO VIRTUAL",
    "deferido": "^DEFERIDO",
    "indeferido": "^INDEFERIDO",
    "qo": "^QUESTAO DE ORDEM",
    "decisao_merito": "^ADITAMENTO A DECISAO|^CONHECIDO EM PARTE E NESSA PARTE|^DECISAO|^DECLARADA A INCONSTITUCIONALIDADE|^EXTINTO O PROCESSO|^HOMOLOG|^IMPROCEDENTE|^JULG. POR DESPACHO|^JULGAMENTO DO PLENO|^JULGAMENTO NO PLENO|^JULGAMENTO POR DESP|^NAO CONHECID|^NEGADO SEGUIMENTO|^PREJUDICAD|^PROCEDENTE|^RETIFICACAO",
    "excluidos": "=AUTOS EMPRESTADOS|=CERTIDAO|=CIENTE|=CITACAO|=COBRADA A DEVOLUCAO DOS AUTOS|=CONVERTIDO EM ELETRONICO|=DECORRIDO O PRAZO|=DETERMINADA A DEVOLUCAO|=DETERMINADA A DILIGENCIA|=DETERMINADA A INTIMACAO|=DETERMINADA A NOTIFICACAO|=DEVOLUCAO DE MANDADO|=MANIFESTACAO DA |=PEDIDO DE LIMINAR|=REMESSA|=VIDE|@5:AUTOS|AUTOS COM|AVISO DE RECEBIMENTO|COMUNICACAO ASSINADA|CONVERTIDO EM DILIGENCIA|DETERMINADA DILIGENCIA|HABILITADO A VOTAR|INFORMACOES RECEBIDAS|JUNTADA|PETICAO|REMESSA DOS AUTOS|^A SECRETARIA,|^CIENCIA|^COMUNICA|^DECURSO DE PRAZO|^DESENTRANHA|^DESPACHO LIBERANDO|^EXPEDID|^INFORMACOES|^INTIMA|^NOTIFICACAO|^RECEBIDOS|^RECEBIMENTO DOS AUTOS|^RECEBIMENTO EXTERNO|^REQUERIDA TUTELA|^RETORNO DOS|^VISTA A",
}


def _test(c: Column, rule: str) -> Column:
    out = None
    for alternative in rule.split("|"):
        both = None
        for part in alternative.split("&"):
            if part[0] == "!":
                one = ~_test(c, part[1:])
            elif part[0] == "^":
                one = c.startswith(part[1:])
            elif part[0] == "=":
                one = c == part[1:]
            elif part[0] == "@":
                n, x = part[1:].split(":")
                one = F.substring(c, 1, int(n)).contains(x)
            else:
                one = c.contains(part)
            both = one if both is None else both & one
        out = both if out is None else out | both
    return out


def classify_event(c: Column, rules: Mapping[str, str] = EVENT_RULES) -> Column:
    """The first label whose test the upper-case text passes, else the empty string, also for null. Accents aren't
    stripped: accented spellings of the rules' words don't match, as in the data the rules were made for."""

    def first(up: Column) -> Column:
        out = F.lit("")
        for label, rule in reversed(rules.items()):
            out = F.when(_test(up, rule), F.lit(label)).otherwise(out)
        return out

    return tx.stages(F.upper(F.coalesce(c, F.lit(""))), first)


# events judged by their complement too, as the archived analysis did: a label has (name, complement) alternatives,
# each a rule as above or empty; both must hold

ARCHIVED_RULES: dict[str, tuple[tuple[str, str], ...]] = {
    "art12": (("ADOTADO RITO DO ART. 12,&DA LEI 9.868/99", ""), ("DECISAO", "RITO DO ART. 12")),
    "amicus_curiae": (("PETICAO", "AMICUS CURIAE"), ("PROVIDO", "CURIAE&DEFIRO O PEDIDO"), ("DEFERIDO", "AMICUS CURIAE")),
    "liminar_comunicada": (("COMUNICADO DEFERIMENTO DE LIMINAR", ""),),
    "liminar_decisao": (
        *(("LIMINAR&!=PEDIDO DE LIMINAR&!COMUNICADO DEFERIMENTO DE LIMINAR", ""), ("!COMUNICADO DEFERIMENTO DE LIMINAR", "DETERMINO O SOBRESTAMENTO DO PROCESSO")),
        *(("PROVIDO", "EMBARGOS DE DECLARACAO COMO PEDIDO CAUTELAR"), ("REJEITADO", "REJEITO O PEDIDO DE MEDIDA CAUTELAR"), ("DECISAO", "CAUTELAR|LIMINAR")),
    ),
    "agravo": (("AGRAVO", ""), ("PROVIDO", "PROVIMENTO AO AGRAVO REGIMENTAL|@30:O AG.REG. NO")),
    "embargo": (
        *(("EMBARGO", ""), ("", "CONHECEU DOS EMBARGOS DE DECLARACAO E OS ACOLHEU|NEGO PROVIMENTO AOS DECLARATORIOS"), ("PROVI", "DESPROVEJO OS DECLARATORIOS")),
        ("PROVIDO", "^NOS TERCEIROS ED|@30:OS EMB.DECL. NO|DOU PROVIMENTO AOS EMBARGOS DE DECLARACAO|EMBARGOS DE DECLARACAO ACOLHIDOS|PROVEJO OS EMBARGOS DECLARATORIOS"),
    ),
    "excluidos": (("DETERMIN&DISTRIB", ""), ("PROVIDO", "@30:PETICAO"), (EVENT_RULES["excluidos"], "")),
}


def archived_labels(nome: Column, complemento: Column, rules: Mapping[str, Sequence[tuple[str, str]]] = ARCHIVED_RULES) -> Column:
    """array<string>: every label of the archived analysis that an event has, by its folded name and complement, in the
    order of the table. Null texts are empty."""

    def labels(t: Column) -> Column:
        out = []
        for label, alternatives in rules.items():
            held = F.lit(False)
            for name, more in alternatives:
                held = held | ((_test(t["n"], name) if name else F.lit(True)) & (_test(t["c"], more) if more else F.lit(True)))
            out.append(F.when(held, F.lit(label)))
        return F.array_compact(F.array(*out))

    return tx.stages(F.struct(tx.fold(nome).alias("n"), tx.fold(complemento).alias("c")), labels)


def decision_by(nome: Column) -> Column:
    """struct(nome, julgador) of a folded name: who decided, where the name of a decision says so, and the rest of it."""

    def told(n: Column) -> Column:
        rest, who = n, F.lit(None).cast("string")
        for prefix, judge in (("DECISAO DA PRESIDENCIA - ", "PRESIDENCIA"), ("DECISAO DO(A) RELATOR(A) - ", "RELATOR")):
            rest, who = F.when(n.startswith(prefix), F.replace(n, F.lit(prefix), F.lit(""))).otherwise(rest), F.when(n.startswith(prefix), judge).otherwise(who)
        for whole, judge in (("DECISAO DO RELATOR", "RELATOR"), ("DECISAO DA RELATORA", "RELATOR"), ("DECISAO DA PRESIDENCIA", "PRESIDENCIA")):
            rest, who = F.when(n == whole, "DECISAO").otherwise(rest), F.when(n == whole, judge).otherwise(who)
        return F.struct(rest.alias("nome"), who.alias("julgador"))

    return tx.stages(tx.fold(nome), told)


# parties

_PAREN = "\\s*\\(([^)]*)\\)\\s*"


def lawyer_key(c: Column) -> Column:
    """Upper-case name without parentheses and a closing ``E OUTRO(S)``; the empty string for ``O MESMO`` and its
    variants."""
    clean = F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, _PAREN, " ")), "(?i)\\s+E\\s+OUTRO[AS]?S?\\s*$", ""))
    key = F.upper(F.trim(F.regexp_replace(clean, ",+$", "")))
    same = "^I?[AO]S?\\s*,?\\s*MESM[A0O]S?(\\s+E\\s+OUTRO[AS]?S?)?$"
    return tx.stages(key, lambda k: F.when(k.rlike(same), F.lit("")).otherwise(k))


def bar_codes(c: Column) -> Column:
    """Registration codes within parentheses, in order, as NNNN/UF or as written."""
    inner = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(_PAREN), F.lit(1)), lambda p: F.split(p, ",")))
    return F.transform(F.filter(F.transform(inner, lambda p: F.trim(p)), lambda p: p.rlike("^\\d+([A-Z]?/[A-Z]{2}|[A-Z]{2,3})$")), lambda p: F.upper(p))


_AFTER = "\\bOAB[\\s/-]+([A-Z]{2})[\\s/-]+([0-9.]+[A-Z]?)"
_BEFORE = "\\bOAB[\\s/-]+([0-9.]+[A-Z]?)[\\s/-]*/[\\s-]*([A-Z]{2})"


def bar_codes_anywhere(c: Column) -> Column:
    """Codes written after the word OAB, state first or last, as NNNN/UF without thousands points, in order."""
    whole = F.regexp_extract_all(F.upper(c), F.lit(f"{_AFTER}|{_BEFORE}"), F.lit(0))

    def code(m: Column) -> Column:
        state_first = m.rlike(f"^{_AFTER[2:]}")
        uf = F.when(state_first, F.regexp_extract(m, _AFTER, 1)).otherwise(F.regexp_extract(m, _BEFORE, 2))
        number = F.when(state_first, F.regexp_extract(m, _AFTER, 2)).otherwise(F.regexp_extract(m, _BEFORE, 1))
        return F.concat_ws("/", F.replace(number, F.lit("."), F.lit("")), uf)

    return F.transform(whole, code)


_KINDS = (
    ("placeholder", "=SEM REPRESENTACAO NOS AUTOS"),
    ("pro_se", "=EM CAUSA PROPRIA"),
    ("institutional", "^ADVOCACIA-GERAL DA UNIAO|^ADVOGADO-GERAL DA UNIAO|^DEFENSOR PUBLICO|^DEFENSORIA PUBLICA|^MINISTERIO PUBLICO|^PROCURADOR-GERAL|^PROCURADORIA-GERAL"),
    ("juridical", "^ASSOCIACAO|^CONFEDERACAO|^CONSELHO FEDERAL|^CONSELHO REGIONAL|^FEDERACAO|^INSTITUTO|^ORDEM DOS ADVOGADOS DO BRASIL|^SINDICATO|ADVOCACIA|ADVOGADOS ASSOCIADOS|SOCIEDADE DE ADVOGADOS"),
    ("court", "^DESEMBARGADOR|^JUIZ DE DIREITO|^JUIZ FEDERAL|^JUIZO|^RELATOR DO|^RELATORA DO|^SUPERIOR TRIBUNAL|^TRIBUNAL"),
)


def classify_lawyer(c: Column) -> Column:
    """struct(kind, key, codes): sentinel, placeholder, pro_se, institutional, juridical, court, with_oab or bare, the
    first that holds, whatever the accents. Sentinels have an empty key; they, placeholders and pro_se have no codes."""
    none = F.array().cast("array<string>")

    def read(x: Column) -> Column:
        return F.struct(lawyer_key(x).alias("key"), bar_codes(x).alias("paren"), F.when(x.rlike("(?i)OAB"), bar_codes_anywhere(x)).otherwise(none).alias("anywhere"))

    def kind_of(t: Column) -> Column:
        kind = F.when(F.size(t["paren"]) + F.size(t["anywhere"]) > 0, F.lit("with_oab")).otherwise(F.lit("bare"))
        for label, rule in reversed(_KINDS):
            test = _test(t["folded"], rule) | t["folded"].contains("& ADVOGADOS") if label == "juridical" else _test(t["folded"], rule)
            kind = F.when(test, F.lit(label)).otherwise(kind)
        return F.when(t["key"] == "", F.lit("sentinel")).otherwise(kind)

    def judged(t: Column) -> Column:
        every = F.array_distinct(F.concat(t["paren"], t["anywhere"]))
        codes = F.when(t["kind"].isin("sentinel", "placeholder", "pro_se", "bare"), none).when(t["kind"] == "with_oab", every).otherwise(t["paren"])
        return F.struct(t["kind"].alias("kind"), t["key"].alias("key"), codes.alias("codes"))

    folded = lambda t: F.struct(t["key"].alias("key"), t["paren"].alias("paren"), t["anywhere"].alias("anywhere"), tx.strip_accents(t["key"]).alias("folded"))
    with_kind = lambda t: F.struct(t["key"].alias("key"), t["paren"].alias("paren"), t["anywhere"].alias("anywhere"), kind_of(t).alias("kind"))
    return tx.stages(c, read, folded, with_kind, judged)


def primeiro_autor(partes: Column, prefixes: tuple[str, ...] = ("AGTE", "AUTOR", "EMBTE", "IMPTE", "PACTE", "RECLTE", "RECTE", "REQTE")) -> Column:
    """Name of the first party whose type begins with one of the prefixes."""
    return F.try_element_at(F.filter(partes, lambda p: p["tipo"].rlike("^(" + "|".join(prefixes) + ")")), F.lit(1))["nome"]


# document types

TIER_OF = {
    **dict.fromkeys(("INTEIRO TEOR DO ACORDAO", "DECISAO MONOCRATICA", "MANIFESTACAO DA PGR", "RELATORIO", "VOTO", "VOTO VISTA", "VOTO VOGAL"), "A"),
    **dict.fromkeys(("DECISAO DE JULGAMENTO", "DESPACHO"), "B"),
    **dict.fromkeys(
        ("CERTIDAO", "CERTIDAO DE DECURSO DE PRAZO PARA RESPOSTA", "CERTIDAO DE JULGAMENTO", "CERTIDAO DE TRANSITO EM JULGADO", "COMUNICACAO ASSINADA", "INTIMACAO")
        + ("OUTRAS PECAS", "TERMO DE BAIXA", "TERMO DE REMESSA", "VISTA A PARTE AGRAVADA", "VISTA A PARTE EMBARGADA", "VISTA A PGR"),
        "C",
    ),
}
#: Types whose text can't be short unless its extraction failed.
SUBSTANTIVE = tuple(sorted({"ACORDAO", "DECISAO DE JULGAMENTO", "DECISAO MONOCRATICA", "DESPACHO", "INTEIRO TEOR DO ACORDAO", "PARECER", "PETICAO INICIAL", "RELATORIO", "VOTO", "VOTO-VISTA"}))
SHORT_CHARS = 200


def tier(doc_type: Column) -> Column:
    """A (argument), B (mixed), C (procedural), null for unknown types; case and accents aside."""
    folded = tx.fold(doc_type)
    out = F.lit(None).cast("string")
    for t in "CBA":
        out = F.when(folded.isin(*[k for k, v in TIER_OF.items() if v == t]), F.lit(t)).otherwise(out)
    return out


def keeps(doc_type: Column) -> Column:
    """All but procedural types: unknown ones and null stay."""
    return ~F.coalesce(tier(doc_type) == "C", F.lit(False))


def suspicious_short(chars: Column, doc_type: Column) -> Column:
    """Whether a substantive type's text has under 200 characters; null if either is null."""
    return F.when(chars.isNotNull() & doc_type.isNotNull(), tx.fold(doc_type).isin(*SUBSTANTIVE) & (chars < SHORT_CHARS))


def register(spark: SparkSession) -> None:
    """Makes ``is_suspicious_short(n, doc_type)`` known to the session's SQL, as an expression and no user function;
    an earlier one is replaced."""
    folded = "trim(upper(translate(regexp_replace(doc_type, '[\\u0300-\\u036f]+', ''), '{}', '{}')))".format(*tx.ACCENTS)
    known = ", ".join(f"'{t}'" for t in SUBSTANTIVE)
    body = f"CASE WHEN n IS NOT NULL AND doc_type IS NOT NULL THEN {folded} IN ({known}) AND n < {SHORT_CHARS} END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION is_suspicious_short(n INT, doc_type STRING) RETURNS BOOLEAN RETURN {body}")


def pick_provider(doc_type: Column, ocr: str = "tesseract") -> Column:
    """The extractor for a type: OCR for full judgements, the text layer for the rest."""
    return F.when(tx.fold(doc_type) == "INTEIRO TEOR DO ACORDAO", F.lit(ocr)).otherwise(F.lit("pypdf"))


def supported_url(c: Column) -> Column:
    """Whether a URL leads to a PDF or RTF document, case aside: by its ending, or by one of the portal's two
    redirecting endpoints."""
    return F.coalesce(F.lower(c).rlike("\\.(pdf|rtf)$|ext=rtf$|/repgeral/votacao\\?|/servicos/dje/verdecisao\\.asp\\?"), F.lit(False))
