"""Pages and answers of the court's portal, already fetched: fields and tables of HTML pages, sessions and themes in
JSON.

HTML has no built-in reader in Spark, so pages go through Arrow-batched functions over a small tree made by the standard
parser; JSON answers are read by explicit schemas on the JVM. A page that lacks a part gives nulls or empty lists.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docketry import ship
from docketry.functions import legal
from docketry.functions import text as tx

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


# what the standard parser gives its text of raw, or reads by rules of its own
_RAW = frozenset("iframe listing math noembed noframes noscript plaintext script style svg textarea title xmp".split())


class Node:
    """An element: its name, attributes, and children (elements and texts). What is within it is a stretch of the page's
    elements, and one of its texts, both in the page's order."""

    __slots__ = ("name", "attributes", "parent", "children", "classes", "page", "at", "end", "text_at", "text_end")

    def __init__(self, name: str, attributes: dict[str, str | None], parent: Node | None, page: Page) -> None:
        self.name, self.attributes, self.parent, self.children, self.page = name, attributes, parent, [], page
        self.classes = (attributes.get("class") or "").split() if attributes else ()
        self.at, self.end, self.text_at, self.text_end = len(page.nodes), len(page.nodes) + 1, len(page.data), len(page.data)
        page.nodes.append(self)

    def walk(self) -> list[Node]:
        return self.page.nodes[self.at + 1 : self.end]

    def texts(self) -> list[str]:
        return self.page.data[self.text_at : self.text_end]

    def text(self, between: str = "") -> str:
        return between.join([s for t in self.texts() if (s := t.strip())])

    def has(self, css: str) -> bool:
        return css in self.classes

    def all(self, css: str) -> list[Node]:
        return [n for n in self.walk() if css in n.classes]

    def first(self, css: str) -> Node | None:
        return next((n for n in self.walk() if css in n.classes), None)

    def named(self, *names: str) -> list[Node]:
        return [n for n in self.walk() if n.name in names]

    def by_id(self, value: str) -> Node | None:
        return next((n for n in self.walk() if n.attributes.get("id") == value), None)


class Page:
    """A tree as it grows: its elements, its texts, and the element that is open."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.data: list[str] = []
        self.root = self.open = Node("", {}, None, self)

    def begin(self, tag: str, attributes: dict) -> None:
        node = Node(tag, attributes, self.open, self)
        self.open.children.append(node)
        if tag not in _VOID:
            self.open = node

    def finish(self, tag: str) -> None:
        up = self.open
        while up.parent is not None and up.name != tag:
            up = up.parent
        if up.parent is not None:
            self._close(up.parent)

    def say(self, data: str) -> None:
        self.open.children.append(data)
        self.data.append(data)

    def _close(self, outer: Node | None) -> None:
        n = self.open
        while n is not outer:
            n.end, n.text_end = len(self.nodes), len(self.data)
            n = n.parent
        self.open = outer

    def whole(self) -> Node:
        self._close(None)
        return self.root


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.page.begin(tag, dict(attrs))

    def handle_endtag(self, tag: str) -> None:
        self.page.finish(tag)

    def handle_data(self, data: str) -> None:
        self.page.say(data)


_B = "[ \\t\\n\\r\\f]"
_PAIR = f"{_B}+([A-Za-z][A-Za-z0-9_-]*)=(?:\"([^\"<>&]*)\"|'([^'<>&]*)')"
_PAIRS = re.compile(_PAIR)
#: a text; a start tag's name, attributes and slash; an end tag's name; a comment or document type; a sign of anything else
_TOKEN = re.compile(
    f"([^<]+)|<([A-Za-z][A-Za-z0-9]*)((?:{re.sub(r'[(](?![?])', '(?:', _PAIR)})*){_B}*(/?)>|</([A-Za-z][A-Za-z0-9]*){_B}*>|(<!--(?!-?>)(?:[^-]|-(?!-))*-->|<![Dd][Oo][Cc][Tt][Yy][Pp][Ee][^<>]*>)|(<)"
)


def _plain_tree(page: str) -> Node | None:
    """The tree of a page of well-formed tags with quoted attributes, as the standard parser makes it, by one pattern and
    so several times faster; None for a page that has anything else in it."""
    out = Page()
    for data, tag, pairs, slash, ended, _, other in _TOKEN.findall(page):
        if data:
            out.say(unescape(data) if "&" in data else data)
        elif tag:
            tag = tag.lower()
            if tag in _RAW or (slash and tag not in _VOID):
                return None
            out.begin(tag, {k.lower(): a or b for k, a, b in _PAIRS.findall(pairs)} if pairs else {})
        elif ended:
            ended = ended.lower()
            if ended in _RAW:
                return None
            out.finish(ended)
        elif other:
            return None
    return out.whole()


def standard_tree(page: str) -> Node:
    b = _Builder()
    b.feed(page)
    b.close()
    return b.page.whole()


def tree(page: str | None) -> Node:
    page = page or ""
    root = _plain_tree(page)
    return standard_tree(page) if root is None else root


def _flat(s: str | None) -> str:
    return " ".join((s or "").split())


_TWO = r"(\d\d)"
_BR = re.compile(rf"\b{_TWO}/{_TWO}/({_TWO[1:-1]}{_TWO[1:-1]})\b(?:(?: |T|,?\s+às\s+){_TWO}:{_TWO}(?::{_TWO})?)?")


def _iso(s: str | None, time: bool = False) -> str | None:
    m = _BR.search(s or "")
    if not m or not (1 <= int(m[2]) <= 12 and 1 <= int(m[1]) <= 31 and 1900 <= int(m[3]) <= 2100):
        return None
    day = f"{m[3]}-{m[2]}-{m[1]}"
    if not time or not m[4]:
        return day
    return f"{day}T{m[4]}:{m[5]}:{m[6] or '00'}" if int(m[4]) < 24 and int(m[5]) < 60 and int(m[6] or 0) < 60 else None


# single fields


def _datum(root: Node, label: str) -> str | None:
    return next((t.removeprefix(label).strip() for n in root.all("processo-dados") if (t := n.text(" ")).startswith(label)), None)


def detail_fields(page: str | None) -> dict:
    """incidente, badges, classe, relator, meio, publicidade and numero_unico of a case's main page."""
    root = tree(page)
    number = root.by_id("incidente")
    value = (number.attributes.get("value") or "") if number else ""
    badges = [b.text() for b in root.all("badge")]
    relator = _flat(_datum(root, "Relator(a):"))
    tag = root.first("processo-rotulo")
    unique = (tag.text(" ").partition("Número Único:")[2].strip() or None) if tag else None
    up = " ".join(badges).upper()
    return {
        "incidente": int(value) if value.isdigit() else None,
        "badges": [t for b in root.all("badge") if b.has("bg-danger") and (t := b.text(" "))],
        "classe": _datum(root, "Classe:"),
        "relator": relator.removeprefix("MIN. ") or None,
        "meio": next(("FISICO" if "Físico" in b else "ELETRONICO" for b in badges if "Físico" in b or "Eletrônico" in b), None),
        "publicidade": "SIGILOSO" if "SIGILOSO" in up else "PUBLICO" if re.search("P[UÚ]BLICO", up) else None,
        "numero_unico": None if unique and unique.lower().startswith("sem número único") else unique,
    }


def _labelled(root: Node, label: str) -> str | None:
    for bold in root.all("processo-detalhes-bold"):
        if _flat(bold.text()).rstrip(":") == label and bold.parent is not None:
            after = bold.parent.children[bold.parent.children.index(bold) + 1 :]
            sibling = next((n for n in after if isinstance(n, Node) and n.name == "div"), None)
            return (_flat(sibling.text()) or None) if sibling else None
    return None


def _boxed(root: Node, label: str) -> int | None:
    for box in root.all("processo-quadro"):
        title = box.first("rotulo")
        if title and label in title.text().upper():
            n = box.first("numero")
            return int(n.text()) if n and n.text().isdigit() else None
    return None


def info_fields(page: str | None) -> dict:
    """assuntos, data_protocolo, orgao_origem, origem, numero_origem, volumes, folhas and apensos of the information page."""
    root = tree(page)
    by_id = lambda i, label: (_flat(n.text()) or None) if (n := root.by_id(i)) else _labelled(root, label)
    numbers = [p for x in (_labelled(root, "Número de Origem") or "").split(",") if (p := x.strip())]
    return {
        "assuntos": [t for li in (root.first("informacoes__assunto") or root).named("li") if (t := _flat(li.text()))],
        "data_protocolo": _iso(_labelled(root, "Data de Protocolo")),
        "orgao_origem": by_id("orgao-procedencia", "Órgão de Origem"),
        "origem": by_id("descricao-procedencia", "Origem"),
        "numero_origem": numbers or None,
        "volumes": _boxed(root, "VOLUME"),
        "folhas": _boxed(root, "FOLHA"),
        "apensos": _boxed(root, "APENSO"),
    }


# tables: rows come newest first, and count down


def parties(page: str | None) -> list[dict]:
    box = tree(page).by_id("todas-partes")
    if box is None:
        return []
    pairs = [(_flat(a.text(" ")), _flat(b.text(" "))) for a, b in zip(box.all("detalhe-parte"), box.all("nome-parte"), strict=False)]
    return [{"index": i, "tipo": t, "nome": n} for i, (t, n) in enumerate(((t, n) for t, n in pairs if t and n), 1)]


PORTAL = "https://portal.stf.jus.br"
_GUIA = re.compile(r", *GUIA *N[^,]*$", re.IGNORECASE)


def _address(href: str, base: str) -> str | None:
    if not href or href.startswith("http"):
        return href or None
    return "/".join((base, "processos", href.replace("amp;", "")))


def events(page: str | None, base: str = PORTAL) -> list[dict]:
    """Docket events; hearings have the same form without links."""
    items = tree(page).all("andamento-item")
    out = []
    for i, item in enumerate(items):
        get = lambda css, item=item: item.first(css)
        day, name, more, judge, link = get("andamento-data"), get("andamento-nome"), get("col-md-9"), get("andamento-julgador"), next(iter(item.named("a")), None)
        url = _address(link.attributes.get("href") or "", base) if link else None
        kind = (_flat("".join(link.texts())).upper() or None) if link else None
        out.append(
            {
                "index": len(items) - i,
                "data": _iso(day.text()) if day else None,
                "nome": _GUIA.sub("", _flat(name.text()) if name else "").strip().upper(),
                "complemento": (_flat("".join(more.texts())) or None) if more else None,
                "julgador": judge.text() if judge else None,
                "link": {"tipo": kind, "url": url} if url or kind else None,
            }
        )
    return out


def _strip_actor(s: str, prefix: str) -> str | None:
    return re.sub(r" em [\d/]{10}$", "", s.removeprefix(f"{prefix} ")).strip() or None


def _rows(page: str | None) -> Iterator[tuple[int, Node]]:
    rows = tree(page).all("lista-dados")
    return ((len(rows) - i, r) for i, r in enumerate(rows))


def _only(row: Node, css: str) -> str | None:
    """Leading text of the first element whose classes are exactly these."""
    for n in row.walk():
        if (n.attributes.get("class") or "") == css:
            return next((_flat(c) for c in n.children if isinstance(c, str) and c.strip()), None)
    return None


def moves(page: str | None) -> list[dict]:
    """Where the papers went: guide, sender, receiver and both days; a day is taken from the sender's or receiver's line
    if it has no cell of its own."""
    out = []
    for i, row in _rows(page):
        got, sent = _only(row, "processo-detalhes bg-font-success"), _only(row, "processo-detalhes bg-font-info")
        sender, receiver = _only(row, "processo-detalhes") or "", _only(row, "processo-detalhes-bold") or ""
        guide = next((g for n in row.all("text-right") if (g := _only(n, "processo-detalhes"))), "")
        if sender == guide and guide:
            sender = next((_flat(n.text()) for n in row.walk() if (n.attributes.get("class") or "") == "processo-detalhes" and not (n.parent and n.parent.has("text-right"))), "")
        out.append(
            {
                "index": i, "guia": re.sub(r"Guia:? |Nº ", "", guide).strip(), "recebido_por": _strip_actor(receiver, "Recebido por"), "data_recebido": _iso(got or receiver),
                "enviado_por": _strip_actor(sender, "Enviado por"), "data_enviado": _iso(sent or sender),
            }
        )
    return out


def petitions(page: str | None) -> list[dict]:
    out = []
    for i, row in _rows(page):
        got = next((m[1] for t in row.texts() if (m := re.search(r"Recebido em (.+)", _flat(t)))), None)
        day, _, who = (got or "").partition(" por ")
        out.append({"index": i, "id": _only(row, "processo-detalhes-bold"), "data": _iso(_only(row, "processo-detalhes")), "recebido_data": _iso(day, time=True), "recebido_por": who.strip() or None})
    return out


def appeals(page: str | None) -> list[dict]:
    return [{"index": i, "tipo": _only(row, "processo-detalhes-bold")} for i, row in _rows(page)]


# gazette

_ISSUE = re.compile(r"\s*DJ(?: +Nr\. *(\d+))? +do dia +([\d/]{10})\s*")
_CALL = re.compile(r"abreDetalheDiarioProcesso\(([^)]*)\)")
_NEW_SITE = "https://digital.stf.jus.br"
_ELSEWHERE = f"{_NEW_SITE}/publico/publicacoes"
_DETAIL = f"{PORTAL}/servicos/dje/verDiarioProcesso.asp"
_ARGUMENTS = ("numDj", "dataPublicacaoDj", "incidente", "codCapitulo", "numMateria", "codMateria")


def _entry(section: str = "", subsection: str = "", title: str = "", detail: str | None = None, linked: int | None = None, elsewhere: str | None = None) -> dict:
    return dict(secao=section, subsecao=subsection, titulo=title, detail_url=detail, incidente_linked=linked, external_redirect=elsewhere)


def gazette_listing(page: str | None) -> list[dict]:
    """Entries under their issue's heading, with the section and subsection above them; links that lead to the new site
    give one entry an issue."""
    out, issue, titles, sent = [], None, [], False
    for n in tree(page).named("strong", "a"):
        if n.name == "strong":
            if m := _ISSUE.fullmatch(n.text()):
                issue, titles, sent = m, [], False
            else:
                titles.append(n.text())
            continue
        if issue is None:
            continue
        entry = {"numero": int(issue[1]) if issue[1] else None, "data": _iso(issue[2])}
        call = _CALL.search(n.attributes.get("onclick") or "")
        values = [a.strip(" '") for a in call[1].split(",")] if call else []
        if len(values) == len(_ARGUMENTS) and values[2].isdigit():
            query = "&".join(map("=".join, zip(_ARGUMENTS, values, strict=True)))
            first, second = (*titles, "", "")[:2]
            out.append(entry | _entry(first, second, n.text(), f"{_DETAIL}?{query}", int(values[2])))
        elif (href := n.attributes.get("href") or "").startswith(_ELSEWHERE) and not sent:
            out.append(entry | _entry(elsewhere=href))
            sent = True
    return out


_SCALARS, _LISTS = ("relator", "procedencia", "classe"), ("materia", "partes")
_PLAIN = str.maketrans("éêá", "eea", ":")


def gazette_detail(page: str | None) -> dict:
    """classe, procedencia, relator, partes, materia, and decisions: each text with the download that follows it."""
    root = tree(page)
    out: dict = dict.fromkeys(_SCALARS) | {k: [] for k in (*_LISTS, "decisoes")}
    dl = next(iter(root.named("dl")), None)
    cells = [c for c in dl.children if isinstance(c, Node) and c.name in ("dt", "dd")] if dl else []
    for a, b in zip(cells, cells[1:], strict=False):
        field = a.text().lower().translate(_PLAIN)
        if (a.name, b.name) == ("dt", "dd") and field in (*_SCALARS, *_LISTS):
            items = [li.text(" ") for li in b.named("li")]
            whole = b.text(" ") or None
            out[field] = (items or ([whole] if whole else [])) if field in _LISTS else "; ".join(items) if items else whole
    waiting = None
    for p in (root.by_id("andamentos") or root).named("p"):
        link = next((a for a in p.named("a") if a.attributes.get("href")), None)
        if p.has("text-right") and link is not None:
            if waiting is not None:
                out["decisoes"].append({"kind": "ementa" if waiting.startswith("EMENTA:") else "decisao", "texto": waiting, "rtf_url": link.attributes["href"].strip()})
                waiting = None
        elif t := " ".join(s for line in "\n".join(p.texts()).splitlines() if (s := line.strip())):
            waiting = t
    return out


# as functions over columns

_S, _I = T.StringType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_LIST = T.ArrayType(_S)
SHAPES: dict[str, tuple[Callable, T.DataType]] = {
    "detail": (detail_fields, _struct(incidente=_I, badges=_LIST, classe=_S, relator=_S, meio=_S, publicidade=_S, numero_unico=_S)),
    "info": (info_fields, _struct(assuntos=_LIST, data_protocolo=_S, orgao_origem=_S, origem=_S, numero_origem=_LIST, volumes=_I, folhas=_I, apensos=_I)),
    "parties": (parties, T.ArrayType(_struct(index=_I, tipo=_S, nome=_S))),
    "events": (events, T.ArrayType(_struct(index=_I, data=_S, nome=_S, complemento=_S, julgador=_S, link=_struct(tipo=_S, url=_S)))),
    "moves": (moves, T.ArrayType(_struct(index=_I, guia=_S, recebido_por=_S, data_recebido=_S, enviado_por=_S, data_enviado=_S))),
    "petitions": (petitions, T.ArrayType(_struct(index=_I, id=_S, data=_S, recebido_data=_S, recebido_por=_S))),
    "appeals": (appeals, T.ArrayType(_struct(index=_I, tipo=_S))),
    "gazette_listing": (gazette_listing, T.ArrayType(_struct(numero=_I, data=_S, secao=_S, subsecao=_S, titulo=_S, detail_url=_S, incidente_linked=_I, external_redirect=_S))),
    "gazette_detail": (gazette_detail, _struct(classe=_S, procedencia=_S, relator=_S, partes=_LIST, materia=_LIST, decisoes=T.ArrayType(_struct(kind=_S, texto=_S, rtf_url=_S)))),
}


def extracted(pages: DataFrame, kind: str, html: str = "html", out: str = "fields") -> DataFrame:
    """``pages`` with what a page of a kind holds in ``out``; null pages give what empty ones do."""
    function, shape = SHAPES[kind]

    # in Arrow batches; the page alone goes to Python, the other columns stay where they are
    ship(pages.sparkSession)

    def batch(page: pa.Array) -> pa.Array:
        return pa.array([function(p) for p in page.to_pylist()], kept)

    kept = to_arrow_type(shape)
    batch.__annotations__ = {"page": pa.Array, "return": pa.Array}  # as types, not as this module's texts
    # called non-deterministic, as else the filter that an explode of the fields brings is pushed below, and every page
    # is read twice
    return pages.withColumn(out, F.arrow_udf(batch, shape).asNondeterministic()(F.col(html)))


def assembled(detail: DataFrame, info: DataFrame, partes: DataFrame, andamentos: DataFrame, key: str = "incidente_id", sessao_virtual: DataFrame | None = None, publicacoes_dje: DataFrame | None = None, **more: DataFrame) -> DataFrame:
    """One row a case with the fields of all its pages, each given as (key, fields); a page that is missing gives nulls.
    ``sessao_virtual`` and ``publicacoes_dje`` are (key, fields) with the lists that ``session_entries`` and
    ``gazette_entries`` make; ``more`` are further pages (moves, petitions, appeals) under their names. With all of them
    it is a whole case: primeiro_autor and outcome are derived, and lists that are missing are empty."""
    out = detail.select(key, F.col("fields").alias("d"))
    lists = {"partes": partes, "andamentos": andamentos, "sessao_virtual": sessao_virtual, "publicacoes_dje": publicacoes_dje, **more}
    lists = {k: v for k, v in lists.items() if v is not None}
    for name, df in ({"i": info} | lists).items():
        out = out.join(df.select(key, F.col("fields").alias(name)), key, "left")
    if sessao_virtual is None:
        return out.select(key, "d.*", "i.*", *lists)
    filled = [F.coalesce(F.col(n), F.array().cast(out.schema[n].dataType)).alias(n) for n in lists]
    held = F.transform(F.coalesce(F.col("sessao_virtual"), F.array().cast(out.schema["sessao_virtual"].dataType)), lambda s: F.struct(s["metadata"].alias("metadata"), s["voto_relator"].alias("voto_relator")))
    events = F.coalesce(F.col("andamentos"), F.array().cast(out.schema["andamentos"].dataType))
    return out.select(key, "d.*", "i.*", *filled, legal.primeiro_autor(F.col("partes")).alias("primeiro_autor"), legal.derive_outcome(held, events).alias("outcome"))


def with_details(listing: DataFrame, details: DataFrame) -> DataFrame:
    """Gazette entries with what their detail page says, by its address."""
    return listing.join(details, "detail_url", "left")


def gazette_entries(listings: DataFrame, details: DataFrame, key: str = "incidente_id") -> DataFrame:
    """(key, fields): each case's gazette entries in the order of its listing, (key, fields), each with the fields of its
    page, (detail_url, fields); an entry whose page is missing has null ones and no decisions."""
    rows = listings.select(key, F.posexplode("fields").alias("at", "e"))
    found = details.select(F.col("detail_url").alias("_url"), F.col("fields").alias("f"))
    j = rows.join(found, F.col("e.detail_url") == F.col("_url"), "left")
    decisions = F.transform(F.coalesce(F.col("f.decisoes"), F.array().cast("array<struct<kind:string,texto:string,rtf_url:string>>")), lambda d: F.struct(d["kind"].alias("kind"), d["texto"].alias("texto"), F.when(d["rtf_url"].isNotNull(), F.struct(d["rtf_url"].alias("url"))).alias("rtf")))
    entry = F.struct("at", "e.*", *[F.col(f"f.{c}").alias(c) for c in ("classe", "procedencia", "relator", "partes", "materia")], decisions.alias("decisoes"))
    g = j.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("x"))
    return g.select(key, F.transform("x", lambda t: t.dropFields("at")).alias("fields"))


# sessions and themes: JSON

_NAME = "struct<descricao:string>"
_TEXT = "struct<link:string,descricao:string>"
_SITTING = f"struct<nomeLista:string,cabecalho:string,ministroRelator:{_NAME},sessao:struct<dataInicio:string,dataPrevistaFim:string,colegiado:{_NAME}>,relatorioRelator:{_TEXT},votoRelator:{_TEXT},ministroVista:struct<descricao:string,textos:array<{_TEXT}>>,votos:array<struct<tipoVoto:struct<codigo:string>,ministro:{_NAME},textos:array<{_TEXT}>>>>"
SESSIONS = f"array<struct<objetoIncidente:struct<id:int,identificacao:string,identificacaoCompleta:string>,listasJulgamento:array<{_SITTING}>>>"


def subjects(body: Column) -> Column:
    """array<struct(id, identificacao, identificacaoCompleta)> of a listing of subjects; malformed answers have none."""
    all_of = F.transform(F.from_json(body, SESSIONS), lambda e: e["objetoIncidente"])
    return F.coalesce(F.filter(all_of, lambda o: o["id"].isNotNull()), F.array().cast("array<struct<id:int,identificacao:string,identificacaoCompleta:string>>"))


def _cast(votes: Column, code: str) -> Column:
    return F.filter(F.transform(F.filter(votes, lambda v: v["tipoVoto"]["codigo"] == code), lambda v: v["ministro"]["descricao"]), lambda n: n.isNotNull())


def _given(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), F.array(c)).otherwise(F.array().cast("array<string>"))


def sittings(answers: DataFrame, body: str = "body") -> DataFrame:
    """A row for each list of each subject of each answer: the columns of ``answers``, metadata, votes, documents in the
    answer's order, the rapporteur's vote as text, and the title. Malformed answers give no row."""
    rest = [c for c in answers.columns if c != body]
    rows = answers.select(*rest, F.explode(F.from_json(body, SESSIONS)).alias("e")).select(*rest, F.col("e.objetoIncidente").alias("o"), F.explode("e.listasJulgamento").alias("l"))
    x, empty = F.col("l"), F.lit("")
    votes = F.coalesce(x["votos"], F.array().cast("array<struct<tipoVoto:struct<codigo:string>,ministro:struct<descricao:string>,textos:array<struct<link:string,descricao:string>>>>"))
    document = lambda kind, url: F.struct(kind.alias("tipo"), url.alias("url"))
    texts = F.flatten(F.transform(votes, lambda v: F.coalesce(v["textos"], F.array().cast(f"array<{_TEXT}>"))))
    documents = F.concat(
        F.array(document(F.lit("Relatório"), x["relatorioRelator"]["link"]), document(F.coalesce(F.nullif(x["votoRelator"]["descricao"], empty), F.lit("Voto")), x["votoRelator"]["link"])),
        F.transform(F.coalesce(x["ministroVista"]["textos"], F.array().cast(f"array<{_TEXT}>")), lambda t: document(F.lit("Voto Vista"), t["link"])),
        F.transform(texts, lambda t: document(F.coalesce(F.nullif(t["descricao"], empty), F.lit("Voto")), t["link"])),
    )
    return rows.select(
        *rest,
        F.struct(
            F.coalesce(x["ministroRelator"]["descricao"], empty).alias("relator"), F.coalesce(x["sessao"]["colegiado"]["descricao"], empty).alias("orgao_julgador"), F.coalesce(x["nomeLista"], empty).alias("lista"),
            F.coalesce("o.identificacao", empty).alias("processo"), tx.to_iso(x["sessao"]["dataInicio"]).alias("data_inicio"), tx.to_iso(x["sessao"]["dataPrevistaFim"]).alias("data_fim_prevista"),
        ).alias("metadata"),
        F.struct(_given(x["ministroRelator"]["descricao"]).alias("relator"), _cast(votes, "9").alias("acompanha_relator"), _cast(votes, "7").alias("diverge_relator"), _cast(votes, "8").alias("acompanha_divergencia"), _given(x["ministroVista"]["descricao"]).alias("pedido_vista")).alias("votes"),
        F.filter(documents, lambda d: d["url"] != "").alias("documentos"),
        tx.strip_html(F.coalesce(x["cabecalho"], empty)).alias("voto_relator"),
        F.coalesce("o.identificacaoCompleta", empty).alias("julgamento_item_titulo"),
    )


_CASE = "struct<numeroTema:int,tituloTema:string,dataInicioJulgamento:string,dataFimPrevistaJulgamento:string,siglaClasse:string,numeroProcesso:int,relator:string,placar:struct<ministro:string>>"
_JUDGE = "array<struct<nomeMinistro:string,votoQC:string,votoRG:string,votoRJ:string>>"


def themes(answers: DataFrame, body: str = "body") -> DataFrame:
    """A row for each leading case of a theme; one case, and one judge, may stand without a list around it."""
    rest = [c for c in answers.columns if c != body]
    cases = F.get_json_object(body, "$.package.repercussaoGeral.processoLeadingCase")
    as_list = lambda c: F.when(c.startswith("["), c).otherwise(F.concat(F.lit("["), c, F.lit("]")))
    rows = answers.select(*rest, F.explode(F.from_json(as_list(cases), f"array<{_CASE}>")).alias("p"))
    title = F.concat(F.format_string("Tema %d", F.col("p.numeroTema")), F.coalesce(F.concat(F.lit(" - "), F.nullif("p.tituloTema", F.lit(""))), F.lit("")))
    votes = F.from_json(as_list(F.col("p.placar.ministro")), _JUDGE)
    return rows.select(
        *rest, F.lit("tema").alias("tipo"), F.col("p.numeroTema").alias("tema"), F.col("p.tituloTema").alias("titulo"), tx.to_iso(F.col("p.dataInicioJulgamento")).alias("data_inicio"), tx.to_iso(F.col("p.dataFimPrevistaJulgamento")).alias("data_fim_prevista"),
        F.col("p.siglaClasse").alias("classe"), F.col("p.numeroProcesso").alias("numero"), "p.relator", F.coalesce(votes, F.array().cast(_JUDGE)).alias("votos"), title.alias("julgamento_item_titulo"),
    )


Fetch = Callable[[str, DataFrame], DataFrame]


def session_entries(cases: DataFrame, fetch: Fetch, key: str = "incidente") -> DataFrame:
    """(key, fields): the session entries of each of ``cases`` (key, tema): those of its theme first, then those of every
    subject of its own, in their order.

    ``fetch(what, asked)`` answers questions: for ``what`` "tema", "oi" or "sessaoVirtual" it returns ``asked``, a table
    with a column ``value``, with the answers' text in ``body``, null where there was none. A part whose answer is
    missing or malformed has no entries; the others stay. Cases without any have an empty list.
    """
    answer = lambda what, asked: fetch(what, asked)
    of_theme = themes(answer("tema", cases.where("tema IS NOT NULL").select(key, F.col("tema").alias("value"))).where(F.try_parse_json("body").isNotNull()).select(key, "body"))
    none = F.lit(None).cast("string")
    entry = lambda tipo, metadata, documents, vote, title: F.struct(tipo.alias("tipo"), metadata.alias("metadata"), documents.alias("documentos"), vote.alias("voto_relator"), title.alias("julgamento_item_titulo"))
    when = F.struct(F.col("relator").alias("relator"), F.col("data_inicio").alias("data_inicio"), F.col("data_fim_prevista").alias("data_fim_prevista"))
    a = of_theme.select(key, F.struct(F.lit(0).alias("part"), F.lit(0).alias("i"), F.col("tema").cast("bigint").alias("j")).alias("at"), entry(F.lit("tema"), when, F.array().cast("array<struct<tipo:string,url:string>>"), none, F.col("julgamento_item_titulo")).alias("e"))
    own = answer("oi", cases.select(key, F.col(key).alias("value"))).select(key, F.posexplode(subjects(F.col("body"))).alias("i", "o"))
    held = sittings(answer("sessaoVirtual", own.select(key, "i", F.col("o.id").alias("value"))).drop("value"))
    meta = F.struct("metadata.relator", "metadata.data_inicio", "metadata.data_fim_prevista")
    at = F.struct(F.lit(1).alias("part"), "i", F.monotonically_increasing_id().alias("j"))
    b = held.select(key, at.alias("at"), entry(F.lit("sessao"), meta, F.col("documentos"), F.col("voto_relator"), F.col("julgamento_item_titulo")).alias("e"))
    g = a.unionByName(b).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "e"))).alias("x")).select(key, F.col("x.e").alias("fields"))
    out = cases.select(key).distinct().join(g, key, "left")
    return out.withColumn("fields", F.coalesce("fields", F.array().cast(g.schema["fields"].dataType)))
