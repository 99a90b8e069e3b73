"""Pages and answers of the portal, as small examples of their forms."""

import json

from pyspark.sql import functions as F

from docketry.sources import portal



def el(css, inside, tag="div", **more):
    attributes = {"class": css} if css else {}
    return "<" + " ".join([tag, *(f'{k}="{v}"' for k, v in (attributes | more).items())]) + ">" + inside + f"</{tag}>"


def bold(label, value):
    return el("", el("processo-detalhes-bold", label + ":") + el("x", value))


DETAIL = '<input id="incidente" value="123">' + "".join(el(f"badge bg-{c}", t, "span") for c, t in (("primary", "Processo Eletrônico"), ("success", "Público"), ("danger", "Réu Preso")))
DETAIL += el("processo-rotulo", "Número Único: 0001-22") + el("processo-dados", "Classe: HC") + el("processo-dados", "Relator(a): MIN. FULANO &amp; CIA")
INFO = el("informacoes__assunto", "<ul><li> Direito  Penal </li><li></li></ul>") + bold("Data de Protocolo", "03/02/2020") + bold("Número de Origem", "001, 002,") + el("", "STJ", "span", id="orgao-procedencia") + el("processo-quadro", el("numero", "3") + el("rotulo", "Volumes"))
LINK = el("", " Decisão  monocrática ", "a", href="peca.asp?a=1&amp;b=2")
EVENTS = el("andamento-item", el("andamento-data", "05/06/2020") + el("andamento-nome", "Remessa, GUIA Nº 3/2020", "h5") + el("col-md-9", "um\n dois") + el("andamento-julgador", "MIN. X", "span") + LINK) + el("andamento-item", el("andamento-nome", "Autuado"))
MOVES = el("lista-dados", el("", el("processo-detalhes-bold", "Recebido por GABINETE em 02/03/2020", "span") + el("processo-detalhes", "Enviado por SECRETARIA em 01/03/2020", "span")) + el("text-right", el("processo-detalhes", "Guia: Nº 12/2020", "span")))
PETITIONS = el("lista-dados", el("processo-detalhes-bold", "77/2020", "span") + el("processo-detalhes", "Peticionado em 01/02/2020", "span") + el("", "Recebido em 20/08/2020 11:51:26 por SETOR", "span"))
CALL = "abreDetalheDiarioProcesso({}, '03/06/2020', {}, 2, 3, 4)"
LISTING = el("", "before", "a", onclick=CALL.format(1, 1)) + "".join(el("", t, "strong") for t in ("DJ Nr. 137 do dia 03/06/2020", "Acórdãos", "&nbsp;Primeira Turma")) + el("", "HC 1", "a", onclick=CALL.format(137, 99))
LISTING += el("", "DJ do dia 26/02/2024", "strong") + "".join(el("", t, "a", href=f"{portal._ELSEWHERE}/{t}") for t in "12")
DOWN = lambda url: el("text-right", el("", "RTF", "a", href=url), "p")
GAZETTE = "<dl>" + "".join(f"<dt>{k}:</dt><dd>{v}</dd>" for k, v in (("Partes", "<ul><li>A</li><li>B</li></ul>"), ("Classe", "HC"), ("Outra", "z"))) + "</dl>" + el("", "<p>EMENTA: um<br> dois</p>" + DOWN(" u1 ") + DOWN("u2") + "<p>Decisão: x</p>" + DOWN("u3"), id="andamentos")


def run(spark, kind, page):
    rows = portal.extracted(spark.createDataFrame([(page,), (None,)], "html string"), kind).collect()
    return rows[0].asDict(True)["fields"], rows[1].asDict(True)["fields"]


def test_pages(spark):
    got, none = run(spark, "detail", DETAIL)
    assert got == dict(numero_unico="0001-22", publicidade="PUBLICO", incidente=123, badges=["Réu Preso"], classe="HC", relator="FULANO & CIA", meio="ELETRONICO") and none["classe"] is None and none["badges"] == []
    got, none = run(spark, "info", INFO)
    assert got == {"assuntos": ["Direito Penal"], "data_protocolo": "2020-02-03", "orgao_origem": "STJ", "origem": None, "numero_origem": ["001", "002"], "volumes": 3, "folhas": None, "apensos": None} and none["numero_origem"] is None
    got, none = run(spark, "events", EVENTS)
    assert got[0] == dict(link=dict(url=f"{portal.PORTAL}/processos/peca.asp?a=1&b=2", tipo="DECISÃO MONOCRÁTICA"), index=2, data="2020-06-05", nome="REMESSA", complemento="um dois", julgador="MIN. X")
    assert got[1]["index"] == 1 and got[1]["link"] is None and none == []
    got, _ = run(spark, "moves", MOVES)
    assert got == [{"index": 1, "guia": "12/2020", "recebido_por": "GABINETE", "data_recebido": "2020-03-02", "enviado_por": "SECRETARIA", "data_enviado": "2020-03-01"}]
    got, _ = run(spark, "petitions", PETITIONS)
    assert got == [{"index": 1, "id": "77/2020", "data": "2020-02-01", "recebido_data": "2020-08-20T11:51:26", "recebido_por": "SETOR"}]
    assert run(spark, "appeals", PETITIONS)[0] == [{"index": 1, "tipo": "77/2020"}]
    got, _ = run(spark, "parties", el("", el("detalhe-parte", "IMPTE.(S)") + el("nome-parte", " A  B ") + el("detalhe-parte", "") + el("nome-parte", "C"), id="todas-partes"))
    assert got == [dict(nome="A B", tipo="IMPTE.(S)", index=1)]


def test_gazette(spark):
    got, none = run(spark, "gazette_listing", LISTING)
    assert [(e["numero"], e["data"], e["secao"], e["subsecao"], e["titulo"], e["incidente_linked"], e["external_redirect"]) for e in got] == [
        (137, "2020-06-03", "Acórdãos", "Primeira Turma", "HC 1", 99, None),
        (None, "2024-02-26", "", "", "", None, f"{portal._ELSEWHERE}/1"),
    ]
    assert got[0]["detail_url"].endswith("?numDj=137&dataPublicacaoDj=03/06/2020&incidente=99&codCapitulo=2&numMateria=3&codMateria=4") and none == []
    got, _ = run(spark, "gazette_detail", GAZETTE)
    assert (got["classe"], got["partes"], got["materia"]) == ("HC", ["A", "B"], [])
    assert [tuple(e[k] for k in ("rtf_url", "texto", "kind")) for e in got["decisoes"]] == [("u1", "EMENTA: um dois", "ementa"), ("u3", "Decisão: x", "decisao")]


def test_sessions(spark):
    name = lambda n: {"descricao": n}
    body = [{"objetoIncidente": {"id": 5, "identificacao": "HC 1", "identificacaoCompleta": "Agravo"}, "listasJulgamento": [{"nomeLista": "L1", "cabecalho": "<p>Nego&nbsp;provimento</p>", "ministroRelator": name("R"), "sessao": {"dataInicio": "01/02/2020", "colegiado": name("1T")}, "relatorioRelator": {"link": "a.pdf"}, "votoRelator": {"link": "b.pdf", "descricao": ""},
             "ministroVista": {"descricao": "V", "textos": [{"link": "c.pdf"}]}, "votos": [{"tipoVoto": {"codigo": 9}, "ministro": name("M"), "textos": [{"link": "d.pdf", "descricao": "Voto Vogal"}]}, {"tipoVoto": {"codigo": 3}, "ministro": name("N")}]}]}, {"objetoIncidente": {}}]
    d = spark.createDataFrame([(1, json.dumps(body)), (2, "{oops"), (3, None)], "k int, body string")
    r = portal.sittings(d).collect()
    assert len(r) == 1 and r[0]["k"] == 1
    x = r[0].asDict(True)
    assert x["metadata"] == {"relator": "R", "orgao_julgador": "1T", "lista": "L1", "processo": "HC 1", "data_inicio": "2020-02-01", "data_fim_prevista": None}
    assert {k: v for k, v in x["votes"].items() if v} == dict(pedido_vista=["V"], acompanha_relator=["M"], relator=["R"])
    assert [(e["tipo"], e["url"]) for e in x["documentos"]] == [("Relatório", "a.pdf"), ("Voto", "b.pdf"), ("Voto Vista", "c.pdf"), ("Voto Vogal", "d.pdf")]
    assert (x["voto_relator"], x["julgamento_item_titulo"]) == ("Nego provimento", "Agravo")
    assert [len(r[0]) for r in d.orderBy("k").select(portal.subjects(F.col("body"))).collect()] == [1, 0, 0]
    case = dict(siglaClasse="RE", numeroProcesso=10, tituloTema="T", numeroTema=7, placar=dict(ministro=dict(votoRG="S", nomeMinistro="M")))
    theme = dict(package=dict(repercussaoGeral=dict(processoLeadingCase=case)))
    t = portal.themes(spark.createDataFrame([(json.dumps(theme),), ("{}",)], "body string")).collect()
    assert [(r["tema"], r["julgamento_item_titulo"], r["votos"][0]["votoRG"]) for r in t] == [(7, "Tema 7 - T", "S")]


def test_pages_are_read_once(spark):
    pages = spark.createDataFrame([("<p>x</p>",)], "html string")
    d = portal.extracted(pages, "events").select(F.explode("fields").alias("e")).select("e.index")
    assert d._jdf.queryExecution().executedPlan().toString().count("batch(") == 1
    assert d.collect() == []


def test_plain_tree_is_the_standard_parsers():
    def dump(n):
        return n.name, n.attributes, n.text("|"), [m.name for m in n.walk()], [c if isinstance(c, str) else dump(c) for c in n.children]

    plain = ("", "a &amp; b&nbsp", LISTING, GAZETTE, DETAIL, "<!DOCTYPE html><DIV ID='a' class=\"x y\" id=\"b\">t<br/>u<p>v</div>w</i><!-- c -->z", "<li>a<li>b</ul></li>c")
    for page in plain:
        assert dump(portal._plain_tree(page)) == dump(portal.standard_tree(page)), page
    for page in ("a < b", "<a href=x>t</a>", "<i checked>t", "<a href='a&amp;b'>t", "<script>'<b>'</script>t", "<div/>t", "<!--a--b-->t", "<p <b>t", "<title>&lt;</title>", "</ p>t"):
        assert portal._plain_tree(page) is None and dump(portal.tree(page)) == dump(portal.standard_tree(page)), page
