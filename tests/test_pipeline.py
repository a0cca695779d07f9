import copy

import pytest
from pyspark.sql import functions as F

from provenio.operators import compare as C
from provenio.plans import pipeline as P
from provenio.plans.pipeline import Rules
from tests import policies as D


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(D.PAGES, D.PAGES_SCHEMA)


@pytest.fixture(scope="module")
def rules(spark):
    return Rules.of(spark, D.CAMPOS, D.EXTRACAO, D.COERENCIA, D.COMPARACAO, D.CONFORMIDADE)


@pytest.fixture(scope="module")
def facts(pages, rules):
    return P.facts(pages, rules).cache()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(d, d.title(), True) for d in D.SPECS], "doc_id string, label string, is_spec boolean")


def test_facts(facts):
    got = {(r.doc_id, r.field_id): (r.value, r.status) for r in facts.collect()}
    assert len(got) == 3 * len(D.CAMPOS["campos"])
    assert got["aurora", "limite"] == ("5.0E7", "verificado") and got["boreal", "limite"] == ("3.0E7", "verificado")
    assert got["aurora", "franquia"] == ("250000.0", "verificado") and got["aurora", "retroatividade"] == ("ilimitada", "verificado")
    assert got["boreal", "penhora"] == ("nao_contratada", "verificado") and got["boreal", "sublimite"][0] is None
    assert got["aurora", "sublimite"][0] == "5000000.0" and got["aurora", "prazo"] == ("360", "verificado") and got["cruzeiro", "prazo"][1] == "nao_localizado"


def test_every_verified_quote_is_found_again(facts, pages):
    from provenio.operators.verify import locate

    quotes = facts.where("status = 'verificado'").select("doc_id", F.col("field_id").alias("quote_id"), "quote", "page")
    assert locate(quotes, pages).where("similarity < 0.9 or found_page <> page").count() == 0


def test_comparison_and_inverted_rule(spark, facts, documents, rules):
    got = {(r.field_id, r.doc_id): r for r in P.compare(facts, documents, rules).collect()}
    assert got["limite", "aurora"].favourability == "mais_favoravel" and got["limite", "boreal"].favourability == "menos_favoravel"
    assert got["franquia", "boreal"].favourability == "menos_favoravel" and got["retroatividade", "aurora"].favourability == "mais_favoravel"
    assert got["custos", "aurora"].favourability == "nao_comparavel" and got["limite", "aurora"].rule_id == "R1"
    turned = copy.deepcopy(D.COMPARACAO)
    turned["regras"][0]["criterio"] = "menor_melhor"
    rules = Rules.of(spark, D.CAMPOS, D.EXTRACAO, D.COERENCIA, turned, D.CONFORMIDADE)
    got = {(r.field_id, r.doc_id): r.favourability for r in P.compare(facts, documents, rules).collect()}
    assert got["limite", "aurora"] == "menos_favoravel"


def test_alerts_and_summary(facts, pages, documents, rules):
    alerts = P.alerts(facts, pages, rules)
    got = {(r.rule_id, r.doc_id): r for r in alerts.collect()}
    assert {d for r, d in got if r == "prazo-ausente"} == {"cruzeiro"}
    assert "ausência" in got["prazo-ausente", "cruzeiro"].message and got["observacoes", "aurora"].page == 1  # the window begins with the last line of page 1
    lines = [r.line for r in C.summary(P.compare(facts, documents, rules), alerts).collect()]
    assert lines[0].startswith("- Aurora:") and lines[-1] == "- Conformidade: 1 ponto(s) de atenção para revisão humana."


def test_questions(pages):
    got = P.ask("Qual é a franquia por reclamação?", pages).collect()
    assert got and any("ranquia" in r.quote for r in got)
    assert P.ask("?", pages).count() == 0


def test_model_and_lessons_in_the_plan(spark, facts, pages, rules, tmp_path):
    """An obedient model changes nothing that is shown without proof; a lesson is used again where the wording is the same."""
    import json

    log = tmp_path / "asked"

    def provider():
        def ask(system, user):
            with open(log, "a") as f:
                f.write("x\n")
            said = [{"campo": "limite", "valor": "R$ 1,00", "trecho": "Limite Máximo de Garantia: R$ 1,00", "pagina": 1}, {"campo": "custos", "valor": "dentro", "trecho": "o tomador declara conhecer as condições", "pagina": 2}]
            said += [{"campo": "prazo", "valor": "999 dias", "trecho": "um prazo que ninguém escreveu aqui", "pagina": 1}, {"campo": "nenhum", "valor": "x", "trecho": "x", "pagina": 1}]
            return "Claro: " + json.dumps({"campos": said})

        return ask

    fused = P.with_model(facts, pages, rules, provider, str(tmp_path / "cache"))
    got = {(r.doc_id, r.field_id): r for r in fused.collect()}
    again = P.with_model(facts, pages, rules, provider, str(tmp_path / "cache"))
    assert again.count() == len(got) == 3 * len(D.CAMPOS["campos"])
    groups = {c["grupo"] for c in D.CAMPOS["campos"]}
    assert len(log.read_text().split()) == 3 * len(groups)  # once a group and document, over all actions
    for (doc, field), r in got.items():
        if r.status == "verificado":
            assert r.source == "rule" and field != "custos"
    assert got["aurora", "limite"].value == "5.0E7" and got["cruzeiro", "prazo"].status == "nao_verificado" and got["cruzeiro", "prazo"].value is None
    lesson = [("L1", "aurora", "custos", "dentro", "o tomador declara conhecer as condições", 1, None, 1), ("L2", "aurora", "limite", "2.0", "Limite Máximo de Garantia: R$ 2,00", 1, None, 2)]
    lessons = spark.createDataFrame(lesson, "lesson_id string, doc_id string, field_id string, value string, quote string, page int, insurer string, created_at int")
    taught = {(r.doc_id, r.field_id): r for r in P.with_lessons(facts, pages, rules, lessons).collect()}
    assert len(taught) == len(got)
    for doc in D.SPECS:
        r = taught[doc, "custos"]
        assert (r.value, r.status, r.page, r.note) == ("dentro", "verificado", 2, "lição L1")
        assert taught[doc, "limite"].value == got[doc, "limite"].value


def test_summaries_of_two_sets(spark):
    """A document in two sets, and sets that differ in what is judged."""
    facts = spark.createDataFrame([("a", "f", "1", "verificado"), ("b", "f", "2", "verificado"), ("c", "f", "2", "verificado"), ("a", "g", "5", "verificado")], "doc_id string, field_id string, value string, status string")
    docs = spark.createDataFrame([(1, "a", "A", True), (1, "b", "B", True), (2, "a", "A", True), (2, "c", "C", True), (3, "b", "B", True), (3, "c", "C", True)], "set_id int, doc_id string, label string, is_spec boolean")
    fields = spark.createDataFrame([("f", 1, "g", "F", "enum", "ambos"), ("g", 2, "g", "G", "enum", "ambos")], "field_id string, field_ord int, grp string, label string, kind string, applies_to string")
    rules = spark.createDataFrame([("f", "R1", "maior_melhor", [], None, "x")], "field_id string, rule_id string, criterion string, tiers array<array<string>>, absent_as string, reason string")
    compared = C.comparison(facts, docs, fields, rules).cache()
    board = {(r.set_id, r.doc_id): (r.mais_favoravel, r.menos_favoravel, r.equivalente) for r in C.scoreboard(compared).collect()}
    assert board == {(1, "a"): (0, 1, 0), (1, "b"): (1, 0, 0), (2, "a"): (0, 1, 0), (2, "c"): (1, 0, 0), (3, "b"): (0, 0, 1), (3, "c"): (0, 0, 1)}
    rows = {(r.set_id, r.field_label): r for r in C.matrix(compared, ["a", "b", "c"]).collect()}
    assert rows[1, "F"].judged and not rows[3, "F"].judged and (rows[1, "F"].a, rows[1, "F"].b, rows[1, "F"].c) == ("1", "2", None)
    alerts = spark.createDataFrame([("b", "atencao"), ("b", "informativo"), ("z", "atencao")], "doc_id string, severity string")
    lines = {s: [r.line for r in C.summary(compared, alerts).collect() if r.set_id == s] for s in (1, 2, 3)}
    assert lines[1] == ["- A: 0 campo(s) mais favoráveis e 1 menos favoráveis ao segurado.", "- B: 1 campo(s) mais favoráveis e 0 menos favoráveis ao segurado.", "- F: mais favorável em B (A: 1; B: 2).", "- Conformidade: 1 ponto(s) de atenção para revisão humana."]
    assert len(lines[2]) == 3 and "- F: mais favorável em C (A: 1; C: 2)." in lines[2] and len(lines[3]) == 3
