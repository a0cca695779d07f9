"""The whole plan from pages to facts over specifications that suppliers' rows are written out as, and its accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenio.functions import text as T
from provenio.operators import evaluate as E
from provenio.operators import matching as M
from provenio.operators import verify as V
from provenio.plans import pipeline as P
from provenio.queries.base import query, table
from provenio.session import staged

CAMPOS = {
    "campos": [
        {"id": "limite", "grupo": "limites", "rotulo": "Limite", "tipo": "dinheiro", "onde": "espec", "pistas": ["limite máximo"], "rotulos_espec": ["Limite Máximo de Garantia"]},
        {"id": "franquia", "grupo": "limites", "rotulo": "Franquia", "tipo": "dinheiro", "onde": "espec", "pistas": ["franquia", "reclamação"], "rotulos_espec": ["Franquia por reclamação"]},
        {"id": "retroatividade", "grupo": "gatilho", "rotulo": "Retroatividade", "tipo": "data", "onde": "espec", "pistas": ["retroatividade"], "rotulos_espec": ["Data de Retroatividade"]},
        {"id": "penhora", "grupo": "coberturas", "rotulo": "Penhora online", "tipo": "cobertura", "onde": "ambos", "pistas": ["penhora"]},
        {"id": "sublimite", "grupo": "limites", "rotulo": "Sublimite", "tipo": "dinheiro", "onde": "espec", "pistas": ["penhora"], "linha_tabela": "penhora online"},
        {"id": "prazo", "grupo": "gatilho", "rotulo": "Prazo complementar", "tipo": "duracao", "onde": "ambos", "pistas": ["prazo complementar"]},
        {"id": "custos", "grupo": "geral", "rotulo": "Custos", "tipo": "enum", "onde": "cg", "pistas": ["custos"], "valores": {"dentro": "dentro"}},
    ]
}
EXTRACAO = {
    "enums": {"custos": {"regras": [{"valor": "dentro", "regex": "custos dentro do limite"}]}},
    "duracoes": {"prazo": {"regras": [{"extrair": True, "regex": r"prazo complementar: [0-9]{1,3} \([a-z ]+\) meses"}]}},
    "coberturas": {
        "penhora": {"titulo": "penhora", "linha_espec": "penhora online"}, "escopo_basico": "riscos cobertos", "marcador_adicional": "cobertura adicional", "texto_basico": {}, "exclusao_geral": {},
    },
    "exclusoes": {"escopo_titulo": "exclusoes", "titulo_opcional": "clausula particular de exclusao", "ressalva": "salvo", "temas": {"cibernetica": "virus"}},
}
COERENCIA = {"por_tipo": {"cobertura": {"contratada": "contratad", "nao_contratada": "nao contratad"}}, "por_campo": {}}


def rules(spark: SparkSession) -> P.Rules:
    return P.Rules.of(spark, CAMPOS, EXTRACAO, COERENCIA, {"regras": []}, {"regras": []})


def policies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pages, gold): a specification of two pages for each supplier, and what it says; some lack a term or have a coverage not contracted."""
    n = F.col("s_suppkey")
    limit, excess, part = ((n % 90 + 10) * 1_000_000).cast("double"), ((n % 40 + 1) * 2_500).cast("double"), ((n % 9 + 1) * 100_000).cast("double")
    day = F.date_add(F.lit("2010-01-01").cast("date"), (n % 3000).cast("int"))
    unlimited, contracted, term = n % 4 == 0, n % 3 != 0, n % 5 != 0
    own = table(spark, sf_dir, "supplier").where("s_suppkey is not null").select(
        n.cast("string").alias("doc_id"), limit.alias("limit"), excess.alias("excess"), part.alias("part"), day.alias("day"), unlimited.alias("unlimited"), contracted.alias("contracted"), term.alias("term"),
    )
    since = F.when(F.col("unlimited"), F.lit(T.UNLIMITED)).otherwise(F.date_format("day", "dd/MM/yyyy"))
    first = F.concat_ws(
        "\n", F.lit("DOCUMENTO FICTÍCIO"), F.lit("ESPECIFICAÇÃO DA APÓLICE"), F.concat(F.lit("Limite Máximo de Garantia: "), T.format_money(F.col("limit"))), F.lit("Franquia"), F.lit("por reclamação:"),
        T.format_money(F.col("excess")), F.concat(F.lit("Data de Retroatividade: "), since), F.lit("Penhora online"), F.when(F.col("contracted"), "Contratada").otherwise("Não contratada"),
        F.when(F.col("contracted"), T.format_money(F.col("part"))).otherwise("-"), F.when(F.col("term"), "Prazo complementar: 12 (doze) meses").otherwise("Sem prazo adicional."),
    )
    page = F.array(F.struct(F.lit(1).alias("page_no"), first.alias("text")), F.struct(F.lit(2).alias("page_no"), F.lit("Observações: o tomador declara conhecer as condições.").alias("text")))
    pages = own.select("doc_id", F.explode(page).alias("p")).select("doc_id", "p.page_no", "p.text", F.lit(True).alias("is_synthetic"))
    said = lambda field, kind, value: F.struct(F.lit(field).alias("field_id"), F.lit(kind).alias("kind"), F.array(value).alias("accepted"))
    gold = F.array(
        said("limite", "dinheiro", F.col("limit").cast("string")), said("franquia", "dinheiro", F.col("excess").cast("string")),
        said("retroatividade", "data", F.when(F.col("unlimited"), F.lit(T.UNLIMITED)).otherwise(F.col("day").cast("string"))),
        said("penhora", "cobertura", F.when(F.col("contracted"), "contratada").otherwise("nao_contratada")),
        said("sublimite", "dinheiro", F.when(F.col("contracted"), F.col("part").cast("string"))), said("prazo", "duracao", F.when(F.col("term"), "360")),
    )
    return pages, own.select(F.col("doc_id").alias("document"), F.explode(gold).alias("g")).select("document", "g.*")


@query("""WITH f(field_id) AS (VALUES ('limite'), ('franquia'), ('retroatividade'), ('penhora'), ('sublimite'), ('prazo'))
    SELECT field_id, count(*) AS fields, count(*) AS hits, CAST(0 AS BIGINT) AS wrong, 1.0 AS accuracy FROM f CROSS JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey IS NOT NULL) GROUP BY field_id
    UNION ALL SELECT NULL, count(*), count(*), 0, 1.0 FROM f CROSS JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey IS NOT NULL)""")
def policy_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the whole plan on authored specifications, by field and in all: rules only, every value read and none wrong."""
    pages, gold = policies(spark, sf_dir)
    found = P.facts(staged(pages), rules(spark))
    return E.metrics(E.details(gold, found), [["field_id"], []]).select("field_id", "fields", "hits", "wrong", "accuracy")


_SPEC = """s AS (SELECT s_suppkey AS n, CAST(s_suppkey AS VARCHAR) AS doc_id FROM supplier WHERE s_suppkey IS NOT NULL)"""


@query(f"""WITH {_SPEC} SELECT doc_id, 'penhora' AS field_id, CASE WHEN n % 3 <> 0 THEN 'contratada' ELSE 'nao_contratada' END AS value, 1 AS page FROM s
    UNION ALL SELECT doc_id, 'prazo', '360', 1 FROM s WHERE n % 5 <> 0
    UNION ALL SELECT doc_id, 'retroatividade', CASE WHEN n % 4 = 0 THEN 'ilimitada' ELSE CAST(DATE '2010-01-01' + CAST(n % 3000 AS INTEGER) AS VARCHAR) END, 1 FROM s""")
def fact_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified values of some fields: a coverage, a duration and a date, each with its page."""
    pages, _ = policies(spark, sf_dir)
    shown = V.displayable(P.facts(staged(pages), rules(spark)))
    return shown.where(F.col("field_id").isin("penhora", "prazo", "retroatividade")).select("doc_id", "field_id", "value", "page")


@query(f"""WITH {_SPEC}, f(field_id, kind) AS (VALUES ('limite', 'dinheiro'), ('franquia', 'dinheiro'), ('retroatividade', 'data'), ('penhora', 'cobertura'), ('sublimite', 'dinheiro'), ('prazo', 'duracao'), ('custos', 'enum'))
    SELECT doc_id, field_id, kind, CASE WHEN field_id = 'custos' OR (field_id = 'sublimite' AND n % 3 = 0) OR (field_id = 'prazo' AND n % 5 = 0) THEN 'nao_localizado' ELSE 'nao_verificado' END AS status FROM s CROSS JOIN f""")
def candidate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each specification and declared field before verification: found, or why not."""
    pages, _ = policies(spark, sf_dir)
    return P.candidates(staged(pages), rules(spark)).select("doc_id", "field_id", "kind", "status")


def _conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """General conditions from parts: clauses (doc_id, clause_no, title, text, page_map, page_start) of coverages and exclusions."""
    part = table(spark, sf_dir, "part").where("p_partkey is not null")
    n = F.col("p_partkey")
    title = F.when(n % 4 == 0, "1 RISCOS COBERTOS").when(n % 4 == 1, "2 EXCLUSÕES").when(n % 4 == 2, "COBERTURA DE MULTAS").otherwise("CLÁUSULA PARTICULAR DE EXCLUSÃO DE VÍRUS")
    text = F.concat_ws("\n", F.lit("Esta apólice trata de:"), F.when(n % 3 == 0, "a) multas e penalidades;").otherwise("a) outros temas;"), F.when(n % 5 == 0, "b) danos por vírus, salvo se contratada;").otherwise("b) nada mais."))
    pages = F.array_repeat(F.lit(1), 3)
    return part.select(n.alias("doc_id"), F.lit(0).alias("clause_no"), title.alias("title"), text.alias("text"), pages.alias("page_map"), F.lit(1).alias("page_start"))


_RULES = [("multas", "multas", False, "multas e penalidades", None, "multas e penalidades", None)]
_RULES_SCHEMA = "field_id string, title_regex string, always_basic boolean, basic_text string, fallback string, excluded_text string, label string"
_MARKS = {"additional": "cobertura adicional", "basic_scope": "riscos cobertos", "exclusion_scope": "^2 exclusoes", "optional_exclusion": "clausula particular de exclusao", "reservation": "salvo"}


@query("""SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 4 = 1 THEN 'excluida' ELSE 'basica' END AS value, CASE WHEN p_partkey % 4 = 2 THEN 1 WHEN p_partkey % 4 = 0 THEN 2 ELSE 4 END AS priority
    FROM part WHERE p_partkey % 4 = 2 OR (p_partkey % 3 = 0 AND p_partkey % 4 IN (0, 1))""")
def coverage_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverages of general conditions: by a clause's title, by the text of basic risks, or excluded by the text of exclusions."""
    clauses, own = staged(_conditions(spark, sf_dir)), spark.createDataFrame(_RULES, _RULES_SCHEMA)
    hits = M.rule_hits(M.in_scopes(clauses, M.coverage_scopes(_MARKS)), M.coverage_rules(own), of=("field_id", "ordinal"), scope="scope")
    return M.coverage_facts(clauses, hits, own, _MARKS).select("doc_id", "value", "priority")


@query("""SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 4 = 3 THEN 'exclusao_opcional' ELSE 'excluido_com_ressalva' END AS value FROM part WHERE p_partkey % 4 = 3 OR (p_partkey % 4 = 1 AND p_partkey % 5 = 0)""")
def exclusion_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusions of general conditions: in the clause of exclusions with a reservation, or as the title of an optional clause."""
    clauses, own = staged(_conditions(spark, sf_dir)), spark.createDataFrame([("virus", "virus")], "field_id string, regex string")
    hits = M.rule_hits(M.in_scopes(clauses, M.coverage_scopes(_MARKS)), M.exclusion_rules(own), of=("field_id", "ordinal"), scope="scope")
    return M.exclusion_facts(clauses, hits, own, _MARKS["optional_exclusion"], _MARKS["reservation"]).select("doc_id", "value")
