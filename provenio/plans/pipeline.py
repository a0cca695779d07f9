"""From pages to facts, comparisons and alerts, under declared rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenio.functions import text as T
from provenio.operators import compare as C
from provenio.operators import matching as M
from provenio.operators import retrieval as R
from provenio.operators import structure as S
from provenio.operators import teach as L
from provenio.operators import verify as V
from provenio.plans import proposals as Q
from provenio.session import staged
from provenio.sources import rules as declared


@dataclass
class Rules:
    """Declared tables; all of them are small."""

    fields: DataFrame
    extraction: DataFrame
    coverages: DataFrame
    exclusions: DataFrame
    marks: dict[str, str]
    signs: DataFrame
    comparison: DataFrame
    compliance: DataFrame
    conditions: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, campos: dict, extracao: dict, coerencia: dict, comparacao: dict, conformidade: dict) -> Rules:
        coverages, marks = declared.coverages(spark, extracao)
        compliance, conditions = declared.compliance(spark, conformidade)
        extraction, _ = declared.sound(declared.extraction(spark, extracao))
        return cls(
            declared.fields(spark, campos), extraction, coverages, declared.exclusions(spark, extracao), marks,
            declared.coherence(spark, coerencia), declared.comparison(spark, comparacao), compliance, conditions,
        )

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Rules:
        """From a folder of YAML files."""
        names = ("campos", "extracao_deterministica", "coerencia", "regras_comparacao", "regras_susep")
        return cls.of(spark, *[declared.read_yaml(spark, f"{folder}/{n}.yaml") for n in names])


def lines_of(pages: DataFrame) -> DataFrame:
    return S.strip_headers(S.page_lines(pages))


def clauses_of(pages: DataFrame) -> DataFrame:
    return S.clauses(S.with_sections(S.with_titles(lines_of(pages))))


#: Kinds of fields that a specification gives beside their label.
LABELLED = ("texto", "dinheiro", "data", "duracao", "periodo")


def declared_rules(rules: Rules) -> tuple[DataFrame, list[tuple[str, str, str | None]]]:
    """All patterns over lines as one table (use, scope, field_id, ordinal, value, regex), and the scopes they name."""
    own = rules.extraction
    use = F.when(F.col("scope").isNotNull(), "scoped").when(F.col("family") == "duracoes", "duration").otherwise("open")
    texts = own.select(use.alias("use"), F.coalesce(F.concat(F.lit("own:"), "scope"), F.lit("")).alias("scope"), "field_id", "ordinal", "value", "regex")
    spans = own.where("family = 'duracoes' and scope is not null")  # durations are looked for everywhere too
    texts = texts.unionByName(spans.select(F.lit("duration").alias("use"), F.lit("").alias("scope"), "field_id", "ordinal", "value", "regex"))
    patterns = rules.fields.where("kind = 'texto' and pattern is not null")
    texts = texts.unionByName(patterns.select(F.lit("text").alias("use"), F.lit("").alias("scope"), "field_id", F.lit(1).alias("ordinal"), F.lit("").alias("value"), F.col("pattern").alias("regex")))
    rows = M.row_rules(rules.coverages.where("label is not null").select("field_id", "label"))
    texts = texts.unionByName(rows.select(F.lit("row").alias("use"), F.lit("").alias("scope"), "field_id", "ordinal", "value", "regex"))
    texts = texts.unionByName(M.coverage_rules(rules.coverages)).unionByName(M.exclusion_rules(rules.exclusions))
    named = [r["scope"] for r in own.where("scope is not null").select("scope").distinct().collect()]  # declared, a few
    return texts, [*((f"own:{s}", s, None) for s in sorted(named)), *M.coverage_scopes(rules.marks)]


def candidates(pages: DataFrame, rules: Rules) -> DataFrame:
    """A row for each document and declared field: (doc_id, field_id, kind, value, quote, page, status), not yet verified.

    Lines, clauses, windows and the hits of all patterns are written once each, as several steps read them.
    """
    documents = staged(S.spec_documents(pages))
    lines = staged(lines_of(pages))
    clauses = staged(S.clauses(S.with_sections(S.with_titles(lines))))
    texts, scopes = declared_rules(rules)
    windows = M.line_windows(lines).withColumn("scope", F.lit("")).unionByName(M.in_scopes(clauses, scopes))
    hits = staged(M.rule_hits(windows, texts, of=("use", "field_id", "ordinal"), scope="scope"))
    of_use = lambda use: hits.where(F.col("use") == use).drop("use")
    kinds = rules.fields.select("field_id", "kind")
    out = ("doc_id", "field_id", "value", "quote", "page")

    def plain(found: DataFrame) -> DataFrame:
        return found.select("doc_id", "field_id", "value", F.col("original").alias("quote"), F.col("page_no").alias("page"))

    spans = M.duration_facts(of_use("duration")).withColumn("value", F.coalesce(F.col("days").cast("string"), "value"))
    found = plain(M.first_rule_wins(of_use("open"))).unionByName(plain(spans)).unionByName(plain(M.first_rule_wins(of_use("scoped"))))
    found = found.unionByName(plain(of_use("text").withColumn("value", F.col("matched"))))
    named = M.named_in_lines(lines).join(F.broadcast(kinds.where("field_id = 'seguradora'").select("field_id")))
    found = found.unionByName(named.select(*out))
    of = lambda spec: documents.where(F.col("is_spec") == spec).select("doc_id")
    general = M.coverage_facts(clauses, of_use("coverage"), rules.coverages, rules.marks).select(*out)
    general = general.unionByName(M.exclusion_facts(clauses, of_use("exclusion"), rules.exclusions, rules.marks["optional_exclusion"], rules.marks["reservation"]).select(*out))
    found = found.unionByName(general.join(of(False), "doc_id", "left_semi"))
    listed = plain(M.row_status(of_use("row")))
    cells = M.table_cells(lines, rules.fields.where("table_row is not null").select("field_id", F.col("table_row").alias("label")))
    listed = listed.unionByName(cells.withColumn("value", F.col("value").cast("string")).select(*out))
    labels = rules.fields.where("table_row is null").where(F.col("kind").isin(*LABELLED))
    labels = labels.select("field_id", F.posexplode(F.when(F.size("spec_labels") > 0, F.col("spec_labels")).otherwise(F.array("label"))).alias("label_ord", "label"))
    anchored = M.label_candidates(lines, labels.join(rules.extraction.select("field_id").distinct(), "field_id", "left_anti"))
    anchored = staged(anchored.join(F.broadcast(kinds), "field_id"))
    read = [anchored.where("kind = 'texto' and length(value_text) >= 3").withColumn("value", F.col("value_text"))]
    for kind in LABELLED[1:]:  # one kind's parsers at a time make code that can be compiled
        read.append(anchored.where(F.col("kind") == kind).withColumn("value", T.coerce(F.lit(kind), F.col("value_text"), F.array().cast("array<string>"))))
    values = reduce(DataFrame.unionByName, read)
    listed = staged(listed.unionByName(M.first_interpretable(values, F.col("value")).select(*out)))
    found = listed.join(of(True), "doc_id", "left_semi").withColumn("first", F.lit(1)).unionByName(found.withColumn("first", F.lit(2)))
    found = M.by_priority(found, order=("first",))
    return staged(M.every_field(documents, rules.fields, found))


def verified(candidates_: DataFrame, pages: DataFrame, rules: Rules) -> DataFrame:
    """Candidates (doc_id, field_id, kind, value, quote, page, status) after verification."""
    clues = rules.fields.select("field_id", F.concat("clues", "spec_labels", F.array("label")).alias("clues"))
    asked = candidates_.join(F.broadcast(clues), "field_id").withColumn("quote_id", F.col("field_id")).withColumn("note", F.lit(""))
    return V.cascade(asked, pages, rules.signs).drop("quote_id")


def facts(pages: DataFrame, rules: Rules) -> DataFrame:
    """The fact sheets: every value with its status after verification."""
    return verified(candidates(pages, rules), pages, rules)


def with_model(facts_: DataFrame, pages: DataFrame, rules: Rules, provider: Callable[[], Callable[[str, str], str]], cache: str, system: str = "") -> DataFrame:
    """facts_ fused with what a model proposes: a verified rule stays, a verified proposal fills what rules did not find.

    Each group of fields is asked once a document; answers are kept at the path `cache` before they are used.
    """
    groups, queries = Q.groups_of(rules.fields)
    contexts = staged(Q.contexts(S.blocks(staged(clauses_of(pages))), groups, queries))
    fields = rules.fields.select("field_id", "label", "kind", F.lit("").alias("instruction"), "allowed")
    said = Q.propose(contexts, groups, fields, system, cache, provider).withColumn("status", F.lit("nao_verificado"))
    return M.fuse(facts_, verified(staged(said), pages, rules))


def with_lessons(facts_: DataFrame, pages: DataFrame, rules: Rules, lessons: DataFrame) -> DataFrame:
    """facts_ with what lessons (lesson_id, doc_id, field_id, value, quote, page, insurer, created_at) give, each verified in its document."""
    sheet = facts_.join(F.broadcast(rules.fields.select("field_id", "kind")), "field_id")
    insurers = facts_.where("field_id = 'seguradora' and status = 'verificado'").select("doc_id", F.col("value").alias("insurer"))
    used = L.reuse(lessons, sheet, pages, insurers).select("doc_id", "field_id", *[F.col(c).alias(f"l_{c}") for c in ("value", "quote", "page", "lesson_id")])
    both = facts_.join(used, ["doc_id", "field_id"], "left")
    taught = F.col("l_lesson_id").isNotNull()
    pick = lambda c: F.when(taught, F.col(f"l_{c}")).otherwise(F.col(c)).alias(c)
    note = F.when(taught, F.concat(F.lit("lição "), F.col("l_lesson_id").cast("string"))).otherwise(F.col("note"))
    status = F.when(taught, "verificado").otherwise(F.col("status"))
    return both.select("doc_id", "field_id", pick("value"), status.alias("status"), pick("page"), pick("quote"), note.alias("note"))


def compare(facts_: DataFrame, documents: DataFrame, rules: Rules) -> DataFrame:
    """Comparison rows; documents (doc_id, label, is_spec)."""
    return C.comparison(facts_, documents, rules.fields, rules.comparison)


def alerts(facts_: DataFrame, pages: DataFrame, rules: Rules) -> DataFrame:
    documents = S.spec_documents(pages)
    return C.evaluate_rules(documents, facts_, S.page_lines(pages), rules.compliance, rules.conditions)


def ask(question: str, pages: DataFrame, k: int = 8) -> DataFrame:
    """The passages that answer a question without a model."""
    spark = pages.sparkSession
    question = question.strip()[:500]
    blocks = S.blocks(clauses_of(pages)).withColumn("block_id", F.concat_ws("/", "doc_id", "clause_no", "block_no"))
    terms = R.block_terms(F.col("title"), F.col("text"))
    post = R.postings(blocks, terms)
    n, mean = R.corpus_size(post)
    asked = spark.createDataFrame([(1, question if len(question) >= 4 else "")], "query_id int, q string").select("query_id", F.explode(T.tokens(F.col("q"))).alias("term"))
    ranked = R.bm25(post, asked, k, n, mean)
    return R.passages(ranked, blocks).join(blocks.select("block_id", "doc_id", "page_start"), "block_id")
