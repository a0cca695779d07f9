"""Comparison, compliance, evaluation, lessons and events over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenio.functions import text as T
from provenio.operators import compare as C
from provenio.operators import evaluate as E
from provenio.operators import teach as L
from provenio.queries.base import LINES, canonical_sql, document_lines, document_pages, query, table

# Suppliers of a nation are documents that are compared in each field: the balance (more is better), the key's day (older is better), the rank of a name.
_FIELDS = ("balance", "fee", "since", "tier")
_TIERS = [["A", "B"], ["C"], ["D"]]
_SCORES = """sup AS (SELECT s_suppkey AS doc, s_nationkey AS grp, CAST(s_acctbal AS DOUBLE) AS bal, substr('ABCDE', CAST(s_suppkey % 5 + 1 AS INTEGER), 1) AS tier, s_suppkey % 7 = 3 AS open FROM supplier),
sc AS (
    SELECT doc, grp || '/balance' AS field_id, bal AS score FROM sup UNION ALL SELECT doc, grp || '/fee', -bal FROM sup UNION ALL
    SELECT doc, grp || '/since', CASE WHEN open THEN 1e18 ELSE -(20200000 + doc % 12 * 100 + 100 + doc % 28 + 1) END FROM sup UNION ALL
    SELECT doc, grp || '/tier', CASE WHEN tier IN ('A', 'B') THEN 3 WHEN tier = 'C' THEN 2 WHEN tier = 'D' THEN 1 END FROM sup
)"""
_FAVOURED = f"""{_SCORES}, lim AS (SELECT field_id, count(score) AS n, max(score) AS best, min(score) AS worst FROM sc GROUP BY 1),
fav AS (SELECT sc.*, CASE WHEN n < 2 OR score IS NULL THEN 'nao_comparavel' WHEN best = worst THEN 'equivalente' WHEN score = best THEN 'mais_favoravel'
    WHEN score = worst THEN 'menos_favoravel' ELSE 'intermediaria' END AS favourability FROM sc JOIN lim ON lim.field_id = sc.field_id)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    day = F.concat(F.lit("2020-"), F.lpad((key % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((key % 28 + 1).cast("string"), 2, "0"))
    balance = F.col("s_acctbal").cast("double").cast("string")
    values = F.array(
        F.struct(F.lit("balance").alias("f"), F.lit("maior_melhor").alias("c"), balance.alias("v")), F.struct(F.lit("fee").alias("f"), F.lit("menor_melhor").alias("c"), balance.alias("v")),
        F.struct(F.lit("since").alias("f"), F.lit("retroatividade").alias("c"), F.when(key % 7 == 3, T.UNLIMITED).otherwise(day).alias("v")),
        F.struct(F.lit("tier").alias("f"), F.lit("ordem").alias("c"), F.substring(F.lit("ABCDE"), (key % 5 + 1).cast("int"), F.lit(1)).alias("v")),
    )
    rows = table(spark, sf_dir, "supplier").select(key.alias("doc"), "s_nationkey", F.explode(values).alias("x"))
    tiers = F.array(*[F.array(*[F.lit(v) for v in t]) for t in _TIERS])
    return rows.select("doc", F.concat_ws("/", F.col("s_nationkey").cast("string"), "x.f").alias("field_id"), C.score(F.col("x.c"), F.col("x.v"), tiers).alias("score"))


@query(f"WITH {_SCORES} SELECT doc, field_id, CAST(score AS DOUBLE) AS score FROM sc")
def criterion_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("doc", "field_id", "score")


@query(f"WITH {_FAVOURED} SELECT doc, field_id, favourability FROM fav")
def favorability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.favourability(_scores(spark, sf_dir)).select("doc", "field_id", "favourability")


@query(f"""WITH {_FAVOURED} SELECT doc, count(*) FILTER (favourability = 'mais_favoravel') AS mais_favoravel, count(*) FILTER (favourability = 'menos_favoravel') AS menos_favoravel,
    count(*) FILTER (favourability = 'equivalente') AS equivalente FROM fav GROUP BY doc""")
def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.scoreboard(C.favourability(_scores(spark, sf_dir)), "doc")


# Orders by priority and status as two documents' fact sheets: the shown values, and whether they differ.
def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    facts = orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").cast("string").alias("value"))
    facts = facts.select(F.col("o_orderstatus").alias("doc_id"), F.col("o_orderpriority").alias("field_id"), "value", F.when(F.substring("o_orderpriority", 1, 1) == "5", "nao_localizado").otherwise("verificado").alias("status"))
    docs = orders.select(F.col("o_orderstatus").alias("doc_id")).distinct().select("doc_id", F.concat(F.lit("Doc "), "doc_id").alias("label"), F.lit(True).alias("is_spec"))
    fields = orders.select(F.col("o_orderpriority").alias("field_id")).distinct()
    fields = fields.select("field_id", F.substring("field_id", 1, 1).cast("int").alias("field_ord"), F.lit("g").alias("grp"), F.col("field_id").alias("label"), F.lit("ambos").alias("applies_to"))
    rules = fields.select("field_id", F.concat(F.lit("R"), F.col("field_ord").cast("string")).alias("rule_id"), F.when(F.col("field_ord") % 2 == 1, "maior_melhor").otherwise("menor_melhor").alias("criterion"), F.array().cast("array<array<string>>").alias("tiers"), F.when(F.col("field_ord") == 5, "0").alias("absent_as"), F.lit("because").alias("reason"))
    return C.comparison(facts, docs, fields, rules)


_COMPARED = """g AS (SELECT o_orderstatus AS doc_id, o_orderpriority AS field_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS ord, count(*) AS n FROM orders GROUP BY ALL),
grid AS (SELECT d.doc_id, f.field_id, f.ord FROM (SELECT DISTINCT doc_id FROM g) d CROSS JOIN (SELECT DISTINCT field_id, ord FROM g) f),
v AS (SELECT grid.*, CASE WHEN grid.ord <> 5 THEN CAST(n AS VARCHAR) END AS shown, CASE WHEN grid.ord = 5 THEN 0.0 WHEN n IS NULL THEN NULL WHEN grid.ord % 2 = 1 THEN CAST(n AS DOUBLE) ELSE -CAST(n AS DOUBLE) END AS score
      FROM grid LEFT JOIN g ON g.doc_id = grid.doc_id AND g.field_id = grid.field_id),
a AS (SELECT field_id, count(score) AS n, max(score) AS best, min(score) AS worst, count(DISTINCT coalesce(shown, '?')) > 1 AS differs FROM v GROUP BY 1),
c AS (SELECT v.*, a.differs, CASE WHEN a.n < 2 OR score IS NULL THEN 'nao_comparavel' WHEN best = worst THEN 'equivalente' WHEN score = best THEN 'mais_favoravel' WHEN score = worst THEN 'menos_favoravel' ELSE 'intermediaria' END AS favourability
      FROM v JOIN a ON a.field_id = v.field_id)"""


@query(f"WITH {_COMPARED} SELECT field_id, doc_id, shown, favourability, differs FROM c")
def comparison_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("field_id", "doc_id", "shown", "favourability", "differs")


@query(f"WITH {_COMPARED} SELECT DISTINCT field_id, differs FROM c")
def value_differs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("field_id", "differs").distinct()


@query(f"""WITH {_COMPARED} SELECT ord AS field_ord, field_id AS field_label, max(shown) FILTER (doc_id = 'F') AS "F", max(shown) FILTER (doc_id = 'O') AS "O", max(shown) FILTER (doc_id = 'P') AS "P",
    bool_or(favourability IN ('mais_favoravel', 'menos_favoravel')) AS judged FROM c GROUP BY ALL""")
def comparison_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.matrix(_compared(spark, sf_dir), ["F", "O", "P"]).select("field_ord", "field_label", "F", "O", "P", "judged")


# Compliance over documents and labels as facts.
_CONDITIONS = (
    ("low-quality", 1, "campo_em", "quality", ["0"], None), ("low-quality", 2, "texto_ausente", None, None, "gnu general"),
    ("licensed", 1, "texto_presente", None, None, "licensed under|public license"), ("unlabelled", 1, "campo_ausente", "quality", None, None),
    ("unlabelled", 2, "texto_presente", None, None, "(token|password)"), ("odd", 1, "outra", None, None, None),
)


@query(f"""WITH {LINES}, d AS (SELECT doc_id, {canonical_sql('text')} AS c FROM documents),
w AS (SELECT doc_id, page_no, row_number() OVER o AS pos, trim(trim(raw) || ' ' || coalesce(lead(trim(raw)) OVER o, '')) AS original FROM lines WHERE trim(raw) <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
n AS (SELECT *, {canonical_sql('original')} AS norm FROM w),
h AS (SELECT doc_id, p, arg_min(original, pos) AS original, CAST(arg_min(page_no, pos) AS INTEGER) AS page FROM n CROSS JOIN (VALUES ('licensed under|public license'), ('(token|password)')) AS x(p) WHERE regexp_matches(norm, p) GROUP BY ALL),
q AS (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY 1)
SELECT 'low-quality' AS rule_id, d.doc_id, 'm (Indício por ausência: confira se a informação está em outro documento da apólice.)' AS message, 'norma, art. 1' AS basis, CAST(NULL AS VARCHAR) AS quote, CAST(NULL AS INTEGER) AS page FROM d JOIN q ON q.doc_id = d.doc_id WHERE q.quality = 0 AND NOT regexp_matches(c, 'gnu general')
UNION ALL SELECT 'licensed', doc_id, 'm', 'norma, art. 1', substr(original, 1, 300), page FROM h WHERE p LIKE 'licensed%'
UNION ALL SELECT 'unlabelled', h.doc_id, 'm (Indício por ausência: confira se a informação está em outro documento da apólice.)', 'norma, art. 1', substr(original, 1, 300), page FROM h LEFT JOIN q ON q.doc_id = h.doc_id WHERE p LIKE '(token%' AND q.quality IS NULL""")
def rule_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("is_spec"))
    facts = table(spark, sf_dir, "labels").select("doc_id", F.lit("quality").alias("field_id"), F.col("quality").cast("string").alias("value"), F.lit("verificado").alias("status"))
    rules = spark.createDataFrame([(r, "todos", "art. 1", "atencao", "m", None, None) for r in ("low-quality", "licensed", "unlabelled", "odd")], "rule_id string, applies_to string, article string, severity string, message string, basis string, excerpt string")
    conditions = spark.createDataFrame(list(_CONDITIONS), "rule_id string, nr int, kind string, field_id string, allowed array<string>, pattern string")
    return C.evaluate_rules(docs, facts, document_lines(spark, sf_dir), rules, conditions, "norma").select("rule_id", "doc_id", "message", "basis", "quote", "page")


# Labels are the gold, and the share of marks in the text is the predictor.
_DETAILS = r"""d AS (
    SELECT l.doc_id, lang, source, CAST(quality AS VARCHAR) AS gold, CASE WHEN d.text IS NULL THEN NULL WHEN length(regexp_replace(d.text, '[^!#$%&*|]', '', 'g')) > 20 THEN '0' ELSE '1' END AS predicted
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id
), e AS (SELECT *, coalesce(gold = predicted, false) AS hit FROM d)"""


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.length(F.regexp_replace("text", r"[^!#$%&*|]", ""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.when(F.col("text").isNull(), None).when(marks > 20, "0").otherwise("1").alias("value"))
    facts = docs.select("doc_id", F.lit("quality").alias("field_id"), "value", F.lit("verificado").alias("status"))
    gold = table(spark, sf_dir, "labels").join(docs.select("doc_id", "lang", "source"), "doc_id")
    gold = gold.select(F.col("doc_id").alias("document"), F.lit("quality").alias("field_id"), F.lit("enum").alias("kind"), F.array(F.col("quality").cast("string")).alias("accepted"), "lang", "source")
    return E.details(gold, facts)


@query(f"WITH {_DETAILS} SELECT doc_id AS document, predicted, hit, NOT hit AND predicted IS NOT NULL AS wrong_shown FROM e")
def gold_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _details(spark, sf_dir).select("document", "predicted", "hit", "wrong_shown")


@query(f"""WITH {_DETAILS} SELECT lang, source, grouping(lang, source) AS slice, count(*) AS fields, count(*) FILTER (hit) AS hits, round_even(count(*) FILTER (hit) / count(*), 4) AS accuracy
    FROM e GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))""")
def eval_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = E.metrics(_details(spark, sf_dir), [[], ["lang"], ["source"], ["lang", "source"]])
    return got.select("lang", "source", F.col("slice").cast("long").alias("slice"), "fields", "hits", "accuracy")


@query(f"WITH {_DETAILS} SELECT doc_id AS document, predicted AS was, CASE WHEN lang = 'de' THEN '0' ELSE predicted END AS now FROM e WHERE lang = 'de' AND predicted IS DISTINCT FROM '0'")
def change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _details(spark, sf_dir)
    after = before.withColumn("predicted", F.when(F.col("lang") == "de", "0").otherwise(F.col("predicted")))
    after = after.withColumn("hit", E.gold_match(F.col("kind"), F.col("predicted"), F.col("accepted")))
    return E.changes(before, after).select("document", "was", "now")


@query()
def lesson_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence lines taught from some documents and found again in others."""
    docs = table(spark, sf_dir, "documents")
    licence = F.regexp_extract("text", r"(?m)^(.*(?:Licensed under|licensed under|Released under).*)$", 1)
    taught = docs.select("doc_id", licence.alias("quote"), F.col("source").alias("insurer")).where("quote <> ''").groupBy("quote").agg(F.min(F.struct("doc_id", "insurer")).alias("x"))
    lessons = taught.select(F.col("x.doc_id").alias("doc_id"), F.lit("licence").alias("field_id"), F.concat(F.lit("L"), F.sha2("quote", 256)).alias("lesson_id"), F.substring("quote", 1, 40).alias("value"), "quote", F.lit(1).alias("page"), F.col("x.insurer").alias("insurer"), F.lit(1).alias("created_at"))
    facts = docs.select("doc_id", F.lit("licence").alias("field_id"), F.lit("enum").alias("kind"), F.lit("nao_localizado").alias("status"))
    return L.reuse(lessons, facts, document_pages(spark, sf_dir), docs.select("doc_id", F.col("source").alias("insurer"))).select("doc_id", "field_id", "value", "page", "lesson_id")


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def trace_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenio.streaming.traces import hourly

    return hourly(table(spark, sf_dir, "events")).select("event_type", "hour", "n", F.round("total", 4).alias("total"))
