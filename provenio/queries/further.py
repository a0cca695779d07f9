"""Scoped lines, durations, table rows, names, coherence, comparison within sets, display, snippets, metadata and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenio.functions import text as T
from provenio.operators import compare as C
from provenio.operators import evaluate as E
from provenio.operators import matching as M
from provenio.operators import retrieval as R
from provenio.operators import teach as L
from provenio.operators import verify as V
from provenio.queries.base import LINES, canonical_sql, document_lines, query, table
from provenio.sources import files as S


@query(r"""SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_no, turn * 1000000 + i - 1 AS line_no, l[i] AS raw
    FROM (SELECT conv_id, turn, string_split_regex(text, '\r\n|\r|\n') AS l FROM conversations WHERE role = 'user' AND text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i)""")
def scoped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as clauses with their speaker as title: the lines of the user's."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    pages = F.transform(T.split_lines(F.col("text")), lambda _: (F.col("turn") + 1).cast("int"))
    clauses = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("clause_no"), F.col("role").alias("title"), "text", pages.alias("page_map"))
    return M.scoped_lines(clauses, "^user$").select("doc_id", "page_no", "line_no", "raw")


_SAID = "CASE WHEN l_linenumber % 4 = 0 THEN 'sem prazo' WHEN l_linenumber % 4 = 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' (x) dias' ELSE 'prazo de ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' meses' END"


@query(f"""WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS pos, s FROM (SELECT l_orderkey, l_linenumber, l_quantity, {_SAID} AS s FROM lineitem)),
    h AS (SELECT doc_id, r.ordinal, min(pos) AS pos FROM l JOIN (VALUES (1, '[0-9]+ meses'), (2, '[0-9]+ [(]x[)] dias')) AS r(ordinal, regex) ON regexp_matches(s, r.regex) GROUP BY ALL),
    d AS (SELECT h.doc_id, h.ordinal, CAST(regexp_extract(s, '[0-9]+') AS INTEGER) * CASE h.ordinal WHEN 1 THEN 30 ELSE 1 END AS days FROM h JOIN l ON l.doc_id = h.doc_id AND l.pos = h.pos)
    SELECT doc_id, CAST(arg_min(days, ordinal) AS INTEGER) AS days FROM d WHERE days > 0 GROUP BY doc_id""")
def duration_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments as an order's lines of terms, in months or in days: the first rule's first line that gives days."""
    said = F.expr(_SAID.replace("VARCHAR", "STRING"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), "l_linenumber", (F.col("l_linenumber") * 1000 + F.col("l_quantity")).cast("long").alias("line_no"), said.alias("raw"))
    rules = spark.createDataFrame([("prazo", 1, "", "[0-9]+ meses"), ("prazo", 2, "", r"[0-9]+ \(x\) dias")], "field_id string, ordinal int, value string, regex string")
    return M.duration_facts(M.rule_hits(M.line_windows(lines), rules)).select("doc_id", "days")


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'contratada' ELSE 'nao_contratada' END AS value FROM orders WHERE o_orderkey % 3 <> 2""")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a coverage table: contracted or not, in the label's line or below it, or of another coverage."""
    form = F.col("o_orderkey") % 3
    text = F.when(form == 0, "Penhora online: Contratada").when(form == 1, "Penhora online\nNão contratada").otherwise("Multas\nContratada")
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
    rows = spark.createDataFrame([("penhora", "penhora online")], "field_id string, label string")
    return M.table_row_status(M.line_windows(lines), rows).select("doc_id", "value")


_NAMED = r"[Ll]icensed under (?:the )?([A-Z][A-Za-z-]+)"


@query(rf"""WITH {LINES}, h AS (SELECT doc_id, page_no, line_no, trim(regexp_extract(raw, '{_NAMED}', 1)) AS value FROM lines)
    SELECT doc_id, arg_min(value, line_no) AS value, CAST(arg_min(page_no, line_no) AS INTEGER) AS page FROM h WHERE value <> '' GROUP BY doc_id""")
def named_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first licence that a document's lines name, in its own letters."""
    return M.named_in_lines(document_lines(spark, sf_dir), (_NAMED,)).select("doc_id", "value", "page")


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN regexp_matches(c, 'licen[cs]e') WHEN 1 THEN regexp_matches(c, '[0-9]') WHEN 2 THEN regexp_matches(c, 'a') ELSE true END AS coherent
    FROM (SELECT doc_id, {canonical_sql('text')} AS c FROM documents WHERE text IS NOT NULL)""")
def coherence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as quotes of values with a sign for the field, for the kind, for both, or for neither."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("doc_id") % 4 + 1).cast("int"))
    facts = docs.select("doc_id", pick("licence", "other", "licence", "other").alias("field_id"), F.lit("enum").alias("kind"), pick("v", "w", "w", "none").alias("value"), F.col("text").alias("quote"), F.lit("").alias("context"))
    signs = spark.createDataFrame([("field", "licence", "v", "licen[cs]e"), ("kind", "enum", "w", "[0-9]"), ("field", "licence", "w", "a")], "scope string, key string, value string, sign string")
    return V.with_signs(facts, signs).select("doc_id", F.coalesce(V.coherent(), F.lit(False)).alias("coherent"))


_SETS = """d AS (SELECT s_suppkey AS doc_id, s_nationkey AS set_id, 'S' || s_suppkey AS label, s_suppkey % 2 = 0 AS is_spec, s_suppkey % 5 <> 0 AS ok, CAST(floor(CAST(s_acctbal AS DOUBLE)) AS BIGINT) AS bal FROM supplier),
v AS (
    SELECT d.*, f.field_id, f.applies, f.absent, CASE WHEN ok THEN CASE WHEN f.field_id = 'tier' THEN substr('ABC', CAST(doc_id % 3 + 1 AS INTEGER), 1) ELSE CAST(bal AS VARCHAR) END END AS shown
    FROM d CROSS JOIN (VALUES ('bal', 'ambos', '0'), ('low', 'espec', NULL), ('tier', 'cg', NULL)) AS f(field_id, applies, absent)
), s AS (
    SELECT *, CASE WHEN (applies = 'espec' AND NOT is_spec) OR (applies = 'cg' AND is_spec) THEN NULL WHEN field_id = 'bal' THEN CAST(coalesce(shown, absent) AS DOUBLE)
        WHEN field_id = 'low' THEN -CAST(shown AS DOUBLE) ELSE CASE shown WHEN 'A' THEN 3.0 WHEN 'B' THEN 2.0 WHEN 'C' THEN 1.0 END END AS score FROM v
), a AS (SELECT set_id, field_id, count(score) AS n, max(score) AS best, min(score) AS worst, count(DISTINCT coalesce(shown, '?')) > 1 AS differs,
    coalesce(list_sort(list(DISTINCT label) FILTER (score IS NOT NULL AND NOT ok)), []) AS inferred FROM s GROUP BY ALL)"""


@query(f"""WITH {_SETS} SELECT s.set_id, s.field_id, s.doc_id, coalesce(CASE WHEN s.field_id = 'tier' AND shown = 'A' THEN 'primeira' ELSE shown END, '—') AS shown_text, a.differs,
    CASE WHEN a.n < 2 OR score IS NULL THEN 'nao_comparavel' WHEN best = worst THEN 'equivalente' WHEN score = best THEN 'mais_favoravel' WHEN score = worst THEN 'menos_favoravel' ELSE 'intermediaria' END AS favourability,
    trim(CASE WHEN a.n < 2 THEN 'valor verificado em menos de dois documentos' ELSE 'porque' || CASE WHEN len(inferred) > 0 THEN ' Ausência tratada como ''' || coalesce(absent, 'None') || ''' em: ' || array_to_string(inferred, ', ') || '.' ELSE '' END END) AS reason
    FROM s JOIN a ON a.set_id = s.set_id AND a.field_id = s.field_id""")
def comparison_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents, compared within their nation: fields of either kind of document, absences and reasons."""
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_nationkey").alias("set_id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("label"), (F.col("s_suppkey") % 2 == 0).alias("is_spec"), F.floor(F.col("s_acctbal").cast("double")).cast("string").alias("bal"))
    tier = F.substring(F.lit("ABC"), (F.col("doc_id") % 3 + 1).cast("int"), F.lit(1))
    own = F.array(F.struct(F.lit("bal").alias("f"), F.col("bal").alias("v")), F.struct(F.lit("low").alias("f"), F.col("bal").alias("v")), F.struct(F.lit("tier").alias("f"), tier.alias("v")))
    facts = d.select("doc_id", F.explode(own).alias("x")).select("doc_id", F.col("x.f").alias("field_id"), F.col("x.v").alias("value"), F.when(F.col("doc_id") % 5 == 0, "nao_verificado").otherwise("verificado").alias("status"))
    fields = spark.createDataFrame([("bal", 1, "g", "Bal", "enum", "ambos"), ("low", 2, "g", "Low", "enum", "espec"), ("tier", 3, "g", "Tier", "enum", "cg")], "field_id string, field_ord int, grp string, label string, kind string, applies_to string")
    rules = spark.createDataFrame([("bal", "R1", "maior_melhor", [], "0", "porque"), ("low", "R2", "menor_melhor", [], None, "porque"), ("tier", "R3", "ordem", [["A"], ["B"], ["C"]], None, "porque")], "field_id string, rule_id string, criterion string, tiers array<array<string>>, absent_as string, reason string")
    labels = spark.createDataFrame([("A", "primeira")], "code string, words string")
    got = C.comparison(facts, d.drop("bal"), fields, rules, always=(), labels=labels)
    return got.select("set_id", "field_id", "doc_id", "shown_text", "differs", "favourability", "reason")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN '12 meses' WHEN 2 THEN CASE o_orderstatus WHEN 'O' THEN 'aberto' WHEN 'F' THEN 'fechado' ELSE o_orderstatus END
    WHEN 3 THEN CASE WHEN o_orderstatus = 'O' THEN 'sim' ELSE 'não' END WHEN 4 THEN strftime(o_orderdate, '%d/%m/%Y') || ' a ' || strftime(CAST(o_orderdate AS DATE) + 30, '%d/%m/%Y') ELSE '—' END AS shown FROM orders""")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' days, states and terms as values of every kind, as a reader sees them."""
    iso = lambda days: F.date_format(F.date_add(F.col("o_orderdate").cast("date"), days), "yyyy-MM-dd")
    pick = lambda *x: F.element_at(F.array(*x), (F.col("o_orderkey") % 6 + 1).cast("int"))
    kind = pick(*map(F.lit, ("data", "duracao", "enum", "booleano", "periodo", "dinheiro")))
    none = F.lit(None).cast("string")
    value = pick(iso(0), F.lit("360"), F.col("o_orderstatus"), F.when(F.col("o_orderstatus") == "O", "true").otherwise("false"), F.concat_ws("/", iso(0), iso(30)), none)
    labels = F.create_map(F.lit("O"), F.lit("aberto"), F.lit("F"), F.lit("fechado"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.display(kind, value, labels).alias("shown"))


@query(r"""WITH w AS (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM benchmark),
    t AS (SELECT item_id, w, list_filter(regexp_extract_all(CANON, '[a-z0-9]+'), lambda x: length(x) > 2)[3:4] AS q FROM w JOIN benchmark USING (item_id)),
    f AS (SELECT item_id, w, q, i, list_intersect(regexp_extract_all(CANON_W, '[a-z0-9]+'), q) AS hit FROM t, unnest(range(1, len(w) + 1)) AS u(i)),
    g AS (SELECT item_id, any_value(w) AS w, any_value(q) AS q, list(hit ORDER BY i) AS hits FROM f GROUP BY item_id),
    s AS (SELECT g.*, i, len(list_distinct(flatten(hits[i : i + 17]))) AS n FROM g, unnest(range(1, len(hits) + 1)) AS u(i) WHERE len(hits[i]) > 0),
    b AS (SELECT item_id, any_value(w) AS w, any_value(hits) AS hits, arg_min(i, -n * 100000 + i) AS i FROM s GROUP BY item_id)
    SELECT item_id, CASE WHEN i > 1 THEN ' … ' ELSE '' END || array_to_string(list_transform(range(i, least(i + 18, len(w) + 1)), lambda j: CASE WHEN len(hits[j]) > 0 THEN '[' || w[j] || ']' ELSE w[j] END), ' ')
        || CASE WHEN i + 17 < len(w) THEN ' … ' ELSE '' END AS snippet FROM b""".replace("CANON_W", canonical_sql("w[i]")).replace("CANON", canonical_sql("text")))
def search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages searched by two of their own words: the words round the hits, marked."""
    items = table(spark, sf_dir, "benchmark").withColumn("terms", F.slice(R.search_terms(F.col("text")), 3, 2))
    return items.where(F.size("terms") > 0).select("item_id", R.snippet(F.col("text"), F.col("terms")).alias("snippet"))


@query("""WITH k AS (SELECT sha256(coalesce(text, '')) AS h, arg_min('q' || quality, doc_id) AS meta FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1)
    SELECT d.doc_id, k.meta FROM documents d LEFT JOIN k ON k.h = sha256(coalesce(d.text, ''))""")
def metadata_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a declared list of known contents: what it says of every document with the same content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", S.identity(F.coalesce("text", F.lit(""))).alias("sha256"))
    known = docs.join(table(spark, sf_dir, "labels").where("quality is not null"), "doc_id")
    known = known.select("sha256", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("meta"), F.col("doc_id").alias("ordinal"))
    return S.with_metadata(docs, known).select("doc_id", "meta")


@query(rf"""WITH l AS (SELECT doc_id, source, regexp_extract(text, '(?m)^(.*[Ll]icensed under.*)$', 1) AS quote FROM documents WHERE text IS NOT NULL)
    SELECT source AS field_id, doc_id, nth FROM (
        SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM l
        WHERE quote <> '' AND doc_id <> 7 AND NOT regexp_matches({canonical_sql('quote')}, '{V.INSTRUCTIONS}')) WHERE nth <= 2""")
def lesson_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence lines as lessons, the source as their field: the first two of each for another document's question."""
    quote = F.regexp_extract("text", r"(?m)^(.*[Ll]icensed under.*)$", 1)
    lessons = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("source").alias("field_id"), F.col("doc_id").alias("lesson_id"), F.col("doc_id").alias("created_at"), quote.alias("quote")).where("quote <> ''")
    return L.examples(lessons, 7).select("field_id", "doc_id", F.col("nth").cast("long").alias("nth"))


@query()
def reading_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages read with some letters wrong and their lines cut elsewhere: error rates by line and of the whole."""
    cut = F.regexp_replace("text", r"(.{40}\S*)\s", "$1\n")
    read = F.regexp_replace(F.regexp_replace("text", r"(.{55}\S*)\s", "$1\n"), "rl|tz", "n")
    pages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("document"), F.lit(1).alias("page_no"), cut.alias("reference"), read.alias("read"))
    return E.reading_errors(pages).select("document", "cer", "cer_page")
