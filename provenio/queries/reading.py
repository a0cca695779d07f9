"""Intake, lines, headers, titles, sections, clauses and blocks over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenio.functions import text as T
from provenio.operators import structure as S
from provenio.queries.base import LINES, canonical_sql, document_lines, document_pages, query, table
from provenio.sources import files as X

# Pages' html stands for received files: kinds come from marks put before it, by the page's number.
_MARKS = ("%PDF-1.7 ", "\n\n%PDF-1.4 ", "", "GIF89a ")


def _received(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.element_at(F.array(*[F.lit(m) for m in _MARKS]), (F.col("page_id") % 4 + 1).cast("int"))
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", F.concat(mark, F.when(F.col("page_id") % 10 == 7, "").otherwise(F.col("html"))).cast("binary").alias("content"))


_RECEIVED = r"""received AS (
    SELECT page_id, url, [ '%PDF-1.7 ', chr(10) || chr(10) || '%PDF-1.4 ', '', 'GIF89a ' ][CAST(page_id % 4 + 1 AS INTEGER)]
           || CASE WHEN page_id % 10 = 7 THEN '' ELSE html END AS content
    FROM pages
)"""
_KIND = "CASE WHEN starts_with(content, '%PDF-') OR contains(substr(content, 1, 1000), '%PDF-') THEN 'pdf' END"


@query(f"WITH {_RECEIVED} SELECT page_id, {_KIND} AS kind FROM received")
def type_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _received(spark, sf_dir).select("page_id", X.kind_of(F.col("content")).alias("kind"))


@query(f"""WITH {_RECEIVED} SELECT page_id, CASE WHEN strlen(content) = 0 THEN 'empty' WHEN strlen(content) > 20000 THEN 'too_large'
    WHEN {_KIND} IS NULL THEN 'unknown_kind' END AS reject_reason FROM received""")
def intake_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _received(spark, sf_dir).select("page_id", X.refusal(F.col("content"), max_bytes=20_000).alias("reject_reason"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, substr(sha256(coalesce(text, '')), 1, 12) AS short_id FROM documents")
def content_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = X.identity(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", sha.alias("sha256"), X.short_id(sha).alias("short_id"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select(X.identity(F.col("text")).alias("sha256"), "doc_id")
    copies = docs.groupBy("sha256").agg(F.count("*").alias("copies"))
    return X.first_of_each(docs, "sha256", "doc_id").join(copies, "sha256")


@query(r"""SELECT page_id, substr(coalesce(nullif(trim(regexp_replace(url, '[^\p{L}\p{N}._\- ()]', '', 'g')), ''), 'documento'), 1, 120) AS name FROM pages""")
def sanitize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.safe_name(F.col("url")).alias("name"))


@query(r"""SELECT doc_id, CAST(length(regexp_replace(coalesce(text, ''), '[^A-Za-zÀ-ÿ0-9]', '', 'g')) AS INTEGER) AS useful,
    CASE WHEN length(regexp_replace(coalesce(text, ''), '[^A-Za-zÀ-ÿ0-9]', '', 'g')) < 80 THEN 'ocr' ELSE 'native' END AS method FROM documents""")
def ocr_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.useful_characters(F.col("text")).cast("int").alias("useful"), X.reading_method(F.col("text")).alias("method"))


@query(f"""WITH {LINES}, p AS (
    SELECT doc_id, page_no, CASE WHEN sum(length(regexp_replace(raw, '[^A-Za-zÀ-ÿ0-9]', '', 'g'))) < 80 THEN 1 ELSE 0 END AS ocr FROM lines GROUP BY ALL
) SELECT d.doc_id, d.source, count(p.page_no) AS n_pages, coalesce(CAST(sum(p.ocr) AS BIGINT), 0) AS n_ocr
  FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id, d.source""")
def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = document_pages(spark, sf_dir).withColumn("method", X.reading_method(F.col("text")))
    return X.listing(table(spark, sf_dir, "documents").select("doc_id", "source"), pages).select("doc_id", "source", "n_pages", "n_ocr")


@query(f"WITH {LINES} SELECT doc_id, line_no, page_no, raw FROM lines")
def explode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).select("doc_id", "line_no", "page_no", "raw")


@query(rf"""WITH {LINES} SELECT doc_id, line_no, regexp_replace(regexp_replace(lower(trim(raw)), '\s+', ' ', 'g'), '[0-9]+', '#', 'g') AS line_key FROM lines""")
def line_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).select("doc_id", "line_no", T.line_key(F.col("raw")).alias("line_key"))


@query(rf"""WITH {LINES}, c AS (SELECT doc_id, line_no, length(regexp_replace(raw, '[^\p{{L}}]', '', 'g')) AS n,
    length(regexp_replace(raw, '[^\p{{Lu}}]', '', 'g')) AS u FROM lines)
  SELECT doc_id, line_no, round(CASE WHEN n = 0 THEN 0 ELSE u / n END, 6) AS upper_share, (CASE WHEN n = 0 THEN 0 ELSE u / n END) >= 0.85 AND n >= 4 AS is_upper FROM c""")
def uppercase_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, raw = document_lines(spark, sf_dir), F.col("raw")
    return lines.select("doc_id", "line_no", F.round(T.upper_share(raw), 6).alias("upper_share"), T.is_upper(raw).alias("is_upper"))


_PASS = r"""
    {x}_m AS (
        SELECT *, trim(raw) <> '' AS filled,
               regexp_replace(regexp_replace(lower(trim(raw)), '\s+', ' ', 'g'), '[0-9]+', '#', 'g') AS k,
               row_number() OVER (PARTITION BY doc_id, page_no, trim(raw) <> '' ORDER BY line_no) AS dn,
               row_number() OVER (PARTITION BY doc_id, page_no, trim(raw) <> '' ORDER BY line_no DESC) AS up
        FROM {f}
    ), {x}_p AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM {f} GROUP BY doc_id),
    {x}_r AS (
        SELECT m.doc_id, m.k FROM {x}_m m JOIN {x}_p p ON p.doc_id = m.doc_id WHERE filled AND (dn <= 6 OR up <= 4) AND k <> '#'
        GROUP BY m.doc_id, m.k, p.pages HAVING count(DISTINCT m.page_no) >= 0.5 * p.pages
    ), {x} AS (
        SELECT m.doc_id, m.page_no, m.line_no, m.raw FROM {x}_m m JOIN {x}_p p ON p.doc_id = m.doc_id
        LEFT JOIN {x}_r r ON r.doc_id = m.doc_id AND r.k = m.k
        WHERE NOT (m.filled AND (m.dn <= 6 OR m.up <= 4) AND m.page_no > 1 AND p.pages >= 4
                   AND (r.k IS NOT NULL OR regexp_matches(m.raw, '(?i)^\s*(p[áa]g(ina)?\.?\s*)?[0-9]{{1,3}}(\s*(de|/)\s*[0-9]{{1,3}})?\s*$')))
    )"""


@query(f"WITH {LINES}, {_PASS.format(x='one', f='lines')}, {_PASS.format(x='two', f='one')} SELECT doc_id, page_no, line_no, raw FROM two")
def header_footer_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.strip_headers(document_lines(spark, sf_dir)).select("doc_id", "page_no", "line_no", "raw")


# Every second line of a document ends like a line of an index.
@query(f"""WITH {LINES}, n AS (SELECT doc_id, page_no, trim(CASE WHEN line_no % 2 = 0 THEN raw || '  ' || (line_no % 100) ELSE raw END) AS s FROM lines)
    SELECT doc_id, page_no, count(*) AS n_index FROM n WHERE regexp_matches(s, '{S.INDEX}') AND length(s) > 8 GROUP BY ALL HAVING count(*) >= 5""")
def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.concat(F.lit("  "), (F.col("line_no") % 100).cast("string"))
    lines = document_lines(spark, sf_dir).withColumn("raw", F.when(F.col("line_no") % 2 == 0, F.concat("raw", number)).otherwise(F.col("raw")))
    return S.index_pages(lines).select("doc_id", "page_no", "n_index")


# A document's short first sentence, in capitals, with a number and the word of a clause before it, stands for a title.
_HEADING = "CASE WHEN length(raw) < 60 AND raw LIKE '%.' THEN CASE WHEN line_no % 2 = 0 THEN 'CLÁUSULA ' || (line_no + 1) || 'ª - ' || upper(replace(replace(raw, '.', ''), 'ß', 'ss')) ELSE (line_no % 9 + 1) || '.2. ' || replace(raw, '.', '') END ELSE raw END"


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, bare = document_lines(spark, sf_dir), F.replace("raw", F.lit("."), F.lit(""))
    ordinal = F.concat(F.lit("CLÁUSULA "), (F.col("line_no") + 1).cast("string"), F.lit("ª - "), F.upper(F.replace(bare, F.lit("ß"), F.lit("ss"))))
    numbered = F.concat((F.col("line_no") % 9 + 1).cast("string"), F.lit(".2. "), bare)
    short = (F.length("raw") < 60) & F.col("raw").endswith(".")
    return lines.withColumn("raw", F.when(short & (F.col("line_no") % 2 == 0), ordinal).when(short, numbered).otherwise(F.col("raw")))


_UP = lambda x, least: rf"(length(regexp_replace({x}, '[^\p{{L}}]', '', 'g')) >= 4 AND length(regexp_replace({x}, '[^\p{{Lu}}]', '', 'g')) / greatest(1, length(regexp_replace({x}, '[^\p{{L}}]', '', 'g'))) >= {least})"
_WORDS = ", ".join(f"'{w}'" for w in S.TITLE_WORDS)
_IDX = r"\.{4,}\s*[0-9]{0,3}\s*$|\s{2,}[0-9]{1,3}\s*$"
_ORD = S.ORDINAL
_NUM = S.NUMBERED
_TITLED = rf"""headed AS (SELECT doc_id, line_no, page_no, {_HEADING} AS raw FROM lines),
parts AS (
    SELECT *, trim(raw) AS s, regexp_extract(trim(raw), '{_ORD}', 2) AS orest, regexp_extract(trim(raw), '{_NUM}', 1) AS num, trim(regexp_extract(trim(raw), '{_NUM}', 2)) AS rest
    FROM headed
), kinds AS (
    SELECT *, string_split_regex(rest, '\s+') AS w, length(regexp_replace(num, '[^.]', '', 'g')) + 1 AS lvl FROM parts
), titles AS (
    SELECT doc_id, line_no, page_no, raw, s, CASE
        WHEN s = '' OR length(s) > 180 OR regexp_matches(s, '{_IDX}') THEN NULL
        WHEN regexp_matches(s, '{_ORD}') AND (orest = '' OR {_UP('orest', 0.7)}) THEN {{'number': regexp_extract(s, '{_ORD}', 1), 'title': s, 'level': 1}}
        WHEN num <> '' AND {_UP('rest', 0.8)} AND length(rest) >= 4 THEN {{'number': num, 'title': regexp_replace(rest, '^[ :–—-]+|[ :–—-]+$', '', 'g'), 'level': lvl}}
        WHEN num <> '' AND length(rest) <= 60 AND len(w) <= 7 AND NOT regexp_matches(rest, '[.;,:]$') AND regexp_matches(rest, '^\p{{Lu}}') AND lvl >= 2
             AND len(list_filter(w, lambda x: regexp_matches(substr(x, 1, 1), '\p{{Lu}}'))) >= greatest(1, len(w) // 2) THEN {{'number': num, 'title': rest, 'level': lvl}}
        WHEN num <> '' THEN NULL
        WHEN {_UP('s', 0.85)} AND length(s) >= 8 AND NOT regexp_matches(s, '[.;]$')
             AND list_contains([{_WORDS}], upper(regexp_replace(string_split_regex(s, '\s+')[1], '^[:–-]+|[:–-]+$', '', 'g'))) THEN {{'number': NULL, 'title': s, 'level': 1}}
        END AS t
    FROM kinds
)"""


@query(f"WITH {LINES}, {_TITLED} SELECT doc_id, line_no, t.number AS number, t.title AS title, CAST(t.level AS INTEGER) AS level FROM titles WHERE t IS NOT NULL")
def classify_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _headed(spark, sf_dir).withColumn("t", S.title_of(F.col("raw"))).where("t is not null")
    return lines.select("doc_id", "line_no", "t.number", "t.title", "t.level")


@query(rf"""WITH {LINES}, {_TITLED}, g AS (
    SELECT *, line_no - max(CASE WHEN t IS NOT NULL THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS since,
           sum(CASE WHEN t IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS seg,
           last_value(CASE WHEN t IS NOT NULL THEN {_UP('t.title', 0.8)} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS caps
    FROM titles
), h AS (SELECT *, coalesce({_UP('s', 0.85)} AND t IS NULL AND length(s) < 120 AND NOT regexp_matches(s, '{_IDX}') AND caps, false) AS more FROM g),
i AS (SELECT *, more OR s = '' AS fine FROM h),
j AS (
    SELECT *, coalesce(more AND since BETWEEN 1 AND 3 AND (since < 2 OR lag(fine, 1) OVER w) AND (since < 3 OR lag(fine, 2) OVER w), false) AS absorbed
    FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), k AS (
    SELECT doc_id, seg, any_value(t) AS t, min(page_no) AS page_start, max(page_no) FILTER (s <> '' AND t IS NULL AND NOT absorbed) AS page_last,
           count(*) FILTER (absorbed) AS n_absorbed, min(line_no) FILTER (s <> '' AND t IS NULL AND NOT absorbed) AS lo, max(line_no) FILTER (s <> '' AND t IS NULL AND NOT absorbed) AS hi
    FROM j GROUP BY doc_id, seg
), b AS (
    SELECT k.doc_id, k.seg, string_agg(j.raw, chr(10) ORDER BY j.line_no) AS text FROM k JOIN j ON j.doc_id = k.doc_id AND j.seg = k.seg
    WHERE j.t IS NULL AND NOT j.absorbed AND j.line_no BETWEEN k.lo AND k.hi GROUP BY ALL
), o AS (
    SELECT k.doc_id, k.seg, t.number AS number, coalesce(t.level, 1) AS level, page_start, greatest(page_start, coalesce(page_last, page_start)) AS page_end, coalesce(text, '') AS text
    FROM k LEFT JOIN b ON b.doc_id = k.doc_id AND b.seg = k.seg
), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1 AS clause_no FROM o)
SELECT doc_id, CAST(clause_no AS INTEGER) AS clause_no, number, CAST(level AS INTEGER) AS level, page_start, page_end, text FROM n WHERE text <> '' OR level = 1""")
def segment_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = _headed(spark, sf_dir).withColumns({"in_index": F.lit(False), "title": S.title_of(F.col("raw")), "section": F.lit("")})
    return S.clauses(titled).select("doc_id", "clause_no", "number", "level", "page_start", "page_end", "text")


# Every 12th line of a document opens a section, by turns.
@query(f"""WITH {LINES}, m AS (SELECT *, CASE WHEN line_no % 12 = 3 THEN ['gerais', 'especiais', 'particulares'][line_no // 12 % 3 + 1] END AS own FROM lines)
    SELECT doc_id, line_no, coalesce('condicoes_' || last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM m""")
def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(F.lit("GERAIS"), F.lit("ESPECIAIS"), F.lit("PARTICULARES")), (F.floor(F.col("line_no") / 12) % 3 + 1).cast("int"))
    heading = F.concat(F.lit("CONDIÇÕES "), names, F.lit(" DO SEGURO"))
    lines = document_lines(spark, sf_dir).withColumn("raw", F.when(F.col("line_no") % 12 == 3, heading).otherwise(F.regexp_replace("raw", r"\.{4,}|\s{2,}", " ")))
    titled = lines.withColumns({"in_index": F.lit(False), "title": F.lit(None)})
    return S.with_sections(titled).select("doc_id", "line_no", "section")


@query()
def pack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = _headed(spark, sf_dir).withColumns({"in_index": F.lit(False), "title": S.title_of(F.col("raw")), "section": F.lit("")})
    return S.blocks(S.clauses(titled))


@query(rf"""WITH f AS (
    SELECT s.c_custkey AS doc, f.* FROM customer s, (VALUES ('limit', 'espec'), ('deductible', 'espec'), ('basis', 'ambos'), ('defence', 'cg'), ('adiantamento_custos_defesa', 'cg')) AS f(field_id, applies_to)
    WHERE s.c_custkey % 2 = 1 OR f.applies_to IN ('espec', 'ambos') OR f.field_id = 'adiantamento_custos_defesa'
) SELECT doc AS doc_id, field_id, applies_to FROM f""")
def applicable_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 2 == 0).alias("is_spec"))
    rows = [("limit", "espec"), ("deductible", "espec"), ("basis", "ambos"), ("defence", "cg"), ("adiantamento_custos_defesa", "cg")]
    return S.applicable_fields(docs, spark.createDataFrame(rows, "field_id string, applies_to string")).select("doc_id", "field_id", "applies_to")


@query(f"""WITH {LINES}, c AS (SELECT doc_id, page_no, string_agg(raw, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY ALL)
    SELECT doc_id, bool_or(page_no <= 2 AND contains(substr({canonical_sql('text')}, 1, 600), 'licensed under')) AS is_spec FROM c GROUP BY doc_id""")
def spec_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = document_pages(spark, sf_dir).withColumn("is_synthetic", F.lit(False))
    return S.spec_documents(pages, "licensed under").select("doc_id", "is_spec")


@query(f"""WITH {LINES}, c AS (SELECT doc_id, page_no, string_agg(raw, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY ALL)
    SELECT doc_id, bool_or(page_no <= 2 AND contains(upper(text), 'LICENSE')) AS is_synthetic FROM c GROUP BY doc_id""")
def stamp_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.stamped(document_pages(spark, sf_dir), "LICENSE")


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.keep_latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], "turn")


@query("SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 100")
def trace_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenio.sources.store import trace_tail as tail

    return tail(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), 100, "ts", "event_id")


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenio.sources.store import missing

    return missing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT conv_id, turn, text || ' ' || coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS window_text FROM conversations""")
def turn_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    nxt = F.coalesce(F.lead("text").over(order), F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" "), nxt).alias("window_text"))
