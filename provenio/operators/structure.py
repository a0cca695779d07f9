"""Lines, headers and footers, titles, sections, clauses and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenio.functions import text as T

# Words that begin a title, and the forms of titles, index lines and page numbers.
TITLE_WORDS = (
    "COBERTURA COBERTURAS CLÁUSULA CLAUSULA EXTENSÃO EXTENSÕES CONDIÇÕES CONDIÇÃO GARANTIA GARANTIAS ANEXO SEÇÃO CAPÍTULO EXCLUSÃO EXCLUSÕES "
    "ESPECIFICAÇÃO DEFINIÇÕES OBJETO LIMITE LIMITES FRANQUIA PRAZO VIGÊNCIA ÂMBITO SUB-ROGAÇÃO SINISTRO SINISTROS RETROATIVIDADE QUADRO RESUMO "
    "DADOS CARACTERÍSTICAS"
).split()
INDEX = r"\.{4,}\s*[0-9]{0,3}\s*$|\s{2,}[0-9]{1,3}\s*$"
NUMBERED = r"^([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})\.?\s*[-–—)]?\s+(\S.*)$"
ORDINAL = r"(?i)^CL[ÁA]USULA\s+([0-9]{1,2})\s*[ªºa°]?\s*[-–—:.]?\s*(.*)$"
SECTION = r"(?i)^\s*CONDI[ÇC][ÕO]ES\s+(GERAIS|ESPECIAIS|PARTICULARES)(?![\p{L}\p{N}_])"
PAGE_NUMBER = r"(?i)^\s*(p[áa]g(ina)?\.?\s*)?[0-9]{1,3}(\s*(de|/)\s*[0-9]{1,3})?\s*$"
HEAD_LINES, FOOT_LINES, LEAST_PAGES = 6, 4, 4
INDEX_LINES = 5
BLOCK_CHARS = 2200

LINE_ORDER = ("page_no", "line_no")


def page_lines(pages: DataFrame) -> DataFrame:
    """Rows (doc_id, page_no, line_no, raw) from pages (doc_id, page_no, text); blank lines stay, numbers count within the page."""
    return pages.select("doc_id", "page_no", F.posexplode(T.split_lines(F.coalesce("text", F.lit("")))).alias("line_no", "raw"))


def _without_edges(lines: DataFrame, share: float) -> DataFrame:
    """lines, dealt out by document and with their `key`, after one pass; windows within a document need no further exchange."""
    page = Window.partitionBy("doc_id", "page_no").orderBy("line_no")
    so_far, whole = page.rowsBetween(Window.unboundedPreceding, Window.currentRow), page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.trim("raw") != ""
    down, of_page = F.count_if(filled).over(so_far), F.count_if(filled).over(whole)
    begins = (F.row_number().over(page) == 1) & F.col("page_no").isNotNull()
    marked = lines.withColumn("begins", begins).withColumn("edge", filled & ((down <= HEAD_LINES) | (of_page - down < FOOT_LINES)))
    marked = marked.withColumn("pages", F.count_if("begins").over(Window.partitionBy("doc_id"))).drop("begins")
    alike = Window.partitionBy("doc_id", "edge", "key")
    in_order = alike.orderBy("page_no", "line_no")
    marked = marked.withColumn("turns", F.col("page_no").isNotNull() & ~F.lag("page_no").over(in_order).eqNullSafe(F.col("page_no")))
    again = (F.count_if("turns").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) >= share * F.col("pages")) & (F.col("key") != "#")
    goes = F.col("edge") & (F.col("page_no") > 1) & (F.col("pages") >= LEAST_PAGES) & (F.coalesce(F.col("again"), F.lit(False)) | F.col("raw").rlike(PAGE_NUMBER))
    return marked.withColumn("again", again).where(~goes).select(*lines.columns)


def strip_headers(lines: DataFrame, share: float = 0.5) -> DataFrame:
    """Lines without those that repeat at the edges of pages, in two passes; page 1 and short documents stay whole.

    Lines are moved once, to their document's task. Those without a document belong to no pages and are left out.
    """
    own = lines.where("doc_id is not null").repartition("doc_id").withColumn("key", T.line_key(F.col("raw")))
    return _without_edges(_without_edges(own, share), share).select(*lines.columns)


def index_pages(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, page_no) of pages that are an index."""
    s = F.trim("raw")
    hit = s.rlike(INDEX) & (F.length(s) > 8)
    return lines.groupBy("doc_id", "page_no").agg(F.count_if(hit).alias("n_index")).where(F.col("n_index") >= INDEX_LINES)


def title_of(line: Column) -> Column:
    """STRUCT<number, title, level> of a line that is a title; null for others."""
    s = F.trim(line)
    out = lambda number, title, level: F.struct(number.alias("number"), title.alias("title"), level.cast("int").alias("level"))
    ordinal_rest = F.regexp_extract(s, ORDINAL, 2)
    number, rest = F.regexp_extract(s, NUMBERED, 1), F.trim(F.regexp_extract(s, NUMBERED, 2))
    level = F.length(F.regexp_replace(number, "[^.]", "")) + 1
    words = F.split(rest, r"\s+")
    capitals = F.size(F.filter(words, lambda w: F.substring(w, 1, 1).rlike(r"\p{Lu}")))
    short = (F.length(rest) <= 60) & (F.size(words) <= 7) & ~rest.rlike("[.;,:]$") & rest.rlike(r"^\p{Lu}") & (level >= 2)
    short = short & (capitals >= F.greatest(F.lit(1), F.floor(F.size(words) / 2)))
    first = F.upper(F.regexp_replace(F.split(s, r"\s+")[0], "^[:–-]+|[:–-]+$", ""))
    none = F.lit(None).cast("string")
    return (
        F.when((s == "") | (F.length(s) > 180) | s.rlike(INDEX), None)
        .when(s.rlike(ORDINAL) & ((ordinal_rest == "") | T.is_upper(ordinal_rest, 0.7)), out(F.regexp_extract(s, ORDINAL, 1), s, F.lit(1)))
        .when(s.rlike(NUMBERED) & T.is_upper(rest, 0.8) & (F.length(rest) >= 4), out(number, F.regexp_replace(rest, "^[ :–—-]+|[ :–—-]+$", ""), level))
        .when(s.rlike(NUMBERED) & short, out(number, rest, level))
        .when(s.rlike(NUMBERED), None)
        .when(T.is_upper(s) & (F.length(s) >= 8) & ~s.rlike("[.;]$") & first.isin(*TITLE_WORDS), out(none, s, F.lit(1)))
    )


def with_titles(lines: DataFrame, title: Column | None = None) -> DataFrame:
    """lines with `title`, null within an index page."""
    own = title if title is not None else title_of(F.col("raw"))
    marked = lines.join(index_pages(lines).select("doc_id", "page_no", F.lit(True).alias("in_index")), ["doc_id", "page_no"], "left")
    return marked.withColumn("in_index", F.coalesce("in_index", F.lit(False))).withColumn("title", F.when(~F.col("in_index"), own))


def with_sections(titled: DataFrame, first: Column | None = None) -> DataFrame:
    """titled lines with the section that is in force; a heading counts if it is long enough or a title follows within five lines."""
    order = Window.partitionBy("doc_id").orderBy(*LINE_ORDER)
    s = F.trim("raw")
    titled = titled.withColumn("_titled", title_of(F.col("raw")).isNotNull())
    coming = F.coalesce(*[F.when(F.trim(F.lead("raw", i).over(order)) != "", F.lead("_titled", i).over(order)) for i in range(1, 6)])
    heading = s.rlike(SECTION) & ~F.col("in_index") & ~F.col("raw").rlike(INDEX) & (F.length(s) < 120)
    heading = heading & ((F.size(F.split(s, r"\s+")) >= 4) | F.coalesce(coming, F.lit(False)))
    named = F.when(heading, F.concat(F.lit("condicoes_"), F.lower(F.regexp_extract(s, SECTION, 1))))
    so_far = F.last(named, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return titled.withColumn("section", F.coalesce(so_far, first if first is not None else F.lit(""))).drop("_titled")


def clauses(titled: DataFrame) -> DataFrame:
    """Clauses from titled lines, with what a title in capitals absorbs of the next three lines.

    Rows (doc_id, clause_no, number, title, level, page_start, page_end, section, text, page_map).
    """
    order = Window.partitionBy("doc_id").orderBy(*LINE_ORDER)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = F.trim("raw")
    is_title = F.col("title").isNotNull()
    numbered = titled.withColumn("at", F.row_number().over(order)).withColumn("seg", F.sum(is_title.cast("int")).over(so_far))
    numbered = numbered.withColumn("since", F.col("at") - F.last(F.when(is_title, F.col("at")), ignorenulls=True).over(so_far))
    in_caps = F.last(F.when(is_title, T.is_upper(F.col("title.title"), 0.8)), ignorenulls=True).over(so_far)
    more = T.is_upper(s) & ~is_title & (F.length(s) < 120) & ~s.rlike(INDEX) & F.coalesce(in_caps, F.lit(False))
    fine = more | (s == "")
    chain = fine & ((F.col("since") < 2) | F.lag(fine, 1).over(order)) & ((F.col("since") < 3) | F.lag(fine, 2).over(order))
    numbered = numbered.withColumn("absorbed", F.coalesce(more & chain & F.col("since").between(1, 3), F.lit(False)))
    line = F.struct("at", "page_no", "raw", "absorbed", is_title.alias("is_title"), s.alias("trimmed"))
    grouped = numbered.groupBy("doc_id", "seg").agg(
        F.sort_array(F.collect_list(line)).alias("lines"), F.first("title", ignorenulls=True).alias("title"), F.min("page_no").alias("page_start"),
        F.min_by("section", "at").alias("section"), F.min_by("in_index", "at").alias("in_index"),
    )
    parts = F.concat(F.array(F.col("title.title")), F.transform(F.filter("lines", lambda x: x["absorbed"]), lambda x: x["trimmed"]))
    title = F.when(F.col("title").isNull(), F.when(F.col("in_index"), "ÍNDICE").otherwise("PREÂMBULO")).otherwise(F.regexp_replace(F.array_join(parts, " "), r"\s+", " "))
    body = F.filter("lines", lambda x: ~x["is_title"] & ~x["absorbed"])
    first_last = F.transform(F.filter(body, lambda x: x["trimmed"] != ""), lambda x: x["at"])
    kept = F.filter(body, lambda x: x["at"].between(F.array_min(first_last), F.array_max(first_last)))
    out = grouped.withColumn("body", F.coalesce(F.when(F.size(first_last) > 0, kept), F.array().cast(grouped.schema["lines"].dataType)))
    out = out.select(
        "doc_id", "seg", F.col("title.number").alias("number"), title.alias("title"), F.coalesce("title.level", F.lit(1)).alias("level"), "page_start",
        F.greatest("page_start", F.array_max(F.transform("body", lambda x: x["page_no"]))).alias("page_end"), "section",
        F.array_join(F.transform("body", lambda x: x["raw"]), "\n").alias("text"), F.transform("body", lambda x: x["page_no"]).alias("page_map"),
    )
    numbers = F.row_number().over(Window.partitionBy("doc_id").orderBy("seg")) - 1
    out = out.withColumn("clause_no", numbers).where((F.col("text") != "") | (F.col("level") == 1))
    return out.select("doc_id", "clause_no", *[c for c in out.columns if c not in ("doc_id", "clause_no", "seg")])


def blocks(clauses_: DataFrame, max_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, clause_no, block_no, title, page_start, text): clauses cut at line ends, with marks where the page changes.

    A fold over a clause's lines finds where blocks begin; only these places are carried, so that its cost is that of the lines.
    """
    zipped = F.arrays_zip(F.when(F.size("page_map") > 0, T.split_lines(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("raw"), F.col("page_map").alias("page"))
    start = F.struct(F.array().cast("array<int>").alias("begins"), F.lit(0).alias("size"), F.lit(0).alias("at"))

    def add(acc: Column, x: Column) -> Column:
        at, size = acc["at"] + 1, F.length(x["raw"])
        new = (acc["at"] == 0) | (acc["size"] + size > max_chars)
        begins = F.when(new, F.concat(acc["begins"], F.array(at))).otherwise(acc["begins"])
        return F.struct(begins.alias("begins"), (F.when(new, 0).otherwise(acc["size"]) + size + 1).cast("int").alias("size"), at.alias("at"))

    def block(begin: Column, i: Column) -> Column:
        end = F.coalesce(F.get("begins", i + 1) - 1, F.size("line"))
        own = F.slice("line", begin, end - begin + 1)

        def marked(x: Column, j: Column) -> Column:
            turned = (j == 0) | (F.get("line", begin + j - 2)["page"] != x["page"])
            mark = F.concat(F.lit("[pág. "), x["page"].cast("string"), F.lit("]"))
            return F.when(turned, F.array(mark, x["raw"])).otherwise(F.array(x["raw"]))

        return F.struct(F.get("line", begin - 1)["page"].cast("int").alias("page"), F.flatten(F.transform(own, marked)).alias("lines"))

    packed = clauses_.withColumn("line", zipped).withColumn("begins", F.aggregate("line", start, add, lambda acc: acc["begins"]))
    packed = packed.withColumn("packed", F.transform("begins", block))
    empty = F.array(F.struct(F.col("page_start").cast("int").alias("page"), F.array(F.concat(F.lit("[pág. "), F.col("page_start").cast("string"), F.lit("]"))).alias("lines")))
    packed = packed.withColumn("packed", F.when(F.size("packed") > 0, F.col("packed")).otherwise(empty))
    head = F.concat(F.coalesce(F.concat("number", F.lit(" ")), F.lit("")), F.col("title"))
    out = packed.select("doc_id", "clause_no", head.alias("title"), F.posexplode("packed").alias("block_no", "b"))
    return out.select("doc_id", "clause_no", "block_no", "title", F.col("b.page").alias("page_start"), F.array_join("b.lines", "\n").alias("text"))


def spec_documents(pages: DataFrame, mark: str = "especificacao da apolice", within: int = 600) -> DataFrame:
    """Rows (doc_id, is_spec) from pages (doc_id, page_no, text, is_synthetic): the mark counts near the beginning of the first two pages."""
    near = F.contains(F.substring(T.canonical(F.col("text")), 1, within), F.lit(mark)) & (F.col("page_no") <= 2)
    return pages.groupBy("doc_id").agg(F.bool_or(near | F.coalesce("is_synthetic", F.lit(False))).alias("is_spec"))


def applicable_fields(documents: DataFrame, fields: DataFrame, always: tuple[str, ...] = ("adiantamento_custos_defesa",)) -> DataFrame:
    """Rows (doc_id, field_id, ...) of documents (doc_id, is_spec) and the fields that apply to them; fields is a small declared table."""
    fits = ~F.col("is_spec") | F.col("applies_to").isin("espec", "ambos") | F.col("field_id").isin(*always)
    return documents.join(F.broadcast(fields), fits)
