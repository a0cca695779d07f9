"""Declared rules over windows of lines: first match wins, candidates by priority, labels and table rows, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenio.functions import text as T
from provenio.operators.patterns import matching

WINDOW_LINES = 3
CONTEXT_CHARS = 11_000
EVIDENCE_CHARS = 600
LINE_ORDER = ("page_no", "line_no")


def line_windows(lines: DataFrame, size: int = WINDOW_LINES, within: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (doc_id, page_no, at, size, original, norm): windows of 1 to size lines that aren't blank; none hangs over the end.

    within: the columns that keep lines apart. A line is brought to its canonical form once; a window's form is that of its lines, joined.
    """
    order = Window.partitionBy(*within).orderBy(*LINE_ORDER)
    filled = lines.where(F.trim("raw") != "").withColumn("s", F.trim("raw"))
    filled = filled.select(*within, *LINE_ORDER, F.struct("s", T.canonical(F.col("s")).alias("n")).alias("w1")).withColumn("at", F.row_number().over(order))
    wide = filled.withColumns({f"w{i + 1}": F.lead("w1", i).over(order) for i in range(1, size)})
    join = lambda n, part: F.concat_ws(" ", *[part(F.col(f"w{i}")) for i in range(1, n + 1)])
    made = [
        F.when(F.col(f"w{n}").isNotNull(), F.struct(F.lit(n).alias("size"), join(n, lambda w: w["s"]).alias("original"), join(n, lambda w: T.nothing(w["n"])).alias("norm")))
        for n in range(1, size + 1)
    ]
    out = wide.select(*within, "page_no", "at", F.explode(F.array_compact(F.array(*made))).alias("w"))
    return out.select(*within, "page_no", "at", "w.*")


def rule_hits(windows: DataFrame, rules: DataFrame, of: tuple[str, ...] = ("field_id", "ordinal"), scope: str | None = None) -> DataFrame:
    """Each rule's first window in each document, the shortest windows first.

    rules (field_id, ordinal, value, regex) are declared; of: the columns that name a rule; scope: a column that windows and rules share.
    """
    hits = matching(windows, "norm", rules, "regex", scope)
    found = F.struct("size", "at", "page_no", "original", F.call_function("regexp_extract", F.col("norm"), F.col("regex"), F.lit(0)).alias("matched"), "value")
    best = hits.groupBy("doc_id", *of).agg(F.min(found).alias("hit"))
    return best.select("doc_id", *of, "hit.value", "hit.size", "hit.at", "hit.page_no", "hit.original", "hit.matched")


def first_rule_wins(hits: DataFrame) -> DataFrame:
    """Of each document and field the hit of the first rule in the declared order."""
    best = hits.groupBy("doc_id", "field_id").agg(F.min(F.struct("ordinal", "value", "size", "at", "page_no", "original", "matched")).alias("hit"))
    return best.select("doc_id", "field_id", "hit.*")


def duration_facts(hits: DataFrame, as_specified: str = "conforme_especificacao") -> DataFrame:
    """Hits of duration rules with `days`; a rule that gives no days gives way to the next one."""
    days = F.when(F.col("value") == as_specified, F.lit(None).cast("int")).otherwise(T.parse_duration(F.col("matched")))
    good = hits.withColumn("days", days).where((F.col("value") == as_specified) | (F.col("days") > 0))
    best = good.groupBy("doc_id", "field_id").agg(F.min(F.struct("ordinal", "value", "days", "page_no", "original")).alias("hit"))
    return best.select("doc_id", "field_id", "hit.*")


# How general conditions name their insurer, in their own letters.
INSURERS = (
    r"É a ([A-ZÀ-Ú][\wÀ-ú ]{2,60}?Seguros?(?: [A-ZÀ-Ú][\wÀ-ú]+)*? S\.? ?A\.?)",
    r"Condi[çc][õo]es Contratuais ([A-Z]{3,}) D&O",
    r"(Seguradora do Grupo [A-Z]{3,})",
)


def named_in_lines(lines: DataFrame, patterns: tuple[str, ...] = INSURERS) -> DataFrame:
    """Rows (doc_id, value, quote, page): the first line of a document that one of the patterns names something in, as it is written."""
    hits = [T.nothing(F.regexp_extract("raw", p, 1)) for p in patterns]
    found = lines.withColumn("value", F.trim(F.coalesce(*hits))).where(F.col("value").isNotNull())
    first = found.groupBy("doc_id").agg(F.min(F.struct(*LINE_ORDER, "value", "raw")).alias("x"))
    return first.select("doc_id", "x.value", F.col("x.raw").alias("quote"), F.col("x.page_no").alias("page"))


def scoped_lines(clauses: DataFrame, scope: str, without: str | None = None) -> DataFrame:
    """Lines (doc_id, page_no, line_no, raw) of the clauses whose title matches."""
    title = T.canonical(F.col("title"))
    kept = clauses.where(title.rlike(scope) & (~title.rlike(without) if without else F.lit(True)) & (F.size("page_map") > 0))
    zipped = F.arrays_zip(T.split_lines(F.col("text")).alias("raw"), F.col("page_map").alias("page"))
    out = kept.select("doc_id", "clause_no", F.posexplode(zipped).alias("i", "x"))
    return out.select("doc_id", F.col("x.page").alias("page_no"), (F.col("clause_no").cast("long") * 1_000_000 + F.col("i")).alias("line_no"), F.col("x.raw").alias("raw"))


def by_priority(candidates: DataFrame, keys: tuple[str, ...] = ("doc_id", "field_id"), order: tuple[str, ...] = ("priority", "position")) -> DataFrame:
    """Of each key the candidate that comes first."""
    rest = [c for c in candidates.columns if c not in (*keys, *order)]
    best = candidates.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("best"))
    return best.select(*keys, "best.*")


def in_scopes(clauses: DataFrame, scopes: list[tuple[str, str, str | None]]) -> DataFrame:
    """Windows (doc_id, scope, page_no, at, size, original, norm) of the clauses of each scope; scopes: (name, pattern of titles, pattern of titles left out)."""
    title = T.canonical(F.col("title"))
    fits = [F.when(F.call_function("rlike", title, F.lit(own)) & (~F.call_function("rlike", title, F.lit(less)) if less else F.lit(True)), F.lit(name)) for name, own, less in scopes]
    kept = clauses.where(F.size("page_map") > 0).withColumn("scope", F.explode(F.array_compact(F.array(*fits)))) if scopes else clauses.withColumn("scope", F.lit("")).limit(0)
    zipped = F.arrays_zip(T.split_lines(F.col("text")).alias("raw"), F.col("page_map").alias("page"))
    lines = kept.select("doc_id", "scope", "clause_no", F.posexplode(zipped).alias("i", "x"))
    lines = lines.select("doc_id", "scope", F.col("x.page").alias("page_no"), (F.col("clause_no").cast("long") * 1_000_000 + F.col("i")).alias("line_no"), F.col("x.raw").alias("raw"))
    return line_windows(lines, within=("doc_id", "scope"))


COVERAGE_SCOPES = ("basic_scope", "exclusion_scope")


def coverage_scopes(marks: dict[str, str]) -> list[tuple[str, str, str | None]]:
    """Where the texts of coverages and exclusions are looked for."""
    return [("basic_scope", marks["basic_scope"], None), ("exclusion_scope", marks["exclusion_scope"], marks["optional_exclusion"])]


def coverage_rules(rules: DataFrame) -> DataFrame:
    """Rules (use, scope, field_id, ordinal, value, regex) that coverages (field_id, basic_text, fallback, excluded_text) look for."""
    texts = (("basic_text", "basic_scope", 2, "basica"), ("fallback", "", 3, "basica"), ("excluded_text", "exclusion_scope", 4, "excluida"))
    each = [F.struct(F.lit(scope).alias("scope"), F.lit(n).alias("ordinal"), F.lit(value).alias("value"), F.col(c).alias("regex")) for c, scope, n, value in texts]
    return rules.select(F.lit("coverage").alias("use"), "field_id", F.explode(F.array(*each)).alias("r")).select("use", "r.scope", "field_id", "r.ordinal", "r.value", "r.regex").where("regex is not null")


def _of_texts(hits: DataFrame, priority: Column, value: Column) -> DataFrame:
    position = (F.col("size") * 1_000_000_000 + F.col("at")).cast("long")
    return hits.select("doc_id", "field_id", priority.alias("priority"), position.alias("position"), value.alias("value"), F.col("page_no").alias("page"), F.col("original").alias("quote"))


def coverage_facts(clauses: DataFrame, hits: DataFrame, rules: DataFrame, marks: dict[str, str]) -> DataFrame:
    """Coverages of general conditions.

    rules (field_id, title_regex, always_basic); marks: additional as a pattern; hits: those of coverage_rules. Titles come
    first, then basic texts, the shared phrase, exclusions.
    """
    t = T.canonical(F.col("title"))
    titles = rules.where("title_regex is not null").select("field_id", "title_regex", "always_basic")
    of_title = matching(clauses.withColumn("norm_title", t), "norm_title", titles, "title_regex")
    value = F.when(F.col("always_basic"), "basica").when(t.rlike(marks["additional"]), "adicional").when(t.rlike(r"^([0-9]+(\.[0-9]+)* )?(cobertura|garantia)"), "basica")
    first_line = F.trim(F.element_at(F.filter(T.split_lines(F.col("text")), lambda x: F.trim(x) != ""), 1))
    quote = F.when((F.length(t) < 25) & first_line.isNotNull(), F.concat_ws(" ", "title", first_line)).otherwise(F.col("title"))
    titled = of_title.withColumn("value", value).where("value is not null").select(
        "doc_id", "field_id", F.lit(1).alias("priority"), F.col("clause_no").cast("long").alias("position"), "value", F.col("page_start").alias("page"), quote.alias("quote")
    )
    return by_priority(titled.unionByName(_of_texts(hits, F.col("ordinal"), F.col("value"))))


def exclusion_rules(rules: DataFrame) -> DataFrame:
    """Rules (use, scope, field_id, ordinal, value, regex) that exclusions (field_id, regex) look for."""
    return rules.select(F.lit("exclusion").alias("use"), F.lit("exclusion_scope").alias("scope"), "field_id", F.lit(1).alias("ordinal"), F.lit("excluido").alias("value"), "regex")


def exclusion_facts(clauses: DataFrame, hits: DataFrame, rules: DataFrame, optional: str, reservation: str) -> DataFrame:
    """Exclusions of general conditions: hits of exclusion_rules, or rules (field_id, regex) in the title of an optional clause."""
    value = F.when(T.canonical(F.col("original")).rlike(reservation), "excluido_com_ressalva").otherwise("excluido")
    t = T.canonical(F.col("title"))
    titles = matching(clauses.where(t.rlike(optional)).withColumn("norm_title", t), "norm_title", rules.select("field_id", "regex"), "regex")
    titles = titles.select("doc_id", "field_id", F.lit(2).alias("priority"), F.col("clause_no").cast("long").alias("position"), F.lit("exclusao_opcional").alias("value"), F.col("page_start").alias("page"), F.col("title").alias("quote"))
    return by_priority(_of_texts(hits, F.lit(1), value).unionByName(titles))


def row_rules(rows: DataFrame) -> DataFrame:
    """Rules (field_id, ordinal, value, regex) for rows (field_id, label) of a table, followed by whether they are contracted."""
    quoted = F.concat(F.lit(r"\Q"), F.col("label"), F.lit(r"\E.{0,80}?(nao contratada|contratada)"))
    return rows.select("field_id", F.lit(1).alias("ordinal"), F.lit("").alias("value"), quoted.alias("regex"))


def row_status(hits: DataFrame) -> DataFrame:
    """Hits of row_rules with what they say."""
    return hits.withColumn("value", F.when(F.col("matched").endswith("nao contratada"), "nao_contratada").otherwise("contratada"))


def table_row_status(windows: DataFrame, rows: DataFrame) -> DataFrame:
    """Coverages of a specification: rows (field_id, label) of the table, followed by whether they are contracted."""
    return row_status(rule_hits(windows, row_rules(rows)))


def table_cells(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Amounts of a specification's table: rows (field_id, label); a label's line and up to two cells below it. None if not contracted."""
    order = Window.partitionBy("doc_id").orderBy(*LINE_ORDER)
    filled = lines.where(F.trim("raw") != "").withColumn("at", F.row_number().over(order)).withColumn("s", F.trim("raw"))
    n1, n2 = F.lead("s", 1).over(order), F.lead("s", 2).over(order)
    cell = lambda x: F.coalesce(T.canonical(x).rlike(r"^((nao )?contratada|r\$ ?[0-9.,]+|-)$"), F.lit(False))
    joined = F.concat_ws(" ", "s", F.when(cell(n1), n1), F.when(cell(n1) & cell(n2), n2))
    wide = filled.withColumn("quote", joined).withColumn("norm", T.canonical(F.col("s")))
    hits = matching(wide, "norm", rows.withColumn("_quoted", F.concat(F.lit(r"\Q"), "label", F.lit(r"\E"))), "_quoted")
    refused = F.contains(T.canonical(F.col("quote")), F.lit("nao contratada"))
    hits = hits.withColumn("value", F.when(~refused, T.parse_money(F.col("quote")))).where(refused | F.col("value").isNotNull())
    first = by_priority(hits.select("doc_id", "field_id", F.lit(1).alias("priority"), F.col("at").alias("position"), "value", F.col("page_no").alias("page"), "quote"))
    return first.where("value is not null")


def label_candidates(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts that may hold a label's value: after it in its line, else the next line, else the one before.

    labels (field_id, label_ord, label). Rows (doc_id, field_id, label_ord, pattern_ord, at, pos_ord, value_text, quote, page).
    """
    order = Window.partitionBy("doc_id").orderBy(*LINE_ORDER)
    filled = lines.where(F.trim("raw") != "").withColumn("at", F.row_number().over(order)).withColumn("s", F.trim("raw"))
    filled = filled.withColumns({"after": F.lead("s").over(order), "ahead": F.lag("s").over(order), "norm": T.canonical(F.col("s"))})
    norm = T.canonical(F.col("label"))
    last = F.element_at(F.split(norm, " "), -1)
    whole = F.struct(F.lit(1).alias("pattern_ord"), F.concat(F.lit(r"\Q"), norm, F.lit(r"\E(\s*\([^)]{0,20}\))?\s*:")).alias("pattern"))
    part = F.struct(F.lit(2).alias("pattern_ord"), F.concat(F.lit(r"\Q"), last, F.lit(r"\E\s*:")).alias("pattern"))
    patterns = labels.withColumn("p", F.explode(F.when(F.contains(norm, F.lit(" ")), F.array(whole, part)).otherwise(F.array(whole))))
    hits = matching(filled, "norm", patterns.select("field_id", "label_ord", "p.*"), "pattern")
    rest = F.trim(F.regexp_replace("norm", F.concat(F.lit("^.*?"), F.col("pattern")), F.lit("")))
    same = F.when(rest != "", F.struct(F.lit(1).alias("pos_ord"), F.regexp_replace("s", F.lit(r"^[^:]*:"), F.lit("")).alias("value_text"), F.col("s").alias("quote")))
    after = F.when(F.col("after").isNotNull(), F.struct(F.lit(2).alias("pos_ord"), F.col("after").alias("value_text"), F.concat_ws(" ", "s", "after").alias("quote")))
    ahead = F.when(F.col("ahead").isNotNull(), F.struct(F.lit(3).alias("pos_ord"), F.col("ahead").alias("value_text"), F.concat_ws(" ", "ahead", "s").alias("quote")))
    out = hits.select("doc_id", "field_id", "label_ord", "pattern_ord", "at", F.col("page_no").alias("page"), F.explode(F.array_compact(F.array(same, after, ahead))).alias("c"))
    return out.select("doc_id", "field_id", "label_ord", "pattern_ord", "at", "c.pos_ord", F.trim("c.value_text").alias("value_text"), "c.quote", "page")


def first_interpretable(candidates: DataFrame, value: Column) -> DataFrame:
    """Of each document and field the first candidate that has a value."""
    good = candidates.withColumn("value", value).where("value is not null")
    return by_priority(good, order=("label_ord", "pattern_ord", "at", "pos_ord"))


def every_field(documents: DataFrame, fields: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each document and declared field: the value found, or why there is none.

    documents (doc_id, is_spec); found (doc_id, field_id, value, quote, page).
    """
    grid = documents.crossJoin(F.broadcast(fields.select("field_id", "kind", "applies_to")))  # by the few declared fields
    elsewhere = ~F.col("is_spec") & (F.col("applies_to") == "espec")
    out = grid.join(found, ["doc_id", "field_id"], "left")
    status = F.when(elsewhere, "definido_na_especificacao").when(F.col("value").isNull(), "nao_localizado").otherwise("nao_verificado")
    return out.withColumn("status", status).withColumn("value", F.when(~elsewhere, F.col("value"))).withColumn("quote", F.substring("quote", 1, EVIDENCE_CHARS))


def select_within_budget(candidates: DataFrame, key: str, order: str, size: str, budget: int = CONTEXT_CHARS) -> DataFrame:
    """Rows (key, chosen, total): candidates in order, each taken if it still fits; one too large doesn't end the choice.

    A key's candidates are the few that a ranking has left.
    """
    listed = candidates.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(size).cast("long").alias("n")))).alias("list"))
    start = F.struct(F.array().cast("array<bigint>").alias("chosen"), F.lit(0).cast("long").alias("total"))

    def take(acc: Column, x: Column) -> Column:
        fits = acc["total"] + x["n"] <= budget
        return F.struct(
            F.when(fits, F.concat(acc["chosen"], F.array(x["o"]))).otherwise(acc["chosen"]).alias("chosen"),
            F.when(fits, acc["total"] + x["n"]).otherwise(acc["total"]).alias("total"),
        )

    return listed.select(key, F.aggregate("list", start, take).alias("r")).select(key, "r.chosen", "r.total")


def first_seen(candidates: DataFrame, key: str, order: str, *same: str) -> DataFrame:
    """Of candidates of a key that agree in `same`, the first in order."""
    rest = [c for c in candidates.columns if c not in (key, order, *same)]
    first = candidates.groupBy(key, *same).agg(F.min(F.struct(order, *rest)).alias("x"))
    return first.select(key, *same, "x.*")


def fuse(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Facts of two sources (doc_id, field_id, value, status, page, note): a verified rule wins, then a verified model, then the model unverified.

    A quote that both have goes with the value.
    """
    quoted = ["quote"] if "quote" in rules.columns and "quote" in model.columns else []
    m = model.select("doc_id", "field_id", *[F.col(c).alias(f"m_{c}") for c in ("value", "status", "page", "note", *quoted)])
    both = rules.join(m, ["doc_id", "field_id"], "left")
    rule_ok, model_ok = F.col("status") == "verificado", F.coalesce(F.col("m_status") == "verificado", F.lit(False))
    use_model = ~rule_ok & (model_ok | F.coalesce(F.col("m_status") == "nao_verificado", F.lit(False)))
    differs = rule_ok & model_ok & ~F.col("value").eqNullSafe(F.col("m_value"))
    conflict = F.concat(F.lit("(o LLM leu '"), F.coalesce("m_value", F.lit("")), F.lit("' na pág. "), F.coalesce(F.col("m_page").cast("string"), F.lit("")), F.lit("; prevaleceu a regra)"))
    pick = lambda c: F.when(use_model, F.col(f"m_{c}")).otherwise(F.col(c))
    note = F.when(differs, F.trim(F.concat_ws(" ", "note", conflict))).otherwise(pick("note"))
    return both.select("doc_id", "field_id", pick("value").alias("value"), pick("status").alias("status"), pick("page").alias("page"), *[pick(c).alias(c) for c in quoted], note.alias("note"), F.when(use_model, "model").otherwise("rule").alias("source"))


def status_counts(facts: DataFrame, statuses: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, status, n) with a 0 for each status that a key doesn't have; statuses is the declared list."""
    counts = facts.groupBy(key, "status").agg(F.count("*").alias("n"))
    grid = facts.select(key).distinct().crossJoin(F.broadcast(statuses.select("status")))
    return grid.join(counts, [key, "status"], "left").select(key, "status", F.coalesce("n", F.lit(0)).alias("n"))
