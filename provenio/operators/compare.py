"""Field-by-field comparison with favourability, scoreboard and matrix; compliance rules and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenio.functions import text as T
from provenio.operators.patterns import matching

UNLIMITED_SCORE = 1e18
LABELS = ("mais_favoravel", "menos_favoravel", "equivalente")
READABLE = {
    "mais_favoravel": "mais favorável ao segurado", "menos_favoravel": "menos favorável ao segurado", "intermediaria": "intermediária",
    "equivalente": "equivalente", "nao_comparavel": "não comparável",
}


def score(criterion: Column, value: Column, tiers: Column) -> Column:
    """Larger is more favourable; null can't be scored. tiers: array of arrays of values, the best first."""
    place = F.array_position(F.transform(tiers, lambda t: F.array_contains(t, value)), True)
    day = F.regexp_replace(value, "-", "").try_cast("double")
    return (
        F.when(value.isNull(), None)
        .when(criterion == "maior_melhor", value.try_cast("double"))
        .when(criterion == "menor_melhor", -value.try_cast("double"))
        .when((criterion == "retroatividade") & (value == T.UNLIMITED), F.lit(UNLIMITED_SCORE))
        .when(criterion == "retroatividade", -day)
        .when((criterion == "ordem") & (place > 0), (F.size(tiers) - place + 1).cast("double"))
    )


def comparison(facts: DataFrame, documents: DataFrame, fields: DataFrame, rules: DataFrame, always: tuple[str, ...] = ("adiantamento_custos_defesa",), labels: DataFrame | None = None) -> DataFrame:
    """Long comparison rows, one for each declared field and document, with the value and how a reader sees it.

    facts (doc_id, field_id, value, status); documents (doc_id, label, is_spec) and, if there are several comparisons, set_id:
    documents are compared within their set, which is what a reader puts side by side; fields (field_id, field_ord, grp, label,
    kind, applies_to), kind may lack; rules (field_id, rule_id, criterion, tiers, absent_as, reason). The declared tables are small.
    labels (code, words): how coded values are shown.
    """
    dims = fields.withColumnRenamed("label", "field_label").join(F.broadcast(rules), "field_id", "left").withColumn("criterion", F.coalesce("criterion", F.lit("informativo")))
    documents = documents if "set_id" in documents.columns else documents.withColumn("set_id", F.lit(0))
    grid = documents.withColumnRenamed("label", "doc_label").crossJoin(F.broadcast(dims))  # documents by the few declared fields
    rows = grid.join(facts.select("doc_id", "field_id", "value", "status"), ["doc_id", "field_id"], "left")
    verified = F.coalesce(F.col("status") == "verificado", F.lit(False))
    shown = F.when(verified, F.col("value"))
    rows = rows.withColumn("shown", shown).withColumn("verified", verified)
    applies = ~(~F.col("is_spec") & (F.col("applies_to") == "espec")) & ~(F.col("is_spec") & (F.col("applies_to") == "cg") & ~F.col("field_id").isin(*always))
    used = F.when(verified, F.col("value")).otherwise(F.col("absent_as"))
    rows = rows.withColumn("score", F.when(applies & (F.col("criterion") != "informativo"), score(F.col("criterion"), used, F.col("tiers"))))
    keys = ["set_id", "field_id"]
    of_field = rows.groupBy(*keys).agg(  # partial sums for each set and field, then one row each
        F.count("score").alias("n"), F.max("score").alias("best"), F.min("score").alias("worst"), F.min("shown").alias("low"), F.max("shown").alias("high"),
        F.count("shown").alias("filled"), F.count("*").alias("all"),
    )
    differs = (F.col("low") != F.col("high")) | ((F.col("filled") > 0) & (F.col("filled") < F.col("all")))
    of_field = of_field.withColumn("differs", F.coalesce(differs, F.lit(False))).drop("low", "high", "filled", "all")
    guessed = rows.where(F.col("score").isNotNull() & ~F.col("verified")).groupBy(*keys).agg(F.sort_array(F.collect_set("doc_label")).alias("inferred"))  # documents of one set
    of_field = of_field.join(guessed, keys, "left").withColumn("inferred", F.coalesce("inferred", F.array().cast("array<string>")))
    out = rows.join(of_field, keys)
    label = (
        F.when((F.col("criterion") == "informativo") | (F.col("n") < 2) | F.col("score").isNull(), "nao_comparavel")
        .when(F.col("best") == F.col("worst"), "equivalente")
        .when(F.col("score") == F.col("best"), "mais_favoravel")
        .when(F.col("score") == F.col("worst"), "menos_favoravel")
        .otherwise("intermediaria")
    )
    guessed = F.concat(F.lit(" Ausência tratada como '"), F.coalesce("absent_as", F.lit("None")), F.lit("' em: "), F.array_join("inferred", ", "), F.lit("."))
    reason = F.concat(F.coalesce("reason", F.lit("")), F.when(F.size("inferred") > 0, guessed).otherwise(""))
    few = F.when(F.col("criterion") != "informativo", "valor verificado em menos de dois documentos").otherwise("")
    why = F.trim(F.when((F.col("criterion") == "informativo") | (F.col("n") < 2), few).otherwise(reason))
    words = F.lit(None).cast("map<string,string>")
    if labels is not None:  # a declared table, as one row
        out = out.crossJoin(F.broadcast(labels.agg(F.map_from_entries(F.collect_list(F.struct("code", "words"))).alias("labels"))))
        words = F.col("labels")
    kind = F.col("kind") if "kind" in out.columns else F.lit("enum")
    return out.select(
        "set_id", "field_id", "field_ord", "grp", "field_label", "doc_id", "doc_label", "shown", T.display(kind, F.col("shown"), words).alias("shown_text"), "score",
        label.alias("favourability"), "rule_id", why.alias("reason"), "differs",
    )


def favourability(scores: DataFrame, field: str = "field_id") -> DataFrame:
    """scores (field, doc, score) with the label of each score among those of its field."""
    of_field = scores.groupBy(field).agg(F.count("score").alias("n"), F.max("score").alias("best"), F.min("score").alias("worst"))
    s = F.col("score")
    label = (
        F.when((F.col("n") < 2) | s.isNull(), "nao_comparavel").when(F.col("best") == F.col("worst"), "equivalente").when(s == F.col("best"), "mais_favoravel")
        .when(s == F.col("worst"), "menos_favoravel").otherwise("intermediaria")
    )
    return scores.join(of_field, field).withColumn("favourability", label).drop("n", "best", "worst")


def scoreboard(compared: DataFrame, doc: str = "doc_id") -> DataFrame:
    """How many fields each document has of each label, within its set if there are several, 0 for none."""
    keys = [c for c in ("set_id", doc) if c in compared.columns]
    return compared.groupBy(*keys).agg(*[F.count_if(F.col("favourability") == x).alias(x) for x in LABELS])


def matrix(compared: DataFrame, documents: list[str], only_differences: bool = False) -> DataFrame:
    """Fields of each set as rows and the named documents as columns; those judged first. A document that a set lacks is null there."""
    kept = compared.where("differs") if only_differences else compared
    wide = kept.groupBy("set_id", "field_ord", "grp", "field_label").pivot("doc_id", documents).agg(F.first("shown"))
    judged = kept.groupBy("set_id", "field_ord").agg(F.bool_or(F.col("favourability").isin("mais_favoravel", "menos_favoravel")).alias("judged"))
    return wide.join(judged, ["set_id", "field_ord"]).orderBy("set_id", F.desc("judged"), "field_ord")


def summary(compared: DataFrame, alerts: DataFrame, highlights: int = 6) -> DataFrame:
    """Rows (set_id, part, nr, line): the scoreboard, the first highlights in the declared order, and the number of points of attention.

    alerts (doc_id, severity) count in every set that has their document; without set_id they would mix what is not compared.
    """
    board = scoreboard(compared, "doc_label")
    line = F.concat(F.lit("- "), "doc_label", F.lit(": "), F.col("mais_favoravel").cast("string"), F.lit(" campo(s) mais favoráveis e "), F.col("menos_favoravel").cast("string"), F.lit(" menos favoráveis ao segurado."))
    first = board.select("set_id", F.lit(1).alias("part"), F.lit(0).alias("nr"), line.alias("line"))  # lines begin with the document's label
    of_field = compared.where("differs").groupBy("set_id", "field_ord", "field_label").agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("favourability") == "mais_favoravel", F.col("doc_label")))), ", ").alias("best"),
        F.array_join(F.sort_array(F.collect_list(F.concat("doc_label", F.lit(": "), F.when(F.col("shown").isNull(), "não localizado").otherwise(F.col("shown_text"))))), "; ").alias("values"),
        F.bool_or(F.col("favourability").isin("mais_favoravel", "menos_favoravel")).alias("judged"),
    )
    text = F.concat(F.lit("- "), "field_label", F.lit(": mais favorável em "), "best", F.lit(" ("), "values", F.lit(")."))
    place = F.row_number().over(Window.partitionBy("set_id").orderBy("field_ord"))  # the declared fields of a set
    second = of_field.where("judged").withColumn("place", place).where(F.col("place") <= highlights)
    second = second.select("set_id", F.lit(2).alias("part"), F.col("field_ord").cast("int").alias("nr"), text.alias("line"))
    of_set = compared.select("set_id", "doc_id").distinct().join(alerts.where("severity = 'atencao'").select("doc_id"), "doc_id")
    n = of_set.groupBy("set_id").agg(F.count("*").alias("n"))
    third = n.select("set_id", F.lit(3).alias("part"), F.lit(1).alias("nr"), F.concat(F.lit("- Conformidade: "), F.col("n").cast("string"), F.lit(" ponto(s) de atenção para revisão humana.")).alias("line"))
    return first.unionByName(second).unionByName(third).orderBy("set_id", "part", "nr", "line")


def evidence_appendix(facts: DataFrame) -> DataFrame:
    return facts.where("status = 'verificado'").select("doc_id", "field_id", "value", "quote", "page").orderBy("doc_id", "field_id")


# -- Compliance.


def pair_windows(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, page_no, at, original, norm): each line that isn't blank with the next one, over pages; canonical once a line."""
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    filled = lines.where(F.trim("raw") != "").select("doc_id", "page_no", "line_no", F.trim("raw").alias("s"), T.nothing(T.canonical(F.trim("raw"))).alias("n"))
    both = lambda c: F.trim(F.concat_ws(" ", c, F.lead(c).over(order)))
    return filled.select("doc_id", "page_no", F.row_number().over(order).alias("at"), both("s").alias("original"), both("n").alias("norm"))


def evaluate_rules(documents: DataFrame, facts: DataFrame, lines: DataFrame, rules: DataFrame, conditions: DataFrame, default_basis: str = "") -> DataFrame:
    """Alerts (rule_id, doc_id, article, severity, message, basis, quote, page) of the rules whose conditions all hold.

    documents (doc_id, is_spec); rules (rule_id, applies_to, article, severity, message, basis, excerpt);
    conditions (rule_id, nr, kind, field_id, allowed, pattern), kind one of campo_ausente, campo_em, texto_ausente, texto_presente.
    Rules and conditions are declared and few. A condition of another kind doesn't hold.
    """
    kind = F.when(F.col("is_spec"), "especificacao").otherwise("condicoes_gerais")
    any_kind = F.array(F.lit("especificacao"), F.lit("condicoes_gerais"))
    of_kind = rules.select("rule_id", F.explode(F.when(F.col("applies_to") == "todos", any_kind).otherwise(F.array("applies_to"))).alias("kind_of_doc"))
    due = documents.withColumn("kind_of_doc", kind).join(F.broadcast(of_kind), "kind_of_doc").select("doc_id", "rule_id")
    open_ = due.join(F.broadcast(conditions), "rule_id")
    verified = F.coalesce(F.col("status") == "verificado", F.lit(False))
    fields = open_.where(F.col("kind").isin("campo_ausente", "campo_em")).join(facts.select("doc_id", "field_id", "value", "status"), ["doc_id", "field_id"], "left")
    absent = ~verified | F.col("value").isNull() | (F.col("value") == "false")
    by_field = fields.select("doc_id", "rule_id", "nr", F.when(F.col("kind") == "campo_ausente", absent).otherwise(verified & F.coalesce(F.array_contains("allowed", F.col("value")), F.lit(False))).alias("holds"))
    whole = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "line_no", "raw"))).alias("l"))
    whole = whole.select("doc_id", T.canonical(F.array_join(F.transform("l", lambda x: x["raw"]), "\n")).alias("all_text"))
    absences = conditions.where("kind = 'texto_ausente'").select("pattern").distinct()
    found = matching(whole, "all_text", absences, "pattern").select("doc_id", "pattern", F.lit(True).alias("found"))
    missing = open_.where("kind = 'texto_ausente'").join(found, ["doc_id", "pattern"], "left")
    by_absence = missing.select("doc_id", "rule_id", "nr", F.col("found").isNull().alias("holds"))
    present = open_.where("kind = 'texto_presente'")
    patterns = conditions.where("kind = 'texto_presente'").select("pattern").distinct()
    seen = matching(pair_windows(lines), "norm", patterns, "pattern").groupBy("doc_id", "pattern").agg(F.min(F.struct("at", "original", "page_no")).alias("hit"))
    by_text = present.join(seen, ["doc_id", "pattern"], "left").select("doc_id", "rule_id", "nr", F.col("hit").isNotNull().alias("holds"), "hit")
    none = F.lit(None).cast(by_text.schema["hit"].dataType)
    other = open_.where(~F.col("kind").isin("campo_ausente", "campo_em", "texto_ausente", "texto_presente")).select("doc_id", "rule_id", "nr", F.lit(False).alias("holds"))
    parts = by_field.unionByName(by_absence).unionByName(other).withColumn("hit", none).unionByName(by_text)
    fired = parts.groupBy("doc_id", "rule_id").agg(F.bool_and("holds").alias("fires"), F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("nr"))).alias("hit")).where("fires")
    by_lack = conditions.groupBy("rule_id").agg(F.bool_or(F.col("kind").isin("texto_ausente", "campo_ausente")).alias("by_lack"))
    out = fired.join(F.broadcast(rules.join(by_lack, "rule_id")), "rule_id")
    basis = F.concat(F.coalesce("basis", F.lit(default_basis)), F.lit(", "), "article", F.coalesce(F.concat(F.lit(': "'), "excerpt", F.lit('"')), F.lit("")))
    message = F.concat("message", F.when(F.col("by_lack"), " (Indício por ausência: confira se a informação está em outro documento da apólice.)").otherwise(""))
    return out.select("rule_id", "doc_id", "article", "severity", message.alias("message"), basis.alias("basis"), F.substring("hit.original", 1, 300).alias("quote"), F.col("hit.page_no").alias("page"))
