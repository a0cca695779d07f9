"""Normalisation and parsers over the given tables: amounts, dates and durations are written out in Brazilian form and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenio.functions import exact as E
from provenio.functions import text as T
from provenio.queries.base import canonical_sql, query, table, tokens_sql

_MONTHS = ", ".join(f"'{m}'" for m in T.MONTHS)


@query(f"SELECT doc_id, {canonical_sql('text')} AS canonical FROM documents")
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.canonical(F.col("text")).alias("canonical"))


@query("SELECT doc_id, strip_accents(coalesce(text, '')) AS plain FROM documents")
def strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_accents(F.coalesce("text", F.lit(""))).alias("plain"))


@query(f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def tokenize_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("SELECT o_orderkey, round(CAST(o_totalprice AS DOUBLE), 2) AS amount, CAST(o_orderkey % 4 AS INTEGER) AS form FROM orders")
def parse_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written with grouping, without, alone, and within a sentence."""
    price = F.round(F.col("o_totalprice").cast("double"), 2)
    form = (F.col("o_orderkey") % 4).cast("int")
    grouped = T.format_money(price)
    plain = F.replace(F.replace(grouped, F.lit("."), F.lit("")), F.lit("R$ "), F.lit("R$"))
    texts = F.when(form == 0, grouped).when(form == 1, F.concat(F.lit("Limite de "), plain, F.lit(" por sinistro"))).when(form == 2, F.replace(grouped, F.lit("R$ "), F.lit("")))
    texts = texts.otherwise(F.concat(F.lit("Franquia: "), grouped, F.lit("; demais R$ 1,00")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(T.parse_money(texts), 2).alias("amount"), form.alias("form"))


@query("""SELECT p_partkey, CAST(p_size AS DOUBLE) * CASE p_partkey % 5 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 WHEN 2 THEN 1000000000 WHEN 3 THEN 1000000 ELSE 1 END AS amount FROM part""")
def parse_money_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.element_at(F.array(*[F.lit(x) for x in (" mil", " milhões", " bilhões", " mi de reais", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.parse_money(F.concat(F.lit("R$ "), F.col("p_size").cast("string"), words)).alias("amount"))


@query(r"""SELECT c_custkey, 'R$ ' || translate(format('{:,.2f}', CAST(c_acctbal AS DOUBLE)), ',.', '.,') AS shown FROM customer""")
def format_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.format_money(F.col("c_acctbal").cast("double")).alias("shown"))


@query("""SELECT o_orderkey, 2 AS n, round(CAST(o_totalprice AS DOUBLE), 2) + 10000000 AS total FROM orders""")
def money_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Limite de R$ 10 milhões e prêmio de "), T.format_money(F.round(F.col("o_totalprice").cast("double"), 2)), F.lit(" ao ano"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", T.money_mentions(text).alias("m"))
    return found.select("o_orderkey", F.size("m").alias("n"), F.aggregate("m", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'ilimitada' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, form = F.col("o_orderdate"), F.col("o_orderkey") % 5
    months = F.array(*[F.lit(m) for m in T.MONTHS])
    written = F.concat(F.date_format(d, "d"), F.lit("º de "), F.element_at(months, F.month(d)), F.lit(" de "), F.date_format(d, "yyyy"))
    text = (
        F.when(form == 0, F.date_format(d, "dd/MM/yyyy")).when(form == 1, F.concat(F.lit("em "), F.date_format(d, "d.M.yyyy"), F.lit(", às 24h")))
        .when(form == 2, written).when(form == 3, F.concat(F.lit("31/02/2020, isto é, "), F.date_format(d, "yyyy-MM-dd"))).otherwise("Retroatividade ILIMITADA")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", T.parse_date(text).alias("day"))


@query("""SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') || '|' || strftime(l_shipdate + INTERVAL 365 DAY, '%Y-%m-%d') AS days FROM lineitem""")
def all_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_shipdate").cast("date")
    text = F.concat(F.lit("Vigência: das 24h de "), F.date_format(d, "dd/MM/yyyy"), F.lit(" (não 30/02/2021) às 24h de "), F.date_format(F.date_add(d, 365), "d-M-yyyy"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(T.all_dates(text), "|").alias("days"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'ilimitada' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS shown FROM orders""")
def format_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.when(F.col("o_orderkey") % 5 == 4, T.UNLIMITED).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.format_date(iso).alias("shown"))


_SPELLED = tuple(T.SPELLED.items())
_UNITS = (("dias", 1), ("meses", 30), ("anos", 365))


@query(f"""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_quantity AS INTEGER) ELSE [{', '.join(str(v) for _, v in _SPELLED)}][CAST(l_orderkey % {len(_SPELLED)} + 1 AS INTEGER)] END
    * [1, 30, 365][CAST(l_linenumber % 3 + 1 AS INTEGER)] AS INTEGER) AS days FROM lineitem""")
def parse_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs, at: F.element_at(F.array(*[F.lit(x) for x in xs]), at.cast("int"))
    unit = pick([u for u, _ in _UNITS], F.col("l_linenumber") % 3 + 1)
    figures = F.concat(F.lit("Prazo de "), F.col("l_quantity").cast("int").cast("string"), F.lit(" (por extenso) "), unit, F.lit(" após a vigência"))
    spelled = F.concat(F.lit("prazo complementar de "), F.upper(pick([w for w, _ in _SPELLED], F.col("l_orderkey") % len(_SPELLED) + 1)), F.lit(" "), unit)
    text = F.when(F.col("l_orderkey") % 2 == 0, figures).otherwise(spelled)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.parse_duration(text).alias("days"))


@query("""SELECT p_partkey, CASE WHEN d % 365 = 0 THEN (d // 365) || CASE WHEN d // 365 > 1 THEN ' anos' ELSE ' ano' END
    WHEN d % 30 = 0 THEN (d // 30) || CASE WHEN d // 30 > 1 THEN ' meses' ELSE ' mês' END ELSE d || ' dias' END AS shown
    FROM (SELECT p_partkey, p_size * CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 30 ELSE 365 END AS d FROM part)""")
def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.col("p_size") * F.when(F.col("p_partkey") % 3 == 0, 1).when(F.col("p_partkey") % 3 == 1, 30).otherwise(365)
    return table(spark, sf_dir, "part").select("p_partkey", T.format_duration(days).alias("shown"))


@query("""SELECT event_id, CASE CAST(event_id % 7 AS INTEGER) WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN false END AS flag FROM events""")
def parse_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ("Sim", "NÃO", " true ", "falso", "1", "0", "talvez")
    return table(spark, sf_dir, "events").select("event_id", T.parse_boolean(F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("event_id") % 7 + 1).cast("int"))).alias("flag"))


@query(r"""SELECT item_id, round(levenshtein(a, b) / length(a), 6) AS cer FROM (
    SELECT item_id, regexp_replace(a, 'o', 'e', 'g') AS b, a FROM (
        SELECT item_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9.]+', ' ', 'g')) AS a FROM benchmark))""")
def cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate of the benchmark's passages read with every o as an e; in ASCII, as not every engine counts code points."""
    plain = F.trim(F.regexp_replace(F.lower(T.strip_accents(F.col("text"))), "[^a-z0-9.]+", " "))
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(T.cer(plain, F.regexp_replace(plain, "o", "e")), 6).alias("cer"))


@query("""SELECT doc_id, regexp_replace(coalesce(text, ''), '(?i)</?documento>', '[documento]', 'g') || '[documento]' AS safe FROM documents""")
def neutral_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("</DOCUMENTO>"))
    return table(spark, sf_dir, "documents").select("doc_id", T.neutral_tags(text).alias("safe"))


@query("SELECT event_id, coalesce(props, '{}') AS parsed FROM events")
def balanced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of an event's properties, found again within chatter and a broken object."""
    events = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('Segue {não é json} ou: '), F.coalesce("props", F.lit("{}")), F.lit(" fim }")).alias("said"))
    return events.select("event_id", E.json_object(F.col("said")).alias("parsed"))


@query()
def line_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate by line of the benchmark against the same text without accents, its lines in reverse."""
    cut = F.regexp_replace("text", r"(.{40}\S*)\s", "$1\n")
    back = F.array_join(F.reverse(F.split(T.strip_accents(cut), "\n")), "\n")
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(E.line_cer(cut, back), 6).alias("line_cer"))


@query(r"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(round(CAST(o_totalprice AS DOUBLE), 2) AS VARCHAR) WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 2 THEN '360' WHEN 3 THEN CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END ELSE 'true' END AS value FROM orders""")
def coerce_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("dinheiro", "data", "duracao", "enum", "booleano")])
    kind = F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int"))
    money = T.format_money(F.round(F.col("o_totalprice").cast("double"), 2))
    raw = F.when(kind == "dinheiro", money).when(kind == "data", F.date_format("o_orderdate", "dd/MM/yyyy")).when(kind == "duracao", "12 (doze) meses").when(kind == "enum", F.col("o_orderstatus")).otherwise("sim")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.coerce(kind, raw, F.array(F.lit("F"), F.lit("O"))).alias("value"))


_FAV = "mais_favoravel"


@query("""SELECT l_orderkey, l_linenumber, 'item ' || CASE l_linenumber % 3 WHEN 0 THEN 'mais favorável ao segurado' WHEN 1 THEN 'equivalente' ELSE 'não comparável' END AS shown FROM lineitem""")
def readable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenio.operators.compare import READABLE

    code = F.when(F.col("l_linenumber") % 3 == 0, _FAV).when(F.col("l_linenumber") % 3 == 1, "equivalente").otherwise("nao_comparavel")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.readable(F.concat(F.lit("item "), code), READABLE).alias("shown"))


@query(r"""SELECT doc_id, i AS word_no, CASE WHEN regexp_matches(t, '^(r\$)?[0-9][0-9.,/]*$') THEN '#' ELSE t END AS form FROM (
    SELECT doc_id, i, regexp_replace(CANON, '^[.,;:()\"'']+|[.,;:()\"'']+$', '', 'g') AS t
    FROM (SELECT doc_id, string_split_regex(trim(coalesce(text, '')), '\s+') AS w FROM documents), unnest(range(1, least(len(w), 1000000) + 1)) AS u(i))""".replace("CANON", canonical_sql("w[i]")))
def word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")).alias("i", "w"))
    return words.select("doc_id", (F.col("i") + 1).cast("long").alias("word_no"), T.word_form(F.col("w")).alias("form"))
