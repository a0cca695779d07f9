"""Declared rules as small DataFrames, from YAML files of the usual layout or from dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_yaml(spark: SparkSession, path: str) -> dict:
    """One YAML file, read through Spark so that any store works."""
    import yaml

    return yaml.safe_load(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode("utf-8"))


def sound(rules: DataFrame, column: str = "regex") -> tuple[DataFrame, list[str]]:
    """(rules whose pattern Spark can read, the other patterns): a rule that is badly written costs its own field alone.

    Rules are declared and few; their patterns are tried one by one.
    """
    spark, bad = rules.sparkSession, []
    for row in rules.select(column).where(F.col(column).isNotNull()).distinct().collect():
        try:
            spark.range(1).select(F.lit("").rlike(row[0])).collect()
        except Exception:  # noqa: BLE001  whatever kind of error the engine gives for a pattern
            bad.append(row[0])
    return rules.where(F.col(column).isNull() | ~F.col(column).isin(bad)) if bad else rules, sorted(bad)


def _text(value) -> str | None:
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def fields(spark: SparkSession, data: dict) -> DataFrame:
    """The field catalogue from campos.yaml: `campos` with id, grupo, rotulo, tipo, onde, pistas, rotulos_espec, valores, padrao, linha_tabela."""
    rows = [
        (c["id"], i, c.get("grupo"), c.get("rotulo"), c["tipo"], c.get("onde", "ambos"), c.get("pistas") or [], c.get("rotulos_espec") or [],
         sorted(map(_text, c.get("valores") or [])), c.get("padrao"), c.get("linha_tabela"))
        for i, c in enumerate(data["campos"], 1)
    ]
    return spark.createDataFrame(rows, "field_id string, field_ord int, grp string, label string, kind string, applies_to string, clues array<string>, spec_labels array<string>, allowed array<string>, pattern string, table_row string")


def extraction(spark: SparkSession, data: dict) -> DataFrame:
    """Ordered rules (family, field_id, ordinal, value, regex, scope) of enums, booleans and durations."""
    rows = []
    for family in ("enums", "booleanos", "duracoes"):
        for field, own in (data.get(family) or {}).items():
            listed, scope = (own, None) if isinstance(own, list) else (own["regras"], own.get("escopo_titulo"))
            rows += [(family, field, i, _text(r.get("valor")), r["regex"], scope) for i, r in enumerate(listed, 1)]
    return spark.createDataFrame(rows, "family string, field_id string, ordinal int, value string, regex string, scope string")


def comparison(spark: SparkSession, data: dict) -> DataFrame:
    rows = [
        (r["campo"], r["id"], r["criterio"], [[_text(v) for v in tier] for tier in r.get("ordem") or []], _text(r.get("ausente_como")), r.get("fundamento"))
        for r in data["regras"]
    ]
    return spark.createDataFrame(rows, "field_id string, rule_id string, criterion string, tiers array<array<string>>, absent_as string, reason string")


def compliance(spark: SparkSession, data: dict) -> tuple[DataFrame, DataFrame]:
    """(rules, conditions)."""
    rules, conditions = [], []
    for r in data["regras"]:
        rules.append((r["id"], r["aplica_a"], r["artigo"], r["severidade"], r["mensagem"], r.get("norma", data.get("norma_padrao")), r.get("trecho_norma")))
        for nr, c in enumerate(r["condicoes"], 1):
            kind, own = next(iter(c.items()))
            field, allowed, pattern = (own["campo"], list(map(_text, own["valores"])), None) if kind == "campo_em" else (own, None, None) if kind == "campo_ausente" else (None, None, own)
            conditions.append((r["id"], nr, kind, field, allowed, pattern))
    return (
        spark.createDataFrame(rules, "rule_id string, applies_to string, article string, severity string, message string, basis string, excerpt string"),
        spark.createDataFrame(conditions, "rule_id string, nr int, kind string, field_id string, allowed array<string>, pattern string"),
    )


def coherence(spark: SparkSession, data: dict) -> DataFrame:
    """Signs (scope, key, value, sign)."""
    rows = [(scope, key, _text(v), sign) for scope, part in (("kind", "por_tipo"), ("field", "por_campo")) for key, own in (data.get(part) or {}).items() for v, sign in own.items()]
    return spark.createDataFrame(rows, "scope string, key string, value string, sign string")


def gold(spark: SparkSession, files: list[dict]) -> DataFrame:
    """Gold labels (document, is_synthetic, holdout, field_id, accepted)."""
    rows = []
    for g in files:
        for field, value in g["campos"].items():
            accepted = value["aceita"] if isinstance(value, dict) and "aceita" in value else [f"{value['inicio']}/{value['fim']}"] if isinstance(value, dict) else [value]
            rows.append((g["documento"], g.get("ficticio", False), g.get("holdout", False), field, [_text(a) for a in accepted]))
    return spark.createDataFrame(rows, "document string, is_synthetic boolean, holdout boolean, field_id string, accepted array<string>")


def coverages(spark: SparkSession, data: dict) -> tuple[DataFrame, dict[str, str]]:
    """(rules, marks) of `coberturas` and `exclusoes`: see operators.matching.coverage_facts."""
    own, out = data["coberturas"], data["exclusoes"]
    basic, excluded = own.get("texto_basico") or {}, own.get("exclusao_geral") or {}
    rows = [
        (f, c["titulo"], f in ("cobertura_a", "cobertura_b"), basic.get(f), "coberturas a e b,? por serem garantias basicas" if f in ("cobertura_a", "cobertura_b") else None, excluded.get(f), c.get("linha_espec"))
        for f, c in own.items()
        if isinstance(c, dict) and "titulo" in c
    ]
    rules = spark.createDataFrame(rows, "field_id string, title_regex string, always_basic boolean, basic_text string, fallback string, excluded_text string, label string")
    marks = {
        "additional": own["marcador_adicional"], "basic_scope": own["escopo_basico"], "exclusion_scope": out["escopo_titulo"],
        "optional_exclusion": out["titulo_opcional"], "reservation": out["ressalva"],
    }
    return rules, marks


def exclusions(spark: SparkSession, data: dict) -> DataFrame:
    return spark.createDataFrame(list(data["exclusoes"]["temas"].items()), "field_id string, regex string")
