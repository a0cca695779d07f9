"""Meeting texts with declared patterns, against every text by every pattern."""

import re

import pytest
from pyspark.sql import functions as F

from provenio.operators import patterns

PATTERNS = (
    "gnu (lesser )?general public license", "mit license", "all rights reserved|licensed under", "a|b", "cc by[a-z -]*", r"(prazo|periodo) (complementar|adicional)", "x{3,}yyy?", r"\bfoo\b.{0,5}bar",
    r"\Qa.b (c)\E.{0,8}?(nao contratada|contratada)", r"[\p{L}]+ seguros", "(?i)CAPS LOCK", "fo+bar", "(?:abc)?def", "(?=never)x", "[0-9]{3}", "virus|[a-z]+ware", "[a-z&&[^m]]oo", "",
)
TEXTS = ("the gnu general public license", "mit license", "licensed under cc by-sa 4", "prazo adicional: 3", "xxxxyy foo, bar", "a.b (c) nao contratada", "azul seguros", "caps lock", "foobar", "def", "malware 123", "zoo", "", None)


def test_literals_are_in_every_match():
    for p in PATTERNS:
        found = patterns.literals(p)
        for text in TEXTS:
            plain = re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m[1]), p).replace(r"\p{L}", "a-z")
            if found and text and "&&" not in p and (m := re.search(plain, text)):
                assert any(x in m[0] for x in found), (p, text)
    assert patterns.literals(PATTERNS[0]) == [" general public license"] or patterns.literals(PATTERNS[0]) == ["general public license"]
    assert patterns.literals(PATTERNS[2]) == ["all rights reserved", "licensed under"] and patterns.literals(PATTERNS[5]) == ["adicional", "complementar"]
    assert patterns.literals(PATTERNS[8]) == ["a.b (c)"] and patterns.literals(PATTERNS[9]) == [" seguros"]
    assert all(patterns.literals(p) == [] for p in ("a|b", "(?i)CAPS LOCK", "[0-9]{3}", "virus|[a-z]+ware|..", "", "(", None, "[a-z&&[^m]]ooo", "(abc)?"))


@pytest.mark.parametrize("few", [512, 3])
@pytest.mark.parametrize("scoped", [False, True])
def test_matching_against_every_pair(spark, monkeypatch, few, scoped):
    monkeypatch.setattr(patterns, "FEW", few)
    rows = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(TEXTS)], "id int, t string, scope string")
    rules = spark.createDataFrame([(n, p, "ab"[n % 2]) for n, p in enumerate(PATTERNS)] + [(99, None, "a")], "n int, p string, scope string")
    want = rows.join(rules.withColumnRenamed("scope", "other"), F.expr("t rlike p"))
    want = sorted((r.id, r.n) for r in want.collect() if not scoped or r.scope == r.other)
    found = patterns.matching(rows, "t", rules if scoped else rules.drop("scope"), "p", "scope" if scoped else None)
    assert sorted((r.id, r.n) for r in found.collect()) == want and len(want) > 8
    assert set(found.columns) == {"id", "t", "scope", "n", "p"}
    assert patterns.matching(rows, "t", rules.drop("scope").limit(0), "p").count() == 0 and patterns.matching(rows.limit(0), "t", rules.drop("scope"), "p").count() == 0


def test_few_patterns_make_no_nested_loop(spark):
    rows = spark.range(10).select("id", F.col("id").cast("string").alias("t"))
    rules = spark.createDataFrame([(n, p) for n, p in enumerate(PATTERNS)], "n int, p string")
    plan = patterns.matching(rows, "t", rules, "p")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
