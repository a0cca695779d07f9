"""Meeting texts with many declared patterns, by the literals that a pattern cannot match without.

A pattern's literals are found from its parse: pieces of plain text of which every match holds at least one. Up to FEW
patterns become conditions of one projection, each behind a search for its literals, so that an expression runs
only where it may match and is compiled once a task; no join is made. More patterns than that meet the texts by a hash join
on three letters of each literal, and are confirmed by the expression; patterns without literals then meet every text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns that become conditions of one projection.
FEW = 512
#: Letters that texts and literals are joined by; shorter literals don't count.
GRAM = 3
#: Letters from which on a literal is rare enough.
LONG = 6


def _best(sets: list[set[str]]) -> set[str] | None:
    """Of the sets of which each is needed, the one with fewest literals that are long enough, else with the longest."""
    return max(sets, key=lambda s: (min(LONG, *map(len, s)), -len(s), min(map(len, s))), default=None)


def _needed(parsed) -> list[set[str]]:
    """Sets of literals for a sequence; a match holds one of each set."""
    out: list[set[str]] = []
    run = ""
    for op, arg in [*parsed, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        if name == "AT":  # a place, no letter
            continue
        if run:
            out.append({run})
            run = ""
        if name == "SUBPATTERN" and not arg[1] and not arg[2]:
            out += _needed(arg[3])
        elif name == "ATOMIC_GROUP":
            out += _needed(arg)
        elif name == "BRANCH":
            each = [_best(_needed(branch)) for branch in arg[1]]
            if all(each):
                out.append(set().union(*each))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            out += _needed(arg[2])
    return out


def literals(pattern: str | None) -> list[str]:
    """Plain texts of GRAM letters at least of which each match of the pattern holds one; none if no such texts are sure.

    Quoted parts and classes of Unicode are understood; a pattern with flags, or one that Python can't parse, has no literals.
    """
    if pattern is None:
        return []
    plain = re.sub(r"\\Q(.*?)(\\E|$)", lambda m: re.escape(m[1]), pattern, flags=re.DOTALL)
    plain = re.sub(r"\\[pP](\{[^}]*\}|[A-Z])", r"\\w", plain)
    if re.search(r"\[[^\]]*(\[|&&)", plain):  # a class within a class
        return []
    try:
        compiled = re.compile(plain)
        parsed = re._parser.parse(plain)
    except (re.error, RecursionError, OverflowError):
        return []
    if compiled.flags & ~re.UNICODE:
        return []
    found = _best(_needed(parsed))
    return sorted(found) if found and min(map(len, found)) >= GRAM else []


def _may(text: Column, pattern: str) -> Column:
    """Whether the pattern is found in text; its literals are looked for first."""
    sure = F.call_function("rlike", text, F.lit(pattern))
    own = literals(pattern)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in own]) & sure if own else sure


def matching(rows: DataFrame, text: str, rules: DataFrame, pattern: str, same: str | None = None) -> DataFrame:
    """rows with the columns of each rule whose pattern (a column of rules) is found in the text (a column of rows).

    same: a column of both that has to agree as well. Null texts and patterns match nothing.
    """
    shared = [same] if same else []
    held = rules.where(F.col(pattern).isNotNull()).limit(FEW + 1).collect()
    if len(held) > FEW:
        return _joined(rows, text, rules, pattern, shared)
    if not held:
        return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rules.schema if f.name not in shared]).where(F.lit(False))
    spark = rows.sparkSession
    listed = spark.createDataFrame([(i, *r) for i, r in enumerate(held)], "_rule int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rules.schema))
    tests = []
    for i, r in enumerate(held):
        found = _may(F.col(text), r[pattern])
        tests.append(F.when((F.col(same).eqNullSafe(F.lit(r[same])) & found) if same else found, F.lit(i)))
    hits = rows.withColumn("_rule", F.explode(F.array_compact(F.array(*tests))))
    return hits.join(F.broadcast(listed.drop(*shared)), "_rule").drop("_rule")  # FEW rows at most


def _joined(rows: DataFrame, text: str, rules: DataFrame, pattern: str, shared: list[str]) -> DataFrame:
    """As matching, for any number of rules."""
    named = rules.where(F.col(pattern).isNotNull()).withColumn("_rule", F.struct(*rules.columns))
    split = F.udf(literals, "array<string>")
    named = named.select(*shared, F.col(pattern).alias("_pattern"), "_rule").withColumn("_literals", split(F.col("_pattern")))
    keyed = rows.withColumn("_row", F.struct(*rows.columns)).select(*shared, F.col(text).alias("_text"), "_row")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_text") - GRAM + 1), lambda i: F.substring(F.col("_text"), i, F.lit(GRAM))))
    opened = keyed.where(F.length("_text") >= GRAM).withColumn("_gram", F.explode(grams))
    middle = lambda x: F.substring(x, F.floor((F.length(x) - GRAM) / 2).cast("int") + 1, F.lit(GRAM))
    asked = named.withColumn("_gram", F.explode(F.array_distinct(F.transform("_literals", middle))))
    found = F.expr("_text rlike _pattern")
    met = opened.join(asked, [*shared, "_gram"]).where(found)
    met = met.groupBy("_row", "_rule").agg(F.count("*").alias("_n")).drop("_n")  # several literals of one rule
    bare = named.where(F.size("_literals") == 0).withColumnsRenamed({c: f"_{c}" for c in shared})
    alike = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), shared, found)
    out = met.unionByName(keyed.join(bare, alike).select("_row", "_rule"))
    return out.select("_row.*", *[F.col("_rule")[c].alias(c) for c in rules.columns if c not in shared])
