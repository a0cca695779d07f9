"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source with a share p of all tokens gets the weight p^a / sum of p^a: a = 1 keeps the
shares, a = 0 makes them equal. The exponent a in [0, 1] is found by bisection: the
smallest at which no source has to be repeated more than `max_repeats` times, or the
one at which the weights have `target_entropy` (a share of the largest possible), whichever
is larger.

The budget is a number of tokens; without one it is the least that lets every source
be drawn whole at least once, so that nothing is dropped. A source's part of the
budget is spent in epochs: whole ones first, and then blocks of its documents in the
order of a permutation that depends on source and epoch, up to the block in which the
part runs out; of that one, documents in the order of their hash while they fit.
Documents fall into `BLOCKS` blocks for each source by a hash, so that the sums over a
source, of any size, are over a bounded table; those of the block that is cut fall into
`BINS` bins by the next digits, so that only one bin of a block is looked at row by row.
Sums over all sources are aggregates: no list of the sources is ever held in one place.

Defined cases: a null source is a source of its own; a null text counts as empty and has
no tokens; a source without tokens has weight 0, and its documents are drawn once; rows
that repeat, or share an id, are drawn one by one, in the same epochs unless the budget
cuts between them; an empty table gives an empty result; the columns that this adds are
named by the caller, and others of any name pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenio.llm.common import staged

BLOCKS = 512
BINS = 1024
HASH_BITS = 28
#: Exponents that one pass over the sources tries at a time, and passes: as good as 60 halvings.
GRID, ROUNDS = 64, 10
#: Up to so many sources the table of blocks is broadcast, 60 MB at most; beyond, it is joined by a shuffle.
FEW = 2000


def token_count(text: Column) -> Column:
    """Words of a text, divided by blanks, tabs and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long"), F.lit(0).cast("long"))


def source_key(source: Column) -> Column:
    """The source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _hash(*parts: Column) -> Column:
    """HASH_BITS bits of an MD5, which any engine can compute."""
    text = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def exponent(tokens: DataFrame, total: float, lowest: float, highest: float, max_repeats: float | None, target_entropy: float | None, budget: float | None) -> float:
    """The exponent by bisection; total: all tokens, lowest, highest: the smallest and the largest share of a source.

    budget: in parts of all tokens; without one it follows from the weights, the least that draws every source once.
    """
    share = F.col("tokens") / F.lit(total)
    some = tokens.where("tokens > 0")

    def sums(grid: list[float]) -> list[tuple[float, float]]:
        """For each exponent a the sums over the sources of p^a and of p^a ln p^a."""
        power = [F.pow(share, F.lit(a)) for a in grid]
        row = some.agg(*[F.sum(x) for x in power], *[F.sum(x * F.ln(x)) for x in power]).first()
        return list(zip(row[: len(grid)], row[len(grid) :], strict=True))

    def smallest(enough, each) -> float:
        """The smallest a in [0, 1] from which on enough holds, of what `each` gives for some exponents at a time."""
        lo, hi = 0.0, 1.0
        if enough(0.0, each([0.0])[0]):
            return 0.0
        for _ in range(ROUNDS):
            grid = [lo + (hi - lo) * i / GRID for i in range(1, GRID)]
            good = next((i for i, (a, x) in enumerate(zip(grid, each(grid), strict=True)) if enough(a, x)), len(grid))
            lo, hi = [lo, *grid][good], [*grid, hi][good]
        return hi

    needs = []
    if max_repeats is not None:
        most = lambda a, z: lowest ** (a - 1) / highest ** (a - 1) if budget is None else lowest ** (a - 1) * budget / z[0]  # noqa: E731  of the source that is repeated most
        needs.append(smallest(lambda a, z: most(a, z) <= max_repeats, (lambda grid: [None] * len(grid)) if budget is None else sums))
    if target_entropy is not None:
        goal = target_entropy * math.log(some.count())
        needs.append(smallest(lambda _, z: math.log(z[0]) - z[1] / z[0] <= goal, sums))
    return round(max(needs, default=1.0), 9)


def weights(tokens: DataFrame, max_repeats: float | None, target_entropy: float | None, budget_tokens: int | None) -> DataFrame:
    """Rows (key, tokens, weight, exponent, part) from rows (key, tokens): part is the source's share of the budget in tokens."""
    some = F.when(F.col("tokens") > 0, F.col("tokens"))
    total, lowest, highest = tokens.agg(F.sum("tokens"), F.min(some), F.max(some)).first()
    if not total:
        return tokens.select("key", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("exponent"), F.lit(0).cast("long").alias("part"))
    part = None if budget_tokens is None else budget_tokens / total
    a = exponent(tokens, float(total), lowest / total, highest / total, max_repeats, target_entropy, part)
    power = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))
    z = tokens.where("tokens > 0").agg(F.sum(power)).first()[0]
    budget = float(budget_tokens) if budget_tokens is not None else total * z / (highest / total) ** (a - 1)
    out = tokens.withColumn("weight", F.when(F.col("tokens") > 0, power / z).otherwise(F.lit(0.0))).withColumn("exponent", F.lit(a))
    part = F.when(F.col("tokens") > 0, F.floor(F.col("weight") * budget + 1e-6)).otherwise(F.lit(0)).cast("long")
    return out.select("key", "tokens", "weight", "exponent", part.alias("part"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", max_repeats: float | None = 2.0,
    target_entropy: float | None = None, budget_tokens: int | None = None, seed: int = 0,
) -> DataFrame:
    """docs, a row for each time a document is drawn, with a struct `mix` of n_tokens, weight, epoch and block."""
    n = token_count(F.col(f"`{text}`"))
    key = source_key(F.col(f"`{source}`"))
    place = _hash(F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    drawn = docs.select(row, key.alias("key"), (place % BLOCKS).cast("int").alias("block"), n.alias("n"), place.alias("place"))
    sums = staged(drawn.groupBy("key", "block").agg(F.sum("n").alias("sum")))  # sources x BLOCKS rows
    few = sums.select("key").distinct().limit(FEW + 1).count() <= FEW
    held = F.broadcast if few else lambda x: x
    by_source = weights(staged(sums.groupBy("key").agg(F.sum("sum").alias("tokens"))), max_repeats, target_entropy, budget_tokens)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("part") / F.col("tokens"))).otherwise(F.lit(1)).cast("int")
    by_source = by_source.withColumn("whole", whole).withColumn("rest", F.when(F.col("tokens") > 0, F.col("part") - F.col("whole") * F.col("tokens")).otherwise(F.lit(0)))
    turn = _hash(F.lit(str(seed)), F.col("key"), F.col("whole").cast("string"), F.col("block").cast("string"))
    before = F.sum("sum").over(Window.partitionBy("key").orderBy(turn, "block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = sums.join(held(by_source), "key").withColumn("room", F.col("rest") - F.coalesce(before, F.lit(0)))
    blocks = blocks.select("key", "block", "weight", "whole", "sum", "room")
    fits = F.col("sum") <= F.col("room")
    cut = ~fits & (F.col("room") > 0)
    told = drawn.join(held(blocks), ["key", "block"])
    sure = told.where(~cut).withColumn("times", F.col("whole") + fits.cast("int"))
    bin_ = F.floor(F.col("place") * BINS / (1 << HASH_BITS)).cast("int")
    open_ = told.where(cut).withColumn("bin", bin_)  # one block of each source
    bins = open_.groupBy("key", "block", "bin").agg(F.sum("n").alias("in_bin"))
    so_far = F.sum("in_bin").over(Window.partitionBy("key", "block").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bins = bins.select("key", "block", "bin", (so_far - F.col("in_bin")).alias("before"), so_far.alias("up_to"))
    open_ = open_.join(held(bins), ["key", "block", "bin"])
    through = F.col("room") >= F.col("up_to")
    partly = ~through & (F.col("room") >= F.col("before"))
    order = Window.partitionBy("key", "block").orderBy("place", "n", F.md5(F.coalesce(F.col(f"row.{text}"), F.lit("")).cast("binary")))
    last = open_.where(partly).withColumn("so_far", F.col("before") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = last.withColumn("times", F.col("whole") + (F.col("so_far") <= F.col("room")).cast("int")).drop("so_far")
    some = open_.where(~partly).withColumn("times", F.col("whole") + through.cast("int")).unionByName(last).drop("bin", "before", "up_to")
    both = sure.unionByName(some).where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    info = F.struct(F.col("n").alias("n_tokens"), "weight", "epoch", "block").alias("mix")
    return both.select("row.*", info)
