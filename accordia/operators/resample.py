"""Exact resampling on the executors: replicates of any number of rows or clusters, without the driver.

A replicate draws as many times as there are units, each time the unit that a hash of (seed, replicate, draw) names: sampling
with replacement, whose totals are exact. Draws are counted before the shuffle; statistics are weighted sums by replicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordia.operators import ranking
from accordia.operators.order import cumulate

#: Hexadecimal digits of a hash: 52 bits, so that the remainder by 10^9 units is even to 2e-7.
DIGITS = 13


def hash_number(*parts: Column) -> Column:
    """The first digits of the md5 of the parts, joined by |, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, DIGITS), 16, 10).cast("long")


def numbered(units: DataFrame, order: str, name: str = "unit") -> DataFrame:
    """units with their number from 0 in the order of a numeric column whose values differ, dealt out by parts of it."""
    run = cumulate(units.withColumn("_all", F.lit(0)), ["_all"], order, [], {name: F.lit(1).cast("long")})
    return run.withColumn(name, F.col(name) - 1).drop("_all")


def draws(units: DataFrame, replicates: int, seed: int = 0, unit: str = "unit") -> DataFrame:
    """replicate, unit, weight: how often each replicate draws each unit (those with a weight); units are numbered from 0.

    Every replicate's weights sum to the number of units, which is counted first.
    """
    n = units.count()
    spark = units.sparkSession
    each = spark.range(n * replicates).select(F.floor(F.col("id") / max(1, n)).alias("replicate"), (F.col("id") % max(1, n)).alias("draw"))
    drawn = each.select("replicate", (hash_number(F.lit(seed), F.col("replicate"), F.col("draw")) % max(1, n)).alias(unit))
    return drawn.groupBy("replicate", unit).agg(F.count("*").alias("weight"))


def weighted(rows: DataFrame, weights: DataFrame, unit: str = "unit") -> DataFrame:
    """rows (unit, ...) once for each replicate that draws their unit, with its weight. A unit may have many rows."""
    return rows.join(weights, unit)


def auroc_replicates(rows: DataFrame, weights: DataFrame, scores: list[str], unit: str = "unit") -> DataFrame:
    """replicate, and for each score its AUROC over the drawn rows (unit, correct, scores); null with one class.

    Rows without one of the scores, or without correct, are left out of all of them: the scores are compared on the same
    rows. Sums run by parts of the score within a replicate.
    """
    usable = F.col("correct").isNotNull()
    for s in scores:
        usable = usable & F.col(s).isNotNull() & ~F.isnan(s)
    drawn = weighted(rows.where(usable), weights, unit)
    cells = drawn.groupBy("replicate", "correct", *scores).agg(F.sum("weight").alias("weight"))
    long = cells.unpivot(["replicate", "correct", "weight"], scores, "method", "u")
    found = ranking.auroc(long, ["replicate", "method"], F.col("weight"))
    return found.groupBy("replicate").agg(*[F.max(F.when(F.col("method") == s, F.col("auroc"))).alias(s) for s in scores])


def mean_replicates(rows: DataFrame, weights: DataFrame, value: str, group: list[str], unit: str = "unit") -> DataFrame:
    """replicate, group, n (drawn rows), mean of the value over them."""
    drawn = weighted(rows.where(F.col(value).isNotNull()), weights, unit)
    return drawn.groupBy("replicate", *group).agg(F.sum("weight").alias("n"), (F.sum(F.col(value) * F.col("weight")) / F.sum("weight")).alias("mean"))
