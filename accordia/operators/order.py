"""Running sums over an order, in parts, so that a group that holds a third of all rows is not one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a doubling of the score; rows of one score in a group beyond which they are dealt out by the order.
PARTS, LEAST_TIE = 256, 1 << 14


def search(bounds: Column, x: Column) -> Column:
    """How many of an array's ascending numbers are under x, by halving; 0 for a null or empty array, null for a null x."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(bounds) + 1)).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        under = F.get(bounds, mid) < x
        return F.when(s["low"] >= s["high"], s).when(under, F.struct((mid + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), mid.alias("high")))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high")), halve, lambda s: s["low"])
    return F.when(x.isNotNull(), F.when(F.size(bounds) > 0, found).otherwise(0))


def same(left: list[str], right: list[str]) -> Column:
    """Whether two lists of columns are equal, nulls too."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def part_of(x: Column) -> Column:
    """A number's part: they ascend with it, PARTS to each doubling, whatever its scale and sign."""
    size = F.floor(F.log2(F.abs(x)) * PARTS).cast("int") + F.lit(2048 * PARTS)
    return F.when(x > 0, size).when(x < 0, -size).otherwise(0)


def dealt(rows: DataFrame, group: list[str], score: str, order: list[Column], least_tie: int = LEAST_TIE) -> DataFrame:
    """rows with _part, _tie and _sub, whose order (all ascending) is that of score and order within a group.

    Parts are of the score. A score of over least_tie rows of its group is a part of its own (between those of what is
    below and above it), and its rows, and no others, are dealt out further by the first order column, if that is a number.
    All of it follows from exact counts, so that working it out twice gives the same parts.
    """
    parted = rows.withColumn("_part", part_of(F.col(score)))
    if not order:
        return parted.withColumns({"_tie": F.lit(0), "_sub": F.lit(0)})
    own = [f"_d_{c}" for c in group]
    counts = parted.groupBy(*group, "_part", F.col(score).alias("_v")).agg(F.count("*").alias("_c")).where(F.col("_c") > least_tie)
    frequent = counts.groupBy(*[F.col(c).alias(a) for c, a in zip(group, own, strict=True)], F.col("_part").alias("_d_part")).agg(F.sort_array(F.collect_list("_v")).alias("_ties"))
    met = parted.join(frequent, same([*group, "_part"], [*own, "_d_part"]), "left")
    at = F.coalesce(search(F.col("_ties"), F.col(score)), F.lit(0))
    tied = F.coalesce(F.get("_ties", at) == F.col(score), F.lit(False))
    first = part_of(order[0].cast("double")) if isinstance(rows.select(order[0]).schema[0].dataType, T.NumericType) else F.lit(0)
    sub = F.when(tied, F.coalesce(first, F.lit(-(1 << 30)))).otherwise(0)
    return met.withColumns({"_tie": 2 * at + tied.cast("int"), "_sub": sub}).drop("_ties", "_d_part", *own)


def cumulate(rows: DataFrame, group: list[str], score: str, order: list[Column], sums: dict[str, Column], least_tie: int = LEAST_TIE) -> DataFrame:
    """rows with, for each name, the sum of its value over the group's rows up to and with this one, by score and order.

    Parts of the order are summed first; each part then adds up its own rows from its start. Scores are finite numbers, and
    order tells rows of one score apart (without one, a score has one row); null orders come first.
    """
    parts = ["_part", "_tie", "_sub"]
    parted = dealt(rows, group, score, order, least_tie)
    totals = parted.groupBy(*group, *parts).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    before = Window.partitionBy(*group).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    names = [*group, *parts]
    own = [f"_g_{c}" for c in names]
    starts = totals.select(*[F.col(c).alias(a) for c, a in zip(names, own, strict=True)], *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums])
    inner = Window.partitionBy(*names).orderBy(F.col(score), *order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parted.select("*", *[F.sum(v).over(inner).alias(f"_i_{n}") for n, v in sums.items()])
    out = summed.join(starts, same(names, own))
    return out.select(*rows.columns, *[(F.col(f"_i_{n}") + F.col(f"_s_{n}")).alias(n) for n in sums])
