"""Rank and selective-risk metrics. Uncertainty u is larger where less certain; correct is 0 or 1; ord breaks ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordia.operators.order import cumulate


def scored(rows: DataFrame) -> DataFrame:
    """Rows with a finite u and a correctness."""
    return rows.where("u is not null and not isnan(u) and abs(u) < double('inf') and correct is not null")


def auroc(rows: DataFrame, group: list[str], weight: Column | None = None) -> DataFrame:
    """Per group: n, n_correct, auroc = P(u of a right one < u of a wrong one) + half of ties; null with a single class.

    Rows are counted by distinct u first, so that the running sum sees a row for each. weight: how often a row counts.
    """
    w = F.lit(1) if weight is None else weight
    counts = scored(rows).groupBy(*group, "u").agg(F.sum(w * F.col("correct")).alias("pos"), F.sum(w * (1 - F.col("correct"))).alias("neg"))
    run = cumulate(counts, group, "u", [], {"below": F.col("pos")})
    agg = run.groupBy(*group).agg(F.sum(F.col("neg") * (F.col("below") - F.col("pos") / 2)).alias("wins"), F.sum("pos").alias("n_correct"), F.sum("neg").alias("n_wrong"))
    return agg.select(*group, (F.col("n_correct") + F.col("n_wrong")).alias("n"), "n_correct", F.try_divide(F.col("wins"), F.col("n_correct") * F.col("n_wrong")).alias("auroc"))


def curve(rows: DataFrame, group: list[str]) -> DataFrame:
    """scored rows with k (items accepted so far), errors (of them wrong) and risk = errors / k, by (u, ord)."""
    run = cumulate(scored(rows), group, "u", [F.col("ord")], {"k": F.lit(1), "errors": 1 - F.col("correct")})
    return run.withColumn("risk", F.col("errors") / F.col("k"))


def auprc(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group: average precision of finding wrong items, the most uncertain first; null without one."""
    run = cumulate(scored(rows).withColumn("_q", -F.col("u")), group, "_q", [F.col("ord")], {"k": F.lit(1), "hits": 1 - F.col("correct")})
    return run.groupBy(*group).agg(F.try_divide(F.sum(F.when(F.col("correct") == 0, F.col("hits") / F.col("k"))), F.sum(1 - F.col("correct"))).alias("auprc"))


def aurc(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group: aurc (mean risk over the curve) and norm = (random - aurc) / (random - best), null if random is no worse.

    random is the error rate; the best curve has all right items first: its k-th risk is (k - right) / k after them.
    """
    run = curve(rows, group)
    agg = run.groupBy(*group).agg(F.avg("risk").alias("aurc"), F.count("*").alias("n"), F.sum("correct").alias("right"))
    totals = agg.select(*group, "right")
    best = run.join(totals.withColumnRenamed("right", "_right"), group).groupBy(*group).agg(F.avg(F.greatest(F.col("k") - F.col("_right"), F.lit(0)) / F.col("k")).alias("best"))
    random = (F.col("n") - F.col("right")) / F.col("n")
    return agg.join(best, group).select(*group, "aurc", "best", F.when(random > F.col("best"), (random - F.col("aurc")) / (random - F.col("best"))).alias("norm"))


def risk_at(rows: DataFrame, group: list[str], coverages: list[float]) -> DataFrame:
    """Per group and coverage: the curve's risk there, linear between its points k / n, flat beyond its ends."""
    run = curve(rows, group)
    sizes = run.groupBy(*group).agg(F.max("k").alias("n"))
    wanted = sizes.withColumn("coverage", F.explode(F.array(*map(F.lit, coverages))))
    at = F.greatest(F.col("coverage") * F.col("n"), F.lit(1.0))
    # Rounding keeps a coverage that is a point of the curve on that point.
    wanted = wanted.withColumn("_x", F.round(at, 9)).withColumn("_lo", F.floor("_x")).withColumn("_hi", F.least(F.ceil("_x"), F.col("n")))
    lo = run.select(*group, F.col("k").alias("_lo"), F.col("risk").alias("r_lo"))
    hi = run.select(*group, F.col("k").alias("_hi"), F.col("risk").alias("r_hi"))
    met = wanted.join(lo, [*group, "_lo"]).join(hi, [*group, "_hi"])
    return met.select(*group, "coverage", (F.col("r_lo") + (F.col("r_hi") - F.col("r_lo")) * (F.col("_x") - F.col("_lo"))).alias("risk"))


def by_class(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group: mean u of right and of wrong items, and their gap."""
    right, wrong = F.avg(F.when(F.col("correct") == 1, F.col("u"))), F.avg(F.when(F.col("correct") == 0, F.col("u")))
    return scored(rows).groupBy(*group).agg(right.alias("mean_right"), wrong.alias("mean_wrong"), (wrong - right).alias("gap"))


def kappa(rows: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Per group: Cohen's kappa of two labelings, null where chance agrees always."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*group, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    total = cells.groupBy(*group).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    rows_, columns = cells.groupBy(*group, "a").agg(F.sum("c").alias("ra")), cells.groupBy(*group, F.col("b").alias("a")).agg(F.sum("c").alias("cb"))
    chance = rows_.join(columns, [*group, "a"]).groupBy(*group).agg(F.sum(F.col("ra") * F.col("cb")).alias("both"))
    met = total.join(chance, group, "left")
    po, pe = F.col("same") / F.col("n"), F.coalesce(F.col("both"), F.lit(0)) / (F.col("n") * F.col("n"))
    return met.select(*group, "n", F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def unpivot(items: DataFrame, ids: list[str], methods: list[str]) -> DataFrame:
    """ids, method, u: a row for each method's score that is not null."""
    return items.unpivot(ids, methods, "method", "u").where("u is not null")


def within_slice(items: DataFrame, first: str, second: str) -> DataFrame:
    """slice (and pooled), n, AUROC of both scores on the items that have both, and the difference."""
    both = items.where(F.col(first).isNotNull() & F.col(second).isNotNull() & F.col("correct").isNotNull())
    every = both.unionByName(both.withColumn("slice", F.lit("pooled")))
    found = auroc(unpivot(every, ["slice", "correct"], [first, second]), ["slice", "method"])
    at = lambda name: F.max(F.when(F.col("method") == name, F.col("auroc")))
    return found.groupBy("slice").agg(F.max("n").alias("n"), at(first).alias("first"), at(second).alias("second"), (at(first) - at(second)).alias("difference"))


def quantile(x: Column, q: float) -> Column:
    """Exact, linear between order statistics."""
    return F.percentile(x, F.lit(q))
