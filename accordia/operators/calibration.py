"""Calibration metrics, maps, conformal thresholds and the decision policy. p is a probability of being right."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordia.functions.text import clip01
from accordia.functions.vocabulary import HARM_WEIGHTS
from accordia.operators.order import cumulate

CLIP = 1e-6
#: Parts of the unit interval that a stratum's rows are dealt out by to meet its map.
MAP_PARTS = 256


def bin_of(p: Column, bins: int) -> Column:
    """Bins are (low, high], the first one closed, numbered from 1."""
    return F.greatest(F.ceil(p * bins), F.lit(1)).cast("int")


def scored(rows: DataFrame) -> DataFrame:
    return rows.where("p is not null and correct is not null")


def calibration_error(rows: DataFrame, group: list[str], bins: int) -> DataFrame:
    """Per group: the mean over items of |accuracy - mean p| of their equal-width bin."""
    cells = scored(rows).groupBy(*group, bin_of(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("c"), F.sum("p").alias("p"), F.sum("correct").alias("right"))
    return cells.groupBy(*group).agg((F.sum(F.abs(F.col("right") - F.col("p"))) / F.sum("c")).alias("ece"))


def scores(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group: n, Brier score, log loss with p kept off 0 and 1."""
    p, y = F.least(F.greatest(F.col("p"), F.lit(CLIP)), F.lit(1 - CLIP)), F.col("correct")
    return scored(rows).groupBy(*group).agg(F.count("*").alias("n"), F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier"), F.avg(-F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))


def all_scores(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group: n, brier, log_loss as scores has them, ace_5bin and ece_10bin as calibration_error, in one pass.

    A bin of ten is half of a bin of five, so that sums by ten bins give both.
    """
    p, y = F.least(F.greatest(F.col("p"), F.lit(CLIP)), F.lit(1 - CLIP)), F.col("correct")
    sums = [F.count("*").alias("c"), F.sum("p").alias("p"), F.sum("correct").alias("right"), F.sum((F.col("p") - y) * (F.col("p") - y)).alias("brier"), F.sum(-F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss")]
    ten = scored(rows).groupBy(*group, bin_of(F.col("p"), 10).alias("bin")).agg(*sums)
    ten = ten.withColumn("g10", F.abs(F.col("right") - F.col("p")))
    five = ten.groupBy(*group, F.ceil(F.col("bin") / 2).alias("bin")).agg(F.sum("g10").alias("g10"), *[F.sum(x).alias(x) for x in ("c", "p", "right", "brier", "log_loss")])
    n = F.sum("c")
    return five.groupBy(*group).agg(n.alias("n"), (F.sum("brier") / n).alias("brier"), (F.sum("log_loss") / n).alias("log_loss"), (F.sum(F.abs(F.col("right") - F.col("p"))) / n).alias("ace_5bin"), (F.sum("g10") / n).alias("ece_10bin"))


def reliability_table(rows: DataFrame, group: list[str], bins: int) -> DataFrame:
    """Per group and bin, empty ones too: n, mean p, accuracy."""
    cells = scored(rows).groupBy(*group, bin_of(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    every = cells.select(*group).distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return every.join(cells, [*group, "bin"], "left").select(*group, "bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "accuracy")


def harm_weight(harm: Column, weights: dict[str, float] | None = None) -> Column:
    """A class's weight; null counts as unknown, a class without a weight is an error."""
    out = None
    for name, w in (weights or HARM_WEIGHTS).items():
        cond = F.coalesce(harm, F.lit("unknown")) == name
        out = F.when(cond, F.lit(w)) if out is None else out.when(cond, F.lit(w))
    return out.otherwise(F.raise_error(F.concat(F.lit("no weight for harm class "), harm)).cast("double"))


def selective_risk(rows: DataFrame, group: list[str], coverages: list[float]) -> DataFrame:
    """Per group and coverage c: the max(1, ceil(c n)) most reliable items' weighted error share, and the last p accepted."""
    weighted = scored(rows).withColumn("w", harm_weight(F.col("harm"))).withColumn("_q", -F.col("p"))
    run = cumulate(weighted, group, "_q", [F.col("ord")], {"k": F.lit(1), "sw": F.col("w"), "se": F.col("w") * (1 - F.col("correct"))})
    sizes = weighted.groupBy(*group).agg(F.count("*").alias("n"))
    wanted = sizes.withColumn("coverage", F.explode(F.array(*map(F.lit, coverages)))).withColumn("k", F.greatest(F.lit(1), F.ceil(F.round(F.col("coverage") * F.col("n"), 9))))
    return wanted.join(run.select(*group, "k", "p", "sw", "se"), [*group, "k"]).select(*group, "coverage", F.col("k").alias("accepted"), (F.col("se") / F.col("sw")).alias("risk"), F.col("p").alias("threshold"))


def map_predict(rows: DataFrame, knots: DataFrame) -> DataFrame:
    """p of each x by its stratum's knots (stratum, x, y): linear between them, flat beyond.

    A stretch between two knots is listed under each part of the unit interval that it meets, so that a row meets the
    stretches of its part alone, however many knots its stratum has; a stratum's rows are dealt out by part.
    """
    w = Window.partitionBy("stratum").orderBy("x")
    stretches = knots.select("stratum", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), (F.row_number().over(w) == 1).alias("first"))
    part = lambda x: F.least(F.greatest(F.floor(x * MAP_PARTS), F.lit(0)), F.lit(MAP_PARTS - 1)).cast("int")
    listed = F.sequence(F.when(F.col("first"), 0).otherwise(part(F.col("x0"))), F.when(F.col("x1").isNull(), MAP_PARTS - 1).otherwise(part(F.col("x1"))))
    stretches = stretches.select("*", F.explode(listed).alias("_part"))
    met = rows.withColumn("_part", part(F.col("x"))).join(stretches, ["stratum", "_part"])
    inside = (F.col("first") | (F.col("x") >= F.col("x0"))) & (F.col("x1").isNull() | (F.col("x") < F.col("x1")))
    share = F.when(F.col("x1").isNull() | (F.col("x") <= F.col("x0")), 0.0).otherwise(F.try_divide(F.col("x") - F.col("x0"), F.col("x1") - F.col("x0")))
    return met.where(inside).select(*rows.columns, clip01(F.col("y0") + share * (F.coalesce("y1", "y0") - F.col("y0"))).alias("p"))


def platt_predict(x: Column, slope: Column, intercept: Column) -> Column:
    return clip01(1 / (1 + F.exp(-(slope * clip01(x) + intercept))))


def map_method(n: Column, spread: Column, least: int = 100, least_spread: float = 0.15) -> Column:
    return F.when((n < least) | (spread < least_spread), "platt").otherwise("isotonic")


def conformal_threshold(rows: DataFrame, group: list[str], target: float) -> DataFrame:
    """Per group: n, index = ceil((n + 1) target), threshold = the index-th largest p; both null if index > n."""
    ranked = rows.where("p is not null").withColumn("_q", -F.col("p"))
    run = cumulate(ranked, group, "_q", [F.col("ord")], {"k": F.lit(1)})
    sizes = ranked.groupBy(*group).agg(F.count("*").alias("n"))
    index = F.ceil(F.round((F.col("n") + 1) * F.lit(target), 9))
    sizes = sizes.withColumn("index", F.when(index <= F.col("n"), F.greatest(index, F.lit(1))))
    return sizes.join(run.select(*group, F.col("k").alias("index"), F.col("p").alias("threshold")), [*group, "index"], "left").select(*group, "n", "index", "threshold")


#: What an action was triggered by.
TRIGGERS = ("undefined_reliability", "phase_d_flag_outranks_calibrated_reliability", "reliability_above_answer_threshold", "reliability_between_verify_and_answer_thresholds", "reliability_below_verify_threshold")


def decide(p: Column, harm: Column, flagged: Column, verify_cost: float = 0.15, abstain_cost: float = 0.35, undefined: str = "verify") -> tuple[Column, Column]:
    """(action, trigger): the cheapest of answering, (1 - p) * weight, verifying and abstaining; a flag forbids answering."""
    loss = (1 - p) * harm_weight(harm)
    answers = loss <= verify_cost
    action = F.when(p.isNull(), undefined).when(answers & ~flagged, "answer").when(loss <= abstain_cost, "verify").otherwise("abstain")
    undefined_, flagged_, above, between, below = map(F.lit, TRIGGERS)
    trigger = F.when(p.isNull(), undefined_).when(answers & flagged, flagged_).when(answers, above).when(loss <= abstain_cost, between).otherwise(below)
    return action, trigger


def census(rows: DataFrame, group: list[str], action: str = "action") -> DataFrame:
    """Per group and action: n and share of the group."""
    counts = rows.groupBy(*group, action).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def harm_class(statutes: DataFrame, topic: str = "topic", harm: str = "harm", rule: str = "max") -> DataFrame:
    """Per topic: its class of the largest weight, or, by the rule modal, its most frequent one; ties to the first by name."""
    if rule not in ("max", "modal"):
        raise ValueError("the rule is max or modal")
    found = statutes.where(F.col(harm).isNotNull()).groupBy(topic, harm).agg(F.count("*").alias("_n")).withColumn("_w", harm_weight(F.col(harm)) if rule == "max" else F.col("_n"))
    return found.groupBy(topic).agg(F.min_by(harm, F.struct(-F.col("_w"), F.col(harm))).alias("harm_class"))


def z_of(confidence: float) -> float:
    """The normal quantile that a two-sided interval of this confidence reaches to."""
    if not 0 < confidence < 1:
        raise ValueError("a confidence is between 0 and 1")
    return NormalDist().inv_cdf((1 + confidence) / 2)


def normal_interval(p: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    spread = F.lit(z) * F.sqrt(p * (1 - p) / n)
    return clip01(p - spread), clip01(p + spread)


def replicate_summary(replicates: DataFrame, group: list[str], alpha: float = 0.05) -> DataFrame:
    """Per group of replicate values: n, mean, standard error (n - 1), floor and ceiling order statistics."""
    values = replicates.where("value is not null").groupBy(*group).agg(F.sort_array(F.collect_list("value")).alias("v"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("se"))
    n = F.size("v")
    low, high = F.floor(F.lit(alpha / 2) * (n - 1)).cast("int"), F.ceil(F.lit(1 - alpha / 2) * (n - 1)).cast("int")
    return values.select(*group, n.alias("n"), "mean", "se", F.col("v")[low].alias("low"), F.col("v")[high].alias("high"))


def gate_stability(low: Column, high: Column, threshold: Column) -> Column:
    """Whether a metric that must be under the threshold is so over its whole interval; a missing one is not computed."""
    return F.when(low.isNull() | high.isNull(), "not_computed").when(high < threshold, "stable_pass").when(low > threshold, "stable_fail").otherwise("indeterminate")
