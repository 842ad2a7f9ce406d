"""Evaluation matrix, population reports, contracts and deployment figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordia.operators.agreement import wilson
from accordia.operators.ranking import aurc, auroc


def matrix(rows: DataFrame, slices: list[str], methods: list[str]) -> DataFrame:
    """slice, method, n, auroc, aurc, reason: a cell for each declared slice and method, with why a metric is undefined."""
    spark = rows.sparkSession
    cells = spark.createDataFrame([(s, m) for s in slices for m in methods], "slice string, method string")
    spread = rows.groupBy("slice", "method").agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    met = cells.join(auroc(rows, ["slice", "method"]), ["slice", "method"], "left").join(aurc(rows, ["slice", "method"]).select("slice", "method", "aurc"), ["slice", "method"], "left").join(spread, ["slice", "method"], "left")
    reason = F.when(F.col("n").isNull(), "no scores").when(F.col("auroc").isNull(), "single class").when(F.col("lo") == F.col("hi"), "constant score")
    return met.select("slice", "method", F.coalesce("n", F.lit(0)).alias("n"), "auroc", "aurc", reason.alias("reason"))


def confident_wrong(rows: DataFrame, group: list[str], least: int = 4) -> DataFrame:
    """Per group: the linear lower quartile of u, and wrong items at or under it; null under `least` items."""
    cut = rows.groupBy(*group).agg(F.percentile("u", F.lit(0.25)).alias("cut"), F.count("*").alias("n"))
    hits = rows.join(cut, group).groupBy(*group, "cut", "n").agg(F.sum(((F.col("correct") == 0) & (F.col("u") <= F.col("cut"))).cast("int")).alias("c"))
    ok = F.col("n") >= least
    return hits.select(*group, "n", F.when(ok, F.col("cut")).alias("cut"), F.when(ok, F.col("c")).alias("confident_wrong"))


def population(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group: rows, scored, in range, invalid, right, wrong, whether both classes are there."""
    u = F.col("u")
    valid = u.isNotNull() & u.between(0.0, 1.0)
    count = lambda c: F.sum(c.cast("int"))
    agg = rows.groupBy(*group).agg(F.count("*").alias("n"), count(u.isNotNull()).alias("scored"), count(valid).alias("valid"), F.coalesce(count(valid & (F.col("correct") == 1)), F.lit(0)).alias("right"), F.coalesce(count(valid & (F.col("correct") == 0)), F.lit(0)).alias("wrong"))
    return agg.withColumn("ready", (F.col("right") > 0) & (F.col("wrong") > 0))


def detector_state(x: Column) -> Column:
    return F.when(x.isNull(), "missing").when(F.isnan(x) | ~x.between(0.0, 1.0), "invalid").when(x == 1, "silent").when(x == 0, "fired").otherwise("partial")


def confound(rows: DataFrame, positive: str) -> DataFrame:
    """method, auroc of u against being in the slice `positive` rather than in another."""
    return auroc(rows.withColumn("correct", (F.col("slice") == positive).cast("int")), ["method"])


def yields(samples: DataFrame, group: list[str]) -> DataFrame:
    """Per group: items, items whose samples are mostly right, sample rate, Wilson interval of the item rate."""
    items = samples.groupBy(*group, "item_id").agg(F.sum("correct").alias("r"), F.count("*").alias("c"))
    agg = items.groupBy(*group).agg(F.count("*").alias("items"), F.sum((F.col("r") * 2 >= F.col("c")).cast("int")).alias("hits"), (F.sum("r") / F.sum("c")).alias("sample_rate"))
    low, high = wilson(F.col("hits"), F.col("items"))
    return agg.select("*", low.alias("low"), high.alias("high"))


def stratified_cap(items: DataFrame, stratum: str, order: str, total: int, strata: int) -> DataFrame:
    """The first max(1, total // strata) rows of each stratum."""
    return items.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).where(F.col("_r") <= max(1, total // strata)).drop("_r")


def latency(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Per group, of finite values of 0 or more: n, median, p95 (linear), mean, min, max."""
    ok = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) >= 0) & (F.col(value) < float("inf")))
    return ok.groupBy(*group).agg(F.count("*").alias("n"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.95)).alias("p95"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def verdict_census(samples: DataFrame, group: list[str], unresolved: tuple[str, ...]) -> DataFrame:
    """Per group and label (the last part of a|b): n, share, and the group's share of resolved labels."""
    rows = samples.select(*group, F.substring_index("verdict", "|", -1).alias("label"))
    counts = rows.groupBy(*group, "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group)
    return counts.select(*group, "label", "n", (F.col("n") / F.sum("n").over(w)).alias("share"), (F.sum(F.when(F.col("label").isin(*unresolved), 0).otherwise(F.col("n"))).over(w) / F.sum("n").over(w)).alias("resolved_share"))


def top_labels(census: DataFrame, group: list[str], most: int) -> DataFrame:
    """The most frequent labels of each group of a verdict census, with their place; ties by name."""
    order = Window.partitionBy(*group).orderBy(F.desc("n"), "label")
    return census.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def ladder_violations(rungs: DataFrame) -> DataFrame:
    """Per item: positions whose value is under the one before."""
    w = Window.partitionBy("item_id").orderBy("pos")
    return rungs.withColumn("_b", F.lag("value").over(w)).where("value < _b").groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_list("pos")), ",").alias("at"), F.count("*").alias("n"))


def contract(rows: DataFrame, key: str, required: list[str]) -> DataFrame:
    """key, rule: missing or blank fields, and keys that come more than once."""
    missing = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"missing {c}")) for c in required]))
    broken = rows.select(F.col(key).cast("string").alias("key"), F.explode(missing).alias("rule"))
    twice = rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("_n")).where("_n > 1").select("key", F.lit("duplicate").alias("rule"))
    return broken.unionByName(twice)


def gate(conditions: DataFrame) -> DataFrame:
    """name, holds rows -> verdict: FAIL on a false one, UNDETERMINED on a null one, else PASS; and how many hold."""
    holds = F.coalesce(F.min(F.col("holds").cast("int")), F.lit(0))
    return conditions.agg(F.when(holds == 0, "FAIL").when(F.sum(F.col("holds").isNull().cast("int")) > 0, "UNDETERMINED").otherwise("PASS").alias("verdict"), F.sum(F.coalesce(F.col("holds").cast("int"), F.lit(0))).alias("held"))


def contrast(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Accuracy in slice a less that in slice b."""
    rate = lambda s: F.avg(F.when(F.col("slice") == s, F.col("correct").cast("double")))
    return rows.agg(rate(a).alias("first"), rate(b).alias("second"), (rate(a) - rate(b)).alias("difference"))


def prompt_tokens(system: Column, question: Column) -> Column:
    return F.ceil((F.length(system) + F.length(question)) / 4)
