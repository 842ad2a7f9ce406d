"""Stages that give the rows of a run new columns: each takes its inputs as tables and reads only those that are still to be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordia.functions import mentions
from accordia.operators import agreement, fits, validity, warrant


def context(samples: DataFrame, statutes: DataFrame, day: Column) -> DataFrame:
    """An item a row: its references with their state on the day, and how many assertions cite nothing."""
    return validity.context(samples, statutes, day)


def typed(samples: DataFrame, pairs: DataFrame, tau: float) -> DataFrame:
    """An item a row, of its samples' typed clusters: n, n_clusters, entropy, top_share, and merged, how many exact keys they save."""
    labelled = samples.join(fits.typed_clusters(samples, pairs, tau).select("item_id", "pos", F.col("label").cast("string").alias("cluster")), ["item_id", "pos"])
    by_cluster, by_key = agreement.profile(labelled, "cluster"), agreement.profile(samples)
    out = by_cluster.select("item_id", "n", F.col("n_keys").alias("n_clusters"), "entropy", "top_share")
    return out.join(by_key.select("item_id", F.col("n_keys").alias("_exact")), "item_id").withColumn("merged", F.col("_exact") - F.col("n_clusters")).drop("_exact")


def detected(samples: DataFrame, statutes: DataFrame, links: DataFrame, day: Column, source: str = "auto", model_mass: DataFrame | None = None) -> DataFrame:
    """An item a row: warrant.detect over clusters of equal keys. A model's mass must lie within 0 and 1, or the stage fails."""
    if model_mass is not None:
        mass = F.col("mass")
        model_mass = model_mass.withColumn("mass", F.when(mass.isNull() | (~F.isnan(mass) & mass.between(0, 1)), mass).otherwise(F.raise_error(F.concat(F.lit("no share: "), mass.cast("string"))).cast("double")))
    labelled = samples.join(agreement.first_seen(samples, "key").select("item_id", "pos", "label"), ["item_id", "pos"])
    return warrant.detect(labelled, statutes, links, day, source, model_mass)


def rejudged(answers: DataFrame) -> DataFrame:
    """Stored answers (item_id, pos, text, gold_act, gold_provision, verdict) judged again: correct, label, act, provision, and changed."""
    kept = answers.withColumn("_v", mentions.judge_answers("text", "gold_act", "gold_provision"))
    return kept.select(*answers.columns, "_v.*", (~F.col("_v.label").eqNullSafe(F.col("verdict"))).alias("changed"))


def census(rows: DataFrame, column: str) -> DataFrame:
    """column, n: how often each value comes, null included."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))
