"""Typed relations between answers: rules, matrices, clusters and classifier metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relation labels, those that merge answers, and those that keep them apart.
LABELS = (
    "SAME_PROVISION", "LEGALLY_EQUIVALENT", "CONDITIONALLY_EQUIVALENT", "DIFFERENT_PROVISION", "AMBIGUOUS", "CONTRADICTORY", "OUTDATED_PROVISION",
    "TEMPORAL_MISMATCH", "JURISDICTION_MISMATCH",
)
MERGE = ("SAME_PROVISION", "LEGALLY_EQUIVALENT", "CONDITIONALLY_EQUIVALENT")
BLOCK = ("DIFFERENT_PROVISION", "AMBIGUOUS", "CONTRADICTORY")


def pairs(samples: DataFrame, most: int | None = None) -> DataFrame:
    """item_id, i, j with both keys and texts for i < j of an item; with most, its first usable pairs (two known keys)."""
    own = samples.select("item_id", "pos", "key", "text")
    if most is not None:  # the first pairs are of the first most + 1 samples with a key
        place = F.row_number().over(Window.partitionBy("item_id").orderBy("pos"))
        own = own.where("key <> 'NONE'").withColumn("_place", place).where(F.col("_place") <= most + 1).drop("_place")
    a, b = own.alias("a"), own.alias("b")
    met = a.join(b, (F.col("a.item_id") == F.col("b.item_id")) & (F.col("a.pos") < F.col("b.pos")))
    met = met.select(F.col("a.item_id").alias("item_id"), F.col("a.pos").alias("i"), F.col("b.pos").alias("j"), F.col("a.key").alias("key_i"), F.col("b.key").alias("key_j"), F.col("a.text").alias("text_i"), F.col("b.text").alias("text_j"))
    if most is None:
        return met
    return met.withColumn("_place", F.row_number().over(Window.partitionBy("item_id").orderBy("i", "j"))).where(F.col("_place") <= most).drop("_place")


def identity_pairs(samples: DataFrame) -> DataFrame:
    """item_id, i, j, label, score: each sample with a known key, and the next of its item with the same key, as the same provision.

    These chains make the same components as all pairs of equal keys do, and as many rows as there are samples.
    """
    order = Window.partitionBy("item_id", "key").orderBy("pos")
    linked = samples.where("key <> 'NONE'").select("item_id", F.col("pos").alias("i"), F.lead("pos").over(order).alias("j"))
    return linked.where("j is not null").select("item_id", "i", "j", F.lit("SAME_PROVISION").alias("label"), F.lit(1.0).alias("score"))


def deduplicated(p: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each combination."""
    rest = [c for c in p.columns if c not in by]
    best = p.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*by, "_b.*")


def rule_relation(key_i: Column, key_j: Column, link: Column) -> Column:
    """What the keys alone tell: equal keys, a declared link, an unknown key, or different ones."""
    linked = F.when(link == "successor_of", "LEGALLY_EQUIVALENT").when(link == "different_offence", "CONTRADICTORY")
    return F.when((key_i == "NONE") | (key_j == "NONE"), "AMBIGUOUS").when(key_i == key_j, "SAME_PROVISION").otherwise(F.coalesce(linked, F.lit("DIFFERENT_PROVISION")))


def symmetric(scores: DataFrame) -> DataFrame:
    """item_id, i < j, score: the mean of both directions of directed scores."""
    return scores.where("i <> j").groupBy("item_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.avg("score").alias("score"))


def stronger_label(scores: DataFrame) -> DataFrame:
    """item_id, i < j, label of the direction with the higher score; a tie (to 1e-12) takes the smaller label."""
    rows = scores.where("i <> j").select("item_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "label", F.round("score", 12).alias("s"))
    return rows.groupBy("item_id", "i", "j").agg(F.min_by("label", F.struct(-F.col("s"), F.col("label"))).alias("label"))


def contradiction_mass(clusters: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Per item: mass of clusters of whose pairs with the largest cluster (then the smallest label) half or more contradict.

    clusters: item_id, pos, label; contradictions: item_id, i < j.
    """
    sizes = clusters.groupBy("item_id", "label").agg(F.count("*").alias("c"))
    total = sizes.groupBy("item_id").agg(F.sum("c").alias("m"), F.max_by(F.struct("label", "c"), F.struct("c", -F.col("label"))).alias("b"))
    modal = total.select("item_id", "m", F.col("b.label").alias("modal"), F.col("b.c").alias("modal_c"))
    ends = contradictions.join(clusters.select("item_id", F.col("pos").alias("i"), F.col("label").alias("li")), ["item_id", "i"]).join(clusters.select("item_id", F.col("pos").alias("j"), F.col("label").alias("lj")), ["item_id", "j"])
    hits = ends.join(modal.select("item_id", "modal"), "item_id").where("(li = modal) <> (lj = modal)").groupBy("item_id", F.when(F.col("li") == F.col("modal"), F.col("lj")).otherwise(F.col("li")).alias("label")).agg(F.count("*").alias("h"))
    met = sizes.join(modal, "item_id").join(hits, ["item_id", "label"], "left")
    against = (F.col("label") != F.col("modal")) & (F.coalesce("h", F.lit(0)) * 2 >= F.col("c") * F.col("modal_c"))
    return met.groupBy("item_id").agg((F.sum(F.when(against, F.col("c")).otherwise(0)) / F.max("m")).alias("mass"))


def class_report(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """label, support, precision, recall, f1 of each label; 0 where undefined."""
    one = rows.groupBy(F.col(gold).alias("label")).agg(F.count("*").alias("support"), F.sum((F.col(gold) == F.col(predicted)).cast("int")).alias("tp"))
    two = rows.groupBy(F.col(predicted).alias("label")).agg(F.count("*").alias("said"))
    met = one.join(two, "label", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    met = met.select("label", zero(F.col("support")).alias("support"), zero(F.try_divide(zero(F.col("tp")), F.col("said"))).alias("precision"), zero(F.try_divide(zero(F.col("tp")), F.col("support"))).alias("recall"))
    return met.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """gold, said, n: how often each label is taken for each."""
    return rows.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("said")).agg(F.count("*").alias("n"))


def exact_key_label(key_i: Column, key_j: Column, link: Column) -> Column:
    """The baseline classifier: equal known keys and declared successors merge, unknown keys are ambiguous, others differ."""
    return (
        F.when((key_i == key_j) & (key_i != "NONE"), "SAME_PROVISION").when(link.isin("successor_of", "merged_into"), "LEGALLY_EQUIVALENT")
        .when((key_i == "NONE") | (key_j == "NONE"), "AMBIGUOUS").otherwise("DIFFERENT_PROVISION")
    )


def typed_stats(samples: DataFrame, label: str = "label") -> DataFrame:
    """Per item: n_clusters, top_share, entropy in bits, all_same, counts (largest first, joined by commas)."""
    counts = samples.groupBy("item_id", label).agg(F.count("*").alias("c"))
    m = F.sum("c")
    entropy = F.greatest(F.log2(m) - F.sum(F.col("c") * F.log2("c")) / m, F.lit(0.0))
    return counts.groupBy("item_id").agg(F.count("*").alias("n_clusters"), (F.max("c") / m).alias("top_share"), entropy.alias("entropy"), (F.count("*") == 1).cast("int").alias("all_same"), F.array_join(F.sort_array(F.collect_list("c"), asc=False), ",").alias("counts"))


def merge_effect(typed: DataFrame, exact: DataFrame) -> DataFrame:
    """typed_stats with what they change against profiles of exact keys (top_share, entropy, n_keys)."""
    e = exact.select("item_id", F.col("top_share").alias("_a"), F.col("entropy").alias("_e"), F.col("n_keys").alias("_n"))
    changes = {
        "d_agreement": F.col("top_share") - F.col("_a"), "d_entropy": F.col("entropy") - F.col("_e"), "d_n_clusters": F.col("n_clusters") - F.col("_n"),
        "collision_lost": ((F.col("_n") == 1) & (F.col("all_same") == 0)).cast("int"),
    }
    return typed.join(e, "item_id").withColumns(changes).drop("_a", "_e", "_n")


def macro_f1(report: DataFrame) -> DataFrame:
    return report.agg(F.avg("f1").alias("macro_f1"), F.sum("support").alias("n"))


def threshold_sweep(rows: DataFrame, grid: list[float]) -> DataFrame:
    """tau, tp, fp, fn, precision, recall, f1 of score >= tau against gold (0 or 1); one pass counts rows by grid step."""
    step = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col("score")))
    cells = rows.groupBy(step.alias("step"), "gold").agg(F.count("*").alias("c"))
    taus = rows.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(grid)], "at int, tau double")
    over = F.col("step") >= F.col("at")
    total = lambda cond: F.sum(F.when(cond, F.col("c")).otherwise(0))
    swept = cells.withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(len(grid))))).groupBy("at").agg(total(over & (F.col("gold") == 1)).alias("tp"), total(over & (F.col("gold") == 0)).alias("fp"), total(~over & (F.col("gold") == 1)).alias("fn"))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return swept.join(taus, "at").select("tau", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The tau of the best f1 (to 1e-12), ties to the lower."""
    return sweep.agg(F.min_by("tau", F.struct(-F.round("f1", 12), F.col("tau"))).alias("tau"), F.max("f1").alias("f1"))
