"""Evaluation cells: every metric of a method on a slice, each with the reason where it is undefined, and what rests on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordia.operators import calibration, ranking
from accordia.operators.evaluation import confident_wrong, stratified_cap, yields
from accordia.operators.order import cumulate
from accordia.operators.ranking import unpivot
from accordia.operators.records import slice_outcomes
from accordia.operators.tables import written

# Why a metric is undefined.
NO_SCORED_ITEMS = "no_items_with_a_score_and_a_label"
SINGLE_CLASS = "single_correctness_class"
CONSTANT_SCORE = "constant_score"
METHOD_UNAVAILABLE = "method_not_implemented"
LOGPROBS_ABSENT = "logprobs_absent"
OUTSIDE_UNIT_INTERVAL = "score_outside_unit_interval"
HARM_ABSENT = "harm_class_absent"
DEGENERATE = "degenerate_label_distribution"

COVERAGE = 0.5
CELL = ["slice", "method"]


def judge_coverage(items: DataFrame, samples: DataFrame, group: list[str], unresolved: str = "unresolved") -> DataFrame:
    """Per group: items, those with a correctness label, their share; the same of samples (item_id, verdict)."""
    own = items.groupBy(*group).agg(F.count("*").alias("n_items"), F.count("correct").alias("n_items_resolved"))
    said = samples.join(items.select("item_id", *group), "item_id").groupBy(*group).agg(F.count("verdict").alias("n_samples"), F.sum((F.col("verdict") != unresolved).cast("long")).alias("n_samples_resolved"))
    met = own.join(said, group, "left").fillna(0, ["n_samples", "n_samples_resolved"])
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return met.withColumns({"item_coverage": share("n_items_resolved", "n_items"), "sample_coverage": share("n_samples_resolved", "n_samples")})


def score_cells(items: DataFrame, slices: list[str], methods: list[str], unimplemented: tuple[str, ...] = (), logprob: tuple[str, ...] = ("p_true",), coverage: float = COVERAGE) -> DataFrame:
    """A row for each declared slice and method: counts, metrics and reasons.

    items: slice, ord, correct (0, 1 or null), harm (null if unknown) and a column of uncertainty for each method; those in
    `unimplemented` need none. Ranking metrics need both classes and more than one score, calibration metrics scores within
    0 and 1 and both classes, the harm-weighted risk a class of harm for every item. A slice without items has n_items 0.
    The scores are written once, as a long table of which each metric is one pass.
    """
    spark = items.sparkSession
    made = [m for m in methods if m not in unimplemented]
    long = unpivot(items, ["slice", "ord", "correct", "harm"], made).where("correct is not null and not isnan(u) and abs(u) < double('inf')")
    long = written(long.where(F.col("slice").isin(*slices)).withColumn("p", 1 - F.col("u")), "scores")
    base = long.groupBy(*CELL).agg(
        F.count("*").alias("n_scored"), F.sum("correct").cast("long").alias("n_correct"), F.min("u").alias("u_min"), F.max("u").alias("u_max"),
        F.sum(F.col("harm").isNull().cast("int")).alias("_no_harm"), F.bool_and(F.col("u").between(0.0, 1.0)).alias("_unit"),
    )
    # One order gives the curve, its area, the risk at the coverage and the harm-weighted one; reasons hide what is undefined.
    weighted = long.withColumn("_w", calibration.harm_weight(F.col("harm")))
    wrong = 1 - F.col("correct")
    run = cumulate(weighted, CELL, "u", [F.col("ord")], {"k": F.lit(1), "errors": wrong, "sw": F.col("_w"), "se": F.col("_w") * wrong})
    run = run.join(base.select(*CELL, F.col("n_scored").alias("_n"), F.col("n_correct").alias("_r")), CELL)
    risk, x = F.col("errors") / F.col("k"), F.round(F.greatest(F.lit(coverage) * F.col("_n"), F.lit(1.0)), 9)
    at = lambda k, value: F.max(F.when(F.col("k") == k, value))
    accepted = F.greatest(F.lit(1), F.ceil(F.round(F.lit(coverage) * F.col("_n"), 9)))
    curve = run.groupBy(*CELL).agg(
        F.avg(risk).alias("_aurc"), F.avg(F.greatest(F.col("k") - F.col("_r"), F.lit(0)) / F.col("k")).alias("_best"), F.first(x).alias("_x"), at(F.floor(x), risk).alias("_lo"),
        at(F.least(F.ceil(x), F.col("_n")), risk).alias("_hi"), at(accepted, F.col("se") / F.col("sw")).alias("harm_weighted_risk"), F.first((F.col("_n") - F.col("_r")) / F.col("_n")).alias("_random"),
    )
    curve = curve.select(
        *CELL, F.when(F.col("_random") > F.col("_best"), (F.col("_random") - F.col("_aurc")) / (F.col("_random") - F.col("_best"))).alias("normalized_aurc"),
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_x") - F.floor("_x"))).alias("selective_risk"), "harm_weighted_risk",
    )
    parts = [
        curve, ranking.auroc(long, CELL).select(*CELL, "auroc"), ranking.auprc(long, CELL), calibration.all_scores(long, CELL).select(*CELL, "ace_5bin", "ece_10bin", "brier"),
        confident_wrong(long, CELL).select(*CELL, "cut", "confident_wrong"),
    ]
    out = spark.createDataFrame([(s, m, i) for s in slices for i, m in enumerate(methods)], "slice string, method string, place int")
    out = out.join(items.groupBy("slice").agg(F.count("*").alias("n_items")), "slice", "left").join(base, CELL, "left")
    for part in parts:
        out = out.join(part, CELL, "left")
    n, right = F.coalesce("n_scored", F.lit(0)), F.coalesce("n_correct", F.lit(0))
    everything = F.when(F.col("method").isin(*unimplemented), METHOD_UNAVAILABLE).when(n == 0, F.when(F.col("method").isin(*logprob), LOGPROBS_ABSENT).otherwise(NO_SCORED_ITEMS))
    single = F.when((right == 0) | (right == n), SINGLE_CLASS)
    rank = F.coalesce(everything, single, F.when(F.col("u_min") == F.col("u_max"), CONSTANT_SCORE))
    unit = F.coalesce(everything, F.when(~F.col("_unit"), OUTSIDE_UNIT_INTERVAL), single)
    harm = F.coalesce(unit, F.when(F.col("_no_harm") > 0, HARM_ABSENT))
    norm = F.coalesce(rank, F.when(F.col("normalized_aurc").isNull(), DEGENERATE))
    kept = lambda reason, *names: [F.when(reason.isNull(), F.col(c)).alias(c) for c in names]
    return out.select(
        *CELL, F.coalesce("n_items", F.lit(0)).alias("n_items"), n.alias("n_scored"), right.alias("n_correct"), (n - right).alias("n_incorrect"),
        *kept(everything, "u_min", "u_max", "cut", "confident_wrong"), F.when(everything.isNull(), (n - right) / n).alias("base_error_rate"),
        *kept(rank, "auroc", "auprc", "normalized_aurc", "selective_risk"), *kept(unit, "ace_5bin", "ece_10bin", "brier"), *kept(harm, "harm_weighted_risk"),
        everything.alias("reason"), rank.alias("rank_reason"), norm.alias("aurc_reason"), unit.alias("unit_reason"), harm.alias("harm_reason"),
    )


def pooled_reference(items: DataFrame, slices: list[str], methods: list[str]) -> DataFrame:
    """method, n_scored, auroc, confident_wrong, reason over all slices together; an error unless every slice has items."""
    present = {r[0] for r in items.where(F.col("slice").isin(*slices)).select("slice").distinct().collect()}
    if missing := [s for s in slices if s not in present]:
        raise ValueError(f"cannot pool: no items in {missing}")
    found = score_cells(items.where(F.col("slice").isin(*slices)).withColumn("slice", F.lit("pooled")), ["pooled"], methods)
    single = F.when(F.col("n_scored") == 0, NO_SCORED_ITEMS).when((F.col("n_correct") == 0) | (F.col("n_incorrect") == 0), SINGLE_CLASS)
    # Here one score for all is half, as ties are.
    area = F.when(single.isNull(), F.coalesce("auroc", F.lit(0.5)))
    return found.select("method", "n_scored", area.alias("auroc"), F.when(single.isNull(), F.col("confident_wrong")).alias("confident_wrong"), single.alias("reason"))


def comparison_gate(cells: DataFrame, coverage: DataFrame, own: list[str], baselines: list[str]) -> DataFrame:
    """Whether a comparison can be read: status MET or NOT_MET (NOT_EVALUABLE without items), and the four conditions.

    On every slice with items: both classes; a defined AUROC of a method in `own` and of one in `baselines`; a known share of
    judged items (coverage: slice, item_coverage); and a reason wherever an AUROC is undefined.
    """
    some = lambda names: F.max((F.col("method").isin(*names) & F.col("auroc").isNotNull()).cast("int")) == 1
    per = cells.where("n_items > 0").groupBy("slice").agg((some(own) & some(baselines)).alias("comparable"), F.min((F.col("auroc").isNotNull() | F.col("rank_reason").isNotNull()).cast("int")).alias("stated"))
    met = per.join(coverage.select("slice", F.col("item_coverage"), (F.col("right") > 0).alias("_r"), (F.col("wrong") > 0).alias("_w")), "slice", "left")
    every = lambda c: F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False))
    conditions = {
        "both_classes": every(F.col("_r") & F.col("_w")), "comparison_computable": every(F.col("comparable")),
        "coverage_reported": every(F.col("item_coverage").isNotNull()), "undefined_stated": every(F.col("stated") == 1),
    }
    out = met.agg(F.count("*").alias("n_slices"), *[c.alias(name) for name, c in conditions.items()])
    holds = F.col("both_classes") & F.col("comparison_computable") & F.col("coverage_reported") & F.col("undefined_stated")
    return out.withColumn("status", F.when(F.col("n_slices") == 0, "NOT_EVALUABLE").when(holds, "MET").otherwise("NOT_MET"))


def slice_methods(items: DataFrame, group: str, methods: list[str]) -> DataFrame:
    """Per group and method, over resolved items: n, accuracy, auroc, auprc, aurc, norm, mean u of right and wrong ones."""
    rows = unpivot(items.where("correct is not null and resolved = 1"), [group, "ord", "correct"], methods).where("not isnan(u)")
    by = [group, "method"]
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    for part in (ranking.auroc(rows, by).select(*by, "auroc"), ranking.auprc(rows, by), ranking.aurc(rows, by).select(*by, "aurc", "norm"), ranking.by_class(rows, by)):
        out = out.join(part, by, "left")
    return out


def premise_gate(best_auroc: Column, accuracy: Column, collisions: Column, collision_accuracy: Column, gaps: Column, here: tuple[Column, Column, Column], there: tuple[Column, Column, Column], most: float = 0.70, least: float = 0.10) -> tuple[Column, Column, Column]:
    """(ceiling_ok, contrast_ok, pass) from scalars.

    ceiling: the best AUROC on the target slice is at most `most`; undefined, it holds if the slice and its collisions, ten
    or more, are mostly wrong. contrast: the share confidently wrong (value, low, high) is larger here than there by `least`,
    and the intervals do not overlap. The gate needs the ceiling, and a gap that excludes zero or the contrast.
    """
    alone = (accuracy < 0.5) & (collisions >= 10) & (collision_accuracy < 0.5)
    ceiling = F.when(best_auroc.isNotNull(), best_auroc <= most).otherwise(F.coalesce(alone, F.lit(False)))
    (a, a_low, a_high), (b, b_low, b_high) = here, there
    contrast = F.coalesce((a - b >= least) & ((a_low > b_high) | (b_low > a_high)), F.lit(False))
    return ceiling, contrast, ceiling & ((gaps > 0) | contrast)


def separation_gate(auroc: Column, low: Column, full: Column, drop: Column, alarm_right: Column, alarm_wrong: Column) -> tuple[Column, Column, Column, Column]:
    """(separation, attribution, honesty, verdict): AUROC and its lower bound over a half; pinning the temporal factor takes
    half of what is over a half; and alarms on right answers are rarer than on wrong ones. Unknown is false."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    one, two, three = sure((auroc > 0.5) & (low > 0.5)), sure((full > 0.5) & (drop >= 0.5 * (full - 0.5))), sure(alarm_right < alarm_wrong)
    return one, two, three, F.when(one & two & three, "PASS").otherwise("FAIL")


def pilot_verdict(samples: DataFrame, unresolved: tuple[str, ...], target: str, control: str, least_coverage: float = 0.85) -> DataFrame:
    """One row: judge coverage, mean share of right answers of both slices, and what it comes to.

    FAIL: coverage under the least, or the control under 0.20. WARN: the target over 0.80, or a gap under 0.10.
    """
    label = F.substring_index("verdict", "|", -1)
    items = samples.groupBy("slice", "item_id").agg(F.avg(F.col("correct").cast("double")).alias("f"), F.sum((~label.isin(*unresolved)).cast("int")).alias("r"), F.count("*").alias("c"))
    mean = lambda s: F.avg(F.when(F.col("slice") == s, F.col("f")))
    found = items.agg((F.sum("r") / F.sum("c")).alias("coverage"), mean(target).alias("target"), mean(control).alias("control"))
    failed = (F.col("coverage") < least_coverage) | F.coalesce(F.col("target").isNotNull() & (F.col("control") < 0.20), F.lit(False))
    warned = F.coalesce((F.col("control") >= 0.20) & ((F.col("target") > 0.80) | (F.col("control") - F.col("target") < 0.10)), F.lit(False))
    return found.withColumn("verdict", F.when(failed, "FAIL").when(warned, "WARN").otherwise("PASS"))


def resolved_warning(samples: DataFrame, unresolved: tuple[str, ...], least: float = 0.7) -> DataFrame:
    """One row: share of samples with a resolved verdict, and whether that is too low to read on."""
    share = F.avg((~F.substring_index("verdict", "|", -1).isin(*unresolved)).cast("double"))
    return samples.agg(share.alias("resolved_share"), (share < least).alias("warn"))


def group_report(detected: DataFrame, group: list[str]) -> DataFrame:
    """Per group: n, fires (with a flag), their share, mean common mode of defined ones, how many are undefined."""
    fires = (F.size("flags") > 0).cast("int")
    return detected.groupBy(*group).agg(F.count("*").alias("n"), F.sum(fires).alias("fires"), F.avg(fires.cast("double")).alias("fire_rate"), F.avg("cm").alias("cm_mean"), F.sum(F.col("cm").isNull().cast("int")).alias("cm_undefined"))


def joined_coverage(items: DataFrame, calibrated: DataFrame, group: str = "slice") -> DataFrame:
    """Per group: items, those that a calibration run has, those with a p, and both shares."""
    met = items.join(calibrated.select("item_id", "p", F.lit(1).alias("_hit")), "item_id", "left")
    agg = met.groupBy(group).agg(F.count("*").alias("n"), F.count("_hit").alias("joined"), F.count("p").alias("calibrated"))
    return agg.withColumns({"missing": F.col("n") - F.col("joined"), "calibrated_share": F.col("calibrated") / F.col("n")})


def split_mismatches(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """item_id, side: items whose part (item_id, part) is stored but not computed so, or computed but not stored so."""
    a, b = stored.select("item_id", "part"), computed.select("item_id", "part")
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("computed")))


def holdout_metrics(rows: DataFrame, methods: list[str]) -> DataFrame:
    """Per method: n, right and wrong items, auroc, auprc, normalized aurc and risk at half coverage; undefined ones null."""
    long = unpivot(rows.where("correct is not null"), ["ord", "correct"], methods).where("not isnan(u) and abs(u) < double('inf')")
    by = ["method"]
    out = long.groupBy(*by).agg(F.count("*").alias("n"), F.sum("correct").cast("long").alias("right"), F.sum(1 - F.col("correct")).cast("long").alias("wrong"))
    for part in (ranking.auroc(long, by).select("method", "auroc"), ranking.auprc(long, by), ranking.aurc(long, by).select("method", "norm"), ranking.risk_at(long, by, [0.5]).select("method", F.col("risk").alias("risk_at_half"))):
        out = out.join(part, by, "left")
    return out


def merge_rates(pairs: DataFrame, merge: list[str], tau: float, group: list[str]) -> DataFrame:
    """Per group: pairs, those whose merging labels' probabilities (columns) reach tau together, and their share."""
    merged = sum((F.col(c) for c in merge), F.lit(0.0)) >= tau
    agg = pairs.groupBy(*group).agg(F.count("*").alias("n"), F.sum(merged.cast("long")).alias("merged"))
    return agg.withColumn("merge_rate", F.col("merged") / F.col("n"))


def cluster_comparison(items: DataFrame) -> DataFrame:
    """Per slice of items (slice, correct, exact_all_same, typed_all_same): how unanimous items differ by the two clusterings."""
    exact, typed = F.col("exact_all_same") == 1, F.col("typed_all_same") == 1
    count = lambda c: F.sum(c.cast("long"))
    rate = lambda c: F.avg(F.when(c, F.col("correct").cast("double")))
    return items.groupBy("slice").agg(
        F.count("*").alias("n"), count(exact).alias("exact_n"), count(typed).alias("typed_n"), rate(exact).alias("exact_accuracy"), rate(typed).alias("typed_accuracy"),
        count(exact & ~typed).alias("left"), count(exact & ~typed & (F.col("correct") == 0)).alias("rescued"),
    )


def screen(items: DataFrame, samples: DataFrame, violations: DataFrame, slice_: str, cap: int, strata: int) -> DataFrame:
    """Yield by topic of a slice's capped candidate items; an error if any item of the whole set breaks the contract."""
    broken = violations.limit(1).collect()
    if broken:
        raise ValueError(f"{broken[0]['key']}: {broken[0]['rule']}")
    kept = stratified_cap(items.where(F.col("slice") == slice_), "topic", "item_id", cap, strata)
    return yields(samples.join(kept.select("item_id", "topic"), "item_id"), ["topic"])


def pilot_report(items: DataFrame, samples: DataFrame, unresolved: tuple[str, ...]) -> DataFrame:
    """Per slice of items (item_id, slice, correct, error): outcomes of those without an error, errors, coverage by item and sample."""
    fine = items.where("error is null")
    out = slice_outcomes(fine).join(items.groupBy("slice").agg(F.count("error").alias("errors")), "slice")
    said = samples.join(fine.select("item_id", "slice"), "item_id").groupBy("slice").agg(F.count("*").alias("n_samples"), F.sum((~F.col("verdict").isin(*unresolved)).cast("long")).alias("n_samples_resolved"))
    out = out.join(said, "slice", "left")
    return out.withColumns({"item_coverage": F.try_divide("resolved", "n"), "sample_coverage": F.try_divide("n_samples_resolved", "n_samples")})


def typed_separation(items: DataFrame) -> DataFrame:
    """Per slice, and pooled, of items (slice, correct, exact_all_same, typed_all_same, typed_entropy): how right unanimous items are by either clustering.

    n_unanimous, and auroc of the typed entropy, among those that exact keys call unanimous (null with one class); the gap in
    accuracy between unanimous items and others by each clustering, and by how much the typed one's is smaller.
    """
    every = items.unionByName(items.withColumn("slice", F.lit("pooled")))
    alike = every.where("exact_all_same = 1").withColumn("u", F.col("typed_entropy"))
    area = ranking.auroc(alike, ["slice"]).select("slice", F.col("n").alias("n_unanimous"), "auroc")
    rate = lambda c: F.avg(F.when(c, F.col("correct").cast("double")))
    gap = lambda c: rate(F.col(c) == 1) - rate(F.col(c) == 0)
    gaps = every.groupBy("slice").agg(gap("exact_all_same").alias("exact_gap"), gap("typed_all_same").alias("typed_gap"))
    return gaps.withColumn("narrowed", F.abs("exact_gap") - F.abs("typed_gap")).join(area, "slice", "left")
