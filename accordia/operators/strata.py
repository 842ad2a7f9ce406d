"""Calibration by stratum: fitting on a development part, evaluation on the held-out part, and the gate over both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordia.operators import calibration, fits, maps, ranking
from accordia.operators.lineage import Blindness
from accordia.operators.tables import written

ISOTONIC_LEAST, FIT_LEAST, STRATUM_LEAST = 40, 10, 30
TARGET, WALD_Z = 0.80, 1.96


def method_by_size(n: Column, least: int = ISOTONIC_LEAST) -> Column:
    return F.when(n >= least, "isotonic").otherwise("platt")


def usable(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def fit_status(rows: DataFrame, least: int = FIT_LEAST, isotonic: int = ISOTONIC_LEAST) -> DataFrame:
    """Per stratum of development rows (stratum, x, correct): counts, status and the method that its size asks for."""
    ok = usable(F.col("x"))
    right = F.coalesce(F.sum(F.when(ok, F.col("correct"))), F.lit(0)).cast("long")
    agg = rows.groupBy("stratum").agg(F.count("*").alias("n_development"), F.count(F.when(ok, 1)).alias("n_scored"), right.alias("n_correct"))
    n = F.col("n_scored")
    status = F.when(n == 0, "no_scored_records").when((F.col("n_correct") == 0) | (F.col("n_correct") == n), "single_class_in_development").when(n < least, "insufficient_development_records").otherwise("fitted")
    return agg.withColumn("status", status).withColumn("method", F.when(F.col("status") == "fitted", method_by_size(n, isotonic)))


def _key(by: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in by])


def _predicted(rows: DataFrame, training: DataFrame, methods: tuple[str, ...], by: list[str]) -> DataFrame:
    """rows (by, x) with a column for each method: p by the maps of the same `by` columns, fitted on training (by, x, correct); null without a map."""
    out = rows.withColumn("_by", _key(by))
    named = _key(by).alias("stratum")
    for method in methods:
        if method == "isotonic":
            registry = maps.isotonic_registry(fits.isotonic_maps(training, by).select(named, "x", "y"))
        else:
            registry = maps.platt_registry(fits.platt_maps(training, by).select(named, "slope", "intercept"))
        out = maps.apply_maps(out, written(registry, "maps"), "_by", how="left").withColumnRenamed("p", method)
    return out.drop("_by")


def cross_fitted(rows: DataFrame, methods: tuple[str, ...], k: int) -> DataFrame:
    """rows (stratum, fold, x, correct, ...) with a column for each method: p from the map of the other folds, null where these have one class."""
    training = rows.select("stratum", "fold", "x", "correct").withColumn("_out", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("fold <> _out")
    return _predicted(rows.withColumn("_out", F.col("fold")), training.drop("fold"), methods, ["stratum", "_out"]).drop("_out")


def fit_strata(development: DataFrame, k: int = 5, least: int = FIT_LEAST, isotonic: int = ISOTONIC_LEAST) -> tuple[DataFrame, DataFrame]:
    """(a row a stratum: fit_status, and metrics of cross-fitted p by its method and, to compare, by the other; those p).

    development: stratum, fold, item_id, x, correct. Both maps are fitted once and predictions written, as one long table of
    which one aggregate takes all metrics.
    """
    development = written(development.select("stratum", "fold", "item_id", "x", "correct"), "development")
    status = fit_status(development, least, isotonic)
    fitted = development.where(usable(F.col("x"))).join(status.where("status = 'fitted'").select("stratum", F.col("method").alias("_method")), "stratum")
    met = cross_fitted(fitted, ("isotonic", "platt"), k)
    roles = F.array(*[F.struct(F.lit(role).alias("_role"), F.when((F.col("_method") == "isotonic") == own, F.col("isotonic")).otherwise(F.col("platt")).alias("p")) for role, own in (("own", True), ("other", False))])
    long = written(met.select("stratum", "fold", "item_id", "x", "correct", F.inline(roles)).where("p is not null"), "predictions")
    found = calibration.all_scores(long, ["stratum", "_role"])
    own = found.where("_role = 'own'").select("stratum", F.col("n").alias("n_cross_fitted"), "brier", "log_loss", "ace_5bin", "ece_10bin")
    other = found.where("_role = 'other'").select("stratum", F.col("ace_5bin").alias("other_ace_5bin"))
    return status.join(own, "stratum", "left").join(other, "stratum", "left"), long.where("_role = 'own'").drop("_role")


def attach_probabilities(rows: DataFrame, development: DataFrame, least: int = FIT_LEAST, isotonic: int = ISOTONIC_LEAST) -> DataFrame:
    """rows (stratum, x, ...) with p by their stratum's map and calibration_status; labels of rows are not read."""
    status = fit_status(development, least, isotonic).where("status = 'fitted'").select("stratum", F.col("method").alias("_method"))
    named = rows.join(status, "stratum", "left")
    state = F.when(F.col("_method").isNull(), "undefined_stratum_not_calibrated").when(~usable(F.col("x")), "no_score").otherwise("calibrated")
    named = named.withColumn("calibration_status", state)
    ready = named.where("calibration_status = 'calibrated'")
    training = development.where(usable(F.col("x"))).select("stratum", "x", "correct").join(status, "stratum")
    met = _predicted(ready, training, ("isotonic", "platt"), ["stratum"])
    met = met.withColumn("p", F.when(F.col("_method") == "isotonic", F.col("isotonic")).otherwise(F.col("platt"))).drop("isotonic", "platt")
    return named.where("calibration_status <> 'calibrated'").withColumn("p", F.lit(None).cast("double")).unionByName(met).drop("_method")


def coverage_report(holdout: DataFrame, development: DataFrame, target: float = TARGET) -> DataFrame:
    """Per stratum of holdout rows with a p: the conformal threshold of development p, and how many held-out p reach it."""
    threshold = calibration.conformal_threshold(development, ["stratum"], target).select("stratum", F.col("n").alias("n_calibration"), "threshold")
    met = holdout.where("p is not null").join(threshold, "stratum", "left")
    agg = met.groupBy("stratum").agg(F.first("n_calibration").alias("n_calibration"), F.first("threshold").alias("threshold"), F.count("*").alias("n"), F.sum((F.col("p") >= F.col("threshold")).cast("long")).alias("covered"))
    tolerance = F.lit(WALD_Z) * F.sqrt(F.lit(max(target * (1 - target), 0.0)) / F.col("n"))
    status = F.when(F.col("n_calibration").isNull(), "no_development_calibration_set").when(F.col("threshold").isNull(), "undefined").otherwise("defined")
    out = agg.withColumns({"coverage": F.col("covered") / F.col("n"), "tolerance": tolerance, "threshold_status": status})
    return out.withColumn("within_tolerance", F.col("coverage") >= F.lit(target) - F.col("tolerance"))


def evaluate(holdout: DataFrame, development: DataFrame, target: float = TARGET) -> DataFrame:
    """Per stratum: counts and status, calibration metrics, harm-weighted risk at half coverage by p and by both baselines, coverage, actions.

    holdout: stratum, ord, p (null if not calibrated), correct, harm, raw and sample_only (baseline reliabilities; null is 0).
    """
    holdout, development = written(holdout, "holdout"), written(development, "development")
    scored = holdout.where("p is not null")
    by = ["stratum"]
    right = F.sum(F.when(F.col("p").isNotNull(), F.col("correct")))
    out = holdout.groupBy(*by).agg(F.count("*").alias("n_holdout"), F.count("p").alias("n_scored"), F.coalesce(right, F.lit(0)).cast("long").alias("n_correct"))
    n, r = F.col("n_scored"), F.col("n_correct")
    status = F.when((r == 0) | (r == n), "not_evaluable_single_class_holdout").otherwise("evaluated")
    out = out.withColumn("status", F.when(n == 0, "not_evaluable_no_calibrated_scores").otherwise(status)).withColumn("both_classes", (r > 0) & (r < n))
    out = out.join(calibration.all_scores(scored, by).drop("n"), by, "left")
    # The three scores are ranked together, as methods of one long table.
    long = scored.withColumn("raw", F.coalesce("raw", F.lit(0.0))).withColumn("sample_only", F.coalesce("sample_only", F.lit(0.0))).select("stratum", "ord", "correct", "harm", F.col("p").alias("own"), "raw", "sample_only")
    ranked = calibration.selective_risk(long.unpivot(["stratum", "ord", "correct", "harm"], ["own", "raw", "sample_only"], "_method", "p"), ["stratum", "_method"], [0.5])
    out = out.join(ranked.groupBy("stratum").agg(*[F.max(F.when(F.col("_method") == m, F.col("risk"))).alias(name) for name, m in (("risk", "own"), ("risk_raw", "raw"), ("risk_sample_only", "sample_only"))]), by, "left")
    covered = coverage_report(holdout, development, target).select("stratum", "threshold_status", "coverage", "within_tolerance")
    acted = scored.select("stratum", calibration.decide(F.col("p"), F.col("harm"), F.lit(False))[0].alias("action")).groupBy("stratum")
    actions = acted.agg(*[F.count(F.when(F.col("action") == a, 1)).alias(a) for a in ("answer", "verify", "abstain")])
    return out.join(covered, by, "left").join(actions, by, "left")


def gate(strata: DataFrame, evaluated: DataFrame, blindness: Blindness | None, most_error: float = 0.05, least: int = STRATUM_LEAST) -> DataFrame:
    """One row: four conditions, each null where no stratum can be judged by it, and the verdict.

    calibration: cross-fitted error at most most_error in every stratum of `least` rows or more; selective risk under the
    sample-only baseline's in every held-out stratum of both classes; coverage within its tolerance; no labels read, as
    lineage.blind found of the scoring (None: not checked, hence null). NOT_MET if one fails, NOT_EVALUABLE if one is null or a held-out stratum cannot be evaluated, else PASS.
    """
    met = evaluated.join(strata.select("stratum", F.col("ace_5bin").alias("_error"), F.col("n_cross_fitted").alias("_n")), "stratum", "left")
    one = F.when(F.col("_error").isNotNull() & (F.col("_n") >= least), F.col("_error") <= most_error)
    two = F.when(F.col("both_classes"), F.coalesce(F.col("risk") < F.col("risk_sample_only"), F.lit(False)))
    found = met.agg(
        F.bool_and(one).alias("calibration"), F.bool_and(two).alias("selective_risk"), F.bool_and("within_tolerance").alias("coverage"), F.lit(blindness.holds if blindness else None).cast("boolean").alias("label_blind"),
        F.sum(F.col("status").startswith("not_evaluable").cast("long")).alias("unevaluable"),
    )
    names = ("calibration", "selective_risk", "coverage", "label_blind")
    failed = F.lit(False)
    undefined = F.coalesce(F.col("unevaluable"), F.lit(0)) > 0
    for c in names:
        failed = failed | F.coalesce(~F.col(c), F.lit(False))
        undefined = undefined | F.col(c).isNull()
    return found.withColumn("verdict", F.when(failed, "NOT_MET").when(undefined, "NOT_EVALUABLE").otherwise("PASS"))


def candidates(rows: DataFrame, k: int, by: list[str]) -> DataFrame:
    """by, candidate, n, brier, log_loss, ace_5bin of the raw score, the others' accuracy, and cross-fitted maps of both kinds.

    rows: by, fold, item_id, x (a reliability), correct. All candidates are measured on the rows that every one has.
    """
    keyed = rows.withColumn("stratum", F.concat_ws("|", *[F.col(c).cast("string") for c in by]) if by else F.lit("pooled"))
    keyed = written(keyed.where(usable(F.col("x"))).select("stratum", *by, "fold", "item_id", F.least(F.greatest(F.col("x"), F.lit(0.0)), F.lit(1.0)).alias("x"), "correct"), "keyed")
    folds = keyed.groupBy("stratum", "fold").agg(F.sum("correct").alias("_r"), F.count("*").alias("_c"))
    total = keyed.groupBy("stratum").agg(F.sum("correct").alias("_all_right"), F.count("*").alias("_all"))
    constant = folds.join(total, "stratum").select("stratum", "fold", F.try_divide(F.col("_all_right") - F.col("_r"), F.col("_all") - F.col("_c")).alias("constant"))
    wide = cross_fitted(keyed, ("platt", "isotonic"), k).join(constant, ["stratum", "fold"]).where("platt is not null and isotonic is not null")
    long = wide.where("constant is not null").withColumn("raw", F.col("x")).unpivot(["stratum", *by, "correct"], ["raw", "constant", "platt", "isotonic"], "candidate", "p")
    group = [*by, "candidate"]
    return calibration.all_scores(long, group).drop("ece_10bin")


def within_slice_arms(items: DataFrame, slice_: str, design: list[Column]) -> DataFrame:
    """arm (pooled, within), training_n, n, n_correct, auroc, brier: a risk score fitted on all development items, or on the slice's alone.

    items: slice, dev (boolean), correct, and what the design reads. Both arms score the same held-out items of the slice:
    those with a complete design and a label. Each is fitted anew, on errors; brier takes 1 - risk as the probability of being right.
    """
    ready = F.col("correct").isNotNull()
    for d in design:
        ready = ready & d.isNotNull()
    items = written(items.where(ready).withColumn("_wrong", 1 - F.col("correct")), "items")
    mine = F.col("slice") == slice_
    held, out = items.where(mine & ~F.col("dev")), None
    for arm, training in (("pooled", items.where("dev")), ("within", items.where(F.col("dev") & mine))):
        bias, weights = fits.fit_risk(training, design, "_wrong")
        z = F.lit(float(bias))
        for d, w in zip(design, weights.tolist(), strict=True):
            z = z + d * w
        u = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0))))
        one = held.select(F.lit(arm).alias("arm"), F.lit(training.count()).alias("training_n"), u.alias("u"), "correct")
        out = one if out is None else out.unionByName(one)
    area = ranking.auroc(out, ["arm", "training_n"])
    miss = (1 - F.col("u") - F.col("correct")) * (1 - F.col("u") - F.col("correct"))
    return area.join(out.groupBy(F.col("arm").alias("_arm")).agg(F.avg(miss).alias("brier")), F.col("arm") == F.col("_arm")).drop("_arm")
