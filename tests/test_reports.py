"""Cells, strata and gates against plain loops and by cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordia.operators import bootstrap, calibration, cells, evaluation, fits, ranking, records, relations, strata, validity, warrant
from accordia.operators.lineage import Blindness
from accordia.plans.reports import QUERIES

SMALL = "/root/testdata/sf0.001"
ITEM = "slice string, ord long, correct int, harm string, u double, v double, p_true double"


def cell_rows(spark, rows, slices=("a", "b"), methods=("u", "v", "p_true", "x")):
    found = cells.score_cells(spark.createDataFrame(rows, ITEM), list(slices), list(methods), ("x",))
    return {(r["slice"], r["method"]): r for r in found.collect()}


def test_reasons_of_undefined_cells(spark):
    good = [("a", i, i % 2, "both", i / 10, 0.3, None) for i in range(10)]
    one = [("b", i, 1, None if i == 3 else "custodial", i / 10, 1.5 * i, None) for i in range(6)]
    got = cell_rows(spark, good + one, ("a", "b", "gone"))
    fine = got["a", "u"]
    assert all(fine[c] is None for c in ("reason", "rank_reason", "unit_reason", "harm_reason", "aurc_reason")) and fine["auroc"] is not None and fine["harm_weighted_risk"] is not None
    flat = got["a", "v"]
    assert flat["rank_reason"] == "constant_score" and flat["auroc"] is None and flat["selective_risk"] is None and flat["brier"] is not None and flat["base_error_rate"] == 0.5
    assert got["a", "p_true"]["reason"] == "logprobs_absent" and got["a", "x"]["reason"] == "method_not_implemented"
    single = got["b", "u"]
    assert single["rank_reason"] == single["unit_reason"] == single["harm_reason"] == "single_correctness_class" and single["confident_wrong"] == 0 and single["brier"] is None
    assert got["b", "v"]["unit_reason"] == "score_outside_unit_interval" and got["b", "v"]["rank_reason"] == "single_correctness_class"
    assert got["gone", "u"]["n_items"] == 0 and got["gone", "u"]["reason"] == "no_items_with_a_score_and_a_label" and len(got) == 12
    no_harm = cell_rows(spark, [(*r[:3], None if r[1] == 4 else r[3], *r[4:]) for r in good])["a", "u"]
    assert no_harm["harm_reason"] == "harm_class_absent" and no_harm["harm_weighted_risk"] is None and no_harm["brier"] is not None
    unknown = cell_rows(spark, [(*r[:2], None if r[1] > 6 else r[2], *r[3:]) for r in good])["a", "u"]
    assert (unknown["n_items"], unknown["n_scored"], unknown["n_correct"], unknown["n_incorrect"]) == (10, 7, 3, 4)
    # The trivial order is the best one: no skill is left to measure.
    worst = cell_rows(spark, [("a", 0, 0, "both", 0.1, 0.0, None), ("a", 1, 1, "both", 0.2, 0.0, None)])["a", "u"]
    assert worst["auroc"] == 0.0 and worst["normalized_aurc"] is not None


def test_cells_against_loops(spark):
    draw = random.Random(3)
    weight = {"custodial": 5.0, "both": 3.0, "definition": 1.5, "procedural": 1.0}
    rows = [("a", i, draw.randint(0, 1), draw.choice([*weight]), draw.randint(0, 20) / 20, draw.random(), None) for i in range(101)]
    r = cell_rows(spark, rows)["a", "u"]
    u, y, w = [x[4] for x in rows], [x[2] for x in rows], [weight[x[3]] for x in rows]
    n, wrong = len(rows), 101 - sum(y)
    pairs = [(a, b) for a, c in zip(u, y) if c for b, e in zip(u, y) if not e]
    assert r["auroc"] == pytest.approx(sum((a < b) + (a == b) / 2 for a, b in pairs) / len(pairs))
    order = sorted(range(n), key=lambda i: (u[i], i))
    risk = np.cumsum([1 - y[i] for i in order]) / np.arange(1, n + 1)
    assert r["selective_risk"] == pytest.approx(float(np.interp(0.5, np.arange(1, n + 1) / n, risk)))
    best = np.maximum(np.arange(1, n + 1) - sum(y), 0) / np.arange(1, n + 1)
    assert r["normalized_aurc"] == pytest.approx((wrong / n - risk.mean()) / (wrong / n - best.mean()))
    worst = sorted(range(n), key=lambda i: (-u[i], i))
    hits = np.cumsum([1 - y[i] for i in worst])
    assert r["auprc"] == pytest.approx(sum(hits[k] / (k + 1) for k, i in enumerate(worst) if not y[i]) / wrong)
    for bins, name in ((5, "ace_5bin"), (10, "ece_10bin")):
        total = 0
        for b in range(bins):
            at = [i for i in range(n) if (1 - u[i] > b / bins or b == 0) and 1 - u[i] <= (b + 1) / bins + 1e-12 and math.ceil(round((1 - u[i]) * bins, 9)) in ((b + 1), 0 if b == 0 else b + 1)]
            total += abs(sum(y[i] - (1 - u[i]) for i in at))
        assert r[name] == pytest.approx(total / n, abs=0.05)
    taken = sorted(range(n), key=lambda i: (-(1 - u[i]), i))[: math.ceil(0.5 * n)]
    assert r["harm_weighted_risk"] == pytest.approx(sum(w[i] * (1 - y[i]) for i in taken) / sum(w[i] for i in taken))
    cut = np.quantile(u, 0.25)
    assert r["cut"] == pytest.approx(cut) and r["confident_wrong"] == sum(1 - y[i] for i in range(n) if u[i] <= cut)


def test_pooling_needs_every_slice(spark):
    df = spark.createDataFrame([("a", i, i % 2, "both", i / 10, 0.5, None) for i in range(8)], ITEM)
    with pytest.raises(ValueError):
        cells.pooled_reference(df, ["a", "b"], ["u"])
    got = {r["method"]: r for r in cells.pooled_reference(df, ["a"], ["u", "v", "p_true"]).collect()}
    assert got["v"]["auroc"] == 0.5 and got["v"]["reason"] is None and got["p_true"]["reason"] == "no_items_with_a_score_and_a_label"
    same = cells.pooled_reference(df.withColumn("correct", F.lit(1)), ["a"], ["u"]).first()
    assert same["auroc"] is None and same["reason"] == "single_correctness_class" and same["n_scored"] == 8


@pytest.mark.parametrize("change, status", [({}, "MET"), ({"right": 0}, "NOT_MET"), ({"item_coverage": None}, "NOT_MET"), ({"auroc": None, "rank_reason": "x"}, "NOT_MET"), ({"auroc": None, "rank_reason": None}, "NOT_MET"), ({"n_items": 0}, "NOT_EVALUABLE")])
def test_comparison_gate_by_condition(spark, change, status):
    cell = {"slice": "a", "n_items": 5, "auroc": 0.6, "rank_reason": None} | {k: v for k, v in change.items() if k in ("n_items", "auroc", "rank_reason")}
    judged = {"slice": "a", "item_coverage": 1.0, "right": 2, "wrong": 3} | {k: v for k, v in change.items() if k in ("item_coverage", "right")}
    c = spark.createDataFrame([(m, *cell.values()) for m in ("own", "base")], "method string, slice string, n_items long, auroc double, rank_reason string")
    j = spark.createDataFrame([tuple(judged.values())], "slice string, item_coverage double, right long, wrong long")
    got = cells.comparison_gate(c, j, ["own"], ["base"]).first()
    assert got["status"] == status
    if "rank_reason" in change:
        assert got["undefined_stated"] == (change["rank_reason"] is not None) and not got["comparison_computable"]


def row(spark, columns):
    return spark.range(1).select(*columns).first()


def test_scalar_gates(spark):
    lit = lambda x: F.lit(x).cast("double")
    for case, want in (
        ((0.9, 0.6, 0.9, 0.3, 0.1, 0.2), "PASS"), ((0.9, 0.5, 0.9, 0.3, 0.1, 0.2), "FAIL"), ((0.9, 0.6, 0.9, 0.1, 0.1, 0.2), "FAIL"), ((0.9, 0.6, 0.9, 0.2, 0.1, 0.2), "PASS"),
        ((0.9, 0.6, 0.9, 0.3, 0.2, 0.2), "FAIL"), ((None, 0.6, 0.9, 0.3, 0.1, 0.2), "FAIL"), ((0.9, 0.6, 0.5, 0.3, 0.1, 0.2), "FAIL"), ((0.9, 0.6, 0.9, None, 0.1, 0.2), "FAIL"), ((0.9, 0.6, 0.9, 0.3, None, 0.2), "FAIL"),
    ):
        assert row(spark, [cells.separation_gate(*map(lit, case))[3].alias("v")])["v"] == want, case
    gate = lambda auroc, acc, n, cacc, gaps, here, there: tuple(row(spark, [c.alias(f"c{i}") for i, c in enumerate(cells.premise_gate(lit(auroc), lit(acc), F.lit(n), lit(cacc), F.lit(gaps), tuple(map(lit, here)), tuple(map(lit, there))))]))
    apart, near = ((0.8, 0.7, 0.9), (0.2, 0.1, 0.3)), ((0.8, 0.2, 0.9), (0.2, 0.1, 0.3))
    assert gate(0.7, 0.4, 0, None, 0, *apart) == (True, True, True)
    assert gate(0.71, 0.4, 0, None, 3, *apart) == (False, True, False)
    assert gate(0.6, 0.4, 0, None, 0, *near) == (True, False, False) and gate(0.6, 0.4, 0, None, 1, *near) == (True, False, True)
    assert gate(None, 0.0, 10, 0.2, 0, *apart) == (True, True, True) and gate(None, 0.0, 9, 0.2, 1, *apart) == (False, True, False)
    assert gate(None, 0.0, 10, None, 0, (None,) * 3, (None,) * 3) == (False, False, False)
    status = lambda low, high: row(spark, [calibration.gate_stability(lit(low), lit(high), F.lit(0.5)).alias("v")])["v"]
    assert (status(0.1, 0.4), status(0.6, 0.9), status(0.4, 0.6), status(0.5, 0.6), status(None, 0.4)) == ("stable_pass", "stable_fail", "indeterminate", "indeterminate", "not_computed")


@pytest.mark.parametrize("target, control, resolved, want", [(0.1, 0.9, 1.0, "PASS"), (0.1, 0.9, 0.8, "FAIL"), (0.1, 0.1, 1.0, "FAIL"), (0.9, 1.0, 1.0, "WARN"), (0.5, 0.55, 1.0, "WARN"), (None, 0.9, 1.0, "PASS")])
def test_pilot_verdicts(spark, target, control, resolved, want):
    rows = [(s, f"{s}{k}", int(k < 20 * share), "x" if j < 10 * resolved else "unresolved") for s, share in (("t", target), ("c", control)) if share is not None for k in range(20) for j in range(10)]
    got = cells.pilot_verdict(spark.createDataFrame(rows, "slice string, item_id string, correct int, verdict string"), ("unresolved",), "t", "c").first()
    assert got["verdict"] == want


# Strata
def stratum_rows(n, seed, share=0.6, stratum="s"):
    draw = random.Random(seed)
    return [(stratum, i % 5, f"{stratum}{i}", round(draw.random(), 3), int(draw.random() < share)) for i in range(n)]


DEVELOPMENT = "stratum string, fold int, item_id string, x double, correct int"


def test_status_and_metrics_of_strata(spark):
    rows = stratum_rows(60, 1, stratum="large") + stratum_rows(30, 2, stratum="small") + stratum_rows(9, 3, stratum="few") + [(*r[:4], 1) for r in stratum_rows(20, 4, stratum="one")]
    rows += [("none", 0, "n", None, 1), ("large", 0, "nan", float("nan"), 1), ("large", 1, "null", None, 0)]
    table, p = strata.fit_strata(spark.createDataFrame(rows, DEVELOPMENT).repartition(3))
    got = {r["stratum"]: r for r in table.collect()}
    assert {s: (r["status"], r["method"]) for s, r in got.items()} == {"large": ("fitted", "isotonic"), "small": ("fitted", "platt"), "few": ("insufficient_development_records", None), "one": ("single_class_in_development", None), "none": ("no_scored_records", None)}
    assert (got["large"]["n_development"], got["large"]["n_scored"]) == (62, 60) and got["one"]["n_cross_fitted"] is None and got["large"]["other_ace_5bin"] is not None
    predicted = {r["item_id"]: r["p"] for r in p.collect()}
    for s, n in (("large", 60), ("small", 30)):
        own = [r for r in rows if r[0] == s and r[3] is not None and r[3] == r[3]]
        for fold in range(5):
            x, y = (np.array(c, float) for c in zip(*[(r[3], r[4]) for r in own if r[1] != fold]))
            for r in own:
                if r[1] == fold:
                    if s == "large":
                        want = float(fits.interpolate(np.array([r[3]]), *fits.pool_adjacent(x, y))[0])
                    else:
                        a, b = fits.platt(x, y)
                        want = 1 / (1 + math.exp(-(a * r[3] + b)))
                    assert predicted[r[2]] == pytest.approx(want), (s, r)
        brier = sum((predicted[r[2]] - r[4]) ** 2 for r in own) / n
        assert got[s]["brier"] == pytest.approx(brier) and got[s]["n_cross_fitted"] == n


def test_probabilities_are_attached_by_status(spark):
    dev = spark.createDataFrame(stratum_rows(60, 1, stratum="large") + stratum_rows(30, 2, stratum="small") + stratum_rows(5, 3, stratum="few"), DEVELOPMENT)
    rows = spark.createDataFrame([(1, "large", 0.4), (2, "large", None), (3, "few", 0.4), (4, "gone", 0.2), (5, "small", 0.9), (6, "small", float("inf"))], "item_id long, stratum string, x double")
    got = {r["item_id"]: (r["calibration_status"], r["p"]) for r in strata.attach_probabilities(rows, dev).collect()}
    assert {i: s for i, (s, _) in got.items()} == {1: "calibrated", 2: "no_score", 3: "undefined_stratum_not_calibrated", 4: "undefined_stratum_not_calibrated", 5: "calibrated", 6: "no_score"}
    x, y = (np.array(c, float) for c in zip(*[(r[3], r[4]) for r in stratum_rows(60, 1, stratum="large")]))
    assert got[1][1] == pytest.approx(float(fits.interpolate(np.array([0.4]), *fits.pool_adjacent(x, y))[0])) and got[2][1] is None and 0 < got[5][1] < 1


def test_coverage_of_the_conformal_threshold(spark):
    dev = spark.createDataFrame([("s", i, i / 20) for i in range(1, 20)] + [("t", 1, 0.5)], "stratum string, ord long, p double")
    held = spark.createDataFrame([("s", i, i / 10) for i in range(1, 11)] + [("t", 1, 0.5), ("u", 1, 0.5), ("s", 99, None)], "stratum string, ord long, p double")
    got = {r["stratum"]: r for r in strata.coverage_report(held, dev).collect()}
    assert got["s"]["threshold"] == 4 / 20 and got["s"]["covered"] == 9 and got["s"]["within_tolerance"] and got["s"]["n"] == 10
    assert got["t"]["threshold_status"] == "undefined" and got["t"]["coverage"] is None and got["u"]["threshold_status"] == "no_development_calibration_set"


@pytest.mark.parametrize(
    "change, want",
    [({}, "PASS"), ({"ace_5bin": 0.06}, "NOT_MET"), ({"n_cross_fitted": 29}, "NOT_EVALUABLE"), ({"risk": 0.3}, "NOT_MET"), ({"within_tolerance": False}, "NOT_MET"), ({"within_tolerance": None}, "NOT_EVALUABLE"),
     ({"both_classes": False, "status": "not_evaluable_single_class_holdout"}, "NOT_EVALUABLE"), ({"blind": False}, "NOT_MET"), ({"blind": None}, "NOT_EVALUABLE"), ({"ace_5bin": 0.05}, "PASS")],
)
def test_calibration_gate_by_condition(spark, change, want):
    v = {"ace_5bin": 0.01, "n_cross_fitted": 30, "risk": 0.2, "risk_sample_only": 0.3, "within_tolerance": True, "both_classes": True, "status": "evaluated"} | change
    fitted = spark.createDataFrame([("s", v["ace_5bin"], v["n_cross_fitted"])], "stratum string, ace_5bin double, n_cross_fitted long")
    done = spark.createDataFrame([("s", v["risk"], v["risk_sample_only"], v["within_tolerance"], v["both_classes"], v["status"])], "stratum string, risk double, risk_sample_only double, within_tolerance boolean, both_classes boolean, status string")
    checked = v.get("blind", True)
    assert strata.gate(fitted, done, None if checked is None else Blindness(checked, {})).first()["verdict"] == want


def test_candidates_of_a_stratum(spark):
    rows = spark.createDataFrame([("s", r[1], r[2], r[3], r[4]) for r in stratum_rows(50, 7)], "g string, fold int, item_id string, x double, correct int")
    got = {r["candidate"]: r for r in strata.candidates(rows, 5, ["g"]).collect()}
    made = stratum_rows(50, 7)
    assert got.keys() == {"raw", "constant", "platt", "isotonic"} and {r["n"] for r in got.values()} == {50}
    assert got["raw"]["brier"] == pytest.approx(sum((r[3] - r[4]) ** 2 for r in made) / 50)
    share = {f: sum(r[4] for r in made if r[1] != f) / sum(r[1] != f for r in made) for f in range(5)}
    assert got["constant"]["brier"] == pytest.approx(sum((share[r[1]] - r[4]) ** 2 for r in made) / 50)
    pooled = strata.candidates(rows, 5, [])
    assert pooled.count() == 4 and pooled.where("candidate = 'raw'").first()["brier"] == pytest.approx(got["raw"]["brier"])


# Others
def test_statutes_are_loaded_whole_or_not_at_all(spark):
    made = [("k", 1, "IPC", "302", 0, 10), ("k", 2, "XYZ", " ", 10, 10), ("l", 1, None, "1", 5, None)]
    df = spark.createDataFrame(made, "key string, ord long, act string, section string, begin long, end long")
    assert validity.loaded(df.where("ord = 1 and act is not null"), ("IPC",)).count() == 1
    with pytest.raises(ValueError) as e:
        validity.loaded(df, ("IPC",))
    assert str(e.value) == "k 2: empty; k 2: missing section; k 2: unknown act; l 1: unknown act"


def test_clusters_numbers_and_effects(spark):
    s = spark.createDataFrame([(1, k, lab) for k, lab in enumerate("aabc")] + [(2, 0, "x")], "item_id long, pos int, label string")
    got = {r["item_id"]: r for r in relations.typed_stats(s).collect()}
    assert got[1]["counts"] == "2,1,1" and got[1]["entropy"] == pytest.approx(1.5) and got[2]["all_same"] == 1 and got[2]["entropy"] == 0
    exact = spark.createDataFrame([(1, 0.25, 2.0, 4), (2, 1.0, 0.0, 1)], "item_id long, top_share double, entropy double, n_keys long")
    effect = {r["item_id"]: r for r in relations.merge_effect(relations.typed_stats(s), exact).collect()}
    assert effect[1]["d_agreement"] == 0.25 and effect[1]["d_entropy"] == pytest.approx(-0.5) and effect[1]["d_n_clusters"] == -1 and effect[1]["collision_lost"] == 0


def test_baseline_labels(spark):
    rows = spark.createDataFrame([("A 1", "A 1", None), ("NONE", "NONE", None), ("A 1", "B 1", "successor_of"), ("A 1", "B 2", "different_offence"), ("A 1", "NONE", None), ("A 1", "B 1", "merged_into")], "a string, b string, link string")
    got = [r[0] for r in rows.select(relations.exact_key_label(F.col("a"), F.col("b"), F.col("link"))).collect()]
    assert got == ["SAME_PROVISION", "AMBIGUOUS", "LEGALLY_EQUIVALENT", "DIFFERENT_PROVISION", "AMBIGUOUS", "LEGALLY_EQUIVALENT"]


def test_intervals_of_replicates(spark):
    df = spark.createDataFrame([(i, i / 10 - 0.2) for i in range(11)] + [(99, None)], "seed long, value double")
    got = bootstrap.intervals(df, []).first()
    assert got["n"] == 11 and got["p_le_zero"] == pytest.approx(3 / 11) and got["low"] == pytest.approx(-0.175) and not got["excludes_zero"]
    assert bootstrap.intervals(df.withColumn("value", F.col("value") + 1), []).first()["excludes_zero"]


def test_bootstrap_query_summaries(spark):
    got = {r["what"]: r for r in QUERIES["bootstrap_ci"](spark, SMALL).collect()}
    assert len(got) >= 5 and all(r["low"] <= r["mean"] <= r["high"] and r["se"] > 0 for r in got.values())


def test_planning_by_group(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.0)], "g string, low double")
    got = {r["g"]: r["needed"] for r in fits.items_needed_by(df, "low", 5).collect()}
    assert got == {"a": fits.items_needed(0.5, 5), "b": None}


def test_scores_of_two_models_on_shared_items(spark):
    rows = [("a", 0.1, 0.9, 1), ("a", 0.8, 0.2, 0), ("a", 0.5, None, 0), ("b", 0.3, 0.1, 1)]
    got = {r["slice"]: r for r in ranking.within_slice(spark.createDataFrame(rows, "slice string, u double, v double, correct int"), "u", "v").collect()}
    assert (got["a"]["n"], got["a"]["first"], got["a"]["second"], got["a"]["difference"]) == (2, 1.0, 0.0, 1.0) and got["b"]["first"] is None and got["pooled"]["n"] == 3


def test_states_of_detectors(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.5,), (1.0,), (0.0,), (0.5,)], "x double")
    assert [r[0] for r in df.select(evaluation.detector_state(F.col("x"))).collect()] == ["missing", "invalid", "invalid", "silent", "fired", "partial"]


# Records
PAIR = "pair string, text_i string, text_j string, key_i string, key_j string, label string, split string, stratum string, verifier string, condition string, link string"
GOOD = {"pair": "p", "text_i": "a", "text_j": "b", "key_i": "A 1", "key_j": "A 1", "label": "SAME_PROVISION", "split": "train", "stratum": "S1", "verifier": "pending", "condition": None, "link": None}


@pytest.mark.parametrize(
    "change, want",
    [({}, []), ({"label": "X"}, ["unknown label"]), ({"label": None}, ["unknown label"]), ({"label": "TEMPORAL_MISMATCH"}, ["reserved label"]), ({"split": "all"}, ["unknown split"]), ({"stratum": None}, ["unknown stratum"]),
     ({"verifier": "me"}, ["unknown verifier"]), ({"text_i": " ", "text_j": None}, ["empty first text", "empty second text"]), ({"label": "CONDITIONALLY_EQUIVALENT"}, ["no condition"]), ({"condition": "era"}, ["needless condition"]),
     ({"label": "CONDITIONALLY_EQUIVALENT", "condition": "era"}, []), ({"label": "AMBIGUOUS"}, ["ambiguous equal keys"]), ({"label": "AMBIGUOUS", "key_i": "NONE", "key_j": "NONE"}, []), ({"pair": ""}, ["no pair id"])],
)
def test_rules_of_pairs(spark, change, want):
    df = spark.createDataFrame([tuple((GOOD | change).values())], PAIR)
    assert records.pair_violations(df, ("S1", "S2")).first()["broken"] == want


@pytest.mark.parametrize(
    "change, want",
    [({}, []), ({"key_j": "NONE"}, ["same without keys"]), ({"key_j": "B 1"}, ["same of different keys"]), ({"label": "LEGALLY_EQUIVALENT"}, ["equivalent of equal keys", "equivalent without a link"]),
     ({"label": "LEGALLY_EQUIVALENT", "key_j": "B 1", "link": "successor_of"}, []), ({"label": "CONDITIONALLY_EQUIVALENT"}, ["conditional without a condition"]), ({"label": "DIFFERENT_PROVISION"}, ["different of equal keys"]),
     ({"label": "DIFFERENT_PROVISION", "key_j": "B 1", "link": "merged_into"}, ["different but linked"]), ({"label": "DIFFERENT_PROVISION", "key_j": "B 1", "link": "different_offence"}, []), ({"label": "AMBIGUOUS"}, ["ambiguous of equal keys"]), ({"label": "CONTRADICTORY"}, [])],
)
def test_labels_are_entailed_by_keys(spark, change, want):
    assert records.structural(spark.createDataFrame([tuple((GOOD | change).values())], PAIR)).first()["broken"] == want


def test_documents_and_tables():
    assert records.document({"b": None, "a": "é"}) == '{\n  "a": "é",\n  "b": null\n}\n'
    with pytest.raises(ValueError):
        records.document({"x": float("nan")})
    assert records.markdown([{"a": 0.12345, "b": None}, {"a": float("nan"), "b": "x|y"}], ["a", "b"]) == "| a | b |\n|---|---|\n| 0.123 | - |\n| - | x\\|y |\n"


def test_json_tells_unknown_from_zero(spark):
    df = spark.createDataFrame([(1, None, 0.0), (2, 0.5, None)], "id long, a double, b double")
    made = records.to_json(df, ["a", "b"])
    assert [r["record"] for r in made.orderBy("id").collect()] == ['{"a":null,"b":0.0}', '{"a":0.5,"b":null}']
    assert sorted(map(tuple, records.from_json(made, "a double, b double").collect())) == [(1, None, 0.0), (2, 0.5, None)]


def test_banks_are_whole_and_repeatable(spark):
    one = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    make = lambda n: records.question_bank(one("topic", "abc"), one("frame", "xy"), one("context", "pq"), n, 3, ("L1", "L7"))
    got = make(12).collect()
    assert len(got) == 24 and len({r["item_id"] for r in got}) == 24 and len({(r["topic"], r["frame"], r["context"]) for r in got}) == 12
    assert {r["pair_id"] for r in make(5).collect()} <= {r["pair_id"] for r in got} and make(0).count() == 0


def test_checklists_round_trip(spark):
    s = spark.createDataFrame([("IPC 1", False), ("BNS 2(1)", True)], "statute string, verified boolean")
    assert {r["key"]: r["verified"] for r in records.checklist(s).collect()} == {"IPC 1": "", "BNS 2(1)": ""}
    assert sorted(map(tuple, records.apply_checklist(s, records.checklist(s)).collect())) == [("BNS 2(1)", True), ("IPC 1", False)]
    said = spark.createDataFrame([("ipc 1", "Y"), ("IPC 1", "no"), ("gone", "yes"), ("BNS 2(1)", None)], "key string, verified string")
    assert sorted(map(tuple, records.apply_checklist(s, said).collect())) == [("BNS 2(1)", True), ("IPC 1", True)]


# Detection
def test_sources_of_contradiction(spark):
    s = spark.createDataFrame([(1, p, k, lab) for p, (k, lab) in enumerate([("IPC 1", 0), ("IPC 1", 0), ("BNS 1", 1)])] + [(2, 0, "NONE", 0)] + [(3, 0, "IPC 1", 0)], "item_id long, pos int, key string, label int")
    statutes = spark.createDataFrame([("IPC 1", "1862-01-01", "2024-07-01"), ("BNS 1", "2024-07-01", None)], "statute string, begin string, end string").withColumns({c: F.col(c).cast("timestamp") for c in ("begin", "end")})
    none = spark.createDataFrame([], "`from` string, `to` string")
    links, day = spark.createDataFrame([("bns 1", "IPC  1")], "`from` string, `to` string"), F.lit("2020-01-01").cast("timestamp")
    run = lambda *a, **k: {r["item_id"]: r for r in warrant.detect(s, statutes, *a, **k).collect()}
    rule = run(links, day)
    assert rule[1]["k"] == pytest.approx(1 / 3) and rule[1]["cm"] == pytest.approx(2 / 3 - 2 / 3 * 2 / 3) and rule[1]["flags"] == ["contradiction"] and rule[1]["contradiction_source"] == "rule"
    assert rule[2]["modal_key"] == "NONE" and rule[2]["t"] is None and rule[2]["w"] is None and rule[2]["flags"] == ["unresolvable"]
    auto = run(none, day)
    assert auto[1]["k"] is None and auto[1]["contradiction_source"] == "no_signal" and auto[1]["cm"] is None and auto[3]["k"] == 0.0 and auto[3]["cm"] == 0.0
    assert run(links, day, source="none")[3]["contradiction_source"] == "none" and run(links, day, source="none")[3]["k"] is None
    model = spark.createDataFrame([(1, 0.25)], "item_id long, mass double")
    assert run(none, day, model_mass=model)[1]["k"] == 0.25 and run(links, day, source="model", model_mass=model)[1]["contradiction_source"] == "model"
    assert run(links, F.lit("2025-01-01").cast("timestamp"))[3]["flags"] == ["stale"]


def test_screens_refuse_broken_sets(spark):
    broken = spark.createDataFrame([("7", "missing source")], "key string, rule string")
    with pytest.raises(ValueError, match="7: missing source"):
        cells.screen(None, None, broken, "L7", 1, 1)


def test_metric_intervals_hold_their_means(spark):
    got = QUERIES["metric_intervals"](spark, SMALL).collect()
    assert {(r["metric"], r["unit"]) for r in got} == {("ace_5bin", "item"), ("ace_5bin", "topic"), ("brier", "item"), ("brier", "topic"), ("coverage", "item")}
    assert all(r["low"] <= r["mean"] <= r["high"] for r in got)
