import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from accordia.operators import agreement, bootstrap, calibration, evaluation, fits, ranking, relations, risk, validity, warrant
from accordia.sources import runs
from accordia.streaming.ingest import ingest


def scored(spark, u, correct, slice_="s"):
    return spark.createDataFrame([(slice_, i, float(x) if x is not None else None, c) for i, (x, c) in enumerate(zip(u, correct, strict=True))], "slice string, ord long, u double, correct int")


def value(df, name):
    return df.first()[name]


@pytest.mark.parametrize(
    ("u", "c", "want"),
    [([0.1, 0.2, 0.3, 0.9, 0.95], [1, 1, 1, 0, 0], 1.0), ([0.95, 0.9, 0.3, 0.2, 0.1], [1, 1, 1, 0, 0], 0.0), ([0.5] * 6, [1, 0] * 3, 0.5), ([0.1, 0.4, 0.6, 0.2], [1, 1, 0, 0], 0.75), ([0.1, 0.2], [1, 1], None)],
)
def test_auroc(spark, u, c, want):
    assert value(ranking.auroc(scored(spark, u, c), ["slice"]), "auroc") == want


def test_curves_on_random_rows_in_any_order(spark):
    draw = random.Random(2)
    u, c = [round(draw.uniform(-2, 3), 1) for _ in range(200)] + [None, float("nan")], [draw.randint(0, 1) for _ in range(202)]
    order = sorted((x, i, y) for i, (x, y) in enumerate(zip(u, c, strict=True)) if x is not None and x == x)
    risk_, errors = [], 0
    for k, (_, _, y) in enumerate(order, 1):
        errors += 1 - y
        risk_.append(errors / k)
    for df in (scored(spark, u, c), scored(spark, u, c).orderBy(F.desc("ord")).repartition(5)):
        got = [r["risk"] for r in ranking.curve(df, ["slice"]).orderBy("k").collect()]
        assert got == pytest.approx(risk_)
        assert value(ranking.aurc(df, ["slice"]), "aurc") == pytest.approx(sum(risk_) / len(risk_))
        pairs = [(a, b) for a, _, y in order if y for b, _, z in order if not z]
        want = sum((a < b) + (a == b) / 2 for a, b in pairs) / len(pairs)
        assert value(ranking.auroc(df, ["slice"]), "auroc") == pytest.approx(want)
        table = pd.DataFrame([(a, y) for a, _, y in order], columns=["u", "correct"])
        assert bootstrap.auroc(table, np.ones(len(table))) == pytest.approx(want)
        worst = sorted(order, key=lambda x: (-x[0], x[1]))
        hits = [sum(1 - y for _, _, y in worst[: k + 1]) for k in range(len(worst))]
        precision = sum(h / (k + 1) for k, (h, (_, _, y)) in enumerate(zip(hits, worst)) if not y) / hits[-1]
        assert value(ranking.auprc(df, ["slice"]), "auprc") == pytest.approx(precision)


def test_risk_coverage_by_hand(spark):
    got = ranking.curve(scored(spark, [0.1, 0.9, 0.2, 0.3], [1, 0, 1, 1]), ["slice"]).orderBy("k").collect()
    assert [r["risk"] for r in got] == [0, 0, 0, 0.25]


def test_degenerate_groups(spark):
    none = scored(spark, [], [])
    assert ranking.auroc(none, ["slice"]).count() == 0 and ranking.aurc(none, ["slice"]).count() == 0
    all_null = scored(spark, [None, None], [1, 0])
    assert ranking.auroc(all_null, ["slice"]).count() == 0
    right = scored(spark, [0.1], [1])
    assert value(ranking.aurc(right, ["slice"]), "norm") is None and value(ranking.auprc(right, ["slice"]), "auprc") is None
    assert value(ranking.kappa(right.withColumn("b", F.col("correct")), ["slice"], "correct", "b"), "kappa") is None


def test_bins_have_closed_upper_ends(spark):
    df = spark.createDataFrame([(k / 10,) for k in range(11)], "p double").select(calibration.bin_of(F.col("p"), 10).alias("b"))
    assert [r["b"] for r in df.collect()] == [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]


def test_unknown_harm_class_is_an_error(spark):
    df = spark.createDataFrame([("custodial",), (None,)], "h string")
    assert [r[0] for r in df.select(calibration.harm_weight(F.col("h"))).collect()] == [5.0, 5.0]
    with pytest.raises(Exception, match="no weight"):
        spark.createDataFrame([("fine",)], "h string").select(calibration.harm_weight(F.col("h"))).collect()


@pytest.mark.parametrize(
    ("p", "harm", "flag", "want"),
    [(0.99, "custodial", False, "answer"), (0.99, "custodial", True, "verify"), (0.95, "custodial", False, "verify"), (0.5, "custodial", False, "abstain"), (0.9, "procedural", False, "answer"), (None, "both", False, "verify"), (0.5, None, True, "abstain")],
)
def test_decisions(spark, p, harm, flag, want):
    df = spark.createDataFrame([(p, harm, flag)], "p double, harm string, flag boolean")
    assert df.select(calibration.decide(F.col("p"), F.col("harm"), F.col("flag"))[0]).first()[0] == want


def test_conformal_threshold_needs_enough_rows(spark):
    p = spark.createDataFrame([("a", i, i / 10) for i in range(10)] + [("b", 0, 0.5)], "slice string, ord long, p double")
    got = {r["slice"]: (r["index"], r["threshold"]) for r in calibration.conformal_threshold(p, ["slice"], 0.8).collect()}
    assert got == {"a": (9, 0.1), "b": (None, None)}


def test_isotonic_knots_are_at_left_edges():
    x, y = fits.pool_adjacent(np.array([0.1, 0.2, 0.3, 0.5, 0.9]), np.array([1.0, 0, 0, 1, 1]))
    assert x.tolist() == [0.1, 0.5, 0.9] and y.tolist() == pytest.approx([1 / 3, 1, 1])
    assert fits.interpolate(np.array([0.0, 0.3, 1.0]), x, y).tolist() == pytest.approx([1 / 3, 2 / 3, 1])


def test_isotonic_against_least_squares_on_random_rows():
    draw = np.random.default_rng(0)
    for _ in range(30):
        x, y = draw.integers(0, 8, 25) / 10, draw.integers(0, 2, 25).astype(float)
        kx, ky = fits.pool_adjacent(x, y)
        assert (np.diff(ky) > -1e-12).all()
        step = ky[np.searchsorted(kx, x, side="right") - 1]
        # Pooling fits at least as well as any other non-decreasing step function drawn at random.
        for _ in range(20):
            other = np.sort(draw.uniform(0, 1, 8))[(x * 10).astype(int)]
            assert ((y - step) ** 2).sum() <= ((y - other) ** 2).sum() + 1e-9


def test_platt_and_monotone_fits():
    draw = np.random.default_rng(0)
    x = draw.uniform(0, 1, 400)
    y = (draw.uniform(0, 1, 400) < x).astype(float)
    a, b = fits.platt(x, y)
    assert a > 2 and 1 / (1 + math.exp(-(a * 0.5 + b))) == pytest.approx(0.5, abs=0.1)
    assert fits.platt(x, 1 - y)[0] == 0.0
    bias, w = fits.monotone_logistic(np.stack([x, 1 - x], axis=1), y)
    assert w[0] > 0 and w[1] == 0


def test_greedy_clusters_follow_leaders(spark):
    df = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "a b c d"), (1, 2, "x"), (1, 3, "b c d e"), (2, 0, "")], "item_id long, pos int, text string")
    like = lambda a, b: len(set(a.split()) & set(b.split())) / max(1, len(set(a.split()) | set(b.split())))
    got = {(r["item_id"], r["pos"]): r["label"] for r in fits.greedy_clusters(df, like, 0.7).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (1, 3): 2, (2, 0): 0}


def test_typed_merges_and_refusals():
    same, apart = "LEGALLY_EQUIVALENT", "CONTRADICTORY"
    assert fits.merge_typed(["A 1", "A 1", "NONE"], {(0, 2): same}, {(0, 2): 0.9}, 0.5) == [0, 0, 0]
    assert fits.merge_typed(["A 1", "B 1", "NONE"], {(0, 1): apart, (0, 2): same, (1, 2): same}, {(0, 1): 1, (0, 2): 0.9, (1, 2): 0.8}, 0.5) == [0, 1, 0]
    assert fits.merge_typed(["A 1", "A 2"], {(0, 1): same}, {(0, 1): 0.4}, 0.5) == [0, 1]
    assert fits.merge_typed(["NONE", "NONE"], {}, {}, 0.5) == [0, 1] and fits.merge_typed([], {}, {}, 0.5) == []


def test_bounds_and_planning():
    assert fits.binomial_tail(2, 3, 0.5) == pytest.approx(0.5) and fits.exact_lower(0, 5) == pytest.approx(0, abs=1e-9) and fits.exact_lower(5, 5) == 1.0
    assert fits.binomial_tail(8, 10, fits.exact_lower(8, 10)) == pytest.approx(0.05, abs=1e-6)
    n = fits.items_needed(0.125, 20)
    assert fits.binomial_tail(20, n, 0.125) >= 0.95 > fits.binomial_tail(20, n - 1, 0.125) and fits.items_needed(0.0, 1) is None


def test_resampling_is_seeded(spark):
    rows = scored(spark, [i / 20 for i in range(20)], [int(i % 3 > 0) for i in range(20)])
    a, b = (sorted(map(tuple, bootstrap.replicates(x, bootstrap.auroc, ["u", "correct"], 20).collect())) for x in (rows, rows.repartition(3)))
    assert a == b and len({v for _, v in a}) > 5
    got = calibration.replicate_summary(bootstrap.replicates(rows, bootstrap.auroc, ["u", "correct"], 20), [])
    assert got.first()["n"] == 20


def area(rows):
    pairs = [(a, b) for a, y in rows if y for b, z in rows if not z]
    return sum((a < b) + (a == b) / 2 for a, b in pairs) / len(pairs) if pairs else None


def test_replicates_against_rows_written_out(spark):
    """Each replicate's weights, written out as repeated rows, give the statistic by plain loops."""
    draw = random.Random(4)
    made = [(draw.choice("ab"), f"t{draw.randrange(4)}", draw.randint(0, 5) / 5, draw.randint(0, 4) / 4, draw.randint(0, 1)) for _ in range(60)]
    rows = spark.createDataFrame(made, "slice string, topic string, u double, v double, correct int")

    def check(columns, unit, apart, want, statistic):
        table = bootstrap.cells(rows, [*columns, *(c for c in (unit, apart) if c and c not in columns)])
        got = {r["seed"]: r["value"] for r in bootstrap.replicates(rows, statistic, columns, 25, unit, apart).collect()}
        for seed in range(25):
            made_ = np.random.default_rng(seed)
            if unit:
                groups = sorted(table[unit].unique())
                times = made_.multinomial(len(groups), np.full(len(groups), 1 / len(groups)))
                weight = table["n"].to_numpy() * np.array([times[groups.index(g)] for g in table[unit]])
                assert times.sum() == len(groups)
            elif apart:
                weight = np.zeros(len(table), int)
                for s in sorted(table[apart].unique()):
                    at = (table[apart] == s).to_numpy()
                    weight[at] = made_.multinomial(table["n"][at].sum(), table["n"][at] / table["n"][at].sum())
            else:
                weight = made_.multinomial(60, table["n"] / 60)
            out = [r for r, w in zip(table.to_dict("records"), weight) for _ in range(w)]
            expected = want(out)
            assert got[seed] is None if expected is None else got[seed] == pytest.approx(expected)

    one = lambda out: area([(r["u"], r["correct"]) for r in out])
    check(["u", "correct"], None, None, one, bootstrap.auroc)
    check(["u", "correct"], "topic", None, one, bootstrap.auroc)
    check(["u", "v", "correct"], "topic", None, lambda out: one(out) - area([(r["v"], r["correct"]) for r in out]) if one(out) is not None else None, bootstrap.auroc_difference)
    side = lambda out, s: [r for r in out if r["slice"] == s]
    check(["slice", "u", "correct"], None, "slice", lambda out: one(side(out, "a")) - one(side(out, "b")), bootstrap.auroc_gap("a", "b"))
    check(["slice", "correct"], None, "slice", lambda out: np.mean([r["correct"] for r in side(out, "a")]) - np.mean([r["correct"] for r in side(out, "b")]), bootstrap.mean_gap("a", "b"))


def test_bootstrap_of_too_many_cells_and_of_none(spark, monkeypatch):
    rows = scored(spark, [i / 20 for i in range(20)], [i % 2 for i in range(20)])
    assert bootstrap.replicates(rows.limit(0), bootstrap.auroc, ["u", "correct"], 3).where("value is null").count() == 3
    with pytest.raises(ValueError):
        bootstrap.bounded(rows, 5)


def test_maps_of_counted_cells_equal_those_of_rows(spark):
    draw = random.Random(6)
    made = [(s, round(draw.random(), 2), int(draw.random() < 0.6)) for s in ("a", "b") for _ in range(400)]
    df = spark.createDataFrame(made, "stratum string, x double, correct int").repartition(4)
    knots, lines = fits.isotonic_maps(df, ["stratum"]).collect(), {r["stratum"]: r for r in fits.platt_maps(df, ["stratum"]).collect()}
    xs = spark.createDataFrame([("a", x / 50 - 0.1) for x in range(60)], "stratum string, x double")
    predicted = {r["x"]: r["p"] for r in calibration.map_predict(xs, fits.isotonic_maps(df, ["stratum"])).collect()}
    for s in ("a", "b"):
        x, y = (np.array(c, float) for c in zip(*[(x, y) for g, x, y in made if g == s]))
        kx, ky = fits.pool_adjacent(x, y)
        got = sorted((r["x"], r["y"]) for r in knots if r["stratum"] == s)
        assert [g[0] for g in got] == kx.tolist() and [g[1] for g in got] == pytest.approx(ky.tolist())
        assert (lines[s]["slope"], lines[s]["intercept"], lines[s]["n"]) == pytest.approx((*fits.platt(x, y), 400))
        if s == "a":
            assert len(predicted) == 60 and all(p == pytest.approx(float(fits.interpolate(np.array([x]), kx, ky)[0])) for x, p in predicted.items())


def test_lookups_of_a_hot_key_in_parts(spark):
    draw = random.Random(1)
    spans = [(k, b, b + draw.randint(0, 30) if draw.random() < 0.9 else None, i) for i, (k, b) in enumerate((draw.choice("hhhc"), draw.randint(-50, 400)) for _ in range(80))]
    days = [(i, draw.choice("hhhcx"), draw.randint(0, 300)) for i in range(300)]
    day = lambda c: F.timestamp_seconds(F.col(c) * 86400)
    iv = spark.createDataFrame(spans, "key string, begin long, end long, value long").withColumns({"begin": day("begin"), "end": day("end")})
    pr = spark.createDataFrame(days, "id long, key string, day long").withColumn("day", day("day"))
    got = sorted((r["id"], r["value"]) for r in validity.as_of(pr, iv, "key", "day").collect() if r["value"] is not None)
    want = sorted((i, v) for i, k, d in days for g, b, e, v in spans if g == k and b <= d and (e is None or d < e))
    assert got == want and validity.as_of(pr, iv, "key", "day").select("id").distinct().count() == 300
    assert validity.as_of(pr.limit(0), iv, "key", "day").count() == 0 and validity.as_of(pr, iv.limit(0), "key", "day").count() == 300


def test_interval_edges_and_unknown_keys(spark):
    statutes = spark.createDataFrame([("IPC 302", "1862-01-01", "2024-07-01"), ("BNS 103(1)", "2024-07-01", None), ("BNS 103(2)", "2024-07-01", None)], "statute string, begin string, end string").withColumns({c: F.col(c).cast("date") for c in ("begin", "end")})
    refs = spark.createDataFrame([("ipc  302", "2024-06-30"), ("IPC 302", "2024-07-01"), ("BNS 103", "2024-07-01"), ("IPC 302(a)", "2000-01-01"), ("X 1", "2024-07-01")], "key string, day string")
    got = validity.resolve(refs, statutes).select("key", "day", "statute", validity.in_force(F.col("day").cast("date"), F.col("begin"), F.col("end")).alias("ok")).collect()
    assert [(r["statute"], r["ok"]) for r in sorted(got, key=lambda r: (r["key"].lower(), r["day"]))] == [("BNS 103(1)", True), ("IPC 302", True), ("IPC 302", False), ("IPC 302", True), (None, None)]


def test_composition_is_null_with_any_null_factor(spark):
    df = spark.createDataFrame([(0.8, 1.0, 0.5, 0.25), (0.8, None, 1.0, 0.0)], "a double, t double, j double, k double")
    got = df.select(*[c.alias(n) for c, n in zip(warrant.compose(*map(F.col, "atjk")), ("w", "cm"), strict=True)], warrant.flags(*map(F.col, "tjk")).alias("f")).collect()
    assert got[0]["w"] == pytest.approx(0.3) and got[0]["cm"] == pytest.approx(0.5) and got[0]["f"] == ["foreign", "contradiction"]
    assert got[1]["w"] is None and got[1]["f"] == ["unresolvable"]


def test_features_never_impute(spark):
    rows = [(4, 1.0, 2.0, 0.5, -0.1, 0.0), (1, 0.0, 0.0, 0.5, 0.1, 0.0), (4, 1.0, float("nan"), None, 0.1, 2.0)]
    df = spark.createDataFrame(rows, "n_samples int, prov_se double, disc_se double, warranted double, common_mode double, contradiction double")
    got = risk.estimate(risk.features(df), 0.0, {("u_prov",): 1.0, ("u_prov", "u_cm"): 1.0}).collect()
    assert [r["mode"] for r in got] == ["sample_only_fallback", "unscorable", "sample_only_fallback"] and got[0]["u_cm"] is None and got[0]["u_text"] == 1.0
    assert got[2]["u_text"] is None and got[2]["u_contra"] is None and got[0]["score"] == 0.5


def test_hash_split_is_the_plain_one(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"7|p1").digest()[:8], "big") / 2**64
    assert spark.range(1).select(risk.hash_unit(7, F.lit("p1"))).first()[0] == want


def test_folds_keep_groups_whole(spark):
    df = spark.createDataFrame([(f"g{i % 5}",) for i in range(40)], "g string")
    got = risk.folds(df, F.col("g"), 9, 1).groupBy("g").agg(F.count_distinct("fold").alias("n"), F.max("fold").alias("f")).collect()
    assert all(r["n"] == 1 for r in got) and {r["f"] for r in got} == {0, 1, 2, 3, 4}


def test_threshold_ties_take_the_lower(spark):
    sweep = relations.threshold_sweep(spark.createDataFrame([(0.3, 0), (0.6, 1), (0.9, 1)], "score double, gold int"), [0.2, 0.4, 0.5, 0.8])
    assert relations.best_threshold(sweep).first()["tau"] == 0.4


def test_matrix_tells_why(spark):
    rows = spark.createDataFrame([("a", "m", i, 0.5, i % 2) for i in range(4)] + [("b", "m", i, i / 4, 1) for i in range(4)], "slice string, method string, ord long, u double, correct int")
    got = {(r["slice"], r["method"]): r["reason"] for r in evaluation.matrix(rows, ["a", "b", "c"], ["m", "x"]).collect()}
    assert got == {("a", "m"): "constant score", ("b", "m"): "single class", ("c", "m"): "no scores", ("a", "x"): "no scores", ("b", "x"): "no scores", ("c", "x"): "no scores"}


def test_states_and_gates(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (0.5,), (None,), (2.0,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(evaluation.detector_state(F.col("x"))).collect()] == ["silent", "fired", "partial", "missing", "invalid", "invalid"]
    gate = lambda *h: evaluation.gate(spark.createDataFrame([(str(i), x) for i, x in enumerate(h)], "name string, holds boolean")).first()["verdict"]
    assert (gate(True, True), gate(True, None), gate(None, False)) == ("PASS", "UNDETERMINED", "FAIL")


def test_agreement_by_hand(spark):
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate("bbaac")] + [(2, 0, "z")], "item_id long, pos int, key string")
    got = {r["item_id"]: r for r in agreement.profile(df).collect()}
    assert got[1]["majority"] == "a" and got[1]["entropy"] == pytest.approx(0.8 * math.log2(2.5) + 0.2 * math.log2(5)) and str(got[2]["entropy"]) == "0.0"


def test_runs_are_written_once_without_nan(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "item_id string, x double")
    runs.write_run(df, f"{tmp_path}/run", "json")
    assert sorted(map(tuple, runs.read_jsonl(spark, f"{tmp_path}/run", "item_id string, x double").collect())) == [("a", 1.0), ("b", None)]
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        runs.write_run(df, f"{tmp_path}/run", "json")
    with pytest.raises(Exception, match="not finite"):
        runs.write_run(spark.createDataFrame([(float("nan"),)], "x double"), f"{tmp_path}/other")
    first = runs.tree_hash(spark, f"{tmp_path}/run")
    assert first == runs.tree_hash(spark, f"{tmp_path}/run")
    (tmp_path / "t.txt").write_bytes(b"a\r\nb")
    (tmp_path / "u.txt").write_bytes(b"a\nb")
    assert len({r["sha256"] for r in runs.content_hash(spark, f"{tmp_path}/*.txt").collect()}) == 1


def test_overrides_never_unset(spark):
    rows = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "key string, verified boolean")
    over = spark.createDataFrame([("a", False), ("b", True), ("b", False), ("x", True)], "key string, verified boolean")
    out, lost = runs.override(rows, over, "key", "verified")
    assert dict(map(tuple, out.collect())) == {"a": True, "b": True, "c": False} and [r["key"] for r in lost.collect()] == ["x"]


def test_stream_adds_each_record_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n, text in enumerate(['{"item_id": "a", "x": 1}\n{"item_id": "a", "x": 2}\n', '{"item_id": "a", "x": 3}\n{"item_id": "b", "x": 4}\n']):
        (source / f"{n}.json").write_text(text)
        ingest(spark, str(source), "item_id string, x int", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    assert sorted(r["item_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]
