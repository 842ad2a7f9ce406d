"""Fits of groups that no task holds whole, maps as values, exact resampling: equal to the plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordia.operators import calibration, fits, maps


def labelled(seed, n, groups=("a", "b", None)):
    """x anywhere, right ones more likely above; stretches of equal means, and a narrow range with many scores."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        x = draw.choice([draw.random(), draw.random(), 0.9 + draw.random() / 1e4, draw.randrange(20) / 20, draw.uniform(-5, 5)])
        out.append((draw.choice(groups), x, int(draw.random() < min(1, max(0, x)))))
    return out


def plain(rows, g):
    x, y = (np.array(c, float) for c in zip(*[(r[1], r[2]) for r in rows if r[0] == g], strict=True))
    return fits.pool_adjacent(x, y)


@pytest.mark.parametrize("most", [1, 40, 500, 1 << 16])
def test_isotonic_maps_in_segments(spark, most):
    rows = labelled(1, 3000) + [("flat", i / 100, i % 2) for i in range(100)] + [("step", i / 100, int(i >= 50)) for i in range(100)] + [("down", i / 100, int(i < 50)) for i in range(100)] + [("one", 0.5, 1)] * 3
    got = fits.isotonic_maps(spark.createDataFrame(rows, "g string, x double, correct int"), ["g"], most).collect()
    for g in {r[0] for r in rows} - {"one"}:
        found = sorted((r["x"], r["y"]) for r in got if r["g"] == g)
        x, y = plain(rows, g)
        assert [f[0] for f in found] == x.tolist() and np.allclose([f[1] for f in found], y, atol=1e-12), g
    assert not [r for r in got if r["g"] == "one"]


def test_a_million_scores_of_one_stratum(spark):
    """Equal to the plain fit, and no segment holds more than a small share of the blocks."""
    n = 1_000_000
    made = spark.range(n).select(F.lit("s").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 40)).alias("x"), F.col("id").alias("i"))
    made = made.withColumn("correct", (F.pmod(F.xxhash64("i", F.lit(7)), F.lit(1 << 30)) / (1 << 30) < F.col("x")).cast("int")).drop("i")
    got = np.array(sorted((r["x"], r["y"]) for r in fits.isotonic_maps(made, ["g"]).collect()))
    held = made.toPandas()
    x, y = fits.pool_adjacent(held["x"].to_numpy(), held["correct"].to_numpy(float))
    assert np.array_equal(got[:, 0], x) and np.allclose(got[:, 1], y, atol=1e-12)


@pytest.mark.parametrize("most", [1, 300, 1 << 16])
def test_platt_maps_in_steps(spark, most):
    rows = labelled(2, 1500) + [("apart", float(i >= 5), int(i >= 5)) for i in range(10)] + [("down", i / 100, int(i < 50)) for i in range(100)]
    got = {r["g"]: r for r in fits.platt_maps(spark.createDataFrame(rows, "g string, x double, correct int"), ["g"], most).collect()}
    for g in {r[0] for r in rows}:
        x, y = (np.array(c, float) for c in zip(*[(r[1], r[2]) for r in rows if r[0] == g], strict=True))
        slope, intercept = fits.platt(x, y)
        assert (got[g]["slope"], got[g]["intercept"]) == pytest.approx((slope, intercept), abs=1e-6) and got[g]["n"] == len(x)


def test_risk_in_epochs_gives_the_same_weights(spark, monkeypatch):
    rows = [(r[1], (r[1] * 7) % 1, r[2]) for r in labelled(3, 400)]
    df = spark.createDataFrame(rows, "u double, v double, y int")
    design = [F.col("u"), F.col("v")]
    plain_ = fits.monotone_logistic(np.array([r[:2] for r in rows]), np.array([r[2] for r in rows], float), epochs=8)
    monkeypatch.setattr(fits._risk_in_epochs, "__defaults__", (0.25, 0.05, 8))
    bias, w = fits.fit_risk(df, design, "y", most=10)
    assert bias == pytest.approx(plain_[0], abs=1e-9) and w == pytest.approx(plain_[1], abs=1e-9)
    with pytest.raises(ValueError):
        fits.fit_risk(df.where("y = 1"), design, "y")


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_maps_as_values(spark, chunk):
    rows = labelled(4, 2000, ("a", "b"))
    knots = fits.isotonic_maps(spark.createDataFrame(rows, "stratum string, x double, correct int"), ["stratum"])
    registry = maps.isotonic_registry(knots, "v7", chunk)
    xs = spark.createDataFrame([(s, x) for s in ("a", "b", "gone") for x in [*np.linspace(-6, 6, 301).tolist(), None]] + [(r["stratum"], r["x"]) for r in knots.collect()], "stratum string, x double")
    got = {(r["stratum"], r["x"]): r["p"] for r in maps.apply_maps(xs, registry).collect()}
    for s in ("a", "b"):
        kx, ky = plain([(r[0], r[1], r[2]) for r in rows], s)
        for (t, x), p in got.items():
            if t == s:
                assert p is None if x is None else p == pytest.approx(float(fits.interpolate(np.array([x]), kx, ky)[0]), abs=1e-12)
    assert {s for s, _ in got} == {"a", "b"}
    ranged = {(r["stratum"], r["x"]): r["p"] for r in calibration.map_predict(xs.where("x is not null"), knots).collect()}
    assert all(p == pytest.approx(got[k], abs=1e-12) for k, p in ranged.items())
    left = maps.apply_maps(xs, registry, how="left")
    assert left.count() == xs.count() and left.where("stratum = 'gone' and p is not null").count() == 0
    back = maps.from_json(maps.to_json(registry))
    assert sorted(map(str, back.collect())) == sorted(map(str, registry.collect())) and back.dtypes == registry.dtypes
    assert maps.violations(back).count() == 0


def test_lines_as_values(spark):
    registry = maps.platt_registry(spark.createDataFrame([("a", 2.0, -1.0)], "stratum string, slope double, intercept double"))
    xs = spark.createDataFrame([("a", x) for x in (-1.0, 0.0, 0.3, 1.0, 2.0)], "stratum string, x double")
    want = {r["x"]: r["p"] for r in xs.select("x", calibration.platt_predict(F.col("x"), F.lit(2.0), F.lit(-1.0)).alias("p")).collect()}
    assert {r["x"]: r["p"] for r in maps.apply_maps(xs, registry).collect()} == want


def test_broken_maps_are_named(spark):
    bad = [
        ("kind", "spline", "1", 0, [0.0], [0.0], None, None), ("none", "isotonic", "1", 0, [], [], None, None), ("order", "isotonic", "1", 0, [0.0, 0.0], [0.1, 0.2], None, None),
        ("falls", "isotonic", "1", 0, [0.0, 1.0], [0.2, 0.1], None, None), ("range", "isotonic", "1", 0, [0.0], [1.5], None, None), ("lengths", "isotonic", "1", 0, [0.0, 1.0], [0.5], None, None),
        ("line", "platt", "1", 0, [], [], None, 1.0), ("down", "platt", "1", 0, [], [], -1.0, 0.0), ("gap", "isotonic", "1", 0, [0.0, 1.0], [0.1, 0.2], None, None), ("gap", "isotonic", "1", 1, [2.0], [0.3], None, None),
        ("two", "isotonic", "1", 0, [0.0], [0.1], None, None), ("two", "isotonic", "2", 1, [0.0], [0.1], None, None), ("fine", "isotonic", "1", 0, [0.0, 1.0], [0.1, 0.2], None, None), ("fine", "isotonic", "1", 1, [1.0], [0.2], None, None),
    ]
    got = {(r["stratum"], r["rule"]) for r in maps.violations(spark.createDataFrame(bad, maps.SCHEMA)).collect()}
    assert got == {("kind", "unknown kind"), ("none", "no knots"), ("order", "xs do not ascend"), ("falls", "ys fall"), ("range", "ys beyond [0, 1]"), ("lengths", "knots of two lengths"), ("line", "no line"), ("down", "falling line"), ("gap", "chunks do not join"), ("two", "several maps")}
