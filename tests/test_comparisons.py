"""Comparisons of arms and clusterings, plan digests, modal classes, and the fits' SQL on ties, against plain loops."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from accordia.operators import agreement, calibration, cells, fits, records, relations, strata
from accordia.plans import fit_sql


def test_identity_pairs_make_the_components_of_equal_keys(spark):
    draw = random.Random(1)
    rows = [(i % 3, p, draw.choice(["A 1", "A 2", "B 1", "NONE"])) for i in range(3) for p in range(20)]
    df = spark.createDataFrame(rows, "item_id long, pos int, key string")
    up = {(r[0], r[1]): (r[0], r[1]) for r in rows}

    def top(x):
        return x if up[x] == x else top(up[x])

    for r in relations.identity_pairs(df).collect():
        assert r["i"] < r["j"] and r["label"] == "SAME_PROVISION"
        up[top((r["item_id"], r["j"]))] = top((r["item_id"], r["i"]))
    for a in rows:
        for b in rows:
            same = a[0] == b[0] and a[2] == b[2] != "NONE" or a[:2] == b[:2]
            assert (top(a[:2]) == top(b[:2])) == same


def test_key_counts_and_modal_classes(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, None), (2, 0, "b")], "item_id long, pos int, key string")
    assert {r["item_id"]: r["counts"] for r in agreement.key_counts(df).collect()} == {1: {"a": 2, "NONE": 1}, 2: {"b": 1}}
    harms = spark.createDataFrame([("t", "both")] * 2 + [("t", "custodial"), ("u", "procedural"), ("u", "both"), ("v", None)], "topic string, harm string")
    got = {rule: {r["topic"]: r["harm_class"] for r in calibration.harm_class(harms, rule=rule).collect()} for rule in ("max", "modal")}
    assert got == {"max": {"t": "custodial", "u": "both"}, "modal": {"t": "both", "u": "both"}}
    with pytest.raises(ValueError):
        calibration.harm_class(harms, rule="least")
    assert calibration.z_of(0.95) == pytest.approx(1.959963984540054) and calibration.z_of(0.9) == pytest.approx(1.6448536269514722)
    with pytest.raises(ValueError):
        calibration.z_of(1.0)


def test_plans_are_bound_by_their_digest(spark):
    items = spark.createDataFrame([(i,) for i in range(20)], "item_id long")
    digest = records.plan_digest(items, {"model": "m", "samples": 10})
    assert digest == records.plan_digest(items.repartition(7), {"samples": 10, "model": "m"}) == records.approved(items, {"model": "m", "samples": 10}, digest, 0.5, 1.0)
    others = [records.plan_digest(items.limit(19), {"model": "m", "samples": 10}), records.plan_digest(items, {"model": "n", "samples": 10}), records.plan_digest(items.unionByName(items.limit(1)), {"model": "m", "samples": 10})]
    assert len({digest, *others}) == 4
    for approval, cost in ((None, 0.5), (others[0], 0.5), (digest, 1.5)):
        with pytest.raises(PermissionError):
            records.approved(items, {"model": "m", "samples": 10}, approval, cost, 1.0)


def test_typed_separation(spark):
    rows = [("a", 1, 1, 1, 0.1), ("a", 0, 1, 0, 0.9), ("a", 1, 1, 1, 0.9), ("a", 0, 0, 0, 0.5), ("b", 1, 1, 1, 0.2), ("b", 1, 0, 0, 0.3)]
    got = {r["slice"]: r for r in cells.typed_separation(spark.createDataFrame(rows, "slice string, correct int, exact_all_same int, typed_all_same int, typed_entropy double")).collect()}
    assert (got["a"]["n_unanimous"], got["a"]["auroc"]) == (3, 0.75) and (got["b"]["n_unanimous"], got["b"]["auroc"]) == (1, None)
    assert got["a"]["exact_gap"] == pytest.approx(2 / 3) and got["a"]["typed_gap"] == pytest.approx(1.0) and got["a"]["narrowed"] == pytest.approx(-1 / 3)
    assert got["pooled"]["n_unanimous"] == 4 and got["b"]["exact_gap"] == 0


def test_arms_score_the_same_held_out_items(spark):
    draw = random.Random(5)
    rows = [(i, draw.choice(["en", "fr"]), i % 3 > 0, draw.random(), draw.choice([0, 1, 1]), None if i % 17 == 0 else draw.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "item_id long, slice string, dev boolean, u double, correct int, v double")
    got = {r["arm"]: r for r in strata.within_slice_arms(df, "en", [F.col("u"), F.col("v")]).collect()}
    ready = [r for r in rows if r[5] is not None]
    held = [r for r in ready if r[1] == "en" and not r[2]]
    for arm, training in (("pooled", [r for r in ready if r[2]]), ("within", [r for r in ready if r[2] and r[1] == "en"])):
        bias, w = fits.monotone_logistic(np.array([(r[3], r[5]) for r in training]), np.array([1.0 - r[4] for r in training]))
        u = [1 / (1 + math.exp(-(bias + w[0] * r[3] + w[1] * r[5]))) for r in held]
        wins = [(a < b) + 0.5 * (a == b) for a, x in zip(u, held, strict=True) if x[4] == 1 for b, y in zip(u, held, strict=True) if y[4] == 0]
        assert (got[arm]["training_n"], got[arm]["n"]) == (len(training), len(held))
        assert got[arm]["auroc"] == pytest.approx(sum(wins) / len(wins)) and got[arm]["brier"] == pytest.approx(sum((1 - a - r[4]) ** 2 for a, r in zip(u, held, strict=True)) / len(held))


@pytest.mark.parametrize("seed", range(6))
def test_the_fits_sql_is_the_plain_fit(seed):
    """Ties, equal means of neighbouring blocks, and groups of one class."""
    draw = random.Random(seed)
    rows = [(draw.choice("ab"), draw.randrange(12) / 4, draw.randrange(2)) for _ in range(80)] + [("one", 0.5, 1)] * 3 + [("even", i / 8, i % 2) for i in range(8)]
    con = duckdb.connect()
    con.execute("create table t (grp varchar, x double, correct int)")
    con.executemany("insert into t values (?, ?, ?)", rows)
    knots = con.execute(f"WITH {fit_sql.isotonic('t', 'grp')} SELECT grp, x, y FROM knots ORDER BY grp, x").fetchall()
    lines = {r[0]: r[1:] for r in con.execute(f"WITH RECURSIVE {fit_sql.platt('t', 'grp')} SELECT grp, slope, intercept, n FROM lines").fetchall()}
    assert {k[0] for k in knots} == {"a", "b", "even"} == set(lines)
    for g in ("a", "b", "even"):
        x, y = (np.array(c, float) for c in zip(*[(r[1], r[2]) for r in rows if r[0] == g], strict=True))
        kx, ky = fits.pool_adjacent(x, y)
        mine = [k for k in knots if k[0] == g]
        assert [k[1] for k in mine] == kx.tolist() and [k[2] for k in mine] == pytest.approx(ky.tolist())
        assert lines[g][:2] == pytest.approx(fits.platt(x, y), abs=1e-7) and lines[g][2] == len(x)


def test_the_bounds_sql_is_the_plain_bound():
    con = duckdb.connect()
    cases = [(k, n) for n in (1, 2, 7, 40, 333) for k in sorted({0, 1, n // 2, n - 1, n})]
    con.execute("create table t (g int, hits bigint, n bigint)")
    con.executemany("insert into t values (?, ?, ?)", [(i, *c) for i, c in enumerate(cases)])
    got = con.execute(f"WITH RECURSIVE {fit_sql.exact_low('t', 'g')} SELECT g, exact_low FROM bounds ORDER BY g").fetchall()
    assert [g[1] for g in got] == pytest.approx([fits.exact_lower(*c) for c in cases], abs=1e-9)
    con.execute("create table r (g int, rate double)")
    rates = [0.0, 0.0005, 0.01, 0.2, 0.5, 0.99]
    con.executemany("insert into r values (?, ?)", [*enumerate(rates)])
    found = dict(con.execute(f"WITH RECURSIVE {fit_sql.needed('r', 'g', 'rate', 20)} SELECT g, needed FROM needed_").fetchall())
    assert [found.get(i) for i in range(len(rates))] == [fits.items_needed(r, 20) for r in rates]
