"""As-of look-ups by one sort, and exact resampling, against plain loops."""

import hashlib
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordia.operators import bootstrap, resample, validity

START = datetime(2020, 1, 1)
day = lambda n: None if n is None else START + timedelta(days=n)


def brute(probes, intervals):
    out = []
    for pid, k, d in probes:
        found = [(b, e, v) for kk, b, e, v in intervals if k is not None and kk == k and b is not None and d is not None and b <= d and (e is None or d < e)]
        out += [(pid, k, day(d), day(b), day(e), v) for b, e, v in found] or [(pid, k, day(d), None, None, None)]
    return sorted(map(str, out))


@pytest.mark.parametrize("key_rows", [1, 7, 1 << 16])
@pytest.mark.parametrize("overlap", [False, True])
def test_as_of_against_loops(spark, key_rows, overlap):
    draw = random.Random(3)
    intervals = []
    for k in ("a", "b", "hot", None):
        at = 0
        for v in range(60 if k == "hot" else 6):
            length = draw.randint(0, 9)
            intervals.append((k, None if draw.randrange(12) == 0 else at, None if draw.randrange(9) == 0 and overlap else at + length, v))
            at += draw.randint(0, 9) if overlap else length + draw.randrange(2)
    intervals.append(("a", 100, None, 99))
    probes = [(i, draw.choice(["a", "b", "hot", "hot", "gone", None]), draw.choice([None, *range(-3, 300)])) for i in range(400)]
    p = spark.createDataFrame([(i, k, day(d)) for i, k, d in probes], "pid long, key string, day timestamp").repartition(3)
    i = spark.createDataFrame([(k, day(b), day(e), v) for k, b, e, v in intervals], "key string, begin timestamp, end timestamp, value long").repartition(3)
    got = validity.as_of(p, i, "key", "day", key_rows)
    assert got.columns == ["pid", "key", "day", "begin", "end", "value"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(probes, intervals)
    assert validity.as_of(p.limit(0), i, "key", "day").count() == 0 and validity.as_of(p, i.limit(0), "key", "day").where("value is null").count() == 400


def test_as_of_of_one_key_is_linear(spark):
    """A key of 200,000 probes and as many intervals: each interval is listed once, but for those open between parts."""
    n = 200_000
    at = lambda c: F.timestamp_seconds(F.lit(1_600_000_000) + c)
    i = spark.range(n).select(F.lit("k").alias("key"), at(F.col("id") * 10).alias("begin"), at(F.col("id") * 10 + 10).alias("end"), F.col("id").alias("value"))
    p = spark.range(n).select(F.lit("k").alias("key"), at(F.col("id") * 10 + 3).alias("day"), F.col("id").alias("want"))
    got = validity.as_of(p, i, "key", "day")
    assert got.agg(F.count("*"), F.count_if(F.col("value") == F.col("want"))).first() == (n, n)


def picked(seed, r, n):
    return Counter(int(hashlib.md5(f"{seed}|{r}|{j}".encode()).hexdigest()[:13], 16) % n for j in range(n))


def test_draws_are_exact(spark):
    units = resample.numbered(spark.createDataFrame([(x * 7 - 50,) for x in range(40)], "id long"), "id")
    assert [r["unit"] for r in units.orderBy("id").collect()] == list(range(40))
    got = {(r["replicate"], r["unit"]): r["weight"] for r in resample.draws(units, 6, 5).collect()}
    assert got == {(r, u): w for r in range(6) for u, w in picked(5, r, 40).items()}
    assert resample.draws(units.limit(0), 6).count() == 0


def test_replicates_against_the_plain_statistic(spark):
    draw = random.Random(9)
    rows = [(i, i % 13, draw.choice([0.1, 0.2, draw.random()]), draw.random(), draw.choice([0, 1, 1, None])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, topic long, u double, v double, correct int")
    for unit in ("id", "topic"):
        units = resample.numbered(df.select(unit).distinct(), unit)
        placed = df.join(units, unit)
        weights = resample.draws(units, 4, 1)
        names = sorted({r[0 if unit == "id" else 1] for r in rows})
        for r in resample.auroc_replicates(placed, weights, ["u", "v"]).collect():
            w = picked(1, r["replicate"], len(names))
            kept = [(x, w[names.index(x[0 if unit == "id" else 1])]) for x in rows if x[4] is not None]
            for s, at in (("u", 2), ("v", 3)):
                want = bootstrap.weighted_auroc(np.array([x[at] for x, _ in kept]), np.array([x[4] for x, _ in kept]), np.array([k for _, k in kept]))
                assert r[s] == pytest.approx(want)
        for r in resample.mean_replicates(placed, weights, "correct", []).collect():
            w = picked(1, r["replicate"], len(names))
            kept = [(x[4], w[names.index(x[0 if unit == "id" else 1])]) for x in rows if x[4] is not None]
            assert r["n"] == sum(k for _, k in kept) and r["mean"] == pytest.approx(sum(c * k for c, k in kept) / r["n"])
