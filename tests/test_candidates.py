"""Candidate pairs, column lineage, and running sums by parts, against plain loops."""

import random
from itertools import combinations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from accordia.operators import candidates, order, ranking, strata
from accordia.operators.lineage import blind, lineage
from accordia.operators.records import structural

TOPICS = "topic long, label string, punishment string, act string, number string, new_act string, new_number string, near_act string, near_number string"
ROWS = [(1, "theft", "a fine", "IPC", "378", "BNS", "303", "IPC", "379"), (2, "theft", "a fine", "IPC", "400", "BNS", "310", "IPC", "401"), (3, "fraud", "prison", "IPC", "415", "BNS", "318", "IPC", "416")]


def loops(rows):
    """All pairs by nested loops over wordings, as text pairs with stratum, date and link."""

    def say(form, act, number, label, punishment):
        values = {"name": candidates.ACT_NAMES[act], "act": act, "number": number, "label": label, "Label": label.capitalize(), "punishment": punishment}
        return form.format(**values)

    full, vague = candidates.FULL_FORMS, candidates.AMBIGUOUS_FORMS
    out = set()
    for _, label, punishment, act, number, new_act, new_number, near_act, near_number in rows:
        old = [say(f, act, number, label, punishment) for f in full]
        new = [say(f, new_act, new_number, label, punishment) for f in full]
        near = [say(f, near_act, near_number, label, punishment) for f in full]
        unclear = [say(f, act, number, label, punishment) for f in vague]
        swapped = say(full[2], new_act, number, label, punishment)
        for i, j in combinations(range(6), 2):
            out.add(("S1" if {i, j} <= {0, 2, 5} else "S2", old[i], old[j], "2024-01-01", ""))
        out |= {("S3", old[i], old[i], day, "successor_of") for i in (1, 3) for day in ("2024-01-01", "2026-10-01")}
        out |= {("S4", old[i], new[j], "2026-10-01", "successor_of") for i in range(3) for j in range(3)}
        out |= {("S5", old[0], near[1], "2024-01-01", ""), ("S5", old[3], near[4], "2024-01-01", ""), ("S6", old[0], swapped, "2026-10-01", "")}
        out |= {("S7", unclear[0], unclear[1], "2024-01-01", ""), ("S7", unclear[0], old[0], "2024-01-01", "")}
    return out


def test_candidates_against_loops(spark):
    got = candidates.candidate_pairs(spark.createDataFrame(ROWS, TOPICS)).collect()
    assert {(r["stratum"], r["text_i"], r["text_j"], r["as_of"], r["link"]) for r in got} == loops(ROWS)
    assert len(got) == len(loops(ROWS)) == len({(r["pair"], r["stratum"], r["as_of"], r["link"]) for r in got})
    vague = [r for r in got if r["stratum"] == "S7" and r["key_j"] == "NONE"]
    assert sorted((r["topic"], r["stands_for"]) for r in vague) == [(1, 3), (3, 3)]  # "governed by the Indian Penal Code" may be any of three


def test_candidates_pass_the_structural_rules(spark):
    got = candidates.candidate_pairs(spark.createDataFrame(ROWS, TOPICS))
    assert structural(got).where(F.size("broken") > 0).count() == 0


def test_wordings_are_read_as_what_they_were_made_of(spark):
    index = candidates.form_index(spark.createDataFrame(ROWS, TOPICS))
    assert candidates.mismatched_forms(index).count() == 0
    # An abbreviation that begins like another is read as that one, and a long name may be out of reach: such wordings are named.
    odd = candidates.form_index(spark.createDataFrame([(1, "bail", "a fine", "CRPC", "437", "BNSS", "480", "CRPC", "438")], TOPICS))
    assert {r["asserted"] for r in candidates.mismatched_forms(odd).collect()} == {"BNS 480", "BNS 437", "UNKNOWN 480", "UNKNOWN 437"}


def test_candidates_of_odd_topics(spark):
    assert candidates.candidate_pairs(spark.createDataFrame([], TOPICS)).count() == 0
    bare = spark.createDataFrame([(1, "theft", "a fine", "IPC", "378", None, None, None, None), (2, None, None, None, None, None, None, None, None), ROWS[0], ROWS[0]], TOPICS)
    got = candidates.candidate_pairs(bare)
    assert {r["stratum"] for r in got.collect()} == {f"S{i}" for i in range(1, 8)}
    assert got.count() == len(loops(ROWS[:1]))


def test_quotas_take_the_first_by_hash(spark):
    pairs = candidates.candidate_pairs(spark.createDataFrame(ROWS, TOPICS))
    got = candidates.quota(pairs, {"S2": 5, "S4": 100, "S5": 0})
    count = lambda df: {r["stratum"]: r["count"] for r in df.groupBy("stratum").count().collect()}
    every = count(pairs)
    assert count(got) == {s: n for s, n in (every | {"S2": 5}).items() if s != "S5"}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, candidates.quota(pairs.repartition(7), {"S2": 5, "S4": 100, "S5": 0}).collect()))


def shuffled(spark, df):
    """Bytes that the work of df, or of what makes it, writes to shuffles."""
    written = lambda: sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = written()
    df = df() if callable(df) else df
    df.write.format("noop").mode("overwrite").save()
    return written() - before


def many_topics(spark, n):
    return spark.range(n).selectExpr(
        "id topic", "concat('theft ', id % 7) label", "concat('fine ', id % 9) punishment", "'IPC' act", "string(id) number", "'BNS' new_act", "string(id + 1000) new_number", "'IPC' near_act", "string(id + 1) near_number"
    )


def test_pairs_that_come_once_are_not_shuffled_whole(spark):
    topics = many_topics(spark, 2000)
    assert shuffled(spark, candidates.candidate_pairs(topics)) < 60 * 33 * 2000


def test_quotas_make_few_pairs_whole(spark):
    topics = many_topics(spark, 2000)
    most = {f"S{i}": 3 for i in range(1, 8)}
    assert shuffled(spark, lambda: candidates.quota_pairs(topics, most)) < 30 * 33 * 2000


def test_pairs_without_the_index_are_the_same(spark):
    topics = many_topics(spark, 30)
    names = [c for c in ["pair", *candidates.PAIR_COLUMNS] if c != "stands_for"]
    plain = lambda df: sorted(str([r[c] for c in names]) for r in df.collect())
    assert plain(candidates.distinct_pairs(topics)) == plain(candidates.candidate_pairs(topics))


@pytest.mark.parametrize("marks", [1, 1 << 20])
def test_marks_change_no_pair(spark, monkeypatch, marks):
    """With one mark, every pair is looked at again."""
    topics = many_topics(spark, 40).union(many_topics(spark, 3))
    plain = lambda df: sorted(str([r[c] for c in ["pair", *candidates.PAIR_COLUMNS]]) for r in df.collect())
    want = plain(candidates.candidate_pairs(topics))
    monkeypatch.setattr(candidates, "MARKS", marks)
    assert plain(candidates.candidate_pairs(topics)) == want and len(set(want)) == len(want) == 40 * 32 + 7
    most = {f"S{i}": 5 * i for i in range(1, 8)}
    assert plain(candidates.quota_pairs(topics, most)) == plain(candidates.quota(candidates.candidate_pairs(topics), most))


# Lineage
@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame([(1, 2, 3)], "id long, x long, y long"), spark.createDataFrame([(1, 5)], "id long, z long")


def named(df):
    found = lineage(df)
    return {c: {s.column for s in v} for c, v in found.columns.items()}, {s.column for s in found.rows}


def test_lineage_through_every_kind_of_node(two):
    a, b = two
    assert named(a.withColumn("s", F.col("x") + F.col("y")).where("s > 3").join(b, "id").select("s", "z")) == ({"s": {"x", "y"}, "z": {"z"}}, {"x", "y", "id"})
    assert named(a.groupBy("id").agg(F.sum("x").alias("t"))) == ({"id": {"id"}, "t": {"x"}}, {"id"})
    assert named(a.select("x", F.row_number().over(Window.partitionBy("id").orderBy("y")).alias("r"))) == ({"x": {"x"}, "r": {"id", "y"}}, set())
    assert named(a.select("id", F.explode(F.array("x", "y")).alias("e")))[0] == {"id": {"id"}, "e": {"x", "y"}}
    assert named(a.select("id", "x").unionByName(b.select("id", F.col("z").alias("x"))))[0] == {"id": {"id"}, "x": {"x", "z"}}
    assert named(a.select("x", "y").mapInPandas(lambda it: it, "p long, q long"))[0] == {"p": {"x", "y"}, "q": {"x", "y"}}
    assert named(a.alias("l").join(a.alias("r"), F.col("l.x") == F.col("r.y")).select(F.col("l.y").alias("ly"), F.col("r.x").alias("rx"))) == ({"ly": {"y"}, "rx": {"x"}}, {"x", "y"})
    assert named(a.dropDuplicates(["x"]).select("y")) == ({"y": {"y"}}, {"x"})
    assert named(a.groupBy("id").applyInPandas(lambda d: d, "id long, x long, y long").select("x"))[1] == {"id", "x", "y"}
    assert named(a.unpivot(["id"], ["x"], "k", "v").select("v"))[0]["v"] >= {"x"}


def test_blindness_of_clean_and_leaking_plans(two):
    a, b = two
    assert blind(lambda d: d.withColumn("p", F.col("x") / 2), a, ["y"]).holds
    assert blind(lambda d: d.withColumn("p", F.avg("y").over(Window.partitionBy("id"))), a, ["y"]).leaks == {"p": ("y",)}
    assert blind(lambda d: d.where("y = 1").select("x"), a, ["y"]).leaks == {"rows": ("y",)}
    assert blind(lambda d: d.join(d.groupBy("id").agg(F.max("y").alias("m")), "id").select("id", "x", F.col("m").alias("p")), a, ["y"]).leaks == {"p": ("y",)}
    # What is fitted on labels of other rows is no leak, even of the same table.
    assert blind(lambda d: d.join(a.groupBy("id").agg(F.avg("y").alias("p")), "id"), a, ["y"]).holds
    assert not blind(lambda d: d.withColumn("p", F.col("y")), a, ["y"], ["p"]).holds
    with pytest.raises(ValueError):
        blind(lambda d: d, a, ["gone"])


def test_scoring_of_strata_is_blind_and_a_leak_is_seen(spark):
    dev = spark.createDataFrame([("s", i / 50, i % 2) for i in range(50)], "stratum string, x double, correct int")
    rows = spark.createDataFrame([("s", 0.5, 1)], "stratum string, x double, correct int")
    assert blind(lambda d: strata.attach_probabilities(d, dev), rows, ["correct"], ["p", "calibration_status"]).holds
    leaking = blind(lambda d: strata.attach_probabilities(d.withColumn("x", F.col("x") + 0 * F.col("correct")), dev), rows, ["correct"], ["p"])
    assert not leaking.holds and "p" in leaking.leaks


# Running sums
def tied(seed, n, share=3):
    """(group, score, ord, correct): a third of the scores are 0, some groups and scores are beyond [0, 1]."""
    draw = random.Random(seed)
    return [(draw.choice(["a", "a", "b", None]), 0.0 if draw.randrange(share) == 0 else draw.choice([draw.uniform(-3, 3), 0.5, 0.5 + draw.randrange(9) / 1e9, 1e9, -2.0, 1e-300]), i, draw.randrange(2)) for i in range(n)]


@pytest.mark.parametrize("least_tie", [2, 100, 1 << 14])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_running_sums_with_ties(spark, kind, least_tie):
    rows = tied(1, 3000)
    df = spark.createDataFrame(rows, "g string, u double, ord long, correct int").withColumn("ord", F.col("ord").cast(kind)).repartition(5)
    got = {r["ord"]: (r["k"], r["s"]) for r in order.cumulate(df, ["g"], "u", [F.col("ord")], {"k": F.lit(1), "s": F.col("correct")}, least_tie).collect()}
    for g in ("a", "b", None):
        k = s = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2] if kind == "long" else str(r[2]))):
            k, s = k + 1, s + r[3]
            assert got[r[2] if kind == "long" else str(r[2])] == (k, s)


def test_one_tied_score_is_dealt_out(spark):
    df = spark.range(20000).select(F.lit("g").alias("g"), F.lit(0.0).alias("u"), F.col("id").alias("ord"), F.lit(1).alias("correct"))
    sizes = [r["count"] for r in order.dealt(df, ["g"], "u", [F.col("ord")]).groupBy("_part", "_tie", "_sub").count().collect()]
    assert len(sizes) > 32 and max(sizes) < 2000
    assert ranking.aurc(df, ["g"]).first()["aurc"] == 0.0


def test_search_counts_smaller_bounds(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0, 5.0], x) for x in (0.0, 1.0, 1.5, 2.0, 3.0, 5.0, 6.0)] + [([], 1.0), (None, 1.0), ([1.0], None)], "b array<double>, x double")
    assert [r[0] for r in df.select(order.search(F.col("b"), F.col("x"))).collect()] == [0, 0, 1, 1, 3, 3, 4, 0, 0, None]
