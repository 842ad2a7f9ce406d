"""Stages over immutable runs, streaming de-duplication by state, generated answers, revisions and manifests."""

import duckdb
import pytest
from pyspark.sql import functions as F

from accordia.functions import mentions
from accordia.functions.vocabulary import ACT_ALIASES
from accordia.operators import attach, fits, mock, revision
from accordia.plans.reports import ORACLE, QUERIES
from accordia.plans.supervision import revision_audit
from accordia.sources.stages import Catalogue, ChangedInput, fingerprint, run_stage
from accordia.streaming.ingest import ingest


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# Fingerprints and stages
def test_fingerprints_follow_the_rows_alone(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 0.5), (2, "b", 0.5)], "k long, s string, x double")
    same = [df, df.repartition(3), df.select("x", "k", "s"), df.orderBy("k")]
    assert len({fingerprint(x) for x in same}) == 1
    other = [df.distinct(), df.withColumn("x", F.coalesce("x", F.lit(0.0))), df.withColumn("k", F.col("k").cast("int")), df.withColumnRenamed("s", "t"), df.limit(0)]
    assert len({fingerprint(x)[0] for x in [df, *other]}) == 6


def doubled(items):
    return items.select("item_id", (F.col("x") * 2).alias("y"))


def test_a_stage_publishes_resumes_and_refuses(spark, tmp_path):
    runs = Catalogue(spark, f"{tmp_path}/runs")
    items = spark.createDataFrame([("a", 1), ("b", 2)], "item_id string, x int")
    seen = []

    def transform(items):
        seen.append([(r["item_id"],) for r in items.collect()])
        return doubled(items)

    first = run_stage(runs, "double", {"items": items}, "out", transform)
    assert first.version == 1 and first.n_rows == 2 and rows(runs.read("out"), "item_id", "y") == [("a", 2), ("b", 4)]
    # The same again does nothing; more items are added to the old ones, which are not done again.
    assert run_stage(runs, "double", {"items": items}, "out", transform) == first and len(seen) == 1
    more = items.unionByName(spark.createDataFrame([("c", 3), (None, 9)], items.schema))
    second = run_stage(runs, "double", {"items": more}, "out", transform)
    assert second.version == 2 and len(seen) == 2 and set(seen[1]) == {("c",), (None,)}
    assert sorted(map(str, rows(runs.read("out").where("item_id is not null"), "item_id", "y"))) == ["('a', 2)", "('b', 4)", "('c', 6)"]
    assert runs.spark.read.parquet(first.path).count() == 2  # the first run's files are as they were
    with pytest.raises(ChangedInput):  # another stage, and other side inputs, publish under other names
        run_stage(runs, "treble", {"items": more}, "out", transform)
    with pytest.raises(ChangedInput):
        run_stage(runs, "double", {"items": more, "side": items}, "out", lambda items, side: doubled(items))
    with pytest.raises(KeyError):
        runs.read("nothing")


def test_a_changed_input_or_a_failed_write_publishes_nothing(spark, tmp_path):
    runs = Catalogue(spark, f"{tmp_path}/runs")
    path = f"{tmp_path}/in"
    spark.createDataFrame([("a", 1)], "item_id string, x int").write.parquet(path)
    items = spark.read.schema("item_id string, x int").parquet(path)

    def meddle():
        spark.createDataFrame([("b", 2)], "item_id string, x int").write.mode("append").parquet(path)

    # What is read anew sees the files of its time: the check reads the folder again.
    reread = lambda: spark.read.schema("item_id string, x int").parquet(path)
    before = fingerprint(reread())
    run_stage(runs, "double", {"items": items}, "fine", doubled)
    meddle()
    assert fingerprint(reread()) != before
    failing = lambda items: items.select("item_id", F.raise_error(F.lit("no")).cast("int").alias("y"))
    with pytest.raises(Exception, match="no"):
        run_stage(runs, "double", {"items": items}, "broken", failing)
    assert runs.newest("broken") is None and runs.newest("fine").version == 1


def test_an_input_that_changes_meanwhile_is_refused(spark, tmp_path, monkeypatch):
    from accordia.sources import stages

    runs = Catalogue(spark, f"{tmp_path}/runs")
    items = spark.createDataFrame([("a", 1)], "item_id string, x int")
    given = iter([("one", 1), ("two", 1)])
    monkeypatch.setattr(stages, "fingerprint", lambda df: next(given))
    with pytest.raises(ChangedInput, match="items changed"):
        run_stage(runs, "double", {"items": items}, "out", doubled)
    assert runs.newest("out") is None


def test_a_run_whose_files_changed_is_not_resumed(spark, tmp_path):
    runs = Catalogue(spark, f"{tmp_path}/runs")
    items = spark.createDataFrame([("a", 1)], "item_id string, x int")
    made = run_stage(runs, "double", {"items": items}, "out", doubled)
    spark.createDataFrame([("z", 5)], "item_id string, y int").write.mode("append").parquet(made.path)
    with pytest.raises(ChangedInput):
        runs.verify("out")
    with pytest.raises(ChangedInput):
        run_stage(runs, "double", {"items": items}, "out", doubled)


def test_attach_stages(spark, tmp_path):
    runs = Catalogue(spark, f"{tmp_path}/runs")
    samples = spark.createDataFrame([(1, 0, "Section 1 of the IPC", "IPC 1"), (1, 1, "Section 2 of the IPC", "IPC 2"), (1, 2, "s. 1 IPC", "IPC 1"), (2, 0, "no idea", "NONE")], "item_id long, pos int, text string, key string")
    statutes = spark.createDataFrame([("IPC 1", "1862-01-01", None)], "statute string, begin string, end string").selectExpr("statute", "cast(begin as timestamp) begin", "cast(end as timestamp) end")
    day = F.lit("2020-01-01").cast("timestamp")
    run_stage(runs, "context", {"samples": samples, "statutes": statutes}, "with_context", lambda samples, statutes: attach.context(samples, statutes, day))
    assert rows(runs.read("with_context"), "item_id", "validity") == [(1, "IPC 1=true,IPC 2=unknown"), (2, "")]
    pairs = spark.createDataFrame([(1, 0, 1, "SAME_PROVISION", 0.9), (1, 1, 2, "SAME_PROVISION", 0.8)], "item_id long, i int, j int, label string, score double")
    run_stage(runs, "typed", {"samples": samples, "pairs": pairs}, "typed", lambda samples, pairs: attach.typed(samples, pairs, 0.5))
    assert rows(runs.read("typed"), "item_id", "n_clusters", "merged") == [(1, 1, 1), (2, 1, 0)]
    links = spark.createDataFrame([("IPC 1", "IPC 2")], "`from` string, `to` string")
    run_stage(runs, "detect", {"samples": samples, "statutes": statutes, "links": links}, "detected", lambda samples, statutes, links: attach.detected(samples, statutes, links, day))
    got = {r["item_id"]: r for r in runs.read("detected").collect()}
    assert got[1]["contradiction_source"] == "rule" and got[1]["k"] == pytest.approx(1 / 3) and got[1]["modal_key"] == "IPC 1"
    bad = spark.createDataFrame([(1, 1.5)], "item_id long, mass double")
    with pytest.raises(Exception, match="no share"):
        run_stage(runs, "detect", {"samples": samples, "statutes": statutes, "links": links.limit(0), "mass": bad}, "bad", lambda samples, statutes, links, mass: attach.detected(samples, statutes, links, day, "model", mass))
    answers = spark.createDataFrame([(1, 0, "Section 5 of the IPC.", "IPC", "5", "gold"), (1, 1, "Section 6 of the IPC.", "IPC", "5", "gold")], "item_id long, pos int, text string, gold_act string, gold_provision string, verdict string")
    run_stage(runs, "rejudge", {"answers": answers}, "rejudged", attach.rejudged)
    assert rows(runs.read("rejudged"), "pos", "label", "changed") == [(0, "gold", False), (1, "wrong_section", True)]
    assert rows(attach.census(runs.read("rejudged"), "changed"), "changed", "n") == [(False, 1), (True, 1)]


# Streams
def test_a_stream_reads_its_own_batch_and_goes_on_after_a_restart(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "item_id string, x int, at timestamp"
    done = spark.createDataFrame([("old",)], "item_id string")

    def go(name, lines, **more):
        (source / f"{name}.json").write_text("\n".join(lines) + "\n")
        q = ingest(spark, str(source), schema, f"{tmp_path}/out", f"{tmp_path}/check", **more)
        q.awaitTermination(120)
        return q

    record = lambda k, x, at: f'{{"item_id": "{k}", "x": {x}, "at": "{at}"}}'
    go("0", [record("a", 1, "2024-01-01 00:00:00"), record("a", 2, "2024-01-01 00:00:01"), record("old", 3, "2024-01-01 00:00:02")], arrived="at", delay="1 day", done=done)
    first = go("1", [record("a", 4, "2024-01-01 01:00:00"), record("b", 5, "2024-01-01 01:00:00")], arrived="at", delay="1 day", done=done)
    assert sorted(r["item_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]
    assert sum(p["numInputRows"] for p in first.recentProgress) <= 2 + 2 * 1  # its two records (and the static keys), never the target
    state = [s for p in first.recentProgress for s in p["stateOperators"]]
    assert state and max(s["numRowsTotal"] for s in state) <= 2


def test_state_forgets_after_the_delay(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n, day in enumerate((1, 10, 20, 21)):
        (source / f"{n}.json").write_text(f'{{"item_id": "k{n}", "x": 1, "at": "2024-01-{day:02d} 00:00:00"}}\n')
        q = ingest(spark, str(source), "item_id string, x int, at timestamp", f"{tmp_path}/out", f"{tmp_path}/check", arrived="at", delay="1 day")
        q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    assert [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]][-1] < 4


# Generated answers
def test_generated_answers_reach_every_label(spark):
    items = spark.range(600).select(F.col("id").alias("item_id"), F.when(F.col("id") % 2 == 0, "IPC").otherwise("BNS").alias("gold_act"), (F.col("id") % 40 + 100).cast("string").alias("gold_provision"))
    made = mock.answers(items, 6, 3)
    judged = made.withColumn("v", mentions.judge_answers("text", "gold_act", "gold_provision")).select("*", "v.label", "v.correct")
    got = judged.collect()
    assert all(r["label"] == r["expected"] for r in got) and len(got) == 3600
    assert {r["label"] for r in got} == {x for t in mock.TEMPLATES for x in (t.old, t.new)}
    text = " ".join(r["text"] for r in got).lower()
    assert not [a for a, _ in ACT_ALIASES if a not in text and a != "bnss"]
    assert not [c for c in (*mock.CUES, *mock.FOREIGN, *mock.OPERATIVE_CUES) if c not in text]
    regimes = {}
    for r in got:
        regimes.setdefault((r["regime"], r["item_id"]), []).append(r["label"])
    assert all(len(set(x)) == 1 for (g, _), x in regimes.items() if g == "wrong")
    assert {r["correct"] for r in got if r["regime"] == "right"} == {True} and {r["correct"] for r in got if r["regime"] == "wrong"} == {False}
    assert rows(made, "item_id", "pos", "text") == rows(mock.answers(items.repartition(5), 6, 3), "item_id", "pos", "text")
    assert rows(made, "item_id", "pos", "text") != rows(mock.answers(items, 6, 4), "item_id", "pos", "text")


def test_an_item_of_many_samples_is_clustered_by_its_texts(spark):
    """100,000 samples with 1,000 texts; and texts that are not like themselves found a cluster each time."""
    n = 100_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("item_id"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("w"), F.col("id") % 1000).alias("text"))
    got = fits.greedy_clusters(df, lambda a, b: float(a == b), 0.5)
    assert got.agg(F.count("*"), F.count_distinct("label"), F.count_if(F.col("label") == F.col("pos") % 1000)).first() == (n, 1000, n)
    odd = spark.createDataFrame([(1, 0, "a"), (1, 1, ""), (1, 2, "a b"), (1, 3, ""), (1, 4, None), (1, 5, "a")], "item_id long, pos int, text string")
    like = lambda a, b: len(a & b) / max(len(a), len(b)) if a and b else 0.0
    assert rows(fits.greedy_clusters(odd, like, 0.5, lambda t: frozenset(t.split())), "pos", "label") == [(0, 0), (1, 1), (2, 0), (3, 2), (4, 3), (5, 0)]


# Revisions and manifests
ITEM = "item_id string, gold string, n int, verified boolean"
REVISION = "item_id string, gold string, n int, action string, reason string, decided_by string"


def test_revisions_are_audited_and_change_nothing_twice(spark):
    items = spark.createDataFrame([("a", "1", 1, True), ("b", "2", None, True), ("c", None, 3, True), ("d", "4", 4, True)], ITEM)
    r = spark.createDataFrame([("a", "9", None, "change", "typo", "x"), ("b", None, None, "retire", "gone", "x"), ("e", "5", 5, "insert", "new", "y"), ("c", None, 3, "change", "none", "y")], REVISION)
    out, audit = revision.revise(items, r)
    assert rows(out, "item_id", "gold", "n", "verified", "retired") == [("a", "9", 1, False, False), ("b", "2", None, False, True), ("c", None, 3, True, False), ("d", "4", 4, True, False), ("e", "5", 5, False, False)]
    got = {(x["item_id"], x["action"], x["field"], x["before"], x["after"]) for x in audit.collect()}
    assert got == {("a", "change", "gold", "1", "9"), ("a", "change", "verified", "true", "false"), ("b", "retire", "retired", "false", "true"), ("b", "retire", "verified", "true", "false"), ("e", "insert", "gold", None, "5"), ("e", "insert", "n", None, "5"), ("e", "insert", "verified", None, "false"), ("e", "insert", "retired", None, "false")}
    again, nothing = revision.revise(out, r)
    assert rows(again.fillna({"n": -1, "gold": "-"}), *out.columns) == rows(out.fillna({"n": -1, "gold": "-"}), *out.columns) and nothing.count() == 0
    untouched, none = revision.revise(items, r.limit(0))
    assert untouched.count() == 4 and none.count() == 0


@pytest.mark.parametrize(
    "row, said", [(("z", None, None, "change", "r", "x"), "no such item"), (("z", None, None, "retire", "r", "x"), "no such item"), (("a", None, None, "swap", "r", "x"), "no key or action"), ((None, "1", 1, "insert", "r", "x"), "no key or action"), (("b", None, 1, "change", "r", "x"), "revised twice")]
)
def test_revisions_with_problems_are_refused(spark, row, said):
    items = spark.createDataFrame([("a", "1", 1, True), ("b", "2", 2, True)], ITEM)
    r = spark.createDataFrame([("b", "3", None, "change", "r", "x"), row], REVISION)
    assert said in {x["problem"] for x in revision.problems(items, r, "item_id").collect()}
    with pytest.raises(Exception, match="refused"):
        revision.revise(items, r)[0].collect()


def test_items_are_numbered_by_topic(spark):
    plan = spark.createDataFrame([(1, "t", "L7", "q1"), (2, "t", "L1", "q2"), (3, "u", "L7", "q3")], "ord int, topic string, slice string, question string").selectExpr("*", "'IPC' old_act", "'1' old_number", "'BNS' new_act", "'2' new_number")
    assert rows(revision.numbered_items(plan), "item_id", "gold_act", "trap_provision", "era") == [("L1-t-c002", "IPC", "2", "pre-transition"), ("L7-t-c001", "BNS", "1", "current"), ("L7-u-c001", "BNS", "1", "current")]


def test_revision_of_a_topic_of_over_999_items(spark, tmp_path):
    spark.range(1, 1102).selectExpr("id p_partkey", "'b' p_brand", "'n' p_name").write.parquet(f"{tmp_path}/part.parquet")
    audit = revision_audit(spark, str(tmp_path))
    assert {r["action"]: r["count"] for r in audit.groupBy("action").count().collect()} == {"change": 111, "retire": 110, "insert": 5 * 110}


def test_revision_leaves_parts_without_a_brand_alone(spark, tmp_path):
    spark.range(1, 61).selectExpr("id p_partkey", "if(id % 4 = 0, null, concat('b', id % 2)) p_brand", "'n' p_name").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    audit = revision_audit(spark, str(tmp_path))
    want = con.execute(f"select {', '.join(audit.columns)} from ({ORACLE['revision_audit']})").fetchall()
    assert want and sorted(map(str, want)) == sorted(str(tuple(r)) for r in audit.collect())


def test_revised_items_of_parts_without_a_brand_are_as_in_the_sql(spark, tmp_path):
    spark.range(1, 61).selectExpr("id p_partkey", "if(id % 4 = 0, null, concat('b', id % 2)) p_brand", "'n' p_name").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = QUERIES["revised_items"](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLE['revised_items']})").fetchall()
    assert want and sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("name", ["candidate_items", "revised_items", "revision_audit"])
def test_a_part_without_a_key_is_numbered_last_as_in_the_sql(spark, tmp_path, name):
    spark.range(60).selectExpr("if(id in (20, 21), null, id) p_partkey", "concat('b', id % 2) p_brand", "concat('n', id) p_name").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLE[name]})").fetchall()
    assert want and sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("name", ["candidate_items", "revised_items", "revision_audit"])
def test_over_999_items_differ_from_the_sql_by_its_cut_numbers_alone(spark, tmp_path, name):
    spark.range(1, 1402).selectExpr("id p_partkey", "if(id % 5 = 0, 'a', 'b') p_brand", "concat('n', id) p_name").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got, cut, number = QUERIES[name](spark, str(tmp_path)), ORACLE[name], "row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)"
    whole = cut.replace(f"lpad({number}::VARCHAR, 3, '0')", f"printf('%03d', {number})")
    assert whole != cut and sorted(map(str, con.execute(f"select {', '.join(got.columns)} from ({whole})").fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def test_numbers_of_over_three_digits_stay_whole(spark):
    plan = spark.range(1, 1102).selectExpr("id ord", "'t' topic", "'L1' slice", "'q' question", "'IPC' old_act", "'1' old_number", "'BNS' new_act", "'2' new_number")
    got = {r["item_id"] for r in revision.numbered_items(plan).collect()}
    assert len(got) == 1101 and {"L1-t-c001", "L1-t-c100", "L1-t-c1000", "L1-t-c1101"} <= got


def test_manifests_bind_contents_and_threshold(spark):
    pairs = spark.createDataFrame([("train", "p1", "S"), ("train", "p2", "D"), ("dev", "p3", None)], "split string, pair string, label string")
    scored = spark.createDataFrame([("dev", 0.9, 1), ("dev", 0.3, 0), ("train", 0.1, 1)], "split string, score double, gold int")
    one = revision.manifest(pairs, ["pair", "label"], scored, [0.2, 0.5, 0.8], "v1")
    assert rows(one, "split", "n", "tau", "f1") == [("dev", 1, 0.5, 1.0), ("train", 2, 0.5, 1.0)]
    assert revision.manifest_changes(one, revision.manifest(pairs.repartition(3), ["pair", "label"], scored, [0.2, 0.5, 0.8], "v1")).count() == 0
    other = revision.manifest(pairs.withColumn("label", F.when(F.col("pair") == "p2", "S").otherwise(F.col("label"))), ["pair", "label"], scored, [0.2, 0.5, 0.8], "v1")
    assert {(r["split"], r["field"]) for r in revision.manifest_changes(one, other).collect()} == {("train", "content"), ("train", "n_labels")}
    assert {(r["split"], r["field"]) for r in revision.manifest_changes(one, one.where("split = 'dev'")).collect()} >= {("train", "n"), ("train", "content")}


def test_feasibility_and_deployment(spark):
    items = spark.createDataFrame([(1, "a", 0, 0.1, 1), (2, "a", 1, 0.2, 0), (3, "b", 0, 0.2, 1), (4, "c", 0, 1.5, 1)], "item_id long, slice string, part int, u double, correct int")
    stored = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "item_id long, part int")
    assert rows(revision.feasibility(items, stored), "slice", "n", "scored", "moved", "status") == [("a", 2, 2, 1, "READY"), ("b", 1, 1, 0, "SINGLE_CLASS"), ("c", 1, 0, 1, "NO_SCORES"), ("pooled", 4, 3, 2, "READY")]
    times = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("x", None), ("x", -1.0), ("z", 9.0)], "stage string, seconds double")
    got = {r["stage"]: r for r in revision.deployment(times, ["x", "y"], 12.5).collect()}
    assert (got["x"]["n"], got["x"]["median"], got["x"]["undefined"]) == (2, 2.0, None) and (got["y"]["n"], got["y"]["median"], got["y"]["undefined"]) == (0, None, "not_instrumented")
    assert (got["memory"]["median"], got["memory"]["unit"], got["memory"]["undefined"]) == (12.5, "megabytes", None) and "z" not in got
    with pytest.raises(ValueError):
        revision.deployment(times, ["x"], float("nan"))
