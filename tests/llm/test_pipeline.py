import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_ops import brute_components, brute_leaks, library, plain_language, plain_taken, sets

import corpus_pipeline
from accordia.llm import common, langid, mixing

SMALL = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        seen.append(name)
        before = docs
        docs = common.materialize(stage(spark, before, SMALL), name)
        if name != "token_output":
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert seen == ["language_id", "near_duplicates", "decontamination", "source_mixing", "token_output"]
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and docs.count() == before.count()
    ordered = docs.orderBy("start").collect()
    assert [r["start"] for r in ordered] == [sum(r["n_tokens"] for r in ordered[:i]) for i in range(len(ordered))]


def test_run_gives_the_same_rows_again(spark):
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) for _ in range(2))
    assert one == two and one


@pytest.fixture(scope="module")
def by_loops(spark):
    """What each stage keeps of the small table's documents, by plain loops over its predecessor's, as lists of rows."""
    read = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet")
    docs, out = read("documents"), []
    rows = docs.orderBy("doc_id").collect()
    found = plain_language(langid.fit(docs), [(r["text"], None, r["source"], None) for r in rows])
    out.append(rows := [r for r, (*_, kept) in zip(rows, found) if kept])
    smallest = brute_components([r["doc_id"] for r in rows], sets([r["text"] for r in rows], 5), 80)
    out.append(rows := [r for r in rows if smallest[r["doc_id"]] == r["doc_id"]])
    leaks = {d for d, _ in brute_leaks([(r["doc_id"], r["text"]) for r in rows], [(r["item_id"], r["text"]) for r in read("benchmark").collect()])}
    out.append(rows := [r for r in rows if r["doc_id"] not in leaks])
    taken = {i: n for (i, _), n in plain_taken(mixing.mix(spark.createDataFrame(rows, docs.schema))).items()}
    size = lambda r: len("".join(" " if c in "\t\n\v\f\r" else c for c in r["text"] or "").split(" ")) - "".join(" " if c in "\t\n\v\f\r" else c for c in r["text"] or "").split(" ").count("")
    out.append(rows := [r for r in rows if size(r) for _ in range(int(taken[r["doc_id"]] / size(r) + 0.5))])
    tokenizer, start, tokens = library(), 0, []
    for r in rows:
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        tokens.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return [*out, tokens]


def test_each_stage_keeps_what_loops_keep(spark, by_loops):
    docs, sizes = spark.read.parquet(f"{SMALL}/documents.parquet"), [200]
    for (name, stage), want in zip(corpus_pipeline.STAGES, by_loops):
        docs = common.materialize(stage(spark, docs, SMALL), name)
        assert sorted(tuple(r) for r in docs.collect()) == sorted(map(tuple, want)), name
        sizes.append(len(want))
    assert sizes[1] <= sizes[0] and sizes[3] < sizes[2] < sizes[1]


def test_run_gives_what_loops_give(spark, by_loops):
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(by_loops[-1])


def test_odd_rows_by_stage(spark):
    """Nulls, empty texts, repeated rows, shared ids and other columns: what each stage keeps of them."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ten = docs.orderBy("doc_id").limit(10)
    first = ten.first()
    odd = ten.unionByName(ten.limit(1)).unionByName(spark.createDataFrame([(None, first["text"], None, None, None), (None, None, None, None, None), (-1, "", None, None, 0), (-2, None, "xx", "y", None), (-3, "\t ", "en", None, 2)], docs.schema))
    odd = odd.withColumn("kept", F.lit(1)).withColumn("id", F.lit("a")).withColumn("_h", F.lit("b"))
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda rows: sorted((r["doc_id"] for r in rows.collect()), key=str)
    every = [r["doc_id"] for r in ten.collect()]
    named = common.materialize(stages["language_id"](spark, odd, SMALL), "language_id")
    assert named.columns == odd.columns and ids(named) == sorted([*every, first["doc_id"], None, None], key=str)
    unlike = stages["near_duplicates"](spark, odd, SMALL)
    assert unlike.columns == odd.columns and ids(unlike).count(None) == 2 and {-1, -2, -3} <= set(ids(unlike)) and ids(unlike).count(first["doc_id"]) == 2
    clean = stages["decontamination"](spark, odd, SMALL)
    assert clean.columns == odd.columns and {-1, -2, -3, None} <= set(ids(clean))
    mixed = stages["source_mixing"](spark, odd, SMALL)
    assert mixed.columns == odd.columns and not {-1, -2, -3} & set(ids(mixed)) and mixed.where("text is null").count() == 0
    tokens = stages["token_output"](spark, odd, SMALL)
    assert tokens.count() == odd.count() and tokens.where("n_tokens = 1").count() == 3


def test_stages_stand_odd_and_empty_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = docs.limit(20).unionByName(docs.limit(2)).unionByName(spark.createDataFrame([(None, None, None, None, None), (-1, "", None, None, 0), (-2, None, "xx", "y", None)], docs.schema)).withColumn("kept", F.lit(1)).withColumn("id", F.lit("a"))
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = common.materialize(stage(spark, rows, SMALL), "stage")
    assert rows.count() == 0
