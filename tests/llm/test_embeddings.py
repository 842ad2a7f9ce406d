import numpy as np
import pytest

from accordia.llm import embed_dup
from accordia.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, cls long, id string"


def brute(rows):
    good, out = [], {}
    for k, (i, v, label) in enumerate(rows):
        out[k] = [i, 0, i]
        x = None if v is None or any(c is None for c in v) else np.array(v, float)
        if x is not None and len(x) and label is not None and np.isfinite(x).all() and np.abs(x).max() > 0:
            x = x / np.abs(x).max()
            good.append((k, x / np.linalg.norm(x), label))
    links = [(a, b) for n, (a, x, p) in enumerate(good) for b, y, q in good[:n] if p == q and len(x) == len(y) and x @ y >= 0.98]
    for a, b in links:
        out[a][1] += 1
        out[b][1] += 1
    for _ in rows:
        for a, b in links:
            out[a][2] = out[b][2] = min(out[a][2], out[b][2])
    return sorted(map(tuple, out.values()), key=str)


@pytest.mark.parametrize("cut", [1024, 5])
def test_links_against_brute_force(spark, cut):
    draw = np.random.default_rng(3)
    rows = []
    for g in range(40):
        base = draw.normal(size=24)
        for _ in range(int(draw.integers(1, 20))):
            v = base + draw.normal(size=24) * draw.choice([0.0, 0.05, 0.12, 0.2])
            rows.append((len(rows) * 3 % 1009, (v * draw.choice([1.0, 2.0])).tolist(), int(g % 3)))
    # Ids shared by other vectors, under the same label and under others.
    rows += [(rows[k][0], rows[k + 9][1], int(label)) for k in range(0, 90, 10) for label in (rows[k][2], (rows[k][2] + 1) % 3)]
    rows += [(5000, None, 1), (5001, [0.0] * 24, 1), (5002, [1.0, None], 1), (5003, [float("nan")] * 24, 1), (5004, [float("inf")] * 24, 1), (5005, [], 1), (5006, rows[0][1], None), (5007, [1.0, 2.0], 1), (5008, [1.0, 2.0], 1), (5009, [1e300] * 24, 1), (5010, [1e-300] * 24, 1), (5008, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dup.near_vectors(df, cut=cut).collect()), key=str)
    assert got == brute(rows)


def test_an_id_under_two_labels_links_by_each(spark):
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, one, 1), (5, two, 2), (7, [1.0, 0.01, 0.0], 1), (3, [0.01, 1.0, 0.0], 2)]
    got = embed_dup.near_vectors(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(3, 1, 3), (5, 1, 3), (5, 1, 5), (7, 1, 5)]


def test_rare_sizes_are_one_list(spark):
    draw = np.random.default_rng(8)
    rows = [(k, draw.normal(size=3 + k % 5).tolist(), 1) for k in range(60)]
    rows += [(100 + i, v, 1) for i, v, _ in rows[:9]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dup.near_vectors(df, cut=4, most_sizes=1).collect()), key=str)
    assert got == brute(rows)


def test_pivots_are_apart_and_nearest_ones_are_found():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(700, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = embed_dup.spread_out(x, 90)
    assert len(p) <= 90 and (p @ p.T > embed_dup.PIVOT_COSINE).sum() == len(p)
    assert np.array_equal(embed_dup.nearest_pivots(x, p, 7), np.sort(np.argsort(-(x @ p.T), axis=1)[:, :7], axis=1))


def test_small_table_and_empty_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in QUERIES["op9_embedding_near_dup"](spark, SMALL).collect()), key=str)
    assert got == brute(rows)
    assert embed_dup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_on_the_larger_table(spark):
    d = "/root/testdata/sf0.1"
    got = {r["vec_id"]: r["n_links"] for r in QUERIES["op9_embedding_near_dup"](spark, d).collect()}
    by = {}
    for r in spark.read.parquet(f"{d}/embeddings.parquet").collect():
        by.setdefault(r["label"], []).append((r["vec_id"], r["embedding"]))
    true = 0
    for rows in by.values():
        x = np.array([v for _, v in rows], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        true += int((x @ x.T >= 0.98).sum()) - len(rows)
    assert sum(got.values()) <= true and sum(got.values()) >= 0.9 * true
