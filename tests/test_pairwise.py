"""The pairwise and clustering queries against plain loops over all samples of an item."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict
from itertools import combinations

import pyarrow as pa
import pytest

from accordia.operators import agreement as A
from accordia.operators import fits
from accordia.plans import inputs
from accordia.plans.queries import QUERIES, _alike, _words

SMALL = "/root/testdata/sf0.001"


def overlap(a, b):
    x, y = (set(re.findall("[a-z0-9]+", t.lower())) for t in (a, b))
    return len(x & y) / max(len(x), len(y))


def rule(x, y):
    if "NONE" in (x, y):
        return "AMBIGUOUS"
    if x == y:
        return "SAME_PROVISION"
    return "LEGALLY_EQUIVALENT" if x.split()[1] == y.split()[1] else "CONTRADICTORY" if x.split()[0] != y.split()[0] else "DIFFERENT_PROVISION"


@pytest.fixture(scope="module")
def items(spark):
    found = defaultdict(list)
    for r in inputs.samples(spark, SMALL).orderBy("item_id", "pos").collect():
        found[r["item_id"]].append((r["key"], r["text"]))
    assert max(map(len, found.values())) > 6
    return found


def test_scores_of_all_pairs(spark, items):
    want = {(k, i, j): overlap(s[i][1], s[j][1]) for k, s in items.items() for i, j in combinations(range(len(s)), 2)}
    got = QUERIES["lexical_pairs"](spark, SMALL).collect()
    assert len(got) == len(want) and {(r["item_id"], r["i"], r["j"]): r["score"] for r in got} == pytest.approx(want, abs=1e-6)
    best = {(k, i): max((want[k, min(i, j), max(i, j)] for j in range(len(s)) if j != i), default=0) for k, s in items.items() for i in range(len(s))}
    mean = {k: sum(1 - best[k, i] for i in range(len(s))) / len(s) for k, s in items.items()}
    assert {r["item_id"]: r["selfcheck"] for r in QUERIES["selfcheck"](spark, SMALL).collect()} == pytest.approx(mean, abs=1e-6)


def test_rules_and_contradictions_of_all_pairs(spark, items):
    labels = Counter(rule(a[0], b[0]) for s in items.values() for a, b in combinations(s, 2))
    assert {r["label"]: r["n"] for r in QUERIES["rule_relations"](spark, SMALL).collect()} == labels
    want = {}
    for item, s in items.items():
        sizes = Counter(k for k, _ in s)
        modal = max(sizes, key=sizes.get)  # the first of the largest, in order of first place
        hits = Counter(b if a == modal else a for (a, _), (b, _) in combinations(s, 2) if (a == modal) != (b == modal) and rule(a, b) == "CONTRADICTORY")
        want[item] = sum(c for k, c in sizes.items() if k != modal and 2 * hits[k] >= c * sizes[modal]) / len(s)
    assert {r["item_id"]: r["mass"] for r in QUERIES["contradiction_mass"](spark, SMALL).collect()} == pytest.approx(want, abs=1e-6)


def test_clusters_of_all_samples(spark, items):
    greedy, typed = {}, {}
    for item, s in items.items():
        leaders = []
        for pos, (_, text) in enumerate(s):
            found = next((i for i, lead in enumerate(leaders) if _alike(_words(lead), _words(text)) >= 0.8), len(leaders))
            leaders += [text] * (found == len(leaders))
            greedy[item, pos] = found
        pairs = list(combinations(range(len(s)), 2))
        merged = fits.merge_typed([k for k, _ in s], {(i, j): rule(s[i][0], s[j][0]) for i, j in pairs}, {(i, j): overlap(s[i][1], s[j][1]) for i, j in pairs}, 0.5)
        typed |= {(item, pos): x for pos, x in enumerate(merged)}
    for name, want in (("greedy_clusters", greedy), ("typed_clusters", typed)):
        assert {(r["item_id"], r["pos"]): r["label"] for r in QUERIES[name](spark, SMALL).collect()} == want


def test_a_batch_of_items_takes_little_memory():
    """Of many items in a batch, only one at a time has its pairs as objects."""
    items, n = 600, 30
    samples = [{"pos": p, "key": f"A {p % 5}"} for p in range(n)]
    links = [{"i": i, "j": j, "merges": i % 5 == j % 5, "score": 0.75} for i, j in combinations(range(n), 2)]
    typed = pa.schema([("item_id", pa.int64()), ("samples", pa.list_(pa.struct([("pos", pa.int32()), ("key", pa.string())]))), ("pairs", pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("merges", pa.bool_()), ("score", pa.float64())])))])
    batch = pa.RecordBatch.from_pylist([{"item_id": k, "samples": samples, "pairs": links if k else None} for k in range(items)], typed)
    tracemalloc.start()
    out = next(fits.merge_items(iter([batch]), 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column("label").to_pylist() == [p % 5 for p in range(n)] * items
    assert out.column("item_id").to_pylist() == [k for k in range(items) for _ in range(n)]
    assert peak < 30e6


def test_selfcheck_by_texts_gives_that_by_pairs_and_shuffles_less(spark):
    draw = random.Random(4)
    texts = ["Section 1 of the Code", "section 1, of the code", "Section 2 of the Act", "another", "", "--", None]
    rows = [(draw.randrange(40), p, draw.choice(texts)) for p in range(900)] + [(50, 0, "lone"), (51, 0, None), (51, 1, None), (52, 0, "twice"), (52, 1, "twice"), (None, 0, "lost"), (None, 1, "lost")]
    s = spark.createDataFrame(rows, "item_id long, pos int, text string")
    want = {r["item_id"]: r["selfcheck"] for r in A.selfcheck(s, A.pair_scores(s)).collect()}
    assert {r["item_id"]: r["selfcheck"] for r in A.selfcheck_of_texts(s).collect()} == pytest.approx(want, abs=1e-12)
    assert len(want) == 44 and want[50] == want[51] == want[None] == 1 and want[52] == 0
    total = lambda: sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = total()
    assert QUERIES["selfcheck"](spark, SMALL).count() == 200
    assert total() - before < 30 * 6000  # a few bytes a sample, none a pair
