import itertools
import math
import os
import random
import re
import subprocess
import sys
import tempfile
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from accordia.llm import chat, common, decontaminate, langid, mixing, near_dup, quality, substring, token_out, url_filter
from accordia.llm.queries import ORACLE, QUERIES, TOKENIZER, URL_RULES
from accordia.llm.url_filter import Rule

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, part int, kept boolean, gone long"


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("bcdfgklmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 4))) for _ in range(n))


def rows(texts, first=0):
    return [(first + i, t, "en", "s", 1, 7, "x", 3, True, 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named as the operators' own."""
    long = prose(1, 150_000)
    made = [*rows(["", None, "one", "one", prose(2, 40), prose(2, 40), long, " \t\n", "é" * 50]), (4, prose(2, 40), None, None, None, None, None, None, None, None), (None, "x y", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(made, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def sets(texts, n):
    out = []
    for t in texts:
        w = WORD.findall((t or "").encode().lower())
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def brute_components(ids, found, percent):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for j in range(i):
            x, y = found[i], found[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(ids[j])
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def test_words_hash_alike_wherever_they_stand():
    data = b"One two\xc3\xa9 one\x0bTWO\xc3\xa9  x" * 3
    found = common.words(np.frombuffer(data, np.uint8), np.array([0, 0, len(data), len(data)]))
    said = WORD.findall(data.lower())
    assert len(found.hash) == len(said) and len(set(found.hash.tolist())) == len(set(said))
    assert {w: h for w, h in zip(said, found.hash.tolist())} == {w: h for w, h in zip(reversed(said), reversed(found.hash.tolist()))}
    assert set(found.text.tolist()) == {1}


@pytest.mark.parametrize("bound", [1 << 20, 3])
def test_components_of_chains_stars_and_loops(spark, bound):
    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(20)] + [(draw.randint(200, 260), draw.randint(200, 260)) for _ in range(40)] + [(5, 5), (0, 1)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "u long, v long"), bound).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    up = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert {n: got.get(n) for n in nodes} == up


def test_union_find_without_edges():
    node, root = common.union_find(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert not len(node) and not len(root)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot, least_hot", [(1 << 14, 1 << 14), (3, 5), (1 << 14, 0)])
def test_spread_joins_give_plain_joins(spark, monkeypatch, how, hot, least_hot):
    monkeypatch.setattr(common, "HOT", hot)
    draw = random.Random(6)
    rows_ = [(i, draw.choice(["a"] * 40 + ["b", "c", "d", None, "x"]), 1) for i in range(900)]
    n = Counter(k for _, k, _ in rows_)
    table = spark.createDataFrame([(k, n[k], f"v{k}") for k in "abcde"], "its string, n long, v string")
    got = common.join_spread(spark.createDataFrame(rows_, "id long, key string, salt int"), "key", table, "its", "n", ["id"], how, least_hot)
    assert got.columns == ["id", "key", "salt", "v"]
    want = [(i, k, s, f"v{k}" if k in list("abcde") else None) for i, k, s in rows_ if how == "left" or k in list("abcde")]
    assert sorted(map(tuple, got.collect())) == sorted(want)


# URL filters
@pytest.mark.parametrize("fpp, most_bits", [(None, url_filter.MAX_FILTER_BITS), (0.5, url_filter.MAX_FILTER_BITS), (1e-9, 64)])
def test_urls_by_one_cascade_and_by_several(spark, fpp, most_bits):
    urls = [f"http://{h}{p}" for h in ("a.example.com", "example.com", "x.com", "EXAMPLE.net", "b.c.example.net", "org", "xorg", ".com", "") for p in ("", "/", "/en/", "/en/7a?x", "/de/8#y", "/es/", "/en")]
    urls += [None, "", "no scheme", "http://", "a://b://c/en/", "http://é.com/en/ü", "http://example.com/en/7", "http://example.com/en/7"]
    df = spark.createDataFrame([(i, u, "mine", "other", 5) for i, u in enumerate(urls)], "page_id long, url string, host string, key string, row long")
    # With filters of no use at all, level follows level; with little room for them, the list is dealt out.
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["key"]) for r in url_filter.judge_urls(df, URL_RULES, first_fpp=fpp, max_bits=most_bits).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("(/[^?#]*)?", rest[len(host) :])[0]
            host = "".join(c.lower() if c.isascii() else c for c in host)
        best = best_rule(URL_RULES, host, path)
        assert got[i] == (host, path, best and best.host + best.path, best.verdict if best else "allow", "other"), u
    assert len(got) == len(urls)


def test_verdicts_of_the_rules_of_the_contract(spark, tmp_path):
    urls = {"http://x.net/de/1": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://a.example.net/de/8": ("example.net/de/8", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://b.com/en/7": ("com/en/", "block"), "http://b.org/es/": ("org/es/", "block"), "http://b.org/de/": (None, "allow")}
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in QUERIES["op1_url_filter"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(urls.values()))


def best_rule(rules, host, path):
    fit = [r for r in rules if (host == r.host.lower() or host.endswith("." + r.host.lower())) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.host) + len(r.path), len(r.host)), default=None)


@pytest.mark.parametrize("most_bits", [url_filter.MAX_FILTER_BITS, 64])
def test_rules_without_slash_in_upper_case_or_with_an_empty_path(spark, most_bits):
    """Host and path do not run into each other: a rule for `ab.co` and `m/` says nothing of `ab.com/`."""
    rules = [Rule("block", "ab.co", "m/"), Rule("block", "zz.org", "/"), Rule("block", "LOUD.com", "/X"), Rule("allow", "a.loud.COM", ""), Rule("block", "bare.net", ""), Rule("block", "bare.net", "/a#b"), Rule("block", "q.de", "/#"), Rule("allow", "bare.net", "/ok")]
    urls = ["http://ab.com/x", "http://ab.co/m/", "http://ab.com", "http://zz.org/m/", "http://loud.com/X1", "http://LOUD.COM/x", "http://b.a.Loud.com/Xy", "http://bare.net", "http://x.bare.net/q", "http://bare.net/a#b", "http://bare.net/okay", "http://q.de/#", "http://q.de/", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for r in url_filter.judge_urls(df, rules, max_bits=most_bits).collect():
        best = best_rule(rules, r["host"], r["path"])
        assert (r["rule"], r["verdict"]) == ((best.host.lower() + best.path, best.verdict) if best else (None, "allow")), r


def test_the_words_of_a_level_are_in_a_plan_once(spark):
    level = url_filter.Level(128, 9, [123456789012345, 5], 0)
    plan = spark.range(3).select(level.passes(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("123456789012345") == 1, plan


def test_urls_without_a_checkpoint_folder():
    code = """
from pyspark.sql import SparkSession
from accordia.llm import url_filter
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
s.sparkContext.getConf()
assert not s.conf.get("spark.checkpoint.dir", "")
d = s.createDataFrame([("http://a.com/en/1",)], "url string")
assert url_filter.judge_urls(d, [url_filter.Rule("block", "com", "/en/")]).first()["verdict"] == "block"
"""
    with tempfile.TemporaryDirectory() as empty_conf:
        run = subprocess.run([sys.executable, "-c", code], env=os.environ | {"SPARK_CONF_DIR": empty_conf, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}, capture_output=True, timeout=240, text=True)
    assert run.returncode == 0, run.stderr[-2000:]


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{i}" for i in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = url_filter.make_cascade(df.limit(200), df, 0.3)
    assert len(cascade.levels) > 2
    listed = {r[0] for r in df.limit(200).collect()}
    assert {r[0] for r in df.where(cascade.contains(F.col("key"))).collect()} == listed


def test_url_rules_that_clash_and_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(none, URL_RULES).columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert not url_filter.judge_urls(none, URL_RULES).count()
    with pytest.raises(ValueError):
        url_filter.judge_urls(none, [Rule("block", "com", "/"), Rule("allow", "COM", "/")])
    one = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert url_filter.judge_urls(one, []).first()["verdict"] == "allow"


# Mixing
def test_targets_fill_up_to_the_cap(spark):
    sizes = {"a": 100, "b": 1000, "c": 5, "d": 3000, None: 40, "é": 0}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame([*sizes.items()], "source string, source_size long")).collect()}
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, free, left = {}, set(order), float(sum(sizes.values()))
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s] + 1e-9]:
        for s in over:
            want[s] = 3.0 * sizes[s]
        left -= sum(want[s] for s in over)
        free -= set(over)
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_comes_near_its_targets_and_repeats_itself(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    one, two = ({(r["id"], r["taken"]) for r in mixing.mix(x).documents.collect()} for x in (d, d.repartition(7)))
    assert one == two
    m = mixing.mix(d)
    for r in m.documents.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"), F.sum("size").alias("s"), F.first("source_size").alias("ss")).collect():
        assert abs(r["t"] - r["g"]) <= max(20, 0.01 * r["g"]) and r["over"] <= 0 and r["s"] == r["ss"]
    # The schedule against the sequence and the blocks by hand.
    ranges = [(r["source"], r["low"], r["high"]) for r in m.sources.collect()]
    plan = m.schedule.orderBy("slot").collect()
    seen = {}
    by_slot = {r["slot"]: r for r in plan}
    for k in range(2000):
        x = k * mixing.GOLDEN % (1 << mixing.RANGE_BITS)
        s = next(s for s, lo, hi in ranges if lo <= x < hi)
        if k in by_slot:
            assert by_slot[k]["source"] == s and by_slot[k]["rank"] == seen.get(s, 0)
        seen[s] = seen.get(s, 0) + 1
    assert mixing.mixed_documents(d).columns == d.columns


def plain_taken(m):
    """(id, order) -> words taken, from the documents' order, blocks of the sources and points of the sequence alone."""
    sources, docs = m.sources.collect(), m.documents.collect()
    ranks, times, out = Counter(), Counter(), {}
    for k in range(round(sum(r["slots"] for r in sources))):
        x = k * mixing.GOLDEN % (1 << mixing.RANGE_BITS)
        r = next(r for r in sources if r["low"] <= x < r["high"])
        if ranks[r["source"]] < 3 * r["blocks"]:
            times[r["source"], ranks[r["source"]] % r["blocks"]] += 1
        ranks[r["source"]] += 1
    for r in sources:
        least, longer = divmod(r["source_size"], max(1, r["blocks"]))
        block_of = [b for b in range(r["blocks"]) for _ in range(least + (b < longer))]
        at = 0
        for d in sorted((d for d in docs if d["source"] == r["source"]), key=lambda d: (d["_order"] % (1 << 64) >> 33, d["_order"], d["id"])):
            out[d["id"], d["_order"]] = sum(times[r["source"], b] for b in block_of[at : at + d["size"]])
            at += d["size"]
    return out


def test_words_taken_against_the_schedule_by_hand(spark):
    got = {r["doc_id"]: r["taken"] for r in QUERIES["op2_source_mixing"](spark, SMALL).collect()}
    want = plain_taken(mixing.mix(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source")))
    assert got == {i: n for (i, _), n in want.items()} and sum(want.values()) > 0


def test_small_sources_beside_a_large_one_come_near_their_targets(spark):
    # As with billions of words, the large source makes a block longer than the small sources' documents together.
    texts = [("tiny", 5), ("tiny", 2), ("small", 900), ("small", 1100), ("little", 4_000), ("little", 5_000)] + [("huge", 1_500_000)] * 20
    rows = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(texts)], "doc_id long, source string, n int").repartition(8)
    d = rows.withColumn("text", F.expr("repeat('w ', n)"))
    documents = mixing.mix(d).documents.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert len(documents) == 4
    for r in documents:
        assert abs(r["taken"] - r["target"]) <= max(4, 0.01 * r["target"]), r
    assert {r["source"] for r in mixing.mixed_documents(d).select("source").distinct().collect()} == {"tiny", "small", "little", "huge"}


def test_mix_of_odd_rows(spark, odd):
    m = mixing.mix(odd).documents
    assert m.count() == odd.count() and m.where("size = 0 and taken <> 0").count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.count() > 0
    assert mixing.mix(empty(spark)).documents.count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


# Decontamination
PART = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def parted(t):
    return PART.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def grams(w, n=5):
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_leaks(docs, items):
    """Every passage of every text against every item by the share of question's and answer's shingles."""
    out = set()
    for item, t in items:
        whole = parted(t)
        if not whole:
            continue
        q, a = (parted(x.decode()) or whole for x in decontaminate.split_item(t.encode()))
        stride = max(16, 1 << (len(whole) - 1).bit_length())
        for doc, text in docs:
            w = parted(text)
            if not set(w) & set(whole):
                continue
            for first in range(0, len(w), stride):
                passage = w[first : first + 2 * stride]
                if all(len(grams(x) & grams(passage, min(5, len(x)))) >= 0.8 * len(grams(x)) for x in (q, a)):
                    out.add((doc, item))
                    break
    return out


def test_leaks_against_brute_force(spark):
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op3_benchmark_decontamination"](spark, SMALL).collect()}
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_leaks([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got == want and want


def test_items_of_one_template_are_found_without_their_rare_words(spark):
    """300 items share 33 words; each has a rare word at both ends, which is half of its score. Leaks lose words of all kinds."""
    template, draw = prose(77, 33).split(), random.Random(4)
    items = [(i, " ".join([f"first{i}", *template, f"last{i}"]) + (f". {prose(900 + i, 4)} answer{i}" if i % 2 else "")) for i in range(300)]
    docs = []
    for d in range(120):
        w = items[d][1].split()
        if d % 4 == 0:
            w = w[:-1]
        elif d % 4 == 1:
            w[draw.randrange(len(w))] = "other"
        elif d % 4 == 2:
            w = w[1:-1]
        docs.append((d, prose(5000 + d, d % 40) + " " + " ".join(w) + " " + prose(7000 + d, 30)))
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    want = brute_leaks(docs, items)
    assert got == want and {(d, d) for d in range(0, 120, 4)} <= want and len(want) > 2000


def test_question_and_answer_apart(spark):
    question, answer = prose(1, 20), prose(2, 10)
    docs = [(gap, f"{prose(100 + gap, 7)} {question}. {prose(200 + gap, gap)} {answer}") for gap in range(0, 80, 2)]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, f"{question}. {answer}")], "item_id long, text string"))
    got = {r["doc_id"] for r in found.collect()}
    assert {d for d, _ in brute_leaks(docs, [(1, f"{question}. {answer}")])} == got
    assert {0, 2} <= got and not any(gap >= 64 - 22 for gap in got)  # 30 words: windows of 64, and shares of 0.8


def test_most_lost_against_all_choices():
    draw = random.Random(3)
    parts = [np.array([draw.randrange(1, 9) if k % 3 else draw.randrange(1, 3) for _ in range(draw.randint(1, 13))], np.uint64) for k in range(120)]
    weights = [np.array([draw.random() for _ in p]) for p in parts]
    for overlap in (0.8, 0.5):
        got = decontaminate.most_lost(parts, weights, 3, overlap)
        for p, w, g in zip(parts, weights, got):
            order = decontaminate.shingles_in_order(p, 3).tolist()
            n, distinct = min(3, len(p)), sorted(set(order))
            want = 0.0
            for k in range(len(distinct) + 1):
                if len(distinct) - k >= overlap * len(distinct) - 1e-9:
                    for gone in itertools.combinations(distinct, k):
                        over = [{order[j] for j in range(max(0, i - n + 1), min(i, len(order) - 1) + 1)} for i in range(len(p))]
                        want = max(want, sum(x for x, o in zip(w, over) if o <= set(gone)))
            assert g >= want - 1e-9 and (g == pytest.approx(want) or len(distinct) < len(order))


def test_retrieval_equals_plain_scores(monkeypatch):
    items = [(i, prose(i, 20 + i % 30).encode()) for i in range(60)]
    texts = [(prose(100 + i, 200) + " " + items[i][1].decode() + " " + prose(300 + i, 90)).encode() for i in range(12)] + [b"", b"a"]
    w = common.words(*utf8([t.decode() for t in texts]), common.PUNCTUATION)
    seen = 0
    for retrieve, held in ((0.3, 1 << 22), (0.3, 50), (None, 1 << 22)):
        monkeypatch.setattr(decontaminate, "HELD", held)
        for index in decontaminate.make_indexes(items, retrieve=retrieve):
            got = {(t, s, e, i): v for t, s, e, i, v in decontaminate.search(index, w.text, w.hash)}
            want = {}
            posting_word = np.repeat(np.arange(len(index.vocabulary)), index.posting_at[index.block_at[1:]] - index.posting_at[index.block_at[:-1]])
            for t in range(len(texts)):
                at = np.flatnonzero(w.text == t)
                for first in range(0, len(at), index.stride):
                    passage = at[first : first + 2 * index.stride]
                    terms = np.flatnonzero(np.isin(index.vocabulary, w.hash[passage]))
                    for i in range(len(index.items)):
                        v = index.weight[(index.item == i) & np.isin(posting_word, terms)].sum()
                        if v >= 1 - 1e-10:
                            want[t, int(passage[0]), int(passage[-1]) + 1, i] = v * index.threshold[i]
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
            seen += len(want)
    assert seen > 20


def test_leaks_of_odd_rows_and_shards(spark, odd):
    items = spark.createDataFrame([(1, prose(2, 40)), (2, None), (3, ""), (1, "one")], "item_id long, text string")
    one = sorted(map(tuple, decontaminate.find_leaks(odd, items).select("doc_id", "item_id").collect()), key=str)
    assert (4, 1) in one and (2, 1) in one and not any(i in (2, 3) for _, i in one)
    two = sorted(map(tuple, decontaminate.find_leaks(odd, items, shard_bytes=10).select("doc_id", "item_id").collect()), key=str)
    assert set(one) == set(two)
    left = decontaminate.decontaminate(odd, items)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} == {0, 1, 6, 7, 8, None}
    assert decontaminate.find_leaks(empty(spark), items).count() == 0 and decontaminate.find_leaks(odd, items.limit(0)).count() == 0


# Near-duplicates
def near_copies():
    texts, draw = [], random.Random(9)
    for g in range(12):
        base = prose(g, 60).split()
        for _ in range(draw.choice([1, 2, 9])):
            w = base[:]
            for _ in range(draw.randint(0, 9)):
                w[draw.randrange(len(w))] = prose(draw.random(), 1)
            texts += [" ".join(w)] * draw.choice([1, 1, 2])
    return texts + ["", None, "a", "A", "a b", "the the the the", " "]


@pytest.mark.parametrize("cut", [1024, 3])
@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_against_brute_force(spark, n, cut):
    texts = near_copies()
    ids = random.Random(3).sample(range(10_000), len(texts))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in zip(ids, texts)], "doc_id long, text string, cls int, label int")
    found = sets(texts, n)
    want = brute_components(ids, found, 80)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(df, shingle=n, cut=cut).collect()}
    assert {i: got[i]["component_id"] for i in ids} == want
    assert [got[i]["n_shingles"] for i in ids] == [len(s) for s in found] and all(got[i]["kept"] == (want[i] == i) for i in ids)


@pytest.mark.parametrize("cut", [1024, 3])
def test_rows_that_share_an_id_are_judged_each_by_its_text(spark, cut):
    texts = near_copies()
    draw = random.Random(8)
    ids = [draw.randrange(len(texts) // 3) for _ in texts]
    found = sets(texts, 2)
    up = [*range(len(texts))]

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(found):
        for j, y in enumerate(found[:i]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[top(i)] = top(j)
    least = {}
    for i in range(len(texts)):
        least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    want = sorted((ids[i], len(found[i]), least[top(i)]) for i in range(len(texts)))
    df = spark.createDataFrame([*zip(ids, texts)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, shingle=2, cut=cut).collect()) == want


def test_two_texts_of_an_id_have_each_their_near_copies(spark):
    a, b = prose(1, 60), prose(2, 60)
    df = spark.createDataFrame([(5, a), (5, b), (9, a + " x"), (11, b + " x"), (4, b + " y")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect())
    assert got == [(4, 4, True), (5, 4, False), (5, 5, True), (9, 5, False), (11, 4, False)]


def test_pairs_at_the_threshold_are_found_in_the_larger_table(spark):
    """Recall of linked pairs of different texts against brute force over all documents of sf0.01, by an inverted index."""
    rows_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    found = sets([r["text"] for r in rows_], 5)
    ids = [r["doc_id"] for r in rows_]
    by = {}
    for k, s in enumerate(found):
        for x in s:
            by.setdefault(x, []).append(k)
    near = Counter((i, j) for who in by.values() for i, j in itertools.combinations(who, 2))
    up = {k: k for k in range(len(ids))}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, j), n in near.items():
        if 100 * n >= 80 * (len(found[i]) + len(found[j]) - n):
            up[top(i)] = top(j)
    least = {}
    for k, i in enumerate(ids):
        least[top(k)] = min(least.get(top(k), i), i)
    want = {i: least[top(k)] for k, i in enumerate(ids)}
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows_)).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_small_documents_near_duplicates(spark):
    rows_ = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    ids, texts = [r[0] for r in rows_], [r[1] for r in rows_]
    want = brute_components(ids, sets(texts, 2), 80)
    assert {r["doc_id"]: r["component_id"] for r in QUERIES["op4_minhash_near_dup"](spark, SMALL).collect()} == want


def test_bound_keeps_pairs_at_the_threshold():
    for n, least in near_dup.least_matches(0.8, 1024, 1e-4):
        draws = np.random.default_rng(1).binomial(n, 0.8 + 0.2 / 256, 50_000)
        assert (draws < least).mean() < 1e-3 and least > 0.5 * n


def test_near_duplicates_of_odd_rows(spark, odd):
    got = near_dup.near_duplicates(odd)
    assert got.count() == odd.count() and got.where("kept is null").count() == 0
    by = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert by[3] == 2 and by[5] == 4 and by[0] == 0 and by[1] == 1 and by[7] == 7
    left = near_dup.deduplicate(odd)
    assert left.columns == odd.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["0", "1", "2", "4", "4", "6", "7", "8", "None"]
    assert near_dup.near_duplicates(empty(spark)).count() == 0


# Chat
def test_chats_read_back_as_they_were(spark):
    texts = ["", None, "\\", "\\b", "<turn>", "</turn>", "### user: <turn>x</turn>\n", "#h\\l<", "plain", "é😀\n", "\\### Assistant: </turn> ok", ": <turn>"]
    draw = random.Random(2)
    made = [(c, t if draw.random() < 0.9 else None, draw.choice(["user", "assistant", "assistant", None, "a: <b#\\", ""]), draw.choice(texts), "x") for c in [*range(30), None] for t in range(draw.randint(1, 9))]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string, turns string")
    out = {r["conv"]: r for r in chat.read_chats(chat.format_chats(df.repartition(5))).collect()}
    for c in {m[0] for m in made}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for k, t, r, x, _ in made if k == c))
        assert [(t["role"], t["text"]) for t in out[c]["turns"]] == [(r, x) for _, r, x in turns]
        assert out[c]["loss_text"] == "".join(x for _, r, x in turns if r == "assistant")
    runs = chat.format_chats(df.where("conv_id = 3")).first()["formatted"]
    assert runs.count(chat.HEAD) <= sum(1 for m in made if m[0] == 3)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_a_conversation_of_many_turns_and_long_texts(spark):
    draw = random.Random(7)
    made = [(1, t, draw.choice(["user", "assistant"]), draw.choice(["é<#\\ ", "a", "", "word "]) * draw.randint(0, 9)) for t in range(12_000)]
    made += [(2, t, "assistant", "x<é" * 120_000 + str(t)) for t in range(5)] + [(3, 0, "user", "y" * 300_000), (4, 0, "assistant", "")]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").repartition(4)
    out = {r["conv"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for c in (1, 2, 3, 4):
        turns = [(r, x) for k, _, r, x in made if k == c]
        assert [(t["role"], t["text"]) for t in out[c]["turns"]] == turns
        assert out[c]["loss_text"] == "".join(x for r, x in turns if r == "assistant")


def test_adjacent_turns_of_a_role_share_a_head(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).first()
    assert got["formatted"] == "### user: <turn>a</turn>\n### assistant: <turn>b</turn><turn>c</turn><turn>c</turn>\n"
    assert [got["formatted"][s["begin"] : s["end"]] for s in got["loss_spans"]] == ["b", "c", "c"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_gives_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    want = sorted(map(str, (tuple(r) for r in cur.fetchall())))
    assert sorted(str(tuple(r[c] for c in columns)) for r in QUERIES[name](spark, SMALL).collect()) == want


# Quality
def test_quality_tells_held_out_labels_apart(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    good = "quality = 1 and toxic = 0"
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.importance_sample(d, train.where(good), quality.good_share(train, good)).join(test, "doc_id")
    share = {(r[0], r[1]): r[2] for r in got.groupBy(F.expr(good).alias("g"), F.expr("quality = 0").alias("b")).agg(F.avg(F.col("kept").cast("int"))).collect()}
    assert share[True, False] > 0.93 and share[False, True] < 0.1


def test_held_out_ranking_by_the_plain_ratio(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    good = "quality = 1 and toxic = 0"
    train = labels.where("doc_id % 2 = 0")
    got = quality.importance_sample(d, train.where(good), quality.good_share(train, good)).join(labels.where("doc_id % 2 = 1"), "doc_id").select("log_weight", F.expr(good).alias("good"), "toxic", "kept").collect()
    order = sorted(got, key=lambda r: r["log_weight"])
    rank = sum(i for i, r in enumerate(order) if r["good"])
    p = sum(r["good"] for r in got)
    assert (rank - p * (p - 1) / 2) / (p * (len(got) - p)) > 0.95
    toxic = [r["kept"] for r in got if r["toxic"]]
    assert sum(toxic) < 0.25 * len(toxic)


def test_quality_query_against_loops(spark):
    got = {r["doc_id"]: r for r in QUERIES["op6_importance_quality"](spark, SMALL).collect()}
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    good = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()}
    grams_, mask = {}, (1 << quality.BUCKET_BITS) - 1
    for r in docs.collect():
        h = common.words(*utf8([r["text"] or ""])).hash.tolist()
        pair = [int(common.mix64(np.array([(a * 0x9E3779B97F4A7C15 + b) % (1 << 64)], np.uint64))[0]) for a, b in zip(h[:-1], h[1:])]
        grams_[r["doc_id"]] = [Counter(x & mask for x in h), Counter(x & mask for x in pair)]
    weight = Counter()
    for order, s in ((0, 3.0), (1, 300.0)):
        raw, target = Counter(), Counter()
        for i, g in grams_.items():
            raw.update(g[order])
            if i in good:
                target.update(g[order])
        scale = sum(target.values()) / sum(raw.values())
        ratio = {x: math.log((target[x] + s) / (n * scale + s)) for x, n in raw.items()}
        for i, g in grams_.items():
            weight[i] += sum(n * ratio[x] for x, n in g[order].items())
    noise = {r["doc_id"]: r["g"] for r in docs.select("doc_id", quality.gumbel(F.xxhash64(F.lit(0), "doc_id")).alias("g")).collect()}
    assert all(got[i]["log_weight"] == pytest.approx(weight[i], abs=1e-3) and got[i]["n_grams"] == sum(sum(x.values()) for x in g) for i, g in grams_.items())
    k = round(len(grams_) * len(good) / labels.count())
    assert {i for i, r in got.items() if r["kept"]} == set(sorted(grams_, key=lambda i: -weight[i] - noise[i])[:k])


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(quality, "BAND_ROWS", 64)
    draw = random.Random(1)
    made = [(i, round(draw.gauss(0, 1), 2), draw.randrange(5)) for i in range(3000)]
    df = common.materialize(spark.createDataFrame(made, "id long, score double, draw long"), "scores")
    for k in (0, 1, 700, 2999, 3000, 5000):
        want = {x[0] for x in sorted(made, key=lambda x: (-x[1], x[2], x[0]))[:k]}
        assert {r["id"] for r in df.where(quality.top_k(df, k, "score", ["draw", "id"])).collect()} == want


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (None, 1), (99, 1)], "doc_id long, quality int")
    got = quality.importance_sample(odd, labels, 0.5, bits=10)
    assert got.count() == odd.count() and got.where("kept is null or log_weight is null").count() == 0
    assert quality.importance_sample(odd, labels.limit(0), 1.0, bits=10).where("not kept or log_weight <> 0").count() == 0
    assert quality.importance_sample(empty(spark), labels, 0.5, bits=10).count() == 0


# Language
def test_language_of_held_out_texts_and_pages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = langid.fit(d.where("doc_id % 2 = 0"), sample=60)
    test = d.where("doc_id % 2 = 1")
    got = langid.identify(test, models).join(test.select("doc_id", F.col("lang").alias("said")), "doc_id")
    assert got.where("kept").count() == test.count() and got.where("lang = said").count() >= 0.99 * test.count()
    # Short texts follow the other evidence, and only those.
    pages = spark.createDataFrame([(i, t, g, h, "de") for i, (t, g, h) in enumerate([("ich", "de-AT", "a.b.de"), ("a", "de", "a.b.de"), ("e", None, "c.b.de"), ("die und der ist nicht", "fr", None), ("123 !!", "de", "a.b.de")] * 20)], "doc_id long, text string, declared string, host string, suffix string")
    out = langid.identify(pages, models, declared="declared", host="host", suffix="suffix").collect()
    assert all(not r["kept"] and r["lang"] == "und" for r in out if r["doc_id"] % 5 == 4) and all(r["kept"] for r in out if r["doc_id"] % 5 == 3)


def plain_language(models, rows_):
    """Rows of identify by dictionaries: (text, declared, host, suffix) -> lang, posterior, text_lang, kept."""
    languages = sorted(models)
    scored = []
    for t, *_ in rows_:
        shown = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in "".join(c.lower() if c.isascii() else c for c in t or "").encode())
        seen = [shown[i : i + 3] for i in range(len(shown) - 2) if shown[i : i + 2] != b"  "]
        at = [(int.from_bytes(x, "big") * 2654435761 & 0xFFFFFFFF) >> 32 - langid.TRIGRAM_BITS for x in seen]
        scores = [sum(float(models[x][i]) for i in at) for x in languages]
        best = max(scores)
        scored.append((scores, languages[scores.index(best)] if at and best > len(at) * -langid.TRIGRAM_BITS * math.log(2) else None))
    evidence = []
    for c in (1, 3):
        counts = {}
        for r, (_, lang) in zip(rows_, scored):
            if r[c] is not None and lang:
                counts.setdefault(r[c], Counter())[lang] += 1
        totals = Counter()
        for v in counts.values():
            totals.update(v)
        evidence.append({k: [math.log((v[x] + 1) / (totals[x] + len(counts) + 1)) for x in languages] for k, v in counts.items()})
    total = Counter(x for _, x in scored if x)
    base = [(total[x] + 1) / (sum(total.values()) + len(languages)) for x in languages]
    hosts = {}
    for r, (_, lang) in zip(rows_, scored):
        if r[2] is not None:
            hosts.setdefault(r[2], Counter())[lang] += 1
    hosts = {h: [n[x] for x in languages] for h, n in hosts.items()}

    def prior(h):
        p, parts = base, h.split(".")
        for k in (1, 2):
            domain = ".".join(parts[-k:]) if len(parts) > k else None
            inside = [sum(n[i] for g, n in hosts.items() if domain and len(g.split(".")) > k and ".".join(g.split(".")[-k:]) == domain) for i in range(len(languages))]
            p = [(d + 10 * q) / (sum(inside) + 10) for d, q in zip(inside, p)]
        n = hosts[h]
        return [math.log((c + 10 * q) / (sum(n) + 10)) for c, q in zip(n, p)]

    out = []
    for r, (scores, lang) in zip(rows_, scored):
        logs = [x * langid.TEMPER for x in scores]
        for more in (evidence[0].get(r[1]), evidence[1].get(r[3]), prior(r[2]) if r[2] is not None else None):
            logs = [x + y for x, y in zip(logs, more)] if more else logs
        top = max(logs)
        posterior = 1 / sum(math.exp(x - top) for x in logs)
        kept = lang is not None and posterior >= 0.5
        out.append((languages[logs.index(top)] if kept else "und", posterior, lang, kept))
    return out


def test_languages_of_documents_and_pages_against_loops(spark):
    got = {r["doc_id"]: r for r in QUERIES["op7_language_id"](spark, SMALL).collect()}
    docs, pages = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "pages"))
    models = langid.fit(docs)
    rows_ = [(r["doc_id"], (r["text"], None, None, None)) for r in docs.collect()]
    for r in pages.collect():
        host = re.match(r"[^:]*://([^/?#]*)", r["url"])[1].lower()
        text = re.sub(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ", r["html"])
        rows_.append((-1 - r["page_id"], (text, re.search(r"<html[^>]*\slang=\"([a-z]+)", r["html"])[1], host, host.split(".")[-1])))
    want = plain_language(models, [r for _, r in rows_])
    assert len(got) == len(rows_)
    for (i, _), (lang, posterior, text_lang, kept) in zip(rows_, want):
        r = got[i]
        assert (r["lang"], r["text_lang"], r["kept"], r["page_id"]) == (lang, text_lang, kept, -1 - i if i < 0 else None) and r["posterior"] == pytest.approx(posterior, abs=1e-6)


def test_held_out_languages_without_their_labels(spark):
    """Models of half the documents; the others by text alone, and pages whose label, the path's, is no evidence."""
    d, pages = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "pages"))
    models = langid.fit(d.where("doc_id % 2 = 0"))
    test = d.where("doc_id % 2 = 1").select("doc_id", "text", F.col("lang").alias("said"))
    texts = langid.identify(test, models).join(test, "doc_id")
    assert texts.where("lang = said").count() >= 0.99 * test.count()
    said = pages.select("page_id", F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1).alias("said"))
    found = langid.identify(langid.page_evidence(pages), models, doc_id="page_id", declared="declared", host="host", suffix="suffix").join(said, "page_id")
    assert found.where("lang = said").count() >= 0.99 * pages.count() and found.where("text_lang = said").count() >= 0.9 * pages.count()


def test_pages_without_url_markup_or_text(spark):
    made = [(1, None, None), (2, "http://u:p@A.b.DE:80/x", "<HTML class=x LANG='pt-BR'>a&amp;b<script>no</script><!-- no -->c"), (3, "x", ""), (4, "http://localhost/", "<p lang=de>t")]
    got = [tuple(r) for r in langid.page_evidence(spark.createDataFrame(made, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert got[0] == (1, "", None, None, None) and got[2] == (3, "", None, None, None)
    assert got[1][1].split() == ["a", "b", "c"] and got[1][2:] == ("pt", "a.b.de", "de")
    assert got[3][1].split() == ["t"] and got[3][2:] == (None, "localhost", None)


def test_labels_in_many_spellings_and_too_many(spark, monkeypatch):
    d = spark.createDataFrame([(i, prose(i, 30), lang) for i, lang in enumerate(["en", "EN", "en-US", " en_GB", "de", None, ""])], "doc_id long, text string, lang string")
    assert sorted(langid.fit(d)) == ["de", "en"]
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.fit(d)
    assert sorted(langid.fit(d, languages=["de"])) == ["de"]


def test_host_priors_follow_parents(spark):
    rows_ = [("x.b.de", "de")] * 30 + [("y.b.de", "fr")] * 2 + [("z.com", "en")] * 30 + [("q.b.de", None)] * 3 + [(None, "en")]
    got = {r["_host"]: np.exp(r["host_logs"]) for r in langid.host_priors(spark.createDataFrame(rows_, "host string, text_lang string"), ["de", "en", "fr"]).collect()}
    assert all(v.sum() == pytest.approx(1) for v in got.values())
    assert got["x.b.de"].argmax() == 0 and got["q.b.de"].argmax() == 0 and got["z.com"].argmax() == 1 and got["y.b.de"][2] > got["x.b.de"][2]


def test_language_of_odd_rows(spark, odd):
    models = langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), sample=5)
    got = langid.identify(odd, models, declared="lang", host="source")
    assert got.count() == odd.count() and {r["doc_id"] for r in got.where("not kept").collect()} >= {0, 1, 7}
    assert langid.keep_identified(odd, models, declared="lang").columns == odd.columns
    assert langid.identify(empty(spark), models).count() == 0 and langid.fit(empty(spark)) == {}
    assert langid.identify(odd, {}).where("kept").count() == 0


# Substrings
def test_chunks_cover_texts_and_resist_shifts():
    base = prose(5, 300).encode()
    for shift in (b"", b"x", b"some words before "):
        data = shift + base
        ends = substring.chunk_ends(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert ends[-1] == len(data) and (np.diff(np.append(0, ends)) > 0).all()
        assert len({len(data) - e for e in ends.tolist()} & {len(base) - e for e in substring.chunk_ends(np.frombuffer(base, np.uint8), np.array([0, len(base)])).tolist()}) > 0.8 * len(ends) - 5


def test_gear_hash_is_the_plain_sum():
    data = np.frombuffer(prose(6, 30).encode(), np.uint8)
    got = substring.gear_hashes(data)
    for i in range(len(data)):
        assert got[i] == sum(int(substring.GEAR[data[i - j]]) << j for j in range(min(16, i + 1))) % (1 << 16)


def test_passages_that_repeat_are_found(spark):
    passages = [prose(1000 + i, 51 + i) for i in range(25)]
    texts = [prose(i, 30 + 7 * (i % 9)) + " " + (passages[i // 4] if i % 2 else prose(5000 + i, 12)) + " " + prose(700 + i, 90) for i in range(100)]
    short = "common line of ten words that all of them share here"
    texts = [f"{short}\n{t}" for t in texts]
    got = substring.find_repeats(spark.createDataFrame(rows(texts), DOCS)).collect()
    want = {i for i in range(100) if i % 2 and i % 4 == 3}
    assert {r["doc_id"] for r in got} == want and all(r["first_doc_id"] == r["doc_id"] - 2 for r in got)
    left = {r["doc_id"]: r["text"] for r in substring.remove_repeats(spark.createDataFrame(rows(texts), DOCS)).collect()}
    assert all(left[i] == texts[i] for i in range(100) if i not in want) and all(len(left[i]) < len(texts[i]) - 150 for i in want)


def test_all_of_many_passages_of_51_words_are_found(spark):
    texts = [prose(3 * i + 20_000, 20 + i % 31) + " " + prose(90_000 + i // 2, 51) + " " + prose(3 * i + 40_000, 30) for i in range(1200)]
    got = substring.find_repeats(spark.createDataFrame(rows(texts), DOCS)).collect()
    assert {r["doc_id"] for r in got} == set(range(1, 1200, 2)) and all(r["first_doc_id"] == r["doc_id"] - 1 for r in got)
    # Far shorter ones are left alone.
    texts = [prose(3 * i + 20_000, 20 + i % 31) + " " + prose(90_000 + i // 2, 20) + " " + prose(3 * i + 40_000, 30) for i in range(400)]
    assert substring.find_repeats(spark.createDataFrame(rows(texts), DOCS)).count() <= 8


def plain_chunks(data):
    """(begin, end) of a text's chunks, byte by byte."""
    h, candidates = 0, []
    for i, b in enumerate(data):
        h = (2 * h + int(substring.GEAR[b])) & 0xFFFF
        if not h >> 16 - substring.RATE_BITS and i + 1 >= substring.WINDOW:
            candidates.append(i + 1)
    kept = [e for e, before in zip(candidates, [-99, *candidates]) if e - before > substring.GAP]
    out, begin = [], 0
    for end in sorted({*kept, len(data)} - {0}):
        while end - begin > substring.LONGEST:
            out.append((begin, begin + substring.LONGEST))
            begin += substring.LONGEST
        if end > begin:
            out.append((begin, end))
            begin = end
    return out


def plain_repeats(docs):
    """Rows of find_repeats by chunks' bytes and loops over a document's chunks."""
    made, first = {}, {}
    for i, t in docs:
        data = "".join(c.lower() if c.isascii() else c for c in t or "").encode()
        made[i] = (data, plain_chunks(data), [m.start() for m in WORD.finditer(data)])
        for a, b in made[i][1]:
            first[data[a:b]] = min(first.get(data[a:b], i), i)
    out = []
    for i, (data, cut, starts) in made.items():
        count = lambda a, b: sum(a <= x < b for x in starts)
        run = []
        for k, (a, b) in enumerate([*cut, (0, 0)]):
            if k < len(cut) and first[data[a:b]] < i:
                run.append(k)
                continue
            if run:
                n, before, after = count(cut[run[0]][0], cut[run[-1]][1]), 0, 0
                if run[0]:
                    m = run[0] - 1
                    while m and cut[m - 1][1] - cut[m - 1][0] == substring.LONGEST:
                        m -= 1
                    before = count(max(0, cut[m][0] - substring.LEAD), cut[run[0]][0])
                if run[-1] + 1 < len(cut):
                    after = count(cut[run[-1]][1], cut[run[-1] + 1][1])
                if n >= 30 or n + before + after >= 51:
                    out.append((i, cut[run[0]][0], cut[run[-1]][1], n, min(first[data[cut[j][0] : cut[j][1]]] for j in run)))
            run = []
    return sorted(out)


@pytest.mark.parametrize("least_hot", [None, 2])
def test_repeats_of_the_small_table_against_loops(spark, least_hot):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sorted(tuple(r) for r in substring.find_repeats(docs, least_hot=least_hot).collect())
    want = plain_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got == want and len(got) > 20
    assert sorted(tuple(r) for r in QUERIES["op8_substring_dedup"](spark, SMALL).collect()) == want


def test_repeats_in_another_case_are_found(spark):
    passage = prose(5, 120)
    texts = [f"{prose(1, 30)} {passage} {prose(2, 30)}", f"{prose(3, 41)} {passage.upper()} {prose(4, 30)}", f"{prose(6, 30)} {passage.title()} é"]
    got = {r["doc_id"]: r["n_words"] for r in substring.find_repeats(spark.createDataFrame(rows(texts), DOCS)).collect()}
    assert got.keys() == {1, 2} and min(got.values()) > 100


def test_repeats_of_odd_rows(spark, odd):
    got = {r["doc_id"] for r in substring.find_repeats(odd).collect()}
    assert got == {5}
    out = substring.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert substring.find_repeats(empty(spark)).count() == 0


# Tokens
def library(name="byte_bpe_50k.json"):
    return Tokenizer.from_file(public_tokenizers.path(name))


def utf8(texts):
    coded = [t.encode() for t in texts]
    return np.frombuffer(b"".join(coded), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in coded])]).astype(np.int64)


def same_as_library(encoder, tokenizer, texts):
    flat, n = encoder.encode(*utf8(texts))
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


ODD_PARTS = ["a", "b", "é", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "1", "23", ".", "!!", "\x1c", "\x85", "\u200b", "😀", "<|endoftext|>", "日本", "\x00", "don't", " '", "²", "—", "\u0301", "Ω", "\xa0", "\u3000", "\u2009", "ß", "×", "ŵ", "ɏ", "à", "x" * 17, "<|"]


def test_segments_encode_as_whole_texts():
    draw = random.Random(5)
    texts = ["".join(draw.choice(ODD_PARTS) for _ in range(draw.randint(0, 30))) for _ in range(6000)] + [prose(1, 3000), "a <|endoftext|> b", "y" * 5000]
    encoder, tokenizer = token_out.Encoder(TOKENIZER, 0), library()
    assert encoder.by_segment and encoder.encode(*utf8(["a <|endoftext|> b"]))[0].tolist() == [64, 220, 50256, 275, 0]
    for size in (1, 37, 6003):
        same_as_library(encoder, tokenizer, texts[:size])
    same_as_library(encoder, tokenizer, [])


@pytest.mark.parametrize("seed", range(4))
def test_every_pair_of_odd_parts_is_parted_as_by_the_library(seed):
    draw = random.Random(seed)
    texts = [x + y + draw.choice(ODD_PARTS) for x in ODD_PARTS for y in ODD_PARTS if "<|e" not in x + y]
    same_as_library(token_out.Encoder(TOKENIZER, 0), library(), texts)


def test_letters_that_segments_end_after_are_letters_to_the_library():
    tokenizer = library()
    for code in range(0x80, 0x250):
        text = f"a{chr(code)}."
        begins = token_out.segment_begins(*utf8([text]))
        if len(begins) > 1:
            assert len(tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 2, hex(code)


def test_other_tokenizers_encode_whole_texts():
    encoder = token_out.Encoder(public_tokenizers.path("word_bpe_49k.json"), 0)
    assert not encoder.by_segment
    same_as_library(encoder, library("word_bpe_49k.json"), ["A  b\n c", "", prose(3, 50), "x<|endoftext|>"])


def test_forgotten_segments_are_learned_again(monkeypatch):
    monkeypatch.setattr(token_out, "MOST_SEGMENTS", 50)
    monkeypatch.setattr(token_out, "BLOCK", 16)
    encoder, tokenizer = token_out.Encoder(TOKENIZER, 0), library()
    for i in range(60):
        same_as_library(encoder, tokenizer, [prose(i % 7, 40), prose(i, 40)])


def test_token_query_gives_the_librarys_ids(spark):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op10_token_output"](spark, SMALL).collect()}
    tokenizer, start = library(), 0
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    for r in docs:
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[r["doc_id"]] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_number_of_files_follows_the_texts_alone(spark):
    """However the documents came about: made, read, or joined."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")

    def count(docs):
        out = common.table_path(spark, "tokens")
        token_out.write_tokens(docs, out, TOKENIZER)
        return spark.read.parquet(out).select(F.input_file_name()).distinct().count()

    try:
        assert count(spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")) == 1
        docs = spark.read.parquet(f"{SMALL}/documents.parquet")
        labels = spark.read.parquet(f"{SMALL}/labels.parquet")
        assert count(docs) == count(docs.join(labels, "doc_id", "left")) == count(spark.createDataFrame(docs.collect(), docs.schema)) == 1
        assert count(docs.limit(0)) == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_token_files_read_back(spark, odd):
    odd = odd.unionByName(odd.limit(1).select(F.lit(77).cast("long").alias("doc_id"), F.lit("two <|endoftext|><|endoftext|> ends").alias("text"), *[c for c in odd.columns if c not in ("doc_id", "text")]))
    out = token_out.token_digests(token_out.tokenize_documents(odd, TOKENIZER, files=3)).collect()
    tokenizer = library()
    order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect()))
    want, start = [], 0
    for known, i, t in order:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i if known else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in out), key=lambda x: x[1]) == want
    assert token_out.token_digests(token_out.tokenize_documents(empty(spark), TOKENIZER)).count() == 0
