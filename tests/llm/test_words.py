"""Spelling variants, token counts and divergence of sources against plain loops and the libraries."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from accordia.llm import common, divergence, spelling, token_count
from accordia.llm.queries import COUNTED_TOKENIZER, QUERIES

SMALL = "/root/testdata/sf0.001"
#: Columns beside the used ones have the operators' own names.
DOCS = "doc_id long, text string, lang string, source string, word string, n long, key long, digest string, block int, term string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(texts, first=0, lang="en", source="s"):
    return [(first + i, t, lang, source, "x", 1, 2, "d", 3, "t") for i, t in enumerate(texts)]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def noisy_words(seed, n, alphabet="abcdeé", sizes=(5, 9)):
    """Words with many at one edit from each other."""
    draw = random.Random(seed)
    stems = ["".join(draw.choice(alphabet) for _ in range(draw.randint(*sizes))) for _ in range(40)]
    out = []
    for _ in range(n):
        w = draw.choice(stems)
        at, what = draw.randrange(len(w)), draw.choice("keep keep keep drop put swap".split())
        out.append({"keep": w, "drop": w[:at] + w[at + 1 :], "put": w[:at] + draw.choice(alphabet) + w[at:], "swap": w[:at] + draw.choice(alphabet) + w[at + 1 :]}[what])
    return out


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = max(a, b, key=len), min(a, b, key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_counts(docs, noise):
    out = Counter()
    for i, text in docs:
        for w, k in Counter(x.translate(LOW) for x in re.findall("[A-Za-zÀ-ÿ]+", text or "")).items():
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if noise and h % noise == 0 else w] += k
    return {w: k for w, k in out.items() if len(w) >= 5 and k >= 3}


def brute_variants(counts):
    found = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, near in found.items():
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 2 * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), k, len(found[w]), counts.get(form.get(w))) for w, k in counts.items()), found


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple(("" if x is None else str(x)) for x in r))


VARIANT = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("most_members", [1, 3, 4096])
def test_near_words_are_all_found(spark, most_members):
    counts = Counter(w for w in noisy_words(1, 1500) if len(w) >= 5)
    table = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    want = sorted((w, v, counts[v]) for w, vs in brute_variants(counts)[1].items() for v in vs)
    assert got(spelling.near_words(table, most_members), "word", "near", "near_n") == want


@pytest.mark.parametrize("noise", [0, 7])
def test_variants_against_loops(spark, noise):
    words = noisy_words(2, 3000) + ["Straße", "STRASSE", "×÷×÷×", "naïve"] * 3
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    texts += [None, "", " \t", "x" * 200_000 + " " + "x" * 200_000, "x" * 199_999, "x" * 200_000, "日本語 Ünïcode", "a1b2", "étude " * 3, texts[0], texts[0]]
    docs = [*enumerate(texts), (None, texts[1]), (3, texts[3]), (3, texts[3])]
    table = spark.createDataFrame([(i, t, "en", "s", "x", 1, 2, "d", 3, "t") for i, t in docs], DOCS)
    want = brute_variants(brute_counts(docs, noise))[0]
    assert sorted(map(str, got(spelling.spelling_variants(table, noise=noise), *VARIANT))) == sorted(map(str, want))


def test_variants_of_an_empty_table(spark):
    assert spelling.spelling_variants(empty(spark), noise=97).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame(rows(["lonely " * 3]), DOCS)).collect() == [("lonely", None, "lonely", 3, 0, None)]


def test_long_chains_of_forms_end_at_their_root(spark):
    chain = ["aaaaa" + "b" * i for i in range(9)]
    table = spark.createDataFrame([(w, 3 * 2**i) for i, w in enumerate(chain)], "word string, n long")
    assert {r["root"] for r in spelling.variants(table).collect()} == {chain[-1]}


def test_one_frequent_key_is_dealt_out(spark):
    """Words that share all rare grams but a few: a third of all words have one key."""
    words = [f"{'q' * 6}{a}{b}{c}" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"]
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    assert spelling.near_words(table, 64).count() == 1000 * 27


def test_query_of_variants_against_loops(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    counts = brute_counts(docs, 97)
    assert sorted(map(str, got(QUERIES["op11_spelling_variants"](spark, SMALL), *VARIANT))) == sorted(map(str, brute_variants(counts)[0]))


def test_check_sums_are_zlibs():
    data = np.frombuffer(b"abcdefgh" * 40, np.uint8)
    begin, end = np.array([0, 3, 7, 8, 0, 20]), np.array([1, 3, 60, 300, 47, 68])
    before = np.array([0, 1, 2**32 - 1, 77, 5, 6], np.uint32)
    assert spelling.check_sums(data, begin, end, before).tolist() == [zlib.crc32(data[b:e].tobytes(), int(x)) for b, e, x in zip(begin, end, before, strict=True)]


ODD_TEXTS = [
    None, "", " ", "\t\n\x0b\x0c\r ", "One two  THREE", "one\ttwo\nthree ", "<|endoftext|>", "<|ENDOFTEXT|> x", "a<|startoftext|>b <|endoftext|>\n<|endoftext|>", "J̌ ǰ J ̌", "ΣΑΣ σας", "İI ı",
    "don't DON'T 's' it's 12 345 6.7", "a b　c d\x85e\x1cf", "각 각", "ﬁ Å Å", "é" * 3000, "word " * 3000, "x" * 20_000, "🙂🙂 ‍🙂", "\x00 \x7f", "<|", "one two three", "One two  THREE",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("most_sent", [0, 1 << 18])
def test_counts_are_the_librarys(spark, name, most_sent):
    path = public_tokenizers.path(name)
    texts = [x or "" for x in ODD_TEXTS]
    if name.endswith(".model"):
        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        want = [len(x) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    found = token_count.count_tokens(spark.createDataFrame(rows(ODD_TEXTS), DOCS), path, most_sent=most_sent, limit=100)
    assert got(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(((i, len(t.encode()), n, n > 100) for i, (t, n) in enumerate(zip(texts, want, strict=True))), key=lambda r: str(r[0]))


def test_only_missing_contents_are_encoded_and_appended(spark, monkeypatch):
    store = common.table_path(spark, "counts")
    version = token_count.tokenizer_version(COUNTED_TOKENIZER)
    held = lambda: spark.read.parquet(f"{store}/{version}").count()
    token_count.count_tokens(spark.createDataFrame(rows(["One two", " one\ttwo ", "one two", "three", None, ""]), DOCS), COUNTED_TOKENIZER, store)
    assert held() == 3  # "one two" thrice, "three", nothing twice
    again = spark.createDataFrame(rows(["ONE TWO", "three"]), DOCS)
    found = token_count.count_tokens(again, COUNTED_TOKENIZER, store)
    assert held() == 3 and [r["n_tokens"] for r in found.orderBy("doc_id").collect()] == [2, 1]
    token_count.count_tokens(spark.createDataFrame(rows(["three", "four"]), DOCS), COUNTED_TOKENIZER, store)
    assert held() == 4
    # Stored counts are what is returned: another version's are not.
    spark.createDataFrame([(hashlib.sha256(b"five").digest(), 99)], "digest binary, n_tokens long").write.mode("append").parquet(f"{store}/{version}")
    five = spark.createDataFrame(rows(["FIVE"]), DOCS)
    assert token_count.count_tokens(five, COUNTED_TOKENIZER, store).first()["n_tokens"] == 99
    monkeypatch.setattr(token_count, "RULE", "2")
    assert token_count.tokenizer_version(COUNTED_TOKENIZER) != version
    assert token_count.count_tokens(five, COUNTED_TOKENIZER, store).first()["n_tokens"] == 1


def test_two_writers_count_once(spark):
    store = common.table_path(spark, "counts")
    docs = spark.createDataFrame(rows(["one two"] * 3), DOCS)
    token_count.count_tokens(docs, COUNTED_TOKENIZER, store)
    folder = f"{store}/{token_count.tokenizer_version(COUNTED_TOKENIZER)}"
    spark.createDataFrame([tuple(r) for r in spark.read.parquet(folder).collect()], "digest binary, n_tokens long").write.mode("append").parquet(folder)
    assert token_count.count_tokens(docs, COUNTED_TOKENIZER, store).count() == 3


def test_counts_of_odd_tables(spark):
    assert token_count.count_tokens(empty(spark), COUNTED_TOKENIZER).count() == 0
    odd = spark.createDataFrame([(None, "a b", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (1, "a b", "", "", "", 0, 0, "", 0, "")], DOCS)
    assert got(token_count.count_tokens(odd, COUNTED_TOKENIZER), "doc_id", "n_bytes", "n_tokens") == [(None, 0, 0), (None, 3, 2), (1, 3, 2)]


def test_query_of_counts_against_the_library(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    n = [len(x) for x in Tokenizer.from_file(COUNTED_TOKENIZER).encode_batch([r["text"] or "" for r in docs], add_special_tokens=False)]
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), k, k > 2048) for r, k in zip(docs, n, strict=True))
    assert sorted(map(tuple, QUERIES["op12_token_counts"](spark, SMALL).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())) == want


def brute_audit(docs, least, top):
    """docs: (text, lang, source)."""
    seen, count, groups = defaultdict(Counter), defaultdict(Counter), sorted({(b or "", c or "") for _, b, c in docs})
    for text, lang, source in docs:
        terms = [x.translate(LOW) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        seen[lang or ""].update(set(terms))
        count[lang or "", source or ""].update(terms)
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)

        def shares(of, kept=kept):
            c = sum((count[g] for g in groups if g in of), Counter())
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        gap = lambda p, q: (p - q) * (p - q) // (p + q)
        p, q = shares({(lang, source)}), shares({g for g in groups if g[0] == lang})
        pairs = []
        for a, b in groups:
            if a == lang and b != source:
                other = shares({(a, b)})
                pairs.append((sum(gap(p[t], other[t]) for t in kept), b))
        terms = [(gap(p[t], q[t]), t) for t in kept if count[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "chunk", "step"), [(16, 8192, 1 << 20), (2, 4, 8), (1, 1, 1)])
def test_divergence_against_loops(spark, monkeypatch, block, chunk, step):
    monkeypatch.setattr(divergence, "STEP", step)
    draw = random.Random(5)
    words = ["alpha", "Beta", "gamma", "épée", "EPEE", "ÉPÉE", "日本", "tail", "over", "done", "red", "blue"]
    docs = [(" ".join(draw.choices(words, range(1, len(words) + 1), k=draw.randint(0, 12))), draw.choice(["en", "en", "de", None]), draw.choice(["a", "b", "c", "d", "é", None])) for _ in range(120)]
    docs += [(None, "en", "silent"), ("", "xx", "p"), ("only here", "xx", "q"), ("1 2 3", "xx", None), (docs[0][0], *docs[0][1:])] + [("zeta " * 50_000, "en", "a")]
    table = spark.createDataFrame([(i, *x, "w", 1, 2, "d", 3, "t") for i, x in enumerate(docs)], DOCS)
    found = divergence.audit(table, least_docs=3, top=4, block=block, chunk=chunk)
    assert sorted(map(tuple, found.collect())) == brute_audit(docs, 3, 4)


def test_divergence_of_large_counts_is_exact(spark):
    """Counts far beyond what a double or a product of longs holds."""
    found = spark.createDataFrame([(10**15 + 7, 10**16 + 3, 5)], "n long, total long, kept long").select(divergence.share("n", "total", "kept")).first()[0]
    assert found == 1 + 10**9 * (10**15 + 9) // (10**16 + 13)


def test_divergence_of_odd_tables(spark):
    assert divergence.audit(empty(spark)).count() == 0
    alone = divergence.audit(spark.createDataFrame(rows(["a b"] * 12), DOCS))
    assert alone.count() == 0  # one source: no other, and nothing it has more of than its language
    nulls = spark.createDataFrame([(None,) * 10] * 2 + rows(["x"], source=None, lang=None) + rows([None], source="z", lang=""), DOCS)
    assert got(divergence.audit(nulls), "lang", "source", "part", "item", "value", "rank") == [("", "", "pair", "z", 0, 1), ("", "z", "pair", "", 0, 1)]


def test_divergence_query_against_loops_and_dealt_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute_audit([tuple(r) for r in docs.select("text", "lang", "source").collect()], 10, 10)
    assert sorted(map(tuple, QUERIES["op13_source_divergence"](spark, SMALL).collect())) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = divergence.Audit(docs, block=4).pairs()
        assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
