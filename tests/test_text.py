import random
import re

import pytest
from pyspark.sql import functions as F

from accordia.functions import mentions as M
from accordia.functions import text as T

ACT = "IPC"


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values, strict=True)))
    return df.select(f(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, ""), ("  Answer: Section 302 of the IPC. ", "section 302 of the ipc"), ("**Final answer -** `302`", "final answer - 302"), ("Ans - “x”", 'ans - "x"'.replace("ans - ", "")),
        ("a  \n b", "a b"), (" .;:,-", ""), ("303(2)", "303(2)"), ("Response:", ""),
    ],
)
def test_normalize(spark, text, want):
    assert one(spark, T.normalize, text) == want


@pytest.mark.parametrize(("text", "want"), [("the BNSS", "BNS"), ("Indian Penal Code", "IPC"), ("nothing", None), ("bsa ipc", "IPC")])
def test_first_alias_follows_the_list(spark, text, want):
    assert one(spark, T.first_alias, text) == want and M.act_in(text) == want


@pytest.mark.parametrize(("x", "base", "sub"), [("303(2)", "303", "2"), ("0012A", "12a", None), (None, "", None), ("(x)", "", "x"), ("7()", "7", None)])
def test_numbers(spark, x, base, sub):
    assert one(spark, T.base_number, x) == base and one(spark, T.subsection, x) == sub


@pytest.mark.parametrize(
    ("number", "sub", "act", "provision", "wanted", "want"),
    [
        ("303", None, "BNS", "303(2)", "BNS", "base"), ("303", "2", "BNS", "303(2)", "BNS", "exact"), ("303", "3", "BNS", "303(2)", "BNS", None), ("302", None, None, "302", "IPC", "exact"),
        ("302", None, "BNS", "302", "IPC", None), ("302", None, "BNS", "302", None, "exact"), ("", None, None, "", None, None), ("0302", "1", "IPC", "302", "IPC", "exact"),
    ],
)
def test_match_kind(spark, number, sub, act, provision, wanted, want):
    assert one(spark, T.match_kind, number, sub, act, provision, wanted) == want
    assert M.matches({"num": number, "sub": sub, "act": act}, wanted, provision) == (want is not None)


@pytest.mark.parametrize(
    ("act", "provision", "want"),
    [(None, None, "NONE"), ("FOREIGN", "uk ", "FOREIGN:uk "), ("FOREIGN", None, "FOREIGN:None"), ("IPC", None, "IPC (no section)"), (None, "3", "UNKNOWN 3"), ("IPC", "302", "IPC 302")],
)
def test_provision_key(spark, act, provision, want):
    assert one(spark, T.provision_key, act, provision) == want


def test_pair_ids_ignore_order_and_spaces(spark):
    assert one(spark, T.pair_id, "a  b", "c") == one(spark, T.pair_id, "c ", "a b") != one(spark, T.pair_id, "a", "c")


def test_overlap_is_over_the_larger_set(spark):
    share = lambda a, b: one(spark, lambda x, y: T.overlap(T.tokens(x), T.tokens(y)), a, b)
    assert share("a b c", "A b") == pytest.approx(2 / 3) and share("", "a") == 0 and share("x x x", "x") == 1


def test_mentions_places_acts_and_cues():
    text = "IPC 302 was replaced; Section 103(1) of the BNS applies. Article 21 too. In the UK s. 5 is used"
    got = M.mentions(text)
    assert [(m["num"], m["sub"], m["act"]) for m in got] == [("302", None, "IPC"), ("103", "1", "BNS"), ("21", None, "CONSTITUTION"), ("5", None, None)]
    assert [m["repeal_cue"] for m in got] == [True, False, False, False] and got[1]["operative"] and got[3]["foreign_marker"] == "uk "
    assert all(text[m["pos"] :].startswith(m["raw"]) for m in got)
    assert M.mentions("") == [] and len(M.mentions("Section 302 IPC")) == 1


def test_sentences_against_a_walk():
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choice("ab .;\n") if draw.random() < 0.3 else "x" for _ in range(draw.randint(1, 500)))
        pos = draw.randrange(len(text))
        a = b = pos
        while a > 0 and text[a - 1] not in ".!?;\n" and pos - a < 160:
            a -= 1
        while b < len(text) and text[b] not in ".!?;\n" and b - pos < 160:
            b += 1
        assert M.sentence_at(text, pos) == text[a:b]


@pytest.mark.parametrize(
    ("text", "act", "provision", "correct", "label"),
    [
        ("Section 103 of the BNS applies.", "BNS", "103", True, "gold"),
        ("Section 103 of the BNS is the one that now applies here. IPC 302 was repealed.", "BNS", "103", True, "gold_with_superseded_note"),
        # An act within reach to the right counts by the order of the names, not by how near it is.
        ("Section 103 of the BNS applies. IPC 302 was repealed.", "BNS", "103", False, "stale_law"),
        ("Section 103 of the BNS. In the UK section 5 is used.", "BNS", "103", True, "gold_with_foreign_note"),
        ("Section 302 of the IPC is old law. Section 103 of the BNS applies.", "BNS", "103", True, "gold_operative"),
        ("Section 103 of the BNS. Section 302 of the IPC.", "BNS", "103", True, "gold_first"),
        ("Section 302 of the IPC applies. Section 103 of the BNS applies.", "BNS", "103", None, "ambiguous"),
        ("Section 302 of the IPC.", "BNS", "103", False, "stale_law"), ("Section 103 of the BNS.", "IPC", "302", False, "premature_law"), ("Section 104 of the BNS.", "BNS", "103", False, "wrong_section"),
        ("Section 9 of the BSA.", "BNS", "103", False, "wrong_act"), ("Section 9.", "BNS", "103", False, "other_provision"), ("Section 9 of english law.", "BNS", "103", False, "non_indian_act"),
        ("As in the United States.", "BNS", "103", False, "non_indian_act"), ("The Indian Penal Code.", "BNS", "103", False, "stale_law_act_only"), ("The BNS.", "IPC", "302", False, "premature_law_act_only"),
        ("The BNS.", "BNS", "103", None, "no_provision_named"), ("I cannot say.", "BNS", "103", None, "declines"), ("", "BNS", "103", None, "unresolved"),
    ],
)
def test_judge(text, act, provision, correct, label):
    assert M.judge(text, act, provision)[:2] == (correct, label)


def test_judge_cascade_and_replies(spark):
    df = spark.createDataFrame([("Section 103 of the BNS.", '{"correct": false}'), ("?", 'so {"correct": true, "reason": "x"}.'), ("?", "that is incorrect"), (None, None)], "text string, reply string")
    first = M.judge_answers(F.col("text"), F.lit("BNS"), F.lit("103"))
    second = F.struct(M.parse_verdict(F.col("reply")).alias("correct"), F.lit("llm").alias("label"), F.lit(None).cast("string").alias("act"), F.lit(None).cast("string").alias("provision"))
    got = df.select(first.alias("f"), second.alias("s")).select(M.cascade(F.col("f"), F.col("s")).alias("v")).collect()
    assert [(r["v"]["correct"], r["v"]["label"]) for r in got] == [(True, "gold"), (True, "unresolved|llm"), (False, "unresolved|llm"), (None, "unresolved|llm")]


def test_surface_forms_name_their_provision(spark):
    for i in range(6):
        said = one(spark, T.surface_form, i, "IPC", "302")
        assert re.search("302", said) and M.mentions(said)[0]["num"] == "302" and M.mentions(said)[0]["act"] == "IPC"


def test_redact(spark):
    assert one(spark, T.redact, "key abc", "abc") == "key [redacted]" and one(spark, T.redact, "key", "") == "key"
