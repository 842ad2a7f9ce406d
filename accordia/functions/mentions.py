"""Citations in free text: where they are, what act they belong to, and what an answer that makes them is worth.

Offsets and the choice among overlapping matches are beyond Spark's regular expressions, so that this is a vectorized
function over Arrow batches; what it returns is an array of structs, on which everything else is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordia.functions.vocabulary import ACT_ALIASES, CURRENT_ACTS, FOREIGN_MARKERS, OPERATIVE_CUES, REPEAL_CUES, REPEALED_ACTS

# Names of acts and the shapes of citations.
_NAMES = "IPC|BNS|CrPC|BNSS|BSA|Indian Penal Code|Bharatiya Nyaya Sanhita|Bharatiya Nagarik Suraksha Sanhita|Bharatiya Sakshya Adhiniyam"
_NUMBER = r"(?P<num>\d{1,4}[A-Za-z]?)"
SHAPES = (
    re.compile(rf"(?:section|sec\.?|s\.|§)\s*{_NUMBER}(?:\s*\((?P<sub>[0-9a-zA-Z]+)\))?", re.I),
    re.compile(rf"\b{_NUMBER}\s*(?:(?:of|under|in)\s+(?:the\s+)?)?(?P<act>{_NAMES})\b", re.I),
    re.compile(rf"\b(?P<act>IPC|BNS|CrPC|BNSS|BSA)\s*(?:section|sec\.?|s\.)?\s*{_NUMBER}\b", re.I),
    re.compile(rf"(?P<constitution>article)\s*{_NUMBER}", re.I),
)
ACT_ALONE = re.compile(r"\b(IPC|BNS|CrPC|BNSS|BSA|Indian Penal Code|Bharatiya Nyaya Sanhita|Code of Criminal Procedure|Indian Evidence Act)\b", re.I)
DECLINES = re.compile(r"\bno (?:specific|particular) provision\b|\bcannot (?:be )?(?:say|determine)\b", re.I)
SENTENCE_ENDS, SENTENCE_REACH, ACT_REACH = frozenset(".!?;\n"), 160, 34

MENTION = T.ArrayType(
    T.StructType([T.StructField(n, T.IntegerType() if n == "pos" else T.BooleanType() if n in ("repeal_cue", "operative") else T.StringType()) for n in ("num", "sub", "pos", "act", "repeal_cue", "operative", "foreign_marker", "raw")])
)
VERDICT = T.StructType([T.StructField("correct", T.BooleanType()), *(T.StructField(n, T.StringType()) for n in ("label", "act", "provision"))])


def act_in(text: str) -> str | None:
    low = text.lower()
    return next((act for alias, act in ACT_ALIASES if alias in low), None)


def marker_in(text: str) -> str | None:
    low = text.lower()
    return next((m for m in FOREIGN_MARKERS if m in low), None)


def sentence_at(text: str, pos: int) -> str:
    """From the sentence end before pos to the one after it, at most 160 characters either way."""
    before, after = text[max(0, pos - SENTENCE_REACH) : pos], text[pos : pos + SENTENCE_REACH]
    cut = max((i for i, c in enumerate(before) if c in SENTENCE_ENDS), default=-1)
    end = next((i for i, c in enumerate(after) if c in SENTENCE_ENDS), len(after))
    return before[cut + 1 :] + after[:end]


def mentions(text: str) -> list[dict]:
    """Citations in order of place. Of overlapping matches the one that begins first stays, then the longest."""
    found = sorted((m for shape in SHAPES for m in shape.finditer(text)), key=lambda m: (m.start(), -m.end()))
    out, free = [], 0
    for m in found:
        if m.start() < free:
            continue
        free = max(free, m.end())
        named = m.groupdict()
        sentence = sentence_at(text, m.start())
        act = "CONSTITUTION" if named.get("constitution") else act_in(named.get("act") or "")
        act = act or act_in(text[m.end() : m.end() + ACT_REACH]) or act_in(text[max(0, m.start() - ACT_REACH) : m.start()]) or act_in(sentence)
        low = sentence.lower()
        out.append({"num": named["num"], "sub": named.get("sub"), "pos": m.start(), "act": act, "repeal_cue": any(c in low for c in REPEAL_CUES), "operative": any(c in low for c in OPERATIVE_CUES), "foreign_marker": marker_in(sentence), "raw": m.group(0)})
    return out


@F.pandas_udf(MENTION)
def find_mentions(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: mentions(t or ""))


def plain(number: str | None) -> str:
    return re.sub("[^0-9A-Za-z]", "", number or "").lower().lstrip("0")


def matches(m: dict, act: str | None, provision: str | None) -> bool:
    """Whether a mention names a provision: the same number, no other act, no other subsection."""
    base, _, rest = (provision or "").partition("(")
    if not plain(base) or plain(m["num"]) != plain(base):
        return False
    want, sub = act_in(act or ""), plain(rest.partition(")")[0]) if ")" in rest else ""
    return not (want and m["act"] and m["act"] != want) and not (sub and plain(m["sub"]) and plain(m["sub"]) != sub)


def _wrong(m: dict, wanted: str | None) -> str:
    if m["foreign_marker"] or marker_in(m["raw"]):
        return "non_indian_act"
    if m["act"] is None:
        return "other_provision"
    if wanted and (m["act"] in REPEALED_ACTS) != (wanted in REPEALED_ACTS):
        return "stale_law" if m["act"] in REPEALED_ACTS else "premature_law"
    return "wrong_section" if wanted == m["act"] else "wrong_act"


def _named(m: dict) -> tuple[str | None, str]:
    act = m["act"] or ("FOREIGN" if m["foreign_marker"] else None)
    return act, f"{m['num']}({m['sub']})" if m["sub"] else m["num"]


def first_key(text: str) -> str:
    """The key of the first citation, NONE without one."""
    found = mentions(text)
    return " ".join(x or "UNKNOWN" for x in _named(found[0])) if found else "NONE"


def judge(text: str, act: str | None, provision: str | None) -> tuple[bool | None, str, str | None, str | None]:
    """(correct, label, act and provision that the answer asserts) against the wanted provision."""
    found = mentions(text)
    hits = [m for m in found if matches(m, act, provision)]
    others = [m for m in found if not matches(m, act, provision)]
    wanted = act_in(act or "")
    if hits:
        live = [m for m in others if not m["repeal_cue"]]
        domestic = [m for m in live if not m["foreign_marker"]]
        first = bool(domestic) and hits[0]["pos"] < domestic[0]["pos"]
        contested = any(m["operative"] for m in domestic)
        ladder = (
            (not others, "gold"), (not live, "gold_with_superseded_note"), (not domestic, "gold_with_foreign_note"), (any(m["operative"] for m in hits) and not contested, "gold_operative"),
            (first and not contested, "gold_first"), (first and len(hits) >= len(domestic), "gold_first_only"),
        )
        label = next((name for holds, name in ladder if holds), None)
        return (True, label, *_named(hits[0])) if label else (None, "ambiguous", None, None)
    if others:
        return False, _wrong(others[0], wanted), *_named(others[0])
    if marker := marker_in(text):
        return False, "non_indian_act", "FOREIGN", marker
    if acts := [act_in(m.group(0)) for m in ACT_ALONE.finditer(text)]:
        stale, current = [a for a in acts if a in REPEALED_ACTS], [a for a in acts if a in CURRENT_ACTS]
        if stale and wanted not in REPEALED_ACTS:
            return False, "stale_law_act_only", stale[0], None
        if current and wanted in REPEALED_ACTS:
            return False, "premature_law_act_only", current[0], None
        return None, "no_provision_named", acts[0], None
    return None, "declines" if DECLINES.search(text) else "unresolved", None, None


@F.pandas_udf(VERDICT)
def judge_answers(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, act, provision in rows:
        made = [judge(t or "", a, p) for t, a, p in zip(text, act, provision, strict=True)]
        yield pd.DataFrame(made, columns=["correct", "label", "act", "provision"]).astype({"correct": "boolean"})


def cascade(first, second):
    """The first verdict where it is decided, else the second's, its label after the first's."""
    return F.when(first["correct"].isNotNull(), first).otherwise(F.struct(second["correct"].alias("correct"), F.concat_ws("|", first["label"], second["label"]).alias("label"), F.coalesce(second["act"], first["act"]).alias("act"), F.coalesce(second["provision"], first["provision"]).alias("provision")))


def parse_verdict(reply):
    """A model's verdict: the correct field of the JSON object in its reply, else the word correct or incorrect."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    told = F.from_json(body, "correct boolean, reason string")["correct"]
    low = F.lower(reply)
    return F.coalesce(told, F.when(low.contains("incorrect"), False).when(low.contains("correct"), True))
