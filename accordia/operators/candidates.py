"""Candidate pairs for a relation classifier, by an inverted index from an answer's wording to the provisions it may stand for.

A provision's topic gives it wordings as the old law, as the new law, as its neighbour, under a swapped act, and ambiguous ones
that name the act alone. The index holds each wording once for each provision; strata are joins of the index with itself on the
topic, by a fixed list of which wordings make a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from accordia.functions.mentions import first_key
from accordia.functions.text import pair_id, plain_text
from accordia.operators.tables import written

# Names of acts, and wordings of an answer by index; texts must not differ, as pairs are named by their hashes.
ACT_NAMES = {"IPC": "Indian Penal Code", "BNS": "Bharatiya Nyaya Sanhita", "CRPC": "Code of Criminal Procedure", "BNSS": "Bharatiya Nagarik Suraksha Sanhita", "IEA": "Indian Evidence Act", "BSA": "Bharatiya Sakshya Adhiniyam"}
FULL_FORMS = (
    "Provision: {name}, section {number}\nReason: {label} as defined in the code.\nPunishment: {punishment}.",
    "{Label} is punishable under section {number} of the {name}.",
    "The applicable provision is s. {number} {act}. The punishment provided is {punishment}.",
    "Under the {name}, the offence of {label} falls under s. {number}; the prescribed punishment is {punishment}.",
    "Section {number} {act} applies here. The reason is that the facts constitute {label}.",
    "Answer: s. {number} of the {name}. Reason: the conduct amounts to {label}, punishable with {punishment}.",
)
AMBIGUOUS_FORMS = (
    "The offence of {label} falls under the {name}.",
    "This is governed by the {name}. The specific section is not stated.",
    "Section {number} {act} applies to the facts as stated",
)
#: Of the full wordings, those that name the provision as a form's field would.
EXPLICIT = (0, 2, 5)
BEFORE, AFTER = "2024-01-01", "2026-10-01"
PAIR_COLUMNS = ["topic", "stratum", "label", "text_i", "text_j", "key_i", "key_j", "as_of", "link", "condition", "stands_for"]


def _plan() -> list[tuple]:
    """(stratum, label, role and form of either text, as_of, link, condition)."""
    same, explicit = "SAME_PROVISION", set(combinations(EXPLICIT, 2))
    made = [("S1" if x in explicit else "S2", same, "old", x[0], "old", x[1], BEFORE, None, None) for x in combinations(range(len(FULL_FORMS)), 2)]
    made += [("S3", "CONDITIONALLY_EQUIVALENT", "old", i, "old", i, day, "successor_of", era) for i in (1, 3) for day, era in ((BEFORE, "era:pre-transition"), (AFTER, "era:current"))]
    made += [("S4", "LEGALLY_EQUIVALENT", "old", i, "new", j, AFTER, "successor_of", None) for i, j in product(range(3), repeat=2)]
    made += [("S5", "DIFFERENT_PROVISION", "old", i, "near", j, BEFORE, None, None) for i, j in ((0, 1), (3, 4))]
    made += [("S6", "DIFFERENT_PROVISION", "old", 0, "swapped", 2, AFTER, None, None)]
    return [*made, ("S7", "AMBIGUOUS", "vague", 0, "vague", 1, BEFORE, None, None), ("S7", "AMBIGUOUS", "vague", 0, "old", 0, BEFORE, None, None)]


PLAN = _plan()


def worded(form: str, act: Column, number: Column, label: Column, punishment: Column) -> Column:
    """One wording; a null act, number, label or punishment makes it null."""
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ACT_NAMES.items() for x in pair]), act), act)
    capital = F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.call_function("substring", label, F.lit(2))))
    out = F.lit(form)
    for mark, value in (("{name}", name), ("{number}", number), ("{act}", act), ("{Label}", capital), ("{label}", label), ("{punishment}", punishment)):
        if mark in form:
            out = F.replace(out, F.lit(mark), value)
    return out


def _wordings() -> list[tuple[str, int, str, str, str]]:
    """(role, form, wording, column of the act, column of the number) of all wordings of a topic."""
    cited = {"old": ("act", "number"), "new": ("new_act", "new_number"), "near": ("near_act", "near_number"), "swapped": ("new_act", "number")}
    full = [(role, i, x, *of) for role, of in cited.items() for i, x in enumerate(FULL_FORMS)]
    return full + [("vague", i, x, "act", "number") for i, x in enumerate(AMBIGUOUS_FORMS)]


def _said(wording: str, act: str, number: str, side: str = "") -> tuple[Column, Column, Column]:
    """Text, key and meant of one wording of a provision, whose columns begin with side."""
    c = lambda name: F.col(side + name)
    meant = F.concat_ws(" ", c(act), c(number))
    unclear = wording in AMBIGUOUS_FORMS and "{number}" not in wording
    return worded(wording, c(act), c(number), c("label"), c("punishment")), F.lit("NONE") if unclear else meant, meant


def _index_rows(provisions: DataFrame) -> DataFrame:
    typed = "struct<role:string,form:int,text:string,key:string,meant:string>"
    made = [F.struct(F.lit(role), F.lit(form), *_said(wording, act, number)).cast(typed) for role, form, wording, act, number in _wordings()]
    return provisions.select("topic", F.inline(F.array(*made))).where("text is not null")


def form_index(provisions: DataFrame) -> DataFrame:
    """topic, role, form, text, key, stands_for: every wording of every provision.

    provisions: topic, label, punishment, act, number, new_act, new_number, near_act, near_number, a row a topic. key is the
    provision that the text cites, NONE where it names an act alone. stands_for counts the different provisions that the
    text may mean: over 1 makes a wording ambiguous.
    """
    rows = _index_rows(provisions)
    # The inverted index: a wording and the provisions that it is listed under.
    listed = rows.groupBy("text").agg(F.count_distinct("meant").alias("stands_for"))
    return rows.join(listed, "text").select("topic", "role", "form", "text", "key", "meant", "stands_for")


#: Hashes that need a closer look are marked by their remainder, so that a broadcast has no more rows than these.
MARKS = 1 << 20
#: Topics that one task words: their pairs' hashes fit its memory.
TOPICS_IN_TASK = 10_000
FIELDS = ["label", "punishment", "act", "number", "new_act", "new_number", "near_act", "near_number"]
#: What makes two pairs the same.
GROUP = ["pair", "stratum", "as_of", "link"]


def _mark(number: Column) -> Column:
    return F.pmod(number, F.lit(MARKS)).cast("int")


def _dealt(provisions: DataFrame) -> DataFrame:
    """Provisions dealt out by topic: they alone are shuffled, never all their wordings, which are long."""
    n = max(1, -(-provisions.count() // TOPICS_IN_TASK))
    return provisions.select("topic", *FIELDS).repartition(n, "topic")


def _met(dealt: DataFrame, standing: DataFrame | None = None) -> DataFrame:
    """stratum, as_of, link, PAIR_COLUMNS, and texts_hash, the same for equal pairs; stands_for only with standing.

    All pairs, with those that several topics make as often as they make them.
    """
    wording = {(role, form): rest for role, form, *rest in _wordings()}
    side = lambda s: dealt.select("topic", *[F.col(c).alias(f"{s}_{c}") for c in FIELDS])
    both = side("i").join(side("j"), "topic")
    if standing is not None:
        both = both.join(standing, "topic", "left")
    columns: dict[str, Column] = {}
    for s, at in (("i", 2), ("j", 4)):
        for role, form in {(p[at], p[at + 1]) for p in PLAN}:
            text, key, _ = _said(*wording[role, form], side=f"{s}_")
            columns |= {f"text_{s}_{role}_{form}": text, f"key_{s}_{role}_{form}": key, f"hash_{s}_{role}_{form}": F.xxhash64(plain_text(text))}
    kept = ["topic"] if standing is None else ["topic", "standing"]
    said = both.select(*kept, *[c.alias(name) for name, c in columns.items()])
    names = ["stratum", "label", "as_of", "link", "condition", "text_i", "text_j", "key_i", "key_j", "hash_i", "hash_j"]
    text = lambda x: F.lit(x).cast("string")
    each = []
    for stratum, label, role_i, form_i, role_j, form_j, as_of, link, condition in PLAN:
        own = [F.col(f"{c}_{s}_{r}_{f}") for c in ("text", "key", "hash") for s, r, f in (("i", role_i, form_i), ("j", role_j, form_j))]
        each.append(F.struct(*[c.alias(n) for n, c in zip(names, [text(stratum), text(label), text(as_of), text(link or ""), text(condition), *own], strict=True)]))
    met = said.select(*kept, F.inline(F.array(*each))).where("text_i is not null and text_j is not null")
    met = met.withColumn("texts_hash", F.xxhash64(F.least("hash_i", "hash_j"), F.greatest("hash_i", "hash_j"), "stratum", "as_of", "link")).drop("hash_i", "hash_j")
    if standing is None:
        return met
    n = lambda c: F.coalesce(F.try_element_at("standing", F.xxhash64(c)), F.lit(1))
    return met.withColumn("stands_for", F.greatest(n("text_i"), n("text_j"))).drop("standing")


def _named(met: DataFrame) -> DataFrame:
    return met.withColumn("pair", pair_id(F.col("text_i"), F.col("text_j"))).drop("texts_hash")


def _once(met: DataFrame) -> DataFrame:
    """Of equal pairs of several topics, the smallest topic's."""
    rest = [c for c in met.columns if c not in GROUP]
    return met.groupBy(*GROUP).agg(F.min_by(F.struct(*rest), F.struct("topic", "text_i")).alias("row")).select(*GROUP, "row.*")


def distinct_pairs(provisions: DataFrame) -> DataFrame:
    """candidate_pairs without stands_for.

    Most pairs come once. So hashes alone are counted first; only pairs whose hash shares its mark with a repeated one are
    shuffled as a whole, to keep the first. That is exact however many repeat: a mark too many costs a shuffle, no result.
    """
    met = _met(_dealt(provisions))
    return _distinct(met, met)


def _distinct(met: DataFrame, bare: DataFrame) -> DataFrame:
    repeated = bare.groupBy("texts_hash").agg(F.count("*").alias("n")).where("n > 1")
    marks = F.broadcast(repeated.select(_mark(F.col("texts_hash")).alias("_mark")).distinct())
    marked = met.withColumn("_mark", _mark(F.col("texts_hash")))
    shared = marked.join(marks, "_mark", "left_semi").drop("_mark")
    return _named(marked.join(marks, "_mark", "left_anti").drop("_mark")).unionByName(_once(_named(shared)))


def _standing(dealt: DataFrame) -> DataFrame:
    """topic, standing: by their hash, texts of the topic that may mean several provisions, and how many; few topics may have any."""
    rows = _index_rows(dealt).withColumn("_h", F.xxhash64("text"))
    meant = F.xxhash64("meant")
    several = rows.groupBy("_h").agg(F.min(meant).alias("_low"), F.max(meant).alias("_high")).where("_low < _high")
    marks = several.select(_mark(F.col("_h")).alias("_mark")).distinct()
    near = rows.withColumn("_mark", _mark(F.col("_h"))).join(F.broadcast(marks), "_mark", "left_semi").select("topic", "text", "_h", "meant")
    listed = near.groupBy("text").agg(F.count_distinct("meant").alias("n")).where("n > 1")
    return near.join(listed, "text").groupBy("topic").agg(F.map_from_entries(F.collect_set(F.struct("_h", "n"))).alias("standing"))


def candidate_pairs(provisions: DataFrame) -> DataFrame:
    """PAIR_COLUMNS, and pair: all pairs of all strata, each text pair once for each stratum, date and link.

    Of equal pairs of several topics, which ambiguous wordings make, the smallest topic's stays. A topic without one of its
    provisions has no pairs of it. stands_for is the larger number of provisions that either text may mean.
    """
    dealt = _dealt(provisions)
    return _distinct(_met(dealt, _standing(dealt)), _met(dealt)).select("pair", *PAIR_COLUMNS)


def _order() -> Column:
    return F.md5(F.concat_ws("|", "pair", "as_of", "link"))


def quota_pairs(provisions: DataFrame, most: dict[str, int]) -> DataFrame:
    """quota of the named strata's candidate_pairs, without making all of them whole.

    Each prefix of hashes that occurs in a stratum holds one of its pairs at least, so that the first `most` prefixes hold
    all that the quota takes; only their pairs are told apart, ranked, and looked up in the index.
    """
    dealt = _dealt(provisions)
    met = _named(_met(dealt).where(F.col("stratum").isin(*most))).withColumn("_prefix", F.conv(F.substring(_order(), 1, 4), 16, 10).cast("int"))
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("_prefix"))
    wanted = F.coalesce(*[F.when(F.col("stratum") == s, n) for s, n in most.items()], F.lit(0))
    last = met.select("stratum", "_prefix").distinct().withColumn("_place", place).where(F.col("_place") <= wanted).groupBy("stratum").agg(F.max("_prefix").alias("_last"))
    taken = quota(_once(met.join(F.broadcast(last), "stratum").where("_prefix <= _last").drop("_prefix", "_last")), most)
    taken = written(taken, "taken")
    texts = taken.select(F.explode(F.array("text_i", "text_j")).alias("text")).distinct()
    listed = _index_rows(dealt).join(F.broadcast(texts), "text").groupBy("text").agg(F.count_distinct("meant").alias("n"))
    n = lambda s: F.broadcast(listed.select(F.col("text").alias(f"text_{s}"), F.col("n").alias(f"n_{s}")))
    return taken.join(n("i"), "text_i").join(n("j"), "text_j").withColumn("stands_for", F.greatest("n_i", "n_j")).select("pair", *PAIR_COLUMNS)


def quota(pairs: DataFrame, most: dict[str, int]) -> DataFrame:
    """pairs with the first `most` of each stratum in order of their names' hash; a stratum that is not named stays whole.

    The rank is cut before the shuffle too, so that a stratum's task sees `most` rows of each task.
    """
    order = Window.partitionBy("stratum").orderBy(_order(), "pair", "as_of", "link")
    limited = pairs.where(F.col("stratum").isin(*most))
    largest = max(most.values(), default=0)
    ranked = limited.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= largest)
    kept = F.lit(False)
    for stratum, n in most.items():
        kept = kept | ((F.col("stratum") == stratum) & (F.col("_rank") <= n))
    return ranked.where(kept).drop("_rank").unionByName(pairs.where(~F.col("stratum").isin(*most)))


@F.pandas_udf(StringType())
def asserted_key(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The key that the answer parser gives a text's first citation, or NONE."""
    for batch in texts:
        yield batch.map(lambda t: first_key(t or ""))


def mismatched_forms(index: DataFrame) -> DataFrame:
    """Wordings (text, key, asserted) whose citation the answer parser does not read as the provision they were made of."""
    forms = index.select("text", "key").distinct()
    return forms.withColumn("asserted", asserted_key("text")).where(F.col("asserted") != F.col("key"))
