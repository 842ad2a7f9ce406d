"""Generated answers to items with a known provision, by regime, from hashes alone: the same on every run and engine.

Each template reaches one label of the judge; its marks are filled with names of acts, numbers, cues and foreign markers that
hashes of seed, item and position pick. Regime right answers rightly, in changing words; wrong repeats one wrong answer of an
item in all samples; mixed draws from all templates.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordia.functions.vocabulary import FOREIGN_MARKERS, OPERATIVE_CUES, REPEAL_CUES

REGIMES = ("right", "mixed", "wrong")


class Template(NamedTuple):
    text: str  # with {own}, {other}, {near}: names of the wanted act, its successor or predecessor, one of the same era
    old: str  # label if the wanted act is a repealed one
    new: str  # label if it is a current one


RIGHT = (
    Template("Section {n} of the {own}.", "gold", "gold"),
    Template("Section {n} of the {own}. The {cue} text was section {m} of the {other}.", "gold_with_superseded_note", "gold_with_superseded_note"),
    Template("Section {n} of the {own}. In {foreign} law one reads section {m}.", "gold_with_foreign_note", "gold_with_foreign_note"),
    Template("Some point to section {m} of the {own}. Section {n} of the {own} {operative} here.", "gold_operative", "gold_operative"),
    Template("Section {n} of the {own}. Another view is section {m} of the {own}.", "gold_first", "gold_first"),
    Template("Section {n} of the {own}. Yet section {m} of the {own} {operative} here.", "gold_first_only", "gold_first_only"),
)
OPEN = (
    Template("Section {m} of the {own} {operative} here. Or section {n} of the {own}.", "ambiguous", "ambiguous"),
    Template("It is under the {own}.", "no_provision_named", "no_provision_named"),
    Template("No specific provision comes to mind.", "declines", "declines"),
    Template("The law is silent, one may say.", "unresolved", "unresolved"),
)
WRONG = (
    Template("Section {m} of the {own}.", "wrong_section", "wrong_section"),
    Template("Section {m} of the {near}.", "wrong_act", "wrong_act"),
    Template("Section {m} of the {other}.", "premature_law", "stale_law"),
    Template("Section {m}.", "other_provision", "other_provision"),
    Template("In {foreign} law, section {m}.", "non_indian_act", "non_indian_act"),
    Template("That is a matter of {foreign} law.", "non_indian_act", "non_indian_act"),
    Template("It is under the {other}.", "premature_law_act_only", "stale_law_act_only"),
)
TEMPLATES = (*RIGHT, *OPEN, *WRONG)
#: Names by which acts are told: of the wanted one if repealed, if current, and of others of either era.
OLD, NEW = ("IPC", "Indian Penal Code", "ipc"), ("BNS", "Bharatiya Nyaya Sanhita", "bns")
#: As the only word of an answer, short names of the new act are no mention of an act alone.
NEAR_OLD, NEAR_NEW = ("CrPC", "Code of Criminal Procedure"), ("BSA", "Bharatiya Sakshya Adhiniyam", "Bharatiya Nagarik Suraksha Sanhita")
#: A sentence ends at a full stop, so that cues and markers with one in them are never met.
CUES, FOREIGN = tuple(c for c in REPEAL_CUES if "." not in c), tuple(m for m in FOREIGN_MARKERS if "." not in m)


def pick(seed: int, what: str, most: Column | int, *by: Column) -> Column:
    """A number below `most` from a hash."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(what), *[b.cast("string") for b in by])), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") % most).cast("int")


def answers(items: DataFrame, samples: int, seed: int = 0) -> DataFrame:
    """item_id, pos, gold_act, gold_provision, regime, text, expected: `samples` answers to each item.

    items: item_id, gold_act (IPC or BNS), gold_provision (a number as text). expected is the judge's label of the text.
    """
    i, p = F.col("item_id"), F.col("pos")
    rows = items.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    rows = rows.withColumn("regime", F.element_at(F.array(*map(F.lit, REGIMES)), pick(seed, "regime", len(REGIMES), i) + 1))
    first_wrong = len(RIGHT) + len(OPEN)
    at = F.when(F.col("regime") == "right", pick(seed, "template", len(RIGHT), i, p)).when(F.col("regime") == "wrong", first_wrong + pick(seed, "template", len(WRONG), i)).otherwise(pick(seed, "template", len(TEMPLATES), i, p))
    held = F.array(*[F.struct(F.lit(t.text).alias("text"), F.lit(t.old).alias("old"), F.lit(t.new).alias("new")) for t in TEMPLATES])
    rows = rows.withColumn("_t", F.element_at(held, at + 1))
    old = F.col("gold_act") == "IPC"
    among = lambda names, what: F.element_at(F.array(*map(F.lit, names)), pick(seed, what, len(names), i, p) + 1)
    n = F.col("gold_provision").cast("int")
    marks = {
        "own": F.when(old, among(OLD, "own")).otherwise(among(NEW, "own")), "other": F.when(old, among(NEW, "other")).otherwise(among(OLD, "other")), "near": F.when(old, among(NEAR_OLD, "near")).otherwise(among(NEAR_NEW, "near")),
        "n": F.col("gold_provision"), "m": (n + 1 + pick(seed, "number", 50, i, p)).cast("string"), "cue": among(CUES, "cue"), "operative": among(OPERATIVE_CUES, "operative"), "foreign": among(FOREIGN, "foreign"),
    }
    text = F.col("_t.text")
    for mark, value in marks.items():
        text = F.replace(text, F.lit("{" + mark + "}"), value)
    return rows.select("item_id", "pos", "gold_act", "gold_provision", "regime", text.alias("text"), F.when(old, F.col("_t.old")).otherwise(F.col("_t.new")).alias("expected"))
