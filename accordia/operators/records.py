"""Whole records of items, labelled pairs, candidate items and generated banks, with the rules that they must keep."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordia.functions.text import base_key, normal_key, pair_id, text_hash
from accordia.operators import agreement
from accordia.operators.relations import LABELS, deduplicated, pairs
from accordia.operators.tables import written

# Labels that are kept for later, splits, verifiers, and links that make two provisions one.
RESERVED = ("OUTDATED_PROVISION", "TEMPORAL_MISMATCH", "JURISDICTION_MISMATCH")
SPLITS = ("train", "dev", "test")
VERIFIERS = ("pending", "structural", "human")
SAME_LAW = ("successor_of", "same_offence_as", "definition_of", "merged_into")


def records(samples: DataFrame) -> DataFrame:
    """Per item, of its samples (pos, text, key, act, correct, resolved, repealed, verdict, logprob): one wide row.

    Text clusters are those of equal texts; the returned answer is the largest of them, the first among equals, and its
    members' majority decides whether it is right and resolved. Keys give the view by provision.
    """
    # Samples are read for each part of the record: what they are made of is worked out once.
    samples = written(samples.select("item_id", "pos", "text", "key", "act", "correct", "resolved", "repealed", "verdict", "logprob"), "samples")
    labelled = written(samples.join(agreement.first_seen(samples).select("item_id", "pos", F.col("label").alias("cluster")), ["item_id", "pos"]), "labelled")
    text = agreement.profile(labelled, "cluster").select("item_id", F.col("n").alias("n_samples"), F.col("entropy").alias("disc_se"), (1 - F.col("top_share")).alias("agreement"), F.col("n_keys").alias("n_unique"), (F.col("n_keys") == 1).cast("int").alias("all_same"))
    prov = agreement.profile(samples).select("item_id", F.col("entropy").alias("prov_se"), (1 - F.col("top_share")).alias("prov_agreement"), F.col("n_keys").alias("prov_n_unique"), F.col("majority").alias("prov_majority"), (F.col("n_keys") == 1).cast("int").alias("prov_all_same"))
    modal = agreement.modal_outcome(labelled, "cluster").select("item_id", F.col("size").alias("majority_cluster_size"), F.col("frac_correct").alias("majority_frac_correct"), "majority_correct", "majority_resolved", F.col("verdict").alias("majority_verdict"))
    in_order = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col(c).cast("string").alias("v")))), lambda x: F.coalesce(x["v"], F.lit("null"))), "|")
    lists = samples.groupBy("item_id").agg(in_order("key").alias("asserted_keys"), in_order("verdict").alias("sample_verdicts"), F.avg(F.col("correct").cast("double")).alias("frac_correct"), F.avg((F.col("resolved") == 0).cast("double")).alias("frac_unresolved"), F.avg(F.col("repealed").cast("double")).alias("repealed_code_share"), (1 - F.exp(F.avg("logprob"))).alias("p_true"))
    return text.join(prov, "item_id").join(modal, "item_id").join(lists, "item_id")


def canonical_key(samples: DataFrame) -> DataFrame:
    """Per item: its most frequent known key, ties to the first by name; NONE without one."""
    counts = samples.groupBy("item_id", "key").agg(F.count("*").alias("c"))
    return counts.groupBy("item_id").agg(F.coalesce(F.min_by(F.when(F.col("key") != "NONE", F.col("key")), F.when(F.col("key") != "NONE", F.struct(-F.col("c"), F.col("key")))), F.lit("NONE")).alias("canonical"))


def assertion_key(act: Column, provision: Column) -> Column:
    """The key of a labelled pair's assertion, whose sentinels differ from those of answers."""
    nothing, foreign = act.isNull() & provision.isNull(), act == "FOREIGN"
    named = F.coalesce(act, F.lit("UNKNOWN_ACT"))
    return F.when(nothing, "NONE").when(foreign, F.concat(F.lit("FOREIGN:"), F.coalesce(provision, F.lit("?")))).when(provision.isNull(), F.concat(named, F.lit(" (no section)"))).otherwise(F.concat_ws(" ", named, provision))


def _broken(p: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return p.withColumn("broken", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()])))


def pair_violations(p: DataFrame, strata: tuple[str, ...]) -> DataFrame:
    """Pair rows (pair, text_i, text_j, key_i, key_j, label, split, stratum, verifier, condition) with the list of broken rules."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    among = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    conditional = F.coalesce(F.col("label") == "CONDITIONALLY_EQUIVALENT", F.lit(False))
    return _broken(p, {
        "unknown label": ~among("label", LABELS), "reserved label": among("label", RESERVED), "unknown split": ~among("split", SPLITS), "unknown stratum": ~among("stratum", strata),
        "unknown verifier": ~among("verifier", VERIFIERS), "empty first text": blank("text_i"), "empty second text": blank("text_j"), "no condition": conditional & blank("condition"),
        "needless condition": ~conditional & ~blank("condition"), "ambiguous equal keys": (F.col("label") == "AMBIGUOUS") & (F.col("key_i") == F.col("key_j")) & (F.col("key_i") != "NONE"), "no pair id": blank("pair"),
    })


def structural(p: DataFrame) -> DataFrame:
    """Pair rows (label, key_i, key_j, link, condition) with the reasons why keys and link do not entail the label."""
    same, known = F.col("key_i") == F.col("key_j"), (F.col("key_i") != "NONE") & (F.col("key_j") != "NONE")
    of = lambda label: F.col("label") == label
    no = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return _broken(p, {
        "same without keys": of("SAME_PROVISION") & ~known, "same of different keys": of("SAME_PROVISION") & known & ~same, "equivalent of equal keys": of("LEGALLY_EQUIVALENT") & same,
        "equivalent without a link": of("LEGALLY_EQUIVALENT") & no("link"), "conditional without a condition": of("CONDITIONALLY_EQUIVALENT") & no("condition"),
        "different of equal keys": of("DIFFERENT_PROVISION") & same & known, "different but linked": of("DIFFERENT_PROVISION") & F.col("link").isin(*SAME_LAW), "ambiguous of equal keys": of("AMBIGUOUS") & same & known,
    })


def observed_pairs(samples: DataFrame, label: Column, link: Column, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(the first `most` usable pairs of each item that pass `structural`, once for each pair id and link; broken rules with counts)."""
    p = pairs(samples, most).withColumns({"label": label, "link": link, "condition": F.lit(None).cast("string")})
    checked = structural(p).withColumns({"pair": pair_id(F.col("text_i"), F.col("text_j")), "hash_i": text_hash(F.col("text_i")), "hash_j": text_hash(F.col("text_j"))})
    rejects = checked.where(F.size("broken") > 0).groupBy(F.col("broken")[0].alias("rule")).agg(F.count("*").alias("n"))
    good = checked.where(F.size("broken") == 0).withColumn("link", F.coalesce("link", F.lit(""))).drop("broken")
    return deduplicated(good, ["pair", "link"], ["item_id", "i", "j"]), rejects


def unforced(p: DataFrame) -> DataFrame:
    """Pairs whose relation a model must tell: all but those of one known key."""
    return p.where(~((F.col("key_i") == F.col("key_j")) & (F.col("key_i") != "NONE")))


def candidate_violations(items: DataFrame, required: list[str], slices: tuple[str, ...]) -> DataFrame:
    """key, rule: every rule that a candidate item breaks; an item must not claim to be verified yet."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    rules = {f"missing {c}": blank(c) for c in required} | {
        "unknown slice": ~blank("slice") & ~F.col("slice").isin(*slices), "missing gold.act": blank("gold_act"), "missing gold.provision": blank("gold_provision"),
        "no verified flag": F.col("verified").isNull(), "verified": F.col("verified"), "missing source": blank("source"),
    }
    key = F.col("item_id").cast("string").alias("key")
    broken = _broken(items, rules).select(key, F.explode("broken").alias("rule"))
    twice = items.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1 and key is not null").select("key", F.lit("duplicate").alias("rule"))
    return broken.unionByName(twice)


def link_violations(statutes: DataFrame, links: DataFrame) -> DataFrame:
    """key, rule: statutes that come twice, links to unknown ones, links without their mirror, bases whose windows differ."""
    s = statutes.withColumn("key", normal_key(F.col("statute")))
    twice = s.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key", F.lit("duplicate").alias("rule"))
    a, known = links.select(normal_key(F.col("from")).alias("f"), normal_key(F.col("to")).alias("t")).distinct(), s.select("key").distinct()
    lost = a.join(known, F.col("t") == F.col("key"), "left_anti").select(F.col("f").alias("key"), F.lit("unknown link").alias("rule"))
    mirror = a.select(F.col("t").alias("_f"), F.col("f").alias("_t"))
    alone = a.join(mirror, (F.col("f") == F.col("_f")) & (F.col("t") == F.col("_t")), "left_anti").select(F.col("f").alias("key"), F.lit("one-sided link").alias("rule"))
    windows = s.groupBy(base_key(F.col("statute")).alias("key")).agg(F.count_distinct(F.struct("begin", "end")).alias("_n")).where("_n > 1").select("key", F.lit("different windows").alias("rule"))
    return twice.unionByName(lost).unionByName(alone).unionByName(windows).distinct()


def statute_rows(crosswalk: DataFrame, change: str, start: str) -> DataFrame:
    """Two rows for each (old, new) pair of sections: the old one until the change, the new one from it; equal rows once."""
    day = lambda x: F.lit(x).cast("timestamp")
    old = F.struct(F.col("old").alias("statute"), day(start).alias("begin"), day(change).alias("end"))
    new = F.struct(F.col("new").alias("statute"), day(change).alias("begin"), F.lit(None).cast("timestamp").alias("end"))
    return crosswalk.select(F.explode(F.array(old, new)).alias("r")).select("r.*").distinct()


def question_bank(topics: DataFrame, frames: DataFrame, contexts: DataFrame, count: int, seed: int, sides: tuple[str, ...]) -> DataFrame:
    """item_id, pair_id, slice, topic, frame, context: the first `count` combinations by a hash, one item for each side.

    topics (topic), frames (frame) and contexts (context) are short lists; their combinations are what is asked for.
    """
    every = topics.select("topic").join(F.broadcast(frames.select("frame")), F.lit(True)).join(F.broadcast(contexts.select("context")), F.lit(True))
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), "topic", "frame", "context"), 256)
    first = every.withColumn("_h", order).orderBy("_h").limit(count)
    numbered = first.withColumn("_n", F.row_number().over(Window.orderBy("_h")) - 1)
    pair = F.concat(F.col("topic"), F.lit("-"), F.lpad(F.col("_n").cast("string"), 3, "0"))
    return numbered.withColumn("slice", F.explode(F.array(*map(F.lit, sides)))).select(F.concat_ws("-", "slice", pair).alias("item_id"), pair.alias("pair_id"), "slice", "topic", "frame", "context")


def pilot_selection(items: DataFrame, per_slice: int, seed: int, key: str = "item_id") -> DataFrame:
    """The first per_slice items of each slice by a seeded hash."""
    order = Window.partitionBy("slice").orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256), key)
    return items.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_slice).drop("_r")


def pilot_cost(questions: DataFrame, prompt_tokens: str, samples: int, answer_tokens: int, prompt_price: float, answer_price: float) -> DataFrame:
    """One row: calls, prompt and answer tokens at most, and what they cost at prices for a million tokens."""
    calls, tokens = F.count("*") * samples, F.sum(prompt_tokens) * samples
    answers = calls * answer_tokens
    return questions.agg(calls.alias("calls"), tokens.alias("prompt_tokens"), answers.alias("answer_tokens"), ((tokens * prompt_price + answers * answer_price) / 1e6).alias("cost"))


def slice_outcomes(items: DataFrame, least: int = 1) -> DataFrame:
    """Per slice of items (slice, correct 0, 1 or null): counts, and whether it is ready, has one class, or nothing resolved."""
    agg = items.groupBy("slice").agg(F.count("*").alias("n"), F.count("correct").alias("resolved"), F.coalesce(F.sum("correct"), F.lit(0)).cast("long").alias("right"))
    wrong = F.col("resolved") - F.col("right")
    state = F.when(F.col("resolved") == 0, "unresolved").when((F.col("right") >= least) & (wrong >= least), "both_classes").when(F.col("right") < least, "too_few_right").otherwise("too_few_wrong")
    return agg.withColumns({"wrong": wrong, "state": state})


def checklist(statutes: DataFrame) -> DataFrame:
    """The rows that a reviewer fills in: key and an empty answer."""
    return statutes.select(normal_key(F.col("statute")).alias("key"), F.lit("").alias("verified"), "statute")


def apply_checklist(statutes: DataFrame, answers: DataFrame) -> DataFrame:
    """statutes with verified by the reviewer's answers: y, yes, true and 1 are yes, n, no, false and 0 are no, others change nothing.

    Answers of unknown keys are skipped; of several for one key, one yes is enough.
    """
    said = F.lower(F.trim(F.coalesce("verified", F.lit(""))))
    parsed = answers.select(normal_key(F.col("key")).alias("_k"), F.when(said.isin("y", "yes", "true", "1"), True).when(said.isin("n", "no", "false", "0"), False).alias("_v")).groupBy("_k").agg(F.bool_or("_v").alias("_v"))
    return statutes.join(parsed, normal_key(F.col("statute")) == F.col("_k"), "left").withColumn("verified", F.coalesce("_v", "verified")).drop("_k", "_v")


def training_texts(statutes: DataFrame, answers: DataFrame) -> DataFrame:
    """text: all distinct texts with words, of statutes and answers, without blanks around them."""
    both = statutes.select(F.trim("text").alias("text")).unionByName(answers.select(F.trim("text").alias("text")))
    return both.where("text <> ''").distinct()


def to_json(rows: DataFrame, fields: list[str], name: str = "record") -> DataFrame:
    """rows with the fields as one JSON text, nulls written out, so that a record tells unknown from absent."""
    return rows.withColumn(name, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).drop(*fields)


def from_json(rows: DataFrame, schema: str, name: str = "record") -> DataFrame:
    """The fields of to_json again; a text that is no record of the schema is an error."""
    return rows.withColumn("_r", F.from_json(name, schema, {"mode": "FAILFAST"})).select(*[c for c in rows.columns if c != name], "_r.*")


def document(value) -> str:
    """A report as JSON text; NaN and infinity are an error."""
    return json.dumps(value, indent=2, ensure_ascii=False, allow_nan=False, sort_keys=True) + "\n"


def markdown(rows: list[dict], columns: list[str], places: int = 3) -> str:
    """A Markdown table of a report's rows; undefined numbers are a dash."""

    def shown(x) -> str:
        if x is None or (isinstance(x, float) and not math.isfinite(x)):
            return "-"
        return f"{x:.{places}f}" if isinstance(x, float) else str(x).replace("|", "\\|")

    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(shown(r.get(c)) for c in columns) + " |" for r in rows)]) + "\n"


def plan_digest(selected: DataFrame, settings: dict[str, object]) -> str:
    """The SHA-256 of a plan: its settings, and the items (column item_id) that it takes, in any order, each as often as it comes.

    Items are hashed and summed on the executors; a number and a sum come to the driver.
    """
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("item_id").cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("decimal(38,0)")
    n, total = selected.agg(F.count("*"), F.sum(number)).first()
    return hashlib.sha256(f"{json.dumps(settings, sort_keys=True)}|{n}|{total or 0}".encode()).hexdigest()


def approved(selected: DataFrame, settings: dict[str, object], approval: str | None, cost: float, cap: float) -> str:
    """The digest of a plan that may run: an error if it costs over the cap, was not approved, or is not what was approved."""
    digest = plan_digest(selected, settings)
    if cost > cap:
        raise PermissionError(f"the plan costs {cost} of {cap}")
    if approval is None:
        raise PermissionError(f"the plan {digest} was not approved")
    if approval != digest:
        raise PermissionError(f"the plan is {digest}, approved was {approval}")
    return digest
