"""Warranted agreement: the modal answer's share A, weighed by validity T, jurisdiction J and contradiction K."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordia.functions.text import is_reference, normal_key
from accordia.functions.vocabulary import CURRENT_ACTS, REPEALED_ACTS
from accordia.operators.tables import written
from accordia.operators.validity import in_force, resolve

HOME_ACTS = REPEALED_ACTS + CURRENT_ACTS


def factors(samples: DataFrame, statutes: DataFrame, links: DataFrame, day: Column, home: tuple[str, ...] = HOME_ACTS) -> DataFrame:
    """Per item: modal_key, a, t, j, k of exact-key clusters.

    t is the share in force of the modal cluster's known members, j that of home acts among those with an act, k the mass
    of other clusters whose key has a declared contradiction (links from, to) with the modal one; 0 for a lone cluster,
    null for several without links. What nothing is known about is null, never 0.
    """
    counts = samples.groupBy("item_id", "key").agg(F.count("*").alias("c"))
    modal = counts.groupBy("item_id").agg(F.sum("c").alias("m"), F.count("*").alias("n_clusters"), F.min_by(F.struct("key", "c"), F.struct(-F.col("c"), F.col("key"))).alias("b"))
    modal = modal.select("item_id", "m", "n_clusters", F.col("b.key").alias("key"), F.col("b.c").alias("c"))
    t = F.avg(in_force(day, F.col("begin"), F.col("end")).cast("double")).alias("t")
    state = resolve(modal, statutes)
    act = F.when((F.col("key") != "NONE") & ~F.col("key").startswith("FOREIGN"), F.split("key", " ")[0]).when(F.col("key").startswith("FOREIGN"), "FOREIGN")
    judged = state.groupBy("item_id", "m", "n_clusters", "key", "c").agg(t).withColumn("j", F.when(act.isNotNull(), act.isin(*home).cast("double")))
    both = links.select(F.col("from").alias("x"), F.col("to").alias("y")).unionByName(links.select(F.col("to").alias("x"), F.col("from").alias("y"))).distinct()
    others = counts.withColumnRenamed("key", "other").join(judged.select("item_id", "key"), "item_id").where("other <> key and other <> 'NONE'")
    mass = others.join(both, (F.col("key") == F.col("x")) & (F.col("other") == F.col("y")), "left_semi").groupBy("item_id").agg(F.sum("c").alias("against"))
    met = judged.join(mass, "item_id", "left")
    return met.select("item_id", F.col("key").alias("modal_key"), (F.col("c") / F.col("m")).alias("a"), "t", "j", (F.coalesce("against", F.lit(0)) / F.col("m")).alias("k"), "n_clusters")


def compose(a: Column, t: Column, j: Column, k: Column) -> tuple[Column, Column]:
    """(warranted agreement, common mode): null if a factor is."""
    w = a * t * j * (1 - k)
    return w, a - w


def flags(t: Column, j: Column, k: Column, temporal: float = 1.0, jurisdiction: float = 1.0, contradiction: float = 0.0) -> Column:
    found = F.array(F.when(t.isNull(), "unresolvable"), F.when(t < temporal, "stale"), F.when(j < jurisdiction, "foreign"), F.when(k > contradiction, "contradiction"))
    return F.array_compact(found)


def flag_census(detected: DataFrame, group: list[str]) -> DataFrame:
    """Per group and flag: how many items have it; no flag counts as none."""
    return detected.select(*group, F.explode(F.when(F.size("flags") > 0, F.col("flags")).otherwise(F.array(F.lit("none")))).alias("flag")).groupBy(*group, "flag").agg(F.count("*").alias("n"))


def confusion(detected: DataFrame, group: list[str]) -> DataFrame:
    """Per group, a fired flag against a wrong answer: tp, fp, fn, tn, recall, false alarm rate (0 without right answers)."""
    fires, wrong = F.size("flags") > 0, F.col("correct") == 0
    count = lambda c: F.sum(c.cast("int"))
    cells = detected.groupBy(*group).agg(count(fires & wrong).alias("tp"), count(fires & ~wrong).alias("fp"), count(~fires & wrong).alias("fn"), count(~fires & ~wrong).alias("tn"))
    return cells.select("*", F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.coalesce(F.try_divide("fp", F.col("fp") + F.col("tn")), F.lit(0.0)).alias("far"))


def ablations(detected: DataFrame) -> DataFrame:
    """Each item once for every pinned factor (none, t, j, k): pin, cm."""
    one, zero = F.lit(1.0), F.lit(0.0)
    pin = lambda name, t, j, k: F.struct(F.lit(name).alias("pin"), t.alias("t"), j.alias("j"), k.alias("k"))
    t, j, k = F.col("t"), F.col("j"), F.col("k")
    pins = F.array(pin("none", t, j, k), pin("t", one, j, k), pin("j", t, one, k), pin("k", t, j, zero))
    rows = detected.withColumn("_p", F.explode(pins))
    _, cm = compose(F.col("a"), F.col("_p.t"), F.col("_p.j"), F.col("_p.k"))
    return rows.select("item_id", "correct", F.col("_p.pin").alias("pin"), cm.alias("cm"))


def detect(samples: DataFrame, statutes: DataFrame, links: DataFrame, day: Column, source: str = "auto", model_mass: DataFrame | None = None, home: tuple[str, ...] = HOME_ACTS) -> DataFrame:
    """Per item, of samples in clusters (item_id, pos, key, label): factors, where contradiction comes from, flags, w and cm.

    The modal cluster is the largest, ties to the smallest label; its key is its most frequent one, ties by name. source:
    rule (declared contradictions between the modal key and the first most frequent key of another cluster), model (from
    model_mass: item_id, mass), none, or auto, which takes the rule if there are links, else the model, else 0 for a lone
    cluster. What nothing is known about is null.
    """
    keys = written(samples.groupBy("item_id", "label", "key").agg(F.count("*").alias("c"), F.min("pos").alias("first")), "keys")
    clusters = keys.groupBy("item_id", "label").agg(F.sum("c").alias("size"), F.min_by("key", F.struct(-F.col("c"), F.col("key"))).alias("by_name"), F.min_by("key", F.struct(-F.col("c"), F.col("first"))).alias("by_place"))
    modal = clusters.groupBy("item_id").agg(F.sum("size").alias("m"), F.count("*").alias("n_clusters"), F.min_by(F.struct("label", "size", "by_name"), F.struct(-F.col("size"), F.col("label"))).alias("b"))
    modal = modal.select("item_id", "m", "n_clusters", F.col("b.label").alias("label"), F.col("b.size").alias("modal_size"), F.col("b.by_name").alias("modal_key"))
    members = keys.join(modal.select("item_id", "label"), ["item_id", "label"])
    held = resolve(members.where(is_reference(F.col("key"))).select("item_id", "key", "c"), statutes).withColumn("v", in_force(day, F.col("begin"), F.col("end")).cast("double")).where("v is not null")
    act = F.when(F.col("key").startswith("FOREIGN"), "FOREIGN").when((F.col("key") != "NONE") & ~F.col("key").startswith("UNKNOWN"), F.split("key", " ")[0])
    fit = members.withColumn("act", act).where("act is not null").groupBy("item_id").agg((F.sum(F.col("c") * F.col("act").isin(*home).cast("int")) / F.sum("c")).alias("j"))
    valid = held.groupBy("item_id").agg((F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("t"))
    out = modal.join(valid, "item_id", "left").join(fit, "item_id", "left")
    ruled = source == "rule" or (source == "auto" and not links.isEmpty())
    if ruled:
        x, y = normal_key(F.col("from")), normal_key(F.col("to"))
        both = links.select(x.alias("x"), y.alias("y")).unionByName(links.select(y.alias("x"), x.alias("y"))).distinct()
        others = clusters.select("item_id", "by_place", "size").join(modal.select("item_id", "modal_key"), "item_id").where("by_place <> modal_key and by_place <> 'NONE'")
        mass = others.join(both, (normal_key(F.col("modal_key")) == F.col("x")) & (normal_key(F.col("by_place")) == F.col("y")), "left_semi").groupBy("item_id").agg(F.sum("size").alias("against"))
        out = out.join(mass, "item_id", "left").withColumns({"k": F.coalesce("against", F.lit(0)) / F.col("m"), "contradiction_source": F.lit("rule")}).drop("against")
    elif source == "none":
        out = out.withColumns({"k": F.lit(None).cast("double"), "contradiction_source": F.lit("none")})
    elif model_mass is not None:
        out = out.join(model_mass.select("item_id", F.col("mass").alias("k")), "item_id", "left").withColumn("contradiction_source", F.lit("model"))
    else:
        lone = F.col("n_clusters") <= 1
        out = out.withColumns({"k": F.when(lone, 0.0), "contradiction_source": F.when(lone, "single_cluster").otherwise("no_signal")})
    w, cm = compose(F.col("a"), F.col("t"), F.col("j"), F.col("k"))
    out = out.withColumn("a", F.col("modal_size") / F.col("m"))
    return out.select("item_id", "modal_key", "modal_size", "n_clusters", "a", "t", "j", "k", "contradiction_source", flags(F.col("t"), F.col("j"), F.col("k")).alias("flags"), w.alias("w"), cm.alias("cm"))


def base_rates(detected: DataFrame) -> DataFrame:
    """One row, of items that are not unanimous: how many, and how often a flag fires, on all, right and wrong ones (0 without any)."""
    fired = (F.size("flags") > 0).cast("double")
    rate = lambda c: F.coalesce(F.avg(F.when(F.col("correct") == c, fired)), F.lit(0.0))
    return detected.where("unanimous = 0").agg(F.count("*").alias("n"), F.avg(fired).alias("fire_rate"), rate(1).alias("alarm_right"), rate(0).alias("alarm_wrong"))
