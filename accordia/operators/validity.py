"""Look-ups in a table of rows valid from a date (inclusive) until another (exclusive; null: open)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordia.functions.text import base_key, is_reference, normal_key


def in_force(day: Column, begin: Column, end: Column) -> Column:
    """Null for an unknown row (no begin)."""
    return F.when(begin.isNotNull() & day.isNotNull(), (begin <= day) & (end.isNull() | (day < end)))


#: Rows of one key that one task takes; a key of more is dealt out over its span of days.
KEY_ROWS = 1 << 16
_OPEN = (1 << 63) - 1


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, part and time, intervals before probes -> probes with each interval that is open then.

    The open intervals of the current key and part are all that is carried along.
    """
    carried, at = None, None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if carried is None else [carried, batch]).combine_chunks().to_batches()
        if not rows:
            continue
        (rows,) = rows
        key, part, time, end, probe = (rows.column(c).to_pylist() for c in ("k", "part", "t", "e", "probe"))
        first = rows.num_rows - batch.num_rows
        open_ = list(range(first))
        asked: list[int] = []
        met: list[int | None] = []
        for i in range(first, rows.num_rows):
            if (key[i], part[i]) != at:
                at, open_ = (key[i], part[i]), []
            if not probe[i]:
                open_.append(i)
                continue
            if open_:
                open_ = [j for j in open_ if end[j] > time[i]] if time[i] is not None else open_
            found = open_ if time[i] is not None and key[i] is not None else []
            asked += [i] * max(1, len(found))
            met += found or [None]
        carried = rows.take(pa.array(open_, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column("p").take(pa.array(asked, pa.int64())), rows.column("i").take(pa.array(met, pa.int64()))], ["p", "i"])


def as_of(probes: DataFrame, intervals: DataFrame, key: str, day: str, key_rows: int = KEY_ROWS) -> DataFrame:
    """probes with the row (begin, end, value) of their key in force on their day; several, if its intervals overlap.

    Probes and intervals are sorted once, together, by key and time, and the open intervals are carried along: rows read
    and sorted grow with the probes and intervals alone. A key of over key_rows rows is cut into parts of its span of days,
    each of which also gets the intervals that are open at its start. Intervals without a key or begin are never met; a probe
    without a key, a day, or an interval in force has nulls.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    p = probes.select(F.col(key).alias("k"), micros(F.col(day)).alias("t"), F.struct(*probes.columns).alias("p"))
    i = intervals.where(F.col(key).isNotNull() & F.col("begin").isNotNull()).select(F.col(key).alias("k"), micros(F.col("begin")).alias("t"), F.coalesce(micros(F.col("end")), F.lit(_OPEN)).alias("e"), F.struct("begin", "end", "value").alias("i"))
    sizes = p.select("k", "t").unionByName(i.select("k", "t")).groupBy("k").agg(F.count("*").alias("_n"), F.min("t").alias("_low"), F.max("t").alias("_high")).where(F.col("_n") > key_rows)
    hot = sizes.select(F.col("k").alias("_k"), F.ceil(F.col("_n") / key_rows).alias("_c"), "_low", (F.col("_high") - F.col("_low") + 1).alias("_span"))
    part = lambda t: F.coalesce(F.least(F.greatest(F.floor((t - F.col("_low")).cast("double") * F.col("_c") / F.col("_span")), F.lit(0)), F.col("_c") - 1), F.lit(0)).cast("int")
    last = F.when(F.col("_c").isNull() | (F.col("e") <= F.col("t")), part(F.col("t"))).otherwise(part(F.col("e") - 1))
    listed = i.join(hot, F.col("k") == F.col("_k"), "left").withColumn("part", F.explode(F.sequence(part(F.col("t")), last)))
    both = p.join(hot, F.col("k") == F.col("_k"), "left").select("k", part(F.col("t")).alias("part"), "t", F.lit(None).cast("long").alias("e"), F.lit(True).alias("probe"), "p", F.lit(None).cast(i.schema["i"].dataType).alias("i"))
    both = both.unionByName(listed.select("k", "part", "t", "e", F.lit(False).alias("probe"), F.lit(None).cast(p.schema["p"].dataType).alias("p"), "i"))
    found = both.repartition("k", "part").sortWithinPartitions("k", "part", "t", "probe").mapInArrow(_carry, T.StructType([T.StructField("p", p.schema["p"].dataType), T.StructField("i", i.schema["i"].dataType)]))
    return found.select("p.*", "i.begin", "i.end", "i.value")


def resolve(references: DataFrame, statutes: DataFrame, key: str = "key") -> DataFrame:
    """references with the statute row of their key: the exact one, else the base key's, else the smallest key with that base."""
    s = statutes.withColumn("_full", normal_key(F.col("statute"))).withColumn("_base", base_key(F.col("statute")))
    exact = s.select(F.col("_full").alias("_e"), F.struct("statute", "begin", "end").alias("_x"))
    bases = s.groupBy("_base").agg(F.min_by(F.struct("statute", "begin", "end"), F.struct((F.col("_full") != F.col("_base")).cast("int"), F.col("_full"))).alias("_y"))
    met = references.join(exact, normal_key(F.col(key)) == F.col("_e"), "left").join(bases, base_key(F.col(key)) == F.col("_base"), "left")
    found = F.coalesce("_x", "_y")
    return met.select(*references.columns, found["statute"].alias("statute"), found["begin"].alias("begin"), found["end"].alias("end"))


def coverage(resolved: DataFrame, group: list[str], key: str = "key") -> DataFrame:
    """Per group: assertions, known (each counted), distinct unknown keys and their sorted list."""
    refs = resolved.where(is_reference(F.col(key)))
    unknown = F.when(F.col("statute").isNull(), normal_key(F.col(key)))
    return refs.groupBy(*group).agg(F.count("*").alias("assertions"), F.count("statute").alias("known"), F.count_distinct(unknown).alias("unknown"), F.array_join(F.sort_array(F.collect_set(unknown)), ",").alias("unknown_keys"))


def last_wins(links: DataFrame, order: str = "ord", default: str = "successor_of") -> DataFrame:
    """One row for each (from, to): the last by order; a null type is the default."""
    return links.groupBy("from", "to").agg(F.max_by(F.coalesce("type", F.lit(default)), order).alias("type"))


def relation(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """pairs (a, b) with the type of the link a -> b, else of b -> a, else null; none between equals."""
    one = links.select(F.col("from").alias("a"), F.col("to").alias("b"), F.col("type").alias("_f"))
    two = links.select(F.col("to").alias("a"), F.col("from").alias("b"), F.col("type").alias("_r"))
    met = pairs.join(one, ["a", "b"], "left").join(two, ["a", "b"], "left")
    return met.select(*pairs.columns, F.when(F.col("a") != F.col("b"), F.coalesce("_f", "_r")).alias("relation"))


def violations(intervals: DataFrame, key: str = "key") -> DataFrame:
    """key, rule: rows that end no later than they begin, have no begin or key, or overlap the key's next row."""
    w = Window.partitionBy(key).orderBy("begin", "ord")
    rows = intervals.withColumn("_next", F.lead("begin").over(w))
    rules = F.array(
        F.when(F.col(key).isNull(), "no key"), F.when(F.col("begin").isNull(), "no begin"), F.when(F.col("end") <= F.col("begin"), "empty"),
        F.when(F.col("_next").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("_next"))), "overlap"),
    )
    return rows.select(key, "ord", F.explode(F.array_compact(rules)).alias("rule"))


def neighbours(intervals: DataFrame, key: str = "key") -> DataFrame:
    """Each row with its predecessor's and successor's value in its key."""
    w = Window.partitionBy(key).orderBy("begin", "ord")
    return intervals.select(key, "ord", "value", F.lag("value").over(w).alias("predecessor"), F.lead("value").over(w).alias("successor"))


def context(samples: DataFrame, statutes: DataFrame, day: Column) -> DataFrame:
    """Per item: distinct references in first-seen order with their state, and how many assertions are none."""
    refs = samples.where(is_reference(F.col("key"))).groupBy("item_id", normal_key(F.col("key")).alias("key")).agg(F.min("pos").alias("first"))
    state = resolve(refs, statutes).withColumn("state", F.coalesce(in_force(day, F.col("begin"), F.col("end")).cast("string"), F.lit("unknown")))
    listed = state.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("first", F.concat_ws("=", "key", "state").alias("v")))).alias("l"))
    counts = samples.groupBy("item_id").agg(F.sum((~is_reference(F.col("key"))).cast("int")).alias("excluded"))
    return counts.join(listed, "item_id", "left").select("item_id", F.coalesce(F.array_join(F.transform("l", lambda x: x["v"]), ","), F.lit("")).alias("validity"), "excluded")


def index_stats(statutes: DataFrame) -> DataFrame:
    """One row: rows, distinct keys, rows without an end, and the first and last key."""
    return statutes.agg(F.count("*").alias("n_rows"), F.count_distinct("statute").alias("n_keys"), F.coalesce(F.sum(F.col("end").isNull().cast("long")), F.lit(0)).alias("open_rows"), F.min("statute").alias("first_key"), F.max("statute").alias("last_key"))


def era_day(slice_: Column, eras: dict[str, str], fixed: str) -> Column:
    """The day on which a slice's answers are judged: its era's, else the fixed one."""
    out = F.lit(fixed)
    for name, day in eras.items():
        out = F.when(slice_ == name, day).otherwise(out)
    return out.cast("timestamp")


def state_census(samples: DataFrame, statutes: DataFrame, day: Column, group: str = "slice") -> DataFrame:
    """Per group, of assertions that can be looked up: how many are in force on their day, are not, or are unknown."""
    refs = samples.where(is_reference(F.col("key"))).withColumn("_day", day).select(group, "key", "_day").groupBy(group, "key", "_day").agg(F.count("*").alias("_n"))
    held = in_force(F.col("_day"), F.col("begin"), F.col("end"))
    state = F.when(held.isNull(), "unknown").when(held, "in_force").otherwise("not_in_force")
    return resolve(refs, statutes).groupBy(group, state.alias("state")).agg(F.sum("_n").alias("n"))


def field_violations(rows: DataFrame, acts: tuple[str, ...], key: str = "key") -> DataFrame:
    """key, ord, rule: rows of an unknown act, without a section, or that end no later than they begin; all of them."""
    rules = F.array(
        F.when(F.coalesce(F.trim("section"), F.lit("")) == "", "missing section"), F.when(~F.coalesce(F.col("act").isin(*acts), F.lit(False)), "unknown act"),
        F.when(F.col("end") <= F.col("begin"), "empty"),
    )
    return rows.select(key, "ord", F.explode(F.array_compact(rules)).alias("rule"))


def loaded(rows: DataFrame, acts: tuple[str, ...], key: str = "key") -> DataFrame:
    """rows, if none breaks a rule; else an error that lists up to a hundred of the broken ones."""
    broken = field_violations(rows, acts, key).orderBy(key, "ord", "rule").limit(101).collect()
    if broken:
        said = "; ".join(f"{r[key]} {r['ord']}: {r['rule']}" for r in broken[:100])
        raise ValueError(said + ("; and more" if len(broken) > 100 else ""))
    return rows


def item_context(items: DataFrame, samples: DataFrame, statutes: DataFrame, links: DataFrame, day: Column) -> DataFrame:
    """Per item (item_id, gold, trap: keys or null): state of what its samples assert and of gold and trap, and the declared link.

    validity lists key=state in first-seen order, gold and trap last; coverage counts distinct references and those known;
    excluded counts distinct assertions that are none; relation is the declared one of trap and gold, either way round.
    """
    first = samples.groupBy("item_id", "key").agg(F.min("pos").cast("long").alias("first"))
    own = first.where(is_reference(F.col("key"))).select("item_id", normal_key(F.col("key")).alias("key"), "first")
    extra = items.select("item_id", F.explode(F.array(F.struct(F.col("gold").alias("key"), F.lit(1 << 40).alias("first")), F.struct(F.col("trap").alias("key"), F.lit((1 << 40) + 1).alias("first")))).alias("x"))
    extra = extra.select("item_id", normal_key(F.col("x.key")).alias("key"), F.col("x.first").alias("first")).where("key <> ''")
    every = own.withColumn("said", F.lit(1)).unionByName(extra.withColumn("said", F.lit(0))).groupBy("item_id", "key").agg(F.min("first").alias("first"), F.max("said").alias("said"))
    state = resolve(every, statutes).withColumn("state", F.coalesce(in_force(day, F.col("begin"), F.col("end")).cast("string"), F.lit("unknown")))
    listed = state.groupBy("item_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", F.concat_ws("=", "key", "state").alias("v")))), lambda x: x["v"]), ",").alias("validity"),
        F.sum("said").alias("assertions"), F.sum(F.when(F.col("statute").isNotNull(), F.col("said")).otherwise(0)).alias("known"),
    )
    excluded = first.groupBy("item_id").agg(F.sum((~is_reference(F.col("key"))).cast("long")).alias("excluded"))
    out = items.select("item_id", normal_key(F.col("trap")).alias("a"), normal_key(F.col("gold")).alias("b")).join(listed, "item_id", "left").join(excluded, "item_id", "left")
    out = relation(out, links)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("item_id", F.coalesce("validity", F.lit("")).alias("validity"), zero("assertions"), zero("known"), zero("excluded"), "relation")
