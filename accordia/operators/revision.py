"""Keyed revisions of candidate items with an audit of each change, and manifests that bind a training set to its contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordia.operators import relations

ACTIONS = ("insert", "change", "retire")
#: Columns of a revision beside the items' own: what is done, why, and by whose decision.
NOTES = ["action", "reason", "decided_by"]


def numbered_items(plan: DataFrame) -> DataFrame:
    """plan (ord, topic, slice, old_act, old_number, new_act, new_number, question) with item_id, pair_id, and the wanted, trap and era of its slice.

    Items of a topic are numbered in the plan's order, with three digits or as many as the number has, those without a place (ord) last; those without a topic have no id. Slice L7 asks for the law of today: the new provision is wanted and the
    old one the trap; any other slice asks for the law before, the other way round.
    """
    n = F.format_string("%03d", F.row_number().over(Window.partitionBy("topic").orderBy(F.asc_nulls_last("ord"))))
    today = F.col("slice") == "L7"
    either = lambda a, b: F.when(today, F.col(a)).otherwise(F.col(b))
    pair = F.concat(F.col("topic").cast("string"), F.lit("-c"), n)
    return plan.select(
        F.when(pair.isNotNull(), F.concat_ws("-", "slice", pair)).alias("item_id"), pair.alias("pair_id"), "slice", "topic", F.when(today, "current").otherwise("pre-transition").alias("era"), "question",
        either("new_act", "old_act").alias("gold_act"), either("new_number", "old_number").alias("gold_provision"), either("old_act", "new_act").alias("trap_act"), either("old_number", "new_number").alias("trap_provision"), F.lit(False).alias("verified"),
    )


def problems(items: DataFrame, revisions: DataFrame, key: str) -> DataFrame:
    """key, problem: revisions without an item to change or retire, of a key that is revised twice or null, or of no known action."""
    known = items.select(F.col(key).alias("_k")).distinct()
    lost = revisions.where("action in ('change', 'retire')").join(known, F.col(key) == F.col("_k"), "left_anti").select(key, F.lit("no such item").alias("problem"))
    twice = revisions.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, F.lit("revised twice").alias("problem"))
    odd = revisions.where(F.col(key).isNull() | ~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))).select(key, F.lit("no key or action").alias("problem"))
    return lost.unionByName(twice).unionByName(odd).distinct()


def _met(items: DataFrame, revisions: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    fields = [c for c in items.columns if c not in (key, "retired")]
    r = revisions.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_r_{c}") for c in fields if c in revisions.columns], *[F.col(c).alias(f"_{c}") for c in NOTES])
    return items.withColumn("_here", F.lit(True)).join(r, F.col(key) == F.col("_key"), "full_outer"), [c for c in fields if c in revisions.columns]


def revise(items: DataFrame, revisions: DataFrame, key: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(items after the revisions; an audit row for each field that they change: key, action, field, before, after, reason, decided_by).

    revisions: key, action, reason, decided_by, and columns of items, null where a change leaves a field as it is. insert
    adds an item, and leaves one of that key alone; change sets fields; retire marks an item retired, and keeps it. The first
    problem (see problems) is an error when the result is used. Revised items claim no verification, if items have such a
    column. Applied to its own result, a revision changes nothing and its audit is empty.
    """
    if "retired" not in items.columns:
        items = items.withColumn("retired", F.lit(False))
    met, given = _met(items, revisions, key)
    action, here = F.col("_action"), F.coalesce(F.col("_here"), F.lit(False))
    bad = problems(items, revisions, key).agg(F.min(F.concat_ws(": ", "problem", F.col(key).cast("string"))).alias("_bad"))
    met = met.crossJoin(F.broadcast(bad)).where(F.coalesce(F.col("_bad").isNull(), F.lit(False)) | F.raise_error(F.concat(F.lit("refused, "), F.col("_bad"))).cast("boolean"))
    after: dict[str, Column] = {}
    for c in (c for c in items.columns if c != key):
        new = F.col(f"_r_{c}") if c in given else F.lit(None).cast(items.schema[c].dataType)
        after[c] = F.when(~here, new).when(action == "change", F.coalesce(new, F.col(c))).otherwise(F.col(c))
    after["retired"] = F.when(here & (action == "retire"), True).otherwise(F.coalesce(F.col("retired"), F.lit(False)))
    changed = F.lit(False)
    for c in after:
        changed = changed | (here & ~after[c].eqNullSafe(F.col(c)))
    if "verified" in after:
        after["verified"] = F.when(~here | changed, False).otherwise(F.col("verified"))
    name = F.coalesce(F.col(key), F.col("_key"))
    out = met.select(name.alias(key), *[after[c].alias(c) for c in items.columns if c != key])
    text = lambda c: c.cast("string")
    each = F.array(*[F.struct(F.lit(c).alias("field"), text(F.when(here, F.col(c))).alias("before"), text(after[c]).alias("after")) for c in after])
    rows = met.where(action.isNotNull()).select(name.alias(key), action.alias("action"), F.explode(each).alias("_f"), F.col("_reason").alias("reason"), F.col("_decided_by").alias("decided_by"))
    audit = rows.where(~F.col("_f.before").eqNullSafe(F.col("_f.after"))).select(key, "action", "_f.*", "reason", "decided_by")
    return out, audit


def content_number(columns: list[str]) -> Column:
    """A row's hash as a number below 2^48, of its columns as text; sums of it do not hang on the rows' order."""
    said = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(said), 1, 12), 16, 10).cast("decimal(38,0)")


def manifest(pairs: DataFrame, columns: list[str], scored: DataFrame, grid: list[float], version: str) -> DataFrame:
    """A row a split: split, n, n_labels, content (its rows' hashes summed), version, tau and f1, chosen on the dev split alone.

    pairs: split, label and `columns`. scored: split, score, gold; without rows of dev, tau is null. Two manifests are equal
    only if every split holds the same rows, however often and in whatever order.
    """
    splits = pairs.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("label").alias("n_labels"), F.sum(content_number(columns)).alias("content"))
    tau = relations.best_threshold(relations.threshold_sweep(scored.where("split = 'dev'").select("score", "gold"), grid))
    return splits.crossJoin(F.broadcast(tau)).withColumn("version", F.lit(version)).select("split", "n", "n_labels", "content", "version", "tau", "f1")


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """split, field, before, after: where two manifests differ; a split of one alone has nulls."""
    a, b = old.alias("a"), new.alias("b")
    met = a.join(b, F.col("a.split").eqNullSafe(F.col("b.split")), "full_outer")
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").cast("string").alias("before"), F.col(f"b.{c}").cast("string").alias("after")) for c in ("n", "n_labels", "content", "version", "tau", "f1")])
    return met.select(F.coalesce("a.split", "b.split").alias("split"), F.explode(each).alias("_f")).select("split", "_f.*").where("not (before <=> after)")


def feasibility(items: DataFrame, stored: DataFrame) -> DataFrame:
    """A row a slice, and pooled: n, scored, right, wrong, status (READY, SINGLE_CLASS or NO_SCORES), and moved, items whose part is not the stored one.

    items: item_id, slice, part, u, correct; stored: item_id, part. A part that either side alone has counts as moved.
    """
    usable = F.col("u").isNotNull() & ~F.isnan("u") & F.col("u").between(0.0, 1.0) & F.col("correct").isNotNull()
    met = items.join(stored.select(F.col("item_id").alias("_i"), F.col("part").alias("_part")), F.col("item_id") == F.col("_i"), "left")
    every = met.withColumn("slice", F.explode(F.array(F.col("slice").cast("string"), F.lit("pooled"))))
    count = lambda c: F.count_if(c)
    agg = every.groupBy("slice").agg(
        F.count("*").alias("n"), count(usable).alias("scored"), count(usable & (F.col("correct") == 1)).alias("right"), count(usable & (F.col("correct") == 0)).alias("wrong"), count(~F.col("part").eqNullSafe(F.col("_part"))).alias("moved"),
    )
    status = F.when(F.col("scored") == 0, "NO_SCORES").when((F.col("right") == 0) | (F.col("wrong") == 0), "SINGLE_CLASS").otherwise("READY")
    return agg.withColumn("status", status)


# Why a measurement is undefined.
NOT_INSTRUMENTED = "not_instrumented"


def deployment(seconds: DataFrame, stages: list[str], memory_mb: float | None = None) -> DataFrame:
    """A row a stage, and one of memory: stage, n, median, p95, mean, least, most, unit, undefined.

    seconds: stage, seconds (null, negative and non-finite ones are left out). A stage that nothing was measured of, and
    memory that is not given, are undefined with a reason, never 0.
    """
    if memory_mb is not None and not 0 <= memory_mb < float("inf"):
        raise ValueError("memory must be a finite number, 0 or more")
    ok = F.col("seconds").isNotNull() & ~F.isnan("seconds") & F.col("seconds").between(0.0, 1e300)
    quantile = lambda q: F.percentile("seconds", F.lit(q))
    got = seconds.where(ok).groupBy("stage").agg(F.count("*").alias("n"), quantile(0.5).alias("median"), quantile(0.95).alias("p95"), F.avg("seconds").alias("mean"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))
    wanted = seconds.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    rows = wanted.join(got, "stage", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("unit", F.lit("seconds"))
    x = F.lit(memory_mb).cast("double")
    memory = seconds.sparkSession.range(1).select(F.lit("memory").alias("stage"), x.isNotNull().cast("long").alias("n"), *[x.alias(c) for c in ("median", "p95", "mean", "least", "most")], F.lit("megabytes").alias("unit"))
    return rows.unionByName(memory).withColumn("undefined", F.when(F.col("n") == 0, NOT_INSTRUMENTED))
