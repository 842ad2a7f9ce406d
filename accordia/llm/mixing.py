"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Each source's documents, shuffled by a hash, are laid end to end and cut into blocks whose numbers of words differ by one
at most; small sources have smaller blocks, so that each has many. Slot k of the mix falls on the point frac(k * golden
ratio), mapped to a source through the cumulative numbers of its blocks that make up the targets; the slots of a source
are ranked, and the slot of rank j takes that source's block j, starting anew when all are taken.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordia.llm.common import WORD_PATTERN, fresh, materialize

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
#: Slots of a mix are points k * GOLDEN mod 2^31 in integers, thus exact; 2^31 / golden ratio, made odd: all differ.
RANGE_BITS = 31
GOLDEN = 1327217885
LEAST_SLOTS = 1 << 17
MOST_BLOCK = 1 << 20
#: Blocks that each source has at least, or one a word; fewer where so many sources would make over LEAST_OF_ALL of them.
LEAST_BLOCKS = 1 << 10
LEAST_OF_ALL = 1 << 27
#: Documents or slots whose running sums one task makes.
BUCKET_ROWS = 1 << 12


class Mix(NamedTuple):
    sources: DataFrame  # source, source_size, weight, target, blocks, slots, low, high
    pieces: DataFrame  # id, source, block, words: the parts of documents that make up each block
    schedule: DataFrame  # slot, source, rank, pass, block
    documents: DataFrame  # id, size, source_size, target, taken


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """sizes (source, source_size), a row a source -> with weight and target; all targets sum to all sizes.

    Weights repeat over the sources by code point, null last. Targets stop at `most` times their size; the excess is
    reshared by weight until none is above: target = min(most * size, level * weight), where the level is found among the
    sources in ascending order of most * size / weight. The windows see a row a source, already summed.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    given = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    given = given.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    filled = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, everything = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # A source is below its cap, as are all after it, if the level that counts it and them as free is at most its own;
    # among those sources that level falls, so that the first of them has the largest.
    found = given.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("weight") <= F.col("_cap"))
    at = F.max(F.when(F.col("_free"), F.col("_level"))).over(everything)
    return found.select("source", "source_size", "weight", F.least(F.col("_cap"), F.coalesce(at * F.col("weight"), F.col("_cap"))).alias("target"))


def running(rows: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over all earlier rows of the group, in parts: buckets are summed, then each adds up its rows.

    bucket must follow the order within a group, so that a group that holds a third of all rows is still dealt out by bucket.
    """
    sums = rows.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(c).alias(f"_{c}") for c in (*group, bucket)], F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_part", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    same = F.lit(True)
    for c in (*group, bucket):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return summed.join(starts, same).withColumn(name, F.col("_part") + F.col("_start")).drop("_part", "_start", *[f"_{c}" for c in (*group, bucket)])


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 0) -> Mix:
    """The mix of docs. Null texts have size 0; a null source is a source; repeated rows are documents of their own.

    Sources' order of documents is by a hash of id and text, so that reruns agree. A document is taken at most `most`
    times over: the few slots, by the sequence's discrepancy, that ask a source for more passes stay empty. An empty
    table gives empty results.
    """
    sized = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), count_words(F.col(text)).alias("size"), F.xxhash64(F.col(doc_id), F.lit(seed), F.col(text)).alias("_order"))
    sized = materialize(sized, "sizes")
    totals = sized.agg(F.count("*").alias("n"), F.sum("size").alias("words")).first()
    n, total = totals["n"], totals["words"] or 0
    block = max(1, min(MOST_BLOCK, total // LEAST_SLOTS), -(-total // (1 << (RANGE_BITS - 1))))
    sources = materialize(_ranged(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), block), "sources")
    slots = round(sources.agg(F.sum("slots")).first()[0] or 0)

    parts = max(1, n // BUCKET_ROWS)
    placed = sized.withColumn("_bucket", F.floor((F.shiftrightunsigned("_order", 33).cast("double") / (1 << RANGE_BITS)) * parts).cast("int"))
    # Equal rows share id, text and thus the hash: which of them comes first makes no difference that can be seen.
    placed = running(placed, ["source"], "_bucket", [F.shiftrightunsigned("_order", 33), F.col("_order"), F.col("id")], F.col("size"), "_at")
    # A source's first blocks have a word more than its others.
    cut = sources.where("blocks > 0").select(F.col("source").alias("_s"), F.expr("source_size div blocks").alias("_least"), (F.col("source_size") % F.col("blocks")).alias("_longer"))
    begin = lambda b: b * F.col("_least") + F.least(b, F.col("_longer"))
    holder = "if({0} < _longer * (_least + 1), {0} div (_least + 1), ({0} - _longer) div _least)"
    held = placed.where("size > 0").join(cut, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    pieces = held.withColumn("block", F.explode(F.sequence(F.expr(holder.format("_at")), F.expr(holder.format("(_at + size - 1)")))))
    words = F.least(F.col("_at") + F.col("size"), begin(F.col("block") + 1)) - F.greatest(F.col("_at"), begin(F.col("block")))
    pieces = pieces.select("id", "source", "_order", "_at", "block", words.cast("long").alias("words"))

    schedule = _schedule(docs.sparkSession, sources, slots).where(F.col("pass") < most)
    taken = schedule.groupBy("source", "block").agg(F.count("*").alias("_times"))
    hits = pieces.alias("p").join(taken.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.block") == F.col("t.block")))
    # One document's pieces meet by its place in its source, which tells repeated rows apart.
    got = hits.groupBy(F.col("p.source").alias("_s"), F.col("p._at").alias("_a"), F.col("p._order").alias("_o")).agg(F.sum(F.col("p.words") * F.col("t._times")).alias("_taken"))
    out = placed.join(got, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_at") == F.col("_a")) & (F.col("_order") == F.col("_o")) & (F.col("size") > 0), "left").drop("_s")
    per = sources.select(F.col("source").alias("_s"), "source_size", "target")
    out = out.join(per, F.col("source").eqNullSafe(F.col("_s"))).select("id", "source", "_order", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))
    return Mix(sources, pieces, schedule, out)


def _ranged(sources: DataFrame, block: int) -> DataFrame:
    """With blocks, of at most `block` words; slots, the blocks that make up the target; low and high: the source's part of [0, 2^31), by cumulative slots."""
    everything = Window.partitionBy()
    least = F.greatest(F.lit(1), F.least(F.lit(LEAST_BLOCKS), F.floor(F.lit(LEAST_OF_ALL) / F.count("*").over(everything))))
    sources = sources.withColumn("blocks", F.least(F.col("source_size"), F.greatest(least, F.ceil(F.col("source_size") / block))).cast("long"))
    sources = sources.withColumn("slots", F.coalesce(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size")), F.lit(0.0)))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    top = F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("slots").over(everything)
    cut = sources.withColumn("high", F.coalesce(F.round(F.when(F.sum("slots").over(everything) > 0, top) * (1 << RANGE_BITS)), F.lit(0)).cast("long"))
    return cut.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0)).cast("long"))


def _schedule(spark, sources: DataFrame, slots: int) -> DataFrame:
    """slot, source, rank, pass, block. Points meet sources on the cells of a grid that each source's range covers."""
    cells = 1 << 10
    width = (1 << RANGE_BITS) // cells
    spread = sources.where("high > low").select("source", "low", "high", F.col("blocks").alias("_blocks"), F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("_cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN % (1 << RANGE_BITS)).alias("_x")).withColumn("_cell", F.floor(F.col("_x") / width))
    dealt = points.join(spread, "_cell").where("_x >= low and _x < high").select("slot", "source", "_blocks", F.floor(F.col("slot") / BUCKET_ROWS).alias("_bucket"))
    ranked = running(dealt, ["source"], "_bucket", [F.col("slot")], F.lit(1).cast("long"), "rank")
    return ranked.select("slot", "source", "rank", F.floor(F.col("rank") / F.col("_blocks")).alias("pass"), (F.col("rank") % F.col("_blocks")).alias("block"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, rounded to whole documents, in the columns of docs."""
    taken = mix(docs, doc_id, text, source, weights, seed=seed).documents
    id_, source_, order_, times_, rows_, own_, n_, copy_ = fresh(docs, "id", "s", "order", "times", "rows", "own", "n", "copy")
    times = taken.select(F.col("id").alias(id_), F.col("source").alias(source_), F.col("_order").alias(order_), F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int").alias(times_))
    # Repeated rows are alike: their times are summed and dealt out among them.
    times = times.groupBy(id_, source_, order_).agg(F.sum(times_).alias(times_), F.count("*").alias(rows_))
    keyed = docs.withColumn(own_, F.xxhash64(F.col(doc_id), F.lit(seed), F.col(text)))
    met = keyed.join(times, F.col(doc_id).eqNullSafe(F.col(id_)) & F.col(source).eqNullSafe(F.col(source_)) & (F.col(own_) == F.col(order_)))
    share = F.floor(F.col(times_) / F.col(rows_)).cast("int")
    # Single rows, nearly all, need no rank; a window ranks the others.
    alone, several = met.where(F.col(rows_) == 1), met.where(F.col(rows_) > 1)
    rank = F.row_number().over(Window.partitionBy(doc_id, source, own_).orderBy(own_))
    dealt = alone.withColumn(n_, share).unionByName(several.withColumn(n_, share + F.when(rank <= F.col(times_) % F.col(rows_), 1).otherwise(0)))
    return dealt.where(F.col(n_) > 0).withColumn(copy_, F.explode(F.sequence(F.lit(1), F.col(n_)))).select(*docs.columns)
