"""Agreement of repeated answers, an item's samples in order of pos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordia.functions.text import clip01, normalize, overlap, tokens


def bits(n: Column, total: Column) -> Column:
    """A category's part of the entropy in bits."""
    return -(n / total) * F.log2(n / total)


def profile(samples: DataFrame, key: str = "key") -> DataFrame:
    """Per item: n, n_keys, top_share, entropy (bits, never -0), majority (most frequent, then smallest key)."""
    counts = samples.groupBy("item_id", key).agg(F.count("*").alias("c"))
    return (
        counts.groupBy("item_id")
        .agg(F.sum("c").alias("n"), F.count("*").alias("n_keys"), F.max("c").alias("top"), F.sum(F.col("c") * F.log2("c")).alias("clogc"), F.min_by(F.col(key), F.struct(-F.col("c"), F.col(key))).alias("majority"))
        .select("item_id", "n", "n_keys", (F.col("top") / F.col("n")).alias("top_share"), F.greatest(F.log2("n") - F.col("clogc") / F.col("n"), F.lit(0.0)).alias("entropy"), "majority")
    )


def key_counts(samples: DataFrame, key: str = "key") -> DataFrame:
    """Per item: counts, a map from each of its keys to how often it comes; a null key is NONE."""
    counts = samples.groupBy("item_id", F.coalesce(key, F.lit("NONE")).alias("k")).agg(F.count("*").alias("c"))
    return counts.groupBy("item_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "c")))).alias("counts"))


def first_seen(samples: DataFrame, text: str = "text") -> DataFrame:
    """item_id, pos, label: the rank, from 0, in which the normalized text first came up in its item."""
    own = samples.select("item_id", "pos", normalize(F.col(text)).alias("t"))
    firsts = own.withColumn("first", F.min("pos").over(Window.partitionBy("item_id", "t")))
    return firsts.select("item_id", "pos", (F.dense_rank().over(Window.partitionBy("item_id").orderBy("first")) - 1).alias("label"))


def entropy_with_unobserved(samples: DataFrame, unobserved: Column, key: str = "key") -> DataFrame:
    """Per item: entropy in bits if a share of the mass (clipped to [0, 1]) is on an answer never seen."""
    base = profile(samples, key)
    pu = clip01(unobserved)
    own = F.when(pu < 1, -(1 - pu) * F.log2(1 - pu)).otherwise(0.0) + F.when(pu > 0, -pu * F.log2(pu)).otherwise(0.0)
    return base.select("item_id", ((1 - pu) * F.col("entropy") + own).alias("entropy_unobserved"))


def modal_outcome(samples: DataFrame, label: str = "label", correct: str = "correct", resolved: str = "resolved") -> DataFrame:
    """Per item, of the largest cluster (then the earliest): its label, size, share correct and resolved, first verdict."""
    clusters = samples.groupBy("item_id", label).agg(
        F.count("*").alias("size"), F.min("pos").alias("first"), F.avg(F.col(correct).cast("double")).alias("frac_correct"), F.avg(F.col(resolved).cast("double")).alias("frac_resolved"), F.min_by("verdict", "pos").alias("verdict")
    )
    best = clusters.groupBy("item_id").agg(F.max_by(F.struct(label, "size", "frac_correct", "frac_resolved", "verdict"), F.struct("size", -F.col("first"))).alias("b"))
    return best.select("item_id", F.col(f"b.{label}").alias("majority_label"), "b.size", "b.frac_correct", (F.col("b.frac_correct") >= 0.5).cast("int").alias("majority_correct"), (F.col("b.frac_resolved") >= 0.5).cast("int").alias("majority_resolved"), "b.verdict")


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Both ends of the Wilson interval, null for n = 0."""
    p = F.try_divide(successes, n)
    middle, spread = (p + z * z / (2 * n)), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    ok = n > 0
    return F.when(ok, F.greatest((middle - spread) / scale, F.lit(0.0))), F.when(ok, F.least((middle + spread) / scale, F.lit(1.0)))


def unanimous(items: DataFrame, group: list[str]) -> DataFrame:
    """Per group: items whose samples all agree, how many of them are right, accuracy, Wilson interval, share wrong of all."""
    same = F.col("n_keys") == 1
    n, right = F.sum(same.cast("int")), F.sum((same & (F.col("correct") == 1)).cast("int"))
    counted = items.groupBy(*group).agg(F.count("*").alias("items"), n.alias("n"), right.alias("n_correct"))
    low, high = wilson(F.col("n_correct"), F.col("n"))
    return counted.select(*group, "items", "n", "n_correct", F.try_divide("n_correct", "n").alias("accuracy"), low.alias("low"), high.alias("high"), ((F.col("n") - F.col("n_correct")) / F.col("items")).alias("wrong_share"))


def leaderboard(items: DataFrame, group: str, answer: str, most: int = 6) -> DataFrame:
    """A group's most frequent answers (null is NONE), ties by first seen."""
    counts = items.groupBy(group, F.coalesce(answer, F.lit("NONE")).alias("answer")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "first")))
    return ranked.where(F.col("place") <= most).select(group, "answer", "n", "place")


def text_scores(samples: DataFrame, text: str = "text") -> DataFrame:
    """low, high, score: token overlap of each two texts, and of each with itself, that meet in some item, once."""
    once = samples.select("item_id", F.coalesce(text, F.lit("")).alias("t")).distinct()
    a, b = once.alias("a"), once.alias("b")
    meeting = a.join(b, (F.col("a.item_id") == F.col("b.item_id")) & (F.col("a.t") <= F.col("b.t"))).select(F.col("a.t").alias("low"), F.col("b.t").alias("high")).distinct()
    return meeting.select("low", "high", overlap(tokens(F.col("low")), tokens(F.col("high"))).alias("score"))


def with_scores(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """pairs (text_i, text_j, ...) with the score of their texts."""
    one, two = F.coalesce("text_i", F.lit("")), F.coalesce("text_j", F.lit(""))
    return pairs.withColumns({"low": F.least(one, two), "high": F.greatest(one, two)}).join(scores, ["low", "high"]).drop("low", "high")


def pair_scores(samples: DataFrame, text: str = "text") -> DataFrame:
    """item_id, i, j, score: token overlap of all pairs i < j of an item's samples.

    Texts repeat: each pair of different texts that meets in some item is scored once, and samples join the scores.
    """
    own = samples.select("item_id", "pos", F.col(text).alias("t"))
    a, b = own.alias("a"), own.alias("b")
    met = a.join(b, (F.col("a.item_id") == F.col("b.item_id")) & (F.col("a.pos") < F.col("b.pos")))
    met = met.select(F.col("a.item_id").alias("item_id"), F.col("a.pos").alias("i"), F.col("b.pos").alias("j"), F.col("a.t").alias("text_i"), F.col("b.t").alias("text_j"))
    return with_scores(met, text_scores(samples, text)).select("item_id", "i", "j", "score")


def selfcheck(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per item: the mean over samples of 1 - their best score with another; 1 for a lone sample."""
    either = pairs.select("item_id", F.col("i").alias("pos"), "score").unionByName(pairs.select("item_id", F.col("j").alias("pos"), "score"))
    best = either.groupBy("item_id", "pos").agg(F.max("score").alias("best"))
    return samples.select("item_id", "pos").join(best, ["item_id", "pos"], "left").groupBy("item_id").agg(F.avg(1 - F.coalesce("best", F.lit(0.0))).alias("selfcheck"))


def selfcheck_of_texts(samples: DataFrame, text: str = "text") -> DataFrame:
    """selfcheck by pair_scores, from an item's different texts and how often they come: samples are shuffled, never their pairs."""
    own = samples.select("item_id", F.coalesce(text, F.lit("")).alias("t")).repartition("item_id")
    counted = own.groupBy("item_id", "t").agg(F.count("*").alias("c")).withColumn("words", tokens(F.col("t")))
    a, b = counted.alias("a"), counted.select("item_id", "t", "words").alias("b")
    same = F.col("a.t") == F.col("b.t")
    score = F.when(~same | (F.col("a.c") > 1), overlap(F.col("a.words"), F.col("b.words")))
    best = a.join(b, F.col("a.item_id") == F.col("b.item_id"), "left").groupBy(F.col("a.item_id").alias("item_id"), F.col("a.t").alias("t"), F.col("a.c").alias("c")).agg(F.max(score).alias("best"))
    return best.groupBy("item_id").agg((F.sum(F.col("c") * (1 - F.coalesce("best", F.lit(0.0)))) / F.sum("c")).alias("selfcheck"))


def means(samples: DataFrame) -> DataFrame:
    """Per item: share correct, share unresolved, share citing repealed acts, mean words, 1 - exp(mean log probability)."""
    return samples.groupBy("item_id").agg(
        F.avg(F.col("correct").cast("double")).alias("frac_correct"), F.avg((F.col("resolved") == 0).cast("double")).alias("frac_unresolved"),
        F.avg(F.col("repealed").cast("double")).alias("repealed_share"), F.avg(F.size(F.split(F.trim("text"), r"\s+")).cast("double")).alias("mean_words"),
        (1 - F.exp(F.avg("logprob"))).alias("p_true"),
    )
