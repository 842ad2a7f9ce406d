"""Uncertainty features, the linear risk score, and splits by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordia.functions.text import clip01

MAIN = ("u_prov", "u_text", "u_warrant", "u_cm", "u_contra")
LEGAL = MAIN[2:]


def unit(x: Column) -> Column:
    """x if finite and in [0, 1], else null."""
    return F.when(~F.isnan(x) & x.between(0.0, 1.0), x)


def normal_entropy(x: Column, n: Column) -> Column:
    """x / log2(n) for n >= 2, null if that is not in [0, 1] (but for rounding)."""
    most = F.log2(n.cast("double"))
    return F.when((n >= 2) & ~F.isnan(x) & (x >= 0) & (x <= most + 1e-8), clip01(x / most))


def features(records: DataFrame) -> DataFrame:
    """records with the five components, legal_complete and reason. Nulls stay null: nothing is imputed."""
    w, cm, k = unit(F.col("warranted")), unit(F.col("common_mode")), unit(F.col("contradiction"))
    named = {"u_prov": normal_entropy(F.col("prov_se"), F.col("n_samples")), "u_text": normal_entropy(F.col("disc_se"), F.col("n_samples")), "u_warrant": 1 - w, "u_cm": F.when(cm.isNotNull(), F.greatest(cm, F.lit(0.0))), "u_contra": k}
    out = records.withColumns(named)
    complete = F.lit(True)
    for name in MAIN:
        complete = complete & F.col(name).isNotNull()
    missing = F.concat_ws("; ", *[F.when(F.col(n).isNull(), F.lit(f"{n} missing or invalid")) for n in MAIN])
    return out.withColumns({"legal_complete": complete, "reason": F.when(~complete, missing)})


def terms(include: tuple[str, ...] = MAIN) -> list[tuple[str, ...]]:
    """Main effects, then all products of two."""
    return [(a,) for a in include] + [(a, b) for i, a in enumerate(include) for b in include[i + 1 :]]


def logistic(intercept: float, weights: dict[tuple[str, ...], float], dropped: tuple[str, ...] = ()) -> Column:
    """The score of a weighted sum of terms, without those of a dropped component; null if a needed component is."""
    z = F.lit(float(intercept))
    for term, weight in weights.items():
        if not set(term) & set(dropped):
            value = F.lit(float(weight))
            for name in term:
                value = value * F.col(name)
            z = z + value
    z = F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0)))
    return 1 / (1 + F.exp(-z))


def estimate(featured: DataFrame, intercept: float, weights: dict[tuple[str, ...], float], degraded: bool = False) -> DataFrame:
    """featured with score and mode: all components, else those of samples alone, else the plain entropy, else nothing."""
    full, sample = logistic(intercept, weights), logistic(intercept, weights, LEGAL)
    modes = [(F.col("legal_complete"), full, "legal_aware")]
    if degraded:
        modes.append((F.col("u_prov").isNotNull() & F.col("u_text").isNotNull(), sample, "sample_only_degraded"))
    modes.append((F.col("u_prov").isNotNull(), F.col("u_prov"), "sample_only_fallback"))
    score, mode = F.when(modes[0][0], modes[0][1]), F.when(modes[0][0], modes[0][2])
    for cond, value, name in modes[1:]:
        score, mode = score.when(cond, value), mode.when(cond, name)
    return featured.withColumns({"score": score, "mode": mode.otherwise("unscorable")})


def hash_unit(seed: int, key: Column) -> Column:
    """The first 8 bytes of sha256(seed|key) as a share of 2^64."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256), 1, 16)
    return F.conv(digits, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def in_first_part(seed: int, key: Column, share: float) -> Column:
    return hash_unit(seed, key) < share


def folds(rows: DataFrame, group: Column, k: int, seed: int) -> DataFrame:
    """rows with a fold: groups in order of their hash are dealt round; k is at most the number of groups."""
    groups = rows.select(group.alias("_g")).distinct()
    order = Window.orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), F.col("_g")), 256), "_g")
    n = F.count("*").over(Window.partitionBy())
    dealt = groups.select("_g", ((F.row_number().over(order) - 1) % F.least(F.lit(k), n)).cast("int").alias("fold"))
    return rows.withColumn("_g", group).join(dealt, "_g").drop("_g")


def topic_split(topics: DataFrame, topic: str, seed: int, dev: float = 0.2, test: float = 0.2) -> DataFrame:
    """topic, split: topics in order of their hash; the first are dev, the next test (sizes rounded to even), the rest train."""
    names = topics.select(topic).distinct()
    order = Window.orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(topic)), 256), topic)
    n, at = F.count("*").over(Window.partitionBy()), F.row_number().over(order)
    first = F.greatest(F.bround(n * dev), F.lit(1))
    return names.select(topic, F.when(at <= first, "dev").when(at <= first + F.greatest(F.bround(n * test), F.lit(1)), "test").otherwise("train").alias("split"))
