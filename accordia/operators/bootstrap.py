"""Bootstrap replicates of statistics of labelled rows, by row or by whole clusters of rows.

Rows are counted by their distinct values first. A replicate draws how often each of those cells, or each cluster, comes:
this is resampling with replacement, and a replicate's cost follows the number of cells, not of rows. The cells go to the
executors with the seeds, and more than MOST_CELLS of them are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^20 cells of a few numbers each are some tens of megabytes.
MOST_CELLS = 1 << 20
Statistic = Callable[[pd.DataFrame, np.ndarray], float | None]


def bounded(rows: DataFrame, most: int = MOST_CELLS) -> pd.DataFrame:
    """A table that is known to be small, on the driver; an error if it is not."""
    out = rows.limit(most + 1).toPandas()
    if len(out) > most:
        raise ValueError(f"over {most} distinct rows: round the scores first")
    return out


def cells(rows: DataFrame, columns: list[str]) -> pd.DataFrame:
    """Distinct values of the columns in order, with n, how many rows have them."""
    return bounded(rows.groupBy(*columns).agg(F.count("*").alias("n"))).sort_values(columns, kind="stable", ignore_index=True)


def replicates(rows: DataFrame, statistic: Statistic, columns: list[str], count: int, unit: str | None = None, apart: str | None = None, parts: int = 8) -> DataFrame:
    """seed, value: the statistic of each replicate, null where it is undefined.

    unit: a column whose values are drawn as wholes; without it, single rows are. apart: a column whose values are
    independent samples, each drawn with its own size. statistic gets the cells (columns, n) and each one's weight.
    """
    keys = [*columns, *(c for c in (unit, apart) if c and c not in columns)]
    table = cells(rows, keys)
    sides = [np.flatnonzero(table[apart] == s) for s in sorted(table[apart].unique())] if apart else [np.arange(len(table))]
    counts = table["n"].to_numpy(np.int64)
    groups = [np.unique(table[unit].iloc[s], return_inverse=True)[1] if unit else None for s in sides]

    def draw(seed: int) -> np.ndarray:
        made, out = np.random.default_rng(seed), np.zeros(len(table), np.int64)
        for side, group in zip(sides, groups, strict=True):
            if group is None:
                out[side] = made.multinomial(counts[side].sum(), counts[side] / counts[side].sum())
            else:
                k = group.max() + 1
                out[side] = counts[side] * made.multinomial(k, np.full(k, 1 / k))[group]
        return out

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            values = [statistic(table, draw(int(seed))) for seed in batch["id"]] if len(table) else [None] * len(batch)
            yield pd.DataFrame({"seed": batch["id"], "value": pd.Series(values, dtype="float64")})

    return rows.sparkSession.range(0, count, 1, parts).mapInPandas(run, "seed long, value double").withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def weighted_auroc(u: np.ndarray, correct: np.ndarray, weight: np.ndarray) -> float | None:
    """P(u of a right one < u of a wrong one) + half of ties; None with one class."""
    values, at = np.unique(u, return_inverse=True)
    right, wrong = np.bincount(at, weight * correct, len(values)), np.bincount(at, weight * (1 - correct), len(values))
    pairs = right.sum() * wrong.sum()
    return float((wrong * (np.cumsum(right) - right / 2)).sum() / pairs) if pairs else None


def auroc(table: pd.DataFrame, weight: np.ndarray) -> float | None:
    return weighted_auroc(table["u"].to_numpy(float), table["correct"].to_numpy(float), weight)


def auroc_difference(table: pd.DataFrame, weight: np.ndarray) -> float | None:
    """AUROC of u less that of v, of the same rows."""
    a, b = (weighted_auroc(table[c].to_numpy(float), table["correct"].to_numpy(float), weight) for c in ("u", "v"))
    return None if a is None else a - b


def auroc_gap(first: str, second: str) -> Statistic:
    """AUROC of the rows of slice `first` less that of slice `second`."""

    def gap(table: pd.DataFrame, weight: np.ndarray) -> float | None:
        a, b = (auroc(table[table["slice"] == s], weight[(table["slice"] == s).to_numpy()]) for s in (first, second))
        return None if a is None or b is None else a - b

    return gap


def mean_gap(first: str, second: str, value: str = "correct") -> Statistic:
    """Mean of the value in slice `first` less that in slice `second`."""

    def gap(table: pd.DataFrame, weight: np.ndarray) -> float | None:
        x, s = table[value].to_numpy(float), table["slice"].to_numpy()
        means = [np.average(x[s == k], weights=weight[s == k]) if weight[s == k].sum() else np.nan for k in (first, second)]
        return float(means[0] - means[1])

    return gap


def calibration_error(bins: int) -> Statistic:
    """Mean over rows of |accuracy - mean p| of their equal-width bin."""

    def error(table: pd.DataFrame, weight: np.ndarray) -> float | None:
        p, y = table["p"].to_numpy(float), table["correct"].to_numpy(float)
        at = np.maximum(np.ceil(p * bins), 1).astype(int)
        return float(np.abs(np.bincount(at, weight * (y - p))).sum() / weight.sum()) if weight.sum() else None

    return error


def brier(table: pd.DataFrame, weight: np.ndarray) -> float | None:
    return float(np.average((table["p"].to_numpy(float) - table["correct"].to_numpy(float)) ** 2, weights=weight)) if weight.sum() else None


def intervals(replicates_: DataFrame, group: list[str], alpha: float = 0.05) -> DataFrame:
    """Per group: n defined values, low and high (linear percentiles), share of values at or below 0, and whether 0 is outside."""
    values = replicates_.where("value is not null").groupBy(*group)
    low, high = F.percentile("value", F.lit(alpha / 2)), F.percentile("value", F.lit(1 - alpha / 2))
    return values.agg(F.count("*").alias("n"), low.alias("low"), high.alias("high"), F.avg((F.col("value") <= 0).cast("double")).alias("p_le_zero"), ((low > 0) | (high < 0)).alias("excludes_zero"))
