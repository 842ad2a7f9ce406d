"""Order-dependent fits and clusterings.

Fits see a row for each distinct score, never all rows. A group of few of them is fitted in one task; of one with more, isotonic
maps are pooled in segments that do not depend on each other, and Platt maps and risk scores take their steps by sums that the
executors make. Clusterings work on the samples of one item, a bounded group, at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accordia.operators.maps import apply_maps, isotonic_registry
from accordia.operators.order import same, search
from accordia.operators.relations import BLOCK, MERGE
from accordia.operators.tables import written

#: Distinct scores of one group that one task fits; beyond that, the group is fitted in parts or in jobs.
MOST_IN_TASK = 1 << 16
#: Distinct rows of a risk score's design that the driver fits.
MOST_CELLS = 1 << 16
#: Thresholds in [0, 1] that cut a large isotonic fit into segments; a power of two.
THRESHOLDS = 1 << 10


def pool(left: np.ndarray, total: np.ndarray, weight: np.ndarray) -> list[list[float]]:
    """Blocks (left edge, sum, weight) of the non-decreasing fit to blocks in order. Any part may be pooled beforehand."""
    stack: list[list[float]] = []
    for block in zip(left.tolist(), total.tolist(), weight.tolist(), strict=True):
        stack.append([*block])
        while len(stack) > 1 and stack[-2][1] / stack[-2][2] > stack[-1][1] / stack[-1][2] + 1e-12:
            _, total_, weight_ = stack.pop()
            stack[-1][1] += total_
            stack[-1][2] += weight_
    return stack


def pool_adjacent(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit: each pooled block's leftmost x and its mean."""
    values, at = np.unique(x, return_inverse=True)
    blocks = pool(values, np.bincount(at, y), np.bincount(at).astype(float))
    return np.array([b[0] for b in blocks]), np.clip([b[1] / b[2] for b in blocks], 0.0, 1.0)


def interpolate(x: np.ndarray, knots_x: np.ndarray, knots_y: np.ndarray) -> np.ndarray:
    return np.clip(np.interp(x, knots_x, knots_y), 0.0, 1.0)


def platt(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, steps: int = 200) -> tuple[float, float]:
    """Slope (0 or more) and intercept by half Newton steps on Platt's smoothed targets; y of n rows at each x are right."""
    n = np.ones_like(x) if n is None else n
    right, wrong = y.sum(), (n - y).sum()
    target = y * (right + 1) / (right + 2) + (n - y) / (wrong + 2)
    theta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-design @ theta))
        gradient = design.T @ (n * p - target)
        hessian = design.T @ (design * (n * np.maximum(p * (1 - p), 1e-9))[:, None]) + 1e-9 * np.eye(2)
        if np.linalg.det(hessian) <= 1e-12:
            break
        step = np.linalg.solve(hessian, gradient)
        theta = theta - 0.5 * step
        theta[0] = max(0.0, theta[0])
        if (np.abs(step) < 1e-10).all():
            break
    return float(theta[0]), float(theta[1])


def monotone_logistic(design: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, l2: float = 0.25, rate: float = 0.05, epochs: int = 2500) -> tuple[float, np.ndarray]:
    """Intercept and weights, none below 0, by projected gradient descent from the log odds; y of n rows are 1."""
    n = np.ones(len(y)) if n is None else n
    share = y.sum() / n.sum()
    bias, w = math.log(share / (1 - share)), np.zeros(design.shape[1])
    for _ in range(epochs):
        error = n / (1 + np.exp(-np.clip(bias + design @ w, -35, 35))) - y
        bias -= rate * error.sum() / n.sum()
        w = np.maximum(0.0, w - rate * (design.T @ error / n.sum() + l2 * w))
    return bias, w


def _with_both_classes(rows: DataFrame, group: list[str]) -> DataFrame:
    """Usable rows (x, correct as doubles) of the groups that have right and wrong ones."""
    usable = rows.select(*group, F.col("x").cast("double").alias("x"), F.col("correct").cast("double").alias("correct")).where("x is not null and not isnan(x) and correct is not null")
    both = usable.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.min("correct").alias("_lo"), F.max("correct").alias("_hi")).where("_lo < _hi")
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return usable.join(both, same, "left_semi")


def _cells(rows: DataFrame, group: list[str]) -> DataFrame:
    """Group, x, right, n: the rows of groups with both classes, counted by distinct x, as a written table."""
    return written(_with_both_classes(rows, group).groupBy(*group, "x").agg(F.sum("correct").alias("right"), F.count("*").cast("double").alias("n")), "cells")


def _per_group(cells: DataFrame, group: list[str], fit: Callable[[pd.DataFrame], dict], kinds: str) -> DataFrame:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{g: part[g].iloc[0] for g in group}, **fit(part.sort_values("x"))})

    named = ", ".join(f"{g} {cells.schema[g].dataType.simpleString()}" for g in group)
    return cells.groupBy(*group).applyInPandas(run, f"{named}, {kinds}")


def _large(cells: DataFrame, group: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """(cells of groups with up to `most` of them; those of larger ones, None if there are none)."""
    names = [f"_l_{g}" for g in group]
    sizes = cells.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)]).agg(F.count("*").alias("_size")).where(F.col("_size") > most).drop("_size")
    if sizes.isEmpty():
        return cells, None
    return cells.join(sizes, same(group, names), "left_anti"), cells.join(sizes, same(group, names), "left_semi")


def _pooled(part: pd.DataFrame) -> dict:
    blocks = np.array(pool(part["x"].to_numpy(float), part["right"].to_numpy(float), part["n"].to_numpy(float)))
    return dict(zip(("x", "right", "n"), blocks.T, strict=True))


def _pooled_in_parts(cells: DataFrame, group: list[str], most: int) -> DataFrame:
    """group, x, right, n: the pooled blocks of groups that no task holds whole.

    Ranges of the score are pooled first. The fit is the slope of the greatest convex line under the running sums of the
    right ones over the rows; where it passes a threshold, the sum less threshold times rows is least, and the fits on
    either side do not depend on each other. Each part gives its own least points, by its blocks' order; the least over
    all parts cut the group into segments, which are pooled apart. Thresholds are dyadic, so that sums are exact.
    """
    kinds = "x double, right double, n double, block long"

    def numbered(part: pd.DataFrame) -> dict:
        found = _pooled(part)
        return found | {"block": np.arange(len(found["x"]))}

    # Ranges of the score of about equal sizes, as a written table: their bounds come from a sample.
    parts = -(-cells.count() // most)
    parted = written(cells.repartitionByRange(parts, *group, "x").withColumn("_part", F.spark_partition_id()), "parts")
    totals = parted.groupBy(*group, "_part").agg(F.sum("right").alias("_r"), F.sum("n").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    own = [f"_g_{g}" for g in group]
    starts = totals.select(*[F.col(g).alias(n) for g, n in zip(group, own, strict=True)], F.col("_part").alias("_g_part"), sums("_r", before).alias("_r0"), sums("_n", before).alias("_n0"))
    blocks = _per_group(parted, [*group, "_part"], numbered, kinds)
    inner = Window.partitionBy(*group, "_part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.join(starts, same([*group, "_part"], [*own, "_g_part"])).select(
        *group, "_part", "x", "right", "n", "block", (F.col("_r0") + sums("right", inner)).alias("_s"), (F.col("_n0") + sums("n", inner)).alias("_w"),
    )
    placed = written(placed, "blocks")
    # A part's point before a block is least for thresholds from the slope of the block before it to that of its own.
    along = Window.partitionBy(*group, "_part").orderBy("block")
    slope = F.col("right") / F.col("n")
    low, last = F.coalesce(F.lag(slope).over(along), F.lit(0.0)), F.lead("block").over(along).isNull()
    points = placed.select(*group, F.col("_s").alias("s"), F.col("_w").alias("w"), low.alias("low"), slope.alias("high"), last.alias("last"), "right", "n")
    ends = points.where("last").select(*group, (F.col("s") + F.col("right")).alias("s"), (F.col("w") + F.col("n")).alias("w"), F.col("high").alias("low"), F.lit(1.0).alias("high"))
    points = points.select(*group, "s", "w", "low", "high").unionByName(ends)
    at = F.sequence(F.ceil(F.col("low") * THRESHOLDS), F.floor(F.col("high") * THRESHOLDS))
    wanted = points.where(F.ceil(F.col("low") * THRESHOLDS) <= F.floor(F.col("high") * THRESHOLDS)).withColumn("t", F.explode(at))
    height = F.col("s") * THRESHOLDS - F.col("t") * F.col("w")
    cuts = wanted.groupBy(*group, "t").agg(F.min_by("w", F.struct(height, "w")).alias("w")).groupBy(*group).agg(F.sort_array(F.collect_set("w")).alias("_cuts"))
    cuts = cuts.select(*[F.col(g).alias(n) for g, n in zip(group, own, strict=True)], "_cuts")
    segment = search(F.col("_cuts"), F.col("_w") + 0.5).alias("_segment")
    segments = placed.join(cuts, same(group, own)).select(*group, "x", "right", "n", segment)
    return _per_group(segments, [*group, "_segment"], _pooled, "x double, right double, n double").drop("_segment")


def isotonic_maps(rows: DataFrame, group: list[str], most: int = MOST_IN_TASK) -> DataFrame:
    """Per group with both classes: knots x, y in order, from x and correct.

    Cells are counted and written first. Groups of up to `most` distinct scores are pooled in a task each; larger ones in
    parts, with the same result.
    """
    small, large = _large(_cells(rows, group), group, most)
    blocks = _per_group(small, group, _pooled, "x double, right double, n double")
    if large is not None:
        blocks = blocks.unionByName(_pooled_in_parts(large, group, most))
    return blocks.select(*group, "x", F.least(F.greatest(F.col("right") / F.col("n"), F.lit(0.0)), F.lit(1.0)).alias("y"))


def _solved(theta: np.ndarray, sums: dict) -> tuple[np.ndarray, bool]:
    """A half Newton step from a group's sums of gradient and Hessian, and whether it was the last."""
    hessian = np.array([[sums["xx"], sums["x"]], [sums["x"], sums["one"]]]) + 1e-9 * np.eye(2)
    if np.linalg.det(hessian) <= 1e-12:
        return theta, True
    step = np.linalg.solve(hessian, [sums["gx"], sums["g"]])
    theta = theta - 0.5 * step
    theta[0] = max(0.0, theta[0])
    return theta, bool((np.abs(step) < 1e-10).all())


def _platt_in_steps(cells: DataFrame, group: list[str], steps: int = 200) -> DataFrame:
    """slope, intercept, n of groups of many cells: gradient and Hessian are grouped sums, a job a step.

    A row a large group is on the driver: there are at most as many as there are cells over MOST_IN_TASK.
    """
    spark = cells.sparkSession
    totals = cells.groupBy(*group).agg(F.sum("right").alias("_right"), (F.sum("n") - F.sum("right")).alias("_wrong"), F.sum("n").cast("long").alias("_all")).collect()
    named = ", ".join(f"_k_{g} {cells.schema[g].dataType.simpleString()}" for g in group)
    state = {tuple(t[g] for g in group): [np.array([1.0, 0.0]), False, t] for t in totals}
    for _ in range(steps):
        open_ = [(*k, float(theta[0]), float(theta[1]), t["_right"], t["_wrong"]) for k, (theta, done, t) in state.items() if not done]
        if not open_:
            break
        now = spark.createDataFrame(open_, f"{named}, _a double, _b double, _right double, _wrong double")
        p = 1 / (1 + F.exp(-(F.col("x") * F.col("_a") + F.col("_b"))))
        target = F.col("right") * (F.col("_right") + 1) / (F.col("_right") + 2) + (F.col("n") - F.col("right")) / (F.col("_wrong") + 2)
        met = cells.join(F.broadcast(now), same(group, [f"_k_{g}" for g in group])).withColumns({"_p": p, "_t": target}).withColumns({"_e": F.col("n") * F.col("_p") - F.col("_t"), "_w": F.col("n") * F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-9))})
        x, w = F.col("x"), F.col("_w")
        for r in met.groupBy(*group).agg(F.sum(x * F.col("_e")).alias("gx"), F.sum("_e").alias("g"), F.sum(w * x * x).alias("xx"), F.sum(w * x).alias("x"), F.sum(w).alias("one")).collect():
            mine = state[tuple(r[g] for g in group)]
            mine[0], mine[1] = _solved(mine[0], r.asDict())
    kinds = ", ".join(f"{g} {cells.schema[g].dataType.simpleString()}" for g in group)
    return spark.createDataFrame([(*k, float(theta[0]), float(theta[1]), t["_all"]) for k, (theta, _, t) in state.items()], f"{kinds}{', ' * bool(group)}slope double, intercept double, n long")


def platt_maps(rows: DataFrame, group: list[str], most: int = MOST_IN_TASK) -> DataFrame:
    """Per group with both classes: slope, intercept, n. Groups of over `most` distinct scores are fitted in jobs, a step each."""

    def fit(part: pd.DataFrame) -> dict:
        slope, intercept = platt(part["x"].to_numpy(float), part["right"].to_numpy(float), part["n"].to_numpy(float))
        return {"slope": [slope], "intercept": [intercept], "n": [int(part["n"].sum())]}

    small, large = _large(_cells(rows, group), group, most)
    lines = _per_group(small, group, fit, "slope double, intercept double, n long")
    return lines if large is None else lines.unionByName(_platt_in_steps(large, group))


def cross_fit(rows: DataFrame, stratum: str, fold: str, k: int, least: int = 10) -> DataFrame:
    """rows with p from the isotonic map of the other folds of their stratum; none where these have one class or few rows."""
    others = rows.withColumn("_out", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col(fold) != F.col("_out"))
    enough = others.groupBy(stratum, "_out").agg(F.count("*").alias("_n"), F.min("correct").alias("_lo"), F.max("correct").alias("_hi")).where(f"_n >= {least} and _lo < _hi").select(stratum, "_out")
    knots = isotonic_maps(others.join(enough, [stratum, "_out"]), [stratum, "_out"])
    named = F.concat_ws("|", F.col(stratum).cast("string"), F.col("_out").cast("string")).alias("stratum")
    own = F.concat_ws("|", F.col(stratum).cast("string"), F.col(fold).cast("string"))
    return apply_maps(rows.where("x is not null").withColumn("_own", own), isotonic_registry(knots.select(named, "x", "y")), "_own").drop("_own")


def fit_risk(rows: DataFrame, design: list, label: str, most: int = MOST_CELLS) -> tuple[float, np.ndarray]:
    """monotone_logistic over rows' design columns, counted by distinct values; rows with a null are left out.

    Over `most` distinct rows, gradients are sums that the executors make, a job an epoch; the weights are the same.
    """
    names = [f"d{i}" for i in range(len(design))]
    named = rows.select(*[d.cast("double").alias(n) for d, n in zip(design, names, strict=True)], F.col(label).cast("double").alias("y")).dropna()
    cells = written(named.groupBy(*names).agg(F.sum("y").alias("y"), F.count("*").alias("n")), "cells")
    size, right, total = cells.agg(F.count("*"), F.sum("y"), F.sum("n")).first()
    if not size or not 0 < right < total:
        raise ValueError("both classes are needed")
    if size > most:
        return _risk_in_epochs(cells, names, right, total)
    found = cells.toPandas().sort_values(names)
    y, n = found.pop("y").to_numpy(float), found.pop("n").to_numpy(float)
    return monotone_logistic(found.to_numpy(float), y, n)


def _risk_in_epochs(cells: DataFrame, names: list[str], right: float, total: float, l2: float = 0.25, rate: float = 0.05, epochs: int = 2500) -> tuple[float, np.ndarray]:
    share = right / total
    bias, w = math.log(share / (1 - share)), np.zeros(len(names))
    for _ in range(epochs):
        z = F.lit(bias)
        for c, x in zip(names, w.tolist(), strict=True):
            z = z + F.col(c) * x
        error = F.col("n") / (1 + F.exp(-F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0)))) - F.col("y")
        sums = cells.select(error.alias("_e"), *names).agg(F.sum("_e"), *[F.sum(F.col(c) * F.col("_e")) for c in names]).first()
        bias -= rate * sums[0] / total
        w = np.maximum(0.0, w - rate * (np.array(sums[1:]) / total + l2 * w))
    return bias, w


def _sorted_samples(samples: DataFrame, *columns: str) -> DataFrame:
    return samples.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("samples"))


def greedy_labels(units: list[tuple[int, object]], similar: Callable[[object, object], float], threshold: float) -> list[int]:
    """A label for each unit, in order: the first leader that is similar both ways, else a new one."""
    leaders: list[object] = []
    labels = []
    for _, x in units:
        found = next((i for i, lead in enumerate(leaders) if similar(lead, x) >= threshold and similar(x, lead) >= threshold), len(leaders))
        if found == len(leaders):
            leaders.append(x)
        labels.append(found)
    return labels


def greedy_clusters(samples: DataFrame, similar: Callable[[object, object], float], threshold: float, prepare: Callable[[str], object] = str) -> DataFrame:
    """item_id, pos, label: each sample joins the first cluster whose first member is similar both ways, else founds one.

    An item's equal texts are one unit, compared once, at their first place: it costs different texts times clusters,
    however many samples there are. (A text that is not similar to itself founds a cluster each time.) prepare is done
    once a text; similar gets what it returns. A null text is empty.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for item, texts in zip(batch["item_id"], batch["texts"], strict=True):
                units = []
                for t in texts:
                    x, places = prepare(t["text"]), sorted(t["places"])
                    units += [(places, x)] if similar(x, x) >= threshold else [([p], x) for p in places]
                units.sort(key=lambda u: u[0][0])
                labels = greedy_labels([(u[0][0], u[1]) for u in units], similar, threshold)
                out += sorted((item, p, y) for (places, _), y in zip(units, labels, strict=True) for p in places)
            yield pd.DataFrame(out, columns=["item_id", "pos", "label"])

    texts = samples.groupBy("item_id", F.coalesce("text", F.lit("")).alias("text")).agg(F.collect_list("pos").alias("places"))
    return texts.groupBy("item_id").agg(F.collect_list(F.struct("text", "places")).alias("texts")).mapInPandas(run, "item_id long, pos int, label int")


def merge_typed(keys: list[str], label: dict[tuple[int, int], str], score: dict[tuple[int, int], float], tau: float) -> list[int]:
    """Clusters of one item's samples: equal known keys first, then merging pairs from the best score down.

    A merge is refused if any pair across both clusters is of a blocking label, or has two different known keys and no
    merging label. Clusters are numbered by their first sample.
    """
    home = [keys.index(k) if k != "NONE" else i for i, k in enumerate(keys)]
    sets = {h: {i for i, x in enumerate(home) if x == h} for h in set(home)}
    either = lambda m, a, b: m.get((min(a, b), max(a, b)))

    def refused(a: int, b: int) -> bool:
        said = either(label, a, b)
        return said in BLOCK or ("NONE" not in (keys[a], keys[b]) and keys[a] != keys[b] and said not in MERGE)

    for a, b in sorted((p for p in label if label[p] in MERGE and score[p] >= tau), key=lambda p: (-score[p], p)):
        x, y = home[a], home[b]
        if x != y and not any(refused(i, j) for i in sets[x] for j in sets[y]):
            for i in sets[y]:
                home[i] = x
            sets[x] |= sets.pop(y)
    order = {h: n for n, h in enumerate(dict.fromkeys(home))}
    return [order[h] for h in home]


def merge_items(batches: Iterable[pa.RecordBatch], tau: float) -> Iterable[pa.RecordBatch]:
    """item_id, pos, label of merge_typed over rows of an item: its samples (pos, key) and pairs (i, j, merges, score), which may be null.

    Pairs stay columns of numbers, and become objects for one item at a time, not for a whole batch of items.
    """
    for batch in batches:
        taken, met = batch.column("samples"), batch.column("pairs")
        pos, key = (taken.values.field(c) for c in ("pos", "key"))
        i, j, merges, score = (met.values.field(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "merges", "score"))
        first, start = taken.offsets.to_pylist(), met.offsets.to_pylist()
        labels: list[int] = []
        for item in range(batch.num_rows):
            at = {p: n for n, p in enumerate(pos[first[item] : first[item + 1]].to_pylist())}
            own = slice(start[item], start[item + 1])
            where = [(at[a], at[b]) for a, b in zip(i[own].tolist(), j[own].tolist(), strict=True)]
            said = [MERGE[0] if m else BLOCK[0] for m in merges[own].tolist()]
            labels += merge_typed(key[first[item] : first[item + 1]].to_pylist(), dict(zip(where, said, strict=True)), dict(zip(where, score[own].tolist(), strict=True)), tau)
        ids = batch.column("item_id").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(first))))
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pos[first[0] : first[-1]].cast(pa.int32()), pa.array(labels, pa.int32())], names=["item_id", "pos", "label"])


def typed_clusters(samples: DataFrame, pairs: DataFrame, tau: float) -> DataFrame:
    """item_id, pos, label of merge_typed over samples (item_id, pos, key) and pairs (item_id, i < j, label, score).

    Labels that neither merge nor block say as much as none, and are left out.
    """
    told = pairs.where(F.col("label").isin(*MERGE, *BLOCK)).withColumn("merges", F.col("label").isin(*MERGE))
    linked = told.groupBy("item_id").agg(F.collect_list(F.struct("i", "j", "merges", "score")).alias("pairs"))
    rows = _sorted_samples(samples, "key").join(linked, "item_id", "left").select("item_id", "samples", "pairs")
    return rows.mapInArrow(lambda batches: merge_items(batches, tau), "item_id long, pos int, label int")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at least k of n)."""
    if k <= 0:
        return 1.0
    if p <= 0.0 or p >= 1.0:
        return float(p >= 1.0)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    return min(1.0, math.fsum(map(math.exp, logs)))


def exact_lower(k: int, n: int, alpha: float = 0.05) -> float:
    """The one-sided exact binomial lower bound, by bisection; 1 if all n are hits."""
    if k == n:
        return 1.0
    low, high = 0.0, k / n
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) < alpha else (low, mid)
    return low


def exact_lower_bounds(rows: DataFrame, k: str, n: str, alpha: float = 0.05) -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(exact_low=[exact_lower(int(a), int(b), alpha) for a, b in zip(batch[k], batch[n], strict=True)])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, exact_low double")


def items_needed(rate: float, wanted: int, confidence: float = 0.95, most: int = 20_000) -> int | None:
    """The fewest items that yield `wanted` hits with the confidence; None beyond `most`."""
    if rate <= 0:
        return None
    low, high = max(1, wanted), most
    if binomial_tail(wanted, high, rate) < confidence:
        return None
    while low < high:  # the tail grows with the number of items
        mid = (low + high) // 2
        low, high = (low, mid) if binomial_tail(wanted, mid, rate) >= confidence else (mid + 1, high)
    return low


def items_needed_by(rows: DataFrame, rate: str, wanted: int, confidence: float = 0.95) -> DataFrame:
    """rows with needed: the items that a rate asks for, null beyond the bound."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(needed=pd.Series([items_needed(float(r), wanted, confidence) for r in batch[rate]], dtype="Int64"))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, needed long")
