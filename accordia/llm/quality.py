"""Quality classification by importance resampling.

Two generative models over hashed n-grams of words, one of target text and one of all text, give each document the log of
its likelihood ratio; documents are then drawn without replacement in proportion to that ratio: Gumbel noise is added to
the log weights and the top k are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordia.llm.common import bound_batches, materialize, mix64, passes, words

#: Words, and pairs of neighbouring words, fall into 2^20 buckets each: a model of n-grams for each order.
BUCKET_BITS, ORDERS = 20, 2
SLICES = 64
#: Pseudo-counts of the target model by order, dealt out as all text is: pairs are sparser, and chance weighs more in them.
SMOOTHING = (3.0, 300.0)
#: Target documents that the target model is fitted on: the first so many by a hash.
TARGET_SAMPLE = 20_000
#: Documents among which the last places of the top k are settled.
BAND_ROWS = 1 << 16


def ngram_buckets(text: np.ndarray, h: np.ndarray, bits: int = BUCKET_BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """By order, of each word and of each pair of neighbouring words: its text and its bucket."""
    with np.errstate(over="ignore"):
        pair = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    same, low = text[:-1] == text[1:], np.uint64((1 << bits) - 1)
    return [(text, (h & low).astype(np.int64)), (text[:-1][same], (pair[same] & low).astype(np.int64))]


def _counts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((ORDERS, 1 << bits), np.uint32), False
        for batch in batches:
            for _, data, offsets in passes(batch, "text"):
                found = words(data, offsets)
                for i, (_, bucket) in enumerate(ngram_buckets(found.text, found.hash, bits)):
                    total[i] += np.bincount(bucket, minlength=1 << bits).astype(np.uint32)
                any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES)), pa.array([x.astype(np.int64).tobytes() for x in total.reshape(SLICES, -1)], pa.binary())], ["slice", "n"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(n, np.int64)
            total[at] = total[at] + x if at in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "n"])


def count_ngrams(texts: DataFrame, bits: int = BUCKET_BITS) -> np.ndarray:
    """Counts by order and bucket over all rows (column text, binary).

    A task sums all texts of its partition before the shuffle; 2 * 2^bits numbers come to the driver, whatever the input.
    """
    parts = texts.select("text").mapInArrow(_counts(bits), "slice long, n binary").repartition("slice").mapInArrow(_sums, "slice long, n binary")
    out = np.zeros((SLICES, (ORDERS << bits) // SLICES))
    for batch in parts.toArrow().to_batches():
        for at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out[at] += np.frombuffer(n, np.int64)
    return out.reshape(ORDERS, 1 << bits)


def fit(target: np.ndarray, everything: np.ndarray, smoothing: tuple[float, ...] = SMOOTHING) -> np.ndarray:
    """Log ratio of the target's model to that of all text, by order and bucket: (target count + s) / (count expected + s).

    The expected count is that of all text, scaled to the target's size. This is the target's model with s pseudo-counts a
    bucket that say what all text says, over the model of all text.
    """
    out = np.zeros(target.shape, np.float32)
    for i, s in enumerate(smoothing):
        expected = everything[i] * (target[i].sum() / max(1.0, everything[i].sum()))
        out[i] = np.log((target[i] + s) / (expected + s))
    return out


def _weights(ratio: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in passes(batch, "text"):
                found = words(data, offsets)
                n, weight = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                for one, (text, bucket) in zip(ratio, ngram_buckets(found.text, found.hash, bits), strict=True):
                    n += np.bincount(text, minlength=part.num_rows)
                    weight += np.bincount(text, one[bucket], part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("draw"), pa.array(n), pa.array(weight)], ["id", "draw", "n_grams", "log_weight"])

    return run


def gumbel(key: Column) -> Column:
    """Gumbel noise from a 64-bit hash: -log(-log u) with u in (0, 1)."""
    return -F.log(-F.log((F.shiftrightunsigned(key, 11).cast("double") + 0.5) / float(1 << 53)))


def top_k(rows: DataFrame, k: int, score: str, tie: list[str]) -> Column | None:
    """A condition that holds for the k rows with the largest score, ties by the tie columns; rows must be a written table.

    Approximate percentiles bracket the k-th score; the rows within the bracket are ranked. The bracket narrows until
    it holds few rows, or all of them tie.
    """
    n = rows.count()
    if k >= n:
        return F.lit(True)
    if k <= 0:
        return F.lit(False)
    low, high, above = rows.agg(F.min(score), F.max(score)).first() + (0,)
    while True:
        inside = rows.where(F.col(score).between(low, high))
        size = inside.count()
        if size <= BAND_ROWS or low == high:
            break
        rank = 1 - (k - above) / size
        steps = inside.agg(F.percentile_approx(score, [max(0.0, rank - 0.002), min(1.0, rank + 0.002)], 10_000)).first()[0]
        over = rows.where(F.col(score) > steps[1]).count()
        under = rows.where(F.col(score) >= steps[0]).count()
        if (steps[0], steps[1]) == (low, high) or not over < k <= under:
            break
        low, high, above = steps[0], steps[1], over
    order = [F.desc(score), *tie]
    last = inside.orderBy(*order).limit(k - above).agg(F.max_by(F.struct(score, *tie), F.struct(-F.col(score), *tie))).first()[0]
    if last is None:
        return F.col(score) > high
    at, ties = F.col(score) == last[0], F.lit(True)
    for c in reversed(tie):
        ties = (F.col(c) < last[c]) | ((F.col(c) == last[c]) & ties)
    return (F.col(score) > last[0]) | (at & ties)


def importance_sample(docs: DataFrame, target: DataFrame, share: float, doc_id: str = "doc_id", text: str = "text", sample: int = TARGET_SAMPLE, bits: int = BUCKET_BITS, smoothing: tuple[float, ...] = SMOOTHING, seed: int = 0) -> DataFrame:
    """doc_id, n_grams, log_weight, kept: a row for each row of docs; kept marks the share of rows that were drawn.

    target: ids (column doc_id) of target documents, of which the first `sample` by a hash train the target model; the
    model of all text counts every row. A log weight is the sum of the log ratios of a whole text's words and word pairs,
    so that documents are drawn in proportion to the ratio of their likelihoods. A null or empty text
    has weight 0. Gumbel noise comes from doc_id and seed: reruns agree, and rows that share a doc_id and weight are drawn
    together with the last of them. Without target documents all weights are 0. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    chosen = target.select(F.col(doc_id).cast("long").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    everything = count_ngrams(plain, bits)
    chosen = materialize(chosen, "target")
    wanted = count_ngrams(plain.join(F.broadcast(chosen), "id", "left_semi"), bits)  # of at most `sample` ids
    ratio = fit(wanted, everything, smoothing) if wanted.sum() else np.zeros_like(everything, np.float32)
    drawn = plain.select("id", F.xxhash64(F.lit(seed), "id").alias("draw"), "text")
    kind = "id long, draw long, n_grams long, log_weight double"
    scored = drawn.mapInArrow(_weights(ratio, bits), kind)
    scored = materialize(scored.withColumn("score", F.col("log_weight") + gumbel(F.col("draw"))), "weights")
    rows = scored.fillna({"id": -(1 << 63)})
    kept = top_k(rows, round(share * rows.count()), "score", ["draw", "id"])
    return rows.select(F.when(F.col("id") > -(1 << 63), F.col("id")).alias(doc_id), "n_grams", "log_weight", kept.alias("kept"))


def good_share(labels: DataFrame, good: str) -> float:
    """The share of good ones among the labels."""
    return labels.agg(F.avg(F.expr(f"cast(coalesce({good}, false) as int)"))).first()[0] or 0.0
