"""Language identification by Bayesian fusion of four kinds of evidence.

Text: the likelihood of a text's byte trigrams under each language's smoothed model. Declared markup language: how often
documents of each language declare what this one declares. Address suffix: how often each language's documents have it.
Host: a prior by host, smoothed towards its parent domain, and that towards its parent, down to all documents. The last
three are grouped counts over all documents, by the language that their texts alone give.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordia.llm.common import _LOWER as LOWER
from accordia.llm.common import bound_batches, join_spread, materialize, passes, without
from accordia.llm.url_filter import split_url

#: Labelled documents a language that its model is fitted on: the first so many by a hash.
SAMPLE = 400
#: Languages that can have models at a time (a model is 2^16 single-precision numbers); more of them are an error.
MOST_LANGUAGES = 256
TRIGRAM_BITS = 16
#: A trigram counts as this share of a draw of its own, as neighbours overlap.
TEMPER = 0.34
#: Weight, in documents, of the parent domain in a host's prior, and of chance in the counts of declarations and suffixes.
HOST_SMOOTHING, SMOOTHING = 10.0, 1.0
#: A document is rejected without a letter, if its posterior is under this, or if random bytes explain its text better.
LEAST_POSTERIOR = 0.5
UNKNOWN = "und"


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each three bytes in a row of a text, A-Z lower-cased, other ASCII but letters made a space."""
    shown = np.where((LOWER >= 97) & (LOWER <= 122) | (np.arange(256) > 127), LOWER, 32).astype(np.uint32)[data]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (shown[:-2] << np.uint32(16) | shown[1:-1] << np.uint32(8) | shown[2:]) * np.uint32(2654435761)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    whole = (text[:-2] == text[2:]) & ~((shown[:-2] == 32) & (shown[1:-1] == 32))
    return text[:-2][whole], (mixed[whole] >> np.uint32(32 - TRIGRAM_BITS)).astype(np.int32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part, data, offsets in passes(batch, "text"):
            text, bucket = trigrams(data, offsets)
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in set(langs):
                total.setdefault(lang, np.zeros(1 << TRIGRAM_BITS, np.int64))
                total[lang] += np.bincount(bucket[(langs == lang)[text]], minlength=1 << TRIGRAM_BITS)
    for lang, n in total.items():
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(n[seen])], ["lang", "bucket", "n"])


def normal(label: Column) -> Column:
    """A language label without region or script, in lower case; null if nothing is left."""
    return F.nullif(F.lower(F.substring_index(F.translate(F.trim(label), "_", "-"), "-", 1)), F.lit(""))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, languages: list[str] | None = None) -> dict[str, np.ndarray]:
    """Log likelihood by trigram bucket of each language, from `sample` whole labelled texts of each.

    Labels are brought to their normal form first. Every language has a model, or each of `languages` that occurs; over
    MOST_LANGUAGES are an error. Rows without a label are ignored; an empty table gives no models.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), normal(F.col(lang)).alias("lang"), F.col(text).cast("binary").alias("text"), F.xxhash64(doc_id, text).alias("_h")).where("lang is not null")
    if languages is not None:
        rows = rows.where(F.col("lang").isin(languages))
    # A bound on the hash, from a language's count, leaves about four times its sample for the window to rank.
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages: name those that are wanted")
    near = F.lit(False)
    for one, n in sizes:
        near = near | ((F.col("lang") == one) & (F.col("_h") < min((1 << 63) - 1, int((8 * sample / n - 1) * (1 << 63)))))
    near = rows.select("id", "lang", "_h").where(near)
    chosen = near.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "id"))).where(F.col("_r") <= sample).select("id", "lang", "_h")
    texts = rows.join(F.broadcast(chosen), ["id", "lang", "_h"], "left_semi")  # at most `sample` ids a language
    found: dict[str, np.ndarray] = {}
    for x in texts.select("lang", "text").mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_batches():
        langs = np.array(x.column(0).to_pylist(), object)
        for one in set(langs):
            found.setdefault(one, np.zeros(1 << TRIGRAM_BITS))[x.column(1).to_numpy()[langs == one]] += x.column(2).to_numpy()[langs == one]
    return {one: np.log((n + 0.05) / (n.sum() + 0.05 * len(n))).astype(np.float32) for one, n in sorted(found.items())}


def _scores(models: dict[str, np.ndarray]):
    table = np.stack([*models.values()], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in passes(batch, "text"):
                text, bucket = trigrams(data, offsets)
                out = np.stack([np.bincount(text, table[bucket, i], part.num_rows) for i in range(table.shape[1])], axis=1) if len(text) else np.zeros((part.num_rows, table.shape[1]))
                n = np.bincount(text, minlength=part.num_rows) if len(text) else np.zeros(part.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * table.shape[1], pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "declared", "host", "suffix")), pa.array(n.astype(np.int64)), lists], ["id", "declared", "host", "suffix", "n", "scores"])

    return run


def _evidence(scored: DataFrame, column: str, languages: list[str]) -> DataFrame:
    """(column, one log P(value | language) a language, rows) from counts over all documents, as a written table."""
    n = [F.count(F.when(F.col("text_lang") == x, 1)).alias(f"n{i}") for i, x in enumerate(languages)]
    counts = materialize(scored.where(F.col(column).isNotNull() & F.col("text_lang").isNotNull()).groupBy(column).agg(*n, F.count("*").alias(f"{column}_n")), f"{column}_counts")
    *totals, values = counts.agg(*[F.sum(f"n{i}") for i in range(len(languages))], F.count("*")).first()
    logs = [F.log((F.col(f"n{i}") + SMOOTHING) / F.lit((t or 0) + SMOOTHING * (values + 1))) for i, t in enumerate(totals)]
    return counts.select(F.col(column).alias(f"_{column}"), F.array(*logs).alias(f"{column}_logs"), f"{column}_n")


def host_priors(scored: DataFrame, languages: list[str], levels: int = 3) -> DataFrame:
    """(host, log prior by language, rows): a host's counts with its parent domain's prior as pseudo-counts, and so on up.

    A host's parents are what is left without its first label, down to one label, at most `levels` in all.
    """
    counts = [F.count(F.when(F.col("text_lang") == x, 1)).cast("double").alias(f"n{i}") for i, x in enumerate(languages)]
    hosts = scored.where("host is not null").groupBy("host").agg(*counts, F.count("*").alias("host_n"))
    parts = F.split("host", r"\.")
    # Level 1 is the last label, level 2 the last two, ...; the host itself is the last level.
    domain = lambda k: F.when(F.size(parts) > k, F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    total = scored.where("text_lang is not null").agg(*counts).first()
    size = sum(total) + len(languages)
    prior = [F.lit((n + 1) / size) for n in total]
    rows = hosts
    for k in range(1, levels):
        at = hosts.withColumn("_d", domain(k)).where("_d is not null").groupBy("_d").agg(*[F.sum(f"n{i}").alias(f"d{i}") for i in range(len(languages))])
        rows = rows.withColumn("_k", domain(k)).join(at, F.col("_k") == F.col("_d"), "left").drop("_k", "_d")
        size = sum((F.coalesce(F.col(f"d{i}"), F.lit(0.0)) for i in range(len(languages))), F.lit(0.0))
        rows = rows.select("host", "host_n", *[f"n{i}" for i in range(len(languages))], *[f"p{i}" for i in range(len(languages)) if k > 1], *[((F.coalesce(F.col(f"d{i}"), F.lit(0.0)) + HOST_SMOOTHING * (prior[i] if k == 1 else F.col(f"p{i}"))) / (size + HOST_SMOOTHING)).alias(f"q{i}") for i in range(len(languages))])
        rows = rows.select("host", "host_n", *[f"n{i}" for i in range(len(languages))], *[F.col(f"q{i}").alias(f"p{i}") for i in range(len(languages))])
    size = sum((F.col(f"n{i}") for i in range(len(languages))), F.lit(0.0))
    logs = [F.log((F.col(f"n{i}") + HOST_SMOOTHING * F.col(f"p{i}")) / (size + HOST_SMOOTHING)) for i in range(len(languages))]
    return rows.select(F.col("host").alias("_host"), F.array(*logs).alias("host_logs"), "host_n")


def _sum(arrays: list[Column], i: int) -> Column:
    return sum((F.coalesce(a[i], F.lit(0.0)) for a in arrays), F.lit(0.0))


def identify(docs: DataFrame, models: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text", declared: str | None = None, host: str | None = None, suffix: str | None = None) -> DataFrame:
    """doc_id, lang, posterior, text_lang, kept: a row for each row of docs.

    declared, host and suffix name columns of evidence; what is null, or has no column, adds nothing. lang is the likeliest
    language of all evidence, ties to the first by name; kept is false, and lang und, for a text without a letter or the
    like (null and empty ones among them), if the posterior is under a half, or if random bytes explain the text better
    than every language. Rows that share a doc_id are judged each; an empty table, or no models, give an empty result or
    und. Other columns are ignored.
    """
    languages = sorted(models)
    if not languages:
        return docs.select(doc_id, F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"), F.lit(False).alias("kept"))
    bound_batches(docs.sparkSession)
    given = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    plain = docs.select(F.col(doc_id).alias("id"), normal(given(declared)).alias("declared"), F.lower(given(host)).alias("host"), F.lower(given(suffix)).alias("suffix"), F.col(text).cast("binary").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    scored = plain.mapInArrow(_scores({x: models[x] for x in languages}), f"id {kind}, declared string, host string, suffix string, n long, scores array<double>")
    names = F.array(*map(F.lit, languages))
    best = F.array_max("scores")
    # Random bytes over all buckets are the text's likelihood without any language.
    sound = (F.col("n") > 0) & (best > F.col("n") * -math.log(1 << TRIGRAM_BITS))
    scored = materialize(scored.withColumn("text_lang", F.when(sound, F.element_at(names, F.array_position("scores", best).cast("int")))), "language_scores")
    rows = scored
    for column, used in (("declared", declared), ("suffix", suffix)):
        if used:
            rows = join_spread(rows, column, _evidence(scored, column, languages), f"_{column}", f"{column}_n", ["id"])
    if host:
        rows = join_spread(rows, "host", materialize(host_priors(scored, languages), "host_priors"), "_host", "host_n", ["id"])
    others = [F.col(f"{c}_logs") for c, used in (("declared", declared), ("suffix", suffix), ("host", host)) if used]
    logs = F.array(*[F.col("scores")[i] * TEMPER + _sum(others, i) for i in range(len(languages))])
    rows = rows.withColumn("_logs", logs).withColumn("_top", F.array_max("_logs"))
    rows = rows.withColumn("posterior", 1 / F.aggregate("_logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_top"))))
    kept = F.col("text_lang").isNotNull() & (F.col("posterior") >= LEAST_POSTERIOR)
    lang = F.when(kept, F.element_at(names, F.array_position("_logs", F.col("_top")).cast("int"))).otherwise(UNKNOWN)
    return rows.select(F.col("id").alias(doc_id), lang.alias("lang"), "posterior", "text_lang", kept.alias("kept"))


#: Of a page: what is no text, and its declaration.
NO_TEXT = r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;"
MARKUP_LANG = r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)"


def page_evidence(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, text (without markup), declared (the html element's lang), host, suffix (the host's last label) of web pages.

    What a page or its url lacks is null; a null page has an empty text.
    """
    host = F.nullif(split_url(F.col(url))[0], F.lit(""))
    host = F.regexp_replace(F.substring_index(host, "@", -1), r":\d*$", "")
    declared = F.nullif(F.regexp_extract(F.col(html), MARKUP_LANG, 1), F.lit(""))
    suffix = F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1))
    return pages.select(F.col(page_id).alias(page_id), F.coalesce(F.regexp_replace(F.col(html), NO_TEXT, " "), F.lit("")).alias("text"), declared.alias("declared"), host.alias("host"), suffix.alias("suffix"))


def keep_identified(docs: DataFrame, models: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text", **evidence) -> DataFrame:
    """The rows of docs whose language identify finds, in the columns of docs; of rows that share a doc_id, all or none stay; rows without one stay."""
    return without(docs, doc_id, identify(docs, models, doc_id, text, **evidence).where("not kept").select(doc_id))
