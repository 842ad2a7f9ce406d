"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's bytes; where it is a multiple of RATE, and was not within the GAP bytes before, a chunk
ends. As that depends on the bytes just before alone, a passage is cut alike wherever it stands, but for its first bytes.
A digest's first place, by doc_id, is the original; a run of chunks whose originals are in other documents is a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordia.llm.common import _LOWER as LOWER
from accordia.llm.common import bound_batches, fresh, join_spread, materialize, mix64, passes, powers, words

#: The hash covers 16 bytes: each byte's gear is shifted out of its low RATE_BITS + 11 bits by then.
WINDOW = 16
RATE_BITS = 4
GAP = 12
#: Text without an end of its own is cut after so many bytes; a prime, so that chunks of one repeated word take all phases.
LONGEST = 127
#: A repeat's chunks hold so many words at least, or so many with all words that its passage can have lost at its ends.
LEAST_WORDS = 30
LEAST_PASSAGE = 51
#: Ends in a passage's first so many bytes may hang on what stands before it.
LEAD = WINDOW + GAP
GEAR = np.random.default_rng(77).integers(0, 1 << 16, 256, dtype=np.uint64).astype(np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of gear[byte i back] << i over the last 16 bytes, modulo 2^16, by doubling."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint16(width)
        h, width = longer, 2 * width
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks of some texts, in order; each text's end is one."""
    ends = np.flatnonzero(gear_hashes(data) >> np.uint16(16 - RATE_BITS) == 0) + 1 if len(data) > WINDOW else np.zeros(0, np.int64)
    start = offsets[np.searchsorted(offsets, ends, side="left") - 1]
    ends = ends[ends - start >= WINDOW]  # before that, the hash holds bytes of another text
    near = np.append(False, np.diff(ends) <= GAP)[: len(ends)]
    ends = np.unique(np.concatenate([ends[~near], offsets[1:]]))
    ends = ends[ends > 0]
    lengths = np.diff(np.append(0, ends))
    if len(long := np.flatnonzero(lengths > LONGEST)):
        begin = ends[long] - lengths[long]
        ends = np.unique(np.concatenate([ends, *(np.arange(b + LONGEST, e, LONGEST) for b, e in zip(begin, ends[long], strict=True))]))
    return ends


def edges(data: np.ndarray, offsets: np.ndarray, begins: np.ndarray, ends: np.ndarray, owner: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each chunk, the most words that a passage whose first (last) whole chunk it is can have before (after) it.

    A passage's ends of chunks are those of its other places from LEAD bytes on, but for cuts at LONGEST, which count from
    the end before: thus it begins at most LEAD bytes before the last end of the hash's own. It ends within the next chunk.
    """
    own = ends - begins != LONGEST  # ends of the hash at just that length count as cuts, which finds more
    last = np.maximum.accumulate(np.where(np.append(True, own[:-1]) | np.append(True, owner[1:] != owner[:-1]), np.arange(len(begins)), 0))[: len(begins)] if len(begins) else begins
    back = np.append(0, last[:-1])[: len(begins)]
    inner = np.append(False, owner[1:] == owner[:-1])[: len(begins)]
    floor = np.maximum(begins[back] - LEAD, offsets[owner]) if len(begins) else begins
    before = np.where(inner, np.searchsorted(starts, begins) - np.searchsorted(starts, floor), 0)
    following = np.append(ends[1:], 0)[: len(ends)]
    after = np.where(np.append(inner[1:], False)[: len(ends)], np.searchsorted(starts, following) - np.searchsorted(starts, ends), 0)
    return before, after


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in passes(batch, "text"):
            lower = LOWER[data]
            ends = chunk_ends(lower, offsets)
            begins = np.append(0, ends[:-1]) if len(ends) else ends
            owner = np.searchsorted(offsets[1:], begins, side="right")
            up, down = powers(len(data) + 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
            digest = mix64((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
            starts = words(data, offsets).begin
            n = np.searchsorted(starts, ends) - np.searchsorted(starts, begins)
            before, after = edges(data, offsets, begins, ends, owner, starts)
            first = np.searchsorted(owner, np.arange(part.num_rows))
            ids = part.column("id").take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([ids, pa.array((np.arange(len(ends)) - first[owner]).astype(np.int32)), pa.array((begins - offsets[owner]).astype(np.int32)), pa.array((ends - offsets[owner]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(digest.view(np.int64))], ["id", "chunk", "begin", "end", "n_words", "before", "after", "digest"])


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, chunk (its number in the text), begin, end (bytes), n_words (that begin in it), before, after (see edges), digest; letters' case is ignored."""
    bound_batches(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return plain.mapInArrow(_chunks, "id long, chunk int, begin int, end int, n_words int, before int, after int, digest long")


#: Bits of a chunk's length, words, words before and words after; its begin takes the bits above. No chunk is over LONGEST
#: bytes, hence of half as many words; words before count up to what is enough.
LENGTH_BITS, WORD_BITS = 8, 7


def _packed() -> Column:
    """begin, length, n_words, before and after as one number, as rows in a shuffle take eight bytes a column."""
    out = F.col("begin").cast("long")
    for c, bits in ((F.col("end") - F.col("begin"), LENGTH_BITS), *((F.least(F.col(c), F.lit((1 << WORD_BITS) - 1)), WORD_BITS) for c in ("n_words", "before", "after"))):
        out = F.shiftleft(out, bits).bitwiseOR(c.cast("long"))
    return out


def _unpacked() -> list[Column]:
    place, words_ = F.col("_place"), (1 << WORD_BITS) - 1
    begin = F.shiftright(place, 3 * WORD_BITS + LENGTH_BITS).cast("int")
    length = F.shiftright(place, 3 * WORD_BITS).bitwiseAND(F.lit((1 << LENGTH_BITS) - 1)).cast("int")
    counts = [F.shiftright(place, (2 - i) * WORD_BITS).bitwiseAND(F.lit(words_)).cast("int").alias(c) for i, c in enumerate(("n_words", "before", "after"))]
    return [begin.alias("begin"), (begin + length).alias("end"), *counts]


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_hot: int | None = None) -> DataFrame:
    """doc_id, begin, end (bytes of the text), n_words, first_doc_id: a row for each repeat of a passage of another document.

    The document with the smallest doc_id holds a passage's original, which is not a repeat; first_doc_id is the smallest
    one that a repeat's chunks come from. Passages that repeat within one document only are left alone, and so are, among
    rows that share a doc_id, what they share. A-Z count as a-z. Null and empty texts have no chunks; rows without a doc_id are ignored;
    other columns are ignored; an empty table gives an empty result.
    """
    found = materialize(chunks(docs, doc_id, text).where("id is not null"), "chunks")
    firsts = found.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("_last"), F.count("*").alias("_n")).where("first < _last").select("digest", "first", "_n")
    firsts = materialize(firsts, "firsts")
    met = join_spread(found.select("id", "chunk", "digest", _packed().alias("_place")), "digest", firsts.withColumnRenamed("digest", "_d"), "_d", "_n", ["id", "chunk"], "inner", least_hot).where("id > first")
    repeats = met.select("id", "chunk", "_place", "first").distinct().select("id", "chunk", *_unpacked(), "first")
    # Runs of neighbours: a chunk's number less its rank among the document's repeats stays the same along a run.
    ranked = repeats.withColumn("_run", F.col("chunk") - F.dense_rank().over(Window.partitionBy("id").orderBy("chunk")))
    runs = ranked.groupBy("id", "_run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"), F.min("first").alias("first_doc_id"), F.min_by("before", "chunk").alias("_before"), F.max_by("after", "chunk").alias("_after"))
    enough = (F.col("n_words") >= least_words) | (F.col("n_words") + F.col("_before") + F.col("_after") >= LEAST_PASSAGE)
    return runs.where(enough).select(F.col("id").alias(doc_id), "begin", "end", "n_words", "first_doc_id")


def _cut(text_column: str, cuts_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column(text_column).to_pylist(), batch.column(cuts_column).to_pylist(), strict=True):
                data = (text or "").encode()
                for x in sorted(cuts, key=lambda x: -x["begin"]):
                    data = data[: x["begin"]] + data[x["end"] :]
                out.append(data.decode("utf-8", "ignore") if text is not None else None)
            at = batch.schema.get_field_index(text_column)
            yield batch.set_column(at, text_column, pa.array(out, pa.string())).drop_columns([cuts_column])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with the repeats cut out of its texts, in the columns of docs; code points cut in two at an edge go too."""
    id_, cuts_ = fresh(docs, "cut_id", "cuts")
    cuts = find_repeats(docs, doc_id, text, least_words).groupBy(F.col(doc_id).alias(id_)).agg(F.collect_list(F.struct("begin", "end")).alias(cuts_))
    rows = docs.join(cuts, F.col(doc_id) == F.col(id_), "left").drop(id_)
    touched = rows.where(F.col(cuts_).isNotNull()).mapInArrow(_cut(text, cuts_), docs.schema)
    return touched.unionByName(rows.where(F.col(cuts_).isNull()).drop(cuts_))
