"""Divergence of sources within a language, from counts of the terms that the language keeps, in exact integers.

With n a term's count in a group and N the group's sum over all V kept terms, p = 1 + floor(SCALE * (n + 2) / (N + 2 V)),
and two groups part by the sum over all kept terms of floor((p - q)^2 / (p + q)). Groups of a language are cut into blocks,
terms into chunks; a block's counts in a chunk are packed into one array of longs and replicated to each pair of blocks it
is part of. A task takes such a pair's chunks one after another and adds up the submatrix of its pairs; terms that neither
block holds are all alike for a pair and are added at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordia.llm.common import _LOWER, bound_batches, join_spread, materialize, passes, words
from accordia.llm.spelling import gather

SCALE, ADDED = 1_000_000_000, 2
LEAST_DOCS, TOP = 10, 10
#: Groups a block, terms a chunk (about: terms are dealt out by a hash), and longs that a task compares at a time.
BLOCK, CHUNK, STEP = 16, 1 << 13, 1 << 20
#: A packed long: the group's place in its block, the term's in its chunk, and p, which is at most SCALE + 1.
TERM_BITS, P_BITS = 22, 30
#: Bytes that are no part of a term: all ASCII but letters.
APART = np.array([i < 128 and not chr(i).isalpha() for i in range(256)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in passes(batch, "text"):
            names: dict[tuple[str, str], int] = {}
            group = np.array([names.setdefault(x, len(names)) for x in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)])
            met = words(data, offsets, APART)
            mixed = lambda own, h: h ^ (own.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            _, first, n = np.unique(mixed(met.text, met.hash), return_index=True, return_counts=True)  # a document's terms
            own = group[met.text[first]]
            _, at, where = np.unique(mixed(own, met.hash[first]), return_index=True, return_inverse=True)  # a group's
            sums, docs = np.bincount(where, n, len(at)).astype(np.int64), np.bincount(where, minlength=len(at))
            first, own = first[at], own[at]
            lang, source = (pa.array([x[k] for x in names], pa.string()).take(pa.array(own)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([lang, source, gather(_LOWER[data], met.begin[first], met.end[first]), pa.array(sums), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term). Nulls are empty strings; each row is a document.

    Terms are runs of anything but ASCII's non-letters, with A-Z lower-cased; within 1 MB of text they are told apart by
    64-bit hashes.
    """
    bound_batches(docs.sparkSession)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for a, c in (("lang", lang), ("source", source), ("text", text))])
    return plain.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """p of a count, exact for any long: the division is one of decimals."""
    return F.expr(f"1 + (cast({n} as decimal(20,0)) + {ADDED}) * {SCALE} div (cast({total} as decimal(20,0)) + {ADDED} * cast({kept} as decimal(20,0)))")


def gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1, so that the square is a long."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


class Audit:
    """Written tables of one audit.

    groups: lang, source, block, member (place in the block), total (N), kept (V), lang_total, p0 (p of a count of 0); every group of the docs.
    kept: lang, source, block, member, term, chunk, place (within the chunk), n, p, q (the language's p).
    """

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, block: int = BLOCK, chunk: int = CHUNK):
        counts = materialize(term_counts(docs, text, lang, source), "counts")
        terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("_docs"), F.sum("n").alias("lang_n")).where(F.col("_docs") >= least_docs).drop("_docs")
        terms = materialize(terms, "terms")
        langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
        seen = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for a, c in (("lang", lang), ("source", source))]).distinct()
        langs = materialize(seen.select("lang").distinct().join(langs, "lang", "left").select(F.col("lang").alias("its"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")), "langs")
        # Terms of a language get places chunk by chunk; chunks by a hash, so that a language with most terms is dealt out.
        sized = join_spread(terms, "lang", langs.select("its", "kept", F.col("kept").alias("rows")), "its", "rows", ["term"])
        sized = sized.withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / chunk)).cast("int"))
        placed = sized.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).drop("kept")
        met = materialize(counts.drop("docs").join(placed, ["lang", "term"]), "met")
        totals = met.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        # A group is one of a language's block by its rank: pairs grow with the square of these rows.
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        groups = seen.join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0))).withColumn("_rank", rank).join(langs.withColumnRenamed("its", "lang"), "lang")
        groups = groups.select("lang", "source", F.floor(F.col("_rank") / block).cast("int").alias("block"), (F.col("_rank") % block).cast("int").alias("member"), "total", "kept", "lang_total")
        self.groups = materialize(groups.withColumn("p0", F.when(F.col("kept") > 0, share("0", "total", "kept")).otherwise(1)), "groups")
        both = met.join(self.groups, ["lang", "source"])
        self.kept = materialize(both.select("lang", "source", "block", "member", "term", "chunk", "place", "n", share("n", "total", "kept").alias("p"), share("lang_n", "lang_total", "kept").alias("q")), "kept")

    def pairs(self) -> DataFrame:
        """lang, source, other, value for all ordered pairs of different sources of a language."""
        packed = F.shiftleft(F.col("member").cast("long"), TERM_BITS + P_BITS) + F.shiftleft(F.col("place").cast("long"), P_BITS) + F.col("p")
        names = F.array().cast("array<string>")
        chunks = self.kept.groupBy("lang", "block", "chunk").agg(F.collect_list(packed).alias("packed")).withColumn("names", names).withColumn("kept", F.lit(0).cast("long"))
        # A block's head comes before its chunks: names and p0 of its groups, in order.
        head = F.sort_array(F.collect_list(F.struct("member", "source", "p0")))
        heads = self.groups.groupBy("lang", "block").agg(head.alias("_head"), F.max("kept").alias("kept"))
        heads = heads.select("lang", "block", F.lit(-1).alias("chunk"), F.transform("_head", lambda x: x["p0"]).alias("packed"), F.transform("_head", lambda x: x["source"]).alias("names"), "kept")
        blocks = self.groups.groupBy("lang").agg((F.max("block") + 1).alias("_blocks"))
        tiled = heads.unionByName(chunks).join(blocks, "lang").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        tiled = tiled.select("lang", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "block", "chunk", "packed", "names", "kept")
        dealt = tiled.repartition("lang", "low", "high").sortWithinPartitions("lang", "low", "high", "chunk", "block")
        return dealt.mapInArrow(_tiles, "lang string, source string, other string, value long")

    def terms(self, top: int = TOP) -> DataFrame:
        """lang, source, term, value, rank: the terms of a group that it has more of than its language, the top ones."""
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
        return self.kept.where("p > q").select("lang", "source", "term", gap("p", "q").alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


class _Tile:
    """The submatrix of two blocks' groups, added up chunk by chunk."""

    def __init__(self, low: tuple[list[str], np.ndarray], high: tuple[list[str], np.ndarray], kept: int):
        self.names, self.zero, self.left = (low[0], high[0]), (low[1], high[1]), kept
        self.value = np.zeros((len(low[0]), len(high[0])), np.int64)

    def add(self, packed: list[np.ndarray]) -> None:
        """packed: what either block holds of one chunk."""
        at = [x >> P_BITS & (1 << TERM_BITS) - 1 for x in packed]
        terms = np.unique(np.concatenate(at))
        self.left -= len(terms)
        step = max(1, STEP // max(1, len(self.names[1])))
        for a in range(0, len(terms), step):
            some = terms[a : a + step]
            p = []
            for x, places, zero in zip(packed, at, self.zero, strict=True):
                full = np.repeat(zero[:, None], len(some), axis=1)
                use = (places >= some[0]) & (places <= some[-1])
                full[x[use] >> TERM_BITS + P_BITS, np.searchsorted(some, places[use])] = x[use] & (1 << P_BITS) - 1
                p.append(full)
            for i in range(len(p[0])):
                self.value[i] += _gaps(p[0][i], p[1]).sum(axis=1)

    def rows(self, lang: str, same: bool) -> pa.RecordBatch:
        """All ordered pairs of different groups; a tile of one block with itself has both ways already."""
        value = self.value + self.left * _gaps(self.zero[0][:, None], self.zero[1])
        i, j = (x.ravel() for x in np.indices(value.shape))
        if same:
            i, j = i[i != j], j[i != j]
        a, b = (pa.array(x, pa.string()) for x in self.names)
        a, b, found = a.take(pa.array(i)), b.take(pa.array(j)), pa.array(value[i, j])
        if not same:
            a, b, found = pa.concat_arrays([a, b]), pa.concat_arrays([b, a]), pa.concat_arrays([found, found])
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), a, b, found], ["lang", "source", "other", "value"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, chunk, block; a tile's heads come first."""
    key = tile = chunk = None
    heads, held = {}, {}
    none = np.zeros(0, np.int64)

    def add() -> None:
        if chunk is not None and chunk >= 0:
            tile.add([held.get(b, none) for b in key[1:]])

    def end() -> Iterator[pa.RecordBatch]:
        if key is not None:
            add()
            yield tile.rows(key[0], key[1] == key[2])

    for batch in batches:
        lang, low, high, block, number = (batch.column(c).to_pylist() for c in ("lang", "low", "high", "block", "chunk"))
        for i in range(batch.num_rows):
            values = batch.column("packed")[i].values.to_numpy()
            if (lang[i], low[i], high[i]) != key:
                yield from end()
                key, chunk, heads, held = (lang[i], low[i], high[i]), None, {}, {}
            if number[i] < 0:
                heads[block[i]] = (batch.column("names")[i].as_py(), values.astype(np.int64))
                if low[i] in heads and high[i] in heads:
                    tile = _Tile(heads[low[i]], heads[high[i]], batch.column("kept")[i].as_py())
                continue
            if number[i] != chunk:
                add()
                chunk, held = number[i], {}
            held[block[i]] = values
    yield from end()


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` ranks the other sources of the language, `term` the top terms.

    Null texts, languages and sources are empty strings; a group without terms has its rows; a language without kept terms
    has pairs of value 0; repeated rows are documents; an empty table gives no rows. Other columns are ignored.
    """
    made = Audit(docs, text, lang, source, least_docs, block, chunk)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")
    pairs = made.pairs().withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", "rank")
    return pairs.unionByName(made.terms(top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))
