"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are drawn from the vectors. Each vector is described by its nearest pivots in order; a posting
list for every few pivots holds the vectors that have all of them among their nearest, so that two vectors meet in a list
exactly if they share so many pivots. Lists are verified by the cosine in double precision, each pair in the list of the
smallest pivots it shares, and only counts and a forest of links leave a list: a list of n near copies gives n rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordia.llm.common import bound_batches, components, join_spread, materialize, union_find

THRESHOLD = 0.98
#: Pivots: about four times the square root of the number of vectors, within these bounds; of at most PIVOT_NUMBERS numbers.
PIVOTS = (64, 1 << 14)
PIVOT_NUMBERS = 1 << 22
NEAREST, SHARED = 7, 3
#: Numbers of components that get pivots of their own.
SIZES = 1024
#: Pivots are less alike than this: else those inside one dense group would be ordered by chance by the group's members.
PIVOT_COSINE = 0.7
#: Members of a list that one call compares at once; longer lists are dealt out as pairs of cuts.
CUT = 1024


def scaled(v: np.ndarray) -> bytes | None:
    """A vector over its largest component, as bytes of doubles; none if it cannot link."""
    peak = np.abs(v).max(initial=0.0)
    if not np.isfinite(v).all() or not peak:
        return None
    with np.errstate(over="ignore", under="ignore"):  # cosines don't depend on the scale, norms might overflow
        return (v / peak + 0.0).tobytes()


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that can link: id, label, dim, the vector as bytes of doubles, its digest; the others have no digest."""
    for batch in batches:
        lists = batch.column("v")
        places, numbers = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)  # a null component becomes NaN
        usable = np.array(lists.is_valid()) & np.array(batch.column("label").is_valid())
        good = [scaled(numbers[a:b]) if x else None for x, a, b in zip(usable.tolist(), places[:-1].tolist(), places[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array([len(m) // 8 if m else None for m in good], pa.int32()), pa.array(good, pa.binary()), pa.array([hashlib.blake2b(m, digest_size=16).digest() if m else None for m in good], pa.binary())],
            ["id", "label", "dim", "v", "digest"],
        )


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spread_out(drawn: np.ndarray, want: int) -> np.ndarray:
    """Up to `want` of the drawn unit vectors, in order, without any that is too much like one before."""
    kept = drawn[:0]
    for at in range(0, len(drawn), 256):
        block = drawn[at : at + 256]
        block = block[~(block @ kept.T > PIVOT_COSINE).any(axis=1)]
        alike = block @ block.T > PIVOT_COSINE
        own: list[int] = []
        for i in range(len(block)):
            if not alike[i, own].any():
                own.append(i)
        kept = np.concatenate([kept, block[own]])
        if len(kept) >= want:
            break
    return kept[:want]


def subset_keys(near: np.ndarray, shared: int) -> np.ndarray:
    """Keys of all `shared`-subsets of each row of ascending pivot numbers below 2^20."""
    return np.stack([_key(near[:, list(c)]) for c in combinations(range(near.shape[1]), shared)], axis=1)


def _key(pivots: np.ndarray) -> np.ndarray:
    out = np.zeros(len(pivots), np.int64)
    for i in range(pivots.shape[1]):
        out = out << 20 | pivots[:, i]
    return out


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Ascending numbers of each row's k nearest pivots."""
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), CUT):
        cosines = x[s : s + CUT] @ pivots.T
        out[s : s + CUT] = np.argpartition(-cosines, k - 1, axis=1)[:, :k] if k < len(pivots) else np.arange(len(pivots))
    return np.sort(out, axis=1)


def _described(pivots: dict[int, np.ndarray], nearest: int, shared: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                p = pivots.get(int(dim), np.ones((1, dim)))  # too rare a size for pivots of its own: one list
                k = min(nearest, len(p))
                near = nearest_pivots(_unit(part.column("v").to_pylist()), p, k)
                keys = subset_keys(near, min(shared, k))
                fixed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel().astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("cls"), part.column("label"), part.column("dim"), fixed(near), fixed(keys)], ["cls", "label", "dim", "near", "keys"])

    return run


def first_shared(a: np.ndarray, b: np.ndarray, shared: int) -> np.ndarray:
    """Key of the smallest `shared` pivots that rows of a and b have in common, -1 with fewer."""
    common = (a[:, :, None] == b[:, None, :]).any(axis=2)
    order = np.where(common, a, 1 << 40)
    order.sort(axis=1)
    lead = order[:, :shared]
    return np.where(lead[:, -1] < 1 << 40, _key(np.where(lead < 1 << 40, lead, 0)), -1)


def _verified(threshold: float, shared: int):
    def pairs(x: np.ndarray, near: np.ndarray, side: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for s in range(0, len(x), CUT):
            block = x[s : s + CUT] @ x[s:].T
            i, j = np.nonzero(block >= threshold)
            i, j = i + s, j + s
            keep = (i < j) & ((side[i] < 0) | (side[i] != side[j]))
            i, j = i[keep], j[keep]
            for t in range(0, len(i), 1 << 16):
                a, b = i[t : t + (1 << 16)], j[t : t + (1 << 16)]
                own = first_shared(near[a], near[b], min(shared, near.shape[1])) == key
                found.append((a[own], b[own]))
        return tuple(np.concatenate([f[c] for f in found] or [np.zeros(0, np.int64)]) for c in (0, 1))

    def flush(table: pa.Table) -> pa.RecordBatch:
        key, part, label, dim, cls, m, side = (table[c].to_numpy() for c in ("key", "part", "label", "dim", "cls", "m", "side"))
        change = np.ones(len(key) + 1, bool)
        change[1:-1] = (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (label[1:] != label[:-1]) | (dim[1:] != dim[:-1])
        at = np.flatnonzero(change)
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            rows = table.slice(a, b - a)
            near = np.array(rows["near"].to_pylist(), np.int64)
            i, j = pairs(_unit(rows["v"].to_pylist()), near, side[a:b], key[a])
            if len(i):
                links = np.bincount(i, m[a:b][j], b - a) + np.bincount(j, m[a:b][i], b - a)
                node, root = union_find(i, j)
                out.append((cls[a:b][node], links[node].astype(np.int64), cls[a:b][root]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in out] or [np.zeros(0, np.int64)])) for c in range(3)], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            last = [table[c][-1].as_py() for c in ("key", "part", "label", "dim")]
            same = np.logical_and.reduce([table[c].to_numpy() == x for c, x in zip(("key", "part", "label", "dim"), last, strict=True)])
            cut = int(np.argmax(same))  # rows are sorted: the last group may go on
            if cut:
                yield flush(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return run


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, nearest: int = NEAREST, shared: int = SHARED, cut: int = CUT, most_sizes: int = SIZES) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors.

    Vectors of one label and one number of components are linked if found with a cosine of at least the threshold; none
    is linked below it. n_links counts the other rows linked directly, copies included; component_id is the smallest
    vec_id reachable; kept marks the vector that is it. A vector that is null, zero, empty or holds null or non-finite
    components, or has no label, links with nothing. Labels must be whole numbers; rows that share a
    vec_id are vectors of their own; one without a vec_id counts among the copies of its vector only. Other columns are ignored; an empty table gives an empty result.

    Pivots are a hash sample of distinct vectors, 64 to 16,384 by the square root of their number and at most 2^22
    numbers in all; every vector is indexed. Copies are one class before the index. The 1,024 most frequent numbers of
    components have pivots; vectors of a rarer one, at most a 1,024th of all, are one list, in cuts: all its pairs are
    compared.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    plain = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).cast("long").alias("label"))
    made = materialize(plain.mapInArrow(_prepared, "id long, label long, dim int, v binary, digest binary"), "vectors")
    good = made.where("digest is not null")
    # A class, of equal vectors of a label, has a number of its own: ids may be shared by several.
    classes = good.groupBy("label", "digest").agg(F.min("id").alias("first"), F.count("*").alias("m"), F.first("dim").alias("dim"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    pivots: dict[int, np.ndarray] = {}
    sizes = classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(most_sizes).collect()
    left = PIVOT_NUMBERS
    for dim, n in sizes:
        want = max(2, min(left // dim, max(PIVOTS[0], min(PIVOTS[1], int(4 * n**0.5)))))
        drawn = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("digest"), "cls").limit(2 * want).select("v").collect()
        pivots[dim] = spread_out(_unit([bytes(r["v"]) for r in drawn]), want)
        left = max(0, left - pivots[dim].size)

    index = materialize(classes.mapInArrow(_described(pivots, nearest, shared), "cls long, label long, dim int, near array<long>, keys array<long>"), "index")
    posted = index.select("cls", "label", "dim", F.explode("keys").alias("key"))
    lists = posted.groupBy("label", "dim", "key").agg(F.count("*").alias("_n")).where("_n > 1").select("label", "dim", "key", F.ceil(F.col("_n") / cut).cast("int").alias("_c"))
    own = F.pmod(F.xxhash64("cls", F.lit(3)), F.col("_c")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("_c") - 1), lambda o: F.struct((F.least(own, o) * F.col("_c") + F.greatest(own, o)).alias("part"), F.when(o == own, -1).otherwise(own).alias("side")))
    rows = posted.join(lists, ["label", "dim", "key"]).withColumn("_x", F.explode(others)).select("cls", "label", "dim", "key", F.col("_x.part").alias("part"), F.col("_x.side").alias("side"))
    rows = rows.join(index.select("cls", "near"), "cls").join(classes.select("cls", "m", "v"), "cls")
    rows = rows.repartition("label", "dim", "key", "part").sortWithinPartitions("label", "dim", "key", "part", "cls")
    found = materialize(rows.mapInArrow(_verified(threshold, shared), "node long, links long, root long"), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("_links"))
    labels = components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "_node")
    per = classes.select("label", "digest", "cls", "m", "first").join(links, F.col("cls") == F.col("node"), "left").join(labels, F.col("cls") == F.col("_node"), "left")
    smallest = per.where("root is not null").groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("_least"))
    per = per.join(smallest, F.col("root") == F.col("_root"), "left")
    whole = lambda label, digest: F.concat(digest, label.cast("string").cast("binary"))
    per = per.select(whole(F.col("label"), F.col("digest")).alias("_k"), "m", (F.coalesce("_links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("_least", "first").alias("component"))
    # Copies of one vector, and vectors that link with nothing, are dealt out.
    out = join_spread(made.select("id", whole(F.col("label"), F.col("digest")).alias("key")), "key", materialize(per, "classes_found"), "_k", "m", ["id"])
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), component.isNull()).alias("kept"))
