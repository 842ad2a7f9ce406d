"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes a set of word shingles (64-bit hashes), a MinHash signature and a digest of the set. Equal sets are
   one class; only classes go on, so that exact copies never make pairs.
2. Bands of the signature put classes into buckets. Within a bucket, signatures are compared batch by batch; a pair is
   dropped as soon as the posterior probability that its similarity reaches the threshold falls under `miss`.
3. Of the survivors, a bucket first proposes a spanning forest, the likeliest pairs first. Those are verified on the full
   sets and the links' components found. Then each member proposes its likeliest survivors in other components, and at
   last all survivors across components. What is never verified joins classes that are one component already, so that the
   components are those of all surviving pairs, while a group of n near copies costs about n verifications, not n^2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordia.llm.common import bound_batches, components, fresh, join_spread, materialize, mix64, passes, spans, words

THRESHOLD = 0.8
ROWS, BANDS = 5, 26
#: Of classes that share a bucket, one byte of each of so many further hashes is compared, in batches.
PROOF, BATCH = 1024, 64
#: So many of these bytes go along while a bucket proposes its likeliest pairs; all of them in the last round.
SHORT_PROOF = 256
MISS = 1e-4
#: Members of a bucket that one call compares; larger buckets are cut, in the last round into all pairs of cuts.
CUT = 1024
#: Signatures use 32-bit multiply-and-xor permutations of the shingles' hashes.
_SEED = 20240229


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(_SEED)
    return draw.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32), draw.integers(0, 1 << 31, k, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-word shingles of one text's word hashes, sorted; a shorter text is one shingle, an empty one has none."""
    return np.unique(shingles_in_order(h, n))


def shingles_in_order(h: np.ndarray, n: int) -> np.ndarray:
    if not len(h):
        return h
    n = min(n, len(h))
    out = h[: len(h) - n + 1]
    with np.errstate(over="ignore"):
        for i in range(1, n):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
        return mix64(out + np.uint64(n))


def signature(s: np.ndarray, k: int) -> np.ndarray:
    xor, times = _permutations(k)
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(out, (((low[i : i + 4096, None] ^ xor) * times).min(axis=0)), out=out)
    return out


def _features(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in passes(batch, "text"):
                found = words(data, offsets)
                at = spans(found.text, part.num_rows)
                sets = [shingles(found.hash[a:b], n) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("place"), pa.array([len(s) for s in sets], pa.int64()), pa.array([*map(digest_of, sets)], pa.binary()), pa.array([signature(s, k).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["id", "place", "n", "digest", "sig"],
                )

    return run


def digest_of(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sets(n: int, proof: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in passes(batch, "text"):
                found = words(data, offsets)
                at = spans(found.text, part.num_rows)
                sets = [shingles(found.hash[a:b], n) for a, b in zip(at[:-1], at[1:], strict=True)]
                mine = [i for i, (s, wanted) in enumerate(zip(sets, part.column("digest").to_pylist(), strict=True)) if digest_of(s) == wanted]
                sets = [sets[i] for i in mine]
                places = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                proofs = pa.array([signature(s, proof).astype(np.uint8).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("cls").take(pa.array(mine, pa.int64())), pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(flat)), proofs], ["cls", "items", "proof"])

    return run


@cache
def least_matches(threshold: float, k: int, miss: float) -> tuple[tuple[int, int], ...]:
    """(hashes compared, least matches that keep a pair) after each batch.

    With a uniform prior, m matches of n leave a Beta(m + 1, n - m + 1) posterior of a byte's chance of matching, whose tail
    over t is the chance of at most m successes in n + 1 draws at t. Bytes of different hashes match by 1 / 256.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in sorted({*range(BATCH, k, BATCH), k}):
        tail, m = 0.0, 0
        while m <= n and (tail := tail + comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < miss:
            m += 1
        out.append((n, m))
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of proofs: those that survive every batch (indexes), and their matches."""
    left = np.flatnonzero(100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
    score, done = np.zeros(len(left), np.int64), 0
    for n, least in least_matches(percent / 100, a.shape[1], miss):
        score = score + (a[left, done:n] == b[left, done:n]).sum(axis=1)
        stay = score >= least
        left, score, done = left[stay], score[stay], n
    return left, score


class Bucket(NamedTuple):
    """Members of one or more buckets: class, component so far, size of set, proof, keys of all bands, the bucket's key, cut."""

    cls: np.ndarray
    label: np.ndarray
    n: np.ndarray
    sig: np.ndarray
    bands: np.ndarray
    key: np.ndarray
    side: np.ndarray

    def cut(self, at: slice) -> Bucket:
        return Bucket(*(x[at] for x in self))


def _survivors(m: Bucket, i: np.ndarray, j: np.ndarray, percent: int, miss: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of index pairs (i, j), those of different labels that survive, in slices of bounded memory.

    A pair counts in the bucket of the first band that both share, and, where a bucket is cut in pairs of cuts, across these.
    """
    apart = (m.label[i] != m.label[j]) & ((m.side[i] < 0) | (m.side[i] != m.side[j]))
    i, j = i[apart], j[apart]
    kept = []
    for s in range(0, len(i), 1 << 15):
        x, y = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
        same = m.bands[x] == m.bands[y]
        first = m.bands[x, same.argmax(axis=1)] == m.key[x]
        x, y = x[first], y[first]
        at, score = plausible(m.sig[x], m.sig[y], m.n[x], m.n[y], percent, miss)
        kept.append((x[at], y[at], score))
    return tuple(np.concatenate([k[c] for k in kept] or [np.zeros(0, np.int64)]) for c in range(3))


def _forest(i: np.ndarray, j: np.ndarray, score: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Indexes of a spanning forest of the pairs over labels, the best scores first."""
    nodes, flat = np.unique(np.concatenate([label[i], label[j]]), return_inverse=True)
    up = list(range(len(nodes)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out, a, b = [], flat[: len(i)].tolist(), flat[len(i) :].tolist()
    for k in np.argsort(-score, kind="stable").tolist():
        x, y = top(a[k]), top(b[k])
        if x != y:
            up[x] = y
            out.append(k)
            if len(out) == len(nodes) - 1:
                break
    return np.array(out, np.int64)


def _best(i: np.ndarray, j: np.ndarray, score: np.ndarray, label: np.ndarray, most: int) -> np.ndarray:
    """Indexes of pairs among the `most` best of a node of the smaller component to another component."""
    _, at, sizes = np.unique(label, return_inverse=True, return_counts=True)
    swap = sizes[at[i]] > sizes[at[j]]
    node, other = np.where(swap, j, i), label[np.where(swap, i, j)]
    order = np.lexsort((-score, other, node))
    same = np.zeros(len(order), bool)
    same[1:] = (node[order][1:] == node[order][:-1]) & (other[order][1:] == other[order][:-1])
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    return order[rank < most]


def _propose(percent: int, miss: float, most: int | None):
    """Buckets in sorted order -> proposed pairs. most: None a spanning forest, 0 all survivors, else so many a node."""

    def pairs(m: Bucket) -> tuple[np.ndarray, np.ndarray]:
        i, j, score = _survivors(m, *np.triu_indices(len(m.cls), 1), percent, miss)
        if len(i) > 1 and most != 0:
            keep = _forest(i, j, score, m.label) if most is None else _best(i, j, score, m.label, most)
            i, j = i[keep], j[keep]
        return np.minimum(m.cls[i], m.cls[j]), np.maximum(m.cls[i], m.cls[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> pa.RecordBatch:
            key, part = table["key"].to_numpy(), table["part"].to_numpy()
            matrix = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind).reshape(len(key), -1)
            m = Bucket(*(table[c].to_numpy() for c in ("cls", "label", "n")), matrix("proof", np.uint8), matrix("bands", np.uint32), key.astype(np.uint32), table["side"].to_numpy())
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]), [True]]))
            two = starts[:-1][np.diff(starts) == 2]
            i, j, _ = _survivors(m, two, two + 1, percent, miss)
            found = [(np.minimum(m.cls[i], m.cls[j]), np.maximum(m.cls[i], m.cls[j]))]
            found += [pairs(m.cut(slice(a, b))) for a, b in zip(starts[:-1], starts[1:], strict=True) if b - a > 2]
            u, v = (np.concatenate([f[c] for f in found]) for c in (0, 1))
            both = np.unique(np.stack([u, v], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < 4 * CUT:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key, part = table["key"].to_numpy(), table["part"].to_numpy()
            last = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1:].max(initial=-1)) + 1
            if last:
                yield flush(table.slice(0, last))
            held = table.slice(last).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return run


def _active(members: DataFrame, labels: DataFrame | None, sigs: DataFrame, across: bool, proof: int, cut: int = CUT) -> DataFrame:
    """Members of buckets with two or more labels, with signatures, dealt into parts of at most about `cut` members."""
    if labels is not None:
        members = members.join(labels.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("label", F.coalesce("root", "cls")).drop("root")
    else:
        members = members.withColumn("label", F.col("cls"))
    sizes = members.groupBy("key").agg(F.count("*").alias("_m"), F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi").select(F.col("key").alias("_key"), "_m", F.ceil(F.col("_m") / cut).cast("int").alias("_c"))
    # A bucket of many members is dealt out before it is cut.
    rows = join_spread(members, "key", sizes, "_key", "_m", ["cls"], "inner")
    own = F.pmod(F.xxhash64("cls", F.lit(1 if labels is None else 2)), F.col("_c")).cast("int")
    if across:  # a part for each cut, and for each pair of cuts
        others = F.transform(F.sequence(F.lit(0), F.col("_c") - 1), lambda o: F.struct((F.least(own, o) * F.col("_c") + F.greatest(own, o)).alias("part"), F.when(o == own, -1).otherwise(own).alias("side")))
        rows = rows.withColumn("_x", F.explode(others)).withColumns({"part": F.col("_x.part"), "side": F.col("_x.side")})
    else:
        rows = rows.withColumns({"part": own, "side": F.lit(-1)})
    rows = rows.join(sigs, "cls").select("key", "part", "side", "cls", "label", "n", F.call_function("substring", F.col("proof"), F.lit(1), F.lit(proof)).alias("proof"), "bands")
    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "cls")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = int(100 * THRESHOLD), rows: int = ROWS, bands: int = BANDS, proof: int = PROOF, miss: float = MISS, cut: int = CUT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of shingles. component_id is the
    smallest doc_id reachable by links; kept marks the document that is it. A text without words, and a null text, has an
    empty set, links with nothing and is kept. doc_id must be a whole number; rows that share a doc_id are judged each by
    its text, and one that links with nothing is its own component; a row without one joins the component of equal sets only, and is kept if there is none. Other columns are
    ignored; an empty table gives an empty result. Texts that link at exactly the
    threshold are found unless all bands miss them (3e-5 by default, less above it).
    """
    bound_batches(docs.sparkSession)
    k = rows * bands
    # A row is found again by its id and a hash of its text, which tells apart rows that share an id.
    plain = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("place"), F.col(text).cast("binary").alias("text"))
    feats = materialize(plain.mapInArrow(_features(shingle, k), "id long, place long, n long, digest binary, sig binary"), "features")
    firsts = feats.where("n > 0").groupBy("digest").agg(F.min(F.struct("id", "place")).alias("_f"), F.count("*").alias("copies")).select(F.col("digest").alias("_d"), F.col("_f.id").alias("_i"), F.col("_f.place").alias("_p"), "copies")
    reps = feats.where("n > 0 and id is not null").join(firsts, (F.col("digest") == F.col("_d")) & (F.col("id") == F.col("_i")) & (F.col("place") == F.col("_p")))
    # A class has a number of its own: ids may be shared by several.
    reps = reps.select("digest", "id", "place", "n", "sig", "copies").dropDuplicates(["digest"]).withColumn("cls", F.monotonically_increasing_id())
    reps = materialize(reps, "classes")

    band = lambda i: F.xxhash64(i, F.call_function("substring", F.col("sig"), i * (4 * rows) + 1, F.lit(4 * rows)))
    keyed = reps.select("cls", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("_m")).where("_m > 1").select("key")
    members = materialize(keyed.join(shared, "key").select("key", "cls"), "buckets")
    # Each member's keys of all bands tell, for a pair, which bucket is the first that both share.
    involved = reps.join(members.select("cls").distinct(), "cls", "left_semi").select("cls", "digest", F.col("id").alias("_i"), F.col("place").alias("_p"))
    texts = plain.join(involved, (F.col("id") == F.col("_i")) & (F.col("place") == F.col("_p"))).select("cls", "digest", "text")
    sets = materialize(texts.mapInArrow(_sets(shingle, proof), "cls long, items array<long>, proof binary").dropDuplicates(["cls"]), "sets")
    keys = reps.select("cls", "n", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band).alias("bands")).mapInArrow(_packed, "cls long, n long, bands binary")
    sigs = materialize(sets.select("cls", "proof").join(keys, "cls"), "signatures")

    tested = links = labels = None
    for most in (None, 8, 0):
        spread = _active(members, labels, sigs, across=most == 0, proof=proof if most == 0 else min(proof, SHORT_PROOF), cut=cut)
        pairs = spread.mapInArrow(_propose(percent, miss, most), "a long, b long").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs", few=True)
        if pairs.isEmpty():  # nor can a later round verify what was never proposed
            continue
        new = _verified(pairs, sets, percent)
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = new if links is None else links.unionByName(new)
        links = materialize(links, "links", few=True)
        labels = components(links)
    numbered = reps.select("digest", "id", "cls", "copies")
    if labels is not None:
        numbered = numbered.join(labels, F.col("cls") == F.col("node"), "left").withColumn("cls", F.coalesce("root", "cls"))
        smallest = numbered.where("node is not null").groupBy(F.col("cls").alias("_c")).agg(F.min("id").alias("_least"))
        numbered = numbered.join(smallest, F.col("cls") == F.col("_c"), "left").withColumn("id", F.coalesce("_least", "id"))
    found = numbered.select(F.col("digest").alias("_d"), F.col("id").alias("component"), "copies")
    # Copies of one text, and texts without words, are dealt out.
    out = join_spread(feats.select("id", "place", "n", "digest"), "digest", found, "_d", "copies", ["id", "place"])
    component = F.coalesce("component", "id")
    kept = F.coalesce(component == F.col("id"), component.isNull())
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("bands")
        values = lists.values.to_numpy()
        packed = pa.array([values[a:b].astype(np.uint32).tobytes() for a, b in zip(lists.offsets[:-1].to_pylist(), lists.offsets[1:].to_pylist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), packed], ["cls", "n", "bands"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold, as edges (u, v)."""
    one = pairs.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a")
    two = one.join(sets.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    sized = two.select("a", "b", both.alias("i"), (F.size("x") + F.size("y")).alias("s"))
    return sized.where(F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs of which near_duplicates keeps the document, in the columns of docs; of rows that share a kept doc_id, all stay, and so do rows without one."""
    (name,) = fresh(docs, "kept_id")
    kept = near_duplicates(docs, doc_id, text, **options).where("kept").select(F.col(doc_id).alias(name)).distinct()
    return docs.join(kept, F.col(doc_id) == F.col(name), "left_semi").unionByName(docs.where(F.col(doc_id).isNull()))
