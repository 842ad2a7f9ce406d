"""What several training-data operators share: the shared folder, vectorised word hashing, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII characters; A-Z alone is lower-cased.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: All ASCII but letters and digits, for words without punctuation.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Text bytes that one numpy pass works on (a longer text makes a pass of its own).
PASS_BYTES = 1 << 20
#: Bytes that Spark puts into one Arrow batch (and one row more).
BATCH_BYTES = 4 << 20
#: Edges up to which one task finishes the components: 2^20 pairs of longs are 16 MB.
LOCAL_EDGES = 1 << 20

#: Of a join's keys, the HOT most frequent ones with over LEAST_HOT rows are dealt out over SALTS tasks.
LEAST_HOT, HOT, SALTS = 1 << 14, 1 << 14, 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session may go without that setting; it gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if found := sc.getCheckpointDir():
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="accordia-"))
    return sc.getCheckpointDir().rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Holds the Arrow batches of this session to BATCH_BYTES, however long its texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/accordia/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors.

    few: of a table that is small beside the data, such as links, at most eight files for each of the cluster's cores, or 64.
    """
    path = table_path(df.sparkSession, name)
    (df.coalesce(max(64, 8 * df.sparkSession.sparkContext.defaultParallelism)) if few else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores before it as make it no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def join_spread(rows: DataFrame, key: str, table: DataFrame, its: str, count: str, spread: list[str], how: str = "left", least_hot: int | None = None) -> DataFrame:
    """rows joined with a table that is cheap to read twice (a row a key, column `its`), so that no key's rows all come to one task.

    The HOT most frequent keys by `count`, of over LEAST_HOT rows each, are dealt out over SALTS parts by a hash of the
    columns `spread`, and so are rows without a key; each other key has at most a share of 1 / HOT of all rows. Only the
    hot keys, a bounded list, are broadcast.
    """
    hot_, salt_, own_ = fresh(rows, "hot", "salt", "own_salt")
    hot = table.where(F.col(count) > (LEAST_HOT if least_hot is None else least_hot)).orderBy(F.desc(count), its).limit(HOT).select(F.col(its).alias(hot_))
    part = F.pmod(F.xxhash64(*spread), F.lit(SALTS))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col(hot_), "left").withColumn(salt_, F.when(F.col(hot_).isNotNull(), part).when(F.col(key).isNull(), F.xxhash64(*spread)).otherwise(0)).drop(hot_)
    copies = table.join(F.broadcast(hot), F.col(its) == F.col(hot_), "left").withColumn(own_, F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col(hot_).isNull(), 0).otherwise(SALTS - 1).cast("long")))).drop(hot_, count)
    return dealt.join(copies, (F.col(key) == F.col(its)) & (F.col(salt_) == F.col(own_)), how).drop(salt_, own_, its)


def without(docs: DataFrame, doc_id: str, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in gone's first column; rows without a doc_id stay."""
    (name,) = fresh(docs, "gone")
    return docs.join(gone.toDF(name).distinct(), F.col(doc_id) == F.col(name), "left_anti")


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n at least."""
    if len(_tables.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without a copy; a null is an empty text."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, places, values = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words(NamedTuple):
    """Words of some texts: the text's index, a 64-bit hash of the lower-cased word, where it begins and ends."""

    text: np.ndarray
    hash: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> Words:
    """apart: for each byte, whether it parts words."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none.astype(np.uint64), none, none)
    solid = ~apart[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = mix64((sums[end] - sums[begin]) * down[begin])
    return Words(np.searchsorted(offsets[1:], begin, side="right"), h, begin, end)


def passes(batch: pa.RecordBatch, column: str, most: int = PASS_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch with about `most` bytes of text each: (slice, bytes, offsets)."""
    at = batch.schema.get_field_index(column)
    _, offsets = raw(batch.column(at))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        part = batch.slice(first, last - first)
        yield (part, *raw(part.column(at)))
        first = last


def spans(text: np.ndarray, n: int) -> np.ndarray:
    """First index of each of n texts in a sorted array of text indexes, and the end."""
    return np.searchsorted(text, np.arange(n + 1), side="left")


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of an edge list, by rounds of hooking and halving over arrays."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while not np.array_equal(root, up := root[root]):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if found:
        node, root = union_find(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) with the smallest node reachable, for every node of edges (u long, v long).

    Up to `local_edges` distinct edges, 16 MB, are finished by one task. Beyond that, large-star and small-star
    steps (each a grouped minimum and a join on the node) run until they change nothing or few enough edges are left.
    Self-loops and repeated edges are harmless; nulls are dropped.
    """
    edges = materialize(
        edges.where("u is not null and v is not null").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), "edges", few=True
    )
    before = None
    while edges.count() > local_edges:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("m < u").select("u", F.col("m").alias("v")))
        large = materialize(large.where("u <> v").distinct(), "large", few=True)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small", few=True)
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(now) == before:
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        before = tuple(now)
    return materialize(edges.repartition(1).mapInArrow(_finish, "node long, root long"), "components")
