"""Run tables: a run is a directory that is written once; the next stage writes another."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line; a line that is no object of the schema is an error, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_run(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Refuses to write over a run, and to write NaN or infinity."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    checked = df.withColumns({c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.raise_error(F.lit(f"{c} is not finite")).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in floats})
    checked.write.mode("errorifexists").format(kind).save(path)


def pending(items: DataFrame, done: DataFrame, key: str = "item_id") -> DataFrame:
    """Items without a finished record (an anti-join: the done set may be of any size)."""
    return items.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def usable(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records without an error, number of those with one)."""
    return records.where("error is null"), records.agg(F.count("error").alias("errors"))


def select_items(items: DataFrame, slices: list[str], limit: int | None = None, order: str = "ord") -> DataFrame:
    chosen = items.where(F.col("slice").isin(*slices))
    return chosen.orderBy(order).limit(limit) if limit is not None else chosen


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row by order of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with two or more values."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def override(rows: DataFrame, overrides: DataFrame, key: str, flag: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose flag an override sets true, never false; overrides that match no row)."""
    won = overrides.groupBy(key).agg(F.bool_or(flag).alias("_o"))
    out = rows.join(won, key, "left").withColumn(flag, F.col(flag) | F.coalesce("_o", F.lit(False))).drop("_o")
    return out, overrides.join(rows.select(key).distinct(), key, "left_anti")


def first_by_rounded(curves: DataFrame, order: str, places: int = 3) -> DataFrame:
    """The first of all curves that are equal when rounded."""
    w = Window.partitionBy(F.transform("values", lambda x: F.round(x, places))).orderBy(order)
    return curves.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def content_hash(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of each file with CRLF read as LF."""
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n", "\n")
    return spark.read.format("binaryFile").load(path).select("path", F.sha2(F.encode(text, "ISO-8859-1"), 256).alias("sha256"))


def tree_hash(spark: SparkSession, path: str) -> str:
    """One digest over all files below path, by relative path: executors hash the files, the driver their digests."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", "length", F.sha2("content", 256).alias("h")).orderBy("path").toLocalIterator()
    out = hashlib.sha256()
    for r in rows:
        out.update(f"{r['path'].rsplit(path.rstrip('/'), 1)[-1]}\0{r['length']}\0{r['h']}\n".encode())
    return out.hexdigest()
