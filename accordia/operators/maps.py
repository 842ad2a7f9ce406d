"""Fitted maps as values: a registry table, applied by binary search in an expression.

A row holds a chunk of a stratum's map: kind (isotonic or platt), version, chunk, xs and ys (ascending knots, with the first
one of the next chunk at the end), slope, intercept. Knots of a large map are many rows of bounded size; a row of data meets
the heads of its stratum's chunks, and then one chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordia.functions.text import clip01
from accordia.operators.order import search

#: Knots of a chunk.
CHUNK = 1 << 10
KINDS = ("isotonic", "platt")
SCHEMA = "stratum string, kind string, version string, chunk int, xs array<double>, ys array<double>, slope double, intercept double"


def isotonic_registry(knots: DataFrame, version: str = "1", chunk: int = CHUNK) -> DataFrame:
    """The registry of knots (stratum, x, y)."""
    w = Window.partitionBy("stratum").orderBy("x")
    at = knots.select("stratum", "x", "y", F.floor((F.row_number().over(w) - 1) / chunk).cast("int").alias("chunk"), F.lead("x").over(w).alias("_x"), F.lead("y").over(w).alias("_y"))
    both = at.groupBy("stratum", "chunk").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("_k"), F.max_by(F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")), "x").alias("_next"))
    every = F.when(F.col("_next.x").isNull(), F.col("_k")).otherwise(F.concat("_k", F.array("_next")))
    part = lambda c: F.transform(every, lambda k: k[c].cast("double"))
    return both.select(F.col("stratum").cast("string").alias("stratum"), F.lit("isotonic").alias("kind"), F.lit(version).alias("version"), "chunk", part("x").alias("xs"), part("y").alias("ys"), F.lit(None).cast("double").alias("slope"), F.lit(None).cast("double").alias("intercept"))


def platt_registry(lines: DataFrame, version: str = "1") -> DataFrame:
    """The registry of lines (stratum, slope, intercept)."""
    nothing = F.array().cast("array<double>")
    return lines.select(F.col("stratum").cast("string").alias("stratum"), F.lit("platt").alias("kind"), F.lit(version).alias("version"), F.lit(0).alias("chunk"), nothing.alias("xs"), nothing.alias("ys"), "slope", "intercept")


def between(xs: Column, ys: Column, x: Column) -> Column:
    """The value at x of a line through ascending knots, flat beyond its ends; null without knots."""
    k, n = search(xs, x), F.size(xs)
    x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
    return F.when(k == 0, F.get(ys, F.lit(0))).when(k == n, F.get(ys, n - 1)).otherwise(y0 + (x - x0) / (x1 - x0) * (y1 - y0))


def apply_maps(rows: DataFrame, registry: DataFrame, by: str = "stratum", x: str = "x", how: str = "inner") -> DataFrame:
    """rows with p, held to [0, 1], by their stratum's map of a registry with one map a stratum.

    how: inner leaves rows without a map out, left gives them a null p. A null x has a null p.
    """
    one = Window.partitionBy("stratum").orderBy("chunk")
    heads = registry.select("stratum", "chunk", F.get("xs", F.lit(0)).alias("_x")).groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("chunk", "_x"))).alias("_h"))
    heads = heads.select(F.col("stratum").alias("_s"), F.transform("_h", lambda h: h["_x"]).alias("_heads"))
    chunks = registry.select(F.col("stratum").alias("_t"), (F.row_number().over(one) - 1).alias("_c"), "kind", "xs", "ys", "slope", "intercept").select("_t", "_c", F.struct("kind", "xs", "ys", "slope", "intercept").alias("_map"))
    met = rows.join(heads, F.col(by).cast("string") == F.col("_s"), how)
    met = met.withColumn("_at", F.coalesce(F.greatest(search(F.col("_heads"), F.col(x).cast("double")) - 1, F.lit(0)), F.lit(0)))
    met = met.join(chunks, (F.col("_s") == F.col("_t")) & (F.col("_at") == F.col("_c")), "left")
    line = 1 / (1 + F.exp(-(F.col("_map.slope") * clip01(F.col(x)) + F.col("_map.intercept"))))
    p = F.when(F.col("_map.kind") == "platt", line).otherwise(between(F.col("_map.xs"), F.col("_map.ys"), F.col(x).cast("double")))
    return met.select(*rows.columns, clip01(p).alias("p"))


def violations(registry: DataFrame) -> DataFrame:
    """stratum, rule: each rule that a stratum's map breaks."""
    up = lambda c, strict: F.forall(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.coalesce(F.get(c, i) > F.get(c, i - 1) if strict else F.get(c, i) >= F.get(c, i - 1), F.size(c) < 2))
    iso, line = F.col("kind") == "isotonic", F.col("kind") == "platt"
    rules = {
        "unknown kind": ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "no knots": iso & (F.size("xs") == 0), "knots of two lengths": iso & (F.size("xs") != F.size("ys")),
        "xs do not ascend": iso & ~up(F.col("xs"), True), "ys fall": iso & ~up(F.col("ys"), False), "ys beyond [0, 1]": iso & F.exists("ys", lambda y: ~y.between(0, 1)),
        "no line": line & (F.col("slope").isNull() | F.col("intercept").isNull()), "falling line": line & (F.col("slope") < 0),
    }
    one = registry.select("stratum", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))).alias("rule"))
    w = Window.partitionBy("stratum").orderBy("chunk")
    joins = registry.where(iso).select("stratum", "xs", "chunk", F.lead(F.get("xs", F.lit(0))).over(w).alias("_next"), (F.row_number().over(w) - 1).alias("_at"))
    broken = joins.where((F.col("chunk") != F.col("_at")) | (F.col("_next").isNotNull() & (F.element_at("xs", -1) != F.col("_next")))).select("stratum", F.lit("chunks do not join").alias("rule"))
    several = registry.groupBy("stratum").agg(F.count_distinct("kind", "version").alias("_n")).where("_n > 1").select("stratum", F.lit("several maps").alias("rule"))
    return one.unionByName(broken).unionByName(several).distinct()


def to_json(registry: DataFrame) -> DataFrame:
    """stratum, json: each map as one value; a reader needs nothing else."""
    body = F.struct("kind", "version", "chunk", "xs", "ys", "slope", "intercept")
    return registry.select("stratum", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def from_json(values: DataFrame) -> DataFrame:
    body = SCHEMA.split(", ", 1)[1]
    return values.select("stratum", F.from_json("json", body).alias("_m")).select("stratum", "_m.*")
