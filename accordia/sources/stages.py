"""Stages over runs: a run is read, never changed; a stage writes beside it, publishes at once, and resumes.

A published run is a folder of Parquet files and a row in its catalogue (a folder of its own): name, version, the path of its
files, the fingerprints of its inputs and of itself. The row, written last, is what publishes: readers take the newest row, and
files without one, of a stage that failed, are not seen by anybody.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOGUE = "name string, version long, path string, inputs map<string,string>, fingerprint string, n_rows long, stage string"


class ChangedInput(RuntimeError):
    """An input is not what it was when the stage began, or when a run that is resumed was made of it."""


class Run(NamedTuple):
    name: str
    version: int
    path: str
    inputs: dict[str, str]
    fingerprint: str
    n_rows: int
    stage: str


def fingerprint(df: DataFrame) -> tuple[str, int]:
    """(a digest of the rows in any order, their number), from sums of hashes that the executors make: 3 numbers come to the driver.

    Repeated rows count as often as they come; columns count with their names and types.
    """
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    hashes = df.select(F.xxhash64(row).alias("a"), F.xxhash64(F.lit(1), row).alias("b"))
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    n, a, b = hashes.agg(F.count("*"), whole("a"), whole("b")).first()
    names = ",".join(f"{c} {t}" for c, t in sorted(df.dtypes))
    digest = df.sparkSession.range(1).select(F.sha2(F.lit(f"{names}|{n}|{a}|{b}"), 256)).first()[0]
    return digest, n


class Catalogue:
    """Published runs below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(CATALOGUE).parquet(f"{self.folder}/_catalogue")
        except AnalysisException as gone:
            if gone.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], CATALOGUE)

    def newest(self, name: str) -> Run | None:
        found = self.rows().where(F.col("name") == name).orderBy(F.desc("version"), "path").first()
        return Run(*found) if found else None

    def read(self, name: str) -> DataFrame:
        run = self.newest(name)
        if run is None:
            raise KeyError(name)
        return self.spark.read.parquet(run.path)

    def write(self, df: DataFrame, name: str) -> str:
        """The new folder that df was written to; nobody sees it until it is published."""
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def publish(self, path: str, name: str, inputs: dict[str, str], stage: str = "") -> Run:
        """Adds the row that publishes a written folder, with its fingerprint as it is read back."""
        before = self.newest(name)
        digest, n = fingerprint(self.spark.read.parquet(path))
        run = Run(name, before.version + 1 if before else 1, path, inputs, digest, n, stage)
        self.spark.createDataFrame([run], CATALOGUE).coalesce(1).write.mode("append").parquet(f"{self.folder}/_catalogue")
        return run

    def verify(self, name: str) -> None:
        """An error if the files of a run are no longer what was published."""
        run = self.newest(name)
        if run is None or fingerprint(self.spark.read.parquet(run.path)) != (run.fingerprint, run.n_rows):
            raise ChangedInput(name)


def run_stage(catalogue: Catalogue, stage: str, inputs: dict[str, DataFrame], output: str, transform: Callable[..., DataFrame], key: str = "item_id") -> Run:
    """Publishes transform(**inputs) as the run `output`, of which the first input's rows are those still to be done.

    Inputs are fingerprinted before and after; if one changes meanwhile, nothing is published. A published run of the same
    stage and inputs is resumed: rows of the first input whose key it has are left out, and its rows are published again
    with the new ones; without new ones it stays as it is. A run of the same name that was made of other inputs, or by
    another stage, is an error: publish under another name. Keys that are null are done each time.
    """
    seen = {name: fingerprint(df)[0] for name, df in inputs.items()}
    first, *_ = inputs
    old = catalogue.newest(output)
    if old is not None and (old.stage != stage or {k: v for k, v in old.inputs.items() if k != first} != {k: v for k, v in seen.items() if k != first}):
        raise ChangedInput(f"{output} was made by {old.stage} of other inputs")
    todo, done = inputs[first], None
    if old is not None:
        catalogue.verify(output)
        done = catalogue.read(output)
        todo = todo.join(done.select(F.col(key).alias("_done")).where("_done is not null").distinct(), F.col(key) == F.col("_done"), "left_anti")
        if old.inputs[first] == seen[first] and todo.where(F.col(key).isNotNull()).isEmpty():
            return old
    made = transform(**(inputs | {first: todo}))
    made = made if done is None else done.unionByName(made)
    path = catalogue.write(made, output)
    if now := [name for name, df in inputs.items() if fingerprint(df)[0] != seen[name]]:
        raise ChangedInput(f"{', '.join(now)} changed while {stage} ran")
    return catalogue.publish(path, output, seen, stage)
