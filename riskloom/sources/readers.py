"""Scans with header hygiene, and settings."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trimmed_names(df: DataFrame) -> DataFrame:
    """Column names without outer blanks; names that then collide are an error."""
    names = [c.strip() for c in df.columns]
    twice = sorted(n for n, k in Counter(names).items() if k > 1)
    if twice:
        raise ValueError(f"column names collide once trimmed: {twice}")
    return df.toDF(*names)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(f"`{c}`")) for c in floats}) if floats else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV table with a header. Without a schema, types are inferred, which reads the data once more."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema).option("enforceSchema", True) if schema else reader.option("inferSchema", True)
    try:
        return nan_to_null(trimmed_names(reader.csv(path)))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"{path} is not there; write the table first, or point the settings at it") from error
        raise


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(trimmed_names(spark.read.parquet(path)))


def preview(df: DataFrame, target: str, n: int = 5) -> tuple[DataFrame, int, bool]:
    """First rows, number of columns, whether the target is there."""
    return df.limit(n), len(df.columns), target in df.columns


def largest_file(spark: SparkSession, folder: str, pattern: str = "*.csv") -> str | None:
    """Path of the largest file of that pattern below the folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.agg(F.max_by("path", F.struct("length", "path"))).first()[0]


class StoreError(ValueError):
    """A folder that is no finished store, or another one than was asked for."""


MARKER = "_READY.json"


def fingerprint(*parts: object) -> str:
    """A short name of what a table was made from."""
    return hashlib.sha256(json.dumps([str(p) for p in parts]).encode()).hexdigest()[:16]


def source_mark(spark: SparkSession, paths: list[str]) -> str:
    """A name of the present state of some files: their paths, lengths and times. Contents are not read."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    return fingerprint(*files.agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


def _marker(spark: SparkSession, path: str) -> dict | None:
    """What a store says of itself; None where there is no folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return None
    if not system.exists(spark._jvm.org.apache.hadoop.fs.Path(path, MARKER)):
        raise StoreError(f"{path} holds no finished store; choose another path, or force a new one")
    stream = system.open(spark._jvm.org.apache.hadoop.fs.Path(path, MARKER))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def materialized(spark: SparkSession, make: Callable[[], DataFrame], path: str, force: bool = False, source: str = "", partition_by: list[str] = ()) -> DataFrame:
    """The table at `path`, made and written once (or anew, by force).

    It is written beside, given a marker (schema, rows, the source's fingerprint) and renamed, so a broken write never stands at `path`. Of two writers, the first to
    rename wins and the other takes its table. A folder without a marker, a store of another source, or one whose files do not have the marker's schema or
    rows raise StoreError.
    """
    path = path.rstrip("/")
    marker = None if force else _marker(spark, path)
    if marker is None:
        jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        beside = f"{path}.{uuid.uuid4().hex}"
        system = jvm.Path(beside).getFileSystem(conf)
        try:
            make().write.partitionBy(*partition_by).parquet(beside)
            written = spark.read.parquet(beside)
            marker = {"schema": written.schema.json(), "rows": written.count(), "source": source}
            out = system.create(jvm.Path(beside, MARKER))
            out.write(json.dumps(marker).encode())
            out.close()
            if force:
                system.delete(jvm.Path(path), True)
            files = jvm.FileContext.getFileContext(system.getUri(), conf)
            try:
                files.rename(jvm.Path(beside), jvm.Path(path), spark._sc._gateway.new_array(jvm.Options.Rename, 0))
            except Py4JJavaError as error:
                if not system.exists(jvm.Path(path)):
                    raise StoreError(f"{path} could not be put in place: {error.java_exception}") from error
                marker = _marker(spark, path)  # another writer was first
        finally:
            system.delete(jvm.Path(beside), True)
    if marker["source"] != source:
        raise StoreError(f"{path} was made from another source; force a new one, or choose another path")
    found = spark.read.parquet(path)
    if found.schema.json() != marker["schema"] or found.count() != marker["rows"]:
        raise StoreError(f"{path} is not what its marker says")
    return found


@dataclass(frozen=True)
class Settings:
    """Read from the environment, with defaults."""

    data_dir: str = "data"
    seed: int = 42
    folds: int = 5
    target: str = "flag"

    @classmethod
    def from_environment(cls, prefix: str = "RISKLOOM_") -> Settings:
        return cls(**{k: type(v)(os.environ.get(prefix + k.upper(), v)) for k, v in cls().__dict__.items()})


def doctor(spark: SparkSession, settings: Settings) -> dict[str, bool]:
    """What a run needs, and whether it is there."""
    try:
        found = bool(spark.read.parquet(settings.data_dir).columns)
    except AnalysisException:
        found = False
    return {"spark": spark.version >= "3.5", "data": found}
