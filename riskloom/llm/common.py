"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII blanks; `bytes.split()` splits at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its whole name, blanks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(name: str, columns: list[str]) -> str:
    """`name`, with underscores before it until no column of the table is called so."""
    taken = {x.lower() for x in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local temporary one is made only on a local master; a cluster has to name its own."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="riskloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows, as a table in the shared folder. Unlike a checkpoint, it carries nothing of the plan it came from, whose inferred constraints
    would double from round to round of a loop."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def in_training_folds(doc_id: Column) -> Column:
    """True for documents whose crc32 of the identifier's text, modulo 3, is not 1. A null identifier counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def hash64(data: bytes) -> int:
    """64 bits, as a signed integer; alike on every machine."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


try:  # glibc keeps freed pages of its heap until it is asked
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _trim = None


def give_back() -> None:
    """Returns freed memory to the system. Workers live on between tasks, and an executor's memory counts what they hold idle."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches, rows: int = 1000, size: int = 1 << 22, text: str = "_text"):
    """Arrow batches in parts of at most so many rows and bytes of text (one text, if it is longer), so that a task holds few whole texts as Python objects."""
    for batch in batches:
        give_back()  # what the batch before took
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lengths, dtype=np.int64), 0
        while at < batch.num_rows:
            within = int(np.searchsorted(ends, ends[at] - lengths[at] + size, "right"))
            stop = min(at + rows, max(at + 1, within))
            yield batch.slice(at, stop - at)
            at = stop
        del batch, lengths, ends
    give_back()


#: What a worker keeps from task to task, by operator.
_KEPT: list[dict] = []


def kept_by_worker() -> dict:
    """A dictionary that outlives tasks, as the worker does, until a task of another operator calls `release`."""
    _KEPT.append({})
    return _KEPT[-1]


def release() -> None:
    """Drops what other operators keep in this worker: workers are used again, stage after stage."""
    for kept in _KEPT:
        kept.clear()
    give_back()


class Remembered(dict):
    """Values of `compute(key)`, kept for later calls. Beyond `limit` keys, those not asked for since the last time go, and keys longer than
    `longest` are not kept, so the bytes held are bounded. A cache, never a cap on results."""

    def __init__(self, compute, limit: int = 300_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.before = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value
