"""What the operators share: reading tables, scratch tables in the shared folder, byte helpers."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as every contract here has them.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
#: Where nothing is set, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tapeloom"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = f"file://{LOCAL_CHECKPOINTS}"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables and files of one operator run, in the shared folder; every table is readable by all executors."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        if self.root.startswith(f"file://{LOCAL_CHECKPOINTS}/"):
            atexit.register(shutil.rmtree, self.root.removeprefix("file://"), ignore_errors=True)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it again: this cuts its lineage, so that a lost executor costs no earlier stage."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark drop the shuffle files of stages whose results are in tables already."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Small rows for a task of a step over few of them.
TASK_ROWS, LEAST_TASKS = 1 << 16, 8


def in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df, of so many small rows about, in as many tasks as these need, however many shuffle partitions there are: a task
    reads several of them. Never in more tasks than there are partitions."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def crc_fold(column: str | Column, folds: int) -> Column:
    """crc32 of a key written as text, modulo folds; null keys count as the empty string."""
    key = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
LOWER_TABLE = bytes.maketrans(_UPPER, _LOWER)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Record batches cut small, so that a task's memory doesn't follow Spark's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def list_array(values: np.ndarray, lengths) -> pa.ListArray:
    """An Arrow list column from its flat values and the rows' lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer (public-domain splitmix64 finaliser) over an uint64 array."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Memo:
    """Results by key in two generations of at most size keys: what is used again survives, memory stays bounded."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def rotate(self) -> dict:
        """Starts a new generation where the young one is full, and returns the young one."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        return self.young

    def of(self, keys: set, make) -> dict:
        """A mapping that has all of keys; make(list of keys) gives the results of those not known."""
        young, old = self.young, self.old
        again = old.keys() & keys if old else ()
        young.update({key: old[key] for key in again})
        missing = [key for key in keys if key not in young]
        if missing:
            young.update(zip(missing, make(missing), strict=True))
        return young
