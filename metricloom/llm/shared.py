"""Helpers shared by the training-data operators: scratch tables and common expressions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of the six ASCII white-space characters, for Java regular expressions and for DuckDB.
WHITESPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Spark removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_OWN_FOLDERS: list[str] = []
#: Lists that collect the scratch folders opened while they are on the stack.
_OPENED: ContextVar[tuple[list, ...]] = ContextVar("opened", default=())
_CLEANUP_LOCK, _CLEANING = threading.Lock(), Counter()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, as in tests, it is set to a private folder; only a local master may do so.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_FOLDERS:
        _OWN_FOLDERS.append(tempfile.mkdtemp(prefix="llm-scratch-"))
        atexit.register(shutil.rmtree, _OWN_FOLDERS[0], ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", "file://" + _OWN_FOLDERS[0])
    return "file://" + _OWN_FOLDERS[0]


@contextmanager
def shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside remove their shuffle files when they end; nested and concurrent uses in one session share the setting."""
    key = spark._jsparkSession.sessionUUID()
    with _CLEANUP_LOCK:
        _CLEANING[key] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _CLEANUP_LOCK:
            _CLEANING[key] -= 1
            if not _CLEANING[key]:
                spark.conf.unset(CLEANUP)


@contextmanager
def opened_scratch() -> Iterator[list[Scratch]]:
    """Collects the scratch folders that operators open inside, for a caller who writes their results and then closes them."""
    made: list[Scratch] = []
    token = _OPENED.set((*_OPENED.get(), made))
    try:
        yield made
    finally:
        _OPENED.reset(token)


class Scratch:
    """Intermediate Parquet tables in the shared folder: they cut lineage and survive lost executors.

    An operator's result may still read some of them; who has written the result closes them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        for made in _OPENED.get():
            made.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        with shuffle_files_removed(self.spark):  # the table replaces the shuffle files that it was made from
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(conf).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that later tables no longer need."""
        for table in tables:
            self._delete(table._scratch_path)

    def close(self) -> None:
        """Deletes all of its tables."""
        self._delete(self.base)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Rows that a slice of a table in hash order should hold, and the hexadecimal digits of the hash that tell slices apart: 4,096 to 1,048,576 slices.
SLICE_ROWS, SLICE_DIGITS = 250_000, (3, 5)


def slice_digits(rows: int) -> int:
    least, most = SLICE_DIGITS
    return next((d for d in range(least, most) if 16**d * SLICE_ROWS >= rows), most)


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
