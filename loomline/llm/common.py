"""Shared pieces of the training-data operators: the shared folder, materialised tables, a worker's memory, slicing."""

from __future__ import annotations

import ctypes
import functools
import uuid
import weakref
from collections.abc import Callable, Hashable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of the six ASCII white-space characters; what lies between them is a word.
SPACE = r"[\x20\x09-\x0D]+"


_LOCAL_DIR = "file:///tmp/checkpoints/loomline"
#: The folder of each materialised table at hand, and all folders made and not yet deleted.
_folder_of: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. In local mode (tests) a local one is set where it is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = _LOCAL_DIR
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _made.add(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends here and no executor's loss undoes it."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folder_of[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    _made.discard(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of materialised tables of which nothing is read any more: what was made of them is written."""
    for t in tables:
        if path := _folder_of.pop(t, None):
            _delete(t.sparkSession, path)


def renamed(table: DataFrame, names: dict[str, str]) -> DataFrame:
    """A materialised table with columns renamed; discard() takes the result."""
    out = table.withColumnsRenamed(names)
    if path := _folder_of.get(table):
        _folder_of[out] = path
    return out


def clean_shared_dir(spark: SparkSession) -> None:
    """Deletes every folder that this driver's operators made and have not deleted; for when their results have been used."""
    for path in sorted(_made):
        _delete(spark, path)


_resident: tuple[Hashable, object] = (None, None)


def resident(key: Hashable, build: Callable[[], object]) -> object:
    """What build() makes, kept in this worker until another key is asked for: of tables that outlive a task, a worker holds one operator's."""
    global _resident
    if _resident[0] != key:
        _resident = (None, None)
        release()
        _resident = (key, build())
        release()
    return _resident[1]


def release() -> None:
    """Gives freed memory back to the system: Arrow's pool and the C library keep it else."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with release() when its task ends: workers are used again by later stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Rows of an Arrow batch that the Python stages take at most; with Spark's own bound in bytes, it bounds a worker's memory.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows where they are larger. The setting stays: Spark reads it when the lazy result is run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def word_count(text: Column) -> Column:
    """Number of maximal runs of other than ASCII white space; null counts as 0."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    empty = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - empty).cast("long")


def slices(texts: Sequence[str | None], budget: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of texts of about budget characters each, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
