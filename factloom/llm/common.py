"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    A local session that names none, as in tests, gets a folder of this process,
    which is deleted at its end; a session on a cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


def written(spark: SparkSession) -> list[str]:
    """The folders that the operators of this application have written and not deleted."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and
    a lost executor costs a re-read rather than a recomputation."""
    path = new_path(df.sparkSession, label)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that no plan reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    known = _written.get(spark.sparkContext.applicationId, [])
    if path in known:
        known.remove(path)


def clear_intermediates(spark: SparkSession) -> int:
    """Delete all that the operators of this application have written to the shared
    folder and return the number of folders. Results that were not yet read or
    stored elsewhere are lost with them."""
    paths = written(spark)
    for path in paths:
        remove(spark, path)
    return len(paths)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called like it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is hot from this many rows on, and if its rows are one of so many parts of all.
HOT_ROWS, HOT_KEYS = 1000, 100_000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``left`` with the unique ``keys`` of ``right``, whose column
    ``count`` tells how many rows of ``left`` have each key.

    Keys of more than ``total / HOT_KEYS`` rows (and HOT_ROWS) are broadcast, which
    are HOT_KEYS at most whatever the size, so their rows stay where they are; the
    rows of no other key are more than that share in one task. Both sides should
    be tables, as they are read twice if there is a hot key.
    """
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot = right.where(F.col(count) > bound).drop(count)
    if not hot.take(1):
        return left.join(right.drop(count), keys)
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(count) <= bound).drop(count), keys)
    return left.join(F.broadcast(hot), keys).unionByName(cold)


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null text has no bytes."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def gives_back(run: Callable) -> Callable:
    """``run``, a function for ``mapInArrow``, that returns freed memory to the system
    after each batch and at its end. Spark keeps Python workers for later tasks; what
    they have freed but still hold counts against their executor all that time."""

    @wraps(run)
    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                _give_back()

        yield from run(fed())
        _give_back()

    return frugal


#: Spark's setting for the bytes of a batch of rows that goes to Python, and what suits whole texts.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Set the session's batches to BATCH_BYTES, for an application that runs several of
    the text operators on executors with little memory: by Spark's default of 64 MB both
    sides of a worker hold that much, and copies of it. A session that has named a
    size of its own keeps it. No operator calls this; the pipeline does."""
    if spark.conf.get(BATCH_SETTING) == "67108864b":
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def text_parts(batch: pa.RecordBatch, text_name: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most_bytes`` of text each, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_name))), 0))
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop
