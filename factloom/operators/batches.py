"""Tables that grow by batches, each of which may be written again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.ranking import first_per


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Put a batch into the table at ``path``, in place of what an earlier attempt at
    the same batch has left; other batches stay."""
    rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def append_evidence(evidence: DataFrame, path: str, batch_id: int, as_of: Column) -> None:
    """Evidence is only ever added, with the time it was checked at."""
    write_batch(evidence.withColumn("checked_at", as_of), path, batch_id)


def stream_batches(stream: DataFrame, path: str, checkpoint: str, as_of: Callable[[int], Column]) -> StreamingQuery:
    """The same for a stream, one batch for each of its own: a batch that Spark repeats
    after a failure takes the place of its first attempt. Ends when all there is is read."""
    write = lambda rows, batch_id: append_evidence(rows, path, batch_id, as_of(batch_id))
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(batches: DataFrame, keys: list[str]) -> DataFrame:
    """The table as upserts leave it: of each key the row of the last batch."""
    return first_per(batches, keys, [F.desc("batch_id")])


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches at ``path``, none if nothing was written yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], f"{schema}, batch_id long")
    return spark.read.schema(f"{schema}, batch_id long").parquet(path)


def missing(entries: DataFrame, cached: DataFrame, key: str = "entity_id") -> DataFrame:
    """Entries that the cache has no row of."""
    return entries.join(cached.select(key), key, "left_anti")


def run_missing(entries: DataFrame, path: str, schema: str, batch_id: int, compute: Callable[[DataFrame], DataFrame], key: str = "entity_id") -> int:
    """Compute and store the rows of the entries that no other batch has, and return how
    many there are; where there are none nothing is written."""
    cached = read_batches(entries.sparkSession, path, schema).where(F.col("batch_id") != batch_id)
    open_ = missing(entries, cached, key)
    n = open_.count()
    if n:
        write_batch(compute(open_), path, batch_id)
    return n


def calibration_status(entries: DataFrame, rows: DataFrame, expectations: DataFrame, key: str = "entity_id") -> DataFrame:
    """Every entry of a calibration set with what there is for it: its row (``row``),
    the fields expected of it (``expected``) and a status: missing, ready or unchecked."""
    joined = entries.join(rows, key, "left").join(expectations, key, "left")
    status = F.when(F.col("row").isNull(), "missing").when(F.col("expected").isNull(), "unchecked").otherwise("ready")
    return joined.withColumn("status", status)
