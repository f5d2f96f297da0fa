"""Reproducible global shuffle and sharding by a Feistel permutation.

Every row gets a dense global number, a keyed Feistel permutation with cycle
walking maps that number to another one below the row count, and shard and slot
are its remainder and quotient by the shard count. So any row's place can be
computed from its number alone, shard sizes differ by one row at most and slots
have no gaps. DataFrame functions only.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialize, text_crc32

SHARDS = 40
ROUNDS = 6
SEED = 20240607
#: Number of buckets of the global numbering; also the row bound of what the
#: driver sees (one count per bucket).
BUCKETS = 4096
#: Copies of one row that are expanded at a time.
CHUNK = 100_000


def feistel_sides(n: int, tries: int = 4096) -> tuple[int, int]:
    """Sides (a, b) of a grid with n cells at least and few to spare.

    The cells beyond n are the ones that cycle walking has to leave, so the
    smaller their number, the shorter the longest walk.
    """
    n = max(n, 1)
    root = isqrt(n - 1) + 1
    return min(((a, -(-n // a)) for a in range(root, root + tries)), key=lambda s: (s[0] * s[1] - n, s[0]))


def feistel(x: Column, a: int, b: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0 .. a*b-1 as a column expression."""
    left, right = F.call_function("div", x, F.lit(b)), F.pmod(x, F.lit(b))
    for i in range(rounds):
        if i % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(i), F.lit(seed)), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(i), F.lit(seed)), F.lit(b)), F.lit(b))
    return left * F.lit(b) + right


def permute(x: Column, n: int, seed: int = SEED, sides: tuple[int, int] | None = None) -> Column:
    """A keyed permutation of 0 .. n-1: ``feistel`` walked along its cycle until
    the number is below n. At most a*b-n cells lie outside, so as many more
    steps always suffice and the walk is exact."""
    a, b = sides or feistel_sides(n)
    once, spare = feistel(x, a, b, seed), a * b - n
    if not spare:
        return once
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(spare)),
        once,
        lambda at, _: F.when(at < n, at).otherwise(feistel(at, a, b, seed)),
    )
    return F.when(once < n, once).otherwise(walk)


def assign_shards(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Shard and slot of every row under the law ``rows``.

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law,
    shard, slot (gapless from 0 in each shard), grown_shard (null: only the law
    ``key`` has one) and row_number (the global number before the shuffle).

    Rows are numbered by (hash bucket, id, checksum, size). Rows equal in all of
    these are interchangeable: they get consecutive numbers, and which copy has
    which cannot be told from the output. A null id or text is a value like any
    other (size 16, checksum 0). An empty table gives an empty result. Other
    columns are not read, so clashing names do no harm.
    """
    spark = df.sparkSession
    text = F.col(text_col)
    narrow = materialize(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text).cast("long"), F.lit(0)) + 16).alias("size"),
            text_crc32(text).alias("text_crc32"),
        ).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets))),
        "shard-rows",
    )
    counts = {r["bucket"]: r["n"] for r in narrow.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, starts = 0, []
    for bucket in sorted(counts):
        starts.append((bucket, first))
        first += counts[bucket]
    offsets = spark.createDataFrame(starts, "bucket long, first long")

    order = Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size")
    upto = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kinds = (
        narrow.groupBy("bucket", "doc_id", "text_crc32", "size")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("before", upto - F.col("copies"))
        .join(F.broadcast(offsets), "bucket")
    )
    at = F.col("first") + F.col("before")
    numbered = (
        kinds.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long"))))
        .withColumn("copy", F.explode(F.sequence(F.col("chunk"), F.least(F.col("chunk") + (CHUNK - 1), F.col("copies") - 1))))
        .select("doc_id", "size", "text_crc32", (at + F.col("copy")).alias("row_number"))
    )
    place = permute(F.col("row_number"), max(first, 1), seed)
    return numbered.withColumn("place", place).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), F.lit(shards)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
