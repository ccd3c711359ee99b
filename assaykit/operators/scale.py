"""What keeps operators even at any size: tables written once and read again, ranks without a global sort or a task that
holds a whole group, and lookups that survive hot keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaykit.sources.shared import remove, scratch

#: A lookup table may be broadcast up to this many rows; see ``lookup``.
HOT_KEYS = 4000


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again. Later plans start from
    files that outlive any executor, and nothing upstream runs twice."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what ``written`` wrote, once no plan that is still to run reads it."""
    remove(df.sparkSession, df._written_to)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, for columns added beside those of any table."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def unit_hash(*cols: Column) -> Column:
    """A uniform double in [0, 1) from XXH64 of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def buckets_for(n_rows: int) -> int:
    """Buckets by which ``ranked`` deals out n_rows: of about 256 rows, and of
    sqrt(n_rows) rows once that is more, so neither buckets nor their table grow past the root."""
    return max(1, math.ceil(n_rows / max(256.0, math.sqrt(n_rows))))


def ranked(df: DataFrame, group: str, bucket: str, order: list[str], out: str = "rank_", total: str = "total_") -> DataFrame:
    """Adds the 0-based rank of each row within ``group`` by (bucket, order), and the group's size.

    ``bucket`` must not decrease along ``order``'s meaning: all of bucket b ranks before b + 1.
    No task holds a group: rows are dealt by (group, bucket), and only one count for each
    (group, bucket) is summed along the group. ``bucket`` must not be null."""
    within = Window.partitionBy(group, bucket).orderBy(*order)
    counts = df.groupBy(group, bucket).agg(F.count("*").alias("n_"))
    along = Window.partitionBy(group).orderBy(bucket)
    offsets = counts.select(
        F.col(group).alias("g_"),
        F.col(bucket).alias("b_"),
        (F.sum("n_").over(along) - F.col("n_")).alias("before_"),
        F.sum("n_").over(Window.partitionBy(group)).alias(total),
    )
    local = df.withColumn("rn_", F.row_number().over(within))
    joined = local.join(offsets, F.col(group).eqNullSafe(F.col("g_")) & (F.col(bucket) == F.col("b_")))
    return joined.withColumn(out, F.col("before_") + F.col("rn_") - 1).drop("g_", "b_", "before_", "rn_")


def lookup(left: DataFrame, key: str, table: DataFrame, value: str, count: str, n_rows: int, spread: Column) -> DataFrame:
    """Left join of ``table``'s ``value`` by ``key``, however often one key occurs in ``left``.

    ``table`` has one row for each key with ``count``, how often it occurs in ``left`` of n_rows
    rows. Keys of more than n_rows / HOT_KEYS rows are at most HOT_KEYS, so those are broadcast;
    the rows they settle are dealt over all tasks by ``spread``. The other keys are joined by a
    shuffle in which none has more rows than that."""
    limit = max(64, n_rows // HOT_KEYS)
    hot = table.filter(F.col(count) > limit).select(F.col(key).alias("hot_key_"), F.col(value).alias("hot_value_"))
    rest = table.filter(F.col(count) <= limit).select(F.col(key).alias("rest_key_"), F.col(value).alias("rest_value_"), F.lit(0).alias("rest_salt_"))
    first = left.join(F.broadcast(hot), F.col(key) == F.col("hot_key_"), "left")
    salted = first.withColumn("salt_", F.when(F.col("hot_key_").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int") + 1))
    both = salted.join(rest, (F.col(key) == F.col("rest_key_")) & (F.col("salt_") == F.col("rest_salt_")), "left")
    return both.withColumn(value, F.coalesce("hot_value_", "rest_value_")).drop("hot_key_", "hot_value_", "salt_", "rest_key_", "rest_value_", "rest_salt_")


def running_total(df: DataFrame, key: str, value: str, out: str, most: int = 4096) -> DataFrame:
    """Adds the sum of ``value`` over all rows with a smaller ``key`` (distinct longs from 0 on). Blocks of ``most`` keys are summed each by itself,
    and only one sum for each block is added up in one task."""
    blocks = df.withColumn("block_", F.floor(F.col(key) / most))
    along = Window.partitionBy("block_").orderBy(key)
    sums = blocks.groupBy("block_").agg(F.sum(value).alias("sum_"))
    before = sums.select("block_", (F.sum("sum_").over(Window.orderBy("block_")) - F.col("sum_")).alias("before_"))
    inside = blocks.withColumn("inside_", F.sum(value).over(along) - F.col(value))
    return inside.join(before, "block_").withColumn(out, F.col("before_") + F.col("inside_")).drop("block_", "inside_", "before_")


def by_range(df: DataFrame, order: list[str], out: str, name: str) -> DataFrame:
    """``df`` written out with a bucket number that rises along ``order``: the range of sampled bounds that a row falls in. Rows equal in
    ``order`` share a bucket."""
    n = buckets_for(df.count())
    return written(df.repartitionByRange(n, *order).withColumn(out, F.spark_partition_id().cast("long")), name)
