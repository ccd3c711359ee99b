"""An incremental sweep: new files are read once, texts seen before are passed over, results are appended.

The stream's checkpoint is what makes it resume: a run that was stopped goes on with the files it had not finished. A batch is
written under its own number, and a batch that runs again only heeds those with smaller numbers and replaces what it left, so nothing is counted
twice and nothing is lost. The digests of all texts seen stand in a table of their own, so texts without any result are known as well, and
results are never read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def new_texts(batch: DataFrame, seen: DataFrame | None, text: str) -> DataFrame:
    """Rows of the batch with a text whose digest neither ``seen`` nor an earlier row of this batch has; ``digest`` is added. Of equal texts
    the first row by all its columns stays. A null text is passed over."""
    cols = batch.columns
    marked = batch.filter(F.col(text).isNotNull()).withColumn("digest", F.sha2(F.col(text), 256))
    first = marked.groupBy("digest").agg(F.min(F.struct(*[c for c in cols if c != text])).alias("row_"), F.min(text).alias(text)).select("digest", text, "row_.*")
    return first if seen is None else first.join(seen, "digest", "left_anti")


def _before(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """What batches with smaller numbers have written under ``path``; null if none has."""
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/batch=*").filter(F.col("batch") < number)
    except Exception as e:  # the first batch finds nothing
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def write_batch(batch: DataFrame, number: int, out: str, check: Callable[[DataFrame], DataFrame] = lambda df: df, text: str = "text") -> None:
    """What a sweep does with one batch. It can be run again, after any later batch or a failure at any point, with the same result."""
    spark = batch.sparkSession
    seen = _before(spark, f"{out}/digests", number)
    fresh = new_texts(batch, None if seen is None else seen.select("digest"), text).persist()
    try:
        fresh.select("digest").write.mode("overwrite").parquet(f"{out}/digests/batch={number}")
        check(fresh).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
    finally:
        fresh.unpersist()


def sweep(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, check: Callable[[DataFrame], DataFrame] = lambda df: df, text: str = "text", fmt: str = "parquet") -> None:
    """Runs ``check`` over what is new under ``source`` since the last call, and appends its rows under ``out``."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    query = stream.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, out, check, text)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def results(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows/batch=*")


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of each kind in tumbling windows; rows later than ``late`` are left out, and so is state older than that. For streams and tables alike."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
