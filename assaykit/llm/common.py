"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaykit.operators.scale import buckets_for, discard, fresh, lookup, ranked, running_total, unit_hash, written
from assaykit.sources.shared import scratch

__all__ = ["buckets_for", "discard", "fresh", "lookup", "ranked", "read_table", "running_total", "scratch", "unit_hash", "written"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
