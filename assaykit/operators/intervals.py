"""Points in intervals, neighbours within a band, nearest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaykit.functions.exact import relative_gap


def running_starts(pieces: DataFrame, group: str, order: str, length: str) -> DataFrame:
    """Adds ``start``: the lengths of all pieces of the group before this one."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)))


def next_start(heads: DataFrame, group: str, start: str, end: Column) -> DataFrame:
    """Adds ``stop``: where the group's next head starts, or ``end`` for the last."""
    return heads.withColumn("stop", F.coalesce(F.lead(start).over(Window.partitionBy(group).orderBy(start)), end))


def points_inside(points: DataFrame, intervals: DataFrame, group: list[str], at: str, start: str, stop: str, width: int) -> DataFrame:
    """Every point with every interval of its group that holds it: start <= at < stop. Positions (numbers) are cut into bands of ``width``;
    an interval stands in each band that it reaches into, and a point meets the intervals of its own band only, by equality. A width of about
    an interval's length keeps both small."""
    a = points.withColumn("band_", F.floor(F.col(at) / width))
    b = intervals.filter(F.col(start) < F.col(stop)).withColumn("band_", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))
    return a.join(b, [*group, "band_"]).filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col(stop))).drop("band_")


def point_in_interval(points: DataFrame, intervals: DataFrame, group: list[str], at: str, start: str, stop: str, name: str, width: int) -> DataFrame:
    """Adds to each point the first interval (by start, then name) of its group that holds it; null if none does. Repeated points stay
    as many as they are."""
    spots = points.select(*group, at).distinct()
    first = points_inside(spots, intervals.select(*group, start, stop, name), group, at, start, stop, width).groupBy(*group, at).agg(F.min(F.struct(start, name)).alias("i_"))
    return points.join(first, [*group, at], "left").withColumn(name, F.col(f"i_.{name}")).drop("i_")


def band_semi_join(left: DataFrame, right: DataFrame, group: str, at: str, width: int) -> DataFrame:
    """Rows of ``left``, repeated ones as well, with a row of ``right`` in the same group within ``width``. Positions are cut into bands of that
    width, and a row of ``right`` stands in its own band and its neighbours, so rows meet by equality."""
    a = left.withColumn("band_", F.floor(F.col(at) / width))
    b = right.select(F.col(group).alias("g_"), F.col(at).alias("at_"), F.explode(F.array(*[F.floor(F.col(at) / width) + d for d in (-1, 0, 1)])).alias("b_")).distinct()
    same = (F.col(group) == F.col("g_")) & (F.col("band_") == F.col("b_")) & (F.abs(F.col(at) - F.col("at_")) <= width)
    return a.join(b, same, "left_semi").drop("band_")


def near_misses(stated: DataFrame, cells: DataFrame, key: list[str], value: str, cell: str, near: float = 0.02, most: int = 12, place: str | None = None) -> DataFrame:
    """Stated values that equal none of their key's cells but are within ``near`` of the nearest: a claim left behind by a revision.
    Keys of more than ``most`` distinct cells are lookup tables and say nothing. Cells are made distinct before they move. With ``place``,
    nearest_place is the first place of the nearest cell."""
    own = cells.filter(F.col(cell).isNotNull()).groupBy(*key, cell).agg(F.min(place if place else F.lit(0)).alias("place_"))
    few = own.groupBy(*key).agg(F.count("*").alias("n_")).filter(F.col("n_") <= most).drop("n_")
    kept = own.join(few, key, "left_semi").groupBy(*key).agg(F.collect_list(F.struct(F.col(cell).alias("c"), F.col("place_").alias("p"))).alias("cells_"))
    both = stated.join(kept, key).filter(~F.exists("cells_", lambda c: c["c"] == F.col(value)))
    nearest = F.array_min(F.transform("cells_", lambda c: F.struct(F.abs(c["c"] - F.col(value)).alias("d"), c["c"].alias("c"), c["p"].alias("p"))))
    out = both.withColumn("nearest_", nearest).withColumns({"nearest": F.col("nearest_.c"), "gap": relative_gap(F.col(value), F.col("nearest_.c"))})
    out = out.withColumn("nearest_place", F.col("nearest_.p")) if place else out
    return out.filter((F.col("gap") > 0) & (F.col("gap") <= near)).drop("cells_", "nearest_")
