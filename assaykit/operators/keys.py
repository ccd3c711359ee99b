"""Keys that are used and keys that are defined: orphans both ways, effective values, lookups of three outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def undefined_keys(uses: DataFrame, defined: DataFrame, key: str, place: str, shown: int = 3, within: str | None = None) -> DataFrame:
    """Keys of ``uses`` that ``defined`` lacks: key, n_uses, first_places. If nothing is defined, nothing can be said, and
    the result is empty. ``within`` names a column that both share, as a document: then all of this holds within each of its values. Counts
    are combined before they move, and places cut to the first ones, so no key's uses are gathered."""
    by = [within, key] if within else [key]
    missing = uses.join(defined.select(*by).distinct(), by, "left_anti")
    if within:
        missing = missing.join(defined.select(within).distinct(), within, "left_semi")
    else:
        missing = missing.join(F.broadcast(defined.limit(1).select(F.lit(1).alias("some_"))), how="left_semi")
    firsts = missing.withColumn("k_", F.row_number().over(Window.partitionBy(*by).orderBy(place))).filter(F.col("k_") <= shown)
    lists = firsts.groupBy(*by).agg(F.array_sort(F.collect_list(place)).alias("first_places"))
    return missing.groupBy(*by).agg(F.count("*").alias("n_uses")).join(lists, by)


def unused_entries(defined: DataFrame, uses: DataFrame, key: str, group: str, flag: Column, shown: int = 8, within: str | None = None, place: str | None = None) -> DataFrame:
    """Entries of ``defined`` nobody uses, one row for each group: n_unused, first_keys, all_flagged (whether ``flag`` holds for all), and
    first_place if ``place`` is given. ``within`` names a column that both share; then a use only counts within its value. The first
    keys come from a ranked prefix, so no group's keys are gathered."""
    by = [within, key] if within else [key]
    unused = defined.join(uses.select(*by).distinct(), by, "left_anti").withColumn("flag_", flag)
    ranked = unused.withColumn("k_", F.row_number().over(Window.partitionBy(group).orderBy(key))).filter(F.col("k_") <= shown)
    firsts = ranked.groupBy(group).agg(F.array_sort(F.collect_list(key)).alias("first_keys"))
    places = [F.min(place).alias("first_place")] if place else []
    counts = unused.groupBy(group).agg(F.count("*").alias("n_unused"), F.bool_and("flag_").alias("all_flagged"), *places)
    return counts.join(firsts, group)


def share_of(rows: DataFrame, group: str, flag: Column, least: float, name: str, shown: int = 5) -> DataFrame:
    """Groups in which ``flag`` holds for at least ``least`` of the rows: n, n_flagged, share, first_names (the first names among the
    flagged ones, from a ranked prefix of them)."""
    per = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(flag).alias("n_flagged")).withColumn("share", F.col("n_flagged") / F.col("n")).filter(F.col("share") >= least)
    names = rows.filter(flag).select(group, name).distinct().withColumn("k_", F.row_number().over(Window.partitionBy(group).orderBy(name))).filter(F.col("k_") <= shown)
    return per.join(names.groupBy(group).agg(F.array_sort(F.collect_list(name)).alias("first_names")), group, "left")


def single_literal(rows: DataFrame, group: str, value: str, varies: Column, most: int = 1) -> DataFrame:
    """Groups none of whose rows vary and that hold at most ``most`` distinct values: n_values, first_value, n."""
    per = rows.groupBy(group).agg(F.bool_or(varies).alias("varies_"), F.count_distinct(value).alias("n_values"), F.min(value).alias("first_value"), F.count("*").alias("n"))
    return per.filter(~F.coalesce("varies_", F.lit(False)) & (F.col("n_values") <= most)).drop("varies_")


def effective_values(rows: DataFrame, keys: list[str], strength: str, value: str) -> DataFrame:
    """The value at the greatest strength of each key; null where that level holds more than one value. Candidates at that level are
    counted. Two aggregations, both combined before they move: the strongest level, then its values."""
    by_level = rows.groupBy(*keys, strength).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"), F.count("*").alias("n_"))
    top = by_level.groupBy(*keys).agg(F.max_by(F.struct("lo_", "hi_", "n_"), strength).alias("t"), F.max(strength).alias("binding"), F.sum("n_").alias("n_candidates"))
    same = F.col("t.lo_") == F.col("t.hi_")
    return top.select(*keys, "binding", F.when(same, F.col("t.lo_")).alias("effective"), (~same).alias("conflict"), F.col("t.n_").alias("n_top"), "n_candidates")


def first_answer(asked: DataFrame, indexes: list[tuple[str, DataFrame, bool]], key: str, value: str) -> DataFrame:
    """Looks keys up in indexes in turn (name, table, reachable). found: the first index that has the key answers; not-found: all
    were reachable and none has it; unknown: none has it, but one couldn't be asked. Unknown is never absence."""
    out = asked
    for i, (_, table, reachable) in enumerate(indexes):
        own = table.groupBy(key).agg(F.min(value).alias(f"v{i}_")) if reachable else None
        out = out.join(own, key, "left") if own is not None else out.withColumn(f"v{i}_", F.lit(None).cast("string"))
    values = [F.col(f"v{i}_") for i in range(len(indexes))]
    source = F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for v, (n, *_) in zip(values, indexes)])
    status = F.when(source.isNotNull(), "found").when(F.lit(all(r for *_, r in indexes)), "not-found").otherwise("unknown")
    return out.withColumns({"status": status, "answered_by": source, "answer": F.coalesce(*values)}).drop(*[f"v{i}_" for i in range(len(indexes))])


def exactly_one_ladder(rows: DataFrame, facts: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Resolves a value for each of ``rows`` from ``facts`` along levels, the narrowest first: one fact at a level settles it, several
    make it abstain with their number, none goes on to the next level. Both tables have all level columns."""
    out = rows
    for i, level in enumerate(levels):
        own = facts.groupBy(level).agg(F.count("*").alias(f"c{i}_"), F.min(value).alias(f"v{i}_"))
        out = out.join(own, level, "left").fillna(0, [f"c{i}_"])
    settled, source, several = F.lit(None).cast(facts.schema[value].dataType), F.lit("none"), F.lit(0).cast("long")
    for i in reversed(range(len(levels))):
        c = F.col(f"c{i}_")
        settled = F.when(c == 1, F.col(f"v{i}_")).when(c == 0, settled)
        source = F.when(c == 1, F.lit(levels[i])).when(c > 1, F.lit("abstain")).otherwise(source)
        several = F.when(c > 1, c).when(c == 1, F.lit(0).cast("long")).otherwise(several)
    return out.withColumns({"resolved": settled, "resolved_at": source, "n_found": several}).drop(*[f"{k}{i}_" for i in range(len(levels)) for k in "cv"])
