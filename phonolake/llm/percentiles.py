"""Exact percentiles of large numeric columns by group, also from the parts of separate days.

Method: equal values are counted first (map-side), the counted values are sorted over all
partitions, per-partition counts give each group's offsets, the target positions are located
in the partitions that hold them, and neighbouring order statistics are interpolated.

A state is what a day or a partition contributes: its values with their counts. States are
added by adding counts, so percentiles of any set of days are those of their rows, exactly.

Defined results: nulls and not-a-number are left out, a null group is a group, infinities
are values, a group without values has no row; with ties the tied value; an empty table gives
an empty result. The percentile p lies at p * (n - 1), as in ``percentile`` and ``quantile_cont``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.operators.ranks import sorted_parts, with_position

POINTS = (0.5, 0.9, 0.95, 0.99)


def states(df: DataFrame, group: str, metrics: list[str], day: str | None = None) -> DataFrame:
    """metric, group, (day,) value and how often it is stored."""
    by = [F.col(f"`{group}`").alias("grp")] + ([F.to_date(F.col(f"`{day}`")).alias("day")] if day else [])
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in metrics])).alias("x"))
    long = long.select("x.metric", "grp", *(["day"] if day else []), F.col("x.value").alias("value"))
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("metric", "grp", *(["day"] if day else []), "value").agg(F.count(F.lit(1)).alias("n"))


def combine(parts: DataFrame) -> DataFrame:
    """The sum of states of several days."""
    return parts.groupBy("metric", "grp", "value").agg(F.sum("n").alias("n"))


def percentiles(counted: DataFrame, points: tuple[float, ...] = POINTS, group: str = "grp") -> DataFrame:
    """metric, group, percentile, value and n from one state for each metric and group."""
    ranked = with_position(sorted_parts(counted.select("metric", "grp", "value", "n"), ["metric", "grp"], ["value"], "n"), ["metric", "grp"], "n")
    wanted = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), (F.lit(float(p)) * (F.col("total") - 1)).alias("at")) for p in points]))
    near = ranked.select("metric", "grp", "value", "n", "total", "position", wanted.alias("t")).select("metric", "grp", "value", "n", "total", "position", "t.p", "t.at")
    near = near.withColumn("low", F.floor("at")).withColumn("high", F.least(F.floor("at") + 1, F.col("total") - 1))
    last = F.col("position") + F.col("n") - 1
    holds = lambda c: (F.col(c) >= F.col("position")) & (F.col(c) <= last)
    near = near.filter(holds("low") | holds("high"))
    out = near.groupBy("metric", "grp", "p").agg(
        F.max(F.when(holds("low"), F.col("value"))).alias("below"), F.max(F.when(holds("high"), F.col("value"))).alias("above"), F.max(F.col("at") - F.col("low")).alias("share"), F.max("total").alias("n")
    )
    value = F.when((F.col("share") == 0) | (F.col("below") == F.col("above")), F.col("below")).otherwise(F.col("below") + (F.col("above") - F.col("below")) * F.col("share"))
    return out.select("metric", F.col("grp").alias(group), F.col("p").alias("percentile"), value.alias("value"), F.col("n").cast("bigint").alias("n"))
