"""Corpus reports: error rates by group, grids with empty cells, pivots, deltas, ranks, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonolake.functions import align
from phonolake.operators.ranks import numbered


def scored(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Adds the counts of errors and lengths once; rates and sums both come from them. Rows without a reference are dropped."""
    from phonolake.functions import text as tx

    rows = pairs.filter(F.col(reference).isNotNull())
    return rows.withColumn("counts", align.counts(tx.normalize(F.col(reference)), tx.normalize(F.col(hypothesis))))


def corpus_rates(rows: DataFrame, *by: str, rtf: str | None = None, memory: str | None = None) -> DataFrame:
    """Sum of errors by sum of lengths (not a mean of rates), null where nothing is to be said; mean RTF and highest memory."""
    c = lambda f: F.sum(F.col(f"counts.{f}"))
    over = lambda a, b: (c(a).cast("double") / F.nullif(c(b), F.lit(0)))
    more = [F.avg(rtf).alias("mean_rtf")] if rtf else []
    more += [F.max(memory).alias("max_peak_process_memory_mb")] if memory else []
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), over("word_errors", "reference_words").alias("wer"), over("character_errors", "reference_characters").alias("cer"),
        c("reference_words").alias("reference_words"), c("reference_characters").alias("reference_characters"), *more,
    )


def grid(left: DataFrame, right: DataFrame, facts: DataFrame, on: list[str], value: Column) -> DataFrame:
    """Every pair of two small dimensions with the count of facts and a sum, zero where there are none."""
    cells = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), value)
    name = cells.columns[-1]
    return left.crossJoin(right).join(cells, on, "left").fillna(0, ["n", name])


def pivot_first(df: DataFrame, index: str, columns: str, names: list[str], values: list[str]) -> DataFrame:
    """One row for each index, a column for each name and value. A cell with several rows takes their smallest, so that the result is one."""
    return df.groupBy(index).pivot(columns, names).agg(*[F.min(v).alias(v) for v in values])


def delta(df: DataFrame, key: str, value: str, baseline: str) -> DataFrame:
    """Difference to the baseline's value, in percentage points. One aggregated row for each key."""
    base = df.filter(F.col(key) == baseline).select(F.col(value).alias("baseline"))
    return df.crossJoin(base).withColumn("delta_pp", (F.col(value) - F.col("baseline")) * 100)


def with_index(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """Row number from 0 over the whole table in an order that tells the rows apart; no task sees all rows."""
    return numbered(df, [], list(order), name)


def batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Batch number of each row in an order."""
    return with_index(df, *order).withColumn("batch_id", F.floor(F.col("idx") / size).cast("bigint"))


def attributed(df: DataFrame, elapsed: str, batch: str = "batch_id") -> DataFrame:
    """A batch's time shared by its members."""
    return df.withColumn("share", F.col(elapsed) / F.count(F.lit(1)).over(Window.partitionBy(batch)))


def shown(value: Column, digits: int = 4) -> Column:
    """A number for the console, half up; N/A for none, nan for one that isn't a number."""
    return F.when(F.isnan(value.cast("double")), "nan").when(value.isNotNull(), F.format_string(f"%.{digits}f", F.floor(value * 10**digits + 0.5) / 10**digits)).otherwise("N/A")
