"""Texts of overlapping chunks put together again.

A chunk loses the longest run of words, up to a limit, that ends what came before and begins
it. ``merge`` joins two texts; ``fold`` all chunks of a file in order, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.functions.align import let

LIMIT = 12


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda w: w != "")


def overlap(a: Column, b: Column, limit: int = LIMIT) -> Column:
    """Length of the longest run of words that ends a and begins b."""
    most = F.least(F.lit(limit), F.size(a), F.size(b))
    fits = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda n: (n <= most) & (F.slice(a, -n, n) == F.slice(b, F.lit(1), n)))
    return F.coalesce(F.array_max(fits), F.lit(0))


def merge_words(a: Column, b: Column, limit: int = LIMIT) -> Column:
    n = overlap(a, b, limit)
    return F.when(F.size(a) == 0, b).when(a == b, a).otherwise(F.concat(a, F.slice(b, n + 1, F.size(b))))


def merge(previous: Column, current: Column, limit: int = LIMIT) -> Column:
    """Two texts; an empty or equal one changes nothing; null counts as empty."""
    def body(s: Column) -> Column:
        p, c, a, b = s["p"], s["c"], s["a"], s["b"]
        join = let(overlap(a, b, limit), lambda n: F.when(n == F.size(b), p).otherwise(F.array_join(F.concat(a, F.slice(b, n + 1, F.size(b))), " ")))
        return F.when(p == "", c).when((c == "") | (p == c), p).otherwise(join)

    both = F.struct(F.trim(F.coalesce(previous, F.lit(""))).alias("p"), F.trim(F.coalesce(current, F.lit(""))).alias("c"))
    return let(let(both, lambda s: F.struct(s["p"], s["c"], words(s["p"]).alias("a"), words(s["c"]).alias("b"))), body)


def fold(chunks: DataFrame, file: str, order: str, text: str, limit: int = LIMIT) -> DataFrame:
    """One text for each file. The chunks of a file are one recording's, so a group is as long as a recording."""
    listed = chunks.groupBy(file).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("parts"))
    merged = F.aggregate(F.transform("parts", lambda x: x["t"]), F.lit(""), lambda acc, t: merge(acc, t, limit))
    return listed.select(file, merged.alias("text"), F.size("parts").cast("bigint").alias("n_chunks"))
