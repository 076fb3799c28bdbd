"""Exact positions in a distributed sort, and rules that look at a row's neighbours in it.

A hot key spreads over many range partitions; what crosses their borders is one row for each
partition and key that meets in it.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "phonolake-checkpoints")


def fresh_path(spark: SparkSession) -> str:
    """A new place in the shared folder; all of a run's places are deleted when its driver ends."""
    base = f"{shared_folder(spark)}/phonolake/{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{base}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes the stored tables of this run; for long sessions, once the results that were read from them are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/phonolake/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: a lost executor costs nothing, lineage is cut."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_parts(df: DataFrame, keys: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """``df`` sorted over all partitions by ``keys`` and ``order``, with ``part`` and ``before``.

    ``before`` counts, within the partition, the rows (or their ``weight``) of the same keys
    that come earlier. Range partitioning samples the rows, so a hot key spreads over many
    partitions as long as ``order`` tells its rows apart. The result is stored, so that the
    two readings that follow see the same partitions.
    """
    names = [*keys, *order]
    ranged = df.repartitionByRange(*[F.col(f"`{c}`").asc_nulls_first() for c in names]).sortWithinPartitions(*[F.col(f"`{c}`").asc_nulls_first() for c in names])
    ranged = ranged.withColumn("part", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pandas as pd

        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            group = table.select(keys).to_pandas()
            own = np.ones(len(group), np.int64) if weight is None else table.column(weight).to_numpy().astype(np.int64)
            new = np.zeros(len(group), bool)
            for c in keys:
                x = group[c]
                new[1:] |= ~((x.values[1:] == x.values[:-1]) | (pd.isna(x.values[1:]) & pd.isna(x.values[:-1])))
            key = tuple(None if pd.isna(x) else x for x in group.iloc[0])
            total = np.cumsum(own) - own
            starts = np.flatnonzero(new)
            base = np.zeros(len(group), np.int64)
            if len(starts):
                base[starts] = np.diff(total[np.concatenate([[0], starts])])
                base = np.cumsum(base)
            before = total - base
            if key == last:
                end = starts[0] if len(starts) else len(group)
                before[:end] += carried
            last = tuple(None if pd.isna(x) else x for x in group.iloc[-1])
            carried = int(before[-1] + own[-1])
            yield from table.append_column("before", pa.array(before, pa.int64())).to_batches()

    schema = T.StructType([*ranged.schema.fields, T.StructField("before", T.LongType())])
    return stored(ranged.mapInArrow(count, schema))


def with_position(parts: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Adds ``position`` (rows of the keys before this one, over all partitions) and ``total``.

    The offsets are one row for each partition and key that meets in it: a hot key has a row
    for each of its partitions, a rare one a row; they are summed in a window over the parts
    of a key and joined back. No row of the data goes through that window.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(F.col(f"`{weight}`"))
    counts = parts.groupBy("part", *keys).agg(size.cast("bigint").alias("n"))
    own = Window.partitionBy(*keys)
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(f"`{c}`").alias(f"__{c}") for c in ["part", *keys]], F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__start"), F.sum("n").over(own).alias("total"))
    on = F.col("part") == F.col("__part")
    for c in keys:
        on &= F.col(f"`{c}`").eqNullSafe(F.col(f"`__{c}`"))
    return parts.join(offsets, on).select(*[F.col(f"`{c}`") for c in parts.columns], (F.col("before") + F.col("__start")).alias("position"), "total")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """Position of each row, from 0, among the rows of its keys (or of all, without keys) in an order that tells rows apart."""
    one = df if keys else df.withColumn("__all", F.lit(0))
    by = keys or ["__all"]
    done = with_position(sorted_parts(one, by, order), by)
    return done.select(*[F.col(f"`{c}`") for c in df.columns], F.col("position").alias(name))


def lagged(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """The value of the row before, by key; a join on key and position, so that a hot key is spread."""
    rows = stored(numbered(df, [key], order, "__at"))
    before = rows.select(F.col(f"`{key}`").alias("__k"), (F.col("__at") + 1).alias("__next"), F.col(f"`{value}`").alias(name))
    return rows.join(before, F.col(f"`{key}`").eqNullSafe(F.col("__k")) & (F.col("__at") == F.col("__next")), "left").drop("__at", "__k", "__next")


def runs(rows: DataFrame, key: str, gap: float) -> DataFrame:
    """key, start, end and n of the runs of intervals (key, s, e, n) that no distance longer than ``gap`` parts.

    The farthest end before a row comes from its own partition by a window, and from earlier
    partitions by a window over one row for each partition and key. Runs are summed by key and
    run number, so that a long run is added up where its parts lie.
    """
    parts = stored(rows.repartitionByRange(key, "s", "e").withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    reach = parts.groupBy("part", key).agg(F.max("e").alias("e")).select(F.col("part").alias("__p"), F.col(key).alias("__k"), F.max("e").over(earlier).alias("carried"))
    same = (F.col("part") == F.col("__p")) & F.col(key).eqNullSafe(F.col("__k"))
    own = Window.partitionBy("part", key).orderBy("s", "e")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    flagged = parts.join(reach, same).withColumn("far", F.greatest("carried", F.max("e").over(before)))
    flagged = flagged.withColumn("fresh", F.when(F.col("far").isNull() | (F.col("s") - F.col("far") > gap), 1).otherwise(0))
    flagged = flagged.withColumn("run", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = stored(flagged.groupBy("part", key, "run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n")))
    count = pieces.groupBy("part", key).agg(F.max("run").alias("m")).select(F.col("part").alias("__p"), F.col(key).alias("__k"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"))
    whole = pieces.join(count, same).groupBy(key, (F.col("run") + F.col("base")).alias("run"))
    return whole.agg(F.min("s").alias("start"), F.max("e").alias("end"), F.sum("n").alias("n")).select(key, "start", "end", "n")
