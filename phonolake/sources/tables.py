"""Tables for work that is heavy a row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """A scan in at least as many partitions as there are cores.

    A large table has more splits than the cluster has cores and is left as it is; only one of
    few splits (a file of one row group) is dealt out, which moves no more than those few. For
    scans and unions of scans: their partitions are known without a job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores else scan.repartition(cores)
