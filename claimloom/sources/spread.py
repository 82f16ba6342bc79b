"""Even out scans that have fewer files than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` as it is, or dealt out evenly if it is small and lies in fewer files than there are cores.

    A file with one row group is read by one task, however many byte ranges it is split into. At scale scans have far
    more ranges than cores; then nothing is moved, and no list of files is made.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > 4 * cores or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)
