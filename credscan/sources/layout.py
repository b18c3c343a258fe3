"""Input layout."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """A table just read, in enough partitions to occupy the cluster.

    Text scanning is CPU-bound and narrow, so it wants one partition per core at least. Only a
    table smaller than one read split per core is shuffled, which bounds the shuffle by
    (cores x spark.sql.files.maxPartitionBytes); a larger one is scanned where its splits are. The
    size is the optimizer's estimate for the files, so nothing runs. Results never depend on it.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = partitions or spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split else df
