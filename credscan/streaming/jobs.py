"""Scanning what arrives: the batch scan on a stream, first exposures, counts."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credscan.sources.store import exists, is_file, numbered, remove


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Rows of Parquet as they arrive at ``path``: a file, a folder of part files, or a pattern."""
    if is_file(spark, path):  # a stream lists folders and patterns: one that only this name matches
        path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _drained(stream, target: str) -> None:
    """Run a writer over everything available."""
    stream.option("checkpointLocation", os.path.join(target, "checkpoint")).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, target: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available, into Parquet; read that back."""
    data = os.path.join(target, "data")
    _drained(stream.writeStream.format("parquet").outputMode(mode).option("path", data), target)
    return _read(stream.sparkSession, [data], stream.schema)


def _read(spark: SparkSession, folders: list[str], schema: T.StructType) -> DataFrame:
    """Rows of those of ``folders`` that exist; a source without rows has written none."""
    found = [f for f in folders if exists(spark, f)]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


#: Micro-batches whose changes are merged into one folder.
MERGED = 20


def drain_latest(stream: DataFrame, target: str, keys: Sequence[str]) -> DataFrame:
    """Run an aggregation over everything available and read back each key's last value.

    Every micro-batch writes the keys it changed to a folder of its own number, so a batch that is
    run again replaces its own files. After every ``MERGED`` batches all so far are merged into one
    folder with a row per key, and those before are removed.
    """
    spark, data = stream.sparkSession, os.path.join(target, "data")
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    rest = [c for c in stream.columns if c not in keys]

    def latest() -> DataFrame:
        whole = numbered(spark, data, "upto")[-1:]
        single = [n for n in numbered(spark, data, "changed") if n > max(whole, default=-1)]
        folders = [os.path.join(data, f"upto={n}") for n in whole] + [os.path.join(data, f"changed={n}") for n in single]
        rows = _read(spark, folders, schema)
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest, "_batch"), "_batch").alias("last")).select(*keys, "last.*")

    def write(changed: DataFrame, batch: int) -> None:
        changed.withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(os.path.join(data, f"changed={batch}"))
        if batch % MERGED == MERGED - 1:
            latest().write.mode("overwrite").parquet(os.path.join(data, f"upto={batch}"))
            for n in numbered(spark, data, "changed"):
                if n <= batch:
                    remove(spark, os.path.join(data, f"changed={n}"))
            for n in numbered(spark, data, "upto")[:-1]:
                remove(spark, os.path.join(data, f"upto={n}"))

    _drained(stream.writeStream.outputMode("update").foreachBatch(write), target)
    return latest().select(*stream.columns)


#: What ranks the exposures of one secret, oldest first.
OLDEST = ("seq", "-combined_score", "line_no", "rule_ord", "match_ord")


def first_exposures(findings: DataFrame) -> DataFrame:
    """The oldest finding of each (file, secret), whatever the order of arrival.

    The state holds one row per distinct (file, secret), as the result does; nothing is late.
    """
    order = [(-F.col(c[1:]) if c[0] == "-" else F.col(c)).alias(f"o{i}") for i, c in enumerate(OLDEST)]
    rest = [c for c in findings.columns if c not in ("file_path", "secret")]
    oldest = F.min(F.struct(*order, F.struct(*rest).alias("row"))).alias("oldest")
    return findings.groupBy("file_path", "secret").agg(oldest).select("file_path", "secret", "oldest.row.*")


def daily_counts(findings: DataFrame, time: str = "committed_at") -> DataFrame:
    """Findings per day and severity. The state has one row for each, so no day is ever closed."""
    return (
        findings.groupBy(F.window(time, "1 day").alias("w"), "severity")
        .agg(F.count("*").alias("n_findings"), F.max("combined_score").alias("max_score"))
        .select(F.col("w.start").alias("day"), "severity", "n_findings", "max_score")
    )


def drain_days(findings: DataFrame, target: str, time: str = "committed_at", delay_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Findings per day and severity with bounded state: counts on time, and late counts apart.

    A day is closed once a finding ``delay_days`` younger than it has been seen in an earlier
    micro-batch. Closed days are written out and forgotten; what comes for them afterwards is
    counted as late, under the number of its batch, so that no finding is lost: on time and late
    together are all. What is carried from batch to batch are the open days, at most ``delay_days``
    of them and those after the newest closed one. Batches replace their own folders when run again.
    """
    spark = findings.sparkSession
    at = lambda kind, n: os.path.join(target, kind, f"batch={n}")
    sums = [F.sum("n_findings").alias("n_findings"), F.max("max_score").alias("max_score")]
    counted = "day date, severity string, n_findings long, max_score double"
    state = f"{counted}, newest date"

    def write(batch_rows: DataFrame, batch: int) -> None:
        before = [n for n in numbered(spark, os.path.join(target, "open"), "batch") if n < batch]
        open_ = spark.read.schema(state).parquet(at("open", before[-1])) if before else spark.createDataFrame([], state)
        known = open_.agg(F.max("newest")).first()[0]
        rows = batch_rows.groupBy(F.to_date(time).alias("day"), "severity").agg(
            F.count("*").alias("n_findings"), F.max("combined_score").alias("max_score")
        )
        border = F.date_sub(F.lit(known), delay_days)
        is_late = F.coalesce(F.col("day") < border, F.lit(False))
        rows = rows.withColumn("late", is_late).persist()
        rows.where("late").drop("late").write.mode("overwrite").parquet(at("late", batch))
        merged = rows.where("NOT late").drop("late").unionByName(open_.where("day IS NOT NULL").drop("newest")).groupBy("day", "severity").agg(*sums)
        merged = merged.persist()
        newest = max((d for d in (known, rows.agg(F.max("day")).first()[0]) if d), default=None)
        closed = F.coalesce(F.col("day") < F.date_sub(F.lit(newest), delay_days), F.lit(False))
        merged.where(closed).write.mode("overwrite").parquet(at("closed", batch))
        mark = spark.range(1).select(F.lit(None).cast("date").alias("day"), F.lit(None).cast("string").alias("severity"),
                                     F.lit(0).cast("long").alias("n_findings"), F.lit(None).cast("double").alias("max_score"))
        merged.where(~closed).unionByName(mark).withColumn("newest", F.lit(newest).cast("date")).write.mode("overwrite").parquet(at("open", batch))
        for used in (rows, merged):
            used.unpersist()
        for n in before[:-1]:  # the last stays, in case this batch is run again
            remove(spark, at("open", n))

    _drained(findings.writeStream.outputMode("append").foreachBatch(write), target)

    def read(kind: str, last: bool = False) -> DataFrame:
        numbers = numbered(spark, os.path.join(target, kind), "batch")
        return _read(spark, [at(kind, n) for n in (numbers[-1:] if last else numbers)], T._parse_datatype_string(counted))

    on_time = read("closed").unionByName(read("open", last=True).where("day IS NOT NULL"))
    return on_time, read("late").groupBy("day", "severity").agg(*sums)
