"""Files as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credscan.functions.text import utf8_text
from credscan.sources.paths import is_binary_file


def read_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    recursive: bool = True,
    glob: str | None = None,
    skip_binary: bool = False,
) -> DataFrame:
    """``file_path, content`` for a file, a directory tree or a list of either.

    A path or pattern that matches nothing gives no rows. Bytes that are not UTF-8 are dropped. ``skip_binary`` leaves out files with
    a binary extension before their content is read; scanning a single file
    does that, walking a directory does not.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = [p for p in paths if _exists(spark, p)]
    if not found:
        return spark.createDataFrame([], "file_path string, content string")
    return _texts(reader.load(found), skip_binary)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern matches anything, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    matched = store.globStatus(where)
    return matched is not None and len(matched) > 0


def read_listed(
    spark: SparkSession, listed: DataFrame, root: str, skip_binary: bool = False,
) -> DataFrame:
    """``content`` for each row of ``listed`` (``file_path`` and any other columns) whose file exists.

    Files are listed below ``root`` once, by Spark, and joined with the list; only files that are in
    both are read. The list is of files submitted together and goes into the plan of the read.
    Rows whose file is missing give no rows.
    """
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(
        "path", F.regexp_replace("path", "^file:/*", "/").alias("file_path")
    )
    wanted = listed.select("file_path").distinct()
    found = [r["path"] for r in there.join(wanted, "file_path", "left_semi").select("path").collect()]
    if not found:
        return listed.limit(0).withColumn("content", F.lit(None).cast("string"))
    return listed.join(_texts(spark.read.format("binaryFile").load(found), skip_binary), "file_path").select(*listed.columns, "content")


def _texts(files: DataFrame, skip_binary: bool) -> DataFrame:
    if skip_binary:
        files = files.where(~is_binary_file(F.col("path")))
    file_path = F.regexp_replace("path", "^file:/*", "/")
    return files.select(file_path.alias("file_path"), utf8_text(F.col("content")).alias("content"))


def write_findings(findings: DataFrame, path: str, format: str = "parquet") -> None:
    """Findings as files, one directory per severity, in files of even size."""
    findings.hint("rebalance", F.col("severity")).write.mode("overwrite").partitionBy("severity").format(format).save(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report table (metrics, model metadata) as JSON lines."""
    report.write.mode("overwrite").json(path)
