"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder. A local
    session that names none gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="credscan-")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own, without its lineage: what an iteration goes on from."""
    target = shared_dir(df.sparkSession, name)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def _at(spark: SparkSession, path: str):
    """A path and the file system that it is in, whatever store that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where)


def is_file(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where) and store.getFileStatus(where).isFile()


def numbered(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers n of the complete folders ``name=n`` in a folder, ascending."""
    store, where = _at(spark, folder)
    if not store.exists(where):
        return []
    done = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(where, f"{name}=*/_SUCCESS"))
    return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in done)


def remove(spark: SparkSession, folder: str) -> None:
    store, where = _at(spark, folder)
    store.delete(where, True)
