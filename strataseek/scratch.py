"""Intermediate tables in the folder that every executor shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where that is unset and all of Spark is one process (tests)."""
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {_SETTING} to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strataseek-")
        spark.conf.set(_SETTING, root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_own(spark)}/{label}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/strataseek/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Results that aren't written elsewhere by then can't be read any more."""
    delete(spark, _own(spark))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so later steps neither recompute nor see other values if an
    executor is lost. (``checkpoint()`` would run the plan twice: once to count, once to write.)
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strataseek_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_strataseek_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fence(df: DataFrame) -> DataFrame:
    """The same rows, but no filter that is put on them moves below.

    Spark moves a filter through projections by putting their expressions in place of the columns;
    an array column that a lambda looks into would then be computed anew for each element.
    """
    return df.select(F.inline_outer(F.array(F.struct(*df.columns))))
