"""Cutting lineage to shared storage, and tables of results and snapshots."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Where that is unset, a session on one machine (``local``) uses the warehouse; a cluster has no
    folder that all executors are sure to share, so the job ends with an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_skeinlake"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows written once and read back: short lineage that survives lost executors.

    The folder is cleared with the checkpoint folder after the job: the rows are read lazily, so no
    operator knows when the last reader is done.
    """
    where = shared_dir(df.sparkSession)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def save_results(df: DataFrame, folder: str, by: list[str]) -> None:
    """Appends results partitioned by the given columns, such as the job."""
    df.write.mode("append").partitionBy(*by).parquet(folder)


def load_results(spark: SparkSession, folder: str, **equal) -> DataFrame:
    """Results of the wanted partitions alone."""
    df = spark.read.parquet(folder)
    for k, v in equal.items():
        df = df.filter(df[k] == v)
    return df


def page_of(df: DataFrame, key: str, cursor=None, limit: int = 100) -> DataFrame:
    """One page of results in key order behind a cursor; the limit is kept between 1 and 1000."""
    x = df if cursor is None else df.filter(df[key] > cursor)
    return x.orderBy(key).limit(max(1, min(limit, 1000)))


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """Upsert view of an append-only table: the last row of each key."""
    from pyspark.sql import Window, functions as F

    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")
