"""Shared helpers of the training-data operators."""
from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skeinlake.operators.storage import cut as written, shared_dir

#: Fewer garbage collections in Python workers: page trees are cyclic, short-lived and many.
GC_THRESHOLD = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str) -> DataFrame:
    """``mapInArrow`` by a function of one batch that returns a batch or a dict of columns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    target = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(GC_THRESHOLD, 20, 20)
        for b in batches:
            out = rows(b)
            if out is None:
                continue
            if isinstance(out, dict):
                out = pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in target], schema=target)
            if out.num_rows:
                yield out

    return df.mapInArrow(run, struct)


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int | None = None) -> DataFrame:
    """Inner join of many rows with a table that has each key once, where one key may hold a third of the left rows.

    The right side is repeated once per salt, so a hot key's rows spread over ``salts`` tasks: one for
    every four cores of the cluster, 16 to 64. What is still too large for a task is split by the adaptive
    skew join, which needs no bound: the salted key stays a plain equi-join.
    """
    from pyspark.sql import functions as F

    salts = salts or min(64, max(16, left.sparkSession.sparkContext.defaultParallelism // 4))
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in left.columns if c != key]), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [key, "_salt"]).drop("_salt")
