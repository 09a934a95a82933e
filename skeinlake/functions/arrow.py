"""Arrow-batched Python over rows, for logic that no column expression can say."""
from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_rows(df: DataFrame, one: Callable[..., list[dict] | dict | None], schema: str) -> DataFrame:
    """Applies ``one(*columns)`` to every row; it gives a dict, a list of dicts, or None.

    If ``schema`` has a column ``error``, a row on which ``one`` fails gives one row of its first column
    and the error there; without such a column the failure ends the job, so that no row is lost silently.
    """
    struct = StructType.fromDDL(schema)
    target = to_arrow_schema(struct)
    names = [f.name for f in target]
    isolate = "error" in names

    def run(batches):
        for b in batches:
            rows = []
            for values in zip(*[c.to_pylist() for c in b.columns]):
                try:
                    x = one(*values)
                except Exception as e:
                    if not isolate:
                        raise
                    x = {names[0]: values[0], "error": f"{type(e).__name__}: {e}"}
                if x:
                    rows += x if isinstance(x, list) else [x]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], f.type) for n, f in zip(names, target)], schema=target)

    return df.mapInArrow(run, struct)
