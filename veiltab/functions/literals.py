"""Constants for the executors: arrays inside expressions and small tables of metadata."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def array_sql(values) -> str:
    """One SQL text is much cheaper to send than one call per element."""

    def one(v) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float):
            return f"{v!r}D"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(v, (list, tuple)):
            return array_sql(v) if v else "cast(array() as array<double>)"
        return str(v)

    return f"array({','.join(map(one, values))})"


def array_lit(values) -> Column:
    return F.expr(array_sql(values))


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A metadata table sent as one Arrow block, so that no Python worker is asked for it later."""
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    data = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(data, schema)
