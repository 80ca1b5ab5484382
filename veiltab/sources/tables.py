"""Reading and writing tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from veiltab.operators.domain import CONTINUOUS, ORDINAL, ROLE_NAMES, Column, Domain, check_columns


def read_domain(path_or_config) -> Domain:
    """A domain from a config ``{col: {type, size}}``, given as dict or JSON file."""
    config = path_or_config
    if isinstance(config, str):
        with open(config) as f:
            config = json.load(f)
    cols = []
    for name, c in config.items():
        role = ROLE_NAMES[c["type"]]
        if role != CONTINUOUS and "size" not in c:
            raise ValueError(f"column {name} needs a size")
        size = int(c.get("size", 1))
        if role == CONTINUOUS:
            size = 1
        hi = float(size - 1) if role == ORDINAL else 1.0
        cols.append(
            Column(name, role, size, float(c.get("lower", 0.0)), float(c.get("upper", hi)),
                   bool(c.get("has_nulls", False)), bool(c.get("is_sparse", False)))
        )
    return Domain(tuple(cols))


def load(spark: SparkSession, path: str, domain: Domain, fmt: str = "parquet") -> DataFrame:
    """The domain's columns of a table; CSV is read with a schema, never inferred."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        kinds = {CONTINUOUS: T.DoubleType(), ORDINAL: T.LongType()}
        header = spark.read.option("header", True).csv(path).columns
        fields = [
            T.StructField(n, kinds.get(domain[n].role, T.StringType()) if n in domain.names else T.StringType())
            for n in header
        ]
        df = spark.read.option("header", True).schema(T.StructType(fields)).csv(path)
    check_columns(df, domain.names)
    return df.select(*domain.names)


def read_delimited(
    spark: SparkSession, path: str, names: list[str], sep: str = ",", header: bool = False,
    types: dict[str, str] | None = None,
) -> DataFrame:
    """A delimited file with the given column names; a header row, if any, is dropped."""
    types = types or {}
    schema = ", ".join(f"`{n}` {types.get(n, 'string')}" for n in names)
    reader = spark.read.option("sep", sep).option("header", header).option("enforceSchema", True)
    trim = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    return trim.schema(schema).csv(path)


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
