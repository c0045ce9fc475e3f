"""Reading tables of a folder, with timestamps in UTC."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; zone-less timestamps are taken as UTC."""
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*(F.col(f"`{c}`").cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(f"`{c}`") for c, t in df.dtypes))


def view(spark: SparkSession, folder: str, *names: str) -> None:
    """Register tables as temporary views."""
    for n in names:
        table(spark, folder, n).createOrReplaceTempView(n)


#: A table name, with or without qualifiers, after the words that take one.
_NAMED = re.compile(r"""\b(?:from|join|into|update|table)\s+((?:[\w`"]+\s*\.\s*)*[\w`"]+)""", re.IGNORECASE)


def check_qualified(sql: str, protected: Iterable[str]) -> None:
    """Raise if a statement names a protected table without the catalog or schema that it belongs to."""
    names = {n.lower() for n in protected}
    bare = {n.strip('`"').lower() for n in _NAMED.findall(sql) if "." not in n}
    if bad := sorted(bare & names):
        raise ValueError(f"tables without a schema: {', '.join(bad)}")
