"""Column selection that survives any column names of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame, prefix: str = "__c") -> DataFrame:
    """The same columns by position, under names that nothing else uses."""
    return df.toDF(*[f"{prefix}{i}" for i in range(len(df.columns))])


def narrow(df: DataFrame, **roles: str) -> DataFrame:
    """Only the named columns, as ``role=column``.

    Names are matched exactly and by position, so further columns that differ from
    them in case only, or that carry a name used inside an operator, do no harm.
    """
    names, plain = df.columns, numbered(df)
    return plain.select(*[F.col(f"__c{names.index(column)}").alias(role) for role, column in roles.items()])
