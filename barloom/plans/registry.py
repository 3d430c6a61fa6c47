"""Registry of queries: each has a Spark form and, where SQL can say it, a twin for the check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    run: Callable
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        CATALOG[name] = Query(fn, sql)
        return fn
    return add


def tidy(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Chosen columns with doubles rounded for comparison (see `near`)."""
    columns = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select([near(F.col(c), digits).alias(c) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else F.col(c)
                      for c in columns])


def near(c, digits: int = 4):
    """Round up from just below the half: prices are short decimals, so exact halves are common and
    engines break them differently."""
    return F.floor(c * 10.0**digits + 0.5001) / 10.0**digits
