"""Where queries are registered under their names, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable, str | None]] = {}
View = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Registers a function of the view loader under its name, with DuckDB SQL over the views."""

    def add(fn: Callable[[View], DataFrame]):
        REGISTRY[fn.__name__] = (fn, sql)
        return fn

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
