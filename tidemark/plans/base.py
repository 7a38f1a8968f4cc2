"""Registration of queries: a module keeps QUERIES and ORACLES and fills them with ``register``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def registry() -> tuple[dict, dict, Callable]:
    queries, oracles = {}, {}

    def register(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, register


def rounded(df, digits: int = 8, **special: int):
    """Doubles rounded, so that sums taken in another order compare equal."""
    return df.select(*[F.round(F.col(c), special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(x: str | Column, digits: int = 8) -> Column:
    return F.round(x, digits)
