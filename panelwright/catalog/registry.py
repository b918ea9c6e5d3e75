"""Registration of queries together with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.catalog.fixtures import FIXTURE_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Column kinds of a result: date, float (6 or 3 digits), integer, string.
# Floats are cut on a grid shifted off the decimal halves, with the same IEEE
# steps in both engines, so exact ties (a price over 32 shares) fall alike.
_SHIFT = 0.4142


def _cut(scale: float):
    return lambda c: F.floor(F.col(c).cast("double") * scale + _SHIFT).cast("double") / scale


_SPARK_CAST = {
    "d": lambda c: F.col(c).cast("date").cast("string"),
    "f": _cut(1e6),
    "g": _cut(1e3),
    "i": lambda c: F.col(c).cast("long"),
    "s": lambda c: F.col(c).cast("string"),
}
_SQL_CAST = {
    "d": "CAST(CAST({c} AS DATE) AS VARCHAR)",
    "f": "CAST(floor(CAST({c} AS DOUBLE) * 1e6 + 0.4142) AS DOUBLE) / 1e6",
    "g": "CAST(floor(CAST({c} AS DOUBLE) * 1e3 + 0.4142) AS DOUBLE) / 1e3",
    "i": "CAST({c} AS BIGINT)",
    "s": "CAST({c} AS VARCHAR)",
}


def _spec(columns: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in columns.split()]


def _with_views(sql: str) -> str:
    """Prepend the fixture views the statement names, with those they need."""
    needed: list[str] = []
    text = sql
    for name in reversed(FIXTURE_SQL):
        if name in text:
            needed.insert(0, name)
            text += FIXTURE_SQL[name]
    views = ",\n".join(f"{n} AS MATERIALIZED ({FIXTURE_SQL[n]})" for n in needed)
    return f"WITH {views}\n" if views else ""


def query(name: str, columns: str, sql: str | None = None):
    """Register ``fn(tables)``; ``columns`` gives names and kinds for both engines."""
    spec = _spec(columns)

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(spark, sf_dir))
            return df.select(*[_SPARK_CAST[k](f"`{c}`").alias(c) for c, k in spec])

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            outer = ", ".join(_SQL_CAST[k].format(c=f'"{c}"') + f' AS "{c}"' for c, k in spec)
            ORACLE[name] = f"{_with_views(sql)}SELECT {outer} FROM (\n{sql}\n)"
        return fn

    return register
