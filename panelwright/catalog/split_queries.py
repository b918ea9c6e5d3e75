"""Queries for splits and validation windows (H1-H5, H8, H9)."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import functions as F

from panelwright.catalog.registry import query
from panelwright.operators import splits

_ROWS = "(SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)"
_FOLD = "fold:i role:s n:i first_date:d last_date:d ids:i"
_SUMMARY = "SELECT fold, role, count(*) AS n, min(date) AS first_date, max(date) AS last_date, sum(id) AS ids"


def orders(t):
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"))


def _summary(tagged, *keys):
    return tagged.groupBy(*keys, "role").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.sum("id").alias("ids"),
    )


@query(
    "h1_ts_folds",
    _FOLD,
    f"""{_SUMMARY} FROM (SELECT id, date, fold, CASE WHEN pos < n - (6 - fold) * (n // 6) THEN 'train'
          WHEN pos < n - (5 - fold) * (n // 6) THEN 'validation' END AS role FROM {_ROWS}, range(1, 6) f(fold))
        WHERE role IS NOT NULL GROUP BY fold, role""",
)
def _(t):
    return _summary(splits.ts_folds(orders(t), 5, ["date", "id"]), "fold")


@query(
    "h1_ts_folds_rows",
    "id:i date:d fold:i",
    f"SELECT id, date, fold FROM {_ROWS}, range(1, 4) f(fold) WHERE pos >= n - (4 - fold) * (n // 4) AND pos < n - (3 - fold) * (n // 4)",
)
def _(t):
    return splits.ts_folds(orders(t), 3, ["date", "id"]).where(F.col("role") == "validation")


@query(
    "h2_expanding_folds",
    _FOLD,
    f"""{_SUMMARY} FROM (SELECT id, date, fold + 1 AS fold, CASE WHEN pos < n // 5 + fold * (n // 20) THEN 'train'
          WHEN pos < n // 5 + fold * (n // 20) + n // 10 THEN 'test' END AS role
        FROM {_ROWS}, range(0, 100) f(fold) WHERE n // 5 + fold * (n // 20) + n // 10 <= n) WHERE role IS NOT NULL GROUP BY fold, role""",
)
def _(t):
    n = t.raw("orders").count()
    return _summary(splits.expanding_folds(orders(t), n // 5, n // 10, n // 20, ["date", "id"]), "fold")


@query(
    "h3_rolling_folds",
    _FOLD,
    f"""{_SUMMARY} FROM (SELECT id, date, fold + 1 AS fold, CASE WHEN pos < fold * s + n // 4 THEN 'train' ELSE 'test' END AS role
        FROM (SELECT *, n // 30 AS s FROM {_ROWS}), range(0, 100) f(fold)
        WHERE fold * s + n // 4 + s <= n AND pos >= fold * s AND pos < fold * s + n // 4 + s)
        GROUP BY fold, role""",
)
def _(t):
    n = t.raw("orders").count()
    return _summary(splits.rolling_folds(orders(t), n // 4, n // 30, None, ["date", "id"]), "fold")


def _windows_sql(anchored: bool, start: str = "DATE '1995-01-01'", end: str = "DATE '2001-08-15'") -> str:
    back = start if anchored else f"{start} + to_months(CAST(3 * i AS INTEGER))"
    at = f"{start} + to_months(CAST(24 + 3 * i AS INTEGER))"
    return f"""(SELECT i + 1 AS "window", CAST({back} AS DATE) AS train_start, CAST({at} AS DATE) AS train_end,
        CAST({at} AS DATE) AS test_start, CAST({at} + INTERVAL 6 MONTH AS DATE) AS test_end
      FROM range(0, 400) r(i) WHERE {at} + INTERVAL 6 MONTH <= {end})"""


def order_windows(t, anchored=False):
    """Windows over the span of the orders."""
    day = F.col("o_orderdate").cast("date")
    start, end = t.raw("orders").agg(F.min(day), F.max(day)).first()
    return splits.walk_forward_windows(t.spark, start, end, 24, 6, 3, anchored)


def _order_windows_sql(anchored: bool) -> str:
    start, end = [f"(SELECT CAST({f}(o_orderdate) AS DATE) FROM orders)" for f in ("min", "max")]
    return _windows_sql(anchored, start, end)


def windows(t, anchored=False):
    return splits.walk_forward_windows(t.spark, Date(1995, 1, 1), Date(2001, 8, 15), 24, 6, 3, anchored)


_WINDOW = "window:i train_start:d train_end:d test_start:d test_end:d"


@query("h4_walk_forward_windows", _WINDOW, f"SELECT * FROM {_order_windows_sql(False)}")
def _(t):
    return order_windows(t)


@query("h4_walk_forward_windows_anchored", _WINDOW, f"SELECT * FROM {_order_windows_sql(True)}")
def _(t):
    return order_windows(t, True)


@query(
    "h5_assign_windows",
    "window:i role:s n:i first_date:d last_date:d ids:i",
    f"""SELECT "window", role, count(*) AS n, min(date) AS first_date, max(date) AS last_date, sum(id) AS ids FROM (
          SELECT "window", id, date, CASE WHEN date < train_end THEN 'train' ELSE 'test' END AS role
          FROM {_windows_sql(False)} JOIN (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date FROM orders)
            ON date >= train_start AND date < test_end) GROUP BY ALL""",
)
def _(t):
    return _summary(splits.assign_windows(orders(t), windows(t)), "window")


@query(
    "h8_year_split",
    "part:s symbol:i date:d revenue:f",
    """SELECT 'train' AS part, symbol, date, revenue FROM fx_filing WHERE calendarYear IN (1996, 1997, 1998)
       UNION ALL SELECT 'test', symbol, date, revenue FROM fx_filing WHERE calendarYear = 1999 AND period IN ('Q1', 'Q2')""",
)
def _(t):
    train, test = splits.year_split(t.filing, [1996, 1997, 1998], [1999], ["Q1", "Q2"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "h9_predict_rows",
    "symbol:i date:d close:f",
    "SELECT * FROM fx_price WHERE date = (SELECT max(date) FROM fx_price)",
)
def _(t):
    return splits.predict_rows(t.price, Date(2030, 1, 1))


@query("h9_predict_rows_at", "symbol:i date:d close:f", "SELECT * FROM fx_price WHERE date = DATE '1999-06-01'")
def _(t):
    return splits.predict_rows(t.price, Date(1999, 6, 1))
