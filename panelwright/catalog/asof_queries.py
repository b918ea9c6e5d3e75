"""Queries for calendars and point-in-time alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.catalog.registry import query
from panelwright.operators import asof

CAL_SQL = """(SELECT CAST(d AS DATE) AS as_of FROM (SELECT unnest(generate_series(DATE '1996-01-01',
    least(DATE '2001-12-31', (SELECT max(date) FROM fx_price)), INTERVAL 3 MONTH)) AS d))"""


def calendar(t, months: int = 3):
    return asof.rebalance_calendar(t.spark, 1999, 2001, months, t.days)


@query("c1_rebalance_calendar", "as_of:d", f"SELECT * FROM {CAL_SQL}")
def _(t):
    return calendar(t)


@query(
    "c2_trade_date",
    "as_of:d trade_date:d",
    f"""SELECT as_of, max(date) AS trade_date FROM {CAL_SQL} JOIN (SELECT DISTINCT date FROM fx_price) p
        ON date BETWEEN as_of - 10 AND as_of GROUP BY as_of""",
)
def _(t):
    return asof.trade_dates(calendar(t), t.days)


@query(
    "c2_trade_date_by_symbol",
    "symbol:i as_of:d trade_date:d close:f",
    f"""SELECT symbol, as_of, date AS trade_date, close
        FROM (SELECT symbol, as_of FROM {CAL_SQL}, (SELECT DISTINCT symbol FROM fx_price)) k
        ASOF JOIN fx_price p ON k.symbol = p.symbol AND p.date <= k.as_of WHERE date >= as_of - 10""".replace(
        "SELECT symbol, as_of, date", "SELECT k.symbol, k.as_of, p.date"
    ),
)
def _(t):
    return asof.trade_dates_by_symbol(calendar(t), t.price)


@query(
    "c3_next_rebalance",
    "symbol:i date:d fillingDate:d rebalance_date:d",
    f"""SELECT symbol, date, fillingDate, (SELECT min(as_of) FROM {CAL_SQL} c WHERE c.as_of > f.fillingDate) AS rebalance_date
        FROM fx_filing f""",
)
def _(t):
    return asof.next_rebalance(t.filing, calendar(t))


@query(
    "c4_latest_filing",
    "as_of:d symbol:i date:d fillingDate:d revenue:f",
    f"""SELECT as_of, symbol, date, fillingDate, revenue FROM {CAL_SQL} JOIN fx_filing
        ON fillingDate BETWEEN CAST(as_of - INTERVAL 6 MONTH AS DATE) AND as_of
        QUALIFY row_number() OVER (PARTITION BY as_of, symbol ORDER BY fillingDate DESC, date DESC) = 1""",
)
def _(t):
    return asof.latest_filing(t.filing, calendar(t))


_LAGS = (3, 6, 9, 12, 15, 18, 21, 24)


@query(
    "c5_lagged_snapshots",
    "as_of:d symbol:i " + " ".join(f"prev{n}_revenue:f prev{n}_netDebt:f" for n in _LAGS),
    f"""SELECT as_of, symbol, """
    + ", ".join(
        f"max(CASE WHEN lag = {n} THEN {c} END) AS prev{n}_{c}" for n in _LAGS for c in ("revenue", "netDebt")
    )
    + f""" FROM (SELECT as_of, symbol, lag, revenue, netDebt
            FROM (SELECT as_of, unnest([3,6,9,12,15,18,21,24]) AS lag FROM {CAL_SQL}) c
            JOIN fx_filing ON fillingDate BETWEEN CAST(as_of - to_months(lag + 4) AS DATE) AND CAST(as_of - to_months(lag) AS DATE)
            QUALIFY row_number() OVER (PARTITION BY as_of, symbol, lag ORDER BY fillingDate DESC, date DESC) = 1)
        GROUP BY as_of, symbol""",
)
def _(t):
    return asof.lagged_snapshots(t.filing, calendar(t), ["revenue", "netDebt"], _LAGS)


@query(
    "c6_date_window",
    "symbol:i date:d fillingDate:d",
    "SELECT symbol, date, fillingDate FROM fx_filing WHERE fillingDate BETWEEN DATE '1997-01-01' AND DATE '2000-03-01'",
)
def _(t):
    return asof.date_window(t.filing, "fillingDate", 1997, 1999)


@query(
    "c7_fiscal_ordinal",
    "symbol:i calendarYear:i period:s ordinal:i",
    "SELECT symbol, calendarYear, period, calendarYear * 4 + CAST(period[2] AS INTEGER) AS ordinal FROM fx_filing",
)
def _(t):
    return asof.fiscal_ordinal(t.filing)


@query(
    "c8_seq_in_symbol",
    "symbol:i date:d time_for_sort:i",
    "SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS time_for_sort FROM fx_income",
)
def _(t):
    return asof.seq_in_symbol(asof.fiscal_ordinal(t.income))


@query(
    "c9_last_n_window",
    "symbol:i ordinal:i revenue:f",
    """SELECT symbol, ordinal, revenue FROM (
         SELECT *, count(*) OVER (PARTITION BY symbol) AS have FROM (
           SELECT *, calendarYear * 4 + CAST(period[2] AS INTEGER) AS ordinal FROM fx_income
           WHERE calendarYear * 4 + CAST(period[2] AS INTEGER) <= 7994
           QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ordinal DESC) <= 12))
       WHERE have = 12""",
)
def _(t):
    return asof.last_n_window(asof.fiscal_ordinal(t.income), 1998 * 4 + 2)


PANEL_SQL = f"""(SELECT d.as_of, p.symbol, d.trade_date, p.close, p.volume, s.industry, s.sector,
           f.report_date, f.fillingDate, f.revenue, f.cost, f.freeCashFlow, f.netDebt
    FROM (SELECT as_of, max(date) AS trade_date FROM {CAL_SQL} JOIN (SELECT DISTINCT date FROM fx_price) p
          ON date BETWEEN as_of - 10 AND as_of GROUP BY as_of) d
    JOIN fx_price p ON p.date = d.trade_date
    JOIN fx_symbol s ON s.symbol = p.symbol AND (s.delistedDate IS NULL OR s.delistedDate >= d.as_of)
    JOIN (SELECT as_of, symbol, date AS report_date, fillingDate, revenue, cost, freeCashFlow, netDebt
          FROM {CAL_SQL} JOIN fx_filing ON fillingDate BETWEEN CAST(as_of - INTERVAL 6 MONTH AS DATE) AND as_of
          QUALIFY row_number() OVER (PARTITION BY as_of, symbol ORDER BY fillingDate DESC, date DESC) = 1) f
      ON f.as_of = d.as_of AND f.symbol = p.symbol)"""


def panel(t):
    quotes = asof.rebalance_quotes(asof.trade_dates(calendar(t), t.days), t.price)
    return asof.panel_asof(calendar(t), t.symbol, t.filing, t.price, quotes=quotes)


@query(
    "c10_panel_asof",
    "as_of:d symbol:i trade_date:d close:f volume:i sector:s report_date:d fillingDate:d revenue:f netDebt:f",
    f"SELECT * FROM {PANEL_SQL}",
)
def _(t):
    return panel(t)


@query(
    "b6_active_universe",
    "as_of:d symbol:i delistedDate:d",
    f"""SELECT as_of, symbol, delistedDate FROM {CAL_SQL} JOIN fx_symbol
        ON delistedDate IS NULL OR delistedDate >= as_of""",
)
def _(t):
    return asof.active_at_dates(t.symbol, calendar(t))
