"""Queries for features and labels."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from panelwright.catalog.asof_queries import CAL_SQL, calendar
from panelwright.catalog.registry import query
from panelwright.operators import asof, features
from panelwright.session import stage

RETURN_SQL = f"""(SELECT symbol, as_of, date AS trade_date, close, volume,
      close - lag(close) OVER w AS price_diff, (close - lag(close) OVER w) / lag(close) OVER w AS price_dev
    FROM (SELECT d.as_of, p.* FROM fx_price p JOIN (
            SELECT as_of, max(date) AS trade_date FROM {CAL_SQL} JOIN (SELECT DISTINCT date FROM fx_price) p
            ON date BETWEEN as_of - 10 AND as_of GROUP BY as_of) d ON p.date = d.trade_date)
    WINDOW w AS (PARTITION BY symbol ORDER BY as_of))"""


def rebalance_prices(t):
    dates = asof.trade_dates(calendar(t), t.days).withColumnRenamed("trade_date", "date")
    return t.price.join(dates, "date")


def returns(t):
    return features.price_return(features.price_change(rebalance_prices(t), "as_of"), "as_of")


@query("e1_price_change", "symbol:i as_of:d close:f price_diff:f", f"SELECT * FROM {RETURN_SQL}")
def _(t):
    return features.price_change(rebalance_prices(t), "as_of")


@query("e2_price_return", "symbol:i as_of:d close:f price_dev:f", f"SELECT * FROM {RETURN_SQL}")
def _(t):
    return features.price_return(rebalance_prices(t), "as_of")


@query("e3_turnover", "symbol:i date:d turnover:f", "SELECT symbol, date, close * volume AS turnover FROM fx_price")
def _(t):
    return t.price.withColumn("turnover", features.turnover())


def capped(t):
    """Filings with a market cap that can be zero or negative."""
    cap = t.raw("supplier").select(
        F.col("s_suppkey").alias("symbol"),
        F.when(F.col("s_suppkey") % 9 == 0, 0.0).otherwise(F.col("s_acctbal") * 100).alias("marketCap"),
    )
    return t.filing.join(cap, "symbol")


CAPPED_SQL = """(SELECT f.*, CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE s_acctbal * 100 END AS marketCap
                 FROM fx_filing f JOIN supplier ON s_suppkey = symbol)"""


@query(
    "e4_over_marketcap",
    "symbol:i date:d marketCap:f OverMC_revenue:f OverMC_netDebt:f",
    f"""SELECT symbol, date, marketCap, CASE WHEN marketCap > 0 THEN revenue / marketCap END AS OverMC_revenue,
        CASE WHEN marketCap > 0 THEN netDebt / marketCap END AS OverMC_netDebt FROM {CAPPED_SQL}""",
)
def _(t):
    return features.over_marketcap(capped(t), ["revenue", "netDebt"])


@query(
    "e5_ev_multiples",
    "symbol:i date:d adaptiveMC_ev:f adaptiveMC_revenue:f adaptiveMC_freeCashFlow:f",
    f"""SELECT symbol, date, marketCap + netDebt AS adaptiveMC_ev,
        CASE WHEN revenue > 0 THEN (marketCap + netDebt) / revenue END AS adaptiveMC_revenue,
        CASE WHEN freeCashFlow > 0 THEN (marketCap + netDebt) / freeCashFlow END AS adaptiveMC_freeCashFlow FROM {CAPPED_SQL}""",
)
def _(t):
    return features.ev_multiples(capped(t), ["revenue", "freeCashFlow"])


_CHG = (3, 6, 12, 24)


@query(
    "e6_pct_change",
    "as_of:d symbol:i " + " ".join(f"diff{n}_revenue:f diff{n}_netDebt:f" for n in _CHG),
    "WITH now AS (SELECT as_of, symbol, revenue, netDebt FROM " + CAL_SQL + """ JOIN fx_filing
            ON fillingDate BETWEEN CAST(as_of - INTERVAL 6 MONTH AS DATE) AND as_of
            QUALIFY row_number() OVER (PARTITION BY as_of, symbol ORDER BY fillingDate DESC, date DESC) = 1),
        prev AS (SELECT as_of, symbol, lag, revenue, netDebt
            FROM (SELECT as_of, unnest([3,6,12,24]) AS lag FROM """ + CAL_SQL + """) c
            JOIN fx_filing ON fillingDate BETWEEN CAST(as_of - to_months(lag + 4) AS DATE) AND CAST(as_of - to_months(lag) AS DATE)
            QUALIFY row_number() OVER (PARTITION BY as_of, symbol, lag ORDER BY fillingDate DESC, date DESC) = 1)
        SELECT n.as_of, n.symbol, """
    + ", ".join(
        f"max(CASE WHEN lag = {k} AND p.{c} > 0 THEN (n.{c} - p.{c}) / p.{c} END) AS diff{k}_{c}"
        for k in _CHG
        for c in ("revenue", "netDebt")
    )
    + " FROM now n LEFT JOIN prev p ON p.as_of = n.as_of AND p.symbol = n.symbol GROUP BY ALL",
)
def _(t):
    cal, columns = calendar(t), ["revenue", "netDebt"]
    now = asof.latest_filing(t.filing, cal).select("as_of", "symbol", *columns)
    previous = asof.lagged_snapshots(t.filing, cal, columns, _CHG)
    return features.pct_change(now.join(previous, ["as_of", "symbol"], "left"), columns, _CHG)


@query(
    "e7_market_relative",
    "symbol:i as_of:d price_dev:f price_dev_subavg:f",
    f"SELECT *, price_dev - avg(price_dev) OVER (PARTITION BY as_of) AS price_dev_subavg FROM {RETURN_SQL}",
)
def _(t):
    return features.market_relative(returns(t), "price_dev", ["as_of"])


@query(
    "e8_sector_relative",
    "symbol:i as_of:d sector:s sec_price_dev_subavg:f",
    f"""SELECT symbol, as_of, sec AS sector,
          CASE WHEN sec IS NOT NULL THEN price_dev - avg(price_dev) OVER (PARTITION BY as_of, sec) END AS sec_price_dev_subavg
        FROM (SELECT r.*, nullif(sector, 'ASIA') AS sec FROM {RETURN_SQL} r JOIN fx_symbol USING (symbol))""",
)
def _(t):
    sectors = t.symbol.select("symbol", F.nullif("sector", F.lit("ASIA")).alias("sector"))
    return features.sector_relative(returns(t).join(sectors, "symbol"), "price_dev", ["as_of"])


@query(
    "e9_to_long",
    "symbol:i date:d kind:s value:f",
    """SELECT symbol, date, 'revenue' AS kind, revenue AS value FROM fx_income
       UNION ALL SELECT symbol, date, 'cost', cost FROM fx_income WHERE cost IS NOT NULL""",
)
def _(t):
    return features.to_long(t.income, ["symbol", "date"], ["revenue", "cost"])


def _plain(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", name)


def window_long(t):
    """Twelve quarters per symbol in long form, amounts in millions."""
    window = asof.last_n_window(asof.fiscal_ordinal(t.filing), 7999).select(
        "symbol", F.col("ordinal").alias("time"), *[(F.col(c) / 1e6).alias(c) for c in ("revenue", "netDebt")]
    )
    return features.to_long(window, ["symbol", "time"], ["revenue", "netDebt"])


_WINDOW_ROWS = """base AS (
    SELECT symbol, kind, o, v / 1e6 AS v
    FROM (SELECT symbol, calendarYear * 4 + CAST(period[2] AS INTEGER) AS o, unnest(['revenue', 'netDebt']) AS kind,
                 unnest([revenue, netDebt]) AS v FROM fx_filing)
    WHERE o <= 7999 QUALIFY row_number() OVER (PARTITION BY symbol, kind ORDER BY o DESC) <= 12),
  full_windows AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY o) - 1 AS i FROM base QUALIFY count(*) OVER (PARTITION BY symbol, kind) = 12),
  r AS (SELECT *, """ + ", ".join(f"lead(v, {k}) OVER w AS l{k}" for k in (1, 2, 3, 4, 5, 6, 9)) + """,
      lag(v, 1) OVER w AS b1, lag(v, 2) OVER w AS b2, lag(v, 3) OVER w AS b3, lag(v, 4) OVER w AS b4, lag(v, 5) OVER w AS b5,
      avg(v) OVER p AS m, stddev_pop(v) OVER p AS sd, min(v) OVER p AS mn, max(v) OVER p AS mx, median(v) OVER p AS md,
      sum(abs(v)) OVER (PARTITION BY symbol, kind ORDER BY i) / sum(abs(v)) OVER p AS mass
    FROM full_windows WINDOW w AS (PARTITION BY symbol, kind ORDER BY i), p AS (PARTITION BY symbol, kind))"""

_SQL_FEATURES = {
    "sum_values": "sum(v)",
    "mean": "avg(v)",
    "median": "median(v)",
    "variance": "var_pop(v)",
    "minimum": "min(v)",
    "maximum": "max(v)",
    "root_mean_square": "sqrt(avg(v * v))",
    "abs_energy": "sum(v * v)",
    "mean_change": "(arg_max(v, i) - arg_min(v, i)) / 11",
    "mean_abs_change": "avg(abs(l1 - v))",
    "absolute_sum_of_changes": "sum(abs(l1 - v))",
    "count_above_mean": "count(*) FILTER (v > m)",
    "count_below_mean": "count(*) FILTER (v < m)",
    "first_location_of_maximum": "min(i) FILTER (v = mx) / 12",
    "last_location_of_maximum": "(max(i) FILTER (v = mx) + 1) / 12",
    "first_location_of_minimum": "min(i) FILTER (v = mn) / 12",
    "last_location_of_minimum": "(max(i) FILTER (v = mn) + 1) / 12",
    "has_duplicate": "count(DISTINCT v) < 12",
    "has_duplicate_max": "count(*) FILTER (v = mx) > 1",
    "has_duplicate_min": "count(*) FILTER (v = mn) > 1",
    "variation_coefficient": "stddev_pop(v) / nullif(avg(v), 0)",
    "skewness": "skewness(v)",
    "kurtosis": "kurtosis(v)",
    "quantile__q_0.2": "quantile_cont(v, 0.2)",
    "quantile__q_0.8": "quantile_cont(v, 0.8)",
    "cid_ce__normalize_True": "sqrt(sum(((l1 - v) / sd) ** 2))",
    "cid_ce__normalize_False": "sqrt(sum((l1 - v) ** 2))",
    'linear_trend__attr_"slope"': "regr_slope(v, i)",
    'linear_trend__attr_"intercept"': "regr_intercept(v, i)",
    'linear_trend__attr_"rvalue"': "corr(v, i)",
    "autocorrelation__lag_0": "sum((v - m) * (v - m)) / (12 * var_pop(v))",
    "autocorrelation__lag_5": "sum((v - m) * (l5 - m)) / (7 * var_pop(v))",
    "autocorrelation__lag_9": "sum((v - m) * (l9 - m)) / (3 * var_pop(v))",
    "c3__lag_1": "avg(v * l1 * l2)",
    "c3__lag_2": "avg(v * l2 * l4)",
    "c3__lag_3": "avg(v * l3 * l6)",
    "time_reversal_asymmetry_statistic__lag_1": "avg(l2 * l2 * l1 - l1 * v * v)",
    "time_reversal_asymmetry_statistic__lag_2": "avg(l4 * l4 * l2 - l2 * v * v)",
    "time_reversal_asymmetry_statistic__lag_3": "avg(l6 * l6 * l3 - l3 * v * v)",
    **{f"symmetry_looking__r_{r}": f"abs(any_value(m) - any_value(md)) < {r} * (max(v) - min(v))" for r in ("0.0", "0.25", "0.65", "0.9")},
    **{f"large_standard_deviation__r_{r}": f"stddev_pop(v) > {r} * (max(v) - min(v))" for r in ("0.0", "0.25", "0.6", "0.9")},
    **{f"ratio_beyond_r_sigma__r_{r}": f"count(*) FILTER (abs(v - m) > {r} * sd) / 12" for r in ("0.5", "1", "1.5", "2", "2.5", "3", "5", "6", "7", "10")},
}

_SQL_FEATURES_2 = {
    "index_mass_quantile__q_0.2": "(min(i) FILTER (mass >= 0.2) + 1) / 12",
    "index_mass_quantile__q_0.8": "(min(i) FILTER (mass >= 0.8) + 1) / 12",
    "number_peaks__n_1": "count(*) FILTER (v > b1 AND v > l1)",
    "number_peaks__n_3": "count(*) FILTER (v > b1 AND v > l1 AND v > b2 AND v > l2 AND v > b3 AND v > l3)",
    "number_peaks__n_5": "count(*) FILTER (v > greatest(b1, b2, b3, b4, b5) AND b5 IS NOT NULL AND v > greatest(l1, l2, l3, l4, l5) AND l5 IS NOT NULL)",
    "number_peaks__n_10": "0",
    **{
        f'fft_coefficient__attr_"{a}"__coeff_{k}': e
        for k in (0, 1, 2, 3, 4, 5, 6)
        for a, e in {
            "real": f"sum(v * cos(pi() * {k} * i / 6))",
            "imag": f"sum(-v * sin(pi() * {k} * i / 6))",
            "abs": f"sqrt(sum(v * cos(pi() * {k} * i / 6)) ** 2 + sum(v * sin(pi() * {k} * i / 6)) ** 2)",
        }.items()
    },
}


def _wavelet_sql(coefficient: int, width: int) -> str:
    # Position c of the same-length convolution of 12 points with a kernel of P = min(10 w, 12) points.
    p = min(10 * width, 12)
    t = f"(({coefficient} + {(p - 1) // 2 if p % 2 else p // 2 - 1} - i) - {(p - 1) / 2})"
    amplitude = f"2 / (sqrt(3 * {width}) * pi() ** 0.25)"
    return (
        f"sum(CASE WHEN abs({t}) <= {(p - 1) / 2} THEN v * {amplitude} * (1 - ({t} / {width}) ** 2)"
        f" * exp(-({t} ** 2) / (2 * {width} ** 2)) ELSE 0 END)"
    )


for _w in (2, 5, 10, 20):
    for _c in (0, 6):
        _SQL_FEATURES_2[f"cwt_coefficients__coeff_{_c}__w_{_w}__widths_(2, 5, 10, 20)"] = _wavelet_sql(_c, _w)


def _feature_sql(wanted: dict[str, str]) -> str:
    return (
        f"WITH {_WINDOW_ROWS} SELECT symbol, kind, "
        + ", ".join(f'{e} AS "{_plain(n)}"' for n, e in wanted.items())
        + " FROM r GROUP BY symbol, kind"
    )


def _feature_columns(wanted) -> str:
    return "symbol:i kind:s " + " ".join(f"{_plain(n)}:g" for n in wanted)


def _named(df):
    return df.toDF(*[_plain(c) for c in df.columns])


@query("e10_ts_features", _feature_columns(_SQL_FEATURES), _feature_sql(_SQL_FEATURES))
def _(t):
    return _named(features.time_series_features(window_long(t), ["symbol"], filtered=False, features=list(_SQL_FEATURES)))


@query("e10_ts_features_spectral", _feature_columns(_SQL_FEATURES_2), _feature_sql(_SQL_FEATURES_2))
def _(t):
    return _named(
        features.time_series_features(
            window_long(t), ["symbol"], fourier=range(7), filtered=False, features=list(_SQL_FEATURES_2)
        )
    )


_RUNS_SQL = f"""WITH {_WINDOW_ROWS}, g AS (SELECT *, sum(CASE WHEN v > m THEN 0 ELSE 1 END) OVER w AS ga,
        sum(CASE WHEN v < m THEN 0 ELSE 1 END) OVER w AS gb FROM r WINDOW w AS (PARTITION BY symbol, kind ORDER BY i))
      SELECT a.symbol, a.kind, longest_strike_above_mean, longest_strike_below_mean FROM
        (SELECT symbol, kind, max(c) AS longest_strike_above_mean FROM (
           SELECT symbol, kind, ga, count(*) FILTER (v > m) AS c FROM g GROUP BY ALL) GROUP BY ALL) a JOIN
        (SELECT symbol, kind, max(c) AS longest_strike_below_mean FROM (
           SELECT symbol, kind, gb, count(*) FILTER (v < m) AS c FROM g GROUP BY ALL) GROUP BY ALL) b
        ON a.symbol = b.symbol AND a.kind = b.kind"""


@query("e10_ts_features_runs", "symbol:i kind:s longest_strike_above_mean:i longest_strike_below_mean:i", _RUNS_SQL)
def _(t):
    return features.time_series_features(
        window_long(t), ["symbol"], features=["longest_strike_above_mean", "longest_strike_below_mean"]
    )


_SOLVED = [f"partial_autocorrelation__lag_{k}" for k in range(10)] + [f"ar_coefficient__coeff_{k}__k_10" for k in (0, 3, 6, 10)]


@query("e10_ts_features_solver", _feature_columns(_SOLVED))
def _(t):
    return _named(features.time_series_features(window_long(t), ["symbol"], solver=True, filtered=False))


# Durbin's recursion written out for the first three lags.
@query(
    "e10_ts_features_pacf",
    "symbol:i kind:s lag_0:g lag_1:g lag_2:g lag_3:g",
    f"""WITH {_WINDOW_ROWS}, a AS (SELECT symbol, kind, sum((v - m) * (l1 - m)) / 11 / var_pop(v) AS r1,
          sum((v - m) * (l2 - m)) / 10 / var_pop(v) AS r2, sum((v - m) * (l3 - m)) / 9 / var_pop(v) AS r3 FROM r GROUP BY ALL),
        b AS (SELECT *, (r2 - r1 * r1) / (1 - r1 * r1) AS p2 FROM a)
        SELECT symbol, kind, 1 AS lag_0, r1 AS lag_1, p2 AS lag_2,
          (r3 - (r1 - p2 * r1) * r2 - p2 * r1) / (1 - (r1 - p2 * r1) * r1 - p2 * r2) AS lag_3 FROM b""",
)
def _(t):
    out = features.time_series_features(window_long(t), ["symbol"], solver=True, filtered=False, features=[])
    return out.withColumnsRenamed({f"partial_autocorrelation__lag_{k}": f"lag_{k}" for k in range(4)})


@query(
    "e11_features_wide",
    "symbol:i revenue_ts_mean:f revenue_ts_maximum:f netDebt_ts_mean:f netDebt_ts_maximum:f",
    f"""WITH {_WINDOW_ROWS} SELECT symbol, avg(v) FILTER (kind = 'revenue') AS revenue_ts_mean,
        max(v) FILTER (kind = 'revenue') AS revenue_ts_maximum, avg(v) FILTER (kind = 'netDebt') AS netDebt_ts_mean,
        max(v) FILTER (kind = 'netDebt') AS netDebt_ts_maximum FROM full_windows GROUP BY symbol""",
)
def _(t):
    long = features.time_series_features(window_long(t), ["symbol"], features=["mean", "maximum"])
    return features.features_wide(long, ["symbol"], ["revenue", "netDebt"])


def _scaled_sql(c: str) -> str:
    q = f"quantile_cont({c}, {{}}) OVER (PARTITION BY date)"
    spread = f"({q.format(0.75)} - {q.format(0.25)})"
    return f"({c} - {q.format(0.5)}) / CASE WHEN {spread} = 0 THEN 1 ELSE {spread} END AS {c}"


@query(
    "e12_robust_scale",
    "symbol:i date:d revenue:f netDebt:f flat:f",
    f"SELECT symbol, date, {_scaled_sql('revenue')}, {_scaled_sql('netDebt')}, 0 AS flat FROM fx_filing",
)
def _(t):
    return features.robust_scale(stage(t.filing.withColumn("flat", F.lit(7.0))), ["revenue", "netDebt", "flat"], ["date"])


@query(
    "e13_orient_high_good",
    "symbol:i date:d revenue_sorted:f netDebt_sorted:f",
    """SELECT symbol, date, revenue AS revenue_sorted,
       CASE WHEN netDebt >= 0 THEN -netDebt ELSE netDebt - max(netDebt) OVER (PARTITION BY date) END AS netDebt_sorted FROM fx_filing""",
)
def _(t):
    return features.orient_high_good(t.filing, {"revenue": "high", "netDebt": "low"}, ["date"])


@query("e14_label_up", "symbol:i as_of:d price_dev:f label_up:i", f"SELECT *, price_dev > 0 AS label_up FROM {RETURN_SQL}")
def _(t):
    return features.label_up(returns(t))


@query(
    "e15_forward_label",
    "symbol:i as_of:d future_return:f target:i",
    f"""SELECT symbol, as_of, (f - close) / close * 100 AS future_return, f > close AS target FROM (
        SELECT *, lead(close, 3) OVER (PARTITION BY symbol ORDER BY as_of) AS f FROM {RETURN_SQL}) WHERE f IS NOT NULL""",
)
def _(t):
    return features.forward_label(rebalance_prices(t), 3, "as_of")


@query(
    "e16_minmax10",
    "symbol:i date:d scaled:f",
    "SELECT symbol, date, (revenue - min(revenue) OVER ()) / (max(revenue) OVER () - min(revenue) OVER ()) * 10 AS scaled FROM fx_filing",
)
def _(t):
    return features.minmax10(t.filing, "revenue", "scaled")
