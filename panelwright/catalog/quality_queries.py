"""Queries for filters, pruning and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.catalog.asof_queries import PANEL_SQL, panel
from panelwright.catalog.registry import query
from panelwright.catalog.view_queries import STATEMENT_SQL, statement
from panelwright.functions import names
from panelwright.operators import quality
from panelwright.session import stage

_STATEMENT_COLUMNS = ("symbol", "date", "fillingDate", "calendarYear", "period", "revenue", "cost", "netDebt", "freeCashFlow")
_AMOUNTS = ("revenue", "cost", "netDebt", "freeCashFlow")


@query(
    "d1_liquid_half",
    "symbol:i mean_turnover:g",
    """SELECT symbol, m AS mean_turnover FROM (SELECT symbol, avg(close * volume) AS m FROM fx_price GROUP BY symbol)
       QUALIFY row_number() OVER (ORDER BY m DESC, symbol) <= floor(count(*) OVER () * 0.5)""",
)
def _(t):
    return quality.liquid_half(t.price)


@query(
    "d1_keep_liquid",
    "symbol:i date:d close:f",
    """SELECT symbol, date, close FROM fx_price SEMI JOIN (
         SELECT symbol FROM (SELECT symbol, avg(close * volume) AS m FROM fx_price GROUP BY symbol)
         QUALIFY row_number() OVER (ORDER BY m DESC, symbol) <= floor(count(*) OVER () * 0.3)) USING (symbol)""",
)
def _(t):
    return quality.keep_liquid(t.price, 0.3)


@query(
    "d2_liquid_top_fraction",
    "date:d symbol:i volume:i",
    """SELECT date, symbol, volume FROM fx_price
       QUALIFY rank() OVER (PARTITION BY date ORDER BY volume DESC) <= floor(count(*) OVER (PARTITION BY date) * 0.10)""",
)
def _(t):
    # The price view is derived from line items; it is computed once for the operator's passes.
    return quality.liquid_top_fraction(stage(t.price), "volume", 0.10, ["date"])


def _per_column(select: str, columns, source: str) -> str:
    return " UNION ALL ".join(select.format(c=c, s=source) for c in columns)


@query(
    "d3_sparse_columns",
    "column:s null_share:f dropped:i",
    f"WITH s AS ({STATEMENT_SQL}) SELECT *, null_share > 0.12 AS dropped FROM ("
    + _per_column("SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS null_share FROM s", _STATEMENT_COLUMNS, "s")
    + ")",
)
def _(t):
    return quality.null_shares(statement(t)).withColumn("dropped", (F.col("null_share") > 0.12).cast("int"))


@query(
    "d3_drop_sparse_columns",
    "symbol:i date:d revenue:f n_dropped:i",
    f"SELECT symbol, date, revenue, 2 AS n_dropped FROM ({STATEMENT_SQL})",
)
def _(t):
    kept, dropped = quality.drop_sparse_columns(statement(t), 0.12)
    return kept.withColumn("n_dropped", F.lit(len(dropped)))


@query(
    "d4_constant_columns",
    "column:s top_share:f",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", max(n) / sum(n) AS top_share FROM (SELECT count(*) AS n FROM orders GROUP BY {c})"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    ),
)
def _(t):
    return quality.top_value_shares(
        t.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    )


_HEAVY = ("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "gap", "flat")


@query(
    "d4_heavy_values",
    "column:s top_share:f",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CASE WHEN max(n) / sum(n) >= 0.125 THEN max(n) / sum(n) END AS top_share FROM (
              SELECT count(*) AS n FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS gap, 7 AS flat FROM orders) GROUP BY {c})"""
        for c in _HEAVY
    ),
)
def _(t):
    """By sketch and one counting pass: the share where it is an eighth or more."""
    gap = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey"))
    return quality.heavy_value_shares(t.raw("orders").withColumns({"gap": gap, "flat": F.lit(7)}).select(*_HEAVY))


@query(
    "d5_drop_sparse_rows",
    "symbol:i date:d revenue:f netDebt:f",
    f"""SELECT symbol, date, revenue, netDebt FROM ({STATEMENT_SQL})
        WHERE (revenue IS NULL)::INT + (cost IS NULL)::INT + (netDebt IS NULL)::INT + (freeCashFlow IS NULL)::INT < 2""",
)
def _(t):
    return quality.drop_sparse_rows(statement(t), 0.4, _AMOUNTS)


@query(
    "d6_sparse_column_counter",
    "column:s n_dates:i",
    f"WITH s AS ({STATEMENT_SQL})"
    + _per_column(
        """ SELECT '{c}' AS "column", count(*) FILTER (m >= lim) AS n_dates FROM
            (SELECT date, sum(({c} IS NULL)::INT) AS m, floor(count(*) * 0.2) AS lim FROM s GROUP BY date)""",
        _AMOUNTS,
        "s",
    ),
)
def _(t):
    return quality.sparse_column_counts(statement(t), _AMOUNTS, "date", 0.2)


@query(
    "d7_complete_cases",
    "symbol:i date:d revenue:f netDebt:f freeCashFlow:f",
    f"SELECT * FROM ({STATEMENT_SQL}) WHERE revenue IS NOT NULL AND netDebt IS NOT NULL AND freeCashFlow IS NOT NULL",
)
def _(t):
    return quality.complete_cases(statement(t), ["revenue", "netDebt", "freeCashFlow"])


_PRICE_RULES = quality.Rules(("date", "symbol", "close", "marketCap"), ("date", "close"), 100_000_000)
_SYMBOL_RULES = quality.Rules(("symbol", "ipoDate"), ("symbol", "delistedDate"), 1, "symbol")


def findings(t):
    doubled = t.symbol.unionByName(t.symbol.where(F.col("symbol") % 10 == 1)).drop("ipoDate")
    return quality.findings_of(
        {"price": t.price, "symbol_list": doubled}, {"price": _PRICE_RULES, "symbol_list": _SYMBOL_RULES}
    )


_FINDINGS_SQL = """(
  WITH d AS (SELECT * FROM fx_symbol UNION ALL SELECT * FROM fx_symbol WHERE symbol % 10 = 1)
  SELECT 'price' AS "table", * FROM (
    SELECT 'rows' AS "check", '' AS "column", 'info' AS severity, count(*)::VARCHAR AS observed, NULL AS "limit" FROM fx_price
    UNION ALL SELECT 'columns', '', 'info', '4', NULL
    UNION ALL SELECT 'required', 'marketCap', 'error', 'absent', NULL
    UNION ALL SELECT 'min_rows', '', 'warning', count(*)::VARCHAR, '100000000' FROM fx_price
    UNION ALL SELECT 'date_range', 'date', 'info', min(date) || '..' || max(date), NULL FROM fx_price
    UNION ALL SELECT 'distinct_symbols', 'symbol', 'info', count(DISTINCT symbol)::VARCHAR, NULL FROM fx_price)
  UNION ALL SELECT 'symbol_list', * FROM (
    SELECT 'rows', '', 'info', count(*)::VARCHAR, NULL FROM d
    UNION ALL SELECT 'columns', '', 'info', '5', NULL
    UNION ALL SELECT 'required', 'ipoDate', 'error', 'absent', NULL
    UNION ALL SELECT 'not_null', 'delistedDate', 'error', count(*)::VARCHAR, '0' FROM d WHERE delistedDate IS NULL
    UNION ALL SELECT 'unique', 'symbol', 'warning', (count(*) - count(DISTINCT symbol))::VARCHAR, '0' FROM d
    UNION ALL SELECT 'mostly_null', 'delistedDate', 'warning', sum((delistedDate IS NULL)::INT)::VARCHAR,
                     (count(*) * 0.5)::DECIMAL(20,1)::VARCHAR FROM d
    UNION ALL SELECT 'distinct_symbols', 'symbol', 'info', count(DISTINCT symbol)::VARCHAR, NULL FROM d))"""


@query("d8_validate_table", "table:s check:s column:s severity:s observed:s limit:s", f"SELECT * FROM {_FINDINGS_SQL}")
def _(t):
    return findings(t)


@query(
    "d9_validation_report",
    "table:s status:s n_errors:i n_warnings:i first_error:s n_info:i n_passed:i n_tables:i",
    f"""SELECT *, count(*) FILTER (n_errors = 0) OVER () AS n_passed, count(*) OVER () AS n_tables FROM (
        SELECT "table", CASE WHEN count(*) FILTER (severity = 'error') = 0 THEN 'passed' ELSE 'failed' END AS status,
               count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings,
               min(concat_ws(' ', "check", nullif("column", ''), 'observed=' || observed)) FILTER (severity = 'error') AS first_error,
               count(*) FILTER (severity = 'info') AS n_info
        FROM {_FINDINGS_SQL} GROUP BY "table")""",
)
def _(t):
    out = quality.validation_report(findings(t))
    return out.withColumn("first_error", F.try_element_at("errors", F.lit(1))).withColumn("n_info", F.size("info"))


@query(
    "d10_profile_table",
    "column:s n:i n_null:i null_share:f mean:g std:g min:f q25:f q50:f q75:f max:f",
    f"WITH s AS ({STATEMENT_SQL}) "
    + _per_column(
        """SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS n_null, (count(*) - count({c})) / count(*) AS null_share,
           avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q25,
           quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM s WHERE calendarYear >= 1997""",
        _AMOUNTS,
        "s",
    ),
)
def _(t):
    return quality.profile_table(statement(t), _AMOUNTS, "calendarYear >= 1997")


@query(
    "d10_date_range",
    "first_date:d last_date:d n_keys:i",
    "SELECT min(date) AS first_date, max(date) AS last_date, count(DISTINCT symbol) AS n_keys FROM fx_price",
)
def _(t):
    return quality.date_range(t.price)


@query(
    "d11_finite_columns",
    "date:d column:s is_finite:i",
    f"WITH s AS ({STATEMENT_SQL}) "
    + _per_column("SELECT date, '{c}' AS \"column\", bool_and({c} IS NOT NULL) AS is_finite FROM s GROUP BY date", _AMOUNTS, "s"),
)
def _(t):
    return quality.finite_columns(statement(t), _AMOUNTS, ["date"])


@query(
    "d12_select_features",
    "as_of:d symbol:i priceToCost:f OverMC_revenue:f n_kept:i",
    f"""SELECT as_of, symbol, revenue / cost AS priceToCost, revenue / (close * 1000) AS OverMC_revenue, 4 AS n_kept FROM {PANEL_SQL}""",
)
def _(t):
    wide = panel(t).select(
        "as_of",
        "symbol",
        "revenue",
        "cost",
        (F.col("revenue") / F.col("cost")).alias("priceToCost"),
        (F.col("revenue") / (F.col("close") * 1000)).alias("OverMC_revenue"),
        F.col("netDebt").alias("adaptiveMC_ev"),
        F.col("revenue").alias("revenue_ts_mean"),
    )
    kept = names.select_features(wide.columns, ["priceToCost"], ["revenue", "cost", "netDebt"])
    return wide.select("as_of", "symbol", *kept).withColumn("n_kept", F.lit(len(kept)))


@query(
    "d13_filter_by_suffix",
    "symbol:i revenue_q20:f n_kept:i",
    """SELECT symbol, quantile_cont(revenue, 0.2) AS revenue_q20, 2 AS n_kept FROM fx_filing GROUP BY symbol""",
)
def _(t):
    wanted = {
        "revenue_ts_quantile__q_0.2": F.percentile("revenue", 0.2),
        "revenue_ts_quantile__q_0.5": F.percentile("revenue", 0.5),
        "revenue_ts_standard_deviation": F.stddev_pop("revenue"),
        "revenue_ts_mean": F.avg("revenue"),
    }
    kept = names.filter_by_suffix(wanted)
    # One symbol has at most one filing per quarter, so the built-in percentile holds a bounded group.
    return (
        t.filing.groupBy("symbol")
        .agg(*[wanted[n].alias(n) for n in kept], F.lit(len(kept)).alias("n_kept"))
        .withColumnRenamed("revenue_ts_quantile__q_0.2", "revenue_q20")
    )
