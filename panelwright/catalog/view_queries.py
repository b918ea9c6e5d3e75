"""Queries for view building."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.catalog.registry import query
from panelwright.functions.names import clean_names, key_columns_first
from panelwright.operators import features, views
from panelwright.session import scratch_path
from panelwright.sources import bucketed, tables


def symbol_sources(t):
    """A listed, a delisted and a profile table that overlap."""
    key = F.col("symbol")
    listed = t.symbol.where(key % 10 != 7).select("symbol", "exchangeShortName", F.lit("stock").alias("type"))
    delisted = t.symbol.where(key % 5 == 2).select(
        "symbol",
        F.when(key % 4 == 0, "OTHER").otherwise(F.col("exchangeShortName")).alias("exchangeShortName"),
        F.when(key % 2 == 1, F.col("ipoDate")).alias("ipoDate"),
        "delistedDate",
    )
    profile = t.symbol.where(key % 11 != 0).select("symbol", "exchangeShortName", "ipoDate", "industry")
    return listed, delisted, profile


@query(
    "b1_symbol_master",
    "symbol:i exchangeShortName:s type:s ipoDate:d delistedDate:d industry:s",
    """SELECT a.symbol, a.exchangeShortName, type, coalesce(a.ipoDate, p.ipoDate) AS ipoDate, a.delistedDate, industry
       FROM (SELECT * FROM (
               SELECT symbol, exchangeShortName, 'stock' AS type, NULL::DATE AS ipoDate, NULL::DATE AS delistedDate, 0 AS src
               FROM fx_symbol WHERE symbol % 10 <> 7
               UNION ALL
               SELECT symbol, CASE WHEN symbol % 4 = 0 THEN 'OTHER' ELSE exchangeShortName END, NULL,
                      CASE WHEN symbol % 2 = 1 THEN ipoDate END, delistedDate, 1
               FROM fx_symbol WHERE symbol % 5 = 2)
             QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY src) = 1) a
       LEFT JOIN (SELECT * FROM fx_symbol WHERE symbol % 11 <> 0) p
         ON p.symbol = a.symbol AND p.exchangeShortName = a.exchangeShortName
       WHERE a.exchangeShortName IN ('NASDAQ', 'NYSE')""",
)
def _(t):
    return views.symbol_master(*symbol_sources(t))


@query(
    "b2_recently_active",
    "symbol:i delistedDate:d",
    """SELECT symbol, delistedDate FROM fx_symbol WHERE delistedDate IS NULL
       OR delistedDate >= (SELECT max(delistedDate) - INTERVAL 1 MONTH FROM fx_symbol)""",
)
def _(t):
    return views.recently_active(t.symbol)


def _text_dates(df):
    odd = (F.col("symbol") % 10 == 3) & (F.dayofmonth("date") == 13)
    return df.withColumn(
        "date", F.when(odd, F.date_format("date", "yyyy/MM/dd")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    )


@query(
    "b3_price_view",
    "symbol:i date:d close:f volume:i marketCap:f",
    """SELECT p.*, marketCap FROM fx_price p LEFT JOIN fx_marketcap m ON m.symbol = p.symbol AND m.date = p.date
       WHERE NOT (p.symbol % 10 = 3 AND day(p.date) = 13)""",
)
def _(t):
    return views.price_view(_text_dates(t.price), _text_dates(t.marketcap))[0]


@query(
    "b3_price_view_rejects",
    "symbol:i date:s close:f",
    "SELECT symbol, strftime(date, '%Y/%m/%d') AS date, close FROM fx_price WHERE symbol % 10 = 3 AND day(date) = 13",
)
def _(t):
    return views.price_view(_text_dates(t.price), _text_dates(t.marketcap))[1]


def _statement_sql(join: str) -> str:
    return f"""SELECT symbol, date, coalesce(c.fillingDate, b.fillingDate, i.fillingDate) AS fillingDate,
          coalesce(i.calendarYear, b.calendarYear, c.calendarYear) AS calendarYear,
          coalesce(i.period, b.period, c.period) AS period, revenue, cost, netDebt, freeCashFlow
       FROM fx_income i {join} fx_balance b USING (symbol, date) {join} fx_cashflow c USING (symbol, date)"""


STATEMENT_SQL = _statement_sql("FULL JOIN")
_STATEMENT = "symbol:i date:d fillingDate:d calendarYear:i period:s revenue:f cost:f netDebt:f freeCashFlow:f"


def statement(t, how: str = "full"):
    return views.statement_view(t.income, t.balance, t.cashflow, how=how)


@query("b4_statement_view", _STATEMENT, STATEMENT_SQL)
def _(t):
    return statement(t)


@query("b4_statement_view_inner", _STATEMENT, _statement_sql("JOIN"))
def _(t):
    return statement(t, "inner")


def metric_sources(t):
    key = t.income.select("symbol", "date", (F.col("revenue") / F.col("cost")).alias("priceToCost"))
    growth = t.balance.select("symbol", "date", (F.col("netDebt") / 1000).alias("debtGrowth"))
    dcf = t.cashflow.select("symbol", "date", (F.col("freeCashFlow") / 12).alias("dcf"))
    return key, growth, dcf


_METRIC = """SELECT symbol, date, revenue / cost AS priceToCost, netDebt / 1000 AS debtGrowth, freeCashFlow / 12 AS dcf
       FROM fx_income {0} fx_balance USING (symbol, date) {1} fx_cashflow USING (symbol, date)"""


@query("b5_metrics_view", "symbol:i date:d priceToCost:f debtGrowth:f dcf:f", _METRIC.format("FULL JOIN", "LEFT JOIN"))
def _(t):
    return views.metrics_view(*metric_sources(t))


@query("b5_metrics_view_inner", "symbol:i date:d priceToCost:f debtGrowth:f dcf:f", _METRIC.format("JOIN", "JOIN"))
def _(t):
    return views.metrics_view(*metric_sources(t), how="inner")


@query(
    "b7_coalesce_suffixes",
    "symbol:i date:d fillingDate:d revenue:f",
    """SELECT symbol, date, coalesce(i.fillingDate, b.fillingDate) AS fillingDate, revenue
       FROM fx_income i FULL JOIN fx_balance b USING (symbol, date)""",
)
def _(t):
    left = t.income.select("symbol", "date", F.col("fillingDate").alias("fillingDate_x"), "revenue")
    right = t.balance.select(
        "symbol", "date", F.col("fillingDate").alias("fillingDate_y"), F.lit(1).alias("netDebt_x_y")
    )
    return views.coalesce_suffixes(left.join(right, ["symbol", "date"], "full"))


@query(
    "b8_join_drop_overlap",
    "symbol:i date:d fillingDate:d revenue:f netDebt:f",
    """SELECT symbol, date, b.fillingDate, revenue, netDebt FROM fx_income JOIN fx_balance b USING (symbol, date)""",
)
def _(t):
    return views.join_drop_overlap(t.income, t.balance, ["symbol", "date"], [("fillingDate", False)])


@query(
    "b9_dedup_first",
    "l_orderkey:i l_suppkey:i l_linenumber:i l_quantity:f",
    """SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_suppkey) = 1""",
)
def _(t):
    rows = t.raw("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    return views.dedup_first(
        rows, ["l_orderkey"], [("l_quantity", False), ("l_linenumber", True), ("l_suppkey", True)]
    )


@query(
    "b10_semi_filter",
    "symbol:i date:d close:f",
    "SELECT symbol, date, close FROM fx_price WHERE symbol IN (SELECT symbol FROM fx_symbol WHERE exchangeShortName = 'NYSE')",
)
def _(t):
    return views.semi_filter(t.price, t.symbol.where(F.col("exchangeShortName") == "NYSE"), ["symbol"])


@query(
    "b10_anti_filter",
    "symbol:i date:d close:f",
    "SELECT symbol, date, close FROM fx_price WHERE symbol NOT IN (SELECT symbol FROM fx_symbol WHERE exchangeShortName = 'NYSE')",
)
def _(t):
    return views.anti_filter(t.price, t.symbol.where(F.col("exchangeShortName") == "NYSE"), ["symbol"])


@query(
    "b11_map_sector",
    "symbol:i industry:s sector:s",
    """SELECT symbol, industry, CASE WHEN n_nationkey % 7 = 0 THEN NULL WHEN n_nationkey % 5 = 0 THEN 'LAST' ELSE r_name END AS sector
       FROM fx_symbol JOIN nation ON n_name = industry JOIN region ON n_regionkey = r_regionkey""",
)
def _(t):
    nation, region = t.raw("nation"), t.raw("region")
    known = nation.where(F.col("n_nationkey") % 7 != 0)
    first = known.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("industry"), F.col("r_name").alias("sector"), F.col("n_nationkey").alias("position")
    )
    repeated = known.where(F.col("n_nationkey") % 5 == 0).select(
        F.col("n_name").alias("industry"), F.lit("LAST").alias("sector"), (F.col("n_nationkey") + 100).alias("position")
    )
    return views.map_sector(t.symbol, first.unionByName(repeated))


@query(
    "b12_key_columns_first",
    "symbol:i date:d fillingDate:d revenue:f position_of_revenue:i",
    "SELECT symbol, date, fillingDate, revenue, 3 AS position_of_revenue FROM fx_income",
)
def _(t):
    out = key_columns_first(t.income.select("revenue", "symbol", "cost", "date", "fillingDate"))
    return out.withColumn("position_of_revenue", F.lit(out.columns.index("revenue")))


@query(
    "b13_clean_names",
    "symbol:i netdebt:f netdebt_2:f",
    "SELECT symbol, netDebt AS netdebt, netDebt * 2 AS netdebt_2 FROM fx_balance",
)
def _(t):
    return clean_names(
        t.balance.select(
            "symbol", F.col("netDebt").alias("net debt"), (F.col("netDebt") * 2).alias("net-debt")
        )
    )


@query(
    "b14_load_years",
    "symbol:i date:d close:f year:i",
    "SELECT symbol, date, close, year(date) AS year FROM fx_price WHERE year(date) BETWEEN 1997 AND 2000",
)
def _(t):
    path = scratch_path(t.spark, "price_by_year")
    tables.write_by_year(t.price, path, "date")
    return views.load_years(t.spark.read.parquet(path), 2000, 2000)


def bucketed_statements(t):
    """The three statements written in buckets by symbol and read back."""
    parts = {"income": t.income, "balance": t.balance, "cashflow": t.cashflow}
    return bucketed.load_bucketed(t.spark, [bucketed.save_bucketed(df, name) for name, df in parts.items()])


@query("b4_statement_view_bucketed", _STATEMENT, _statement_sql("JOIN"))
def _(t):
    return views.statement_view(*bucketed_statements(t), how="inner")


@query("b5_metrics_view_bucketed", "symbol:i date:d priceToCost:f debtGrowth:f dcf:f", _METRIC.format("LEFT JOIN", "LEFT JOIN"))
def _(t):
    income, balance, cashflow = bucketed_statements(t)
    key = income.select("symbol", "date", (F.col("revenue") / F.col("cost")).alias("priceToCost"))
    growth = balance.select("symbol", "date", (F.col("netDebt") / 1000).alias("debtGrowth"))
    dcf = cashflow.select("symbol", "date", (F.col("freeCashFlow") / 12).alias("dcf"))
    return key.join(growth, ["symbol", "date"], "left").join(dcf, ["symbol", "date"], "left")


@query(
    "e1_price_change_bucketed",
    "symbol:i date:d close:f marketCap:f diff1_close:f diff5_close:f n_days:i",
    """SELECT symbol, date, close, marketCap, CASE WHEN p1 > 0 THEN (close - p1) / p1 END AS diff1_close, CASE WHEN p5 > 0 THEN (close - p5) / p5 END AS diff5_close, n_days
       FROM (SELECT *, lag(close) OVER w AS p1, lag(close, 5) OVER w AS p5, count(*) OVER (PARTITION BY symbol) AS n_days
             FROM fx_price LEFT JOIN fx_marketcap USING (symbol, date) WINDOW w AS (PARTITION BY symbol ORDER BY date))""",
)
def _(t):
    names = [bucketed.save_bucketed(df, name) for name, df in {"price": t.price, "marketcap": t.marketcap}.items()]
    price, cap = bucketed.load_bucketed(t.spark, names)
    return bucketed_changes(price, cap)


def bucketed_changes(price, cap):
    """Join, per-symbol lags and per-symbol counts over one layout."""
    by = Window.partitionBy("symbol").orderBy("date")
    joined = price.join(cap, ["symbol", "date"], "left")
    joined = joined.withColumns({"prev1_close": F.lag("close", 1).over(by), "prev5_close": F.lag("close", 5).over(by)})
    days = price.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_days"))
    return features.pct_change(joined, ["close"], [1, 5]).join(days, "symbol")
