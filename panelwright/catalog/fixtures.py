"""Panel views over the star-schema tables, in Spark and in SQL.

A supplier plays a symbol, its shipments per day the traded price, its
shipments per quarter the filing.  See FIXTURES.md for the mapping.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.asof import trading_days

MONEY = "decimal(18,2)"


def _cents(name: str) -> Column:
    """Money as whole cents: exact sums on long arithmetic."""
    return F.round(F.col(name) * 100).cast("long")


class Tables:
    """The given tables under ``sf_dir`` and the panel views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def symbol(self) -> DataFrame:
        key = F.col("s_suppkey")
        return (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                key.alias("symbol"),
                F.col("n_name").alias("industry"),
                F.col("r_name").alias("sector"),
                F.when(key % 3 == 0, "NASDAQ").when(key % 3 == 1, "NYSE").otherwise("OTHER")
                .alias("exchangeShortName"),
                F.date_add(F.lit("1990-01-01").cast("date"), (key % 1000).cast("int")).alias("ipoDate"),
                F.when(
                    key % 10 == 7,
                    F.date_add(F.lit("1998-01-01").cast("date"), (key % 900).cast("int")),
                ).alias("delistedDate"),
            )
        )

    @cached_property
    def price(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"))
            .agg(
                (F.sum(_cents("l_extendedprice")) / 100 / F.sum("l_quantity")).alias("close"),
                F.sum("l_quantity").cast("long").alias("volume"),
            )
        )

    @cached_property
    def days(self) -> DataFrame:
        return trading_days(self.price)

    @cached_property
    def marketcap(self) -> DataFrame:
        days = (
            self.raw("lineitem")
            .select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"))
            .where(F.dayofmonth("date") % 2 == 0)
            .distinct()
        )
        cap = self.raw("supplier").select(
            F.col("s_suppkey").alias("symbol"), (F.col("s_acctbal") * 1000).alias("marketCap")
        )
        return days.join(cap, "symbol").select("symbol", "date", "marketCap")

    @cached_property
    def filing(self) -> DataFrame:
        cents, flag = _cents("l_extendedprice"), F.col("l_returnflag")
        percent = (100 - F.round(F.col("l_discount") * 100)).cast("decimal(3,0)")
        return (
            self.raw("lineitem")
            .groupBy(
                F.col("l_suppkey").alias("symbol"),
                F.year("l_shipdate").cast("long").alias("calendarYear"),
                F.quarter("l_shipdate").cast("long").alias("q"),
            )
            .agg(
                (F.sum(F.col("l_extendedprice").cast(MONEY) * percent).cast("double") / 100).alias("revenue"),
                (F.sum(cents) / 100 * 0.6).alias("cost"),
                (F.sum(F.when(flag == "N", cents).otherwise(-cents)) / 100).alias("freeCashFlow"),
                (F.sum(F.when(flag == "R", cents).when(flag == "A", -cents).otherwise(0)) / 100).alias("netDebt"),
            )
            .withColumn("date", F.last_day(F.make_date(F.col("calendarYear").cast("int"), (F.col("q") * 3).cast("int"), F.lit(1))))
            .select(
                "symbol",
                "date",
                F.date_add("date", (20 + F.col("symbol") % 50).cast("int")).alias("fillingDate"),
                "calendarYear",
                F.concat(F.lit("Q"), F.col("q").cast("string")).alias("period"),
                "revenue",
                "cost",
                "freeCashFlow",
                "netDebt",
            )
        )

    def _without(self, modulus: int, *columns: str) -> DataFrame:
        g = F.col("calendarYear") * 4 + F.substring("period", 2, 1).cast("long")
        return self.filing.where((F.col("symbol") + g) % modulus != 0).select(
            "symbol", "date", "fillingDate", "calendarYear", "period", *columns
        )

    @cached_property
    def income(self) -> DataFrame:
        return self._without(9, "revenue", "cost")

    @cached_property
    def balance(self) -> DataFrame:
        return self._without(7, "netDebt")

    @cached_property
    def cashflow(self) -> DataFrame:
        return self._without(5, "freeCashFlow")

    @cached_property
    def prediction(self) -> DataFrame:
        """Orders as scored rows: four probabilities, two predictions, a realised return."""
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        probs = [(((37 + 10 * i) * c + i * k) % 1000 / 1000).alias(f"p{i}") for i in range(4)]
        preds = [(((7919 + 2 * i) * k + i * c) % 2001 / 1000 - 1).alias(f"pred{i}") for i in range(2)]
        return self.raw("orders").select(
            k.alias("id"),
            (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("long").alias("cohort"),
            F.to_date("o_orderdate").alias("date"),
            F.col("o_orderpriority").alias("sector"),
            *probs,
            *preds,
            ((k * 104729 + c * 31) % 2001 / 1000 - 1).alias("ret"),
            F.col("o_totalprice").alias("amount"),
        )

    @cached_property
    def payload(self) -> DataFrame:
        """Events as API payloads; an ``error`` event plays the API's error message."""
        return self.raw("events").select(
            F.col("event_id"),
            F.col("user_id").alias("symbol"),
            F.when(
                F.col("event_type") == "error",
                F.when(F.col("event_id") % 2 == 0, '{"Error Message": "bad"}').otherwise('{"Limit Reach": "slow"}'),
            ).otherwise(F.col("props")).alias("payload"),
        )


# The same views for the SQL engine, in dependency order.
FIXTURE_SQL = {
    "fx_symbol": """
        SELECT s_suppkey AS symbol, n_name AS industry, r_name AS sector,
               CASE s_suppkey % 3 WHEN 0 THEN 'NASDAQ' WHEN 1 THEN 'NYSE' ELSE 'OTHER' END AS exchangeShortName,
               CAST(DATE '1990-01-01' + CAST(s_suppkey % 1000 AS INTEGER) AS DATE) AS ipoDate,
               CASE WHEN s_suppkey % 10 = 7
                    THEN CAST(DATE '1998-01-01' + CAST(s_suppkey % 900 AS INTEGER) AS DATE) END AS delistedDate
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "fx_price": """
        SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
               CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / SUM(l_quantity) AS close,
               CAST(SUM(l_quantity) AS BIGINT) AS volume
        FROM lineitem GROUP BY ALL""",
    "fx_marketcap": """
        SELECT symbol, date, s_acctbal * 1000 AS marketCap
        FROM fx_price JOIN supplier ON s_suppkey = symbol WHERE day(date) % 2 = 0""",
    "fx_filing": """
        SELECT symbol, date, CAST(date + CAST(20 + symbol % 50 AS INTEGER) AS DATE) AS fillingDate,
               calendarYear, 'Q' || q AS period, revenue, cost, freeCashFlow, netDebt
        FROM (SELECT l_suppkey AS symbol, year(l_shipdate) AS calendarYear, quarter(l_shipdate) AS q,
                     CAST(last_day(make_date(year(l_shipdate), 3 * quarter(l_shipdate), 1)) AS DATE) AS date,
                     CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(100 - round(l_discount * 100) AS DECIMAL(3,0))) AS DOUBLE) / 100 AS revenue,
                     CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) * 0.6 AS cost,
                     CAST(SUM(CASE WHEN l_returnflag = 'N' THEN 1 ELSE -1 END * CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS freeCashFlow,
                     CAST(SUM(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END * CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS netDebt
              FROM lineitem GROUP BY ALL)""",
    "fx_income": """
        SELECT symbol, date, fillingDate, calendarYear, period, revenue, cost FROM fx_filing
        WHERE (symbol + calendarYear * 4 + CAST(period[2] AS INTEGER)) % 9 <> 0""",
    "fx_balance": """
        SELECT symbol, date, fillingDate, calendarYear, period, netDebt FROM fx_filing
        WHERE (symbol + calendarYear * 4 + CAST(period[2] AS INTEGER)) % 7 <> 0""",
    "fx_cashflow": """
        SELECT symbol, date, fillingDate, calendarYear, period, freeCashFlow FROM fx_filing
        WHERE (symbol + calendarYear * 4 + CAST(period[2] AS INTEGER)) % 5 <> 0""",
    "fx_prediction": """
        SELECT o_orderkey AS id, year(o_orderdate) * 4 + quarter(o_orderdate) AS cohort,
               CAST(o_orderdate AS DATE) AS date, o_orderpriority AS sector,
               (37 * o_custkey) % 1000 / 1000 AS p0, (47 * o_custkey + o_orderkey) % 1000 / 1000 AS p1,
               (57 * o_custkey + 2 * o_orderkey) % 1000 / 1000 AS p2, (67 * o_custkey + 3 * o_orderkey) % 1000 / 1000 AS p3,
               (7919 * o_orderkey) % 2001 / 1000 - 1 AS pred0, (7921 * o_orderkey + o_custkey) % 2001 / 1000 - 1 AS pred1,
               (o_orderkey * 104729 + o_custkey * 31) % 2001 / 1000 - 1 AS ret, o_totalprice AS amount
        FROM orders""",
    "fx_payload": """
        SELECT event_id, user_id AS symbol,
               CASE WHEN event_type = 'error'
                    THEN CASE WHEN event_id % 2 = 0 THEN '{"Error Message": "bad"}' ELSE '{"Limit Reach": "slow"}' END
                    ELSE props END AS payload
        FROM events""",
}
