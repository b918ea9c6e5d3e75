from datetime import date

import pytest

from panelwright.operators import asof


def day(text):
    return date.fromisoformat(text)


def calendar(spark, *days):
    return spark.createDataFrame([(day(d),) for d in days], "as_of date")


def test_calendar_steps_do_not_drift_and_stop_at_last_price(spark):
    prices = spark.createDataFrame([(day("2021-04-29"),)], "date date")
    got = [r.as_of for r in asof.rebalance_calendar(spark, 2021, 2021, 1, prices, 0, start_day=31).collect()]
    assert got == [day("2021-01-31"), day("2021-02-28"), day("2021-03-31")]
    assert asof.rebalance_calendar(spark, 2022, 2022, 1, prices, 0).count() == 0


def test_trade_date_bounds(spark):
    prices = spark.createDataFrame([(day("2020-01-01"),), (day("2020-03-05"),)], "date date")
    cal = calendar(spark, "2020-01-11", "2020-01-12", "2020-03-05")
    got = {r.as_of: r.trade_date for r in asof.trade_dates(cal, prices).collect()}
    assert got == {day("2020-01-11"): day("2020-01-01"), day("2020-03-05"): day("2020-03-05")}


def test_next_rebalance_is_strictly_after(spark):
    cal = calendar(spark, "2020-01-01", "2020-04-01", "2020-07-01")
    filings = spark.createDataFrame(
        [(i, day(d) if d else None) for i, d in enumerate(["1950-01-01", "2019-12-31", "2020-01-01", "2020-06-30", "2020-07-01", "2031-01-01", None])],
        "id int, fillingDate date",
    )
    got = {r.id: r.rebalance_date for r in asof.next_rebalance(filings, cal).collect()}
    assert got == {
        0: day("2020-01-01"), 1: day("2020-01-01"), 2: day("2020-04-01"), 3: day("2020-07-01"), 4: None, 5: None, 6: None,
    }


def test_latest_filing_window_ends_are_included(spark):
    filings = spark.createDataFrame(
        [("a", day("2020-02-29"), day("2019-12-31"), 1), ("b", day("2020-02-28"), day("2019-12-31"), 2), ("c", day("2020-08-31"), day("2020-06-30"), 3),
         ("d", day("2020-09-01"), day("2020-06-30"), 4), ("c", day("2020-05-31"), day("2020-03-31"), 5)],
        "symbol string, fillingDate date, date date, v int",
    )
    got = {r.symbol: r.v for r in asof.latest_filing(filings, calendar(spark, "2020-08-31")).collect()}
    assert got == {"a": 1, "c": 3}


@pytest.mark.parametrize("quarters, kept", [(11, 0), (12, 12), (13, 12)])
def test_last_n_window(spark, quarters, kept):
    df = spark.createDataFrame([("s", i) for i in range(quarters)], "symbol string, ordinal int")
    got = sorted(r.ordinal for r in asof.last_n_window(df, 100).collect())
    assert got == list(range(quarters))[-kept:] if kept else got == []


def test_universe_includes_the_delisting_day(spark):
    symbols = spark.createDataFrame([("a", day("2020-04-01")), ("b", None)], "symbol string, delistedDate date")
    got = {(str(r.as_of), r.symbol) for r in asof.active_at_dates(symbols, calendar(spark, "2020-04-01", "2020-04-02")).collect()}
    assert got == {("2020-04-01", "a"), ("2020-04-01", "b"), ("2020-04-02", "b")}


def test_panel_never_looks_ahead(tables):
    from panelwright.catalog.asof_queries import panel

    rows = panel(tables)
    assert rows.count() == rows.select("as_of", "symbol").distinct().count() > 0
    assert rows.where("trade_date > as_of OR fillingDate > as_of").count() == 0
