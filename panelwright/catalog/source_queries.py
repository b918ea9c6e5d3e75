"""Queries for sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.catalog.asof_queries import calendar
from panelwright.catalog.registry import query
from panelwright.operators import asof
from panelwright.session import scratch_path
from panelwright.sources import landing, tables
from panelwright.streaming.ingest import incremental_ingest


@query(
    "a1_read_landing",
    "symbol:i name:s acctbal:f extra:s",
    """SELECT s_suppkey AS symbol, s_name AS name, s_acctbal AS acctbal, NULL AS extra FROM supplier
       UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""",
)
def _(t):
    path = scratch_path(t.spark, "landing")
    t.raw("supplier").select(
        F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal")
    ).write.parquet(f"{path}/a")
    wide = t.raw("customer").select(
        F.col("c_custkey").alias("symbol"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("extra"),
    )
    wide.write.option("header", "true").csv(f"{path}/b")
    schema = T.StructType.fromDDL("symbol long, name string, acctbal double, extra string")
    return landing.read_landing(t.spark, path, schema, ["symbol", "name", "acctbal", "extra"])


@query(
    "a2_flatten_json",
    "event_id:i k:i",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def _(t):
    return landing.flatten_json(t.raw("events").select("event_id", "props"), "props", "struct<k: bigint>")


@query(
    "a2_flatten_json_nested",
    "symbol:i day:i price:f date:s date_of_row:s",
    """SELECT o_orderkey AS symbol, d AS day, o_totalprice + d AS price, o_orderpriority AS date, 'd' || d AS date_of_row
       FROM orders, (VALUES (1), (2)) v(d)""",
)
def _(t):
    day = lambda i: F.struct(
        F.lit(i).alias("day"), (F.col("o_totalprice") + i).alias("price"), F.lit(f"d{i}").alias("date")
    )
    texts = t.raw("orders").select(
        F.to_json(
            F.struct(
                F.col("o_orderkey").alias("symbol"),
                F.col("o_orderpriority").alias("date"),
                F.array(day(1), day(2)).alias("rows"),
            )
        ).alias("js")
    )
    schema = "struct<symbol: bigint, date: string, rows: array<struct<day: int, price: double, date: string>>>"
    return landing.flatten_json(texts, "js", schema).withColumnRenamed("date.rows", "date_of_row")


@query(
    "a3_coerce_types",
    "symbol:i marketCap:f dcf:f industry:s",
    """SELECT c_custkey AS symbol, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS marketCap,
              CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS dcf,
              CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS industry FROM customer""",
)
def _(t):
    key = F.col("c_custkey")
    raw = t.raw("customer").select(
        key.alias("symbol"),
        F.when(key % 7 == 0, "").otherwise(F.col("c_acctbal").cast("string")).alias("marketCap"),
        F.when(key % 5 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string")).alias("dcf"),
        F.when(key % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("industry"),
    )
    return landing.coerce_types(raw)


@query(
    "a4_fetch_manifest_quarter",
    "symbol:i year:i quarter:i postfix:s",
    """SELECT symbol, year, quarter, postfix FROM (
         SELECT symbol, year, quarter, '_' || year || '_Q' || quarter AS postfix
         FROM fx_symbol, range(1995, 2003) y(year), range(1, 5) q(quarter)) w
       WHERE NOT EXISTS (SELECT 1 FROM fx_income i WHERE i.symbol = w.symbol
                         AND i.calendarYear = w.year AND i.period = 'Q' || w.quarter)""",
)
def _(t):
    landed = t.income.select("symbol", F.concat(F.lit("_"), "calendarYear", F.lit("_"), "period").alias("postfix"))
    return landing.fetch_manifest(t.symbol, landed, "quarter", 1995, 2002)


@query(
    "a4_fetch_manifest_date",
    "symbol:i date:d postfix:s",
    """SELECT symbol, date, '_' || date AS postfix FROM (
         SELECT symbol, CAST(unnest(generate_series(DATE '1999-01-01', DATE '1999-12-31', INTERVAL 1 DAY)) AS DATE) AS date
         FROM fx_symbol) w
       ANTI JOIN fx_price USING (symbol, date)""",
)
def _(t):
    landed = t.price.select("symbol", F.concat(F.lit("_"), F.date_format("date", "yyyy-MM-dd")).alias("postfix"))
    return landing.fetch_manifest(t.symbol, landed, "date", 1999, 1999)


@query(
    "a5_stale_symbols",
    "symbol:i last_date:d age:i",
    """SELECT symbol, last_date, DATE '2001-11-05' - last_date AS age FROM (SELECT symbol FROM fx_symbol WHERE delistedDate IS NULL)
       LEFT JOIN (SELECT symbol, max(date) AS last_date FROM fx_price WHERE symbol % 4 <> 1 AND year(date) < 2001 - symbol % 2
                  GROUP BY symbol) USING (symbol)
       WHERE last_date IS NULL OR DATE '2001-11-05' - last_date >= 75""",
)
def _(t):
    key = F.col("symbol")
    seen = t.price.where((key % 4 != 1) & (F.year("date") < 2001 - key % 2))
    active = t.symbol.where(F.col("delistedDate").isNull())
    return landing.stale_symbols(seen, active, F.lit("2001-11-05").cast("date"))


@query(
    "a5_current_year_rows",
    "symbol:i year:i",
    "SELECT DISTINCT symbol, 2001 AS year FROM fx_price WHERE year(date) = 2001",
)
def _(t):
    return landing.current_year_rows(t.price, F.lit("2001-11-05").cast("date"))


_ERROR_SQL = """CASE WHEN payload LIKE '{"Limit%' THEN 'Limit Reach' WHEN payload LIKE '{"Error%' THEN 'Error Message' END"""


@query(
    "a6_quarantine",
    "event_id:i symbol:i status:s error_type:s",
    f"""SELECT event_id, symbol, CASE WHEN e IS NULL THEN 'good' ELSE 'bad' END AS status, e AS error_type
        FROM (SELECT *, {_ERROR_SQL} AS e FROM fx_payload)""",
)
def _(t):
    good, bad, _retry = landing.quarantine(t.payload, "payload")
    return (
        good.select("event_id", "symbol", F.lit("good").alias("status"), F.lit(None).cast("string").alias("error_type"))
        .unionByName(bad.select("event_id", "symbol", F.lit("bad").alias("status"), "error_type"))
    )


@query(
    "a6_retry_list",
    "symbol:i n_bad:i error_type:s",
    f"SELECT symbol, count(*) AS n_bad, max(e) AS error_type FROM (SELECT *, {_ERROR_SQL} AS e FROM fx_payload) WHERE e IS NOT NULL GROUP BY symbol",
)
def _(t):
    return landing.quarantine(t.payload, "payload")[2]


@query(
    "a7_incremental_ingest",
    "event_id:i user_id:i event_type:s value:f",
    "SELECT event_id, user_id, event_type, value FROM events",
)
def _(t):
    root = scratch_path(t.spark, "ingest")
    schema = T.StructType.fromDDL("event_id long, user_id long, event_type string, value double")
    for _run in range(2):
        # The second run finds no new file and adds nothing.
        out = incremental_ingest(t.spark, t.sf_dir, f"{root}/out", f"{root}/state", schema, "events.parquet")
    return out


@query(
    "a8_save_table",
    "l_returnflag:s n:i quantity:f",
    "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag",
)
def _(t):
    path = scratch_path(t.spark, "saved")
    df = t.raw("lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    tables.save_table(df, path, "zstd", ["l_returnflag"], sample_path=path + "-sample")
    return t.spark.read.parquet(path).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )


@query(
    "a9_load_table",
    "l_orderkey:i l_linenumber:i l_quantity:f",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 30
       AND l_returnflag IN ('A', 'R') AND l_linestatus NOT IN ('F') AND l_linenumber <> 3""",
)
def _(t):
    return tables.load_table(
        t.spark,
        t.path("lineitem"),
        ["l_orderkey", "l_linenumber", "l_quantity"],
        [
            ("l_quantity", ">=", 10.0),
            ("l_quantity", "<", 30.0),
            ("l_returnflag", "in", ["A", "R"]),
            ("l_linestatus", "not in", ["F"]),
            ("l_linenumber", "!=", 3),
        ],
    )


_STATS = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")


_ALL = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(
    "a10_table_stats",
    "table:s n_rows:i n_columns:i has_bytes:i",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table, count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE {n})) AS n_columns, 1 AS has_bytes FROM {n}"
        for n in _STATS
    ),
)
def _(t):
    out = tables.table_stats(t.spark, {n: t.path(n) for n in _STATS})
    return out.withColumn("has_bytes", (F.col("n_bytes") > 0).cast("int"))


@query(
    "a10_list_tables",
    "table:s n_files:i n_rows:i",
    " UNION ALL ".join(f"SELECT '{n}' AS \"table\", 1 AS n_files, count(*) AS n_rows FROM {n}" for n in _ALL),
)
def _(t):
    """The tables found under the folder, each with its rows."""
    listed = tables.list_tables(t.spark, t.sf_dir)
    names = [r["table"] for r in listed.select("table").collect()]
    return listed.drop("n_bytes").join(tables.table_stats(t.spark, {n: t.path(n) for n in names}), "table")


@query(
    "a10_footer_stats",
    "column:s n_rows:i lowest:s highest:s",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, CAST(min({c}) AS VARCHAR) AS lowest, CAST(max({c}) AS VARCHAR) AS highest FROM orders"""
        for c in ("o_orderkey", "o_custkey")
    ),
)
def _(t):
    return tables.footer_stats(t.spark, t.path("orders"), ["o_orderkey", "o_custkey"])


@query(
    "a10_table_info",
    "table:s position:i column:s type:s",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "table", row_number() OVER () - 1 AS position, column_name AS "column",
            CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(column_type) END AS type
            FROM (DESCRIBE {n})"""
        for n in ("documents", "embeddings", "lineitem", "conversations")
    ),
)
def _(t):
    """Columns and types as the files have them."""
    parts = [tables.table_info(t.spark, t.path(n)).withColumn("table", F.lit(n)) for n in ("documents", "embeddings", "lineitem", "conversations")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "a12_write_by_year",
    "year:i n:i volume:i",
    "SELECT year(date) AS year, count(*) AS n, sum(volume) AS volume FROM fx_price WHERE year(date) BETWEEN 1996 AND 2000 GROUP BY ALL",
)
def _(t):
    path = scratch_path(t.spark, "by_year")
    tables.write_by_year(t.price, path, "date", 1997, 2000)
    return t.spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query(
    "a13_build_missing",
    "as_of:d n:i symbols:i",
    """SELECT as_of, count(*) AS n, sum(symbol) AS symbols FROM (
         SELECT CAST(d AS DATE) AS as_of FROM (SELECT unnest(generate_series(DATE '1996-01-01', DATE '2001-10-01', INTERVAL 3 MONTH)) AS d))
       JOIN fx_filing ON fillingDate BETWEEN CAST(as_of - INTERVAL 6 MONTH AS DATE) AND as_of GROUP BY as_of""",
)
def _(t):
    path = scratch_path(t.spark, "built")
    cal = calendar(t)

    def build(missing):
        days = asof.covered_days(missing, F.add_months("as_of", -6), F.col("as_of"))
        return t.filing.join(days, F.col("fillingDate") == F.col("day")).select("as_of", "symbol", "date")

    tables.build_missing(cal.where(F.col("as_of") < "1999-01-01"), "as_of", path, build)
    out = tables.build_missing(cal, "as_of", path, build)
    return out.groupBy("as_of").agg(F.count(F.lit(1)).alias("n"), F.sum("symbol").alias("symbols"))
