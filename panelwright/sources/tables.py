"""Saved tables: writing, reading, statistics and incremental building."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMPRESSIONS = ("snappy", "gzip", "zstd", "brotli")
SAMPLE_ROWS = 100

Filter = tuple[str, str, object]


def save_table(
    df: DataFrame,
    path: str,
    compression: str = "snappy",
    partition_cols: Sequence[str] = (),
    sample_size: int = SAMPLE_ROWS,
    sample_path: str | None = None,
    validate: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame | None:
    """Write Parquet, a small CSV sample, and validate what was written.

    Partitioned tables are rebalanced on the partition columns, so a partition
    gets few files while a hot one is still split.  Returns the findings of
    ``validate`` over the written table, or None for a partitioned table.
    """
    if compression not in COMPRESSIONS:
        raise ValueError(f"compression must be one of {COMPRESSIONS}")
    out = df
    if partition_cols:
        out = out.hint("rebalance", *[F.col(c) for c in partition_cols])
    writer = out.write.mode("overwrite").option("compression", compression)
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    writer.parquet(path)
    written = df.sparkSession.read.parquet(path)
    if sample_path is not None:
        written.limit(sample_size).write.mode("overwrite").option("header", "true").csv(sample_path)
    if validate is None or partition_cols:
        return None
    return validate(written)


def _condition(column: str, op: str, value: object) -> Column:
    c = F.col(column)
    tests: dict[str, Callable[[], Column]] = {
        "=": lambda: c == value,
        "==": lambda: c == value,
        "!=": lambda: c != value,
        "<": lambda: c < value,
        "<=": lambda: c <= value,
        ">": lambda: c > value,
        ">=": lambda: c >= value,
        "in": lambda: c.isin(list(value)),
        "not in": lambda: ~c.isin(list(value)),
    }
    return tests[op]()


def load_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    filters: Sequence[Filter] = (),
) -> DataFrame:
    """A file or partitioned folder with column and row filters, all pushed into the scan.

    A missing path is an error when the table is read.
    """
    df = spark.read.parquet(path)
    if filters:
        df = df.where(reduce(lambda a, b: a & b, [_condition(*f) for f in filters]))
    return df.select(*columns) if columns else df


def table_stats(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """A10: rows, columns and bytes of each table, one row per table.

    Rows come from file footers and sizes from the file listing; no data page
    or file content is read.
    """
    parts = []
    for name, path in sorted(paths.items()):
        table = spark.read.parquet(path)
        size = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(path)
            .agg(F.sum("length"))
            .scalar()
        )
        parts.append(
            table.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("table"), "n_rows", F.lit(len(table.columns)).alias("n_columns"), size.alias("n_bytes")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def footer_stats(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A10: ``column, n_rows, lowest, highest`` of numeric and date columns from the file footers alone.

    Count, minimum and maximum are pushed into the scan, which then reads no
    page.  That is a matter of planning, so it has a session of its own.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    table = own.read.parquet(path)
    ends = [f(F.col(f"`{c}`")) for c in columns for f in (F.min, F.max)]
    n, *found = table.agg(F.count(F.lit(1)), *ends).first()
    text = [None if v is None else str(v) for v in found]
    rows = [(c, n, text[2 * i], text[2 * i + 1]) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "column string, n_rows long, lowest string, highest string")


def table_info(spark: SparkSession, path: str) -> DataFrame:
    """A10: column names, types and nullability of one table."""
    fields = spark.read.parquet(path).schema.fields
    return spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(fields)],
        "position int, column string, type string, nullable boolean",
    )


def list_tables(spark: SparkSession, root: str) -> DataFrame:
    """A10: the tables under a folder with their file count and bytes."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(root)
        .select("path", "length")
    )
    base = root.rstrip("/").rsplit("/", 1)[-1]
    name = F.regexp_extract("path", rf"/{base}/([^/]+?)(?:\.parquet)?(?:/|$)", 1)
    return files.groupBy(name.alias("table")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes")
    )


def write_by_year(
    df: DataFrame,
    path: str,
    date_column: str = "date",
    first_year: int | None = None,
    last_year: int | None = None,
) -> None:
    """One folder per calendar year, ``first_year - 1 .. last_year`` when given."""
    out = df.withColumn("year", F.year(date_column))
    if first_year is not None:
        out = out.where(F.col("year") >= first_year - 1)
    if last_year is not None:
        out = out.where(F.col("year") <= last_year)
    out.hint("rebalance", F.col("year")).write.mode("overwrite").partitionBy("year").parquet(path)


def build_missing(
    wanted: DataFrame, key: str, path: str, builder: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Build and add only the partitions of ``path`` that do not exist yet.

    ``wanted`` has one row per key; ``builder`` gets the missing ones and
    returns rows with that key.  Writing replaces partitions of the same key
    only, so a rerun after a failure is safe.
    """
    spark = wanted.sparkSession
    try:
        # The partition values stand in the file paths: a listing, no file is opened.
        files = (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        )
        value = F.url_decode(F.regexp_extract("path", f"/{key}=([^/]+)/", 1))
        have = files.select(value.cast(wanted.schema[key].dataType).alias(key)).distinct()
        missing = wanted.join(have, key, "left_anti")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        missing = wanted
    (
        builder(missing)
        .hint("rebalance", F.col(key))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .parquet(path)
    )
    return spark.read.parquet(path)


def write_reports(
    path: str, picks: DataFrame, periods: DataFrame, ranks: DataFrame, rank_periods: int
) -> dict[str, str]:
    """EVAL (picks and period totals), RANK (first ``rank_periods`` + 1 periods), AVG (all rank rows).

    ``periods`` holds one row per period start and is numbered by it.
    """
    numbered = periods.withColumn("__i", F.row_number().over(Window.orderBy("period_start")) - 1)
    early = numbered.where(F.col("__i") <= rank_periods).select("period_start")
    out = {
        "eval_picks": (picks, ["period_start"]),
        "eval_periods": (periods, []),
        "rank": (ranks.join(early, "period_start", "left_semi"), ["period_start"]),
        "avg": (ranks, []),
    }
    written = {}
    for name, (df, by) in out.items():
        written[name] = f"{path}/{name}"
        mode = "append" if name == "avg" else "overwrite"
        writer = df.hint("rebalance", *[F.col(c) for c in by]) if by else df
        writer.write.mode(mode).option("header", "true").partitionBy(*by).csv(written[name])
    return written
