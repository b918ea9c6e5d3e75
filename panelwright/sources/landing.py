"""Landing data: reading, flattening, typing, bookkeeping and quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOAT_COLUMNS = ("dcf", "marketCap")
# Payload keys holding one of these words mark an API answer that is not data.
ERROR_WORDS = {"Limit Reach": "Limit", "Error Message": "Error"}
STALE_DAYS = 75
PAGE_BATCH = 8


def read_landing(
    spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None
) -> DataFrame:
    """A1: all Parquet and CSV files under ``path`` as one table; unreadable files are skipped.

    The schema is declared, so no pass is spent on inferring it, and only the
    wanted columns are read.  :func:`skipped_files` says what was skipped.
    """
    both = _landed(spark, path, schema)
    return both.select(*columns) if columns else both


def _landed(spark: SparkSession, path: str, schema: T.StructType, *extra: str) -> DataFrame:
    reader = lambda glob: (
        spark.read.schema(schema)
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", "true")
        .option("pathGlobFilter", glob)
    )
    parquet = reader("*.parquet").parquet(path).select("*", *extra)
    csv = reader("*.csv").option("header", "true").csv(path).select("*", *extra)
    return parquet.unionByName(csv)


def skipped_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1: ``(path, bytes)`` of the files under ``path`` that give no row: unreadable, or empty.

    A listing without contents against the files rows came from; one row per file is shuffled.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{parquet,csv}")
        .load(path)
        .select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes"))
    )
    read = _landed(spark, path, schema, "_metadata.file_path").select(F.col("file_path").alias("path")).distinct()
    return listed.join(read, "path", "left_anti")


def _spread(df: DataFrame, column: str) -> DataFrame:
    """Replace a struct column by its fields; a clashing name gets ``.column`` appended."""
    fields = df.schema[column].dataType.fieldNames()
    others = [c for c in df.columns if c != column]
    return df.select(
        *[F.col(f"`{c}`") for c in others],
        *[F.col(f"`{column}`.`{f}`").alias(f"{f}.{column}" if f in others else f) for f in fields],
    )


def _first_list(df: DataFrame) -> T.StructField | None:
    return next((f for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)), None)


def flatten_json(df: DataFrame, column: str, schema: T.DataType | str, expand_all: bool = False) -> DataFrame:
    """A2: JSON text to columns; the first list is exploded and its objects spread.

    A top-level array is exploded first.  With ``expand_all`` further lists are
    flattened the same way.
    """
    parsed = df.withColumn(column, F.from_json(column, schema))
    if isinstance(parsed.schema[column].dataType, T.ArrayType):
        parsed = parsed.withColumn(column, F.explode_outer(column))
    out = _spread(parsed, column)
    while (lists := _first_list(out)) is not None:
        name = lists.name
        out = out.withColumn(name, F.explode_outer(f"`{name}`"))
        if isinstance(lists.dataType.elementType, T.StructType):
            out = _spread(out, name)
        if not expand_all:
            break
    return out


def coerce_types(df: DataFrame, float_columns: Sequence[str] = FLOAT_COLUMNS) -> DataFrame:
    """A3: empty text becomes null, the named columns become double (null where not a number)."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            c = F.nullif(c, F.lit(""))
        if field.name in float_columns:
            c = c.try_cast("double")
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(field.name))
    return df.select(*out)


def fetch_manifest(
    symbols: DataFrame,
    landed: DataFrame,
    mode: str | None,
    start_year: int,
    end_year: int,
    first_page: int = 0,
) -> DataFrame:
    """A4: every ``(symbol, postfix)`` still to land, with its request parameters.

    ``mode`` is year, quarter, period, from_to, date, page or None.  Each symbol
    explodes its own requests; what already landed (with data or as an empty
    marker) is removed by an anti join.
    """
    year = F.explode(F.sequence(F.lit(start_year), F.lit(end_year)))
    keys = symbols.select("symbol").where(F.col("symbol").isNotNull())
    if mode in ("quarter", "period"):
        letter = "Q" if mode == "quarter" else "P"
        wanted = keys.withColumn("year", year).withColumn(mode, F.explode(F.sequence(F.lit(1), F.lit(4))))
        postfix = F.concat(F.lit("_"), F.col("year"), F.lit(f"_{letter}"), F.col(mode))
    elif mode == "year":
        wanted = keys.withColumn("year", year)
        postfix = F.concat(F.lit("_"), F.col("year"))
    elif mode == "from_to":
        wanted = keys.withColumn("year", year)
        wanted = wanted.select(
            "symbol",
            F.make_date("year", F.lit(1), F.lit(1)).alias("from"),
            F.make_date("year", F.lit(12), F.lit(31)).alias("to"),
        )
        postfix = F.concat(F.lit("_"), F.year("from"))
    elif mode == "date":
        days = F.sequence(F.lit(f"{start_year}-01-01").cast("date"), F.lit(f"{end_year}-12-31").cast("date"))
        wanted = keys.withColumn("date", F.explode(days))
        postfix = F.concat(F.lit("_"), F.date_format("date", "yyyy-MM-dd"))
    elif mode == "page":
        pages = F.sequence(F.lit(first_page), F.lit(first_page + PAGE_BATCH - 1))
        wanted = keys.withColumn("page", F.explode(pages))
        postfix = F.concat(F.lit("_"), F.col("page"))
    elif mode is None:
        wanted, postfix = keys, F.lit("")
    else:
        raise ValueError(f"unknown mode {mode}")
    return wanted.withColumn("postfix", postfix).join(
        landed.select("symbol", "postfix"), ["symbol", "postfix"], "left_anti"
    )


def stale_symbols(landed: DataFrame, active: DataFrame, as_of: Column, days: int = STALE_DAYS) -> DataFrame:
    """A5: active symbols whose newest date is ``days`` or more old, or that have none."""
    newest = landed.groupBy("symbol").agg(F.max("date").alias("last_date"))
    joined = active.select("symbol").distinct().join(newest, "symbol", "left")
    age = F.datediff(as_of, "last_date")
    return joined.where(F.col("last_date").isNull() | (age >= days)).withColumn("age", age)


def current_year_rows(landed: DataFrame, as_of: Column) -> DataFrame:
    """A5, unconditional part: landed (symbol, year) pairs of the running year."""
    return landed.where(F.year("date") == F.year(as_of)).select("symbol", F.year("date").alias("year")).distinct()


def quarantine(df: DataFrame, payload: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good, bad, retry); payloads with an error key are set aside and listed for refetch."""
    keys = F.coalesce(F.json_object_keys(payload), F.array())
    kinds = F.array_compact(
        F.array(
            *[
                F.when(F.array_join(keys, "\n").contains(word), F.lit(kind))
                for kind, word in ERROR_WORDS.items()
            ]
        )
    )
    flagged = df.withColumn("error_type", F.nullif(F.array_join(kinds, ", "), F.lit("")))
    good = flagged.where(F.col("error_type").isNull()).drop("error_type")
    bad = flagged.where(F.col("error_type").isNotNull())
    retry = bad.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bad"), F.max("error_type").alias("error_type"))
    return good, bad, retry
