"""Helpers shared by the text operators."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.session import scratch_path

# The six characters that separate words: space, tab, \n, \v, \f, \r.
SPACE = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CHAR = r"[^\x20\x09-\x0D]"


def sent_by_value(module: str) -> None:
    """Ship the functions of a module with the tasks, so executors need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs only a reread, and gives the
    planner the real size of what follows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def doc_key(docs: DataFrame) -> list[Column]:
    """Identity and order of a document row: id (null first), then a hash of the text; never null."""
    text = F.coalesce(docs["text"], F.lit(""))
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("__d"), F.xxhash64(text).alias("__t")]


def words(text: Column) -> Column:
    """The words of a text: maximal runs of anything but the six separators; none for null."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_CLASS + "+")))


def running_totals(lengths: Column) -> Column:
    """Sums before each element of an array<bigint>, in blocks so that long arrays stay near linear."""
    block = 64

    def extend(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.element_at(acc, -1) + x))

    zero = F.array(F.lit(0).cast("bigint"))

    def of(arr: Column) -> Column:
        n_blocks = F.ceil(F.size(arr) / F.lit(block)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(arr, b * block + 1, F.lit(block)))
        inner = F.transform(blocks, lambda part: F.aggregate(part, zero, extend))
        return let(
            inner,
            lambda parts: let(
                F.aggregate(parts, zero, lambda acc, part: extend(acc, F.element_at(part, -1))),
                lambda bases: F.flatten(
                    F.transform(
                        parts,
                        lambda part, i: F.transform(F.slice(part, F.lit(1), F.size(part) - 1), lambda x: x + F.get(bases, i)),
                    )
                ),
            ),
        )

    return let(lengths, lambda arr: F.when(F.size(arr) == 0, F.array().cast("array<bigint>")).otherwise(of(arr)))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<s, e, m>>, in code points, end exclusive.

    Spark's regular-expression functions return texts, not places: the pieces
    between the matches and the matches themselves give the places by their
    lengths.  The pattern must not match the empty text.
    """

    def placed(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        lengths = F.zip_with(
            F.transform(F.slice(pieces, F.lit(1), F.size(found)), lambda p: F.length(p).cast("bigint")),
            F.transform(found, lambda m: F.length(m).cast("bigint")),
            lambda gap, own: F.array(gap, own),
        )
        return let(
            running_totals(F.flatten(lengths)),
            lambda at: F.transform(
                found,
                lambda m, i: F.struct(
                    F.get(at, i * 2 + 1).alias("s"),
                    (F.get(at, i * 2 + 1) + F.length(m)).alias("e"),
                    m.alias("m"),
                ),
            ),
        )

    none = F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")
    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)),
    )
