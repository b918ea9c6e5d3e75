"""View tables laid out in buckets by symbol, so that joins and per-symbol steps read them without a shuffle.

The layout pays where one table is read many times: it is shuffled once, when
it is written.  A bucket is a file, so buckets should be counted for the
largest table of a family and be the same for all of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from panelwright.session import scratch_path

BUCKETS = 8


def bucket_session(spark: SparkSession) -> SparkSession:
    """A session that shares tables with ``spark`` and accepts buckets by a part of the join key.

    Rows that agree on symbol and date agree on the symbol, so tables bucketed
    by symbol alone are co-located for such joins; by default Spark asks for
    all keys.  A symbol has at most one row per day, which bounds a bucket's
    largest key.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return own


def save_bucketed(
    df: DataFrame, name: str, by: Sequence[str] = ("symbol",), sort: Sequence[str] = ("symbol", "date"), buckets: int = BUCKETS, path: str | None = None
) -> str:
    """Write ``df`` in ``buckets`` files by the hash of ``by``, each sorted, and return the table's name in the catalog.

    Without ``path`` the files lie in a fresh folder of the shared folder and
    the name gets a suffix of its own.
    """
    if path is None:
        path = scratch_path(df.sparkSession, name)
        name = f"{name}_{uuid.uuid4().hex}"
    spread = df.repartition(buckets, *by)
    spread.write.mode("overwrite").option("path", path).bucketBy(buckets, *by).sortBy(*sort).format("parquet").saveAsTable(name)
    return name


def load_bucketed(spark: SparkSession, names: Sequence[str]) -> list[DataFrame]:
    """The tables as frames of one ``bucket_session``; join them with each other, not with frames of other sessions."""
    own = bucket_session(spark)
    return [own.table(name) for name in names]
