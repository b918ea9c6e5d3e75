"""Spans of text as arrays of ``(s, k, e)``: start, number of the kind, end; code points, end exclusive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelwright.llm.common import matches

TYPE = "array<struct<s:bigint,k:int,e:bigint>>"


def none() -> Column:
    return F.array().cast(TYPE)


def found(text: Column, kind: int, pattern: str, keep=None) -> Column:
    """Leftmost non-overlapping matches of one kind; those whose text fails ``keep`` are dropped."""
    hits = matches(text, pattern)
    if keep is not None:
        hits = F.filter(hits, lambda m: keep(m["m"]))
    return F.transform(hits, lambda m: F.struct(m["s"].alias("s"), F.lit(kind).alias("k"), m["e"].alias("e")))


def together(*arrays: Column) -> Column:
    """All spans by start, then kind as listed."""
    return F.sort_array(F.concat(*arrays))


def overlaps(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (x["s"] < b["e"]) & (b["s"] < x["e"]))


def written_out(spans: Column, kinds: Sequence[str]) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")
