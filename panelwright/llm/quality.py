"""Quality rules with adaptive thresholds per language and source.

Every document gets a handful of counts.  Four ratios of them are put into a
mergeable quantile sketch per (lang, source): a histogram over buckets of
three significant decimal digits, so sketches merge by adding counts, in any
order, and a quantile is off by less than one percent of its value.  Quartiles
of the sketch give fences that take the place of fixed cutoffs; documents are
then joined to the fences of their group and filtered.

Quartiles of a group are drawn towards those of the sketch merged over its
language, and these towards those over everything, with the weight of
``PRIOR`` documents: a group's own share grows smoothly with its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import SPACE_CLASS, WORD_CHAR, let, words, written

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
# Documents that the wider group counts for beside a group's own.
PRIOR = 50
# A fence lies this many spreads outside the quartiles.
FENCE = 3
# Ratios in thousandths: (name, least spread, is there a lower fence).
# The least spread keeps a group of all but equal documents from rejecting harmless differences.
RATIOS = (("word_length", 500, True), ("symbols", 50, False), ("dup_lines", 100, False), ("repeats", 50, False))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeat_words(ws: Column) -> Column:
    """Words that lie in an 8-word window found twice or more; windows are compared by 64-bit hash."""

    def doubled(h: Column, shift: int) -> Column:
        rest = F.size(h) - shift
        return F.zip_with(F.slice(h, F.lit(1), rest), F.slice(h, F.lit(shift + 1), rest), lambda a, b: F.xxhash64(a, b))

    def covered(windows: Column) -> Column:
        tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            tagged,
            lambda s: F.aggregate(
                F.sort_array(
                    F.transform(
                        F.filter(
                            s,
                            lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False))
                            | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)),
                        ),
                        lambda e: e["i"],
                    )
                ),
                F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last")),
                lambda acc, i: F.struct((acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total"), i.alias("last")),
                lambda acc: acc["total"],
            ),
        )

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h1: let(doubled(h1, 1), lambda h2: let(doubled(h2, 2), lambda h4: doubled(h4, 4))))
    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(ws) <= WINDOW, F.lit(0)).otherwise(counted)


def _counts(text: Column) -> Column:
    """All counts of one text as a struct; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD_CHAR))

    def build(ws: Column, ls: Column) -> Column:
        parts = {
            "n_words": F.size(ws),
            "word_chars": F.length(F.array_join(ws, "")),
            "n_symbols": F.size(F.regexp_extract_all(text, F.lit("[#*$%&|<>]"), F.lit(0))),
            "n_lines": F.size(ls),
            "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
            "n_repeat_words": _repeat_words(ws),
        }
        return F.struct(*[parts[c].cast("bigint").alias(c) for c in COUNTS])

    return let(words(text), lambda ws: let(lines, lambda ls: build(ws, ls)))


def _ratio(counts: Column, name: str) -> Column:
    top, bottom = {
        "word_length": ("word_chars", "n_words"),
        "symbols": ("n_symbols", "n_words"),
        "dup_lines": ("n_dup_lines", "n_lines"),
        "repeats": ("n_repeat_words", "n_words"),
    }[name]
    return F.when(counts[bottom] > 0, F.floor(counts[top] * 1000 / counts[bottom]).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def _bucket(value: Column) -> Column:
    """The value cut to three significant digits."""
    width = F.pow(F.lit(10.0), F.greatest(F.length(value.cast("string")) - 3, F.lit(0))).cast("bigint")
    return value - value % width


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``lang`` and ``source`` (null: empty), the counts, the ratios and ``base_failed``."""
    counts = docs.select(
        *keep,
        F.coalesce("lang", F.lit("")).alias("__lang"),
        F.coalesce("source", F.lit("")).alias("__source"),
        _counts(F.col("text")).alias("__c"),
    )
    c = F.col("__c")
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
    return counts.select("*", failed.alias("__failed"), F.struct(*[_ratio(c, n).alias(n) for n, _, _ in RATIOS]).alias("__r"))


def sketches(rows: DataFrame) -> DataFrame:
    """Mergeable sketches: ``(lang, source, ratio, bucket, n)`` of the documents the base rule passes."""
    pairs = F.array(*[F.struct(F.lit(i).alias("ratio"), _bucket(F.col("__r")[n]).alias("bucket")) for i, (n, _, _) in enumerate(RATIOS)])
    return (
        rows.where(~F.col("__failed"))
        .select("__lang", "__source", F.inline(pairs))
        .groupBy("__lang", "__source", "ratio", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and ratio its size and the buckets that hold the first and third quartile."""
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "ratio")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(group).alias("all"))
    return ranked.groupBy(*keys, "ratio").agg(
        F.max("all").alias("size"),
        F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3, F.col("bucket"))).alias("q3"),
    )


def fences(rows: DataFrame) -> DataFrame:
    """One row per (lang, source) with a lower and an upper fence per ratio, in thousandths."""
    sketch = written(sketches(rows), "quality-sketches")
    own = _quartiles(sketch, ["__lang", "__source"])
    by_lang = _quartiles(sketch, ["__lang"])
    overall = _quartiles(sketch, [])

    def renamed(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*[F.col(c).alias(c if c in ("__lang", "__source", "ratio") else f"{tag}_{c}") for c in df.columns])

    joined = (
        own.join(renamed(by_lang, "lang"), ["__lang", "ratio"]).join(renamed(overall, "all"), ["ratio"])
    )

    def drawn(size: str, own: Column, wider: Column) -> Column:
        n = F.col(size).cast("double")
        return F.floor((n * own + F.lit(float(PRIOR)) * wider) / (n + PRIOR))

    def settled(c: str) -> Column:
        return drawn("size", F.col(c), drawn("lang_size", F.col(f"lang_{c}"), F.col(f"all_{c}")))

    resolved = joined.select("__lang", "__source", "ratio", settled("q1").alias("q1"), settled("q3").alias("q3"))
    bounds = []
    for i, (name, least, lower) in enumerate(RATIOS):
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        here = F.col("ratio") == i
        low = F.col("q1") - FENCE * spread if lower else F.lit(-1).cast("bigint")
        bounds += [
            F.max(F.when(here, low)).alias(f"__low_{name}"),
            F.max(F.when(here, F.col("q3") + FENCE * spread)).alias(f"__high_{name}"),
        ]
    return written(resolved.groupBy("__lang", "__source").agg(*bounds), "quality-fences")


def _with_verdict(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Join each row to the fences of its group.

    The fences are a written table of one row per (lang, source): the planner
    broadcasts it by its real size, or splits a hot group of a sorted join.
    """
    joined = rows.join(limits, ["__lang", "__source"], "left")
    outside = F.lit(False)
    for name, _, _ in RATIOS:
        value = F.col("__r")[name]
        outside = outside | (value < F.col(f"__low_{name}")) | (value > F.col(f"__high_{name}"))
    kept = ~F.col("__failed") & ~F.coalesce(outside, F.lit(False))
    return joined.select(*rows.columns, kept.alias("__kept"))


def verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept``, one row per document row.

    Null and empty texts have no words and fail.  Null ``lang`` or ``source``
    form groups of their own.  Repeated rows are judged alike, each.
    """
    rows = written(measured(docs, ["doc_id"]), "quality-counts")
    judged = _with_verdict(rows, fences(rows))
    return judged.select(
        "doc_id",
        *[F.col("__c")[c].alias(c) for c in COUNTS],
        F.col("__failed").alias("base_failed"),
        F.col("__kept").alias("kept"),
    )


def passing(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Texts are counted twice (once for the sketches, once in place) so that
    no text is ever shuffled.
    """
    limits = fences(written(measured(docs, []), "quality-counts"))
    return _with_verdict(measured(docs, docs.columns), limits).where("__kept").select(*docs.columns)


_WS = SPACE_CLASS  # the pattern means the same in both engines

ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
wins AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS win FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM wins) WHERE c > 1),
rep AS (SELECT rid, sum(least(8, gap)) AS n FROM (SELECT rid, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - 8) AS gap FROM twice) GROUP BY rid),
c AS (SELECT d.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid)),
r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
             CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS r0, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS r1,
             CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS r2, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS r3 FROM c),
long AS (SELECT lang, source, unnest([0, 1, 2, 3]) AS ratio, unnest([r0, r1, r2, r3]) AS v FROM r WHERE NOT base_failed),
b AS (SELECT lang, source, ratio, v - v % CAST(pow(10, greatest(length(CAST(v AS VARCHAR)) - 3, 0)) AS BIGINT) AS bucket FROM long),
q AS (SELECT lang, source, ratio, count(*) AS size, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM b GROUP BY ALL),
ql AS (SELECT lang, ratio, count(*) AS size, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM b GROUP BY ALL),
qa AS (SELECT ratio, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM b GROUP BY ALL),
res AS (SELECT lang, source, ratio, {", ".join(f"CAST(floor((CAST(q.size AS DOUBLE) * q.{c} + {PRIOR}.0::DOUBLE * floor((CAST(ql.size AS DOUBLE) * ql.{c} + {PRIOR}.0::DOUBLE * qa.{c}) / (CAST(ql.size AS DOUBLE) + {PRIOR}))) / (CAST(q.size AS DOUBLE) + {PRIOR})) AS BIGINT) AS {c}" for c in ("q1", "q3"))}
        FROM q JOIN ql USING (lang, ratio) JOIN qa USING (ratio)),
lim AS (SELECT lang, source,
               max(CASE WHEN ratio = 0 THEN q1 - {FENCE} * greatest(q3 - q1, {RATIOS[0][1]}) END) AS low0,
               {", ".join(f"max(CASE WHEN ratio = {i} THEN q3 + {FENCE} * greatest(q3 - q1, {least}) END) AS high{i}" for i, (_, least, _) in enumerate(RATIOS))}
        FROM res GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(r0 < low0 OR r0 > high0 OR r1 > high1 OR r2 > high2 OR r3 > high3, false) AS kept
FROM r LEFT JOIN lim USING (lang, source)
"""
