"""Order-based building blocks for groups of any size.

A plain ``Window.partitionBy(group)`` puts a whole group into one task.  The
helpers here are used wherever a group (a cohort, a market, the whole table)
has no bound: rows are range-partitioned by ``(group, order)``, so one hot
group spreads over many tasks, and each range carries its row count (or
running sum) to the ranges after it.  Only one row per range and group is
ever brought together for that carry.

Windows are still used where the key bounds the group: ``(symbol, date)`` is
unique in a panel, so one symbol has at most one row per calendar day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import stage_table

# monotonically_increasing_id keeps the partition id above bit 33.
_ROW_BITS = 33
_SLICE, _SEQ = "__slice", "__seq"

Order = Sequence[tuple[str, bool]]


def _sort_columns(group: Sequence[str], order: Order) -> list[Column]:
    cols = [F.col(g).asc_nulls_first() for g in group]
    for name, ascending in order:
        c = F.col(name)
        cols.append(c.asc_nulls_last() if ascending else c.desc_nulls_last())
    return cols


# Rows of a range where their number is known: a task holds these, however well they compress.
SLICE_ROWS = 300_000


def slices_for(rows: int) -> int:
    """How many ranges, or shuffle partitions, hold so many rows."""
    return max(1, -(-rows // SLICE_ROWS))


def range_slices(df: DataFrame, group: Sequence[str], order: Order, slices: int | None = None) -> DataFrame:
    """Rows sorted across range partitions, with frozen ``__slice`` and ``__seq``.

    ``order`` must be total within a group, or equal rows stay together in one
    range.  The result is staged: range bounds are sampled, so they must not be
    computed twice.  Without a number of ``slices`` the adaptive planner sizes
    them by bytes after compression.
    """
    sort = _sort_columns(group, order)
    numbered = (
        (df.repartitionByRange(slices, *sort) if slices else df.repartitionByRange(*sort))
        .sortWithinPartitions(*sort)
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    return stage_table(
        numbered.withColumn(_SLICE, F.shiftright("__mid", _ROW_BITS).cast("int"))
        .withColumn(_SEQ, F.col("__mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("__mid"),
        "slices",
    )


def positions(
    df: DataFrame,
    group: Sequence[str],
    order: Order,
    position: str = "pos",
    size: str | None = "n",
    slices: int | None = None,
) -> DataFrame:
    """0-based position of every row within its group, and the group size."""
    sliced = range_slices(df, group, order, slices)
    # One row per range and group: the carry of row counts.
    parts = sliced.groupBy(*group, _SLICE).agg(
        F.count(F.lit(1)).alias("__rows"), F.min(_SEQ).alias("__first")
    )
    if group:
        by_group = Window.partitionBy(*group)
    else:
        by_group = Window.partitionBy(F.lit(1))
    upto = by_group.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        *group,
        _SLICE,
        (F.coalesce(F.sum("__rows").over(upto), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__rows").over(by_group).alias("__size"),
    )
    joined = _join_carry(sliced, carry, group)
    out = joined.withColumn(position, F.col(_SEQ) + F.col("__shift"))
    if size:
        out = out.withColumn(size, F.col("__size"))
    return out.drop(_SLICE, _SEQ, "__shift", "__size")


# Rows a bucket should hold, and keys that are drawn to find where buckets end: about KEY_SAMPLE, at most twice as many.
BUCKET_ROWS = 200_000
KEY_SAMPLE = 16_384


def bucket_positions(df: DataFrame, order: Sequence[str], position: str = "pos", size: str = "n") -> DataFrame:
    """0-based position of every row under a total ascending order (nulls last), and the number of rows.

    Only keys are looked at ahead: a sample of them gives the ends of the
    buckets, an exact count how many rows lie before each.  Both are one small
    staged table, so a bucket is the same function of a key in every branch
    and after any loss.  The rows themselves are shuffled once, to be ranked
    inside their bucket, and never staged.
    """
    order = list(order)
    keys = df.select(*order)
    n = keys.count()
    buckets = max(1, min(-(-n // BUCKET_ROWS), KEY_SAMPLE // 4))
    # Null keys sort last: a flag in front of each.
    key = F.struct(*[f for i, c in enumerate(order) for f in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"k{i}"))])
    drawn = keys.where(F.pmod(F.xxhash64(*order), F.lit(max(1, n // KEY_SAMPLE))) == 0).limit(2 * KEY_SAMPLE)
    sorted_keys = F.array_sort(F.collect_list(key))
    cuts = drawn.agg(sorted_keys.alias("__all")).select(
        F.filter(
            F.transform(F.sequence(F.lit(1), F.lit(buckets)), lambda i: F.get("__all", F.floor(i * F.size("__all") / F.lit(buckets)).cast("int"))),
            lambda c: c.isNotNull(),
        ).alias("__cuts")
    )
    cuts = stage_table(cuts, "splitters")

    def bucketed(rows: DataFrame) -> DataFrame:
        steps = F.sequence(F.lit(buckets.bit_length()), F.lit(0), F.lit(-1))
        ends = F.col("__ends")

        # Binary search: how many cuts lie at or below the key.
        def step(low: Column, bit: Column) -> Column:
            up = low + F.pow(F.lit(2), bit).cast("int")
            return F.when((up <= F.size(ends)) & (F.get(ends, up - 1) <= key), up).otherwise(low)

        found = rows.withColumn("__ends", cuts.select("__cuts").scalar())
        return found.withColumn("__bucket", F.aggregate(steps, F.lit(0), step)).drop("__ends")

    counts = bucketed(keys).groupBy("__bucket").agg(F.count(F.lit(1)).alias("__rows"))
    # One row per bucket.
    before = Window.partitionBy(F.lit(1)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage_table(counts.select("__bucket", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__base")), "buckets")
    inside = Window.partitionBy("__bucket").orderBy(*_sort_columns([], [(c, True) for c in order]))
    ranked = bucketed(df).withColumn("__rank", F.row_number().over(inside) - 1)
    placed = join_stats(ranked, bases, ["__bucket"])
    return placed.select(*df.columns, (F.col("__base") + F.col("__rank")).alias(position), F.lit(n).cast("long").alias(size))


def _join_carry(sliced: DataFrame, carry: DataFrame, group: Sequence[str]) -> DataFrame:
    keys = [*group, _SLICE]
    renamed = carry.select(
        *[F.col(k).alias(f"__c_{i}") for i, k in enumerate(keys)],
        *[c for c in carry.columns if c not in keys],
    )
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__c_{i}"))
    return sliced.join(renamed, cond, "inner").drop(*[f"__c_{i}" for i in range(len(keys))])


def running_sums(
    df: DataFrame, group: Sequence[str], order: Order, sums: Mapping[str, str], slices: int | None = None
) -> DataFrame:
    """Inclusive running sum of columns along the order of each group."""
    sliced = range_slices(df, group, order, slices)
    local = (
        Window.partitionBy(_SLICE, *group)
        .orderBy(_SEQ)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    parts = sliced.groupBy(*group, _SLICE).agg(
        *[F.sum(c).alias(f"__t_{out}") for out, c in sums.items()]
    )
    by_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    upto = by_group.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        *group,
        _SLICE,
        *[F.coalesce(F.sum(f"__t_{out}").over(upto), F.lit(0)).alias(f"__b_{out}") for out in sums],
    )
    inside = (sliced.repartition(slices, _SLICE) if slices else sliced).select(
        "*", *[F.coalesce(F.sum(c).over(local), F.lit(0)).alias(f"__l_{out}") for out, c in sums.items()]
    )
    joined = _join_carry(inside, carry, group)
    return joined.select(
        *df.columns,
        *[(F.col(f"__l_{out}") + F.col(f"__b_{out}")).alias(out) for out in sums],
    )


def value_ranks(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Distinct ``(group, value)`` with ``n_equal``, ``n_above``, ``n_below``.

    Ties are pre-aggregated before the sort, so a value shared by any share of
    the rows costs one row per task.  Nulls are left out.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("n_equal"))
    )
    run = running_sums(counts, group, [(value, True)], {"__upto": "n_equal"})
    totals = run.groupBy(*group).agg(F.max("__upto").alias("__all"))
    out = join_stats(run, totals, group)
    return out.select(
        *group,
        value,
        "n_equal",
        (F.col("__all") - F.col("__upto")).alias("n_above"),
        (F.col("__upto") - F.col("n_equal")).alias("n_below"),
    )


def tie_counts(df: DataFrame, group: Sequence[str], value: str, ascending: bool = True) -> DataFrame:
    """Every row with ``n_before`` and ``n_equal``: rows of its group before its value in the order, and with its value.

    Ranks are written where the rows lie: they are range-sorted by group and
    value, told apart by a hash, so one value may take many ranges.  A range
    counts its own ties; the first and last value of each range, with their
    counts, travel with the carry, so ties that cross a border are counted
    together.  No join on the value.  Null values come last, with null counts.
    """
    group = list(group)
    spread = df.withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    sliced = range_slices(spread, group, [(value, ascending), ("__tie", True)]).drop("__tie")
    v = F.col(value)
    tie = Window.partitionBy(_SLICE, *group, value)
    inside = sliced.withColumns({"__low": F.min(_SEQ).over(tie), "__ties": F.count(F.lit(1)).over(tie)})
    here = F.struct(_SEQ, v.alias("v"), "__low", "__ties")
    parts = inside.groupBy(*group, _SLICE).agg(
        F.count(F.lit(1)).alias("__rows"), F.min(_SEQ).alias("__start"), F.min(here).alias("__a"), F.max(here).alias("__b")
    )
    by_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    upto = by_group.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range and group from here on: where each range starts, then where its border values start and how many there are.
    bases = parts.withColumn("__shift", F.coalesce(F.sum("__rows").over(upto), F.lit(0)) - F.col("__start"))
    edge = lambda name: F.struct(F.col(f"{name}.v").alias("v"), (F.col("__shift") + F.col(f"{name}.__low")).alias("at"), F.col(f"{name}.__ties").alias("n"))
    alone = F.col("__a.v").eqNullSafe(F.col("__b.v"))
    both = F.when(alone, F.array(edge("__a"))).otherwise(F.array(edge("__a"), edge("__b")))
    edges = bases.select(*group, _SLICE, "__shift", F.explode(both).alias("__e")).select("*", "__e.*")
    same = Window.partitionBy(*group, "v")
    edges = edges.withColumns({"__from": F.min("at").over(same), "__all": F.sum("n").over(same)})
    carry = edges.groupBy(*group, _SLICE).agg(
        F.max("__shift").alias("__shift"), F.collect_list(F.struct("v", F.col("__from").alias("at"), F.col("__all").alias("n"))).alias("__edges")
    )
    joined = _join_carry(inside, carry, group)
    border = F.get(F.filter("__edges", lambda e: e["v"].eqNullSafe(v)), F.lit(0))
    counted = joined.withColumn("__border", border)
    own = F.struct((F.col("__shift") + F.col("__low")).alias("at"), F.col("__ties").alias("n"))
    found = F.coalesce(F.when(F.col("__border").isNotNull(), F.struct(F.col("__border.at").alias("at"), F.col("__border.n").alias("n"))), own)
    out = counted.withColumn("__found", F.when(v.isNotNull(), found))
    return out.select(*df.columns, F.col("__found.at").alias("n_before"), F.col("__found.n").alias("n_equal"))


def join_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Attach one-row-per-key statistics; null keys match each other.

    No hint: the adaptive planner broadcasts the statistics when their measured
    size is small, and splits a hot key of a sort-merge join otherwise.
    """
    if not keys:
        # A global aggregate is exactly one row: a scalar subquery, not a join.
        row = stats.select(F.struct(*stats.columns)).scalar()
        return df.withColumn("__row", row).select(
            *df.columns, *[F.col(f"__row.{c}").alias(c) for c in stats.columns]
        )
    renamed = stats.select(
        *[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)],
        *[c for c in stats.columns if c not in keys],
    )
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    return df.join(renamed, cond, how).drop(*[f"__k_{i}" for i in range(len(keys))])


def with_group_stats(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Group aggregates next to every row, with map-side pre-aggregation."""
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return join_stats(df, stats, keys)


# Relative rank error of the sketch is 1/accuracy; brackets are this many errors wide on each side.
SKETCH_ACCURACY = 10_000
BRACKET_ERRORS = 5


def _brackets(values: DataFrame, group: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """Per group its size ``__n`` and value bounds around each fraction, drawn from a mergeable sketch.

    A bound of null is open.  Groups whose positions may lie between two ranks
    of the sketch have open brackets, so all their values are kept: they hold
    at most ``SKETCH_ACCURACY`` rows.  Staged, as sketches vary with merge order.
    """
    width = BRACKET_ERRORS / SKETCH_ACCURACY
    low = [max(p - width, 0.0) for p in fractions]
    high = [min(p + width, 1.0) for p in fractions]
    quantiles = F.percentile_approx("__v", low + high, SKETCH_ACCURACY)
    sketch = values.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), quantiles.alias("__q"))
    wide, out = F.col("__n") > SKETCH_ACCURACY, []
    for j, (a, b) in enumerate(zip(low, high, strict=True)):
        # An open side stands for the end of the group.
        out += [F.when(wide & F.lit(a > 0), F.col("__q")[j]).alias(f"__lo{j}")]
        out += [F.when(wide & F.lit(b < 1), F.col("__q")[len(low) + j]).alias(f"__hi{j}")]
    return stage_table(sketch.select(*group, "__n", *out), "brackets")


def _placed(values: DataFrame, info: DataFrame, group: Sequence[str], brackets: int) -> DataFrame:
    """One pass over the values: ``(group, __v, __c)`` inside a bracket, and one row per group (null ``__v``) for all others.

    ``__o{j}`` counts the others below bracket ``j``.
    """
    v = F.col("__v")
    above = [F.col(f"__lo{j}").isNull() | (v >= F.col(f"__lo{j}")) for j in range(brackets)]
    below = [F.col(f"__hi{j}").isNull() | (v <= F.col(f"__hi{j}")) for j in range(brackets)]
    inside = F.lit(False)
    for a, b in zip(above, below, strict=True):
        inside = inside | (a & b)
    kept = join_stats(values, info, group).select("*", inside.alias("__in"))
    return kept.groupBy(*group, F.when(F.col("__in"), v).alias("__v")).agg(
        F.count(F.lit(1)).alias("__c"),
        *[F.count_if(~F.col("__in") & ~a).alias(f"__o{j}") for j, a in enumerate(above)],
    )


def _missed(counts: DataFrame, info: DataFrame, group: Sequence[str], targets: Sequence[Column], brackets: int) -> DataFrame:
    """The groups with a target outside all of their brackets, found from what was placed."""
    v, c = F.col("__v"), F.col("__c")
    sums = []
    for j in range(brackets):
        skipped, lo, hi = F.sum(f"__o{j}"), F.col(f"__lo{j}"), F.col(f"__hi{j}")
        sums.append((skipped + F.sum(F.when(v < lo, c).otherwise(0))).alias(f"__under{j}"))
        # What lies up to a bracket's end is below the bracket or inside one.
        sums.append((skipped + F.sum(F.when(v.isNotNull() & (hi.isNull() | (v <= hi)), c).otherwise(0))).alias(f"__upto{j}"))
    checked = join_stats(counts, info, group).groupBy(*group, "__n").agg(*sums)
    missed = F.lit(False)
    for at in targets:
        held = F.lit(False)
        for j in range(brackets):
            held = held | ((at >= F.col(f"__under{j}")) & (at < F.col(f"__upto{j}")))
        missed = missed | ((at >= 0) & (at < F.col("__n")) & ~held)
    return checked.where(missed).select(*group, F.lit(True).alias("__missed"))


def order_statistics(
    df: DataFrame, group: Sequence[str], value: str, targets: Mapping[str, Column], fractions: Sequence[float]
) -> DataFrame:
    """The values at given 0-based ascending positions of each group, and its size ``__n``.

    A target is an expression of ``__n``; a position outside the group gives
    null.  Nulls are left out.  ``fractions`` says where in a group the targets
    lie.  The rows are read twice: once for a quantile sketch that brackets the
    wanted positions, once to count the values inside the brackets and those
    before them, which keeps positions exact.  The counts show whether a
    bracket missed its target; such a group is read again with open brackets.
    Of the sorted ranges only those that hold a target are looked into.
    """
    group = list(group)
    values = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("__v"))
    fractions = sorted(set(fractions))
    n_brackets = len(fractions)
    info = _brackets(values, group, fractions)
    counts = stage_table(_placed(values, info, group, n_brackets), "placed")
    missed = _missed(counts, info, group, list(targets.values()), n_brackets)
    if not missed.isEmpty():
        missed = stage_table(missed, "missed")
        bounds = [c for c in info.columns if c.startswith(("__lo", "__hi"))]
        if group:
            marked = join_stats(info, missed, group, "left")
            again = join_stats(values, missed, group).drop("__missed")
            counts = join_stats(counts, missed, group, "left").where(F.col("__missed").isNull()).drop("__missed")
        else:
            marked, again, counts = info.withColumn("__missed", F.lit(True)), values, counts.limit(0)
        info = stage_table(marked.select(*group, "__n", *[F.when(F.col("__missed").isNull(), F.col(c)).alias(c) for c in bounds]), "brackets")
        counts = counts.unionByName(_placed(again, info, group, n_brackets))
    v = F.col("__v")
    ranges = range_slices(counts, group, [("__v", True)])
    skips = [f"__o{j}" for j in range(n_brackets)]
    left_out = ranges.where(F.col("__v").isNull()).select(*group, *skips)
    if not group:
        left_out = left_out.agg(*[F.max(c).alias(c) for c in skips])
    known = join_stats(info, left_out, group, "left").na.fill(0, skips)
    sliced = ranges.where(F.col("__v").isNotNull()).drop(*skips)
    by_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    upto = by_group.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range and group.
    carry = sliced.groupBy(*group, _SLICE).agg(F.sum("__c").alias("__rows")).select(
        *group, _SLICE, F.coalesce(F.sum("__rows").over(upto), F.lit(0)).alias("__base"), "__rows"
    )
    carry = join_stats(carry, known, group)
    # With brackets that are not open a range may hold a target anywhere in what was left out before it.
    needed = F.lit(False)
    for j in range(n_brackets):
        needed = needed | F.col(f"__lo{j}").isNotNull() | F.col(f"__hi{j}").isNotNull()
    for at in targets.values():
        needed = needed | ((at >= F.col("__base")) & (at < F.col("__base") + F.col("__rows")))
    hit = _join_carry(sliced, carry.where(needed).drop("__rows"), group)
    local = (
        Window.partitionBy(_SLICE, *group)
        .orderBy(_SEQ)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Rows left out below a value: those below the last bracket that starts at or under it.
    skipped = F.lit(0)
    for j in range(n_brackets):
        skipped = F.when(F.col(f"__lo{j}").isNull() | (v >= F.col(f"__lo{j}")), F.col(f"__o{j}")).otherwise(skipped)
    end = F.col("__base") + F.sum("__c").over(local) + skipped
    located = hit.withColumn("__end", end)
    picks = [
        F.max(F.when((at >= F.col("__end") - F.col("__c")) & (at < F.col("__end")), v)).alias(name)
        for name, at in targets.items()
    ]
    # One row per group: callers join it to the rows by its real size.
    return stage_table(located.groupBy(*group, "__n").agg(*picks), "order-statistics")


def exact_percentiles(
    df: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Linear-interpolated percentiles, one row per group.

    The built-in ``percentile`` keeps every distinct value of a group in one
    buffer; this one takes the two neighbouring order statistics.
    """
    at = {name: F.lit(float(p)) * (F.col("__n") - 1) for name, p in probs.items()}
    targets = {f"__lo_{name}": F.floor(a) for name, a in at.items()}
    targets |= {f"__hi_{name}": F.ceil(a) for name, a in at.items()}
    found = order_statistics(df, group, value, targets, list(probs.values()))
    out = []
    for name, a in at.items():
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (hi - lo) * (a - F.floor(a))).alias(name))
    return found.select(*group, *out)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """The first row of every key under ``order``; nulls sort last.

    An aggregate instead of a ranking window: each task keeps one row per key,
    so a key with any share of the rows is safe.  Descending columns must be
    numeric, date or timestamp.  Rows equal in ``order`` are told apart by their
    remaining columns, so the result does not depend on row order.
    """
    types = dict(df.dtypes)
    sort_key = []
    for i, (name, ascending) in enumerate(order):
        c = F.col(name)
        if not ascending:
            if types[name] == "date":
                c = -F.unix_date(c)
            elif types[name].startswith("timestamp"):
                c = -F.unix_micros(c.cast("timestamp"))
            else:
                c = -c
        sort_key += [F.col(name).isNull().alias(f"n{i}"), c.alias(f"o{i}")]
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    value = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("v")
    ranked = F.struct(F.struct(*sort_key).alias("k"), value) if sort_key else F.struct(value)
    picked = df.groupBy(*keys).agg(F.min(ranked).alias("__m"))
    return picked.select(*keys, *[F.col(f"__m.v.`{c}`").alias(c) for c in rest]).select(*df.columns)


def top_per_group(df: DataFrame, group: Sequence[str], order: Order, n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows per group with their 1-based row number.

    A constant limit lets Spark cut every group to ``n`` rows per task before
    the shuffle, so a hot group does not reach one task whole.  Spark does so up
    to its own threshold; above it the rows are numbered by a range sort.
    """
    spark = df.sparkSession
    if n > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        placed = positions(df, group, order, "__pos", None)
        return placed.where(F.col("__pos") < n).withColumn(rank, F.col("__pos") + 1).drop("__pos")
    w = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))).orderBy(
        *_sort_columns([], order)
    )
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
