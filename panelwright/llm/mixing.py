"""Mixing sources to target weights: hierarchical budgets and seeded token prefixes.

The tree is domain - language - source.  A token budget flows from the root by
integer weights.  A node can give at most its tokens times ``max_epochs``;
what it falls short of goes to its siblings by their weights, and only what
all siblings together cannot give goes up to the siblings of its parent.  At
every level this is water filling under the children's capacities.

A leaf's budget is a prefix of its seeded token stream: whole epochs first,
then the documents of the next epoch in seeded order up to the budget, the
last one cut.  The order is a hash; token sums per hash bucket say which
bucket holds the cut, so only documents of that bucket are ever sorted.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import words, written

LEVELS = ("domain", "lang", "source")
_TOKENS = "decimal(20,0)"


@dataclass(frozen=True)
class Mix:
    """Target mix.  A weight is looked up by name on its level; a name without one has weight 1."""

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    domains: Mapping[str, str] = field(default_factory=dict)
    other_domain: str = "other"
    budget_percent: int = 100  # of the tokens there are
    max_epochs: int = 3
    seed: int = 17


def _lookup(key: Column, values: Mapping, default) -> Column:
    if not values:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def leaves_of(mix: Mix) -> dict[str, Column]:
    """The leaf of a document row; null lang or source is the empty name."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return {
        "__domain": _lookup(source, mix.domains, mix.other_domain),
        "__lang": F.coalesce(F.col("lang"), F.lit("")),
        "__source": source,
    }


def _fill(nodes: DataFrame, parents: list[str], name: str, weights: Mapping[str, int]) -> DataFrame:
    """Give each child its part ``budget`` of the parent's ``total`` under its own ``cap``."""
    w = _lookup(F.col(name), weights, 1).cast(_TOKENS)
    nodes = nodes.withColumn("w", w)
    # Siblings by how soon they run dry.
    by = Window.partitionBy(*parents).orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), name)
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.partitionBy(*parents)
    nodes = nodes.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(_TOKENS).alias("given"),
        F.sum("w").over(after).cast(_TOKENS).alias("w_left"),
        F.row_number().over(by).alias("rank"),
    )
    dry = (F.col("total") - F.col("given")) * F.col("w") >= F.col("cap") * F.col("w_left")
    nodes = nodes.withColumn("first", F.min(F.when(~dry, F.col("rank"))).over(everyone))
    is_dry = F.col("first").isNull() | (F.col("rank") < F.col("first"))
    pick = F.when(F.col("rank") == F.col("first"), F.struct((F.col("total") - F.col("given")).cast(_TOKENS).alias("rest"), F.col("w_left").alias("w")))
    nodes = nodes.withColumn("pool", F.max(pick).over(everyone))
    upto = (F.col("pool.w") - F.col("w_left") + F.col("w")).cast(_TOKENS)
    low = (upto - F.col("w")).cast(_TOKENS)
    nodes = nodes.withColumns({"hi": upto, "lo": low, "rest": F.col("pool.rest"), "wp": F.col("pool.w")})
    # Differences of rounded running shares add up to the whole.
    share = F.expr("(rest * hi) div wp - (rest * lo) div wp").cast(_TOKENS)
    return nodes.withColumn("budget", F.when(is_dry, F.col("cap")).otherwise(F.least(F.col("cap"), share)))


def budgets(leaf_tokens: DataFrame, mix: Mix) -> DataFrame:
    """``(__domain, __lang, __source, tokens, budget)`` of the leaves; one row per leaf in and out."""
    keys = ["__domain", "__lang", "__source"]
    capacity = leaf_tokens.withColumn("cap", (F.col("tokens") * mix.max_epochs).cast(_TOKENS))
    whole = capacity.agg(
        F.least(F.expr(f"(sum(tokens) * {mix.budget_percent}) div 100").cast(_TOKENS), F.sum("cap").cast(_TOKENS)).alias("total")
    )
    upper = capacity.select(*keys, "tokens", "cap").withColumn("total", whole.scalar())
    for depth, level in enumerate(LEVELS):
        parents, here = keys[:depth], keys[: depth + 1]
        nodes = upper.groupBy(*here, "total").agg(F.sum("cap").cast(_TOKENS).alias("cap"))
        if not parents:
            nodes = nodes.withColumn("__root", F.lit(0))
        filled = _fill(nodes, parents or ["__root"], here[-1], mix.weights.get(level, {}))
        # Names on the leaf rows are never null, so plain equality joins them.
        upper = upper.drop("total").join(filled.select(*here, F.col("budget").alias("total")), here)
    return upper.select(*keys, "tokens", F.col("total").cast("long").alias("budget"))


def _order(mix: Mix, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.col("__id")))


def _identity() -> list[Column]:
    """``__id``, by which a document is drawn, and ``__x``, which tells apart rows that share it.

    Rows without an id are drawn by their text, so they spread over the buckets.
    """
    text = F.coalesce("text", F.lit(""))
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text)))
    return [own.alias("__id"), F.xxhash64(text).alias("__x")]


@dataclass(frozen=True)
class Plan:
    leaves: DataFrame  # one row per leaf: budget, whole epochs, cut bucket
    cuts: DataFrame  # documents of the cut buckets with the tokens taken


def plan(docs: DataFrame, mix: Mix) -> Plan:
    """Budgets and cuts for ``docs``."""
    keys = ["__domain", "__lang", "__source"]
    tokens = F.size(words(F.col("text"))).cast("long")
    narrow = written(docs.select(*_identity(), *[c.alias(n) for n, c in leaves_of(mix).items()], tokens.alias("__n")), "mix-tokens")
    narrow = narrow.where(F.col("__n") > 0)
    totals = narrow.groupBy(*keys).agg(F.sum("__n").cast(_TOKENS).alias("tokens"))
    shares = budgets(totals, mix).withColumns(
        {"__whole": F.expr("budget div tokens").cast("int"), "__rest": (F.col("budget") % F.col("tokens")).cast("long")}
    )
    shares = written(shares, "mix-shares")
    placed = narrow.join(shares, keys).select(*keys, "__x", "__n", "__rest", _order(mix, F.col("__whole")).alias("__o"))
    placed = written(placed.where(F.col("__rest") > 0).withColumn("__b", F.substring("__o", 1, 4)), "mix-order")
    buckets = placed.groupBy(*keys, "__rest", "__b").agg(F.sum("__n").alias("n"))
    # At most 65,536 buckets per leaf.
    upto = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = buckets.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") >= F.col("__rest"))
    cut = edges.groupBy(*keys).agg(F.min("__b").alias("__cut"), F.min_by(F.col("upto") - F.col("n"), "__b").alias("__base"))
    leaves = written(shares.join(cut, keys, "left"), "mix-leaves")
    # Only the documents of one bucket per leaf are sorted.
    inside = placed.join(leaves.select(*keys, "__cut", "__base"), keys).where(F.col("__b") == F.col("__cut"))
    running = Window.partitionBy(*keys).orderBy("__o", "__n", "__x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("__rest") - (F.col("__base") + F.sum("__n").over(running) - F.col("__n"))
    cuts = inside.withColumn("__take", F.greatest(F.least(F.col("__n"), left), F.lit(0)))
    # Rows that repeat id, text and leaf share one order value: each takes the part of its own place among them.
    nth = Window.partitionBy(*keys, "__o", "__n", "__x").orderBy(F.desc("__take"))
    cuts = cuts.withColumn("__nth", F.row_number().over(nth)).select(*keys, "__o", "__n", "__x", "__nth", "__take")
    return Plan(leaves, written(cuts, "mix-cuts"))


def mixed(docs: DataFrame, mix: Mix, columns: list[str] | None = None, cut_text: bool = False) -> DataFrame:
    """One row per selected document and epoch: ``columns`` of ``docs`` with ``domain``, ``epoch``, ``n_tokens``, ``taken``.

    Documents without a word are never selected.  ``cut_text`` replaces the text
    of a cut document by its taken words, joined by spaces.  Texts stay where
    they are read: the joins are with one row per leaf and with the cut
    documents of one bucket per leaf, both written tables of known size.
    """
    columns = columns or ["doc_id"]
    keys = ["__domain", "__lang", "__source"]
    made = plan(docs, mix)
    extra = [c for c in ("text",) if cut_text and c not in columns]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in dict.fromkeys([*columns, *extra])],
        *_identity(),
        *[c.alias(n) for n, c in leaves_of(mix).items()],
        F.size(words(F.col("text"))).cast("long").alias("__n"),
    ).where(F.col("__n") > 0)
    rows = rows.join(made.leaves, keys).withColumn("__o", _order(mix, F.col("__whole")))
    whole = rows.where(F.col("__whole") > 0).select("*", F.explode(F.sequence(F.lit(0), F.col("__whole") - 1)).alias("epoch"), F.col("__n").alias("taken"))
    bucket = F.substring("__o", 1, 4)
    before = rows.where((F.col("__rest") > 0) & (F.col("__cut").isNull() | (bucket < F.col("__cut")))).select(
        "*", F.col("__whole").alias("epoch"), F.col("__n").alias("taken")
    )
    at_cut = rows.where((F.col("__rest") > 0) & (bucket == F.col("__cut")))
    same = Window.partitionBy(*keys, "__o", "__n", "__x").orderBy(F.lit(1))
    numbered = at_cut.withColumn("__nth", F.row_number().over(same))
    partly = numbered.join(made.cuts, [*keys, "__o", "__n", "__x", "__nth"]).where(F.col("__take") > 0)
    partly = partly.select(*rows.columns, F.col("__whole").alias("epoch"), F.col("__take").alias("taken"))
    out = whole.unionByName(before).unionByName(partly)
    if cut_text:
        prefix = F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("taken").cast("int")), " ")
        out = out.withColumn("text", F.when(F.col("taken") < F.col("__n"), prefix).otherwise(F.col("text")))
    return out.select(
        *[F.col(f"`{c}`") for c in columns], F.col("__domain").alias("domain"), "epoch", F.col("__n").alias("n_tokens"), "taken"
    )


def oracle_sql(mix: Mix) -> str:
    """The same selection in DuckDB SQL: ``doc_id, lang, source, domain, epoch, n_tokens, taken``."""

    def case(column: str, values: Mapping, default) -> str:
        def lit(x):
            return f"'{x}'" if isinstance(x, str) else str(x)

        if not values:
            return lit(default)
        return f"CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in values.items()) + f" ELSE {lit(default)} END"

    ctes = [
        "t AS (SELECT doc_id, text, lang, source, coalesce(lang, '') AS k1, coalesce(source, '') AS k2, "
        f"{case('source', mix.domains, mix.other_domain)} AS k0, "
        r"CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n FROM documents)",
        f"leaf AS (SELECT k0, k1, k2, CAST(sum(n) AS HUGEINT) AS tokens, CAST(sum(n) AS HUGEINT) * {mix.max_epochs} AS cap FROM t WHERE n > 0 GROUP BY ALL)",
        f"b0 AS (SELECT *, (SELECT least(sum(tokens) * {mix.budget_percent} // 100, sum(cap)) FROM leaf) AS total FROM leaf)",
    ]
    for depth, level in enumerate(LEVELS):
        here = ", ".join(f"k{i}" for i in range(depth + 1))
        part = "PARTITION BY " + (", ".join(f"k{i}" for i in range(depth)) or "1")
        by = f"{part} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), k{depth}"
        weight = case(f"k{depth}", mix.weights.get(level, {}), 1)
        ctes += [
            f"n{depth} AS (SELECT {here}, total, sum(cap) AS cap, CAST({weight} AS HUGEINT) AS w FROM b{depth} GROUP BY {here}, total)",
            f"o{depth} AS (SELECT *, coalesce(sum(cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given, "
            f"sum(w) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl, row_number() OVER ({by}) AS r FROM n{depth})",
            f"f{depth} AS (SELECT *, min(CASE WHEN NOT (total - given) * w >= cap * wl THEN r END) OVER ({part}) AS first FROM o{depth})",
            f"g{depth} AS (SELECT *, max(CASE WHEN r = first THEN total - given END) OVER ({part}) AS rest, max(CASE WHEN r = first THEN wl END) OVER ({part}) AS wp FROM f{depth})",
            f"h{depth} AS (SELECT {here}, CASE WHEN first IS NULL OR r < first THEN cap ELSE least(cap, rest * (wp - wl + w) // wp - rest * (wp - wl) // wp) END AS budget FROM g{depth})",
            f"b{depth + 1} AS (SELECT b.* EXCLUDE (total), h.budget AS total FROM b{depth} b JOIN h{depth} h USING ({here}))",
        ]
    ctes += [
        "s AS (SELECT k0, k1, k2, CAST(total // tokens AS INTEGER) AS whole, CAST(total % tokens AS BIGINT) AS rest FROM b3)",
        f"p AS (SELECT *, md5('{mix.seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS o FROM t JOIN s USING (k0, k1, k2) WHERE n > 0)",
        "c AS (SELECT *, rest - (sum(n) OVER (PARTITION BY k0, k1, k2 ORDER BY o, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n) AS room FROM p)",
    ]
    select = "SELECT doc_id, lang, source, k0 AS domain, CAST({e} AS INTEGER) AS epoch, n AS n_tokens, CAST({t} AS BIGINT) AS taken FROM {f}"
    whole = select.format(e="e", t="n", f="(SELECT *, unnest(range(whole)) AS e FROM p)")
    part = select.format(e="whole", t="least(n, room)", f="c WHERE room > 0")
    return "WITH " + ",\n".join(ctes) + f"\n{whole}\nUNION ALL\n{part}"
