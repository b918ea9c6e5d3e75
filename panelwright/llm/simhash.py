"""SimHash fingerprints linked exactly within a Hamming radius by a forest of vantage-point trees.

A fingerprint of 64 bits is cut into three bands.  Two fingerprints that
differ in at most four bits differ in at most one bit of some band, so each
band has a tree of its own over the band's Hamming distance with radius one.
An inner node sends a fingerprint inside when its distance to the vantage
point is at most ``mu`` and outside otherwise; by the triangle bound a
partner within the radius can only lie across the border when the distance is
``mu + 1 .. mu + radius``, and those boundary fingerprints go to both sides.
The small radius against a band of 21 bits is what makes the trees prune:
one ball over all 64 bits with radius four would copy most points to both sides.

Trees are fitted on a bounded sample; every fingerprint is routed.  Leaves
are the shards Spark shuffles.  Inside a shard the full 64 bits are compared:
a local vantage-point split where it prunes, else a breadth-first search over
unvisited points, which a dense cluster finishes in a few steps.  A shard
emits one link per member to its component's root, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import neardup
from panelwright.llm.common import sent_by_value, written
from panelwright.llm.components import stars

sent_by_value(__name__)

# Words of a shingle and bits of a link of op10; the pipeline stage has its own rule (neardup).
SHINGLE = 4
RADIUS = 4
BANDS = ((0, 22), (22, 43), (43, 64))
BAND_RADIUS = RADIUS // len(BANDS)
# The trees are fitted on a sample by hash: one fingerprint in SAMPLE_ONE_IN, or about SAMPLE of them if that is fewer; never more than twice SAMPLE.
SAMPLE = 16_384
SAMPLE_ONE_IN = 8
# Splitting goes on while a leaf would hold more rows than this, as far as the sample tells.
LEAF_ROWS = 2_000
LEAF_SAMPLE = 4
BRUTE = 256


def fingerprint(text: str | None) -> int:
    """Fingerprint of one text as an unsigned integer; null and empty give zero."""
    hashes = neardup.shingle_hashes(text, SHINGLE)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of each row."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_fingerprints, "doc_id long, fp long")


def _bits(x: np.ndarray, v: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((x ^ v) & mask).astype(np.int64)


def _band_mask(band: tuple[int, int]) -> np.uint64:
    return np.uint64(((1 << band[1]) - 1) ^ ((1 << band[0]) - 1))


def fit_tree(sample: np.ndarray, mask: np.uint64, radius: int, leaf_share: float) -> list[tuple]:
    """Nodes ``(vantage, mu, inside, outside)``; a leaf is ``None``.

    The vantage point of a node is the sampled member farthest from the first
    one, ``mu`` the distance that splits the node's sample most evenly.
    """
    nodes: list = [None]
    todo = [(0, sample)]
    while todo:
        at, own = todo.pop()
        if len(own) <= max(LEAF_SAMPLE, leaf_share * len(sample)):
            continue
        vantage = own[int(np.argmax(_bits(own, own[0], mask)))]
        upto = np.cumsum(np.bincount(_bits(own, vantage, mask), minlength=65))
        inside, outside = upto[np.minimum(np.arange(65) + radius, 64)], len(own) - upto
        mu = int(np.argmin(np.maximum(inside, outside)))
        if max(inside[mu], outside[mu]) > 0.9 * len(own):
            continue
        d = _bits(own, vantage, mask)
        nodes[at] = (int(vantage), mu, len(nodes), len(nodes) + 1)
        nodes += [None, None]
        todo += [(len(nodes) - 2, own[d <= mu + radius]), (len(nodes) - 1, own[d > mu])]
    return nodes


def route(x: np.ndarray, nodes: list, mask: np.uint64, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(leaf, positions in x)``; boundary points come in two leaves."""
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        if nodes[at] is None:
            yield at, own
            continue
        vantage, mu, inside, outside = nodes[at]
        d = _bits(x[own], np.uint64(vantage), mask)
        todo += [(inside, own[d <= mu + radius]), (outside, own[d > mu])]


def components_within(x: np.ndarray, radius: int, direct: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(members, root)`` links that join each distinct value of ``x`` to one root per component of the shard; ``direct`` ones, to a member within the radius."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    todo = [x]
    while todo:
        own = todo.pop()
        if len(own) < 2:
            continue
        if len(own) > BRUTE:
            d = _bits(own, own[0], full)
            upto = np.cumsum(np.bincount(d, minlength=65)).astype(float)
            inside, outside = upto[np.minimum(np.arange(65) + radius, 64)], len(own) - upto
            cost = inside**2 + outside**2
            mu = int(np.argmin(cost))
            if cost[mu] < 0.7 * len(own) ** 2:
                todo += [own[d <= mu + radius], own[d > mu]]
                continue
        unvisited = own
        while len(unvisited) > 1:
            root, frontier, unvisited = unvisited[0], unvisited[:1], unvisited[1:]
            while len(frontier) and len(unvisited):
                step, frontier = frontier[:64], frontier[64:]
                near, by = np.zeros(len(unvisited), bool), np.full(len(unvisited), root)
                for v in step:
                    hit = np.bitwise_count(unvisited ^ v) <= radius
                    if direct:
                        by[hit & ~near] = v
                    near |= hit
                if near.any():
                    found = unvisited[near]
                    yield found, by[near]
                    frontier, unvisited = np.concatenate((frontier, found)), unvisited[~near]


def links(unique: DataFrame, direct: bool = False) -> DataFrame:
    """Links ``(u, v)``, ``u > v``, between distinct fingerprints ``fp`` that span each shard's components, as stars or ``direct``."""
    n = unique.count()
    one_in = max(SAMPLE_ONE_IN, n // SAMPLE)
    sample = unique.where(F.pmod(F.xxhash64("fp"), F.lit(one_in)) == 0).orderBy(F.xxhash64("fp"), "fp").limit(2 * SAMPLE).select("fp").collect()
    drawn = np.array([r[0] for r in sample], np.int64).view(np.uint64)
    trees = []
    for band in BANDS:
        mask = _band_mask(band)
        trees.append((mask, fit_tree(drawn, mask, BAND_RADIUS, LEAF_ROWS / max(n, 1)) if len(drawn) else [None]))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(0)).view(np.uint64)
            for b, (mask, nodes) in enumerate(trees):
                for leaf, own in route(x, nodes, mask, BAND_RADIUS):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), b * 1_000_000 + leaf, np.int64)), pa.array(x[own].view(np.int64))], names=["shard", "fp"]
                    )

    def within(shard: pd.DataFrame) -> pd.DataFrame:
        out = [(m, r) for m, r in components_within(shard["fp"].to_numpy().view(np.uint64), RADIUS, direct)]
        if not out:
            return pd.DataFrame({"u": np.array([], np.int64), "v": np.array([], np.int64)})
        a = np.concatenate([m for m, _ in out]).view(np.int64)
        b = np.concatenate([r for _, r in out]).view(np.int64)
        return pd.DataFrame({"u": np.maximum(a, b), "v": np.minimum(a, b)})

    routed = unique.select("fp").mapInArrow(shards, "shard long, fp long")
    return routed.groupBy("shard").applyInPandas(within, "u long, v long").distinct()


def _fingerprint_names(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def _set_names(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([neardup.set_key(neardup.shingle_set(t)) for t in texts], np.int64))


def fingerprint_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame, Callable]:
    """``(doc_id, fp, component_id)`` of each row, and ``(fp, component_id, root)`` of each fingerprint, and what names texts.

    Null and empty texts have fingerprint zero and are linked like any other.
    A null ``doc_id`` never names a component unless all ids in it are null.
    Repeated rows keep one result row each.
    """
    rows = written(fingerprints(docs), "fingerprints")
    # Exact copies meet here: a group of any size becomes one row per task before the shuffle.
    unique = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints-unique")
    named = _named(unique, links(unique))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id"), named, _fingerprint_names


def clusters(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of each row."""
    return fingerprint_groups(docs)[0]


def _named(unique: DataFrame, edges: DataFrame) -> DataFrame:
    """``fp``, ``component_id`` and ``root`` of each distinct ``fp``."""
    star = stars(edges)
    rooted = unique.join(star.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return written(rooted.join(smallest, "root").select("fp", "component_id", "root"), "fingerprints-named")


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """Pairs ``(u, v)``, ``u > v``, of shingle sets ``fp`` by their fingerprints ``print``: each set with the first one of its fingerprint, and first ones along the links of the forest."""
    held = written(rows.where("size > 0").select("print", "fp").distinct(), "near-prints")
    first = written(held.groupBy("print").agg(F.min("fp").alias("first")), "near-prints-first")
    same = held.join(first, "print").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    ends = [first.select(F.col("print").alias(end), F.col("first").alias(name)) for end, name in (("u", "a"), ("v", "b"))]
    across = links(first.select(F.col("print").alias("fp")), direct=True).join(ends[0], "u").join(ends[1], "v").select("a", "b")
    pairs = same.unionByName(across).where(F.col("a") != F.col("b"))
    return written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "near-print-pairs")


def near_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame, Callable]:
    """``(doc_id, fp, component_id)`` of each row by the rule of :mod:`neardup`, and ``(fp, component_id, root)`` of each shingle set, and what names texts.

    Fingerprints linked by the forest and shared min-hash keys propose pairs; whole sets confirm them.
    """
    rows = written(neardup.set_keys(docs, fingerprint), "near-rows")
    unique = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min("t").alias("t"), F.min("size").alias("size"), F.min("bands").alias("bands"))
    unique = written(unique, "near-unique")
    named = _named(unique.select("fp", "first_id"), neardup.links(docs, unique, fingerprint_pairs(rows)))
    return rows.select("doc_id", "fp").join(named, "fp").select("doc_id", "fp", "component_id"), named, _set_names


def result(docs: DataFrame) -> DataFrame:
    """Contract columns: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``."""
    return clusters(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, groups: Callable[[DataFrame], tuple[DataFrame, DataFrame, Callable]] = fingerprint_groups) -> DataFrame:
    """The document with the smallest id of each group, with all columns of ``docs``; ``groups`` is the rule of op10 or :func:`near_copies`.

    Rows that repeat a ``doc_id`` count as one document; the row with the
    smallest text stays.  Rows without an id stay only where no row of their
    group has one, one row per group.  Texts are not shuffled by group:
    removed ids are few and anti-joined.
    """
    found, named_groups, name = groups(docs)
    found = written(found, "near-duplicates")
    ids = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("doc_id") != F.col("component_id")).alias("gone")
    )
    lost = written(ids.where(F.col("gone")).select("doc_id"), "near-duplicates-lost")
    repeated = written(ids.where(~F.col("gone") & (F.col("n") > 1)).select("doc_id"), "near-duplicates-repeated")
    named = docs.where(F.col("doc_id").isNotNull()).join(lost, "doc_id", "left_anti")
    single = named.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    rest = [named.join(repeated, "doc_id", "left_semi").select(*docs.columns)]
    rest[0] = _first_rows(rest[0], ["doc_id"])
    # Groups in which no row has an id: rows without an id are named again and follow their group's root.
    bare = docs.where(F.col("doc_id").isNull()).withColumn("__fp", F.pandas_udf(name, "long")(F.col("text").cast("string")))
    roots = named_groups.where(F.col("component_id").isNull()).select(F.col("fp").alias("__fp"), F.col("root").alias("__root"))
    rest.append(_first_rows(bare.join(roots, "__fp").drop("__fp"), ["__root"]).drop("__root"))
    out = single
    for part in rest:
        out = out.unionByName(part)
    return out


def _first_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the one with the smallest text (then the smallest hash of the row)."""
    cols = [c for c in df.columns]
    order = F.struct(F.coalesce("text", F.lit("")), F.hash(*[F.col(f"`{c}`").cast("string") for c in cols]))
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in cols]), order).alias("__row"))
    return picked.select(*[F.col("__row")[c].alias(c) for c in cols])
