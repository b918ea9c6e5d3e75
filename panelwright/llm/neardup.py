"""Groups of near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates have SimHash fingerprints that the forest of :mod:`simhash` links, or share one of ``BANDS`` keys of ``ROWS`` min-hashes each; a pair at
similarity 0.8 has no key in common with probability (1 - 0.8 ** 4) ** 20, or
3 in 100,000, and less above.  Every link is confirmed on the whole sets.

Inside a key all members are compared with its smallest one, the pivot, and in
a few further rounds those that are left with a new pivot of their own.  A
large group of near copies is joined that way by one pair per member.  What
the first pivot did not confirm may still be linked to any member of its key;
those links are found by prefixes: with the shingles of each set in order of
rarity, similar sets share one of their first few, and where they share it
bounds what they can have in common.  Sets that are already in one component
are not compared again.  Pages of one template whose own shingles fill the
prefix (a similarity of the family up to about 0.63) make no pairs at all.
Families nearer to 0.8 do meet in shingles of their frame; sets that meet in
so crowded a shingle are compared in blocks of their keys instead, by counting
shared shingles inside a task, so that only links are written and each set
travels once per key and block, not once per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import sent_by_value, written
from panelwright.llm.components import stars

sent_by_value(__name__)

SHINGLE = 5
SEED = 42
# Similarity in tenths, so that it is compared in whole numbers.
TENTHS = 8
BANDS, ROWS = 20, 4
# Rounds of pivots inside a key; the prefixes find what they leave.
ROUNDS = 3
# A prefix shingle of more sets than this is crowded, and its sets are compared in blocks of about this many shingles.
CROWDED = 64
BLOCK_SHINGLES = 1 << 18
# Bits of the presence map of candidate texts: a fixed size.
MAP_BITS = 24
_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the shingles of ``width`` words in order; one of all words if there are fewer, none without words."""
    # bytes.lower and bytes.split know exactly A-Z and the six separators.
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    joined = b" ".join(ws)
    width = min(width, len(ws))
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(ws) - width + 1
    spans = map(slice, starts[:n].tolist(), ends[width - 1 :].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED)), np.uint64, n)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def set_key(shingles: np.ndarray) -> int:
    """Name of a set as a signed long; texts with equal sets share it."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes())).view(np.int64))


def band_keys(shingles: np.ndarray) -> list[int]:
    if not len(shingles):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        low = np.minimum(low, (_FACTORS[:, None] * shingles[None, at : at + 2048]).min(axis=1))
    parts = low.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), b) for b, p in enumerate(parts)], np.uint64).view(np.int64).tolist()


def _text_hash(text: str | None) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"))).view(np.int64))


def _keyed(batches: Iterator[pa.RecordBatch], fingerprint: Callable[[str | None], int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for t in batch.column(1):
            text = t.as_py()
            shingles = shingle_set(text)
            own = int(np.uint64(fingerprint(text)).view(np.int64))
            for col, value in zip(out, (set_key(shingles), len(shingles), _text_hash(text), band_keys(shingles), own), strict=True):
                col.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "fp", "size", "t", "bands", "print"])


def set_keys(docs: DataFrame, fingerprint: Callable[[str | None], int]) -> DataFrame:
    """``doc_id``, ``fp`` (name of the shingle set), ``size``, ``t`` (hash of the text), ``bands`` and ``print`` (the text's fingerprint as a signed long) of each row."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(partial(_keyed, fingerprint=fingerprint), "doc_id long, fp long, size long, t long, bands array<long>, print long")


def _sets(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """``fp`` and the whole set of each candidate.  Texts are found again by a bit map of their hashes, so they are not shuffled."""
    place = F.col("t").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = candidates.select(F.shiftright(place, 5).alias("word"), place.bitwiseAND(F.lit(31)).alias("bit")).distinct()
    packed = words.groupBy("word").agg(F.sum(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits")).collect()
    present = np.zeros(1 << (MAP_BITS - 5), np.uint32)
    for word, bits in packed:
        present[word] = bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sets = [], []
            for t in batch.column(0):
                text = t.as_py()
                place = _text_hash(text) & ((1 << MAP_BITS) - 1)
                if present[place >> 5] >> np.uint32(place & 31) & 1:
                    shingles = shingle_set(text)
                    names.append(set_key(shingles))
                    sets.append(shingles.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "shingles"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "fp long, shingles array<long>")
    return found.join(candidates.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.any_value("shingles").alias("shingles"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` whose whole sets are similar enough."""
    a = sets.select(F.col("fp").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("fp").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(a.hint("merge"), "u").join(b.hint("merge"), "v")
    common = F.size(F.array_intersect("a", "b"))
    # common / (a + b - common) >= TENTHS / 10
    return both.where((10 + TENTHS) * common >= TENTHS * (F.size("a") + F.size("b"))).select("u", "v")


def _fits(a: str, b: str):
    """Can sets of these sizes be similar enough?"""
    return 10 * F.least(a, b) >= TENTHS * F.greatest(a, b)


def _pivots(members: DataFrame) -> DataFrame:
    """Members of each key with its smallest one as ``v``; keys with one member and the pivots themselves are left out."""
    pivots = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("fp", "size")).alias("pivot")).where(F.col("n") > 1)
    pivots = pivots.select("key", F.col("pivot.fp").alias("v"), F.col("pivot.size").alias("v_size"))
    return members.join(pivots.hint("merge"), "key").where(F.col("fp") != F.col("v")).select("key", "fp", "size", "v", "v_size")


def _unconfirmed(paired: DataFrame, good: DataFrame) -> DataFrame:
    known = good.select(F.col("u").alias("fp"), "v")
    return paired.join(known.hint("merge"), ["fp", "v"], "left_anti").select("key", "fp", "size")


def _prefixes(sets: DataFrame) -> DataFrame:
    """``fp, size, token, pos, short``: the shingles by which similar sets find each other.

    Shingles are ordered by the number of these sets that hold them, rarest
    first.  The larger set of a pair looks into its first ``size - 0.8 size + 1``;
    the smaller one is found by its first ``size - 8/9 size + 1`` (``short``),
    since two sets of at least its size must share 8/9 of it.  Shingles of one
    set only keep their places but meet nobody.
    """
    tokens = sets.select("fp", F.size("shingles").alias("size"), F.explode("shingles").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    own = tokens.join(shared, "token").groupBy("fp", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("by"))
    need = lambda top, of: F.floor((F.col("size") * top + of - 1) / of)
    placed = own.select(
        "fp",
        "size",
        (F.col("size") - need(TENTHS, 10) + 1).alias("long_end"),
        (F.col("size") - need(2 * TENTHS, 10 + TENTHS) + 1).alias("short_end"),
        F.posexplode("by").alias("i", "of"),
        F.size("by").alias("n_shared"),
    ).withColumn("pos", F.col("size") - F.col("n_shared") + F.col("i"))
    placed = placed.where(F.col("pos") < F.col("long_end"))
    return placed.select("fp", "size", F.col("of.token").alias("token"), "pos", (F.col("pos") < F.col("short_end")).alias("short"))


def _entries(sets: DataFrame, marks: DataFrame) -> DataFrame:
    """Prefix shingles in which sets of different components meet, with ``n`` sets each; ``marks`` are ``(fp, root, open)``."""
    entries = _prefixes(sets).join(marks, "fp")
    # A shingle inside one component, or without an open set, joins nothing new; such lists are left out whole.
    worth = entries.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("a"), F.max("root").alias("b"), F.max("open").alias("any"))
    worth = worth.where((F.col("a") != F.col("b")) & F.col("any")).select("token", "n")
    return written(entries.join(worth.hint("merge"), "token"), "near-prefixes")


def _prefix_pairs(entries: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of different components that may be similar and share a shingle that is not crowded."""
    entries = entries.where(F.col("n") <= CROWDED)
    x = entries.where("short").select("token", *[F.col(c).alias(f"x_{c}") for c in ("fp", "size", "pos", "root", "open")])
    y = entries.select("token", *[F.col(c).alias(f"y_{c}") for c in ("fp", "size", "pos", "root", "open")])
    smaller = (F.col("x_size") < F.col("y_size")) | ((F.col("x_size") == F.col("y_size")) & (F.col("x_fp") < F.col("y_fp")))
    # At the first shared shingle no more can be in common than what follows it in either set.
    rest = F.least(F.col("x_size") - F.col("x_pos"), F.col("y_size") - F.col("y_pos"))
    enough = (10 + TENTHS) * rest >= TENTHS * (F.col("x_size") + F.col("y_size"))
    new = (F.col("x_root") != F.col("y_root")) & (F.col("x_open") | F.col("y_open"))
    found = x.hint("merge").join(y, (x["token"] == y["token"]) & smaller & _fits("x_size", "y_size") & enough & new)
    return found.select(F.greatest("x_fp", "y_fp").alias("u"), F.least("x_fp", "y_fp").alias("v")).distinct()


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` has in common with each of ``right``."""
    values, at = np.unique(np.concatenate(left + right), return_inverse=True)
    # A shingle of one set is in no intersection.
    column = np.cumsum(np.bincount(at, minlength=len(values)) > 1) - 1
    kept = np.bincount(at, minlength=len(values)) > 1
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    owner, place = owner[kept[at]], column[at[kept[at]]]
    out = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    for low in range(0, int(kept.sum()), step):
        mine = (place >= low) & (place < low + step)
        present = np.zeros((len(left) + len(right), step), np.float32)
        present[owner[mine], place[mine] - low] = 1
        out += present[: len(left)] @ present[len(left) :].T
    return out.astype(np.int64)


def _block_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks of a key (or inside one), each pair in the first key it shares."""
    a, b, key = (group[c].iloc[0] for c in ("a", "b", "key"))
    sides = [group[group["block"] == a], group[group["block"] == b]]
    if not all(map(len, sides)):
        return pd.DataFrame({"u": np.array([], np.int64), "v": np.array([], np.int64)})
    fps, roots, opens, sizes = ([s[c].to_numpy() for s in sides] for c in ("fp", "root", "open", "size"))
    pairs = (roots[0][:, None] != roots[1]) & (opens[0][:, None] | opens[1])
    first = np.ones_like(pairs)
    for bands in zip(*[np.stack(s["bands"].to_numpy()).T for s in sides], strict=True):
        same = bands[0][:, None] == bands[1]
        pairs &= ~(same & first & (bands[0] != key)[:, None])
        first &= ~same
    pairs &= 10 * np.minimum(sizes[0][:, None], sizes[1]) >= TENTHS * np.maximum(sizes[0][:, None], sizes[1])
    rows, columns = pairs.any(axis=1), pairs.any(axis=0)
    out = (np.array([], np.int64), np.array([], np.int64))
    if rows.any():
        common = _shared(list(sides[0]["shingles"][rows]), list(sides[1]["shingles"][columns]))
        total = sizes[0][rows][:, None] + sizes[1][columns]
        x, y = np.nonzero(pairs[np.ix_(rows, columns)] & ((10 + TENTHS) * common >= TENTHS * total))
        out = fps[0][rows][x], fps[1][columns][y]
    return pd.DataFrame({"u": np.maximum(*out), "v": np.minimum(*out)})


def _crowd_links(entries: DataFrame, members: DataFrame, marks: DataFrame, unique: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among sets that meet in a crowded shingle, compared in blocks of the keys they share."""
    crowd = entries.where(F.col("n") > CROWDED).select("fp").distinct()
    keyed = written(members.join(crowd.hint("merge"), "fp", "left_semi"), "near-crowd")
    blocks = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("size") / BLOCK_SHINGLES).alias("blocks")).where(F.col("n") > 1)
    rows = keyed.join(blocks.select("key", "blocks"), "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    whole = sets.join(crowd.hint("merge"), "fp", "left_semi").join(marks.hint("merge"), "fp").join(unique.select("fp", "bands").hint("merge"), "fp")
    rows = rows.join(whole.hint("merge"), "fp")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other"))
    return rows.groupBy("key", "a", "b").applyInPandas(_block_links, "u long, v long").distinct()


def links(docs: DataFrame, unique: DataFrame, proposed: DataFrame) -> DataFrame:
    """Links ``(u, v)``, ``u > v``, that join the sets ``fp`` of ``unique`` to their groups; ``proposed`` are pairs found by other means."""
    members = written(unique.select("fp", "size", F.explode("bands").alias("key")), "near-keys")
    paired = written(_pivots(members), "near-members")
    found = paired.select("fp").union(paired.select("v")).union(proposed.select("u")).union(proposed.select("v")).distinct()
    candidates = written(unique.select("fp", "t").join(found, "fp", "left_semi"), "near-candidates")
    sets = written(_sets(docs, candidates), "near-sets")
    good, open_rows = None, None
    for i in range(ROUNDS):
        first = paired.where(_fits("size", "v_size")).select(F.col("fp").alias("u"), "v")
        first = first.unionByName(proposed) if i == 0 else first
        confirmed = written(_confirmed(first.distinct(), sets), "near-links")
        good = confirmed if good is None else good.unionByName(confirmed)
        left = written(_unconfirmed(paired, confirmed), "near-left")
        open_rows = left if open_rows is None else open_rows
        paired = written(_pivots(left), "near-members")
    star = stars(good.distinct())
    # Whoever shares a key with an open set may be linked to it.
    keys = open_rows.select("key").distinct()
    near = members.join(keys.hint("merge"), "key", "left_semi").select("fp").distinct()
    open_sets = open_rows.select("fp", F.lit(True).alias("open")).distinct()
    marks = near.join(open_sets.hint("merge"), "fp", "left").join(star.select(F.col("u").alias("fp"), F.col("v").alias("root")).hint("merge"), "fp", "left")
    marks = written(marks.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("open", F.lit(False)).alias("open")), "near-marks")
    entries = _entries(sets.join(marks.select("fp").hint("merge"), "fp", "left_semi"), marks)
    pairs = _confirmed(written(_prefix_pairs(entries), "near-pairs"), sets)
    return star.unionByName(pairs).unionByName(_crowd_links(entries, members, marks, unique, sets))
