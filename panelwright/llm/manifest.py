"""Merkle manifest of a corpus, kept as append logs in postorder.

Leaves are numbered inside their tree by a range sort, so no tree is ever in
one task.  An *aligned builder* takes ``2 ** HEIGHT`` consecutive leaves (a
whole subtree) and writes every node when it is complete, which is postorder.
The subtree roots are the leaves of the next round, so a tree of a thousand
million leaves takes three rounds.  Where a node lies in its log follows from
the sizes of the subtrees before it (:func:`position`); siblings are addressed
that way and never searched for.  Proofs go top down: a block gets the path
above its root once and puts the siblings inside the block in front of it.

Each language is a tree; its root is a leaf of the one tree above.  Defined
cases: a null language is a tree of its own and the first, rows without an id
come first, rows that share an id are ordered by their leaf (equal rows have
equal leaves, so their order does not show), an empty table has an empty
manifest.  Extra columns take no part.
"""

from __future__ import annotations

from hashlib import sha256
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import sent_by_value, written
from panelwright.operators.ordered import join_stats, positions

sent_by_value(__name__)

# Levels of one aligned builder: it holds at most 2 ** HEIGHT leaves.
HEIGHT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_SIBLING, LEFT, RIGHT = b"\0", b"\1", b"\2"


def combine(*digests: bytes) -> bytes:
    """The parent of consecutive nodes; digests are hashed as hex text."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return max(n - 1, 0).bit_length()


def position(level: int, index: int, n: int) -> int:
    """Where node ``index`` of ``level`` stands in the postorder log of a tree of ``n`` leaves.

    After k leaves, k + k/2 + k/4 + ... = 2k - popcount(k) nodes are complete.
    A whole node follows its last leaf by ``level``; the ragged nodes of the
    right edge close the log, lowest first.
    """
    end = (index + 1) << level
    if end <= n:
        return 2 * (end - 1) - (end - 1).bit_count() + level
    return 2 * n - n.bit_count() + sum(n % (1 << k) != 0 for k in range(1, level))


def append_log(leaves: list[bytes], levels: int) -> list[tuple[int, int, bytes]]:
    """``(level, index, digest)`` of every node of the lowest ``levels`` levels, in completion order."""
    m, log = len(leaves), []
    for i, leaf in enumerate(leaves):
        log.append((0, i, leaf))
        level, index = 0, i
        while index & 1 and level < levels:
            left = log[position(level, index - 1, m)][2]
            level, index = level + 1, index >> 1
            log.append((level, index, combine(left, log[-1][2])))
    for level in range(1, levels + 1):
        if m % (1 << level):
            index, below = m >> level, -(-m >> (level - 1))
            children = [log[position(level - 1, c, m)][2] for c in (2 * index, 2 * index + 1) if c < below]
            log.append((level, index, combine(*children)))
    return log


def siblings(log: list[bytes], leaf: int, m: int, levels: int) -> bytes:
    """The path of a leaf inside its log: per level a mark, and the sibling's digest if there is one."""
    path = []
    for level in range(levels):
        index = leaf >> level
        other = index ^ 1
        if other < -(-m >> level):
            path.append((LEFT if other < index else RIGHT) + log[position(level, other, m)])
        else:
            path.append(NO_SIBLING)
    return b"".join(path)


def steps(path: bytes):
    """``(mark, sibling)`` of each level of a path."""
    at = 0
    while at < len(path):
        mark, at = path[at : at + 1], at + 1
        if mark == NO_SIBLING:
            yield mark, b""
        else:
            yield mark, path[at : at + 32]
            at += 32


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root a leaf and its path lead to."""
    for mark, other in steps(path):
        leaf = combine(leaf) if mark == NO_SIBLING else combine(other, leaf) if mark == LEFT else combine(leaf, other)
    return leaf


def proof_digest(path: bytes) -> str:
    return sha256("".join(other.hex() for _, other in steps(path)).encode()).hexdigest()


# --- logs, bottom up -------------------------------------------------------------------------------------------


def _height_column(n: str) -> Column:
    return F.when(F.col(n) > 1, F.length(F.bin(F.col(n) - 1))).otherwise(0)


_ROUND = "tree long, n long, block long, place long, level int, idx long, pos long, digest binary"


def _builder(base: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        tree, n, first = int(block["tree"].iloc[0]), int(block["n"].iloc[0]), int(block["idx"].iloc[0])
        log = append_log(list(block["digest"]), min(HEIGHT, height(n) - base))
        rows = []
        for place, (level, index, digest) in enumerate(log):
            idx = (first >> level) + index
            rows.append((tree, n, first >> HEIGHT, place, base + level, idx, position(base + level, idx, n), digest))
        return pd.DataFrame(rows, columns=["tree", "n", "block", "place", "level", "idx", "pos", "digest"])

    return run


def grow(nodes: DataFrame) -> list[DataFrame]:
    """The rounds of aligned builders over leaves ``(tree, n, idx, digest)``, each a written table."""
    tallest = nodes.agg(F.max(_height_column("n"))).first()[0] or 0
    rounds = []
    for r in range(max(1, -(-tallest // HEIGHT))):
        base = r * HEIGHT
        blocks = nodes.withColumn("block", F.shiftright("idx", HEIGHT)).groupBy("tree", "block")
        rounds.append(written(blocks.applyInPandas(_builder(base), _ROUND), f"manifest-round-{r}"))
        done = F.col("level") == base + HEIGHT
        nodes = rounds[-1].where(done & (_height_column("n") > F.col("level"))).select("tree", "n", "idx", "digest")
    return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """``(tree, n, digest)``: the root of each tree."""
    out = None
    for r, table in enumerate(rounds):
        # A builder's leaves are nodes of the round before.
        new = F.lit(True) if r == 0 else F.col("level") > r * HEIGHT
        part = table.where(new & (F.col("level") == _height_column("n"))).select("tree", "n", "digest")
        out = part if out is None else out.unionByName(part)
    return out


def log(rounds: list[DataFrame]) -> DataFrame:
    """The append logs: ``(tree, pos, level, idx, digest)``, every node once."""
    out = None
    for r, table in enumerate(rounds):
        part = (table if r == 0 else table.where(F.col("level") > r * HEIGHT)).select("tree", "pos", "level", "idx", "digest")
        out = part if out is None else out.unionByName(part)
    return out


# --- paths, top down -------------------------------------------------------------------------------------------


_NODE, _PATH, _ROW = 0, 1, 2
_MIXED = ("tree", "block", "kind", "place", "n", "digest", "extra", "doc_id")


def _mixed(df: DataFrame, kind: int, **given: Column) -> DataFrame:
    types = {"place": "long", "n": "long", "digest": "binary", "extra": "binary", "doc_id": "long"}
    columns = [given.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    return df.select("tree", "block", F.lit(kind).alias("kind"), *columns)


def _segment(block: pd.DataFrame, base: int):
    """What a block's rows hold: its log, its number of leaves and levels, and the path row."""
    nodes = block[block["kind"] == _NODE].sort_values("place")
    n, at = int(nodes["n"].iloc[0]), int(block["block"].iloc[0])
    m = min(1 << HEIGHT, -(-n >> base) - (at << HEIGHT))
    return list(nodes["digest"]), m, min(HEIGHT, height(n) - base), block[block["kind"] == _PATH].iloc[0]


def _block_paths(base: int):
    """The path of each leaf of a block; that leaf is a block of the round below."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        digests, m, levels, up = _segment(block, base)
        tree, first = int(block["tree"].iloc[0]), int(block["block"].iloc[0]) << HEIGHT
        rows = [(tree, first + i, siblings(digests, i, m, levels) + up["digest"], up["extra"]) for i in range(m)]
        return pd.DataFrame(rows, columns=["tree", "block", "path", "extra"])

    return run


def block_paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``(tree, block, path, extra)`` of the blocks of the lowest round; ``tops`` gives ``(tree, n, path, extra)`` of each root."""
    last = F.greatest(F.ceil(_height_column("n") / HEIGHT).cast("int") - 1, F.lit(0))
    tops = tops.withColumn("last", last)
    up = None
    for r in range(len(rounds) - 1, -1, -1):
        start = tops.where(F.col("last") == r).select("tree", F.lit(0).cast("long").alias("block"), "path", "extra")
        if up is not None:
            nodes = _mixed(rounds[r + 1], _NODE, place=F.col("place"), n=F.col("n"), digest=F.col("digest"))
            above = nodes.unionByName(_mixed(up, _PATH, digest=F.col("path"), extra=F.col("extra")))
            found = above.groupBy("tree", "block").applyInPandas(_block_paths((r + 1) * HEIGHT), "tree long, block long, path binary, extra binary")
            start = start.unionByName(found)
        up = written(start, f"manifest-paths-{r}")
    return up


# --- the manifest of documents -----------------------------------------------------------------------------------


class Manifest(NamedTuple):
    """``leaves``: (tree, n, idx, doc_id, leaf, tampered); ``rounds`` and ``top_rounds``: node tables; ``names``: (tree, lang)."""

    leaves: DataFrame
    rounds: list[DataFrame]
    subroots: DataFrame
    top_rounds: list[DataFrame]


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(docs: DataFrame, **changed: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(changed.get(c, docs[c])) for c in FIELDS]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, leaf, tampered``; ``tampered`` is the leaf after the trial change, null for rows it spares."""
    touched = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    more = docs["n_chars"].cast("decimal(20,0)") + 1
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["lang"].cast("string").alias("lang"),
        _leaf(docs).alias("leaf"),
        F.when(touched, _leaf(docs, n_chars=more)).alias("tampered"),
    )


def build(docs: DataFrame) -> Manifest:
    """Logs of all trees; texts are read once and not shuffled, only their digests are."""
    # Written before they are sorted, as the range sort reads its input twice.
    rows = written(leaves(docs), "manifest-digests").withColumn("known", F.col("doc_id").isNotNull())
    numbered = written(positions(rows, ["lang"], [("known", True), ("doc_id", True), ("leaf", True)], "idx", "n"), "manifest-leaves")
    langs = numbered.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("known", F.col("lang").isNotNull())
    trees = written(positions(langs, [], [("known", True), ("lang", True)], "tree", "n_trees").select("lang", "tree", "n_trees"), "manifest-trees")
    own = join_stats(numbered, trees, ["lang"]).select("tree", "n", "idx", "doc_id", "leaf", "tampered")
    own = written(own, "manifest-leaves")
    rounds = grow(own.select("tree", "n", "idx", F.col("leaf").alias("digest")))
    sizes = trees.select("tree", "n_trees")
    subroots = written(roots(rounds).join(sizes, "tree"), "manifest-subroots")
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("n_trees").alias("n"), F.col("tree").alias("idx"), "digest")
    return Manifest(own, rounds, subroots, grow(top))


def _proofs(block: pd.DataFrame) -> pd.DataFrame:
    digests, m, levels, up = _segment(block, 0)
    subroot, root = up["extra"][:32].hex(), up["extra"][32:].hex()
    out = []
    for doc_id, place, leaf, tampered in block.loc[block["kind"] == _ROW, ["doc_id", "place", "digest", "extra"]].itertuples(index=False):
        path = siblings(digests, int(place), m, levels) + up["digest"]
        folded = fold(leaf if tampered is None else tampered, path).hex()
        out.append((None if pd.isna(doc_id) else int(doc_id), leaf.hex(), subroot, root, proof_digest(path), folded, folded == root))
    frame = pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return frame.astype({"doc_id": "Int64"})


def proofs(manifest: Manifest) -> DataFrame:
    """One row per document: its leaf, both roots, its proof, and what the (tampered) leaf folds to."""
    # The tree of trees: its paths continue those of each language.
    root = roots(manifest.top_rounds).select("tree", "n", F.lit(b"").cast("binary").alias("path"), F.col("digest").alias("extra"))
    nodes = _mixed(manifest.top_rounds[0], _NODE, place=F.col("place"), n=F.col("n"), digest=F.col("digest"))
    above = nodes.unionByName(_mixed(block_paths(manifest.top_rounds, root), _PATH, digest=F.col("path"), extra=F.col("extra")))
    tops = above.groupBy("tree", "block").applyInPandas(_block_paths(0), "tree long, block long, path binary, extra binary")
    tops = tops.select(F.col("block").alias("tree"), "path", F.col("extra").alias("root"))
    tops = manifest.subroots.join(tops, "tree").select("tree", "n", "path", F.concat("digest", "root").alias("extra"))
    up = block_paths(manifest.rounds, tops)
    nodes = _mixed(manifest.rounds[0], _NODE, place=F.col("place"), n=F.col("n"), digest=F.col("digest"))
    rows = manifest.leaves.withColumn("block", F.shiftright("idx", HEIGHT))
    inside = F.col("idx").bitwiseAND(F.lit((1 << HEIGHT) - 1))
    rows = _mixed(rows, _ROW, place=inside, digest=F.col("leaf"), extra=F.col("tampered"), doc_id=F.col("doc_id"))
    mixed = nodes.unionByName(_mixed(up, _PATH, digest=F.col("path"), extra=F.col("extra"))).unionByName(rows)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return mixed.groupBy("tree", "block").applyInPandas(_proofs, schema)


def result(docs: DataFrame) -> DataFrame:
    """Contract columns: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``."""
    return proofs(build(docs))


# CRC-32 bit by bit: each byte is followed by eight steps, marked -1.
CRC32_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''),
    lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT)"""


def _field_sql(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


_LEAF_SQL = "sha256(" + " || ".join(_field_sql(c) for c in FIELDS) + ")"

ORACLE_SQL = f"""WITH RECURSIVE leaf AS (
    SELECT doc_id, lang, {_LEAF_SQL} AS leaf,
           CASE WHEN doc_id IS NOT NULL AND {CRC32_SQL.format("CAST(doc_id AS VARCHAR)")} % 7 = 0
                THEN {_LEAF_SQL.replace("n_chars", "(n_chars + 1)")} END AS tampered FROM documents),
  own AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaf
          WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)),
  nodes AS (SELECT coalesce('=' || lang, '-') AS tree, 0 AS l, idx, n, leaf AS h FROM own
    UNION ALL SELECT tree, l + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, l, idx // 2, n),
  tops AS (SELECT 0 AS l, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, h FROM nodes WHERE n = 1
    UNION ALL SELECT l + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY l, idx // 2, n),
  subs AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS top_idx, l AS top_l FROM nodes WHERE n = 1),
  docs AS (SELECT own.*, subroot, top_idx, top_l, (SELECT h FROM tops WHERE n = 1) AS root, row_number() OVER () AS r
           FROM own JOIN subs ON tree = coalesce('=' || lang, '-')),
  steps AS (
    SELECT r, l, idx >> l AS at, h FROM docs JOIN (SELECT tree, l, idx AS sib, n, h FROM nodes) s
      ON s.tree = coalesce('=' || docs.lang, '-') AND s.sib = xor(docs.idx >> s.l, 1) WHERE s.n > 1
    UNION ALL SELECT r, top_l + l, top_idx >> l, h FROM docs JOIN (SELECT l, idx AS sib, n, h FROM tops) s
      ON s.sib = xor(docs.top_idx >> s.l, 1) WHERE s.n > 1),
  proofs AS (SELECT r, sha256(string_agg(h, '' ORDER BY l)) AS proof FROM steps GROUP BY r),
  total AS (SELECT max(l) AS top FROM tops),
  fold AS (SELECT r, 0 AS l, coalesce(tampered, leaf) AS h FROM docs
    UNION ALL SELECT f.r, f.l + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.at & 1 = 1 THEN s.h || f.h ELSE f.h || s.h END)
      FROM fold f JOIN docs d ON d.r = f.r JOIN total ON f.l < d.top_l + top LEFT JOIN steps s ON s.r = f.r AND s.l = f.l)
SELECT d.doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM docs d JOIN total ON true JOIN fold f ON f.r = d.r AND f.l = d.top_l + top LEFT JOIN proofs p ON p.r = d.r"""
