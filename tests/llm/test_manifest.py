"""Merkle manifest against whole trees built in one place."""

import hashlib
import zlib

import pytest

from panelwright.llm import manifest


def parent(run):
    return hashlib.sha256("".join(run).encode()).hexdigest()


def levels(leaves):
    out = [list(leaves)]
    while len(out[-1]) > 1:
        out.append([parent(out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def postorder(tree):
    """``(level, index)`` in the order in which nodes become complete."""
    out = []

    def walk(level, index):
        if level:
            for child in (2 * index, 2 * index + 1):
                if child < len(tree[level - 1]):
                    walk(level - 1, child)
        out.append((level, index))

    walk(len(tree) - 1, 0)
    return out


@pytest.mark.parametrize("n", [*range(1, 35), 64, 100, 127])
def test_positions_and_proofs_in_closed_form(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    tree = levels([x.hex() for x in leaves])
    log = manifest.append_log(leaves, manifest.height(n))
    assert [(level, index) for level, index, _ in log] == postorder(tree)
    assert all(manifest.position(level, index, n) == at for at, (level, index, _) in enumerate(log))
    assert all(digest.hex() == tree[level][index] for level, index, digest in log)
    digests = [digest for _, _, digest in log]
    for i, leaf in enumerate(leaves):
        path = manifest.siblings(digests, i, n, manifest.height(n))
        assert manifest.fold(leaf, path).hex() == tree[-1][0]


def text_of(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def expected(rows):
    """Result rows for documents given as dictionaries."""

    def leaf(r, more=0):
        chars = None if r["n_chars"] is None else r["n_chars"] + more
        return hashlib.sha256("".join(map(text_of, (r["doc_id"], r["source"], r["lang"], chars, r["text"]))).encode()).hexdigest()

    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = [r for r in rows if r["lang"] == lang]
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[lang] = own, levels(leaf(r) for r in own)
    top = levels(tree[-1][0] for _, tree in trees.values())
    out = []
    for at, (own, tree) in enumerate(trees.values()):
        for i, r in enumerate(own):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            folded, proof = leaf(r, 1 if changed else 0), ""
            for part, index in ((tree, i), (top, at)):
                for level in part[:-1]:
                    pair = level[index & ~1 : (index & ~1) + 2]
                    proof += "".join(pair[:0] + [x for j, x in enumerate(pair) if j != index & 1])
                    pair[index & 1] = folded
                    folded, index = parent(pair), index >> 1
            root = top[-1][0]
            out.append((r["doc_id"], leaf(r), tree[-1][0], root, hashlib.sha256(proof.encode()).hexdigest(), folded, folded == root))
    return sorted(out, key=str)


def check(df, rows):
    assert sorted(map(tuple, df.collect()), key=str) == expected(rows)


def test_odd_rows_over_several_rounds(spark, odd_docs, monkeypatch):
    # Builders of four leaves: four rounds, ragged right edges, a lone leaf, and a null language.
    monkeypatch.setattr(manifest, "HEIGHT", 2)
    more = spark.range(70).selectExpr("id AS doc_id", "concat('t', id) AS text", "IF(id % 3 = 0, NULL, 'en') AS lang", "'s' AS source", "id AS n_chars")
    lone = spark.createDataFrame([(500, "x", "zz", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd_docs.unionByName(more, allowMissingColumns=True).unionByName(lone, allowMissingColumns=True)
    check(manifest.result(docs), [r.asDict() for r in docs.collect()])
    built = manifest.build(docs)
    log = manifest.log(built.rounds)
    counts = built.leaves.groupBy("tree").count().collect()
    for tree, n in counts:
        nodes = log.where(log.tree == tree).orderBy("pos").collect()
        assert [r["pos"] for r in nodes] == list(range(len(nodes)))
        assert len(nodes) == sum(-(-n >> level) for level in range(manifest.height(n) + 1))


def test_one_row_and_none(spark, no_docs):
    one = spark.createDataFrame([(7, "x", "en", None, 1)], no_docs.schema)
    check(manifest.result(one), [r.asDict() for r in one.collect()])
    assert manifest.result(no_docs).count() == 0


def test_query_matches_sql(spark, duck, sf_dir):
    from panelwright.llm.catalog import ORACLE, QUERIES

    want = duck.sql(ORACLE["op12_manifest"])
    got = QUERIES["op12_manifest"](spark, sf_dir).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
