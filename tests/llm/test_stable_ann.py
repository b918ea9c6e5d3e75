"""Neighbours over stable projections against brute force."""

import math

import numpy as np
import pytest

from panelwright.llm import stable_ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=stable_ann.K, every=stable_ann.QUERY_EVERY):
    """``{query: [(id, score), ...]}`` for valid rows ``(id, vector)``."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = stable_ann.cosines(x, x[i])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hits / max(sum(map(len, want.values())), 1)


def test_distribution_function():
    assert stable_ann.chi_square(2.0, 2) == pytest.approx(1 - math.exp(-1))
    # Tabulated points of the chi-square distribution.
    assert stable_ann.quantile(0.95, 16) == pytest.approx(26.296, abs=1e-3)
    assert stable_ann.quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def test_recall_and_scores_over_many_cells(spark, monkeypatch):
    # Small cells, so that second visits, parts of cells and the stopping test all take part.
    monkeypatch.setattr(stable_ann, "CELL_ROWS", 200)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 32)) * 2
    x = (centres[rng.integers(0, 12, 3000)] + rng.standard_normal((3000, 32))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(stable_ann.result(spark.createDataFrame(rows, SCHEMA))), brute(rows)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.9
    for q, hits in got.items():
        for i, score in hits:
            assert score == stable_ann.cosines(x[[i]].astype(float), x[q].astype(float))[0]
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))


def test_copies_ties_and_rows_that_take_no_part(spark, monkeypatch):
    monkeypatch.setattr(stable_ann, "CELL_ROWS", 50)
    rng = np.random.default_rng(6)
    valid = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(300)]
    # A third of all rows is one vector; another is scaled, so its copies tie but differ.
    valid += [(i, [1.0] * 8) for i in range(300, 500)] + [(i, [2.0 ** (i % 7)] * 8) for i in range(500, 600)]
    odd = [(1000, None), (1050, []), (1100, [0.0] * 8), (1150, [1.0] * 7 + [None]), (1200, [float("nan")] * 8), (1250, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (1300, [1.0])]
    df = spark.createDataFrame(valid + odd + valid[:40], SCHEMA).selectExpr("*", "vec_id AS cell", "1 AS part", "2 AS bound")
    got, want = found(stable_ann.result(df)), brute(valid)
    assert got.keys() == want.keys()
    for q in want:
        if q >= 300:
            assert got[q] == want[q]
    assert recall(got, want) >= 0.9


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 2.0])]
    assert found(stable_ann.result(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert stable_ann.result(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0
    assert stable_ann.result(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_on_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got, want = found(stable_ann.result(table)), brute(rows)
    assert recall(got, want) >= 0.9 and got.keys() == want.keys()
