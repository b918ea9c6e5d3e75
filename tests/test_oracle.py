"""Every query with a SQL counterpart returns the same rows in both engines."""

import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLE[name])
    assert df.columns == [c[0] for c in result.description]
    ours, theirs = _sorted(df.collect()), _sorted(result.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["period_start", "period_end", "return", "log_accumulated"]
    assert df.count() > 0
