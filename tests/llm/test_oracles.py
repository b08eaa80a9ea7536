"""Training-data queries that SQL can express give what the SQL gives, over whole tables."""

import pytest

from streamloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    cursor = duck.execute(queries.ORACLES[name])
    cols = [d[0] for d in cursor.description]
    want = [tuple(dict(zip(cols, r, strict=True))[c] for c in sorted(cols)) for r in cursor.fetchall()]
    assert names == sorted(cols) and sorted(got, key=str) == sorted(want, key=str)
