"""Every query with an oracle gives what the SQL gives."""

import pytest

import __spark_entry__ as entry

CORE = [n for n in entry.core.QUERIES if n in entry.core.ORACLES]


def plain(v):
    return round(v, 9) if isinstance(v, float) else int(v) if type(v).__name__ == "Decimal" else v


def assert_same(spark, duck, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    cursor = duck.execute(sql)
    cols = [d[0] for d in cursor.description]
    want = [tuple(plain(dict(zip(cols, r, strict=True))[c]) for c in sorted(cols)) for r in cursor.fetchall()]
    assert names == sorted(cols)
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_oracle(spark, duck, sf_dir, name):
    assert_same(spark, duck, sf_dir, entry.core.QUERIES[name], entry.core.ORACLES[name])


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["playlist_id", "ordinal", "media_sequence", "range_start", "range_end"]
    assert df.limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
