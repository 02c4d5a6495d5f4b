"""Every query with SQL gives the SQL's rows."""

import math

import duckdb
import pytest

from filingloom.llm import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def value(x):
        return round(x, 6) if isinstance(x, float) and not math.isnan(x) else x

    return sorted((tuple(value(x) for x in r) for r in rows), key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, name, size):
    folder = f"/root/testdata/{size}"
    found = queries.queries()[name](spark, folder)
    columns = sorted(found.columns)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    sql = db.execute(queries.ORACLES[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in sql.fetchall()]
    assert plain([tuple(r) for r in found.select(*columns).collect()]) == plain(want)
