"""Every registered query with SQL gives the SQL's rows."""

import datetime
import math

import duckdb
import pytest

from filingloom.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return x.date() if isinstance(x, datetime.datetime) and x.time() == datetime.time() else x

    return sorted((tuple(value(x) for x in r) for r in rows), key=lambda r: tuple(str(x) for x in r))


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def database(request):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{request.param}/{t}.parquet'")
    return db, f"/root/testdata/{request.param}"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_matches_sql(spark, database, name):
    database, folder = database
    found = queries.queries()[name](spark, folder)
    columns = sorted(found.columns)
    got = plain([tuple(r) for r in found.select(*[f"`{c}`" for c in columns]).collect()])
    sql = database.execute(queries.ORACLES[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == columns
    want = plain([tuple(r[names.index(c)] for c in columns) for r in sql.fetchall()])
    assert got and len(got) == len(want)
    assert got == want
