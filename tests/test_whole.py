"""The registered queries that leave nothing of their tables out."""

import duckdb

from filingloom.plans import queries, render


def test_every_paragraph_of_long_documents(spark, tmp_path):
    paragraphs = [f"Item {i}. Straße № {i} & <b> Ünïcode, Item 7" for i in range(30)]
    texts = {1: "\n".join(paragraphs), 2: "\n \nSIGNATURES 12\n", 3: "привет  мир 42\nPart II"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = {str(k): [" ".join(p.split()) for p in t.split("\n") if p.strip()] for k, t in texts.items()}
    flat = sorted((k, p) for k, ps in own.items() for p in ps)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("sections_roundtrip", "contents_roundtrip", "cross_reference_roundtrip"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        assert sorted((r.ref, r.body) for r in got.collect()) == flat, name
        assert sorted(tuple(r) for r in got.collect()) == sorted(db.execute(queries.ORACLES[name]).fetchall()), name
    named = queries.QUERIES["named_section_roundtrip"](spark, str(tmp_path)).collect()
    assert {r.text for r in named if r.ref == "1" and r.name == "Chapter ninth part"} == {" ".join(["Chapter ninth part", *own["1"][8:]])}
    assert sorted(tuple(r) for r in named) == sorted(db.execute(queries.ORACLES["named_section_roundtrip"]).fetchall()) and len(named) == 27


def test_ties_and_all_facts(spark, tmp_path):
    day = "timestamp'1997-08-05'"
    lines = [(1, i, 10 * i, i, f) for i, f in enumerate("RANAR" "NN", 1)] + [(2, 1, 5, 1, "A"), (2, 2, 4, 1, "N"), (3, 1, 2, 2, "N"), (3, 1, 1, 1, "R"), (4, 1, 1, 1, "A")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").selectExpr("*", "'O' l_linestatus", "1.5D l_extendedprice", f"{day} l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k, 7 if k in (2, 10, 9) else k, float(k)) for k in (1, 2, 3, 4, 9, 10)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").selectExpr("*", "'1-URGENT' o_orderpriority", f"{day} o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    for t in ("lineitem", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = {
        "provenance_join": {("1", 7, 1), ("2", 2, 1), ("3", 2, 1), ("4", 1, 1)},
        "most_common_value": {(1, "N", 3), (2, "A", 1), (3, "R", 1), (4, "A", 1)},
        "frames_cross_section": {("0000000001", "CY1997Q3I", 1.0), ("0000000003", "CY1997Q3I", 3.0), ("0000000004", "CY1997Q3I", 4.0), ("0000000007", "CY1997Q3I", 9.0)},
    }
    for name, rows in want.items():
        got = [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]
        assert len(got) == len(rows) and set(got) == rows == set(db.execute(queries.ORACLES[name]).fetchall()), name


def test_shortened_text_of_long_keys(spark, tmp_path):
    keys = [0, 7, 42, 999, 1000, 59999, 1234567, 2**63 - 1]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(tuple(r) for r in queries.queries()["shortened_text"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert got == sorted((str(k), f"First of {k}.") for k in keys) == sorted(db.execute(queries.oracle_sql()["shortened_text"]).fetchall())


def test_rendered_orders_are_dealt_out_as_columns(spark, tmp_path):
    """No rendered text goes through a shuffle; each distinct line stands in its order's document once, in order."""
    lines = [(1, 1, 2, 3), (1, 1, 2, 3), (1, 2, 5, 1), (3, 1, 2, 3), (3, 10, 4, 4), (9007199254740993, 1, 1, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").selectExpr("*", "2.0D l_quantity", "1.5D l_extendedprice", "timestamp'1997-08-05' l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    for rendered, mark, column in ((render.presentation_linkbases, "link:loc", "xml"), (render.inline_prices, "ix:nonFraction", "content"), (render.dimensional_prices, "ix:nonFraction", "content")):
        found = rendered(spark, str(tmp_path))
        above, below = found._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
        assert mark in above and mark not in below
        assert {r.ref: r[column].count(f"<{mark}") for r in found.collect()} == {k: n + (column == "xml") for k, n in (("1", 2), ("3", 2), ("9007199254740993", 1))}
    flipped = {(r.accession, r.concept): (r.statement, r.value) for r in queries.QUERIES["negation_flip"](spark, str(tmp_path)).collect()}
    assert flipped == {
        ("1", "tpch:Price1-2-3"): ("BalanceSheet", -1.5), ("1", "tpch:Price2-5-1"): ("BalanceSheet", 1.5), ("3", "tpch:Price1-2-3"): ("", 1.5),
        ("3", "tpch:Price10-4-4"): ("", 1.5), ("9007199254740993", "tpch:Price1-1-1"): ("", 1.5),
    }
