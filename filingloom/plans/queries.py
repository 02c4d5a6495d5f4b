"""Registered queries of the engine's operators, each with the SQL that gives its rows where SQL can.

Each query runs over whole tables.  Many render a table as filings, read them
back with the engine and return what was read; their SQL selects the table's
own columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingloom.functions import names, numbers
from filingloom.functions import text as texts
from filingloom.operators import classify, linkbase, listing, standardize, warehouse, windows, xbrl
from filingloom.plans import render
from filingloom.plans.render import table, text
from filingloom.sources import facts_json

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


KEY = "l_linenumber || '-' || l_partkey || '-' || l_suppkey"


# -- XBRL ------------------------------------------------------------------------


@query(f"""SELECT CAST(l_orderkey AS VARCHAR) AS accession, 'tpch:Price' || {KEY} AS concept, round(l_extendedprice, 2) AS value, 'USD' AS unit,
  CAST(l_shipdate AS DATE) AS period_end, true AS is_instant, 2 AS decimals, '{{}}' AS dimensions FROM lineitem""")
def xbrl_inline_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = xbrl.facts(render.inline_prices(spark, sf_dir))
    return rows.select("accession", "concept", F.round("value", 2).alias("value"), "unit", "period_end", "is_instant", "decimals", "dimensions")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS accession, 'tpch:Total' || o_orderkey AS concept, round(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END, 2) AS value,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS period_start, last_day(o_orderdate) AS period_end, false AS is_instant FROM orders""")
def xbrl_classic_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = xbrl.facts(render.classic_prices(spark, sf_dir))
    return rows.select("accession", "concept", F.round("value", 2).alias("value"), "period_start", "period_end", "is_instant")


@query(f"""SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS accession, 'x' || {KEY} || '-' || CAST(l_quantity AS INTEGER) AS context_ref, round(l_quantity, 0) AS value,
  '{{"tpch:PartAxis":"tpch:Part' || l_partkey || '"' || CASE WHEN l_partkey % 2 = 0 THEN ',"tpch:SupplierAxis":"tpch:Supplier' || l_suppkey || '"' ELSE '' END || '}}' AS dimensions FROM lineitem""")
def context_dims_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = xbrl.facts(render.dimensional_prices(spark, sf_dir))
    return rows.select("accession", "context_ref", F.round("value", 0).alias("value"), "dimensions")


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS ref, 'tpch:Nation' || n_nationkey AS concept, n_name AS label FROM nation""")
def label_linkbase_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkbase.label_rows(render.label_linkbases(spark, sf_dir))


@query(f"""SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS ref, 'IncomeStatement' AS statement, 'tpch:Total' AS parent, 'tpch:Price' || {KEY} AS child,
  CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM lineitem""")
def calculation_linkbase_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkbase.calculation_rows(render.calculation_linkbases(spark, sf_dir)).select("ref", "statement", "parent", "child", "weight")


@query(f"""SELECT CAST(l_orderkey AS VARCHAR) AS accession, 'tpch:Price' || {KEY} AS concept, CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'BalanceSheet' END AS statement,
  CASE WHEN l_orderkey % 3 = 0 THEN '[]' ELSE '["BalanceSheet"]' END AS statements,
  round(CASE WHEN l_orderkey % 3 <> 0 AND l_partkey % 2 = 0 THEN -l_extendedprice ELSE l_extendedprice END, 2) AS value FROM lineitem""")
def negation_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = render.presentation_linkbases(spark, sf_dir)
    rows = xbrl.facts(render.inline_prices(spark, sf_dir), statements=linkbase.statement_rows(books), negations=linkbase.negation_rows(books))
    return rows.select("accession", "concept", "statement", "statements", F.round("value", 2).alias("value"))


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fact rows, without a document."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    statements = F.when(F.col("l_returnflag") == "R", F.array(F.lit("IncomeStatement"), F.lit("Equity"))).when(F.col("l_returnflag") == "A", F.array(F.lit("BalanceSheet"), F.lit("Equity"))).otherwise(F.array(F.lit("CashFlow")))
    return lines.select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("accession"),
        F.get(statements, F.lit(0)).alias("statement"), F.to_json(statements).alias("statements"), text("tpch:", F.col("l_returnflag"), F.col("l_linestatus")).alias("concept"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("standard_concept"), F.col("o_orderpriority").alias("label"), F.col("l_extendedprice").alias("value"), F.lit("USD").alias("unit"),
        F.col("o_orderdate").cast("date").alias("period_start"), F.to_date(text(F.year("l_shipdate").cast("string"), "-12-31")).alias("period_end"), (F.col("l_linenumber") == 1).alias("is_instant"),
        F.when(F.col("l_linenumber") == 2, F.lit('{"a":"b"}')).otherwise("{}").alias("dimensions"), F.lit(2).alias("decimals"),
        render.line_key().alias("context_ref"), F.lit("usd").alias("unit_ref"), F.lit("").alias("source_selector"),
    )


LINE_FACTS = f"""WITH facts AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS accession,
  CASE l_returnflag WHEN 'R' THEN ['IncomeStatement', 'Equity'] WHEN 'A' THEN ['BalanceSheet', 'Equity'] ELSE ['CashFlow'] END AS member,
  'tpch:' || l_returnflag || l_linestatus AS concept, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS standard_concept, o_orderpriority AS label, l_extendedprice AS value, 'USD' AS unit,
  CAST(o_orderdate AS DATE) AS period_start, CAST(year(l_shipdate) || '-12-31' AS DATE) AS period_end, l_linenumber = 1 AS is_instant,
  CASE WHEN l_linenumber = 2 THEN '{{"a":"b"}}' ELSE '{{}}' END AS dimensions, {KEY} AS context_ref FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""
YEARS = [f"{y}-12-31" for y in range(2001, 1994, -1)]


def _pivot_sql(where: str, keys: str) -> str:
    columns = ", ".join(f"max(value) FILTER (period_end = DATE '{y}') AS \"{y}\"" for y in YEARS)
    return f"""{LINE_FACTS}, shown AS (SELECT *, row_number() OVER (PARTITION BY {keys}, period_end ORDER BY accession DESC, period_start DESC, context_ref DESC, value DESC) AS r FROM facts WHERE {where})
SELECT {keys}, {columns} FROM shown WHERE r = 1 GROUP BY {keys}"""


@query(_pivot_sql("dimensions = '{}'", "concept, label"))
def statement_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.statement_view(line_facts(spark, sf_dir), periods=YEARS)


@query(_pivot_sql("list_contains(member, 'Equity')", "concept, label, dimensions"))
def statement_pivot_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.statement_view(line_facts(spark, sf_dir), periods=YEARS, statement="Equity", consolidated=False)


@query(_pivot_sql("dimensions = '{}' AND standard_concept IS NOT NULL AND (is_instant OR round(date_diff('day', period_start, period_end) / 30.44::DOUBLE) = 6)", "standard_concept"))
def statement_pivot_standard_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.statement_view(line_facts(spark, sf_dir), periods=YEARS, by="standard_concept", months=6)


@query(f"""{LINE_FACTS} SELECT accession, concept, context_ref FROM facts WHERE list_contains(member, 'Equity')""")
def multi_statement_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.view_rows(line_facts(spark, sf_dir), statement="Equity", consolidated=False).select("accession", "concept", "context_ref")


@query(f"""{LINE_FACTS}, keyed AS (SELECT *, cik || '|' || accession || '|' || concept || '|' || unit || '|' || period_start || '|' || period_end || '|' || is_instant || '|' || dimensions AS fact_key FROM facts),
stored AS (SELECT DISTINCT fact_key FROM keyed WHERE right(accession, 1) IN ('0', '2', '4', '6', '8')), fresh AS (SELECT fact_key, min(round(value, 2)) AS value FROM keyed GROUP BY 1)
SELECT fact_key, value FROM fresh WHERE fact_key NOT IN (SELECT fact_key FROM stored)""")
def warehouse_idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warehouse.fact_rows(line_facts(spark, sf_dir)).withColumn("value", F.round("value", 2))
    stored = rows.where(F.right("accession", F.lit(1)).isin("0", "2", "4", "6", "8"))
    return warehouse.new_rows(rows, stored, ["fact_key"], ["value"]).select("fact_key", "value")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1""")
def fact_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return xbrl.first_of(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("""SELECT CAST(round(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) / 30.44::DOUBLE) AS INTEGER) AS months, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def period_month_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy(numbers.months(F.col("o_orderdate"), F.col("l_shipdate")).alias("months")).agg(F.count("*").alias("n"))


@query("""WITH facts AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS accession, o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'IncomeStatement' WHEN o_custkey % 3 = 1 THEN 'ComprehensiveIncome' ELSE 'Equity' END AS statement,
  CASE WHEN o_orderkey % 5 = 0 THEN 'us-gaap:NetIncomeLoss' ELSE 'tpch:Other' END AS concept FROM orders),
usable AS (SELECT accession, statement FROM facts GROUP BY 1, 2 HAVING statement = 'IncomeStatement' OR bool_or(concept = 'us-gaap:NetIncomeLoss'))
SELECT accession, statement, concept, o_orderkey FROM facts SEMI JOIN usable USING (accession, statement)""")
def select_statement_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("o_custkey") % 3
    rows = table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("accession"), "o_orderkey", F.when(third == 0, "IncomeStatement").when(third == 1, "ComprehensiveIncome").otherwise("Equity").alias("statement"),
        F.when(F.col("o_orderkey") % 5 == 0, "us-gaap:NetIncomeLoss").otherwise("tpch:Other").alias("concept"),
    )
    return classify.select_statement(rows, "IncomeStatement").select("accession", "statement", "concept", "o_orderkey")


ROLE_CASES = [
    ("http://x/role/ConsolidatedBalanceSheets", [], "BalanceSheet"), ("http://x/role/ConsolidatedBalanceSheetsParenthetical", [], ""), ("http://x/role/StatementsOfOperations", [], "IncomeStatement"),
    ("http://x/role/ComprehensiveIncomeStatements", [], "ComprehensiveIncome"), ("http://x/role/R4", ["us-gaap:StatementOfCashFlowsAbstract", "us-gaap:X"], "CashFlow"),
    ("http://x/role/StockholdersEquity", ["us-gaap:EquityTextBlock", "us-gaap:EquityAbstract"], ""), ("http://x/role/Other", ["us-gaap:Assets", "us-gaap:Liabilities", "us-gaap:StockholdersEquity"], "BalanceSheet"),
    ("http://x/role/Other", ["us-gaap:Assets", "us-gaap:Liabilities"], ""), ("http://x/role/DocumentAndEntityInformation", [], "CoverPage"), ("http://x/role/SegmentDetails", ["us-gaap:Revenues"], ""),
    ("StatementOfProfitOrLoss", ["ifrs-full:Revenue", "ifrs-full:ProfitLoss"], "IncomeStatement"),
]


@query(f"""SELECT p_partkey, [{', '.join(f"'{s}'" for _, _, s in ROLE_CASES)}][CAST(p_partkey % {len(ROLE_CASES)} + 1 AS BIGINT)] AS statement FROM part""")
def role_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = F.array(*[F.struct(F.lit(r).alias("role"), (F.array(*[F.lit(c) for c in own]) if own else F.array().cast("array<string>")).alias("concepts")) for r, own, _ in ROLE_CASES])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.element_at(cases, (F.col("p_partkey") % len(ROLE_CASES) + 1).cast("int")).alias("c"))
    return rows.select("p_partkey", classify.classify(F.col("c.role"), F.col("c.concepts")).alias("statement"))


@query("""SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS accession, round(o_totalprice, 2) AS value, round(sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END), 2) AS total, count(*) AS children
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice""")
def calculation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = linkbase.calculation_rows(render.calculation_linkbases(spark, sf_dir)).withColumn("ref", F.lpad("ref", 10, "0"))
    where = [F.lit("USD").alias("unit"), F.lit(None).cast("date").alias("period_start"), F.to_date(F.lit("2024-12-31")).alias("period_end"), F.lit("{}").alias("dimensions")]
    lines = table(spark, sf_dir, "lineitem").select(F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("accession"), *where, text("tpch:Price", render.line_key()).alias("concept"), F.col("l_extendedprice").alias("value"))
    totals = table(spark, sf_dir, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("accession"), *where, F.lit("tpch:Total").alias("concept"), F.col("o_totalprice").alias("value"))
    checked = linkbase.roll_up(lines.unionByName(totals), arcs)
    return checked.select("accession", F.round("value", 2).alias("value"), F.round("total", 2).alias("total"), "children")


@query("""SELECT p_partkey, p_type AS concept, CASE p_brand WHEN 'Brand#11' THEN NULL ELSE upper(p_type) END AS standard_concept FROM part""")
def standardize_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    mapping = parts.select(F.col("p_type").alias("concept"), F.upper("p_type").alias("standard_concept")).distinct()
    rows = standardize.standardized(parts.select("p_partkey", F.col("p_type").alias("concept"), "p_brand"), mapping)
    return rows.select("p_partkey", "concept", F.when(F.col("p_brand") != "Brand#11", F.col("standard_concept")).alias("standard_concept"))


@query("""SELECT p_partkey, CASE WHEN p_brand < 'Brand#3' THEN lower(p_brand) END AS standard_concept FROM part""")
def standardize_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("concept"))
    return standardize.standardized(rows, lambda c: c.lower() if c < "Brand#3" else None).select("p_partkey", "standard_concept")


@query(f"""{LINE_FACTS} SELECT accession, concept, context_ref, round(value, 2) AS value, period_start, period_end, is_instant, dimensions, member[1] AS statement FROM facts""")
def facts_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = line_facts(spark, sf_dir)
    documents = facts_json.facts_documents(facts, facts.select("accession", F.lit("file:///x").alias("url")).distinct())
    return facts_json.read_facts(documents).select("accession", "concept", "context_ref", F.round("value", 2).alias("value"), "period_start", "period_end", "is_instant", "dimensions", "statement")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS accession, CAST(l_linenumber AS VARCHAR) AS context_ref, 'c' || l_partkey AS concept, round(arg_min(l_quantity, l_suppkey * 1000000 + l_quantity) * 100, 2) AS value FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey""")
def picked_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = F.to_json(F.struct(
        text("c", F.col("l_partkey").cast("string")).alias("concept"), F.lit("x").alias("label"), F.format_number("l_quantity", 0).alias("value"), F.lit(2).alias("scale"), F.lit("").alias("sign"), F.lit("USD").alias("unit"),
        F.lit("u").alias("unitRef"), F.col("l_linenumber").cast("string").alias("contextRef"), F.lit("2024-12-31").alias("periodEnd"), F.lit(True).alias("isInstant"),
    ))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", fact.alias("fact")).alias("x"))
    picks = lines.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("x"))["fact"], ",").alias("facts"))
    payload = text('{"version":1,"provenance":{"cik":"1","accession":"', F.col("l_orderkey").cast("string"), '","url":""},"selector":"#t","kind":"table","facts":[', F.col("facts"), "]}")
    rows = facts_json.pick_facts(facts_json.read_picks(picks.select(payload.alias("json"))))
    return rows.select("accession", "context_ref", "concept", F.round("value", 2).alias("value"))


# -- text ------------------------------------------------------------------------


@query("""SELECT p_partkey, round(CASE WHEN greatest(length(trim(p_name)), length(trim(p_type))) = 0 THEN 1.0 ELSE 1 - levenshtein(lower(trim(p_name)), lower(trim(p_type))) / greatest(length(trim(p_name)), length(trim(p_type))) END, 9) AS ratio FROM part""")
def similarity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(texts.similarity(F.col("p_name"), F.col("p_type")), 9).alias("ratio"))


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS ps FROM documents),
e AS (SELECT doc_id, unnest(ps) AS paragraph, generate_subscripts(ps, 1) AS index FROM p) SELECT doc_id, CAST(index AS INTEGER) AS index, paragraph FROM e WHERE contains(lower(paragraph), 'license')""")
def find_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.find_paragraphs(table(spark, sf_dir, "documents"), "License", keep=["doc_id"], html_col="text")


@query(r"""WITH b AS (SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<body.*?</body>') THEN regexp_extract(html, '(?is)<body.*?</body>') ELSE html END AS body FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM b""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", texts.html_to_text(F.col("html")).alias("text"))


ENTITIES_SQL = "x"
for _entity, _letter in texts.ENTITIES:
    _a, _b = _entity.replace("'", "''"), _letter.replace("'", "''")
    ENTITIES_SQL = f"replace({ENTITIES_SQL}, '{_a}', '{_b}')"


@query(rf"""WITH b AS (SELECT page_id, CASE WHEN contains(html, '</body>') THEN regexp_extract(html, '(?is)<body\b[^>]*>.*</body>') ELSE regexp_extract(html, '(?is)<body\b[^>]*>.*') END AS body FROM pages),
c AS (SELECT page_id, regexp_replace(regexp_replace(body, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g') AS body FROM b),
l AS (SELECT page_id, string_split(regexp_replace(body, '(?is)</?(?:{"|".join(texts.BLOCK_TAGS)})\b[^>]*>', chr(10), 'g'), chr(10)) AS parts FROM c),
p AS (SELECT page_id, list_filter(list_transform(list_transform(parts, lambda x: regexp_replace(x, '<[^>]+>', ' ', 'g')), lambda x: trim(regexp_replace({ENTITIES_SQL}, '\s+', ' ', 'g'))), lambda x: x <> '') AS ps FROM l)
SELECT page_id, CAST(generate_subscripts(ps, 1) AS INTEGER) AS index, unnest(ps) AS paragraph FROM p""")
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(texts.paragraphs(F.col("html"))).alias("at", "paragraph"))
    return rows.select("page_id", (F.col("at") + 1).alias("index"), "paragraph")


@query("""SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'licensed under', ''))) / 14 AS DOUBLE) AS score FROM documents WHERE contains(lower(text), 'licensed under')""")
def full_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.full_text_search(table(spark, sf_dir, "documents"), "licensed under", page=None).select("doc_id", "score")


# -- windows -----------------------------------------------------------------------


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""")
def forward_fill_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("order"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase"))
    return windows.forward_fill(events, ["last_purchase"], by=["user_id"], order="order").select("event_id", "last_purchase")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY place) AS r FROM l) SELECT doc_id, CAST(place AS INTEGER) AS place, line FROM c WHERE n < 3 OR r <= 2""")
def nav_line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("place", F.col("place") + 1)
    return windows.navigation_lines(lines, by=["doc_id"], order="place", line="line", least=3, keep=2)


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS place FROM lineitem),
s AS (SELECT *, CASE WHEN l_linenumber = lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY place) + 1 THEN 0 ELSE 1 END AS step FROM o),
r AS (SELECT *, sum(step) OVER (PARTITION BY l_orderkey ORDER BY place) AS run FROM s)
SELECT l_orderkey, CAST(place AS INTEGER) AS place, l_linenumber FROM r QUALIFY count(*) OVER (PARTITION BY l_orderkey, run) > 1""")
def page_number_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")))
    return windows.page_runs(lines, by=["l_orderkey"], order="place", number="l_linenumber").select("l_orderkey", "place", "l_linenumber")


@query("""WITH m AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS o, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS item FROM lineitem)
SELECT l_orderkey, CAST(o AS INTEGER) AS offset_, item, CAST(coalesce((SELECT min(n.o) FROM m n WHERE n.l_orderkey = m.l_orderkey AND n.o > m.o AND n.item IS NOT NULL AND n.item <>
  (SELECT arg_max(p.item, p.o) FROM m p WHERE p.l_orderkey = m.l_orderkey AND p.o <= m.o AND p.item IS NOT NULL)), 999) AS INTEGER) AS stop FROM m""")
def item_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")
    marks = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(order).alias("offset_"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("item"), F.lit(999).alias("length"))
    return windows.ends_at_other_item(marks, by="l_orderkey", order="offset_").select("l_orderkey", "offset_", "item", "stop")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS place FROM lineitem),
c AS (SELECT l_orderkey, l_returnflag AS quantity, CAST(count(*) AS BIGINT) AS n, min(place) AS first FROM o GROUP BY 1, 2)
SELECT l_orderkey, quantity, n FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, first) = 1""")
def most_common_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("quantity"), F.row_number().over(order).alias("place"))
    return windows.most_common(lines, by=["l_orderkey"], value="quantity", order="place")


# -- listings -----------------------------------------------------------------------


@query("""SELECT c_name AS entity, 'T' || c_custkey AS ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer WHERE contains(lower(c_name), '00007') OR upper('T' || c_custkey) = '00007'""")
def ticker_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("cik_str"), text("T", F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_name").alias("title")))
    payloads = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 16).alias("part")).agg(F.array_join(F.collect_list(text('"', F.col("c_custkey").cast("string"), '":', entry)), ",").alias("entries"))
    return listing.lookup(listing.tickers(payloads.select(text("{", F.col("entries"), "}").alias("json"))), " 00007 ")


@query("""SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, c_name AS name, 'operating' AS "entityType", c_mktsegment AS "sicDescription", '' AS website FROM customer""")
def filer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("cik"), F.col("c_name").alias("name"), F.lit("operating").alias("entityType"), F.col("c_mktsegment").alias("sicDescription")))
    return listing.profile(table(spark, sf_dir, "customer").select(payload.alias("json"))).select("cik", "name", "entityType", "sicDescription", "website")


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    filing = F.struct("o_orderkey", F.col("o_orderkey").cast("string").alias("accession"), F.col("o_orderpriority").alias("form"), render.day(F.col("o_orderdate")).alias("filed"), (F.col("o_orderkey") % 2).cast("int").alias("flag"))
    own = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(filing)).alias("f"))
    recent = F.struct(
        F.col("f.accession").alias("accessionNumber"), F.col("f.filed").alias("reportDate"), F.col("f.filed").alias("filingDate"), F.col("f.filed").alias("acceptanceDateTime"), F.col("f.form").alias("form"),
        F.col("f.accession").alias("primaryDocument"), F.col("f.flag").alias("isXBRL"), F.col("f.flag").alias("isInlineXBRL"), F.col("f.flag").alias("isXBRLNumeric"),
    )
    return own.select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.struct(recent.alias("recent")).alias("filings"))).alias("json"))


@query("""SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(o_orderkey AS VARCHAR) AS accession, o_orderpriority AS form, strftime(o_orderdate, '%Y-%m-%d') AS filed, o_orderkey % 2 = 1 AS "isXBRL" FROM orders""")
def recent_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.recent_filings(_submissions(spark, sf_dir)).select("cik", "accession", "form", "filed", "isXBRL")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS accession, CAST(l_linenumber AS VARCHAR) AS document, CASE WHEN o_orderpriority <= '3' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS "acceptanceDateTime",
  CASE WHEN o_orderpriority <= '3' THEN NULL ELSE o_orderkey % 2 = 1 END AS "isXBRL" FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def filings_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    hits = lines.select(F.col("l_orderkey").cast("string").alias("accession"), F.col("l_linenumber").cast("string").alias("document"), F.lit("10-K").alias("form"), F.lit("").alias("reportDate"), F.lit("").alias("filed"))
    filings = listing.recent_filings(_submissions(spark, sf_dir)).where("form > '3'")
    return listing.filings_of(hits, filings).select("accession", "document", "acceptanceDateTime", "isXBRL")


@query("""SELECT c_custkey AS place, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, c_name AS entity, 'a' || c_custkey AS accession, 'd' || c_custkey || '.htm' AS document, round(c_acctbal, 2) AS score FROM customer""")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    hit = F.struct(text("a", key, ":d", key, ".htm").alias("_id"), F.col("c_acctbal").alias("_score"), F.struct(F.array(F.lpad(key, 10, "0")).alias("ciks"), F.array(text(F.col("c_name"), "  (T", key, ")  (CIK ", F.lpad(key, 10, "0"), ")")).alias("display_names"), F.lit("10-K").alias("form"), text("a", key).alias("adsh")).alias("_source"))
    payloads = table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(F.struct(F.array(hit).alias("hits")).alias("hits"))).alias("json"))
    rows = listing.search_hits(payloads)
    return rows.select(F.substring("accession", 2, 20).cast("bigint").alias("place"), "cik", "entity", "accession", "document", F.round("score", 2).alias("score"))


@query("""WITH f AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS filed, CAST(o_orderkey AS VARCHAR) AS accession FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1997 AND quarter(o_orderdate) = 3)
SELECT cik, 'CY1997Q3I' AS frame, round(o_totalprice, 2) AS value FROM f QUALIFY row_number() OVER (PARTITION BY cik ORDER BY filed DESC, accession DESC) = 1""")
def frames_cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    value = F.struct(render.day(F.col("o_orderdate")).alias("end"), F.col("o_totalprice").alias("val"), F.col("o_orderkey").cast("string").alias("accn"), render.day(F.col("o_orderdate")).alias("filed"))
    own = orders.groupBy("o_custkey", "o_orderpriority").agg(F.collect_list(value).alias("values"))
    tags = own.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", F.struct(F.create_map(F.lit("USD"), F.col("values")).alias("units"))))).alias("tags"))
    payloads = tags.select(F.to_json(F.struct(F.col("o_custkey").alias("cik"), F.create_map(F.lit("tpch"), F.col("tags")).alias("facts"))).alias("json"))
    rows = listing.frames(listing.company_facts(payloads), "tpch", "1-URGENT", "USD", "CY1997Q3I")
    return rows.select("cik", "frame", F.round("value", 2).alias("value"))


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS ref, n_name || '.htm' AS filename, CASE WHEN n_nationkey % 3 = 0 THEN 'EX-99.1' ELSE '10-K' END AS type, CAST(n_nationkey AS INTEGER) AS size FROM nation WHERE n_nationkey % 3 = 0 OR contains(upper(n_name), 'IN')""")
def submission_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    kind = F.when(F.col("n_nationkey") % 3 == 0, "EX-99.1").otherwise("10-K")
    about = F.when(F.contains(F.upper("n_name"), F.lit("IN")), "PRESS RELEASE").otherwise("ANNUAL REPORT")
    block = text("<DOCUMENT>\n<TYPE>", kind, "\n<SEQUENCE>1\n<FILENAME>", F.col("n_name"), ".htm\n<DESCRIPTION>", about, "\n<TEXT>\nbody\n</TEXT>\n</DOCUMENT>\n")
    full = nation.groupBy("n_regionkey").agg(F.array_join(F.collect_list(block), "").alias("text")).select(F.col("n_regionkey").cast("string").alias("ref"), "text")
    sizes = nation.select(F.col("n_regionkey").cast("string").alias("ref"), text(F.col("n_name"), ".htm").alias("name"), F.col("n_nationkey").cast("int").alias("size"))
    return listing.press_releases(listing.submission_documents(full, sizes)).select("ref", "filename", "type", "size")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS ref, s_name AS name, 'Town ' || s_nationkey AS location, CAST(s_suppkey AS INTEGER) AS firm_id, s_suppkey % 2 = 0 AS icfr_attestation FROM supplier""")
def auditor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filingloom.operators.exhibits import auditors

    key = F.col("s_suppkey").cast("string")
    flag = F.when(F.col("s_suppkey") % 2 == 0, "ixt:fixed-true").otherwise("ixt:fixed-false")
    content = text(
        '<ix:nonNumeric name="dei:AuditorName" contextRef="c">', F.col("s_name"), '</ix:nonNumeric><ix:nonNumeric name="dei:AuditorLocation" contextRef="c">Town&#160;', F.col("s_nationkey").cast("string"),
        '</ix:nonNumeric><ix:nonNumeric name="dei:AuditorFirmId" contextRef="c">', key, '</ix:nonNumeric><ix:nonNumeric name="dei:IcfrAuditorAttestationFlag" format="', flag, '">x</ix:nonNumeric>',
    )
    return auditors(table(spark, sf_dir, "supplier").select(key.alias("ref"), content.alias("content")))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS ref, 'companies_house' AS system, CAST(o_custkey AS VARCHAR) AS entity_value, CAST(CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE date_trunc('month', o_orderdate) END AS DATE) AS period_end FROM orders""")
def account_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made_up = F.when(F.col("o_orderstatus") == "F", render.day(F.col("o_orderdate")))
    item = F.struct(F.col("o_orderkey").cast("string").alias("transaction_id"), render.day(F.trunc("o_orderdate", "month")).alias("action_date"), F.struct(made_up.alias("made_up_date")).alias("description_values"), F.struct(text("http://x/", F.col("o_orderkey").cast("string")).alias("document_metadata")).alias("links"))
    payloads = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("json")).select(F.col("o_custkey").cast("string").alias("company_number"), "json")
    return listing.account_handles(payloads).select("ref", "system", "entity_value", "period_end")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(2 * l_linenumber AS INTEGER) AS start, CAST(2 * l_linenumber + 1 AS INTEGER) AS stop FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 25, 25 FROM lineitem""")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (2 * F.col("l_linenumber")).cast("string")
    pages = text(start, "&#8211;", (2 * F.col("l_linenumber") + 1).cast("string"), ", (a), 25")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode(names.page_ranges(pages)).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "r.start", "r.stop")


@query("""WITH r AS (SELECT n_regionkey, list('| ' || n_name || ' | ' || n_nationkey || ' |' ORDER BY n_nationkey) AS l FROM nation GROUP BY 1)
SELECT CAST(n_regionkey AS VARCHAR) AS accession, '| Nation | Key |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(l, chr(10)) AS markdown FROM r""")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("n_nationkey", F.array(F.lit(""), F.col("n_name"), F.lit("$"), F.col("n_nationkey").cast("string")).alias("cells"))
    grids = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(row))["cells"].alias("rows"))
    header = F.array(F.lit("Nation"), F.lit(" "), F.lit("Key"))
    return grids.select(F.col("n_regionkey").cast("string").alias("accession"), facts_json.table_markdown(header, F.col("rows")).alias("markdown"))


@query("""SELECT l_returnflag AS statement, count(*) FILTER (l_linenumber % 4 <> 0) AS matched, count(*) AS expected FROM lineitem GROUP BY 1""")
def fact_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    expected = table(spark, sf_dir, "lineitem").select(*keys, F.col("l_returnflag").alias("statement"), F.col("l_extendedprice").alias("value"))
    found = expected.where("l_linenumber % 4 <> 0").drop("statement")
    return windows.parity(found, expected, keys=keys, value="value")


# -- documents ----------------------------------------------------------------------


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS ref, s_name AS name, n_name AS jurisdiction, CASE WHEN n_nationkey % 2 = 0 THEN CAST(s_suppkey % 100 + 1 AS DOUBLE) END AS ownership FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def subsidiaries_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filingloom.operators.exhibits import subsidiaries

    return subsidiaries(render.subsidiary_exhibits(spark, sf_dir)).select("ref", "name", "jurisdiction", "ownership")


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS ref, CAST(n_nationkey AS INTEGER) AS key, n_name AS name, CAST(n_nationkey * 1000 AS DOUBLE) AS value FROM nation""")
def table_cells_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filingloom.operators.html_tree import cells

    row = text("<tr><td>", F.col("n_nationkey").cast("string"), "<td colspan=2><b>", F.col("n_name"), "</b></td><td>$", F.format_number(F.col("n_nationkey") * 1000, 0), "</tr>")
    html = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(text("<table><thead><tr><th>Key<th>Name<th><th>Value</tr></thead><tbody>", F.array_join(F.collect_list(row), ""), "</table>").alias("content"))
    found = cells(html.select(F.col("n_regionkey").cast("string").alias("ref"), "content")).where("section = 'body'")
    own = found.groupBy("ref", "table_id", "row").agg(F.max(F.when(F.col("col") == 0, F.col("text"))).alias("key"), F.max(F.when(F.col("col") == 1, F.col("text"))).alias("name"), F.max(F.when(F.col("col") == 3, F.col("value"))).alias("value"))
    return own.select("ref", F.col("key").cast("int").alias("key"), "name", "value")


WHOLE = r"""WITH lines AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(regexp_replace(p, ' +', ' ', 'g'))), lambda p: p <> '') AS l FROM documents),
w AS (SELECT doc_id, CASE WHEN len(l) <= 9800 THEN l ELSE list_append(l[:9799], array_to_string(l[9800:], ' ')) END AS ps FROM lines),
p AS (SELECT CAST(doc_id AS VARCHAR) AS ref, generate_subscripts(ps, 1) - 1 AS i, unnest(ps) AS body FROM w)
"""
NUMBER = "(i // 100 + 1) || '.' || lpad(CAST(i % 100 AS VARCHAR), 2, '0')"


@query(WHOLE + f"SELECT ref, 'Item ' || {NUMBER} AS item, body FROM p")
def sections_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filingloom.operators.sections import item_sections

    # "Text:" keeps a paragraph from being read as a label of its own
    paragraph = lambda p, i: F.concat(F.lit("<p>Item "), render.item_number(i), F.lit(". Heading</p><p>Text: "), p, F.lit("</p>"))
    docs = render.documents(spark, sf_dir)
    found = item_sections(docs.select("ref", text("<html><body>", F.array_join(F.transform("shown", paragraph), "\n"), "</body></html>").alias("content")), item_label=windows.DECIMAL_LABEL)
    return found.select("ref", "item", F.regexp_replace("text", "^Item [0-9.]+ Heading\\s+Text: ", "").alias("body"))


@query(WHOLE + f"SELECT ref, {NUMBER} AS item, 'Item ' || {NUMBER} || '. Heading' AS title, body FROM p")
def contents_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filingloom.operators.sections import contents_sections

    docs = render.documents(spark, sf_dir)
    row = lambda i, n: F.concat(F.lit('<tr><td><a href="#s'), i.cast("string"), F.lit('">Item '), n, F.lit('.</a></td><td><a href="#s'), i.cast("string"), F.lit('">Heading</a></td><td>9</td></tr>'))
    rows = F.array_join(F.transform("shown", lambda p, i: row(i, render.item_number(i))), "")
    body = F.array_join(F.transform("shown", lambda p, i: F.concat(F.lit('<div id="s'), i.cast("string"), F.lit('"></div><p>'), p, F.lit("</p>"))), "\n")
    # contents of one entry aren't taken for contents: each document ends with an item of its own
    end = row(F.lit("end"), F.lit("99.99"))
    found = contents_sections(docs.select("ref", text("<html><body><table>", rows, end, "</table>", body, '<div id="send"></div><p>End</p></body></html>').alias("content")))
    return found.where("item <> '99.99'").select("ref", "item", F.col("label").alias("title"), F.col("text").alias("body"))


@query(WHOLE + "SELECT ref, CAST(i + 1 AS VARCHAR) AS item, body FROM p")
def cross_reference_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filingloom.operators.sections import cross_reference_sections

    docs = render.documents(spark, sf_dir)
    number = lambda i: (i + 1).cast("string")
    rows = F.array_join(F.transform("shown", lambda p, i: F.concat(F.lit("<tr><td>Item "), number(i), F.lit(".</td><td>Heading</td><td>"), number(i), F.lit("</td></tr>"))), "")
    body = F.array_join(F.transform("shown", lambda p: F.concat(F.lit("<p>"), p, F.lit('</p><hr style="page-break-after: always"/>'))), "")
    found = cross_reference_sections(docs.select("ref", text(body, "<p>FORM 10-K CROSS-REFERENCE INDEX</p><table>", rows, "</table>").alias("content")))
    return found.select("ref", "item", F.col("text").alias("body"))


CHAPTERS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth")


@query(WHOLE + f"""SELECT ref, 'Chapter ' || c || ' part' AS name, trim('Chapter ' || c || ' part ' || coalesce(string_agg(body, ' ' ORDER BY i), '')) AS text
  FROM (SELECT DISTINCT ref FROM p) r CROSS JOIN (SELECT unnest({list(CHAPTERS)}) AS c, generate_subscripts({list(CHAPTERS)}, 1) - 1 AS k) LEFT JOIN (SELECT ref AS own, least(i, {len(CHAPTERS) - 1}) AS chapter, i, body FROM p) ON own = ref AND chapter = k GROUP BY ref, c""")
def named_section_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filingloom.operators.sections import extract_sections

    docs = render.documents(spark, sf_dir).withColumn("shown", render.rest_in_last(F.col("shown"), len(CHAPTERS)))
    headings = [f"Chapter {c} part" for c in CHAPTERS]
    body = text(*[x for i, h in enumerate(headings) for x in (f"<h2>{h}</h2><p>", F.coalesce(F.get("shown", F.lit(i)), F.lit("")), "</p>")])
    return extract_sections(docs.select("ref", text("<html><body>", body, "</body></html>").alias("content")), headings)


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS ref, '001-' || s_suppkey AS commission_file_number, 'April 2024' AS report_month, CASE WHEN s_suppkey % 2 = 0 THEN '20-F' ELSE '40-F' END AS annual_report_form, 'Report of ' || s_name AS content_description FROM supplier""")
def sixk_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filingloom.operators.exhibits import sixk_covers as covers

    form = F.when(F.col("s_suppkey") % 2 == 0, "Form 20-F [X] Form 40-F [ ]").otherwise("Form 20-F [ ] Form 40-F [X]")
    page = text("<p>Commission File Number: 001-", F.col("s_suppkey").cast("string"), "</p><p>For the month of April 2024</p><p>", form, "</p><p>Material Contained in this Report: Report of ", F.col("s_name"), "</p><p>SIGNATURES</p>")
    return covers(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("ref"), page.alias("content")))


TENS = {2: "twenty", 3: "thirty", 4: "forty", 5: "fifty"}


@query("""SELECT p_partkey, CAST(p_size * 1000 + p_size AS BIGINT) AS value FROM part""")
def number_words_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = [w for w, v in numbers.NUMBER_WORDS.items() if v < 20 and w not in ("no", "none", "nil", "null")]
    low = F.element_at(F.array(*[F.lit(u) for u in units]), (F.when(F.col("p_size") < 20, F.col("p_size")).otherwise(F.col("p_size") % 10) + 1).cast("int"))
    tens = F.element_at(F.create_map(*[F.lit(x) for item in TENS.items() for x in item]), F.floor(F.col("p_size") / 10).cast("int"))
    words = F.when(F.col("p_size") < 20, low).when(F.col("p_size") % 10 == 0, tens).otherwise(text(F.initcap(tens), "-", low))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.number_from_words(text(words, " thousand and ", words)).alias("value"))


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS value FROM orders""")
def decimal_comma_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    value = numbers.parsed_number(numbers.displayed(F.lit("ixt:num-comma-decimal"), shown), F.lit(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(value, 2).alias("value"))


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS ref, 'tpch:' || replace(n_name, ' ', '') AS concept, CASE WHEN n_nationkey % 2 = 0 THEN '["BalanceSheet"]' ELSE '["IncomeStatement"]' END AS statements FROM nation""")
def report_statements_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").withColumn("ref", F.col("n_regionkey").cast("string"))
    summary = "<Report><HtmlFileName>R2.htm</HtmlFileName><LongName>02 - Statement - BALANCE SHEETS</LongName><Role>http://x/role/BalanceSheets</Role></Report><Report><HtmlFileName>R4.htm</HtmlFileName><LongName>04 - Statement - OPERATIONS</LongName><ShortName>Statements of Operations</ShortName></Report><Report><HtmlFileName>R9.htm</HtmlFileName><LongName>09 - Disclosure - Income</LongName><ShortName>Income Statements</ShortName></Report>"
    summaries = nation.select("ref").distinct().withColumn("xml", F.lit(summary))
    file = F.when(F.col("n_nationkey") % 2 == 0, "R2.htm").otherwise("R4.htm")
    mention = text("<a onclick=\"top.Show.showAR(this, 'defref_tpch_", F.replace("n_name", F.lit(" "), F.lit("")), "', window)\">x</a>")
    pages = nation.select("ref", file.alias("file"), mention.alias("line")).groupBy("ref", "file").agg(F.array_join(F.collect_list("line"), "").alias("html"))
    return linkbase.report_statements(summaries, pages).select("ref", "concept", F.to_json("statements").alias("statements"))


@query(f"""SELECT CAST(l_orderkey AS VARCHAR) AS accession, 'tpch:Price' || {KEY} AS concept, 'reconstructed:StockholdersEquityDetails' AS source_selector, 'Equity' AS statement FROM lineitem WHERE l_orderkey % 3 = 0""")
def notes_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = render.presentation_linkbases(spark, sf_dir).withColumn("xml", F.replace("xml", F.lit("NoteDetails"), F.lit("StockholdersEquityDetails")))
    found = linkbase.from_notes(xbrl.facts(render.inline_prices(spark, sf_dir)), books, "Equity")
    return found.select("accession", "concept", "source_selector", "statement")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS ref, 'tpch:N' AS concept, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'standard ' || n_nationkey) AS label FROM nation""")
def labels_over_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").withColumn("ref", F.col("n_nationkey").cast("string"))
    own = text('<link:loc xlink:href="a#tpch_N" xlink:label="l"/><link:labelArc xlink:from="l" xlink:to="r"/><link:label xlink:label="r">', F.col("n_name"), "</link:label>")
    books = nation.where("n_nationkey % 2 = 0").select("ref", F.lit("lab").alias("suffix"), own.alias("xml"))
    return linkbase.label_rows(books, nation.select("ref", F.lit("tpch:N").alias("concept"), text("standard ", F.col("ref")).alias("label")))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS accession, count(*) AS facts, 1 AS documents FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def provenance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _provenance(spark, sf_dir, line_facts(spark, sf_dir))


def _provenance(spark: SparkSession, sf_dir: str, facts: DataFrame) -> DataFrame:
    facts = facts.withColumn("accession", F.col("accession").cast("bigint").cast("string"))
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("accession"), F.lit("d").alias("document"))
    extractions = facts.select("accession").distinct().withColumn("selector", F.lit(""))
    joined = documents.join(extractions, "accession").join(facts, "accession")
    return joined.groupBy("accession").agg(F.count("*").alias("facts"), F.countDistinct("document").cast("int").alias("documents"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS ref, 'L' || c_nationkey AS entity_value, 'http://b/' || c_custkey || '.zip' AS url, CAST('2023-12-31' AS DATE) AS period_end, 'esef' AS system FROM customer WHERE c_custkey % 2 = 0""")
def report_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    nation = F.col("c_nationkey").cast("string")
    end = F.when(F.col("c_custkey") % 2 == 0, "2023-12-31").otherwise("2022-12-31")
    filing = F.struct(key.alias("id"), F.struct(text("/", key, ".zip").alias("package_url"), end.alias("period_end"), key.alias("fxo_id"), F.lit("FI").alias("country")).alias("attributes"), F.struct(F.struct(F.struct(nation.alias("id")).alias("data")).alias("entity")).alias("relationships"))
    entity = F.struct(F.lit("entity").alias("type"), nation.alias("id"), F.struct(text("L", nation).alias("identifier")).alias("attributes"))
    payloads = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.struct(F.collect_list(filing).alias("data"), F.collect_set(entity).alias("included"))).alias("json"))
    return listing.report_handles(payloads, year=2023, base="http://b").select("ref", "entity_value", "url", "period_end", "system")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS accession, CASE WHEN s_suppkey % 2 = 0 THEN 'uk-core:Equity' ELSE 'ns9:Equity' END AS concept, round(s_acctbal, 2) AS value FROM supplier""")
def canonical_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filingloom.sources.packages import canonical_concepts

    key = F.col("s_suppkey").cast("string")
    space = F.when(F.col("s_suppkey") % 2 == 0, "http://xbrl.frc.org.uk/fr/2023-01-01/core").otherwise("http://elsewhere.org/core")
    fact = text('<ix:nonFraction name="ns9:Equity" contextRef="c" unitRef="usd">', F.when(F.col("s_acctbal") < 0, "-").otherwise(""), F.format_number(F.abs("s_acctbal"), 2), "</ix:nonFraction>")
    line = text('<p xmlns:ns9="', space, '"/>', render.instant(F.lit("c"), F.lit("2023-12-31")), fact)
    filings = render.filings(table(spark, sf_dir, "supplier").select(key.alias("ref"), F.array(line).alias("lines")))
    return canonical_concepts(xbrl.facts(filings), filings).select("accession", "concept", F.round("value", 2).alias("value"))


@query("""SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, CAST(max(o_orderkey) AS BIGINT) AS last FROM orders GROUP BY 1""")
def richer_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_custkey").cast("string").alias("accession"))
    fewer = orders.where("o_orderkey % 2 = 0")
    return xbrl.richer(fewer, orders).groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


def queries() -> dict[str, Query]:
    from filingloom.plans import more_queries  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: ORACLES[name] for name in queries() if name in ORACLES}
