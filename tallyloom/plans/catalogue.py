"""Queries over the test tables, one per operator, each with the SQL that DuckDB answers alike.

Dirty inputs are views made by the same expressions on both sides.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import answers, cells, charts, dedup, filters, kpi, layout, logs, mentions, missing, privacy, profile, recommend, schema, spline, templates, text, types
from ..sources import commits, shared
from ..sources.io import table
from ..streaming import running, streams
from . import standardise, table_functions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- dirty views, the same text for both engines ---------------------------------------------------

HOLES = """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 7 = 3 THEN NULL ELSE l_quantity END AS quantity,
  CASE WHEN l_orderkey % 5 = 2 THEN NULL ELSE l_extendedprice END AS price, CASE WHEN l_partkey % 11 = 4 THEN NULL ELSE l_returnflag END AS flag, l_linestatus AS status FROM lineitem"""
TEXTS = """SELECT l_orderkey, l_linenumber, concat('$', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR(30))) AS price, concat(CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR(9)), '%') AS discount,
  CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) AS quantity, CASE WHEN l_returnflag = 'A' THEN 'yes' ELSE 'no' END AS returned, CASE WHEN l_orderkey % 9 = 1 THEN 'N/A' WHEN l_orderkey % 9 = 5 THEN '' ELSE l_linestatus END AS status,
  concat('2024-01-', lpad(CAST(1 + l_linenumber AS VARCHAR(2)), 2, '0')) AS day FROM lineitem"""
ORDERS = """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 5 THEN NULL ELSE o_custkey END AS customer, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 1 THEN NULL ELSE o_totalprice END AS total, o_orderpriority AS priority FROM orders"""
CELLS = """SELECT concat('t', CAST(p_partkey % 40 AS VARCHAR(9))) AS table_id, CAST(floor(p_partkey / 40) AS INT) AS row_no, k AS col_no, CASE WHEN k = 0 THEN 'Name' WHEN k = 1 THEN 'Size' ELSE CASE WHEN p_partkey % 40 = 7 THEN '' ELSE 'Price' END END AS header,
  CASE WHEN k = 0 THEN CASE WHEN p_partkey % 31 = 3 THEN '' ELSE p_name END WHEN k = 1 THEN CASE WHEN p_partkey % 17 = 2 THEN concat('O', CAST(p_size AS VARCHAR(9)), '0') ELSE CAST(p_size AS VARCHAR(9)) END ELSE concat('$', CAST(CAST(floor(p_retailprice) AS INT) AS VARCHAR(9))) END AS value
  FROM part CROSS JOIN (VALUES (0), (1), (2)) AS v(k)"""
# tables of five rows with values off the type of their column, look-alikes, untidy headers and ragged rows
DIRTY = """SELECT concat('t', lpad(CAST(CAST(floor(p_partkey / 5) AS INT) AS VARCHAR(9)), 2, '0')) AS table_id, CAST(p_partkey % 5 AS INT) AS row_no, k AS col_no,
  CASE k WHEN 0 THEN 'Name' WHEN 1 THEN CASE WHEN floor(p_partkey / 5) % 7 = 2 THEN 'Name' ELSE 'Size' END WHEN 2 THEN CASE WHEN floor(p_partkey / 5) % 7 = 3 THEN '' ELSE ' Price' END WHEN 3 THEN 'Column_3' ELSE 'A header that is much longer than fifty characters in all' END AS header,
  CASE k WHEN 0 THEN CASE WHEN p_partkey % 31 = 3 THEN ' ' ELSE concat(' ', p_name, '  x') END
    WHEN 1 THEN CASE p_partkey % 12 WHEN 0 THEN '1,234' WHEN 1 THEN concat('O', CAST(p_size AS VARCHAR(9)), '0') WHEN 2 THEN 'n/a' WHEN 3 THEN '12 34' WHEN 4 THEN '1.234.50' WHEN 5 THEN '' WHEN 6 THEN concat('l', CAST(p_size AS VARCHAR(9))) ELSE CAST(p_size AS VARCHAR(9)) END
    WHEN 2 THEN CASE p_partkey % 8 WHEN 0 THEN '100 USD' WHEN 1 THEN '€5' WHEN 2 THEN 'B12' WHEN 3 THEN '$1O0' ELSE concat('$', CAST(CAST(floor(p_retailprice) AS INT) AS VARCHAR(9))) END
    WHEN 3 THEN CASE p_partkey % 7 WHEN 0 THEN '1/5/2024' WHEN 1 THEN '5-1-2024' WHEN 2 THEN 'Jan 5, 2024' WHEN 3 THEN 'soon' ELSE '2024-01-05' END
    ELSE CASE p_partkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'NO' WHEN 2 THEN '1' ELSE 'y' END END AS value
  FROM part CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS v(k) WHERE NOT (k = 4 AND p_partkey % 55 = 0)"""
WORDS = """SELECT CAST(floor(p_partkey / 20) AS INT) AS page, CAST(p_partkey AS INT) AS word_no, CAST(100 * k + p_partkey % 3 AS INT) AS x, CAST(30 * (p_partkey % 20) + k AS INT) AS y, 40 AS width, 12 AS height, CASE WHEN k = 0 THEN p_name WHEN k = 1 THEN p_brand ELSE p_type END AS text,
  0.5 + (p_partkey % 5) / 10.0 AS confidence, k FROM part CROSS JOIN (VALUES (0), (1), (2)) AS v(k)"""
# words of uneven pages, unsure and empty ones among them
SCANS = """SELECT page, word_no, x, y, width, height, k, CASE WHEN word_no % 23 = 5 AND k = 2 THEN ' ' WHEN page % 9 = 4 THEN left(text, 1) ELSE text END AS text, CASE WHEN page % 3 = 1 THEN 0.9 WHEN word_no % 4 = 1 THEN 0.05 WHEN word_no % 29 = 3 THEN 0.0 ELSE confidence END AS confidence
  FROM (WORDS_) WHERE page % 9 <> 4 OR (word_no % 20 < page % 4 AND k <= page % 3)"""
QUESTIONS = """SELECT o_orderkey AS qid, CASE o_orderkey % 7 WHEN 0 THEN concat('What is the total o_totalprice for customer ', CAST(o_custkey AS VARCHAR(12)), '?') WHEN 1 THEN 'Compare order status versus priority' WHEN 2 THEN 'Show the trend of sales over time'
  WHEN 3 THEN concat('where o_custkey > ', CAST(o_custkey AS VARCHAR(12)), ' and o_orderstatus = F') WHEN 4 THEN concat('top ', CAST(o_custkey % 20 AS VARCHAR(12)), ' customers by o_totalprice') WHEN 5 THEN 'distribution of order priority'
  ELSE concat('Use SELECT o_custkey, SUM(o_totalprice) FROM orders WHERE o_custkey = ', CAST(o_custkey AS VARCHAR(12)), ' GROUP BY o_custkey; it took ', CAST(o_orderkey % 60 AS VARCHAR(12)), ' seconds') END AS text FROM orders"""
# what is said in conversations, and questions of many kinds
ASKED = """SELECT qid, text FROM (QUESTIONS_) UNION ALL SELECT conv_id * 1000 + turn + 100000000 AS qid, text FROM conversations UNION ALL SELECT o_orderkey + 1000000000 AS qid, concat(CASE o_orderkey % 9 WHEN 0 THEN 'what is the standard deviation of ' WHEN 1 THEN 'exclude rows without ' WHEN 2 THEN 'is there a decline in ' WHEN 3 THEN 'how many have the highest '
  WHEN 4 THEN 'which is higher, more or less: ' WHEN 5 THEN 'describe the relationship between ' WHEN 6 THEN 'breakdown of share by ' WHEN 7 THEN 'top 5 and bottom 3 where ' ELSE 'list ' END, o_orderpriority, CASE o_orderkey % 4 WHEN 0 THEN ' having o_custkey and o_totalprice or o_orderstatus' WHEN 1 THEN ' over time' ELSE '' END) AS text FROM orders"""
REGISTRY = """SELECT doc_id, concat('u', CAST(doc_id % 50 AS VARCHAR(9))) AS user_id, TEXT_ AS text, DATE '2024-01-01' AS created, CASE doc_id % 4 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' WHEN 2 THEN 'long' ELSE 'permanent' END AS retention FROM documents"""
SCANS = SCANS.replace("WORDS_", WORDS)
ASKED = ASKED.replace("QUESTIONS_", QUESTIONS)
# word boundaries differ between the engines beside letters outside ASCII, which therefore become one that is inside
ASCII = "regexp_replace(text, '[^\\x20-\\x7E]', 'q', 'g')"
REGISTRY = REGISTRY.replace("TEXT_", ASCII)


def _view(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """A view's rows; its tables are taken from the folder ``d``."""
    names = [n for n in ("lineitem", "orders", "part", "documents", "events", "conversations") if f"FROM {n}" in sql]
    for n in names:
        sql = re.sub(rf"FROM {n}\b(?! WHERE o_custkey = ')", f"FROM {{{n}}}", sql)  # the text of a question holds a FROM too
    sql = sql.replace(ASCII, ASCII.replace(", 'g')", ")").replace("\\x", "\\\\x"))
    return spark.sql(sql, **{n: table(spark, d, n) for n in names})


# --- questions ---------------------------------------------------------------------------------------


@query("agg_global", "SELECT round(sum(l_quantity), 6) AS sum_l_quantity, round(sum(l_extendedprice), 6) AS sum_l_extendedprice FROM lineitem WHERE l_quantity >= 10 AND l_returnflag = 'A'")
def _(spark, d):
    return _rounded(templates.aggregate(table(spark, d, "lineitem"), "SUM", ["l_quantity", "l_extendedprice"], [("l_quantity", "at least", 10.0), ("l_returnflag", "=", "A")]))


@query("agg_median_std", "SELECT round(median(l_quantity), 6) AS median_l_quantity, round(median(l_extendedprice), 6) AS median_l_extendedprice FROM lineitem")
def _(spark, d):
    return _rounded(templates.aggregate(table(spark, d, "lineitem"), "MEDIAN", ["l_quantity", "l_extendedprice"]))


@query("agg_count_all", "SELECT count(*) AS total_count FROM orders")
def _(spark, d):
    return templates.aggregate(table(spark, d, "orders"), "COUNT", [])


@query("compare_groups", "SELECT l_returnflag, round(avg(l_extendedprice), 6) AS avg_l_extendedprice, round(avg(l_quantity), 6) AS avg_l_quantity FROM lineitem GROUP BY 1")
def _(spark, d):
    return _rounded(templates.compare_groups(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"], "l_returnflag"))


@query("trend_daily", "SELECT CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice), 6) AS avg_o_totalprice FROM orders GROUP BY 1")
def _(spark, d):
    return _rounded(templates.trend(table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), "day", "o_totalprice"))


@query("distribution", f"SELECT flag, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 6) AS percentage FROM ({HOLES}) GROUP BY 1")
def _(spark, d):
    return _rounded(templates.distribution(_view(spark, d, HOLES), "flag"))


@query("rank_top", "SELECT o_totalprice, o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def _(spark, d):
    return templates.rank(table(spark, d, "orders"), ["o_totalprice", "o_orderkey"], 10, ties=["o_orderkey"])


@query("rank_bottom", f"SELECT total, o_orderkey FROM ({ORDERS}) ORDER BY total ASC NULLS LAST, o_orderkey LIMIT 7")
def _(spark, d):
    return templates.rank(_view(spark, d, ORDERS), ["total", "o_orderkey"], 7, True, ["o_orderkey"])


@query("filter_and", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'P' AND contains(o_orderpriority, 'HIGH')")
def _(spark, d):
    return templates.select(table(spark, d, "orders"), ["o_orderkey", "o_custkey"], [("o_totalprice", "greater than", 100000.0), ("o_orderstatus", "!=", "P"), ("o_orderpriority", "contains", "HIGH")])


@query("select_basic", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, d):
    return templates.select(table(spark, d, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


# --- filters and rows ----------------------------------------------------------------------------------


@query("widget_filters", "SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_size BETWEEN 10 AND 30 AND regexp_matches(p_name, '(?i)ring')")
def _(spark, d):
    return filters.active_filters(table(spark, d, "part"), [("select", "p_type", ["ECONOMY", "PROMO"]), ("range", "p_size", (10, 30)), ("search", "p_name", "RING"), ("search", "nowhere", "x")]).select("p_partkey")


@query("search_all", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)red') OR regexp_matches(p_brand, '(?i)red') OR regexp_matches(p_type, '(?i)red')")
def _(spark, d):
    return filters.search_everywhere(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "RED").select("p_partkey")


@query("first_last", "SELECT min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders")
def _(spark, d):
    return filters.ends(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").selectExpr("first_row.o_orderkey AS a", "last_row.o_orderkey AS b")


@query("paging", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")
def _(spark, d):
    return filters.page(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 50, 25)


@query("replace_and_edit", "SELECT c_custkey, upper(replace(c_name, 'Customer#', 'C-')) AS c_name FROM customer")
def _(spark, d):
    out = filters.replace_text(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "Customer#", "C-")
    return out.withColumn("c_name", filters.text_operation("c_name", "upper"))


@query("replace_matched", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]+[0-9a-m]', '$1\\\\\\\\', 'g') AS p_name, regexp_matches(p_name, '[aeiou]+[0-9a-m]') AS replaced FROM part")
def _(spark, d):
    return filters.replace_matched(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "[aeiou]+[0-9a-m]", "$1\\\\")


@query("query_checks", """SELECT o_orderkey AS query_id, CAST(o_orderkey % 3 = 0 AS INT) AS unknown_columns, o_orderkey % 4 = 0 AS dangerous, CAST(o_orderkey % 3 = 0 AS INT) + CAST(o_orderkey % 4 = 0 AS INT) + CAST(o_orderkey % 4 = 0 AS INT) AS n_errors,
  o_orderkey % 4 <> 0 AS unbounded, o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 AS valid, round(greatest(0, 1 - 0.2::DOUBLE * (CAST(o_orderkey % 3 = 0 AS INT) + 2 * CAST(o_orderkey % 4 = 0 AS INT))), 6) AS confidence FROM orders""")
def _(spark, d):
    q = table(spark, d, "orders").selectExpr("o_orderkey AS query_id", "IF(o_orderkey % 4 = 0, 'DROP TABLE created_at FROM x', 'SELECT * FROM orders') AS sql", "IF(o_orderkey % 3 = 0, array('a', 'zz'), array('a')) AS used_columns")
    return _rounded(filters.query_checks(q, ["a", "b"]))


# --- types and profile -----------------------------------------------------------------------------------

_KIND = {"price": "CURRENCY", "discount": "PERCENTAGE", "quantity": "NUMBER", "returned": "BOOLEAN", "status": "TEXT", "day": "DATE"}


_MIXED = f"SELECT *, CASE WHEN l_orderkey % 4 = 1 THEN price WHEN l_orderkey % 40 = 2 THEN 'n/a' ELSE quantity END AS amounts, CASE WHEN l_orderkey % 5 = 1 THEN quantity ELSE day END AS days, CASE WHEN l_orderkey % 3 = 1 THEN 'Jan 5, 2024' WHEN l_orderkey % 3 = 2 THEN '31/12/2023' ELSE '1/2/2024' END AS dates FROM ({TEXTS})"
_SEEN = [*_KIND, "amounts", "days", "dates"]
_READS = {
    "BOOLEAN": "lower(v) IN ('true', 'yes', 'y', '1', 'on', 'false', 'no', 'n', '0', 'off')", "CURRENCY": "regexp_matches(v, '^-?[$€£¥₹]\\s*-?[0-9][0-9,]*(\\.[0-9]+)?$')", "PERCENTAGE": "regexp_matches(v, '^-?[0-9]+(\\.[0-9]+)?\\s*%$')",
    "DATE": "coalesce(" + ", ".join(f"try_strptime(v, '{f}')" for f in ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%b %d, %Y")) + ") IS NOT NULL", "NUMBER": "regexp_matches(replace(v, ',', ''), '^[+-]?[0-9]+(\\.[0-9]+)?$')",
}
_ALL_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS name, CASE WHEN trim({c}) NOT IN ('', 'N/A', 'n/a') THEN trim({c}) END AS v FROM ({_MIXED})" for c in _SEEN)


def _detected_sql(least: float) -> str:
    shares = ", ".join(f"avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END) FILTER (v IS NOT NULL) AS {k}" for k, test in _READS.items())
    top = f"greatest({', '.join(_READS)})"
    pick = " ".join(f"WHEN {k} = {top} THEN '{k}'" for k in _READS)
    return f"WITH s AS (SELECT name, count(v) AS non_missing, {shares} FROM ({_ALL_CELLS}) GROUP BY 1) SELECT name, CASE WHEN {top} < {least} THEN 'TEXT' {pick} END AS data_type, round(CASE WHEN {top} < {least} THEN 1.0 ELSE {top} END, 6)::DOUBLE AS confidence, non_missing FROM s"


@query("type_detect", _detected_sql(1.0))
def _(spark, d):
    return _rounded(types.detect(_view(spark, d, _MIXED), _SEEN))


@query("type_detect_most", _detected_sql(0.6))
def _(spark, d):
    return _rounded(types.detect(_view(spark, d, _MIXED), _SEEN, types.TypeConfig(threshold=0.6)))


@query("type_convert", f"""SELECT l_orderkey, l_linenumber, round(CAST(replace(price, '$', '') AS DOUBLE), 6) AS price, round(CAST(replace(discount, '%', '') AS DOUBLE) / 100, 6) AS discount, CAST(quantity AS DOUBLE) AS quantity, returned = 'yes' AS returned,
  CASE WHEN status IN ('N/A', '') THEN NULL ELSE status END AS status, CAST(day AS DATE) AS day FROM ({TEXTS})""")
def _(spark, d):
    v = _view(spark, d, TEXTS)
    return _rounded(v.select("l_orderkey", "l_linenumber", *[types.converted(c, k).alias(c) for c, k in _KIND.items()]))


@query("profile_types", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _KIND.items()) + ") AS t(name, data_type)")
def _(spark, d):
    return types.profile_type(_view(spark, d, TEXTS), list(_KIND))


_COLS = ("o_orderkey", "customer", "status", "total", "priority")


@query("profile_columns", " UNION ALL ".join(f"""SELECT '{c}' AS name, count(*) AS total, count(*) - count({c}) AS nulls, count({c}) AS non_nulls, count(DISTINCT {c}) AS unique_values, round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_percent,
  round(count(DISTINCT {c}) * 100.0 / count({c}), 6) AS unique_percent, (count(*) - count({c})) * 100.0 / count(*) > 5 AS nullable, count(DISTINCT {c}) = count(*) AS primary_key_candidate, count(DISTINCT {c}) <= 20 AND count(DISTINCT {c}) < count({c}) AS categorical FROM ({ORDERS})""" for c in _COLS))
def _(spark, d):
    return _rounded(profile.columns(_view(spark, d, ORDERS)))


@query("profile_numbers", " UNION ALL ".join(f"SELECT '{c}' AS name, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std, bool_and({c} = floor({c})) AS is_integer, bool_or({c} <> floor({c})) AS has_decimals FROM ({ORDERS})" for c in ("customer", "total")))
def _(spark, d):
    return _rounded(profile.numbers(_view(spark, d, ORDERS), ["customer", "total"]))


@query("profile_texts", " UNION ALL ".join(f"""SELECT '{c}' AS name, min(length({c})) AS min_length, max(length({c})) AS max_length, round(avg(length({c})), 6) AS avg_length, bool_or(regexp_matches({c}, '[^a-zA-Z0-9\\s]')) AS special, bool_and({c} = upper({c}) AND {c} <> lower({c})) AS all_upper,
  bool_and({c} = lower({c}) AND {c} <> upper({c})) AS all_lower, '' AS shapes FROM part""" for c in ("p_name", "p_brand", "p_type")))
def _(spark, d):
    return _rounded(profile.texts(table(spark, d, "part"), ["p_name", "p_brand", "p_type"]))


@query("profile_dates", "SELECT 'o_orderdate' AS name, min(o_orderdate) AS first, max(o_orderdate) AS last, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS range_days, bool_or(date_trunc('day', o_orderdate) <> o_orderdate) AS has_time FROM orders")
def _(spark, d):
    return profile.dates(table(spark, d, "orders"), ["o_orderdate"]).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query("missing_report", " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS total, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_percent, (count(*) - count({c})) * 100.0 / count(*) > 50 AS over_half FROM ({ORDERS})" for c in _COLS))
def _(spark, d):
    return _rounded(profile.missing_report(_view(spark, d, ORDERS)))


@query("quality_scores", " UNION ALL ".join(f"SELECT '{c}' AS name, 1.0::DOUBLE AS completeness, 1.0::DOUBLE AS validity, 1.0::DOUBLE AS consistency, round(count(DISTINCT {c}) / count(*), 6) AS uniqueness FROM ({TEXTS})" for c in ("price", "discount", "quantity", "day")))
def _(spark, d):
    return _rounded(profile.quality_scores(_view(spark, d, TEXTS), {c: _KIND[c] for c in ("price", "discount", "quantity", "day")}))


@query("issue_scan", f"""SELECT 'status' AS name, count(CASE WHEN trim(status) = '' THEN 1 END) AS empty, 0::BIGINT AS numeric_text, count(CASE WHEN status <> trim(status) THEN 1 END) AS edge_spaces, 0::BIGINT AS artefacts FROM ({TEXTS})
  UNION ALL SELECT 'price', 0, count(*), 0, 0 FROM lineitem""")
def _(spark, d):
    return profile.issues(_view(spark, d, TEXTS).select("status", "price"))


@query("validation_findings", f"""SELECT 'missing' AS finding, 'customer' AS "column", count(*) - count(customer) AS n FROM ({ORDERS}) UNION ALL SELECT 'missing', 'total', count(*) - count(total) FROM ({ORDERS}) UNION ALL SELECT 'all_unique', 'o_orderkey', 0""")
def _(spark, d):
    return profile.validation_findings(_view(spark, d, ORDERS))


@query("top_values", """SELECT * FROM (SELECT name, value, count, CAST(row_number() OVER (PARTITION BY name ORDER BY count DESC, value) AS INT) AS place FROM (SELECT 'p_brand' AS name, p_brand AS value, count(*) AS count FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2)) WHERE place <= 10""")
def _(spark, d):
    return profile.top_values(table(spark, d, "part"), ["p_brand", "p_type"])


@query("auto_filters", """SELECT name, widget, unique_values FROM (SELECT 'p_partkey' AS name, 'range' AS widget, count(DISTINCT p_partkey) AS unique_values FROM part UNION ALL SELECT 'p_size', 'range', count(DISTINCT p_size) FROM part UNION ALL SELECT 'p_retailprice', 'range', count(DISTINCT p_retailprice) FROM part
  UNION ALL SELECT 'p_type', 'select', count(DISTINCT p_type) FROM part UNION ALL SELECT 'p_brand', CASE WHEN count(DISTINCT p_brand) <= 20 THEN 'select' ELSE 'search' END, count(DISTINCT p_brand) FROM part UNION ALL SELECT 'p_name', CASE WHEN count(DISTINCT p_name) <= 20 THEN 'select' ELSE 'search' END, count(DISTINCT p_name) FROM part) WHERE unique_values <= 50 OR widget = 'range'""")
def _(spark, d):
    return profile.filter_definitions(table(spark, d, "part"))


# --- missing values ------------------------------------------------------------------------------------

_FILL = f"SELECT l_orderkey, l_linenumber, l_partkey, {{0}} FROM ({HOLES}) {{1}}"


def _filled(name: str, sql: str, run) -> None:
    @query(name, sql)
    def _(spark, d):
        return _rounded(run(_view(spark, d, HOLES)).select("l_orderkey", "l_linenumber", "l_partkey", "flag" if name == "fill_mode" else "quantity"))


_filled("fill_mean", _FILL.format("round(coalesce(quantity, m), 6) AS quantity", f"CROSS JOIN (SELECT avg(quantity) AS m FROM ({HOLES}))"), lambda v: missing.fill_mean(v, "quantity"))
_filled("fill_median", _FILL.format("round(coalesce(quantity, m), 6) AS quantity", f"CROSS JOIN (SELECT median(quantity) AS m FROM ({HOLES}))"), lambda v: missing.fill_median(v, "quantity"))
_filled("fill_mode", _FILL.format("coalesce(flag, m) AS flag", f"CROSS JOIN (SELECT flag AS m FROM ({HOLES}) WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"), lambda v: missing.fill_mode(v, "flag"))
_filled("fill_zero", _FILL.format("coalesce(quantity, 0) AS quantity", ""), lambda v: missing.fill_value(v, "quantity", 0.0))
_filled("drop_missing", _FILL.format("quantity", "WHERE quantity IS NOT NULL"), lambda v: missing.drop_missing(v, "quantity"))
_filled("fill_outlier", _FILL.format("round(coalesce(quantity, m), 6) AS quantity", f"CROSS JOIN (SELECT median(quantity) AS m FROM ({HOLES}) CROSS JOIN (SELECT avg(quantity) AS a, stddev_pop(quantity) AS s FROM ({HOLES})) WHERE abs(quantity - a) / s < 3)"), lambda v: missing.fill_outlier_median(v, "quantity"))

EVENT_HOLES = "SELECT event_id, user_id, ts, CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE value END AS value FROM events"


@query("fill_forward", f"SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value FROM ({EVENT_HOLES})")
def _(spark, d):
    return missing.fill_forward(_view(spark, d, EVENT_HOLES), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value")


@query("fill_forward_whole", f"SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id) AS value FROM ({EVENT_HOLES})")
def _(spark, d):
    return missing.fill_forward(_view(spark, d, EVENT_HOLES), "value", ["ts", "event_id"]).select("event_id", "value")


@query("fill_backward_whole", f"SELECT event_id, first_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM ({EVENT_HOLES})")
def _(spark, d):
    return missing.fill_backward(_view(spark, d, EVENT_HOLES), "value", ["ts", "event_id"]).select("event_id", "value")


@query("interpolate", f"""WITH r AS (SELECT *, row_number() OVER w AS i FROM ({EVENT_HOLES}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT *, CASE WHEN value IS NOT NULL THEN i END AS ki FROM r),
  n AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, last_value(ki IGNORE NULLS) OVER b AS pi, first_value(value IGNORE NULLS) OVER f AS nv, first_value(ki IGNORE NULLS) OVER f AS ni FROM k WINDOW b AS (PARTITION BY user_id ORDER BY i), f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT event_id, round(coalesce(value, pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0), CASE WHEN ni IS NULL THEN pv END), 6) AS value FROM n""")
def _(spark, d):
    return _rounded(missing.interpolate(_view(spark, d, EVENT_HOLES), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value"))


@query("knn_impute", """WITH s AS (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS x, CASE WHEN s_suppkey % 5 = 2 THEN NULL ELSE s_acctbal END AS y FROM supplier),
  n AS (SELECT a.s_suppkey, b.y, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY sqrt((a.x - b.x) * (a.x - b.x)), b.s_suppkey) AS r FROM s a JOIN s b ON a.y IS NULL AND b.y IS NOT NULL)
  SELECT s_suppkey, round(y, 6) AS y FROM s WHERE y IS NOT NULL UNION ALL SELECT s_suppkey, round(avg(y), 6) FROM n WHERE r <= 3 GROUP BY 1""")
def _(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey", "CAST(s_nationkey AS DOUBLE) AS x", "IF(s_suppkey % 5 = 2, NULL, s_acctbal) AS y")
    return _rounded(missing.knn_impute(s, "y", ["x"], "s_suppkey", 3).select("s_suppkey", "y"))


@query("policies", f"SELECT o_orderkey, customer, coalesce(total, m) AS total FROM ({ORDERS}) CROSS JOIN (SELECT round(median(total), 6) AS m FROM ({ORDERS}) WHERE customer IS NOT NULL) WHERE customer IS NOT NULL")
def _(spark, d):
    v = _view(spark, d, ORDERS).select("o_orderkey", "customer", "total")
    return _rounded(missing.apply_policies(v, {"customer": missing.Policy("remove"), "total": missing.Policy("median", threshold=0.9)}))


# --- duplicates ------------------------------------------------------------------------------------------


@query("dedup_exact", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang")
def _(spark, d):
    return dedup.exact(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id", ["text", "lang"]).select("doc_id")


@query("duplicate_rate", "SELECT 'completeness' AS kpi_id, 100.0::DOUBLE AS value UNION ALL SELECT 'total_records', count(*) FROM documents UNION ALL SELECT 'duplicate_rate', round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents))) * 100.0 / count(*), 6) FROM documents")
def _(spark, d):
    return _rounded(kpi.quality_kpis(table(spark, d, "documents").select("text", "lang")))


@query("header_rows", "SELECT n_name FROM nation")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("string").alias("n_regionkey"))
    extra = spark.sql("SELECT ' N_NATIONKEY' AS n_nationkey, 'n_name ' AS n_name, 'N_RegionKey' AS n_regionkey")
    return dedup.without_headers(n.unionByName(extra), n.columns).select("n_name")


@query("fuzzy_pairs_edit", "WITH p AS (SELECT DISTINCT p_name AS t, min(p_partkey) AS k FROM part GROUP BY 1) SELECT a.k AS a, b.k AS b, round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 6) AS similarity FROM p a JOIN p b ON a.k < b.k WHERE 1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)) >= 0.7")
def _(spark, d):
    p = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    return _rounded(dedup.similar_pairs(p, "k", "p_name", 0.7, edit_only=True))


@query("similar_values")
def _(spark, d):
    return dedup.similar_values(table(spark, d, "part").select("p_name"), "p_name", 0.85)


@query("fuzzy_rows")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return dedup.fuzzy(p, "p_partkey", ["p_name", "p_brand"], 0.9)


@query("standardise", f"SELECT l_orderkey, l_linenumber, CAST(replace(price, '$', '') AS DOUBLE) AS price, CAST(quantity AS DOUBLE) AS quantity FROM ({TEXTS}) QUALIFY row_number() OVER (PARTITION BY l_linenumber, price, quantity ORDER BY l_orderkey) = 1")
def _(spark, d):
    return standardise.standardise(_view(spark, d, TEXTS).select("l_orderkey", "l_linenumber", "price", "quantity"), "l_orderkey")


# --- KPIs -------------------------------------------------------------------------------------------------


@query("kpi_numeric", """SELECT 'total_o_totalprice' AS kpi_id, 'sum' AS category, round(sum(o_totalprice), 4) AS value FROM orders UNION ALL SELECT 'avg_o_totalprice', 'average', round(avg(o_totalprice), 4) FROM orders UNION ALL SELECT 'max_o_totalprice', 'max', max(o_totalprice) FROM orders""")
def _(spark, d):
    return _rounded(kpi.numeric_kpis(table(spark, d, "orders"), ["o_totalprice"]), 4)


@query("kpi_categorical", """(SELECT 'top_o_orderstatus' AS kpi_id, o_orderstatus AS label, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1) UNION ALL SELECT 'unique_o_orderstatus', NULL, count(DISTINCT o_orderstatus) FROM orders
  UNION ALL (SELECT 'top_o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1) UNION ALL SELECT 'unique_o_orderpriority', NULL, count(DISTINCT o_orderpriority) FROM orders""")
def _(spark, d):
    return kpi.categorical_kpis(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("kpi_timeseries", """SELECT 'records_per_day' AS kpi_id, round(count(*) / greatest(1, floor(epoch(max(ts) - min(ts)) / 86400)), 6) AS value FROM events UNION ALL SELECT 'recent_records', CAST(count(*) AS DOUBLE) FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS""")
def _(spark, d):
    return _rounded(kpi.time_kpis(table(spark, d, "events"), "ts"))


@query("kpi_business", """SELECT 'average_price' AS kpi_id, 'business' AS category, round(avg(o_totalprice), 4) AS value FROM orders UNION ALL SELECT 'unique_order', 'business', count(DISTINCT o_orderpriority) FROM orders""")
def _(spark, d):
    return _rounded(kpi.business_kpis(table(spark, d, "orders").select("o_totalprice", "o_orderkey", "o_orderpriority")), 4)


@query("kpi_ranked", """SELECT * FROM (VALUES ('total_o_totalprice', 'sum', 0.9::DOUBLE), ('avg_o_totalprice', 'average', 0.7::DOUBLE)) AS t(kpi_id, category, score)""")
def _(spark, d):
    return kpi.ranked(kpi.numeric_kpis(table(spark, d, "orders"), ["o_totalprice"]).drop("value"), {"sum": 0.9, "average": 0.7, "max": 0.5}, 2)


_MONTHS = "SELECT o_orderpriority AS kpi_id, date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2"


@query("kpi_trend", f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY kpi_id ORDER BY month) AS i FROM ({_MONTHS})), f AS (SELECT kpi_id, count(*) AS points, arg_min(value, i) AS a, arg_max(value, i) AS b, stddev_pop(value) / abs(avg(value)) AS volatility, abs(corr(i, value)) AS strength FROM m GROUP BY 1)
  SELECT kpi_id, points, round(b - a, 2) AS change, round((b - a) * 100 / a, 2) AS percent, round(volatility, 2) AS volatility, round(strength, 2) AS strength, CASE WHEN volatility > 0.3 THEN 'VOLATILE' WHEN abs((b - a) * 100 / a) < 5 THEN 'STABLE' WHEN b > a THEN 'UP' ELSE 'DOWN' END AS direction FROM f""")
def _(spark, d):
    return _rounded(kpi.trends(_view(spark, d, _MONTHS), ["kpi_id"], "month", "value"), 2)


_YEAR = "SELECT o_orderpriority AS kpi_id, round(sum(o_totalprice), 2) AS value FROM orders WHERE year(o_orderdate) = {0} GROUP BY 1"


@query("kpi_compare", f"""SELECT kpi_id, a.value AS current, b.value AS base, round(a.value - b.value, 2) AS difference, round((a.value - b.value) * 100 / b.value, 2) AS percent, a.value > b.value AS improved FROM ({_YEAR.format(1998)}) a JOIN ({_YEAR.format(1997)}) b USING (kpi_id)""")
def _(spark, d):
    return _rounded(kpi.comparisons(_view(spark, d, _YEAR.format(1998)), _view(spark, d, _YEAR.format(1997))), 2)


_TREND = f"""SELECT kpi_id, abs(corr(i, value)) AS strength, CASE WHEN stddev_pop(value) / abs(avg(value)) > 0.3 THEN 'VOLATILE' WHEN abs((arg_max(value, i) - arg_min(value, i)) * 100 / arg_min(value, i)) < 5 THEN 'STABLE' WHEN arg_max(value, i) > arg_min(value, i) THEN 'UP' ELSE 'DOWN' END AS direction
  FROM (SELECT *, row_number() OVER (PARTITION BY kpi_id ORDER BY month) AS i FROM ({_MONTHS})) GROUP BY 1"""
_RATED = f"""WITH c AS (SELECT kpi_id, a.value, b.value AS base, (a.value - b.value) * 100 / b.value AS percent, a.value > b.value AS improved FROM ({_YEAR.format(1998)}) a JOIN ({_YEAR.format(1997)}) b USING (kpi_id)),
  r AS (SELECT *, CASE WHEN kpi_id < '3' THEN value >= base * 0.5 END AS met FROM c JOIN ({_TREND}) USING (kpi_id))"""
_INSIGHTS = """SELECT kpi_id, CASE direction WHEN 'UP' THEN 'upward_trend' ELSE 'downward_trend' END AS insight, CASE direction WHEN 'UP' THEN 'success' ELSE 'warning' END AS severity, round(strength, 4) AS confidence FROM r WHERE strength > 0.7 AND direction IN ('UP', 'DOWN')
  UNION ALL SELECT kpi_id, 'volatile', 'info', 0.8 FROM r WHERE direction = 'VOLATILE' UNION ALL SELECT kpi_id, 'zero_value', 'warning', 0.9 FROM r WHERE value = 0
  UNION ALL SELECT kpi_id, CASE WHEN met THEN 'target_exceeded' ELSE 'target_missed' END, CASE WHEN met THEN 'success' ELSE 'warning' END, 0.95 FROM r WHERE met IS NOT NULL
  UNION ALL SELECT kpi_id, 'large_change', CASE WHEN improved THEN 'success' ELSE 'warning' END, 0.9 FROM r WHERE abs(percent) > 20"""


def _insights(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Values, comparisons and insights of the year's totals by priority."""
    compared = kpi.comparisons(_view(spark, d, _YEAR.format(1998)), _view(spark, d, _YEAR.format(1997)))
    values = compared.withColumn("value", F.col("current")).join(kpi.trends(_view(spark, d, _MONTHS), ["kpi_id"], "month", "value").drop("percent"), "kpi_id")
    targets = compared.where("kpi_id < '3'").selectExpr("kpi_id", "base * 0.5 AS target")
    return values, compared, kpi.insights(kpi.against_targets(values, targets))


@query("kpi_insights", f"{_RATED} SELECT kpi_id, insight, severity, confidence::DOUBLE AS confidence FROM ({_INSIGHTS})")
def _(spark, d):
    return _rounded(_insights(spark, d)[2], 4)


@query("kpi_summary", f"{_RATED} SELECT (SELECT count(*) FROM r) AS kpis, (SELECT count(*) FROM c) AS comparisons, (SELECT count(*) FROM c WHERE improved) AS improved, count(CASE WHEN severity = 'success' THEN 1 END) AS success, count(CASE WHEN severity = 'warning' THEN 1 END) AS warning, count(CASE WHEN severity = 'info' THEN 1 END) AS info, count(*) AS insights FROM ({_INSIGHTS})")
def _(spark, d):
    return kpi.summary(*_insights(spark, d))


@query("kpi_targets", f"SELECT kpi_id, a.value, b.value AS target, round(greatest(0, least(100, a.value * 100 / b.value)), 4) AS progress FROM ({_YEAR.format(1998)}) a JOIN ({_YEAR.format(1997)}) b USING (kpi_id)")
def _(spark, d):
    return _rounded(kpi.gauges(_view(spark, d, _YEAR.format(1998)), _view(spark, d, _YEAR.format(1997)).withColumnRenamed("value", "target")), 4)


@query("kpi_custom", "SELECT 'share_of_open' AS kpi_id, round(count(CASE WHEN o_orderstatus = 'O' THEN 1 END) * 100.0 / count(*), 6) AS value FROM orders UNION ALL SELECT 'largest', max(o_totalprice) FROM orders")
def _(spark, d):
    return _rounded(kpi.custom(table(spark, d, "orders"), {"share_of_open": F.count_if(F.col("o_orderstatus") == "O") * 100.0 / F.count("*"), "largest": F.max("o_totalprice"), "none": F.max(F.lit(None).cast("double"))}))


@query("kpi_alerts", "SELECT c_custkey AS kpi_id, c_acctbal AS value, CASE WHEN c_acctbal <= 0 OR c_acctbal >= 9500 THEN 'critical' WHEN c_acctbal <= 1000 OR c_acctbal >= 9000 THEN 'warning' ELSE 'normal' END AS status FROM customer")
def _(spark, d):
    v = table(spark, d, "customer").selectExpr("c_custkey AS kpi_id", "c_acctbal AS value")
    return kpi.alerts(v, v.selectExpr("kpi_id", "0.0D AS critical_low", "9500.0D AS critical_high", "1000.0D AS warning_low", "9000.0D AS warning_high"))


@query("kpi_sparkline", "SELECT c_mktsegment, c_custkey, round((c_acctbal - min(c_acctbal) OVER (PARTITION BY c_mktsegment)) * 100 / (max(c_acctbal) OVER (PARTITION BY c_mktsegment) - min(c_acctbal) OVER (PARTITION BY c_mktsegment)), 6) AS scaled FROM customer")
def _(spark, d):
    return _rounded(kpi.sparkline(table(spark, d, "customer"), "c_mktsegment", "c_custkey", "c_acctbal"))


@query("kpi_history", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 50")
def _(spark, d):
    return kpi.history(table(spark, d, "events"), "event_type", "event_id").select("event_id")


@query("kpi_point_changes", "SELECT event_type, event_id, value, round(CASE WHEN lag(value) OVER w IS NOT NULL THEN coalesce((value - lag(value) OVER w) * 100 / nullif(lag(value) OVER w, 0), 0) END, 4) AS change_percent FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)")
def _(spark, d):
    return _rounded(kpi.point_changes(table(spark, d, "events"), "event_type", "event_id", "value"), 4)


# --- charts -------------------------------------------------------------------------------------------------


@query("chart_bar", "SELECT p_brand, round(avg(p_retailprice), 6) AS value FROM part GROUP BY 1")
def _(spark, d):
    return _rounded(charts.bar(table(spark, d, "part"), "p_brand", "p_retailprice", "avg"))


@query("chart_line", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS count FROM orders GROUP BY 1")
def _(spark, d):
    return charts.line(table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), "day")


@query("chart_pie", f"SELECT flag, count(*) AS count FROM ({HOLES}) WHERE flag IS NOT NULL GROUP BY 1")
def _(spark, d):
    return charts.pie(_view(spark, d, HOLES), "flag")


@query("chart_scatter", "SELECT p_partkey, p_size, p_retailprice FROM part")
def _(spark, d):
    return charts.scatter(table(spark, d, "part"), "p_size", "p_retailprice", "p_partkey")


@query("chart_histogram", """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT CAST(least(greatest(ceil((l_extendedprice - lo) / (hi - lo) * 20), 1), 20) AS INT) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
  SELECT CAST(i AS INT) AS bin, round(lo + (i - 1) * ((hi - lo) / 20), 4) AS bin_low, round(lo + i * ((hi - lo) / 20), 4) AS bin_high, coalesce(n, 0) AS count FROM range(1, 21) AS r(i) CROSS JOIN e LEFT JOIN b ON b.bin = i""")
def _(spark, d):
    return _rounded(charts.histogram(table(spark, d, "lineitem"), "l_extendedprice"), 4)


@query("chart_heatmap", "SELECT l_returnflag, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS F, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS O FROM lineitem GROUP BY 1")
def _(spark, d):
    return charts.heatmap(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("chart_correlations", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem")
def _(spark, d):
    return _rounded(charts.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]))


@query("chart_box", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders) SELECT round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders, q WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1, 2, 3")
def _(spark, d):
    return _rounded(charts.box(table(spark, d, "orders"), "o_totalprice"), 4)


@query("summary_statistics", " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM part" for c in ("p_size", "p_retailprice")))
def _(spark, d):
    return _rounded(charts.summary(table(spark, d, "part"), ["p_size", "p_retailprice"]), 4)


@query("chart_top_values", "SELECT p_name, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return charts.top_values(table(spark, d, "part"), "p_name")


# --- schemas ------------------------------------------------------------------------------------------------

def _orders_of(spark: SparkSession, d: str, dirty: bool) -> DataFrame:
    """``orders`` as it is, or with holes and a column that turned to text."""
    return _view(spark, d, ORDERS) if dirty else table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey AS customer", "o_orderstatus AS status", "o_totalprice AS total", "o_orderdate AS placed")


def _columns_of(spark: SparkSession, d: str, dirty: bool) -> DataFrame:
    """Profile rows of these orders."""
    v = _orders_of(spark, d, dirty)
    return profile.columns(v).join(types.profile_type(v, v.columns), "name")


def _difference(spark: SparkSession, d: str) -> DataFrame:
    return schema.diff(schema.descriptor(_orders_of(spark, d, False)), schema.descriptor(_orders_of(spark, d, True)))


@query("schema_diff", """SELECT * FROM (VALUES ('customer', 'NULLABLE_CHANGED', 'minor'), ('placed', 'REMOVED', 'major'), ('priority', 'ADDED', 'minor'), ('total', 'NULLABLE_CHANGED', 'minor')) AS t(name, change, severity)""")
def _(spark, d):
    return _difference(spark, d)


@query("schema_compat", "SELECT 'major' AS level, 4::BIGINT AS changes, 1::BIGINT AS major, 0::BIGINT AS breaking, 'migrate data' AS strategy")
def _(spark, d):
    return schema.compatibility(_difference(spark, d))


@query("schema_drift", f"""SELECT 'customer' AS name, round(count(CASE WHEN v.customer IS NULL THEN 1 END) * 100.0 / count(*), 4) AS null_percent_change, count(DISTINCT v.customer) - count(DISTINCT o.o_custkey) AS unique_change, 0::BIGINT AS row_change FROM ({ORDERS}) v JOIN orders o USING (o_orderkey)
  UNION ALL SELECT 'total', round(count(CASE WHEN v.total IS NULL THEN 1 END) * 100.0 / count(*), 4), count(DISTINCT v.total) - count(DISTINCT o.o_totalprice), 0 FROM ({ORDERS}) v JOIN orders o USING (o_orderkey) UNION ALL SELECT 'o_orderkey', 0, 0, 0 UNION ALL SELECT 'status', 0, 0, 0""")
def _(spark, d):
    clean = table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey AS customer", "o_orderstatus AS status", "o_totalprice AS total")
    return _rounded(schema.drift(clean, _view(spark, d, ORDERS).drop("priority")), 4)


@query("schema_validate", f"SELECT 'warning' AS severity, concat('more values than rows: ', name) AS problem FROM (SELECT 'o_orderkey' AS name, count(*) AS n FROM orders) WHERE n > 5000")
def _(spark, d):
    return schema.validate(profile.columns(table(spark, d, "orders").select("o_orderkey", "o_orderstatus")), 5000)


_VERSIONS = "SELECT o_custkey AS table_name, o_orderkey AS version, o_totalprice FROM orders"


@query("schema_versions", f"SELECT table_name, version, lead(version) OVER (PARTITION BY table_name ORDER BY version) AS next_version, lead(version) OVER (PARTITION BY table_name ORDER BY version) IS NULL AS active FROM ({_VERSIONS})")
def _(spark, d):
    return schema.versions(_view(spark, d, _VERSIONS)).drop("o_totalprice")


@query("version_ancestry", "WITH RECURSIVE c AS (SELECT 0 AS depth, max(o_orderkey) AS version FROM orders UNION ALL SELECT depth + 1, version // 10 FROM c WHERE version > 0) SELECT version, depth FROM c")
def _(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS version", "IF(o_orderkey > 0, o_orderkey DIV 10, NULL) AS parent_version")
    return schema.ancestry(rows, rows.agg(F.max("version")).first()[0])


@query("schema_prompt")
def _(spark, d):
    return schema.prompt_rows(_columns_of(spark, d, True))


@query("schema_describe")
def _(spark, d):
    return schema.describe(_view(spark, d, TEXTS), list(_KIND), order="l_orderkey")


# --- privacy -----------------------------------------------------------------------------------------------


@query("pii_counts", "SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS INT) AS n_{k}" for k, p, _ in privacy.PATTERNS) + f" FROM ({REGISTRY})")
def _(spark, d):
    return privacy.counts(_view(spark, d, REGISTRY), "doc_id")


def _masked_sql(c: str = "text") -> str:
    for k, p, _ in privacy.PATTERNS:
        c = f"regexp_replace({c}, '{p}', '[{k.upper()}_REDACTED]', 'g')"
    return c


@query("pii_mask", f"SELECT doc_id, md5({_masked_sql()}) AS masked FROM ({REGISTRY})")
def _(spark, d):
    return _view(spark, d, REGISTRY).select("doc_id", F.md5(privacy.masked("text")).alias("masked"))


_LEVEL = "CASE WHEN " + " OR ".join(f"regexp_matches(text, '{p}')" for _, p, c in privacy.PATTERNS if c > 0.8) + " THEN 'RESTRICTED' WHEN " + " OR ".join(f"regexp_matches(text, '{p}')" for _, p, c in privacy.PATTERNS if c <= 0.8) + " THEN 'CONFIDENTIAL' ELSE 'INTERNAL' END"


@query("classify", f"SELECT doc_id, {_LEVEL} AS level FROM ({REGISTRY})")
def _(spark, d):
    return _view(spark, d, REGISTRY).select("doc_id", privacy.classification("text", "document").alias("level"))


@query("pii_spans")
def _(spark, d):
    return privacy.spans(table(spark, d, "documents"), "doc_id")


_EXPIRY = "CASE retention WHEN 'short' THEN created + 30 WHEN 'medium' THEN created + 365 WHEN 'long' THEN created + 2555 END"


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return privacy.registry(_view(spark, d, REGISTRY), "doc_id", "user_id", "text", "created", "retention")


@query("retention", f"SELECT doc_id, user_id, {_EXPIRY} AS expires_on FROM ({REGISTRY}) WHERE {_EXPIRY} IS NULL OR {_EXPIRY} >= DATE '2024-06-01'")
def _(spark, d):
    return privacy.retained(_registry(spark, d), F.lit("2024-06-01").cast("date")).select("doc_id", "user_id", "expires_on")


@query("privacy_report", f"""SELECT level AS classification, count(doc_id) AS records, count(CASE WHEN level IN ('RESTRICTED', 'CONFIDENTIAL') AND doc_id IS NOT NULL THEN 1 END) AS pii, count(CASE WHEN level = 'RESTRICTED' AND doc_id IS NOT NULL THEN 1 END) AS encrypted FROM (VALUES ('PUBLIC'), ('INTERNAL'), ('CONFIDENTIAL'), ('RESTRICTED')) AS l(level)
  LEFT JOIN (SELECT doc_id, {_LEVEL} AS level FROM ({REGISTRY})) USING (level) GROUP BY 1""")
def _(spark, d):
    return privacy.report(_registry(spark, d))


@query("privacy_compliance", f"""SELECT count(*) AS records, count(CASE WHEN level <> 'INTERNAL' THEN 1 END) AS pii, count(CASE WHEN level = 'RESTRICTED' THEN 1 END) AS encrypted, count(CASE WHEN expires < DATE '2024-06-01' THEN 1 END) AS expired,
  round(coalesce(count(CASE WHEN level = 'RESTRICTED' THEN 1 END) * 100.0 / nullif(count(CASE WHEN level <> 'INTERNAL' THEN 1 END), 0), 100), 6) AS pii_encryption_rate, count(CASE WHEN expires < DATE '2024-06-01' THEN 1 END) > 0 AS expired_present FROM (SELECT {_LEVEL} AS level, {_EXPIRY} AS expires FROM ({REGISTRY}))""")
def _(spark, d):
    return _rounded(privacy.compliance(_registry(spark, d), F.lit("2024-06-01").cast("date")))


@query("retention_counts", f"SELECT retention, count(*) AS records FROM ({REGISTRY}) GROUP BY 1")
def _(spark, d):
    return privacy.retention_counts(_registry(spark, d))


@query("access_decision", f"""SELECT event_id AS request_id, e.doc_id, reason = 'granted' AS allowed, reason FROM (SELECT event_id, e.doc_id, CASE WHEN r.level IS NULL THEN 'unknown record' WHEN expires < DATE '2024-06-01' THEN 'expired' WHEN level IN ('RESTRICTED', 'CONFIDENTIAL') AND e.doc_id % 3 <> 0 THEN 'no consent' WHEN purpose NOT IN ('view', 'click') THEN 'purpose not allowed' ELSE 'granted' END AS reason
  FROM (SELECT event_id, user_id * 11 AS doc_id, event_type AS purpose FROM events) e LEFT JOIN (SELECT doc_id, {_LEVEL} AS level, {_EXPIRY} AS expires FROM ({REGISTRY})) r ON e.doc_id = r.doc_id) e""")
def _(spark, d):
    records = _registry(spark, d).withColumn("consent", F.col("doc_id") % 3 == 0).withColumn("purposes", F.array(F.lit("view"), F.lit("click")))
    requests = table(spark, d, "events").selectExpr("event_id AS request_id", "user_id * 11 AS doc_id", "event_type AS purpose")
    return privacy.access_decisions(requests, records, "doc_id", F.lit("2024-06-01").cast("date"))


@query("subject_export", f"SELECT doc_id FROM ({REGISTRY}) WHERE user_id = 'u7'")
def _(spark, d):
    return privacy.subject_export(_registry(spark, d), "user_id", "u7").select("doc_id")


# --- text jobs ---------------------------------------------------------------------------------------------


def _case(table_: tuple, c: str = "lower(text)") -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f"contains({c}, '{w}')" for w in words)} THEN '{k}'" for k, words in table_)


def _words_case(table_: tuple, c: str = "lower(text)") -> str:
    return "CASE " + " ".join(f"WHEN contains({c}, '{w}') THEN '{k}'" for k, words in table_ for w in words)


@query("question_intent", f"SELECT qid, {_case(text.FAMILIES)} ELSE 'DESCRIPTIVE' END AS question_type, {_words_case(text.FUNCTIONS)} END AS aggregation, TRY_CAST(regexp_extract(text, '([0-9]+)', 1) AS BIGINT) AS number FROM ({ASKED})")
def _(spark, d):
    return text.intents(_view(spark, d, ASKED)).drop("text")


@query("question_complexity", f"""SELECT qid, CASE WHEN s <= 0 THEN 'simple' WHEN s <= 2 THEN 'medium' ELSE 'complex' END AS complexity FROM (SELECT qid, {' + '.join(f"CASE WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in words)} THEN {weight} ELSE 0 END" for weight, words in text.INDICATORS)}
  + CASE WHEN {' + '.join(f"contains(lower(text), '{c}')::INT" for c in ('o_custkey', 'o_totalprice', 'o_orderstatus'))} > 2 THEN 1 ELSE 0 END + CASE WHEN {' + '.join(f"contains(lower(text), '{c}')::INT" for c in text.CONDITIONS)} > 1 THEN 1 ELSE 0 END AS s FROM ({ASKED}))""")
def _(spark, d):
    return _view(spark, d, ASKED).select("qid", text.complexity(F.col("text"), ["o_custkey", "o_totalprice", "o_orderstatus"]).alias("complexity"))


@query("question_features", f"""SELECT qid, length(text) AS length, len(regexp_split_to_array(trim(text), '\\s+')) AS words, regexp_matches(text, '[0-9]') AS has_number, contains(text, '?') AS has_mark, families, CASE WHEN families = 0 THEN 'simple' WHEN families <= 2 THEN 'moderate' ELSE 'complex' END AS complexity
  FROM (SELECT *, {' + '.join('CAST(' + ' OR '.join(f"contains(lower(text), '{w}')" for w in words) + ' AS INT)' for _, words in text.FAMILIES)} AS families FROM ({QUESTIONS}))""")
def _(spark, d):
    return text.features(_view(spark, d, QUESTIONS), "qid")


@query("question_scores", f"""WITH s AS (SELECT qid, {', '.join(f"round(least(0.6::DOUBLE, ({' + '.join(f"CAST(contains(lower(trim(text)), '{w}') AS INT)" for w in words)}) * 0.2::DOUBLE) + least(0.4::DOUBLE, ({' + '.join(f"CAST(regexp_matches(lower(trim(text)), '{r}') AS INT)" for r in patterns)}) * 0.3::DOUBLE), 6) AS {k}" for k, words, patterns in text.WEIGHTED)} FROM ({ASKED})), m AS (SELECT *, greatest({', '.join(k for k, _, _ in text.WEIGHTED)}) AS g FROM s)
  SELECT qid, CASE WHEN g < 0.3 THEN 'DESCRIPTIVE' {' '.join(f"WHEN {k} = g THEN '{k}'" for k, _, _ in text.WEIGHTED)} END AS kind, round(CASE WHEN g < 0.3 THEN 0.5::DOUBLE ELSE g END, 6) AS score FROM m""")
def _(spark, d):
    return _rounded(text.weighted_types(_view(spark, d, ASKED), "qid"))


_NAMES = ("o_totalprice", "o_custkey", "order_status", "order_priority", "trend_of_sales", "total")


@query("column_mentions", f"""WITH q AS (SELECT qid, lower(text) AS t, list_distinct(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +')) AS w FROM ({ASKED})), n AS (SELECT name, replace(name, '_', ' ') AS spaced, list_distinct(string_split(replace(name, '_', ' '), ' ')) AS parts FROM (VALUES {', '.join(f"('{n}')" for n in _NAMES)}) AS t(name))
  SELECT qid, name, round(c, 6)::DOUBLE AS confidence FROM (SELECT qid, name, CASE WHEN contains(t, name) THEN 1.0 WHEN contains(t, spaced) THEN 0.9 WHEN len(list_intersect(w, parts)) / len(parts) >= 0.5 THEN 0.7 * len(list_intersect(w, parts)) / len(parts) END AS c FROM q CROSS JOIN n) WHERE c IS NOT NULL""")
def _(spark, d):
    names = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    return _rounded(text.mentions(_view(spark, d, ASKED), names, "qid"))


# names that are all of one text and do not overlap in it: the longer ones take what shorter ones hold too
@query("column_spans", f"""WITH q AS (SELECT qid, lower(text) AS t FROM ({QUESTIONS})), f AS (SELECT * FROM (VALUES ('order_status', 'order status', 0.9), ('order_priority', 'order priority', 0.9), ('priority', 'priority', 1.0), ('o_totalprice', 'o_totalprice', 1.0), ('total', 'total', 1.0), ('sales', 'sales', 1.0)) AS t(name, form, confidence)),
  h AS (SELECT qid, name, form, confidence, instr(t, form) - 1 AS first FROM q JOIN f ON contains(t, form) WHERE name <> 'total' AND name <> 'priority' UNION ALL SELECT qid, 'total', 'total', 1.0, instr(t, 'total ') - 1 FROM q WHERE contains(t, 'total ') UNION ALL SELECT qid, 'priority', 'priority', 1.0, instr(t, 'priority') - 1 FROM q WHERE contains(t, 'priority') AND NOT contains(t, 'order priority'))
  SELECT qid, 'column' AS kind, form AS text, name, first::INT AS first, (first + length(form))::INT AS last, confidence::DOUBLE AS confidence FROM h""")
def _(spark, d):
    names = spark.createDataFrame([(n,) for n in ("order_status", "order_priority", "priority", "o_totalprice", "total", "sales")], "name string")
    return mentions.spans(_view(spark, d, QUESTIONS), names, "qid")


@query("filter_phrases", f"SELECT qid, 'o_custkey' AS \"column\", '>' AS operator, regexp_extract(text, '> ([0-9]+)', 1) AS value FROM ({QUESTIONS}) WHERE qid % 7 = 3 UNION ALL SELECT qid, 'o_orderstatus', '=', 'F' FROM ({QUESTIONS}) WHERE qid % 7 = 3 UNION ALL SELECT qid, 'o_custkey', '=', regexp_extract(text, '= ([0-9]+)', 1) FROM ({QUESTIONS}) WHERE qid % 7 = 6")
def _(spark, d):
    return text.filter_phrases(_view(spark, d, QUESTIONS), "qid")


@query("sql_blocks", f"SELECT qid, upper(regexp_extract(text, '(SELECT .*);', 1)) AS sql, true AS has_aggregation, true AS has_grouping, true AS has_filter, false AS has_order FROM ({QUESTIONS}) WHERE qid % 7 = 6")
def _(spark, d):
    return text.sql_blocks(_view(spark, d, QUESTIONS), "qid")


@query("text_metrics", f"SELECT qid, 0 AS place, CAST(regexp_extract(text, 'took ([0-9]+) seconds', 1) AS DOUBLE) AS value, 'seconds' AS unit FROM ({QUESTIONS}) WHERE qid % 7 = 6")
def _(spark, d):
    return text.metrics(_view(spark, d, QUESTIONS), "qid")


@query("answer_features", """WITH c AS (SELECT concat_ws('-', conv_id, turn) AS k, len(list_filter(regexp_split_to_array(text, '[.!?]+\\s*'), lambda s: length(trim(s)) > 0)) AS sentences, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda s: s <> '')) AS words, len(regexp_extract_all(text, '(?m)^\\s*(?:[0-9]+\\.|[-*])\\s')) AS steps,
  contains(lower(text), 'because') OR contains(lower(text), 'therefore') OR contains(lower(text), 'due to') AS explains, list_sum(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda p: len(list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> '')))) / len(regexp_split_to_array(text, '[.!?]+')) AS mean FROM conversations)
  SELECT k, sentences::INT AS sentences, words::INT AS words, steps::INT AS steps, explains, CASE WHEN mean BETWEEN 10 AND 25 THEN 0.8 WHEN mean BETWEEN 5 AND 35 THEN 0.6 ELSE 0.4 END::DOUBLE AS clarity FROM c""")
def _(spark, d):
    return _rounded(text.answer_features(table(spark, d, "conversations").withColumn("k", F.concat_ws("-", "conv_id", "turn")), "k"))


# answers in sections, bullets, paragraphs, steps, and with the fields of a diagnosis
ANSWERS = """SELECT o_orderkey AS qid, CASE o_orderkey % 6 WHEN 0 THEN concat('1. Overview: total is ', CAST(o_custkey AS VARCHAR(12)), chr(10), '2. Insight: more of ', o_orderpriority, chr(10), '1. Overview: again, for example ', o_orderstatus) WHEN 1 THEN concat('- Trend: up by ', CAST(o_custkey % 90 AS VARCHAR(12)), chr(10), '  still rising', chr(10), '- We recommend: review prices')
  WHEN 2 THEN concat('First of all.', chr(10), chr(10), 'The findings are clear because orders of ', o_orderpriority, ' fell. This shows it! Is it due to cost?', chr(10), chr(10), 'That is all') WHEN 3 THEN concat('Problem: column ', CAST(o_custkey AS VARCHAR(12)), ' is missing', chr(10), 'in the table', chr(10), 'Fix: add it', chr(10), 'Tips: check first')
  WHEN 4 THEN concat('1. Compare regions of ', o_orderstatus, chr(10), '2. Track sales', chr(10), '10. Wait') ELSE concat('Nothing to say about ', CAST(o_custkey AS VARCHAR(12))) END AS text FROM orders"""


@query("answer_sections", f"""WITH s AS (SELECT qid, qid % 6 AS c, text FROM ({ANSWERS}))
  SELECT qid, 0 AS place, 'Overview' AS title, regexp_extract(text, 'again.*$') AS content FROM s WHERE c = 0 UNION ALL SELECT qid, 1, 'Insight', regexp_extract(text, 'more of [^\n]*') FROM s WHERE c = 0
  UNION ALL SELECT qid, 0, 'Trend', concat(regexp_extract(text, 'up by [0-9]+'), chr(10), '  still rising') FROM s WHERE c = 1 UNION ALL SELECT qid, 1, 'We recommend', 'review prices' FROM s WHERE c = 1 UNION ALL SELECT qid, 0, 'Analysis 2', string_split(text, chr(10) || chr(10))[2] FROM s WHERE c = 2""")
def _(spark, d):
    return answers.sections(_view(spark, d, ANSWERS), "qid")


@query("answer_suggestions", f"""WITH s AS (SELECT qid, qid % 6 AS c, text FROM ({ANSWERS})), l AS (SELECT qid, c, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS place, regexp_replace(unnest(string_split(text, chr(10))), '^[0-9]+[.] ', '') AS line FROM s WHERE c IN (0, 4)),
  r AS (SELECT qid, place, line AS suggestion FROM l UNION ALL SELECT qid, 0, concat('Trend: ', regexp_extract(text, 'up by [0-9]+'), chr(10), '  still rising') FROM s WHERE c = 1 UNION ALL SELECT qid, 1, 'We recommend: review prices' FROM s WHERE c = 1)
  SELECT qid, place, suggestion, contains(lower(suggestion), 'compare') OR contains(lower(suggestion), 'track') OR contains(lower(suggestion), 'review') AS actionable FROM r""")
def _(spark, d):
    return answers.suggestions(_view(spark, d, ANSWERS).where("qid % 6 <> 2"), "qid")


@query("answer_diagnosis", f"SELECT qid, CASE WHEN qid % 6 = 3 THEN concat(regexp_extract(text, 'column [0-9]+ is missing'), chr(10), 'in the table') END AS cause, CASE WHEN qid % 6 = 3 THEN concat('add it', chr(10), 'Tips: check first') END AS solution, CASE WHEN qid % 6 = 3 THEN 'check first' END AS prevention, CASE WHEN qid % 6 = 3 THEN 1.0 ELSE 0.2 END::DOUBLE AS confidence FROM ({ANSWERS})")
def _(spark, d):
    return _rounded(answers.diagnosis(_view(spark, d, ANSWERS), "qid"))


@query("kpi_relevant", """SELECT * FROM (SELECT *, (CASE category WHEN 'business' THEN 10 WHEN 'summary' THEN 8 WHEN 'categorical' THEN 6 ELSE 5 END + CASE WHEN contains(kpi_id, 'customer') OR contains(kpi_id, 'sales') THEN 5 ELSE 0 END + CASE WHEN kpi_type IN ('sum', 'average', 'count') THEN 3 ELSE 0 END)::INT AS score
  FROM (SELECT * FROM (VALUES ('total_o_totalprice', 'summary', 'sum'), ('avg_o_totalprice', 'summary', 'average'), ('max_o_totalprice', 'summary', 'max'), ('total_o_custkey', 'summary', 'sum'), ('avg_o_custkey', 'summary', 'average'), ('max_o_custkey', 'summary', 'max'), ('completeness', 'quality', 'percentage'), ('duplicate_rate', 'quality', 'percentage'), ('total_records', 'quality', 'count')) AS t(kpi_id, category, kpi_type)
    UNION ALL SELECT 'unique_customer_' || o_orderstatus, 'business', 'count' FROM (SELECT DISTINCT o_orderstatus FROM orders))) ORDER BY score DESC, kpi_id LIMIT 9""")
def _(spark, d):
    o = table(spark, d, "orders")
    of = lambda rows, category, kind: rows.select("kpi_id", F.lit(category).alias("category"), kind.alias("kpi_type"))
    first = F.substring_index("kpi_id", "_", 1)
    numeric = of(kpi.numeric_kpis(o, ["o_totalprice", "o_custkey"]), "summary", F.when(first == "total", "sum").when(first == "avg", "average").otherwise("max"))
    quality = of(kpi.quality_kpis(o), "quality", F.when(F.col("kpi_id") == "total_records", "count").otherwise("percentage"))
    business = of(o.select(F.concat(F.lit("unique_customer_"), "o_orderstatus").alias("kpi_id")).distinct(), "business", F.lit("count"))
    return kpi.relevant(numeric.unionByName(quality).unionByName(business), 9)


@query("entities")
def _(spark, d):
    return text.entities(_view(spark, d, QUESTIONS), "qid")


@query("filter_conditions")
def _(spark, d):
    q = _view(spark, d, QUESTIONS)
    named = q.where("locate('o_custkey', text) > 0").select("qid", F.lit("o_custkey").alias("name"), (F.locate("o_custkey", "text") + 8).alias("last"))
    return text.filter_conditions(text.entities(q, "qid"), named, "qid")


@query("fuzzy_columns")
def _(spark, d):
    names = table(spark, d, "orders").limit(1).select(F.explode(F.array(F.lit("o_totalprice"), F.lit("customer"), F.lit("orders"))).alias("name"))
    return text.fuzzy_columns(_view(spark, d, QUESTIONS), names, "qid", "text")


@query("conversation_summary", "SELECT conv_id, count(*) AS interactions, md5(string_agg(text, '|' ORDER BY turn) FILTER (r <= 5)) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) GROUP BY 1")
def _(spark, d):
    return text.last_turns(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "interactions", F.md5(F.array_join("recent", "|")).alias("recent"))


@query("conversation_confidence", "SELECT conv_id, count(*) AS interactions, round(coalesce(avg(CASE WHEN turn % 3 <> 1 THEN (length(text) % 100) / 100.0 END), 0), 6) AS confidence, md5(string_agg(text, '|' ORDER BY turn) FILTER (r <= 5)) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) GROUP BY 1")
def _(spark, d):
    told = table(spark, d, "conversations").withColumn("confidence", F.when(F.col("turn") % 3 != 1, F.length("text") % 100 / 100.0))
    return _rounded(text.conversation_summary(told, "conv_id", "turn", "text", "confidence").withColumn("recent", F.md5(F.array_join("recent", "|"))))


@query("numbers_in_text", "SELECT doc_id, len(regexp_extract_all(text, '(-?[0-9]+\\.?[0-9]*)')) AS n, round(coalesce(list_sum(list_transform(regexp_extract_all(text, '(-?[0-9]+\\.?[0-9]*)'), lambda x: CAST(x AS DOUBLE) % 1000)), 0), 4) AS total FROM documents")
def _(spark, d):
    numbers = S.all_numbers(F.col("text"))
    return _rounded(table(spark, d, "documents").select("doc_id", F.size(numbers).cast("long").alias("n"), F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x % 1000).alias("total")), 4)


# --- logs --------------------------------------------------------------------------------------------------


@query("metric_percentiles", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events), s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM r WHERE k <= 1000)
  SELECT event_type, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, max(CASE WHEN i = floor(n * 0.5) + 1 THEN value END) AS p50, max(CASE WHEN i = floor(n * 0.95) + 1 THEN value END) AS p95, max(CASE WHEN i = floor(n * 0.99) + 1 THEN value END) AS p99 FROM s GROUP BY 1""")
def _(spark, d):
    return _rounded(logs.percentiles(table(spark, d, "events"), ["event_type"], "value", ["ts", "event_id"]))


@query("metric_counters", "SELECT event_type, user_id, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    return _rounded(logs.counters(table(spark, d, "events"), ["event_type", "user_id"], "value"), 4)


@query("metric_gauges", "SELECT event_type, arg_max(value, event_id) AS last FROM events GROUP BY 1")
def _(spark, d):
    return logs.gauges(table(spark, d, "events"), ["event_type"], "value", ["event_id"])


@query("metric_summary", """SELECT event_type, coalesce(count(e.value), 0) AS count, round(coalesce(avg(e.value), 0), 4) AS avg, coalesce(min(e.value), 0) AS min, coalesce(max(e.value), 0) AS max, coalesce(arg_max(e.value, e.ts), 0) AS latest FROM (SELECT DISTINCT event_type FROM events UNION ALL SELECT 'absent') LEFT JOIN (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-20') e USING (event_type) GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "events")
    names = e.select("event_type").distinct().unionByName(e.limit(1).select(F.lit("absent").alias("event_type")))
    return _rounded(logs.metric_summary(e, names, "event_type", "value", "ts", F.lit("2024-01-20").cast("timestamp_ntz")), 4)


@query("system_health", "SELECT count(*) AS total, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed, round(count(CASE WHEN event_type = 'error' THEN 1 END) * 100.0 / count(*), 6) AS error_rate FROM events")
def _(spark, d):
    return _rounded(logs.health(table(spark, d, "events"), "event_type", "error"))


@query("error_stats", "SELECT user_id, event_type, count(*) AS errors FROM events GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def _(spark, d):
    return logs.error_statistics(table(spark, d, "events"), ["user_id", "event_type"])


# the events as audit events of several kinds
AUDIT = "SELECT event_id, value, CASE event_type WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'error_occurred' WHEN event_id % 3 = 1 THEN 'login_failed' ELSE 'account_locked' END WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'data_exported' ELSE 'data_deleted' END WHEN 'signup' THEN 'user_created' WHEN 'view' THEN 'data_accessed' ELSE 'logout' END AS event_type FROM events"
_RISK = "CASE WHEN event_type IN ('account_locked', 'data_deleted') THEN 'high' WHEN event_type IN ('error_occurred', 'login_failed', 'data_exported', 'user_created') THEN 'medium' ELSE 'low' END"


@query("audit_report", f"SELECT 'type' AS dimension, event_type AS value, count(*) AS events FROM ({AUDIT}) GROUP BY 2 UNION ALL SELECT 'risk', {_RISK}, count(*) FROM ({AUDIT}) GROUP BY 2 UNION ALL SELECT 'result', CASE WHEN value < 5 THEN 'failure' ELSE 'success' END, count(*) FROM ({AUDIT}) GROUP BY 2")
def _(spark, d):
    e = _view(spark, d, AUDIT).select("event_type", logs.risk_level().alias("risk"), F.when(F.col("value") < 5, "failure").otherwise("success").alias("result"))
    return logs.audit_counts(e, "event_type", "risk", "result")


@query("audit_summary", f"SELECT count(*) AS events, count(DISTINCT event_id % 97) AS users, count(CASE WHEN {_RISK} = 'high' OR value < 5 THEN 1 END) AS alerts FROM ({AUDIT})")
def _(spark, d):
    return logs.audit_summary(_audited(spark, d), "user_id", "risk", "result")


@query("security_alerts", f"SELECT event_id, event_type, {_RISK} AS risk, CASE WHEN value < 5 THEN 'failure' ELSE 'success' END AS result FROM ({AUDIT}) WHERE {_RISK} = 'high' OR value < 5 ORDER BY event_id DESC LIMIT 50")
def _(spark, d):
    return logs.security_alerts(_audited(spark, d), "risk", "result", "event_id", "event_id").select("event_id", "event_type", "risk", "result")


def _audited(spark: SparkSession, d: str) -> DataFrame:
    result = F.when(F.col("value") < 5, "failure").otherwise("success")
    return _view(spark, d, AUDIT).select("event_id", (F.col("event_id") % 97).alias("user_id"), "event_type", "value", logs.risk_level().alias("risk"), result.alias("result"))


@query("threshold_alerts", f"""SELECT event_id, CASE WHEN (event_type = 'logout' AND value <= 3) OR (event_type = 'data_accessed' AND value >= 95) THEN 'critical' WHEN {_RISK} = 'high' THEN 'high' WHEN value < 5 THEN 'failed' ELSE 'warning' END AS severity FROM ({AUDIT})
  WHERE {_RISK} = 'high' OR value < 5 OR (event_type = 'logout' AND value <= 10) OR (event_type = 'data_accessed' AND (value >= 95 OR value >= 80))""")
def _(spark, d):
    levels = spark.createDataFrame([("logout", 3.0, 10.0, None, None), ("data_accessed", None, None, 80.0, 95.0)], "name string, critical_low double, warning_low double, warning_high double, critical_high double")
    return streams.threshold_alerts(_audited(spark, d), levels, "event_type", "value", "risk", "result").select("event_id", "severity")


@query("status_health", """WITH l AS (SELECT ts, event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 10)
  SELECT count(*) AS total, count(CASE WHEN event_type = 'signup' THEN 1 END) AS pending, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed, round(count(CASE WHEN event_type = 'error' THEN 1 END) * 100.0 / count(*), 6) AS error_rate, (SELECT string_agg(event_id, ',' ORDER BY ts DESC, event_id DESC) FROM l) AS recent, (SELECT count(*)::INT FROM l) AS n_recent FROM events""")
def _(spark, d):
    out = logs.status_health(table(spark, d, "events"), "event_type", "ts", "event_id", "signup", "error")
    return _rounded(out.withColumn("recent", F.array_join(F.transform("recent_errors", lambda e: e["key"].cast("string")), ",")).drop("recent_errors"))


@query("session_addresses", "SELECT count(*) AS total, count(CASE WHEN a THEN 1 END) AS active, count(DISTINCT CASE WHEN a THEN user_id END) AS users, count(DISTINCT CASE WHEN a THEN event_id % 61 END) AS addresses FROM (SELECT *, event_type <> 'error' AND ts + INTERVAL 1 DAY >= TIMESTAMP '2024-01-29' AS a FROM events)")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 61).alias("ip"), F.expr("ts + INTERVAL 1 DAY").alias("expires"), (F.col("event_type") != "error").alias("open"))
    return logs.session_addresses(e, "user_id", "ip", "expires", F.lit("2024-01-29").cast("timestamp_ntz"), "open")


# every third user's link has a password, which two in three requests know
@query("guarded_shares", """WITH j AS (SELECT event_id, user_id, ts, CASE WHEN user_id % 10 = 9 THEN 'unknown' WHEN user_id % 10 = 8 THEN 'inactive' WHEN ts > TIMESTAMP '2024-01-25' THEN 'expired' END AS b, user_id % 3 <> 0 OR event_id % 3 <> 0 AS fits FROM events),
  n AS (SELECT *, count(CASE WHEN b IS NULL AND fits THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) - CASE WHEN b IS NULL AND fits THEN 1 ELSE 0 END AS k FROM j), o AS (SELECT event_id, user_id, coalesce(b, CASE WHEN k >= 20 THEN 'limit reached' WHEN NOT fits THEN 'wrong password' ELSE 'granted' END) AS reason FROM n)
  SELECT event_id, user_id, reason = 'granted' AS granted, reason FROM o""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("p"), F.col("user_id").cast("string"))).alias("password"))
    known = F.when(F.col("user_id") % 3 == 0, F.sha2(F.concat(F.lit("p"), F.col("user_id").cast("string")), 256))
    links = e.select("user_id").distinct().where("user_id % 10 <> 9").select("user_id", (F.col("user_id") % 10 != 8).alias("active"), F.lit("2024-01-25").cast("timestamp_ntz").alias("expires_at"), F.lit(20).alias("max_access"), known.alias("password_hash"))
    return logs.guarded_decisions(e, links, "user_id", "ts", "event_id")


@query("user_activity", "SELECT user_id, count(*) AS events, max(ts) AS last_activity FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return logs.user_activity(table(spark, d, "events"), "user_id", "ts")


@query("audit_integrity", "SELECT count(*) AS events, count(CASE WHEN event_id % 10 = 3 THEN 1 END) AS mismatches, round(100 - count(CASE WHEN event_id % 10 = 3 THEN 1 END) * 100.0 / count(*), 6) AS integrity FROM events")
def _(spark, d):
    signed = logs.with_checksum(table(spark, d, "events").select("event_id", "user_id", "value"))
    return _rounded(logs.integrity(signed.withColumn("user_id", F.when(F.col("event_id") % 10 == 3, F.lit(-1)).otherwise(F.col("user_id")))))


@query("share_analytics", "SELECT event_type, count(*) AS accesses, count(DISTINCT user_id) AS visitors, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def _(spark, d):
    return logs.share_analytics(table(spark, d, "events"), "event_type", "user_id", "ts")


@query("daily_access", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS accesses FROM events GROUP BY 1, 2")
def _(spark, d):
    return logs.daily(table(spark, d, "events"), "ts", ["event_type"])


@query("sessions", """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS events FROM s GROUP BY user_id, k""")
def _(spark, d):
    return logs.sessions(table(spark, d, "events"), "user_id", "ts", "6 hours")


@query("session_stats", "SELECT count(*) AS total, count(CASE WHEN ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-20' THEN 1 END) AS active, count(DISTINCT CASE WHEN ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-20' THEN user_id END) AS active_users FROM events")
def _(spark, d):
    return logs.session_statistics(table(spark, d, "events").withColumn("expires", F.expr("ts + INTERVAL 1 DAY")), "user_id", "expires", F.lit("2024-01-20").cast("timestamp_ntz"))


@query("share_decisions", """WITH j AS (SELECT event_id, user_id, CASE WHEN user_id % 10 = 9 THEN 'unknown' WHEN user_id % 10 = 8 THEN 'inactive' WHEN ts > TIMESTAMP '2024-01-25' THEN 'expired' END AS b, ts FROM events), n AS (SELECT *, sum(CASE WHEN b IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM j)
  SELECT event_id, user_id, b IS NULL AND k <= 20 AS granted, coalesce(b, CASE WHEN k > 20 THEN 'limit reached' ELSE 'granted' END) AS reason FROM n""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    links = e.select("user_id").distinct().where("user_id % 10 <> 9").select("user_id", (F.col("user_id") % 10 != 8).alias("active"), F.lit("2024-01-25").cast("timestamp_ntz").alias("expires_at"), F.lit(20).alias("max_access"))
    return logs.share_decisions(e, links, "user_id", "ts", "event_id")


@query("lockouts", "SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTES PRECEDING AND CURRENT ROW) AS failures, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTES PRECEDING AND CURRENT ROW) >= 2 AS locked FROM events WHERE event_type = 'error'")
def _(spark, d):
    return logs.lockouts(table(spark, d, "events").where("event_type = 'error'"), "user_id", "ts", 900, 2)


@query("assemble", "SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, d):
    child = table(spark, d, "orders").selectExpr("o_custkey AS c_custkey", "o_orderdate", "o_orderkey")
    out = logs.assemble(table(spark, d, "customer").select("c_custkey"), {"orders": (child, ["o_orderdate", "o_orderkey"])}, "c_custkey")
    return out.select("c_custkey", F.size("orders").cast("long").alias("n"), F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",").alias("orders"))


@query("result_summary", "SELECT count(*) AS n, round(sum(c_acctbal), 4) AS total, round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS std, count(DISTINCT c_acctbal) AS distinct, (SELECT c_acctbal FROM customer ORDER BY c_acctbal LIMIT 1 OFFSET (SELECT count(*) // 2 FROM customer)) AS upper_median FROM customer")
def _(spark, d):
    return _rounded(logs.result_summary(table(spark, d, "customer"), "c_acctbal"), 4)


@query("answer_quality", f"SELECT round(1 - 0.5 * (count(*) * 6 - count(l_orderkey) - count(quantity) - count(price) - count(flag) - count(status) - count(CASE WHEN note <> '' THEN 1 END)) / (count(*) * 6.0), 6)::DOUBLE AS quality FROM (SELECT *, CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE 'x' END AS note FROM ({HOLES}))")
def _(spark, d):
    v = _view(spark, d, HOLES).drop("l_linenumber", "l_partkey")
    return _rounded(logs.answer_quality(v.withColumn("note", F.when(F.col("l_orderkey") % 5 == 0, "").otherwise("x"))))


@query("execution_stats", "SELECT round(avg(value), 4) AS avg_value, max(value) AS max_value, min(value) AS min_value, round(avg(user_id), 4) AS avg_user_id, max(user_id) AS max_user_id, min(user_id) AS min_user_id, sum(user_id)::BIGINT AS total_user_id FROM events")
def _(spark, d):
    return _rounded(logs.execution_statistics(table(spark, d, "events"), "value", "user_id"), 4)


@query("upsert", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 1 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return logs.upsert(c, c.where("c_custkey % 4 = 1").selectExpr("c_custkey", "CAST(NULL AS STRING) AS c_name", "c_acctbal + 1 AS c_acctbal"), "c_custkey")


@query("weighted_confidence", "SELECT event_type, round(sum(value * value) / sum(value), 4) AS confidence FROM events GROUP BY 1")
def _(spark, d):
    return _rounded(table(spark, d, "events").groupBy("event_type").agg(S.weighted_confidence(F.col("value")).alias("confidence")), 4)


# --- cells and layout ----------------------------------------------------------------------------------------


def _sql_types(value: str) -> str:
    """A column for each cell type: whether ``value`` has it."""
    return ", ".join(f"CASE WHEN regexp_matches({value}, '{cells.type_pattern(k)}') THEN 1 ELSE 0 END AS {k}" for k, _ in cells.CELL_TYPES)


_SHARES = ", ".join(f"avg({k}) AS {k}" for k, _ in cells.CELL_TYPES)
_TOP = f"greatest({', '.join(k for k, _ in cells.CELL_TYPES)})"
_PICK = f"CASE WHEN {_TOP} < 0.5 THEN 'TEXT' " + " ".join(f"WHEN {k} = {_TOP} THEN '{k}'" for k, _ in cells.CELL_TYPES) + " END"
_OFF = "CASE " + " ".join(f"WHEN data_type = '{k}' THEN {k} = 0" for k, _ in cells.CELL_TYPES) + " ELSE false END"
TYPED = f"""d AS ({DIRTY}), m AS (SELECT *, trim(value) AS v, {_sql_types('trim(value)')} FROM d), kinds AS (SELECT table_id, col_no, {_PICK} AS data_type FROM (SELECT table_id, col_no, {_SHARES} FROM m WHERE v <> '' GROUP BY 1, 2))"""
JUDGED = f"""{TYPED}, j AS (SELECT m.*, data_type, {_OFF} AS off, regexp_matches(value, '{"|".join(cells.SUSPICIOUS)}') AS odd,
  trim(regexp_replace(CASE WHEN data_type IN ('NUMBER', 'CURRENCY', 'PERCENTAGE') THEN translate(value, 'OlISGB', '011568') ELSE value END, '\\s+', ' ', 'g')) AS z FROM m JOIN kinds USING (table_id, col_no) WHERE v <> ''),
  t AS (SELECT *, CASE data_type WHEN 'CURRENCY' THEN regexp_replace(z, '[^\\d.,$€£¥]', '', 'g') WHEN 'NUMBER' THEN CASE WHEN regexp_matches(z, '^\\d+ \\d+$') THEN replace(z, ' ', '') WHEN length(z) - length(replace(z, '.', '')) > 1 AND NOT contains(z, ',') AND length(split_part(z, '.', -1)) <= 2 THEN replace(left(z, length(z) - length(split_part(z, '.', -1)) - 1), '.', '') || '.' || split_part(z, '.', -1) ELSE z END ELSE z END AS tidy FROM j),
  checked AS (SELECT table_id, row_no, col_no, value, data_type, CASE WHEN tidy <> value THEN tidy END AS suggested, off, odd FROM t)"""


@query("cell_types", f"WITH {TYPED} SELECT * FROM kinds")
def _(spark, d):
    return cells.column_types(_view(spark, d, DIRTY))


@query("cell_checks", f"WITH {JUDGED} SELECT table_id, row_no, col_no, value, data_type, suggested, round(CASE WHEN suggested IS NULL THEN 1.0 ELSE 0.8 END * CASE WHEN off THEN 0.7 ELSE 1.0 END * CASE WHEN odd THEN 0.8 ELSE 1.0 END, 6)::DOUBLE AS confidence, concat_ws(',', CASE WHEN suggested IS NOT NULL THEN 'suggestion' END, CASE WHEN off THEN 'off_type' END, CASE WHEN odd THEN 'suspicious' END) AS issues FROM checked")
def _(spark, d):
    return _rounded(cells.checks(_view(spark, d, DIRTY)))


STRUCTURE = f"""{JUDGED}, r AS (SELECT table_id, row_no, count(*) AS n, count(CASE WHEN v <> '' THEN 1 END) AS f, string_agg(lower(v), '|' ORDER BY col_no) AS s FROM m GROUP BY 1, 2),
  body AS (SELECT table_id, count(*) AS rows, min(n) AS lo, max(n) AS hi, count(CASE WHEN f = 0 THEN 1 END) AS empty_rows, count(*) - count(DISTINCT s) AS duplicate_rows FROM r GROUP BY 1),
  heads AS (SELECT table_id, count(*) AS width, count(CASE WHEN trim(header) = '' THEN 1 END) AS empty_headers, count(*) - count(DISTINCT lower(trim(header))) AS duplicate_headers, count(CASE WHEN starts_with(header, 'Column_') THEN 1 END) AS generic_headers,
    count(CASE WHEN length(trim(header)) > 50 THEN 1 END) + count(CASE WHEN trim(header) <> header THEN 1 END) AS untidy_headers FROM (SELECT DISTINCT table_id, col_no, header FROM d) GROUP BY 1),
  mixed AS (SELECT table_id, sum(x)::BIGINT AS mixed_columns FROM (SELECT table_id, col_no, CASE WHEN count(CASE WHEN off THEN 1 END) > 0.1 * count(*) THEN 1 ELSE 0 END AS x FROM j GROUP BY 1, 2) GROUP BY 1),
  facts AS (SELECT table_id, rows, width, empty_rows, duplicate_rows, lo <> width OR hi <> width AS ragged, empty_headers, duplicate_headers, generic_headers, untidy_headers, coalesce(mixed_columns, 0) AS mixed_columns FROM body JOIN heads USING (table_id) LEFT JOIN mixed USING (table_id)),
  scored AS (SELECT *, (width < 2)::BIGINT + ragged::BIGINT + (duplicate_headers > 0)::BIGINT + (empty_headers > 0)::BIGINT AS structure_issues, (generic_headers > 0)::BIGINT + untidy_headers + mixed_columns + (empty_rows > 0)::BIGINT + (duplicate_rows > 0)::BIGINT AS quality_issues FROM facts)"""


@query("table_structure", f"WITH {STRUCTURE} SELECT * FROM scored")
def _(spark, d):
    return cells.structure(_view(spark, d, DIRTY))


@query("table_scores", f"WITH {STRUCTURE}, bad AS (SELECT table_id, count(CASE WHEN suggested IS NOT NULL OR off OR odd THEN 1 END) AS cell_issues FROM checked GROUP BY 1), s AS (SELECT table_id, structure_issues, quality_issues, coalesce(cell_issues, 0) AS cell_issues, greatest(0.0, round(0.95 + (length(table_id) - 3) - 0.2 * structure_issues - 0.1 * quality_issues - 0.05 * coalesce(cell_issues, 0), 6))::DOUBLE AS score FROM scored LEFT JOIN bad USING (table_id)) SELECT *, score >= 0.7 AND structure_issues = 0 AS valid FROM s")
def _(spark, d):
    c = _view(spark, d, DIRTY)
    return _rounded(cells.score(c, c.select("table_id").distinct().withColumn("confidence", F.lit(0.95) + F.length("table_id") - 3)))


def _corrections(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d, CELLS).selectExpr("table_id", "row_no", "col_no", "CASE WHEN row_no % 10 = 4 THEN 'delete_row' WHEN col_no = 1 THEN 'replace' ELSE 'blank' END AS action", "'42' AS new_value", "row_no AS seq").where("row_no % 10 = 4 OR (row_no % 7 = 2 AND col_no > 0)")


@query("cells_correct", f"""WITH c AS (SELECT *, dense_rank() OVER (PARTITION BY table_id ORDER BY row_no) - 1 + min(row_no) OVER (PARTITION BY table_id) AS k FROM ({CELLS}) WHERE row_no % 10 <> 4)
  SELECT table_id, CAST(k AS INT) AS row_no, col_no, header, CASE WHEN row_no % 7 = 2 AND col_no = 1 THEN '42' WHEN row_no % 7 = 2 AND col_no = 2 THEN '' ELSE value END AS value FROM c""")
def _(spark, d):
    return cells.corrected(_view(spark, d, CELLS), _corrections(spark, d))


@query("cell_diff", f"""WITH c AS ({CELLS}), o AS (SELECT * FROM c WHERE row_no % 9 <> 1), n AS (SELECT table_id, row_no, col_no, upper(value) AS value FROM c WHERE row_no % 9 <> 2)
  SELECT coalesce(o.table_id, n.table_id) AS table_id, coalesce(o.row_no, n.row_no) AS row_no, coalesce(o.col_no, n.col_no) AS col_no, o.value AS old_value, n.value AS new_value, CASE WHEN o.table_id IS NULL THEN 'added' WHEN n.table_id IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM o FULL JOIN n ON o.table_id = n.table_id AND o.row_no = n.row_no AND o.col_no = n.col_no WHERE o.value IS DISTINCT FROM n.value OR o.table_id IS NULL OR n.table_id IS NULL""")
def _(spark, d):
    c = _view(spark, d, CELLS)
    return cells.diff(c.where("row_no % 9 <> 1"), c.where("row_no % 9 <> 2").withColumn("value", F.upper("value")))


@query("correction_status", f"SELECT event_type AS session_id, count(*) AS total, count(CASE WHEN user_id % 3 = 0 THEN 1 END) AS accepted, count(CASE WHEN user_id % 3 = 1 THEN 1 END) AS rejected, count(CASE WHEN user_id % 3 = 2 THEN 1 END) AS open, 0.3::DOUBLE AS gain FROM events GROUP BY 1")
def _(spark, d):
    return cells.correction_status(table(spark, d, "events").selectExpr("event_type AS session_id", "CASE user_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'open' END AS state"))


@query("words_to_lines", f"""WITH w AS (SELECT *, CASE WHEN abs(y - lag(y) OVER o) > 10 THEN 1 ELSE 0 END AS n FROM ({WORDS}) WINDOW o AS (PARTITION BY page ORDER BY y, x)) SELECT page, word_no, k, CAST(sum(n) OVER (PARTITION BY page ORDER BY y, x ROWS UNBOUNDED PRECEDING) AS INT) AS line FROM w""")
def _(spark, d):
    return layout.lines(_view(spark, d, WORDS), ["page"], ["y", "x"]).select("page", "word_no", "k", "line")


@query("words_to_rows", f"SELECT page, word_no, k, CAST(word_no % 20 AS INT) AS row_no FROM ({WORDS})")
def _(spark, d):
    return layout.rows_by_running_mean(_view(spark, d, WORDS), ["page"]).select("page", "word_no", "k", "row_no")


@query("column_bounds", f"SELECT page, k AS col_no, CAST(floor(avg(x)) AS INT) AS bound FROM (SELECT DISTINCT page, k, x FROM ({WORDS})) GROUP BY 1, 2")
def _(spark, d):
    return layout.column_bounds(_view(spark, d, WORDS), ["page"])


# starts of three columns, the last one narrow; pages of every fourth kind have a first word far to the left of its column
SPREAD = f"SELECT page, word_no, CASE WHEN k = 0 THEN x + CASE WHEN page % 4 = 1 AND word_no % 20 > 0 THEN 25 ELSE 0 END WHEN page % 4 = 2 THEN 32 + x % 3 + k ELSE x END AS x, CASE WHEN k = 2 AND page % 5 = 3 THEN 9 ELSE width END AS width, CASE WHEN page % 3 = 0 AND word_no % 20 = 4 THEN y + 1000 * k ELSE y END AS y, height FROM ({WORDS})"


@query("column_edges", f"""WITH w AS (SELECT * FROM ({SPREAD})), n AS (SELECT page, x, CASE WHEN x - lag(x) OVER (PARTITION BY page ORDER BY x) > 30 THEN 1 ELSE 0 END AS f FROM w), c AS (SELECT page, x, sum(f) OVER (PARTITION BY page ORDER BY x) AS c FROM n), b AS (SELECT page, CAST(floor(avg(x)) AS INT) AS bound FROM c GROUP BY page, c),
  e AS (SELECT page, min(x) AS lo, max(x + width) AS hi FROM w GROUP BY page), a AS (SELECT page, bound FROM b UNION ALL SELECT page, lo FROM e JOIN (SELECT page, min(bound) AS m FROM b GROUP BY page) USING (page) WHERE m > lo + 10 UNION ALL SELECT page, hi FROM e JOIN (SELECT page, max(bound) AS m FROM b GROUP BY page) USING (page) WHERE m < hi - 10)
  SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY bound) - 1 AS INT) AS col_no, CAST(bound AS INT) AS bound FROM a""")
def _(spark, d):
    return layout.column_edges(_view(spark, d, SPREAD), ["page"])


@query("block_tables", f"""WITH n AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y, x) > 20 THEN 1 ELSE 0 END AS f, count(*) OVER (PARTITION BY page) AS m FROM ({SPREAD})), r AS (SELECT *, sum(f) OVER (PARTITION BY page ORDER BY y, x) AS r FROM n), g AS (SELECT page, r, count(*) AS k, min(x) AS x, min(y) AS y, max(x + width) AS x2, max(y + height) AS y2 FROM r WHERE m >= 4 GROUP BY page, r HAVING count(*) >= 2)
  SELECT page, min(x) AS x, min(y) AS y, max(x2) - min(x) AS width, max(y2) - min(y) AS height, count(*) AS "rows", CAST(sum(k) AS BIGINT) AS blocks FROM g GROUP BY page HAVING count(*) >= 2""")
def _(spark, d):
    return layout.block_tables(_view(spark, d, SPREAD), ["page"])


@query("words_to_cells", f"SELECT page, CAST(word_no % 20 AS INT) AS row_no, k AS col_no, text, round(confidence, 6) AS confidence FROM ({WORDS})")
def _(spark, d):
    w = layout.rows_by_running_mean(_view(spark, d, WORDS), ["page"])
    return _rounded(layout.grid(layout.to_cells(w, ["page"], "row_no"), ["page"]))


@query("table_regions", f"SELECT page, 0 AS region, min(x) AS x, min(y) AS y, max(x + width) AS \"right\", max(y + height) AS bottom, count(DISTINCT word_no) AS rows FROM ({WORDS}) GROUP BY 1 HAVING count(DISTINCT word_no) >= 2")
def _(spark, d):
    w = layout.rows_by_running_mean(_view(spark, d, WORDS), ["page"])
    return layout.table_regions(w, ["page"], "row_no")


@query("words_in_regions", f"SELECT page, word_no, k, 1 AS region_id FROM ({WORDS}) WHERE x + width // 2 BETWEEN 90 AND 190 AND y + height // 2 BETWEEN 100 AND 400")
def _(spark, d):
    w = _view(spark, d, WORDS)
    regions = w.select("page").distinct().selectExpr("page", "1 AS region_id", "90 AS x", "100 AS y", "100 AS width", "300 AS height")
    return layout.words_in_regions(w, regions, ["page"]).select("page", "word_no", "k", "region_id")


@query("page_confidence", f"""SELECT page, words, round(greatest(0, least(1, m * CASE WHEN chars > 10 THEN 1.05 WHEN chars < 3 THEN 0.8 ELSE 1 END * CASE WHEN words > 5 THEN 1.02 WHEN words = 1 THEN 0.9 ELSE 1 END * CASE WHEN s < 0.1 THEN 1.05 WHEN s > 0.3 THEN 0.95 ELSE 1 END)), 6)::DOUBLE AS confidence
  FROM (SELECT page, count(*) AS words, avg(confidence)::DOUBLE AS m, stddev_pop(confidence) AS s, length(string_agg(trim(text), ' ')) AS chars FROM ({SCANS}) GROUP BY 1)""")
def _(spark, d):
    return _rounded(layout.page_confidence(_view(spark, d, SCANS), ["page"]))


@query("structure_confidence", f"""WITH c AS (SELECT page, CAST(word_no % 20 AS INT) AS row_no, k AS col_no, text, confidence, word_no % 20 = 0 AND page % 2 = 0 AS is_header FROM ({SCANS})), r AS (SELECT page, row_no, count(CASE WHEN trim(text) <> '' THEN 1 END) AS n, sum(CASE WHEN confidence > 0 THEN confidence END) AS s, count(CASE WHEN confidence > 0 THEN 1 END) AS k, max(col_no) AS last, bool_or(is_header) AS h FROM c GROUP BY 1, 2),
  f AS (SELECT page, sum(s) / sum(k) AS cell, greatest(0, 1 - stddev_pop(n) / avg(n)) AS even, CASE WHEN bool_or(h) THEN 0.8 ELSE 0.5 END AS headed, CASE WHEN max(last) < 1 THEN 0.5 WHEN count(*) >= 3 THEN 0.9 WHEN count(*) >= 2 THEN 0.7 ELSE 0.5 END AS size FROM r GROUP BY 1)
  SELECT page, round(least(1, (cell + even + headed + size) / 4), 6)::DOUBLE AS confidence FROM f""")
def _(spark, d):
    scans = _view(spark, d, SCANS).selectExpr("page", "CAST(word_no % 20 AS INT) AS row_no", "k AS col_no", "text", "confidence", "word_no % 20 = 0 AND page % 2 = 0 AS is_header")
    return _rounded(layout.structure_confidence(scans, ["page"]))


@query("fragment_merge", "SELECT l_linenumber AS table_id, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS leader FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def _(spark, d):
    t = table(spark, d, "lineitem").select("l_linenumber").distinct()
    return layout.fragments(t.selectExpr("l_linenumber AS table_id", "IF(l_linenumber % 2 = 0, array('Key', ' price', 'Tax'), array('Key', 'Price', 'Tax', 'Flag')) AS headers"))


@query("ragged_to_table", "SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 3 > 1 THEN p_type END AS type FROM part")
def _(spark, d):
    t = table(spark, d, "part").selectExpr("p_partkey", "slice(array(p_name, p_brand, p_type), 1, CAST(1 + p_partkey % 3 AS INT)) AS cells")
    return layout.rectangular(t, ["name", "brand", "type"])


@query("word_boxes", """WITH t AS (SELECT p_partkey, list_filter(regexp_split_to_array(trim(p_name), '\\s+'), lambda w: w <> '') AS ws FROM part), u AS (SELECT p_partkey, ws, unnest(generate_series(1, len(ws))) AS i, list_sum(list_transform(ws, lambda w: length(w))) AS chars FROM t),
  v AS (SELECT *, coalesce(list_sum(list_transform(ws[1:i - 1], lambda w: length(w))), 0) AS before FROM u) SELECT p_partkey, CAST(i - 1 AS INT) AS place, ws[i] AS word, CAST(10 + floor(200.0::DOUBLE * before / chars + 4.0::DOUBLE * (i - 1)) AS INT) AS x, CAST(floor(200.0::DOUBLE * length(ws[i]) / chars) AS INT) AS width FROM v""")
def _(spark, d):
    return cells.split_span(table(spark, d, "part").selectExpr("p_partkey", "p_name AS text", "10 AS x", "200 AS width"), "p_partkey")


# --- charts to choose, headlines, reports ------------------------------------------------------------------------

_PARTS = {"p_name": ("text", 1), "p_brand": ("text", 1), "p_type": ("text", 1), "p_size": ("number", 0), "p_retailprice": ("number", 0)}


@query("chart_roles", " UNION ALL ".join(f"SELECT '{c}' AS name, {i} AS place, '{k}' AS kind, count(DISTINCT {c}) AS unique_values, count(*) - count({c}) AS nulls, round(count(DISTINCT {c}) / count(*), 6)::DOUBLE AS cardinality, {'true' if t else f'count(DISTINCT {c}) <= 10 AND count(DISTINCT {c}) <= 0.5 * count(*)'} AS categorical, {'false' if t else 'true'} AS numerical, false AS temporal FROM part" for i, (c, (k, t)) in enumerate(_PARTS.items())))
def _(spark, d):
    return _rounded(recommend.column_roles(table(spark, d, "part").select(*_PARTS)))


@query("chart_choice", """WITH n AS (SELECT (SELECT count(DISTINCT x) <= 8 FROM (SELECT o_orderstatus AS x FROM orders))::INT + (SELECT count(DISTINCT o_orderpriority) <= 8 FROM orders)::INT AS few, (SELECT count(DISTINCT o_orderstatus) > 10 FROM orders)::INT + (SELECT count(DISTINCT o_orderpriority) > 10 FROM orders)::INT AS many),
  s AS (SELECT 'bar' AS chart, 0 AS i, (0.9 + 0.8) / 2 AS score FROM n UNION ALL SELECT 'line', 1, 0.9 * 1.5 FROM n UNION ALL SELECT 'pie', 2, 0.7 * 1.2 ** few * 0.5 ** many FROM n UNION ALL SELECT 'histogram', 4, 0.8 FROM n UNION ALL SELECT 'heatmap', 5, 0.6 FROM n)
  SELECT chart, round(score, 6)::DOUBLE AS score, CAST(row_number() OVER (ORDER BY score DESC, i) AS INT) AS place FROM s ORDER BY place LIMIT 5""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return _rounded(recommend.recommendations(recommend.column_roles(o)))


@query("dashboard_headline", f"SELECT count(*) AS rows, round(avg(o_orderkey), 4) AS mean, max(o_orderkey)::DOUBLE AS most, round(100 - (count(*) * 5 - count(o_orderkey) - count(customer) - count(status) - count(total) - count(priority)) * 100.0 / (count(*) * 5), 6)::DOUBLE AS quality FROM ({ORDERS})")
def _(spark, d):
    return _rounded(_rounded(recommend.headline(_view(spark, d, ORDERS))).withColumn("mean", F.round("mean", 4)))


@query("imputation_report", f"""SELECT 'customer' AS name, 'remove' AS strategy, count(*) - count(customer) AS missing_before, 0::BIGINT AS missing_after, count(*) - count(customer) AS rows_removed, 0::BIGINT AS imputed, 1.0::DOUBLE AS improvement, NULL AS warning FROM ({ORDERS})
  UNION ALL SELECT 'total', 'median', count(*) - count(total), 0, 0, count(*) - count(total), 1.0, CASE WHEN (count(*) - count(total)) / count(*) > 0.3 THEN 'total: over 30 % missing, median instead of mean' END FROM ({ORDERS}) WHERE customer IS NOT NULL""")
def _(spark, d):
    policies = {"customer": missing.Policy("remove"), "total": missing.Policy("mean", threshold=0.3, fallback="median")}
    return _rounded(missing.imputation_report(_view(spark, d, ORDERS), policies)[1])


@query("imputation_steps", f"""WITH v AS ({EVENT_HOLES}), w AS (SELECT *, CASE WHEN event_id % 5 = 2 THEN NULL ELSE event_id % 40 END AS weight, CASE WHEN event_id % 3 = 1 THEN 'x' END AS mark FROM v), f AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS filled FROM w)
  SELECT 'value' AS name, 'forward' AS strategy, count(*) - count(value) AS missing_before, count(*) - count(filled) AS missing_after, 0::BIGINT AS rows_removed, count(filled) - count(value) AS imputed, round((count(filled) - count(value)) / (count(*) - count(value)), 6) AS improvement, NULL AS warning FROM f
  UNION ALL SELECT 'weight', 'remove', count(*) - count(weight), 0, count(*) - count(weight), 0, 1.0, NULL FROM f
  UNION ALL SELECT 'mark', 'custom', count(*) - count(mark), 0, 0, count(*) - count(mark), 1.0, 'mark: over 50 % missing, custom instead of mode' FROM f WHERE weight IS NOT NULL""")
def _(spark, d):
    e = _view(spark, d, EVENT_HOLES).withColumn("weight", F.when(F.col("event_id") % 5 != 2, F.col("event_id") % 40)).withColumn("mark", F.when(F.col("event_id") % 3 == 1, "x"))
    steps = {"value": missing.Policy("forward", order=("ts", "event_id"), keys=("user_id",)), "weight": missing.Policy("remove"), "mark": missing.Policy("mode", value="y", fallback="custom")}
    return _rounded(missing.imputation_report(e, steps)[1])


# three known points around each gap by joins on their numbers
@query("interpolate_quadratic", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS i FROM ({EVENT_HOLES})), k AS (SELECT user_id, i, value, row_number() OVER (PARTITION BY user_id ORDER BY i) AS n, count(*) OVER (PARTITION BY user_id) AS m FROM r WHERE value IS NOT NULL),
  g AS (SELECT r.event_id, r.user_id, r.i, r.value, (SELECT max(k.n) FROM k WHERE k.user_id = r.user_id AND k.i <= r.i) AS p, (SELECT min(k.n) FROM k WHERE k.user_id = r.user_id AND k.i >= r.i) AS q FROM r),
  h AS (SELECT g.event_id, g.i, g.value, g.p, g.q, a.i AS ai, a.value AS av, b.i AS bi, b.value AS bv, CASE WHEN g.i - a.i <= b.i - g.i THEN CASE WHEN g.p > 1 THEN g.p - 1 WHEN g.q < a.m THEN g.q + 1 END ELSE CASE WHEN g.q < a.m THEN g.q + 1 WHEN g.p > 1 THEN g.p - 1 END END AS cn, g.user_id FROM g LEFT JOIN k a ON a.user_id = g.user_id AND a.n = g.p LEFT JOIN k b ON b.user_id = g.user_id AND b.n = g.q)
  SELECT event_id, round(CASE WHEN h.value IS NOT NULL THEN h.value WHEN p IS NULL THEN NULL WHEN q IS NULL THEN av WHEN c.i IS NULL THEN av + (bv - av) * (h.i - ai) / (bi - ai) ELSE av * (h.i - bi) * (h.i - c.i) / ((ai - bi) * (ai - c.i)) + bv * (h.i - ai) * (h.i - c.i) / ((bi - ai) * (bi - c.i)) + c.value * (h.i - ai) * (h.i - bi) / ((c.i - ai) * (c.i - bi)) END, 6) AS value FROM h LEFT JOIN k c ON c.user_id = h.user_id AND c.n = h.cn""")
def _(spark, d):
    return _rounded(missing.interpolate_quadratic(_view(spark, d, EVENT_HOLES), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value"))


# the same splines, each series swept forth and back one point at a time
@query("interpolate_spline", f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS i FROM ({EVENT_HOLES})),
  k AS (SELECT user_id, i AS x, value AS y, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS m, lag(i, 1) OVER w AS p1, lag(i, 2) OVER w AS p2, lag(i, 3) OVER w AS p3, lead(i, 1) OVER w AS n1, lead(i, 2) OVER w AS n2, lead(i, 3) OVER w AS n3 FROM r WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY i)),
  t AS (SELECT user_id, x, y, n, m, CASE WHEN p3 IS NOT NULL THEN (p2 + p1) / 2 ELSE coalesce(p2, p1) END AS a, CASE WHEN p2 IS NOT NULL THEN (p1 + x) / 2 ELSE p1 END AS b, CASE WHEN n2 IS NOT NULL THEN (x + n1) / 2 ELSE n1 END AS c, CASE WHEN n3 IS NOT NULL THEN (n1 + n2) / 2 ELSE coalesce(n2, n1) END AS d FROM k WHERE m >= 3),
  e AS (SELECT *, CASE WHEN n IN (1, m) THEN 0.0::DOUBLE ELSE (c - x) * (c - x) / ((c - a) * (c - b)) END AS lo, CASE WHEN n IN (1, m) THEN 0.0::DOUBLE ELSE (x - b) * (x - b) / ((d - b) * (c - b)) END AS up FROM t),
  f AS (SELECT user_id, n, 0.0::DOUBLE AS q, y AS g FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.up / (1 - e.lo - e.up - e.lo * f.q), (e.y - e.lo * f.g) / (1 - e.lo - e.up - e.lo * f.q) FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1),
  u AS (SELECT f.user_id, f.n, f.g AS u FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n WHERE e.n = e.m UNION ALL SELECT f.user_id, f.n, f.g - f.q * u.u FROM u JOIN f ON f.user_id = u.user_id AND f.n = u.n - 1),
  v AS (SELECT e.*, w.u, p.u AS u0, s.u AS u2 FROM e JOIN u w ON w.user_id = e.user_id AND w.n = e.n JOIN u p ON p.user_id = e.user_id AND p.n = e.n - 1 JOIN u s ON s.user_id = e.user_id AND s.n = e.n + 1)
  SELECT r.event_id, round(coalesce(r.value, v.u + (v.u0 - v.u) * (v.c - r.i) * (v.c - r.i) / ((v.c - v.a) * (v.c - v.b)) + (v.u2 - v.u) * (r.i - v.b) * (r.i - v.b) / ((v.d - v.b) * (v.c - v.b))), 6) AS value FROM r LEFT JOIN v ON v.user_id = r.user_id AND r.value IS NULL AND r.i >= v.b AND r.i < v.c""")
def _(spark, d):
    return _rounded(spline.interpolate_spline(_view(spark, d, EVENT_HOLES), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value"))


HEADS = """SELECT CAST(floor(p_partkey / 10) AS INT) AS page, CAST(p_partkey % 10 AS INT) AS row_no, k AS col_no, CASE WHEN p_partkey % 10 > 0 THEN p_name WHEN k = 0 THEN CASE p_partkey % 50 WHEN 0 THEN 'Unit Price' WHEN 10 THEN 'JOHN 12' WHEN 20 THEN 'John Smith' WHEN 30 THEN '12:' ELSE '34' END
  WHEN k = 1 THEN CASE p_partkey % 50 WHEN 0 THEN '99' WHEN 10 THEN '77x9' WHEN 20 THEN '$5' WHEN 30 THEN '' ELSE '3a5' END ELSE CASE p_partkey % 50 WHEN 40 THEN '' WHEN 20 THEN '7-7' ELSE '12345' END END AS text FROM part CROSS JOIN (VALUES (0), (1), (2)) AS v(k)"""


@query("header_marks", f"""WITH c AS ({HEADS}), j AS (SELECT *, row_no = 0 AND text <> '' AND ({' OR '.join(f"contains(lower(text), '{w}')" for w in layout.HEADER_WORDS)} OR right(text, 1) = ':' OR (length(text) <= 20 AND regexp_full_match(text, '[A-Za-z\\s]+') AND NOT regexp_full_match(text, '[A-Z][a-z]+ [A-Z][a-z]+'))) AS a,
  row_no = 0 AND regexp_matches(text, '[A-Za-z]') AND ((text = upper(text) AND length(text) > 1) OR text IN ('John Smith')) AS b FROM c)
  SELECT page, row_no, col_no, CASE WHEN bool_or(a) OVER (PARTITION BY page) THEN a WHEN bool_or(b) OVER (PARTITION BY page) THEN b ELSE row_no = 0 AND text <> '' END AS is_header FROM j""")
def _(spark, d):
    return layout.marked_headers(_view(spark, d, HEADS), ["page"]).select("page", "row_no", "col_no", "is_header")


@query("fragment_rows", """WITH f AS (SELECT o_custkey, o_orderkey AS table_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), l AS (SELECT table_id, min(table_id) OVER (PARTITION BY o_custkey, i % 2) AS leader FROM f), r AS (SELECT l_orderkey AS table_id, l_linenumber AS row_no, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
  s AS (SELECT leader, avg(0.5 + (table_id % 5) / 10.0) AS confidence, count(*) AS fragments FROM l GROUP BY 1)
  SELECT leader AS table_id, row_number() OVER (PARTITION BY leader ORDER BY l.table_id, row_no) - 1 AS row_no, q AS first_cell, round(confidence, 6)::DOUBLE AS confidence, fragments FROM l JOIN r USING (table_id) JOIN s USING (leader)""")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    tables = table(spark, d, "orders").withColumn("i", F.row_number().over(w) % 2).selectExpr("o_orderkey AS table_id", "array(concat('customer ', o_custkey), IF(i = 0, 'Price', 'Weight'), 'tax ') AS headers", "0.5 + (o_orderkey % 5) / 10.0D AS confidence")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q")).selectExpr("l_orderkey AS table_id", "l_linenumber AS row_no", "array(q, 0) AS cells")
    return _rounded(layout.merged_fragments(tables, rows, 1.0).select("table_id", "row_no", F.col("cells")[0].alias("first_cell"), "confidence", "fragments"))


@query("union_parts", "SELECT c_custkey AS id, c_name AS name, NULL AS size FROM customer UNION ALL SELECT p_partkey, p_name, p_size FROM part")
def _(spark, d):
    return layout.union_of([table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name"), table(spark, d, "part").selectExpr("p_partkey AS id", "p_name AS name", "p_size AS size")])


@query("coerce_numbers", f"SELECT l_orderkey, l_linenumber, TRY_CAST(quantity AS DOUBLE) AS quantity, price FROM ({TEXTS})")
def _(spark, d):
    return types.coerce_numbers(_view(spark, d, TEXTS).select("l_orderkey", "l_linenumber", "quantity", "price"))


@query("quick_numeric", f"SELECT table_id, col_no, avg(CASE WHEN regexp_matches(regexp_replace(trim(value), '[$%,]', '', 'g'), '^[+-]?[0-9]+(\\.[0-9]*)?$') THEN 1.0 ELSE 0.0 END) > 0.7 AS numeric FROM ({DIRTY}) WHERE trim(value) <> '' AND row_no < 4 GROUP BY 1, 2")
def _(spark, d):
    return types.quick_numeric(_view(spark, d, DIRTY), ["table_id"], 4)


@query("rows_removed", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS place FROM lineitem WHERE l_orderkey * 8 + l_linenumber NOT IN (9, 16, 25) AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_orderkey * 8 + l_linenumber AS place")
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'").selectExpr("explode(sequence(o_orderkey * 8, o_orderkey * 8 + 7)) AS place")
    return filters.without_rows(rows, "place", pending.unionByName(spark.createDataFrame([(9,), (16,), (25,)], "place long")))


@query("combined_answers", """WITH s AS (SELECT o_custkey, 'try ' || o_orderpriority AS s, min(o_orderkey) AS seen FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY seen) AS i FROM s)
  SELECT o_custkey, round(t, 2) AS o_totalprice, round(c, 6) AS confidence, n AS answers, (SELECT string_agg(r.s, '|' ORDER BY r.i) FROM r WHERE r.o_custkey = f.o_custkey AND r.i <= 3) AS suggestions FROM (SELECT o_custkey, sum(o_totalprice) AS t, avg((o_orderkey % 10) / 10.0)::DOUBLE AS c, count(*) AS n FROM orders GROUP BY 1) f""")
def _(spark, d):
    a = table(spark, d, "orders").selectExpr("o_custkey", "o_orderkey AS place", "(o_orderkey % 10) / 10.0D AS confidence", "array(concat('try ', o_orderpriority)) AS suggestions", "o_totalprice")
    out = text.combined_answers(a, "o_custkey", ["o_totalprice"], 3).withColumn("suggestions", F.array_join("suggestions", "|"))
    return _rounded(out).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("kpi_texts", f"""WITH c AS (SELECT kpi_id, a.value - b.value AS d, (a.value - b.value) * 100 / b.value AS p FROM ({_YEAR.format(1998)}) a JOIN ({_YEAR.format(1997)}) b USING (kpi_id)) SELECT kpi_id, CASE WHEN d > 0 THEN 'increased by ' ELSE 'decreased by ' END || printf('%.1f%%', abs(p)) AS text, CASE WHEN d > 0 THEN 'Target exceeded by ' || printf('%.1f%%', p) ELSE 'Below target by ' || printf('%.1f%%', abs(p)) END AS target FROM c""")
def _(spark, d):
    c = kpi.comparisons(_view(spark, d, _YEAR.format(1998)), _view(spark, d, _YEAR.format(1997)))
    text_of = lambda kind: S.comparison_text(F.lit(kind), F.col("difference"), F.col("percent"), F.col("improved"))
    return c.select("kpi_id", text_of("previous_period").alias("text"), text_of("target").alias("target"))


@query("session_log")
def _(spark, d):
    e = table(spark, d, "events").selectExpr("user_id", "event_id", "ts", "user_id * 100 + CAST(datediff(ts, DATE '2024-01-01') AS INT) DIV 2 AS session_id", "concat('10.0.0.', event_id % 3) AS address")
    return streams.session_log(e)


# --- streams, in batch form -----------------------------------------------------------------------------------


@query("windowed_kpis", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS count, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, arg_max(value, ts) AS latest FROM events GROUP BY 1, 2, 3""")
def _(spark, d):
    return _rounded(streams.windowed_kpis(table(spark, d, "events")))


@query("rolling_metrics", """SELECT h AS start, h + INTERVAL 24 HOURS AS "end", event_type, count(*) AS count, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, arg_max(value, ts) AS latest FROM (SELECT *, unnest(generate_series(0, 3)) AS i FROM events) CROSS JOIN LATERAL (SELECT time_bucket(INTERVAL 6 HOURS, ts) - i * INTERVAL 6 HOURS AS h) GROUP BY 1, 2, 3""")
def _(spark, d):
    return _rounded(streams.windowed_kpis(table(spark, d, "events"), "24 hours", "6 hours"))


@query("stale_clients", """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 5 MINUTES THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS first, max(ts) + INTERVAL 5 MINUTES AS gone_at, count(*) AS events FROM s GROUP BY user_id, k""")
def _(spark, d):
    return streams.stale_clients(table(spark, d, "events"))


@query("event_routing", "SELECT s AS subscriber, count(*) AS events FROM events CROSS JOIN (VALUES ('all', ''), ('errors', 'error'), ('sales', 'purchase')) AS t(s, k) WHERE k = '' OR k = event_type GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events")
    subs = e.limit(1).select(F.inline(F.array(F.struct(F.lit("all").alias("subscriber"), F.array().cast("array<string>").alias("types")), F.struct(F.lit("errors").alias("subscriber"), F.array(F.lit("error")).alias("types")), F.struct(F.lit("sales").alias("subscriber"), F.array(F.lit("purchase")).alias("types")))))
    return streams.routed(e, subs).groupBy("subscriber").agg(F.count("*").alias("events"))


@query("event_routing_boards", """WITH e AS (SELECT event_id, event_type, CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('d', CAST(user_id % 6 AS VARCHAR)) END AS board FROM events),
  s AS (SELECT * FROM (VALUES ('all', NULL, NULL), ('errors', 'error', ''), ('sales2', 'purchase', 'd2'), ('board3', NULL, 'd3'), ('views3', 'view', 'd3')) AS t(subscriber, kind, board))
  SELECT subscriber, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids FROM e JOIN s ON (s.kind IS NULL OR s.kind = event_type) AND (coalesce(e.board, '') = '' OR coalesce(s.board, '') = '' OR e.board = s.board) GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "event_type", "CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('d', user_id % 6) END AS dashboard_id")
    subs = spark.createDataFrame([("all", [], None), ("errors", ["error"], ""), ("sales2", ["purchase"], "d2"), ("board3", None, "d3"), ("views3", ["view"], "d3")], "subscriber string, types array<string>, dashboard_id string")
    return streams.routed_boards(e, subs).groupBy("subscriber").agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"))


@query("alert_events", "SELECT event_id FROM events WHERE event_type = 'error' OR value >= 90")
def _(spark, d):
    return streams.alert_events(table(spark, d, "events"), 90.0).select("event_id")


@query("quota", "SELECT event_id, user_id, event_type, used, greatest(0, 3 - used) AS remaining, round(epoch(first) + 3600 - epoch(ts), 3) AS reset_after FROM (SELECT *, count(*) OVER w AS used, min(ts) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW))")
def _(spark, d):
    return _rounded(streams.quota(table(spark, d, "events"), 3), 3)


# one request an hour for each user and type, and a burst of none: allowed are those an hour after the last allowed one
@query("rate_limit", """WITH RECURSIVE r AS (SELECT user_id, event_type AS endpoint, event_id, epoch_us(ts) / 1000000 AS "at", row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
  s AS (SELECT user_id, endpoint, event_id, "at", i, true AS allowed, 'ok' AS reason, "at" AS last, CAST(-1 AS DOUBLE) AS blocked FROM r WHERE i = 1
    UNION ALL SELECT user_id, endpoint, event_id, "at", i, reason = 'ok', reason, CASE WHEN reason = 'ok' THEN "at" ELSE last END, CASE WHEN hasty THEN "at" + 60 ELSE blocked END
      FROM (SELECT r.*, s.last, s.blocked, r."at" >= s.blocked AND s.last > r."at" - 3600 AND r."at" - s.last < 1 AS hasty, CASE WHEN r."at" < s.blocked OR (s.last > r."at" - 3600 AND r."at" - s.last < 1) THEN 'blocked' WHEN s.last > r."at" - 3600 THEN 'limit' ELSE 'ok' END AS reason FROM s JOIN r ON r.user_id = s.user_id AND r.endpoint = s.endpoint AND r.i = s.i + 1))
  SELECT user_id, endpoint, event_id, round("at", 3) AS "at", allowed, reason FROM s""")
def _(spark, d):
    return _rounded(streams.rate_limited(table(spark, d, "events"), streams.Limit(1)), 3)


@query("change_detect", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n")) if streams.fingerprint(e) == streams.fingerprint(e.repartition(7)) else e.limit(0)


# three batches, of which one comes twice; what was committed is there once, and whole
@query("committed_tables", """SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS n_tables, 1::BIGINT AS n_logs, CAST(1 + o_orderkey % 3 AS BIGINT) AS version
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def _(spark, d):
    store = commits.Store(spark, shared.folder(spark, "store"))
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    for k in (0, 1, 1, 2):
        own = orders.where(f"o_orderkey % 3 = {k}")
        store.commit(f"upload-{k}", {
            "documents": own.select("o_orderkey", F.lit(k + 1).cast("long").alias("version")), "tables": lines.where(f"l_orderkey % 3 = {k}").select("l_orderkey", "l_linenumber"),
            "logs": own.select(F.col("o_orderkey").alias("log_key"), F.lit("uploaded").alias("stage")),
        })
    tables = store.read("tables").groupBy("l_orderkey").agg(F.count("*").alias("n_tables"))
    logged = store.read("logs").groupBy("log_key").agg(F.count("*").alias("n_logs"))
    documents = store.read("documents")
    return documents.join(tables, documents["o_orderkey"] == tables["l_orderkey"], "left").join(logged, documents["o_orderkey"] == logged["log_key"], "left").select(
        "o_orderkey", F.coalesce("n_tables", F.lit(0).cast("long")).alias("n_tables"), F.coalesce("n_logs", F.lit(0).cast("long")).alias("n_logs"), "version"
    )


_AUDITED = "CASE event_type WHEN 'error' THEN 'account_locked' WHEN 'signup' THEN 'user_created' WHEN 'purchase' THEN 'data_modified' WHEN 'click' THEN 'api_key_created' ELSE 'page_viewed' END"


@query("audit_log", f"SELECT {_AUDITED} AS kind, CASE event_type WHEN 'error' THEN 'high' WHEN 'view' THEN 'low' ELSE 'medium' END AS risk_level, count(*) AS events, 100.0::DOUBLE AS integrity FROM events GROUP BY 1, 2")
def _(spark, d):
    store = commits.Store(spark, shared.folder(spark, "audit"))
    events = table(spark, d, "events").selectExpr("event_id", "user_id", f"{_AUDITED} AS event_type", "value")
    for k in (0, 1, 1):
        commits.log_events(store, events.where(f"event_id % 2 = {k}"), f"batch-{k}")
    kept = commits.audit(store)
    return kept.groupBy(F.col("event_type").alias("kind"), "risk_level").agg(F.count("*").alias("events")).crossJoin(logs.integrity(kept).select("integrity"))  # one row


_RUNNING = "SELECT o_orderstatus, o_orderpriority, o_totalprice, o_custkey % 30 AS segment, o_orderdate FROM orders"


@query("kpi_incremental", f"""WITH o AS ({_RUNNING}) SELECT 'total_o_totalprice' AS kpi_id, NULL::VARCHAR AS label, round(sum(o_totalprice), 2)::DOUBLE AS value FROM o UNION ALL SELECT 'avg_o_totalprice', NULL, round(avg(o_totalprice), 2) FROM o UNION ALL SELECT 'max_o_totalprice', NULL, max(o_totalprice) FROM o
  UNION ALL SELECT 'total_segment', NULL, sum(segment) FROM o UNION ALL SELECT 'avg_segment', NULL, round(avg(segment), 2) FROM o UNION ALL SELECT 'max_segment', NULL, max(segment) FROM o
  UNION ALL (SELECT 'top_o_orderstatus', o_orderstatus, count(*) FROM o GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1) UNION ALL SELECT 'unique_o_orderstatus', NULL, count(DISTINCT o_orderstatus) FROM o
  UNION ALL (SELECT 'top_o_orderpriority', o_orderpriority, count(*) FROM o GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1) UNION ALL SELECT 'unique_o_orderpriority', NULL, count(DISTINCT o_orderpriority) FROM o
  UNION ALL SELECT 'completeness', NULL, 100 UNION ALL SELECT 'total_records', NULL, count(*) FROM o UNION ALL SELECT 'duplicate_rate', NULL, round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM o))) * 100.0 / count(*), 2) FROM o
  UNION ALL SELECT 'records_per_day', NULL, round(count(*) / greatest(1, floor((epoch_us(max(o_orderdate)::TIMESTAMP) - epoch_us(min(o_orderdate)::TIMESTAMP)) / 86400000000)), 2) FROM o
  UNION ALL SELECT 'recent_records', NULL, count(*) FROM o WHERE o_orderdate >= (SELECT max(o_orderdate) FROM o) - INTERVAL 7 DAY""")
def _(spark, d):
    own = running.RunningKpis(spark, shared.folder(spark, "kpis"), ["o_totalprice", "segment"], ["o_orderstatus", "o_orderpriority", "segment"], "o_orderdate")
    orders = _view(spark, d, _RUNNING)
    for k in range(3):
        own.update(orders.where(F.pmod(F.datediff("o_orderdate", F.lit("1990-01-01")), F.lit(3)) == k), k)
    return _rounded(own.kpis(), 2)


_DAYS = "SELECT o_orderstatus AS kpi_id, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2"


@query("kpi_rolling_trend", f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY kpi_id ORDER BY day) AS i FROM ({_DAYS})), f AS (SELECT *, value - first_value(value) OVER w AS c, first_value(value) OVER w AS f, coalesce(stddev_pop(value) OVER w / abs(avg(value) OVER w), 0) AS vol, coalesce(abs(corr(i, value) OVER w), 0) AS str FROM p WINDOW w AS (PARTITION BY kpi_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
  SELECT kpi_id, day, value, least(i, 50)::INT AS points, round(CASE WHEN i < 3 THEN 0 ELSE c END, 4) AS change, round(CASE WHEN i < 3 THEN 0 ELSE c * 100 / f END, 4) AS percent, round(CASE WHEN i < 3 THEN 0 ELSE vol END, 4) AS volatility, round(CASE WHEN i < 3 THEN 0 ELSE str END, 4) AS strength,
  CASE WHEN i < 3 THEN 'STABLE' WHEN vol > 0.3 THEN 'VOLATILE' WHEN abs(c * 100 / f) < 5 THEN 'STABLE' WHEN c > 0 THEN 'UP' ELSE 'DOWN' END AS direction FROM f""")
def _(spark, d):
    return _rounded(kpi.rolling_trend(_view(spark, d, _DAYS), ["kpi_id"], ["day"], "value"), 4)


# limits that are never reached within a block, so that windows can count what was allowed
@query("limit_details", """WITH e AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events)
  SELECT a.event_id, 1000000 AS request_limit, 1000000 - count(*)::INT AS remaining, round(min(b.us) / 1000000 + 3600, 3) AS reset_at, NULL::DOUBLE AS retry_after FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.i <= a.i AND b.us > a.us - 3600000000 GROUP BY a.event_id""")
def _(spark, d):
    return _rounded(streams.limit_details(table(spark, d, "events"), streams.Limit(1_000_000)).select("event_id", "request_limit", "remaining", "reset_at", "retry_after"), 3)


_HITS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, len(regexp_extract_all(text, '{p}')) AS n FROM ({REGISTRY})" for k, p, _ in privacy.PATTERNS)


@query("udtf_pii_hits", f"SELECT doc_id, kind, n AS hits FROM ({_HITS}) WHERE n > 0")
def _(spark, d):
    table_functions.register(spark)
    return spark.sql("SELECT r.doc_id, h.kind, count(*) AS hits FROM {r} r, LATERAL pii_hits(r.text) h GROUP BY ALL", r=_view(spark, d, REGISTRY))


@query("udtf_page_cells", f"""WITH w AS (SELECT * FROM ({WORDS})), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY row_y) - 1 AS row_no FROM (SELECT DISTINCT page, word_no % 20 AS row_y FROM w))
  SELECT w.page, r.row_no::INT AS row_no, w.k AS col_no, w.text, round(w.confidence, 6)::DOUBLE AS confidence FROM w JOIN r ON r.page = w.page AND r.row_y = w.word_no % 20""")
def _(spark, d):
    table_functions.register(spark)
    out = spark.sql("SELECT * FROM page_cells(TABLE(SELECT CAST(page AS BIGINT) AS page, x, y, width, text, CAST(confidence AS DOUBLE) AS confidence FROM {w}) PARTITION BY page)", w=_view(spark, d, WORDS))
    return _rounded(out.withColumn("page", F.col("page").cast("int")))


# days and months of which some tell the order, and two formats in one column
_DATED = """SELECT o_orderkey, concat(lpad(CAST(1 + o_orderkey % 28 AS VARCHAR(2)), 2, '0'), '/', lpad(CAST(1 + o_custkey % 12 AS VARCHAR(2)), 2, '0'), '/2023') AS day_first, CASE WHEN o_orderkey % 10 = 7 THEN 'soon' ELSE concat('2022-', lpad(CAST(1 + o_custkey % 12 AS VARCHAR(2)), 2, '0'), '-', lpad(CAST(1 + o_orderkey % 28 AS VARCHAR(2)), 2, '0')) END AS iso,
  CASE WHEN o_orderkey % 5 = 2 THEN '2021/03/04' ELSE concat(lpad(CAST(1 + o_custkey % 12 AS VARCHAR(2)), 2, '0'), '/', lpad(CAST(1 + o_orderkey % 28 AS VARCHAR(2)), 2, '0'), '/2021') END AS mixed FROM orders"""


@query("profile_text_dates", f"""WITH d AS ({_DATED})
  SELECT 'day_first' AS name, 'dd/MM/yyyy' AS format, min(strptime(day_first, '%d/%m/%Y'))::DATE AS first, max(strptime(day_first, '%d/%m/%Y'))::DATE AS last, (max(strptime(day_first, '%d/%m/%Y'))::DATE - min(strptime(day_first, '%d/%m/%Y'))::DATE)::BIGINT AS range_days, 0.0::DOUBLE AS unread, false AS mixed FROM d
  UNION ALL SELECT 'iso', 'yyyy-MM-dd', min(try_strptime(iso, '%Y-%m-%d'))::DATE, max(try_strptime(iso, '%Y-%m-%d'))::DATE, max(try_strptime(iso, '%Y-%m-%d'))::DATE - min(try_strptime(iso, '%Y-%m-%d'))::DATE, round(count(*) FILTER (iso = 'soon') / count(*), 6), false FROM d
  UNION ALL SELECT 'mixed', 'MM/dd/yyyy', min(try_strptime(mixed, '%m/%d/%Y'))::DATE, max(try_strptime(mixed, '%m/%d/%Y'))::DATE, max(try_strptime(mixed, '%m/%d/%Y'))::DATE - min(try_strptime(mixed, '%m/%d/%Y'))::DATE, round(count(*) FILTER (mixed = '2021/03/04') / count(*), 6), true FROM d""")
def _(spark, d):
    return _rounded(profile.text_dates(_view(spark, d, _DATED), ["day_first", "iso", "mixed"]))
