"""Named queries over the test tables, one or more to an operator, each with its SQL twin.

Names begin with the operator's number in the blueprint. Queries about order carry a ``position``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, Field, Relation, sales_catalog
from .config import Options
from .operators.aggregates import flat
from .plans import batch, prepared, stats
from .plans.client import Engine
from .sources.tables import FrameTables, ParquetTables
from .streaming import rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def nullable(spark: SparkSession, sf_dir: str) -> FrameTables:
    """The tables with nulls in orders' priority and lineitem's return flag, which have none by themselves."""
    rest = ParquetTables(spark, sf_dir)
    orders = rest.frame("orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    lines = rest.frame("lineitem").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("N")))
    return FrameTables(spark, {"orders": orders, "lineitem": lines}, rest)


#: The same in SQL.
NULLABLE = """WITH ord AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders),
line AS (SELECT * REPLACE (nullif(l_returnflag, 'N') AS l_returnflag) FROM lineitem) """


def add(name: str, sql: str | None, run: Callable[[Engine], DataFrame], nulls: bool = False, options: Options | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(Engine(spark, nullable(spark, sf_dir) if nulls else sf_dir, options=options))

    QUERIES[name] = query
    if sql:
        ORACLES[name] = (NULLABLE if nulls else "") + sql


def many(name: str, model: str, args: dict, sql: str, nulls: bool = False, placed: bool = False, options: Options | None = None, method: str = "findMany") -> None:
    def run(engine: Engine) -> DataFrame:
        return engine.numbered(model, args) if placed else engine.query(model, method, args)

    add(name, sql, run, nulls, options)


def totals(df: DataFrame, *names: str) -> DataFrame:
    """Sums and averages to cents: addition order differs between engines."""
    return df.withColumns({n: F.round(n, 2) for n in names})


def positioned(select: str, rest: str, order: str, nulls: bool = False) -> str:
    """SQL of a page with its rows' places."""
    page = f"SELECT {select} {rest} ORDER BY {order}"
    return f"SELECT *, row_number() OVER () AS position FROM ({page})" if not nulls else f"SELECT *, row_number() OVER () AS position FROM ({page})"


# scalar filters

ORDER = {"key": True}
where = lambda name, model, cond, sql, **more: many(name, model, {"where": cond, "select": ORDER if model != "embeddings" else {"id": True}}, sql, **more)
where("f01_equals", "orders", {"status": "F"}, "SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F'")
where("f01_null", "orders", {"priority": None}, "SELECT o_orderkey AS key FROM ord WHERE o_orderpriority IS NULL", nulls=True)
where("f02_equals_insensitive", "customer", {"segment": {"equals": "building", "mode": "insensitive"}}, "SELECT c_custkey AS key FROM customer WHERE lower(c_mktsegment) = lower('building')")
where("f03_not", "orders", {"priority": {"not": "1-URGENT"}}, "SELECT o_orderkey AS key FROM ord WHERE o_orderpriority <> '1-URGENT'", nulls=True)
where("f03_not_null", "orders", {"priority": {"not": None}}, "SELECT o_orderkey AS key FROM ord WHERE o_orderpriority IS NOT NULL", nulls=True)
where("f04_not_nested", "orders", {"total": {"not": {"gt": 1000, "lt": 200000}}}, "SELECT o_orderkey AS key FROM orders WHERE NOT (o_totalprice > 1000 AND o_totalprice < 200000)")
where("f05_ranges", "orders", {"total": {"gte": 1000.5, "lt": 90000}, "date": {"gt": "1999-01-01", "lte": "2001-06-30T00:00:00"}}, "SELECT o_orderkey AS key FROM orders WHERE o_totalprice >= 1000.5 AND o_totalprice < 90000 AND o_orderdate > TIMESTAMP '1999-01-01' AND o_orderdate <= TIMESTAMP '2001-06-30'")
where("f06_in", "orders", {"priority": {"in": ["1-URGENT", "2-HIGH"]}}, "SELECT o_orderkey AS key FROM ord WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", nulls=True)
where("f06_in_empty", "orders", {"key": {"in": []}}, "SELECT o_orderkey AS key FROM orders WHERE false")
where("f07_not_in", "orders", {"priority": {"notIn": ["1-URGENT", "2-HIGH"]}}, "SELECT o_orderkey AS key FROM ord WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", nulls=True)
where("f07_not_in_null", "orders", {"priority": {"notIn": ["1-URGENT", None]}}, "SELECT o_orderkey AS key FROM ord WHERE o_orderpriority NOT IN ('1-URGENT', NULL)", nulls=True)
where("f08_contains", "part", {"name": {"contains": "_1"}}, "SELECT p_partkey AS key FROM part WHERE p_name LIKE '%_1%'")
where("f08_contains_escaped", "part", {"name": {"contains": "_1"}}, "SELECT p_partkey AS key FROM part WHERE contains(p_name, '_1')", options=Options(escape_like=True))
where("f09_starts_ends", "customer", {"name": {"startsWith": "Cust", "endsWith": "7"}}, "SELECT c_custkey AS key FROM customer WHERE c_name LIKE 'Cust%' AND c_name LIKE '%7'")
where("f10_like_insensitive", "customer", {"name": {"contains": "MER#00000001", "mode": "insensitive"}}, "SELECT c_custkey AS key FROM customer WHERE c_name ILIKE '%MER#00000001%'")
add("f11_like_param", "SELECT c_custkey AS key FROM customer WHERE c_name LIKE '%' || '42' || '%'", lambda e: prepared.Prepared(e, "customer", "findMany", {"where": {"name": {"contains": prepared.Param("part")}}, "select": {"key": True}})(part="42"))
where("f12_and", "orders", {"AND": [{"status": "O"}, {"total": {"gt": 200000}}, {}]}, "SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000")
where("f13_or", "orders", {"OR": [{"status": "P"}, {"total": {"lt": 5000}}]}, "SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'P' OR o_totalprice < 5000")
where("f13_or_empty", "orders", {"OR": []}, "SELECT o_orderkey AS key FROM orders WHERE false")
where("f14_not", "orders", {"NOT": [{"priority": "1-URGENT"}, {"status": "F"}]}, "SELECT o_orderkey AS key FROM ord WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')", nulls=True)

# lists and JSON


def arrays(run: Callable[[Engine, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Orders' return flags as lists, with nulls among them, a null list and empty ones."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = nullable(spark, sf_dir)
        lists = tables.frame("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.coalesce("l_returnflag", F.lit("-")))).alias("flags"))
        lists = lists.withColumn("flags", F.when(F.col("l_orderkey") % 7 == 0, F.array().cast("array<string>")).when(F.col("l_orderkey") % 11 != 0, F.transform("flags", lambda x: F.nullif(x, F.lit("-")))))
        catalog = Catalog()
        catalog.add("lists", [Field("key", "BigInt", db="l_orderkey", is_id=True), Field("flags", "String[]", required=False)])
        return run(Engine(spark, FrameTables(spark, {"lists": lists}), catalog))

    return query


LISTS = """WITH l0 AS (SELECT l_orderkey AS key, list_sort(list(l_returnflag)) AS f FROM lineitem GROUP BY 1),
lists AS (SELECT key, CASE WHEN key % 7 = 0 THEN [] WHEN key % 11 <> 0 THEN f END AS flags FROM l0) SELECT key FROM lists WHERE """
for name, cond, sql in (
    ("f15_list_equals", {"equals": ["A", "R"]}, "flags = ['A', 'R']"),
    ("f15_list_equals_empty", {"equals": []}, "flags IS NULL OR len(flags) = 0"),
    ("f17_list_has", {"has": "A"}, "coalesce(list_contains(flags, 'A'), false)"),
    ("f18_list_has_some", {"hasSome": ["A", "R"]}, "list_has_any(flags, ['A', 'R'])"),
    ("f19_list_has_every", {"hasEvery": ["A", "R"]}, "list_has_all(flags, ['A', 'R'])"),
    ("f20_list_is_empty", {"isEmpty": True}, "flags IS NULL OR len(flags) = 0"),
    ("f20_list_not_empty", {"isEmpty": False}, "flags IS NOT NULL AND len(flags) > 0"),
):
    QUERIES[name] = arrays(lambda e, c=cond: e.lists.find_many({"where": {"flags": c}, "select": {"key": True}}))
    ORACLES[name] = LISTS + sql
#: "N" is null in the lists of the first kind.
QUERIES["f16_list_not"] = arrays(lambda e: e.lists.find_many({"where": {"flags": {"not": ["A", "A"]}}, "select": {"key": True}}))
ORACLES["f16_list_not"] = LISTS + "NOT (list_transform(flags, lambda x: nullif(x, 'N')) IS NOT DISTINCT FROM ['A', 'A']) AND flags IS NOT NULL"
where("f15_list_of_numbers", "embeddings", {"embedding": {"isEmpty": False}, "label": {"in": [0, 1, 2]}}, "SELECT vec_id AS id FROM embeddings WHERE len(embedding) > 0 AND label IN (0, 1, 2)")
many("f21_json_number", "events", {"where": {"props": {"path": {"path": ["k"], "gte": 10, "lt": 20}}}, "select": {"id": True}}, "SELECT event_id AS id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 10 AND TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) < 20")
many("f21_json_short_form", "events", {"where": {"props": {"path": ["k"], "equals": 42}}, "select": {"id": True}}, "SELECT event_id AS id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) = 42")
many("f21_json_missing", "events", {"where": {"props": {"path": ["nothing"], "equals": None}, "type": "error"}, "select": {"id": True}}, "SELECT event_id AS id FROM events WHERE json_extract_string(props, '$.nothing') IS NULL AND event_type = 'error'")
many("f22_json_path_null", "events", {"where": {"props": {"path": None}}, "select": {"id": True}}, "SELECT event_id AS id FROM events WHERE props IS NULL")
many("f23_json_text", "events", {"where": {"props": {"string_contains": '"K": 7'}}, "select": {"id": True}}, "SELECT event_id AS id FROM events WHERE props ILIKE '%\"K\": 7%'")
many("f24_json_equals", "events", {"where": {"props": {"in": ['{"k": 1}', '{"k": 2}']}}, "select": {"id": True}}, "SELECT event_id AS id FROM events WHERE props IN ('{\"k\": 1}', '{\"k\": 2}')")

# relations

some = "EXISTS (SELECT 1 FROM {t} WHERE {c})"
where("j01_some", "customer", {"orders": {"some": {"total": {"gt": 400000}}}}, "SELECT c_custkey AS key FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
where("j02_every", "orders", {"lines": {"every": {"returnFlag": {"not": "A"}}}}, "SELECT o_orderkey AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM line WHERE l_orderkey = o_orderkey AND NOT (l_returnflag <> 'A'))", nulls=True)
where("j03_none", "orders", {"lines": {"none": {"quantity": {"gt": 30}}}}, "SELECT o_orderkey AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30)")
where("j04_none_at_all", "orders", {"lines": {"none": {}}}, "SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
where("j05_quantifiers", "orders", {"lines": {"some": {"lineStatus": "O"}, "none": {"returnFlag": "R"}, "every": {"quantity": {"gt": 2}}}}, "SELECT o_orderkey AS key FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT l_quantity > 2)")
where("j06_is", "orders", {"customer": {"is": {"segment": "BUILDING"}}}, "SELECT o_orderkey AS key FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
where("j06_bare", "customer", {"nation": {"region": {"name": "ASIA"}}}, "SELECT c_custkey AS key FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
where("j07_is_not", "orders", {"customer": {"isNot": {"balance": {"gt": 0}}}}, "SELECT o_orderkey AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
many("j08_is_null", "documents", {"where": {"label": {"is": None}}, "select": {"id": True}}, "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
many("j08_is_not_null", "documents", {"where": {"label": {"isNot": None}}, "select": {"id": True}}, "SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
where("j09_nested", "region", {"nations": {"some": {"customers": {"some": {"orders": {"every": {"total": {"gt": 500}}}}}}}}, "SELECT r_regionkey AS key FROM region WHERE EXISTS (SELECT 1 FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice > 500))")
where("j09_under_or_not", "orders", {"OR": [{"lines": {"none": {}}}, {"NOT": {"customer": {"is": {"segment": {"in": ["BUILDING", "MACHINERY"]}}}}}, {"lines": {"some": {"discount": {"gte": 0.1}}}}]}, "SELECT o_orderkey AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) OR NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment IN ('BUILDING', 'MACHINERY')) OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount >= 0.1)")

# projections, order and pages

many("m01_find_many", "supplier", {}, "SELECT s_suppkey AS key, s_name AS name, s_nationkey AS nationKey, s_acctbal AS balance FROM supplier")
many("m02_find_first", "orders", {"where": {"status": "O"}, "orderBy": {"total": "desc"}, "skip": 2, "select": {"key": True, "total": True}}, "SELECT o_orderkey AS key, o_totalprice AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 2", method="findFirst")
many("m03_find_unique", "customer", {"where": {"key": 77}}, "SELECT c_custkey AS key, c_name AS name, c_nationkey AS nationKey, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE c_custkey = 77", method="findUnique")
many("m03_compound_unique", "conversations", {"where": {"conv_turn": {"conv": 3, "turn": 1}}}, "SELECT conv_id AS conv, turn, role, text FROM conversations WHERE conv_id = 3 AND turn = 1", method="findUnique")
add("m04_count", "SELECT count(*) AS count_all FROM orders WHERE o_totalprice > 1000", lambda e: flat(e.orders.count({"where": {"total": {"gt": 1000}}})))
add("m04_count_page", "SELECT least(100, greatest(count(*) - 7, 0)) AS count_all FROM orders", lambda e: flat(e.orders.count({"skip": 7, "take": 100, "orderBy": {"key": "asc"}})))
add("m04_count_distinct", "SELECT count(*) AS count_all FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)", lambda e: flat(e.orders.count({"distinct": ["customerKey", "status"]})))
add("p01_renamed", "SELECT r_regionkey AS key, r_name AS name FROM region", lambda e: e.region.find_many())
add("p02_select", "SELECT p_partkey AS key, p_brand AS brand FROM part", lambda e: e.part.find_many({"select": {"key": True, "brand": True, "name": False}}))
many("o01_order", "part", {"orderBy": [{"size": "desc"}, {"brand": "asc", "key": "desc"}], "take": 50, "select": {"key": True}}, positioned("p_partkey AS key", "FROM part", "p_size DESC, p_brand, p_partkey DESC LIMIT 50"), placed=True)
for nulls in ("first", "last"):
    for d in ("asc", "desc"):
        many(f"o02_nulls_{d}_{nulls}", "orders", {"orderBy": [{"priority": {"sort": d, "nulls": nulls}}, {"key": "asc"}], "skip": 10, "select": {"key": True}}, positioned("o_orderkey AS key", "FROM ord", f"o_orderpriority {d} NULLS {nulls}, o_orderkey OFFSET 10"), nulls=True, placed=True)
many("o03_default_nulls", "orders", {"orderBy": [{"priority": "desc"}, {"key": "asc"}], "select": {"key": True}}, positioned("o_orderkey AS key", "FROM ord", "o_orderpriority DESC NULLS FIRST, o_orderkey"), nulls=True, placed=True)
many("o03_enum_order", "orders", {"orderBy": [{"status": "asc"}, {"key": "asc"}], "select": {"key": True}}, positioned("o_orderkey AS key", "FROM orders", "list_position(['O', 'P', 'F'], o_orderstatus), o_orderkey"), placed=True)
many("o04_relation_order", "orders", {"orderBy": [{"customer": {"nation": {"name": "desc"}}}, {"customer": {"balance": "asc"}}, {"key": "asc"}], "select": {"key": True}}, positioned("o_orderkey AS key", "FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey", "n_name DESC, c_acctbal, o_orderkey"), placed=True)
many("o05_take_zero", "orders", {"take": 0, "select": {"key": True}}, "SELECT o_orderkey AS key FROM orders LIMIT 0")
many("o06_skip", "orders", {"orderBy": {"key": "asc"}, "skip": 14000, "select": {"key": True}}, "SELECT o_orderkey AS key FROM orders ORDER BY o_orderkey OFFSET 14000")
many("o07_negative_take", "orders", {"orderBy": [{"priority": "asc"}, {"key": "asc"}], "take": -20, "skip": 3, "select": {"key": True}}, "SELECT key, row_number() OVER (ORDER BY p ASC NULLS LAST, key) AS position FROM (SELECT o_orderkey AS key, o_orderpriority AS p FROM ord ORDER BY p DESC NULLS FIRST, key DESC LIMIT 20 OFFSET 3)", nulls=True, placed=True)
many("d01_distinct_leading", "orders", {"distinct": ["customerKey"], "orderBy": {"total": "desc"}, "select": {"key": True, "customerKey": True}}, "SELECT DISTINCT ON (o_custkey) o_orderkey AS key, o_custkey AS customerKey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
many("d02_distinct_own_order", "orders", {"distinct": ["customerKey"], "orderBy": [{"total": "desc"}, {"key": "asc"}], "select": {"key": True}}, positioned("key", "FROM (SELECT DISTINCT ON (o_custkey) o_orderkey AS key, o_totalprice AS t FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey)", "t DESC, key"), placed=True, options=Options(dialect="sqlite"))
many("c01_cursor", "orders", {"cursor": {"key": 700}, "take": 30, "skip": 1, "select": {"key": True}}, positioned("o_orderkey AS key", "FROM orders WHERE o_orderkey >= 700", "o_orderkey LIMIT 30 OFFSET 1"), placed=True)
many("c02_cursor_ordered", "orders", {"cursor": {"key": 700}, "orderBy": {"key": "desc"}, "take": 30, "select": {"key": True}}, positioned("o_orderkey AS key", "FROM orders WHERE o_orderkey <= 700", "o_orderkey DESC LIMIT 30"), placed=True)
many("c03_cursor_compound", "conversations", {"cursor": {"conv_turn": {"conv": 5, "turn": 1}}, "orderBy": [{"conv": "asc"}, {"turn": "asc"}], "take": 25, "select": {"conv": True, "turn": True}}, positioned("conv_id AS conv, turn", "FROM conversations WHERE (conv_id, turn) >= (5, 1)", "conv_id, turn LIMIT 25"), placed=True)
many("c04_cursor_general", "orders", {"cursor": {"key": 33}, "orderBy": [{"priority": {"sort": "desc", "nulls": "first"}}, {"total": "asc"}], "take": 200, "skip": 2, "select": {"key": True}}, "SELECT key, row_number() OVER (ORDER BY r) AS position FROM (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderpriority DESC NULLS FIRST, o_totalprice, o_orderkey) AS r FROM ord) WHERE r >= 2 + (SELECT r FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC NULLS FIRST, o_totalprice, o_orderkey) AS r FROM ord) WHERE o_orderkey = 33) ORDER BY r LIMIT 200", nulls=True, placed=True)
many("c04_cursor_backwards", "orders", {"cursor": {"key": 33}, "orderBy": [{"priority": "asc"}, {"key": "asc"}], "take": -15, "select": {"key": True}}, "SELECT key, row_number() OVER (ORDER BY r) AS position FROM (SELECT key, r FROM (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderpriority ASC NULLS LAST, o_orderkey) AS r FROM ord) WHERE r <= (SELECT r FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority ASC NULLS LAST, o_orderkey) AS r FROM ord) WHERE o_orderkey = 33) ORDER BY r DESC LIMIT 15)", nulls=True, placed=True)

# aggregates

add("a01_count_fields", "SELECT count(*) AS count_all, count(o_orderpriority) AS count_priority FROM ord", lambda e: flat(e.orders.aggregate({"_count": {"_all": True, "priority": True}})), nulls=True)
add(
    "a03_aggregate", "SELECT round(sum(o_totalprice), 2) AS sum_total, round(avg(o_totalprice), 2) AS avg_total, min(o_orderdate) AS min_date, max(o_orderpriority) AS max_priority FROM orders WHERE o_orderstatus = 'F'",
    lambda e: totals(flat(e.orders.aggregate({"where": {"status": "F"}, "_sum": {"total": True}, "_avg": {"total": True}, "_min": {"date": True}, "_max": {"priority": True}})), "sum_total", "avg_total"),
)
add("a03_sum_of_nothing", "SELECT count(*) AS count_all, sum(o_totalprice) AS sum_total FROM orders WHERE o_totalprice < 0", lambda e: flat(e.orders.aggregate({"where": {"total": {"lt": 0}}, "_count": True, "_sum": {"total": True}})))
add("a07_group_by", "SELECT l_returnflag AS returnFlag, l_linestatus AS lineStatus, count(*) AS count_all, round(sum(l_quantity), 2) AS sum_quantity, round(sum(l_extendedprice), 2) AS sum_price FROM line GROUP BY 1, 2", lambda e: totals(flat(e.lineitem.group_by({"by": ["returnFlag", "lineStatus"], "_count": True, "_sum": {"quantity": True, "price": True}})), "sum_quantity", "sum_price"), nulls=True)
add(
    "a08_having", "SELECT o_custkey AS customerKey, count(*) AS count_all, max(o_totalprice) AS max_total FROM orders GROUP BY 1 HAVING (avg(o_totalprice) > 240000 OR count(*) >= 18) AND NOT max(o_totalprice) < 300000",
    lambda e: flat(e.orders.group_by({"by": ["customerKey"], "_count": True, "_max": {"total": True}, "having": {"OR": [{"total": {"_avg": {"gt": 240000}}}, {"_count": {"_all": {"gte": 18}}}], "NOT": {"_max": {"total": {"lt": 300000}}}}})),
)
add("a09_having_in", "SELECT c_nationkey AS nationKey FROM customer GROUP BY 1 HAVING count(*) NOT IN (55, 56, 57, 58) AND NOT (count(*) > 70)", lambda e: e.customer.group_by({"by": "nationKey", "having": {"_count": {"_all": {"notIn": [55, 56, 57, 58], "not": {"gt": 70}}}}}))
add("a11_group_page", positioned("p_brand AS brand, count(*) AS count_all", "FROM part GROUP BY 1", "count(*) DESC, p_brand LIMIT 8 OFFSET 2"), lambda e: flat(e.part.group_by({"by": ["brand"], "_count": True, "orderBy": [{"_count": {"_all": "desc"}}, {"brand": "asc"}], "take": 8, "skip": 2})).coalesce(1).withColumn("position", F.monotonically_increasing_id() + 1))
add("a12_relation_counts", "SELECT c_custkey AS key, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS orders, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS events FROM customer", lambda e: e.customer.find_many({"select": {"key": True, "_count": {"select": {"orders": {"where": {"status": "F"}}, "events": True}}}}).select("key", "_count.*"))
add("a18_fan_out", "SELECT count(*) AS parents, avg(n) AS average, max(n) AS maximum, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, (SELECT count(*) FROM orders) AS total, count(*) / (SELECT count(*) FROM orders) AS coverage FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)", lambda e: stats.fan_out(e, "orders", "lines"))

# nesting: results are spread to rows for comparison


def spread(df: DataFrame, name: str, *fields: str) -> DataFrame:
    """A row to each nested row with its place, and one with nulls where there is none."""
    return df.select("key", F.posexplode_outer(name).alias("place", "x")).select("key", "place", *[F.col(f"x.{f}").alias(f"{name}_{f}") for f in fields])


ROWS = "SELECT c_custkey AS key, CAST(place AS INT) AS place, orders_key FROM customer LEFT JOIN ({}) ON c = c_custkey"
PLACE = "SELECT o_custkey AS c, o_orderkey AS orders_key, row_number() OVER (PARTITION BY o_custkey ORDER BY {}) - 1 AS place FROM {}"
include = lambda name, args, sql, **more: add(name, ROWS.format(sql), lambda e: spread(e.customer.find_many({"include": {"orders": args}}), "orders", "key"), **more)
include("i01_to_many", True, PLACE.format("o_orderkey", "orders"))
include("i03_child_where", {"where": {"total": {"gt": 300000}}}, PLACE.format("o_orderkey", "orders WHERE o_totalprice > 300000"))
include("i04_child_order", {"orderBy": [{"priority": "desc"}, {"total": "asc"}]}, PLACE.format("o_orderpriority DESC NULLS FIRST, o_totalprice, o_orderkey", "ord").replace("FROM ord", "FROM ord"), nulls=True)
include("i05_child_page", {"orderBy": {"date": "desc"}, "take": 3, "skip": 1}, "SELECT c, orders_key, place - 1 AS place FROM (" + PLACE.format("o_orderdate DESC, o_orderkey", "orders") + ") WHERE place BETWEEN 1 AND 3")
include("o08_child_tail", {"orderBy": {"date": "asc"}, "take": -2}, "SELECT c, orders_key, place + least(n, 2) - n AS place FROM (SELECT *, count(*) OVER (PARTITION BY c) AS n FROM (" + PLACE.format("o_orderdate, o_orderkey", "orders") + ")) WHERE place >= n - 2")
include("i09_child_distinct", {"distinct": ["status"], "orderBy": {"total": "desc"}}, "SELECT c, orders_key, row_number() OVER (PARTITION BY c ORDER BY t DESC, orders_key) - 1 AS place FROM (SELECT DISTINCT ON (o_custkey, o_orderstatus) o_custkey AS c, o_orderkey AS orders_key, o_totalprice AS t FROM orders ORDER BY o_custkey, o_orderstatus, o_totalprice DESC, o_orderkey)")
add("i02_to_one", "SELECT d.doc_id AS id, l.quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id)", lambda e: e.documents.find_many({"select": {"id": True, "label": True}}).select("id", "label.quality", F.col("label").isNull().alias("missing")))
add(
    "i06_nested", "SELECT n_nationkey AS key, count(o_orderkey) AS orders, CAST(coalesce(sum(lines), 0) AS BIGINT) AS lines, max(n_name) AS name, max(r_name) AS region FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1",
    lambda e: e.nation.find_many({"include": {"region": True, "customers": {"select": {"orders": {"where": {"total": {"gt": 100000}}, "select": {"key": True, "_count": {"select": {"lines": True}}}}}}}})
    .select("key", "name", F.col("region.name").alias("region"), F.flatten(F.transform("customers", lambda c: c["orders"])).alias("o"))
    .select("key", "name", "region", F.size("o").cast("long").alias("orders"), F.aggregate("o", F.lit(0).cast("long"), lambda a, x: a + x["_count"]["lines"]).alias("lines")),
)
add(
    "i07_nested_to_one", "SELECT o_orderkey AS key, c_name AS customer, n_name AS nation, r_name AS region FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey ORDER BY o_orderkey",
    lambda e: e.orders.find_many({"select": {"key": True, "customer": {"select": {"name": True, "nation": {"include": {"region": True}}}}}, "orderBy": {"key": "asc"}}).select("key", F.col("customer.name").alias("customer"), F.col("customer.nation.name").alias("nation"), F.col("customer.nation.region.name").alias("region")),
)
# keys of two columns
LINE = "SELECT l_orderkey AS orderKey, l_linenumber AS number, l_partkey AS partKey FROM lineitem a WHERE "
SAME = "(SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey = a.l_suppkey"
PICK = {"orderKey": True, "number": True, "partKey": True}
many("j13_composite_some", "lineitem", {"where": {"alike": {"some": {"returnFlag": "R", "quantity": {"gt": 40}}}}, "select": PICK}, f"{LINE}EXISTS {SAME} AND l_returnflag = 'R' AND l_quantity > 40)")
many("j13_composite_none", "lineitem", {"where": {"alike": {"none": {"number": {"gt": 1}}}}, "select": PICK}, f"{LINE}NOT EXISTS {SAME} AND l_linenumber > 1)")
many("j13_composite_under_or", "lineitem", {"where": {"OR": [{"alike": {"every": {"lineStatus": "F"}}}, {"quantity": {"lt": 3}}]}, "select": PICK}, f"{LINE}NOT EXISTS {SAME} AND l_linestatus <> 'F') OR l_quantity < 3")
add(
    "j13_composite_include", "SELECT a.l_orderkey AS orderKey, a.l_suppkey AS supplierKey, a.l_linenumber AS number, a.l_partkey AS partKey, count(b.l_orderkey) AS n, max(b.l_quantity) AS most FROM (SELECT * FROM lineitem WHERE l_quantity > 45) a LEFT JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_suppkey = a.l_suppkey GROUP BY ALL",
    lambda e: e.lineitem.find_many({"where": {"quantity": {"gt": 45}}, "select": {"orderKey": True, "supplierKey": True, "number": True, "partKey": True, "alike": {"select": {"quantity": True}}}})
    .select("orderKey", "supplierKey", "number", "partKey", F.size("alike").cast("long").alias("n"), F.array_max("alike.quantity").alias("most")).groupBy("orderKey", "supplierKey", "number", "partKey").agg((F.sum("n")).alias("n"), F.max("most").alias("most")),
)
many("c07_cursor_compound_down", "conversations", {"cursor": {"conv_turn": {"conv": 5, "turn": 1}}, "orderBy": [{"conv": "desc"}, {"turn": "asc"}], "take": 25, "select": {"conv": True, "turn": True}}, positioned("conv_id AS conv, turn", "FROM conversations WHERE conv_id < 5 OR conv_id = 5 AND turn >= 1", "conv_id DESC, turn LIMIT 25"), placed=True)
many("c08_cursor_distinct", "orders", {"cursor": {"customerKey": 20}, "distinct": ["customerKey"], "orderBy": [{"customerKey": "asc"}, {"key": "asc"}], "take": 30, "select": {"customerKey": True, "key": True}}, positioned("customerKey, key", "FROM (SELECT o_custkey AS customerKey, min(o_orderkey) AS key FROM orders WHERE o_custkey >= 20 GROUP BY 1)", "customerKey LIMIT 30"), placed=True)
add("m04_count_select", "SELECT count(*) AS all_rows, count(o_orderpriority) AS priority FROM ord", lambda e: e.orders.count({"select": {"_all": True, "priority": True}}).select(F.col("_count._all").alias("all_rows"), F.col("_count.priority").alias("priority")), nulls=True)
add("x09_attach", "SELECT s_suppkey AS key, count(l_suppkey) AS lines FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 45 WHERE s_acctbal > 5000 GROUP BY 1", lambda e: e.attach_includes(e.supplier.find_many({"where": {"balance": {"gt": 5000}}, "select": {"key": True}}), "supplier", {"lines": {"where": {"quantity": {"gt": 45}}}}).select("key", F.size("lines").cast("long").alias("lines")))

# several at once, streams, prepared

add(
    "m07_batch", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS open, (SELECT string_agg(r_name, ',' ORDER BY r_regionkey) FROM region) AS regions, (SELECT max(o_totalprice) FROM orders) AS most",
    lambda e: batch.batch_row(e, {"open": ("orders", "count", {"where": {"status": "P"}}), "regions": ("region", "findMany", {"orderBy": {"key": "asc"}}), "most": ("orders", "aggregate", {"_max": {"total": True}})})
    .select(F.col("open._count._all").alias("open"), F.array_join("regions.name", ",").alias("regions"), F.col("most._max.total").alias("most")),
)
add(
    "m08_fused_counts", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS count_0, (SELECT count(*) FROM customer) AS count_1, (SELECT count(*) FROM orders WHERE o_totalprice > 100000 OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS count_2, 10 + 0 * (SELECT count(*) FROM orders) AS count_3",
    lambda e: batch.fused_counts(e, [("orders", {"where": {"status": "F"}}), ("customer", {}), ("orders", {"where": {"OR": [{"total": {"gt": 100000}}, {"lines": {"none": {}}}]}}), ("orders", {"take": 10})]),
)
add("m09_batch_count", "SELECT unnest([(SELECT count(*) FROM part WHERE p_size > 25), (SELECT count(*) FROM nation)]) AS n", lambda e: e.spark.createDataFrame([(n,) for n in batch.batch_count(e, [{"model": "part", "method": "count", "args": {"where": {"size": {"gt": 25}}}}, {"model": "nation"}])], "n long"))
add("m11_transaction", "SELECT (SELECT count(*) FROM region) AS regions, (SELECT max(n_nationkey) FROM nation) AS last", lambda e: e.spark.createDataFrame([(lambda r: (r[0][0]._count._all, r[1][0]._max.key))(batch.transaction(e, [{"model": "region", "method": "count"}, {"model": "nation", "method": "aggregate", "args": {"_max": {"key": True}}}], isolation="Serializable", timeout=600))], "regions long, last int"))
add("m13_stream", "SELECT s_suppkey AS key FROM supplier WHERE s_acctbal < 0 ORDER BY s_suppkey", lambda e: e.spark.createDataFrame([(r.key,) for r in rows.iterate(e, "supplier", {"where": {"balance": {"lt": 0}}, "orderBy": {"key": "asc"}})], "key long"))
add("m14_fold", "SELECT count(*) AS customers, count(o_orderkey) AS orders FROM (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') LEFT JOIN (SELECT o_custkey, count(*) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey", lambda e: e.spark.createDataFrame([rows.fold(e, "customer", {"where": {"segment": "BUILDING"}, "select": {"key": True, "_count": {"select": {"orders": True}}}}, (0, 0), lambda s, r: (s[0] + 1, s[1] + (r._count.orders > 0)))], "customers long, orders long"))
add("m16_prepared", positioned("o_orderkey AS key", "FROM orders WHERE o_totalprice > 150000", "o_orderkey LIMIT 12 OFFSET 4"), lambda e: prepared.Registry(e).prepare("big", "orders", "findMany", {"where": {"total": {"gt": prepared.Param("least")}}, "orderBy": {"key": "asc"}, "take": prepared.Param("n"), "skip": prepared.Param("from"), "select": {"key": True}})(least=150000, n=12, **{"from": 4}).coalesce(1).withColumn("position", F.monotonically_increasing_id() + 1))
add("s04_sql", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1", lambda e: e.sql("SELECT segment, count(*) AS n FROM {customers} WHERE balance > :least GROUP BY 1".replace("{customers}", _view(e, "customer")), least=0))


def _view(engine: Engine, model: str) -> str:
    name = f"lattiq_{model}"
    engine.model(model).find_many().createOrReplaceTempView(name)
    return name


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a region with an order over a sum, in order, each with its last three orders and their line counts."""
    return Engine(spark, sf_dir).customer.find_many(
        {
            "where": {"nation": {"is": {"region": {"is": {"name": "ASIA"}}}}, "orders": {"some": {"total": {"gt": 100000}}}},
            "include": {"nation": {"select": {"name": True}}, "orders": {"orderBy": {"date": "desc"}, "take": 3, "select": {"key": True, "date": True, "total": True, "_count": {"select": {"lines": True}}}}, "_count": {"select": {"orders": True}}},
            "orderBy": [{"balance": "desc"}, {"key": "asc"}],
            "take": 20,
        }
    )


add(
    "flagship",
    """WITH page AS (SELECT c_custkey, c_name, n_name, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) ORDER BY c_acctbal DESC, c_custkey LIMIT 20),
last AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS orders FROM orders)
SELECT c_custkey AS key, n_name AS nation, CAST(rn - 1 AS INT) AS place, o_orderkey AS order_key, orders, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM page JOIN last ON o_custkey = c_custkey WHERE rn <= 3""",
    lambda e: flagship(e.spark, e.tables.folder).select("key", F.col("nation.name").alias("nation"), F.col("_count.orders").alias("orders"), F.posexplode("orders").alias("place", "x")).select("key", "nation", "place", F.col("x.key").alias("order_key"), "orders", F.col("x._count.lines").alias("lines")),
)
