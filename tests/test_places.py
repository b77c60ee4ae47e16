"""Long pages and places of whole tables: right, and without a task that gets all rows."""

import pytest
from pyspark.sql import functions as F

from lattiq import Catalog, Engine, Field, FrameTables, catalog_queries
from lattiq.operators import paging, places
from lattiq.operators.ordering import Key

SF = "/root/testdata/sf0.01"


def most(df):
    """The part of the frame's rows that one task gets at most."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return max(parts) / sum(parts)


def test_o06_skip(spark):
    df = catalog_queries.QUERIES["o06_skip"](spark, SF)
    assert most(df) < 0.6
    keys = sorted(r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect())
    assert [r.key for r in df.collect()] == keys[14000:]
    assert df.limit(5).agg(F.max("key")).first()[0] == keys[14004]


@pytest.fixture(scope="module")
def db(spark):
    rows = [(k, None if k % 7 == 0 else "abcde"[k % 5], None if k % 11 == 0 else float(k % 13) - 6, k % 3 == 0) for k in range(3000)]
    c = Catalog()
    c.add("t", [Field("id", "Int", is_id=True), Field("s", required=False), Field("x", "Float", required=False), Field("b", "Boolean")])
    c.add("bag", [Field("s", required=False), Field("x", "Float", required=False), Field("b", "Boolean")])
    frame = spark.createDataFrame(rows, "id int, s string, x double, b boolean").repartition(5)
    return Engine(spark, FrameTables(spark, {"t": frame, "bag": frame.drop("id")}), c), rows


@pytest.mark.parametrize("down", [False, True])
@pytest.mark.parametrize("first", [False, True])
def test_long_pages(db, monkeypatch, down, first):
    monkeypatch.setattr(paging, "HELD", 0)
    engine, rows = db

    def key(v):
        null = (v is None) != (first != down)
        return null, 0 if v is None else v

    want = sorted(rows, key=lambda r: (-r[3], r[0]))
    for n in (1, 2):  # the least key first: Python's sort is stable
        some = sorted((r for r in want if r[n] is not None), key=lambda r: r[n], reverse=False)
        if down:
            some = [r for v in sorted({r[n] for r in some}, reverse=True) for r in some if r[n] == v]
        none = [r for r in want if r[n] is None]
        want = none + some if first else some + none
    ids = [r[0] for r in want]
    way = {"sort": "desc" if down else "asc", "nulls": "first" if first else "last"}
    order = [{"x": way}, {"s": way}, {"b": "desc"}, {"id": "asc"}]
    got = lambda **page: [r.id for r in engine.t.find_many({"orderBy": order, "select": {"id": True}, **page}).collect()]
    assert got(skip=1) == ids[1:] and got(skip=2990, take=50) == ids[2990:] and got(skip=7, take=900) == ids[7:907] and got(skip=3000) == []
    assert got(skip=5, take=-20) == ids[-25:-5] and engine.t.count({"skip": 100, "orderBy": order}).first()[0][0] == 2900
    placed = engine.numbered("t", {"orderBy": order, "skip": 10, "select": {"id": True}}).collect()
    assert [(r.id, r.position) for r in placed] == [(k, n) for n, k in enumerate(ids[10:], 1)]


def test_rows_without_a_key(db, monkeypatch):
    monkeypatch.setattr(paging, "HELD", 0)
    engine, rows = db
    want = sorted((r[1:] for r in rows), key=lambda r: (r[2], r[0] is None, r[0] or "", r[1] is None, r[1] or 0))
    assert [tuple(r) for r in engine.bag.find_many({"orderBy": {"b": "asc"}, "skip": 1234}).collect()] == want[1234:]
    groups = engine.bag.group_by({"by": ["s", "x"], "_count": True, "orderBy": [{"_count": {"_all": "desc"}}], "skip": 4}).collect()
    assert len(groups) == len({r[1:3] for r in rows}) - 4


def test_buckets_are_even(spark):
    frame = spark.range(20000).select(F.when(F.col("id") > 5, "same").alias("s"), "id")
    counts = [r["count"] for r in places.bucketed(frame, [Key("s", True), Key("id")], True).groupBy("__bucket").count().collect()]
    assert sum(counts) == 20000 and len(counts) > 200 and max(counts) < 400


@pytest.mark.parametrize(("way", "nulls"), [("asc", "first"), ("asc", "last"), ("desc", "first"), ("desc", "last")])
def test_o02_nulls(spark, way, nulls):
    df = catalog_queries.QUERIES[f"o02_nulls_{way}_{nulls}"](spark, SF)
    assert most(df) < 0.6
    got = df.collect()
    assert [r.position for r in got] == list(range(1, 14991))
    priority = dict(spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW"))).collect())
    some, none = sorted((p, k) for k, p in priority.items() if p), sorted((None, k) for k, p in priority.items() if p is None)
    if way == "desc":
        some = [r for v in sorted({p for p, _ in some}, reverse=True) for r in some if r[0] == v]
    assert [r.key for r in got] == [k for _, k in (none + some if nulls == "first" else some + none)][10:]


def test_o03_default_nulls(spark):
    df = catalog_queries.QUERIES["o03_default_nulls"](spark, SF)
    assert most(df) < 0.6
    got = df.collect()
    assert [r.position for r in got] == list(range(1, 15001))
    rows = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW"))).collect()
    assert [r.key for r in got] == [k for v in (None, "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT") for k, p in sorted(rows, key=lambda r: r[0]) if p == v]


def test_o03_enum_order(spark):
    df = catalog_queries.QUERIES["o03_enum_order"](spark, SF)
    assert most(df) < 0.6
    got = df.collect()
    assert [r.position for r in got] == list(range(1, 15001))
    rows = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderstatus").collect()
    assert [r.key for r in got] == [k for v in "OPF" for k, s in sorted(rows, key=lambda r: r[0]) if s == v]


@pytest.mark.parametrize(("name", "rows"), [("o04_relation_order", 15000), ("d02_distinct_own_order", None)])
def test_the_same_step(spark, name, rows):
    df = catalog_queries.QUERIES[name](spark, SF)
    assert most(df) < 0.6
    got = df.collect()
    assert [r.position for r in got] == list(range(1, (rows or len(got)) + 1)) and len({r.key for r in got}) == len(got) > 1000
