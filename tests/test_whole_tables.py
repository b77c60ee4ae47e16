"""Queries about order, nesting and streams run over whole tables."""

import pytest

from lattiq import catalog_queries

NAMES = [*[f"o02_nulls_{d}_{n}" for d in ("asc", "desc") for n in ("first", "last")], "o03_default_nulls", "o03_enum_order", "o04_relation_order", "d02_distinct_own_order", "i07_nested_to_one", "m13_stream"]


@pytest.mark.parametrize("name", NAMES)
def test_no_limit(name):
    assert "LIMIT" not in catalog_queries.ORACLES[name]


def test_every_order_is_resolved(spark):
    sf = "/root/testdata/sf0.001"
    assert catalog_queries.QUERIES["i07_nested_to_one"](spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count()
