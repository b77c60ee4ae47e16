"""The driver gives memory back while loops write their tables."""

from lattiq.llm import common


def test_the_jvm_trims_its_native_memory(spark):
    assert common.rest(spark).startswith("Trim native heap")


def test_written_tables_let_the_driver_rest(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "rest", calls.append)
    scratch = common.Scratch(spark, "rest")
    for k in range(2 * common.REST_AFTER):
        scratch.table(spark.range(1), f"t{k}")
        assert len(calls) == (k + 1) // common.REST_AFTER
    scratch.close()
