"""Every engine query against its SQL."""

import re

import pytest
from oracle import compare
from pyspark.sql import functions as F

from tessera import engine_queries
from tessera.catalog import parse
from tessera.engine import execute
from tessera.sources.chunks import FrameSource

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(engine_queries.queries()))
def test_query(spark, name):
    compare(spark, engine_queries.queries()[name], engine_queries.oracle_sql()[name], SF)


def test_whole_tables(spark):
    """The hierarchies and block queries reach rows of all ids."""
    rows = {n: {tuple(r) for r in engine_queries.queries()[n](spark, SF).collect()} for n in ("relation_children", "relation_cross_children", "relation_list_key", "relation_cross_parents", "include_all_blocks", "boundary_blocks")}
    for name in list(rows)[:4]:
        assert any(i > 100 for _, i in rows[name]) and any(i % 3 for _, i in rows[name])
    assert len(rows["include_all_blocks"]) == spark.read.parquet(SF + "/orders.parquet").count() and any(b > 900 for (b,) in rows["boundary_blocks"])


def explained(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_scans_are_pruned(spark):
    """Filters and the few columns of a request reach the chunk's scan."""
    plan = explained(engine_queries.queries()["filter_inlist"](spark, SF))
    assert "In(l_linenumber, [1,3])" in plan and "EqualTo(status,F)" in plan
    read = re.search(r"ReadSchema: struct<(.*)>", plan)[1]
    assert {c.split(":")[0] for c in read.split(",")} == {"l_orderkey", "seq", "status", "l_linenumber"}


def test_weights_read_narrow_columns(spark):
    """One scan of each table, of keys, filters and sizes only."""
    e = engine_queries._run(spark, SF, "shop", 1 << 30, **engine_queries._HEAVY)
    reads = re.findall(r"ReadSchema: struct<(.*)>", explained(e.weights()))
    lines = [r for r in reads if "flag" in r]
    assert len(lines) == 1 and {c.split(":")[0] for c in lines[0].split(",")} == {"l_orderkey", "flag", "price_size"}


def test_reached_rows_are_selected_once(spark):
    """A page's second pass looks rows that relations reach up by key; the relation itself is not run again."""
    request = {"fields": {"payment": {"mode": True}}, "lines": [{"flag": ["r"], "payments": True}]}
    e = engine_queries._run(spark, SF, "shop", 100_000, **request)
    assert e.last_block() is not None
    plan = explained(e.lines())
    assert "InMemoryTableScan" in plan and e.lines().count() > 0
    e.release()


def test_page_is_not_cut_by_light_headers(spark):
    """Headers charged by a light weight key: the page holds what the budget does."""
    catalog = parse("version: 1\ndataset: x\ntables:\n  b: {block: n, weight_key: [x], columns: {n: uint64, x: uint8 w=1}}")
    blocks = spark.range(20).select(F.col("id").alias("n"), F.lit(1).alias("x"))
    e = execute(spark, {"type": "x", "includeAllBlocks": True}, catalog, FrameSource({"b": blocks}), budget=40)
    assert e.last_block() == 19 and e.page().count() == 20
