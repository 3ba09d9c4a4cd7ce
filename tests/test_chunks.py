"""How chunks of derived tables are written: one deal of narrow rows by blocks, in tasks of a bounded size."""

import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tessera import engine_queries
from tessera.engine import execute
from tessera.sources.chunks import TASK_ROWS, DerivedSource, FrameSource, ranged

SF = "/root/testdata/sf0.001"


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.mark.parametrize("dataset,table", [("shop", "orders"), ("shop", "lineitem"), ("shop", "payments"), ("tree", "nodes"), ("tree", "marks"), ("lab", "things")])
def test_rows_are_dealt_once(spark, dataset, table):
    """By ranges of their blocks, before wide columns are derived: nothing that an Arrow function or another exchange would carry again."""
    source = engine_queries._DERIVED[dataset](spark, SF)
    text = plan(source.table(table))
    assert table in source.laid_out
    assert re.findall(r"Exchange (\w+)", text) == ["rangepartitioning"] and text.count("Sort [") == 1
    below = text[text.index("Exchange") :]
    assert "ArrowEvalPython" not in below and "hex(" not in below and "concat(" not in below


def test_tasks_are_bounded(spark):
    """More rows are dealt to more tasks, whatever spark.sql.shuffle.partitions says."""
    df = spark.range(1000)
    few = spark.sparkContext.defaultParallelism
    assert ranged(df, "id", 1000).rdd.getNumPartitions() == few
    assert ranged(df, "id", 40 * TASK_ROWS + 1).rdd.getNumPartitions() == 41


def test_files_hold_ranges_in_order(spark):
    """Every file of a laid out table holds blocks that no other file holds, in key order, and all rows."""
    source = engine_queries.chunk(spark, SF, "shop")
    for name, keys in (("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey", "seq"]), ("payments", ["p_order", "p_line", "p_supplier"])):
        rows = source.table(name).select(F.input_file_name().alias("f"), *keys).collect()
        files = {}
        for r in rows:
            files.setdefault(r[0], []).append(tuple(r[1:]))
        assert all(own == sorted(own) for own in files.values()) and len(files) > 1
        ends = sorted((own[0][0], own[-1][0]) for own in files.values())
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert source.table("lineitem").count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_tables_are_written_at_first_use(spark, tmp_path):
    """A request for lines writes no payments, and no table twice."""
    at = f"{tmp_path}/{uuid.uuid4().hex}"
    source = DerivedSource(spark, at, engine_queries.shop(spark, SF), engine_queries.catalogs()["shop"])
    for _ in range(2):
        assert execute(spark, {"type": "shop", "lines": [{"nonZero": True}]}, engine_queries.catalogs()["shop"], source, None)
    assert sorted(os.listdir(at)) == ["lineitem.parquet", "orders.parquet"]


def test_bloom_of_a_row_with_a_null(spark):
    """A null supplier or part sets no bit and leaves the rows beside it as they are."""
    rows = spark.createDataFrame([(3, 77), (None, 77), (3, None), (None, None)], "s long, p long").coalesce(1)
    got = [r[0] for r in rows.select(engine_queries._parties(F.col("s"), F.col("p"))).collect()]
    want = [engine_queries.bloom_build(v, 64, 7) for v in (["s3", "p77"], ["p77"], ["s3"], [])]
    assert [bytes(x) for x in got] == want
    assert isinstance(engine_queries.shop(spark, SF), FrameSource)
