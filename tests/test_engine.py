"""Engine behaviour on small chunks: encodings, hashing, schema checks, paging, streaming."""

import json
from decimal import Decimal

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog import load, parse
from tessera.engine import execute, pages, read_frames
from tessera.errors import QueryError
from tessera.functions.encode import or_null, raw_json
from tessera.functions.hashing import Fuse8, base58, bloom_build, bloom_test
from tessera.sources.chunks import FrameSource, ParquetSource, write_chunk
from tessera.streaming.chunks import answer_chunks

EVM, SOLANA = load("evm"), load("solana")


def evm_chunk(spark, first=100, last=115):
    """16 blocks with 2 transactions, 4 logs and 4 traces each."""
    n = last - first + 1
    blocks = spark.range(first, last + 1).select(F.col("id").alias("number"), F.concat(F.lit("0xb"), "id").alias("hash"), F.concat(F.lit("0xb"), F.col("id") - 1).alias("parent_hash"), F.timestamp_seconds(F.col("id") * 12).alias("timestamp"))
    tx = spark.range(2 * n).select((F.col("id") / 2).cast("int").alias("b"), (F.col("id") % 2).cast("int").alias("transaction_index"))
    tx = tx.select((F.col("b") + first).cast("long").alias("block_number"), "transaction_index", F.lit("0xaa").alias("from"), F.col("b").cast("long").alias("nonce"), F.lit("0x").alias("input"), F.lit(2).cast("long").alias("input_size"))
    logs = spark.range(4 * n).select(((F.col("id") / 4).cast("int") + first).cast("long").alias("block_number"), (F.col("id") % 4).cast("int").alias("log_index"), ((F.col("id") % 4) / 2).cast("int").alias("transaction_index"),
        F.concat(F.lit("0x"), F.lpad((F.col("id") % 2).cast("string"), 40, "0")).alias("address"), F.lit("0x01").alias("topic0"), F.when(F.col("id") % 3 == 0, "0x02").alias("topic1"), F.lit(None).cast("string").alias("topic2"), F.lit("0x03").alias("topic3"), F.repeat(F.lit("ab"), 50).alias("data"), F.lit(100).cast("long").alias("data_size"))
    paths = [[], [0], [0, 0], [1]]
    traces = spark.createDataFrame([(b, 0, p, "call" if p != [1] else "create", "0xc1", "0x0" if p else "0x1f") for b in range(first, last + 1) for p in paths], "block_number long, transaction_index int, trace_address array<int>, type string, call_from string, call_value string")
    return {"blocks": blocks, "transactions": tx, "logs": logs, "traces": traces}


def lines(e):
    return [json.loads(x) for x in e.json_lines()]


def test_answer(spark):
    source = FrameSource(evm_chunk(spark))
    request = {"type": "evm", "fromBlock": 101, "toBlock": 104, "fields": {"block": {"number": True}, "log": {"logIndex": True, "topics": True}, "transaction": {"transactionIndex": True}}, "logs": [{"address": ["0x" + "0" * 39 + "1"], "transaction": True}]}
    got = lines(execute(spark, request, EVM, source))
    assert [x["header"]["number"] for x in got] == [101, 102, 103, 104]
    assert list(got[0]) == ["header", "transactions", "logs"]
    assert [x["logIndex"] for x in got[0]["logs"]] == [1, 3] and [x["transactionIndex"] for x in got[0]["transactions"]] == [0, 1]
    assert all(x["topics"] in (["0x01"], ["0x01", "0x02"]) for b in got for x in b["logs"])
    empty = execute(spark, {**request, "fromBlock": 900, "toBlock": 901}, EVM, source)
    assert "".join(empty.json_lines()) == "" and empty.last_block() is None


def test_traces(spark):
    source = FrameSource(evm_chunk(spark))
    fields = {"trace": {"traceAddress": True, "type": True, "callFrom": True, "callValue": True}}
    one = {"type": "evm", "fromBlock": 100, "toBlock": 100, "fields": fields}
    got = lines(execute(spark, {**one, "traces": [{"callValueNonZero": True, "subtraces": True}]}, EVM, source))[0]["traces"]
    assert [x["traceAddress"] for x in got] == [[], [0], [0, 0], [1]]
    assert got[0] == {"traceAddress": [], "type": "call", "action": {"from": "0xc1", "value": "0x1f"}} and got[3] == {"traceAddress": [1], "type": "create"}


def test_paging_is_exact(spark):
    source = FrameSource(evm_chunk(spark))
    request = {"type": "evm", "fields": {"log": {"logIndex": True, "data": True}, "block": {"number": True}}, "logs": [{}]}
    whole = lines(execute(spark, request, EVM, source, budget=None))
    split = [x for p in pages(spark, request, EVM, source, budget=3000) for x in lines(p)]
    assert [x for x in split if "logs" in x] == [x for x in whole if "logs" in x]
    tiny = execute(spark, request, EVM, source, budget=1)
    assert len(lines(tiny)) == 1 and tiny.last_block() == 100 and tiny.read_through() == 100
    assert execute(spark, request, EVM, source).read_through() is None and tiny.estimated_bytes("logs") > 0


def test_widths_do_not_matter(spark):
    chunk = evm_chunk(spark)
    wide = {n: df.select(*[F.col(c).cast("decimal(20,0)").alias(c) if k in ("bigint", "int") else F.col(c) for c, k in df.dtypes]) for n, df in chunk.items()}
    request = {"type": "evm", "fields": {"log": {"logIndex": True}, "transaction": {"nonce": True}}, "logs": [{"transaction": True}], "transactions": [{"firstNonce": 3}], "toBlock": 110}
    assert list(execute(spark, request, EVM, FrameSource(chunk)).json_lines()) == list(execute(spark, request, EVM, FrameSource(wide)).json_lines())


def test_schema_checks(spark):
    chunk = evm_chunk(spark)

    def kind(tables, **request):
        with pytest.raises(QueryError) as e:
            execute(spark, {"type": "evm", **request}, EVM, FrameSource(tables))
        return e.value.kind

    assert kind({k: v for k, v in chunk.items() if k != "transactions"}, logs=[{"transaction": True}]) == "TableNotFound"
    assert kind(chunk | {"logs": chunk["logs"].drop("address")}, logs=[{"address": ["0x1"]}]) == "ColumnNotFound"
    assert kind(chunk | {"logs": chunk["logs"].drop("data_size")}, logs=[{}], fields={"log": {"data": True}}) == "ColumnNotFound"
    assert kind(chunk | {"logs": chunk["logs"].drop("topic3")}, logs=[{}], fields={"log": {"topics": True}}) == "ColumnNotFound"
    assert kind(chunk | {"logs": chunk["logs"].withColumn("transaction_index", F.lit(1.5))}, logs=[{"transaction": True}]) == "UnsupportedKeyType"
    assert kind(chunk | {"logs": chunk["logs"].withColumn("address", F.lit(1.5))}, logs=[{"address": ["0x1"]}]) == "UnsupportedKeyType"
    assert kind(chunk | {"blocks": chunk["blocks"].withColumn("number", F.lit("x"))}, logs=[{}]) == "MalformedChunkData"
    assert kind(chunk | {"logs": chunk["logs"].withColumn("data", F.array("data"))}, logs=[{}], fields={"log": {"data": True}}) == "MalformedChunkData"
    holes = FrameSource(chunk | {"logs": chunk["logs"].withColumn("block_number", F.nullif("block_number", F.lit(103)))}, vouched=False)
    with pytest.raises(QueryError) as e:
        execute(spark, {"type": "evm", "logs": [{}]}, EVM, holes)
    assert e.value.kind == "MalformedChunkData"
    assert execute(spark, {"type": "evm", "logs": [{}]}, EVM, FrameSource(chunk | {"logs": chunk["logs"].drop("address")}))


def test_fork(spark):
    source = FrameSource(evm_chunk(spark))
    assert execute(spark, {"type": "evm", "fromBlock": 100, "parentBlockHash": "0xb99"}, EVM, source)
    assert execute(spark, {"type": "evm", "fromBlock": 500, "parentBlockHash": "other"}, EVM, source)
    with pytest.raises(QueryError) as e:
        execute(spark, {"type": "evm", "fromBlock": 105, "parentBlockHash": "other"}, EVM, source)
    assert "does not follow other" in str(e.value) and e.value.blocks[-1] == (104, "0xb104")


def test_bloom(spark):
    accounts = [f"account{i}" for i in range(6)]
    df = spark.createDataFrame([(i, bytearray(bloom_build(accounts[: i + 1], 64, 7))) for i in range(6)] + [(9, None)], "i int, b binary")
    assert [r.i for r in df.filter(bloom_test(F.col("b"), ["account4", "none"], 64, 7)).collect()] == [4, 5]


def test_fuse8(spark):
    values = [f"0x{i:040x}" for i in range(2000)]
    f = Fuse8.decode(Fuse8.build(values).encode())
    assert all(map(f.holds, values)) and sum(f.holds(f"no{i}") for i in range(20000)) < 200
    mixed = [*values, *(f"no{i}" for i in range(20000))]
    assert f.holds_all(np.array([xxhash.xxh3_64_intdigest(v.encode()) for v in mixed], np.uint64)).tolist() == [f.holds(v) for v in mixed]
    source = FrameSource(evm_chunk(spark))
    held = ["0x" + "0" * 39 + "1", *values[5:40]]
    request = {"type": "evm", "fields": {"log": {"logIndex": True, "address": True}}, "sets": {"s": {"fuse8": Fuse8.build(held).encode(), "canaries": held[:1]}}, "logs": [{"address": [{"set": "s"}]}], "toBlock": 100}
    assert [x["logIndex"] for x in lines(execute(spark, request, EVM, source))[0]["logs"]] == [1, 3]


def test_encodings(spark):
    import datetime

    row = spark.createDataFrame(
        [(1600, -1, 1.5, float("nan"), "a\"é\n", bytearray(b"\0\1"), Decimal("5"), datetime.datetime(1969, 12, 31, 23, 59, 58, 500000), [1, None], ("x", 2))],
        T.StructType([T.StructField(n, t) for n, t in (("h", T.IntegerType()), ("v", T.ShortType()), ("f", T.DoubleType()), ("g", T.DoubleType()), ("s", T.StringType()), ("b", T.BinaryType()), ("d", T.DecimalType(38, 0)), ("t", T.TimestampNTZType()), ("l", T.ArrayType(T.IntegerType())), ("st", T.StructType([T.StructField("in_name", T.StringType()), T.StructField("n", T.IntegerType())])))]),
    )
    j = lambda c, *a: or_null(raw_json(F.col(c), row.schema[c].dataType, c, *a))
    got = row.select(j("h", "hex_number", "uint16"), j("h", "hex_number", "uint8"), j("v", "solana_tx_version"), j("v", "hex_number", "uint16"), j("f"), j("g"), j("s"), j("b", "hex_bytes"), j("b", "base58"), j("d", "decimal_string"), j("t", "", "timestamp_second"), j("t", "", "timestamp_millisecond"), j("l"), j("st", "", "", {"n": "decimal_string"})).first()
    assert list(got) == ['"0x0640"', '"0x0000000000000640"', '"legacy"', '"0xffff"', "1.5", "null", '"a\\"é\\n"', '"0x0001"', '"12"', '"5"', "-1", "-1500", "[1,null]", '{"inName":"x","n":"2"}']
    assert base58(b"\0\0\1") == "112"


def test_floats(spark):
    values = {163491654908.9593: "163491654908.9593", 1e15: "1000000000000000.0", 1e16: "1e16", 1.5e300: "1.5e300", 1e-5: "0.00001", -2.5e-5: "-0.000025", 1e-6: "1e-6", 0.1: "0.1", -0.0: "-0.0", 2.0**-44: "5.684341886080802e-14", 3.0: "3.0", float("inf"): "null", float("nan"): "null", None: "null"}
    catalog = parse("version: 1\ndataset: x\ntables:\n  b: {block: n, columns: {n: uint64, f: float64}}")
    df = spark.createDataFrame(list(enumerate(values)), "n long, f double")
    got = lines(execute(spark, {"type": "x", "includeAllBlocks": True, "fields": {"b": {"f": True}}}, catalog, FrameSource({"b": df})))
    text = list(execute(spark, {"type": "x", "includeAllBlocks": True, "fields": {"b": {"f": True}}}, catalog, FrameSource({"b": df})).json_lines())
    assert text == ['{"header":{"f":' + t + "}}\n" for t in values.values()]
    assert [x["header"]["f"] for x in got][:9] == list(values)[:9]


def test_frames_and_files(spark, tmp_path):
    write_chunk(evm_chunk(spark), EVM, f"{tmp_path}/a")
    write_chunk(evm_chunk(spark, 116, 120), EVM, f"{tmp_path}/b")
    source = ParquetSource(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    request = {"type": "evm", "fromBlock": 114, "fields": {"log": {"address": True}, "block": {"number": True}}, "logs": [{}]}
    e = execute(spark, request, EVM, source)
    assert len(lines(e)) == 7
    tables = read_frames(e.arrow_frames(binary_hex=True, compress=True))
    assert list(tables) == ["blocks", "logs"] and len(tables["logs"]) == 28 and len(tables["logs"]["address"][0].as_py()) == 20
    plan = e.direct("logs")[0]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block_number,114)" in plan


def test_json_is_checked(spark):
    catalog = parse("version: 1\ndataset: x\ntables:\n  b: {block: n, columns: {n: uint64, j: string/json_verbatim}}")
    for text, good in (('{"b":1.10,"a":2}', True), ("", True), ("{", False)):
        e = execute(spark, {"type": "x", "includeAllBlocks": True, "fields": {"b": {"j": True}}}, catalog, FrameSource({"b": spark.createDataFrame([(1, text)], "n long, j string")}))
        if good:
            assert list(e.json_lines()) == ['{"header":{"j":' + (text or "null") + "}}\n"]
        else:
            with pytest.raises(Exception, match="MalformedChunkData"):
                list(e.json_lines())


def test_stream(spark, tmp_path):
    write_chunk(evm_chunk(spark), EVM, f"{tmp_path}/a")
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox/1.txt").write_text(f"{tmp_path}/a\n")
    answer_chunks(spark, f"{tmp_path}/inbox", {"type": "evm", "logs": [{}]}, EVM, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.text(f"{tmp_path}/out").count() == 16
