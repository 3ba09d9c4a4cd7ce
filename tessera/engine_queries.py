"""Registered queries of the block engine, each a request over Parquet chunks made of the driver's tables, with its SQL.

A chunk's tables are written once for a session and folder of tables, each at
its first use, and read by every query; they are derived from whole driver
tables. Driver tables are dealt by blocks while they are narrow, once, and wide
columns are derived where the rows are written.
"""

from __future__ import annotations

from collections.abc import Callable

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import Catalog, parse
from tessera.engine import Execution, execute, read_frames
from tessera.errors import QueryError
from tessera.functions.hashing import Fuse8, bloom_build
from tessera.sources.chunks import DerivedSource, FrameSource, ranged, shared_folder

SHOP = """
version: 1
dataset: shop
tables:
  orders:
    request: orders
    output: order
    block: o_orderkey
    parent_hash: parent_hash
    columns: {o_orderkey: uint64, parent_hash: string, o_custkey: uint64/decimal_string, o_orderstatus: string, o_totalprice: float64, o_orderdate: timestamp_second, o_orderpriority: string w=16}
  lineitem:
    request: lines
    output: line
    block: l_orderkey
    order: [seq]
    weight_key: [l_orderkey, seq]
    columns:
      l_orderkey: uint64
      seq: uint32
      l_linenumber: uint8/hex_number
      l_partkey: uint64
      l_suppkey: uint64
      flag: string fold
      status: string
      big: boolean
      note: string
      hexed: string
      tags: list_string
      t0: string
      t1: string
      t2: string
      rest: list_string
      d1: uint8 sys
      d2: uint16 sys
      shipped: timestamp_millisecond
      paid: string w=price_size
      price_size: int64 sys
      doc: string/json_verbatim
      parties: fixed_binary_64 sys
    filters: {code: in hexed, mentions: bloom parties 64 7, flag: in fold, status: in, l_linenumber: in, l_suppkey: in, part_from: gte l_partkey, part_to: lte l_partkey, big: equals, note: in, non_zero: at_least hexed 0x2, tags: in, discriminator: discriminator, d1: in}
    relations:
      payments: {join: payments, keys: [l_orderkey, l_linenumber], to: [p_order, p_line]}
      same_note: {join: lineitem, keys: [l_orderkey, note]}
      siblings: {join: lineitem, keys: [l_orderkey, l_linenumber]}
    rolls:
      topics: [t0, t1, t2, rest]
    variant_column: status
    variants:
      F: {result: {paid: amount}, _: {hexed: code}}
      O: {open: {note: remark}}
  payments:
    request: payments
    output: payment
    block: p_order
    order: [p_line, p_supplier]
    columns: {p_order: uint64, p_line: uint32, p_supplier: uint64, mode: string}
    filters: {mode: in}
    relations:
      lines: {join: lineitem, keys: [p_order, p_line], to: [l_orderkey, l_linenumber]}
aliases:
  returnedLines:
    table: lineitem
    implicit: {flag: [r]}
    filters: {line: in l_linenumber, supplier: in l_suppkey}
    relations:
      payments: {join: payments, keys: [l_orderkey, l_linenumber], to: [p_order, p_line]}
"""

TREE = """
version: 1
dataset: tree
tables:
  sizes:
    request: sizes
    output: size
    block: number
    columns: {number: uint64}
  nodes:
    request: nodes
    output: node
    block: size
    order: [part]
    address: path
    columns: {size: uint64, part: uint64, path: list_uint32, brand: string}
    filters: {brand: in, part: in}
    relations:
      below: {children: nodes, keys: [size, path]}
      above: {parents: nodes, keys: [size, path]}
      marks: {children: marks, keys: [size, path], to: [size, spot]}
      roots: {parents: marks, keys: [size, path], to: [size, spot]}
      exact: {join: marks, keys: [size, path], to: [size, spot]}
  marks:
    request: marks
    output: mark
    block: size
    order: [id]
    address: spot
    columns: {size: uint64, id: uint64, spot: list_uint32}
    filters: {id: in}
"""


LAB = """
version: 1
dataset: lab
tables:
  sizes:
    request: sizes
    output: size
    block: number
    columns: {number: uint64}
  things:
    request: things
    output: thing
    block: size
    order: [part]
    columns:
      size: uint64
      part: uint64
      price: float64
      raw: string/hex_bytes
      hash: string/hex_bytes
      token: string/base58
      version: int16/solana_tx_version
      digits: list_uint32
      words: list_string
      dims: "struct members={'big_number': {'encoding': 'decimal_string'}}"
      boxes: list_struct
      delta: int16
      code: fixed_binary_4 sys
      flag: boolean
    filters: {delta: in, code: in, flag: equals, part: in, raw: in}
"""


def _parties(supplier: Column, part: Column) -> Column:
    """A bloom filter of each line's supplier and part, as an archive's writer would store it."""

    @F.pandas_udf("binary")
    def build(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([bloom_build([v for v in pair if v is not None], 64, 7) for pair in zip(a, b)], dtype=object)

    return build(F.concat(F.lit("s"), supplier), F.concat(F.lit("p"), part))


def catalogs() -> dict[str, Catalog]:
    return {"shop": parse(SHOP), "tree": parse(TREE), "lab": parse(LAB)}


def shop(spark: SparkSession, sf_dir: str) -> FrameSource:
    """Orders as blocks, line items and payments as items; nulls, lists and sizes derived."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders = ranged(o, "o_orderkey", o.count()).sortWithinPartitions("o_orderkey").withColumn("parent_hash", F.concat(F.lit("h"), F.col("o_orderkey") - 1))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = li.count()
    own = ranged(li.select("l_orderkey", *order, "l_returnflag", "l_linestatus"), "l_orderkey", rows).sortWithinPartitions("l_orderkey", *order)
    # Numbered before anything else is derived: behind an Arrow function the rows' ranges would be unknown, and dealt again.
    own = own.withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    quantity = F.col("l_quantity").cast("int")
    lines = own.select(
        "l_orderkey", "seq", "l_linenumber", "l_partkey", "l_suppkey",
        F.lower("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.col("l_quantity") > 25).alias("big"),
        F.nullif("l_returnflag", F.lit("N")).alias("note"), F.concat(F.lit("0x"), F.lower(F.hex(quantity))).alias("hexed"),
        F.array("l_returnflag", "l_linestatus").alias("tags"), F.col("l_returnflag").alias("t0"), F.nullif("l_linestatus", F.lit("O")).alias("t1"), F.lit("x").alias("t2"), F.array(F.lit("y"), F.lit("z")).alias("rest"),
        F.col("l_linenumber").alias("d1"), (F.col("l_linenumber") * 256 + quantity).alias("d2"),
        F.col("l_shipdate").alias("shipped"), F.col("l_extendedprice").cast("bigint").cast("string").alias("paid"), F.col("l_extendedprice").cast("bigint").alias("price_size"),
        F.when(quantity % 2 == 0, F.concat(F.lit('{"q":'), quantity, F.lit("}"))).otherwise(F.lit("")).alias("doc"), _parties(F.col("l_suppkey"), F.col("l_partkey")).alias("parties"),
    )
    pay = li.filter(F.col("l_linenumber") != 2).select(F.col("l_orderkey").alias("p_order"), F.col("l_linenumber").alias("p_line"), F.col("l_suppkey").alias("p_supplier"))
    pay = ranged(pay, "p_order", rows).distinct().sortWithinPartitions("p_order", "p_line", "p_supplier").withColumn("mode", F.when(F.col("p_supplier") % 2 == 0, "cash").otherwise("card"))
    return FrameSource({"orders": orders, "lineitem": lines, "payments": pay}, laid_out=("orders", "lineitem", "payments"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in ranges of their sizes, which are blocks, ordered by key."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return ranged(p, "p_size", p.count()).sortWithinPartitions("p_size", "p_partkey")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("number")).distinct()


def tree(spark: SparkSession, sf_dir: str) -> FrameSource:
    """Parts as nodes of digit paths: a part is below another of its size if its number extends the other's."""
    p = _parts(spark, sf_dir)
    digits = F.transform(F.split(F.col("p_partkey").cast("string"), ""), lambda x: x.cast("int"))
    nodes = p.select(F.col("p_size").alias("size"), F.col("p_partkey").alias("part"), digits.alias("path"), F.col("p_brand").alias("brand"))
    marks = nodes.select("size", F.col("part").alias("id"), F.col("path").alias("spot"))
    return FrameSource({"sizes": _sizes(spark, sf_dir), "nodes": nodes, "marks": marks}, laid_out=("nodes", "marks"))


def lab(spark: SparkSession, sf_dir: str) -> FrameSource:
    """Parts as rows of every kind of value: floats with gaps, binaries, signed numbers, lists, structs and lists of structs."""
    p = _parts(spark, sf_dir)
    key, name = F.col("p_partkey"), F.col("p_name")
    wide = F.lpad(F.hex(key + 16777216), 8, "0")
    box = lambda i, label: F.struct(F.lit(i).alias("box_number"), label.alias("label"))
    things = p.select(
        F.col("p_size").alias("size"), key.alias("part"), F.when(key % 11 == 0, F.lit(float("nan"))).when(key % 7 > 0, F.col("p_retailprice")).alias("price"),
        name.cast("binary").alias("raw"), F.concat(F.lit("0x"), F.lower(F.hex(name))).alias("hash"), F.unhex(wide).alias("token"), (key % 3 - 1).cast("short").alias("version"),
        F.transform(F.split(key.cast("string"), ""), lambda x: x.cast("int")).alias("digits"), F.split(name, " ").alias("words"),
        F.struct(F.col("p_size").alias("size_mm"), (key * 1000003).alias("big_number")).alias("dims"),
        F.when(key % 5 > 0, F.array(box(1, F.col("p_brand")), box(2, F.lit(None).cast("string")))).alias("boxes"),
        (key % 9 - 4).cast("short").alias("delta"), F.unhex(F.lpad(F.hex(key % 50), 8, "0")).alias("code"), (key % 4).cast("int").alias("flag"),
    )
    return FrameSource({"sizes": _sizes(spark, sf_dir), "things": things}, laid_out=("things",))


#: Datasets' tables as they are derived, and the chunks written of them by session and folder.
_DERIVED = {"shop": shop, "tree": tree, "lab": lab}
_chunks: dict[tuple[str, str, str], DerivedSource] = {}


def chunk(spark: SparkSession, sf_dir: str, dataset: str) -> DerivedSource:
    """The dataset's Parquet chunk, laid out for skipping, its tables written at their first use."""
    at = (spark.sparkContext.applicationId, sf_dir, dataset)
    if at not in _chunks:
        path = f"{shared_folder(spark)}/chunk-{dataset}-{uuid.uuid4().hex}"
        _chunks[at] = DerivedSource(spark, path, _DERIVED[dataset](spark, sf_dir), catalogs()[dataset])
    return _chunks[at]


def _run(spark: SparkSession, sf_dir: str, dataset: str, budget: int | None = None, **request) -> Execution:
    return execute(spark, {"type": dataset, **request}, catalogs()[dataset], chunk(spark, sf_dir, dataset), budget)


def _rows(e: Execution, table: str, *columns: str) -> DataFrame:
    found = e.items(e.query.catalog.tables[table])
    if found is None:
        found = e.source.table(table).filter(F.lit(False))
    return found.select(*columns)


LINE = ("l_orderkey", "seq")
#: Names of queries to their (function, SQL).
_REGISTRY: dict[str, tuple[Callable, str | None]] = {}

LINES_SQL = """
li AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS seq,
  l_linenumber, l_partkey, l_suppkey, lower(l_returnflag) AS flag, l_linestatus AS status, l_quantity > 25 AS big, nullif(l_returnflag, 'N') AS note,
  CAST(l_quantity AS INTEGER) AS quantity, CAST(trunc(l_extendedprice) AS BIGINT) AS price_size, l_returnflag AS t0, nullif(l_linestatus, 'O') AS t1, l_shipdate FROM lineitem),
pay AS (SELECT DISTINCT l_orderkey AS p_order, l_linenumber AS p_line, l_suppkey AS p_supplier, CASE WHEN l_suppkey % 2 = 0 THEN 'cash' ELSE 'card' END AS mode FROM lineitem WHERE l_linenumber <> 2)
"""
NODES_SQL = "nodes AS (SELECT p_size AS size, p_partkey AS part, CAST(p_partkey AS VARCHAR) AS path, p_brand AS brand FROM part), marks AS (SELECT size, part AS id, path AS spot FROM nodes)"


def _lines_query(name: str, where: str, **request) -> None:
    _REGISTRY[name] = (lambda s, d: _rows(_run(s, d, "shop", **request), "lineitem", *LINE), f"WITH {LINES_SQL} SELECT l_orderkey, seq FROM li WHERE {where}")


_lines_query("filter_inlist", "status IN ('F') AND l_linenumber IN (1, 3)", lines=[{"status": ["F"], "lLinenumber": [1, 3]}])
_lines_query("filter_inlist_fold", "flag IN ('r', 'a')", lines=[{"flag": ["R", "A"]}])
_lines_query("filter_hex_number", "l_linenumber = 4", lines=[{"lLinenumber": ["0x04", "0x0004"]}])
_lines_query("filter_scalar", "status = 'O'", lines=[{"status": "O"}])
_lines_query("filter_empty_list", "false", lines=[{"status": []}])
_lines_query("filter_out_of_range", "false", lines=[{"lLinenumber": [999]}])
_lines_query("filter_range", "l_partkey BETWEEN 20 AND 60", lines=[{"partFrom": 20, "partTo": 60}])
_lines_query("filter_at_least", "'0x' || lower(hex(quantity)) >= '0x2'", lines=[{"nonZero": True}])
_lines_query("filter_equals_bool", "big", lines=[{"big": True}])
_lines_query("filter_null", "note = 'R'", lines=[{"note": ["R"]}])
_lines_query("filter_list_contains_any", "t0 = 'A' OR status = 'F'", lines=[{"tags": ["A", "F"]}])
_lines_query("filter_discriminator", "l_linenumber = 3 OR l_linenumber * 256 + quantity = 1282", lines=[{"discriminator": ["0x03", "0x0502"]}])
_lines_query("items_union", "(flag = 'r' AND big) OR l_linenumber = 1", lines=[{"flag": ["r"], "big": True}, {"lLinenumber": [1]}])
_lines_query("alias_items", "flag = 'r' AND l_linenumber IN (1, 2)", returnedLines=[{"line": [1, 2]}])
_lines_query("alias_and_table", "(flag = 'r' AND l_linenumber = 1) OR status = 'O'", returnedLines=[{"line": [1]}], lines=[{"status": ["O"]}])
_lines_query("block_range", "l_orderkey BETWEEN 10 AND 500", lines=[{}], fromBlock=10, toBlock=500)
_lines_query("relation_null_key", "EXISTS (SELECT 1 FROM li s WHERE s.l_linenumber = 1 AND s.l_orderkey = li.l_orderkey AND s.note = li.note) OR l_linenumber = 1", lines=[{"lLinenumber": [1], "sameNote": True}])
# Both structures may hold more than they were built from; with these values and seeds they don't.
_lines_query("filter_bloom", "l_suppkey = 3 OR l_partkey = 77", lines=[{"mentions": ["s3", "p77"]}])
_CODES = ["0x1", "0xa", "0x1f"]
_lines_query("filter_set_fuse8", "'0x' || lower(hex(quantity)) IN ('0x1', '0xa', '0x1f') OR quantity = 2", fields={"line": {"hexed": True}}, sets={"s": {"fuse8": Fuse8.build(_CODES).encode(), "canaries": _CODES[:1]}}, lines=[{"code": [{"set": "s"}, "0x2"]}])
_lines_query(
    "relation_scoped",
    "flag = 'r' OR l_linenumber = 5 OR EXISTS (SELECT 1 FROM li s WHERE s.flag = 'r' AND s.l_orderkey = li.l_orderkey AND s.note = li.note)",
    lines=[{"flag": ["r"], "sameNote": True}, {"lLinenumber": [5]}],
)


def _payments(name: str, where: str, **request) -> None:
    _REGISTRY[name] = (lambda s, d: _rows(_run(s, d, "shop", **request), "payments", "p_order", "p_line", "p_supplier"), f"WITH {LINES_SQL} SELECT p_order, p_line, p_supplier FROM pay WHERE {where}")


_REACH = "EXISTS (SELECT 1 FROM li WHERE {} AND l_orderkey = p_order AND l_linenumber = p_line)"
_payments("relation_join", _REACH.format("flag = 'r'"), lines=[{"flag": ["r"], "payments": True}])
_payments("items_dedup", _REACH.format("big") + " OR mode = 'cash'", lines=[{"big": True, "payments": True}], payments=[{"mode": ["cash"]}])
_payments("relation_one_hop", _REACH.format("l_linenumber = 1"), lines=[{"lLinenumber": [1], "payments": True, "siblings": True}], payments=[])
_payments("relation_merged", _REACH.format("(flag = 'r' OR l_linenumber = 5)"), lines=[{"flag": ["r"], "payments": True}, {"lLinenumber": [5], "payments": True}])
_payments("relation_empty_source", "false", lines=[{"status": ["none"], "payments": True}])
_payments("relation_range", _REACH.format("flag = 'r'") + " AND p_order BETWEEN 100 AND 2000", lines=[{"flag": ["r"], "payments": True}], fromBlock=100, toBlock=2000)
_payments("relation_alias", _REACH.format("flag = 'r' AND l_suppkey = 3"), returnedLines=[{"supplier": [3], "payments": True}])


#: Half the brands, whatever the parts' ids, are the sources of the hierarchies.
_BRANDS = [f"Brand#{k}" for k in range(1, 26, 2)]
_BRAND = f"brand IN ({', '.join(map(repr, _BRANDS))})"
_FROM = f"EXISTS (SELECT 1 FROM nodes s WHERE s.{_BRAND} AND s.size = t.size AND {{}})"


def _nodes(name: str, table: str, column: str, where: str, **relation) -> None:
    sql = f"WITH {NODES_SQL} SELECT size, {column} FROM {table} t WHERE {where}"
    _REGISTRY[name] = (lambda s, d: _rows(_run(s, d, "tree", nodes=[{"brand": _BRANDS, **relation}]), table, "size", column), sql)


_nodes("relation_children", "nodes", "part", f"{_BRAND} OR " + _FROM.format("starts_with(t.path, s.path) AND length(t.path) > length(s.path)"), below=True)
_nodes("relation_parents", "nodes", "part", f"{_BRAND} OR " + _FROM.format("starts_with(s.path, t.path) AND length(s.path) > length(t.path)"), above=True)
_nodes("relation_cross_children", "marks", "id", _FROM.format("starts_with(t.spot, s.path)"), marks=True)
_nodes("relation_cross_parents", "marks", "id", _FROM.format("starts_with(s.path, t.spot)"), roots=True)
_nodes("relation_list_key", "marks", "id", _FROM.format("s.path = t.spot"), exact=True)

_HEAVY = {"fields": {"line": {"paid": True, "status": True}, "order": {"oOrderpriority": True}}, "lines": [{"flag": ["r"]}]}
_WEIGHTS = f"""WITH {LINES_SQL}, w AS (
  SELECT o_orderkey AS block, 32 + 16 AS weight FROM orders
  UNION ALL SELECT l_orderkey, 96 + greatest(price_size, 0) FROM li WHERE flag = 'r'
), cand AS (
  SELECT l_orderkey AS block FROM li WHERE flag = 'r' UNION SELECT min(o_orderkey) FROM orders UNION SELECT max(o_orderkey) FROM orders
), blocks AS (SELECT block, CAST(sum(weight) AS BIGINT) AS weight FROM w WHERE block IN (SELECT block FROM cand) GROUP BY block)"""
_BUDGET = 2_000_000


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "shop", **_HEAVY).weights().select("block", F.col("weight").cast("long").alias("weight"))


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "shop", _BUDGET, **_HEAVY).page().select("block", F.col("weight").cast("long").alias("weight"), F.col("total").cast("long").alias("total"))


def _resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after the first."""
    last = _run(spark, sf_dir, "shop", _BUDGET, **_HEAVY).last_block()
    return _run(spark, sf_dir, "shop", _BUDGET, **_HEAVY, fromBlock=last + 1).page().select("block", F.col("weight").cast("long").alias("weight"), F.col("total").cast("long").alias("total"))


_SUMMED = "SELECT block, weight, CAST(sum(weight) OVER (ORDER BY block) AS BIGINT) AS total FROM {}"
_REGISTRY["block_weight"] = (_weights, f"{_WEIGHTS} SELECT block, weight FROM blocks")
_REGISTRY["page_budget"] = (_page, f"{_WEIGHTS} SELECT * FROM ({_SUMMED.format('blocks')}) WHERE total <= {_BUDGET} OR total = weight")
_REGISTRY["page_resume"] = (
    _resumed,
    f"""{_WEIGHTS}, first AS (SELECT max(block) AS last FROM ({_SUMMED.format("blocks")}) WHERE total <= {_BUDGET} OR total = weight),
  edge AS (SELECT min(o_orderkey) AS block FROM orders, first WHERE o_orderkey > last),
  again AS (SELECT * FROM blocks, first WHERE block > last UNION BY NAME
            SELECT block, CAST(48 AS BIGINT) AS weight, last FROM edge, first WHERE block NOT IN (SELECT block FROM blocks))
  SELECT block, weight, total FROM ({_SUMMED.format("again")}) WHERE total <= {_BUDGET} OR total = weight""",
)


def _boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "shop", lines=[{"lLinenumber": [7], "big": True}]).weights().select("block")


def _all_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "shop", includeAllBlocks=True, lines=[{"lLinenumber": [7]}]).weights().select("block")


_REGISTRY["boundary_blocks"] = (_boundary, f"WITH {LINES_SQL} SELECT l_orderkey AS block FROM li WHERE l_linenumber = 7 AND big UNION SELECT min(o_orderkey) FROM orders UNION SELECT max(o_orderkey) FROM orders")
_REGISTRY["include_all_blocks"] = (_all_blocks, "SELECT o_orderkey AS block FROM orders")


def _lines_of(name: str, sql: str, budget: int | None = None, **request) -> None:
    _REGISTRY[name] = (lambda s, d: _run(s, d, "shop", budget, **request).lines(), sql)


def _blocks_sql(item: str, order: str = "seq", where: str = "l_linenumber = 1", header: str = "'{}'") -> str:
    return f"""WITH {LINES_SQL}, own AS (SELECT l_orderkey AS block, string_agg({item}, ',' ORDER BY {order}) AS items FROM li WHERE {where} GROUP BY 1),
  cand AS (SELECT block FROM own UNION SELECT min(o_orderkey) FROM orders UNION SELECT max(o_orderkey) FROM orders)
  SELECT o_orderkey AS block, '{{"header":' || {header} || coalesce(',"lines":[' || items || ']', '') || '}}' AS line
  FROM orders JOIN cand ON cand.block = o_orderkey LEFT JOIN own ON own.block = o_orderkey"""


_ROLL = """'{"topics":["' || t0 || '"' || coalesce(',"' || t1 || '","x","y","z"', '') || ']}'"""
_lines_of("roll_field", _blocks_sql(_ROLL), fields={"line": {"topics": True}}, lines=[{"lLinenumber": [1]}])
_VARIANT = """'{"lPartkey":' || l_partkey || CASE status WHEN 'F' THEN ',"result":{"amount":"' || price_size || '"},"code":"0x' || lower(hex(quantity)) || '"'
  WHEN 'O' THEN ',"open":{"remark":' || coalesce('"' || note || '"', 'null') || '}' ELSE '' END || '}'"""
_lines_of("variants", _blocks_sql(_VARIANT), fields={"line": {"lPartkey": True, "paid": True, "hexed": True, "note": True}}, lines=[{"lLinenumber": [1]}])
_ENCODED = """'{"lLinenumber":"0x' || lpad(lower(hex(l_linenumber)), 2, '0') || '","shipped":' || epoch_ms(l_shipdate) || ',"doc":' || CASE WHEN quantity % 2 = 0 THEN '{"q":' || quantity || '}' ELSE 'null' END || '}'"""
_lines_of("encodings", _blocks_sql(_ENCODED), fields={"line": {"lLinenumber": True, "shipped": True, "doc": True}}, lines=[{"lLinenumber": [1]}])
_HEADER = """'{"oOrderkey":' || o_orderkey || ',"oCustkey":"' || o_custkey || '","oOrderdate":' || CAST(epoch(o_orderdate) AS BIGINT) || '}'"""
_lines_of(
    "ndjson_block",
    _blocks_sql("""'{"seq":' || seq || ',"status":"' || status || '","big":' || CAST(big AS VARCHAR) || '}'""", where="flag = 'r'", header=_HEADER),
    fields={"order": {"oOrderkey": True, "oCustkey": True, "oOrderdate": True}, "line": {"seq": True, "status": True, "big": True}},
    lines=[{"flag": ["R"]}],
)
_lines_of("empty_items", _blocks_sql("'{}'", where="l_linenumber = 2"), lines=[{"lLinenumber": [2]}])


_lines_of(
    "two_tables",
    f"""WITH {LINES_SQL}, own AS (SELECT l_orderkey AS block, string_agg('{{"seq":' || seq || '}}', ',' ORDER BY seq) AS items FROM li WHERE flag = 'r' GROUP BY 1),
  paid AS (SELECT p_order AS block, string_agg('{{"pLine":' || p_line || ',"mode":"' || mode || '"}}', ',' ORDER BY p_line, p_supplier) AS items FROM pay
    WHERE EXISTS (SELECT 1 FROM li WHERE flag = 'r' AND l_orderkey = p_order AND l_linenumber = p_line) GROUP BY 1),
  cand AS (SELECT block FROM own UNION SELECT block FROM paid UNION SELECT min(o_orderkey) FROM orders UNION SELECT max(o_orderkey) FROM orders)
  SELECT o_orderkey AS block, '{{"header":{{"oOrderkey":' || o_orderkey || '}}' || coalesce(',"lines":[' || own.items || ']', '') || coalesce(',"payments":[' || paid.items || ']', '') || '}}' AS line
  FROM orders JOIN cand ON cand.block = o_orderkey LEFT JOIN own ON own.block = o_orderkey LEFT JOIN paid ON paid.block = o_orderkey""",
    fields={"order": {"oOrderkey": True}, "line": {"seq": True}, "payment": {"pLine": True, "mode": True}},
    lines=[{"flag": ["r"], "payments": True}],
)


def _things(name: str, field: str, sql: str, where: str = "true", **tests) -> None:
    """A field of the lab's things as it is rendered, one line per block."""
    sql = f"""WITH t AS (SELECT p_size AS block, p_partkey AS part, string_agg('{{"{field}":' || {sql} || '}}', ',' ORDER BY p_partkey) OVER (PARTITION BY p_size ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS items FROM part WHERE {where}),
  own AS (SELECT DISTINCT block, items FROM t), cand AS (SELECT block FROM own UNION SELECT min(p_size) FROM part UNION SELECT max(p_size) FROM part)
  SELECT cand.block AS block, '{{"header":{{}}' || coalesce(',"things":[' || items || ']', '') || '}}' AS line FROM cand LEFT JOIN own ON own.block = cand.block"""
    _REGISTRY[name] = (lambda s, d: _run(s, d, "lab", fields={"thing": {field: True}}, things=[tests]).lines(), sql)


_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_DIGIT58 = " || ".join(f"substr('{_BASE58}', CAST(((p_partkey + 16777216) // {58**k}) % 58 AS INTEGER) + 1, 1)" for k in (4, 3, 2, 1, 0))
_things("encode_float", "price", "CASE WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 0 THEN 'null' ELSE CAST(p_retailprice AS VARCHAR) END")
_things("encode_hex_binary", "raw", """'"0x' || lower(hex(p_name)) || '"'""")
_things("encode_hex_text", "hash", """'"0x' || lower(hex(p_name)) || '"'""")
_things("encode_base58", "token", f"""'"' || {_DIGIT58} || '"'""")
_things("encode_version", "version", """CASE p_partkey % 3 WHEN 0 THEN '"legacy"' ELSE CAST(p_partkey % 3 - 1 AS VARCHAR) END""")
_things("encode_list_numbers", "digits", "'[' || array_to_string(string_split(CAST(p_partkey AS VARCHAR), ''), ',') || ']'")
_things("encode_list_texts", "words", """'["' || replace(p_name, ' ', '","') || '"]'""")
_things("encode_struct", "dims", """'{"sizeMm":' || p_size || ',"bigNumber":"' || p_partkey * 1000003 || '"}'""")
_things("encode_list_struct", "boxes", """CASE WHEN p_partkey % 5 = 0 THEN 'null' ELSE '[{"boxNumber":1,"label":"' || p_brand || '"},{"boxNumber":2,"label":null}]' END""")
_things("filter_signed", "part", "p_partkey", "p_partkey % 9 - 4 IN (-4, -1, 2)", delta=[-4, -1, 2])
_things("filter_fixed_binary", "part", "p_partkey", "p_partkey % 50 IN (7, 31)", code=["0x00000007", "0x0000001f"])
_things("filter_number_flag", "part", "p_partkey", "p_partkey % 4 = 1", flag=True)
_things("filter_number_flag_false", "part", "p_partkey", "p_partkey % 4 <> 1", flag=False)


def _page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of the first page as they are rendered: wide columns are read up to its last block only."""
    return _run(spark, sf_dir, "shop", _BUDGET, **_HEAVY).lines()


_PAGE = f"{_WEIGHTS}, page AS (SELECT block FROM ({_SUMMED.format('blocks')}) WHERE total <= {_BUDGET} OR total = weight)"
_REGISTRY["page_lines"] = (
    _page_lines,
    f"""{_PAGE}, own AS (SELECT l_orderkey AS block, string_agg('{{"status":"' || status || '"' || CASE status WHEN 'F' THEN ',"result":{{"amount":"' || price_size || '"}}' ELSE '' END || '}}', ',' ORDER BY seq) AS items FROM li WHERE flag = 'r' GROUP BY 1)
  SELECT o_orderkey AS block, '{{"header":{{"oOrderpriority":"' || o_orderpriority || '"}}' || coalesce(',"lines":[' || items || ']', '') || '}}' AS line
  FROM orders JOIN page ON page.block = o_orderkey LEFT JOIN own ON own.block = o_orderkey""",
)


def _arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of each framed Arrow stream of a page with related tables, in the streams' order."""
    e = _run(spark, sf_dir, "shop", _BUDGET, fields={"line": {"seq": True}, "payment": {"mode": True}}, lines=[{"flag": ["r"], "payments": True}])
    frames = read_frames(e.arrow_frames(compress=True))
    return spark.createDataFrame([(i, n, len(t), ",".join(t.column_names)) for i, (n, t) in enumerate(frames.items())], "place long, name string, n long, columns string")


_REGISTRY["arrow_frames"] = (
    _arrow,
    f"""WITH {LINES_SQL}, reach AS (SELECT * FROM pay WHERE EXISTS (SELECT 1 FROM li WHERE flag = 'r' AND l_orderkey = p_order AND l_linenumber = p_line)),
  w AS (SELECT o_orderkey AS block, 32 AS weight FROM orders UNION ALL SELECT l_orderkey, 64 FROM li WHERE flag = 'r' UNION ALL SELECT p_order, 128 FROM reach),
  cand AS (SELECT l_orderkey AS block FROM li WHERE flag = 'r' UNION SELECT min(o_orderkey) FROM orders UNION SELECT max(o_orderkey) FROM orders),
  blocks AS (SELECT block, CAST(sum(weight) AS BIGINT) AS weight FROM w WHERE block IN (SELECT block FROM cand) GROUP BY block),
  page AS (SELECT block FROM ({_SUMMED.format("blocks")}) WHERE total <= {_BUDGET} OR total = weight)
  SELECT 0 AS place, 'orders' AS name, count(*) AS n, 'o_orderkey' AS columns FROM page
  UNION ALL SELECT 1, 'lineitem', count(*), 'l_orderkey,seq' FROM li JOIN page ON l_orderkey = block WHERE flag = 'r'
  UNION ALL SELECT 2, 'payments', count(*), 'p_order,mode' FROM reach JOIN page ON p_order = block""",
)


def _arrow_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex texts as bytes in a framed Arrow stream."""
    e = _run(spark, sf_dir, "lab", 1 << 40, fields={"thing": {"part": True, "hash": True}}, things=[{}])
    found = read_frames(e.arrow_frames(binary_hex=True))["things"]
    return spark.createDataFrame(found.select(["part", "hash"])).select("part", F.hex("hash").alias("hex"))


_REGISTRY["arrow_hex_to_binary"] = (_arrow_hex, "SELECT p_partkey AS part, hex(p_name) AS hex FROM part")

#: Requests that are refused, with the kind of error that says so.
_REFUSED = [
    ("UnknownTable", "shop", {"nothing": [{}]}), ("UnknownFilter", "shop", {"lines": [{"nothing": [1]}]}), ("UnknownField", "shop", {"fields": {"line": {"nothing": True}}, "lines": [{}]}),
    ("InvalidBlockRange", "shop", {"fromBlock": 9, "toBlock": 3, "lines": [{}]}), ("InvalidFilterValue", "shop", {"lines": [{"big": "yes"}]}), ("TooManyItemRequests", "shop", {"lines": [{}] * 101}),
    ("UnexpectedBaseBlock", "shop", {"fromBlock": 500, "parentBlockHash": "stale", "lines": [{}]}), ("InvalidFilterValue", "lab", {"things": [{"delta": ["x"]}]}),
]


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    for i, (_, dataset, request) in enumerate(_REFUSED):
        try:
            _run(spark, sf_dir, dataset, **request)
            found.append((i, "accepted"))
        except QueryError as e:
            found.append((i, e.kind))
    return spark.createDataFrame(found, "number long, kind string")


_REGISTRY["refused_requests"] = (_refused, "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}')" for i, (k, _, _) in enumerate(_REFUSED)) + ") t(number, kind)")


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columnar rendering of the same rows."""
    e = _run(spark, sf_dir, "shop", fields={"line": {"paid": True, "topics": True}}, lines=[{"lLinenumber": [3]}])
    return e.tables()["lineitem"].select("l_orderkey", "paid", "t0", "t1", F.array_join("rest", ",").alias("rest"))


_REGISTRY["flat_tables"] = (_flat, f"WITH {LINES_SQL} SELECT l_orderkey, CAST(price_size AS VARCHAR) AS paid, t0, t1, 'y,z' AS rest FROM li WHERE l_linenumber = 3")


def _fork(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client with a stale parent hash learns: the recent blocks and their hashes."""
    try:
        _run(spark, sf_dir, "shop", fromBlock=500, toBlock=600, parentBlockHash="stale", lines=[{}])
    except QueryError as e:
        return spark.createDataFrame([(n, h) for n, h in e.blocks], "number long, hash string")
    return spark.createDataFrame([], "number long, hash string")


_REGISTRY["fork_check"] = (_fork, "SELECT o_orderkey - 1 AS number, 'h' || (o_orderkey - 1) AS hash FROM orders WHERE o_orderkey BETWEEN 401 AND 500")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _REGISTRY.items() if sql}
