"""The engine: a request over a source of tables to an answer of blocks.

Selection works on narrow columns: keys and sizes give each candidate block a
weight, and the page is the prefix of blocks that the budget allows. The wide
columns are then read for blocks up to the page's last one only.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from tessera.catalog import Catalog, Table
from tessera.errors import QueryError
from tessera.functions.encode import item_json
from tessera.functions.predicates import is_integer, item_expression
from tessera.operators.forks import check_parent
from tessera.operators.relations import comparable, related
from tessera.operators.weights import block_weights, fixed_weight, page, row_weight, size_columns
from tessera.plans.planner import Plan, compile_query
from tessera.plans.request import Query, parse_query
from tessera.sources.chunks import TableSource

BUDGET = 20 << 20


@dataclass
class Execution:
    """A compiled request bound to a source; frames are built on demand."""

    spark: SparkSession
    plan: Plan
    source: TableSource
    budget: int | None = BUDGET
    _last: int | None = field(default=None, init=False)
    _paged: bool = field(default=False, init=False)
    _keys: dict[str, DataFrame] = field(default_factory=dict, init=False)

    # ---- checks ---------------------------------------------------------

    @property
    def query(self) -> Query:
        return self.plan.query

    def prepare(self) -> "Execution":
        """Everything that can be refused before rows are read, then the fork check."""
        block = self.query.catalog.block_table
        for t in [block, *self.plan.output_tables()]:
            df = self.source.table(t.name)
            kind = df.schema[t.block].dataType if t.block in df.columns else None
            if kind is None:
                raise QueryError("ColumnNotFound", f"{t.name} has no column {t.block}", t.block)
            if not is_integer(kind):
                raise QueryError("MalformedChunkData", f"{t.name}.{t.block} is stored as {kind.simpleString()}", t.block)
            if self.source.holds_null(t.name, t.block):
                raise QueryError("MalformedChunkData", f"{t.name}.{t.block} holds a null", t.block)
            shown = self.query.selected(t)
            need = [c for f in shown for c in t.fields()[f]] + size_columns(t, shown)
            varied = {c for groups in t.variants.values() for own in groups.values() for c in own}
            need += [t.variant_column] if varied & set(need) else []
            for c in need:
                if c not in df.columns:
                    raise QueryError("ColumnNotFound", f"{t.name} has no column {c}", c)
            item_json(t, shown, df.schema)  # refuses what no encoding renders
        for p in self.plan.tables.values():
            df = self.source.table(p.table.name)
            for item in p.items:
                for c in (c for test in item.tests for c in test.columns()):
                    if c not in df.columns:
                        raise QueryError("ColumnNotFound", f"{p.table.name} has no column {c}", f"{item.path}.{c}")
                item_expression(item, df.schema)
            for r in p.relations:
                target = self.source.table(r.relation.target)
                for frame, names, at in ((df, r.relation.left, p.table.name), (target, r.relation.right, r.relation.target)):
                    for c in names:
                        if c not in frame.columns:
                            raise QueryError("ColumnNotFound", f"{at} has no column {c}", c)
                        comparable(frame, c)
        check_parent(self.query, self.source)
        return self

    # ---- selection ------------------------------------------------------

    def _in_range(self, table: Table, last: int | None = None) -> DataFrame:
        """Rows of the block range, by bare comparisons that reach the scan."""
        df = self.source.table(table.name)
        kind, number = df.schema[table.block].dataType, F.col(f"`{table.block}`")
        top = 1 << 64 if isinstance(kind, T.DecimalType) else {T.ByteType: 1 << 7, T.ShortType: 1 << 15, T.IntegerType: 1 << 31}.get(type(kind), 1 << 63)
        low = self.query.from_block
        high = min([x for x in (self.query.to_block, last) if x is not None], default=None)
        if low >= top:
            return df.filter(F.lit(False))
        literal = lambda v: F.lit(v) if v < 1 << 63 else F.expr(f"{v}BD")
        df = df.filter(number >= literal(low))
        return df.filter(number <= literal(high)) if high is not None and high < top else df

    def headers(self, last: int | None = None) -> DataFrame:
        return self._in_range(self.query.catalog.block_table, last)

    def direct(self, name: str, last: int | None = None) -> tuple[DataFrame, list[Expr]]:
        """Rows that any item of a table takes, and each item's own condition."""
        p = self.plan.tables[name]
        df = self._in_range(p.table, last)
        tests = [item_expression(i, df.schema) for i in p.items]
        return df.filter(reduce(lambda a, b: a | b, tests)), tests

    def items(self, table: Table, last: int | None = None) -> DataFrame | None:
        """A table's rows in the answer, each once: taken by items or reached by relations."""
        parts = []
        if table.name in self.plan.tables:
            parts.append(self.direct(table.name, last)[0])
        for p in self.plan.tables.values():
            for r in p.relations:
                if r.relation.target != table.name:
                    continue
                source, tests = self.direct(p.table.name, last)
                if r.items is not None:  # only rows of the items that asked
                    source = source.filter(reduce(lambda a, b: a | b, [tests[i] for i in r.items]))
                parts.append(related(source, p.table, self._in_range(table, last), table, r.relation))
        if not parts:
            return None
        out = reduce(lambda a, b: a.unionByName(b), parts)
        return out.dropDuplicates(list(table.key)) if len(parts) > 1 else out

    def _selected(self, table: Table, last: int | None = None) -> DataFrame:
        """A table's rows in the answer up to a block.

        Rows that relations reach are selected once: their keys and weights are
        kept, and later passes look the wide columns up by key. Rows that only
        items take are found again by their filters, which reach the scan.
        """
        if not any(r.relation.target == table.name for p in self.plan.tables.values() for r in p.relations):
            return self.items(table, last)
        if table.name not in self._keys:
            weight = row_weight(table, self.query.selected(table)).alias("__weight")
            self._keys[table.name] = self.items(table).select(*[F.col(f"`{c}`") for c in table.key], weight).persist(StorageLevel.MEMORY_AND_DISK)
        if last is None:
            return self._keys[table.name]
        keys = self._keys[table.name].filter(F.col(f"`{table.block}`") <= last)
        keys = keys.select(*[F.col(f"`{c}`").alias(f"__s{i}") for i, c in enumerate(table.key)])
        rows = self._in_range(table, last)
        return rows.join(keys, [rows[f"`{c}`"].eqNullSafe(keys[f"__s{i}"]) for i, c in enumerate(table.key)], "left_semi")

    def release(self) -> None:
        """Give up the kept selection once the answer is written."""
        for kept in self._keys.values():
            kept.unpersist()
        self._keys.clear()

    def _ends(self) -> DataFrame:
        """One row: the lowest and the highest block of the range that have headers."""
        block = self.query.catalog.block_table
        number = F.col(f"`{block.block}`")
        return self.headers().agg(F.min(number).alias("__lo"), F.max(number).alias("__hi"))

    def _bounded(self, rows: DataFrame, filled: Expr, number: str = "block") -> DataFrame:
        """Rows whose blocks have items or bound the range; all of them if the request wants so."""
        if self.query.include_all:
            return rows
        ends = F.broadcast(self._ends())  # one row
        return rows.join(ends).filter(filled | (F.col(number) == F.col("__lo")) | (F.col(number) == F.col("__hi"))).drop("__lo", "__hi")

    def weights(self) -> DataFrame:
        """(block, weight) of every candidate block, from one pass over headers and items."""
        block = self.query.catalog.block_table
        number = lambda t: F.col(f"`{t.block}`").alias("block")
        head = self.headers().select(number(block), row_weight(block, self.query.selected(block)).alias("weight"))
        own = []
        for t in self.plan.output_tables():
            rows = self._selected(t) if self.budget is not None else self.items(t)
            weight = F.col("__weight") if "__weight" in rows.columns else row_weight(t, self.query.selected(t))
            own.append(rows.select(number(t), weight.alias("weight")))
        total = block_weights(head, own)
        # A block without a header row is no candidate's block unless it has items, as in the sum.
        return self._bounded(total, F.col("filled")).select("block", "weight")

    def page(self) -> DataFrame:
        """The blocks of the page: block, weight, total. At most as many as the budget holds headers, at what a header is charged at least."""
        block = self.query.catalog.block_table
        return page(self.weights(), self.budget, fixed_weight(block, self.query.selected(block)))

    def last_block(self) -> int | None:
        """The page's last block: where a client resumes after. None if the range is empty. One number comes to the driver."""
        if not self._paged:
            frame = self.page() if self.budget is not None else self.weights()
            self._last, self._paged = (lambda v: None if v is None else int(v))(frame.agg(F.max("block")).first()[0]), True
        return self._last

    def read_through(self) -> int | None:
        """How far a page was read if it stopped before the range's last candidate block; None if the answer is whole."""
        last = self.last_block()
        if self.budget is None or last is None:
            return None
        beyond = self.weights().filter(F.col("block") > last)
        return None if beyond.isEmpty() else last

    def estimated_bytes(self, name: str) -> int:
        """What the planner expects a table's rows of the range to take in memory, from file sizes and the columns that the answer needs."""
        table = self.query.catalog.tables[name]
        need = dict.fromkeys([*table.key, *(c for f in self.query.selected(table) for c in table.fields()[f])])
        df = self._in_range(table).select(*[F.col(f"`{c}`") for c in need])
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    # ---- answers --------------------------------------------------------

    def lines(self) -> DataFrame:
        """(block, line): one JSON object per block of the page; order by block to write them."""
        last = self.last_block() if self.budget is not None else None
        if self.budget is not None and last is None:
            return self.spark.createDataFrame([], "block long, line string")
        block = self.query.catalog.block_table
        out = self.headers(last)
        schema = out.schema
        out = out.withColumn("__block", F.col(f"`{block.block}`"))
        text, filled = [F.lit('{"header":'), item_json(block, self.query.selected(block), schema)], F.lit(False)
        for i, t in enumerate(self.plan.output_tables()):
            rows = self._selected(t, last) if last is not None else self.items(t)
            keys = [comparable(rows, c) for c in t.key if c != t.block]
            entry = F.struct(*[k.alias(f"k{j}") for j, k in enumerate(keys)], item_json(t, self.query.selected(t), rows.schema).alias("json"))
            per_block = rows.select(F.col(f"`{t.block}`").alias("__b"), entry.alias("e")).groupBy("__b").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["json"]), ",").alias(f"__items{i}"))
            out = out.join(per_block, F.col("__block") == F.col("__b"), "left").drop("__b")
            own = F.col(f"__items{i}")
            filled = filled | own.isNotNull()
            text.append(F.when(own.isNotNull(), F.concat(F.lit(f',"{t.request}":['), own, F.lit("]"))).otherwise(F.lit("")))
        # A block is a candidate if it has items, which the joins show: the tables are not read for it again.
        return self._bounded(out, filled, "__block").select(F.col("__block").alias("block"), F.concat(*text, F.lit("}")).alias("line"))

    def json_lines(self) -> Iterator[str]:
        """The answer's lines in block order, each with its newline; nothing for an empty answer."""
        for r in self.lines().orderBy("block").toLocalIterator():
            yield r["line"] + "\n"

    def write_ndjson(self, path: str) -> None:
        """The answer as text files whose order is block order."""
        self.lines().orderBy("block").select("line").write.text(path)

    def tables(self) -> dict[str, DataFrame]:
        """The same rows as flat tables: block number and rendered physical columns, headers first."""
        last = self.last_block() if self.budget is not None else self.query.to_block
        if self.budget is not None and last is None:
            return {}
        out = {}
        block = self.query.catalog.block_table
        own = {t.name: self._selected(t, last) if self.budget is not None else self.items(t, last) for t in self.plan.output_tables()}
        head = self.headers(last)
        if not self.query.include_all:
            filled = [df.select(F.col(f"`{self.query.catalog.tables[n].block}`").alias("__b")) for n, df in own.items()]
            ends = self._ends().select(F.explode(F.array("__lo", "__hi")).alias("__b"))
            head = head.join(reduce(lambda a, b: a.unionByName(b), [ends, *filled]).distinct(), F.col(f"`{block.block}`") == F.col("__b"), "left_semi")
        for t in [block, *self.plan.output_tables()]:
            rows = head if t.is_block_table else own[t.name]
            names = dict.fromkeys([t.block, *(c for f in self.query.selected(t) for c in t.fields()[f])])
            order = [F.col(f"`{c}`") for c in t.key]
            out[t.name] = rows.orderBy(*order).select(*[F.col(f"`{c}`") for c in names])
        return out

    def arrow_frames(self, binary_hex: bool = False, compress: bool = False) -> bytes:
        """Flat tables as framed Arrow streams: name length, name, stream length, stream. Bounded by the page."""
        import pyarrow as pa

        if self.budget is None:
            raise ValueError("framed streams are built on the driver, so they need a page budget; tables() has no such bound")
        out = io.BytesIO()
        options = pa.ipc.IpcWriteOptions(compression="zstd" if compress else None)
        for name, df in self.tables().items():
            table = self.query.catalog.tables[name]
            if binary_hex:
                df = df.select(*[hex_to_binary(F.col(f"`{c}`"), c).alias(c) if table.columns[c].encoding == "hex_bytes" and k == "string" else F.col(f"`{c}`") for c, k in df.dtypes])
            data = df.toArrow()
            if not len(data) and not table.is_block_table:
                continue
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, data.schema, options=options) as writer:
                writer.write_table(data)
            raw, label = sink.getvalue(), name.encode()
            out.write(struct.pack("<I", len(label)) + label + struct.pack("<I", len(raw)) + raw)
        return out.getvalue()


def hex_to_binary(text: Expr, name: str) -> Expr:
    """0x hex as bytes; an odd digit count gets a leading zero; anything else is refused."""
    data = F.unhex(F.substring(text, F.lit(3), F.length(text)))
    refuse = F.raise_error(F.lit(f"MalformedChunkData: {name} holds a value that is not hex")).cast("binary")
    return F.when(text.isNotNull(), F.when(F.rlike(text, F.lit("^0[xX]")) & data.isNotNull(), data).otherwise(refuse))


def read_frames(raw: bytes) -> dict:
    """Arrow frames back to tables by name."""
    import pyarrow as pa

    out, at = {}, 0
    while at < len(raw):
        n = struct.unpack_from("<I", raw, at)[0]
        name = raw[at + 4 : at + 4 + n].decode()
        at += 4 + n
        size = struct.unpack_from("<I", raw, at)[0]
        out[name] = pa.ipc.open_stream(raw[at + 4 : at + 4 + size]).read_all()
        at += 4 + size
    return out


def execute(spark: SparkSession, request: bytes | str | dict, catalog: Catalog, source: TableSource, budget: int | None = BUDGET) -> Execution:
    """Parse, compile and check a request; the answer's frames are lazy."""
    return Execution(spark, compile_query(parse_query(request, catalog)), source, budget).prepare()


def pages(spark: SparkSession, request: dict, catalog: Catalog, source: TableSource, budget: int = BUDGET) -> Iterator[Execution]:
    """All pages of a request, each resuming after the last block of the one before."""
    end = request.get("toBlock")
    while True:
        one = execute(spark, request, catalog, source, budget)
        last = one.last_block()
        if last is None:
            return
        yield one
        top = one.headers().agg(F.max(F.col(f"`{catalog.block_table.block}`"))).first()[0]
        if last >= int(top) or (end is not None and last >= end):
            return
        request = {**request, "fromBlock": last + 1}
        request.pop("parentBlockHash", None)
