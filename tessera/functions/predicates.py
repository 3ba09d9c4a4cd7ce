"""Filters as Catalyst expressions. Columns are never cast or wrapped, so that predicates reach the Parquet scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column as Expr
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog import Table
from tessera.errors import QueryError
from tessera.functions.hashing import base58_text, bloom_test, set_test
from tessera.plans.request import Item, Test

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, INTEGERS) or isinstance(kind, T.DecimalType) and kind.scale == 0


def _in(column: Expr, kind: T.DataType, values: tuple, name: str) -> Expr:
    if not values:
        return F.lit(False)
    first = values[0]
    if isinstance(first, bool):
        return _equals(column, kind, values[0], name) if len(set(values)) == 1 else column.isNotNull()
    if isinstance(first, int):
        if not is_integer(kind):
            raise QueryError("UnsupportedKeyType", f"{name} is stored as {kind.simpleString()}", name)
        top = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}.get(type(kind))
        own = [v for v in values if top is None or -(1 << top) <= v < 1 << top]
        return column.isin(*own) if own else F.lit(False)
    if isinstance(first, bytes):
        if isinstance(kind, T.StringType):
            return column.isin(*["0x" + v.hex() for v in values])
        if not isinstance(kind, T.BinaryType):
            raise QueryError("UnsupportedKeyType", f"{name} is stored as {kind.simpleString()}", name)
        return column.isin(*[F.lit(bytearray(v)) for v in values])
    if isinstance(kind, T.BinaryType):
        own = [bytearray.fromhex(v[2:]) for v in values if v.startswith("0x") and len(v) % 2 == 0 and all(c in "0123456789abcdef" for c in v[2:])]
        return column.isin(*map(F.lit, own)) if own else F.lit(False)
    if not isinstance(kind, T.StringType):
        raise QueryError("UnsupportedKeyType", f"{name} is stored as {kind.simpleString()}", name)
    return column.isin(*values)


def _equals(column: Expr, kind: T.DataType, value: bool, name: str) -> Expr:
    if isinstance(kind, T.BooleanType):
        return column == F.lit(value)
    if is_integer(kind):
        return column == 1 if value else column != 1
    raise QueryError("UnsupportedKeyType", f"{name} is stored as {kind.simpleString()}", name)


def rendered_text(column: Expr, kind: T.DataType, encoding: str) -> Expr:
    """A value as the response shows it, without quotes."""
    if isinstance(kind, T.BinaryType):
        return base58_text(column) if encoding == "base58" else F.concat(F.lit("0x"), F.lower(F.hex(column)))
    return column


def test_expression(t: Test, table: Table, schema: T.StructType) -> Expr:
    """One filter over the physical columns of ``schema``; null fails every one."""
    if t.kind == "any_of":
        return reduce(lambda a, b: a | b, [_in(F.col(f"`{c}`"), schema[c].dataType, v, c) for c, v in t.groups])
    column, kind = F.col(f"`{t.column}`"), schema[t.column].dataType
    if t.kind == "in":
        parts = [_in(column, kind, t.values, t.column)] if t.values else []
        if t.sets:
            parts.append(set_test(rendered_text(column, kind, table.columns[t.column].encoding), list(t.sets)))
        return reduce(lambda a, b: a | b, parts)
    if t.kind == "compare":
        if not is_integer(kind):
            raise QueryError("UnsupportedKeyType", f"{t.column} is stored as {kind.simpleString()}", t.column)
        value = t.values[0]
        if isinstance(kind, T.DecimalType) or value < 1 << 63:
            limit = F.lit(value) if value < 1 << 63 else F.expr(f"{value}BD")
        else:  # beyond what the column can hold
            return F.lit(False) if t.op == ">=" else column.isNotNull()
        return column >= limit if t.op == ">=" else column <= limit
    if t.kind == "at_least":
        return column >= F.lit(t.values[0])
    if t.kind == "equals":
        return _equals(column, kind, t.values[0], t.column)
    if t.kind == "bloom":
        return bloom_test(column, list(t.values), t.n_bytes, t.hashes)
    if t.kind == "list_any":
        if not isinstance(kind, T.ArrayType):
            raise QueryError("UnsupportedKeyType", f"{t.column} is stored as {kind.simpleString()}", t.column)
        own = F.array(*[F.lit(v).cast(kind.elementType) for v in t.values])
        return F.coalesce(F.arrays_overlap(column, own), F.lit(False))
    raise AssertionError(t.kind)


def item_expression(item: Item, schema: T.StructType) -> Expr:
    """All tests of an item; an item without tests takes every row."""
    return reduce(lambda a, b: a & b, [test_expression(t, item.table, schema) for t in item.tests], F.lit(True))
