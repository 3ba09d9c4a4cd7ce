"""Catalog validation: each contradiction is refused."""

import pytest

from tessera.catalog import camel, parse, snake
from tessera.engine_queries import SHOP, TREE
from tessera.errors import CatalogError


@pytest.mark.parametrize(
    "text, old, new",
    [
        (SHOP, "version: 1", "version: 2"),
        (SHOP, "block: o_orderkey", "block: nowhere"),
        (SHOP, "order: [seq]", "order: [nowhere]"),
        (SHOP, "weight_key: [l_orderkey, seq]", "weight_key: [l_orderkey, d1]"),
        (SHOP, "weight_key: [l_orderkey, seq]", "weight_key: [l_orderkey, paid]"),
        (SHOP, "paid: string w=price_size", "paid: string w=nowhere"),
        (SHOP, "uint8/hex_number", "int32/hex_number"),
        (SHOP, "request: payments", "request: lines"),
        (SHOP, "output: payment", "output: line"),
        (SHOP, "part_from: gte l_partkey", "part_from: gte seq"),
        (SHOP, "big: equals", "big: equals flag"),
        (SHOP, "status: in,", "nowhere: in,"),
        (SHOP, "topics: [t0, t1, t2, rest]", "topics: [t0, rest, t2]"),
        (SHOP, "topics: [t0, t1, t2, rest]", "t0: [t0, t1]"),
        (SHOP, "variant_column: status", ""),
        (SHOP, "join: payments, keys: [l_orderkey, l_linenumber]", "join: nowhere, keys: [l_orderkey, l_linenumber]"),
        (SHOP, "{join: lineitem, keys: [l_orderkey, note]}", "{join: lineitem, keys: [note]}"),
        (SHOP, "{join: lineitem, keys: [l_orderkey, note]}", "{children: lineitem, keys: [l_orderkey, note]}"),
        (SHOP, "implicit: {flag: [r]}", "implicit: {nowhere: [r]}"),
        (SHOP, "doc: string/json_verbatim", "doc: string/nothing"),
        (SHOP, "note: string", "note: text"),
        (SHOP, "rolls:", "rules:"),
        (TREE, "path: list_uint32", "path: string"),
        (TREE, "request: sizes", "request: sizes\n    order: [number]"),
    ],
)
def test_refused(text, old, new):
    assert old in text
    with pytest.raises((CatalogError, KeyError)):
        parse(text.replace(old, new, 1))


def test_lenient():
    assert parse(SHOP.replace("    rolls:", "    other: 1\n    rolls:"), strict=False)


def test_names():
    assert camel("call_result_gas_used") == "callResultGasUsed" and snake("callResultGasUsed") == "call_result_gas_used" and snake("a0") == "a0"
