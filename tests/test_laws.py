"""Laws that answers obey whatever the request: unions, conjunctions, order, monotony, relations, pages."""

import itertools
import random

import pytest
from test_engine import EVM, evm_chunk, lines

from tessera.engine import execute, pages
from tessera.sources.chunks import FrameSource

ADDRESS = ["0x" + "0" * 39 + d for d in "01"]
FIELDS = {"log": {"logIndex": True, "transactionIndex": True}, "transaction": {"transactionIndex": True}, "block": {"number": True}}


@pytest.fixture(scope="module")
def source(spark):
    tables = {n: df.cache() for n, df in evm_chunk(spark, 100, 106).items()}
    yield FrameSource(tables)
    for df in tables.values():
        df.unpersist()


def keys(spark, source, table="logs", **request):
    """The keys of a table's rows in an answer."""
    e = execute(spark, {"type": "evm", "fields": FIELDS, **request}, EVM, source, budget=None)
    t = EVM.tables[table]
    found = e.items(t) if table in {x.name for x in e.plan.output_tables()} else None
    return set() if found is None else {tuple(str(x) for x in r) for r in found.select(*t.key).collect()}


def random_item(rng):
    """A random item over logs."""
    out = {}
    if rng.random() < 0.6:
        out["address"] = rng.sample(ADDRESS, rng.randrange(0, 3))
    if rng.random() < 0.6:
        out["topic1"] = rng.sample(["0x02", "0x09"], rng.randrange(1, 3))
    if rng.random() < 0.3:
        out["topic3"] = ["0x03"]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_items(spark, source, seed):
    rng = random.Random(seed)
    a, b = random_item(rng), random_item(rng)
    one, two = keys(spark, source, logs=[a]), keys(spark, source, logs=[b])
    both = keys(spark, source, logs=[a, b])
    assert both == one | two and keys(spark, source, logs=[b, a, b]) == both
    apart = [keys(spark, source, logs=[{k: v}]) for k, v in a.items()]
    whole = keys(spark, source, logs=[{}])
    assert one == (set.intersection(*apart) if apart else whole) and one <= whole
    # A longer list takes no rows away; an empty one takes all.
    for k, v in a.items():
        assert one <= keys(spark, source, logs=[{**a, k: [*v, "0x77"]}])
        assert not keys(spark, source, logs=[{**a, k: []}])


@pytest.mark.parametrize("seed", range(3))
def test_relations(spark, source, seed):
    rng = random.Random(10 + seed)
    a, b = random_item(rng), random_item(rng)
    reached = keys(spark, source, "transactions", logs=[{**a, "transaction": True}])
    # Only the item that asked reaches rows, and what it reaches does not change what items take.
    assert keys(spark, source, "transactions", logs=[{**a, "transaction": True}, b]) == reached
    assert keys(spark, source, logs=[{**a, "transaction": True}, b]) == keys(spark, source, logs=[a, b])
    sources = keys(spark, source, logs=[a])
    assert {x[0] for x in reached} == {x[0] for x in sources}
    # Reached rows and rows taken directly unite.
    direct = keys(spark, source, "transactions", transactions=[{}])
    assert keys(spark, source, "transactions", logs=[{**a, "transaction": True}], transactions=[{}]) == direct | reached


def test_ranges(spark, source):
    whole = keys(spark, source, logs=[{}])
    for cut in (100, 103, 106):
        low, high = keys(spark, source, logs=[{}], toBlock=cut), keys(spark, source, logs=[{}], fromBlock=cut + 1)
        assert low | high == whole and not low & high


def test_pages(spark, source):
    """Pages of any budget hold each block once, in order, as the whole answer has it."""
    request = {"type": "evm", "fields": FIELDS, "logs": [{"address": ADDRESS[:1], "transaction": True}]}
    whole = {x["header"]["number"]: x for x in lines(execute(spark, request, EVM, source, budget=None))}
    for budget in (1, 700, 1 << 20):
        split = list(itertools.chain.from_iterable(lines(p) for p in pages(spark, request, EVM, source, budget=budget)))
        numbers = [x["header"]["number"] for x in split]
        assert numbers == sorted(set(numbers)) and all(whole[n] == x for n, x in zip(numbers, split) if n in whole) and set(whole) <= set(numbers)
