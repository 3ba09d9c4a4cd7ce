"""One case per validation error kind, and values that match nothing."""

import pytest

from tessera.catalog import load
from tessera.errors import QueryError
from tessera.functions.hashing import Fuse8
from tessera.plans.planner import compile_query
from tessera.plans.request import parse_query

EVM, SOLANA, SUBSTRATE = load("evm"), load("solana"), load("substrate")
ADDRESSES = [f"0x{i:040x}" for i in range(1, 40)]
FUSE = Fuse8.build(ADDRESSES).encode()


def evm(**k):
    return {"type": "evm", **k}


def with_set(canaries=None, fuse=FUSE, fields=True, **k):
    return evm(sets={"s": {"fuse8": fuse, "canaries": canaries or [ADDRESSES[0].upper().replace("0X", "0x")]}}, fields={"log": {"address": fields}}, logs=[{"address": [{"set": "s"}]}], **k)


@pytest.mark.parametrize(
    "kind, request_, catalog",
    [
        ("MalformedRequest", b"[]", EVM),
        ("MalformedRequest", b"{", EVM),
        ("MalformedRequest", evm(logs={}), EVM),
        ("MalformedRequest", evm(includeAllBlocks=1), EVM),
        ("UnknownDataset", {}, EVM),
        ("UnknownDataset", {"type": "solana"}, EVM),
        ("UnknownTable", evm(log=[]), EVM),
        ("UnknownTable", evm(blocks=[]), EVM),
        ("UnknownFilter", evm(logs=[{"data": ["0x"]}]), EVM),
        ("UnknownFieldGroup", evm(fields={"logs": {}}), EVM),
        ("UnknownField", evm(fields={"log": {"topic0": True}}), EVM),
        ("UnknownField", evm(fields={"log": {"blockNumber": True}}), EVM),
        ("InvalidBlockRange", evm(fromBlock=2, toBlock=1), EVM),
        ("InvalidBlockNumber", evm(fromBlock="1"), EVM),
        ("InvalidBlockNumber", evm(toBlock=-1), EVM),
        ("InvalidBlockNumber", evm(toBlock=1 << 64), EVM),
        ("TooManyItemRequests", evm(logs=[{}] * 60, traces=[{}] * 41), EVM),
        ("TooManyBloomValues", {"type": "solana", "transactions": [{"mentionsAccount": [str(i) for i in range(11)]}]}, SOLANA),
        ("ConflictingFilters", {"type": "solana", "instructions": [{"d1": ["0x01"], "discriminator": ["0x02"]}]}, SOLANA),
        ("InvalidHex", {"type": "solana", "instructions": [{"discriminator": ["0x1"]}]}, SOLANA),
        ("InvalidHex", {"type": "solana", "instructions": [{"discriminator": ["zz"]}]}, SOLANA),
        ("DiscriminatorTooLong", {"type": "solana", "instructions": [{"discriminator": ["0x" + "00" * 17]}]}, SOLANA),
        ("InvalidFilterValue", evm(logs=[{"address": [1]}]), EVM),
        ("InvalidFilterValue", evm(logs=[{"address": None}]), EVM),
        ("InvalidFilterValue", evm(transactions=[{"firstNonce": "1"}]), EVM),
        ("InvalidFilterValue", {"type": "solana", "instructions": [{"isCommitted": "yes"}]}, SOLANA),
        ("InvalidFilterValue", evm(logs=[{"address": [{"other": "s"}]}]), EVM),
        ("UnknownSet", evm(fields={"log": {"address": True}}, logs=[{"address": {"set": "s"}}]), EVM),
        ("InvalidSet", with_set(fuse="AAAA"), EVM),
        ("InvalidSet", evm(sets={"s": {"fuse8": FUSE, "canaries": ADDRESSES[:1]}}), EVM),
        ("InvalidSet", evm(sets={"s": {"fuse8": FUSE, "canaries": []}}), EVM),
        ("SetCanaryMismatch", with_set(canaries=["nothex"]), EVM),
        ("SetFieldNotSelected", with_set(fields=False), EVM),
        ("RequestTooLarge", evm(logs=[{"address": ["0x"] * 100_001}]), EVM),
        ("UnsupportedRequestField", {"type": "shop", "parentBlockHash": "x"}, None),
    ],
)
def test_kind(kind, request_, catalog):
    if catalog is None:
        from tessera.catalog import parse
        from tessera.engine_queries import SHOP

        catalog = parse(SHOP.replace("    parent_hash: parent_hash\n", ""))
    with pytest.raises(QueryError) as e:
        parse_query(request_, catalog)
    assert e.value.kind == kind and e.value.is_validation


def test_accepted():
    q = parse_query(with_set(), EVM)
    assert q.items[0].tests[0].sets
    assert parse_query(evm(logs=[{"address": []}]), EVM).items[0].dead
    assert not compile_query(parse_query(evm(logs=[{"address": []}]), EVM)).tables
    q = parse_query({"type": "substrate", "evmLogs": [{"address": ["0xAB"], "extrinsic": True}]}, SUBSTRATE)
    assert [(t.column, t.values) for t in q.items[0].tests] == [("_evm_log_address", ("0xab",)), ("name", ("EVM.Log",))]
    assert parse_query({"type": "solana", "instructions": [{"discriminator": ["0x"]}]}, SOLANA).items[0].tests == []


def test_relations_merge():
    plan = compile_query(parse_query(evm(logs=[{"transaction": True}, {"transaction": True, "topic0": ["0x1"]}, {}]), EVM))
    assert [r.items for r in plan.tables["logs"].relations] == [[0, 1]]


def test_all_catalogs_load():
    names = ["evm", "solana", "substrate", "tron", "bitcoin", "hyperliquidFills", "hyperliquidReplicaCmds"]
    all_ = [load(n) for n in names]
    assert [c.name for c in all_] == names
    assert sum(len(c.tables) for c in all_) == 28 and sum(len(c.aliases) for c in all_) == 13
    assert sum(len(t.filters) for c in all_ for t in c.tables.values()) == 90
    assert sum(len(t.relations) for c in all_ for t in c.tables.values()) == 52
