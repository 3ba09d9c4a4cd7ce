"""Requests: JSON to a validated query. A pure function of the request and the catalog."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from tessera.catalog import SIGNED, UNSIGNED, Alias, Catalog, Column, Filter, Relation, Table, camel, snake
from tessera.errors import QueryError
from tessera.functions.hashing import Fuse8, is_base58

MAX_ITEMS, MAX_BYTES, MAX_LIST, MAX_BLOOM = 100, 16 << 20, 100_000, 10
MAX_DISCRIMINATORS, MAX_DISCRIMINATOR_BYTES, MAX_CANARIES, MAX_SET_REFERENCES = 1, 16, 64, 64
_U64 = 1 << 64
_RESERVED = {"type", "fromBlock", "toBlock", "parentBlockHash", "includeAllBlocks", "fields", "sets"}
_HEX = re.compile(r"0[xX](?:[0-9a-fA-F]{2})*\Z")


@dataclass(frozen=True)
class Test:
    """One filter of an item. ``kind``: in, compare, at_least, equals, bloom, list_any, any_of."""

    kind: str
    column: str
    values: tuple = ()
    sets: tuple = ()
    op: str = ""
    n_bytes: int = 0
    hashes: int = 0
    groups: tuple = ()

    def columns(self) -> tuple[str, ...]:
        return tuple(c for c, _ in self.groups) if self.kind == "any_of" else (self.column,)


@dataclass
class Item:
    """One item request: all tests hold. An item that can match nothing is dead."""

    table: Table
    tests: list[Test]
    relations: list[Relation]
    dead: bool = False
    path: str = ""


@dataclass
class Query:
    catalog: Catalog
    from_block: int = 0
    to_block: int | None = None
    include_all: bool = False
    parent_hash: str | None = None
    fields: dict[str, list[str]] = field(default_factory=dict)
    items: list[Item] = field(default_factory=list)

    def selected(self, table: Table) -> list[str]:
        """Selected fields of a table in output order."""
        chosen = set(self.fields.get(table.name, ()))
        return [f for f in table.fields() if f in chosen]


def _refuse(kind: str, path: str, text: str) -> QueryError:
    return QueryError(kind, f"{path}: {text}" if path else text, path)


def parse_query(request: bytes | str | dict, catalog: Catalog) -> Query:
    """Parse and validate a request; QueryError names what is wrong and where."""
    if isinstance(request, dict):
        raw = request
        size = len(json.dumps(raw))
    else:
        size = len(request if isinstance(request, bytes) else request.encode())
        if size > MAX_BYTES:
            raise _refuse("RequestTooLarge", "", f"the request has more than {MAX_BYTES} bytes")
        try:
            raw = json.loads(request)
        except ValueError as e:
            raise _refuse("MalformedRequest", "", f"not JSON: {e}") from e
    if size > MAX_BYTES:
        raise _refuse("RequestTooLarge", "", f"the request has more than {MAX_BYTES} bytes")
    if not isinstance(raw, dict):
        raise _refuse("MalformedRequest", "", "the request must be an object")
    if raw.get("type") != catalog.name:
        raise _refuse("UnknownDataset", "type", f"expected {catalog.name}, got {raw.get('type')!r}")
    out = Query(catalog)
    out.from_block = _block(raw, "fromBlock") or 0
    out.to_block = _block(raw, "toBlock")
    if out.to_block is not None and out.to_block < out.from_block:
        raise _refuse("InvalidBlockRange", "toBlock", "toBlock is below fromBlock")
    out.include_all = _typed(raw, "includeAllBlocks", bool, False)
    out.parent_hash = _typed(raw, "parentBlockHash", str, None)
    if out.parent_hash is not None and not catalog.block_table.parent_hash:
        raise _refuse("UnsupportedRequestField", "parentBlockHash", "the dataset declares no parent hash")
    _fields(_typed(raw, "fields", dict, {}), catalog, out)
    sets = _sets(_typed(raw, "sets", dict, {}))
    surfaces = catalog.surfaces()
    by_snake = {snake(k): v for k, v in surfaces.items()}
    count, used, references = 0, set(), 0
    for key, items in raw.items():
        if key in _RESERVED:
            continue
        surface = surfaces.get(key) or by_snake.get(snake(key))
        if surface is None or (isinstance(surface, Table) and surface.is_block_table):
            raise _refuse("UnknownTable", key, f"no table or alias {key} ({snake(key)})")
        if not isinstance(items, list):
            raise _refuse("MalformedRequest", key, "must be an array")
        count += len(items)
        if count > MAX_ITEMS:
            raise _refuse("TooManyItemRequests", key, f"more than {MAX_ITEMS} item requests")
        for i, item in enumerate(items):
            own, n = _item(item, surface, catalog, sets, out, f"{key}[{i}]", used)
            references += n
            out.items.append(own)
    if references > MAX_SET_REFERENCES:
        raise _refuse("RequestTooLarge", "sets", f"more than {MAX_SET_REFERENCES} set references")
    if idle := sorted(set(sets) - used):
        raise _refuse("InvalidSet", f"sets.{idle[0]}", "no filter refers to it")
    return out


def _block(raw: dict, key: str) -> int | None:
    v = raw.get(key)
    if v is None and key not in raw:
        return None
    if isinstance(v, bool) or not isinstance(v, int) or not 0 <= v < _U64:
        raise _refuse("InvalidBlockNumber", key, f"not an unsigned 64-bit integer: {v!r}")
    return v


def _typed(raw: dict, key: str, kind: type, default: Any) -> Any:
    if key not in raw:
        return default
    if not isinstance(raw[key], kind):
        raise _refuse("MalformedRequest", key, f"must be {kind.__name__}")
    return raw[key]


def _fields(raw: dict, catalog: Catalog, out: Query) -> None:
    groups = {t.output: t for t in catalog.tables.values()}
    for group, own in raw.items():
        if group not in groups:
            raise _refuse("UnknownFieldGroup", f"fields.{group}", "no such table")
        if not isinstance(own, dict):
            raise _refuse("MalformedRequest", f"fields.{group}", "must be an object")
        table = groups[group]
        names = {camel(f): f for f in table.fields()} | {f: f for f in table.fields()}
        for name, on in own.items():
            if name not in names:
                raise _refuse("UnknownField", f"fields.{group}.{name}", f"no selectable field {snake(name)}")
            if not isinstance(on, bool):
                raise _refuse("MalformedRequest", f"fields.{group}.{name}", "must be a boolean")
            if on:
                out.fields.setdefault(table.name, []).append(names[name])


def _sets(raw: dict) -> dict[str, tuple[Fuse8, list[str]]]:
    out = {}
    for name, s in raw.items():
        path = f"sets.{name}"
        if not isinstance(s, dict) or set(s) - {"canaries"} != {"fuse8"}:
            raise _refuse("InvalidSet", path, "must carry exactly the structure fuse8, and canaries")
        canaries = s.get("canaries")
        if not isinstance(canaries, list) or not 1 <= len(canaries) <= MAX_CANARIES or not all(isinstance(x, str) for x in canaries):
            raise _refuse("InvalidSet", f"{path}.canaries", f"must be 1 to {MAX_CANARIES} strings")
        try:
            out[name] = Fuse8.decode(s["fuse8"]), canaries
        except (ValueError, TypeError) as e:
            raise _refuse("InvalidSet", f"{path}.fuse8", str(e)) from e
    return out


def _item(raw: Any, surface: Table | Alias, catalog: Catalog, sets: dict, query: Query, path: str, used: set) -> tuple[Item, int]:
    if not isinstance(raw, dict):
        raise _refuse("MalformedRequest", path, "must be an object")
    table = surface if isinstance(surface, Table) else catalog.tables[surface.table]
    filters = {camel(k): v for k, v in surface.filters.items()} | surface.filters
    relations = {camel(k): v for k, v in surface.relations.items()} | surface.relations
    out = Item(table, [], [], path=path)
    discriminators = references = 0
    family = {c for f in table.filters.values() if f.kind == "discriminator" for c in f.columns}
    for key, value in raw.items():
        at = f"{path}.{key}"
        if key in relations:
            if not isinstance(value, bool):
                raise _refuse("MalformedRequest", at, "must be a boolean")
            if value:
                out.relations.append(relations[key])
            continue
        if key not in filters:
            raise _refuse("UnknownFilter", at, f"no filter or relation {snake(key)}")
        f = filters[key]
        if f.kind == "discriminator" or (f.kind == "in" and f.columns[0] in family):
            discriminators += 1
            if discriminators > MAX_DISCRIMINATORS:
                raise _refuse("ConflictingFilters", at, "more than one discriminator filter")
        test, n = _test(f, value, table, sets, query, at, used)
        references += n
        if test is None:
            out.dead = True
        elif test is not True:
            out.tests.append(test)
    if isinstance(surface, Alias):
        for column, values in surface.implicit.items():
            out.tests.append(Test("in", column, tuple(values)))
    return out, references


def _test(f: Filter, value: Any, table: Table, sets: dict, query: Query, at: str, used: set) -> tuple[Any, int]:
    """A test; True for no constraint, None for one that nothing passes; and the number of set references."""
    column = table.columns[f.columns[0]]
    bad = lambda text: _refuse("InvalidFilterValue", at, text)
    if value is None:
        raise bad("null is no filter value")
    if f.kind in ("gte", "lte"):
        if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value < _U64:
            raise bad("must be an unsigned integer")
        return Test("compare", column.name, (value,), op=">=" if f.kind == "gte" else "<="), 0
    if f.kind == "at_least":
        if not isinstance(value, bool):
            raise bad("must be a boolean")
        return (Test("at_least", column.name, (f.text,)) if value else True), 0
    if f.kind == "equals":
        if not isinstance(value, bool):
            raise bad("must be a boolean")
        return Test("equals", column.name, (value,)), 0
    values = value if isinstance(value, list) else [value]
    if len(values) > MAX_LIST:
        raise _refuse("RequestTooLarge", at, f"more than {MAX_LIST} values")
    if f.kind == "bloom":
        if not all(isinstance(v, str) for v in values):
            raise bad("must be strings")
        if len(values) > MAX_BLOOM:
            raise _refuse("TooManyBloomValues", at, f"more than {MAX_BLOOM} values")
        return (Test("bloom", column.name, tuple(dict.fromkeys(values)), n_bytes=f.n_bytes, hashes=f.hashes) if values else None), 0
    if f.kind == "discriminator":
        return _discriminator(f, values, table, at), 0
    if f.kind == "list_any":
        element = {"list_string": str}.get(column.type, int)
        if not all(isinstance(v, element) and not isinstance(v, bool) for v in values):
            raise bad(f"must be {element.__name__} values")
        if element is str:
            own = tuple(dict.fromkeys(v.lower() if column.folds else v for v in values))
        else:
            top = 256 if column.type == "list_uint8" else 1 << 32
            own = tuple(dict.fromkeys(v for v in values if 0 <= v < top))
        return (Test("list_any", column.name, own) if own else None), 0
    plain, names = [], []
    for v in values:
        if isinstance(v, dict):
            if set(v) != {"set"} or not isinstance(v["set"], str):
                raise bad("an object must be a set reference")
            names.append(v["set"])
        else:
            plain.append(v)
    structures = [_reference(n, column, table, sets, query, at, used) for n in dict.fromkeys(names)]
    own = fit_values(plain, column, at)
    if not own and not structures:
        return None, 0
    return Test("in", column.name, tuple(dict.fromkeys(own)), tuple(structures)), len(structures)


def fit_values(values: list, column: Column, at: str) -> list:
    """Values as the column holds them; those that no row can hold are left out."""
    bad = lambda text: _refuse("InvalidFilterValue", at, text)
    out = []
    for v in values:
        number = isinstance(v, int) and not isinstance(v, bool)
        if column.type == "string":
            if not isinstance(v, str):
                raise bad("must be strings")
            out.append(v.lower() if column.folds else v)
        elif column.type in UNSIGNED:
            width = UNSIGNED[column.type]
            if number:
                if 0 <= v < 1 << 8 * width:
                    out.append(v)
            elif isinstance(v, str):
                if _HEX.match(v) and len(v) == 2 + 2 * width:
                    out.append(int(v, 16))
            else:
                raise bad("must be unsigned integers or hex")
        elif column.type in SIGNED:
            if not number:
                raise bad("must be integers")
            if -(1 << 8 * SIGNED[column.type] - 1) <= v < 1 << 8 * SIGNED[column.type] - 1:
                out.append(v)
        elif column.width:
            if not isinstance(v, str):
                raise bad("must be hex strings")
            if _HEX.match(v) and len(v) == 2 + 2 * column.width:
                out.append(bytes.fromhex(v[2:]))
        elif column.type == "boolean":
            if not isinstance(v, bool):
                raise bad("must be booleans")
            out.append(v)
        else:
            raise bad(f"a {column.type} column takes no list")
    return out


def _discriminator(f: Filter, values: list, table: Table, at: str) -> Any:
    """Hex values of 1 to 16 bytes, each compared with the column of its length."""
    groups: dict[str, list] = {}
    by_width = {int(c[1:]): c for c in f.columns}
    for v in values:
        if not isinstance(v, str) or not _HEX.match(v):
            raise _refuse("InvalidHex", at, f"not 0x and an even number of hex digits: {v!r}")
        n = len(v) // 2 - 1
        if n > MAX_DISCRIMINATOR_BYTES:
            raise _refuse("DiscriminatorTooLong", at, f"more than {MAX_DISCRIMINATOR_BYTES} bytes")
        if n == 0:
            return True  # every row begins with nothing
        if n not in by_width:
            raise _refuse("InvalidFilterValue", at, f"no column for {n} bytes")
        column = table.columns[by_width[n]]
        groups.setdefault(column.name, []).append(bytes.fromhex(v[2:]) if column.width else int(v, 16))
    if not groups:
        return None
    return Test("any_of", f.columns[0], groups=tuple((c, tuple(dict.fromkeys(v))) for c, v in groups.items()))


def _reference(name: str, column: Column, table: Table, sets: dict, query: Query, at: str, used: set) -> Fuse8:
    if name not in sets:
        raise _refuse("UnknownSet", at, f"no set {name}")
    if column.type != "string" and not column.width or column.encoding not in ("hex_bytes", "base58", ""):
        raise _refuse("InvalidFilterValue", at, "the column takes no set")
    shown = {c for s in query.selected(table) for c in table.fields()[s]}
    if column.name not in shown:
        raise _refuse("SetFieldNotSelected", at, f"no selected field renders {column.name}")
    structure, canaries = sets[name]
    for c in canaries:
        text = c.lower() if column.folds else c
        sound = _HEX.match(text) if column.encoding == "hex_bytes" else is_base58(text) if column.encoding == "base58" else True
        if not sound or not structure.holds(text):
            raise _refuse("SetCanaryMismatch", f"sets.{name}", f"the set does not hold {c!r} as {column.name} renders it")
    used.add(name)
    return structure
