"""Dataset catalogs: tables, columns, filters, relations, output fields.

A catalog is a YAML file; nothing in the engine knows a dataset by name. A
column is written ``type[/encoding] [w=weight] [fold] [sys] [members={...}]``, a
filter ``kind [column] [arguments]``, a relation ``{kind: target, keys: [...], to: [...]}``.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from tessera.errors import CatalogError

HERE = Path(__file__).parent / "catalogs"
UNSIGNED = {"uint8": 1, "uint16": 2, "uint32": 4, "uint64": 8}
SIGNED = {"int16": 2, "int32": 4, "int64": 8}
SCALARS = {*UNSIGNED, *SIGNED, "float64", "boolean", "string", "timestamp_second", "timestamp_millisecond", "decimal128"}
LISTS = {"list_uint8", "list_uint32", "list_string"}
NESTED = {"struct", "list_struct"}
ENCODINGS = {"", "hex_bytes", "base58", "decimal_string", "hex_number", "json_verbatim", "solana_tx_version", "timestamp_second", "timestamp_millisecond"}
FILTER_KINDS = {"in", "equals", "gte", "lte", "at_least", "bloom", "discriminator"}
DEFAULT_WEIGHT = 32


def camel(name: str) -> str:
    """snake_case to camelCase."""
    head, *rest = name.split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


def snake(name: str) -> str:
    """camelCase to snake_case; snake_case stays."""
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    encoding: str = ""
    weight: int | str | None = None
    fold: bool = False
    hidden: bool = False
    members: tuple = ()

    @property
    def folds(self) -> bool:
        """Whether filter values are lower-cased before they are compared."""
        return self.fold or self.encoding == "hex_bytes"

    @property
    def width(self) -> int | None:
        """Bytes of a fixed-width binary column."""
        return int(self.type.rpartition("_")[2]) if self.type.startswith("fixed_binary_") else None


@dataclass(frozen=True)
class Filter:
    name: str
    kind: str
    columns: tuple[str, ...]
    text: str = ""
    n_bytes: int = 0
    hashes: int = 0


@dataclass(frozen=True)
class Relation:
    name: str
    kind: str
    target: str
    left: tuple[str, ...]
    right: tuple[str, ...]


@dataclass
class Table:
    name: str
    request: str
    output: str
    block: str
    columns: dict[str, Column]
    order: tuple[str, ...] = ()
    address: str | None = None
    parent_hash: str | None = None
    parent_number: str | None = None
    weight_columns: tuple[str, ...] | None = None
    sort_key: tuple[str, ...] = ()
    filters: dict[str, Filter] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)
    rolls: dict[str, tuple[str, ...]] = field(default_factory=dict)
    variant_column: str | None = None
    variants: dict[str, dict[str, dict[str, str]]] = field(default_factory=dict)
    #: Fields that only variants render, with the column that each reads.
    variant_fields: dict[str, str] = field(default_factory=dict)

    @property
    def is_block_table(self) -> bool:
        return not self.order and not self.address

    @property
    def key(self) -> tuple[str, ...]:
        """Identity and order of rows: block, order keys, address, each once."""
        return tuple(dict.fromkeys([self.block, *self.order, *([self.address] if self.address else [])]))

    @property
    def weight_key(self) -> tuple[str, ...]:
        """Columns that every row is charged for."""
        return self.weight_columns or tuple(dict.fromkeys([*self.key, *([self.variant_column] if self.variant_column else [])]))

    def fields(self) -> dict[str, tuple[str, ...]]:
        """Selectable fields in output order, each with its physical columns: columns, then rolls."""
        rolled = {c for own in self.rolls.values() for c in own}
        out = {c.name: (c.name,) for c in self.columns.values() if not c.hidden and c.name not in rolled and (self.is_block_table or c.name != self.block)}
        return out | {k: tuple(v) for k, v in self.rolls.items()} | {k: (c,) for k, c in self.variant_fields.items()}


@dataclass
class Alias:
    name: str
    table: str
    implicit: dict[str, list]
    filters: dict[str, Filter]
    relations: dict[str, Relation]


@dataclass
class Catalog:
    name: str
    tables: dict[str, Table]
    aliases: dict[str, Alias]

    @property
    def block_table(self) -> Table:
        return next(t for t in self.tables.values() if t.is_block_table)

    def surfaces(self) -> dict[str, Table | Alias]:
        """Request names: tables' and aliases'."""
        return {t.request: t for t in self.tables.values()} | self.aliases


def _column(name: str, text: str) -> Column:
    members = {}
    if "members=" in text:
        text, _, raw = text.partition("members=")
        members = ast.literal_eval(raw)
    head, *marks = text.split()
    kind, _, encoding = head.partition("/")
    weight: int | str | None = None
    for m in marks:
        if m.startswith("w="):
            weight = int(m[2:]) if m[2:].isdigit() else m[2:]
        elif m not in ("fold", "sys"):
            raise CatalogError(f"{name}: unknown mark {m}")
    return Column(name, kind, encoding, weight, "fold" in marks, "sys" in marks, tuple((k, v["encoding"]) for k, v in members.items()))


def _filter(name: str, text: str, columns: dict[str, Column]) -> Filter:
    kind, *rest = [x for x in str(text).split() if x != "fold"]
    if kind not in FILTER_KINDS:
        raise CatalogError(f"{name}: unknown filter kind {kind}")
    if kind == "discriminator":
        return Filter(name, kind, tuple(c for k in range(1, 17) if (c := f"d{k}") in columns))
    column = rest[0] if rest else name
    if kind == "at_least":
        return Filter(name, kind, (column,), text=rest[1])
    if kind == "bloom":
        return Filter(name, kind, (column,), n_bytes=int(rest[1]), hashes=int(rest[2]))
    if kind == "in" and columns.get(column) and columns[column].type in LISTS:
        kind = "list_any"
    return Filter(name, kind, (column,))


def _relation(name: str, spec: dict) -> Relation:
    kind = next(k for k in ("join", "children", "parents") if k in spec)
    return Relation(name, kind, spec[kind], tuple(spec["keys"]), tuple(spec.get("to", spec["keys"])))


def load(path_or_name: str | Path, strict: bool = True) -> Catalog:
    """Load a catalog file, or a bundled dataset by name."""
    path = Path(path_or_name)
    if not path.suffix:
        path = HERE / f"{snake(str(path_or_name))}.yaml"
    return parse(path.read_text(), strict)


def parse(text: str, strict: bool = True) -> Catalog:
    """A validated catalog from YAML. Not strict: unknown keys are ignored."""
    raw: dict[str, Any] = yaml.safe_load(text)
    if raw.get("version") != 1:
        raise CatalogError("unsupported catalog version")
    known = {"request", "output", "block", "order", "address", "parent_hash", "parent_number", "weight_key", "sort_key", "columns", "filters", "relations", "rolls", "variant_column", "variants", "variant_fields"}
    tables = {}
    for name, t in raw["tables"].items():
        if strict and (odd := set(t) - known):
            raise CatalogError(f"{name}: unknown keys {sorted(odd)}")
        columns = {k: _column(k, v) for k, v in t["columns"].items()}
        tables[name] = Table(
            name, t.get("request", name), t.get("output", name), t["block"], columns, tuple(t.get("order", ())), t.get("address"), t.get("parent_hash"), t.get("parent_number"),
            tuple(t["weight_key"]) if "weight_key" in t else None, tuple(t.get("sort_key", ())), {k: _filter(k, v, columns) for k, v in (t.get("filters") or {}).items()},
            {k: _relation(k, v) for k, v in (t.get("relations") or {}).items()}, {k: tuple(v) for k, v in (t.get("rolls") or {}).items()}, t.get("variant_column"), t.get("variants") or {}, t.get("variant_fields") or {},
        )
    aliases = {}
    for name, a in (raw.get("aliases") or {}).items():
        if a["table"] not in tables:
            raise CatalogError(f"{name}: unknown table {a['table']}")
        columns = tables[a["table"]].columns
        aliases[name] = Alias(name, a["table"], a.get("implicit") or {}, {k: _filter(k, v, columns) for k, v in (a.get("filters") or {}).items()}, {k: _relation(k, v) for k, v in (a.get("relations") or {}).items()})
    out = Catalog(raw["dataset"], tables, aliases)
    validate(out)
    return out


def validate(c: Catalog) -> None:
    """Refuse catalogs that contradict themselves."""

    def need(ok: object, text: str) -> None:
        if not ok:
            raise CatalogError(text)

    blocks = [t for t in c.tables.values() if t.is_block_table]
    need(len(blocks) == 1 and next(iter(c.tables.values())) is blocks[0], "exactly one table, the first, must be the block table")
    need(len({t.request for t in c.tables.values()} | set(c.aliases)) == len(c.tables) + len(c.aliases), "request names must be unique")
    need(len({t.output for t in c.tables.values()}) == len(c.tables), "output names must be unique")
    for t in c.tables.values():
        at = t.name
        for what in (t.block, *t.key, *t.weight_key, *t.sort_key, *filter(None, (t.parent_hash, t.parent_number, t.variant_column))):
            need(what in t.columns, f"{at}: no column {what}")
        need(t.is_block_table or not (t.parent_hash or t.parent_number), f"{at}: only the block table has parent columns")
        need(bool(t.variants) == bool(t.variant_column), f"{at}: variants and variant_column belong together")
        need(not (t.is_block_table and t.variants), f"{at}: the block table has no variants")
        if t.address:
            need(t.columns[t.address].type in ("list_uint8", "list_uint32"), f"{at}: the address must be a list of integers")
        for k in t.weight_key:
            need(not t.columns[k].hidden and not isinstance(t.columns[k].weight, str), f"{at}: weight key column {k} must be visible and of fixed weight")
        for col in t.columns.values():
            need(col.type in SCALARS | LISTS | NESTED or col.width, f"{at}.{col.name}: unknown type {col.type}")
            need(col.encoding in ENCODINGS, f"{at}.{col.name}: unknown encoding {col.encoding}")
            need(col.encoding != "hex_number" or col.type in UNSIGNED, f"{at}.{col.name}: hex_number needs an unsigned type")
            need(not col.members or col.type in NESTED, f"{at}.{col.name}: only structs have members")
            if isinstance(col.weight, str):
                need(col.weight in t.columns and t.columns[col.weight].type in UNSIGNED | SIGNED, f"{at}.{col.name}: no size column {col.weight}")
        for roll, own in t.rolls.items():
            need(roll not in t.columns, f"{at}: roll {roll} is named as a column")
            need(own and all(x in t.columns for x in own), f"{at}: roll {roll} has unknown columns")
            need(all(t.columns[x].type not in LISTS for x in own[:-1]), f"{at}: only the last column of roll {roll} may be a list")
        for groups in t.variants.values():
            for own in groups.values():
                need(all(t.variant_fields.get(x, x) in t.columns for x in own), f"{at}: a variant has unknown columns")
        _check_surface(c, t, at, t.filters, t.relations)
    for a in c.aliases.values():
        t = c.tables[a.table]
        need(all(x in t.columns for x in a.implicit), f"{a.name}: an implicit filter has no column")
        _check_surface(c, t, a.name, a.filters, a.relations)


def _check_surface(c: Catalog, t: Table, at: str, filters: dict[str, Filter], relations: dict[str, Relation]) -> None:
    if both := set(filters) & set(relations):
        raise CatalogError(f"{at}: filters and relations share names {sorted(both)}")
    for f in filters.values():
        if not f.columns or any(x not in t.columns for x in f.columns):
            raise CatalogError(f"{at}: filter {f.name} has no column")
        kind = t.columns[f.columns[0]].type
        if f.kind == "bloom" and t.columns[f.columns[0]].width != f.n_bytes:
            raise CatalogError(f"{at}: bloom filter {f.name} has another width than its column")
        if f.kind in ("gte", "lte") and kind != "uint64":
            raise CatalogError(f"{at}: range filter {f.name} needs a uint64 column")
        if f.kind == "equals" and kind != "boolean":
            raise CatalogError(f"{at}: equals filter {f.name} needs a boolean column")
        if f.kind == "at_least" and kind != "string":
            raise CatalogError(f"{at}: filter {f.name} needs a string column")
    for r in relations.values():
        u = c.tables.get(r.target)
        if u is None or u.is_block_table or len(r.left) != len(r.right):
            raise CatalogError(f"{at}: relation {r.name} has no target or uneven keys")
        if any(x not in t.columns for x in r.left) or any(x not in u.columns for x in r.right):
            raise CatalogError(f"{at}: relation {r.name} has unknown key columns")
        if r.left[0] != t.block or r.right[0] != u.block:
            raise CatalogError(f"{at}: relation {r.name} must be led by the block number")
        if r.kind != "join" and not (t.address and u.address):
            raise CatalogError(f"{at}: hierarchy {r.name} needs addresses on both sides")
