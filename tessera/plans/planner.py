"""Compilation: a query to table plans with merged relations."""

from __future__ import annotations

from dataclasses import dataclass, field

from tessera.catalog import Relation, Table
from tessera.plans.request import Item, Query


@dataclass
class RelationPlan:
    """One semi-join into ``relation.target`` from the rows of some items of a table; None: of all."""

    relation: Relation
    items: list[int] | None


@dataclass
class TablePlan:
    table: Table
    items: list[Item]
    relations: list[RelationPlan] = field(default_factory=list)


@dataclass
class Plan:
    query: Query
    tables: dict[str, TablePlan]

    def output_tables(self) -> list[Table]:
        """Tables that may have items, in catalog order."""
        names = set(self.tables) | {r.relation.target for t in self.tables.values() for r in t.relations}
        return [t for t in self.query.catalog.tables.values() if t.name in names]


def compile_query(query: Query) -> Plan:
    """Group live items by table; relations with equal target, kind and keys become one."""
    tables: dict[str, TablePlan] = {}
    for item in query.items:
        if not item.dead:
            tables.setdefault(item.table.name, TablePlan(item.table, [])).items.append(item)
    for plan in tables.values():
        merged: dict[tuple, tuple[Relation, list[int]]] = {}
        for i, item in enumerate(plan.items):
            for r in item.relations:
                merged.setdefault((r.target, r.kind, r.left, r.right), (r, []))[1].append(i)
        for r, items in merged.values():
            own = sorted(set(items))
            plan.relations.append(RelationPlan(r, None if len(own) == len(plan.items) else own))
    return Plan(query, tables)
