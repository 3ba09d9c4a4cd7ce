"""Relations: semi-joins from matched rows into a target table. Only target rows come out."""

from __future__ import annotations

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog import Relation, Table
from tessera.errors import QueryError
from tessera.functions.predicates import is_integer


def comparable(df: DataFrame, name: str) -> Expr:
    """A key column in the one type that its values compare in, whatever width they are stored at."""
    kind = df.schema[name].dataType
    column = df[f"`{name}`"]
    if isinstance(kind, T.DecimalType) and kind.scale == 0:
        return column
    if is_integer(kind):
        return column.cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return column
    if isinstance(kind, T.ArrayType) and is_integer(kind.elementType):
        return column.cast("array<bigint>")
    raise QueryError("UnsupportedKeyType", f"{name} is stored as {kind.simpleString()}, which is no key", name)


def prefixes(address: Expr, strict: bool) -> Expr:
    """The prefixes of an address from [] on; without the address itself if strict. Null has none."""
    n = F.size(address) - (1 if strict else 0)
    return F.when(address.isNull() | (n < 0), F.array().cast("array<array<bigint>>")).otherwise(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(address, F.lit(1), k)))


def _keys(df: DataFrame, names: tuple[str, ...], to: str) -> list[Expr]:
    return [comparable(df, c).alias(f"{to}{i}") for i, c in enumerate(names)]


def related(source: DataFrame, source_table: Table, target: DataFrame, target_table: Table, relation: Relation) -> DataFrame:
    """The target rows that ``relation`` reaches from the source rows. Null keys reach nothing."""
    if relation.kind == "join":
        keys = source.select(*_keys(source, relation.left, "__k")).distinct()
        match = [comparable(target, c) == keys[f"__k{i}"] for i, c in enumerate(relation.right)]
        return target.join(keys, match, "left_semi")
    # Hierarchies: within a group, compare addresses; across tables equal depth counts too.
    pairs = [(a, b) for a, b in zip(relation.left, relation.right) if b != target_table.address and a != source_table.address]
    strict = source_table.name == target_table.name
    own, theirs = comparable(source, source_table.address), comparable(target, target_table.address)
    keys = source.select(*_keys(source, tuple(a for a, _ in pairs), "__k"), own.alias("__at")).filter("__at IS NOT NULL").distinct()
    if relation.kind == "parents":
        # Ancestors: every prefix of a source address, as a plain equi-join.
        keys = keys.select(*[f"__k{i}" for i in range(len(pairs))], F.explode(prefixes(F.col("__at"), strict)).alias("__at")).distinct()
        return target.join(keys, [*match_on(target, keys, pairs), theirs == keys["__at"]], "left_semi")
    # Descendants: the prefixes of a target address, as an equi-join that names the keys of the rows reached.
    names = list(dict.fromkeys([*target_table.key, *(b for _, b in pairs)]))
    rows = target.filter(theirs.isNotNull()).select(*[target[f"`{c}`"] for c in names], F.explode(prefixes(theirs, strict)).alias("__prefix"))
    under = rows.join(keys, [*match_on(rows, keys, pairs), rows["__prefix"] == keys["__at"]], "left_semi").select(*names).distinct()
    under = under.select(*[F.col(f"`{c}`").alias(f"__r{i}") for i, c in enumerate(names)])
    return target.join(under, [target[f"`{c}`"].eqNullSafe(under[f"__r{i}"]) for i, c in enumerate(names)], "left_semi")


def match_on(target: DataFrame, keys: DataFrame, pairs: list[tuple[str, str]]) -> list[Expr]:
    return [comparable(target, b) == keys[f"__k{i}"] for i, (_, b) in enumerate(pairs)]
