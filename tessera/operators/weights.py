"""Weights of rows and blocks, and the page they allow."""

from __future__ import annotations

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.catalog import DEFAULT_WEIGHT, Table

LONG_MAX = (1 << 63) - 1


def weighed_columns(table: Table, shown: list[str]) -> list[str]:
    """Columns that a row is charged for: the weight key and what selected fields render, each once, hidden ones free."""
    fields = table.fields()
    names = dict.fromkeys([*table.weight_key, *(c for f in shown for c in fields[f])])
    return [c for c in names if not table.columns[c].hidden]


def size_columns(table: Table, shown: list[str]) -> list[str]:
    return list(dict.fromkeys(w for c in weighed_columns(table, shown) if isinstance(w := table.columns[c].weight, str)))


def fixed_weight(table: Table, shown: list[str]) -> int:
    """What every row is charged at least: the columns whose weight is no size column."""
    own = [table.columns[c].weight for c in weighed_columns(table, shown)]
    return sum(DEFAULT_WEIGHT if w is None else w for w in own if not isinstance(w, str))


def row_weight(table: Table, shown: list[str]) -> Expr:
    total = F.lit(fixed_weight(table, shown)).cast("decimal(38,0)")
    for w in (table.columns[c].weight for c in weighed_columns(table, shown)):
        if isinstance(w, str):
            total = total + F.greatest(F.coalesce(F.col(f"`{w}`").cast("decimal(38,0)"), F.lit(0)), F.lit(0))
    return total.cast("decimal(38,0)")


def block_weights(head: DataFrame, own: list[DataFrame]) -> DataFrame:
    """(block, weight, filled) from rows of (block, weight) of headers and of items, in one pass; filled: the block has items.

    Weights saturate at the largest long.
    """
    rows = head.withColumn("filled", F.lit(False))
    for p in own:
        rows = rows.unionByName(p.withColumn("filled", F.lit(True)))
    total = F.least(F.coalesce(F.try_sum("weight"), F.lit(LONG_MAX).cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)"))
    return rows.groupBy("block").agg(total.alias("weight"), F.max("filled").alias("filled"))


def page(weights: DataFrame, budget: int, least_weight: int) -> DataFrame:
    """The longest ascending prefix of blocks within the budget, never fewer than one: block, weight, total.

    No page has more blocks than the budget holds headers, so only so many of
    the lowest blocks are ordered in one place.
    """
    most = budget // max(1, least_weight) + 1
    first = weights.orderBy("block").limit(most) if most < 1 << 31 else weights
    order = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    summed = first.withColumn("total", F.sum("weight").over(order)).withColumn("__n", F.row_number().over(Window.orderBy("block")))
    return summed.filter((F.col("total") <= budget) | (F.col("__n") == 1)).drop("__n")
