"""The fork check: does the block before the range have the hash that the client expects?"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.plans.request import Query
from tessera.sources.chunks import TableSource

WINDOW = 100


def check_parent(query: Query, source: TableSource) -> None:
    """Raise UnexpectedBaseBlock where the chunk knows better. At most WINDOW + 1 rows come to the driver."""
    if query.parent_hash is None:
        return
    table = query.catalog.block_table
    df = source.table(table.name)
    for c in (table.parent_hash, table.parent_number):
        if c and c not in df.columns:
            raise QueryError("ColumnNotFound", f"{table.name} has no column {c}", c)
    number, start = F.col(f"`{table.block}`"), F.lit(query.from_block)
    columns = [number.alias("n"), F.col(f"`{table.parent_hash}`").alias("p")] + ([F.col(f"`{table.parent_number}`").alias("pn")] if table.parent_number else [])
    here = df.filter(number >= start).select(*columns)
    here = here.filter(F.col("pn") < start) if table.parent_number else here.filter(F.col("n") == start)
    row = here.orderBy("n").first()
    if row is None or row["p"] == query.parent_hash:
        return
    behind = df.filter(number.between(max(0, query.from_block - WINDOW), query.from_block)).select(*columns).orderBy(F.desc("n")).limit(WINDOW).collect()
    pairs = sorted({(int(r["pn"] if table.parent_number else r["n"] - 1), r["p"]) for r in [row, *behind] if r["p"] is not None and (r["n"] > 0)})
    newest = f"{pairs[-1][1]} (block {pairs[-1][0]})" if pairs else "unknown"
    raise QueryError("UnexpectedBaseBlock", f"block {row['n']} does not follow {query.parent_hash}; the newest known parent is {newest}", "parentBlockHash", pairs)
