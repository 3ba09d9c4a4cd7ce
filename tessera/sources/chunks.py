"""Chunk sources: where the tables of a block range come from."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.catalog import Catalog
from tessera.errors import QueryError


class TableSource(Protocol):
    """What the engine reads from."""

    def has_table(self, name: str) -> bool: ...

    def table(self, name: str) -> DataFrame:
        """The table's rows; QueryError(TableNotFound) if there are none."""
        ...

    def holds_null(self, name: str, column: str) -> bool:
        """Whether a block number is missing. A source that vouches for its rows answers no."""
        ...


class ParquetSource:
    """Chunk directories with one Parquet file or folder per table. Several directories read as one range."""

    def __init__(self, spark: SparkSession, directories: str | Iterable[str]):
        self.spark = spark
        self.directories = [directories] if isinstance(directories, str) else list(directories)
        self._read: dict[str, DataFrame | None] = {}
        self._nulls: dict[tuple[str, str], bool] = {}

    def _open(self, name: str) -> DataFrame | None:
        if name not in self._read:
            try:
                self._read[name] = self.spark.read.parquet(*[f"{d.rstrip('/')}/{name}.parquet" for d in self.directories])
            except AnalysisException:
                self._read[name] = None
        return self._read[name]

    def has_table(self, name: str) -> bool:
        return self._open(name) is not None

    def table(self, name: str) -> DataFrame:
        df = self._open(name)
        if df is None:
            raise QueryError("TableNotFound", f"the chunk has no table {name}", name)
        return df

    def holds_null(self, name: str, column: str) -> bool:
        # Row groups whose footer counts no nulls are skipped, so this reads footers where writers keep counts. Chunks don't change, so it is asked once.
        if (name, column) not in self._nulls:
            self._nulls[name, column] = not self.table(name).filter(F.col(f"`{column}`").isNull()).select(column).isEmpty()
        return self._nulls[name, column]


class FrameSource:
    """Tables held as DataFrames: in-memory or derived chunks.

    ``vouched``: their block numbers are known to be set. ``laid_out``: names of
    tables that come in ranges of their blocks (``ranged``) and in key order.
    """

    def __init__(self, tables: dict[str, DataFrame], vouched: bool = True, laid_out: Iterable[str] = ()):
        self.tables, self.vouched, self.laid_out = tables, vouched, frozenset(laid_out)

    def has_table(self, name: str) -> bool:
        return name in self.tables

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise QueryError("TableNotFound", f"the chunk has no table {name}", name)
        return self.tables[name]

    def holds_null(self, name: str, column: str) -> bool:
        return not self.vouched and not self.table(name).filter(F.col(f"`{column}`").isNull()).isEmpty()


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or an own one where it is unset and the master is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + _folders.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tessera-chunks-"))


#: Rows that one task of a written chunk takes, about: few enough to be sorted in memory.
TASK_ROWS = 1 << 19


def ranged(df: DataFrame, block: str, rows: int) -> DataFrame:
    """Rows dealt by ranges of block numbers, in tasks of a bounded size. ``rows``: how many there are, about.

    All rows of a block come to one task, so what is grouped or ordered within
    blocks afterwards needs no other shuffle. Ranges are sampled by a run of
    ``df``: derive wide columns afterwards.
    """
    return df.repartitionByRange(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), block)


def write_chunk(tables: dict[str, DataFrame], catalog: Catalog, directory: str, mode: str = "error", laid_out: Iterable[str] = ()) -> None:
    """Write a chunk laid out for skipping: block numbers signed, rows sorted by each table's sort key. Tables ``laid_out`` are so already."""
    for name, df in tables.items():
        t = catalog.tables[name]
        kind = dict(df.dtypes)[t.block]
        if kind.startswith("decimal"):
            df = df.withColumn(t.block, df[t.block].cast("long"))
        if name not in laid_out:
            keys = [k for k in (t.sort_key or t.key) if k in df.columns]
            df = df.repartitionByRange(t.block).sortWithinPartitions(*keys)
        df.write.mode(mode).option("compression", "zstd").parquet(f"{directory.rstrip('/')}/{name}.parquet")


class DerivedSource(ParquetSource):
    """A Parquet chunk of derived tables, each written at its first use."""

    def __init__(self, spark: SparkSession, directory: str, tables: FrameSource, catalog: Catalog):
        super().__init__(spark, directory)
        self.derived, self.catalog = tables, catalog

    def _open(self, name: str) -> DataFrame | None:
        if name not in self._read and self.derived.has_table(name):
            write_chunk({name: self.derived.table(name)}, self.catalog, self.directories[0], laid_out=self.derived.laid_out)
        return super()._open(name)
