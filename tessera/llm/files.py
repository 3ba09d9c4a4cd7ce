"""Files in shared storage, written from tasks: temporary names, renames, ordered shards."""

from __future__ import annotations

import contextlib
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filesystem(uri: str):
    """pyarrow's file system for a URI and the path in it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def committed(uri: str):
    """A binary stream that appears under ``uri`` only when it was written whole.

    Each attempt writes under a name of its own, so a retried or speculative
    task never meets a half-written file; the last rename wins, and all
    attempts of a deterministic task write the same bytes.
    """
    files, path = filesystem(uri)
    parent, _, name = path.rpartition("/")
    files.create_dir(parent, recursive=True)
    temporary = f"{parent}/.{name}.{uuid.uuid4().hex}.tmp"
    stream = files.open_output_stream(temporary, compression=None)
    try:
        yield stream
        stream.close()
        files.move(temporary, path)
    except BaseException:
        with contextlib.suppress(Exception):
            stream.close()
        with contextlib.suppress(Exception):
            files.delete_file(temporary)
        raise


def read_stream(uri: str):
    files, path = filesystem(uri)
    return files.open_input_stream(path, compression=None, buffer_size=1 << 20)


#: Key bits that one pass looks at: a heavy range is divided into so many powers of two.
BITS = 11


def shard_bounds(df: DataFrame, key: Column, weight: Column, target: int) -> list[int]:
    """The largest key of every shard but the last, so that shards hold about ``target`` weight each.

    Deterministic for the data: weights are summed by the keys' leading bits,
    and all ranges that are too heavy are divided by their next bits in one
    more pass, so any 64-bit keys take at most six passes however many there
    are. Rows with one key stay together. The driver gets at most 2048 rows for
    each range heavier than a shard, and keeps one bound per shard.
    """
    spark = df.sparkSession
    keyed = df.select(key.cast("long").alias("k"), weight.cast("long").alias("w")).filter("k IS NOT NULL")
    low, high, total = keyed.agg(F.min("k"), F.max("k"), F.sum("w")).first()
    if low is None or not total or total <= target:
        return []
    shift = max(0, ((low ^ high) & ((1 << 64) - 1)).bit_length() - BITS)
    done: list[tuple[int, int]] = []
    while True:
        rows = keyed.groupBy(F.shiftright("k", shift).alias("b")).agg(F.sum("w").alias("w"), F.max("k").alias("top"), F.min("k").alias("first")).collect()
        heavy = [r["b"] for r in rows if r["w"] > target and r["top"] > r["first"]] if shift else []
        held = set(heavy)
        done += [(r["top"], r["w"]) for r in rows if r["b"] not in held]
        if not heavy:
            break
        # One row per heavy range, of which there are fewer than shards.
        some = spark.createDataFrame([(b,) for b in heavy], "b long")
        keyed = keyed.join(F.broadcast(some), F.shiftright("k", shift) == some["b"], "left_semi")
        shift = max(0, shift - BITS)
    shards = max(1, math.ceil(total / target))
    bounds, seen = [], 0
    for top, w in sorted(done):
        if seen and seen + w / 2 > total * (len(bounds) + 1) / shards and len(bounds) < shards - 1:
            bounds.append(last)
        seen, last = seen + w, top
    return bounds


def shard_of(key: Column, bounds: list[int]) -> Column:
    """The number of a key's shard; null keys go to the first."""
    tops = np.array(bounds, dtype="int64")

    @F.pandas_udf("int")
    def find(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(tops, k.fillna(-(1 << 63)).astype("int64"), side="left").astype("int32"))

    return find(key.cast("long"))
