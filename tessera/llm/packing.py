"""Best-fit packing of tokenised documents into sequences of a fixed length.

Only lengths matter for packing, and there are at most ``capacity`` different
ones. The driver therefore plans on the histogram of lengths: whole batches of
equal sequences are formed at once, and the plan says which ranks of each
length class go to which sequences. Pieces get their rank within their length
class by a distributed prefix sum and look themselves up in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

PIECES = "{id} {type}, piece int, start long, length long, ids_crc32 long, __part int, __local long"


def best_two_fit(histogram: dict[int, int], capacity: int):
    """Placements (length, first rank, count, first sequence, offset) that pack all pieces.

    Each sequence is filled greedily with the largest pieces that fit. If a gap
    remains, the smallest piece is exchanged for the two unpacked pieces that
    fill the widened gap best, where that leaves less. A sequence's pattern is
    repeated for as many sequences as the counts allow before the next one is
    planned, so the work follows the number of different lengths.
    """
    import numpy as np

    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} does not fit {capacity}")
        count[length] = n
    rank = np.zeros(capacity + 1, dtype=np.int64)
    #: below[x]: the largest length of at most x that still has pieces, 0 if none.
    below = np.maximum.accumulate(np.where(count > 0, np.arange(capacity + 1), 0))

    def retire(length: int) -> None:
        end = length
        down = int(below[length - 1])
        while end <= capacity and below[end] == length:
            step = min(capacity + 1, end + 512)
            part = below[end:step]
            same = part == length
            part[same] = down
            if not same.all():
                break
            end = step

    def two(room: int, used: dict[int, int], least: int) -> tuple[int, int] | None:
        """The unpacked pair with the largest sum of at most ``room`` and above ``least``."""
        half = room // 2
        small = np.flatnonzero(count[: half + 1] > 0)
        small = small[small > 0]
        if not len(small):
            return None
        for a in used:
            if count[a] <= used[a]:
                small = small[small != a]
        large = below[np.minimum(room - small, capacity)].astype(np.int64)
        total = np.where(large >= small, small + large, 0)
        while len(total):
            i = int(total.argmax())
            if total[i] <= least:
                return None
            a, b = int(large[i]), int(small[i])
            if count[a] - used.get(a, 0) >= 1 + (a == b):
                return a, b
            # The larger partner is spoken for; take the next one below it.
            lower = int(below[a - 1])
            large[i] = lower
            total[i] = b + lower if lower >= b else 0
        return None

    placements: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    top = int(below[capacity])
    while top:
        used: dict[int, int] = {}
        gap, limit = capacity, capacity
        while gap and (length := int(below[min(gap, limit)])):
            used[length] = min(gap // length, int(count[length]))
            gap -= length * used[length]
            limit = length - 1
        if gap:
            smallest = min(used)
            used[smallest] -= 1
            if pair := two(gap + smallest, used, smallest):
                for x in pair:
                    used[x] = used.get(x, 0) + 1
            else:
                used[smallest] += 1
        used = {k: v for k, v in used.items() if v}
        times = min(int(count[k]) // v for k, v in used.items())
        offset = 0
        for length in sorted(used, reverse=True):
            for _ in range(used[length]):
                placements.append((length, int(rank[length]), times, sequence, offset))
                rank[length] += times
                offset += length
            count[length] -= times * used[length]
            if not count[length]:
                retire(length)
        sequence += times
        top = int(below[capacity])
    return placements, sequence


def token_pieces(df: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece of every document, with its task and its rank in the task's length class."""
    id_type = dict(df.dtypes)[id_col]

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from tessera.llm.tokens import encoder, together

        e = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4")
        part, seen = TaskContext.get().partitionId(), {}
        for batch in together(batches):
            rows, piece, start, length, crc, local = [], [], [], [], [], []
            for i, packed in enumerate(e.encode_many(batch.column(1).to_pylist())):
                ids = np.concatenate([np.frombuffer(packed, e.dtype).astype("<u4"), end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    n = len(own)
                    rows.append(i), piece.append(k), start.append(at), length.append(n), crc.append(zlib.crc32(own.tobytes()))
                    local.append(seen.get(n, 0))
                    seen[n] = local[-1] + 1
            yield pa.record_batch(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(local, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32", "__part", "__local"],
            )

    return df.select(id_col, text_col).mapInArrow(cut, PIECES.format(id=f"`{id_col}`", type=id_type))


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack every document; one row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents longer than ``capacity`` ids (with the end id) are cut into full
    pieces and a rest; others stay whole. Defined cases: a null or empty text
    is the end id alone. Repeated rows are packed separately, as are rows with
    equal or null ids. Very long texts are cut like any other. An empty table
    gives no rows. Other columns are ignored.
    """
    import numpy as np

    if capacity < 1:
        raise ValueError("a sequence must hold at least one id")

    spark = df.sparkSession
    pieces = materialise(token_pieces(df, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    counts = pieces.groupBy("__part", "length").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # At most ``capacity`` rows come to the driver, whatever the input.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    placements, _ = best_two_fit(histogram, capacity)
    plan = np.array(placements, dtype=np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast(plan)  # bounded by the number of lengths, not by the number of pieces

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        plan = shared.value
        heads = np.searchsorted(plan[:, 0], np.arange(capacity + 2))  # where each length's placements begin
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("__rank")).to_numpy()
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                at[own] = heads[n] + np.searchsorted(plan[heads[n] : heads[n + 1], 1], rank[own], side="right") - 1
            row = plan[at]
            columns = [batch.column(i) for i in range(5)] + [pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])]
            yield pa.record_batch(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    id_type = dict(df.dtypes)[id_col]
    ranked = pieces.join(offsets, ["__part", "length"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("__local") + F.col("__before")).alias("__rank"))
    return ranked.mapInArrow(place, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
