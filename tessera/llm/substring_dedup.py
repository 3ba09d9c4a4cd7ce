"""Suffix-array dedup: bytes covered by long strings that occur elsewhere go.

Suffix arrays of shards decide which strings repeat; the rest of the work deals
the text to shards so that equal strings meet in one. Every window of
``length`` bytes has an anchor, the leftmost least k-gram digest in it, so equal
windows have equal anchors at equal offsets. Consecutive windows with one
anchor form a run, and the anchor is the run's key: runs with one key go to one
shard. A run alone under its key holds no repeat and is left out. Of runs with
equal bytes one is sorted, and what the arrays say of it holds for all of them.
Runs that occur several times go to a shard together with their neighbours of
that kind, as one stretch of text, twice; under their keys they stand once, and
only where a run that occurs once has to be compared with them. A key with more text than a shard holds is
divided: windows are split by the anchor's offset in them, and those of one half
share more bytes around the anchor, which are digested into the new key. This
goes on until every key fits; at the end a key would be one window. Of the runs
under one key, only windows that share more bytes around the anchor with another
run's are sorted.

A shard is sorted as one suffix array by induced sorting, and permuted common
prefixes of ``length`` bytes or more tell the repeated windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.suffix_array import repeated_starts

GRAM = 32
#: Windows digested at a time, which bounds memory for very long texts; the anchor's place takes the low 20 bits.
SEGMENT = 1 << 19
_PLACE = np.uint64(20)
#: Bytes of one key's text; a key with more is divided. Whole keys make up arrays of sixteen times as much.
SHARD = 1 << 18
#: Bytes of a stretch of neighbouring runs.
STRETCH = 1 << 16
#: Parts of a piece's windows, by the anchor's offset in them, that are left out alone.
PARTS = 8
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def runs(data: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor digest, anchor place, first window, windows) of the runs of ``data``, by segments."""
    total = len(data) - length + 1
    for at in range(0, max(0, total), SEGMENT):
        n = min(SEGMENT, total - at)
        part = data[at : at + n + length - 1]
        raw = np.frombuffer(part, np.uint8)
        words = np.ndarray((len(raw) - 7,), np.uint64, part, strides=(1,))  # the eight bytes at every position
        grams = len(raw) - GRAM + 1
        h = words[:grams] * _ODD[0]
        for k in range(1, 4):
            h = (h ^ (h >> np.uint64(31))) + words[8 * k : 8 * k + grams] * _ODD[k]
        h = (h ^ (h >> np.uint64(29))) * _ODD[1]
        h ^= h >> np.uint64(32)
        least = ((h >> _PLACE) << _PLACE) | np.arange(grams, dtype=np.uint64)
        width, done = length - GRAM + 1, 1
        while done * 2 <= width:
            least = np.minimum(least[:-done], least[done:])
            done *= 2
        if done < width:
            least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        own = least[first]
        count = np.diff(np.concatenate([first, [len(least)]]))
        yield (own >> _PLACE).astype(np.int64), (own & np.uint64((1 << 20) - 1)).astype(np.int64) + at, first + at, count


def _packed(first, windows, place):
    """A run's first window, its number of windows and its anchor's offset in one integer."""
    return (first << 24) | (windows << 12) | (place - first)


def _first(at):
    return F.shiftright(at, 24)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def divided(data: bytes, place: int, low: int, high: int, length: int) -> list[tuple[int, int, int, int, int, bytes]]:
    """A piece's windows in two halves by the anchor's offset in them.

    ``data`` holds the windows whose anchor, at ``place`` in it, has the offsets
    low to high - 1 in them (or some of these). Gives (first window, place, low,
    high, context's digest, bytes) of each half that has windows; the context is
    what all windows with those offsets share.
    """
    import xxhash

    last, middle, out = len(data) - length, (low + high) // 2, []
    for lo, hi in ((middle, high), (low, middle)):
        first, to = max(0, place - hi + 1), min(last, place - lo)
        if first <= to:
            context = data[place - lo : place - hi + 1 + length]
            out.append((first, place - first, lo, hi, xxhash.xxh3_64_intdigest(b"%d %d " % (lo, hi) + context), data[first : to + length]))
    return out


def _zip(batches: Iterator) -> Iterator:
    """Texts are read three times, so they are compressed well once."""
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([pack.compress(x.as_buffer()) for x in batch.column(2)], pa.binary())], names=["row", "id", "data"])


def _batch(rows: list[tuple], types: list, names: list[str]):
    import pyarrow as pa

    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)


def _find(length: int):
    """Runs of the texts: row, anchor, digest, and the run's place packed."""

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        import zstandard

        names, unzip = ["row", "anchor", "digest", "at"], zstandard.ZstdDecompressor()
        for batch in batches:
            held: list[list] = [[] for _ in names]
            size = 0
            for row, zipped in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = unzip.decompress(zipped.as_buffer())
                view = memoryview(data)
                for anchor, place, first, count in runs(data, length):
                    digest = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (first + count + length - 1).tolist())]
                    for column, values in zip(held, (np.full(len(first), row), anchor, np.array(digest, np.uint64).view(np.int64), _packed(first, count, place))):
                        column.append(values)
                    size += len(first)
                if size > 50_000:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in held], names=names)
                    held, size = [[] for _ in names], 0
            if size:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in held], names=names)

    return find


PIECE = "key long, digest long, copies int, low int, high int, place int, data binary"
#: The runs of a stretch, one after another; null for a piece of one run, empty for one that is settled.
RUNS = "array<struct<anchor:long,digest:long,windows:long>>"


def _cut(length: int):
    """The bytes of the wanted runs of each text, as pieces; neighbours that occur several times as one."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        import zstandard

        own_runs = pa.list_(pa.struct([("anchor", pa.int64()), ("digest", pa.int64()), ("windows", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), own_runs]
        names = ["key", "digest", "copies", "low", "high", "place", "data", "runs"]
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, size = [], 0
            for row, zipped, cuts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = unzip.decompress(zipped.as_buffer())
                begin, end, held = 0, -1, []

                def close():
                    own = data[begin : end + length - 1]
                    rows.append((_signed(xxhash.xxh3_64_intdigest(b"%d %d" % (row, begin))), 0, 2, 0, 0, 0, own, held))
                    return len(own)

                for c in sorted(cuts.as_py(), key=lambda c: c["at"]):
                    at = c["at"]
                    first, windows, place = at >> 24, at >> 12 & 4095, at & 4095
                    if c["copies"] > 1:
                        if held and (first != end or end - begin > STRETCH):
                            size += close()
                            held = []
                        if not held:
                            begin = first
                        end = first + windows
                        held.append({"anchor": c["anchor"], "digest": c["digest"], "windows": windows})
                    if c["open"]:
                        # Runs that occur several times are there for the others to meet: no stretch of theirs is reported again.
                        own = data[first : first + windows + length - 1]
                        rows.append((c["anchor"], c["digest"], 1, 0, length - GRAM + 1, place, own, [] if c["copies"] > 1 else None))
                        size += len(own)
                if held:
                    size += close()
                if size > 4 << 20:
                    yield _batch(rows, types, names)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, types, names)

    return cut


def _divide(length: int):
    """Pieces of keys that are too large, each in two, with what they were cut from."""

    def divide(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        types = [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.binary()]
        names = ["old_key", "old_digest", "shift", "key", "digest", "copies", "low", "high", "place", "data"]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for first, place, low, high, context, data in divided(r["data"], r["place"], r["low"], r["high"], length):
                    key = _signed(xxhash.xxh3_64_intdigest(b"%d %d" % (r["key"], context)))
                    digest = _signed(xxhash.xxh3_64_intdigest(b"%d " % place + data))
                    rows.append((r["key"], r["digest"], first, key, digest, r["copies"], low, high, place, data))
            yield _batch(rows, types, names)

    return divide


def met(pieces: list[tuple], length: int) -> Iterator[tuple[tuple, int, bytes]]:
    """Pieces of one key with the windows that can be repeated: (piece, windows left out before them, bytes).

    A piece is (copies, runs, low, high, place, data, ...). All its windows with
    an anchor's offset from lo to hi - 1 share the bytes ``context``; if these
    occur in no other piece, neither do the windows. Nor is there anything to
    find out where only settled pieces hold them.
    """
    parts, seen, unsettled = [], {}, set()
    for copies, runs, low, high, place, data, *_ in pieces:
        own, last, width = [], len(data) - length, -(-(high - low) // PARTS)
        for lo in range(low, high, width or 1):
            hi = min(lo + width, high)
            first, to = max(0, place - hi + 1), min(last, place - lo)
            if first <= to:
                context = data[place - lo : place - hi + 1 + length]
                seen[context] = seen.get(context, 0) + copies
                if runs is None:
                    unsettled.add(context)
                own.append((first, to, context))
        parts.append(own)
    for piece, own in zip(pieces, parts):
        if piece[0] > 1:
            yield piece, 0, piece[5]
        else:
            kept = [(first, to) for first, to, context in own if seen[context] > 1 and context in unsettled]
            if kept:
                first, to = kept[-1][0], kept[0][1]  # parts go from the last windows to the first
                yield piece, first, piece[5][first : to + length]


def _sort(length: int, shard: int):
    """Suffix arrays of whole keys, a few times ``shard`` bytes together: how often the piece was divided, key, digest, first and last window of each repeated stretch."""

    def sort(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types, names = [pa.int32(), *[pa.int64()] * 4], ["depth", "key", "digest", "first", "last"]

        def array(pieces: list[tuple]) -> list[tuple]:
            out = []
            starts = repeated_starts([data for piece, _, data in pieces for _ in range(piece[0])], length)
            at = 0
            for (copies, runs, _, _, _, _, key, digest, depth), shift, data in pieces:
                own = starts[at]
                at += copies
                offset = 0
                for r in ({"anchor": key, "digest": digest, "windows": len(data) - length + 1},) if runs is None else runs:
                    to = offset + r["windows"]
                    part = own[np.searchsorted(own, offset) : np.searchsorted(own, to)] - offset + shift
                    offset = to
                    if len(part):
                        edge = np.flatnonzero(np.diff(part) > 1)
                        out += [(depth, r["anchor"], r["digest"], a, b) for a, b in zip(part[np.concatenate([[0], edge + 1])].tolist(), part[np.concatenate([edge, [len(part) - 1]])].tolist())]
            return out

        group, held, size = [], [], 0
        for batch in batches:
            for key, digest, depth, copies, low, high, place, data, runs in zip(*(batch.column(k).to_pylist() for k in range(7)), batch.column(7), batch.column(8)):
                if group and key != group[-1][6]:
                    for own in met(group, length):
                        held.append(own)
                        size += own[0][0] * len(own[2])
                    group = []
                    if size > 16 * shard:
                        yield _batch(array(held), types, names)
                        held, size = [], 0
                group.append((copies, runs.as_py(), low, high, place, data.as_py(), key, digest, depth))
        held += met(group, length)
        if held:
            yield _batch(array(held), types, names)

    return sort


def _remove(id_col: str):
    def remove(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = []
                for doc_id, data, spans in zip(*(batch.column(i) for i in range(3))):
                    data = unzip.decompress(data.as_buffer())
                    kept, end, gone, n = [], 0, 0, 0
                    for a, b in sorted((s["a"], s["b"]) for s in spans.as_py() or ()):
                        if a > end or not n:
                            kept.append(data[end:a])
                            n += 1
                            gone += b - a
                            end = b
                        elif b > end:
                            gone += b - end
                            end = b
                    kept.append(data[end:])
                    rows.append((doc_id.as_py(), len(data), gone, n, b"".join(kept)))
                yield _batch(rows, [pa.int64()] * 4 + [pa.binary()], [id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return remove


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, shard: int = SHARD) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else.

    One row per input row: id, n_bytes, n_removed, n_spans, kept (binary: the
    remaining UTF-8 bytes). Strings are judged on the input, never cross rows,
    and may overlap. Defined cases: null texts are empty; texts shorter than
    ``length`` keep all; repeated rows are repeats of each other, so all their
    windows go; rows are told apart by a number of their own, so null and
    repeated ids do no harm; very long texts are digested by segments. An empty
    table gives no rows. Other columns are ignored.
    """
    if not 2 * GRAM <= length <= 4000:
        raise ValueError(f"length must lie between {2 * GRAM} and 4000")
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"))
    # Written once, so that a row keeps its number.
    texts = materialise(docs.mapInArrow(_zip, "row long, id long, data binary"), "texts", "uncompressed")

    every = materialise(texts.select("row", "data").mapInArrow(_find(length), "row long, anchor long, digest long, at long"), "runs")
    anchors = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    shared = materialise(every.join(materialise(anchors, "anchors"), "anchor"), "shared-runs")
    # One text of each different run, and whether there are several.
    different = shared.groupBy("anchor", "digest").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("copies"), F.min(F.struct("row", "at")).alias("one"))
    different = materialise(different.select("anchor", "digest", "copies", "one.row", "one.at"), "different-runs")
    # A key is open if a run under it occurs once: only then is there something to find out.
    open_keys = different.groupBy("anchor").agg((F.min("copies") == 1).alias("open"))
    wanted = different.join(open_keys, "anchor").groupBy("row").agg(F.collect_list(F.struct("anchor", "digest", "copies", "at", "open")).alias("cuts"))
    pieces = materialise(texts.join(wanted, "row").select("row", "data", "cuts").mapInArrow(_cut(length), f"{PIECE}, runs {RUNS}"), "pieces", "zstd")

    # Keys that are too large are divided by rounds; parts: which stretch of which run a piece is.
    todo, parts, fitting = pieces, None, []
    for _ in range((length - GRAM + 1).bit_length() + 1):
        large = todo.groupBy("key").agg(F.sum(F.col("copies") * F.octet_length("data")).alias("n"), F.max(F.col("high") - F.col("low")).alias("w")).filter((F.col("n") > shard) & (F.col("w") > 1)).select("key")
        large = materialise(large, "large-keys")
        if large.isEmpty():
            fitting.append((todo, parts))
            break
        fitting.append((todo.join(large, "key", "left_anti"), parts))
        halves = materialise(todo.join(large, "key").select("key", "digest", "copies", "low", "high", "place", "data").mapInArrow(_divide(length), "old_key long, old_digest long, shift int, " + PIECE), "halves", "zstd")
        todo = halves.groupBy("key", "digest").agg(F.least(F.sum("copies"), F.lit(2)).cast("int").alias("copies"), *[F.first(c).alias(c) for c in ("low", "high", "place", "data")], F.lit(None).cast(RUNS).alias("runs"))
        todo = materialise(todo, "pieces", "zstd")
        links = halves.select("key", "digest", "old_key", "old_digest", "shift")
        if parts is None:
            parts = links.select("key", "digest", F.col("old_key").alias("anchor"), F.col("old_digest").alias("run"), "shift")
        else:
            before = parts.select(F.col("key").alias("old_key"), F.col("digest").alias("old_digest"), "anchor", "run", F.col("shift").alias("more"))
            parts = links.join(before, ["old_key", "old_digest"]).select("key", "digest", "anchor", "run", (F.col("shift") + F.col("more")).alias("shift"))
        parts = materialise(parts, "parts")

    every_piece = [own.select("key", "digest", F.lit(k).alias("depth"), "copies", "low", "high", "place", "data", "runs") for k, (own, _) in enumerate(fitting)]
    dealt = reduce(lambda a, b: a.unionByName(b), every_piece).repartition("key").sortWithinPartitions("key", "digest")
    found = materialise(dealt.mapInArrow(_sort(length, shard), "depth int, key long, digest long, first long, last long"), "repeated")
    stretches = found.filter("depth = 0").select(F.col("key").alias("anchor"), "digest", "first", "last")
    for k, (_, links) in enumerate(fitting):
        if k:
            below = found.filter(F.col("depth") == k).join(links, ["key", "digest"])
            stretches = stretches.unionByName(below.select("anchor", F.col("run").alias("digest"), (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last")))
    holders = shared.join(stretches, ["anchor", "digest"]).select("row", (_first(F.col("at")) + F.col("first")).alias("a"), (_first(F.col("at")) + F.col("last") + length).alias("b"))
    spans = holders.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = texts.join(spans, "row", "left").select("id", "data", "spans")
    return joined.mapInArrow(_remove(id_col), f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept binary")
