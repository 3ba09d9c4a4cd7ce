"""Token-id files: static range asymmetric numeral coding in interleaved blocks.

One frequency table, counted over all ids of the corpus, serves every file. A
file holds the documents of one id range as independent blocks; a block's
symbols are dealt to lanes that are coded in step. Each block carries its first
token's index (a checkpoint), its sizes and two checksums, so any block can be
found, checked and decoded alone.

File: ``TNS1`` | blocks | index | index length u32 | index crc u32 | ``TNSX``.
Block: symbols u32, lanes u16, words u32, first token u64, payload crc u32,
ids crc u32, then the lanes' end states (u64 each) and the words (u32 each).
Index: zlib of JSON with the blocks' offsets and first tokens, and of the
documents' ids and lengths.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh_path, materialise
from tessera.llm.files import committed, read_stream, shard_bounds

SCALE = 20
LANES = 1024
BLOCK = 1 << 18
_HEAD = struct.Struct("<IHIQII")
_LOW = 1 << 31


def frequencies(counts, scale: int = SCALE):
    """Counts scaled to sum 2**scale, at least one for every id that occurs."""
    import numpy as np

    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), dtype=np.uint32)
    if int((counts > 0).sum()) > 1 << scale:
        raise ValueError(f"more than {1 << scale} different ids occur; raise the scale")
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * ((1 << scale) / total)).astype(np.int64)), 0)
    rest = (1 << scale) - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    while rest:  # spread over the most frequent ids, which change least
        head = order[: min(abs(rest), max(1, int((freq > 1).sum())))]
        step = np.sign(rest)
        take = head if step > 0 else head[freq[head] > 1]
        freq[take] += step
        rest -= int(step) * len(take)
    return freq.astype(np.uint32)


class Coder:
    """Encodes and decodes blocks with one table."""

    def __init__(self, freq, scale: int = SCALE):
        import numpy as np

        self.np, self.scale = np, scale
        self.freq = np.asarray(freq, dtype=np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.lookup = np.repeat(np.arange(len(self.freq), dtype=np.uint16 if len(self.freq) <= 1 << 16 else np.uint32), self.freq.astype(np.int64))

    def encode(self, ids, first: int, lanes: int = LANES) -> bytes:
        np = self.np
        n = len(ids)
        steps = -(-n // lanes)
        state = np.full(lanes, _LOW, dtype=np.uint64)
        words = []
        scale, half = np.uint64(self.scale), np.uint64(32)
        # What the table says of every symbol is looked up for the whole block; a step divides and adds.
        every, starts = self.freq.take(ids), self.start.take(ids)
        limits, factors = every << np.uint64(63 - self.scale), (np.uint64(1) << scale) - every
        for t in range(steps - 1, -1, -1):
            own = slice(t * lanes, min(n, (t + 1) * lanes))
            x = state[: own.stop - own.start]
            full = (x >= limits[own]).nonzero()[0]
            if len(full):
                high = x.take(full)
                words.append(high.astype(np.uint32))
                x[full] = high >> half
            q = x // every[own]
            q *= factors[own]  # q << scale takes the place of q * f
            x += q
            x += starts[own]
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        payload = state.astype("<u8").tobytes() + stream.astype("<u4").tobytes()
        return _HEAD.pack(n, lanes, len(stream), first, zlib.crc32(payload), zlib.crc32(np.ascontiguousarray(ids, "<u4"))) + payload

    def decode(self, head: tuple, payload: bytes):
        np = self.np
        n, lanes, count, _, payload_crc, ids_crc = head
        if zlib.crc32(payload) != payload_crc:
            raise ValueError("a block's payload does not match its checksum")
        # States are below 2**63; signed ones are indices without a copy.
        state = np.frombuffer(payload, "<u8", lanes).astype(np.int64)
        stream = np.frombuffer(payload, "<u4", count, lanes * 8).astype(np.int64)
        freq, start = self.freq.astype(np.int64), self.start.astype(np.int64)
        out = np.empty(n, dtype=np.uint32)
        mask = (1 << self.scale) - 1
        at = 0
        for t in range(0, n, lanes):
            x = state[: min(lanes, n - t)]
            slot = x & mask
            s = self.lookup.take(slot)
            out[t : t + len(x)] = s
            x >>= self.scale
            x *= freq.take(s)
            x += slot
            x -= start.take(s)
            need = (x < _LOW).nonzero()[0]
            if len(need):
                x[need] = (x.take(need) << 32) | stream[at : at + len(need)]
                at += len(need)
        if zlib.crc32(np.ascontiguousarray(out, "<u4")) != ids_crc:
            raise ValueError("a block's ids do not match their checksum")
        return out


def write_table(uri: str, freq) -> None:
    body = freq.astype("<u4").tobytes()
    with committed(uri) as out:
        out.write(b"TNST" + struct.pack("<III", SCALE, len(freq), zlib.crc32(body)) + body)


def read_table(uri: str):
    import numpy as np

    with read_stream(uri) as f:
        raw = f.read()
    scale, n, crc = struct.unpack_from("<III", raw, 4)
    if raw[:4] != b"TNST" or zlib.crc32(raw[16:]) != crc:
        raise ValueError("the frequency table is damaged")
    return np.frombuffer(raw, "<u4", n, 16), scale


class FileWriter:
    """Writes documents of ascending ids as blocks; memory holds one block and the index."""

    def __init__(self, out, coder: Coder, first: int, block: int = BLOCK):
        import numpy as np

        self.np, self.out, self.coder, self.block = np, out, coder, block
        self.token, self.held, self.size = first, [], 0
        self.blocks, self.docs = [], []
        self.out.write(b"TNS1")
        self.at = 4

    def add(self, doc_id, ids) -> None:
        self.docs.append((doc_id, len(ids)))
        while len(ids):
            part = ids[: self.block - self.size]
            self.held.append(part)
            self.size += len(part)
            ids = ids[len(part) :]
            if self.size == self.block:
                self.flush()

    def flush(self) -> None:
        if self.size:
            raw = self.coder.encode(self.np.concatenate(self.held), self.token)
            self.blocks.append((self.at, self.token))
            self.out.write(raw)
            self.at += len(raw)
            self.token += self.size
            self.held, self.size = [], 0

    def close(self) -> int:
        self.flush()
        index = zlib.compress(json.dumps({"blocks": self.blocks, "docs": self.docs}).encode(), 6)
        self.out.write(index + struct.pack("<II", len(index), zlib.crc32(index)) + b"TNSX")
        return self.at + len(index) + 12


def read_index(uri: str) -> dict:
    from tessera.llm.files import filesystem

    files, path = filesystem(uri)
    with files.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 12)
        tail = f.read(12)
        length, crc = struct.unpack("<II", tail[:8])
        f.seek(size - 12 - length)
        raw = f.read(length)
    if tail[8:] != b"TNSX" or zlib.crc32(raw) != crc:
        raise ValueError(f"the index of {uri} is damaged")
    return json.loads(zlib.decompress(raw))


def read_blocks(uri: str, coder: Coder, first_block: int = 0, last_block: int | None = None) -> Iterator:
    """The ids of a file's blocks, decoded one by one from a checkpoint on."""
    from tessera.llm.files import filesystem

    blocks = read_index(uri)["blocks"][first_block:last_block]
    files, path = filesystem(uri)
    with files.open_input_file(path) as f:
        for at, token in blocks:
            f.seek(at)
            head = _HEAD.unpack(f.read(_HEAD.size))
            if head[3] != token:
                raise ValueError(f"a block of {uri} is not where the index has it")
            yield coder.decode(head, f.read(head[1] * 8 + head[2] * 4))


def write_token_files(df: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_bytes: int = 32 << 20) -> DataFrame:
    """Encode all texts and write them in ascending id order; the manifest: shard, uri, start, n_tokens, n_docs, bytes.

    ``path``: a folder that driver and executors share (default: a new one below
    spark.checkpoint.dir). Defined cases: a null or empty text is the end id
    alone; null ids come first; rows with equal ids are ordered by the bytes of
    their packed ids, and repeated rows are written each. Very long texts run
    over as many blocks as they need. An empty table gives an empty manifest.
    Other columns are ignored.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, "token-files")
    source = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = shard_bounds(source, F.col("id"), F.octet_length("text") + 64, shard_bytes)

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tessera.llm.tokens import encoder, together

        e, tops = encoder(tokenizer), np.array(bounds, dtype=np.int64)
        end = np.array([end_id], dtype=e.dtype).tobytes()
        for part in together(batches):
            ids = [x + end for x in e.encode_many(part.column(1).to_pylist())]
            shard = np.searchsorted(tops, part.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="left")  # null ids go to the first
            yield pa.record_batch([pa.array(shard.astype(np.int32)), part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // e.dtype.itemsize for x in ids], pa.int64()), pa.array([e.dtype.itemsize] * len(ids), pa.int32())], names=["shard", "id", "ids", "n", "width"])

    tokens = source.select("id", "text").mapInArrow(encode, "shard int, id long, ids binary, n long, width int")
    tokens = materialise(tokens, "token-ids")

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        seen = np.zeros(0, dtype=np.int64)
        for batch in batches:
            # All of a batch at once: a count per document would clear a whole table for each.
            width = batch.column(1)[0].as_py() if batch.num_rows else 2
            own = np.bincount(np.frombuffer(b"".join(x.as_buffer() for x in batch.column(0)), f"<u{width}"))
            if len(own) > len(seen):
                seen = np.concatenate([seen, np.zeros(len(own) - len(seen), np.int64)])
            seen[: len(own)] += own
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["token", "n"])

    import numpy as np

    # One row per vocabulary entry at most comes to the driver.
    rows = tokens.select("ids", "width").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["token"] for r in rows), default=0) + 1, dtype=np.int64)
    for r in rows:
        counts[r["token"]] = r["n"]
    write_table(f"{path}/table.bin", frequencies(counts))
    # One row per shard: where each shard's tokens start.
    sizes = {r["shard"]: (r["n"], r["d"]) for r in tokens.groupBy("shard").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).collect()}
    starts, at = {}, 0
    for shard in sorted(sizes):
        starts[shard] = at
        at += sizes[shard][0]
    table_uri = f"{path}/table.bin"

    def write(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        coder, open_shard, stack, writer, done = None, None, None, None, []

        def finish():
            size, n = writer.close(), (writer.token - starts[open_shard], len(writer.docs))
            stack.__exit__(None, None, None)
            done.append((open_shard, f"{path}/shard-{open_shard:06d}.tns", starts[open_shard], *n, size))

        try:
            for batch in batches:
                coder = coder or Coder(*read_table(table_uri))
                for shard, doc_id, raw, width in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(4).to_pylist()):
                    if shard != open_shard:
                        if stack is not None:
                            finish()
                        stack = committed(f"{path}/shard-{shard:06d}.tns")
                        writer, open_shard = FileWriter(stack.__enter__(), coder, starts[shard]), shard
                    writer.add(doc_id, np.frombuffer(raw.as_buffer(), f"<u{width}"))
            if stack is not None:
                finish()
                stack = None
        except BaseException as e:
            if stack is not None:
                stack.__exit__(type(e), e, e.__traceback__)
            raise
        columns = list(zip(*done)) or [[]] * 6
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["shard", "uri", "start", "n_tokens", "n_docs", "bytes"])

    ordered = tokens.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "id", "ids")
    manifest = materialise(ordered.mapInArrow(write, "shard int, uri string, start long, n_tokens long, n_docs long, bytes long"), "token-manifest")
    with committed(f"{path}/manifest.json") as out:
        out.write(json.dumps({"table": "table.bin", "files": [r.asDict() for r in manifest.orderBy("shard").collect()]}).encode())
    return manifest.withColumn("table_uri", F.lit(table_uri))


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode the files of a manifest; one row per document: id, start, n_tokens, ids_crc32.

    Null and repeated ids come back as they were written; an empty manifest
    gives no rows; a damaged file raises ValueError.
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coders: dict[str, Coder] = {}
        for batch in batches:
            for uri, table_uri, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if table_uri not in coders:
                    coders[table_uri] = Coder(*read_table(table_uri))
                docs = read_index(uri)["docs"]
                crcs, k, left, crc = [], 0, docs[0][1] if docs else 0, 0
                for ids in read_blocks(uri, coders[table_uri]):
                    raw, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), 0
                    while at < len(raw):
                        take = min(left * 4, len(raw) - at)
                        crc = zlib.crc32(raw[at : at + take], crc)
                        at, left = at + take, left - take // 4
                        if not left:
                            crcs.append(crc)
                            k, crc = k + 1, 0
                            left = docs[k][1] if k < len(docs) else 0
                if k != len(docs):
                    raise ValueError(f"{uri} holds fewer documents than its index names")
                starts, at = [], start
                for _, n in docs:
                    starts.append(at)
                    at += n
                yield pa.record_batch([pa.array([d for d, _ in docs], pa.int64()), pa.array(starts, pa.int64()), pa.array([n for _, n in docs], pa.int64()), pa.array(crcs, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    files = manifest.select("uri", "table_uri", "start")
    spark: SparkSession = manifest.sparkSession
    n = max(1, manifest.count())
    spread = files.repartitionByRange(n, "uri") if n > 1 else files
    return spread.mapInArrow(read, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
