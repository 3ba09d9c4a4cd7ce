"""Deterministic sharded WARC writer and reader.

Records are dealt to shards by ranges of their id and sorted within them; each
shard is a series of .warc.gz files, one gzip member per record, rolled by
compressed size. All headers and digests are made anew from the payload, so
the same rows give the same bytes. Files appear by renaming, and the manifest,
written last, names those that count.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh_path, materialise
from tessera.llm.files import committed, read_stream, shard_bounds, shard_of

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tessera:warc")


def _record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, key)}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(url: str | None) -> str:
    """A header value: control characters and spaces are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "urn:null"


def record(kind: str, page_id: int | None, ordinal: int, url: str | None, payload: bytes, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One record's bytes. A revisit has the HTTP head of the full payload and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _record_id(f"{page_id}/{ordinal}")),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Page-ID", "null" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", _sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        head[4:4] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(f"{refers_to}/0")), ("WARC-Refers-To-Page-ID", str(refers_to))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    body = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id(name)}\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roll:
    """The files of one shard: rolled by compressed size."""

    def __init__(self, path: str, shard: int, limit: int):
        self.path, self.shard, self.limit = path, shard, limit
        self.number, self.open, self.done = 0, None, []

    def add(self, data: bytes) -> None:
        raw = _member(data)
        if self.open and self.size + len(raw) > self.limit:
            self.close()
        if not self.open:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.open = committed(f"{self.path}/{self.name}")
            self.out = self.open.__enter__()
            self.size, self.records, self.hash = 0, 0, hashlib.sha256()
            self._put(_member(_info(self.name)))
        self._put(raw)
        self.records += 1

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.hash.update(raw)
        self.size += len(raw)

    def close(self) -> None:
        if self.open:
            self.open.__exit__(None, None, None)
            self.done.append((self.shard, self.number, self.name, self.size, self.records, self.hash.hexdigest()))
            self.open, self.number = None, self.number + 1

    def abort(self, e: BaseException) -> None:
        if self.open:
            self.open.__exit__(type(e), e, e.__traceback__)
            self.open = None


MANIFEST = "shard int, number int, name string, bytes long, records long, sha256 string"


def write_warc(df: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 1000, shard_bytes: int = 64 << 20, roll_bytes: int = 8 << 20) -> tuple[str, DataFrame]:
    """Write one record per row; returns the folder and its manifest.

    Of rows with equal payloads of ``min_revisit`` bytes or more, that with the
    largest id becomes a response record and the others revisit it. Defined
    cases: a null payload is empty, a null url is ``urn:null``; a null id is
    written as such, sorts first and revisits like any other; rows that repeat
    the largest id of their payload are all responses, told apart by an
    ordinal in their record id. Very long payloads are one record each. An
    empty table gives an empty manifest. Other columns are ignored.
    ``shard_bytes`` counts payloads, ``roll_bytes`` compressed members, so a
    shard is a few files.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, "warc")
    html = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("payload"))
    pages = pages.select("*", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("key"))
    # Partial aggregates first, so a payload that a third of all rows share costs one row per task.
    leaders = materialise(pages.filter(F.col("n") >= min_revisit).groupBy("key").agg(F.max("id").alias("leader"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "leader"), "warc-leaders")
    bounds = shard_bounds(df.select(F.col(id_col).alias("id"), F.octet_length(html_col).alias("w")), F.col("id"), F.coalesce(F.col("w"), F.lit(0)) + 500, shard_bytes)
    marked = pages.join(leaders, "key", "left").withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("leader")), F.col("leader")))
    rows = marked.select(
        shard_of(F.col("id"), bounds).alias("shard"), "id", "url", F.sha1("payload").alias("sha1"), "n", "refers_to",
        F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
    )

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        roll, last, ordinal, done = None, object(), 0, []
        try:
            for batch in batches:
                shards, ids, urls, sha1s, sizes, refers = (batch.column(i).to_pylist() for i in range(6))
                for i, payload in enumerate(batch.column(6)):
                    if roll is None or roll.shard != shards[i]:
                        if roll is not None:
                            roll.close()
                            done += roll.done
                        roll, last = _Roll(path, shards[i], roll_bytes), object()
                    ordinal = ordinal + 1 if ids[i] == last else 0
                    last = ids[i]
                    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1s[i])).decode()
                    kind = "response" if refers[i] is None else "revisit"
                    roll.add(record(kind, ids[i], ordinal, urls[i], payload.as_py() or b"", sizes[i], digest, refers[i]))
            if roll is not None:
                roll.close()
                done += roll.done
        except BaseException as e:
            if roll is not None:
                roll.abort(e)
            raise
        columns = list(zip(*done)) or [[]] * 6
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["shard", "number", "name", "bytes", "records", "sha256"])

    # Revisits of an id sort before its responses only where all else is equal; url and digest break ties.
    ordered = rows.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "id", "sha1", "url")
    manifest = materialise(ordered.mapInArrow(write, MANIFEST), "warc-manifest")
    with committed(f"{path}/manifest.json") as out:
        out.write(json.dumps({"files": [r.asDict() for r in manifest.orderBy("shard", "number").collect()]}, indent=1).encode())
    return path, manifest


def _members(stream) -> Iterator[bytes]:
    """The records of a .warc.gz, one gzip member at a time."""
    rest = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            chunk = rest or stream.read(1 << 20)
            rest = b""
            if not chunk:
                if parts:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(z.decompress(chunk))
            rest = z.unused_data
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, with its length and block digest checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    block = rest[:n]
    if not lines[0].startswith("WARC/1.") or rest[n:] != b"\r\n\r\n" or fields.get("WARC-Block-Digest", d := _sha1(block)) != d:
        raise ValueError("a damaged record")
    return fields, block


def read_warc(path: str, manifest: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Read the manifest's files; one row per record.

    Columns: id, url, payload_bytes, payload_digest (hex SHA-1), record_type,
    refers_to, payload (null for revisits). Block and payload digests are
    checked; a damaged or cut file raises ValueError. Null ids and urls come
    back as null and ``urn:null``; an empty manifest gives no rows.
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [id_col, "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with read_stream(f"{path}/{name}") as stream:
                    for raw in _members(stream):
                        fields, block = parse(raw)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                        digest = fields["WARC-Payload-Digest"]
                        revisit = fields["WARC-Type"] == "revisit"
                        if not revisit and (_sha1(payload) != digest or len(payload) != n):
                            raise ValueError(f"a payload of {name} does not match its digest")
                        page = fields["WARC-Page-ID"]
                        rows.append((None if page == "null" else int(page), fields["WARC-Target-URI"], n, base64.b32decode(digest[5:]).hex(), fields["WARC-Type"], int(fields["WARC-Refers-To-Page-ID"]) if revisit else None, None if revisit else payload))
                        held += len(payload)
                        if held > 8 << 20:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    n = max(1, manifest.count())
    files = manifest.select("name")
    files = files.repartitionByRange(n, "name") if n > 1 else files
    return files.mapInArrow(read, f"`{id_col}` long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
