"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts with equal shingle sets count as one. MinHash bands put texts that may be
similar into buckets; the least text of a bucket leads it, and a text's pivot is
the leader that it shares most buckets with. Each text is compared with its
pivot exactly: from how many shingles it lacks and has besides, a cost follows,
and two texts of one pivot whose costs add up to no more than a limit are linked
whatever their shingles are. Such links are counted from sums over costs, so a
group of near copies is not compared pair by pair.

All other pairs that share a bucket meet at a leader of both: MinHash values are
compared a few at a time, a pair is dropped once the posterior probability of
reaching the threshold falls below a tolerance, and what is left is verified
exactly. A leader's texts are dealt in blocks, and each pair of blocks returns
counts and a spanning set of links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.components import components

#: 40 bands of 6 values: a pair at 0.8 shares no band with probability 5e-6.
BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
STEP = 24
#: Texts of one leader that one block holds.
BLOCK = 192
#: Costs are whole numbers of millionths of a shingle.
COST = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, n: int = 5) -> np.ndarray:
    """The sorted set of 64-bit digests of a UTF-8 text's word n-grams; one of all its words, if there are fewer than n."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    number: dict[bytes, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    digest = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))[at]
    n = min(n, len(words))
    out = digest[: len(digest) - n + 1].copy()
    for k in range(1, n):
        out = out * _MIX + digest[k : k + len(out)]
    return np.unique(_mixed(out + np.uint64(n)))


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return draw.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(own: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each."""
    a, b = _functions()
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 256):
        np.minimum(out, (np.multiply.outer(own[at : at + 256], a) + b).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band."""
    rows = values.astype(np.uint64).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = _mixed(out * _MIX + rows[:, k])
    return out.view(np.int64)


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each number of compared values, the matches below which a pair is dropped.

    With a uniform prior on the similarity, P(s >= t | m of n match) is
    P(Bin(n + 1, t) <= m).
    """
    out = [0]
    for n in range(1, HASHES + 1):
        p, m = 0.0, 0
        while m <= n:
            p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if p >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def similar_pairs(rows: list[tuple], left: np.ndarray, right: np.ndarray, wanted, threshold: float, tolerance: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js) of the wanted pairs at or above the threshold; rows: (shingles, signature).

    ``wanted`` is asked for a mask of pairs (a column and a row of numbers).
    """
    need = least_matches(threshold, tolerance)
    values = np.stack([r[1] for r in rows])
    size = np.array([len(r[0]) for r in rows])
    _, number = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    local = np.split(number, np.cumsum(size)[:-1])
    mark = np.zeros(number.max() + 1, np.int64)
    same_block = left is right or np.array_equal(left, right)
    for at in range(0, len(left), 32):
        part = left[at : at + 32]
        # Similar sets have similar sizes: a bound that loses nothing.
        keep = np.minimum(size[part, None], size[None, right]) >= threshold * np.maximum(size[part, None], size[None, right]) - 1e-9
        keep &= wanted(part[:, None], right[None, :])
        if same_block:
            keep &= part[:, None] < right[None, :]
        x, y = np.nonzero(keep)
        i, j = part[x], right[y]
        got = np.zeros(len(i), np.int64)
        for n in range(0, HASHES, STEP):
            if not len(i):
                break
            got = got + (values[i, n : n + STEP] == values[j, n : n + STEP]).sum(axis=1)
            alive = got >= need[n + STEP]
            i, j, got = i[alive], j[alive], got[alive]
        for k in np.unique(i):
            js = j[i == k]
            mark[local[k]] = 1
            own = [local[v] for v in js]
            both = np.add.reduceat(mark[np.concatenate(own)], np.concatenate([[0], np.cumsum([len(v) for v in own])[:-1]]))
            mark[local[k]] = 0
            linked = js[both >= threshold * (size[k] + size[js] - both) - 1e-9]
            if len(linked):
                yield int(k), linked


def _unit(rows: list[dict], threshold: float, tolerance: float) -> list[tuple[int, int, int]]:
    """(text, links, a text of its group) of the texts of one pair of blocks that have links."""
    leader = rows[0]["leader"]
    data = [(np.frombuffer(r["shingles"], np.uint64), np.frombuffer(r["values"], np.uint32)) for r in rows]
    low = np.array([i for i, r in enumerate(rows) if r["block"] == r["low"]], np.int64)
    high = low if rows[0]["low"] == rows[0]["high"] else np.array([i for i, r in enumerate(rows) if r["block"] == r["high"]], np.int64)
    links = np.zeros(len(rows), np.int64)
    copies, pivot, cost, limit = (np.array([r[c] for r in rows], np.int64) for c in ("copies", "pivot", "cost", "limit"))
    # The leaders below this one: pairs of different pivots that share one of them meet there.
    lower = sorted({x for r in rows for x in r["leaders"] if x < leader})
    column = {x: k for k, x in enumerate(lower)}
    shared = np.zeros((len(rows), max(1, len(lower))), np.float32)
    for i, r in enumerate(rows):
        for x in r["leaders"]:
            if x < leader:
                shared[i, column[x]] = 1

    def wanted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        together = pivot[a] == pivot[b]
        undecided = (pivot[a] == leader) & (cost[a] + cost[b] > limit[a])
        elsewhere = shared[a[:, 0]] @ shared[b[0]].T > 0
        return np.where(together, undecided, ~elsewhere)

    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(low) and len(high):
        for i, js in similar_pairs(data, low, high, wanted, threshold, tolerance):
            links[i] += copies[js].sum()
            links[js] += copies[i]
            for j in js:
                parent[root(int(j))] = root(i)
    least: dict[int, int] = {}
    for i in np.flatnonzero(links):
        r = root(int(i))
        least[r] = min(least.get(r, rows[i]["node"]), rows[i]["node"])
    return [(rows[i]["node"], int(links[i]), least[root(int(i))]) for i in np.flatnonzero(links)]


def _sign(n: int):
    def sign(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                row, digest, found = [], [], []
                for text in batch.column(1):
                    raw = (text.as_buffer() or b"") and text.as_buffer().to_pybytes()
                    own = shingles(raw, n)
                    row.append(hashlib.md5(raw, usedforsecurity=False).digest())
                    digest.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    found.append(bands(signature(own)).tobytes() if len(own) else None)
                yield pa.record_batch([batch.column(0), *(pa.array(x, pa.binary()) for x in (row, digest, found))], names=["id", "row", "digest", "bands"])

    return sign


def _deal(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        found = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]) if batch.num_rows else np.zeros(0, np.int64)
        yield pa.record_batch([pa.array(found), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["bucket", "node"])


def _shingled(n: int):
    """Shingles and MinHash values of the texts that stand for their nodes; other texts under the same id are left out."""

    def shingle(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                keep, sets = [], []
                for k, (row, text) in enumerate(zip(batch.column(1), batch.column(2))):
                    raw = text.as_buffer().to_pybytes()
                    if hashlib.md5(raw, usedforsecurity=False).digest() == row.as_py():
                        keep.append(k)
                        sets.append(shingles(raw, n))
                yield pa.record_batch([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([signature(x).tobytes() for x in sets], pa.binary())], names=["node", "shingles", "values"])

    return shingle


def _measure(threshold: float):
    """Each text against its pivot: its cost, and the limit of two costs."""

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                cost, limit = [], []
                for own, pivot in zip(batch.column(1), batch.column(2)):
                    own, pivot = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(pivot.as_buffer(), np.uint64)
                    both = len(np.intersect1d(own, pivot, assume_unique=True))
                    cost.append(round(COST * (len(pivot) - both + threshold * (len(own) - both))))
                    limit.append(round(COST * (1 - threshold) * len(pivot)))
                yield pa.record_batch([batch.column(0), pa.array(cost, pa.int64()), pa.array(limit, pa.int64())], names=["node", "cost", "limit"])

    return measure


def _verify(threshold: float, tolerance: float):
    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, held = None, []

        def out(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([],) * 3)], names=["node", "links", "least"])

        for batch in batches:
            for row in batch.to_pylist():
                own = row["leader"], row["low"], row["high"]
                if own != key:
                    if len(held) > 1:
                        yield out(_unit(held, threshold, tolerance))
                    key, held = own, []
                held.append(row)
        if len(held) > 1:
            yield out(_unit(held, threshold, tolerance))

    return verify


def _certain(measured: DataFrame) -> DataFrame:
    """(node, certain, pivot) of the texts linked to their pivot: how many documents of the pivot's other texts their costs alone link them to.

    Sums run over the costs of a pivot, whose number its length bounds, not over its texts.
    """
    near = measured.filter("cost <= limit")
    sums = materialise(near.groupBy("pivot", "limit", "cost").agg(F.sum("copies").alias("w")), "costs")
    nothing = F.lit(0).cast("long")
    events = sums.select("pivot", F.col("cost").alias("x"), F.lit(0).alias("kind"), "w", nothing.alias("cost")).unionByName(
        sums.select("pivot", (F.col("limit") - F.col("cost")).alias("x"), F.lit(1).alias("kind"), nothing.alias("w"), "cost")
    )
    upto = Window.partitionBy("pivot").orderBy("x", "kind", "cost").rowsBetween(Window.unboundedPreceding, 0)
    reach = events.withColumn("reach", F.sum("w").over(upto)).filter("kind = 1").select("pivot", "cost", "reach")
    own = F.when(2 * F.col("cost") <= F.col("limit"), F.col("copies")).otherwise(nothing)
    return near.join(reach, ["pivot", "cost"]).select("node", "pivot", (F.col("reach") - own).alias("certain"))


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """One row per input row: id, class_id (the least id of its group of links), n_links, copy_of, text_md5, keeper.

    A document is an id with a text. n_links counts the other documents whose
    word n-gram sets have a Jaccard similarity of ``threshold`` or more with the
    row's, exact copies included; copy_of is the least id with an equal set.
    keeper marks one document of each class, that of the least id and then the
    least text digest.

    Defined cases: words are ASCII-lower-cased runs between ASCII white space;
    a text of 1 to n - 1 words is one shingle; texts without words (null,
    empty) and rows without an id have no links, are classes of their own and
    keepers. Repeated rows are one document. Rows that share an id but not the
    text are different documents, told apart by text_md5. Very long texts are
    shingled whole. An empty table gives no rows. Other columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialise(docs.mapInArrow(_sign(n), "id long, row binary, digest binary, bands binary"), "signatures")
    texts = signed.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
    # One node per different shingle set. Partial aggregates keep very many copies to one row per task.
    documents = texts.groupBy("digest", "id", "row").agg(F.first("bands").alias("bands"))
    reps = documents.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    reps = materialise(reps.select(F.monotonically_increasing_id().alias("node"), "digest", "rep", "copies", "bands"), "texts")

    dealt = reps.select("node", "bands").mapInArrow(_deal, "bucket long, node long")
    led = materialise(dealt.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last").select("bucket", "leader"), "buckets")
    stars = materialise(dealt.join(led, "bucket").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("buckets")), "stars")
    chosen = stars.groupBy("node").agg(F.sort_array(F.collect_list("leader")).alias("leaders"), F.max(F.struct("buckets", (-F.col("leader")).alias("m")))["m"].alias("m")).select("node", "leaders", (-F.col("m")).alias("pivot"))
    chosen = materialise(chosen, "chosen")
    pivots = materialise(chosen.select("pivot").distinct(), "pivots")
    # A pivot is its own.
    own = pivots.select(F.col("pivot").alias("self"))
    chosen = chosen.join(own, chosen["node"] == own["self"], "left").select("node", "leaders", F.coalesce("self", "pivot").alias("pivot"))

    members = chosen.join(reps.select("node", "rep", "copies"), "node")
    wanted = members.select("node", F.col("rep.id").alias("rep_id"), F.col("rep.row").alias("row"))
    source = docs.join(wanted, docs["id"] == wanted["rep_id"]).select("node", "row", F.coalesce("text", F.lit("")).alias("text"))
    # A text is read once even if its row is repeated.
    ready = source.mapInArrow(_shingled(n), "node long, shingles binary, values binary").groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("values").alias("values"))
    ready = materialise(ready, "shingles", "zstd")
    of_pivot = ready.join(pivots, ready["node"] == pivots["pivot"]).select("pivot", F.col("shingles").alias("theirs"))
    compared = ready.join(chosen.select("node", "pivot"), "node").join(of_pivot, "pivot").select("node", "shingles", "theirs")
    costs = compared.mapInArrow(_measure(threshold), "node long, cost long, limit long")
    measured = materialise(costs.join(members.select("node", "leaders", "pivot", "copies"), "node"), "measured")

    certain = materialise(_certain(measured), "certain")

    # The bulk of a leader's texts have one pivot and, if that is the leader, low costs: no two of them are compared here.
    at = measured.select("node", "leaders", "pivot", "copies", "cost", "limit", F.explode("leaders").alias("leader"))
    at = at.withColumn("alike", (F.col("pivot") != F.col("leader")) | (2 * F.col("cost") <= F.col("limit")))
    sizes = at.groupBy("leader", "pivot", "alike").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("leader").agg(F.sum("n").alias("every"), F.max(F.when(F.col("alike"), F.struct("n", "pivot"))).alias("bulk"))
    sizes = sizes.select("leader", F.coalesce("bulk.n", F.lit(0)).alias("alike_n"), (F.col("every") - F.coalesce("bulk.n", F.lit(0))).alias("rest"), F.col("bulk.pivot").alias("bulk"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    # Written, so that the join below does not share its stage with the sums and a large leader can be split or its row broadcast.
    sizes = materialise(sizes.filter("rest > 0").select("leader", "bulk", blocks("rest").alias("first"), (blocks("rest") + blocks("alike_n")).alias("blocks")), "leaders")
    placed = at.join(sizes, "leader").withColumn("__bulk", F.col("alike") & F.col("pivot").eqNullSafe(F.col("bulk")))
    deal = F.pmod(F.xxhash64("node", "leader"), F.when(F.col("__bulk"), F.col("blocks") - F.col("first")).otherwise(F.col("first")))
    placed = placed.withColumn("block", (F.when(F.col("__bulk"), F.col("first")).otherwise(F.lit(0)) + deal).cast("int"))
    # The rest's blocks meet all blocks, the bulk's only the rest's.
    others = F.sequence(F.lit(0), F.when(F.col("__bulk"), F.col("first")).otherwise(F.col("blocks")) - 1)
    placed = placed.withColumn("other", F.explode(others)).select("leader", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "pivot", "cost", "limit", "leaders")
    units = placed.join(ready, "node")
    found = units.repartition("leader", "low", "high").sortWithinPartitions("leader", "low", "high", "node").mapInArrow(_verify(threshold, tolerance), "node long, links long, least long")
    found = materialise(found, "links")

    edges = found.select(F.col("node").alias("a"), F.col("least").alias("b")).unionByName(certain.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    groups = components(edges)
    counts = found.select("node", "links").unionByName(certain.select("node", F.col("certain").alias("links"))).groupBy("node").agg(F.sum("links").alias("links"))
    known = reps.select("node", "digest", "rep", "copies").join(counts, "node", "left").join(groups, "node", "left")
    known = materialise(known.select("digest", "rep", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "classes")
    heads = known.groupBy("root").agg(F.min("rep").alias("head"))
    known = known.join(heads, "root").select("digest", F.col("rep.id").alias("copy_of"), F.col("head.id").alias("class_id"), F.col("head.row").alias("head"), "links")
    md5 = F.lower(F.hex("row")).alias("text_md5")
    linked = texts.select("id", "row", "digest").join(known, "digest").select(F.col("id").alias(id_col), "class_id", F.col("links").alias("n_links"), "copy_of", md5, ((F.col("id") == F.col("class_id")) & (F.col("row") == F.col("head"))).alias("keeper"))
    alone = signed.filter(F.col("digest").isNull() | F.col("id").isNull()).select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("copy_of"), md5, F.lit(True).alias("keeper"))
    return linked.unionByName(alone)
