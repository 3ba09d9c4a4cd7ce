"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed n-gram model learned from the training rows: with
context h and word w, P(w|h) = (c(hw) + k P(w|h')) / (c(h) + k), where h' is h
without its first word, down to P(w) = (c(w) + 1) / (N + V + 1). As an
automaton, every context seen is a state, every n-gram seen an arc, and a
failure arc of weight k / (c(h) + k) leads from h to h'. One left-to-right
traversal of a document carries the state and adds up log-probabilities.

The automaton of a whole corpus fits no worker, so each chunk of documents
builds the part it can reach. It needs the corpus's counts of its own distinct
n-grams, and gets them through a tree of hops: a node gathers the lists of a
group of chunks for a slice of the digests, adds them up, and asks the nodes
above it, whose groups are larger and whose slices are narrower; the topmost
nodes know the totals, which go back the same way. Every node sends a bounded
number of lists, and there are as many nodes at every level as chunks, so the
lists grow with the corpus, not with its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = "\x00end"
#: The low bits of a key that name its n-gram's order, and the bits of a key. Lists are as large as their keys' bits.
ORDERS, BITS = 7, 56


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokenise(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts, each with its end token, the texts' lengths, and the words' digests (the end's last)."""
    import xxhash

    words: dict[bytes, int] = {}
    streams, lengths = [], []
    for text in texts:
        own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and the six ASCII spaces only
        get = words.setdefault
        streams.append(np.fromiter((get(w, len(words)) for w in own), dtype=np.int64, count=len(own)))
        lengths.append(len(own) + 1)
    tail = np.array([len(words)], dtype=np.int64)
    digests = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in (*words, _END)), dtype=np.uint64, count=len(words) + 1)
    return np.concatenate([x for s in streams for x in (s, tail)]) if streams else np.zeros(0, np.int64), np.array(lengths, dtype=np.int64), digests


class Chunk:
    """A chunk's documents as word numbers, with its distinct n-grams of every order.

    Words are numbered within the chunk; an n-gram is a pair of the number of
    its (n-1)-gram and of its last word, so every distinct n-gram has a number
    of its own, and digests are needed only to speak to other chunks.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, digest: np.ndarray, order: int):
        self.words, self.lengths = words, lengths
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        kinds = len(digest)
        # order 1 is the word itself; order n at position i ends there and is -1 where it would begin before the text.
        self.grams, self.digests = [words], [digest]
        for n in range(2, order + 1):
            before = np.concatenate([[-1], self.grams[-1][:-1]]).astype(np.int64)
            before[self.starts] = -1
            valid = before >= 0
            distinct, number = np.unique(before[valid] * kinds + words[valid], return_inverse=True)
            gram = np.full(len(words), -1, dtype=np.int64)
            gram[valid] = number
            self.grams.append(gram)
            self.digests.append(_mixed(self.digests[-1][distinct // kinds] * _MIX + digest[distinct % kinds]))

    def counts(self, trained: np.ndarray) -> list[np.ndarray]:
        """How often each distinct n-gram occurs in the training documents, by order."""
        on = np.repeat(trained, self.lengths)
        return [np.bincount(g[on & (g >= 0)], minlength=len(d)).astype(np.int64) for g, d in zip(self.grams, self.digests)]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The digests of the n-grams of all orders, their orders in the low bits, ascending, and the order that sorts them."""
        every = np.concatenate([((d >> np.uint64(64 - BITS)) & ~np.uint64(ORDERS)) | np.uint64(n) for n, d in enumerate(self.digests, 1)])
        by = np.argsort(every, kind="stable")
        return every[by], by


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers as zstd over byte planes."""
    import zstandard

    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _unpack(raw) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(raw) -> np.ndarray:
    return np.cumsum(_unpack(raw), dtype=np.uint64)


def _slices(keys: np.ndarray, own: int, fan: int, level: int) -> list[int]:
    """Where the ``fan`` sub-slices of slice ``own`` of a level begin and end in ascending keys; level k has fan**k slices."""
    parts = fan ** (level + 1)
    edges = np.array([-(-((own * fan + t) << BITS) // parts) for t in range(1, fan)], dtype=np.uint64)
    return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]


ASK = "g long, s long, sender long, keys binary, counts binary"
TELL = "receiver long, s long, totals binary, known long, tokens long"


def _record(rows: list[tuple], types: list, names: list[str]):
    import pyarrow as pa

    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)


def _asks(group: int, own: int, sender: int, keys: np.ndarray, counts: np.ndarray, fan: int, level: int) -> list[tuple]:
    """A node's lists for the nodes above it, one per sub-slice that has keys."""
    edges = _slices(keys, own, fan, level)
    return [(group, own * fan + t, sender, _pack_sorted(keys[a:b]), _pack(counts[a:b])) for t, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]


def _gathered(table) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """A node's senders and their lists; the distinct keys, where each list's keys are among them, and their counts."""
    by = np.argsort(table.column("sender").to_numpy(), kind="stable")
    table = table.take(by)
    senders = table.column("sender").to_pylist()
    lists = [_unpack_sorted(x.as_buffer()) for x in table.column("keys")]
    counts = [_unpack(x.as_buffer()) for x in table.column("counts")]
    keys, number = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.zeros(len(keys), np.uint64)
    np.add.at(total, number, np.concatenate(counts))
    return senders, lists, keys, number, total


def _tells(senders: list[int], lists: list[np.ndarray], number: np.ndarray, total: np.ndarray, own: int, known: int, tokens: int):
    """Each sender's totals, in the order of its list."""
    import pyarrow as pa

    rows, at = [], 0
    for k, (sender, keys) in enumerate(zip(senders, lists)):
        rows.append((sender, own, _pack(total[number[at : at + len(keys)]]), known if k == 0 else 0, tokens if k == 0 else 0))
        at += len(keys)
    return _record(rows, [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()], ["receiver", "s", "totals", "known", "tokens"])


def _gather(fan: int, level: int, width: int):
    """A node between: what it asks of the level above. Its number is its slice times the level's groups plus its group."""

    def gather(key, table):  # no hints here: Spark takes them for a kind of function
        import pyarrow as pa

        g, own = (x.as_py() for x in key)
        _, _, keys, _, total = _gathered(table)
        return _record(_asks(g // fan, own, own * width + g, keys, total, fan, level), [pa.int64()] * 3 + [pa.binary()] * 2, ["g", "s", "sender", "keys", "counts"])

    return gather


def held_out(id_col: Column | str, parts: int = 7, which: int = 2):
    """Whether a row is held out: crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == which


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, order: int = 3, strength: float = 8.0, chunk_bytes: int = 4 << 20, most_fan: int = 256) -> DataFrame:
    """Score every row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held``: a boolean expression of the rows not to learn from. Words are
    maximal runs of other characters than ASCII white space, A-Z lower-cased,
    and every text ends with one end token. base_score uses add-one unigrams;
    score is the automaton's log10 probability.

    Defined cases: null and empty texts are the end token alone. Repeated rows
    are learned and scored separately. Rows without an id count by the empty
    text. With no training rows, every token is unknown. An empty table gives
    no rows. Other columns are ignored. Words and n-grams of one order meet by
    digests of 53 bits, so of 10**12 different ones about one in ten thousand
    shares its count with another.

    A chunk is closed once it holds ``chunk_bytes`` of text, so it holds at most
    that and one document, whatever ids and texts repeat. ``most_fan`` bounds
    the lists that a chunk or node sends, and with it the tree's height.
    """
    if not 1 <= order <= ORDERS:
        raise ValueError(f"the order must lie between 1 and {ORDERS}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = held_out(id_col) if held is None else held
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    id_type = dict(df.dtypes)[id_col]

    def chunked(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number, ids, texts, out, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def close():
            words, lengths, digest = tokenise(texts)
            own = [[number], [pa.concat_arrays(ids)], [out], *([_pack(x)] for x in (words, lengths, digest))]
            types = [pa.int64(), pa.list_(ids[0].type), pa.list_(pa.bool_()), *[pa.binary()] * 3]
            return pa.record_batch([pa.ListArray.from_arrays([0, len(x[0])], x[0]) if isinstance(x[0], pa.Array) else pa.array(x, t) for x, t in zip(own, types)], names=["chunk", "ids", "held", "words", "lengths", "digests"])

        for batch in batches:
            sizes = np.cumsum([len(x.as_buffer() or b"") + 16 for x in batch.column(1)])
            at = 0
            while at < batch.num_rows:
                before = int(sizes[at - 1]) if at else 0
                to = min(batch.num_rows, int(np.searchsorted(sizes, before + chunk_bytes - size)) + 1)
                part = batch.slice(at, to - at)
                ids.append(part.column(0)), texts.extend(part.column(1).to_pylist()), out.extend(part.column(2).to_pylist())
                size += int(sizes[to - 1]) - before
                at = to
                if size >= chunk_bytes:
                    yield close()
                    number, ids, texts, out, size = number + 1, [], [], [], 0
        if texts:
            yield close()

    chunks = materialise(rows.mapInArrow(chunked, f"chunk long, ids array<{id_type}>, held array<boolean>, words binary, lengths binary, digests binary"), "chunks", "uncompressed")
    n = max(1, chunks.count())
    hops = max(1, math.ceil(math.log(n) / math.log(most_fan) - 1e-9))
    fan = max(1, math.ceil(n ** (1 / hops) - 1e-9))
    groups = -(-n // fan)

    def restored(row: dict) -> Chunk:
        return Chunk(_unpack(row["words"]).astype(np.int64), _unpack(row["lengths"]).astype(np.int64), _unpack(row["digests"]), order)

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                chunk = restored({c: row[c].as_buffer() for c in ("words", "lengths", "digests")})
                keys, by = chunk.keys()
                counts = np.concatenate(chunk.counts(~np.array(row["held"].as_py(), bool)))[by]
                asked = _record(_asks(row["g"].as_py(), 0, row["chunk"].as_py(), keys, counts, fan, 0), [pa.int64()] * 3 + [pa.binary()] * 2, ["g", "s", "sender", "keys", "counts"])
                yield from asked.to_batches()

    asked = chunks.select("chunk", "held", "words", "lengths", "digests", F.pmod(F.xxhash64("chunk"), F.lit(groups)).alias("g")).mapInArrow(ask, ASK)
    levels, width = [asked], groups
    for level in range(1, hops):
        below = levels[-1] = materialise(levels[-1], f"asked-{level}")

        levels.append(below.groupBy("g", "s").applyInArrow(_gather(fan, level, width), ASK))
        width = -(-width // fan)

    def answer(key, table):
        senders, lists, keys, number, total = _gathered(table)
        words = (keys & np.uint64(ORDERS)) == 1
        return _tells(senders, lists, number, total, key[1].as_py(), int((total[words] > 0).sum()), int(total[words].sum()))

    told = materialise(levels[-1].groupBy("g", "s").applyInArrow(answer, TELL), "ngram-counts")
    vocabulary, train_tokens = told.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    widths = [groups]
    for _ in range(1, hops):
        widths.append(-(-widths[-1] // fan))

    def passed(key, table, replies):
        senders, lists, keys, number, _ = _gathered(table)
        by = np.argsort(replies.column("s").to_numpy(), kind="stable")
        total = np.concatenate([_unpack(x.as_buffer()) for x in replies.column("totals").take(by)])
        return _tells(senders, lists, number, total, key[1].as_py(), 0, 0)

    for level in range(hops - 1, 0, -1):
        width = widths[level - 1]
        replies = told.select((F.col("receiver") % width).alias("g"), F.floor(F.col("receiver") / width).alias("node"), "s", "totals")
        replies = replies.select("g", F.col("node").alias("own"), "s", "totals")
        below = levels[level - 1].withColumn("own", F.col("s"))
        told = materialise(below.groupBy("g", "own").cogroup(replies.groupBy("g", "own")).applyInArrow(passed, TELL), "ngram-counts")

    def score(key, table, replies):
        import pyarrow as pa

        row = {c: table.column(c)[0] for c in table.column_names}
        chunk = restored({c: row[c].as_buffer() for c in ("words", "lengths", "digests")})
        keys, order_of = chunk.keys()
        by = np.argsort(replies.column("s").to_numpy(), kind="stable")
        every = np.empty(len(keys))
        every[order_of] = np.concatenate([_unpack(x.as_buffer()) for x in replies.column("totals").take(by)])
        totals = np.split(every, np.cumsum([len(d) for d in chunk.digests])[:-1])
        count = totals[0][chunk.words]
        base = np.log10((count + 1.0) / (train_tokens + 1.0 * (vocabulary + 1)))
        scores = Automaton(chunk, totals, train_tokens, vocabulary, strength).walk(chunk)
        return pa.table({
            "id": row["ids"].values, "held_out": row["held"].values, "n_tokens": pa.array(chunk.lengths), "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), chunk.starts)),
            "train_tokens": pa.array(np.full(len(chunk.lengths), train_tokens, np.int64)), "base_score": pa.array(np.add.reduceat(base, chunk.starts)), "score": pa.array(scores),
        })

    out = chunks.groupBy("chunk").cogroup(told.withColumnRenamed("receiver", "chunk").groupBy("chunk")).applyInArrow(score, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


class Automaton:
    """The part of the backoff automaton that a chunk's documents can reach.

    State 0 is the empty context and has an arc for every word of the chunk.
    Each n-gram shorter than the order that training has seen is a state. Arcs
    lie in one array sorted by state and word; ``arc_log`` is the smoothed log10
    probability, ``arc_to`` the state after it. ``fail_to`` and ``fail_log`` are
    the failure arc of each state.
    """

    def __init__(self, chunk: Chunk, totals: list[np.ndarray], tokens: int, vocabulary: int, strength: float):
        self.words = len(chunk.digests[0])
        order = len(totals)
        prob = (totals[0] + 1.0) / (tokens + vocabulary + 1.0)
        state = [np.where(totals[0] > 0, np.arange(1, self.words + 1), 0)] if order > 1 else [np.zeros(self.words, np.int64)]
        keys, logs, to = [np.arange(self.words, dtype=np.int64)], [np.log10(prob)], [state[0]]
        fail_to, fail_log, size = [np.zeros(self.words + 1, np.int64)], [np.concatenate([[0.0], np.log10(strength / (totals[0] + strength))])], self.words + 1
        suffix = np.zeros(self.words, np.int64)
        for n in range(2, order + 1):
            gram, before = chunk.grams[n - 1], np.concatenate([[-1], chunk.grams[n - 2][:-1]])
            at = np.flatnonzero(gram >= 0)
            m = len(chunk.digests[n - 1])
            context, shorter, last = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
            context[gram[at]], shorter[gram[at]], last[gram[at]] = before[at], chunk.grams[n - 2][at], chunk.words[at]
            seen = totals[n - 1] > 0
            prob = np.where(seen, (totals[n - 1] + strength * prob[shorter]) / (totals[n - 2][context] + strength), 0.0)
            own = np.where(seen, np.arange(size, size + m), 0) if n < order else state[-1][shorter]
            keys.append(state[-1][context[seen]] * self.words + last[seen])
            logs.append(np.log10(prob[seen]))
            to.append(own[seen])
            if n < order:
                fail_to.append(state[-1][shorter])
                fail_log.append(np.log10(strength / (totals[n - 1] + strength)))
                state.append(own)
                size += m
        keys = np.concatenate(keys)
        by = np.argsort(keys, kind="stable")
        self.arc_key, self.arc_log, self.arc_to = keys[by], np.concatenate(logs)[by], np.concatenate(to)[by]
        self.fail_to, self.fail_log = np.concatenate(fail_to), np.concatenate(fail_log)

    def walk(self, chunk: Chunk) -> np.ndarray:
        """The log10 probability of each document: one traversal from left to right, all documents in step."""
        by = np.argsort(-chunk.lengths, kind="stable")
        starts, lengths = chunk.starts[by], chunk.lengths[by]
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
        score, state = np.zeros(len(by)), np.zeros(len(by), np.int64)
        for t, n in enumerate(active):
            word, here, left = chunk.words[starts[:n] + t], state[:n].copy(), np.arange(n)
            while len(left):
                key = here * self.words + word
                arc = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
                hit = self.arc_key[arc] == key
                score[left[hit]] += self.arc_log[arc[hit]]
                state[left[hit]] = self.arc_to[arc[hit]]
                miss = ~hit
                left, here, word = left[miss], here[miss], word[miss]
                score[left] += self.fail_log[here]
                here = self.fail_to[here]
        out = np.empty(len(by))
        out[by] = score
        return out
