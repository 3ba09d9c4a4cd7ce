"""Benchmark decontamination: passages within a few word edits of an item.

Windows and items are embedded by CGK random walks, which turn edit distance
into Hamming distance; repeated sampling of the embeddings' coordinates gives
LSH keys, with as many repeats as a seeded simulation needs for the target
recall; candidate pairs are verified by exact semi-global edit distance, as a
passage with k inserted or deleted words is up to 2k from any window of the item's
length. Windows near no passage within reach of any item by the q-gram lemma
(too few word q-grams of any item) are never embedded; that loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

#: Coordinates per LSH key, keys drawn from each walk, and the walks after which an index that misses its recall is refused.
SAMPLE, KEYS_PER_WALK, MAX_WALKS = 6, 24, 96
#: Items that one broadcast index holds; larger benchmarks are searched in blocks.
BLOCK_ITEMS = 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hash(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(seed * 2 + 1)) * _MIX
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _last_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
    """Edit distances of paired rows: the whole of a's and each prefix of b's, or each prefix's nearest end where ``free``."""
    m, n = a.shape[1], b.shape[1]
    steps = np.arange(n + 1, dtype=np.int32)
    row = np.broadcast_to(np.int32(0) if free else steps, (len(a), n + 1)).copy()
    for i in range(m):
        change = row[:, :-1] + (a[:, i : i + 1] != b)
        best = np.minimum(change, row[:, 1:] + 1)
        # Insertions run along the row: d[j] = min over k <= j of best[k] + j - k.
        full = np.concatenate([np.full((len(a), 1), i + 1, np.int32), best], axis=1)
        row = np.minimum.accumulate(full - steps, axis=1) + steps
    return row


def edit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact edit distances of paired rows of two matrices of words."""
    return _last_row(a, b, False)[:, -1]


def nearest_passage(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance, start and words of the passage of b's row (of ``sizes`` words, then padding) nearest to a's: the first, and of those the longest."""
    n, width, every = a.shape[1], b.shape[1], np.arange(len(a))
    # Read backwards, the cell at each end is the least distance of the passages that start there.
    starts = _last_row(a[:, ::-1], b[:, ::-1], True)[:, ::-1]
    start = np.argmin(starts, axis=1)
    distance = starts[every, start]
    columns = start[:, None] + np.arange(2 * n)
    tail = np.where(columns < width, b[every[:, None], np.minimum(columns, width - 1)], 0)
    ends = _last_row(a, tail, False)
    fits = (ends == distance[:, None]) & (np.arange(2 * n + 1) <= (sizes - start)[:, None])
    return distance, start, 2 * n - np.argmax(fits[:, ::-1], axis=1)


class Index:
    """LSH tables over a block of items, by item length."""

    def __init__(self, items: list[tuple[int | None, str | None]], max_ratio: float, recall: float, seed: int = 1):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.rows = [], []
        for item_id, text in items:
            own = words_of(text)
            if own:
                self.ids.append(item_id)
                self.rows.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own], np.int64))
        self.ratio, self.seed = max_ratio, seed
        self.by_length: dict[int, np.ndarray] = {}
        for n in sorted({len(r) for r in self.rows}):
            self.by_length[n] = np.array([i for i, r in enumerate(self.rows) if len(r) == n])
        # For each q: the items' q-grams, and in whose lengths' items each occurs (lengths share bits beyond 64, which only keeps more).
        self.bit = {n: np.uint64(k % 64) for k, n in enumerate(self.by_length)}
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for q in {self.gram_size(n) for n in self.by_length}:
            own = [(self._gram(self.rows[i], q), np.uint64(1) << self.bit[n]) for n, items in self.by_length.items() if self.gram_size(n) == q for i in items]
            grams, number = np.unique(np.concatenate([g for g, _ in own]), return_inverse=True)
            lengths = np.zeros(len(grams), np.uint64)
            np.bitwise_or.at(lengths, number, np.concatenate([np.full(len(g), m) for g, m in own]))
            self.grams[q] = grams, lengths
        self.widest = max(self.by_length, default=0)
        self.walks = self._walks_for(recall)
        self.tables = [(keys[by := np.argsort(keys, kind="stable")], by) for keys in self.keys(*self._padded(self.rows))] if self.rows else []

    def reach(self, n: int) -> int:
        """The edits allowed for an item of n words."""
        return int(self.ratio * n)

    def gram_size(self, n: int) -> int:
        """The largest q up to 3 for which the q-gram lemma asks for a shared q-gram."""
        return next((q for q in (3, 2) if self.least(n, q) >= 1), 1)

    def least(self, n: int, q: int) -> int:
        """Word q-grams of an item that a passage within reach must hold."""
        return n - q + 1 - q * self.reach(n)

    @staticmethod
    def _gram(row: np.ndarray, q: int) -> np.ndarray:
        n = len(row) - q + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        code = row[:n].astype(np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, q):
                code = code * _MIX + row[k : k + n].astype(np.uint64)
        return code

    def _padded(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows as one matrix and their lengths; unknown words and the padding have numbers of their own."""
        lengths = np.array([len(r) for r in rows], np.int64)
        out = np.full((len(rows), self.widest + 1), len(self.vocabulary) + 1, np.int64)
        out[np.arange(self.widest + 1) < lengths[:, None]] = np.concatenate(rows) if len(rows) else []
        return out, lengths

    def embed(self, padded: np.ndarray, lengths: np.ndarray, walk: int) -> np.ndarray:
        """CGK: 3n steps; each emits the current word and advances by a random bit of (step, word)."""
        m, steps = len(padded), 3 * self.widest
        bits = np.random.default_rng([self.seed, walk]).integers(0, 2, (steps, len(self.vocabulary) + 2), dtype=np.uint8)
        at, out, flat = np.arange(m) * padded.shape[1], np.empty((steps, m), np.int64), padded.ravel()
        end = at + lengths
        for t in range(steps):
            word = out[t] = flat[at]
            at = np.minimum(at + bits[t][word], end)
        return out

    def keys(self, padded: np.ndarray, lengths: np.ndarray, walks: range | None = None) -> Iterator[np.ndarray]:
        """The LSH keys of rows, one array per repeat: some coordinates of the first 3n, with n."""
        every = np.arange(len(padded))
        for walk in walks or range(self.walks):
            embedded = self.embed(padded, lengths, walk)
            draw = np.random.default_rng([self.seed, walk, 1])
            for _ in range(KEYS_PER_WALK):
                key = lengths.astype(np.uint64)
                with np.errstate(over="ignore"):
                    for u in draw.random(SAMPLE):
                        key = _hash(key * _MIX + embedded[(u * 3 * lengths).astype(np.int64), every].astype(np.uint64), 7)
                yield key

    def _walks_for(self, recall: float) -> int:
        """Walks until simulated pairs at the full distance meet in some key with probability ``recall``, whatever the item's length.

        Of the lengths that allow equally many edits the least bears the largest
        share of them, so that one is simulated for each number of edits; of
        large numbers, those about a quarter apart.
        """
        least: dict[int, int] = {}
        for n in self.by_length:
            least.setdefault(self.reach(n), n)
        fitted, last = 0, 0
        for k, n in least.items():
            if k <= 8 or k >= 1.25 * last or k == max(least):
                last = k
                fitted = max(fitted, self._walks_at(n, recall, max(64, min(256, 2048 // (2 * k + 1)))))
        return fitted

    def _walks_at(self, n: int, recall: float, trials: int) -> int:
        """The same for items of n words."""
        own, k = self.by_length[n], self.reach(n)
        rng = np.random.default_rng(self.seed)
        a = np.stack([self.rows[i] for i in own])[rng.integers(len(own), size=trials)]
        # Every kind of edit must reach the recall: words replaced, inserted, deleted, and all of them mixed.
        b = []
        for kind in range(4):
            for row in a:
                passage = list(row)
                for _ in range(k):
                    at, change = int(rng.integers(max(1, len(passage)))), int(rng.integers(3)) if kind == 3 else kind
                    passage[at : at + (change != 1)] = [] if change == 2 else [0]
                # Of the windows that the search embeds, those that begin up to k words before or after the passage.
                around = np.zeros(n + 4 * k + len(passage), np.int64)
                around[k : k + len(passage)] = passage
                b += [around[s : s + n] for s in range(2 * k + 1)]
        known, seen, met = self._padded(list(a)), self._padded(b), np.zeros((4, trials), bool)
        for walk in range(MAX_WALKS):
            one = range(walk, walk + 1)
            for x, y in zip(self.keys(*known, one), self.keys(*seen, one)):
                met |= (y.reshape(4, trials, 2 * k + 1) == x[:, None]).any(axis=2)
            if met.mean(axis=1).min() >= recall:
                return walk + 1
        raise ValueError(f"{MAX_WALKS} walks do not reach a recall of {recall} for items of {n} words; lower the recall or the distance")

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(row, item, distance, first word, words) of the best passage of every row and item within reach."""
        windows: list[tuple[int, int, int]] = []
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        get, streams = self.vocabulary.get, []
        for i, text in enumerate(texts):
            own = words_of(text)
            stream = np.fromiter(map(get, own, repeat(0)), np.int64, len(own))
            streams.append(stream)
            for q, (grams, lengths) in self.grams.items():
                m = len(stream) - q + 1
                if m < 1:
                    continue
                whole = stream > 0
                whole = np.logical_and.reduce([whole[k : k + m] for k in range(q)])
                at = np.flatnonzero(whole)
                code = stream[at].astype(np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(1, q):
                        code = code * _MIX + stream[at + k].astype(np.uint64)
                spot = np.minimum(np.searchsorted(grams, code), len(grams) - 1)
                hit = grams[spot] == code
                at, which = at[hit], lengths[spot[hit]]
                if not len(at):
                    continue
                for n in self.by_length:
                    if self.gram_size(n) == q:
                        windows += [(i, s, n) for s in self._starts(at[(which >> self.bit[n]) & np.uint64(1) > 0], n, q, len(stream))]
            while len(windows) >= 10_000:
                self._verify(windows[:10_000], streams, best)
                del windows[:10_000]
        if windows:
            self._verify(windows, streams, best)
        return [(i, j, *best[i, j]) for i, j in sorted(best)]

    def _starts(self, at: np.ndarray, n: int, q: int, size: int) -> list[int]:
        """The windows of n words where passages of up to n + reach words with enough of the q-grams at ``at`` may begin, and up to the reach before and after; unknown words surround the text."""
        least, span = max(1, self.least(n, q)), n + self.reach(n) - q + 1
        if len(at) < least or size < n - self.reach(n):
            return []
        close = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] < span)
        starts: set[int] = set()
        for k in close:
            starts.update(range(max(0, int(at[k + least - 1]) - span + 1) - self.reach(n), int(at[k]) + self.reach(n) + 1))
        return sorted(starts)

    def _verify(self, windows: list[tuple[int, int, int]], streams: list, best: dict) -> None:
        """Candidates among windows by LSH, and the exact distances of the passages around them."""
        rows = []
        for i, s, n in windows:
            own = streams[i][max(0, s) : s + n]
            # Unknown words stand where a window begins before the text or ends after it.
            rows.append(own if len(own) == n else np.concatenate([np.zeros(max(0, -s), np.int64), own, np.zeros(n - max(0, -s) - len(own), np.int64)]))
        padded, lengths = self._padded(rows)
        pairs = []
        for (keys, items), own in zip(self.tables, self.keys(padded, lengths)):
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            count = high - low
            w = np.repeat(np.arange(len(own)), count)
            offset = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
            pairs.append(np.unique(w * len(self.rows) + items[low[w] + offset]))
        w, j = np.divmod(np.unique(np.concatenate(pairs)), len(self.rows))
        n_of = np.array([len(r) for r in self.rows])[j]
        same = n_of == lengths[w]
        w, j, n_of = w[same], j[same], n_of[same]
        for n in np.unique(n_of):
            self._nearest([(*windows[x][:2], int(y)) for x, y in zip(w[n_of == n], j[n_of == n])], int(n), streams, best)

    def _nearest(self, found: list[tuple[int, int, int]], n: int, streams: list, best: dict) -> None:
        """The best passages around candidates (row, window's start, item of n words), neighbouring windows of one item together."""
        k, groups = self.reach(n), []
        for i, j, s in sorted((i, j, s) for i, s, j in found):
            if not groups or groups[-1][:2] != (i, j) or s > groups[-1][2] + n:
                groups.append((i, j, s))
        # A group's last window begins n words after its first; passages lie up to twice the reach beyond on either side.
        width = 2 * n + 4 * k
        for at in range(0, len(groups), 4096):
            part = groups[at : at + 4096]
            text, sizes = np.zeros((len(part), width), np.int64), np.empty(len(part), np.int64)
            for r, (i, _, s) in enumerate(part):
                own = streams[i][max(0, s - 2 * k) : s + 2 * n + 2 * k]
                text[r, : len(own)], sizes[r] = own, len(own)
            distance, start, words = nearest_passage(np.stack([self.rows[j] for _, j, _ in part]), text, sizes)
            for r in np.flatnonzero(distance <= k):
                i, j, s = part[r]
                key, value = (i, j), (int(distance[r]), max(0, s - 2 * k) + int(start[r]), int(words[r]))
                if key not in best or (value[0], value[1], -value[2]) < (best[key][0], best[key][1], -best[key][2]):
                    best[key] = value


def _blocks(items: DataFrame, id_col: str, text_col: str, block: int) -> Iterator[list[tuple]]:
    """The query set in blocks, so that no broadcast grows with it."""
    held: list[tuple] = []
    for r in items.select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == block:
            yield held
            held = []
    yield held


def _each_block(df: DataFrame, items: DataFrame, id_col: str, text_col: str, max_ratio: float, recall: float, block: int, search, after) -> list[DataFrame]:
    """``search`` over a broadcast index of each block of items in turn. With several blocks each result is written, and its index given up, before the next."""
    spark, out = df.sparkSession, []
    blocks = _blocks(items, id_col, text_col, block)
    held = next(blocks)
    while held is not None:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(Index(held, max_ratio, recall))
        found = search(out[-1] if out and after else df, shared)
        if following is not None or out:
            found = materialise(found, "searched")
            shared.destroy()
        out.append(found)
        held = following
    return out


def contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", max_ratio: float = 0.15, recall: float = 0.99, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document row and item found in it: id, item_id, distance, start_word, n_words.

    An item of n words is found where a passage of any length is within
    ``max_ratio`` * n word edits of it; the nearest, then first and then longest
    passage is named. Defined cases: null and empty texts and items without
    words match nothing; very long texts are searched whole; repeated rows and
    items are each reported; null ids are carried; an empty table on either side
    gives no rows. Other columns are ignored. A recall that the index cannot
    reach for some length of item is refused with ValueError.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_type, item_type = dict(df.dtypes)[id_col], dict(items.dtypes)[item_id_col]
    item_arrow = to_arrow_type(items.schema[item_id_col].dataType)

    def search(rows: DataFrame, shared) -> DataFrame:
        def find(batches: Iterator) -> Iterator:
            import pyarrow as pa

            index = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    batch = whole.slice(at, 4096)
                    hits = index.search(batch.column(1).to_pylist())
                    own, item, distance, start, n = zip(*hits) if hits else ([],) * 5
                    yield pa.record_batch(
                        [batch.column(0).take(pa.array(own, pa.int64())), pa.array([index.ids[j] for j in item], item_arrow), pa.array(distance, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int32())],
                        names=[id_col, "item_id", "distance", "start_word", "n_words"],
                    )

        return rows.select(id_col, text_col).mapInArrow(find, f"`{id_col}` {id_type}, item_id {item_type}, distance int, start_word long, n_words int")

    parts = _each_block(df, items, item_id_col, item_text_col, max_ratio, recall, block_items, search, after=False)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decontaminate(df: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", max_ratio: float = 0.15, recall: float = 0.99, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``df`` in which no item is found, all columns kept.

    Defined cases: rows with a null or empty text stay, as do all rows where
    the items are none or without words; repeated rows stay or go together; ids
    play no part; very long texts are searched whole; an empty table gives none.
    """
    schema = df.schema

    def search(rows: DataFrame, shared) -> DataFrame:
        def clean(batches: Iterator) -> Iterator:
            import pyarrow as pa

            index = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    batch = whole.slice(at, 4096)
                    mask = np.ones(batch.num_rows, bool)
                    mask[[h[0] for h in index.search(batch.column(batch.schema.get_field_index(text_col)).to_pylist())]] = False
                    yield batch.filter(pa.array(mask))

        return rows.mapInArrow(clean, schema)

    return _each_block(df, items, item_id_col, item_text_col, max_ratio, recall, block_items, search, after=True)[-1]


def contaminated_ids(df: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Distinct ids of rows with at least one item."""
    return contamination(df, items, id_col, **options).select(F.col(id_col)).distinct()
