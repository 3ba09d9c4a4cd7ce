"""Byte-pair merges of many short words at once, by the merges of a byte-level tokenizer's model."""

from __future__ import annotations

_NONE = (1 << 31) - 1


class Merges:
    """Merges words' bytes as the model does: the pair of least rank first, of equal ones the leftmost.

    Words stand in a matrix of one row each and as many columns as they have
    symbols left. A step merges one pair in every row, so all rows lose one
    column; shorter words join when the matrix has come down to their length,
    and rows in which no pair merges are finished.
    """

    def __init__(self, model: dict, letters: dict[int, str]):
        """``letters``: how each byte is written in the vocabulary. ValueError for models that merge otherwise."""
        import numpy as np

        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        vocab = model.get("vocab") or {}
        if not plain or any(x not in vocab for x in letters.values()) or max(vocab.values()) >= 1 << 24:
            raise ValueError("the model does not merge bytes by ranks alone")
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs[vocab[a] << 24 | vocab[b]] = (rank, vocab[a + b])
        self._np = np
        self.symbols = np.zeros(256, np.int32)
        for byte, x in letters.items():
            self.symbols[byte] = vocab[x]
        keys, ranks = np.array(list(pairs), np.int64), np.array([r for r, _ in pairs.values()], np.int32)
        self.merged = np.zeros(len(model["merges"]) + 1, np.int32)
        self.merged[ranks] = [i for _, i in pairs.values()]
        # A pair stands at its own place, or, where that is another's, in a short sorted list.
        self.shift = np.uint64(64 - max(8, int(4 * len(keys)).bit_length()))
        places = 1 << (64 - int(self.shift))
        self.keys, self.ranks = np.full(places, -1, np.int64), np.full(places, _NONE, np.int32)
        at = self._place(keys)
        self.keys[at] = keys
        kept = self.keys[at] == keys
        self.ranks[at[kept]] = ranks[kept]
        self.shared = np.zeros(places, bool)
        self.shared[at[~kept]] = True
        order = np.argsort(keys[~kept])
        self.more, self.more_ranks = keys[~kept][order], ranks[~kept][order]

    def _place(self, keys):
        return ((keys.view(self._np.uint64) * self._np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(self._np.int64)

    def _ranks(self, left, right):
        """The ranks of pairs of symbols; _NONE for pairs that don't merge."""
        np = self._np
        keys = (left.astype(np.int64) << 24 | right).ravel()
        at = self._place(keys)
        other = self.keys.take(at) != keys
        out = self.ranks.take(at)
        out[other] = _NONE
        i = (other & self.shared.take(at)).nonzero()[0]
        if len(i):
            k = np.minimum(np.searchsorted(self.more, keys[i]), len(self.more) - 1)
            out[i] = np.where(self.more[k] == keys[i], self.more_ranks[k], _NONE)
        return out.reshape(left.shape)

    def __call__(self, words: list[str], dtype) -> list[bytes]:
        """Packed ids of words, none of them empty. Takes as many steps as the longest has bytes."""
        np = self._np
        raws = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        order = np.argsort(-sizes, kind="stable")
        flat = self.symbols.take(np.frombuffer(b"".join([raws[i] for i in order.tolist()]), np.uint8))
        width = int(sizes[order[0]]) if len(order) else 0
        ends = np.cumsum(np.bincount(sizes, minlength=width + 1)[::-1])[::-1].tolist()  # words of so many bytes or more
        out: list[bytes] = [b""] * len(words)
        who, rows, ranks = np.zeros(0, np.int64), np.zeros((0, width), np.int32), np.zeros((0, max(0, width - 1)), np.int32)
        begun = taken = 0
        while width:
            if ends[width] > begun:
                n = ends[width] - begun
                fresh = flat[taken : taken + n * width].reshape(n, width)
                who, rows = np.concatenate([who, order[begun : begun + n]]), np.concatenate([rows, fresh])
                ranks = np.concatenate([ranks, self._ranks(fresh[:, :-1], fresh[:, 1:])])
                begun, taken = begun + n, taken + n * width
            if width > 1:
                at = ranks.argmin(1)
                least = ranks[np.arange(len(at)), at]
                going = least != _NONE
            else:
                going = np.zeros(len(who), bool)
            if not going.all():
                ended = ~going
                raw, step = rows[ended].astype(dtype).tobytes(), width * dtype.itemsize
                for k, i in enumerate(who[ended].tolist()):
                    out[i] = raw[k * step : (k + 1) * step]
                who, rows = who[going], rows[going]
                if width > 1:
                    ranks, at, least = ranks[going], at[going], least[going]
            width -= 1
            n = len(who)
            if not n:
                rows, ranks = np.zeros((0, width), np.int32), np.zeros((0, max(0, width - 1)), np.int32)
                continue
            each = np.arange(n)
            rows[each, at] = self.merged.take(least)
            # Without the merged pair's right symbol, and the rank that stood for the pair.
            columns, here = np.arange(width), at[:, None]
            rows = np.where(columns <= here, rows[:, :-1], rows[:, 1:])
            ranks = np.where(columns[:-1] < here, ranks[:, :-1], ranks[:, 1:])
            k = (at < width - 1).nonzero()[0]
            p = at[k]
            ranks[k, p] = self._ranks(rows[k, p], rows[k, p + 1])
            k = (at > 0).nonzero()[0]
            p = at[k]
            ranks[k, p - 1] = self._ranks(rows[k, p - 1], rows[k, p])
        return out
