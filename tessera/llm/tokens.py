"""Whole-text encoding with public tokenizers, by cached chunks.

A text is cut where the tokenizer's own splitter always cuts, each distinct
chunk is encoded once per worker by the library, and the texts' ids are joined
from the cache. The result equals encoding each whole text.
"""

from __future__ import annotations

import contextlib
import json
import os
import re

from tessera.llm.merges import Merges

#: White space other than space and newline; texts that hold it are encoded whole in "leading" mode.
_ODD = re.compile("[\x00\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
#: Letters beyond Latin-1, whose case and composition are left to the library.
_WIDE = re.compile("[^\x00-\xff]")
#: A full stop or comma after another mark, which may belong to a longer run.
_MARKS = re.compile("[.,](?<![0-9A-Za-zÀ-ÖØ-öø-ÿ][.,])")
#: One space or newline and what it leads: any such chunks, one after another, are a text that is cut between them.
_SPACED = re.compile("[ \n][^ \n]+")
_LED = re.compile("[ \n]*[^ \n]+|[ \n]+")
#: A led word of Latin letters and the marks behind it, between which byte-level splitters always cut.
_MARKED = re.compile("([ \n][A-Za-zÀ-ÖØ-öø-ÿ]+)([#$%&*|<>.,!?;:]+)")
#: Chunks of one generation of a worker's cache. When a generation is full it becomes the
#: old one, from which chunks in use are taken over. Bounds memory, never results.
MAX_CHUNKS = 320_000

#: Words of so many letters at most are merged together.
MERGED = 48

#: Texts that are encoded together hold so many bytes, about.
TOGETHER = 1 << 22

_encoders: dict[str, "ChunkEncoder"] = {}


def together(batches, column: int = 1):
    """Record batches as runs of rows whose texts are encoded together: the more, the fewer times a chunk is looked up."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            held = int(sizes[at - 1]) if at else 0
            n = max(1, int(np.searchsorted(sizes, held + TOGETHER, side="right")) - at)
            yield batch.slice(at, n)
            at += n


def encoder(path: str) -> "ChunkEncoder":
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


class ChunkEncoder:
    """Encodes texts to packed little-endian 16-bit ids (32-bit for larger vocabularies)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.vocabulary = size
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self._np = np
        self.cache: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        self.mode = self._mode(spec)
        # The library cuts added tokens' strings out before it splits; texts that may hold one are encoded whole.
        added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.added_head = os.path.commonprefix(added)
        # Tokens at which a word of letters ends (bare) or a chunk begins (leading: space, newline), to take joined ones apart.
        edge = str.endswith if self.mode == "bare" else str.startswith
        mark = {"bare": "</w>", "leading": ("\u0120", "\u010a")}.get(self.mode)
        self.edges = np.zeros(max(size, 1 + max(self.tokenizer.get_vocab().values(), default=0)), bool)
        self.merges = None
        if self.mode == "leading":
            self._letters(spec["model"])
        if mark:
            self.edges[[i for t, i in self.tokenizer.get_vocab().items() if edge(t, mark)]] = True

    def _letters(self, model: dict) -> None:
        """The model's merges, for words that need no splitter."""
        # The model's own cache holds a few thousand words and would be asked for chunks that are new by definition.
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        as_text = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        with contextlib.suppress(ValueError):
            self.merges = Merges(model, as_text)

    @staticmethod
    def _mode(spec: dict) -> str:
        """leading: chunks keep the white space before them; bare: white space only separates; whole: anything else."""
        before, split = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        if before is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space"):
            return "leading"
        steps = [x.get("type") for x in (before or {}).get("normalizers", [])]
        parts = split.get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and parts and parts[0].get("type") == "Split" and parts[0].get("invert") and r"[^\s\p{L}\p{N}]+" in (parts[0].get("pattern") or {}).get("Regex", ""):
            return "bare"
        return "whole"

    def _holds_added(self, text: str) -> bool:
        if self.added is None or (self.added_head.lower() == self.added_head.upper() and self.added_head not in text):
            return False
        return self.added.search(text) is not None

    def _cut(self, text: str) -> str | None:
        """The text with the mode's separator between its chunks; None if it has to be encoded whole."""
        if self.mode == "whole" or self._holds_added(text):
            return None
        flat = text.replace("\n", " ")
        if self.mode == "bare":
            flat = flat.replace("\t", " ").replace("\r", " ")
            if not _WIDE.search(flat):
                flat = flat.lower()
                if self._apart(flat):
                    flat = flat.replace(".", " .").replace(",", " ,")
            return flat
        if not flat.isprintable() and _ODD.search(text):  # printable white space is the space alone
            return None
        if "  " in flat:
            return "\x00".join(_LED.findall(text))
        if self._apart(flat):
            text = text.replace(".", "\x00.").replace(",", "\x00,")
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n")

    @staticmethod
    def _apart(flat: str) -> bool:
        """Whether every full stop and comma stands between a letter or digit and white space."""
        ends = flat.count(". ") + flat.count(", ") + flat.endswith((".", ","))
        return flat.count(".") + flat.count(",") == ends and not _MARKS.search(flat)

    def _pack(self, ids: list[int]) -> bytes:
        return self._np.array(ids, dtype=self.dtype).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Packed ids of one whole text; null counts as empty."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of whole texts. Their new chunks are learned together, and each of their chunks is looked up once."""
        np = self._np
        import pyarrow as pa

        if len(self.cache) > MAX_CHUNKS:
            self.old, self.cache = self.cache, {"": b""}
        separator = " " if self.mode == "bare" else "\x00"
        cut = [self._cut(t) if t else "" for t in texts]
        raw = np.frombuffer("".join([f"{c or ''}{separator}" for c in cut]).encode(), np.uint8)
        between = raw == ord(separator)
        ends = np.flatnonzero(between)
        # Arrow numbers the different chunks of all texts; Python sees each of them once, and Arrow joins their ids.
        offsets = np.zeros(len(ends) + 1, np.int64)
        np.subtract(ends, np.arange(len(ends)), out=offsets[1:])
        chunks = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(raw[~between])).dictionary_encode()
        words = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist
        found = list(map(self.cache.get, words))
        gaps = [i for i, x in enumerate(found) if x is None]
        new = {words[i] for i in gaps}
        if new and self.old:
            for c in [c for c in new if c in self.old]:
                self.cache[c] = self.old[c]
                new.discard(c)
        if new:
            self._learn(new)
        for i in gaps:
            found[i] = self.cache[words[i]]
        joined = pa.array(found, pa.large_binary()).take(chunks.indices)
        _, starts, data = joined.buffers()
        starts = np.frombuffer(starts, np.int64, len(joined) + 1, joined.offset * 8) if len(joined) else np.zeros(1, np.int64)
        stops = starts[np.cumsum([0, *((c or "").count(separator) + 1 for c in cut)])].tolist()
        data = memoryview(data or b"")
        return [self._pack(self.tokenizer.encode(t, add_special_tokens=False).ids) if c is None else bytes(data[a:b]) for t, c, a, b in zip(texts, cut, stops, stops[1:])]

    def _learn(self, new: set[str]) -> None:
        if self.mode == "bare":
            words = [c for c in new if c.isalpha()]
            # Words beyond Latin-1 must not keep the others from being learned together.
            words = [w for w in words if not _WIDE.search(w)] if _WIDE.search("".join(words)) else words
        elif self.mode == "leading":
            new, marked = self._parted(new)
            plain = [c for c in new if c[0] == " " and c[1:].isalpha() and len(c) <= MERGED]
            plain = [w for w in plain if not _WIDE.search(w)] if _WIDE.search("".join(plain)) else plain
            if self._learn_words(plain, letters=True):
                new = new.difference(plain)
            words = list(filter(_SPACED.fullmatch, new))
        else:
            words = []
        rest = list(new.difference(words)) if self._learn_words(words) else list(new)
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.cache[c] = self._pack(e.ids)
        if self.mode == "leading":
            for c, word, marks in marked:
                self.cache[c] = self.cache[word] + self.cache[marks]

    def _parted(self, new: set[str]) -> tuple[set[str], list[tuple[str, str, str]]]:
        """New chunks that are a word and marks as such, and what has to be learned for them and the others."""
        marked = [(c, m[1], m[2]) for c in new if not c[-1].isalpha() and (m := _MARKED.fullmatch(c))]
        if not marked:
            return new, marked
        need = new.difference(c for c, _, _ in marked)
        for part in {x for _, word, marks in marked for x in (word, marks)}:
            if part not in self.cache:
                if part in self.old:
                    self.cache[part] = self.old[part]
                else:
                    need.add(part)
        return need, marked

    def _learn_words(self, words: list[str], letters: bool = False) -> bool:
        """Cache words (bare, letters: of Latin letters) from one encoding of them all; false if they don't come apart."""
        if letters:
            if not words or self.merges is None or self._holds_added("".join(words)):
                return False
            self.cache.update(zip(words, self.merges(words, self.dtype)))
            return True
        if len(words) > 1024:
            half = len(words) // 2
            return self._learn_words(words[:half]) and self._learn_words(words[half:])
        joined = (" " if self.mode == "bare" else "").join(words)
        if not words or (self.mode == "bare" and _WIDE.search(joined)) or self._holds_added(joined):
            return False
        ids = self._np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.dtype)
        at = self._np.flatnonzero(self.edges[ids]) + (self.mode == "bare")
        if len(at) != len(words):
            return False
        raw, wide = ids.tobytes(), self.dtype.itemsize
        stops = [0, *(at * wide).tolist()] if self.mode == "bare" else [*(at * wide).tolist(), len(raw)]
        if stops[0] or stops[-1] != len(raw):
            return False
        for w, a, b in zip(words, stops, stops[1:]):
            self.cache[w] = raw[a:b]
        return True

    def ids(self, text: str | None):
        return self._np.frombuffer(self.encode(text), dtype=self.dtype)
