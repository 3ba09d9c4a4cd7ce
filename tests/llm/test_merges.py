"""Words merged together give the ids that the library's model gives each."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm.merges import Merges
from tessera.llm.tokens import MERGED, TOGETHER, ChunkEncoder, together

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_words_merged_together():
    rng, library, own = random.Random(5), Tokenizer.from_file(PATH), ChunkEncoder(PATH)
    letters = "etaoinshrdluETAéèßüñçÀÖª"
    words = [" " + "".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(3000)] + [" a", " aaaaaaaa", " " + "e" * 200, " international", " Übergrößenträger"]
    got = own.merges(words, own.dtype)
    assert [np.frombuffer(x, own.dtype).tolist() for x in got] == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert own.merges([], own.dtype) == []


def test_new_words_do_not_reach_the_library():
    """Only words that are longer than the bound do; equal chunks of many texts are looked up once."""
    own, sent, want = ChunkEncoder(PATH), [], Tokenizer.from_file(PATH)

    class Heard:
        def encode_batch_fast(self, texts, **kw):
            sent.extend(texts)
            return whole.encode_batch_fast(texts, **kw)

        def __getattr__(self, at):
            return getattr(whole, at)

    whole, own.tokenizer = own.tokenizer, Heard()
    texts = [" wordish otherish wordish", " otherish", None, "", " wordish" * 3, " tab\tx", " é"]
    got = own.encode_many(texts)
    assert sent == [] and [np.frombuffer(x, own.dtype).tolist() for x in got] == [want.encode(t or "", add_special_tokens=False).ids for t in texts]
    own.encode(" " + "x" * MERGED)
    assert sent == [" " + "x" * MERGED]
    assert own.encode_many([]) == [] and own.encode_many([None]) == [b""]


def test_least_rank_before_leftmost():
    model = {"type": "BPE", "vocab": {"a": 0, "b": 1, "c": 2, "bc": 3, "ab": 4, "abc": 5, "aa": 6}, "merges": ["b c", "a b", "a bc", "a a"]}
    merge = Merges(model, {97: "a", 98: "b", 99: "c"})
    ids = [list(x) for x in merge(["abc", "aab", "aaa", "a", "cab", "abcabc"], np.dtype("u1"))]
    assert ids == [[5], [0, 4], [6, 0], [0], [2, 4], [5, 5]]
    for other in ({"type": "Unigram"}, {**model, "dropout": 0.1}, {**model, "byte_fallback": True}):
        with pytest.raises(ValueError):
            Merges(other, {97: "a"})


def test_runs_of_texts():
    """Runs hold all rows in order, and so many bytes that no text but a longer one goes beyond."""
    texts = ["x" * n for n in (0, 10, TOGETHER, 5, TOGETHER - 500, 300, 7)] + [None]
    batch = pa.record_batch([pa.array(range(8)), pa.array(texts, pa.string())], names=["id", "text"])
    runs = list(together([batch, batch.slice(0, 0), batch.slice(1)]))
    assert [i for r in runs for i in r.column(0).to_pylist()] == [*range(8), *range(1, 8)]
    assert all(r.num_rows == 1 or sum(len(t or "") for t in r.column(1).to_pylist()) <= TOGETHER for r in runs)
