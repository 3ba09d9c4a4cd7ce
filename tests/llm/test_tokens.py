"""Words and marks learned apart give the ids that the library gives whole texts."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.tokens import ChunkEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "word word### word word.%%% and,### new### \nline&&& \n\nÉté??? naïve;; ÀÖØöøÿ!! ×÷ª º µ word***", " ###  word### x$$$y a.b, c|d <e> don't### it's... I'll,",
    "中文### слово### word中### ǅ%%% ſtraße!! é### é###", "a", " ", "\n", "###", " word", "word ### ###word ###", "Ġword Ċ Ġ### word\xa0word### \xad### \x7f", " x" * 3000 + " y###" * 3000,
]


@pytest.mark.parametrize("order", [1, -1])
def test_parts_of_chunks(order):
    library, own = Tokenizer.from_file(PATH), ChunkEncoder(PATH)
    texts = TEXTS[::order]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(own._np.frombuffer(x, own.dtype)) for x in own.encode_many(texts)] == want
    assert [list(own.ids(t)) for t in texts] == want


def test_marked_words_are_learned_by_their_parts():
    """A word that is known needs nothing of the library when marks follow it; parts come from the old generation too."""
    own = ChunkEncoder(PATH)
    own.encode_many([" wordish other", " x###"])
    own.old, own.cache = own.cache, {"": b""}
    asked = []
    learn = own._learn_words
    own._learn_words = lambda words, letters=False: asked.extend(words) or learn(words, letters)
    got = own.encode(" wordish### other###")
    assert asked == [] and list(own._np.frombuffer(got, own.dtype)) == Tokenizer.from_file(PATH).encode(" wordish### other###", add_special_tokens=False).ids
