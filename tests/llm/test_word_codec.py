"""The packing operator's encoder against the tokenizers library, and what it spares."""

import gc
import random

import public_tokenizers
import pytest

from sylvan.llm.packing import WordCodec

ODD = list("aZé Ééßµªº×÷İΣςſKǺ'’\"!?.,<|>/w123٣²½\x00\x1c\x85\xa0 \n\t\r語ไ🙂👍🏽ﬁœ_-")
PARTS = ["<|endoftext|>", "<|ENDOFTEXT|>", "</w>", "don't", "I'LL", "word,", "Word!!", "naïve.", "a]b", "a\\", "  ", "ÀÖØöøÿ"]


@pytest.fixture(scope="module")
def spec():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("kept", [1_000_000, 50])
def test_ids_are_the_librarys(spec, kept):
    r, c = random.Random(3), WordCodec(spec, kept)
    texts = ["", *PARTS] + ["".join(r.choice([r.choice(ODD), r.choice(PARTS), r.choice("abcde "), " "]) for _ in range(r.randrange(40))) for _ in range(2000)]
    want = [e.ids for e in c.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [x.tolist() for i in range(0, len(texts), 97) for x in c.encode_batch(texts[i : i + 97])]
    assert got == want


def words(n):
    return ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(n)]


def test_words_are_encoded_without_marks_between(spec):
    class Seen:
        def __init__(self, t):
            self.t, self.n = t, 0

        def __getattr__(self, name):
            return getattr(self.t, name)

        def encode_batch_fast(self, texts, **kw):
            got = self.t.encode_batch_fast(texts, **kw)
            self.n += sum(len(e.ids) for e in got)
            return got

    c = WordCodec(spec)
    c.tokenizer = seen = Seen(c.tokenizer)
    (ids,) = c.encode_batch([" ".join(words(500))])
    assert seen.n == len(ids)  # with marks there were 499 more


def test_no_garbage_is_sought_while_encoding(spec):
    c, runs = WordCodec(spec), []
    text = [" ".join(words(20_000)) + "," for _ in range(3)]
    gc.collect()
    gc.callbacks.append(lambda phase, info: runs.append(phase))
    try:
        c.encode_batch([x for t in text for x in (t, t.upper(), t.replace(" ", ". "))] + ["a"] * 5000)
    finally:
        gc.callbacks.pop()
    assert not runs and gc.isenabled()
