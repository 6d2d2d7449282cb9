"""Ids are the tokenizers library's, for every text."""

import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.token_store import Encoder, StoreFormat

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = Encoder(StoreFormat(path), "<u2")
    assert encoder.by_words
    tokenizer = Tokenizer.from_file(path)

    def same(texts):
        mine = list(encoder(pa.array(texts, pa.large_string())))
        whole = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        wrong = [t for t, a, b in zip(texts, mine, whole, strict=True) if a.tolist() != [*b.ids, 2]]
        assert not wrong, wrong[:5]
        assert all(a.dtype == np.dtype("<u2") for a in mine)

    return same


CHARACTERS = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i <= 0xDFFF]


def test_every_character_of_the_basic_plane(both):
    """Each alone, between letters, beside digits and points, in words of small and large letters, next to its other forms."""
    for form in ("{0}", "a{0}b", "A{0}{0}B.", "9{0}'s {0}{1}{2} {1}x X{2}", "-{0}{1}z Z{2}"):
        both([form.format(c, c.upper(), c.lower()) for c in CHARACTERS])


def test_characters_of_other_planes(both):
    both([f"A{chr(i)}b {chr(i)}{chr(i).lower()}{chr(i).upper()}" for i in range(0x10000, sys.maxunicode + 1, 13)])


def test_random_texts(both):
    r = random.Random(4)
    plain = [chr(i) for i in range(0x20, 0x250)]
    pools = [plain, plain, plain[:95], CHARACTERS[:0x600], CHARACTERS, list("aAbB'’sStT rRe.,;:-0123\t\n\r\x0b\x0c\x1c \u0085 ́̇İıΣσςſẞ")]
    words = ["<|endoftext|>", "<s>", "</s>", "don't", "WE'LL", "Əhməd", "Ɛwe Ɔdɔ", "é", "각", "क्ष"]
    for _ in range(10):
        texts = []
        for _ in range(10_000):
            pool = r.choice(pools)
            text = "".join(r.choice(pool) for _ in range(r.randrange(40)))
            texts.append(text if r.random() < 0.8 else text + r.choice(["", " "]) + r.choice(words) + r.choice(["", " "]) + text[::-1])
        both(texts)
