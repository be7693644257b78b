"""Word ids equal the tokenizer's on letters that change length or gain marks when normalised."""

import random

import numpy as np
import public_tokenizers
import pytest

from factorweave.llm import packing

ODD = "İıŉǰΐΰßẞŁÅÉéǅﬁΣςſΩ﷐Ⅷ①ȩ́̇ñヴガ가각हि"
MARKS = ".,;:!?#$%&*+-/=@^_~()[]{}|<>'\""


def whole(coder, text):
    return coder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["BELEDİYESİ, ŞEHRİ. x", "İ.", "aİ!", "Straße, ẞ; ŉ. ǰ? ﬁ, É. é."])
def test_punctuation_behind_letters_that_gain_marks(text):
    coder = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(coder.encode(text.encode()), "<u4").tolist() == whole(coder, text)


def test_fuzz_over_odd_letters_and_punctuation():
    coder = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert coder.by_word
    rng = random.Random(11)
    letters = ODD + "abcXYZ019" + "".join(map(chr, range(0xC0, 0x250)))
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice([letters, letters, MARKS, " \n"])) for _ in range(rng.randint(1, 12)))
        assert np.frombuffer(coder.encode(text.encode()), "<u4").tolist() == whole(coder, text), text


def test_every_letter_before_every_punctuation():
    coder = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(12)
    for c in map(chr, range(0xA0, 0x3000)):
        if c.isalpha():
            text = f"a{c}{rng.choice(MARKS)} {c}{rng.choice(MARKS)}b"
            assert np.frombuffer(coder.encode(text.encode()), "<u4").tolist() == whole(coder, text), (hex(ord(c)), text)
