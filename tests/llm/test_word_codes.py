"""Codes of words for the language model: equal halves mean one id."""

import public_tokenizers
import pytest

from factorweave.llm import lm_scoring


def test_words_with_equal_ends_are_not_words_of_one_id():
    coder = lm_scoring.Coder(public_tokenizers.path("word_bpe_49k.json"))
    words = [b"1-1", b"a-a", b"ha-ha", b"0.0", b"the", b"a", b"1", b"thethe"]
    for w, code, ids in zip(words, coder.encoded(words).tolist(), coder.ids_of.words(words)):
        assert (code & 0xFFFF == code >> 16) == (len(ids) == 4), w
        assert code >> 16 == int.from_bytes(ids[-4:], "little")


def test_vocabularies_that_do_not_fit_are_refused(monkeypatch):
    monkeypatch.setattr(lm_scoring, "SAME", 1000)
    with pytest.raises(ValueError, match="more than 1000 ids"):
        lm_scoring.Coder(public_tokenizers.path("word_bpe_49k.json"))
