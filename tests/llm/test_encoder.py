"""Ids made part by part against the library's ids of the whole text."""

import random
import sys

from spectrafold.llm import token_files

ATOMS = ["a", "Word", "über", "ñciónóra", "ß", "'s", "'ll", "don't", "###", "...", "12", "3rd", "½", "\n", "\n\n", "\t", " ", "  ", "\r\n", " ", " ", "日本", "е", "́", "\U0001f600", "\x00", "\x7f", "×", "ǀ", "ª", "º", "\u0085", "ɏ", "ɐ", "<|", "|>", "<|endoftext|>"]


def test_encoder_equals_the_library(monkeypatch):
    sys.path.append("/opt/tokenizers")
    import public_tokenizers

    # So few that parts are forgotten and met again.
    monkeypatch.setattr(token_files, "REMEMBERED", 20)
    encoder, rnd = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    texts = ["".join(rnd.choice(ATOMS) for _ in range(rnd.randint(0, 14))) for _ in range(5000)]
    texts += ["", "x" * 5000 + " " + "y" * 70 + ",", " ".join(["word,"] * 3000)]
    for text, ids in zip(texts, encoder.ids(texts), strict=True):
        assert ids.tolist() == [*encoder.whole.encode(text, add_special_tokens=False).ids, token_files.END], text
    assert len(encoder) + len(encoder.old) <= 24


def test_a_blank_before_white_space_is_no_part():
    import public_tokenizers
    import pytest

    encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for part in ("", "\n", "\t", "\n\t", " a"):
        with pytest.raises(token_files.NoPart):
            encoder[part]
    assert not encoder
