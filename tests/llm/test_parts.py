"""Tokens by recurring parts of texts are those of whole texts."""

import random

import numpy as np

from tracklume.llm import alignment, tokens
from tracklume.llm import alignment_query as Q

ODD = [None, "", " ", "  ", "  x", "x ", "a  b", "it's we'll can't'll 'sx 'tx'rex", "café ×y naïve, (x)y.z\n\nEnd \n x", "a.\nB\n\nc\n", "tab\tx \t y", "a1b2 3c", "<s>hi</s> <0x41> a", "▁x y", "中文 abc, d", "ﬁ x", "don't.'s'S", "<|endoftext|> a", "a\x00b \x1c c\r\nd", "ª µm.º a", "a_b __c", "A" * 5000 + " b"]


def test_parts_of_texts(monkeypatch):
    own = random.Random(3)
    texts = ODD + ["".join(own.choice(" '.,a\nsbtéR1\t- ×") for _ in range(own.randint(1, 25))) for _ in range(4000)]
    sides = Q.encoders()
    by_parts = Q.by_parts(sides)
    assert isinstance(by_parts.__self__, tokens.Parts)
    wanted = alignment.whole_texts(sides)(texts)
    for kept in (tokens.KEPT_PARTS, 5):  # a table that is begun anew for each list
        monkeypatch.setattr(tokens, "KEPT_PARTS", kept)
        assert all(np.array_equal(a, b) for a, b in zip(by_parts(texts), wanted, strict=True))
        assert all(np.array_equal(a, b) for a, b in zip(by_parts(texts[:50]), alignment.whole_texts(sides)(texts[:50]), strict=True))
    assert len(by_parts.__self__) < 1000
