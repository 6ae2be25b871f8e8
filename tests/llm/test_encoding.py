"""Ids of the two engines equal those of the tokenizers library."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quirework.llm.encoding import encoder
from quirework.llm.queries import vocabulary

PARTS = ["'s", "'", "don't", "THE", "the ", "hello", "12", "3", "²", "½", "É", "é", "ß", "ſ", "ÿ", "\n", "\r\n", "\t", "  ", "#", "!?", "…", "«", "x", "Zürich", "'ll", "<|", "|>", "\x01", "中", "İ", "ı", "'T", "'S", " "]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_random_texts(name):
    code, library, pick = encoder(vocabulary(name), "<i4"), Tokenizer.from_file(vocabulary(name)), random.Random(3)
    assert code.mode
    texts = ["", " \n", *("".join(pick.choices(PARTS, k=pick.randint(0, 30))) for _ in range(4000))]
    for text, ids in zip(texts, code.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert code.encode([]) == []
