"""Special tokens in mixed case among other documents."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cloakwork.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_special_tokens():
    library, coder = Tokenizer.from_file(PATH), packing.Words(PATH)
    texts = ["Alpha beta, gamma.", "a <|StartOfText|> b zeta", "x <|ENDOFTEXT|> y", "x<|EndOfText|>y <|endoftext|>", "<|startoftext|> Eta theta", "alpha delta epsilon. <|STARTOFTEXT|>", "Iota kappa lambda"]
    for _ in range(2):  # the second time from what is remembered
        got = coder.encode_all([t.encode() for t in texts])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_parting():
    with pytest.raises(ValueError):
        packing.Words(PATH)._encode([b"one", b"<|startoftext|>", b"two"])
