"""Ids of texts that hold an added token's string."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hazmill.llm import packing


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext| >", "plain"])
def test_added_tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    docs = packing._encoder(packing.tokenizer_path())
    assert packing.token_ids(docs, text).tolist() == [*want, packing.END_ID]
    assert packing.token_ids(docs, text).dtype == np.uint32


@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "\n\n", "don't", "naïve", "١٢", "\u200d", "a" * 40])), max_size=8))
@settings(max_examples=400, deadline=None)
def test_any_text(parts):
    import public_tokenizers
    from tokenizers import Tokenizer

    global _BOTH
    if _BOTH is None:
        _BOTH = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing._encoder(packing.tokenizer_path())
    text = "".join(parts)
    assert packing.token_ids(_BOTH[1], text).tolist() == [*_BOTH[0].encode(text, add_special_tokens=False).ids, packing.END_ID]


_BOTH = None
