import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import tokens

TEXT = st.lists(
    st.one_of(
        st.sampled_from(["the", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\xa0", " ", "don't", "é", "é", "ΑΣ", "̸", "123", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "...", "🙂", "\r\n", "\x00", "İ"]),
        st.text(max_size=4),
    ),
    max_size=12,
).map("".join)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=400, deadline=None)
@given(texts=st.lists(TEXT.filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)), max_size=4))
def test_units_give_the_tokenizers_ids(name, texts):
    enc = tokens.encoder(P.path(name))
    want = [e.ids for e in enc.whole.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == want
