import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tallyforge.llm import token_counts
from tallyforge.llm.catalog import tokenizer

PATH = tokenizer("piece_bpe_32k.model")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("km .,!|\n12²³¹½¼①Ⅷ₂٣")), max_size=40))
@example("km².")
def test_counts_beside_numerics(text):
    assert token_counts.counter(PATH).count(text) == len(sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text))
