"""Ids of texts with added tokens, against the tokenizer as it is loaded."""

import random

import public_tokenizers

from fixturelake.llm import packing


def test_added_tokens_keep_their_ids():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder = packing.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(9)
    parts = [" ", "  ", "a", "the", "\n", "é", "<|endoftext|>", "<|endof", "|>", "'s", " \n ", "12"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    assert [coder.encode(t).tolist() for t in texts] == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
