"""The encoder's tables against the library's own call, however small the tables are."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer


@pytest.mark.parametrize("kind, name", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_tables_change_no_ids(kind, name):
    from mediaframe.llm.tokens import Encoder

    rnd = random.Random(12)
    parts = ["don't", "we'll", "A", "É", "ß", "x1y2", "--", "''s", "café", "12", "3.4", "the", "of", "tion", "\t", "\n", "  ", "²", "hello,world", "(see", "it)", "<|", "|>", "<|endoftext|>"]
    texts = ["".join(rnd.choice(parts) + rnd.choice([" ", " ", "", "\r\n"]) for _ in range(rnd.randrange(0, 60))) for _ in range(300)]
    texts += ["".join(chr(rnd.choice([*range(32, 127), *range(161, 256)])) for _ in range(200)) for _ in range(100)] + ["", " ", " ", "日本語 text", "w" * 5000]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    want = [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    for sizes in ((500_000, 2_000_000), (40, 50)):
        encoder = Encoder(public_tokenizers.path(name), kind, False, *sizes)
        got = [x.tolist() for k in range(0, len(texts), 16) for x in encoder(texts[k : k + 16], 2)]
        assert got == want
    ordinary = Encoder(public_tokenizers.path(name), kind, True)
    library.encode_special_tokens = True
    assert [x.tolist() for x in ordinary(texts, 2)] == [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
