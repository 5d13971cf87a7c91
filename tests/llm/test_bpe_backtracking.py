"""Ids by longest tokens with backtracking."""

import random

import pytest

from sharecast.llm import bpe, registry


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe._content(registry.default_vocabulary()))


def test_encoding_matches_the_tokenizers_library(encoder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.default_vocabulary())
    draw = random.Random(5)
    texts = ["", "a" * 500, " " * 40, "one two, three.", "don't. Can't! x's", "naïve Straße, 東京 ٣٤ 🙂🙂 end?", "a.b,c;d:e!f?", " .", "x. ", "K1 \x00"]
    texts += ["".join(draw.choice("abeinorst ,.'é\n") for _ in range(300)) for _ in range(60)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert list(bpe.unpack(encoder.encode(t))) == want, t
        assert encoder.decode(encoder.encode(t)) == library.decode(want, skip_special_tokens=False)


def test_plain_words_are_encoded_without_the_pattern(encoder, monkeypatch):
    calls, inner = [], encoder.pieces_of
    monkeypatch.setattr(encoder, "pieces_of", lambda t: calls.append(t) or inner(t))
    encoder.encode("first qzvword, anotherqz. qzthird")
    assert calls == ["first"]
