"""Token counts against the library, text by text."""

import random

import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import AWKWARD

from commitloom.llm import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def proof():
    return token_counts.prove(MODEL)


def want(text):
    return len(LIBRARY.encode(text or ""))


def test_counts_are_the_library_s(make, texts):
    spaced = [(50 + k, t) for k, t in enumerate(["", " ", "  ", "a  b ", "\n", " \n \n", "\t x", "▁a▁ b", "</s> <0x0A>", "a" * 20_000])]
    rows = texts + AWKWARD + spaced
    got = token_counts.count_tokens(make(rows, extra=True), MODEL, 100).collect()
    expected = [
        (i, len((t or "").encode()), want(t), want(t) > 100) for i, t in rows
    ]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_empty_table(make):
    assert token_counts.count_tokens(make([]), MODEL, 1).count() == 0


def test_random_strings(proof):
    rng, counter = random.Random(3), token_counts.TokenCounter(proof, remembered=50)
    signs = " \n\t▁  aeinrst.,-éß漢😀01</s><0x0A>\0\xa0​\rЖд"
    made = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for some in range(0, len(made), 100):
        assert counter.counts(made[some : some + 100]) == [want(t) for t in made[some : some + 100]]


def test_long_texts_in_stretches(proof, monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 64)
    rng, counter = random.Random(4), token_counts.TokenCounter(proof, remembered=10)
    made = ["".join(rng.choice(["the ", "\n", "  ", "Wört", ",", "a", "的"]) for _ in range(n)) for n in (0, 10, 500, 5000)]
    assert counter.counts([*made, "x" * 500]) == [want(t) for t in [*made, "x" * 500]]


def test_whole_tokens_are_proven(proof):
    # every pre-token of the set is one token after a space and in the middle of a word
    assert " the" in proof.whole and "ing" in proof.whole and " x7q" not in proof.whole
    for word in random.Random(5).sample(sorted(proof.whole), 2000):
        alone = LIBRARY.encode(word[1:]) if word[0] == " " and word != " " else None
        assert alone is None or len(alone) == 1


def test_models_that_cannot_be_split(tmp_path, proof):
    from sentencepiece import sentencepiece_model_pb2 as model

    spec = model.ModelProto()
    spec.ParseFromString(open(MODEL, "rb").read())
    spec.pieces.add(piece="of▁the", score=-1.0, type=model.ModelProto.SentencePiece.NORMAL)
    path = str(tmp_path / "other.model")
    open(path, "wb").write(spec.SerializeToString())
    with pytest.raises(ValueError, match="goes on with a space"):
        token_counts.prove(path)
