import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import AWKWARD
from tokenizers import Tokenizer

from commitloom.llm import packing, token_files
from commitloom.llm.word_encoder import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows, end):
    encoder = Tokenizer.from_file(PATH)
    return [
        (i, np.array([*encoder.encode(t or "", add_special_tokens=False).ids, end], "<u4"))
        for i, t in rows
    ]


def key(row):
    return (row[0] is not None, row[0] or 0)


@pytest.mark.parametrize("case", ["table", "awkward"])
def test_files_hold_the_ids_in_order(spark, make, texts, tmp_path, case):
    rows = sorted(texts if case == "table" else AWKWARD, key=key)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(make(rows, extra=True), path, PATH, 1, metadata=("lang", "source"))
    stored = token_files.read_tokens(spark, path)
    got = {}
    for r in token_files.checksums(stored).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    start, want = 0, {}
    for i, ids in expected(rows, 1):
        want.setdefault(i, []).append((start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    assert stored.select("meta.lang").distinct().collect()[0][0] == "en"


def test_selective_read_prunes(spark, make, texts, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(make(texts), path, PATH, 1)
    some = spark.read.parquet(path).where("doc_id BETWEEN 20 AND 30").select("doc_id", "n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,20)" in plan and "ids" not in plan
    assert some.count() == sum(20 <= i <= 30 for i, _ in texts) > 0


def test_empty_table(spark, make, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(make([]), path, PATH, 1)
    assert token_files.checksums(token_files.read_tokens(spark, path)).count() == 0
    assert packing.pack(make([]), PATH, 2).count() == 0


def test_remembered_words_change_nothing():
    small, text = WordEncoder(PATH, remembered=3), "A a. A! B b's İ. é. É. x x. <|ENDOFTEXT|> ab ba ab"
    whole = Tokenizer.from_file(PATH)
    for _ in range(2):
        for part in (text, text.lower(), "<|startoftext|> Ab", "", "Ḱ. ﬁ! ²."):
            ids = np.frombuffer(b"".join(small.words(part.encode())[1]), "<u4").tolist()
            assert ids == whole.encode(part, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_plain_letters_have_the_tokenizer_s_ids(name):
    path = public_tokenizers.path(name)
    encoder, whole = WordEncoder(path), Tokenizer.from_file(path)
    letters = [chr(c) for c in range(0x300) if chr(c).isalpha()]
    words = [*letters, *(a + b for a, b in zip(letters, letters[7:] + letters[:7], strict=True)), "e\u0301te", "straße", "ﬁn"]
    if encoder.lowers:  # words that stand alone
        assert len(encoder.plain) > 200
        words = [w.lower() for w in words]
    for word in words:
        ids = np.frombuffer(encoder._encode_word(word), "<u4").tolist()
        assert ids == whole.encode(word, add_special_tokens=False).ids, word


@pytest.mark.parametrize("stretch", [1 << 20, 5000])
@pytest.mark.parametrize("case", ["table", "awkward"])
def test_pieces_cover_every_document(make, texts, case, stretch):
    rows = texts if case == "table" else AWKWARD
    pieces = packing.pack(make(rows, extra=True), PATH, 2, stretch=stretch).collect()
    ids = {i: a for i, a in expected(rows, 2)}
    by_doc, by_sequence, copies = {}, {}, {}
    for i, _ in rows:
        copies[i] = copies.get(i, 0) + 1
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        assert sum(p.length for p in own) == len(ids[i]) * copies[i]
        if copies[i] == 1:
            ends = 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == ends
                ends += p.length
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.02 * sum(map(len, ids.values()))


def brute_force(places, costs, sequence, last_cost):
    best = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        end = j == len(places) - 1
        best[j] = min(
            best[i] + (last_cost(places[j] - places[i]) if end else sequence - (places[j] - places[i]) + costs[j])
            for i in range(j) if places[j] - places[i] <= sequence
        )
    return best[-1]


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(200):
        places = [0, *np.cumsum(rng.integers(1, 8, rng.integers(1, 40))).tolist()]
        costs = [0, *rng.choice([0, 4, 12], len(places) - 1).tolist()]
        for last_cost in (lambda length: 16 - length, lambda length: length % 3, lambda length: 0):
            cuts = packing.best_cuts(places, costs, 16, last_cost)
            inner = zip(cuts, cuts[1:-1], strict=False)
            total = sum(16 - (places[b] - places[a]) + costs[b] for a, b in inner)
            total += last_cost(places[cuts[-1]] - places[cuts[-2]])
            assert cuts[0] == 0 and cuts[-1] == len(places) - 1
            assert total == brute_force(places, costs, 16, last_cost)


def test_sentence_ends():
    text = 'a. b "c.") d? 。 x。\n\ty! end'
    assert packing.sentence_ends(text.encode()).tolist() == [True, False, True, True, True, True, True, False]
    assert packing.sentence_ends(b"").tolist() == []
