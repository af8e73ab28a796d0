"""Token alignment against whole texts encoded at once, and the fragments' algebra."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import AWKWARD
from tokenizers import Tokenizer

from commitloom.llm import alignment, fragments

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [c for c in range(256) if c not in plain]
    return {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(rest)}


class Library:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.letters = letters()

    def bytes_b(self, n):
        piece = self.b.id_to_piece(n)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(n) else piece.replace("▁", " ").encode()

    def groups(self, text):
        """[(ids of A, ids of B)] of a text, token after token."""
        if not text:
            return []
        a = self.a.encode(" " + text, add_special_tokens=False)
        ids, b = a.ids, self.b.encode(text)
        bytes_a = [bytes(self.letters[c] for c in t) for t in a.tokens]
        bytes_b = [self.bytes_b(n) for n in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return []
        ends_a, ends_b = np.cumsum([*map(len, bytes_a)]).tolist(), np.cumsum([*map(len, bytes_b)]).tolist()
        made, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end, x) + 1, ends_b.index(end, y) + 1
            made.append((ids[x:i], b[y:j]))
            x, y = i, j
        return made

    def rows(self, texts):
        found = [(i, self.groups(t)) for i, t in texts]
        links = [Counter((a, b) for x, y in g for a in x for b in y) for _, g in found]
        counts = Counter(p for own in links for p in own)
        best = defaultdict(int)
        for (a, _), n in counts.items():
            best[a] = max(best[a], n)
        made = []
        for (i, g), own in zip(found, links, strict=True):
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
            made.append((
                i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()),
                hashlib.sha256(text.encode()).hexdigest() if g else "",
                sum(n for p, n in own.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in own.items()),
            ))
        return made


@pytest.fixture(scope="module")
def library():
    return Library()


def same(got, want):
    assert sorted((tuple(r[n] for n in NAMES) for r in got), key=repr) == sorted(want, key=repr)


ODD = [
    (60 + k, t) for k, t in enumerate([
        " ", "  ", "a  b ", "\n", " \n \n x", "a\n  b", "a\tb\r\nc", "x▁y", "▁", "tail \n", "a b  c", "\0 a\0 b", "a\n\0b c",
        "</s> <|endoftext|> <0x0A>", "it's we'll 'tis", "的 中文字符\n日本語 テキスト", "é ﬁ​ x", "aaaa" * 50, "1234567 89,0.1",
    ])
]


@pytest.mark.parametrize("long", [1 << 16, 40])
def test_rows_equal_brute_force(make, texts, library, long):
    rows = texts[:60] + AWKWARD + ODD
    same(alignment.align(make(rows, extra=True), A, B, long, width=64, fan=3).collect(), library.rows(rows))


def test_empty_and_tokenless(make, library):
    assert alignment.align(make([]), A, B).count() == 0
    rows = [(1, None), (2, ""), (3, "a▁b " * 30)]
    for long in (1 << 16, 10):
        same(alignment.align(make(rows), A, B, long, 16, 2).collect(), library.rows(rows))


def test_small_chunks_and_memory(make, texts, library, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_DOCS", 7)
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    same(alignment.align(make(texts[:40]), A, B).collect(), library.rows(texts[:40]))


def test_random_texts_split_like_whole_ones(library):
    rng, words = random.Random(2), alignment.Words(alignment.Pair(A, B))
    signs = " \n\t  aeinrst.,'lé漢😀01\0\xa0​\r　"
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 40)))
        keys = words.split(text)
        words.learn([keys])
        counts, digest, pairs, times = words.text(keys)
        groups = library.groups(text)
        want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert digest == hashlib.sha256(want.encode()).hexdigest(), (text, keys)
        assert counts[:3] == [sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups)]
        assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == Counter(
            a << 32 | b for x, y in groups for a in x for b in y
        )


def test_ranges_cover_a_text():
    rng = random.Random(8)
    text = "".join(rng.choice(["wörd ", "a", "\n", "漢字", "x" * 200, ", "]) for _ in range(2000))
    data = (" " + text).encode()
    found = alignment.ranges(text, 128)
    assert found[0][2] == 0 and found[-1][3] == len(data)
    for context, base, start, end in found:
        assert data[base : base + len(context.encode())] == context.encode()
        assert base <= start < end <= base + len(context.encode())
    assert all(x[3] == y[2] for x, y in zip(found, found[1:], strict=False))
    assert alignment.ranges("x" * 5000, 128) == [(" " + "x" * 5000, 0, 0, 5001)]


def test_composition_is_associative():
    rng = random.Random(6)

    def part(place):
        some = lambda: [rng.randrange(9) for _ in range(rng.randrange(3))]
        both = lambda: ((x := some()), x[:1])
        return fragments.Open(True, place, both(), both()) if rng.random() < 0.6 else fragments.Open(False, place, both())

    for _ in range(300):
        parts = [part(k) for k in range(6)]
        want = fragments.fold(parts)
        cut = rng.randrange(1, 6)
        (left, x), (right, y) = fragments.fold(parts[:cut]), fragments.fold(parts[cut:])
        whole, seam = fragments.compose(left, right)
        assert whole == want[0]
        assert sorted(x + y + ([seam] if seam else [])) == sorted(want[1])


def test_links_of_large_groups_are_counted(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 300), rng.integers(0, 4, 200)
    groups_a, groups_b = np.sort(rng.integers(0, 3, 300)), np.sort(rng.integers(0, 3, 200))
    plain = fragments.counted(*fragments.links(a, b, groups_a, groups_b, 3))
    monkeypatch.setattr(fragments, "MANY", 10)
    few = fragments.counted(*fragments.links(a, b, groups_a, groups_b, 3))
    assert all((x == y).all() for x, y in zip(plain, few, strict=True))
    assert plain[1].sum() == sum((groups_a == g).sum() * (groups_b == g).sum() for g in range(3))


def test_words_are_encoded_together(library, monkeypatch):
    """Words not known go to the tokenizers as a few texts, and what was asked for twice is still known later."""
    own, asked = alignment.Pair(A, B), []
    encode = own.encode
    monkeypatch.setattr(own, "encode", lambda parts: asked.extend(parts) or encode(parts))
    monkeypatch.setattr(alignment, "REMEMBERED", 3000)
    rng, words = random.Random(5), alignment.Words(own)

    def drawn(count):
        return ["".join(rng.choices("abcéß的'1▁.-", k=rng.randint(1, 9))) for _ in range(count)]

    common = [w for w in drawn(600) if "▁" not in w]
    for _ in range(6):
        text = " ".join(common + [w for w in drawn(1500) if "▁" not in w]) + "\nx" + " \ty"
        keys = words.split(text)
        asked.clear()
        words.learn([keys])
        (n_a, n_b, n_groups, n_links), digest, pairs, times = words.text(keys)
        assert [(text, n_a, n_b, n_groups, n_links, digest)] == [(text, *r[1:6]) for r in library.rows([(0, text)])]
        assert len(asked) < 30  # before: each word for itself
        assert len(words.place) <= 3000
    assert sum(len(a) for a in asked) < len(text) - sum(map(len, common))
    keys = words.split("a▁b fine x▁")  # a word that is not exact does not spoil those beside it
    words.learn([keys])
    assert words.text(keys) is None and words.text(["fine"]) is not None
