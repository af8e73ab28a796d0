"""The pipeline's near-duplicate documents against brute-force Jaccard similarity."""

import random

from conftest_llm import AWKWARD
from test_duplicates import least_reachable

import corpus_pipeline
from commitloom.llm import alike, near_copies


def word_shingles(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def like(a, b, similarity=0.8):
    both = len(a & b)
    return a == b or both >= similarity * (len(a) + len(b) - both) > 0


def kept_of(docs):
    return {r.doc_id for r in corpus_pipeline.without_near_copies(docs.sparkSession, docs, "").collect()}


def texts_of(rng, count, words):
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(words)) for _ in range(count)]


def test_unlike_documents_all_stay(make):
    rows = list(enumerate(texts_of(random.Random(1), 1500, 6)))
    assert kept_of(make(rows, extra=True)) == {i for i, _ in rows}


def test_kept_documents_are_those_of_brute_force(make):
    rng, rows = random.Random(2), []
    for base in texts_of(rng, 6, 80):
        for _ in range(8):
            words = base.split()
            for _ in range(rng.randrange(3)):  # each edit of a word takes five shingles
                words[rng.randrange(80)] = f"n{rng.randrange(99)}"
            rows.append((100 + len(rows), " ".join(words)))
    rows += [r for r in AWKWARD if r[0] not in (None, 6)]
    sets = {i: word_shingles(text) for i, text in rows}
    group = least_reachable(list(sets), lambda a, b: like(sets[a], sets[b]))
    assert 10 < len(set(group.values())) < len(rows) - 10
    docs = make([*rows, (None, rows[0][1])])
    assert kept_of(docs) == {*group.values(), None}


def test_pairs_at_the_threshold_are_found(make):
    rng, rows = random.Random(3), []
    for k, base in enumerate(texts_of(rng, 400, 94)):
        words = base.split()  # 90 shingles; two edits inside leave 80 of 100
        words[20], words[60] = f"n{k}", f"m{k}"
        rows += [(2 * k, base), (2 * k + 1, " ".join(words))]
    a, b = word_shingles(rows[0][1]), word_shingles(rows[1][1])
    assert len(a & b) == 80 and len(a | b) == 100
    assert alike.recall(0.8, near_copies.ROWS, near_copies.BANDS) > 0.999
    kept = kept_of(make(rows))
    assert {i for i, _ in rows if i % 2 == 0} <= kept and len(kept) <= 402


def test_buckets_of_unlike_templates_lose_no_pair(make):
    rng, rows = random.Random(4), []
    template = texts_of(rng, 1, 80)[0].split()
    for k in range(300):  # own ending: 76 of 126 shingles and more in common
        rows.append((k, " ".join([*template, *(f"o{k}x{j}" for j in range(25))])))
    for k in range(40):  # the copy lacks the last 15 words
        rows.append((1000 + k, rows[7 * k][1].rsplit(" ", 15)[0]))
    sets = {i: word_shingles(text) for i, text in rows}
    group = least_reachable(list(sets), lambda a, b: like(sets[a], sets[b]))
    assert len(set(group.values())) > 200
    assert kept_of(make(rows)) == set(group.values())


def test_classes_of_operator_10_bring_documents_together(make, monkeypatch):
    """Without MinHash buckets fingerprints alone still do; the exact check keeps unlike sets apart."""
    monkeypatch.setattr(near_copies, "BANDS", 0)
    base, other = texts_of(random.Random(5), 2, 4000)
    words = base.split()
    words[2000] = "edited"
    kept = kept_of(make([(1, base), (2, " ".join(words)), (3, other), (4, None), (5, "one two"), (6, "one  TWO")]))
    assert kept == {1, 3, 4, 5}
