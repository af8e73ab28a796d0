"""Language model and quality classifier."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import AWKWARD

from commitloom.llm import factorization, interpolation

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*SPACED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def part(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


@pytest.mark.parametrize("chunk", [interpolation.CHUNK, 3000])
def test_scores_are_those_of_plain_counts(make, texts, monkeypatch, chunk):
    monkeypatch.setattr(interpolation, "CHUNK", chunk)
    used = {}
    fit = interpolation.learned_weights
    monkeypatch.setattr(
        interpolation, "learned_weights", lambda cells, even: used.setdefault("w", fit(cells, even))
    )
    rows = texts + AWKWARD
    got = interpolation.score_texts(make(rows, extra=True)).collect()
    words, pairs = Counter(), Counter()
    for i, text in rows:
        if part(i) != 1:
            t = tokens(text)
            words.update(t)
            pairs.update(zip([None, *t], t, strict=False))
    size, known, weights = sum(words.values()), len(words), used["w"]
    want = []
    for i, text in rows:
        t = tokens(text)
        base = sum(math.log10((words[w] + 0.5) / (size + 0.5 * (known + 1))) for w in t)
        score = 0.0
        for before, w in zip([None, *t], t, strict=False):
            seen = words[before]
            a, b, c = weights[min(math.frexp(seen)[1], interpolation.BUCKETS - 1)]
            bigram = pairs[before, w] / seen if seen else 0
            score += math.log10(a * bigram + b * words[w] / size + c / (known + 1))
        want.append((i, part(i) == 1, len(t), sum(words[w] > 0 for w in t), size, base, score))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5:] for r in got] == [pytest.approx(r[5:], rel=1e-9) for r in want]
    held = [r for r in got if r[1] and r[2] > 50]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)
    assert np.allclose(weights.sum(axis=1), 1) and (weights > 0).all()


def test_weights_reach_the_best_likelihood():
    rng = np.random.default_rng(1)
    cells = [(3, float(rng.integers(1, 9)), p, q) for p, q in rng.random((40, 2)) * [0.3, 0.05]]
    weights = interpolation.learned_weights(cells, 0.001)
    n, p = np.array([c[1] for c in cells]), np.array([[c[2], c[3], 0.001] for c in cells])

    def fit(w):
        return float(n @ np.log(p @ w))

    grid = [np.array([a, b, 1 - a - b]) for a in np.arange(0, 1.01, 0.02) for b in np.arange(0, 1.01 - a, 0.02)]
    assert fit(weights[3]) >= max(fit(w) for w in grid if w[2] > 1e-9) - 1e-2
    assert (weights[0] == weights[7]).all()  # buckets without tokens share one set


def test_packed_keys_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype="u8") * np.uint64(2))
        assert (interpolation.unpacked(interpolation.packed(keys), len(keys)) == keys).all()
        counts = rng.integers(0, 2**31, n)
        assert (interpolation.expanded(interpolation.squeezed(counts)) == counts).all()


def test_model_without_learning_rows(make):
    assert interpolation.score_texts(make([])).count() == 0
    scored = [i for i in range(100) if part(i) == 1][:3]
    rows = interpolation.score_texts(make([(i, "a b") for i in scored])).collect()
    assert len(rows) == 3 and all(r.train_tokens == 0 and math.isfinite(r.score) for r in rows)


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    good = np.array(labels) == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in factorization.quality_scores(docs, labels).collect()}
    held = [r for r in labels.collect() if got[r.doc_id].held_out]
    scores = [got[r.doc_id].score for r in held]
    assert auc([r.quality for r in held], scores) > 0.97
    good = [got[r.doc_id].predicted for r in held if r.quality == 1]
    assert np.mean(good) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert len(got) == docs.count()


def test_scores_of_awkward_tables(spark, make, texts):
    docs = make(texts[:60] + AWKWARD, extra=True)
    ids = [i for i, _ in texts[:60]]
    rows = [(i, k % 3 != 0 if k % 7 else None, 0) for k, i in enumerate(ids)] + [(None, 1, 0), (ids[0], 1, 1), (10**9, 0, 0)]
    labels = spark.createDataFrame([(i, None if q is None else int(q), t) for i, q, t in rows], "doc_id long, quality int, toxic int")
    got = factorization.quality_scores(docs, labels).collect()
    assert len(got) == 60 + len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    kept = factorization.keep_good(docs, labels)
    assert kept.schema == docs.schema and kept.count() == sum(r.predicted for r in got)
    assert factorization.quality_scores(make([]), labels).count() == 0
    unlabelled = factorization.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}
    ones = factorization.quality_scores(docs, labels.selectExpr("doc_id", "1 as quality", "toxic")).collect()
    assert len({r.score for r in ones}) == 1 and ones[0].score > 0.9


def test_identity_of_the_pairwise_sum():
    rng = np.random.default_rng(3)
    machine = factorization.Machine(0.1, rng.normal(size=6000), rng.normal(size=(6000, 8)) * 0.1, [np.zeros(9)] * len(factorization.STATISTICS))
    at, values, stats = factorization.features(b"Some words, some more.\nA line", factorization.WordPlaces())
    places, x = machine.rows(at, values, stats)
    total = machine.bias + machine.linear[places] @ x
    for i in range(len(places)):
        for j in range(i):
            total += machine.factors[places[i]] @ machine.factors[places[j]] * x[i] * x[j]
    assert machine.score(at, values, stats) == pytest.approx(1 / (1 + math.exp(-total)))


def test_freed_memory_goes_back_to_the_system():
    from pathlib import Path

    from commitloom.llm import common

    def held():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    blocks = [bytes(2000) for _ in range(100_000)]
    last, full = blocks[-1], held()
    del blocks
    common.release()
    assert last is not None and full - held() > 100e6
