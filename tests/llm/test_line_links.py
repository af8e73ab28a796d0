"""Lines of crowded buckets and at the threshold."""

import random

import pytest
from pyspark.sql import functions as F
from test_duplicates import shingles

from commitloom.llm import alike, lines


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def drawn(rng, size):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(size - 1)) + "."


def test_a_bucket_of_unlike_template_lines_loses_no_pair(make):
    rng = random.Random(1)
    template = drawn(rng, 140)
    own = [template + drawn(rng, 40) for _ in range(2000)]
    copies = [own[10 * k][:-6] for k in range(200)]
    assert all(0.55 < likeness(a, b) < 0.75 for a, b in zip(own[:200], own[1:], strict=False))
    assert all(likeness(own[10 * k], copy) > 0.95 for k, copy in enumerate(copies))
    docs = make([(k, "\n".join(own[40 * k : 40 * k + 40])) for k in range(50)] + [(99, "\n".join(copies))])
    gone = {r.doc_id: r.n_removed for r in lines.line_classes(docs).collect()}
    assert gone.pop(99) == 200 and not any(gone.values())


def test_lines_at_the_threshold_are_found(make):
    rng = random.Random(2)
    own = [drawn(rng, 187) for _ in range(1000)]
    copies = [line[:-36] for line in own]
    assert all(likeness(a, b) == 0.8 for a, b in zip(own[:50], copies, strict=False))
    gone = {r.doc_id: r.n_removed for r in lines.line_classes(make([(1, "\n".join(own)), (2, "\n".join(copies))])).collect()}
    share = lines.recall(0.8)  # of pairs at the threshold; four standard deviations below it
    assert gone[1] == 0 and gone[2] >= 1000 * share - 4 * (1000 * share * (1 - share)) ** 0.5 > 980


def test_pairs_a_bucket_has_held_are_not_sought_again(spark):
    """Of three members two are chosen, so all pairs were compared; of five, three are left to compare."""
    rows = [(1, member, 1) for member in (10, 11, 12)] + [(2, member, 1) for member in (20, 21, 22, 23, 24)] + [(3, 30, 1)]
    shared = alike.members(spark.createDataFrame(rows, "bucket long, id long, n long"))
    chosen = {(r.bucket, tuple(sorted(r.others))) for r in shared.collect()}
    assert chosen == {(1, (11, 12)), (2, (22, 24))} and shared.count() == 8
    nothing = spark.createDataFrame([], "a long, b long")
    assert sorted(r.id for r in alike.apart(shared, nothing).collect()) == [20, 21, 23]


def rows_made(plan, node):
    """Rows that the nodes of a name made in a plan that has run."""
    inner = [plan.children().apply(k) for k in range(plan.children().size())]
    if plan.nodeName() == "AdaptiveSparkPlan":
        inner = [plan.executedPlan()]
    elif plan.nodeName().endswith("QueryStage"):
        inner = [plan.plan()]
    own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == node else 0
    return own + sum(rows_made(p, node) for p in inner)


def test_a_signature_row_stands_for_several_shingles(make):
    """Places are the least over all shingles, whatever a line's length, without a row for each shingle."""
    rng = random.Random(3)
    own = [drawn(rng, n) for n in (2, 7, 8, 9, 22, 23, 24, 25, 39, 40, 400)] + ["ß的" * 9 + "é"]
    found = lines.distinct_lines(make([(1, "\n".join(own))]))
    signed = lines.signatures(found)
    got = {r.id: tuple(r)[2:] for r in signed.collect()}
    shingled = sum(max(1, len(line) - lines.SHINGLE + 1) for line in own)
    made = rows_made(signed._jdf.queryExecution().executedPlan(), "Generate")
    assert made - len(own) < shingled / 8  # the lines themselves come of a Generate as well
    data = found.select("id", lines._wide("line").alias("data"))
    hashed = data.select("id", F.explode(lines._hashes("data")).alias("h"))
    want = {}
    for r in hashed.collect():
        want.setdefault(r.id, set()).add(r.h >> 32)
    drawn_points = alike.points(lines.ROWS * lines.BANDS, 4)
    assert got == {i: tuple(min(h ^ p for h in hs) for p in drawn_points) for i, hs in want.items()}


@pytest.mark.parametrize("most", [alike.MOST_HELD, 2])
def test_the_prefix_filter_sorts_one_number_and_loses_no_pair(spark, monkeypatch, most):
    """However far counts order the elements, every like pair of two classes is let through."""
    monkeypatch.setattr(alike, "MOST_HELD", most)
    rng = random.Random(4)
    base = [[rng.getrandbits(63) - (1 << 62) for _ in range(40)] for _ in range(6)]
    sets = [sorted(set(rng.sample(b, rng.randint(30, 40)) + rng.choices(base[0], k=3))) for b in base for _ in range(12)]
    items = spark.createDataFrame(list(enumerate(sets)), "id long, data array<long>")
    rest = spark.createDataFrame([(k, k) for k in range(len(sets))], "id long, class long")
    pairs = alike.sharing_pairs(rest, items, F.col, 0.8)
    like = {
        (a, b) for a in range(len(sets)) for b in range(a)
        if len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})
    }
    found = {(r.a, r.b) for r in pairs.collect()}
    assert len(like) > 20 and like <= found and len(found) < len(sets) * (len(sets) - 1) / 4
