"""Near-duplicate documents, fingerprints, lines, passages, components."""

import hashlib
import random
import re

import pytest
import xxhash
from conftest_llm import AWKWARD

from commitloom.llm import fingerprints, lines, simhash_trees, substrings
from commitloom.llm.components import components

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def least_reachable(nodes, linked):
    """The least node reachable from each node."""
    found = {}
    for node in sorted(nodes):
        if node in found:
            continue
        open_nodes = [node]
        while open_nodes:
            at = open_nodes.pop()
            if at not in found:
                found[at] = node
                open_nodes += [other for other in nodes if other not in found and linked(at, other)]
    return found


def simhash(text, shingle=3):
    w = SPACED.findall(lower(text))
    parts = [" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 1), (2, 3)], [(k, k + 1) for k in range(40)], "random"])
def test_components(spark, edges):
    if edges == "random":
        rng = random.Random(1)
        edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    df = spark.createDataFrame([*edges, (7, None)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    pairs = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == least_reachable(nodes, lambda a, b: (a, b) in pairs)


def near_texts():
    rng, rows = random.Random(2), []
    for base in range(4):
        words = [f"t{rng.randrange(900)}" for _ in range(60)]
        for copy in range(6):
            own = list(words)
            for _ in range(copy % 3):
                own[rng.randrange(60)] = f"n{rng.randrange(99)}"
            rows.append((5000 + 10 * base + copy, " ".join(own)))
    return rows


def test_near_duplicates_are_those_of_brute_force(make, texts):
    rows = texts + [r for r in AWKWARD if r[0] is not None] + near_texts()
    prints = {}
    for i, text in rows:
        prints.setdefault(i, set()).add(simhash(text))
    nodes = sorted(prints)

    def linked(a, b):
        return any((x ^ y).bit_count() <= 3 for x in prints[a] for y in prints[b])

    want = least_reachable(nodes, linked)
    got = simhash_trees.near_duplicates(make(rows, extra=True)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {(r.doc_id, int(r.fingerprint, 16)) for r in got} == {(i, p) for i, own in prints.items() for p in own}


def test_one_of_each_group_stays(make):
    docs = make([*near_texts(), *AWKWARD], extra=True)
    kept = simhash_trees.keep_one(docs, 5, 9)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {5000, 5010, 5020, 5030} <= ids and len([i for i in ids if i and 5000 <= i < 6000]) <= 8
    assert None in ids and 4 not in ids and 3 in ids  # a null text comes before the equal empty one
    assert simhash_trees.keep_one(make([]), 5, 9).count() == 0


def test_shards_lose_no_link():
    rng = random.Random(3)
    masks = simhash_trees.shard_masks(3)
    assert all(mask.bit_count() == 28 for mask in masks)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_tree_finds_all_near_values():
    rng = random.Random(4)
    values = [rng.getrandbits(10) for _ in range(300)]
    for radius in (0, 1, 3):
        tree = simhash_trees.BKTree(radius)
        for n, value in enumerate(values):
            near = sorted(tree.near(value))
            assert near == [k for k in range(n) if (values[k] ^ value).bit_count() <= radius]
            tree.add(value)


def test_edits_and_fingerprints(make, texts):
    rows = sorted({r for r in texts + [r for r in AWKWARD if r[0] is not None]}, key=lambda r: (r[0], r[1] or ""))
    rows = [r for k, r in enumerate(rows) if not k or rows[k - 1][0] != r[0]]
    got = {r.doc_id: r for r in fingerprints.compare_edits(make(rows, extra=True)).collect()}
    prints = {i: int(r.fingerprint, 16) for i, r in got.items()}
    assert len(got) == len(rows)
    different = set(prints.values())
    for (i, text), (j, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after, r = text or "", after or "", got[i]
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_next == 1 - (prints[i] ^ prints[j]).bit_count() / 64
        assert r.near_edited == 1 - (prints[i] ^ int(r.edited_fingerprint, 16)).bit_count() / 64
        if i % 20 == 0:
            assert r.n_near == sum((prints[i] ^ p).bit_count() <= 3 for p in different) - 1
    by_text = {}
    for i, text in rows:
        assert by_text.setdefault(text or "", prints[i]) == prints[i]


def test_votes_are_those_of_brute_force(make):
    text = "The cat the CAT sat on a longer-than-usual-hyphenated word the cat"
    w = text.lower().split()
    votes = [0] * 64
    from pyspark.sql import functions as F

    docs = make([(1, text)])
    spark = docs.sparkSession
    pairs = list(zip(w, w[1:], strict=False))
    hashed = spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64("a", "b").alias("h"), "a", "b").collect()
    for r in hashed:
        weight = min(len(r.a) + len(r.b), fingerprints.HEAVIEST)
        for bit in range(64):
            votes[bit] += weight if r.h >> bit & 1 else -weight
    want = sum(1 << bit for bit in range(64) if votes[bit] > 0)
    found = fingerprints.fingerprints(fingerprints.identified(docs), "text", ["doc"]).first().print
    assert found & (1 << 64) - 1 == want


def test_search_within_a_radius(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    for value in list(values):
        for bits in (1, 2, 3, 4):
            other = value & (1 << 64) - 1
            for bit in rng.sample(range(64), bits):
                other ^= 1 << bit
            values.append(other - (1 << 64 if other >> 63 else 0))
    index = spark.createDataFrame([(v,) for v in set(values)], "print long")
    queries = index.where("print % 3 = 0")
    got = sorted(map(tuple, fingerprints.within(queries, index, 3).collect()))
    full = (1 << 64) - 1
    asked = [v for v in set(values) if abs(v) % 3 == 0]
    want = sorted((a, b) for a in asked for b in set(values) if ((a ^ b) & full).bit_count() <= 3)
    assert got == want


def test_repeated_rows_are_one_document_in_a_row_each(make):
    once = [(1, "first text of some words"), (2, "second text, another one"), (3, "third text"), (4, None)]
    often = once + [once[1]] * 30 + [once[2]] * 20 + [once[3]]
    want = {r.doc_id: r for r in fingerprints.compare_edits(make(once)).collect()}
    got = fingerprints.compare_edits(make(often, extra=True)).collect()
    assert len(got) == len(often) and all(r == want[r.doc_id] for r in got)
    assert sum(r.doc_id == 2 for r in got) == 31


def test_one_and_no_document(make):
    one = fingerprints.compare_edits(make([(5, "a single text of some words")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.compare_edits(make([])).count() == 0


def shingles(line, size=lines.SHINGLE):
    data, size = line.encode("utf-16-be"), size * lines.UNIT
    return {data[k : k + size] for k in range(0, max(1, len(data) - size + 1), lines.UNIT)}


def kept_lines(rows):
    """Places kept, by all pairs of different lines."""
    first = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        for place, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip(" \t\r\x0b\f"):
                first.setdefault(line, (i, place))
    sets = {line: shingles(line) for line in first}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)

    group = least_reachable(list(first), linked)
    best = {}
    for line, place in first.items():
        best[group[line]] = min(place, best.get(group[line], place))
    kept = set(best.values())
    out = {}
    for i, text in rows:
        if text is None:
            out[i] = (0, 0, None)
            continue
        split = text.split("\n")
        own = [line for place, line in enumerate(split) if not line.strip(" \t\r\x0b\f") or (i, place) in kept]
        out[i] = (len(split), len(split) - len(own), "\n".join(own))
    return out


def line_rows():
    rng, rows = random.Random(6), []
    bases = [" ".join(f"k{rng.randrange(10**6)}" for _ in range(25)) for _ in range(30)]
    for doc in range(25):
        own = []
        for _ in range(8):
            words = rng.choice(bases).split()
            if rng.random() < 0.4:
                words[rng.randrange(25)] = f"e{rng.randrange(99)}"
            if doc % 3 == 0:  # other alphabets, two to four bytes a character in UTF-8
                words = [w.translate({ord("k"): "ж", ord("1"): "一", ord("2"): "\U0001f600"}) for w in words]
            own.append(" ".join(words))
        rows.append((900 + doc, "\n".join([*own, "", "short", f"own line of {doc}"])))
    return rows


def test_lines_kept_are_those_of_brute_force(make):
    rows = line_rows() + [r for r in AWKWARD if r[0] not in (None, 6)]
    want = kept_lines(rows)
    docs = make(rows, extra=True)
    got = {r.doc_id: r for r in lines.line_classes(docs).collect()}
    assert {i: r.n_lines for i, r in got.items()} == {i: n for i, (n, _, _) in want.items()}
    gone = sum(r.n_removed for r in got.values())
    all_gone = sum(n for _, n, _ in want.values())
    assert all_gone > 100 and 0.97 * all_gone <= gone <= all_gone  # signatures may miss a link
    kept = lines.drop_lines(docs)
    assert kept.schema == docs.schema
    texts = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    for i, (_, removed, text) in want.items():
        if i in texts:
            have, size = texts[i]
            assert got[i].kept_sha256 == digest(have) and size == (None if have is None else len(have))
            assert set((text or "").split("\n")) <= set((have or "").split("\n"))
        else:
            assert removed and not text.strip()


def test_lines_of_awkward_tables(make):
    assert lines.line_classes(make([])).count() == 0
    assert lines.line_classes(make(AWKWARD)).count() == len(AWKWARD)
    assert lines.recall(0.8) > 0.99 and lines.recall(0.85) > 0.999


def test_a_document_of_many_lines_takes_linear_time(make):
    text = "\n".join(f"{k}" if k % 5 else "" for k in range(300_000))
    row = lines.line_classes(make([(1, text), (2, "7\n\nnew")])).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in row} == {1: (300_000, 0), 2: (3, 1)}


def kept_words(rows, window=20):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = SPACED.findall(text or "")
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_passages(make, texts):
    long = " ".join(f"p{k % 37}" for k in range(400))
    rows = [*texts, (9001, "a " * 60), (9002, long), (9003, "x " + long[:600]), (9004, None), (9005, ""),
            (None, long[40:300]), (9007, "b b " * 12 + "a " * 19)]
    got = sorted(map(tuple, substrings.digests(substrings.repeats(make(rows, extra=True))).collect()), key=repr)
    want = kept_words(rows)
    assert got == want and sum(r[2] for r in want) > 500
    assert substrings.repeats(make([])).count() == 0


def test_repeated_rows_are_one_document(make):
    text = " ".join(f"q{k}" for k in range(30))
    got = substrings.repeats(make([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 30)]


@pytest.mark.parametrize("shard_words", [10_000, 50])
def test_known_passages(spark, make, texts, shard_words):
    reference = make(texts[:40])
    rows = [*texts[30:60], (9004, None), (9005, ""), (9006, " ".join((texts[3][1] or "").split()[2:30]))]
    got = substrings.remove_known(make(rows, extra=True), reference, 5, shard_words=shard_words).collect()
    known = set()
    for _, text in texts[:40]:
        w = SPACED.findall(text or "")
        known |= {tuple(w[s : s + 5]) for s in range(len(w) - 4)}
    want = {}
    for i, text in rows:
        w = SPACED.findall(text or "")
        gone = {s + k for s in range(len(w) - 4) if tuple(w[s : s + 5]) in known for k in range(5)}
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want
