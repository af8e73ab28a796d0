"""Licence passages and benchmark passages."""

import hashlib
import re

from conftest_llm import AWKWARD

from commitloom.llm import decontaminate, license_scan
from commitloom.llm.license_texts import BASE_PHRASES, NOTICES
from commitloom.llm.suffix_automaton import SuffixAutomaton

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


LICENSED = [
    (101, "Foo. Released under the MIT License. under the mit license under the MIT license"),
    (102, "Licensed under the Apache License, Version 2.0. CC-BY-NC cc by nc"),
    (103, "see the GNU General Public License, version 3. This work is licensed under the GNU General Public License, version 3"),
    (104, "under the mit like license version 2 apache license version"),
]


def test_base_places(make, texts):
    rows = texts + AWKWARD + LICENSED
    got = license_scan.scan_licenses(make(rows, extra=True)).collect()
    want = []
    for i, text in rows:
        w = words(text)
        places = sorted(
            (s, label) for label, phrase in BASE_PHRASES.items()
            for s in range(len(w)) if w[s : s + len(phrase.split())] == phrase.split()
        )
        starts = [s for s, _ in places]
        want.append((
            i, len(w), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})),
        ))
    have = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    labels = {r.doc_id: (r.labels, r.score) for r in got}
    assert labels[103][0] == "gpl-3" and labels[103][1] >= 0.9
    assert labels[104][0] == "" and labels[104][1] < 1
    assert labels[102][0] == "apache-2,cc-by-nc" and labels[4] == ("", 0.0)
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in got if r.base_labels)


def test_long_notice_with_gaps(make):
    notice = NOTICES["mit"][0].split()
    text = "x " * 50 + " ".join([*notice[:20], "EDIT", *notice[21:]]) + " y" * 50
    row = license_scan.scan_licenses(make([(1, text)])).first()
    assert row.labels == "mit" and row.score > 0.9
    span = max(row.spans, key=lambda s: s.coverage)
    assert (span.start, span.stop) == (50, 50 + len(notice))


def test_matching_statistics():
    sequences = [s.split() for s in ("a b c a b d", "b c b c a", "d", "a b c a b d")]
    automaton = SuffixAutomaton([[w.encode() for w in s] for s in sequences])
    text = "x a b c b c a b d d b c a b c a b d q".split()
    lengths = [n for _, n in automaton.run([w.encode() for w in text])]
    for end, length in enumerate(lengths, 1):
        def occurs(n, end=end):
            part = text[end - n : end]
            return any(s[k : k + n] == part for s in sequences for k in range(len(s) - n + 1))

        longest = max(n for n in range(end + 1) if n == 0 or occurs(n))
        assert length == longest


def brute(rows, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add("" if item is None else str(item))
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if own := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


ITEMS = [
    (1, "one TWO three"), (10, "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11"), (2, None), (3, ""),
    (None, "a null id"), (1, "one two three"), (11, "日本語"),
]


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_hits_are_those_of_brute_force(spark, make, texts, folder, monkeypatch):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()] + ITEMS
    rows = texts + AWKWARD
    want = brute(rows, items)
    assert any(r[-1] for r in want)
    for shard in (decontaminate.SHARD_BYTES, 4000):  # one broadcast, then several passes
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
        got = decontaminate.contamination(make(rows, extra=True), items_of(spark, items)).collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_removal_leaves_no_window_and_all_else(spark, make):
    docs = make([*AWKWARD, (20, "Before, one two\nthree after."), (21, "one one two three two three")], extra=True)
    items = items_of(spark, ITEMS)
    clean = decontaminate.remove_items(docs, items)
    assert clean.schema == docs.schema
    assert not decontaminate.contamination(clean, items).where("contaminated").count()
    texts = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert texts[20] == ("Before, \n after.", 16)
    assert 21 not in texts and None not in texts  # nothing else was in them
    assert texts[3] == (None, None) and texts[4] == ("", 0) and texts[8] == ("x", 1)


def cleaned(text, items, size=10):
    """The words left when all occurrences of all windows go at once, until none is left."""
    left = words(text)
    windows = {tuple(w[s : s + size]) for _, t in items for w in [words(t)] for s in range(max(1, len(w) - size + 1))}
    while True:
        hit = set()
        for window in windows:
            for s in range(len(left) - len(window) + 1):
                if tuple(left[s : s + len(window)]) == window[:size]:
                    hit.update(range(s, s + len(window)))
        if not hit:
            return left
        left = [w for k, w in enumerate(left) if k not in hit]


def test_shards_cut_no_text_differently(spark, make, monkeypatch):
    run = [f"w{k}" for k in range(40)]
    # items overlap in the texts; the last ones come together only where another is cut out
    items = [(k, " ".join(run[s : s + 12])) for k, s in enumerate((2, 8, 14, 20))]
    items += [(10, "one two three four"), (11, "x one"), (12, "y z")]
    rows = [
        (1, " ".join(run)), (2, "a " + " ".join(run[5:30]) + " b"), (3, "clean text"),
        (4, "p x " + " ".join(run[2:14]) + " one q"), (5, "y one two three four z. End"), (6, "y x one two three four z"),
    ]
    docs, table = make(rows, extra=True), items_of(spark, items)
    whole = sorted((r.doc_id, r.text, r.n_chars) for r in decontaminate.remove_items(docs, table).collect())
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 100)
    assert decontaminate._shard_count(decontaminate._passages(table)) > 4
    parts = decontaminate.remove_items(docs, table)
    assert parts.schema == docs.schema
    assert sorted((r.doc_id, r.text, r.n_chars) for r in parts.collect()) == whole
    left = {i: cleaned(t, items) for i, t in rows}
    assert {i: words(t) for i, t, _ in whole} == {i: w for i, w in left.items() if w}
    assert left[4] == ["p", "q"] and left[6] != words(rows[5][1])


def test_empty_tables(spark, make, texts):
    none = items_of(spark, [])
    assert decontaminate.contamination(make([]), items_of(spark, ITEMS)).count() == 0
    assert decontaminate.contamination(make(texts[:5]), none).where("contaminated").count() == 0
    assert license_scan.scan_licenses(make([])).count() == 0
