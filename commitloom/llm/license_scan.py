"""Operator 2: licence passages, found with a generalised suffix automaton.

The automaton holds all templates' words: every word sequence of a template is a
path from its root. A text runs through it word by word; state and length give
the longest template passage that ends there (matching statistics). Passages too
long to be chance are chained, in order and with small gaps, into spans of a
template; a span that covers enough of its template gives the template's label.
A short base phrase must occur whole, which the state and the length tell too.

Only stretches of at least three words that all occur in templates are run: a
word outside them ends every match, and no phrase is shorter.

Defined cases: a null or wordless text has no place, no label and score 0;
repeated rows are scanned each; ties in coverage take the first label in order;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.llm.common import binary, received, send
from commitloom.llm.license_texts import BASE_PHRASES, NOTICES
from commitloom.llm.suffix_automaton import SuffixAutomaton
from commitloom.llm.words import folded_words, known_runs

#: words of a passage that counts as a match, the widest gap between two chained
#: matches, and the share of a template's words that gives its label
SHORTEST, GAP, COVERAGE = 3, 6, 0.75


@dataclass(frozen=True)
class Span:
    """Words [start, stop) of a text, chained to a share of a template."""

    label: str
    start: int
    stop: int
    coverage: float


class LicenseScanner:
    """Base phrases' places and template spans of texts."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, tuple[str, ...]]):
        self.sequences = [(label, text.encode().split(), True) for label, text in sorted(phrases.items())]
        self.sequences += [
            (label, text.encode().split(), False) for label, texts in sorted(notices.items()) for text in texts
        ]
        self.automaton = SuffixAutomaton([words for _, words, _ in self.sequences])
        self.vocabulary = {w: 1 for _, words, _ in self.sequences for w in words}
        self.least = min([SHORTEST, *(len(w) for _, w, base in self.sequences if base)])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[Span]]:
        """Base phrases as (start, label), and spans of notices."""
        import numpy as np

        _, starts = known_runs(words, self.vocabulary, self.least)
        places, matches = [], []
        if len(starts):
            breaks = np.flatnonzero(np.diff(starts) > 1) + 1
            for run in np.split(starts, breaks):
                first, stop = int(run[0]), int(run[-1]) + self.least
                self._run(words, first, stop, places, matches)
        return sorted(places), self._chain(matches)

    def _run(self, words, first, stop, places, matches) -> None:
        before = (0, 0)
        for place, (state, length) in enumerate(self.automaton.run(words[first:stop]), first):
            if length <= before[1] and before[1] >= SHORTEST:
                self._add(place - 1, *before, matches)
            for number in self.automaton.states[state].whole:
                label, phrase, base = self.sequences[number]
                if base and length >= len(phrase):
                    places.append((place - len(phrase) + 1, label))
            before = state, length
        if before[1] >= SHORTEST:
            self._add(stop - 1, *before, matches)

    def _add(self, place: int, state: int, length: int, matches: list) -> None:
        """A match that ends with the word at `place`, once for each place in a notice."""
        for number, end in self.automaton.states[state].ends:
            if not self.sequences[number][2]:
                matches.append((number, place - length + 1, end - length + 1, length))

    def _chain(self, matches: list) -> list[Span]:
        """Best chains of each notice: matches in order, none far from the one before."""
        spans = []
        ordered = sorted(matches)
        chains: list[tuple[int, int, int, int, int]] = []  # notice, first, text stop, notice stop, covered
        for number, start, at, length in ordered:
            best = (number, start, start + length, at + length, length)
            for k in range(len(chains) - 1, -1, -1):
                other, first, text_stop, notice_stop, covered = chains[k]
                if other != number or start - text_stop > GAP + len(self.sequences[number][1]):
                    break
                gap, step = start - text_stop, at - notice_stop
                overlap = max(0, -gap, -step)
                if gap <= GAP and step <= GAP and overlap < length and covered + length - overlap > best[4]:
                    best = (number, first, start + length, at + length, covered + length - overlap)
            chains.append(best)
        for number, first, stop, _, covered in chains:
            label, words, _ = self.sequences[number]
            spans.append(Span(label, first, stop, min(1.0, covered / len(words))))
        return spans


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] = BASE_PHRASES,
    notices: dict[str, tuple[str, ...]] = NOTICES,
    coverage: float = COVERAGE,
) -> DataFrame:
    """Per document: base places, labels, the best coverage, and the labelled spans."""
    scanner = send(docs.sparkSession, LicenseScanner(phrases, notices))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _scan(batches, received(scanner), coverage),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, "
        "spans array<struct<label:string,start:int,stop:int,coverage:double>>",
    )


def _scan(batches: Iterator, scanner: LicenseScanner, coverage: float) -> Iterator:
    import pyarrow as pa

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.struct([("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("coverage", pa.float64())])
    whole, text = pa.int64(), pa.string()
    types = [whole, whole, whole, whole, whole, text, text, pa.float64(), pa.list_(span)]
    for batch in batches:
        rows = []
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), binary(batch.column("text")), strict=True):
            words = folded_words(data)
            places, spans = scanner.scan(words)
            base = {label for _, label in places}
            good = [s for s in spans if s.coverage >= coverage]
            score = max([1.0 if places else 0.0, *(s.coverage for s in spans)])
            rows.append((
                doc_id, len(words), len(places),
                places[0][0] if places else None, places[-1][0] if places else None,
                ",".join(sorted(base)), ",".join(sorted(base | {s.label for s in good})), score,
                [vars(s) for s in sorted(good, key=lambda s: (s.start, s.stop, s.label))],
            ))
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names
        )
