"""Operator 5: packing documents into fixed-length sequences, in their order.

Documents, ascending by id, form one token stream a range partition. A dynamic
programme over the cut places of a stretch of that stream chooses the sequences:
a cut costs nothing at a document's end, a little after a sentence, more
elsewhere, and each unfilled position costs one. The best predecessor of a place
is the least value in a sliding window, kept by a monotone queue, so a stretch
takes time in proportion to its places. A stretch's last sequence is carried
into the next one; the rest at a partition's end is cut into powers of two when
that is cheaper than padding.

Defined cases: a null text is empty and holds the end id only; a null id sorts
first; repeated rows are packed as often as they occur; an empty table gives no
piece; a text longer than a stretch is cut over several; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.llm.common import binary, text_or_empty
from commitloom.llm.word_encoder import word_encoder

SEQUENCE = 4096
#: tokens one dynamic programme covers; it bounds a task's memory, not the result's size
STRETCH = 1 << 20
#: what a cut costs, in positions of padding
AFTER_SENTENCE, ELSEWHERE = 4, 12
#: where no sentence ends, a cut is possible at each multiple of so many tokens
STEP = 32

SPACE, CLOSERS, MARKS, WIDE_MARKS = b"\t\n\x0b\x0c\r ", b"\"')]", b".!?", "。！？…"

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, sequence: int = SEQUENCE, stretch: int = STRETCH
) -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence."""
    rows = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            text_or_empty().alias("text"),
            F.xxhash64("text").alias("tie"),
        )
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
    )
    return rows.mapInArrow(
        lambda batches: _pack(batches, tokenizer, end_id, sequence, stretch), PIECES
    )


def best_cuts(places: list[int], costs: list[int], sequence: int, last_cost) -> list[int]:
    """Indexes of the cheapest cuts; places ascend from 0, the last is the end.

    Neighbouring places lie at most `sequence` apart. The value of a place is the
    least padding plus cut costs of a division that ends there; what the last
    sequence costs is `last_cost` of its length.
    """
    came, values = [0] * len(places), [0] * len(places)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # value + place, place, index
    push, pop, drop = queue.append, queue.pop, queue.popleft
    for j in range(1, len(places) - 1):
        place = places[j]
        while queue[0][1] < place - sequence:
            drop()
        best, _, came[j] = queue[0]
        value = best + sequence + costs[j]  # the place itself cancels out
        values[j] = value - place
        while queue and queue[-1][0] >= value:
            pop()
        push((value, place, j))
    end = len(places) - 1
    near = range(bisect_left(places, places[end] - sequence), end)
    came[end] = min(near, key=lambda i: values[i] + last_cost(places[end] - places[i]))
    cuts = [end]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return cuts[::-1]


def _holds(some: bytes):
    """For each byte whether it is one of some."""
    table = np.zeros(256, bool)
    table[list(some)] = True
    return table


IS_SPACE, IS_CLOSER, IS_MARK = _holds(SPACE), _holds(CLOSERS), _holds(MARKS)
WIDE = [int.from_bytes(mark.encode(), "big") for mark in WIDE_MARKS]


def sentence_ends(text: bytes):
    """For each word of a text, whether a sentence ends with it."""
    # blanks before the text, so that a word's end can be looked back from
    data = np.frombuffer(b"    " + text + b" ", "u1")
    space = IS_SPACE[data]
    last = np.flatnonzero(~space[:-1] & space[1:])
    final = data[last]
    for _ in range(2):
        closed = np.flatnonzero(IS_CLOSER[final])
        if not len(closed):
            break
        last[closed] -= 1
        final[closed] = data[last[closed]]
    ends = IS_MARK[final]
    # a wide mark has three bytes, none of them ASCII
    far = np.flatnonzero(final >= 0x80)
    if len(far):
        at = last[far]
        wide = data[at].astype("i4") | data[at - 1].astype("i4") << 8 | data[at - 2].astype("i4") << 16
        for mark in WIDE:
            ends[far] |= wide == mark
    return ends


class _Stretch:
    """Tokens not yet given out: ids, the places where they may be cut, their documents."""

    def __init__(self):
        self.ids, self.length = [], 0
        self.places, self.costs = [], []
        self.docs = []  # id, where it starts here (before 0 if earlier), tokens

    def add(self, doc_id, text: bytes, ids: list[bytes], end: bytes, stretch: int) -> Iterator[None]:
        """Append a document, its ids word by word; yields whenever the stretch is full."""
        data = np.frombuffer(b"".join(ids) + end, "<u4")
        sentence = sentence_ends(text)
        ends = np.cumsum(np.fromiter(map(len, ids), "i8", len(ids)))[sentence] // 4
        ends = ends[(ends > 0) & (ends < len(data) - 1)]
        self.docs.append((doc_id, self.length, len(data)))
        done = 0
        while done < len(data):
            part = min(len(data) - done, max(1, stretch - self.length))
            inside = ends[(ends > done) & (ends < done + part)]
            self.ids.append(data[done : done + part])
            self.places.append(inside - done + self.length)
            self.costs.append(np.full(len(inside), AFTER_SENTENCE))
            self.length, done = self.length + part, done + part
            self.places.append(np.array([self.length]))
            self.costs.append(np.array([0 if done == len(data) else ELSEWHERE]))
            if self.length >= stretch:
                yield

    def take(self, sequence: int, last: bool) -> Iterator[tuple]:
        """Give out the sequences; all but the last one unless this is the end."""
        import zlib

        if not self.length:
            return
        ids = np.concatenate(self.ids)
        places, first = np.unique(np.concatenate([[0], *self.places]), return_index=True)
        costs = np.concatenate([[0], *self.costs])[first]
        gaps = np.flatnonzero(np.diff(places) > STEP)
        extra = [np.arange(places[g] + STEP, places[g + 1], STEP) for g in gaps]
        places = np.concatenate([places, *extra])
        costs = np.concatenate([costs, *(np.full(len(e), ELSEWHERE) for e in extra)])
        order = np.argsort(places, kind="stable")
        places, costs = places[order].tolist(), costs[order].tolist()
        # what is carried on costs nothing yet
        last_cost = (lambda length: _tail(length, sequence)[0]) if last else (lambda length: 0)
        bounds = [places[c] for c in best_cuts(places, costs, sequence, last_cost)]
        if last:
            start = bounds[-2]
            bounds[-1:] = [start + end for end in _tail(bounds[-1] - start, sequence)[1]]
        else:
            bounds.pop()
        done = 0
        for s, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            while done < len(self.docs) and self.docs[done][1] < b:
                doc_id, start, n = self.docs[done]
                low, high = max(a, start), min(b, start + n)
                yield s, doc_id, low - start, high - low, zlib.crc32(ids[low:high].tobytes()), n, low - a
                if start + n > b:
                    break
                done += 1
        at = bounds[-1]
        rest = [(d, start - at, n) for d, start, n in self.docs[done:]]
        places, costs = np.array(places), np.array(costs)
        later = places > at
        self.__init__()
        self.ids, self.length, self.docs = [ids[at:].copy()], len(ids) - at, rest
        self.places, self.costs = [places[later] - at], [costs[later]]


def _tail(length: int, sequence: int) -> tuple[int, list[int]]:
    """Cost and ends of the last sequences: powers of two if that is cheaper than padding."""
    powers = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    cost = (len(powers) - 1) * ELSEWHERE
    if cost >= sequence - length:
        return sequence - length, [length]
    return cost, list(accumulate(powers))


def _pack(batches: Iterator, tokenizer: str, end_id: int, sequence: int, stretch: int) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    encoder, end = word_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
    names = [c.split()[0] for c in PIECES.split(", ")]
    next_id = TaskContext.get().partitionId() << 40
    kept = _Stretch()

    def pieces(last: bool):
        nonlocal next_id
        rows = list(kept.take(sequence, last))
        for some in range(0, len(rows), 20_000):
            s, doc_id, start, length, crc, n, offset = zip(*rows[some : some + 20_000], strict=True)
            ids = [next_id + x for x in s]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (doc_id, start, length, crc, n, ids, offset)], names
            )
        if rows:
            next_id += rows[-1][0] + 1

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), binary(batch.column("text")), strict=True):
            for _ in kept.add(doc_id, text, encoder.words(text)[1], end, stretch):
                yield from pieces(False)
    yield from pieces(True)
