"""Operator 9: removal of word passages that occur before.

`remove_known` is the method by suffix automata: each shard of a reference, of a
bounded size, is broadcast as an automaton; documents stream through it, and the
maximal spans whose matching statistics reach the length are removed. Further
shards take further passes.

`repeats` does it where the corpus is its own reference. Its automata would grow
with the corpus, and every document would have to pass every shard, so candidates
are found first: a passage of twenty words has the same least eight-word gram
wherever it stands, so only windows whose least gram occurs at two places can
repeat. Those windows go by a 64-bit hash to the least place that has them, by an
aggregate that combines before it shuffles, and each document gets back the
windows it is first to hold; its other candidates are removed. Two different
windows share a hash with a chance of one in 2**64 a pair.

Defined cases: a null or wordless text has nothing to remove and keeps an empty
text; a null id comes before all others; rows equal in id and text count as one
document, other rows of one id are ordered by their text's hash; texts shorter
than the window are left as they are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.llm.common import binary, free, received, send, store
from commitloom.llm.suffix_automaton import SuffixAutomaton

WINDOW, GRAM = 20, 8
#: stands for a null id, before all others
NO_ID = -(1 << 63)
#: words of a reference shard; its automaton takes up to a kilobyte a word
SHARD_WORDS = 100_000


class Windows:
    """Hashes of a document's grams and windows."""

    def __init__(self, text: bytes, window: int):
        import numpy as np
        from xxhash import xxh64_intdigest

        self.words, self.window = text.split(), window
        n = len(self.words)
        self.count = max(0, n - window + 1)
        self.gram = min(GRAM, window)
        self.hashes = np.fromiter(map(xxh64_intdigest, self.words), "u8", n) if self.count else None

    def _rolled(self, size: int, seed: int):
        import random

        import numpy as np

        rng = random.Random(seed)
        total = np.zeros(len(self.hashes) - size + 1, "u8")
        for k in range(size):
            total += self.hashes[k : len(self.hashes) - size + 1 + k] * np.uint64(rng.getrandbits(64) | 1)
        total ^= total >> np.uint64(31)
        total *= np.uint64(0x9E3779B97F4A7C15)
        return total ^ (total >> np.uint64(29))

    def anchors(self):
        """The grams' hashes, and for each window the place of its least gram."""
        import numpy as np

        grams = self._rolled(self.gram, 1)
        span = self.window - self.gram + 1
        least = np.empty(self.count, "i8")
        for start in range(0, self.count, 1 << 16):
            part = grams[start : min(start + (1 << 16), self.count) + span - 1]
            views = np.lib.stride_tricks.sliding_window_view(part, span)
            least[start : start + len(views)] = views.argmin(axis=1) + np.arange(start, start + len(views))
        return grams, least

    def keys(self):
        return self._rolled(self.window, 2)

    def candidates(self, places: list[int]):
        """Starts of the windows whose least gram stands at one of the places."""
        import numpy as np

        if not self.count or not places:
            return np.empty(0, "i8")
        chosen = np.zeros(len(self.words), bool)
        places = np.array(places, "i8")
        chosen[places[places < len(self.words)]] = True
        return np.flatnonzero(chosen[self.anchors()[1]])

    def covered(self, starts):
        """Which words lie in a window at one of the starts."""
        import numpy as np

        change = np.zeros(len(self.words) + 1, "i8")
        if len(starts):
            np.add.at(change, starts, 1)
            np.add.at(change, starts + self.window, -1)
        return np.cumsum(change[:-1]) > 0


def _identified(docs: DataFrame) -> DataFrame:
    """Order and identity of a row: its id, null first, and its text's hash."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("tie"),
        F.col("text").alias("text"),
    )


def candidates(docs: DataFrame, window: int) -> DataFrame:
    """(doc, tie, rank, places): places of the least grams that occur twice or more.

    `rank` numbers the documents with such places in their order.
    """
    grams = _identified(docs).select("doc", "tie", "text").mapInArrow(
        lambda batches: _anchors(batches, window), "gram long, doc long, tie long, place int"
    )
    # written first, so that a gram of many places can be split in the join
    repeated = store(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    found = grams.join(repeated, "gram", "left_semi").groupBy("doc", "tie").agg(
        F.collect_list("place").alias("places")
    )
    ordered = found.repartitionByRange("doc", "tie").sortWithinPartitions("doc", "tie")
    return store(ordered.withColumn("rank", F.monotonically_increasing_id()))


def _anchors(batches: Iterator, window: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        rows = []
        keys = zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), strict=True)
        for (doc, tie), text in zip(keys, binary(batch.column("text")), strict=True):
            found = Windows(text, window)
            if found.count:
                grams, least = found.anchors()
                places = np.unique(least)
                full = len(places)
                rows.append((grams[places].view("i8"), np.full(full, doc), np.full(full, tie), places.astype("i4")))
        if rows:
            columns = [pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "doc", "tie", "place"])


def _window_rows(batches: Iterator, window: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        rows = []
        keys = zip(batch.column("rank").to_pylist(), batch.column("places").to_pylist(), strict=True)
        for (rank, places), text in zip(keys, binary(batch.column("text")), strict=True):
            found = Windows(text, window)
            starts = found.candidates(places)
            if len(starts):
                rows.append((found.keys()[starts].view("i8"), np.full(len(starts), rank), starts.astype("i4")))
        if rows:
            columns = [pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "rank", "start"])


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the kept words joined by single spaces."""
    found = candidates(docs, window)
    free(docs.sparkSession)
    texts = _identified(docs)
    rows = texts.join(found, ["doc", "tie"]).select("rank", "places", "text").mapInArrow(
        lambda batches: _window_rows(batches, window), "key long, rank long, start int"
    )
    first = rows.groupBy("key").agg(F.min(F.struct("rank", "start")).alias("first"))
    firsts = first.select("first.*").groupBy("rank").agg(F.collect_list("start").alias("firsts"))
    judged = found.join(firsts, "rank", "left").select("doc", "tie", "places", "firsts")
    whole = texts.join(judged, ["doc", "tie"], "left")
    # both joins above take the same three columns and read one shuffle of the texts
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")
    return whole.select(doc_id, "text", "places", "firsts").mapInArrow(
        lambda batches: _kept(batches, window), "doc_id long, n_words long, n_removed long, kept string"
    )


def _kept(batches: Iterator, window: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        counts, removed, kept = [], [], []
        lists = zip(batch.column("places").to_pylist(), batch.column("firsts").to_pylist(), strict=True)
        for (places, firsts), text in zip(lists, binary(batch.column("text")), strict=True):
            if not places:
                words, out = text.split(), 0
            else:
                found = Windows(text, window)
                starts = np.setdiff1d(found.candidates(places), np.array(firsts or [], "i8"))
                gone = found.covered(starts)
                words = [w for w, g in zip(found.words, gone.tolist(), strict=True) if not g]
                out = int(gone.sum())
            counts.append(len(words) + out)
            removed.append(out)
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _reference_shards(reference: DataFrame, shard_words: int) -> Iterator:
    """Broadcast automata of reference texts, each of about `shard_words` words.

    A text longer than a shard is cut into pieces that overlap by `shard_words` / 10.
    """
    words = reference.where("text IS NOT NULL").select(F.split("text", r"[\x20\x09-\x0D]+").alias("w"))
    step = shard_words - shard_words // 10
    cut = words.select(F.explode(F.sequence(F.lit(1), F.size("w"), F.lit(step))).alias("at"), "w")
    pieces = cut.select(F.slice("w", F.col("at"), shard_words).alias("w")).dropDuplicates()
    total = pieces.agg(F.sum(F.size("w"))).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    spread = pieces.withColumn("shard", F.pmod(F.xxhash64("w"), F.lit(shards)))
    for shard in range(shards):
        listed = sorted([x.encode() for x in r.w if x] for r in spread.where(F.col("shard") == shard).toLocalIterator())
        yield send(reference.sparkSession, SuffixAutomaton(listed, places=False))


def remove_known(docs: DataFrame, reference: DataFrame, length: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept: without the spans of `length` words or more that the reference has.

    `length` is at most a tenth of `shard_words`; spans are judged on the whole
    texts, so what one shard removes does not hide what another would.
    """
    if length > shard_words // 10:
        raise ValueError("a span must fit the overlap of two pieces")
    state = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"),
        F.array().cast("array<int>").alias("gone"),
    )
    schema = state.schema
    for place, automaton in enumerate(_reference_shards(reference, shard_words)):
        state = store(state) if place else state
        state = state.mapInArrow(lambda batches, a=automaton: _matched(batches, received(a), length), schema)
    return state.mapInArrow(_without, "doc_id long, n_words long, n_removed long, kept string")


def _matched(batches: Iterator, automaton: SuffixAutomaton, length: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        gone = []
        for text, before in zip(binary(batch.column("text")), batch.column("gone").to_pylist(), strict=True):
            words = text.split()
            hit = np.zeros(len(words), bool)
            hit[before] = True
            for end, (_, matched) in enumerate(automaton.run(words), 1):
                if matched >= length:
                    hit[end - matched : end] = True
            gone.append(np.flatnonzero(hit).tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text"), pa.array(gone, pa.list_(pa.int32()))],
            ["doc_id", "text", "gone"],
        )


def _without(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        counts, removed, kept = [], [], []
        for text, gone in zip(binary(batch.column("text")), batch.column("gone").to_pylist(), strict=True):
            words, out = text.split(), set(gone)
            counts.append(len(words))
            removed.append(len(out))
            kept.append(b" ".join(w for place, w in enumerate(words) if place not in out))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )
