"""Operator 3: benchmark passages in training text, found and removed.

The items' word windows (n consecutive words; a shorter item is one window) form
a hash set that every task gets. Texts are scanned once: only stretches of words
that all occur in the items are hashed, a hash found in the set is verified
against the window's words, and every word inside an occurrence is hit. Items
are sent in shards of bounded size; further shards take further passes over the
documents, with the hits so far kept in a written table.

Defined cases: a null text has no words; an item with no word or a null text has
no window; a null item id reads as an empty string; items repeated under an id
count once; repeated documents are scanned each; without documents or items
nothing is hit; all other columns are carried along in one struct.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.llm.common import binary, received, send, store
from commitloom.llm.words import FOLD, folded_words, known_runs

WINDOW = 10
#: bytes of item text in one broadcast shard; its index takes about thirty times that
SHARD_BYTES = 4 << 20


class WindowSet:
    """The windows of some items: hashes to search, words to verify, the items that have them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        import random

        import numpy as np

        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[int, dict[bytes, list[str]]] = {}
        for item, text in items:
            words = folded_words(text)
            size = min(window, len(words))
            for word in words:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
            for start in range(len(words) - size + 1 if words else 0):
                key = b" ".join(words[start : start + size])
                self.items.setdefault(size, {}).setdefault(key, []).append(item)
        rng = random.Random(1)
        self.codes = np.array([0, *(rng.getrandbits(64) | 1 for _ in self.vocabulary)], "u8")
        self.hashes = {
            size: np.unique(np.array([self._hash(key.split()) for key in keys], "u8"))
            for size, keys in self.items.items()
        }

    def _hash(self, words: list[bytes]) -> int:
        import numpy as np

        numbers = np.array([[self.vocabulary[w] for w in words]])
        return int(self.rolled(numbers[0], np.array([0]), len(words))[0])

    def rolled(self, numbers, starts, size: int):
        """64-bit hashes of the windows at `starts`."""
        import numpy as np

        value = np.zeros(len(starts), "u8")
        for k in range(size):
            value = value * np.uint64(0x9E3779B97F4A7C15) + self.codes[numbers[starts + k]]
            value ^= value >> np.uint64(29)
        return value

    def find(self, words: list[bytes]):
        """Which words are hit, and the items found."""
        import numpy as np

        hit, found = np.zeros(len(words), bool), set()
        for size, keys in self.items.items():
            numbers, starts = known_runs(words, self.vocabulary, size)
            if not len(starts):
                continue
            hashes = self.hashes[size]
            values = self.rolled(numbers, starts, size)
            at = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
            for start in starts[hashes[at] == values].tolist():
                items = keys.get(b" ".join(words[start : start + size]))
                if items:
                    hit[start : start + size] = True
                    found.update(items)
        return hit, found


def _passages(items: DataFrame) -> DataFrame:
    return items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text")
    ).where(F.length("text") > 0).dropDuplicates()


def _shard_count(rows: DataFrame) -> int:
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return -(-2 * total // SHARD_BYTES) if total > SHARD_BYTES else 1


def _shards(items: DataFrame, window: int) -> Iterator:
    """Broadcast window sets, each of about `SHARD_BYTES` of item text at most."""
    rows = _passages(items)
    shards = _shard_count(rows)
    for shard in range(shards):
        some = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard)
        listed = sorted((r.item, r.text.encode()) for r in some.collect())
        yield send(items.sparkSession, WindowSet(listed, window))


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """`row` (the whole document), n_words, hits (hit words' places), items (ids found).

    The number of passes follows the size of the items alone.
    """
    found = docs.select(F.struct(*_all(docs)).alias("row"), F.col("text").alias("text")).withColumns({
        "n_words": F.lit(None).cast("long"),
        "hits": F.array().cast("array<int>"),
        "items": F.array().cast("array<string>"),
    })
    schema = found.schema
    for place, windows in enumerate(_shards(items, window)):
        found = store(found) if place else found
        found = found.mapInArrow(lambda batches, w=windows: _find(batches, received(w)), schema)
    return found.drop("text")


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _find(batches: Iterator, windows: WindowSet) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        counts, hits, items = [], [], []
        before = zip(
            binary(batch.column("text")), batch.column("hits").to_pylist(),
            batch.column("items").to_pylist(), strict=True,
        )
        for text, old_hits, old_items in before:
            words = folded_words(text)
            hit, found = windows.find(words)
            hit[old_hits] = True
            counts.append(len(words))
            hits.append(np.flatnonzero(hit).tolist())
            items.append(sorted(found.union(old_items)))
        yield pa.RecordBatch.from_pydict(
            {
                "row": batch.column("row"),
                "text": batch.column("text"),
                "n_words": pa.array(counts, pa.int64()),
                "hits": pa.array(hits, pa.list_(pa.int32())),
                "items": pa.array(items, pa.list_(pa.string())),
            },
        )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, hit words, items found and their digest."""
    found = find_items(docs, items, window)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def remove_items(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without the passages; one that holds nothing else is removed.

    A cut leaves a line break. `n_chars` follows the text where there is one.
    Removing a passage may bring the words around it together; texts cut once
    are scanned again until none of them holds a window. A text is judged by the
    windows of all shards before it is cut, so the number of shards changes nothing.
    """
    texts = docs.select(
        F.struct(*_all(docs)).alias("row"), F.col("text").alias("text"), F.lit(False).alias("cut")
    )
    if _shard_count(_passages(items)) == 1:
        (windows,) = _shards(items, window)
        found = texts.mapInArrow(lambda batches: _cut(batches, received(windows)), texts.schema)
    else:
        found = _cut_in_rounds(texts, items, window)
    kept = found.where(~F.col("cut") | F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"))
    columns = []
    for name in docs.columns:
        value = F.col(f"row.`{name}`")
        if name == "text":
            value = F.col("text")
        elif name == "n_chars":
            value = F.when(F.col("cut"), F.length("text")).otherwise(value).cast(docs.schema[name].dataType)
        columns.append(value.alias(name))
    return kept.select(columns)


def _cut_in_rounds(texts: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(row, text, cut): every round marks the windows of all shards, then cuts; texts just cut go on."""
    done = None
    while True:
        marked = store(find_items(texts, items, window).select("row.*", "hits"))
        clean = marked.where(F.size("hits") == 0).drop("hits")
        done = clean if done is None else done.unionByName(clean)
        hit = marked.where(F.size("hits") > 0)
        if hit.isEmpty():
            return done
        texts = store(hit.mapInArrow(_cut_marked, clean.schema))


def without_words(text: bytes, hit) -> bytes:
    """The text with a line break for each stretch of words that are hit."""
    import re

    spans = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(FOLD))]
    parts, at = [], 0
    for place, (start, end) in enumerate(spans):
        if hit[place]:
            if not place or not hit[place - 1]:
                parts.append(text[at:start])
            at = end
    return b"\n".join([*parts, text[at:]])


def without_hits(text: bytes, windows: WindowSet) -> bytes:
    """The text without any occurrence of a window."""
    while True:
        hit, _ = windows.find(folded_words(text))
        if not hit.any():
            return text
        text = without_words(text, hit)


def _cut_marked(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        texts = []
        for text, places in zip(binary(batch.column("text")), batch.column("hits").to_pylist(), strict=True):
            hit = np.zeros(len(folded_words(text)), bool)
            hit[places] = True
            texts.append(without_words(text, hit).decode())
        yield pa.RecordBatch.from_pydict({
            "row": batch.column("row"), "text": pa.array(texts, pa.string()),
            "cut": pa.array([True] * len(texts), pa.bool_()),
        })


def _cut(batches: Iterator, windows: WindowSet) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts, cut = batch.column("text").to_pylist(), batch.column("cut").to_pylist()
        for place, text in enumerate(texts):
            if text:
                clean = without_hits(text.encode(), windows).decode()
                texts[place], cut[place] = clean, cut[place] or clean != text
        yield pa.RecordBatch.from_pydict(
            {"row": batch.column("row"), "text": pa.array(texts, pa.string()), "cut": pa.array(cut, pa.bool_())}
        )
