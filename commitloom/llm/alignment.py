"""Operator 13: how the tokens of two tokenizers lie over each other, text by text.

A encodes the bytes of a space and the text, B (which puts the space itself) the
text. Where a token of each ends, a group ends; a link is a pair of tokens of one
group. How many documents hold a pair of ids linked is counted over the corpus and
brought back to the documents.

Ordinary documents are cut at words: before a space or a single line end that
follows a word neither tokenizer joins anything, so a word's groups are the same in
every text and are remembered; words not known are encoded many at a time, as one text. Documents go in chunks of bounded size. A chunk's
different pairs, each with the number of its documents, are the rows that shuffle;
they are summed to the corpus counts and joined back to the chunks.

A long document is dealt out as byte ranges. A task encodes a range with the words
around its ends, keeps the tokens that end in it, and gives a fragment: open prefix,
closed groups, open suffix (`fragments.py`). Open ends are folded by a tree of
stages, each over `FAN` neighbours; closed groups stay where they were made.

Defined cases: a null or empty text, and one whose joined tokens differ from its
bytes (it holds U+2581), has no tokens; a null id and rows repeated under an id are
documents like any other; an empty table gives an empty one; other columns are
ignored, whatever their names. A stretch of a long text in which no word ends within
a range is one range.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.llm import fragments
from commitloom.llm.common import store, text_or_empty, worker_state
from commitloom.llm.token_counts import APART, processor, prove

#: characters beyond which a text is dealt out, and bytes of a range
LONG, RANGE = 1 << 16, 1 << 14
#: neighbouring fragments that one task of the tree folds
FAN = 16
#: words and characters of words one worker remembers
REMEMBERED, REMEMBERED_CHARS = 200_000, 8 << 20
#: words that are encoded as one text
TOGETHER = 256
#: a chunk has no more documents than these, and about as many pairs at most
CHUNK_DOCS, CHUNK_PAIRS = 8_000, 3_000_000

#: a character of a word for both tokenizers, whatever either takes for white space
SOLID = "[^\\s\u180e\u200b\ufeff\u2581]"
CUTS = rf"(?<={SOLID})(?= |\n{SOLID})"
#: a text in which every space and line end stands between two words has none of these
UNEVEN = "[^\\S \n]|[ \n][ \n]|[\0\u180e\u200b\ufeff\u2581]"
#: a part that stands in a text of such parts as it stands alone
PLAIN = rf"[ \n]{SOLID}(?:[^\u2581]*{SOLID})?"

COUNTS = ("n_a", "n_b", "n_groups", "n_links")
CHUNKS = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "at array<int>, times array<long>, pairs array<long>, docs array<long>"
)
OPENS = "closed boolean, first long, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>"
FRAGMENTS = (
    f"key string, place long, doc_id long, valid boolean, n_a long, n_b long, n_groups long, n_links long, {OPENS}, "
    "groups string, pairs array<long>, times array<long>"
)
FOLDED = f"key string, place long, {OPENS}, seam_a array<int>, seam_b array<int>"


class Pair:
    """The two tokenizers of a worker, with the bytes of their tokens."""

    def __init__(self, byte_level: str, pieces: str):
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_level), processor(pieces)
        self.a.encode_special_tokens = True  # special strings in a text are text
        # byte-level letters: printable bytes stand for themselves, the others follow 255 in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(c): c for c in plain}
        letters |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, n in self.a.get_vocab().items():
            self.bytes_a[n] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b = [
            bytes([int(self.b.id_to_piece(n)[3:-1], 16)]) if self.b.is_byte(n)
            else self.b.id_to_piece(n).replace("▁", " ").encode()
            for n in range(self.b.get_piece_size())
        ]
        self.sizes_a = np.fromiter(map(len, self.bytes_a), "i8", len(self.bytes_a))
        self.sizes_b = np.fromiter(map(len, self.bytes_b), "i8", len(self.bytes_b))
        self.before = len(self.b.encode(APART))

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B for parts of a text that both encode apart."""
        a = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        # B's own space comes before a character that joins nothing; both are taken off again
        b = [ids[self.before :] for ids in self.b.encode([APART + p for p in parts], num_threads=1)]
        return a, b

    def exact(self, part: str, a: list[int], b: list[int]) -> bool:
        """Whether the tokens of both are the bytes of a part."""
        want = part.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == want == b"".join(map(self.bytes_b.__getitem__, b))

    def ends(self, ids, sizes):
        import numpy as np

        return np.cumsum(sizes[ids])

    def words(self, parts: list[str], plain: int):
        """(a, b, n_a, n_b, valid): ids of A and of B of parts that both encode apart, and how many are of each part.

        The first `plain` parts are `PLAIN`. A part that is not exact has no ids: its text
        has no tokens, so what it would add is never read.
        """
        import numpy as np

        starts = range(0, plain, TOGETHER)
        ends = [min(start + TOGETHER, plain) for start in starts]
        texts = ["".join(parts[x:y]) for x, y in zip(starts, ends, strict=True)]
        sizes = np.fromiter((len(p.encode()) for p in parts[:plain]), "i8", plain)
        counts, valid, found, odd = np.zeros((2, len(parts)), "i8"), np.zeros(len(parts), bool), [], []
        for x, y, text, *ids in zip(starts, ends, texts, *self.encode(texts), strict=True):
            own = [np.array(i, "i8") for i in ids]
            if self.exact(text, *ids):
                stops = np.cumsum(sizes[x:y])
                byte = [self.ends(i, size) for i, size in zip(own, (self.sizes_a, self.sizes_b), strict=True)]
                last = [np.searchsorted(e, stops) for e in byte]
                if all((e[at] == stops).all() for e, at in zip(byte, last, strict=True)):
                    counts[:, x:y], valid[x:y] = [np.diff(at, prepend=-1) for at in last], True
                    found.append((x, own))
                    continue
            odd += range(x, y)
        odd += range(plain, len(parts))
        alone = [parts[k] for k in odd]
        for k, part, *ids in zip(odd, alone, *self.encode(alone), strict=True):
            if self.exact(part, *ids):
                counts[:, k], valid[k] = [len(i) for i in ids], True
                found.append((k, [np.array(i, "i8") for i in ids]))
        found.sort(key=lambda x: x[0])
        none = np.zeros(0, "i8")
        a, b = (np.concatenate([none, *(own[side] for _, own in found)]) for side in (0, 1))
        return a, b, *counts, valid


def pair_of(tokenizers: tuple[str, str]) -> Pair:
    """This worker's tokenizers."""
    made = worker_state("tokenizer_pairs", dict)
    if tokenizers not in made:
        made[tokenizers] = Pair(*tokenizers)
    return made[tokenizers]


class Words:
    """Words seen lately: their groups as text, their counts and their links."""

    def __init__(self, own: Pair):
        import re

        self.own, self.uneven, self.cuts = own, re.compile(UNEVEN).search, re.compile(CUTS).split
        self.plain = re.compile(PLAIN).fullmatch
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.valid = np.zeros(0, bool)
        self.counts = np.zeros((4, 0), "i8")
        self.starts, self.links, self.chars = np.zeros(1, "i8"), np.zeros(0, "i8"), 0
        self.asked = np.zeros(0, "i8")

    def forget(self) -> None:
        """Let go what was asked for once, or everything if that is too little."""
        import numpy as np

        kept = np.flatnonzero(self.asked > 1)
        keys = list(self.place)
        keys = [keys[k] for k in kept.tolist()]
        chars = sum(map(len, keys))
        if len(keys) > REMEMBERED // 2 or chars > REMEMBERED_CHARS // 2:
            self.clear()
            return
        places = self._places(kept)
        self.links, self.starts = self.links[places], np.concatenate([[0], np.cumsum(self.counts[3, kept])])
        self.place, self.groups = dict(zip(keys, range(len(keys)), strict=True)), [self.groups[k] for k in kept.tolist()]
        self.valid, self.counts, self.chars = self.valid[kept], self.counts[:, kept], chars
        self.asked = np.zeros(len(keys), "i8")

    def _places(self, words):
        """Places of the links of some words."""
        import numpy as np

        starts, ends = self.starts[words], self.starts[words + 1]
        each = ends - starts
        return np.arange(each.sum()) + np.repeat(starts - (np.cumsum(each) - each), each)

    def split(self, text: str) -> list[str]:
        """Keys of the parts of a text: a part without its space, or one that starts otherwise."""
        if not self.uneven(" " + text):
            return text.replace("\n", " \n").split(" ")
        parts = self.cuts(" " + text)
        return [
            p if p[0] == "\n" else "\0" + p if p[1:2] in ("", " ", "\n", "\0") else p[1:] for p in parts
        ]

    def learn(self, texts: list[list[str]]) -> None:
        """Have every key of some texts at hand."""
        import numpy as np

        keys = set().union(*texts)
        new = keys.difference(self.place)
        if len(self.place) + len(new) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
            new = keys.difference(self.place)
        keys -= new
        self.asked[np.fromiter(map(self.place.__getitem__, keys), "i8", len(keys))] += 1
        if not new:
            return
        parts = {k: k if k[:1] == "\n" else k[1:] if k[:1] == "\0" else " " + k for k in new}
        plain = [k for k, part in parts.items() if self.plain(part)]
        new = [*plain, *parts.keys() - set(plain)]
        a, b, n_a, n_b, valid = self.own.words([parts[k] for k in new], len(plain))
        ends_a, ends_b = self.own.ends(a, self.own.sizes_a), self.own.ends(b, self.own.sizes_b)
        groups_a, groups_b, n = fragments.group_ends(ends_a, ends_b)
        # a word ends a group, so a group is of one word
        word = np.repeat(np.arange(len(new)), n_a)
        group_word = np.zeros(n, "i8")
        group_word[groups_a] = word
        n_groups = np.bincount(group_word, minlength=len(new))
        per_group = np.bincount(groups_a, minlength=n) * np.bincount(groups_b, minlength=n)
        n_links = np.bincount(group_word, weights=per_group, minlength=len(new)).astype("i8")
        each = np.bincount(groups_b, minlength=n)[groups_a]
        starts_b = np.searchsorted(groups_b, groups_a)
        places = np.arange(each.sum()) + np.repeat(starts_b - (np.cumsum(each) - each), each)
        made, chars = fragments.written(a, b, groups_a, groups_b, n)
        stops = np.concatenate([[0], chars])[np.cumsum(n_groups)].tolist()
        at = len(self.place)
        self.place.update(zip(new, range(at, at + len(new)), strict=True))
        self.groups += [made[x : max(x, y - 1)] for x, y in zip([0, *stops], stops, strict=False)]
        self.valid = np.concatenate([self.valid, valid])
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links])], axis=1)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n_links)])
        self.links = np.concatenate([self.links, fragments.pair(np.repeat(a, each), b[places])])
        self.chars += sum(map(len, new))
        self.asked = np.concatenate([self.asked, np.ones(len(new), "i8")])

    def text(self, keys: list[str]):
        """Counts, digest, pairs and times of a text whose keys are at hand; None without tokens."""
        import hashlib

        import numpy as np

        words = list(map(self.place.__getitem__, keys))
        at = np.array(words)
        if not self.valid[at].all():
            return None
        pairs, times = np.unique(self.links[self._places(at)], return_counts=True)
        digest = hashlib.sha256(";".join(map(self.groups.__getitem__, words)).encode()).hexdigest()
        return self.counts[:, at].sum(axis=1).tolist(), digest, pairs, times


def words_of(own: Pair) -> Words:
    """This worker's words."""
    made = worker_state("aligned_words", dict)
    if id(own) not in made:
        made[id(own)] = Words(own)
    return made[id(own)]


def _chunks(batches: Iterator, tokenizers: tuple[str, str]) -> Iterator:
    """A row a document, and after a chunk's documents a row with its different pairs."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    words, chunk = words_of(pair_of(tokenizers)), TaskContext.get().partitionId() << 32
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.list_({"at": pa.int32()}.get(n, pa.int64())) if n in ("at", "times", "pairs", "docs")
             else pa.string() if n == "groups_sha256" else pa.int64() for n in names]
    held, size = [], 0

    def flush() -> Iterator:
        nonlocal chunk, held, size
        if not held:
            return
        pairs, docs = np.unique(np.concatenate([row[-2] for row in held]), return_counts=True)
        for some in range(0, len(held), 500):
            rows = [
                (chunk, doc_id, *counts, digest, np.searchsorted(pairs, own), times, None, None)
                for doc_id, counts, digest, own, times in held[some : some + 500]
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
            )
        last = (chunk, *[None] * 8, pairs, docs)
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(last, kinds, strict=True)], names)
        chunk, held, size = chunk + 1, [], 0

    nothing = np.zeros(0, "i8")
    for batch in batches:
        texts = batch.column("text").to_pylist()
        split = [words.split(t) if t else [] for t in texts]
        words.learn(split)
        for doc_id, keys in zip(batch.column("doc_id").to_pylist(), split, strict=True):
            found = words.text(keys) if keys else None
            counts, digest, pairs, times = found or ([0] * 4, "", nothing, nothing)
            held.append((doc_id, counts, digest, pairs, times))
            size += len(pairs)
            if size >= CHUNK_PAIRS or len(held) >= CHUNK_DOCS:
                yield from flush()
    yield from flush()


# ---------------------------------------------------------------- long documents


def ranges(text: str, width: int) -> list[tuple[str, int, int, int]]:
    """(context, its first byte, start, end) of the byte ranges of a space and the text.

    The context reaches from the last word's start at or before the range to the first
    word's end at or after it. Of the multiples of `width` those are ends of ranges
    around which words start and end within `width` bytes.
    """
    import re

    import numpy as np

    whole = " " + text
    code = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    size = 1 + (code >= 0x80).astype("i8") + (code >= 0x800) + (code >= 0x10000)
    byte = np.concatenate([[0], np.cumsum(size)])
    cuts = np.concatenate([
        [0], np.fromiter((m.start() for m in re.finditer(CUTS, whole)), "i8"), [len(whole)]
    ]).astype("i8")
    places = byte[cuts]
    edges = np.arange(width, byte[-1], width)
    near = np.searchsorted(places, edges, "right")
    edges = [0, *edges[places[near] - places[near - 1] <= width].tolist(), int(byte[-1])]
    found = []
    for start, end in zip(edges, edges[1:], strict=False):
        low = cuts[np.searchsorted(places, start, "right") - 1]
        high = cuts[np.searchsorted(places, end, "left")]
        found.append((whole[low:high], int(byte[low]), start, end))
    return found


def _dealt(batches: Iterator, width: int) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    row = 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            key, row = f"{TaskContext.get().partitionId()}-{row}", row + 1
            found = ranges(text, width)
            for some in range(0, len(found), 64):
                part = found[some : some + 64]
                texts, bases, starts, ends = map(list, zip(*part, strict=True))
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array([key] * len(part)),
                    "doc_id": pa.array([doc_id] * len(part), pa.int64()),
                    "place": pa.array(range(some, some + len(part)), pa.int64()),
                    "context": pa.array(texts, pa.string()),
                    "base": pa.array(bases, pa.int64()), "start": pa.array(starts, pa.int64()),
                    "stop": pa.array(ends, pa.int64()),
                })


def _row_batch(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(),
             "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)],
        [name for name, _ in fields],
    )


def _fragments(batches: Iterator, tokenizers: tuple[str, str]) -> Iterator:
    """Each range as a fragment."""
    import numpy as np

    own = pair_of(tokenizers)
    names = ("key", "doc_id", "place", "context", "base", "start", "stop")
    for batch in batches:
        rows = []
        for key, doc_id, place, context, base, start, stop in zip(
            *(batch.column(n).to_pylist() for n in names), strict=True
        ):
            (ids_a,), (ids_b,) = own.encode([context])
            a, b = np.array(ids_a, "i8"), np.array(ids_b, "i8")
            if not own.exact(context, ids_a, ids_b):
                rows.append((key, place, doc_id, False, 0, 0, 0, 0, False, place, [], [], [], [], "", [], []))
                continue
            ends_a, ends_b = base + own.ends(a, own.sizes_a), base + own.ends(b, own.sizes_b)
            edge, (a, b, ends_a, ends_b) = fragments.of_range(a, b, ends_a, ends_b, start, stop)
            groups_a, groups_b, n = fragments.group_ends(ends_a, ends_b)
            pairs, times = fragments.counted(*fragments.links(a, b, groups_a, groups_b, n))
            rows.append((
                key, place, doc_id, True, len(a) + len(edge.head[0]) + len(edge.tail[0]),
                len(b) + len(edge.head[1]) + len(edge.tail[1]), n, int(times.sum()), edge.closed, place,
                *edge.head, *edge.tail, fragments.written(a, b, groups_a, groups_b, n)[0][:-1], pairs, times,
            ))
        yield _row_batch(rows, FRAGMENTS)


def _fold(batches: Iterator) -> Iterator:
    """Each group of neighbours as one fragment, and a row for each group that closed between them."""
    for batch in batches:
        rows = []
        for key, place, parts in zip(*(batch.column(n).to_pylist() for n in ("key", "place", "parts")), strict=True):
            opens = [
                fragments.Open(p["closed"], p["first"], (p["head_a"], p["head_b"]), (p["tail_a"], p["tail_b"]))
                for p in parts
            ]
            whole, seams = fragments.fold(opens)
            rows.append((key, place, whole.closed, whole.first, *whole.head, *whole.tail, None, None))
            rows += [(key, None, None, first, None, None, None, None, a, b) for first, a, b in seams]
        yield _row_batch(rows, FOLDED)


def seams(found: DataFrame, fan: int) -> DataFrame:
    """(key, place, a, b): the groups that lie over the ends of ranges; place: the range that ends them.

    A tree of stages: each folds `fan` neighbours, until a document is one fragment,
    which its start, a common end, closes.
    """
    opens = [c.split()[0] for c in OPENS.split(", ")]
    parts, closed = found.select("key", "place", *opens), []
    width = found.agg(F.max("place")).first()[0]
    while True:
        start = width == 0  # the last stage folds the whole document to its start
        listed = parts.groupBy("key", F.floor(F.col("place") / fan).alias("place")).agg(
            F.sort_array(F.collect_list(F.struct("place", *opens))).alias("parts")
        )
        if start:
            none = F.array().cast("array<int>")
            edge = F.struct(
                F.lit(-1).cast("long").alias("place"), F.lit(True).alias("closed"), F.lit(-1).cast("long").alias("first"),
                *(none.alias(name) for name in opens[2:]),
            )
            listed = listed.withColumn("parts", F.concat(F.array(edge), "parts"))
        folded = store(listed.mapInArrow(_fold, FOLDED))
        closed.append(folded.where("place IS NULL").select(
            "key", F.col("first").alias("place"), F.col("seam_a").alias("a"), F.col("seam_b").alias("b")
        ))
        if start:
            return reduce(DataFrame.unionByName, closed)
        parts, width = folded.where("place IS NOT NULL").select("key", "place", *opens), width // fan


def _seam_rows(batches: Iterator) -> Iterator:
    """Text, links, pairs and times of the groups of `seams`."""
    import numpy as np

    for batch in batches:
        rows = []
        for key, place, a, b in zip(*(batch.column(n).to_pylist() for n in ("key", "place", "a", "b")), strict=True):
            zeros = np.zeros(len(a), "i8"), np.zeros(len(b), "i8")
            pairs, times = fragments.counted(*fragments.links(np.array(a, "i8"), np.array(b, "i8"), *zeros, 1))
            rows.append((key, place, 1, len(a) * len(b), f"{','.join(map(str, a))}|{','.join(map(str, b))}", pairs, times))
        yield _row_batch(rows, SEAMS)


SEAMS = "key string, place long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def _digests(batches: Iterator) -> Iterator:
    """The digest of each document's groups, whose rows come one after the other."""
    import hashlib

    key, digest, done = None, None, []
    for batch in batches:
        for its, groups in zip(batch.column("key").to_pylist(), batch.column("groups").to_pylist(), strict=True):
            if its != key:
                if digest:
                    done.append((key, digest.hexdigest()))
                key, digest = its, hashlib.sha256(groups.encode())
            else:
                digest.update(b";" + groups.encode())
        yield _row_batch(done, "key string, groups_sha256 string")
        done = []
    if digest:
        yield _row_batch([(key, digest.hexdigest())], "key string, groups_sha256 string")


def long_documents(docs: DataFrame, tokenizers: tuple[str, str], width: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Counts and digest of each (doc_id, text), and (key, pair, times) of its links."""
    dealt = docs.mapInArrow(
        lambda batches: _dealt(batches, width),
        "key string, doc_id long, place long, context string, base long, start long, stop long",
    )
    found = store(
        dealt.repartition("key", "place").mapInArrow(lambda batches: _fragments(batches, tokenizers), FRAGMENTS)
    )
    sound = found.groupBy("key").agg(F.min("valid").alias("valid"))
    good = found.join(sound.where("valid").select("key"), "key", "left_semi")
    if good.isEmpty():
        between = good.select("key", "place", "n_groups", "n_links", "groups", "pairs", "times").limit(0)
    else:
        between = store(seams(good, fan).mapInArrow(_seam_rows, SEAMS))
    parts = good.where("n_groups > 0").select("key", "place", F.lit(1).alias("part"), "groups").unionByName(
        between.select("key", "place", F.lit(0).alias("part"), "groups")
    )
    digests = parts.repartition("key").sortWithinPartitions("key", "place", "part").mapInArrow(
        _digests, "key string, groups_sha256 string"
    )
    sums = good.select("key", *COUNTS).unionByName(
        between.select("key", F.lit(0).cast("long").alias("n_a"), F.lit(0).cast("long").alias("n_b"), "n_groups", "n_links")
    ).groupBy("key").agg(*(F.sum(c).alias(c) for c in COUNTS))
    documents = (
        found.groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(sums, "key", "left").join(digests, "key", "left")
        .select("key", "doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS),
                F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    )
    listed = good.select("key", "pairs", "times").unionByName(between.select("key", "pairs", "times"))
    pairs = listed.select("key", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    return documents, pairs.groupBy("key", "pair").agg(F.sum("times").alias("times"))


# ---------------------------------------------------------------- the whole


def _weighed(left, right):
    """A chunk's documents with the sums over their links."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    right = right.sort_by("at")
    counts, best = (right.column(n).to_numpy() for n in ("count", "best"))
    at, times = (pc.list_flatten(left.column(n)).to_numpy() for n in ("at", "times"))
    ends = np.cumsum(pc.list_value_length(left.column("at")).to_numpy())

    def total(values):
        sums = np.concatenate([[0], np.cumsum(values)])[[0, *ends]]
        return pa.array(np.diff(sums))

    names = ["doc_id", *COUNTS, "groups_sha256"]
    return pa.table(
        [*(left.column(n) for n in names), total(times * best[at]), total(times * counts[at])],
        [*names, "n_best", "count_sum"],
    )


RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
)


def align(
    docs: DataFrame, byte_level: str, pieces: str, long: int = LONG, width: int = RANGE, fan: int = FAN
) -> DataFrame:
    """Per document its tokens, groups and links, and what the corpus knows of its pairs."""
    prove(pieces)  # words may be encoded apart
    tokenizers = (byte_level, pieces)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    is_long = F.length("text") > long
    chunked = store(rows.where(~is_long).mapInArrow(lambda batches: _chunks(batches, tokenizers), CHUNKS))
    long_docs, long_pairs = long_documents(rows.where(is_long), tokenizers, width, fan)
    long_pairs = store(long_pairs)
    asked = chunked.where("pairs IS NOT NULL").select(
        "chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "x")
    ).select("chunk", "at", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = store(
        asked.select("pair", "docs").unionByName(long_pairs.select("pair", F.lit(1).cast("long").alias("docs")))
        .groupBy("pair").agg(F.sum("docs").alias("count"))
    )
    # a row for each id of A's vocabulary
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    known = counts.withColumn("a", F.shiftright("pair", 32)).join(F.broadcast(highest), "a").select(
        "pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best")
    )
    answers = asked.select("chunk", "at", "pair").join(known, "pair").select(F.col("chunk").alias("of"), "at", "count", "best")
    short = (
        chunked.where("pairs IS NULL").select("chunk", "doc_id", *COUNTS, "groups_sha256", "at", "times")
        .groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(_weighed, RESULT)
    )
    weighed = long_pairs.join(known, "pair").groupBy("key").agg(
        F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    )
    others = long_docs.join(weighed, "key", "left").select(
        "doc_id", *COUNTS, "groups_sha256",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")),
    )
    return short.unionByName(others)
