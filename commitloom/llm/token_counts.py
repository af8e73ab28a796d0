"""Operator 11: token counts of whole texts, most words counted without being encoded.

A SentencePiece BPE model is examined once, on the driver: `prove` establishes
where two neighbouring characters can never be merged (in front of a run of spaces,
between letters and signs that no piece holds together, around every character that
no longer piece holds), so that a text falls into pre-tokens that are encoded apart, and it encodes every vocabulary string
alone to learn which are one token. Tasks split texts into pre-tokens, count those
of the proven set as one each, and give only the others to the library, each once
for as long as it is remembered. What is remembered never changes a count.

There is no shuffle. What is broadcast is bounded by the vocabulary.

Defined cases: a null or empty text has no bytes and no token; a null id and rows
repeated under an id are counted like any other row; an empty table gives an empty
one; other columns are ignored, whatever their names. A very long text is split
into stretches of bounded size at such boundaries. A model for which the proof
does not hold is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.llm.common import received, send, text_or_empty, worker_state

#: pre-tokens one worker remembers in its younger and its older half
REMEMBERED = 300_000
#: characters of a long text that are split into pre-tokens at once
STRETCH = 1 << 20
#: SentencePiece's sign for a space
SPACE = "▁"
#: a character of no longer piece, to put before a pre-token that follows no space
APART = "\n"


@dataclass(frozen=True)
class Proof:
    """What holds for every text: how it may be split, and which pre-tokens are one token."""

    model: str
    #: regular expression of the pre-tokens of a text with a space in front
    pretokens: str
    #: pre-tokens that the model encodes, alone and so anywhere, as one token
    whole: frozenset[str]


def processor(model: str):
    """This worker's SentencePiece processor for a model file."""
    import sentencepiece

    made = worker_state("sentencepieces", dict)
    if model not in made:
        made[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return made[model]


def prove(model: str) -> Proof:
    """Examine a model file; an error where texts cannot be split as `Proof` states."""
    import re

    from sentencepiece import sentencepiece_model_pb2 as format

    spec, sp = format.ModelProto(), processor(model)
    with open(model, "rb") as file:
        spec.ParseFromString(file.read())
    kind, normal, train = format.ModelProto.SentencePiece, spec.normalizer_spec, spec.trainer_spec
    strings = [p.piece for p in spec.pieces if p.type == kind.NORMAL]
    kinds = _kinds([s.lstrip(SPACE) for s in strings if len(s) > 1])
    letters = {c for some in kinds for c in some}
    holds = {
        "a BPE model with byte fallback": train.model_type == format.TrainerSpec.BPE and train.byte_fallback,
        "text is taken as it is": not (normal.precompiled_charsmap or normal.remove_extra_whitespaces),
        "a space is put in front": normal.add_dummy_prefix and not train.treat_whitespace_as_suffix,
        "only plain, byte and control pieces": all(
            p.type in (kind.NORMAL, kind.BYTE, kind.CONTROL, kind.UNKNOWN) for p in spec.pieces
        ),
        "no piece goes on with a space": not any(re.search(f"[^{SPACE}]{SPACE}", s) for s in strings),
        "a line end is in no longer piece": APART not in letters,
    }
    if failed := [what for what, held in holds.items() if not held]:
        raise ValueError(f"{model}: not proven: {'; '.join(failed)}")
    runs = ["".join(map(re.escape, sorted(some))) for some in kinds]
    pattern = "|".join(f" *[{run}]+" for run in runs) + f"| +|[^ {''.join(runs)}]"
    # strings[k] alone, as it stands after a space or after a character that is in no longer piece
    asked = [s.replace(SPACE, " ") for s in strings]
    counts = encoded_counts(sp, asked)
    return Proof(model, pattern, frozenset(s for s, n in zip(asked, counts, strict=True) if n == 1))


def _kinds(strings: list[str]) -> list[list[str]]:
    """Characters of pieces by kind: no piece holds characters of two kinds, so none goes over their border.

    Kinds of a few characters are put together, which only makes pre-tokens longer.
    """
    kind = {c: c for string in strings for c in string}

    def root(c: str) -> str:
        while kind[c] != c:
            c = kind[c]
        return c

    for string in strings:
        for c in string[1:]:
            kind[root(c)] = root(string[0])
    found: dict[str, list[str]] = {}
    for c in kind:
        found.setdefault(root(c), []).append(c)
    large = sorted((some for some in found.values() if len(some) >= 10), key=len, reverse=True)
    small = [c for some in found.values() if len(some) < 10 for c in some]
    return [*large, *([small] if small else [])]


def encoded_counts(sp, pretokens: list[str]) -> list[int]:
    """Tokens of each pre-token, from the library; a leading space is the one the model puts in front itself."""
    texts = [p[1:] if p[0] == " " else APART + p for p in pretokens]
    before = len(sp.encode(APART))
    found = sp.encode(texts, num_threads=1)
    return [
        # a pre-token of one space is the text that is empty after the model's own space
        (len(ids) if p[0] == " " else len(ids) - before) or 1
        for p, ids in zip(pretokens, found, strict=True)
    ]


class TokenCounter:
    """Counts of one worker: the proven pre-tokens, and those encoded lately in two halves."""

    def __init__(self, proof: Proof, remembered: int = REMEMBERED):
        import re

        self.find, self.model = re.compile(proof.pretokens).findall, proof.model
        self.cut = re.compile("(?<=[^ ]) ").search
        self.whole = dict.fromkeys(proof.whole, 1)
        self.young, self.old, self.remembered = dict(self.whole), {}, remembered + len(self.whole)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; what is split but not yet counted stays bounded."""
        totals, held, size = [0] * len(texts), [], 0
        for n, text in enumerate(texts):
            for part in self._parts(text):
                held.append((n, self.find(part)))
                size += len(part)
                if size >= STRETCH:
                    self._settle(held, totals)
                    held, size = [], 0
        self._settle(held, totals)
        return totals

    def _parts(self, text: str) -> Iterator[str]:
        """A text with the model's space in front, in stretches that end before a space."""
        text = " " + text.replace(SPACE, " ") if text else ""
        start = 0
        while start < len(text):
            place = self.cut(text, start + STRETCH) if start + STRETCH < len(text) else None
            end = place.start() if place else len(text)
            yield text[start:end]
            start = end

    def _settle(self, held: list[tuple[int, list[str]]], totals: list[int]) -> None:
        """Encode the words of some texts that are not known, and count all."""
        new = set().union(*(words for _, words in held)).difference(self.young)
        if len(self.young) + len(new) > self.remembered:
            self.old, self.young = self.young, dict(self.whole)
            new = set().union(*(words for _, words in held)).difference(self.young)
        self.young.update({word: self.old[word] for word in new if word in self.old})
        rest = [word for word in new if word not in self.young]
        self.young.update(zip(rest, encoded_counts(processor(self.model), rest), strict=True))
        for n, words in held:
            totals[n] += sum(map(self.young.__getitem__, words))


def count_tokens(docs: DataFrame, model: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether a text has more than `limit` tokens."""
    sent = send(docs.sparkSession, prove(model))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    counted = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(
        lambda batches: _counted(batches, received(sent)), "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def counter(proof: Proof) -> TokenCounter:
    """This worker's counter."""
    made = worker_state("token_counters", dict)
    if proof.model not in made:
        made[proof.model] = TokenCounter(proof)
    return made[proof.model]


def _counted(batches: Iterator, proof: Proof) -> Iterator:
    import pyarrow as pa

    own = counter(proof)
    for batch in batches:
        counts = own.counts(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
            ["doc_id", "n_bytes", "n_tokens"],
        )
