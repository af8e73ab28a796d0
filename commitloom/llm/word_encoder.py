"""Token ids of a text, word by word, from a tokenizer file."""

from __future__ import annotations

import re
import struct

from commitloom.llm.common import worker_state

#: words whose ids one worker remembers in its younger and its older half
REMEMBERED = 500_000
PUNCTUATION = b".,;:!?$%&*#|"
#: the end of the Latin letters; combining marks come after it
LETTERS_END = 0x250


class WordEncoder(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes; itself the words seen lately.

    For a tokenizer that lower-cases, and for which ASCII white space ends a word
    and leaves no token, a text's ids are its lower-cased words' ids in a row.
    Where such a tokenizer also splits letters from punctuation, a word of
    letters and marks is looked up in two parts. A word of plain letters, which
    the tokenizer neither changes nor cuts before its model sees them, goes to the
    model at once. Words seen lately are remembered in two halves: when the younger
    is full it becomes the older one. What is remembered never changes a result.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content.lower().encode() for t in special]
        self.remembered, self.old = remembered, {}
        self.lowers = self._encode(b"A B") == self._encode(b"a b")
        self.splits = self._encode(b"a.") == self._encode(b"a") + self._encode(b".")
        self.model, self.plain = self.tokenizer.model, self._plain_letters()
        self.is_plain = re.compile(f"[{''.join(map(chr, self.plain))}]+" if self.plain else r"(?!)").fullmatch

    def _plain_letters(self) -> dict[int, str]:
        """Letters that the tokenizer leaves as they are, and what its model reads for each.

        None of these letters combine with one another, so what holds for each holds
        for a word of them if the tokenizer does not cut one that has them all.
        """
        normal, pieces = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if pieces is None:
            return {}
        plain = {}
        for code in range(LETTERS_END):
            letter = chr(code)
            if letter.isalpha() and (normal is None or normal.normalize_str(letter) == letter):
                cut = pieces.pre_tokenize_str(letter)
                if len(cut) == 1:
                    plain[code] = cut[0][0]
        every = "".join(map(chr, plain)) * 2
        whole = [piece for piece, _ in pieces.pre_tokenize_str(every)] == [every.translate(plain)]
        added = (t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        return plain if whole and not any(plain.keys() >= set(map(ord, a)) for a in added) else {}

    def words(self, text: bytes) -> tuple[list[bytes], list[bytes]]:
        """The words of a UTF-8 text, and the ids of each."""
        folded = text.lower() if self.lowers else text
        if folded is not text and any(s in folded for s in self.special):
            folded = text  # the tokenizer tells these strings' case apart
        words = folded.split()
        return words, list(map(self.__getitem__, words))

    def _encode(self, word: bytes) -> bytes:
        return _packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)

    def _encode_word(self, word: str) -> bytes:
        if self.is_plain(word):
            return _packed([token.id for token in self.model.tokenize(word.translate(self.plain))])
        return self._encode(word.encode())

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            letters = word.rstrip(PUNCTUATION) if self.splits else word
            if letters != word and (self.is_plain(text := letters.decode()) or _only_letters(text)):
                ids = self[letters] + self[word[len(letters) :]]
            else:
                ids = self._encode_word(word.decode())
        if len(self) >= self.remembered:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _only_letters(word: str) -> bool:
    """Latin letters that stay letters when composed and lower-cased."""
    import unicodedata

    return max(word, default="") < chr(LETTERS_END) and unicodedata.normalize("NFC", word).lower().isalpha()


def word_encoder(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer file."""
    made = worker_state("encoders", dict)
    if path not in made:
        made[path] = WordEncoder(path)
    return made[path]
