"""Words of a text as the operators take them, on UTF-8 bytes."""

from __future__ import annotations

#: ASCII letters in lower case, digits and all other alphabets' bytes; the rest separates words
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def folded_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return text.translate(FOLD).split()


def known_runs(words: list[bytes], vocabulary: dict[bytes, int], length: int):
    """Vocabulary numbers of the words (0: none), and the starts of `length` known words in a row."""
    from itertools import repeat

    import numpy as np

    numbers = np.fromiter(map(vocabulary.get, words, repeat(0)), "i8", len(words))
    if len(words) < length:
        return numbers, np.empty(0, "i8")
    known = np.concatenate([[0], np.cumsum(numbers != 0)])
    return numbers, np.flatnonzero(known[length:] - known[:-length] == length)
