"""Token groups of a byte range, and how the groups of neighbouring ranges are put together.

Two tokenizers cut the same bytes into tokens. Where a token of each ends, a group
ends. Of a range of those bytes only the middle is known for sure: a fragment has an
open prefix (tokens up to and including the first common end), closed groups, and
an open suffix (tokens after the last common end). A range without a common end is
all prefix. `compose` joins the suffix of one fragment to the prefix of the next,
which may close a group, the seam. It is associative, so the fragments of a long
document are folded in any bracketing; closed groups need not travel along.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: a group of more links is counted by its different tokens instead of pair by pair
MANY = 1 << 16


@dataclass(frozen=True)
class Open:
    """The open ends of a fragment; `first` names the range that holds its first common end."""

    closed: bool
    first: int
    head: tuple[list[int], list[int]]
    tail: tuple[list[int], list[int]] = field(default=([], []))


#: the start of a document, which is a common end itself
START = Open(True, -1, ([], []))


def _joined(left: tuple, right: tuple) -> tuple:
    return left[0] + right[0], left[1] + right[1]


def compose(left: Open, right: Open) -> tuple[Open, tuple | None]:
    """The fragment of two neighbours, and the group that closes between them: (first, ids, ids)."""
    if not left.closed:
        return replace(right, head=_joined(left.head, right.head)), None
    if not right.closed:
        return replace(left, tail=_joined(left.tail, right.head)), None
    seam = _joined(left.tail, right.head)
    return replace(left, tail=right.tail), (right.first, *seam) if seam[0] else None


def fold(parts: list[Open]) -> tuple[Open, list[tuple]]:
    """Consecutive fragments as one, and the groups that close between them."""
    whole, seams = parts[0], []
    for part in parts[1:]:
        whole, seam = compose(whole, part)
        if seam:
            seams.append(seam)
    return whole, seams


def group_ends(ends_a, ends_b):
    """For each token its group, and the number of groups; ends ascend, and the last end of both is common."""
    import numpy as np

    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return np.searchsorted(common, ends_a), np.searchsorted(common, ends_b), len(common)


def pair(a, b):
    """One long of two ids."""
    return a.astype("i8") << 32 | b


def links(a, b, groups_a, groups_b, n: int):
    """(pairs, times): every pair of ids that share one of n groups, and how often; pairs may repeat."""
    import numpy as np

    counts_a, counts_b = np.bincount(groups_a, minlength=n), np.bincount(groups_b, minlength=n)
    many = np.flatnonzero(counts_a * counts_b > MANY)
    some_a = ~np.isin(groups_a, many) if len(many) else slice(None)
    each = counts_b[groups_a[some_a]]
    starts_b = np.cumsum(counts_b) - counts_b
    before = np.cumsum(each) - each
    places = np.arange(each.sum()) + np.repeat(starts_b[groups_a[some_a]] - before, each)
    pairs, times = [pair(np.repeat(a[some_a], each), b[places])], [np.ones(len(places), "i8")]
    for group in many.tolist():
        ids_a, n_a = np.unique(a[groups_a == group], return_counts=True)
        ids_b, n_b = np.unique(b[groups_b == group], return_counts=True)
        pairs.append(pair(np.repeat(ids_a, len(ids_b)), np.tile(ids_b, len(ids_a))))
        times.append(np.repeat(n_a, len(n_b)) * np.tile(n_b, len(n_a)))
    return np.concatenate(pairs), np.concatenate(times)


def counted(pairs, times):
    """Every different pair once, with the sum of its times."""
    import numpy as np

    different, at = np.unique(pairs, return_inverse=True)
    return different, np.bincount(at, weights=times, minlength=len(different)).astype("i8")


def written(a, b, groups_a, groups_b, n: int):
    """The groups in order as `a1,a2|b1`, each with a `;` after it, and where each of those ends in the text."""
    import numpy as np

    # a group's tokens of A, then its tokens of B
    at_a = np.arange(len(a)) + np.searchsorted(groups_b, groups_a, "left")
    at_b = np.arange(len(b)) + np.searchsorted(groups_a, groups_b, "right")
    ids, signs = np.zeros(len(a) + len(b), "u4"), np.full(len(a) + len(b), ord(","), "u1")
    ids[at_a], ids[at_b] = a, b
    lasts = at_b[np.searchsorted(groups_b, np.arange(n), "right") - 1]
    signs[at_a[np.searchsorted(groups_a, np.arange(n), "right") - 1]], signs[lasts] = ord("|"), ord(";")
    width = len(str(ids.max(initial=0)))
    text = np.zeros((len(ids), width + 1), "u1")
    text[:, width] = signs
    for k in reversed(range(width)):
        text[:, k] = np.where((ids > 0) | (k == width - 1), ids % 10 + ord("0"), 0)
        ids //= 10
    kept = text > 0
    return text[kept].tobytes().decode(), np.cumsum(kept.sum(axis=1))[lasts]


def of_range(a, b, ends_a, ends_b, start: int, end: int):
    """The tokens that end in (start, end]: open ends, and the ids and ends of the closed groups between.

    `first` is left at 0, the caller knows the range's number.
    """
    import numpy as np

    in_a, in_b = (ends_a > start) & (ends_a <= end), (ends_b > start) & (ends_b <= end)
    a, b, ends_a, ends_b = a[in_a], b[in_b], ends_a[in_a], ends_b[in_b]
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    if not len(common):
        none = a[:0]
        return Open(False, 0, (a.tolist(), b.tolist())), (none, none, ends_a[:0], ends_b[:0])
    head_a, head_b = ends_a <= common[0], ends_b <= common[0]
    tail_a, tail_b = ends_a > common[-1], ends_b > common[-1]
    edges = Open(
        True, 0, (a[head_a].tolist(), b[head_b].tolist()), (a[tail_a].tolist(), b[tail_b].tolist())
    )
    mid_a, mid_b = ~(head_a | tail_a), ~(head_b | tail_b)
    return edges, (a[mid_a], b[mid_b], ends_a[mid_a], ends_b[mid_b])
