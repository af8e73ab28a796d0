"""Path globs as regular expressions (driver side, a few hundred at most).

``*`` stays inside a segment, ``**`` spans segments (also zero of them), dot
files match, case is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segment(glob: str) -> str:
    """Regex of one path segment."""
    if glob == "*":
        return "[^/]+"
    out, i, braces = [], 0, 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        elif ch == "{" and "}" in glob[i:]:
            braces += 1
            out.append("(?:")
        elif ch == "}" and braces:
            braces -= 1
            out.append(")")
        elif ch == "," and braces:
            out.append("|")
        elif ch == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


def glob_regex(glob: str) -> str:
    """Regex of a whole relative path, without anchors."""
    segments = glob.split("/")
    last = len(segments) - 1
    out = ""
    for i, segment in enumerate(segments):
        if segment == "**":
            if i == last:
                # "a/**" also matches "a" itself
                out = out[:-1] + "(?:/.*)?" if out.endswith("/") else out + ".*"
            else:
                out += "(?:.*/)?"
        else:
            out += _segment(segment) + ("/" if i < last else "")
    return out


def _any_regex(globs: Iterable[str], subtree: bool) -> str:
    """One pattern for many globs.

    ``**/name`` and ``**/name/**`` globs share one scan over the segment starts;
    the others are anchored. ``subtree`` lets a matched folder take everything beneath it.
    """
    boundary, end = r"(?:/|\z)", r"\z"
    names, trees, anchored = [], [], []
    for glob in globs:
        head, _, rest = glob.partition("/")
        if head == "**" and rest and "/" not in rest and rest != "**":
            names.append(_segment(rest))
        elif head == "**" and rest.endswith("/**") and "/" not in rest[:-3]:
            trees.append(_segment(rest[:-3]))
        else:
            anchored.append(glob_regex(glob))
    tail = boundary if subtree else end
    parts = []
    if names:
        parts.append(r"(?:\A|/)(?:" + "|".join(names) + ")" + tail)
    if trees:
        parts.append(r"(?:\A|/)(?:" + "|".join(trees) + ")" + boundary)
    if anchored:
        parts.append(r"\A(?:" + "|".join(anchored) + ")" + tail)
    return "(?ius)" + "|".join(parts)


def matches_any(path: Column, globs: Iterable[str], subtree: bool = False) -> Column:
    globs = tuple(globs)
    if not globs:
        return F.lit(False)
    return path.rlike(_any_regex(globs, subtree))
