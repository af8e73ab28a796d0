"""Per-file measures: language, layer, lines of code, drawn size."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from commitloom.functions import fixed_values as fv
from commitloom.functions.globs import matches_any
from commitloom.functions.paths import basename

# White space inside a line, as the bytes of its UTF-8 form.
_BLANK = (
    r"(?:[ \t\x0B\f]|\xC2[\x85\xA0]|\xE1\x9A\x80"
    r"|\xE2\x80[\x80-\x8A\xA8\xA9\xAF]|\xE2\x81\x9F|\xE3\x80\x80|\xEF\xBB\xBF)"
)
# A line start, its leading white space, and one byte that is neither.
_CONTENT_LINE = r"(?:\A|[\r\n])" + _BLANK + r"*+[^\r\n]"


def is_binary(content: Column) -> Column:
    head = F.decode(F.substring(content, 1, fv.BINARY_PROBE_BYTES), "ISO-8859-1")
    return F.locate("\x00", head) > 0


def line_count(content: Column) -> Column:
    """Lines with at least one character that is not white space."""
    return F.regexp_count(
        F.decode(content, "ISO-8859-1"), F.lit(_CONTENT_LINE)
    ).cast("long")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])[key]


def language(path: Column) -> Column:
    """File name, else extension, else the name before its first dot."""
    name = basename(path)
    dotted = F.instr(F.call_function("substr", name, F.lit(2)), ".") > 0
    extension = F.lower(F.substring_index(name, ".", -1))
    return F.coalesce(
        _lookup(fv.LANGUAGE_BY_FILENAME, name),
        F.when(dotted, _lookup(fv.LANGUAGE_BY_EXTENSION, extension)),
        F.when(dotted, _lookup(fv.LANGUAGE_BY_FILENAME, F.substring_index(name, ".", 1))),
        F.lit(fv.UNKNOWN_LANGUAGE),
    )


def layer(path: Column, overrides: dict[str, str] | None = None) -> Column:
    """First matching rule; user rules come before the default ones."""
    rules = [(name, (glob,)) for glob, name in (overrides or {}).items()]
    rules += list(fv.LAYER_RULES)
    merged: list[tuple[str, list[str]]] = []
    for name, globs in rules:  # neighbours of one layer share one pattern
        if merged and merged[-1][0] == name:
            merged[-1][1].extend(globs)
        else:
            merged.append((name, list(globs)))
    chosen = reduce(
        lambda acc, rule: acc.when(matches_any(path, rule[1]), rule[0]),
        merged[1:],
        F.when(matches_any(path, merged[0][1]), merged[0][0]),
    )
    return chosen.otherwise(fv.DEFAULT_LAYER)


def radius(kind: Column, loc: Column) -> Column:
    base = F.when(kind == "module", fv.RADIUS_BASE["module"]).otherwise(
        fv.RADIUS_BASE["file"]
    )
    return base + F.sqrt(F.greatest(loc, F.lit(0)).cast("double")) / fv.RADIUS_DIVISOR


def churn(commits: Column, p95: Column) -> Column:
    """``min(1, commits / p95)`` at three decimals, never 0 for an active node.

    Whole-number arithmetic, rounded half up, so every engine agrees.
    """
    thousandths = F.floor((2000 * commits + p95) / (2 * p95)).cast("long")
    bounded = F.greatest(F.least(thousandths, F.lit(1000)), F.lit(1))
    return F.when((commits <= 0) | (p95 <= 0), F.lit(0.0)).otherwise(bounded / 1000.0)
