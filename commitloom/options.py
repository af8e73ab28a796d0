"""Job options: what a run may change."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone
from math import ceil, floor

from commitloom.functions import fixed_values as fv


def instant_seconds(instant: str) -> float:
    """Unix seconds of an ISO instant; a bad instant is an error."""
    try:
        parsed = datetime.fromisoformat(instant.replace("Z", "+00:00"))
    except ValueError as cause:
        raise ValueError(f"anchor is not an ISO instant: {instant!r}") from cause
    if parsed.tzinfo is None:
        parsed = parsed.replace(tzinfo=timezone.utc)
    return parsed.timestamp()


def merge_excludes(*lists: tuple[str, ...] | list[str]) -> tuple[str, ...]:
    """Defaults, then file, then command-line globs: order kept, distinct."""
    return tuple(dict.fromkeys(glob for globs in lists for glob in globs))


@dataclass(frozen=True)
class Options:
    anchor: str
    window_days: int = 90
    excludes: tuple[str, ...] = fv.DEFAULT_EXCLUDES
    # glob -> layer, tried before the default rules, in insertion order
    layers: dict[str, str] = field(default_factory=dict)
    hot_churn: float = fv.HOT_CHURN
    blob_loc: int = fv.DATA_BLOB_LOC
    bulk_paths: int = fv.BULK_COMMIT_PATHS
    min_pair_count: int = fv.MIN_PAIR_COUNT
    max_pairs: int = fv.MAX_PAIRS_PER_KIND

    def __post_init__(self) -> None:
        instant_seconds(self.anchor)
        if self.window_days < 1:
            raise ValueError("window_days must be at least 1")
        for name in ("bulk_paths", "min_pair_count", "max_pairs"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        unknown = sorted(set(self.layers.values()) - set(fv.LAYERS))
        if unknown:
            raise ValueError(f"unknown layers: {unknown}")

    @property
    def until(self) -> int:
        """Last second of the window, inclusive."""
        return floor(instant_seconds(self.anchor))

    @property
    def since(self) -> int:
        """First second of the window, inclusive."""
        return ceil(instant_seconds(self.anchor)) - self.window_days * 86400
