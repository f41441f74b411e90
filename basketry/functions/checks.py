"""Argument checks that fail before any Spark job starts."""

from __future__ import annotations

from collections.abc import Iterable
from math import isclose


def validate_ratios(train: float, validation: float, test: float) -> None:
    """Each is a share of the whole, together they are the whole."""
    shares = {"train": train, "validation": validation, "test": test}
    outside = [f"{name}={share}" for name, share in shares.items() if not 0 <= share <= 1]
    if outside:
        raise ValueError(f"not between 0 and 1: {', '.join(outside)}")
    if not isclose(sum(shares.values()), 1.0, rel_tol=0, abs_tol=1e-9):
        raise ValueError(f"the shares of {', '.join(shares)} do not make up 1: {shares}")


def validate_ks(ks: Iterable[int | str] | str) -> list[int]:
    """Cutoffs as a sorted list without repeats. Accepts numbers, or the text form ``"10, 50,100"``."""
    parts = ks.split(",") if isinstance(ks, str) else [str(k) for k in ks]
    numbers = [int(part) for part in parts if part.strip()]
    if not numbers:
        raise ValueError("at least one cutoff k is needed")
    if min(numbers) <= 0:
        raise ValueError(f"cutoffs must be positive, got {min(numbers)}")
    return sorted(set(numbers))
