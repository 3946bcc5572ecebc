"""Names for helper columns that no given column has."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it unlike all of taken (names don't differ by case)."""
    out, used = [], {t.lower() for t in taken}
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out
