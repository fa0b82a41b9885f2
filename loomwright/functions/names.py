"""Names for helper columns."""

from __future__ import annotations


def free(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front until no column has one of them, in whatever case."""
    taken, mark = {c.lower() for c in columns}, ""
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]
