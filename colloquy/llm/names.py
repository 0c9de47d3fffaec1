"""Column names of an operator's own beside whatever columns a caller's table has."""

from __future__ import annotations


def free_name(taken: list[str], wish: str) -> str:
    """``wish``, with underscores behind it until no column of ``taken`` has the name, whatever the case."""
    held = {c.lower() for c in taken}
    while wish.lower() in held:
        wish += "_"
    return wish
