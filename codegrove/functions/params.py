"""Parameters of reports: normalised and checked before a query is built."""

from __future__ import annotations

# Kinds of nodes, their other names, bounds of limits.
NODE_KINDS = ["callable", "classifier", "module"]
KIND_NAMES = {"function": "callable", "method": "callable", "class": "classifier"}
EVERY_KIND = ["any", "all"]
DIRECTIONS = ["in", "out", "both"]
MODULE_EDGES = ["IMPORTS_DECLARED"]
EVERY_EDGE = ["any", "*"]
LOOKUP_LIMIT, EDGE_LIMIT, TOP_LIMIT, TOP = 200, 10_000, 50, 5


def kinds(kind: str | None) -> list[str]:
    """The node kinds a name stands for; all without one."""
    name = (kind or "").strip().lower()
    if kind is None or not kind or name in EVERY_KIND:
        return NODE_KINDS
    name = KIND_NAMES.get(name, name)
    if name not in NODE_KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    return [name]


def direction(value: str | None) -> str:
    name = (value or "both").strip().lower()
    if name not in DIRECTIONS:
        raise ValueError("direction must be in, out or both")
    return name


def edge_type(value: str | None, allowed: list[str] = MODULE_EDGES) -> str | None:
    """The edge type asked for, imports by default; None stands for all."""
    name = (value or "").strip() or allowed[0]
    if name.lower() in EVERY_EDGE:
        return None
    if name not in allowed:
        raise ValueError(f"edge_type must be one of {', '.join(allowed)}, any or *")
    return name


def bounded(value: int | str | None, most: int, default: int | None = None) -> int | None:
    """A positive whole number, no more than `most`."""
    if value is None:
        return default
    try:
        n = int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{value!r} is no whole number") from None
    if n <= 0:
        raise ValueError("a limit must be positive")
    return min(n, most)


def known(given: dict, allowed: list[str]) -> dict:
    """The parameters given; any other than the allowed ones is an error."""
    other = sorted(set(given) - set(allowed))
    if other:
        raise ValueError(f"unknown parameters: {', '.join(other)}")
    return given
