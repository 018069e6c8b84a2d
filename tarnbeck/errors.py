"""Errors that name the operation and column, with suggestions for misspelt names."""

from __future__ import annotations

import difflib
from collections.abc import Iterable


class EngineError(Exception):
    """An operation that cannot be carried out as asked."""

    def __init__(self, operation: str, message: str, column: str | None = None, hint: str | None = None):
        self.operation, self.column, self.hint = operation, column, hint
        self.message = message
        super().__init__(f"{operation}: {message}" + (f" (column {column!r})" if column else "") + (f"; {hint}" if hint else ""))

    def describe(self, level: str = "normal") -> str:
        """brief: the message; normal: with operation, column and hint; full: on lines of their own, with the causes."""
        if level == "brief":
            return self.message
        if level == "normal":
            return str(self)
        if level != "full":
            raise ValueError("brief, normal or full")
        lines = [f"operation: {self.operation}", f"message: {self.message}", *([f"column: {self.column}"] if self.column else []), *([f"hint: {self.hint}"] if self.hint else [])]
        cause = self.__cause__
        while cause is not None:
            lines.append(f"cause: {type(cause).__name__}: {cause}")
            cause = cause.__cause__
        return "\n".join(lines)


def suggest(name: str, known: Iterable[str], most: int = 3) -> list[str]:
    known = list(known)
    by_lower = {k.lower(): k for k in known}
    return [by_lower[x] for x in difflib.get_close_matches(name.lower(), list(by_lower), n=most, cutoff=0.6)]


def require_columns(operation: str, names: Iterable[str], known: Iterable[str]) -> None:
    known = list(known)
    for name in names:
        if name not in known:
            near = suggest(name, known)
            raise EngineError(operation, "no such column", name, f"did you mean {', '.join(near)}?" if near else f"columns are {', '.join(known)}")


def require_equal_length(operation: str, left: list, right: list) -> None:
    if len(left) != len(right):
        raise EngineError(operation, f"{len(left)} on one side and {len(right)} on the other")


def require_not_empty(operation: str, what: str, items: list | tuple) -> None:
    if not items:
        raise EngineError(operation, f"needs at least one of: {what}")
