"""Checks by name, in the order in which they were registered."""

from __future__ import annotations

from corpusloom.operators.base import BaseChecker

_CHECKERS: dict[str, type[BaseChecker]] = {}


def register(cls: type[BaseChecker]) -> type[BaseChecker]:
    """Class decorator: make a check known by its name."""
    _CHECKERS[cls.name] = cls
    return cls


def get_checker(name: str) -> type[BaseChecker]:
    try:
        return _CHECKERS[name]
    except KeyError:
        raise KeyError(f"No checker {name!r}; there are: {', '.join(_CHECKERS)}") from None


def get_all_checkers() -> dict[str, type[BaseChecker]]:
    return dict(_CHECKERS)
