"""Checks, cleaner and row filter."""

from corpusloom.operators import checks  # noqa: F401  registers the built-in checks
from corpusloom.operators.base import BaseChecker, Finding
from corpusloom.operators.registry import get_all_checkers, get_checker, register

__all__ = ["BaseChecker", "Finding", "get_all_checkers", "get_checker", "register"]
