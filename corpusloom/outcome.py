"""What checks found: flat records, one for each kind of problem, and numbers by check.

All of it is of bounded size.  Totals of any sort are counts over the records;
what a report looks like is the business of ``plans.report``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any, NamedTuple

ERROR, WARNING, INFO = "error", "warning", "info"
#: Row ids that a record carries as examples.
SAMPLE_ROWS = 10


class Record(NamedTuple):
    """One kind of problem: what it is, how many rows have it, and the first few of them."""

    checker: str
    severity: str
    message: str
    rows: int = 0
    sample: Sequence[int] = ()
    details: Mapping[str, Any] = {}


class Outcome:
    """Records of some checks, and the numbers of each check by its name, in the order in which they ran."""

    def __init__(self, stats: Mapping[str, Mapping[str, Any]] | None = None, records: Iterable[Record] = ()) -> None:
        self.stats = {name: dict(numbers) for name, numbers in (stats or {}).items()}
        self.records = list(records)

    def __or__(self, other: Outcome) -> Outcome:
        return Outcome({**self.stats, **other.stats}, self.records + other.records)

    def of(self, *checkers: str) -> Outcome:
        """The part that belongs to some checks, in the order named."""
        there = [c for c in checkers if c in self.stats]
        return Outcome({c: self.stats[c] for c in there}, [r for c in there for r in self.records if r.checker == c])

    def count(self, severity: str | None = None) -> int:
        """How many records there are, or how many of one severity."""
        return sum(severity in (None, r.severity) for r in self.records)


class Checked(NamedTuple):
    """A table that was checked, and the outcome."""

    dataset_id: str
    split: str
    total_rows: int
    text_field: str
    outcome: Outcome
