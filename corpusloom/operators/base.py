"""What a check is: columns for each row, sums over rows, and a result made of the sums.

A check never loops over rows.  It names *measures* (columns of the row), and
*totals* (measures to be summed).  The runner puts the measures of all checks in
one projection, and all counts, totals and examples in one pass; from the few
numbers that come back each check makes its result.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.config import CheckerConfig
from corpusloom.outcome import Outcome, Record


@dataclass(frozen=True)
class Finding:
    """One kind of issue: which rows have it, and how it is told."""

    flag: str
    severity: str
    message: str  # with {n} for the number of rows


class BaseChecker:
    """Base of all checks, built in or the user's own."""

    name: ClassVar[str] = ""

    def __init__(self, config: CheckerConfig | None = None) -> None:
        self.config = config or CheckerConfig()

    def measures(self, text: Column) -> dict[str, Column]:
        """Row-local columns; flags are booleans that are never null.

        ``text`` is null where the row has no string; the column ``present``
        says whether it has any value.
        """
        return {}

    def shared(self, rows: DataFrame) -> DataFrame | None:
        """For a check that compares rows: a written table of the groups of two rows or more, (row_id, keys...).

        ``rows`` has row_id and text.  When rows go, their rows of this table go
        too, and the flags follow from what is left: no text is read again.
        """
        return None

    def of_shared(self, shared: DataFrame) -> tuple[list[str], DataFrame]:
        """Columns that follow from such a table: their names, and a table (row_id, ...) of the rows that have them."""
        raise NotImplementedError

    def group_measures(self, rows: DataFrame) -> tuple[list[str], DataFrame] | None:
        """Columns that need other rows: their names, and a table (row_id, ...) of the rows that have them."""
        shared = self.shared(rows)
        return None if shared is None else self.of_shared(shared)

    def totals(self) -> list[str]:
        """Measures whose sum over all rows is wanted; booleans count their true rows."""
        return []

    def sums(self) -> dict[str, Column]:
        """Further aggregates over the measures, which are columns named ``<check>.<measure>``; one more pass."""
        return {}

    def findings(self, text_field: str) -> list[Finding]:
        return []

    def details(self, finding: Finding, sums: dict[str, Any]) -> dict[str, Any]:
        return {}

    def stats(self, total_rows: int, flagged: dict[str, int], sums: dict[str, Any]) -> dict[str, Any]:
        return {}

    def skipped(self) -> bool:
        """Whether the settings switch this check off."""
        return False

    def column(self, measure: str) -> Column:
        return F.col(f"`{self.name}.{measure}`")

    def result(
        self, text_field: str, total_rows: int, flagged: dict[str, int], samples: dict[str, list[int]], sums: dict[str, Any]
    ) -> Outcome:
        records = [
            Record(
                self.name, f.severity, f.message.format(n=flagged[f.flag]), flagged[f.flag], samples.get(f.flag, []),
                self.details(f, sums),
            )
            for f in self.findings(text_field)
            if flagged[f.flag]
        ]
        return Outcome({self.name: self.stats(total_rows, flagged, sums)}, records)

    def check(self, df: DataFrame, text_field: str = "text", id_col: str | None = None) -> Outcome:
        """Run this check alone over a table."""
        from corpusloom.plans.runner import run_check

        return run_check(self, df, text_field, id_col)


def is_text(df: DataFrame, text_field: str) -> bool:
    """Whether the text column holds strings; other columns have nothing to check."""
    return text_field in df.columns and isinstance(df.schema[text_field].dataType, T.StringType)
