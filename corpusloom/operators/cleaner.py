"""The four-step text cleaner."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions import repair
from corpusloom.operators.base import is_text
from corpusloom.sources.session import fresh_name, materialise, ship_package

#: Steps in their fixed order: name of the counter, column function.
STEPS = (
    ("mojibake_fixed", repair.fix_mojibake),
    ("html_stripped", repair.strip_html),
    ("control_chars_removed", repair.remove_control_chars),
    ("whitespace_normalized", repair.normalize_whitespace),
)


class TextCleaner:
    """Rewrites texts; null texts stay null, other columns stay as they are."""

    def clean(self, text: Column) -> Column:
        for _, step in STEPS:
            text = step(text)
        return text

    def fix_text(self, text: str | None) -> str | None:
        """One text, without Spark: for interactive use and tests."""
        import re

        if text is None:
            return None
        text = repair.strip_markup(repair.fix_text(text))
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", text)
        return re.sub(r"\n{4,}", "\n\n\n", re.sub(P.LONG_BLANKS, "  ", text)).strip()

    def fix_dataset(self, df: DataFrame, text_field: str = "text") -> tuple[DataFrame, dict[str, Any]]:
        """The cleaned table, and how many rows each step changed.

        The steps are a chain of columns.  Cleaned rows are written once with a
        flag for each step, and the counts are one aggregate over what was
        written, never accumulators, which count twice where tasks run again.
        """
        ship_package(df.sparkSession)
        if not is_text(df, text_field):
            zero = {name: 0 for name, _ in STEPS}
            return df, {**zero, "total_fixed": 0, "total_rows": df.count()}
        names = [fresh_name(df, f"s{i}") for i in range(len(STEPS) + 1)]
        chain = df.withColumn(names[0], F.col(f"`{text_field}`"))
        for (_, step), before, after in zip(STEPS, names, names[1:]):
            chain = chain.withColumn(after, step(F.col(before)))
        changed = {n: F.col(a) != F.col(b) for (n, _), a, b in zip(STEPS, names, names[1:])}
        changed["total_fixed"] = F.col(names[0]) != F.col(names[-1])
        steps = fresh_name(df, "steps")
        kept = [F.col(names[-1]).alias(c) if c == text_field else F.col(f"`{c}`") for c in df.columns]
        flags = F.struct(*[flag.alias(n) for n, flag in changed.items()]).alias(steps)
        written = materialise(chain.select(*kept, flags), "cleaned")
        counts = [F.count_if(F.col(f"{steps}.{n}")).alias(n) for n in changed]
        stats = written.agg(*counts, F.count("*").alias("total_rows")).first().asDict()
        return written.drop(steps), stats
