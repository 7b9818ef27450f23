"""Removal of flagged rows, the first of each group of duplicates kept."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import CheckerConfig
from corpusloom.operators.components import connected_components
from corpusloom.sources.session import materialise

#: Checks whose rows are removed, and the measures that flag them.  Rows with
#: boilerplate phrases go too, though their severity is only INFO.
REMOVING = {
    "exact_duplicate": ("later",),
    "near_duplicate": ("alike",),
    "text_length": ("short", "long"),
    "pii": ("found",),
    "boilerplate": ("phrase", "urls", "emails"),
}


class RowFilter:
    """Turns the annotations of all checks into rows to remove."""

    def __init__(self, config: CheckerConfig | None = None) -> None:
        self.config = config or CheckerConfig()

    def _reason(self, annotated: DataFrame, check: str) -> Column:
        there = [f"{check}.{m}" for m in REMOVING[check] if f"{check}.{m}" in annotated.columns]
        flag = F.lit(False)
        for name in there:
            flag = flag | F.col(f"`{name}`")
        return flag

    def removals(self, annotated: DataFrame, links: DataFrame | None = None) -> DataFrame:
        """(row_id, one boolean for each removing check).

        ``links`` (first, row_id) are needed where near-duplicates keep one row
        for each cluster; otherwise one near-duplicate row in all is kept, the
        least, as by the default setting.  ``annotated`` is read more than once,
        so it should be a written table.
        """
        skip = set(self.config.skip_checkers)
        flags = {c: F.lit(False) if c in skip else self._reason(annotated, c) for c in REMOVING}
        out = annotated.select("row_id", *[f.alias(c) for c, f in flags.items()])
        if "near_duplicate" in skip or "near_duplicate.alike" not in annotated.columns:
            return out
        if self.config.near_dup_keep == "per_cluster" and links is not None:
            links = materialise(links.select(F.col("first").alias("v1"), F.col("row_id").alias("v2")), "links")
            labels = connected_components(links)
            kept = labels.where("v = label").select(F.col("v").alias("row_id"), F.lit(True).alias("kept"))
            out = out.join(kept, "row_id", "left")
        else:
            least = annotated.where("`near_duplicate.alike`").agg(F.min("row_id").alias("least"))  # one row
            out = out.join(F.broadcast(least)).withColumn("kept", F.col("row_id") == F.col("least")).drop("least")
        alike = F.col("near_duplicate") & ~F.coalesce("kept", F.lit(False))
        return out.withColumn("near_duplicate", alike).drop("kept")

    def removed(self, annotated: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, dict[str, Any]]:
        """(row_id) of the rows that go, as a written table, and the counts.

        A row that several checks remove counts once in the total and once for
        each check.
        """
        reasons = self.removals(annotated, links)
        gone = F.lit(False)
        for c in REMOVING:
            gone = gone | F.col(c)
        out = materialise(reasons.where(gone), "removed")
        counts = [F.count_if(F.col(c)).alias(c) for c in REMOVING]
        stats = out.agg(*counts, F.count("*").alias("total_rows_removed")).first().asDict()
        stats["rows_after_filter"] = annotated.count() - stats["total_rows_removed"]
        return out.select("row_id"), stats

    def filter_dataset(
        self, df: DataFrame, annotated: DataFrame, links: DataFrame | None = None
    ) -> tuple[DataFrame, dict[str, Any]]:
        """The rows of ``df`` (with row_id) that stay, and the counts."""
        out, stats = self.removed(annotated, links)
        return df.join(out, "row_id", "left_anti"), stats
