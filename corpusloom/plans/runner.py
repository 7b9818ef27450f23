"""Running checks and the fix pipeline: few fused passes over the table."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import CheckerConfig
from corpusloom.outcome import ERROR, SAMPLE_ROWS, Checked, Outcome, Record
from corpusloom.operators import BaseChecker, get_all_checkers
from corpusloom.operators.base import is_text
from corpusloom.operators.checks import NearDuplicateChecker, SchemaChecker
from corpusloom.operators.cleaner import TextCleaner
from corpusloom.operators.row_filter import RowFilter
from corpusloom.sources.loader import with_row_id
from corpusloom.sources.session import materialise, ship_package

log = logging.getLogger(__name__)
#: Tasks' counts are first merged in so many parts.
MERGED_TASKS = 1024


def text_rows(df: DataFrame, text_field: str, id_col: str | None = None) -> DataFrame:
    """(row_id, text, present): what checks see of a table."""
    if id_col != "row_id" or "row_id" not in df.columns:
        df = with_row_id(df, id_col)
    if text_field not in df.columns:
        return df.select("row_id", F.lit(None).cast("string").alias("text"), F.lit(False).alias("present"))
    value = F.col(f"`{text_field}`")
    text = value if is_text(df, text_field) else F.lit(None).cast("string")
    return df.select("row_id", text.alias("text"), value.isNotNull().alias("present"))


def annotate(rows: DataFrame, checkers: list[BaseChecker], shared: dict[str, DataFrame] | None = None) -> DataFrame:
    """(row_id, <check>.<measure>...): all checks in one projection; no texts.

    Checks that compare rows are joined by row_id, from their tables of ``shared``
    groups where given; everything else is row-local.
    """
    own = [c.alias(f"{k.name}.{m}") for k in checkers for m, c in k.measures(F.col("text")).items()]
    return _with_groups(rows.select("row_id", *own), rows, checkers, shared or {})


def _with_groups(out: DataFrame, rows: DataFrame, checkers: list[BaseChecker], shared: dict[str, DataFrame]) -> DataFrame:
    for k in checkers:
        group = k.of_shared(shared[k.name]) if k.name in shared else k.group_measures(rows)
        if group is not None:
            names, table = group
            named = table.select(F.col("row_id").alias("__row"), *[F.col(n).alias(f"{k.name}.{n}") for n in names])
            joined = out.join(named, out["row_id"] == named["__row"], "left").drop("__row")
            full = {f"{k.name}.{n}": F.coalesce(F.col(f"`{k.name}.{n}`"), F.lit(False)) for n in names}
            out = joined.withColumns(full)
    return out


def annotate_stream(stream: DataFrame, text_field: str, checkers: list[BaseChecker]) -> DataFrame:
    """The row-local measures added to any table, streaming ones too; checks that compare rows are left out."""
    ship_package(stream.sparkSession)
    rows = stream.withColumns({"text": F.col(text_field), "present": F.col(text_field).isNotNull()})
    own = {f"{k.name}.{m}": c for k in checkers for m, c in k.measures(F.col("text")).items()}
    out = rows.withColumns(own)
    return out.select(*stream.columns, *[f"`{n}`" for n in own])


def _counted(batches: Iterator[pa.RecordBatch], names: list[str], flags: list[str]) -> Iterator[pa.RecordBatch]:
    """For each named column of a task, after row_id: its sum, and the first few ids where it is true if it is a flag."""
    total: dict[str, int] = {}
    first: dict[str, np.ndarray] = {}
    for batch in batches:
        ids = batch.column(0)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        for name, column in zip(names, batch.columns[1:]):
            value = column.fill_null(False if pa.types.is_boolean(column.type) else 0).to_numpy(zero_copy_only=False)
            total[name] = total.get(name, 0) + int(value.sum())
            if name in flags:
                some = np.concatenate([first.get(name, ids[:0]), ids[value & known]])
                first[name] = np.sort(some)[:SAMPLE_ROWS]
        total[""] = total.get("", 0) + batch.num_rows
    ids = [first[n].tolist() if n in first else [] for n in total]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), type=pa.string()), pa.array(list(total.values()), type=pa.int64()), pa.array(ids, type=pa.list_(pa.int64()))],
        names=["name", "total", "first"],
    )


def counted(annotated: DataFrame, flags: list[str], totals: list[str]) -> DataFrame:
    """(name, total, first) of flag and number columns, and ("", number of rows): one pass over the annotations.

    ``first`` holds the ten least row ids of a flag.  Each task gives one short row
    for a column; these are merged in two steps, so no task gathers many.
    """
    names = list(dict.fromkeys([*flags, *totals]))
    columns = [F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]
    told = annotated.select("row_id", *columns).mapInArrow(
        lambda it: _counted(it, names, flags), "name string, total long, first array<bigint>"
    )
    told = told.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGED_TASKS)))
    for by in (["name", "part"], ["name"]):
        least = F.slice(F.sort_array(F.flatten(F.collect_list("first"))), 1, SAMPLE_ROWS)
        told = told.groupBy(*by).agg(F.sum("total").alias("total"), least.alias("first"))
    return told


def summarise(annotated: DataFrame, checkers: list[BaseChecker], text_field: str) -> Outcome:
    """Outcome of checks from their annotations, which are read once."""
    flags = [f"{k.name}.{f.flag}" for k in checkers for f in k.findings(text_field)]
    totals = [f"{k.name}.{m}" for k in checkers for m in k.totals()]
    got = {r["name"]: r for r in counted(annotated, flags, totals).collect()}  # one short row for each column
    total = {n: got[n]["total"] if n in got else 0 for n in ("", *flags, *totals)}
    more = {f"{k.name}.{s}": a for k in checkers for s, a in k.sums().items()}
    sums = annotated.agg(*[a.alias(n) for n, a in more.items()]).first().asDict() if more else {}
    out = Outcome()
    for k in checkers:
        own = [f.flag for f in k.findings(text_field)]
        out |= k.result(
            text_field, total[""], {f: total[f"{k.name}.{f}"] for f in own},
            {f: list(got[f"{k.name}.{f}"]["first"]) for f in own if f"{k.name}.{f}" in got},
            {m: total[f"{k.name}.{m}"] for m in k.totals()} | {s: sums[f"{k.name}.{s}"] for s in k.sums()},
        )
    return out


def _failed(name: str, error: Exception) -> Outcome:
    log.warning("check %s failed: %s", name, error)
    return Outcome({name: {}}, [Record(name, ERROR, f"Checker raised an exception: {error}")])


class CheckRun:
    """All checks over one table: the outcome in registration order, and annotations.

    Annotations are written to the shared folder once, so neither examples nor
    the row filter evaluate the checks again, and a lost executor costs nothing.
    The groups of rows that checks compare are written too: when rows go, the
    outcome for the others follows from what was written (``without``).
    """

    def __init__(
        self, df: DataFrame, text_field: str, config: CheckerConfig, id_col: str | None = None, shown: DataFrame | None = None
    ) -> None:
        """``shown`` is the table whose columns are told, where ``df`` has others besides."""
        ship_package(df.sparkSession)
        self.df, self.text_field = df if shown is None else shown, text_field
        self.rows = text_rows(df, text_field, id_col)
        self.annotated = self.rows.select("row_id")
        self.shared: dict[str, DataFrame] = {}
        self.total_rows = df.count()
        self.order = [n for n in get_all_checkers() if n not in config.skip_checkers]
        self.schema: SchemaChecker | None = None
        #: What does not depend on rows: checks that are switched off or failed.
        self.told = Outcome()
        live: list[BaseChecker] = []
        for name in self.order:
            try:
                check = get_all_checkers()[name](config)
                if isinstance(check, SchemaChecker):
                    self.schema = check
                    if check.look(self.df, text_field, self.total_rows).count(ERROR):
                        break
                elif check.skipped():
                    self.told |= Outcome({name: {"skipped": True}})
                else:
                    check.measures(F.lit("x"))  # bad settings show here
                    live.append(check)
            except Exception as e:  # noqa: BLE001  one bad check leaves the others alone
                self.told |= _failed(name, e)
        try:
            found = self._take(live)
        except Exception:  # noqa: BLE001  find out which, one by one
            good = []
            for k in live:
                try:
                    annotate(self.rows, [k]).write.format("noop").mode("overwrite").save()
                    good.append(k)
                except Exception as e:  # noqa: BLE001
                    self.told |= _failed(k.name, e)
            live = good
            found = self._take(live)
        self.live = live
        self.outcome = self._all(found, self.total_rows)
        self.links: Callable[[], DataFrame] | None = None
        near = next((k for k in live if isinstance(k, NearDuplicateChecker)), None)
        if near is not None:
            self.links = lambda: near.links(self.shared[near.name])

    def _take(self, checkers: list[BaseChecker]) -> Outcome:
        self.shared = {k.name: t for k in checkers if (t := k.shared(self.rows)) is not None}
        self.annotated = materialise(annotate(self.rows, checkers, self.shared), "annotated")
        return summarise(self.annotated, checkers, self.text_field)

    def _all(self, found: Outcome, total_rows: int) -> Outcome:
        schema = self.schema.look(self.df, self.text_field, total_rows) if self.schema else Outcome()
        return (self.told | found | schema).of(*self.order)

    def without(self, removed: DataFrame) -> Outcome:
        """The outcome for the rows that are left when those of ``removed`` (row_id) go.

        Measures of single rows hold on.  Groups lose their removed rows, and the
        flags that compare rows are made again from what is left of them.
        """
        own = [f"`{k.name}.{m}`" for k in self.live for m in k.measures(F.lit("x"))]
        left = self.annotated.join(removed, "row_id", "left_anti").select("row_id", *own)
        shared = {name: t.join(removed, "row_id", "left_anti") for name, t in self.shared.items()}
        rows = self.rows.join(removed, "row_id", "left_anti")  # only for checks without a table of groups
        again = _with_groups(left, rows, self.live, shared)
        found = summarise(again, self.live, self.text_field)
        return self._all(found, left.count())


def run_check(check: BaseChecker, df: DataFrame, text_field: str, id_col: str | None = None) -> Outcome:
    """One check alone."""
    ship_package(df.sparkSession)
    if isinstance(check, SchemaChecker):
        return check.look(df, text_field, df.count())
    if check.skipped():
        return Outcome({check.name: {"skipped": True}})
    annotated = annotate(text_rows(df, text_field, id_col), [check])
    return summarise(annotated, [check], text_field)


def check_table(
    df: DataFrame, text_field: str = "text", config: CheckerConfig | None = None, id_col: str | None = None,
    dataset_id: str = "", split: str = "train",
) -> Checked:
    """Outcome of all checks over a table."""
    run = CheckRun(df, text_field, config or CheckerConfig(), id_col)
    return Checked(dataset_id, split, run.total_rows, text_field, run.outcome)


def fix_table(
    df: DataFrame, text_field: str = "text", config: CheckerConfig | None = None, id_col: str | None = None,
    dataset_id: str = "", split: str = "train",
) -> tuple[DataFrame, dict[str, Any], Checked]:
    """Clean, check, remove rows: the fixed table, the counts, and the report for the rows that are left."""
    config = config or CheckerConfig()
    ship_package(df.sparkSession)
    columns = df.columns
    rows = with_row_id(df, id_col)
    cleaned, stats = TextCleaner().fix_dataset(rows, text_field)
    if not id_col and rows.count() != stats["total_rows"]:  # positions are of a written table, so these counts are of the same rows
        raise RuntimeError(f"{rows.count()} rows before cleaning, {stats['total_rows']} after")
    run = CheckRun(cleaned, text_field, config, "row_id", df)
    links = run.links() if run.links and config.near_dup_keep == "per_cluster" else None
    removed, counts = RowFilter(config).removed(run.annotated, links)
    fixed = materialise(cleaned.join(removed, "row_id", "left_anti"), "fixed")
    report = Checked(dataset_id, split, counts["rows_after_filter"], text_field, run.without(removed))
    return fixed.select(*[f"`{c}`" for c in columns]), {**stats, "filter_stats": counts}, report


def merge_config(config: CheckerConfig, sample_size: int | None, skip: list[str]) -> CheckerConfig:
    """Settings with what the command line says laid over."""
    if sample_size is not None:
        config = replace(config, sample_size=sample_size)
    if skip:
        config = replace(config, skip_checkers=sorted({*config.skip_checkers, *skip}))
    return config
