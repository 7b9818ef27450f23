"""Reports as JSON documents and as plain text."""

from __future__ import annotations

import json
from typing import Any, TextIO

from corpusloom.outcome import ERROR, WARNING, Checked, Outcome


def _summary(outcome: Outcome) -> dict[str, int]:
    return {"total_issues": outcome.count(), "errors": outcome.count(ERROR), "warnings": outcome.count(WARNING)}


def _by_check(outcome: Outcome) -> list[dict[str, Any]]:
    # Fixed keys.
    keys = ("checker", "severity", "message", "affected_rows", "sample_indices", "details")
    issues: dict[str, list] = {name: [] for name in outcome.stats}
    for r in outcome.records:
        issues[r.checker].append(dict(zip(keys, r)))
    return [{"checker": name, "issues": issues[name], "stats": stats} for name, stats in outcome.stats.items()]


def document(checked: Checked, fix_stats: dict[str, Any] | None = None, after: Checked | None = None) -> dict[str, Any]:
    """The JSON document: flat, or before and after a fix."""
    head = {k: v for k, v in checked._asdict().items() if k != "outcome"}
    stats = {} if fix_stats is None else {"fix_stats": fix_stats}
    before, *rest = ({"summary": _summary(c.outcome), "results": _by_check(c.outcome)} for c in (checked, after) if c)
    if not rest:
        return {**head, **before, **stats}
    return {**head, "before": before, **stats, "after": rest[0]}


def write_json(out: TextIO, report: Checked, fix_stats: dict[str, Any] | None = None, after: Checked | None = None) -> None:
    out.write(json.dumps(document(report, fix_stats, after), ensure_ascii=False, indent=2) + "\n")


def _table(head: list[str], rows: list[list[str]]) -> list[str]:
    wide = [max(len(r[i]) for r in [head, *rows]) for i in range(len(head))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in [head, *rows]]
    return [lines[0], "  ".join("-" * w for w in wide), *lines[1:]]


def _status(errors: int, warnings: int) -> str:
    return "FAIL" if errors else "WARN" if warnings else "PASS"


def _results(outcome: Outcome) -> list[str]:
    rows = []
    for name in outcome.stats:
        own = outcome.of(name)
        errors, warnings = own.count(ERROR), own.count(WARNING)
        rows.append([name, str(own.count()), str(errors), str(warnings), _status(errors, warnings)])
    lines = _table(["Checker", "Issues", "Errors", "Warnings", "Status"], rows)
    for r in outcome.of(*outcome.stats).records:
        lines += ["", f"[{r.severity.upper()}] {r.checker}: {r.message}"]
        if r.rows:
            lines.append(f"  Affected rows: {r.rows:,} (sample: {list(r.sample)})")
        lines += [f"  {k}: {v}" for k, v in r.details.items()]
    return lines


def _counts(outcome: Outcome) -> str:
    return f"Issues: {outcome.count()} ({outcome.count(ERROR)} errors, {outcome.count(WARNING)} warnings)"


def _verdict(outcome: Outcome) -> list[str]:
    word = {"FAIL": "ERRORS FOUND", "WARN": "WARNINGS FOUND", "PASS": "ALL CHECKS PASSED"}
    n, errors, warnings = _summary(outcome).values()
    return ["", word[_status(errors, warnings)], f"Total issues: {n} | Errors: {errors} | Warnings: {warnings}"]


def text(report: Checked, fix_stats: dict[str, Any] | None = None, after: Checked | None = None) -> str:
    """The report for people."""
    lines = [
        "Dataset Quality Report",
        f"Dataset: {report.dataset_id}",
        f"Split: {report.split} | Rows: {report.total_rows:,} | Text field: {report.text_field}",
        "",
    ]
    if after is None:
        lines += _results(report.outcome)
        if fix_stats:
            rows = [[k, str(v)] for k, v in fix_stats.items() if k != "total_rows" and isinstance(v, int)]
            lines += ["", *_table(["Step", "Rows Fixed"], rows)]
        return "\n".join([*lines, *_verdict(report.outcome)]) + "\n"
    stats = fix_stats or {}
    lines += ["--- Before Fix ---", _counts(report.outcome), *_results(report.outcome), "", "--- Fix Applied ---"]
    lines.append(f"Text cleaned: {stats.get('total_fixed', 0)} rows")
    removed = dict(stats.get("filter_stats") or {})
    if removed:
        total, rest = removed.pop("total_rows_removed", 0), removed.pop("rows_after_filter", "?")
        each = ", ".join(f"{n} {name}" for name, n in removed.items() if n) or "none"
        lines += [f"Rows removed: {total} ({each})", f"Rows remaining: {rest}"]
    lines += ["", "--- After Fix ---", f"Rows: {after.total_rows:,} | {_counts(after.outcome)}", *_results(after.outcome)]
    return "\n".join([*lines, *_verdict(after.outcome)]) + "\n"


def error_text(message: str, as_json: bool) -> str:
    return json.dumps({"error": message}, ensure_ascii=False) if as_json else f"Error: {message}"
