"""Markdown and JSON of small results."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame


def percent(x: float | None) -> str:
    return "n/a" if x is None else f"{100 * x:.1f}"


def rate_cell(k: int, n: int, rate: float | None, lo: float | None, hi: float | None) -> str:
    """`rate (k/n) [lo, hi]` in percent, or `n/a (0/0)`."""
    return f"{percent(rate)} ({k}/{n}) [{percent(lo)}, {percent(hi)}]" if n else "n/a (0/0)"


def markdown_table(head: list[str], rows: list[list[str]]) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(head), "|" + "---|" * len(head), *map(line, rows)])


def rates_table(rates: DataFrame, rules: list[str], skipped: dict[str, str] | None = None) -> str:
    """Systems against rules; a skipped system's row holds its reason."""
    cells = {(r.system, r.rule): rate_cell(r.k, r.n, r.rate, r.ci_lo, r.ci_hi) for r in rates.collect()}
    systems = list(dict.fromkeys(s for s, _ in sorted(cells)))
    rows = [[s, *[cells.get((s, r), "n/a (0/0)") for r in rules]] for s in systems]
    rows += [[s, f"skipped: {why}", *[""] * (len(rules) - 1)] for s, why in (skipped or {}).items()]
    return markdown_table(["System", *rules], rows)


def grading_report(summary: DataFrame, differences: DataFrame, agreement: DataFrame) -> str:
    """Rates by grader and system, paired differences in points, and agreement."""
    measures = ["correct", "correct_or_partly", "correct_if_rubric_pass", "correct_if_rubric_fail"]
    cells = {(r.grader, r.system, r.measure): rate_cell(r.k, r.n, r.rate, r.ci_lo, r.ci_hi) for r in summary.collect()}
    points = lambda x: f"{100 * x:+.1f}"
    out = ["# Blind grading results", ""]
    for g in sorted({g for g, _, _ in cells}):
        systems = sorted({s for x, s, _ in cells if x == g})
        out += [f"## Grader {g}", "", markdown_table(["System", *measures], [[s, *[cells.get((g, s, m), "n/a (0/0)") for m in measures]] for s in systems]), ""]
        for r in sorted((r for r in differences.collect() if r.grader == g), key=lambda r: r.difference):
            out.append(f"- {r.difference}: {points(r.diff)} points [{points(r.ci_lo)}, {points(r.ci_hi)}], n = {r.n}" if r.n else f"- {r.difference}: n/a, n = 0")
        out.append("")
    rows = [[f"{r.first} vs {r.second}", str(r.n), f"{percent(r.exact_match)}%", "undefined" if r.cohens_kappa is None else f"{r.cohens_kappa:.3f}"] for r in agreement.collect()]
    return "\n".join([*out, *(["## Agreement between graders", "", markdown_table(["Pair", "n", "exact match", "Cohen's kappa"], rows), ""] if rows else [])])


def as_json(df: DataFrame) -> str:
    """A small result as a JSON array, nulls written."""
    rows: list[dict[str, Any]] = [r.asDict(recursive=True) for r in df.collect()]
    return json.dumps(rows, indent=2, ensure_ascii=False) + "\n"
