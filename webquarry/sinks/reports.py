"""Reports: distributed JSON lines, and single JSON files for those who need one document.

Single files are streamed row by row from the driver, which holds one partition at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame

from ..operators import audit

FINDING = ("metric", "page", "severity", "evidence", "suggested_fix")


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _file(path: str) -> Path:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    return p


def write_items(out: TextIO, items: Iterable, margin: str = "") -> int:
    """Items as an indented JSON array, one after another; returns their number."""
    n = 0
    out.write("[")
    for item in items:
        text = json.dumps(item, ensure_ascii=False, indent=2)
        out.write(("," if n else "") + f"\n{margin}  " + text.replace("\n", f"\n{margin}  "))
        n += 1
    out.write(f"\n{margin}]" if n else "]")
    return n


def write_array(df: DataFrame, path: str) -> int:
    """Rows as one indented JSON array in the frame's order; returns their number."""
    with _file(path).open("w", encoding="utf-8") as out:
        n = write_items(out, (row.asDict(recursive=True) for row in df.toLocalIterator()))
        out.write("\n")
    return n


def audit_report(found: DataFrame, path: str) -> int:
    return write_array(found.select(*FINDING), path)


def audit_summary(found: DataFrame, pages: DataFrame, seconds: float, path: str | None = None) -> dict:
    """Totals, the five severities, metrics by frequency, addresses, findings."""
    summary = {
        "pages_crawled": pages.count(), "total_findings": found.count(), "duration_seconds": round(seconds, 2),
        "severity_counts": {r["severity"]: r["n"] for r in audit.severity_summary(found).orderBy("rank").collect()},
        "metric_counts": {r["metric"]: r["n"] for r in audit.metric_summary(found).orderBy("n", "metric", ascending=[False, True]).collect()},
    }
    if path:
        addresses = (r["final_url"] for r in pages.select("page_ord", "final_url").orderBy("page_ord").toLocalIterator())
        rows = (r.asDict() for r in found.select(*FINDING).toLocalIterator())
        with _file(path).open("w", encoding="utf-8") as out:
            out.write(json.dumps(summary, ensure_ascii=False, indent=2)[:-2])
            for name, items in (("urls", addresses), ("findings", rows)):
                out.write(f',\n  "{name}": ')
                write_items(out, items, "  ")
            out.write("\n}\n")
    return summary


def identity_report(reports: DataFrame, path: str) -> int:
    return write_array(reports.orderBy("field_ord").drop("field_ord"), path)


def answer_report(answer: dict, path: str) -> None:
    """The three keys, null where there is no answer."""
    _file(path).write_text(json.dumps({k: answer.get(k) for k in ("query", "url", "excerpt")}, ensure_ascii=False, indent=2), encoding="utf-8")


def print_summary(summary: dict, found: DataFrame) -> None:
    """Counts by severity and the eight most frequent metrics."""
    print(f"{summary['pages_crawled']} pages, {summary['total_findings']} findings in {summary['duration_seconds']} s")
    for name, n in summary["severity_counts"].items():
        print(f"  {name:<10}{n}")
    for r in audit.top_metrics(found).collect():
        print(f"  {r['metric']:<32}{r['n']}")


def print_identity(found: DataFrame, pages: int, seconds: float, path: str) -> None:
    """Verdict, confidence and numbers of values of the three fields."""
    print(f"{pages} pages in {seconds:.2f} s; written to {path}")
    for r in found.orderBy("field_ord").selectExpr("field", "verdict", "confidence", "size(values) AS raw", "size(normal_values) AS normal").collect():
        print(f"  {r['field']:<9}{r['verdict']:<29}{r['confidence']:<6.2f}{r['raw']} values, {r['normal']} distinct")


def print_answer(answer: dict, pages: int, seconds: float, path: str) -> None:
    """Question, confidence, and source and excerpt, or that there is none."""
    print(f"{pages} pages in {seconds:.2f} s; written to {path}")
    print(f"  question    {answer['query']}\n  confidence  {answer.get('confidence') or 0.0:.2f}")
    print(f"  source      {answer['url']}\n  excerpt     {answer['excerpt']}" if answer.get("url") else "  no grounded answer on these pages")
