"""The crawl report as a standalone page, and statistics as JSON."""

from __future__ import annotations

import json
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame

from webloom.operators.records import report_rows


def _table(title: str, heads: tuple[str, ...], rows: list[tuple]) -> str:
    """Rows of cells that are escaped already."""
    body = "".join(f"<tr>{''.join(f'<td>{c}</td>' for c in r)}</tr>" for r in rows)
    return f"<h2>{escape(title)}</h2><table><tr>{''.join(f'<th>{escape(h)}</th>' for h in heads)}</tr>{body}</table>"


def html_report(path: str, summary: dict, counts: dict[str, dict], pages: DataFrame, rows: int = 500) -> None:
    """Write a report: the summary's figures, tables of counts, and the first ``rows`` pages. Every value is escaped."""
    safe = lambda v: escape(str(v), quote=True)
    figures = _table("Summary", ("Figure", "Value"), [(safe(k), safe(v)) for k, v in summary.items()])
    tables = "".join(_table(name, ("Value", "Count"), [(safe(k), safe(v)) for k, v in table.items()]) for name, table in counts.items())
    listed = [(f'<a href="{r["href"]}" rel="noopener noreferrer">{r["shown_url"]}</a>', r["title"], r["links"], r["text_length"]) for r in report_rows(pages, rows).collect()]
    page = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Crawl report</title></head><body><h1>Crawl report</h1>{figures}{tables}{_table("Pages", ("URL", "Title", "Links", "Text"), listed)}</body></html>'
    Path(path).write_text(page, encoding="utf-8")


def stats_json(path: str, stats: dict) -> None:
    """Statistics as indented JSON; keys become text, letters beyond ASCII stay."""
    Path(path).write_text(json.dumps({str(k): v for k, v in stats.items()}, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
