"""Reports from small tables: Markdown, figures as SVG, and HTML of both."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame


def markdown_table(df: DataFrame, most: int = 100) -> str:
    """The first rows as a table; meant for results that are small already."""
    rows = [[_cell(v) for v in r] for r in df.limit(most).collect()]
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in rows])


def _cell(v: object) -> str:
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")


def report(title: str, sections: Iterable[tuple[str, DataFrame | str]]) -> str:
    parts = [f"# {title}"]
    for name, body in sections:
        parts += [f"## {name}", body if isinstance(body, str) else markdown_table(body)]
    return "\n\n".join(parts) + "\n"


def figure(df: DataFrame, x: str, lines: list[str], title: str = "", most: int = 2000, width: int = 640, height: int = 240) -> str:
    """Lines over an ordered column as SVG; meant for one row a date or bin. Missing values break a line."""
    rows = df.select(x, *lines).orderBy(x).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a figure of more than {most} points")
    seen = [float(r[c]) for r in rows for c in lines if r[c] is not None and r[c] == r[c]]
    low, high = (min(seen), max(seen)) if seen else (0.0, 1.0)
    span, out = (high - low) or 1.0, [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" role="img"><title>{html.escape(title)}</title>']
    for k, c in enumerate(lines):
        path, pen = [], "M"
        for i, r in enumerate(rows):
            if r[c] is None or r[c] != r[c]:
                pen = "M"
                continue
            path.append(f"{pen}{40 + (width - 50) * i / max(1, len(rows) - 1):.1f} {height - 20 - (height - 40) * (float(r[c]) - low) / span:.1f}")
            pen = "L"
        out.append(f'<path d="{" ".join(path)}" fill="none" stroke="hsl({67 * k % 360} 60% 40%)"><title>{html.escape(c)}</title></path>')
    if rows:
        out += [f'<text x="2" y="{y}" font-size="10">{v:.4g}</text>' for y, v in ((20, high), (height - 20, low))] + [f'<text x="{at}" y="{height - 4}" font-size="10">{html.escape(str(v))}</text>' for at, v in ((40, rows[0][0]), (width - 80, rows[-1][0]))]
    return "".join(out) + "</svg>"


def to_html(markdown: str) -> str:
    """A page of the report's headings, tables, figures and text."""
    out: list[str] = []
    for block in markdown.strip().split("\n\n"):
        lines = block.split("\n")
        if block.startswith("#"):
            level = len(block) - len(block.lstrip("#"))
            out.append(f"<h{level}>{html.escape(block[level:].strip())}</h{level}>")
        elif block.startswith("|") and len(lines) > 1:
            cells = [[html.escape(c.strip().replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", x)[1:-1]] for x in (lines[0], *lines[2:])]
            head, *body = ["<tr>" + "".join(f"<{t}>{c}</{t}>" for c in r) + "</tr>" for t, r in zip(["th", *["td"] * len(cells)], cells, strict=False)]
            out.append(f"<table><thead>{head}</thead><tbody>{''.join(body)}</tbody></table>")
        else:
            out.append(block if block.startswith("<svg") else f"<p>{html.escape(block)}</p>")
    return f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(markdown.split(chr(10))[0].lstrip('# '))}</title>{''.join(out)}"
