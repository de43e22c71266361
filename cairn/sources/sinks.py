"""Writing tables and reports: Parquet, CSV, JSON, LaTeX, HTML, JDBC."""

from __future__ import annotations

import html
import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame

#: Rows that a report table shows at most; larger tables go to Parquet or CSV.
REPORT_ROWS = 1000


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A folder of CSV files with headers; one_file for small results only."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True)


def write_json(value: Mapping, path: str, sort_keys: bool = False) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False, sort_keys=sort_keys, default=str), encoding="utf-8")


def write_jdbc(df: DataFrame, url: str, table: str, properties: Mapping[str, str]) -> None:
    """Replace a database table. Credentials come in properties, from the caller's configuration."""
    df.write.jdbc(url, table, mode="overwrite", properties=dict(properties))


def _rows(df: DataFrame, most: int) -> tuple[list[tuple], str]:
    """The first rows, and a note if there are more."""
    rows = [tuple(r) for r in df.limit(most + 1).collect()]
    return rows[:most], f"The first {most} rows; the table has more." if len(rows) > most else ""


_TEX = str.maketrans({"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"})


def _cell(v) -> str:
    return "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)


def latex(df: DataFrame, caption: str = "", label: str = "", most: int = REPORT_ROWS) -> str:
    """A LaTeX table of the first rows, with a note if there are more."""
    rows, note = _rows(df, most)
    lines = [r"\begin{table}", *([rf"\caption{{{caption.translate(_TEX)}}}"] if caption else []), *([rf"\label{{{label}}}"] if label else []), rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule"]
    lines += [" & ".join(c.translate(_TEX) for c in df.columns) + r" \\", r"\midrule"]
    lines += [" & ".join(_cell(v).translate(_TEX) for v in r) + r" \\" for r in rows]
    return "\n".join([*lines, r"\bottomrule", r"\end{tabular}", *([note] if note else []), r"\end{table}"]) + "\n"


def latex_tables(tables: Sequence[str]) -> str:
    return "\n".join(tables)


def html_page(title: str, tables: Mapping[str, DataFrame], charts: Mapping[str, Mapping] | None = None, most: int = REPORT_ROWS) -> str:
    """A self-contained page: tables, and charts as bars or points drawn in SVG, each with its data as JSON."""
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, spec in (charts or {}).items():
        out.append(f"<h2>{html.escape(name)}</h2>{_svg(spec)}<script type=application/json>{json.dumps(spec, default=str).replace('</', '<' + chr(92) + '/')}</script>")
    for name, df in tables.items():
        rows, note = _rows(df, most)
        head = "".join(f"<th>{html.escape(c)}" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(v))}" for v in r) for r in rows)
        out.append(f"<h2>{html.escape(name)}</h2><table border=1><tr>{head}{body}</table>" + (f"<p>{note}</p>" if note else ""))
    return "\n".join(out)


def _svg(spec: Mapping, width: int = 640, height: int = 320) -> str:
    x, y = list(spec.get("x", [])), [float(v or 0) for v in spec.get("y", [])]
    if not y:
        return "<p>No data</p>"
    low, high = min(0.0, *y), max(1e-12, *y)
    at = lambda v: height - (v - low) / (high - low) * height
    if spec.get("kind") == "bars":
        w = width / len(y)
        marks = "".join(f"<rect x={i * w:.1f} y={at(v):.1f} width={w * 0.9:.1f} height={max(0, at(0) - at(v)):.1f}><title>{html.escape(str(a))}: {v}</title></rect>" for i, (a, v) in enumerate(zip(x, y)))
    else:
        xs = [float(v or 0) for v in x]
        a, b = min(xs), max(xs)
        color = spec.get("color", [""] * len(y))
        marks = "".join(f"<circle cx={(u - a) / ((b - a) or 1) * width:.1f} cy={at(v):.1f} r=2><title>{html.escape(str(c))}</title></circle>" for u, v, c in zip(xs, y, color))
    return f'<svg viewBox="0 0 {width} {height}" width={width} height={height}>{marks}</svg>'


def save_page(page: str, folder: str, name: str) -> str:
    path = Path(folder) / f"output_chart_{name}.html"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(page, encoding="utf-8")
    return str(path)
