"""Chart data and an HTML or Markdown report (VZ-01, SNK-03, SNK-07, RG-11, LI-02)."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame

from plumbline.functions.cells import numeric
from plumbline.operators import stats


def chart_specs(df: DataFrame, k: int = 10) -> list[dict]:
    """Specs with their (small) data: histograms, a correlation matrix, category bars."""
    out = []
    nums = numeric(df)[:5]
    if nums:
        for c in nums:
            rows = stats.histogram(df, [c], bins=25).orderBy("bin").collect()
            out.append({"type": "histogram", "column": c, "data": [[r["low"], r["high"], r["count"]] for r in rows]})
        if len(nums) > 1:
            out.append({"type": "correlation", "data": [[r["column_a"], r["column_b"], r["r"]] for r in stats.correlation(df, nums).collect()]})
    for f in [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"][:3]:
        out.append({"type": "bar", "column": f, "data": [[r["value"], r["count"]] for r in stats.value_counts(df, f, k).collect()]})
    return out


def _number(x) -> str:
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def narrative(result: dict, name: str = "the dataset", cleaned: dict | None = None) -> str:
    """RG-11, LI-02: an analysis result in sentences, a paragraph for each subject, the five highest insights in front.

    cleaned: what a cleaning report counted, by name.
    """
    columns = result["columns"]
    parts = [[f"{name[:1].upper()}{name[1:]} has {result['rows']} rows and {len(columns)} columns: {', '.join(columns)}."]]
    parts[0] += [f"{i['title']} (score {i['score']:.2f})." for i in result.get("insights", [])[:5]]
    told = (("mean", "a mean of"), ("median", "a median of"), ("min", "a least value of"), ("max", "a greatest value of"), ("std", "a standard deviation of"))
    parts.append([f"{r['column']} has " + ", ".join(f"{words} {_number(r[k])}" for k, words in told if r.get(k) is not None) + "." for r in result.get("summary") or []])
    parts.append(
        [
            f"{r['column_a']} and {r['column_b']} have a {r['strength']} {r['direction']} correlation of {r['r_value']:.4f}: where one is high, the other tends to be {'high' if r['direction'] == 'positive' else 'low'}."
            for r in result.get("strong_correlations") or []
        ]
    )
    parts.append([f"{c} has {r['count']} outliers, {r['percentage']:.1f}% of the rows, outside {_number(r['lower'])} to {_number(r['upper'])}." for c, r in (result.get("outliers") or {}).items() if r["count"]])
    trends = (result.get("trends") or {}).items()
    parts.append([f"{c} has a {t['strength']} {t['direction']} trend over {t['data_points']} points." for c, t in trends if t.get("detected") and t["direction"] != "flat" and t["statistically_significant"]])
    missing = (result.get("missing_patterns") or {}).get("column_details", {})
    parts.append([f"{r['count']} values of {c} are missing ({r['percentage']:.1f}%, {r['severity']})." for c, r in missing.items()])
    scores = result.get("confidence") or []
    if scores:
        overall = sum(r["overall"] for r in scores) / len(scores)
        weak = [r for r in scores if r["grade"] in ("D", "F")]
        parts.append([f"Confidence in the data is {overall:.1f} of 100."] + [f"{r['column']} has grade {r['grade']}: {', '.join(r['issues'])}." for r in weak])
    parts.append([f"{r['severity'].capitalize()}: {r['column'] or 'rows'}, {r['description']}." for r in (result.get("issues") or [])[:10]])
    done = [f"{k.replace('_', ' ')}: {v}" for k, v in (cleaned or {}).items() if v]
    parts.append([f"Cleaning: {', '.join(done)}."] if done else ["Cleaning changed nothing."] if cleaned is not None else [])
    return "\n\n".join(" ".join(p) for p in parts if p)


def to_html(result: dict, title: str = "Dataset report") -> str:
    """SNK-03: one page, everything escaped."""
    cell = lambda v: html.escape(f"{v:.6g}" if isinstance(v, float) else str(v))

    def table(rows: list[dict]) -> str:
        if not rows:
            return "<p>none</p>"
        head = "".join(f"<th>{cell(k)}</th>" for k in rows[0])
        return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"

    parts = [f"<h2>{html.escape(k)}</h2>{table(v)}" for k, v in result.items() if isinstance(v, list) and (not v or isinstance(v[0], dict))]
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><p>{html.escape(narrative(result))}</p>{''.join(parts)}</body></html>"


def to_json(result: dict) -> str:
    return json.dumps(result, default=str)
