"""Two results side by side in a PDF."""

from __future__ import annotations

from .api import compare
from .charts import Chart
from .pdf import Pdf
from .report import appendix
from .types import PrepResult


def save_compare_pdf(a: PrepResult, b: PrepResult, path: str) -> None:
    for x in (a, b):
        if x is None:
            raise ValueError("Two results are needed for a comparison.")
        if not isinstance(x, PrepResult):
            raise TypeError("Only results of preparation can be compared.")
    found = compare(a, b)
    pdf = Pdf()
    pdf.page()
    pdf.text(60, 90, 24, "Comparison", bold=True)
    pdf.text(60, 120, 12, f"First: {found['shape_a'][0]} rows, {found['shape_a'][1]} columns")
    pdf.text(60, 140, 12, f"Second: {found['shape_b'][0]} rows, {found['shape_b'][1]} columns")
    for kind in ("missingness", "correlation", "mutual_info", "class_distribution"):
        charts = [_chart(x, kind) for x in (a, b)]
        if not any(charts):
            continue
        pdf.page()
        pdf.text(50, 40, 14, kind.replace("_", " ").title(), bold=True)
        for i, chart in enumerate(charts):
            if chart is None:
                pdf.text(50 + 255 * i, 80, 10, "not available")
            else:
                pdf.chart(chart, 50 + 255 * i, 60, 245, 700)
    lines = [f"only in the first: {c}" for c in found["columns_only_in_a"]]
    lines += [f"only in the second: {c}" for c in found["columns_only_in_b"]]
    lines += [f"decided otherwise: {c}" for c in found["decision_diff"]]
    appendix(pdf, "Differences", lines or ["none"])
    pdf.save(path)


def _chart(result: PrepResult, kind: str) -> Chart | None:
    """One side's chart; what cannot be drawn on one side does not keep the other from being drawn."""
    try:
        return result.report.plot(kind)[0]
    except (ValueError, AttributeError):
        return None
