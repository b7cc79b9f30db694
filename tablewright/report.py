"""The decision log and its views: text, table, JSON, HTML, PDF and charts."""

from __future__ import annotations

from enum import Enum
from html import escape
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .charts import MOST_CLASSES, Chart, bars, heatmap
from .functions import columns as fc
from .operators import stats as st
from .pdf import Pdf
from .types import SEVERITIES, STAGES, ColumnProfile, ReportEntry, SemanticType

SHOWN_INFO, SHOWN_ROWS, ROWS_A_PAGE = 5, 1000, 35
KINDS = ("missingness", "correlation", "mutual_info", "class_distribution")
ENTRY = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("stage", "column", "action", "rationale", "severity")]
    + [T.StructField(c, T.MapType(T.StringType(), T.StringType())) for c in ("before_stats", "after_stats")]
)


def plain(value: Any) -> Any:
    """A value that JSON can hold."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if isinstance(value, Enum):
        return value.value
    if hasattr(value, "item"):
        return value.item()
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


class Report:
    def __init__(
        self,
        entries: list[ReportEntry],
        df: DataFrame | None = None,
        profiles: list[ColumnProfile] | None = None,
        target: str | None = None,
    ):
        self._entries = list(entries)
        self.df, self.profiles, self.target = df, profiles, target

    @property
    def entries(self) -> list[ReportEntry]:
        return list(self._entries)

    def filter_by_severity(self, severity: str) -> list[ReportEntry]:
        if severity not in SEVERITIES:
            raise ValueError(f"severity must be one of {SEVERITIES}, not {severity!r}")
        return [e for e in self._entries if e.severity == severity]

    def filter_by_stage(self, stage: str) -> list[ReportEntry]:
        if stage not in STAGES:
            raise ValueError(f"stage must be one of {STAGES}, not {stage!r}")
        return [e for e in self._entries if e.stage == stage]

    def filter_by_column(self, column: str) -> list[ReportEntry]:
        return [e for e in self._entries if e.column == column]

    def summary_counts(self) -> dict[str, int]:
        return {s: sum(e.severity == s for e in self._entries) for s in ("info", "warning", "critical")}

    def show(self, severity_filter: str | None = None, verbose: bool = False) -> None:
        """Prints the decisions by stage, the grave ones first, and of the others a few unless all are asked for."""
        chosen = self.filter_by_severity(severity_filter) if severity_filter else self._entries
        if not chosen:
            print("No decisions logged.")
            return
        print(f"{len(chosen)} decisions: " + ", ".join(f"{n} {s}" for s, n in self.summary_counts().items()))
        for stage in STAGES:
            own = [e for e in chosen if e.stage == stage]
            if not own:
                continue
            print(f"{stage.upper()} ({len(own)})")
            shown = 0
            for e in sorted(own, key=lambda e: SEVERITIES.index(e.severity)):
                if e.severity == "info":
                    shown += 1
                    if shown > SHOWN_INFO and not verbose:
                        continue
                print(f"  [{e.severity}] {e.column}: {e.action} - {e.rationale}")
            if shown > SHOWN_INFO and not verbose:
                print(f"  ... and {shown - SHOWN_INFO} more (verbose=True shows them)")

    def to_dict(self) -> dict[str, Any]:
        return {
            "target": self.target,
            "summary": self.summary_counts(),
            "total_entries": len(self._entries),
            "entries": [plain(vars(e)) for e in self._entries],
            "profiles": [plain(vars(p)) for p in self.profiles] if self.profiles is not None else None,
        }

    def to_dataframe(self, spark: SparkSession | None = None) -> DataFrame:
        """The decisions as a table; without any it still has its columns."""
        spark = spark or (self.df.sparkSession if self.df is not None else SparkSession.getActiveSession())
        text = lambda d: {str(k): str(plain(v)) for k, v in d.items()}
        rows = [
            (e.stage, e.column, e.action, e.rationale, e.severity, text(e.before_stats), text(e.after_stats))
            for e in self._entries
        ]
        return spark.createDataFrame(rows, ENTRY)

    # charts

    def plot(self, kind: str = "all") -> list[Chart]:
        if self.df is None or self.profiles is None or self.target is None:
            raise ValueError("Charts need a report with a table, profiles and a target.")
        if kind != "all" and kind not in KINDS:
            raise ValueError(f"kind must be 'all' or one of {KINDS}, not {kind!r}")
        out = []
        for k in KINDS if kind == "all" else (kind,):
            try:
                out.append(getattr(self, f"_{k}")())
            except ValueError:
                if kind != "all":
                    raise
        return out

    def _missingness(self) -> Chart:
        return missingness_chart(self.df)

    def _correlation(self) -> Chart:
        kinds = (SemanticType.NUMERIC_FEATURE, SemanticType.NUMERIC_ID)
        numeric = [p.name for p in self.profiles if p.semantic_type in kinds]
        return correlation_chart(self.df, [c for c in numeric if fc.is_numeric(self.df.schema[c].dataType)])

    def _mutual_info(self) -> Chart:
        return information_chart(self.profiles)

    def _class_distribution(self) -> Chart:
        return class_chart(self.df, self.target)

    # exports

    def to_html(self, include_plots: bool = True) -> str:
        counts = self.summary_counts()
        out = [
            "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Decisions</title><style>",
            "body{font-family:sans-serif}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:3px 6px}",
            ".warning{background:#fff3cd}.critical{background:#f8d7da}</style></head><body><h1>Decisions</h1><p>",
            ", ".join(f"{n} {s}" for s, n in counts.items()), "</p>",
        ]
        for stage in STAGES:
            if own := self.filter_by_stage(stage):
                out.append(f"<h2>{stage}</h2><table><tr><th>column<th>action<th>rationale<th>severity</tr>")
                out += [
                    f"<tr class='{e.severity}'>" + "".join(f"<td>{escape(str(x))}</td>" for x in (e.column, e.action, e.rationale, e.severity)) + "</tr>"
                    for e in own
                ]
                out.append("</table>")
        if self.profiles:
            names = ("name", "semantic_type", "missing_rate", "cardinality", "outlier_rate", "vif_score", "correlation_with_target", "mutual_info_with_target")
            out.append("<h2>columns</h2><table><tr>" + "".join(f"<th>{n}" for n in names) + "</tr>")
            for p in self.profiles:
                cells = (plain(getattr(p, n)) for n in names)
                out.append("<tr>" + "".join(f"<td>{escape('' if x is None else f'{x:.4g}' if isinstance(x, float) else str(x))}</td>" for x in cells) + "</tr>")
            out.append("</table>")
        if include_plots and self.df is not None and self.profiles is not None and self.target is not None:
            out += [f"<div>{c.svg()}</div>" for c in self.plot()]
        return "".join(out) + "</body></html>"

    def save_html(self, path: str, include_plots: bool = True) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_html(include_plots))

    def save_pdf(self, path: str, include_appendix: bool = True) -> None:
        """A cover with counts, the decisions by stage, charts, and all decisions as an appendix."""
        pdf = Pdf()
        pdf.page()
        pdf.text(60, 90, 24, "Preparation report", bold=True)
        pdf.text(60, 120, 12, f"Target: {self.target}")
        pdf.text(60, 140, 12, ", ".join(f"{n} {s}" for s, n in self.summary_counts().items()))
        counts = [(s, float(len(self.filter_by_stage(s)))) for s in STAGES]
        pdf.chart(bars("Decisions by stage", counts), 50, 180, 495, 120)
        if self.df is not None and self.profiles is not None and self.target is not None:
            for chart in self.plot():
                pdf.page()
                pdf.chart(chart, 50, 60, 495, 700)
        if include_appendix:
            appendix(pdf, "All decisions", [f"{e.stage} | {e.severity} | {e.column} | {e.action} | {e.rationale}" for e in self._entries])
        pdf.save(path)


def appendix(pdf: Pdf, title: str, lines: list[str]) -> None:
    for at in range(0, len(lines), ROWS_A_PAGE):
        pdf.page()
        pdf.text(50, 50, 14, title, bold=True)
        for i, line in enumerate(lines[at : at + ROWS_A_PAGE]):
            pdf.text(50, 80 + 20 * i, 7, line if len(line) <= 130 else line[:127] + "...")


def correlation_chart(df: DataFrame, columns: list[str]) -> Chart:
    if len(columns) < 2:
        raise ValueError("A correlation chart needs two columns of numbers.")
    matrix = st.correlation_matrix(fc.without_nan(df), columns)
    return heatmap("Correlation", columns, [[float(x) for x in row] for row in matrix], columns)


def missing_cells(df: DataFrame, rows: int = SHOWN_ROWS) -> DataFrame:
    """Where values are missing, in a fixed choice of rows: those of least hash."""
    cells = [fc.named(c).isNull().cast("int").alias(c) for c in df.columns]
    plain_columns = [fc.named(f.name) for f in df.schema if fc.is_plain(f.dataType)]
    order = F.xxhash64(*plain_columns).alias("__order")
    return fc.without_nan(df).select(*cells, order).orderBy("__order").limit(rows).drop("__order")


def missingness_chart(df: DataFrame) -> Chart:
    rows = [[float(x) for x in r] for r in missing_cells(df).collect()]
    if not rows:
        raise ValueError("There are no rows to draw.")
    return heatmap("Missing values", df.columns, rows)


def information_chart(profiles: list[ColumnProfile]) -> Chart:
    known = [(p.name, p.mutual_info_with_target) for p in profiles if p.mutual_info_with_target is not None]
    if not known:
        raise ValueError("No column has mutual information with the target.")
    return bars("Mutual information with the target", sorted(known, key=lambda x: -x[1]))


def class_chart(df: DataFrame, target: str) -> Chart:
    rows = st.class_counts(df, target).orderBy(F.desc("n"), F.col("value").cast("string")).limit(MOST_CLASSES + 1).collect()
    if len(rows) > MOST_CLASSES:
        raise ValueError(f"The target has more than {MOST_CLASSES} classes.")
    return bars("Rows by class", [(str(r["value"]), float(r["n"])) for r in rows])
