"""The functions that users call."""

from __future__ import annotations

import functools
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame

from .functions import columns as fc
from .operators import encoding
from .operators import features as ft
from .operators import stats as st
from .operators.cleaning import METHODS, run_cleaner
from .operators.profiling import run_profiler
from .plans import model as pm
from .report import Report
from .types import PRESETS, ColumnProfile, FeatureConfig, PrepResult, ReportEntry, SemanticType
from .validation import as_spark, check_inputs

_UNSET: Any = object()
DEFAULTS = {"drop_threshold": 0.6, "outlier_method": "iqr", "cardinality_threshold": 20, "feature_config": None}


def _settings(preset: str | None, given: dict[str, Any]) -> dict[str, Any]:
    """Defaults, over them the preset, over it what was given."""
    if preset is not None and preset not in PRESETS:
        raise ValueError(f"There is no preset '{preset}'; there are {', '.join(sorted(PRESETS))}.")
    settings = DEFAULTS | (PRESETS[preset] if preset else {})
    settings |= {k: v for k, v in given.items() if v is not _UNSET}
    if settings["outlier_method"] not in METHODS:
        raise ValueError(f"outlier_method must be one of {METHODS}, not {settings['outlier_method']!r}")
    return settings


def _mismatch(target: str, warning: str | None) -> list[ReportEntry]:
    return [ReportEntry("profiler", target, "task_target_mismatch_warning", warning, "warning")] if warning else []


def _subset(df: DataFrame, profiles: list[ColumnProfile], target: str) -> DataFrame:
    return df.select(*(fc.named(p.name) for p in profiles), fc.named(target))


def _read_once(f):
    """f with its table read once for all the passes it makes; the table that it returns reads its source by itself."""

    @functools.wraps(f)
    def run(df, *args, **kwargs):
        df = as_spark(df)
        with st.held(df):
            return f(df, *args, **kwargs)

    return run


@_read_once
def prepare(
    df: DataFrame,
    target: str,
    task: str = "classification",
    model_hint: str = "tree",
    drop_threshold: float = _UNSET,
    outlier_method: str = _UNSET,
    cardinality_threshold: int = _UNSET,
    feature_config: FeatureConfig | None = _UNSET,
    column_types: dict[str, SemanticType] | None = None,
    preset: str | None = None,
    dry_run: bool = False,
    train_encoding: str = "cross_fit",
) -> PrepResult:
    """A prepared table, the frozen pipeline that prepares others alike, and the report of all decisions.

    Columns of many categories are encoded out of fold in the returned table and by the whole table's means in the
    pipeline; ``train_encoding="full"`` uses the latter for both.
    """
    if not isinstance(dry_run, bool):
        raise TypeError("dry_run must be True or False.")
    if train_encoding not in ("cross_fit", "full"):
        raise ValueError("train_encoding must be 'cross_fit' or 'full'")
    given = {
        "drop_threshold": drop_threshold, "outlier_method": outlier_method, "cardinality_threshold": cardinality_threshold,
        "feature_config": feature_config,
    }
    settings = _settings(preset, given)
    df = as_spark(df)
    warning = check_inputs(df, target, task, model_hint, column_types)
    head = _mismatch(target, warning)
    if preset:
        shown = {k: asdict(v) if isinstance(v, FeatureConfig) else v for k, v in settings.items()}
        head.append(ReportEntry("profiler", "*", "apply_preset", f"Preset '{preset}' stands for {shown}", "info"))
    profiles, found = run_profiler(df, target, task, settings["cardinality_threshold"], column_types)
    carried = [c for c in df.columns if c != target and c not in {p.name for p in profiles}]
    config = settings["feature_config"]

    if dry_run:
        head.append(ReportEntry("profiler", "*", "dry_run", "Nothing was transformed and no pipeline fitted", "info"))
        table, kept, cleaning, _ = run_cleaner(df, profiles, settings["drop_threshold"], settings["outlier_method"])
        _, engineering = run_engineer(table, kept, target, model_hint, config)
        return PrepResult(df, None, Report(head + found + cleaning + engineering, df, kept, target))

    names = [p.name for p in profiles]
    features = df.select(*(fc.named(c) for c in names)) if names else None
    if features is None:
        raise ValueError("None of the columns is of a type that can be prepared.")
    _, kept, cleaning, steps = run_cleaner(features, profiles, settings["drop_threshold"], settings["outlier_method"])
    spec = {"inputs": [*names, *carried], "target": target, "clean": steps, "engineer": {}, "features": [], "outputs": []}
    table = pm.cleaned_input(spec, df, [target])
    encodings, engineering, numbered = pm.fit_encodings(table, kept, target, model_hint)
    spec["engineer"] = encodings
    spec["outputs"] = pm.outputs_of([c for c in table.columns if c != target], encodings)
    model = pm.PrepModel(spec)
    if train_encoding == "full":
        prepared = model.transform(df)
    else:
        prepared = pm.finished(spec, pm.cross_fitted(numbered, encodings, [target]), [target])
    report = Report(head + found + cleaning + engineering, df, profiles, target)
    result = PrepResult(prepared, model, report)
    return add_features(result, config) if config is not None else result


@_read_once
def profile(
    df: DataFrame,
    target: str,
    task: str = "classification",
    model_hint: str = "tree",
    cardinality_threshold: int = 20,
    column_types: dict[str, SemanticType] | None = None,
) -> PrepResult:
    """The table as it is, with the report of what was found."""
    df = as_spark(df)
    warning = check_inputs(df, target, task, model_hint, column_types)
    profiles, found = run_profiler(df, target, task, cardinality_threshold, column_types)
    return PrepResult(df, None, Report(_mismatch(target, warning) + found, df, profiles, target))


@_read_once
def clean(
    df: DataFrame,
    target: str,
    task: str = "classification",
    model_hint: str = "tree",
    drop_threshold: float = 0.6,
    outlier_method: str = "iqr",
    cardinality_threshold: int = 20,
    column_types: dict[str, SemanticType] | None = None,
) -> PrepResult:
    """The cleaned table, without repeated rows."""
    df = as_spark(df)
    warning = check_inputs(df, target, task, model_hint, column_types)
    profiles, found = run_profiler(df, target, task, cardinality_threshold, column_types)
    table, kept, cleaning, _ = run_cleaner(df, profiles, drop_threshold, outlier_method)
    return PrepResult(table, None, Report(_mismatch(target, warning) + found + cleaning, df, kept, target))


@_read_once
def engineer(
    df: DataFrame,
    target: str,
    task: str = "classification",
    model_hint: str = "tree",
    drop_threshold: float = 0.6,
    outlier_method: str = "iqr",
    cardinality_threshold: int = 20,
    feature_config: FeatureConfig | None = None,
    column_types: dict[str, SemanticType] | None = None,
) -> PrepResult:
    """The cleaned table with its columns encoded, those of many categories out of fold."""
    df = as_spark(df)
    warning = check_inputs(df, target, task, model_hint, column_types)
    profiles, found = run_profiler(df, target, task, cardinality_threshold, column_types)
    table, kept, cleaning, _ = run_cleaner(df, profiles, drop_threshold, outlier_method)
    out, engineering = run_engineer(table, kept, target, model_hint, feature_config)
    entries = _mismatch(target, warning) + found + cleaning + engineering
    return PrepResult(out, None, Report(entries, df, kept, target))


def run_engineer(
    df: DataFrame,
    profiles: list[ColumnProfile],
    target: str,
    model_hint: str = "tree",
    feature_config: FeatureConfig | None = None,
) -> tuple[DataFrame, list[ReportEntry]]:
    """A cleaned table with its columns encoded and, on request, features added; and the decisions."""
    encodings, entries, numbered = pm.fit_encodings(df, profiles, target, model_hint)
    rest = [c for c in df.columns if c != target]
    spec = {
        "inputs": rest, "target": target, "clean": {}, "engineer": encodings, "features": [],
        "outputs": pm.outputs_of(rest, encodings),
    }
    if feature_config is None or not feature_config.active:
        return pm.finished(spec, pm.cross_fitted(numbered, encodings, [target]), [target]), entries
    plain = pm.finished(spec, pm.cross_fitted(numbered, encodings, [target]), [target])
    new, more = choose_features(plain, df, profiles, target, feature_config)
    spec = pm.extended(pm.PrepModel(spec), new).spec
    raw = [fc.named(c).alias(n) for c, n in pm.raw_names(spec).items()]
    numbered = numbered.select("*", *raw)
    return pm.finished(spec, pm.cross_fitted(numbered, encodings, [target]), [target]), entries + more


def choose_features(
    prepared: DataFrame, raw: DataFrame, profiles: list[ColumnProfile], target: str, config: FeatureConfig
) -> tuple[list[ft.Feature], list[ReportEntry]]:
    """The features that a request comes to, and the decisions. Names that are taken are not taken twice."""
    entries: list[ReportEntry] = []
    taken = set(prepared.columns)
    out: list[ft.Feature] = []

    def log(column: str, action: str, rationale: str, severity: str = "info") -> None:
        entries.append(ReportEntry("engineer", column, action, rationale, severity))

    def add(feature: ft.Feature, action: str, column: str, rationale: str) -> None:
        clash = [n for n in feature["names"] if n in taken]
        for n in clash:
            log(n, "skipped_duplicate_feature", f"There is a column {n} already; the feature was left out", "warning")
        if len(clash) == len(feature["names"]):
            return
        if clash:  # the other columns stay useful without the one whose name is taken
            feature = feature | {"leave_out": clash}
        taken.update(feature["names"])
        out.append(feature)
        log(column, action, rationale)

    kinds = {f.name: f.dataType for f in raw.schema}
    if config.interactions:
        present = [c for c in prepared.columns if c != target and fc.is_numeric(prepared.schema[c].dataType)]
        best = ft.strongest(profiles, present, config.interaction_top_k)
        for f in ft.interactions(best, config.interaction_types):
            add(f, "created_interaction", f["names"][0], f"{f['op'].title()} of {f['a']} and {f['b']}")
    dates = [p.name for p in profiles if p.semantic_type is SemanticType.DATETIME_NATIVE and p.name in kinds]
    dates = [c for c in dates if fc.is_datetime(kinds[c])]
    actions = {"cyclical": "datetime_cyclical", "delta": "datetime_deltas", "since": "datetime_reference"}
    for f in ft.date_features(dates, config):
        column = f["column"] if f["kind"] == "cyclical" else f["names"][0]
        what = f"Cycles of {column}" if f["kind"] == "cyclical" else f"Days from {f['a']} to {f['b']}"
        add(f, actions[f["kind"]], column, what)
    if config.clustering:
        numeric = {p.name for p in profiles if p.semantic_type is SemanticType.NUMERIC_FEATURE}
        wanted = numeric if config.cluster_features == "numeric_only" else set(config.cluster_features)
        columns = [
            c for c in prepared.columns if c in wanted and c != target and fc.is_numeric(prepared.schema[c].dataType)
        ]
        clusters = ft.fit_clusters(prepared, columns, config.cluster_k)
        if clusters:
            add(clusters, "cluster_features", "cluster_label", f"{len(clusters['centres'])} clusters of {len(columns)} columns")
    texts = [p.name for p in profiles if p.semantic_type is SemanticType.TEXT and p.name in kinds]
    for c in texts:
        if config.text_features:
            add(ft.text_feature(c), "generate_text_features", c, "Length, words, and whether there is a text at all")
        if config.text_tfidf:
            feature = ft.fit_tfidf(raw, c, config.text_tfidf_top_k)
            if feature is None:
                log(c, "generate_text_tfidf", "There are no terms to weigh", "warning")
            else:
                add(feature, "generate_text_tfidf", c, f"Weights of the {len(feature['terms'])} most frequent terms")
    return out, entries


def add_features(result: PrepResult, feature_config: FeatureConfig) -> PrepResult:
    """A new result with features added to a prepared one; the given result stays as it is."""
    if not isinstance(feature_config, FeatureConfig):
        raise TypeError("feature_config must be a FeatureConfig.")
    if result.pipeline is None:
        raise ValueError("Features can be added to results of prepare() only: this one has no pipeline.")
    report = result.report
    if report is None or report.profiles is None or report.target is None or report.df is None:
        raise ValueError("The result's report lacks profiles, target or table.")
    entries = report.entries
    if not feature_config.active:
        entries.append(ReportEntry("engineer", "*", "add_features_skipped", "No feature was asked for", "info"))
        return PrepResult(result.df, result.pipeline, Report(entries, report.df, report.profiles, report.target))
    new, more = choose_features(
        result.df, fc.without_nan(report.df), report.profiles, report.target, feature_config
    )
    model = pm.extended(result.pipeline, new)
    table = _augmented(result, model)
    return PrepResult(table, model, Report(entries + more, report.df, report.profiles, report.target))


def _augmented(result: PrepResult, model: pm.PrepModel) -> DataFrame:
    """The prepared table with the model's features. Columns encoded out of fold are encoded again, which gives the same
    values, so features of raw columns and of prepared ones come from the same rows."""
    spec, target, raw = model.spec, result.report.target, result.report.df
    table = pm.cleaned_input(spec, raw, [target])
    if not any(e["kind"] == "target" for e in spec["engineer"].values()):
        return pm.finished(spec, table, [target])
    y = fc.named(target)
    kind = table.schema[target].dataType
    if not (fc.is_numeric(kind) or fc.is_bool(kind)):
        y = encoding.indexed(y, encoding.label_index(encoding.distinct_values(table, [target])[target]))
    numbered = table.withColumn("__y", y.cast("double"))
    out = pm.cross_fitted(numbered, spec["engineer"], [target])
    return pm.finished(spec, out, [target])


def compare(a: PrepResult, b: PrepResult) -> dict[str, Any]:
    """How two results differ; a summary is printed."""
    if a is None or b is None:
        raise ValueError("Two results are needed for a comparison.")
    if a.df is None or b.df is None:
        raise ValueError("A result without its table cannot be compared.")
    out: dict[str, Any] = {}
    for side, x in (("a", a), ("b", b)):
        out[f"shape_{side}"] = (x.df.count(), len(x.df.columns))
        out[f"report_entry_counts_{side}"] = x.report.summary_counts() if x.report is not None else None
    names = {"columns_only_in_a": set(a.df.columns) - set(b.df.columns), "columns_only_in_b": set(b.df.columns) - set(a.df.columns)}
    names["columns_in_both"] = set(a.df.columns) & set(b.df.columns)
    out |= {k: sorted(v) for k, v in names.items()}
    done = [{(e.column, e.action) for e in x.report.entries} if x.report is not None else set() for x in (a, b)]
    common = {c for c, _ in done[0]} & {c for c, _ in done[1]}
    out["decision_diff"] = sorted({c for c, _ in done[0] ^ done[1]} & common)
    for key, value in out.items():
        print(f"{key}: {value}")
    return out
