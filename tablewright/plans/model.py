"""The frozen plan: decisions as plain data, replayed on any table as a few projections."""

from __future__ import annotations

import json
from copy import deepcopy
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import cleaning, encoding, features
from ..types import ColumnProfile, ReportEntry, SemanticType

MAPPING_ROWS = 100_000


class NotFittedError(ValueError, AttributeError):
    """The plan holds no decisions yet."""


class PrepModel:
    """Cleaning steps, encodings and added features of a prepared table.

    ``transform`` never drops a row, adds no job of its own and works on a stream as well. ``spec`` is JSON, but for
    mappings of more than ``MAPPING_ROWS`` categories, which are Parquet tables that it names.
    """

    def __init__(self, spec: dict[str, Any] | None = None):
        self.spec = spec

    def _fitted(self) -> dict[str, Any]:
        if not self.spec:
            raise NotFittedError("This pipeline is not fitted; call prepare() to get a fitted one.")
        return self.spec

    def get_feature_names_out(self) -> list[str]:
        return list(self._fitted()["outputs"])

    def to_json(self) -> str:
        return json.dumps(self._fitted(), default=str)

    @classmethod
    def from_json(cls, text: str) -> PrepModel:
        return cls(json.loads(text))

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())

    @classmethod
    def load(cls, path: str) -> PrepModel:
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read())

    def transform(self, df: DataFrame) -> DataFrame:
        """The prepared columns of a table; of others only the target stays, if it is there."""
        spec = self._fitted()
        if missing := [c for c in spec["inputs"] if c not in df.columns]:
            raise ValueError(f"These columns are missing: {', '.join(missing)}")
        target = [spec["target"]] if spec["target"] in df.columns else []
        out = cleaned_input(spec, df, target)
        for c, e in spec["engineer"].items():
            if e["kind"] == "target":
                out = encoding.mapped(out, c, _mapping(df, e), e["default"])
        return finished(spec, out, target)


def _mapping(df: DataFrame, entry: dict[str, Any]) -> DataFrame:
    spark = df.sparkSession
    if "path" in entry:
        return spark.read.parquet(entry["path"])
    rows = [(str(k), float(v)) for k, v in entry["mapping"].items()]
    return spark.createDataFrame(rows, "category string, value double")


def raw_names(spec: dict[str, Any]) -> dict[str, str]:
    """Columns whose values from before encoding some feature needs, and under which names they are kept."""
    wanted: list[str] = []
    for f in spec["features"]:
        if f["kind"] in ("cyclical", "text", "tfidf"):
            wanted.append(f["column"])
        elif f["kind"] in ("delta", "since"):
            wanted += [f["a"], f["b"]]
    return {c: f"__raw_{c}" for c in dict.fromkeys(wanted)}


def cleaned_input(spec: dict[str, Any], df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns after cleaning, with those that features need as they were but for NaN and for texts that are dates."""
    chosen = df.select(*(fc.named(c) for c in [*spec["inputs"], *keep]))
    extra = [
        cleaning.shaped(fc.named(c), {k: v for k, v in spec["clean"].get(c, {}).items() if k == "dates"}).alias(name)
        for c, name in raw_names(spec).items()
    ]
    return cleaning.cleaned(chosen, spec["clean"], extra)


def finished(spec: dict[str, Any], df: DataFrame, keep: list[str]) -> DataFrame:
    """Encodings (those by a mapping are done), added features, and the outputs in their order."""
    raw = raw_names(spec)
    columns = []
    for c in df.columns:
        if c in keep or c in raw.values():
            columns.append(fc.named(c))
            continue
        columns += encoded_columns(c, spec["engineer"].get(c, {"kind": "passthrough"}))
    out = df.select(*columns)
    if spec["features"]:
        out = features.with_features(out, spec["features"], raw)
    have = set(out.columns)
    wanted = [fc.named(c) if c in have else F.lit(False).alias(c) for c in spec["outputs"]]
    return out.select(*wanted, *(fc.named(c) for c in keep))


def encoded_columns(name: str, entry: dict[str, Any]) -> list:
    c, kind = fc.named(name), entry["kind"]
    if kind == "ordinal":
        return [encoding.ordinal(c, entry["values"]).alias(name)]
    if kind == "onehot":
        return encoding.one_hot(c, name, entry["values"])
    if kind == "linear":
        return [encoding.linear(c, entry).alias(name)]
    if kind == "datetime":
        return encoding.date_parts(c, name)
    return [c]


def fit_encodings(
    df: DataFrame, profiles: list[ColumnProfile], target: str, model_hint: str
) -> tuple[dict[str, dict[str, Any]], list[ReportEntry], DataFrame]:
    """How the columns of a cleaned table are encoded, the decisions, and the table with a target of numbers."""
    entries: list[ReportEntry] = []

    def log(column: str, action: str, rationale: str, **after) -> None:
        entries.append(ReportEntry("engineer", column, action, rationale, "info", {}, after))

    kinds = {f.name: f.dataType for f in df.schema}
    of = {k: [p.name for p in profiles if p.semantic_type is k and p.name in kinds] for k in SemanticType}
    low, high = of[SemanticType.CATEGORICAL_LOW], of[SemanticType.CATEGORICAL_HIGH]
    if high and target not in kinds:
        raise ValueError("Columns of many categories are encoded by the target, which is not there.")
    numeric_target = fc.named(target) if target in kinds else F.lit(None)
    if target in kinds and not (fc.is_numeric(kinds[target]) or fc.is_bool(kinds[target])):
        if high:
            index = encoding.label_index(encoding.distinct_values(df, [target])[target])
            numeric_target = encoding.indexed(numeric_target, index)
    numeric_target = numeric_target.cast("double")
    out: dict[str, dict[str, Any]] = {}
    values = encoding.distinct_values(df, low)
    numbers = [c for c in of[SemanticType.NUMERIC_FEATURE] if fc.is_numeric(kinds[c])] if model_hint == "linear" else []
    fitted = encoding.fit_linear(df, numbers)
    for p in profiles:
        c, kind = p.name, p.semantic_type
        if c not in kinds:
            continue
        if kind is SemanticType.DATETIME_NATIVE:
            out[c] = {"kind": "datetime"}
            log(c, "expand_datetime", "Year, month, day, day of the week, hour and weekend in place of the time")
        elif c in low:
            how = "ordinal" if model_hint == "tree" else "onehot"
            out[c] = {"kind": how, "values": [str(v) for v in values[c]]}
            action = "ordinal_encode" if how == "ordinal" else "one_hot_encode"
            log(c, action, f"{len(values[c])} categories for a {model_hint} model")
        elif c in high:
            mapping, default = encoding.target_mapping(df.withColumn("__y", numeric_target), c, F.col("__y"))
            out[c] = {"kind": "target", "default": default} | _held(mapping, c)
            log(c, "target_encode_cross_fit", f"Smoothed means of the target, {encoding.FOLDS} folds, against leakage")
        elif c in fitted:
            out[c] = {"kind": "linear"} | fitted[c]
            if fitted[c]["log1p"]:
                log(c, "log1p_transform", f"Skewness of {fitted[c]['skewness']:.2f} for a linear model")
            log(c, "standard_scale", "Mean 0, deviation 1 for a linear model", mean=fitted[c]["mean"], std=fitted[c]["std"])
    return out, entries, df.withColumn("__y", numeric_target)


def _held(mapping: DataFrame, column: str) -> dict[str, Any]:
    """A mapping as data if it is small, else as a table that is named."""
    rows = mapping.limit(MAPPING_ROWS + 1).collect()
    if len(rows) <= MAPPING_ROWS:
        return {"mapping": {str(r["category"]): r["value"] for r in sorted(rows, key=lambda r: str(r["category"]))}}
    import uuid

    spark = mapping.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_mappings"
    path = f"{root.rstrip('/')}/mapping-{uuid.uuid4().hex}"
    mapping.write.parquet(path)
    return {"path": path}


def row_fold(df: DataFrame, folds: int = encoding.FOLDS):
    """A fold for each row of a cleaned table, by the row's values."""
    own = [f.name for f in df.schema if fc.is_plain(f.dataType) and f.name != "__y" and not f.name.startswith("__raw_")]
    return F.pmod(F.xxhash64(*map(fc.named, own)), F.lit(folds))


def cross_fitted(df: DataFrame, encodings: dict[str, dict[str, Any]], keep: list[str]) -> DataFrame:
    """A cleaned table (with ``__y``, the target as a number) with its columns of many categories encoded out of fold."""
    high = [c for c, e in encodings.items() if e["kind"] == "target"]
    if high:
        df = encoding.cross_fit(df, high, F.col("__y"), row_fold(df))
    return df.drop("__y")


def outputs_of(df_columns: list[str], encodings: dict[str, dict[str, Any]]) -> list[str]:
    out = []
    for c in df_columns:
        e = encodings.get(c, {"kind": "passthrough"})
        if e["kind"] == "onehot":
            out += sorted(f"{c}_{v}" for v in e["values"])
        elif e["kind"] == "datetime":
            out += [f"{c}_{k}" for k in ("year", "month", "day", "dayofweek", "hour", "is_weekend")]
        else:
            out.append(c)
    return out


def extended(model: PrepModel, new: list[dict[str, Any]]) -> PrepModel:
    """The model with more features; the model itself stays as it is."""
    spec = deepcopy(model._fitted())
    spec["features"] += new
    spec["outputs"] += [n for f in new for n in f["names"] if n not in f.get("leave_out", ())]
    return PrepModel(spec)
