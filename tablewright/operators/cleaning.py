"""The cleaner: repeated rows, useless columns, missing values, outliers, spellings.

Fitting decides once and writes the decisions down as plain data, a step for each column; ``cleaned`` replays them as
one projection on any table with those columns.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..types import ColumnProfile, ReportEntry, SemanticType
from . import stats as st
from .profiling import find_coercions, repeats

IMPUTE_BELOW, CLIP_UP_TO, CHANGED_WARNING = 0.30, 0.30, 0.10
METHODS = ("iqr", "zscore")
#: Up to so many rare values are part of the step; more are a table that it names, joined by value.
MOST_RARE = 10_000

Step = dict[str, Any]


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Rows that differ somewhere; maps cannot be compared, so they do not count as a difference."""
    comparable = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    return df.dropDuplicates() if len(comparable) == len(df.columns) else df.dropDuplicates(comparable)


def fences(method: str, q1: float, q3: float, mean: float, std: float) -> tuple[float, float] | None:
    """The bounds that values are clipped to; None where there is no spread."""
    if method not in METHODS:
        raise ValueError(f"outlier_method must be one of {METHODS}, got {method!r}")
    if None in (q1, q3, mean) or (method == "zscore" and not std):
        return None
    low, high = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) if method == "iqr" else (mean - 3 * std, mean + 3 * std)
    return (low, high) if high > low else None


def shaped(c: Column, step: Step) -> Column:
    """The value before anything is filled in or clipped."""
    if step.get("numeric"):
        c = fc.coerced(c, step.get("unit"))
    if step.get("normalise"):
        c = fc.normalised(c)
    if step.get("dates"):
        c = fc.parsed_date(c)
    if step.get("rare"):
        c = F.when(c.cast("string").isin(step["rare"]), F.lit(fc.RARE)).otherwise(c)
    elif step.get("rare_table"):
        c = F.when(F.col(_flag(step)).isNotNull(), F.lit(fc.RARE)).otherwise(c)
    return c


def _flag(step: Step) -> str:
    return "__rare_" + step["rare_table"].rsplit("/", 1)[-1]


def with_flags(df: DataFrame, steps: dict[str, Step]) -> DataFrame:
    """df with a column for each step whose rare values are a table: not NULL where the value is one of them."""
    for name, step in steps.items():
        if step.get("rare_table") and name in df.columns:
            key = shaped(fc.named(name), {k: v for k, v in step.items() if k != "rare_table"}).cast("string")
            listed = df.sparkSession.read.parquet(step["rare_table"]).select(F.col("value").alias(_flag(step)))
            df = df.join(listed, key == F.col(_flag(step)), "left")
    return df


def rare_step(spark, values: list[str]) -> Step:
    """The part of a step that holds rare values."""
    if len(values) <= MOST_RARE:
        return {"rare": list(values)}
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_mappings"
    path = f"{root.rstrip('/')}/rare-{uuid.uuid4().hex}"
    spark.createDataFrame([(v,) for v in values], "value string").write.parquet(path)
    return {"rare_table": path}


def filled(c: Column, step: Step) -> Column:
    return F.coalesce(c, F.lit(step["fill"])) if step.get("fill") is not None else c


def cleaned_columns(name: str, step: Step) -> list[Column]:
    """What a column becomes: nothing, itself, or itself and its indicator."""
    if step.get("drop"):
        return []
    before = shaped(fc.named(name), step)
    after = filled(before, step)
    if step.get("low") is not None:
        after = fc.clipped(fc.number(after), step["low"], step["high"])
    out = [after.alias(name)]
    if step.get("indicator"):
        out.append(before.isNull().alias(f"{name}_missing"))
    return out


def cleaned(df: DataFrame, steps: dict[str, Step], extra: list[Column] | None = None) -> DataFrame:
    """df as the steps say, columns without a step as they are; indicators come after the columns."""
    df = fc.without_nan(df)
    main, more = [], []
    names, df = df.columns, with_flags(df, steps)
    for c in names:
        first, *rest = cleaned_columns(c, steps.get(c, {})) or [None]
        main += [first] if first is not None else []
        more += rest
    return df.select(*main, *more, *(extra or []))


def run_cleaner(
    df: DataFrame,
    profiles: list[ColumnProfile],
    drop_threshold: float = 0.6,
    outlier_method: str = "iqr",
) -> tuple[DataFrame, list[ColumnProfile], list[ReportEntry], dict[str, Step]]:
    """The cleaned table without repeated rows, the profiles of the columns that stay, the decisions, and the steps."""
    if outlier_method not in METHODS:
        raise ValueError(f"outlier_method must be one of {METHODS}, got {outlier_method!r}")
    entries: list[ReportEntry] = []

    def log(column: str, action: str, rationale: str, severity: str = "info", before=None, after=None) -> None:
        entries.append(ReportEntry("cleaner", column, action, rationale, severity, before or {}, after or {}))

    steps: dict[str, Step] = {p.name: {} for p in profiles}
    kinds = {f.name: f.dataType for f in df.schema}
    total = df.count()
    distinct = drop_duplicates(fc.without_nan(df))
    once = distinct.persist()
    ready = None
    try:
        rows = once.count()
        if rows < total:
            log("*", "remove_duplicates", f"Removed {total - rows} repeated rows", before={"rows": total}, after={"rows": rows})
        kept: list[ColumnProfile] = []
        for p in profiles:
            if p.missing_rate > drop_threshold:
                why = f"{p.missing_rate:.2%} of the values are missing, more than {drop_threshold:.2%}"
            elif p.semantic_type is SemanticType.NUMERIC_ID:
                why = "It identifies rows"
            elif p.semantic_type is SemanticType.CONSTANT:
                why = "It has one value at most"
            else:
                kept.append(p)
                continue
            steps[p.name]["drop"] = True
            log(p.name, "drop_column", why, "warning")

        low = [p for p in kept if p.semantic_type is SemanticType.CATEGORICAL_LOW]
        high = [p for p in kept if p.semantic_type is SemanticType.CATEGORICAL_HIGH]
        numeric = [p for p in kept if p.semantic_type is SemanticType.NUMERIC_FEATURE]
        dates = [p for p in kept if p.semantic_type is SemanticType.DATETIME_STRING]
        texts = [p for p in numeric if fc.is_string(kinds[p.name])]
        coercions = find_coercions(once, [p.name for p in texts], [p.name for p in texts if repeats(p.cardinality, rows)])
        for p in low + high:
            if fc.is_string(kinds[p.name]):
                steps[p.name]["normalise"] = True
        for p in high:
            if p.rare_categories:
                steps[p.name] |= rare_step(df.sparkSession, p.rare_categories)
        for p in numeric:
            if p.name in coercions:
                steps[p.name] |= {"numeric": True, "unit": coercions[p.name].unit}
        numeric = [p for p in numeric if fc.is_numeric(kinds[p.name]) or p.name in coercions]
        for p in dates:
            if fc.is_string(kinds[p.name]):
                steps[p.name]["dates"] = True

        # what the passes look at, shaped once for all of them
        watched = low + high + numeric
        listed = [shaped(fc.named(p.name), steps[p.name]).alias(p.name) for p in watched]
        for i, p in enumerate(dates):
            if steps[p.name].get("dates"):
                c = fc.named(p.name)
                listed.append((c.isNotNull() & shaped(c, steps[p.name]).isNull()).alias(f"__unread{i}"))
        ready = with_flags(once, steps).select(*listed)
        if listed:
            ready.persist()
        # first pass: what is missing, and what to fill in
        asked = []
        for i, p in enumerate(watched):
            c = fc.named(p.name)
            asked.append(F.avg(c.isNull().cast("double")).alias(f"m{i}"))
            if p in numeric:
                asked.append(st.quantiles(fc.number(c), [0.5], rows).alias(f"f{i}"))
            elif p in low:
                asked.append(F.mode(c, deterministic=True).alias(f"f{i}"))
        for i, p in enumerate(dates):
            if steps[p.name].get("dates"):
                asked.append(F.count_if(F.col(f"__unread{i}")).alias(f"u{i}"))
        first = ready.agg(*asked).first().asDict() if asked else {}
        of = [i for i, p in enumerate(watched) if p in numeric]
        middles = [(fc.number(fc.named(watched[i].name)), [0.5]) for i in of]
        first |= {f"f{i}": q for i, q in zip(of, st.settled(ready, middles, [first[f"f{i}"] for i in of], rows))}
        rate = {p.name: first[f"m{i}"] or 0.0 for i, p in enumerate(watched)}
        fill = {}
        for i, p in enumerate(watched):
            value = first.get(f"f{i}")
            fill[p.name] = (value[0] if value else 0.0) if p in numeric else value
        for p in low + high:
            step, m = steps[p.name], rate[p.name]
            if step.get("normalise"):
                log(p.name, "normalize_categories", "Lower case, no white space at the ends")
            if p in high and (step.get("rare") or step.get("rare_table")):
                log(p.name, "group_rare_categories", f"Put {len(p.rare_categories)} rare values together")
            if m > 0 and p in low:
                step["indicator"] = True
                log(p.name, "add_missing_indicator", f"{m:.2%} of the values are missing", before={"missing_rate": m})
                if m < IMPUTE_BELOW and fill[p.name] is not None:
                    step["fill"] = fill[p.name]
                    log(p.name, "mode_impute", f"{m:.2%} missing, below 30%: the most frequent value", after={"value": fill[p.name]})
                elif fc.is_string(kinds[p.name]):
                    step["fill"] = fc.MISSING
                    log(p.name, "constant_fill", f"{m:.2%} missing, 30% or more: a value of its own", after={"value": fc.MISSING})
            elif m > 0 and fc.is_string(kinds[p.name]):
                step["fill"] = fc.MISSING
                log(p.name, "constant_fill", "Missing values of many categories: a value of its own", after={"value": fc.MISSING})
        for p in numeric:
            step, m = steps[p.name], rate[p.name]
            if step.get("numeric"):
                unit = step.get("unit")
                log(p.name, "coerce_numeric", "Text read as numbers" + (f" without the unit {unit!r}" if unit else ""))
            if m > 0:
                step["indicator"] = True
                log(p.name, "add_missing_indicator", f"{m:.2%} of the values are missing", before={"missing_rate": m})
                if m < IMPUTE_BELOW:
                    step["fill"] = float(fill[p.name])
                    log(p.name, "median_impute", f"{m:.2%} missing, below 30%: the median", after={"value": step["fill"]})

        # second pass: the spread of what is filled in; third: how many values the bounds change
        spread = [p for p in numeric if rate[p.name] <= CLIP_UP_TO]
        value = {p.name: fc.number(filled(fc.named(p.name), steps[p.name])) for p in numeric}
        asked = []
        for p in spread:
            asked += [st.quantiles(value[p.name], [0.25, 0.75], rows), F.avg(value[p.name]), F.stddev_samp(value[p.name])]
        second = ready.agg(*(e.alias(f"s{i}") for i, e in enumerate(asked))).first() if asked else []
        quarters = st.settled(ready, [(value[p.name], [0.25, 0.75]) for p in spread], list(second[::3]), rows)
        bounds = {}
        for i, p in enumerate(spread):
            q, (mean, std) = quarters[i], second[3 * i + 1 : 3 * i + 3]
            if q is None or q[0] == q[1]:
                bounds[p.name] = None
            else:
                bounds[p.name] = fences(outlier_method, q[0], q[1], mean, std)
        asked = [
            F.count_if(fc.outside(value[c], *b)).alias(f"c{i}") for i, (c, b) in enumerate(bounds.items()) if b is not None
        ]
        changes = iter(ready.agg(*asked).first() if asked else [])
        for p in numeric:
            if p.name not in bounds:
                log(p.name, "skip_winsorize", f"{rate[p.name]:.2%} of the values are missing, more than 30%", "warning")
            elif bounds[p.name] is None:
                log(p.name, "skip_winsorize", "The middle half of the values is one value: bounds would flatten the column")
            else:
                changed = next(changes)
                steps[p.name]["low"], steps[p.name]["high"] = bounds[p.name]
                if changed:
                    severity = "warning" if changed > CHANGED_WARNING * rows else "info"
                    log(
                        p.name, "winsorize_outliers", f"Brought {changed} outliers within bounds ({outlier_method})", severity,
                        after={"lower": bounds[p.name][0], "upper": bounds[p.name][1]},
                    )
        for i, p in enumerate(dates):
            if steps[p.name].get("dates"):
                lost = first.get(f"u{i}") or 0
                more = f"; {lost} values name no date and become missing" if lost else ""
                log(p.name, "coerce_datetime", "Text read as dates" + more, "warning" if lost > CHANGED_WARNING * rows else "info", after={"unread": lost})
    finally:
        if ready is not None:
            ready.unpersist()
        once.unpersist()
    return cleaned(distinct, steps), kept, entries, steps

