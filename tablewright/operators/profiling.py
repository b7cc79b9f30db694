"""The profiler: what each column is and what is remarkable about it."""

from __future__ import annotations

from contextlib import ExitStack
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..types import ColumnProfile, ReportEntry, SemanticType
from . import stats as st

MATCHING, COMMON_UNIT, MOST_UNITS = 0.95, 0.90, 5
MISSING_WARNING, LEAKAGE, IMBALANCE, UNIQUE = 0.30, 0.95, 10, 0.95
VIF_COLUMNS, SNIFFED, DATES = 50, 100, 0.90
REPEATED = 10
POSTAL, KEYS = ("zip", "postal", "postcode"), ("id", "pk", "index")


@dataclass
class Coercion:
    """A text column that holds numbers: their common unit, and whether they are whole."""

    unit: str | None
    whole: bool


def find_coercions(df: DataFrame, columns: list[str], repeated: list[str] = ()) -> dict[str, Coercion]:
    """Text columns of which 95 % of the values that say anything are numbers with at most one common unit. Of columns
    whose values are ``repeated`` each different value is looked at once, for all rows that hold it."""
    if not columns:
        return {}
    many = [c for c in columns if c in repeated]
    single = [c for c in columns if c not in many]
    values = st.frequencies(df, many) if many else None
    if single:
        own = [F.struct(F.lit(c).alias("name"), fc.named(c).alias("value"), F.lit(1).cast("long").alias("n")) for c in single]
        rest = df.select(F.explode(F.array(*own)).alias("x")).select("x.*").where("value IS NOT NULL")
        values = values.unionAll(rest) if many else rest
    text, n = F.col("value"), F.col("n")
    read = values.select("name", "n", "value", fc.is_na_token(text).alias("na"), fc.plain_number(text).alias("v"))
    says = ~F.col("na")
    value = F.when(says, F.col("v"))
    found = {r["name"]: r for r in read.groupBy("name").agg(
        F.sum(F.when(says, n).otherwise(0)).alias("says"),
        F.sum(F.when(value.isNotNull(), n).otherwise(0)).alias("numbers"),
        F.coalesce(F.bool_and(value == F.floor(value)), F.lit(False)).alias("whole"),
    ).collect()}
    likely = [c for c in columns if c in found and found[c]["says"] and found[c]["numbers"] >= MATCHING * found[c]["says"]]
    units: dict[str, list[tuple[str, int, int]]] = {c: [] for c in likely}
    if likely:
        unit = F.lower(fc.part(text, 2)).alias("u")
        counted = read.where(F.col("name").isin(*likely)).select("name", "n", unit, "v").where("v IS NOT NULL AND u <> ''")
        # of each column the most frequent units, one more than may be
        for r in counted.groupBy("name", "u").agg(F.sum("n").alias("count")).groupBy("name").agg(
            F.slice(F.sort_array(F.collect_list(F.struct("count", "u")), asc=False), 1, MOST_UNITS + 1).alias("top"),
            F.sum("count").alias("all"),
        ).collect():
            units[r["name"]] = [(t["u"], t["count"], r["all"]) for t in r["top"]]
    out = {}
    for c in likely:
        top = units[c]
        if top and (len(top) > MOST_UNITS or top[0][1] < COMMON_UNIT * top[0][2]):
            continue
        out[c] = Coercion(top[0][0] if top else None, found[c]["whole"])
    return out


def looks_like_text(s: st.ColumnStats) -> bool:
    return bool(s.present) and (s.mean_length > 50 or s.mean_length > 30 and s.mean_words >= 5)


def sniff_dates(df: DataFrame, columns: list[str]) -> set[str]:
    """Text columns of which a fixed sample of values reads as dates. The sample is those of least hash, so the same
    table gives the same answer."""
    found = set()
    if not columns:
        return found
    least = [
        df.where(fc.named(c).isNotNull())
        .select(F.lit(i).alias("i"), fc.named(c).alias("v"))
        .orderBy(F.xxhash64("v"), "v")
        .limit(SNIFFED)
        for i, c in enumerate(columns)
    ]
    every = least[0]
    for x in least[1:]:
        every = every.unionAll(x)
    values: dict[int, list[str]] = {}
    for r in every.collect():
        values.setdefault(r["i"], []).append(r["v"])
    read = fc.date_reader()
    return {columns[i] for i, vs in values.items() if sum(read(v) is not None for v in vs) > DATES * len(vs)}


def infer_type(
    s: st.ColumnStats, threshold: int, is_date: bool = False, is_monotonic: bool = False
) -> SemanticType:
    """The rules, in order."""
    name, kind = s.name.lower(), s.kind
    text = fc.is_string(kind)
    by_count = SemanticType.CATEGORICAL_LOW if s.distinct < threshold else SemanticType.CATEGORICAL_HIGH
    if text and looks_like_text(s):
        return SemanticType.TEXT
    if s.distinct <= 1:
        return SemanticType.CONSTANT
    if fc.is_bool(kind) or s.distinct == 2:
        return SemanticType.BOOLEAN
    if fc.is_datetime(kind):
        return SemanticType.DATETIME_NATIVE
    if fc.is_numeric(kind):
        if any(p in name for p in POSTAL):
            return by_count
        unique = s.distinct >= UNIQUE * s.rows
        if unique and (any(k in name for k in KEYS) or fc.is_integer(kind) and is_monotonic):
            return SemanticType.NUMERIC_ID
        return SemanticType.NUMERIC_FEATURE
    return SemanticType.DATETIME_STRING if text and is_date else by_count


def infer_types(df: DataFrame, stats: dict[str, st.ColumnStats], threshold: int) -> dict[str, SemanticType]:
    """The semantic types of columns with statistics; looks at the table only where the statistics do not decide."""
    first = {c: infer_type(s, threshold) for c, s in stats.items()}
    ordered = [
        c
        for c, s in stats.items()
        if first[c] is SemanticType.NUMERIC_FEATURE and fc.is_integer(s.kind) and s.distinct >= UNIQUE * s.rows
    ]
    dated = [
        c
        for c, s in stats.items()
        if fc.is_string(s.kind) and first[c] in (SemanticType.CATEGORICAL_LOW, SemanticType.CATEGORICAL_HIGH)
    ]
    rising, dates = st.monotonic(df, ordered), sniff_dates(df, dated)
    return {c: infer_type(s, threshold, c in dates, rising.get(c, False)) for c, s in stats.items()}


def repeats(distinct: int | None, rows: int) -> bool:
    """Whether the values of a column stand often enough to be counted before they are looked at."""
    return distinct is not None and REPEATED * distinct <= rows


def run_profiler(
    df: DataFrame,
    target: str,
    task: str = "classification",
    cardinality_threshold: int = 20,
    column_types: dict[str, SemanticType] | None = None,
) -> tuple[list[ColumnProfile], list[ReportEntry]]:
    """The profiles of all columns but the target, in order, and the decisions taken."""
    with ExitStack() as stack:
        return _profiled(stack, stack.enter_context(st.held(df)), target, task, cardinality_threshold, column_types)


def _profiled(
    stack: ExitStack, df: DataFrame, target: str, task: str, cardinality_threshold: int, column_types: dict[str, SemanticType] | None
) -> tuple[list[ColumnProfile], list[ReportEntry]]:
    entries: list[ReportEntry] = []

    def log(column: str, action: str, rationale: str, severity: str = "info", **after) -> None:
        entries.append(ReportEntry("profiler", column, action, rationale, severity, {}, after))

    df = fc.without_nan(df)
    kinds = {f.name: f.dataType for f in df.schema}
    features = [c for c in df.columns if c != target and fc.is_plain(kinds[c])]
    for c in df.columns:
        if not fc.is_plain(kinds[c]):
            log(c, "flagged_mixed_types", f"Columns of type {kinds[c].simpleString()} are carried along as they are", "warning")
    stats = st.column_stats(df, [*features, target])

    # texts that are numbers
    texts = [c for c in features if fc.is_string(kinds[c])]
    coercions = find_coercions(df, texts, [c for c in texts if repeats(stats[c].distinct, stats[c].present)])
    accepted, forced_ids = {}, set()
    unique = [c for c in coercions if stats[c].distinct >= UNIQUE * max(1, stats[c].present)]
    as_numbers = df.select(*(fc.coerced(fc.named(c), coercions[c].unit).alias(c) for c in unique)) if unique else None
    rising = st.monotonic(as_numbers, [c for c in unique if coercions[c].whole]) if unique else {}
    for c, k in coercions.items():
        how = f"without its unit {k.unit!r}" if k.unit else "without white space"
        if c in unique and (any(x in c.lower() for x in KEYS) or rising.get(c, False)):
            forced_ids.add(c)
            log(c, "coerce_numeric", f"Text read as a numeric ID, {how}", unit=k.unit)
        elif c in unique and k.whole and not k.unit:
            log(c, "skip_coerce", "Whole numbers that hardly repeat: kept as an identifier of high cardinality")
            continue
        else:
            log(c, "coerce_numeric", f"Text read as numbers, {how}", unit=k.unit)
        accepted[c] = k
    if accepted:
        df = df.select(
            *((fc.coerced(fc.named(c), accepted[c].unit) if c in accepted else fc.named(c)).alias(c) for c in df.columns)
        )
        stack.enter_context(st.held(df))  # texts are made numbers once, not in each pass
        stats |= st.column_stats(df, list(accepted))

    types = infer_types(df, {c: stats[c] for c in features}, cardinality_threshold)
    types |= {c: SemanticType.NUMERIC_ID for c in forced_ids if stats[c].distinct > 2}
    for c, forced in (column_types or {}).items():
        if c in types:
            log(c, "manual_semantic_type_override", f"{forced.name} was asked for instead of {types[c].name}", inferred=types[c].name)
            types[c] = forced

    numeric = [c for c in features if fc.is_numeric(stats[c].kind)]
    outliers = st.outlier_rates(df, {c: stats[c] for c in numeric})
    categorical = [c for c in features if types[c] in (SemanticType.CATEGORICAL_LOW, SemanticType.CATEGORICAL_HIGH)]
    rare = st.rare_values(df, categorical, fold=[c for c in categorical if fc.is_string(stats[c].kind)])
    target_is_number = fc.is_numeric(kinds[target]) or fc.is_bool(kinds[target])
    related = [c for c in features if types[c] in (SemanticType.NUMERIC_FEATURE, SemanticType.NUMERIC_ID) and c in numeric]
    r = st.correlations(df, related, target) if target_is_number else {}
    informed = [
        c for c in features if types[c] not in (SemanticType.CONSTANT, SemanticType.NUMERIC_ID, SemanticType.TEXT)
    ]
    if task == "regression" and not target_is_number:
        informed = []
    information = st.mutual_information(df, informed, target, stats)
    inflated = [c for c in numeric if types[c] is SemanticType.NUMERIC_FEATURE]
    if len(inflated) > VIF_COLUMNS:
        widest = sorted(inflated, key=lambda c: -(stats[c].variance or 0.0))[:VIF_COLUMNS]
        inflated = [c for c in inflated if c in widest]
        log(target, "capped_vif_computation", f"Variance inflation of the {VIF_COLUMNS} columns of largest variance", "warning")
    vif = st.variance_inflation(df, inflated)

    profiles = []
    for c in features:
        s, kind = stats[c], types[c]
        p = ColumnProfile(
            name=c,
            semantic_type=kind,
            missing_rate=s.missing_rate,
            dtype=s.kind.simpleString(),
            outlier_rate=outliers.get(c),
            cardinality=s.distinct,
            rare_categories=rare.get(c),
            vif_score=vif.get(c),
            correlation_with_target=r.get(c),
            mutual_info_with_target=information.get(c),
        )
        p.is_leakage_suspect = p.correlation_with_target is not None and abs(p.correlation_with_target) > LEAKAGE
        if p.missing_rate > MISSING_WARNING:
            log(c, "flagged_high_missingness", f"{p.missing_rate:.1%} of the values are missing", "warning")
        if kind is SemanticType.CATEGORICAL_HIGH:
            log(c, "flagged_high_cardinality", f"{s.distinct} values, at least {cardinality_threshold}", "warning")
        if p.is_leakage_suspect:
            log(c, "flagged_leakage_suspect", f"Correlation with the target of {p.correlation_with_target:.3f}", "critical")
        if kind is SemanticType.TEXT:
            p.text_avg_length, p.text_avg_word_count = s.mean_length or 0.0, s.mean_words or 0.0
            p.text_missing_rate = s.missing_rate
            log(c, "flagged_text_column", "Long texts of many words: only basic statistics are taken")
        profiles.append(p)
    if task == "classification" and (ratio := st.imbalance(df, target)) is not None and ratio > IMBALANCE:
        log(target, "flagged_class_imbalance", f"The largest class has {ratio:.1f} rows for each of the smallest", "warning")
    return profiles, entries
