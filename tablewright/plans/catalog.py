"""The registered queries over the driver's tables, and their SQL.

The tables are clean, so most queries first make them messy in a fixed way, by a CASE on the key; the SQL does the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import columns as fc
from ..operators import cleaning, encoding, features, profiling
from ..operators import stats as st
from ..report import missing_cells
from ..types import ColumnProfile, FeatureConfig, SemanticType
from ..validation import check_inputs, check_target, target_counts
from .model import PrepModel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def gaps(key: str, value: str, every: int = 7) -> Column:
    """The value, missing where the key is a multiple."""
    return F.when(F.col(key) % every == 0, F.lit(None)).otherwise(F.col(value))


def long_form(spark: SparkSession, values: dict[str, float | int | None], name: str, kind: str = "double") -> DataFrame:
    cast = float if kind == "double" else int
    return rows(spark, [(k, None if v is None else cast(v)) for k, v in values.items()], f"column_name string, {name} {kind}")


# The profiler

_GAPS = "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END"
_MANY = "CASE WHEN l_orderkey % 10 < 4 THEN NULL ELSE l_quantity END"


@query(f"""SELECT avg(CASE WHEN {_GAPS} IS NULL THEN 1.0 ELSE 0.0 END) AS price_missing,
 avg(CASE WHEN {_MANY} IS NULL THEN 1.0 ELSE 0.0 END) AS quantity_missing,
 avg(CASE WHEN l_tax IS NULL THEN 1.0 ELSE 0.0 END) AS tax_missing FROM lineitem""")
def profile_missing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = F.when(F.col("l_orderkey") % 10 < 4, F.lit(None)).otherwise(F.col("l_quantity"))
    df = table(spark, sf_dir, "lineitem").select(gaps("l_orderkey", "l_extendedprice").alias("price"), many.alias("quantity"), F.col("l_tax").alias("tax"))
    found = st.column_stats(df, df.columns, ())
    return rows(spark, [tuple(s.missing_rate for s in found.values())], "price_missing double, quantity_missing double, tax_missing double")


def _outlier_sql(name: str, column: str, source: str) -> str:
    return f"""SELECT '{name}' AS column_name, avg(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END) AS outlier_rate
 FROM (SELECT {column} AS v FROM {source}), (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source})"""


@query(" UNION ALL ".join(_outlier_sql(c, c, t) for c, t in (("l_extendedprice", "lineitem"), ("o_totalprice", "orders"), ("value", "events"))))
def profile_outlier_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out: dict[str, float | None] = {}
    for name, column in (("lineitem", "l_extendedprice"), ("orders", "o_totalprice"), ("events", "value")):
        df = table(spark, sf_dir, name).select(column)
        out |= st.outlier_rates(df, st.column_stats(df, [column], ("quartiles",)))
    return long_form(spark, out, "outlier_rate")


_LINEITEM = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
).split()


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique FROM lineitem" for c in _LINEITEM))
def profile_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = st.column_stats(table(spark, sf_dir, "lineitem"), _LINEITEM, ("distinct",))
    return long_form(spark, {c: s.distinct for c, s in found.items()}, "n_unique", "long")


_ODD = "CASE WHEN p_partkey % 250 = 0 THEN 'odd' ELSE p_type END"


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 250 == 0, F.lit("odd")).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


@query(f"""SELECT kind FROM (SELECT {_ODD} AS kind FROM part) GROUP BY kind
 HAVING count(*) < 0.01 * (SELECT count(*) FROM part)""")
def profile_rare_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = st.rare_values(_odd(spark, sf_dir), ["kind"])["kind"]
    return rows(spark, [(v,) for v in found], "kind string")


_NUMBERS = ("l_quantity", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(corr({c}, l_extendedprice), 6) AS r FROM lineitem" for c in _NUMBERS)
       + " UNION ALL SELECT 'always_one', CAST(NULL AS DOUBLE)")
def profile_target_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("always_one", F.lit(1))
    found = st.correlations(df, [*_NUMBERS, "always_one"], "l_extendedprice")
    return long_form(spark, {c: None if r is None else round(r, 6) for c, r in found.items()}, "r")


def _information_sql(x: str, y: str, source: str) -> str:
    return f"""WITH d AS (SELECT {x} AS x, {y} AS y FROM {source}), c AS (SELECT x, y, count(*) AS n FROM d GROUP BY x, y),
 a AS (SELECT x, count(*) AS nx FROM d GROUP BY x), b AS (SELECT y, count(*) AS ny FROM d GROUP BY y), t AS (SELECT count(*) AS nn FROM d)
 SELECT round(greatest(0.0, sum(n * 1.0 / nn * ln(n * 1.0 * nn / (nx * 1.0 * ny)))), 6) AS mutual_information FROM c JOIN a USING (x) JOIN b USING (y), t"""


def _information(spark: SparkSession, df: DataFrame, x: str, y: str) -> DataFrame:
    found = st.mutual_information(df, [x], y, st.column_stats(df, [x, y], ("distinct",)))
    return rows(spark, [(round(found[x], 6),)], "mutual_information double")


@query(_information_sql("l_returnflag", "l_linestatus", "lineitem"))
def profile_mutual_info_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _information(spark, table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus")


_CUTS = ", ".join(f"quantile_cont(o_totalprice, {i / 10}) AS q{i}" for i in range(1, 10))
_BIN = " + ".join(f"CAST(o_totalprice > q{i} AS INTEGER)" for i in range(1, 10))


@query(_information_sql(_BIN, "o_orderpriority", f"orders, (SELECT {_CUTS} FROM orders)"))
def profile_mutual_info_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderpriority")
    return _information(spark, df, "o_totalprice", "o_orderpriority")


@query("""SELECT 'leaky' AS column_name, abs(corr(l_extendedprice * 1.0000001 + l_linenumber * 0.001, l_extendedprice)) > 0.95 AS suspect FROM lineitem
 UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)) > 0.95 FROM lineitem""")
def profile_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaky = F.col("l_extendedprice") * 1.0000001 + F.col("l_linenumber") * 0.001
    df = table(spark, sf_dir, "lineitem").select(leaky.alias("leaky"), "l_tax", "l_extendedprice")
    found = st.correlations(df, ["leaky", "l_tax"], "l_extendedprice")
    return rows(spark, [(c, abs(r) > profiling.LEAKAGE) for c, r in found.items()], "column_name string, suspect boolean")


_SKEWED = "CASE WHEN o_orderkey % 40 = 0 THEN 'rare' ELSE 'usual' END"


@query(f"""SELECT 'o_orderstatus' AS column_name, round(max(n) * 1.0 / min(n), 6) AS ratio FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)
 UNION ALL SELECT 'skewed', round(max(n) * 1.0 / min(n), 6) FROM (SELECT count(*) AS n FROM orders GROUP BY {_SKEWED})""")
def profile_class_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    skewed = F.when(F.col("o_orderkey") % 40 == 0, "rare").otherwise("usual")
    df = table(spark, sf_dir, "orders").select("o_orderstatus", skewed.alias("skewed"))
    return long_form(spark, {c: round(st.imbalance(df, c), 6) for c in df.columns}, "ratio")


@query("""WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem)
 SELECT column_name, round(vif, 5) AS vif FROM (SELECT 'l_quantity' AS column_name, (1 - c * c) / (1 + 2 * a * b * c - a * a - b * b - c * c) AS vif FROM r
 UNION ALL SELECT 'l_extendedprice', (1 - b * b) / (1 + 2 * a * b * c - a * a - b * b - c * c) FROM r
 UNION ALL SELECT 'l_discount', (1 - a * a) / (1 + 2 * a * b * c - a * a - b * b - c * c) FROM r)""")
def profile_vif(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = st.variance_inflation(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return long_form(spark, {c: round(v, 5) for c, v in found.items()}, "vif")


_WORDS = r"len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))"


@query(f"SELECT round(avg(length(text)), 4) AS avg_length, round(avg({_WORDS}), 4) AS avg_words, avg(CASE WHEN text IS NULL THEN 1.0 ELSE 0.0 END) AS missing_rate FROM documents")
def profile_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = st.column_stats(table(spark, sf_dir, "documents").select("text"), ["text"], ("text",))["text"]
    return rows(spark, [(round(s.mean_length, 4), round(s.mean_words, 4), s.missing_rate)], "avg_length double, avg_words double, missing_rate double")


@query("""SELECT 'o_orderkey' AS column_name, CASE WHEN count(DISTINCT o_orderkey) >= 0.95 * count(*) THEN 'numeric_id' ELSE 'numeric_feature' END AS semantic_type FROM orders
 UNION ALL SELECT 'o_custkey', CASE WHEN count(DISTINCT o_custkey) >= 0.95 * count(*) THEN 'numeric_id' ELSE 'numeric_feature' END FROM orders
 UNION ALL SELECT 'o_orderstatus', CASE WHEN count(DISTINCT o_orderstatus) <= 1 THEN 'constant' WHEN count(DISTINCT o_orderstatus) = 2 THEN 'boolean' WHEN count(DISTINCT o_orderstatus) < 20 THEN 'categorical_low' ELSE 'categorical_high' END FROM orders
 UNION ALL SELECT 'o_orderpriority', CASE WHEN count(DISTINCT o_orderpriority) < 20 THEN 'categorical_low' ELSE 'categorical_high' END FROM orders
 UNION ALL SELECT 'o_totalprice', 'numeric_feature' UNION ALL SELECT 'o_orderdate', 'datetime_native'
 UNION ALL SELECT 'day_text', 'datetime_string' UNION ALL SELECT 'flag', 'boolean' UNION ALL SELECT 'same', 'constant'
 UNION ALL SELECT 'zip_code', 'categorical_high' UNION ALL SELECT 'note', 'text'""")
def profile_semantic_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumns({
        "day_text": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "flag": F.col("o_orderkey") % 2 == 0,
        "same": F.lit("x"),
        "zip_code": F.col("o_orderkey") % 500,
        "note": F.concat(F.lit("this order was placed by the customer with the number "), F.col("o_custkey").cast("string")),
    })
    stats = st.column_stats(df, df.columns)
    found = profiling.infer_types(df, stats, 20)
    return rows(spark, [(c, t.value) for c, t in found.items()], "column_name string, semantic_type string")


_UNIT = "CASE WHEN p_partkey % 50 = 0 THEN 'N/A' WHEN p_partkey % 3 = 0 THEN concat('  ', p_size, ' cc ') ELSE concat(p_size, ' CC') END"


@query(f"""SELECT p_partkey, CASE WHEN lower(t) = 'n/a' THEN NULL ELSE CAST(regexp_extract(t, '^([+-]?[0-9]+)', 1) AS DOUBLE) END AS size
 FROM (SELECT p_partkey, trim({_UNIT}) AS t FROM part)""")
def profile_numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        F.when(F.col("p_partkey") % 50 == 0, F.lit("N/A"))
        .when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), F.col("p_size").cast("string"), F.lit(" cc ")))
        .otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" CC")))
    )
    df = table(spark, sf_dir, "part").select("p_partkey", text.alias("size"))
    found = profiling.find_coercions(df, ["size"])["size"]
    return df.select("p_partkey", fc.coerced(F.col("size"), found.unit).alias("size"))


@query("SELECT count(*) AS n_rows, count(DISTINCT o_totalprice) AS n_unique, count(DISTINCT o_totalprice) > 20 AND count(DISTINCT o_totalprice) > 0.05 * count(*) AS looks_continuous FROM orders")
def target_task_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = (F.col("n_unique") > 20) & (F.col("n_unique") > 0.05 * F.col("n_rows"))
    return target_counts(table(spark, sf_dir, "orders"), "o_totalprice").select("n_rows", "n_unique", odd.alias("looks_continuous"))


# The cleaner


def _profile(name: str, kind: SemanticType, missing: float = 0.0, rare: list[str] | None = None) -> ColumnProfile:
    return ColumnProfile(name, kind, missing, "", rare_categories=rare)


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", gaps("l_orderkey", "l_extendedprice").alias("price"))


@query(f"SELECT l_orderkey, l_linenumber, {_GAPS} IS NULL AS price_missing FROM lineitem")
def clean_missing_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.cleaned(_priced(spark, sf_dir), {"price": {"indicator": True}}).drop("price")


@query(f"""SELECT l_orderkey, l_linenumber, coalesce({_GAPS}, (SELECT median({_GAPS}) FROM lineitem)) AS price FROM lineitem""")
def clean_median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _priced(spark, sf_dir)
    rows, price = df.count(), F.col("price")
    found = df.agg(st.quantiles(price, [0.5], rows)).first()[0]
    middle = st.settled(df, [(price, [0.5])], [found], rows)[0][0]
    return cleaning.cleaned(df, {"price": {"fill": middle}})


_SEGMENT = "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END"


@query(f"""SELECT c_custkey, coalesce({_SEGMENT}, (SELECT s FROM (SELECT {_SEGMENT} AS s FROM customer) WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)) AS segment FROM customer""")
def clean_mode_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", gaps("c_custkey", "c_mktsegment", 5).alias("segment"))
    usual = df.agg(F.mode("segment", deterministic=True)).first()[0]
    return cleaning.cleaned(df, {"segment": {"fill": usual}})


@query(f"SELECT c_custkey, coalesce({_SEGMENT}, '__missing__') AS segment FROM customer")
def clean_constant_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", gaps("c_custkey", "c_mktsegment", 5).alias("segment"))
    return cleaning.cleaned(df, {"segment": {"fill": fc.MISSING}})


@query("SELECT l_orderkey % 1000 AS k, l_quantity AS some FROM lineitem GROUP BY ALL")
def clean_drop_high_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mostly = F.when(F.col("l_orderkey") % 10 < 7, F.lit(None)).otherwise(F.col("l_tax"))
    df = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("k"), F.col("l_quantity").alias("some"), mostly.alias("mostly_missing"))
    rate = {c: s.missing_rate for c, s in st.column_stats(df, df.columns, ()).items()}
    profiles = [_profile(c, SemanticType.BOOLEAN, m) for c, m in rate.items()]
    out, _, _, _ = cleaning.run_cleaner(df, profiles, 0.6)
    return cleaning.drop_duplicates(out)


@query("SELECT DISTINCT l_orderkey % 100 AS a, l_returnflag AS b, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linestatus END AS c FROM lineitem")
def clean_drop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("a"), F.col("l_returnflag").alias("b"), F.when(F.col("l_linenumber") != 1, F.col("l_linestatus")).alias("c"))
    return cleaning.drop_duplicates(df)


def _winsorized(df: DataFrame, column: str, method: str) -> DataFrame:
    rows, points = df.count(), [0.25, 0.75]
    q, mean, std = df.agg(st.quantiles(F.col(column), points, rows), F.avg(column), F.stddev_samp(column)).first()
    (q,) = st.settled(df, [(F.col(column), points)], [q], rows)
    bounds = cleaning.fences(method, *q, mean, std) if q[0] != q[1] else None
    step = {"low": bounds[0], "high": bounds[1]} if bounds else {}
    return cleaning.cleaned(df, {column: step}).withColumn(column, F.round(column, 6))


@query(f"""WITH d AS (SELECT l_orderkey, l_linenumber, {_GAPS} AS price FROM lineitem), q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM d WHERE price IS NOT NULL)
 SELECT l_orderkey, l_linenumber, CASE WHEN price IS NOT NULL THEN round(least(greatest(price, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 6) END AS price FROM d, q""")
def clean_winsorize_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _winsorized(_priced(spark, sf_dir), "price", "iqr")


@query("""WITH q AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
 SELECT event_id, round(least(greatest(value, m - 3 * s), m + 3 * s), 6) AS value FROM events, q""")
def clean_winsorize_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _winsorized(table(spark, sf_dir, "events").select("event_id", "value"), "value", "zscore")


_FLAT = "CASE WHEN l_orderkey % 10 = 0 THEN l_extendedprice ELSE 5.0 END"


@query(f"SELECT l_orderkey, l_linenumber, round({_FLAT}, 6) AS flat FROM lineitem")
def clean_winsorize_zero_iqr_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.when(F.col("l_orderkey") % 10 == 0, F.col("l_extendedprice")).otherwise(F.lit(5.0))
    return _winsorized(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", flat.alias("flat")), "flat", "iqr")


@query(r"""SELECT c_custkey, lower(regexp_replace(CASE WHEN c_custkey % 3 = 0 THEN chr(9) || ' ' || upper(c_mktsegment) || '  ' WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END, '^\s+|\s+$', '', 'g')) AS segment FROM customer""")
def clean_normalize_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("\t "), F.upper("c_mktsegment"), F.lit("  "))).when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment"))
    df = table(spark, sf_dir, "customer").select("c_custkey", messy.alias("segment"))
    return cleaning.cleaned(df, {"segment": {"normalise": True}})


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def clean_string_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 13 == 0, F.lit("no date")).when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "MM/dd/yyyy"))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" "), F.date_format(d, "MMM d, yyyy"))).otherwise(F.date_format(d, "yyyy-MM-dd"))
    )
    out = cleaning.cleaned(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("day")), {"day": {"dates": True}})
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"""WITH d AS (SELECT p_partkey, {_ODD} AS kind FROM part), r AS (SELECT kind FROM d GROUP BY kind HAVING count(*) < 0.01 * (SELECT count(*) FROM d))
 SELECT p_partkey, CASE WHEN kind IN (SELECT kind FROM r) THEN '__rare__' ELSE kind END AS kind FROM d""")
def clean_group_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _odd(spark, sf_dir)
    return cleaning.cleaned(df, {"kind": {"rare": st.rare_values(df, ["kind"])["kind"]}})


# Encoders


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS priority FROM orders")
def encode_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    values = encoding.distinct_values(df, ["o_orderpriority"])["o_orderpriority"]
    return df.select("o_orderkey", encoding.ordinal(F.col("o_orderpriority"), values).cast("long").alias("priority"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(f = 'A', false) AS flag_A, coalesce(f = 'N', false) AS flag_N, coalesce(f = 'R', false) AS flag_R
 FROM (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_returnflag END AS f FROM lineitem)""")
def encode_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", gaps("l_orderkey", "l_returnflag").alias("flag"))
    values = encoding.distinct_values(df, ["flag"])["flag"]
    return df.select("l_orderkey", "l_linenumber", *encoding.one_hot(F.col("flag"), "flag", values))


@query("""WITH g AS (SELECT avg(l_extendedprice) AS m FROM lineitem), d AS (SELECT l_orderkey, l_linenumber, l_orderkey % 5 AS f, l_suppkey AS c, l_extendedprice AS y FROM lineitem),
 s AS (SELECT c, f, count(*) AS n, sum(y) AS t FROM d GROUP BY c, f), a AS (SELECT c, sum(n) AS n, sum(t) AS t FROM s GROUP BY c)
 SELECT l_orderkey, l_linenumber, round((a.t - s.t + 10 * m) / (a.n - s.n + 10), 4) AS encoded FROM d JOIN s USING (c, f) JOIN a USING (c), g""")
def encode_target_crossfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("encoded"), F.col("l_extendedprice").alias("y"))
    out = encoding.cross_fit(df, ["encoded"], F.col("y"), F.col("l_orderkey") % 5)
    return out.select("l_orderkey", "l_linenumber", F.round("encoded", 4).alias("encoded"))


@query("""WITH g AS (SELECT avg(l_extendedprice) AS m FROM lineitem)
 SELECT l_suppkey AS category, round((sum(l_extendedprice) + 10 * any_value(m)) / (count(*) + 10), 4) AS value FROM lineitem, g GROUP BY l_suppkey""")
def encode_target_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping, _ = encoding.target_mapping(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_extendedprice"))
    return mapping.select("category", F.round("value", 4).alias("value"))


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS label FROM orders")
def encode_target_string_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    index = encoding.label_index(encoding.distinct_values(df, ["o_orderstatus"])["o_orderstatus"])
    return df.select("o_orderkey", encoding.indexed(F.col("o_orderstatus"), index).alias("label"))


def _linear(df: DataFrame, column: str) -> Column:
    return F.round(encoding.linear(F.col(column), encoding.fit_linear(df, [column])[column]), 5).alias(column)


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 5) AS l_quantity FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem)")
def scale_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", _linear(df, "l_quantity"))


@query("""WITH a AS (SELECT avg(value) AS m FROM events), b AS (SELECT avg((value - m) ** 3) / avg((value - m) ** 2) ** 1.5 AS skew, min(value) AS low FROM events, a),
 d AS (SELECT event_id, CASE WHEN abs(skew) > 1 AND low > -1 THEN ln(1 + value) ELSE value END AS v FROM events, b), e AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM d)
 SELECT event_id, round((v - m) / s, 5) AS value FROM d, e""")
def skew_log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select("event_id", _linear(df, "value"))


def _date_sql(c: str) -> str:
    parts = {"year": f"year({c})", "month": f"month({c})", "day": f"day({c})", "dayofweek": f"isodow({c}) - 1", "hour": f"hour({c})"}
    return ", ".join(f"CAST({e} AS BIGINT) AS d_{k}" for k, e in parts.items()) + f", isodow({c}) >= 6 AS d_is_weekend"


@query(f"SELECT event_id, {_date_sql('ts')} FROM events")
def datetime_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "events").select("event_id", *encoding.date_parts(F.col("ts"), "d"))
    return out.select("event_id", *(F.col(f"d_{k}").cast("long") for k in ("year", "month", "day", "dayofweek", "hour")), "d_is_weekend")


# Added features


def _rounded(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) if c in names else F.col(c)).alias(c) for c in df.columns))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity / nullif(l_discount, 0), 6) AS l_quantity_div_l_discount,
 round(l_quantity * l_discount, 6) AS l_quantity_times_l_discount, round(l_quantity - l_discount, 6) AS l_quantity_minus_l_discount FROM lineitem""")
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.interactions(["l_quantity", "l_discount"], ["ratio", "product", "difference"])
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    names = [n for f in found for n in f["names"]]
    return _rounded(features.with_features(df, found), names).drop("l_quantity", "l_discount")


@query("""SELECT event_id, round(sin(2 * pi() * month(ts) / 12), 6) AS ts_month_sin, round(cos(2 * pi() * month(ts) / 12), 6) AS ts_month_cos,
 round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) AS ts_dayofweek_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) AS ts_dayofweek_cos, isodow(ts) >= 6 AS ts_is_weekend FROM events""")
def datetime_cyclical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.date_features(["ts"], FeatureConfig(datetime_cyclical=True))
    df = features.with_features(table(spark, sf_dir, "events").select("event_id", "ts"), found)
    return _rounded(df, found[0]["names"][:4]).drop("ts")


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    both = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    return both.select("l_orderkey", "l_linenumber", "o_orderdate", "l_shipdate")


_DAYS = "round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0, 6)"


@query(f"SELECT l_orderkey, l_linenumber, {_DAYS} AS o_orderdate_to_l_shipdate_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def datetime_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.date_features(["o_orderdate", "l_shipdate"], FeatureConfig(datetime_deltas=True))
    return _rounded(features.with_features(_ordered(spark, sf_dir), found), found[0]["names"]).drop("o_orderdate", "l_shipdate")


@query(f"SELECT l_orderkey, l_linenumber, {_DAYS} AS l_shipdate_days_since_ref FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def datetime_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.date_features(["o_orderdate", "l_shipdate"], FeatureConfig(datetime_reference_col="o_orderdate"))
    return _rounded(features.with_features(_ordered(spark, sf_dir), found), found[0]["names"]).drop("o_orderdate", "l_shipdate")


_CENTRES = [[10.0, 0.02], [25.0, 0.05], [40.0, 0.08]]
_DISTANCES = [f"sqrt((l_quantity - {a}) ** 2 + (l_discount - {b}) ** 2)" for a, b in _CENTRES]


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS cluster_label, round(least(a, b, c), 6) AS cluster_dist_to_centroid
 FROM (SELECT l_orderkey, l_linenumber, {', '.join(f'{d} AS {n}' for d, n in zip(_DISTANCES, 'abc'))} FROM lineitem)""")
def cluster_assign_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    frozen = {"kind": "cluster", "columns": ["l_quantity", "l_discount"], "centres": _CENTRES, "names": ["cluster_label", "cluster_dist_to_centroid"]}
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return _rounded(features.with_features(df, [frozen]), ["cluster_dist_to_centroid"]).drop("l_quantity", "l_discount")


@query()
def cluster_auto_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    found = features.fit_clusters(df, ["c_acctbal", "c_nationkey"], "auto")
    return features.with_features(df, [found]).groupBy("cluster_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cluster_dist_to_centroid"), 4).alias("mean_distance"))


@query(rf"""SELECT doc_id, CAST(length(t) AS INTEGER) AS text_char_length, CAST(len(list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS INTEGER) AS text_word_count,
 CAST(length(regexp_replace(t, '^\s+|\s+$', '', 'g')) > 0 AS INTEGER) AS text_has_text
 FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 19 = 0 THEN '  ' || chr(9) ELSE text END AS t FROM documents)""")
def text_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 17 == 0, F.lit(None)).when(F.col("doc_id") % 19 == 0, F.lit("  \t")).otherwise(F.col("text"))
    df = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return features.with_features(df, [features.text_feature("text")]).drop("text")


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS ts FROM documents), n AS (SELECT count(*) AS n FROM d),
 e AS (SELECT doc_id, unnest(ts) AS term FROM d), v AS (SELECT term, ln((1 + any_value(n)) * 1.0 / (1 + count(DISTINCT doc_id))) + 1 AS idf FROM e, n GROUP BY term ORDER BY count(*) DESC, term LIMIT 8),
 w AS (SELECT d.doc_id, v.term, len(list_filter(ts, lambda t: t = v.term)) * idf AS x FROM d, v), l AS (SELECT doc_id, sqrt(sum(x * x)) AS l FROM w GROUP BY doc_id)
 SELECT doc_id, term, round(CASE WHEN l > 0 THEN x / l ELSE 0 END, 6) AS weight FROM w JOIN l USING (doc_id)""")
def text_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = features.fit_tfidf(df, "text", 8)
    wide = features.with_features(df, [found])
    pairs = [F.struct(F.lit(t).alias("term"), F.round(fc.named(n), 6).alias("weight")) for (t, _), n in zip(found["terms"], found["names"])]
    return wide.select("doc_id", F.explode(F.array(*pairs)).alias("p")).select("doc_id", "p.term", "p.weight")


# Reports


def _small_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return joined.select("o_totalprice", gaps("o_orderkey", "c_acctbal").alias("c_acctbal"), "o_orderpriority", "o_orderstatus", "o_orderdate", F.col("c_nationkey").cast("string").alias("nation"))


@query()
def report_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.profile(_small_orders(spark, sf_dir), "o_totalprice", "regression").report.to_dataframe(spark)


@query("SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY o_orderstatus")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.class_counts(table(spark, sf_dir, "orders"), "o_orderstatus")


_MATRIX = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in _MATRIX for b in _MATRIX))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = st.correlation_matrix(table(spark, sf_dir, "lineitem"), list(_MATRIX))
    return rows(spark, [(a, b, round(float(found[i, j]), 6)) for i, a in enumerate(_MATRIX) for j, b in enumerate(_MATRIX)], "a string, b string, r double")


@query("SELECT CAST(l_orderkey % 7 = 0 AS INTEGER) AS price, CAST(l_orderkey % 3 = 0 AS INTEGER) AS tax, count(*) AS n FROM lineitem GROUP BY ALL")
def missingness_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(gaps("l_orderkey", "l_extendedprice").alias("price"), gaps("l_orderkey", "l_tax", 3).alias("tax"))
    return missing_cells(df, 2**31 - 1).groupBy("price", "tax").agg(F.count(F.lit(1)).alias("n"))


# Whole preparations

_PREPARED = f"""d AS (SELECT o_totalprice, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE c_acctbal END AS b, o_orderpriority AS p FROM orders JOIN customer ON o_custkey = c_custkey),
 f AS (SELECT b AS x, p AS pp, o_totalprice AS tt FROM d), u AS (SELECT DISTINCT x, pp FROM f), m AS (SELECT median(x) AS med FROM u),
 i AS (SELECT coalesce(x, med) AS y FROM u, m), q AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM i),
 c AS (SELECT tt AS o_totalprice, pp, least(greatest(coalesce(x, med), a - 1.5 * (b - a)), b + 1.5 * (b - a)) AS v, x IS NULL AS gone FROM f, m, q)"""


def _prepare_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _small_orders(spark, sf_dir).select("c_acctbal", "o_orderpriority", "o_totalprice")


@query(f"""WITH {_PREPARED} SELECT round(v, 4) AS c_acctbal, CAST(dense_rank() OVER (ORDER BY pp) - 1 AS INTEGER) AS o_orderpriority, gone AS c_acctbal_missing, o_totalprice FROM c""")
def prepare_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = api.prepare(_prepare_input(spark, sf_dir), "o_totalprice", "regression").df
    return _rounded(out, ["c_acctbal"], 4)


_ONE_HOT = ", ".join(f"lower(pp) = '{p}' AS \"o_orderpriority_{p}\"" for p in ("1-urgent", "2-high", "3-medium", "4-not specified", "5-low"))


@query(f"""WITH {_PREPARED}, k AS (SELECT DISTINCT v, pp, gone, o_totalprice FROM c), z AS (SELECT avg(v) AS mm, stddev_samp(v) AS ss FROM c)
 SELECT round((v - mm) / ss, 4) AS c_acctbal, {_ONE_HOT}, gone AS c_acctbal_missing, o_totalprice FROM c, z""")
def prepare_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = api.prepare(_prepare_input(spark, sf_dir), "o_totalprice", "regression", "linear").df
    return _rounded(out, ["c_acctbal"], 4)


@query("""WITH t AS (SELECT * FROM lineitem WHERE l_suppkey % 2 = 0 AND l_returnflag <> 'R'), g AS (SELECT avg(l_extendedprice) AS m FROM t),
 s AS (SELECT l_suppkey, round((sum(l_extendedprice) + 10 * any_value(m)) / (count(*) + 10), 4) AS e FROM t, g GROUP BY l_suppkey)
 SELECT l_orderkey, l_linenumber, coalesce(e, round(m, 4)) AS supplier, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE -1 END AS flag, l_linestatus = 'F' AS "status_F", l_linestatus = 'O' AS "status_O"
 FROM lineitem LEFT JOIN s USING (l_suppkey), g""")
def transform_unseen_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_extendedprice")
    seen = df.where((F.col("supplier") % 2 == 0) & (F.col("flag") != "R"))
    mapping, overall = encoding.target_mapping(seen, "supplier", F.col("l_extendedprice"))
    values = encoding.distinct_values(seen, ["flag", "status"])
    held = {str(r["category"]): r["value"] for r in mapping.collect()}
    model = PrepModel({
        "inputs": ["l_orderkey", "l_linenumber", "supplier", "flag", "status"], "target": "l_extendedprice", "clean": {}, "features": [],
        "engineer": {"supplier": {"kind": "target", "mapping": held, "default": overall}, "flag": {"kind": "ordinal", "values": values["flag"]}, "status": {"kind": "onehot", "values": values["status"]}},
        "outputs": ["l_orderkey", "l_linenumber", "supplier", "flag", "status_F", "status_O"],
    })
    return _rounded(model.transform(df.drop("l_extendedprice")), ["supplier"], 4)


def _values(columns: str, values: list[tuple]) -> str:
    """A table of fixed values as SQL."""
    listed = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in values)
    return f"SELECT * FROM (VALUES {listed}) AS t({columns})"


_PRIORITIES = ("1-urgent", "2-high", "3-medium", "4-not specified", "5-low")


@query(_values("kind, column_name", [
    ("columns_only_in_a", "o_orderpriority"), *(("columns_only_in_b", f"o_orderpriority_{p}") for p in _PRIORITIES),
    *(("columns_in_both", c) for c in ("c_acctbal", "c_acctbal_missing", "o_totalprice")),
    *(("decision_diff", c) for c in ("c_acctbal", "o_orderpriority")),
]))
def compare_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _prepare_input(spark, sf_dir)
    with st.held(df):
        a, b = (api.prepare(df, "o_totalprice", "regression", hint) for hint in ("tree", "linear"))
        found = api.compare(a, b)
    listed = [(k, c) for k in ("columns_only_in_a", "columns_only_in_b", "columns_in_both", "decision_diff") for c in found[k]]
    return rows(spark, listed, "kind string, column_name string")


# What the API refuses, logs and repeats


def _outcome(call) -> str:
    """How a call ends: the name of the exception, or that there is none."""
    try:
        return "warning" if call() else "none"
    except Exception as e:  # noqa: BLE001
        return type(e).__name__


_TARGETS = (
    ("orders", "o_totalprice", "classification"), ("orders", "o_totalprice", "regression"), ("orders", "o_orderpriority", "regression"),
    ("orders", "o_orderstatus", "classification"), ("lineitem", "l_linenumber", "regression"), ("lineitem", "l_linenumber", "classification"),
    ("customer", "c_nationkey", "classification"),
)


def _target_sql(source: str, column: str, task: str) -> str:
    text = column in ("o_orderpriority", "o_orderstatus")
    many = f"count(DISTINCT {column}) > 20"
    if task == "classification":
        case = "CASE WHEN count(*) > 0 THEN 'none' END" if text else f"CASE WHEN {many} AND count(DISTINCT {column}) > 0.05 * count(*) THEN 'ValueError' ELSE 'none' END"
    else:
        case = "CASE WHEN count(*) > 0 THEN 'warning' END" if text else f"CASE WHEN {many} THEN 'none' ELSE 'warning' END"
    return f"SELECT '{column}' AS target, '{task}' AS task, {case} AS outcome FROM {source}"


@query(" UNION ALL ".join(_target_sql(*t) for t in _TARGETS))
def validate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(c, task, _outcome(lambda: check_target(table(spark, sf_dir, t), c, task))) for t, c, task in _TARGETS]
    return rows(spark, found, "target string, task string, outcome string")


@query(_values("input, outcome", [
    ("no table", "TypeError"), ("no rows", "ValueError"), ("no such target", "ValueError"), ("one column", "ValueError"),
    ("names twice", "ValueError"), ("task", "ValueError"), ("model hint", "ValueError"), ("type of the target", "ValueError"),
    ("type of no column", "ValueError"), ("no type", "ValueError"), ("preset", "ValueError"), ("dry run", "TypeError"), ("nothing wrong", "none"),
]))
def validate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, y = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"), "o_orderstatus"
    check = lambda *a, **k: lambda: check_inputs(*a, **k)
    of = SemanticType.TEXT
    cases = {
        "no table": check([1], y, "classification"), "no rows": check(df.limit(0), y, "classification"),
        "no such target": check(df, "absent", "classification"), "one column": check(df.select(y), y, "classification"),
        "names twice": check(df.select("*", "o_custkey"), y, "classification"), "task": check(df, y, "ranking"),
        "model hint": check(df, y, "classification", "forest"), "type of the target": check(df, y, "classification", None, {y: of}),
        "type of no column": check(df, y, "classification", None, {"absent": of}),
        "no type": check(df, y, "classification", None, {"o_custkey": "text"}),
        "preset": lambda: api.prepare(df, y, preset="slow"), "dry run": lambda: api.prepare(df, y, dry_run="yes"),
        "nothing wrong": check(df, y, "classification", "tree", {"o_custkey": SemanticType.CATEGORICAL_HIGH}),
    }
    return rows(spark, [(name, _outcome(call)) for name, call in cases.items()], "input string, outcome string")


@query("SELECT lower(o_orderpriority) AS o_orderpriority, o_totalprice FROM orders")
def clean_drop_useless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that identify rows or never vary go; the types are those the profiler finds."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("x").alias("same"), "o_orderpriority", "o_totalprice")
    return api.clean(df, "o_totalprice", "regression").df


@query("""SELECT 'o_custkey' AS column_name, 'categorical_high' AS semantic_type UNION ALL SELECT 'o_orderdate', 'datetime_native'
 UNION ALL SELECT 'o_orderpriority', 'text' UNION ALL SELECT 'listed', NULL""")
def profile_override_and_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that the user sets, and a column of arrays, which is logged and not profiled."""
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice", F.array("o_orderkey").alias("listed"))
    types = {"o_custkey": SemanticType.CATEGORICAL_HIGH, "o_orderpriority": SemanticType.TEXT}
    profiles, entries = profiling.run_profiler(df, "o_totalprice", "regression", 20, types)
    flagged = [(e.column, None) for e in entries if e.action == "flagged_mixed_types"]
    return rows(spark, [(p.name, p.semantic_type.value) for p in profiles] + flagged, "column_name string, semantic_type string")


@query("""SELECT 'nation' AS column_name, 'coerce_numeric' AS action, 'info' AS severity FROM customer HAVING count(DISTINCT c_nationkey) < 0.95 * count(*)""")
def report_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = api.profile(_small_orders(spark, sf_dir), "o_totalprice", "regression").report
    return report.to_dataframe(spark).select(F.col("column").alias("column_name"), "action", "severity")


@query("""WITH d AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice END AS half FROM orders)
 SELECT 'summary_info' AS name, 0 AS n UNION ALL SELECT 'summary_warning', 2 UNION ALL SELECT 'summary_critical', 0 UNION ALL SELECT 'total_entries', 2
 UNION ALL SELECT 'by_column', 1 UNION ALL SELECT 'by_stage', 2 UNION ALL SELECT 'in_html', 1 FROM d HAVING avg(CASE WHEN half IS NULL THEN 1.0 ELSE 0.0 END) > 0.3""")
def report_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, half = table(spark, sf_dir, "orders"), F.when(F.col("o_orderkey") % 2 != 0, F.col("o_totalprice")).alias("half")
    df = orders.select(half, F.concat(F.lit("g"), F.col("o_custkey") % 30).alias("group"), "o_orderstatus")
    report = api.profile(df, "o_orderstatus").report
    held = report.to_dict()
    found = {f"summary_{k}": v for k, v in held["summary"].items()} | {
        "total_entries": held["total_entries"], "by_column": len(report.filter_by_column("half")),
        "by_stage": len(report.filter_by_stage("profiler")), "in_html": int("flagged_high_missingness" in report.to_html(False)),
    }
    return rows(spark, list(found.items()), "name string, n int")


@query(_values("column_name, action", [("note_char_length", "skipped_duplicate_feature"), ("note", "generate_text_features")]))
def feature_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat(F.lit("this order was placed by the customer with the number "), F.col("o_custkey").cast("string"))
    df = table(spark, sf_dir, "orders").select(note.alias("note"), (F.col("o_custkey") % 7).alias("note_char_length"), "o_totalprice")
    entries = api.engineer(df, "o_totalprice", "regression", feature_config=FeatureConfig(text_features=True)).report.entries
    return rows(spark, [(e.column, e.action) for e in entries if e.action in ("skipped_duplicate_feature", "generate_text_features")], "column_name string, action string")


def _differing(a: DataFrame, b: DataFrame) -> int:
    """How many rows of two tables with the same columns are in one of them only; both are counted in one shuffle."""
    b = b.select(*(fc.named(c) for c in a.columns))
    own = [fc.named(c) for c in a.columns]
    both = a.select(*own, F.lit(1).alias("__side")).unionAll(b.select(*own, F.lit(-1).alias("__side")))
    more = both.groupBy(*own).agg(F.abs(F.sum("__side")).alias("n"))
    return more.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


@query("SELECT count(*) AS n_rows, 0 AS n_differ, 4 AS n_added FROM orders JOIN customer ON o_custkey = c_custkey")
def add_features_and_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features added to a prepared table, and the same from the pipeline on the raw one. Of the five columns of cycles one
    has a name that the expanded date has taken."""
    df = _small_orders(spark, sf_dir).select("c_acctbal", "o_orderpriority", "o_orderdate", "o_totalprice")
    with st.held(df):
        result = api.prepare(df, "o_totalprice", "regression")
        more = api.add_features(result, FeatureConfig(datetime_cyclical=True))
        n, differ = more.df.count(), _differing(more.df, more.pipeline.transform(df))
    return rows(spark, [(n, differ, len(more.df.columns) - len(result.df.columns))], "n_rows long, n_differ int, n_added int")


@query("SELECT count(*) AS n_rows, 0 AS n_differ, 'NotFittedError' AS unfitted FROM orders JOIN customer ON o_custkey = c_custkey")
def pipeline_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _prepare_input(spark, sf_dir)
    with st.held(df):
        model = api.prepare(df, "o_totalprice", "regression", "linear").pipeline
        again, bare = PrepModel.from_json(model.to_json()).transform(df), df.drop("o_totalprice")
        differ = _differing(model.transform(df), again) + _differing(model.transform(bare), again.drop("o_totalprice"))
        n = again.count()
    return rows(spark, [(n, differ, _outcome(lambda: PrepModel().transform(df)))], "n_rows long, n_differ int, unfitted string")


@query("SELECT count(*) AS n_rows, 0 AS n_differ, true AS no_pipeline FROM orders JOIN customer ON o_custkey = c_custkey")
def prepare_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _prepare_input(spark, sf_dir)
    with st.held(df):
        result = api.prepare(df, "o_totalprice", "regression", preset="fast", dry_run=True)
        n, differ = result.df.count(), _differing(df, result.df)
    return rows(spark, [(n, differ, result.pipeline is None)], "n_rows long, n_differ int, no_pipeline boolean")


@query()
def prepare_thorough(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = FeatureConfig(interactions=True, datetime_cyclical=True, clustering=True, cluster_k=3)
    return api.prepare(_small_orders(spark, sf_dir), "o_totalprice", "regression", "linear", feature_config=config).df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
