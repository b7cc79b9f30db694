"""Column expressions that the operators are made of. All of them stay inside the JVM."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import PandasUDFType

#: Spellings of a missing number in text (fixed values).
NA_TOKENS = ("", "nan", "none", "null", "na", "n/a", "-", "?")
#: A number with an optional unit behind it.
NUMBER = r"^([+-]?(?:\d{1,3}(?:,\d{3})+|\d+)?(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*([A-Za-z%°/²³$€£]*)$"
RARE, MISSING = "__rare__", "__missing__"
#: Forms that the JVM reads exactly as ``date_reader`` does; all others go through that.
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "M/d/yyyy", "MMM d, yyyy",
    "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy",
)


def named(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_string(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.VarcharType, T.CharType))


def is_bool(kind: T.DataType) -> bool:
    return isinstance(kind, T.BooleanType)


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_datetime(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_plain(kind: T.DataType) -> bool:
    """A kind of column that the engine works on; others are carried along."""
    return is_string(kind) or is_bool(kind) or is_numeric(kind) or is_datetime(kind)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL: there is one kind of missing value from here on."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(
        *((F.nanvl(named(c), F.lit(None)) if c in floats else named(c)).alias(c) for c in df.columns)
    )


def number(c: Column) -> Column:
    return c.cast("double")


def stripped(c: Column) -> Column:
    """Without white space at the ends (``trim`` takes off blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalised(c: Column) -> Column:
    return F.lower(stripped(c))


def words(c: Column) -> Column:
    """How many words a text has; 0 if it is blank, NULL if it is NULL."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")).cast("int")


def clipped(c: Column, low: float, high: float) -> Column:
    """c within bounds; NULL stays NULL (``least`` and ``greatest`` would turn it into a bound)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def outside(c: Column, low: Column | float, high: Column | float) -> Column:
    return (c < low) | (c > high)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over the rows where both are there; NULL where one of them does not vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, number(x)), F.when(both, number(y))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def part(c: Column, group: int) -> Column:
    return F.regexp_extract(stripped(c), NUMBER, group)


def is_na_token(c: Column) -> Column:
    return normalised(c).isin(*NA_TOKENS)


def plain_number(c: Column) -> Column:
    """The number at the beginning of a text that is a number with or without a unit, else NULL."""
    return F.regexp_replace(part(c, 1), ",", "").try_cast("double")


def coerced(c: Column, unit: str | None) -> Column:
    """The number in a text, NULL where there is none or where it has another unit."""
    fits = (part(c, 2) == "") | (F.lower(part(c, 2)) == F.lit((unit or "").lower()))
    return F.when(fits & ~is_na_token(c), plain_number(c))


def date_reader():
    """What reads a date, for the profiler that looks for dates and the cleaner that parses them alike: any usual form,
    with fractions, zones and short years, the month first where both are possible. Gives the time as text, with its
    zone if it has one; None for what is no date, and for a bare number, which could be read as one. Parts that a text
    does not name are those of 2000-01-01."""

    def read(text: str | None) -> str | None:
        from datetime import datetime

        from dateutil import parser

        if not text or text.strip().replace(".", "", 1).lstrip("+-").isdigit():
            return None
        try:
            found = parser.parse(text.strip(), default=datetime(2000, 1, 1))
            return found.isoformat(sep=" ")
        except (ValueError, OverflowError, TypeError, AttributeError):
            return None

    return read


def parsed_date(c: Column) -> Column:
    """The time that a text names, NULL if it names none. The usual forms are read in the JVM; only what is left goes
    through Python, in Arrow batches."""
    text = stripped(c)
    quick = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS))
    read = date_reader()  # a function of its own, so that workers need not find this package

    def read_all(texts):
        return texts.map(read, na_action="ignore").astype(object).where(texts.notna(), None)

    read_all.__annotations__ = {}
    slow = F.pandas_udf(read_all, T.StringType(), PandasUDFType.SCALAR)
    rest = F.when(quick.isNull() & text.rlike("[0-9A-Za-z]"), text)
    return F.coalesce(quick, slow(rest).try_cast("timestamp"))


def days_between(a: Column, b: Column) -> Column:
    """From a to b in days, with fractions."""
    micros = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    return micros.cast("double") / F.lit(86_400_000_000.0)


def cycle(c: Column, period: int) -> tuple[Column, Column]:
    angle = c.cast("double") * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def smoothed_mean(n: Column, total: Column, overall: Column, weight: float) -> Column:
    """A mean drawn to the overall one, the more so the fewer rows there are; the overall one for no rows."""
    return F.coalesce((total + F.lit(weight) * overall) / (n + F.lit(weight)), overall)
