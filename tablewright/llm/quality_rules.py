"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` is the table: each row bounds ``100 * numerator / denominator`` or a plain count. ``measures`` is one
expression that gives all counts of a text, ``verdict`` turns the table into one boolean of them, so the whole operator
is one scan and one projection: no shuffle, no user function, and no state that grows with the table. Whatever several
counts share is bound to a variable inside the expression, so it is computed once wherever the optimizer moves it.

Defined results: a null or empty text has no words, so it fails; ties do not occur (rows are judged one by one);
repeated rows are judged alike; extra columns pass through untouched unless they carry the name of a measure, which
is then replaced in ``measure``'s output.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that ends a word, as a regular expression class body (fixed value).
SPACE = r"\x20\x09-\x0D"
#: Characters that count as symbols (fixed value).
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the corpus languages; prose holds many, tables, shouting and noise few.
STOP_WORDS = (
    "the of and to in is that it was for on are as with his they at be this from or an a by not "
    "le la les de des du et un une est que qui dans pour sur au en ne pas avec "
    "der die das und in zu den ist von mit ein eine nicht auf im sich "
    "el los las y del se por con no al lo como para su"
).split()


class Rule(NamedTuple):
    """``low <= 100 * top / bottom <= high``; a bound of None is open. ``bottom`` None: ``top`` itself is bounded."""

    name: str
    top: str
    bottom: str | None
    low: int | None
    high: int | None


BASE = (Rule("length", "n_words", None, 50, None), Rule("repeated words", "n_repeat_words", "n_words", None, 50))
RULES = (
    Rule("mean word length", "word_chars", "n_words", 300, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop words", "n_stop_words", "n_words", 6, None),
    Rule("duplicate lines", "n_dup_lines", "n_lines", None, 50),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")


def _bound(value: Column, then) -> Column:
    """Evaluates ``value`` once and hands it to ``then`` as a variable."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows found twice or more: windows are sorted with their places, equal neighbours mark a
    repeat, and one pass over the marked places adds up the words they cover. O(n log n) in a text's words."""

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["x"] == b["x"]) & (a["y"] == b["y"]) & (a["z"] == b["z"]), F.lit(False))

    def covered(windows: Column) -> Column:
        marked = F.filter(
            windows, lambda v, j: same(v, F.get(windows, j - 1)) | same(v, F.get(windows, j + 1))
        )
        places = F.sort_array(F.transform(marked, lambda v: v["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum"))
        return F.aggregate(
            places,
            start,
            lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(3), i - a["last"])).alias("sum")),
            lambda a: a["sum"],
        )

    def windows(w: Column) -> Column:
        return F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.struct(
                    F.get(w, i).alias("x"), F.get(w, i + 1).alias("y"), F.get(w, i + 2).alias("z"), i.alias("i")
                ),
            )
        )

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_bound(windows(words), covered))


def measures(text: Column) -> Column:
    """A struct with all MEASURES of a text."""
    body = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(body, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    listed = sorted({*STOP_WORDS, *(w.title() for w in STOP_WORDS)})

    def count(split: Column) -> Column:
        w, x = split["words"], split["lines"]
        counts = {
            "n_words": F.size(w),
            "word_chars": F.length(F.regexp_replace(body, f"[{SPACE}]+", "")),
            "n_symbols": F.length(body) - F.length(F.translate(body, SYMBOLS, "")),
            "n_lines": F.size(x),
            "n_dup_lines": F.size(x) - F.size(F.array_distinct(x)),
            "n_stop_words": F.size(F.filter(w, lambda v: v.isin(listed))),
            "n_repeat_words": repeated_words(w),
        }
        return F.struct(*(counts[m].cast("long").alias(m) for m in MEASURES))

    return _bound(F.struct(words.alias("words"), lines.alias("lines")), count)


def holds(rule: Rule, m: Column) -> Column:
    top = m[rule.top] if rule.bottom is None else 100 * m[rule.top]
    bottom = F.lit(1) if rule.bottom is None else m[rule.bottom]
    parts = [top >= rule.low * bottom] if rule.low is not None else []
    parts += [top <= rule.high * bottom] if rule.high is not None else []
    return reduce(and_, parts)


def verdict(rules: tuple[Rule, ...], m: Column) -> Column:
    """The table as one boolean of the measures."""
    return reduce(and_, (holds(r, m) for r in rules))


def quality_rules(df: DataFrame, text: str = "text", base=BASE, rules=RULES) -> DataFrame:
    """df with the measures (long), ``base_failed`` and ``kept``."""
    new = (*MEASURES, "base_failed", "kept")
    own = [F.col(f"`{c}`") for c in df.columns if c not in new]
    m = F.col("__measures")
    return df.select(*own, measures(F.col(f"`{text}`")).alias("__measures")).select(
        *own,
        *(m[x].alias(x) for x in MEASURES),
        (~verdict(base, m)).alias("base_failed"),
        (verdict(base, m) & verdict(rules, m)).alias("kept"),
    )


def keep(df: DataFrame, text: str = "text", base=BASE, rules=RULES) -> DataFrame:
    """The rows of df that pass, with df's own columns: one filter of one expression."""
    return df.where(_bound(measures(F.col(f"`{text}`")), lambda m: verdict(base, m) & verdict(rules, m)))
