"""Reading tables, and writing what a preparation gives."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..types import PrepResult

#: Spellings of a missing value in a CSV file (fixed values).
CSV_NA = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header. Types are inferred after spellings of missing values are taken for what they mean, in
    one more pass over the texts."""
    raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True)
    texts = raw.select(*(F.when(~fc.named(c).isin(*CSV_NA), fc.named(c)).alias(c) for c in raw.columns))
    asked = []
    for i, c in enumerate(texts.columns):
        col = fc.named(c)
        asked += [
            F.count(col).alias(f"n{i}"),
            F.count(F.when(col.rlike(r"^\s*[+-]?\d{1,18}\s*$"), 1)).alias(f"i{i}"),
            F.count(fc.stripped(col).try_cast("double")).alias(f"d{i}"),
            F.count(F.when(F.lower(col).isin("true", "false"), 1)).alias(f"b{i}"),
        ]
    found = texts.agg(*asked).first()
    out = []
    for i, c in enumerate(texts.columns):
        n, col = found[f"n{i}"], fc.named(c)
        if n and found[f"i{i}"] == n:
            col = fc.stripped(col).cast("long")
        elif found[f"d{i}"] == n:  # a column without any value is one of missing numbers
            col = fc.stripped(col).cast("double")
        elif found[f"b{i}"] == n:
            col = F.lower(col).cast("boolean")
        out.append(col.alias(c))
    return texts.select(*out)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path) if path.lower().endswith(".csv") else spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file, row by row through the driver: what the command line promises. Tables of any size go to Parquet."""
    import csv

    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f)
        writer.writerow(df.columns)
        for row in df.toLocalIterator(prefetchPartitions=True):
            writer.writerow("" if v is None else v for v in row)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_outputs(result: PrepResult, source: str, folder: str) -> dict[str, str]:
    """Table, pipeline and report, named after the source; what was written, by kind."""
    os.makedirs(folder, exist_ok=True)
    stem = os.path.join(folder, os.path.splitext(os.path.basename(source))[0])
    out = {"data": f"{stem}_prepared.csv"}
    write_csv(result.df, out["data"])
    if result.pipeline is not None:
        out["pipeline"] = f"{stem}_pipeline.json"
        result.pipeline.save(out["pipeline"])
    if result.report is not None:
        out["report"] = f"{stem}_report.json"
        with open(out["report"], "w", encoding="utf-8") as f:
            json.dump(result.report.to_dict(), f, indent=2)
    return out
