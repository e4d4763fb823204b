"""Readers: lenient and strict CSV, file listings, run tables, prompts, manifests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcorpus.operators.images import header_size

EXTRA = "_extra"


def _with_extra(schema: str) -> T.StructType:
    return T.StructType([*T._parse_datatype_string(schema).fields, T.StructField(EXTRA, T.StringType())])


def csv(spark: SparkSession, path: str, schema: str, strict: bool = False, ordinal: str | None = None) -> DataFrame:
    """CSV with a header. Short lines are padded with nulls; lines that are too long are dropped,
    or raise an error if ``strict``. ``ordinal`` adds a column that grows in source order."""
    rows = spark.read.schema(_with_extra(schema)).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)
    if ordinal:
        rows = rows.withColumn(ordinal, F.monotonically_increasing_id())
    if strict:
        bad = F.raise_error(F.concat(F.lit("line with too many fields: "), F.coalesce(F.col(rows.columns[0]).cast("string"), F.lit(""))))
        return rows.where(F.when(F.col(EXTRA).isNotNull(), bad.cast("boolean")).otherwise(F.lit(True))).drop(EXTRA)
    return rows.where(F.col(EXTRA).isNull()).drop(EXTRA)


def listing(spark: SparkSession, folder: str, pattern: str = "*.jpg", recursive: bool = False, min_bytes: int = 0, ordered: bool = False) -> DataFrame:
    """(path, length) of files of ``min_bytes`` or more, by path if ``ordered``; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)
    found = files.select("path", "length").where(F.col("length") >= min_bytes)
    return found.orderBy("path") if ordered else found


def listing_with_sizes(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """(path, length, width, height): picture sizes from headers; null where unreadable."""

    @F.pandas_udf("width int, height int")
    def sizes(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header_size(c) or (None, None) for c in content], columns=["width", "height"]).astype("Int32")

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", sizes("content").alias("s")).select("path", "length", "s.width", "s.height")


def prompt(path: str | None, fallback: str, suffix: str = "") -> str:
    """Instruction text of a file, or the fallback where it is absent or empty, with a suffix."""
    text = ""
    if path:
        try:
            with open(path, encoding="utf-8") as f:
                text = f.read().strip()
        except FileNotFoundError:
            text = ""
    return (text or fallback) + suffix


def json_manifest(spark: SparkSession, path: str) -> dict:
    """A JSON object on any file system; empty where the file is absent."""
    import json

    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return {}
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0])
