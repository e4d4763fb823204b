"""Exact, reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shuffle_key(ident: Column, seed: int) -> Column:
    """A hash that orders rows at random, the same in every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}-"), ident.cast("string")).cast("binary"))


def years(df: DataFrame, date: str = "date", year: str = "year") -> DataFrame:
    """Adds the year of a date text; rows without a valid date are dropped."""
    kind = dict(df.dtypes)[date]
    day = F.col(date) if kind in ("date", "timestamp", "timestamp_ntz") else F.expr(f"try_to_date(`{date}`)")
    return df.withColumn(year, F.year(day).cast("int")).dropna(subset=[year])


def latest_years(df: DataFrame, n: int = 5, year: str = "year") -> DataFrame:
    """Rows of the newest year and the ``n - 1`` before it; the maximum is one row."""
    newest = df.agg(F.max(year).alias("__newest"))
    return df.join(F.broadcast(newest), F.col(year) > F.col("__newest") - n).drop("__newest")


def per_stratum(df: DataFrame, stratum: str, ident: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows of every stratum, or all of a smaller one, without replacement.

    The rank is cut before the shuffle too (a group limit in the plan), so a large stratum sends
    ``n`` rows from every task and not all it has.
    """
    order = W.partitionBy(stratum).orderBy(shuffle_key(F.col(ident), seed), F.col(ident))
    return df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def uniform(df: DataFrame, ident: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of the whole table."""
    return df.orderBy(shuffle_key(F.col(ident), seed), F.col(ident)).limit(n)
