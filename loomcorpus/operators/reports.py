"""Aggregate reports over states, logs and assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcorpus.functions.text import safe_share


def valid_rates(df: DataFrame, group: str, retrieved: Column, valid: Column) -> DataFrame:
    """Sampled, retrieved, placeholder and valid counts per group with a total row (null group)."""
    r, v = F.coalesce(retrieved, F.lit(False)), F.coalesce(retrieved & valid, F.lit(False))
    rows = df.select(F.col(group), r.alias("__r"), v.alias("__v")).rollup(group).agg(F.count("*").alias("sampled"), F.count_if("__r").alias("retrieved"), F.count_if("__v").alias("valid"), F.grouping(group).cast("int").alias("is_total"))
    rows = rows.withColumn("not_retrieved", F.col("sampled") - F.col("retrieved")).withColumn("placeholder", F.col("retrieved") - F.col("valid"))
    for c in ("not_retrieved", "placeholder", "valid"):
        rows = rows.withColumn(f"{c}_pct", F.round(safe_share(F.col(c), F.col("sampled")), 1))
    return rows


def annotation_stats(log: DataFrame, success: Column, seconds: Column) -> DataFrame:
    """(processed, ok, failed, elapsed, mean_seconds, ok_pct) of an annotation log; 0 without rows."""
    out = log.agg(F.count("*").alias("processed"), F.count_if(F.coalesce(success, F.lit(False))).alias("ok"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("__elapsed"))
    return out.select(
        "processed", "ok", (F.col("processed") - F.col("ok")).alias("failed"), F.round("__elapsed", 3).alias("elapsed"),
        F.round(safe_share(F.col("__elapsed"), F.col("processed"), 1.0), 3).alias("mean_seconds"), F.round(safe_share(F.col("ok"), F.col("processed")), 2).alias("ok_pct"),
    )


def tag_prevalence(df: DataFrame, year: str, tags: str) -> DataFrame:
    """(year, tag, items, share) of items that carry a tag, repeats in an item counted once."""
    totals = df.groupBy(year).agg(F.count("*").alias("__all"))
    tagged = df.select(year, F.explode(F.array_distinct(tags)).alias("tag")).groupBy(year, "tag").agg(F.count("*").alias("items"))
    return tagged.join(totals, year).select(year, "tag", "items", F.round(F.col("items") / F.col("__all"), 4).alias("share"))


def noise_stats(df: DataFrame, group: str) -> DataFrame:
    """(rows, groups, noise, noise_pct): groups without -1."""
    out = df.agg(F.count("*").alias("rows"), F.countDistinct(F.when(F.col(group) != -1, F.col(group))).alias("groups"), F.count_if(F.col(group) == -1).alias("noise"))
    return out.withColumn("noise_pct", F.round(safe_share(F.col("noise"), F.col("rows")), 1))
