"""Checks of stored vectors: lengths, finiteness, norms, counts, completeness and random pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcorpus.functions import vectors as V
from loomcorpus.operators.sampling import shuffle_key


def norm_stats(df: DataFrame, vec: str) -> DataFrame:
    """(vectors, finite, min_norm, max_norm, mean_norm)."""
    n = V.norm(F.col(vec))
    return df.agg(F.count("*").alias("vectors"), F.count_if(V.all_finite(F.col(vec))).alias("finite"), F.round(F.min(n), 6).alias("min_norm"), F.round(F.max(n), 6).alias("max_norm"), F.round(F.avg(n), 6).alias("mean_norm"))


def vector_checks(df: DataFrame, ident: str, vec: str, dimension: int) -> DataFrame:
    """(rows, ids, wrong_dim, not_finite, zero_norm, ok)."""
    out = df.agg(
        F.count("*").alias("rows"), F.countDistinct(ident).alias("ids"), F.count_if(F.coalesce(F.size(vec) != dimension, F.lit(True))).alias("wrong_dim"),
        F.count_if(~F.coalesce(V.all_finite(F.col(vec)), F.lit(False))).alias("not_finite"), F.count_if(V.norm(F.col(vec)) == 0).alias("zero_norm"),
    )
    return out.withColumn("ok", (F.col("rows") == F.col("ids")) & (F.col("wrong_dim") == 0) & (F.col("not_finite") == 0))


def patch_count_stats(df: DataFrame, ident: str) -> DataFrame:
    """(images, patches, min_patches, max_patches, mean_patches, median_patches) over images."""
    per = df.groupBy(ident).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("images"), F.sum("n").alias("patches"), F.min("n").alias("min_patches"), F.max("n").alias("max_patches"), F.round(F.avg("n"), 4).alias("mean_patches"), F.median("n").cast("int").alias("median_patches"))


def per_image_norms(df: DataFrame, ident: str, vec: str) -> DataFrame:
    n = V.norm(F.col(vec))
    return df.groupBy(ident).agg(F.round(F.min(n), 6).alias("min_norm"), F.round(F.max(n), 6).alias("max_norm"))


def missing(expected: DataFrame, stored: DataFrame, ident: str) -> DataFrame:
    """Ids that should have a vector and have none."""
    return expected.select(ident).distinct().join(stored.select(ident).distinct(), ident, "left_anti")


def random_pairs(df: DataFrame, ident: str, vec: str, pairs: int, seed: int = 0) -> DataFrame:
    """(left_id, right_id, cosine) of ``pairs`` random pairs without self-pairs or repeats.

    The first ``2 * pairs`` rows in hash order are paired in turn; only they are sorted at once.
    """
    picked = df.select(ident, vec).orderBy(shuffle_key(F.col(ident), seed), ident).limit(2 * pairs)
    place = F.row_number().over(W.orderBy(shuffle_key(F.col(ident), seed), ident)) - 1
    placed = picked.withColumn("__n", place).withColumn("__pair", F.floor(F.col("__n") / 2))
    a = placed.where("__n % 2 = 0").select("__pair", F.col(ident).alias("left_id"), F.col(vec).alias("__a"))
    b = placed.where("__n % 2 = 1").select("__pair", F.col(ident).alias("right_id"), F.col(vec).alias("__b"))
    return a.join(b, "__pair").select("left_id", "right_id", F.round(V.cosine(F.col("__a"), F.col("__b")), 6).alias("cosine"))
