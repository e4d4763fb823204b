"""The relational tables that link clusters and motifs back to items.

Motif -1 is noise and a group like any other. Every ordering is total: ties go to the smaller
group, then to the smaller item, then to the smaller cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcorpus.functions.text import basename, is_blank


def first_metadata(metadata: DataFrame, ordinal: str, path: str = "thumbnail_path") -> DataFrame:
    """One metadata row per image_id: the first in source order; rows without a path are dropped."""
    named = metadata.withColumn("image_id", basename(F.col(path))).where("image_id is not null")
    rank = F.row_number().over(W.partitionBy("image_id").orderBy(ordinal))
    return named.withColumn("__n", rank).where("__n = 1").drop("__n")


def cluster_assignments(results: DataFrame, metadata: DataFrame, ordinal: str, fields: tuple[str, ...] = ("title", "year", "categories", "thumbnail_path")) -> DataFrame:
    """Cluster results with the first metadata row of each item; unmatched fields are blank."""
    meta = first_metadata(metadata, ordinal).select("image_id", *fields, F.lit(True).alias("__met"))
    both = results.join(meta, "image_id", "left")
    blank = [F.when(F.col("__met"), F.col(c)).otherwise(F.lit("").cast(dict(meta.dtypes)[c]) if dict(meta.dtypes)[c] == "string" else F.lit(None)).alias(c) for c in fields]
    return both.select("image_id", *blank, *[c for c in results.columns if c != "image_id"])


def group_summary(df: DataFrame, group: str, digits: int) -> DataFrame:
    """(group, count, pct): the total is summed over the groups, not over the rows."""
    counts = df.groupBy(group).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("__total"))
    return counts.crossJoin(F.broadcast(total)).select(group, "count", F.round(100.0 * F.col("count") / F.col("__total"), digits).alias("pct"))


def motif_histogram(patches: DataFrame) -> DataFrame:
    """(image_id, motif_id, patch_count, patch_fraction); fractions of an image to four places."""
    counts = patches.groupBy("image_id", "motif_id").agg(F.count("*").alias("patch_count"))
    whole = F.sum("patch_count").over(W.partitionBy("image_id"))
    return counts.withColumn("patch_fraction", F.round(F.col("patch_count") / whole, 4))


def dominant_motif(histogram: DataFrame) -> DataFrame:
    """The motif with most patches of each image; ties go to the smaller motif."""
    best = F.max(F.struct("patch_count", (-F.col("motif_id")).alias("m"), "patch_fraction"))
    return histogram.groupBy("image_id").agg(best.alias("b")).select("image_id", (-F.col("b.m")).alias("dominant_motif_id"), "b.patch_count", "b.patch_fraction")


def dominant_with_metadata(histogram: DataFrame, metadata: DataFrame) -> DataFrame:
    return dominant_motif(histogram).join(metadata, "image_id", "left")


def best_patch(patches: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """The most probable cell of each (motif, image); ties by cell and then ``ties``."""
    key = F.struct((-F.col("motif_probability")).alias("p"), F.col("patch_row").alias("r"), F.col("patch_col").alias("c"), *[F.col(t) for t in ties])
    best = patches.groupBy("motif_id", "image_id").agg(F.min(key).alias("b"))
    return best.select("motif_id", "image_id", F.col("b.r").alias("best_patch_row"), F.col("b.c").alias("best_patch_col"), (-F.col("b.p")).alias("best_patch_probability"))


def _cells_by_image(patches: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, motif_id) with count, fraction, best cell and the image's smallest path, in one pass over the cells."""
    key = F.struct((-F.col("motif_probability")).alias("p"), F.col("patch_row").alias("r"), F.col("patch_col").alias("c"), *[F.col(t) for t in ties])
    path = F.min(F.when(~is_blank(F.col("thumbnail_path")), F.col("thumbnail_path")))
    both = patches.groupBy("image_id", "motif_id").agg(F.count("*").alias("patch_count"), F.min(key).alias("b"), path.alias("__path"))
    image = W.partitionBy("image_id")
    both = both.withColumn("patch_fraction", F.round(F.col("patch_count") / F.sum("patch_count").over(image), 4)).withColumn("__path", F.min("__path").over(image))
    return both.select("image_id", "motif_id", "patch_count", "patch_fraction", F.col("b.r").alias("best_patch_row"), F.col("b.c").alias("best_patch_col"), (-F.col("b.p")).alias("best_patch_probability"), "__path")


def _with_metadata(frame: DataFrame, metadata: DataFrame) -> DataFrame:
    both = frame.join(metadata, "image_id", "left")
    own = F.when(~is_blank(F.col("thumbnail_path")), F.col("thumbnail_path"))
    return both.withColumn("thumbnail_path", F.coalesce(own, "__path")).drop("__path")


def cell_links(patches: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Every (image, motif) with its count, fraction and best cell, without metadata."""
    return _cells_by_image(patches, ties).drop("__path")


def image_links(patches: DataFrame, metadata: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Every (motif, image) with metadata, its best cell and a path."""
    return _with_metadata(_cells_by_image(patches, ties), metadata)


def top_images(patches: DataFrame, metadata: DataFrame, n: int = 12, ties: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` images of each motif with the largest share; the cut comes before the join."""
    order = W.partitionBy("motif_id").orderBy(F.desc("patch_fraction"), F.desc("patch_count"), "image_id")
    top = _cells_by_image(patches, ties).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return _with_metadata(top, metadata)


def top_samples(assignments: DataFrame, n: int = 12, group: str = "cluster_id", score: str = "cluster_probability", ident: str = "image_id") -> DataFrame:
    """The ``n`` most probable items of each cluster."""
    order = W.partitionBy(group).orderBy(F.desc(score), ident)
    return assignments.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_patches(patches: DataFrame, n: int = 12, ties: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` most probable cells of each motif."""
    order = W.partitionBy("motif_id").orderBy(F.desc("motif_probability"), "image_id", "patch_row", "patch_col", *ties)
    return patches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def with_cells(frame: DataFrame) -> DataFrame:
    """Rows that name a cell; those whose place is null are skipped."""
    return frame.dropna(subset=["best_patch_row", "best_patch_col"])


def resolved_paths(items: DataFrame, known: DataFrame, listing: DataFrame | None = None, folder: str = "") -> DataFrame:
    """(image_id, thumbnail_path): the known path, else the name below ``folder`` if it is listed, else blank."""
    own = known.where(~is_blank(F.col("thumbnail_path"))).groupBy("image_id").agg(F.min("thumbnail_path").alias("__own"))
    out = items.select("image_id").distinct().join(own, "image_id", "left").withColumn("__want", F.concat(F.lit(folder.rstrip("/") + "/"), "image_id"))
    there = F.lit(None).cast("string")
    if listing is not None:
        out = out.join(listing.select(F.col("path").alias("__there")).distinct(), F.col("__want") == F.col("__there"), "left")
        there = F.col("__there")
    return out.select("image_id", F.coalesce("__own", there, F.lit("")).alias("thumbnail_path"))
