"""Whether listed files are usable, with the reason, and which path to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcorpus.functions.text import basename

MIN_BYTES = 4096
SIZE = (640, 360)


def large_enough(length: Column, min_bytes: int = MIN_BYTES) -> Column:
    return F.coalesce(length >= min_bytes, F.lit(False))


def validity(length: Column, width: Column | None = None, height: Column | None = None, error: Column | None = None, min_bytes: int = MIN_BYTES, stat_error: Column | None = None, size: tuple[int, int] = SIZE) -> Column:
    """``struct(ok, reason)``; the first of missing, no status, too small, unreadable, wrong size that applies."""
    no_status = F.lit(False) if stat_error is None else stat_error.isNotNull()
    reason = F.when(length.isNull() & ~no_status, F.lit("missing"))
    if stat_error is not None:
        reason = reason.when(no_status, F.concat(F.lit("stat_error:"), stat_error))
    reason = reason.when(length < min_bytes, F.concat(F.lit("too_small:"), length.cast("string"), F.lit("B")))
    if error is not None:
        reason = reason.when(error.isNotNull(), F.concat(F.lit("open_error:"), error))
    if width is not None and height is not None:
        unread = width.isNull() | height.isNull()
        reason = reason.when(unread, F.lit("open_error:no size")).when((width != size[0]) | (height != size[1]), F.concat(F.lit("unexpected_size:"), width.cast("string"), F.lit("x"), height.cast("string")))
    reason = reason.otherwise(F.lit("ok"))
    return F.struct((reason == "ok").alias("ok"), reason.alias("reason"))


def usable_paths(rows: DataFrame, listing: DataFrame, path: str, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Rows with ``image_id`` and ``usable_path``: the recorded path if its file is valid, else
    the same name below ``folder`` if that one is; rows with neither are dropped."""
    good = listing.where(large_enough(F.col("length"), min_bytes)).select("path").distinct()
    named = rows.withColumn("image_id", basename(F.col(path))).where("image_id is not null")
    named = named.withColumn("__second", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("image_id")))
    one = good.select(F.col("path").alias("__one"))
    two = good.select(F.col("path").alias("__two"))
    both = named.join(one, F.col(path) == F.col("__one"), "left").join(two, F.col("__second") == F.col("__two"), "left")
    return both.withColumn("usable_path", F.coalesce("__one", "__two")).where("usable_path is not null").drop("__one", "__two", "__second")
