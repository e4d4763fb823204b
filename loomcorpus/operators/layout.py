"""Image geometry as column expressions: letterboxes, content cells, grids and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def letterbox(df: DataFrame, width: str, height: str, target: Column) -> DataFrame:
    """Adds the square's side, the padding and the content bounds in target pixels.

    Halves are rounded to even, as pixel sizes are; floor division places the content.
    """
    side = F.greatest(F.col(width), F.col(height)).cast("int")
    df = df.withColumn("side", side).withColumn("new_w", F.col(width).cast("int")).withColumn("new_h", F.col(height).cast("int"))
    df = df.withColumn("pad_left", F.floor((F.col("side") - F.col("new_w")) / 2).cast("int")).withColumn("pad_top", F.floor((F.col("side") - F.col("new_h")) / 2).cast("int"))
    ratio = target.cast("double") / F.col("side")
    return df.withColumn("content_top", F.bround(F.col("pad_top") * ratio).cast("int")).withColumn("content_h", F.bround(F.col("new_h") * ratio).cast("int"))


def content_cells(df: DataFrame, target: Column, patch: Column) -> DataFrame:
    """One row per (patch_row, patch_col) whose row centre lies in the content; columns are not masked."""
    n = F.floor(target / patch).cast("int")
    rows = df.withColumn("__n", n).withColumn("patch_row", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    centre = (F.col("patch_row") + 0.5) * patch
    rows = rows.where((centre >= F.col("content_top")) & (centre < F.col("content_top") + F.col("content_h")))
    return rows.withColumn("patch_col", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")


def grid_places(df: DataFrame, group: str, rank: str, width: Column, height: int = 90, columns: int = 4) -> DataFrame:
    """Places of ranked pictures in a grid: a row's pictures stand side by side, left to right."""
    placed = df.withColumn("grid_row", F.floor((F.col(rank) - 1) / columns).cast("int")).withColumn("grid_col", ((F.col(rank) - 1) % columns).cast("int")).withColumn("pic_w", width.cast("int"))
    before = W.partitionBy(group, "grid_row").orderBy("grid_col").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("x", F.coalesce(F.sum("pic_w").over(before), F.lit(0)).cast("long")).withColumn("y", (F.col("grid_row") * height).cast("int"))


def cell_box(row: Column, col: Column, patch: int) -> list[Column]:
    """x0, y0, x1, y1 of a cell in target pixels."""
    return [(col * patch).cast("int").alias("x0"), (row * patch).cast("int").alias("y0"), ((col + 1) * patch).cast("int").alias("x1"), ((row + 1) * patch).cast("int").alias("y1")]


def fixed_places(x: Column, places: int) -> Column:
    """A number as text, rounded as C does: by the exact binary value, ties to even.

    The formats of Java round the shortest decimal text of a number instead, ties up.
    """
    scale, size = float(10**places), F.abs(x)
    # both parts have so few bits that their products with the scale are exact
    high = size * 134217729.0 - (size * 134217729.0 - size)
    whole = F.floor(high * scale).cast("double")
    over = (high * scale - whole - 0.5) + (size - high) * scale
    up = (over > 0) | ((over == 0) & (whole % 2 == 1))
    near = F.format_string(f"%.{places}f", (whole + up.cast("int")) / scale)
    # beyond that, and without a finite value, there is nothing to round or no room for it
    near = F.when(size < 2.0**40, near).otherwise(F.format_string(f"%.{places}f", size))
    return F.when(x.isNotNull(), F.concat(F.when(x < 0, "-").otherwise(""), near))


def preview_name(stem: Column, fraction: Column) -> Column:
    """File name that carries the fraction; ``na`` where there is none."""
    return F.concat(stem, F.lit("_"), F.coalesce(fixed_places(fraction, 3), F.lit("na")), F.lit(".jpg"))
