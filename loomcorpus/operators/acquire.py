"""Acquisition state: what is known, what is new, what is on disk, what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = {"thumbnail_url": "string", "thumbnail_path": "string", "thumbnail_success": "boolean"}


def with_state(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Adds state columns that are missing: null texts, false flags."""
    for name, kind in (columns or STATE).items():
        if name not in df.columns:
            df = df.withColumn(name, (F.lit(False) if kind == "boolean" else F.lit(None)).cast(kind))
    return df


def merge_missing(state: DataFrame, incoming: DataFrame, key: str = "url") -> DataFrame:
    """State plus the incoming rows with an unknown key; a null key is known if state has one."""
    known = state.select(F.col(key).alias("__known")).distinct()
    new = incoming.join(known, F.col(key).eqNullSafe(F.col("__known")), "left_anti")
    return state.unionByName(with_state(new), allowMissingColumns=True)


def reconcile(state: DataFrame, listing: DataFrame, path: Column) -> tuple[DataFrame, Column]:
    """State where failed rows whose file exists are made successful, and the changed-row flag.

    ``listing`` has one row per ``path``; ``path`` is where a state row's file would be.
    """
    on_disk = listing.select(F.col("path").alias("__path")).distinct()
    done = F.coalesce(F.col("thumbnail_success"), F.lit(False))
    found = state.withColumn("__want", path).join(on_disk, F.col("__want") == F.col("__path"), "left")
    changed = ~done & F.col("__path").isNotNull()
    out = found.withColumn("reconciled", changed)
    out = out.withColumn("thumbnail_path", F.when(F.col("reconciled"), F.col("__want")).otherwise(F.col("thumbnail_path")))
    out = out.withColumn("thumbnail_success", F.col("reconciled") | done)
    return out.drop("__want", "__path"), F.col("reconciled")


def todo(rows: DataFrame, done: DataFrame, ident: str, order: str, limit: int | None = None, force: bool = False) -> DataFrame:
    """Rows without output. The limit comes first, so it may leave nothing to do; 0 and None mean all."""
    if limit:
        rows = rows.orderBy(order).limit(limit)
    return rows if force else rows.join(done.select(ident).distinct(), ident, "left_anti")


def accepted(status: Column, content_type: Column) -> Column:
    """Whether a response is a usable image."""
    return F.coalesce((status == 200) & F.lower(content_type).contains("image"), F.lit(False))


def progress(state: DataFrame) -> DataFrame:
    """(rows, done, remaining, done_pct) of the state."""
    done = F.count_if(F.coalesce("thumbnail_success", F.lit(False)))
    out = state.agg(F.count("*").alias("rows"), done.alias("done"))
    return out.select("rows", "done", (F.col("rows") - F.col("done")).alias("remaining"), F.round(F.coalesce(F.try_divide(100.0 * F.col("done"), F.col("rows").cast("double")), F.lit(0.0)), 2).alias("done_pct"))
