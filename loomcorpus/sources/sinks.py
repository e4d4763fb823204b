"""Writers: CSV, JSON records, logs, raw side files and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def json_records(df: DataFrame, path: str, partition: str | None = None) -> None:
    """One JSON object a row; characters outside ASCII are kept."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Adds JSON lines to a log."""
    df.write.mode("append").json(path)


def raw_failures(df: DataFrame, path: str, success: str = "success") -> None:
    """Raw model output of rows that could not be parsed, by id."""
    df.where(~F.col(success)).select("image_id", "raw_output").write.mode("append").parquet(path)


def archive(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a folder unless the target exists or the source does not; repeated calls are harmless."""
    jvm = spark._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(a) or fs.exists(b):
        return False
    fs.mkdirs(b.getParent())
    return bool(fs.rename(a, b))


def scatter_svg(points: DataFrame, path: str, title: str = "", limit: int = 20_000) -> dict[str, int]:
    """A scatter plot of (cluster_id, umap_x, umap_y) as SVG; noise is grey. Returns rows per group.

    Only for display: at most ``limit`` points are drawn, which the title then says; the counts
    are of all.
    """
    counts = {("noise" if r["cluster_id"] == -1 else str(r["cluster_id"])): r["count"] for r in points.groupBy("cluster_id").count().orderBy("cluster_id").collect()}
    rows = points.select("cluster_id", "umap_x", "umap_y").limit(limit).collect()
    if len(rows) < sum(counts.values()):
        title += f" ({len(rows)} of {sum(counts.values())} points drawn)"
    xs, ys = [r["umap_x"] for r in rows] or [0.0], [r["umap_y"] for r in rows] or [0.0]
    sx, sy = (max(xs) - min(xs)) or 1.0, (max(ys) - min(ys)) or 1.0
    dots = []
    for r in rows:
        colour = "#bbb" if r["cluster_id"] == -1 else f"hsl({r['cluster_id'] * 137 % 360},60%,45%)"
        dots.append(f'<circle cx="{20 + 760 * (r["umap_x"] - min(xs)) / sx:.1f}" cy="{40 + 540 * (r["umap_y"] - min(ys)) / sy:.1f}" r="2" fill="{colour}"/>')
    legend = "".join(f'<text x="810" y="{50 + 14 * i}" font-size="11">{k} (n={v})</text>' for i, (k, v) in enumerate(counts.items()))
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<svg xmlns="http://www.w3.org/2000/svg" width="960" height="{max(600, 80 + 14 * len(counts))}"><text x="20" y="20">{title}</text>{"".join(dots)}{legend}</svg>')
    return counts
