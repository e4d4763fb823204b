"""The clustering pipeline over a table of vectors: reduction, clusters, optional layout."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcorpus.operators import hierarchy, reduce
from loomcorpus.operators.nearest import over

METHODS = ("kmeans", "hdbscan", "agglomerative")


@dataclass
class Clusters:
    """``assignments`` by id, and what describes the run."""

    assignments: DataFrame
    pca_components: int
    explained: float
    clusters: int
    noise: int


def kmeans(df: DataFrame, vec: str, k: int, restarts: int = 10, seed: int = 42, out: str = "cluster_id") -> tuple[DataFrame, float]:
    """(df with cluster numbers, cost): the cheapest of several seeded runs."""
    if k < 2:
        raise ValueError("k must be 2 or more")
    data = df.withColumn("__v", array_to_vector(F.col(vec).cast("array<double>"))).cache()
    try:
        models = [KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol=out).fit(data) for i in range(restarts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        return best.transform(df.withColumn("__v", array_to_vector(F.col(vec).cast("array<double>")))).drop("__v"), float(best.summary.trainingCost)
    finally:
        data.unpersist()


def run(
    df: DataFrame, ident: str, vec: str, *, method: str = "hdbscan", components: int = 50, min_cluster_size: int = 3, min_samples: int = 1, selection: str = "leaf",
    k: int | None = None, seed: int = 42, layout: bool = False, neighbors: int = 15, min_dist: float = 0.1, limit: int | None = None,
) -> Clusters:
    """Reduces vectors and clusters them in the reduced space; the layout is for display only.

    k-means and PCA are distributed. The density and Ward methods and the layout hold the reduced
    vectors on the driver; what compares all with all runs on the executors, in blocks. A caller
    may set a ``limit`` to the items.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    if method in ("kmeans", "agglomerative") and (k is None or k < 2):
        raise ValueError("k must be 2 or more")
    reduced, explained, used = reduce.pca(df.select(ident, vec), vec, components)
    if method == "kmeans" and not layout:
        labelled, _ = kmeans(reduced, "pca", k, seed=seed)
        out = labelled.select(ident, F.col("cluster_id").cast("int").alias("cluster_id"), F.lit(1.0).alias("cluster_probability"), F.lit(0.0).alias("umap_x"), F.lit(0.0).alias("umap_y"))
        return Clusters(out, used, explained, k, 0)
    if limit is not None and (n := reduced.count()) > limit:
        raise ValueError(f"{n} items; asked for {limit} at most")
    if method == "kmeans":
        reduced = kmeans(reduced, "pca", k, seed=seed)[0]
    columns = [F.col("cluster_id").cast("int").alias("cluster_id")] if method == "kmeans" else []
    rows = reduced.select(ident, "pca", *columns).orderBy(ident).toArrow()
    ids = rows[ident].to_pylist()
    points = rows["pca"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
    each = over(df.sparkSession)
    if method == "hdbscan":
        labels, probabilities = hierarchy.hdbscan(points, min_cluster_size, min_samples, selection, limit, each)
    elif method == "agglomerative":
        labels, probabilities = hierarchy.ward(points, k, limit, each), np.ones(len(points))
    else:
        labels, probabilities = rows["cluster_id"].to_numpy(), np.ones(len(points))
    xy = reduce.umap_layout(points, neighbors, min_dist, seed=seed, limit=limit, each=each) if layout else np.zeros((len(points), 2))
    kind = dict(df.dtypes)[ident]
    data = list(zip(ids, labels.tolist(), probabilities.tolist(), *xy.T.tolist(), strict=True))
    out = df.sparkSession.createDataFrame(data, f"{ident} {kind}, cluster_id int, cluster_probability double, umap_x double, umap_y double")
    return Clusters(out, used, explained, len(set(labels.tolist()) - {-1}), int((np.asarray(labels) == -1).sum()))


def attach(frame: DataFrame, clusters: Clusters, ident: str) -> DataFrame:
    """Cluster columns joined by key to what they were made from."""
    return frame.join(clusters.assignments, ident)
