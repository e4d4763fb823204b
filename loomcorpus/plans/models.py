"""Queries over reduction, clustering and incremental runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcorpus.functions import vectors as V
from loomcorpus.operators import clustering, hierarchy, reduce
from loomcorpus.session import shared_folder
from loomcorpus.streaming import resume

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@_query
def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of variance that 10 and 50 components explain."""
    v = _vectors(spark, sf_dir).select("vec_id", "embedding")
    rows = [(k, *reduce.pca(v, "embedding", k)[1:]) for k in (10, 50)]
    return spark.createDataFrame([(k, round(e, 6), n) for k, e, n in rows], "asked int, explained double, components int")


@_query
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.pca(_vectors(spark, sf_dir).select("vec_id", "embedding"), "embedding", 10)[0].select("vec_id", "pca")


@_query
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.run(_vectors(spark, sf_dir), "vec_id", "embedding", method="kmeans", components=20, k=10).assignments


@_query
def hdbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of the table."""
    return clustering.run(_vectors(spark, sf_dir), "vec_id", "embedding", method="hdbscan", components=20, min_cluster_size=5, min_samples=3, selection="eom").assignments


@_query
def ward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of the table."""
    return clustering.run(_vectors(spark, sf_dir), "vec_id", "embedding", method="agglomerative", components=20, k=10).assignments


@_query
def umap_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of the table."""
    return clustering.run(_vectors(spark, sf_dir), "vec_id", "embedding", method="kmeans", components=20, k=10, layout=True).assignments


QUERY_IDS = "vec_id % 100 = 0"


@_query
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of the same label for a stated set of query vectors."""
    v = _vectors(spark, sf_dir)
    q = v.where(QUERY_IDS).select("label", F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = v.select("label", "vec_id", "embedding").join(q, "label").where("vec_id <> query_id")
    near = pairs.select("query_id", F.col("vec_id").alias("neighbour_id"), F.round(V.cosine(F.col("q"), F.col("embedding")), 6).alias("cosine"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "neighbour_id"))
    return near.withColumn("rank", rank).where("rank <= 5")


ORACLE["nearest_neighbours"] = f"""
WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS cosine
  FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.{QUERY_IDS}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, neighbour_id)::INT AS rank FROM p) SELECT * FROM r WHERE rank <= 5
"""


@_query
def hdbscan_core_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the third nearest other point of the label, for the query vectors."""
    v = _vectors(spark, sf_dir)
    q = v.where(QUERY_IDS).select("label", F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    d = v.select("label", "vec_id", "embedding").join(q, "label").where("vec_id <> query_id").select("query_id", "vec_id", F.sqrt(V.squared_distance(F.col("q"), F.col("embedding"))).alias("d"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("d", "vec_id"))
    return d.withColumn("n", rank).where("n = 3").select("query_id", F.round("d", 6).alias("core_distance"))


ORACLE["hdbscan_core_distance"] = f"""
WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, sqrt(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
  FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.{QUERY_IDS}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS n FROM p) SELECT query_id, round(d, 6) AS core_distance FROM r WHERE n = 3
"""


@_query
def hdbscan_core_distance_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every vector to its third nearest of all others."""
    return hierarchy.core_distance_table(_vectors(spark, sf_dir), "vec_id", "embedding", 3).withColumn("core_distance", F.round("core_distance", 6))


@_query
def resume_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written by a first run over the events and by a second one that finds nothing new."""
    base = shared_folder(spark)
    root = f"{base.rstrip('/')}/resume-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    schema = "event_id long, user_id long, event_type string"
    events.write.parquet(f"{root}/in")
    first = resume.process_new(spark, f"{root}/in", schema, f"{root}/out", f"{root}/state", lambda b: b)
    second = resume.process_new(spark, f"{root}/in", schema, f"{root}/out", f"{root}/state", lambda b: b)
    return spark.createDataFrame([(1, first), (2, second)], "run int, rows long")


ORACLE["resume_incremental"] = "SELECT 1::INT AS run, count(*) AS rows FROM events UNION ALL SELECT 2::INT, 0::BIGINT"
