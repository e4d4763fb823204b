"""What several operators share: written intermediate tables and connected components.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which all executors
and the driver see, so that a lost executor never costs more than the stage it was running.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcorpus.session import shared_folder


class Scratch:
    """Tables written under one private folder of the shared directory.

    They stay until ``drop`` is called: what is returned to a caller still reads them.
    """

    #: Those not dropped yet.
    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        Scratch.made.append(self)

    def drop(self) -> None:
        """Delete all tables of this folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if self in Scratch.made:
            Scratch.made.remove(self)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the written table: lineage ends here."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every id on an edge; component is the smallest id reachable.

    ``edges`` has long columns ``a`` and ``b``; null ends and loops are ignored, repeats are
    harmless. Every round each vertex points to its smallest neighbour if that is smaller,
    pointers are followed, and edges are contracted to the roots; every component that still
    has an edge at least halves its vertices. All steps are joins and partial aggregations on
    written tables, so a vertex with very many edges is met by skew-join splitting only and
    nothing is gathered on the driver but whether edges are left.
    """
    work = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    work = scratch.keep(work)
    rounds: list[DataFrame] = []
    while not work.isEmpty():
        both = work.union(work.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        hook = scratch.keep(hook)
        for _ in range(2):
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
            hook = hook.join(up, "p").select("a", F.col("q").alias("p"))
        hook = scratch.keep(hook)
        rounds.append(hook)
        left = hook.select("a", F.col("p").alias("x"))
        right = hook.select(F.col("a").alias("b"), F.col("p").alias("y"))
        work = scratch.keep(work.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return work.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = rounds[0].select(F.col("a").alias("id"), F.col("p").alias("component"))
    for hook in rounds[1:]:
        up = hook.select(F.col("a").alias("component"), "p")
        found = found.join(up, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
    return scratch.keep(found)
