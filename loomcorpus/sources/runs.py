"""Runs: vectors and what is known of each run, stored as partitions of two tables."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcorpus import schemas


class RunStore:
    """Tables ``runs`` and ``vectors`` (or another name) below ``root``."""

    def __init__(self, spark: SparkSession, root: str, table: str = "vectors", schema: str = schemas.VECTORS):
        self.spark, self.root, self.table, self.schema = spark, root.rstrip("/"), table, schema

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def runs(self) -> DataFrame:
        path = f"{self.root}/runs"
        return self.spark.read.schema(schemas.RUNS).json(path) if self._exists(path) else self.spark.createDataFrame([], schemas.RUNS)

    def rows(self, run_id: str | None = None) -> DataFrame:
        """Stored rows, of one run if named; a partition filter reads no other run."""
        path = f"{self.root}/{self.table}"
        all_ = self.spark.read.schema(self.schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], self.schema)
        return all_ if run_id is None else all_.where(F.col("run_id") == run_id)

    def append(self, df: DataFrame, run_id: str) -> None:
        df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{self.root}/{self.table}")

    def completed(self, run_id: str) -> DataFrame:
        """Ids that have rows in the run."""
        return self.rows(run_id).select("image_id").distinct()

    def record(self, run_id: str, kind: str, ok: int, failed: int, partial: bool = False, params: dict[str, str] | None = None, detail: dict | None = None) -> None:
        """Adds a row to ``runs``; the newest row of a run is the one that counts."""
        row = (run_id, kind, datetime.now(UTC).replace(tzinfo=None), partial, ok, failed, {k: str(v) for k, v in (params or {}).items()}, json.dumps(detail or {}, ensure_ascii=False))
        self.spark.createDataFrame([row], schemas.RUNS).write.mode("append").json(f"{self.root}/runs")

    def counts(self, run_id: str) -> tuple[int, int]:
        """(ok, failed) of the run's newest record; zeros where there is none."""
        last = self.runs().where(F.col("run_id") == run_id).orderBy(F.desc("finished_at")).select("ok", "failed").first()
        return (int(last["ok"]), int(last["failed"])) if last else (0, 0)

    def resolve(self, run_id: str | None = None, kind: str | None = None) -> str:
        """The named run, which must exist, or the one that finished last."""
        runs = self.runs() if kind is None else self.runs().where(F.col("kind") == kind)
        if run_id is not None:
            if runs.where(F.col("run_id") == run_id).isEmpty():
                raise FileNotFoundError(f"no run {run_id!r}")
            return run_id
        last = runs.orderBy(F.desc("finished_at"), F.desc("run_id")).select("run_id").first()
        if last is None:
            raise FileNotFoundError("no runs")
        return last["run_id"]

    def load(self, run_id: str | None = None) -> DataFrame:
        """The run's rows by id; it is an error if ids repeat or nothing is there."""
        run_id = self.resolve(run_id)
        rows = self.rows(run_id)
        n, ids = rows.agg(F.count("*"), F.countDistinct("image_id")).first()
        if not n:
            raise FileNotFoundError(f"run {run_id!r} has no rows")
        if n != ids:
            raise ValueError(f"run {run_id!r} has {n} rows for {ids} ids")
        return rows.orderBy("image_id")
