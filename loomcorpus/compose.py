"""Whole runs, put together from the operators: acquisition, annotation, vectors, clusters, checks.

A run that calls a handed-in function works in parts. What a part gave is written before anything
else reads it, so that no answer is asked for twice, and after each part the state or a partial
record of the run is stored: a run that is cut off goes on where it stopped.
"""

from __future__ import annotations

import inspect
import json
import logging
import uuid
from collections.abc import Callable
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcorpus import schemas
from loomcorpus.functions import text as T
from loomcorpus.functions import vectors as V
from loomcorpus.operators import acquire, apply, checks, clustering, tables
from loomcorpus.sources import sinks
from loomcorpus.sources.runs import RunStore


def dual_log(name: str, path: str | None = None) -> logging.Logger:
    """A logger to the console and, with a path, to the end of a file; repeated calls add no handler."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    for kind, make in ((logging.StreamHandler, logging.StreamHandler), (logging.FileHandler, (lambda: logging.FileHandler(path, "a", "utf-8")) if path else None)):
        if make and not any(type(h) is kind for h in log.handlers):
            handler = make()
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
            log.addHandler(handler)
    return log


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _parts(rows: DataFrame, ident: str, every: int, path: str):
    """The rows, written once, in parts of about ``every``."""
    rows = _written(rows, path)
    n = -(-rows.count() // max(1, every))
    for k in range(n):
        yield rows.where(F.pmod(F.xxhash64(ident), F.lit(n)) == k)


class _Meta(HTMLParser):
    def __init__(self, name: str):
        super().__init__()
        self.name, self.found = name, None

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "meta" and given.get("property") == self.name and given.get("content") and self.found is None:
            self.found = given["content"]


def page_image(body: bytes) -> str | None:
    """The image that a page names for itself."""
    parser = _Meta("og:image")
    parser.feed(body.decode("utf-8", "replace"))
    return parser.found


class Acquisition:
    """Working frames below ``root``: each a snapshot of all rows with their state, the last one counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store, self.root = spark, RunStore(spark, root), root.rstrip("/")

    def _snapshots(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/state")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(p.getName() for p in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def state(self) -> DataFrame | None:
        """The last whole snapshot."""
        names = self._snapshots()
        return self.spark.read.parquet(f"{self.root}/state/{names[-1]}") if names else None

    def put(self, frame: DataFrame) -> DataFrame:
        names = self._snapshots()
        return _written(frame, f"{self.root}/state/{int(names[-1].split('-')[0]) + 1 if names else 0:08d}-{uuid.uuid4().hex[:8]}")

    def frame(self, incoming: DataFrame, listing: DataFrame, folder: str) -> tuple[DataFrame, int]:
        """The state, or the input where there is none, with new rows and with files that are there; rows changed.

        It is written back where anything changed.
        """
        old = self.state()
        merged = acquire.with_state(incoming) if old is None else acquire.merge_missing(old, incoming)
        found, flag = acquire.reconcile(merged, listing, T.local_path(folder, T.first_group(F.col("url"))))
        new = 0 if old is None else merged.count() - old.count()
        changed = found.where(flag).count() + new
        return (self.put(found.drop("reconciled")) if old is None or changed else old), changed

    def run(self, incoming: DataFrame, listing: DataFrame, folder: str, factory: Callable, every: int = 10, limit: int = 0, log: logging.Logger | None = None, delay: float = 0.0) -> dict:
        """Fetches what is left; returns the progress. Rows that are done or have no key are skipped."""
        log = log or dual_log("loomcorpus")
        frame, changed = self.frame(incoming, listing, folder)
        log.info("rows changed at the start: %d", changed)
        left = frame.withColumn("key", T.first_group(F.col("url"))).where("not coalesce(thumbnail_success, false) and key is not null").select("url", "key").distinct()
        left = left.orderBy("url").limit(limit) if limit else left
        work = f"{self.root}/work/{uuid.uuid4().hex}"
        for k, part in enumerate(_parts(left, "url", every, f"{work}/todo")):
            got = _written(apply.fetch(part, factory, page_image, delay=delay), f"{self.root}/fetched/{uuid.uuid4().hex}")
            news = got.where("success").select(F.col("url").alias("__url"), F.col("thumbnail_url").alias("__where"), T.local_path(folder, F.col("key")).alias("__path"))
            both = frame.join(news, F.col("url") == F.col("__url"), "left")
            both = both.withColumn("thumbnail_url", F.coalesce("__where", "thumbnail_url")).withColumn("thumbnail_path", F.coalesce("__path", "thumbnail_path"))
            frame = self.put(both.withColumn("thumbnail_success", F.col("__url").isNotNull() | F.coalesce("thumbnail_success", F.lit(False))).drop("__url", "__where", "__path"))
            now = acquire.progress(frame).first()
            log.info("part %d: %d of %d rows done, %.2f %%", k + 1, now["done"], now["rows"], now["done_pct"])
        return acquire.progress(frame).first().asDict()


def annotate(rows: DataFrame, factory: Callable, prompt: str, out: str, model: str = "", temperature: float = 0.0, every: int = 1000) -> DataFrame:
    """Answers for all rows, logged part by part; returns the log.

    Answers are logged as ``cut_raw`` has them, those that do not parse whole in a side table;
    model and temperature go to ``factory`` if it takes them.
    """
    made = (lambda: factory(model, temperature)) if len(inspect.signature(factory).parameters) == 2 else factory
    for part in _parts(rows.select("image_id", "title", "thumbnail_path"), "image_id", every, f"{out}/work/{uuid.uuid4().hex}"):
        said = _written(apply.annotate(part, made, prompt), f"{out}/answers/{uuid.uuid4().hex}")
        said = said.withColumn("annotation", T.json_object(F.col("raw_output")).cast("string")).withColumn("success", F.col("annotation").isNotNull())
        sinks.raw_failures(said, f"{out}/raw_failures")
        logged = said.withColumn("raw_output", T.cut_raw(F.col("raw_output"), F.col("request_error"))).join(part.select("image_id", "title", "thumbnail_path"), "image_id")
        sinks.append_log(logged.select("image_id", "title", "thumbnail_path", F.unix_timestamp().cast("double").alias("timestamp"), F.lit(model).alias("model"), "success", "annotation", "raw_output", "request_seconds"), f"{out}/log")
    path = f"{out}/log"
    return rows.sparkSession.read.schema(schemas.ANNOTATION_LOG).json(path) if RunStore(rows.sparkSession, out)._exists(path) else rows.sparkSession.createDataFrame([], schemas.ANNOTATION_LOG)


def extract(rows: DataFrame, store: RunStore, run: str, embed: Callable[[DataFrame], DataFrame], keep: list[str], every: int = 1000, params: dict | None = None) -> dict:
    """Vectors of all rows, stored part by part with a partial record after each; returns ok, failed and detail."""
    params = params or {}
    ok, failed = store.counts(run)
    attempts: list[DataFrame] = []
    for part in _parts(rows.select("image_id", "usable_path"), "image_id", every, f"{store.root}/work/{uuid.uuid4().hex}"):
        made = _written(embed(part), f"{store.root}/attempts/{run}/{uuid.uuid4().hex}")
        store.append(made.where("ok").select(*keep), run)
        good, bad = made.agg(F.count_if("ok"), F.count_if(~F.col("ok"))).first()
        ok, failed = ok + good, failed + bad
        attempts.append(made.select("image_id", "ok", "error", "seconds"))
        store.record(run, store.table, ok, failed, partial=True, params=params)
    detail: dict = {}
    if attempts:
        every_one = attempts[0]
        for more in attempts[1:]:
            every_one = every_one.unionByName(more)
        detail["timing"] = apply.timing(every_one).first().asDict() | {"human": every_one.agg(T.human_duration(F.sum("seconds"))).first()[0]}
    stored = store.rows(run)
    detail["sample_ids"] = [r["image_id"] for r in stored.select("image_id").orderBy("image_id").limit(5).collect()]
    vec = F.col("embedding") if "embedding" in stored.columns else F.get("patches", F.lit(0))["vec"]
    size = stored.select(F.size(vec).alias("n")).limit(1).collect()
    detail["dimension"] = size[0]["n"] if size else None
    store.record(run, store.table, ok, failed, params=params, detail=detail)
    return {"ok": ok, "failed": failed, "detail": detail}


def expected_dimension(store: RunStore, run: str, given: int | None = None) -> int | None:
    """A run's vector length: the one asked for, else that of its record, else that of its model."""
    last = store.runs().where((F.col("run_id") == run) & ~F.coalesce("partial", F.lit(False))).orderBy(F.desc("finished_at"))
    length = F.coalesce(F.lit(given).cast("int"), F.get_json_object("detail", "$.dimension").cast("int"), T.model_dimension(F.try_element_at("params", F.lit("model"))))
    found = last.select(length.alias("n")).first()
    return found["n"] if found else given


def cluster(rows: DataFrame, out: str, store: RunStore, run: str, metadata: DataFrame | None, ordinal: str = "__at", samples: int = 12, params: dict | None = None, **options):
    """Assignments with metadata, summary, samples and, with a layout, a plot; recorded as a run of its own."""
    found = clustering.run(rows, "image_id", "embedding", **options)
    given = found.assignments if metadata is None else tables.cluster_assignments(found.assignments, metadata, ordinal)
    given = _written(given, f"{out}/work/{uuid.uuid4().hex}")
    for name, df in (("assignments", given), ("summary", tables.group_summary(given, "cluster_id", 1).withColumn("label", T.group_label(F.col("cluster_id")))), ("samples", tables.top_samples(given, samples))):
        sinks.csv(df, f"{out}/{name}")
    if options.get("layout"):
        sinks.scatter_svg(given, f"{out.removeprefix('file://')}/layout.svg", f"{found.clusters} clusters")
    n = given.count()
    store.record(f"{run}-clusters", "clusters", n, 0, params=params, detail={"source": run, "clusters": found.clusters, "noise": found.noise, "explained": found.explained})
    return found


def cluster_patches(nested: DataFrame, out: str, store: RunStore, run: str, metadata: DataFrame, listing: DataFrame | None = None, folder: str = "", samples: int = 12, params: dict | None = None, **options):
    """All tables of the cells' clusters: cells, summary, histogram, dominant, links, top images and cells."""
    flat = apply.flat_patches(nested).withColumn("cell", F.concat_ws("|", "image_id", "patch_row", "patch_col"))
    found = clustering.run(flat, "cell", "vec", **options)
    cells = clustering.attach(flat.drop("vec"), found, "cell").select("image_id", "patch_row", "patch_col", F.col("cluster_id").alias("motif_id"), F.col("cluster_probability").alias("motif_probability"), "umap_x", "umap_y")
    paths = tables.resolved_paths(nested.select("image_id").distinct(), metadata, listing, folder)
    cells = _written(cells.join(paths, "image_id", "left"), f"{out}/work/{uuid.uuid4().hex}")
    histogram = tables.motif_histogram(cells)
    links = tables.image_links(cells, metadata)
    top = tables.top_images(cells, metadata, samples)
    made = {
        "patch_assignments": cells, "motif_summary": tables.group_summary(cells, "motif_id", 2), "histogram": histogram, "dominant": tables.dominant_with_metadata(histogram, metadata),
        "links": links, "top_images": top, "top_patches": tables.top_patches(cells, samples), "highlights": tables.with_cells(top),
    }
    for name, df in made.items():
        sinks.csv(df, f"{out}/{name}")
    store.record(f"{run}-motifs", "motifs", cells.count(), 0, params=params, detail={"source": run, "motifs": found.clusters, "noise": found.noise})
    return found


def check_patches(nested: DataFrame, dimension: int | None, pairs: int = 5, seed: int = 0) -> dict:
    """Counts, cell lists, lengths, norms and random pairs of a run's cells."""
    flat = apply.flat_patches(nested)
    done = checks.patch_count_stats(flat, "image_id").first().asDict()
    n, ids, uneven, outside = nested.agg(
        F.count("*"), F.countDistinct("image_id"), F.count_if(F.size(F.array_distinct(F.transform("patches", lambda p: F.struct(p["row"], p["col"])))) != F.size("patches")),
        F.count_if(F.exists("patches", lambda p: (p["row"] < 0) | (p["col"] < 0) | (p["row"] >= F.col("grid_shape.h")) | (p["col"] >= F.col("grid_shape.w")))),
    ).first()
    done |= {"rows": n, "ids": ids, "repeated_cells": uneven, "cells_outside": outside}
    done |= checks.norm_stats(flat, "vec").first().asDict()
    done["wrong_dim"] = flat.where(F.size("vec") != dimension).count() if dimension else 0
    cells = flat.withColumn("cell", F.concat_ws("|", "image_id", "patch_row", "patch_col"))
    done["pairs"] = [r.asDict() for r in checks.random_pairs(cells, "cell", "vec", pairs, seed).collect()]
    done["widest"] = [r.asDict() for r in checks.per_image_norms(flat, "image_id", "vec").orderBy(F.desc(F.col("max_norm") - F.col("min_norm")), "image_id").limit(5).collect()]
    done["finite_cells"] = flat.where(V.all_finite(F.col("vec"))).count()
    done["ok"] = n == ids and not (uneven or outside or done["wrong_dim"]) and done["finite_cells"] == done["patches"]
    return done


def manifest(store: RunStore, run: str) -> dict:
    """The newest record of a run, its detail parsed."""
    last = store.runs().where(F.col("run_id") == run).orderBy(F.desc("finished_at")).first()
    return (last.asDict() | {"detail": json.loads(last["detail"] or "{}")}) if last else {}
