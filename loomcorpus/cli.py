"""Command line over the operators: ``python -m loomcorpus.cli COMMAND --help``."""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Sequence

from pyspark.sql import functions as F

from loomcorpus import compose, pictures, schemas
from loomcorpus.functions.text import utc_run_id
from loomcorpus.operators import acquire, apply, checks, reports, sampling, tables, validity
from loomcorpus.session import session
from loomcorpus.sources import files, sinks
from loomcorpus.sources.runs import RunStore


def _factory(name: str):
    """``package.module:function`` as the function; how fetchers and models are handed in."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomcorpus")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, **options) -> None:
        p = sub.add_parser(name)
        for key, value in options.items():
            flag = "--" + key.replace("_", "-")
            if isinstance(value, bool):
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, default=value if not isinstance(value, type) else None, type=value if isinstance(value, type) else (str if value is None else type(value)), required=isinstance(value, type))

    command("sample", input=str, output=str, per_year=2500, years=5, seed=42)
    command("scrape", input=str, root=str, listing=str, folder="thumbnails", factory=str, every=10, limit=0, delay=5.0, log=None)
    command("annotate", csv=str, listing=str, folder="thumbnails", out=str, factory=str, prompt=None, model="", temperature=0.0, every=1000, limit=0, force=False, dry_run=False)
    command("preview", folder=str, limit=10, seed=42, min_bytes=4096, output=None, decoder=None, include_placeholders=False)
    command("extract", csv=str, listing=str, folder="thumbnails", root=str, factory=str, limit=0, min_bytes=4096, every=1000, model="", force=False, dry_run=False, run_id=None)
    command("extract-patches", root=str, embeddings_run_id=str, csv=str, listing=str, folder="thumbnails", factory=str, patch_size=16, limit=0, min_bytes=4096, every=1000, model="", force=False, dry_run=False, run_id=None)
    command("cluster", root=str, run_id=None, out=str, metadata=None, method="hdbscan", pca=50, min_cluster_size=3, min_samples=1, selection="leaf", n_clusters=40, samples=12, seed=42, layout=False)
    command("cluster-patches", root=str, run_id=str, out=str, metadata=str, listing=None, folder="thumbnails", pca=50, min_cluster_size=30, min_samples=3, selection="eom", samples=12, seed=42, layout=False)
    command("check", root=str, run_id=None, dimension=0, pairs=5, seed=0)
    command("check-patches", root=str, run_id=str, dimension=0, pairs=5, seed=0)
    return top


def _todo(spark, a):
    rows = files.csv(spark, a.csv, schemas.METADATA + ", thumbnail_path STRING", ordinal="__at")
    listed = spark.read.schema("path STRING, length BIGINT").parquet(a.listing)
    return validity.usable_paths(rows, listed, "thumbnail_path", a.folder, getattr(a, "min_bytes", validity.MIN_BYTES))


def _metadata(spark, path: str):
    """Metadata rows in file order, with the year of those that have a date."""
    return files.csv(spark, path, schemas.METADATA + ", thumbnail_path STRING", ordinal="__at").withColumn("year", F.year(F.expr("try_to_date(date)")))


def _patches(spark, root: str) -> RunStore:
    return RunStore(spark, root, "patches", schemas.PATCHES + ", run_id STRING")


def _dry(rows) -> int:
    n = rows.count()
    for r in rows.select("image_id").orderBy("image_id").limit(10).collect():
        print(r["image_id"])
    if n > 10:
        print(f"... and {n - 10} more")
    return n


def main(argv: Sequence[str] | None = None) -> dict:
    """Runs a command; returns and prints what it did."""
    a = parser().parse_args(argv)
    spark = session()
    now = spark.range(1).select(utc_run_id()).first()[0]
    done: dict = {"command": a.command}
    if a.command == "sample":
        rows = sampling.latest_years(sampling.years(files.csv(spark, a.input, schemas.METADATA)), a.years)
        out = sampling.per_stratum(rows, "year", "url", a.per_year, a.seed).orderBy("year")
        sinks.csv(out, a.output)
        done |= {str(r["year"]): r["count"] for r in out.groupBy("year").count().orderBy("year").collect()}
    elif a.command == "annotate":
        log = f"{a.out}/log"
        store = RunStore(spark, a.out)
        old = spark.read.schema(schemas.ANNOTATION_LOG).json(log) if store._exists(log) else spark.createDataFrame([], schemas.ANNOTATION_LOG)
        rows = acquire.todo(_todo(spark, a), old.where("success"), "image_id", "__at", a.limit, a.force)
        if a.dry_run:
            done["todo"] = _dry(rows)
        else:
            logged = compose.annotate(rows, _factory(a.factory), files.prompt(a.prompt, "Describe the picture as JSON."), a.out, a.model, a.temperature, a.every)
            done |= reports.annotation_stats(logged, F.col("success"), F.col("request_seconds")).first().asDict()
    elif a.command == "preview":
        found = files.listing_with_sizes(spark, a.folder)
        judged = found.withColumn("v", validity.validity(F.col("length"), F.col("width"), F.col("height"), min_bytes=a.min_bytes))
        rows = sampling.uniform(judged if a.include_placeholders else judged.where("v.ok"), "path", a.limit, a.seed)
        done["pictures"] = [r.asDict(True) for r in rows.collect()]
        if a.output:
            contents = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(a.folder).join(rows.select("path"), "path", "left_semi")
            done["written"] = pictures.write(pictures.previews(contents, min_bytes=a.min_bytes, decoder=_factory(a.decoder) if a.decoder else None), a.output)
    elif a.command in ("extract", "extract-patches"):
        patches = a.command == "extract-patches"
        store = _patches(spark, a.root) if patches else RunStore(spark, a.root)
        run = a.run_id or now
        rows = _todo(spark, a)
        if patches:
            rows = rows.join(RunStore(spark, a.root).rows(a.embeddings_run_id).select("image_id"), "image_id", "left_semi")
        rows = acquire.todo(rows, store.completed(run), "image_id", "__at", a.limit, a.force)
        if a.dry_run:
            done["todo"] = _dry(rows)
        else:
            factory = _factory(a.factory)
            embed = (lambda part: apply.embed_patches(part, factory, patch_size=a.patch_size)) if patches else (lambda part: apply.embed(part, factory))
            keep = ["image_id", "grid_shape", "patch_size", "patches"] if patches else ["image_id", "embedding"]
            before = store.counts(run)
            made = compose.extract(rows, store, run, embed, keep, a.every, {k: v for k, v in vars(a).items() if v is not None})
            done |= {"run_id": run, "ok": made["ok"] - before[0], "failed": made["failed"] - before[1], "detail": made["detail"]}
    elif a.command == "scrape":
        rows = files.csv(spark, a.input, schemas.METADATA)
        listed = spark.read.schema("path STRING, length BIGINT").parquet(a.listing)
        done |= compose.Acquisition(spark, a.root).run(rows, listed, a.folder, _factory(a.factory), a.every, a.limit, compose.dual_log("loomcorpus.scrape", a.log), a.delay)
    elif a.command == "cluster":
        store = RunStore(spark, a.root)
        run = store.resolve(a.run_id, "vectors")
        meta = _metadata(spark, a.metadata) if a.metadata else None
        found = compose.cluster(
            store.load(run), a.out, store, run, meta, samples=a.samples, params=vars(a), method=a.method, components=a.pca, min_cluster_size=a.min_cluster_size,
            min_samples=a.min_samples, selection=a.selection, k=a.n_clusters, seed=a.seed, layout=a.layout,
        )
        done |= {"clusters": found.clusters, "noise": found.noise, "explained": round(found.explained, 4), "components": found.pca_components}
    elif a.command == "cluster-patches":
        store = _patches(spark, a.root)
        run = store.resolve(a.run_id, "patches")
        meta = tables.first_metadata(_metadata(spark, a.metadata), "__at").select("image_id", "title", "year", "categories", "thumbnail_path")
        listed = spark.read.schema("path STRING, length BIGINT").parquet(a.listing) if a.listing else None
        found = compose.cluster_patches(
            store.rows(run), a.out, store, run, meta, listed, a.folder, a.samples, vars(a), components=a.pca, min_cluster_size=a.min_cluster_size,
            min_samples=a.min_samples, selection=a.selection, seed=a.seed, layout=a.layout,
        )
        done |= {"motifs": found.clusters, "noise": found.noise}
    elif a.command == "check":
        store = RunStore(spark, a.root)
        run = store.resolve(a.run_id, "vectors")
        rows = store.load(run)
        done |= checks.vector_checks(rows, "image_id", "embedding", compose.expected_dimension(store, run, a.dimension or None) or 0).first().asDict() | checks.norm_stats(rows, "embedding").first().asDict()
        done["pairs"] = [r.asDict() for r in checks.random_pairs(rows, "image_id", "embedding", a.pairs, a.seed).collect()]
    else:
        store = _patches(spark, a.root)
        run = store.resolve(a.run_id, "patches")
        done |= compose.check_patches(store.rows(run), compose.expected_dimension(store, run, a.dimension or None), a.pairs, a.seed)
    print(json.dumps(done, default=str, ensure_ascii=False))
    return done


if __name__ == "__main__":
    main()
