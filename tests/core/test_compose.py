"""Composed runs, by the files they write."""

import csv
import glob
import json

import numpy as np
import pytest

from loomcorpus import cli, compose
from loomcorpus.operators import tables
from loomcorpus.sources.runs import RunStore


def site():
    """Answers for a few addresses: one by its key, one by its page, one never."""

    def get(url):
        if "viewkey=" not in url:
            if url.endswith("abcdefghi1"):
                return 200, "image/jpeg", b"one"
            if url == "http://cdn/two.jpg?a=1&b=2":
                return 200, "IMAGE/png", b"two"
            return 404, "text/html", b""
        if url.endswith("pagekey2"):
            return 200, "text/html", b"<meta property='og:image' content='http://cdn/two.jpg?a=1&amp;b=2'>"
        raise TimeoutError("slow")

    return get


def asker(model, temperature):
    def ask(prompt, ident, title):
        if ident == "3.jpg":
            raise RuntimeError("busy " + "x" * 3000)
        return '{"framing": "close"}' if ident != "4.jpg" else "no object " * 400

    return ask


def vector():
    def run(path):
        if path.endswith("/7.jpg"):
            raise ValueError("unreadable")
        n = int(path.split("/")[-1].split(".")[0])
        return [float(n % 2) * 10, float(n) / 100, 1.0]

    return run


def cells():
    def run(path):
        n = int(path.split("/")[-1].split(".")[0])
        rng = np.random.default_rng(n)
        return np.vstack([np.zeros((1, 4)), *(rng.normal((k % 2) * 8, 0.1, (1, 4)) for k in range(6))]), (3, 2), [0, 1]

    return run


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("runs")
    rows = [f"u{i},20{15 + i % 8}-01-01,t{i},c,d/{i}.jpg" for i in range(12)] + ["u0,2020-01-01,second,c,e/0.jpg"]
    (at / "m.csv").write_text("url,date,title,categories,thumbnail_path\n" + "\n".join(rows) + "\n")
    spark.createDataFrame([(f"d/{i}.jpg", 5000) for i in range(12)], "path string, length long").write.parquet(f"file://{at}/l")
    return at


def read(path):
    out = []
    for f in glob.glob(f"{path}/*.csv"):
        with open(f, newline="") as x:
            out += list(csv.DictReader(x))
    return out


def args(work, command, name, *more):
    return [command, "--csv", f"{work}/m.csv", "--listing", f"file://{work}/l", "--factory", f"tests.core.test_compose:{name}", *more]


def test_scrape(spark, tmp_path):
    pages = [("http://h/v?viewkey=abcdefghi1", "one"), ("http://h/v?viewkey=pagekey2", "two"), ("http://h/v?viewkey=never3", "three"), ("http://h/nokey", "four"), ("http://h/v?viewkey=ondisk4", "five")]
    (tmp_path / "in.csv").write_text("url,date,title,categories\n" + "".join(f"{u},2020-01-01,{t},c\n" for u, t in pages))
    spark.createDataFrame([("pics/ondisk4.jpg", 9)], "path string, length long").write.parquet(f"file://{tmp_path}/l")
    run = ["scrape", "--input", f"{tmp_path}/in.csv", "--root", f"file://{tmp_path}/s", "--listing", f"file://{tmp_path}/l", "--folder", "pics", "--factory", "tests.core.test_compose:site", "--every", "2", "--delay", "0.01", "--log", f"{tmp_path}/log.txt"]
    # the key has no path of its own at this site: the address of the picture is made of the key alone
    done = cli.main(run)
    assert (done["rows"], done["done"], done["remaining"]) == (5, 3, 2)
    frame = {r.title: r for r in compose.Acquisition(spark, f"file://{tmp_path}/s").state().collect()}
    assert frame["five"].thumbnail_path == "pics/ondisk4.jpg" and frame["two"].thumbnail_url == "http://cdn/two.jpg?a=1&b=2" and not frame["three"].thumbnail_success
    with open(tmp_path / "in.csv", "a") as f:
        f.write("http://h/v?viewkey=new5,2021-01-01,six,c\n")
    again = cli.main(run)
    assert (again["rows"], again["done"]) == (6, 3)
    assert spark.read.parquet(*glob.glob(f"{tmp_path}/s/fetched/*")).where("success").count() == 2
    assert "rows done" in (tmp_path / "log.txt").read_text()


def test_annotate(spark, work):
    run = args(work, "annotate", "asker", "--out", f"file://{work}/a", "--model", "m1", "--temperature", "0.5", "--every", "5")
    done = cli.main(run)
    log = {r["image_id"]: r for f in glob.glob(f"{work}/a/log/*.json") for r in map(json.loads, open(f))}
    assert len(log) == 12 and sum(r["success"] for r in log.values()) == 10 and {r["model"] for r in log.values()} == {"m1"}
    assert len(log["4.jpg"]["raw_output"]) == 2000 and len(log["3.jpg"]["raw_output"]) > 3000
    side = {r.image_id: r.raw_output for r in spark.read.parquet(f"file://{work}/a/raw_failures").collect()}
    assert set(side) == {"3.jpg", "4.jpg"} and len(side["4.jpg"]) == 4000
    assert done["command"] == "annotate"


def test_vectors_and_their_clusters(spark, work):
    run = args(work, "extract", "vector", "--root", f"file://{work}/r", "--run-id", "one", "--every", "4", "--model", "vitb16")
    done = cli.main(run)
    store = RunStore(spark, f"file://{work}/r")
    assert (done["ok"], done["failed"]) == (11, 1) and cli.main(run)["ok"] == 0
    records = store.runs().where("run_id = 'one'").collect()
    assert sum(r.partial for r in records) >= 3 and not compose.manifest(store, "one")["partial"]
    assert done["detail"]["sample_ids"] == ["0.jpg", "1.jpg", "10.jpg", "11.jpg", "2.jpg"] and done["detail"]["dimension"] == 3 and done["detail"]["timing"]["ok"] == 11
    assert cli.main(["check", "--root", f"file://{work}/r"])["ok"] and not cli.main(["check", "--root", f"file://{work}/r", "--dimension", "4"])["ok"]
    out = cli.main(["cluster", "--root", f"file://{work}/r", "--out", f"file://{work}/c", "--metadata", f"{work}/m.csv", "--method", "kmeans", "--n-clusters", "2", "--pca", "2", "--samples", "3"])
    assert out["clusters"] == 2
    rows = {r["image_id"]: r for r in read(work / "c/assignments")}
    assert len(rows) == 11 and rows["0.jpg"]["title"] == "t0" and rows["1.jpg"]["year"] == "2016"
    assert len(read(work / "c/samples")) == 6 and {r["label"] for r in read(work / "c/summary")} == {"0", "1"}
    assert compose.manifest(store, "one-clusters")["detail"]["source"] == "one"


def test_patches_and_their_motifs(spark, work):
    cli.main(args(work, "extract", "vector", "--root", f"file://{work}/p", "--run-id", "v"))
    more = ["--root", f"file://{work}/p", "--embeddings-run-id", "v", "--run-id", "w", "--patch-size", "16"]
    assert cli.main(args(work, "extract-patches", "cells", *more))["ok"] == 11
    checked = cli.main(["check-patches", "--root", f"file://{work}/p", "--run-id", "w"])
    assert checked["ok"] and checked["images"] == 11 and checked["patches"] == 44 and len(checked["pairs"]) == 5 and checked["wrong_dim"] == 0
    assert not cli.main(["check-patches", "--root", f"file://{work}/p", "--run-id", "w", "--dimension", "5"])["ok"]
    with pytest.raises(FileNotFoundError):
        cli.main(["check-patches", "--root", f"file://{work}/p", "--run-id", "nothing"])
    out = cli.main(["cluster-patches", "--root", f"file://{work}/p", "--run-id", "w", "--out", f"file://{work}/m", "--metadata", f"{work}/m.csv", "--pca", "3", "--min-cluster-size", "5", "--samples", "2"])
    assert out["motifs"] == 2
    assert len(read(work / "m/patch_assignments")) == 44 and len(read(work / "m/histogram")) == 22 and len(read(work / "m/links")) == 22
    top = read(work / "m/top_images")
    assert len(top) == 4 and all(r["thumbnail_path"].startswith("d/") and r["title"] for r in top)
    assert len(read(work / "m/dominant")) == 11 and len(read(work / "m/highlights")) == 4


def test_paths_and_cells(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "image_id string")
    known = spark.createDataFrame([("a", "x/a"), ("b", " "), ("c", None)], "image_id string, thumbnail_path string")
    listed = spark.createDataFrame([("f/b",)], "path string")
    assert {r.image_id: r.thumbnail_path for r in tables.resolved_paths(items, known, listed, "f/").collect()} == {"a": "x/a", "b": "f/b", "c": ""}
    frame = spark.createDataFrame([(1, 2, 3), (2, None, 3), (3, 1, None)], "n int, best_patch_row int, best_patch_col int")
    assert [r.n for r in tables.with_cells(frame).collect()] == [1]
