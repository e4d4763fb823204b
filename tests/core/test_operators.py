import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcorpus import cli, schemas
from loomcorpus.operators import acquire, apply, clustering, hierarchy, images, layout, reduce, reports, sampling, tables, validity
from loomcorpus.sources import files, sinks
from loomcorpus.sources.runs import RunStore
from loomcorpus.streaming import resume


def test_csv_lines(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("url,date,title,categories\nu1,2020-01-02,t,c\nu2,2020-01-02\nu3,2020-01-02,t,c,extra\nu4,not a date,,c\n")
    rows = files.csv(spark, str(p), schemas.METADATA, ordinal="n").orderBy("n").collect()
    assert [(r.url, r.title, r.categories) for r in rows] == [("u1", "t", "c"), ("u2", None, None), ("u4", None, "c")]
    with pytest.raises(Exception, match="too many fields"):
        files.csv(spark, str(p), schemas.METADATA, strict=True).collect()
    dated = sampling.years(files.csv(spark, str(p), schemas.METADATA))
    assert sorted((r.url, r.year) for r in dated.collect()) == [("u1", 2020), ("u2", 2020)]


def test_samples_are_exact(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 5, 2010).when(F.col("id") < 20, 2019).otherwise(2020 + F.col("id") % 2).alias("year"))
    kept = sampling.latest_years(df, 3)
    assert {r.year for r in kept.select("year").distinct().collect()} == {2019, 2020, 2021}
    a = sampling.per_stratum(kept, "year", "id", 100)
    assert {r.year: r["count"] for r in a.groupBy("year").count().collect()} == {2019: 15, 2020: 100, 2021: 100}
    assert {r.id for r in a.collect()} == {r.id for r in sampling.per_stratum(kept.repartition(7), "year", "id", 100).collect()}
    assert sampling.per_stratum(df.limit(0), "year", "id", 3).count() == 0


def test_state_merges_and_reconciles(spark):
    state = spark.createDataFrame([("a", True, "p"), ("b", False, None), (None, None, None)], "url string, thumbnail_success boolean, thumbnail_path string")
    new = spark.createDataFrame([("a",), ("c",), ("c",), (None,)], "url string")
    merged = acquire.merge_missing(acquire.with_state(state), new)
    assert sorted((r.url or "") for r in merged.collect()) == ["", "a", "b", "c", "c"]
    listing = spark.createDataFrame([("d/b.jpg",), ("d/x.jpg",)], "path string")
    out, changed = acquire.reconcile(merged, listing, F.concat(F.lit("d/"), "url", F.lit(".jpg")))
    assert [(r.url, r.thumbnail_path) for r in out.where(changed).collect()] == [("b", "d/b.jpg")]
    assert acquire.progress(out).first().asDict() == {"rows": 5, "done": 2, "remaining": 3, "done_pct": 40.0}
    assert acquire.progress(out.limit(0)).first()["done_pct"] == 0.0
    rows = spark.range(10)
    assert acquire.todo(rows, spark.range(5), "id", "id", 5).count() == 0
    assert acquire.todo(rows, spark.range(5), "id", "id", 0).count() == 5
    assert acquire.todo(rows, spark.range(5), "id", "id", 7, force=True).count() == 7


def test_validity_reasons(spark):
    rows = spark.createDataFrame([(None, None, None), (4095, 640, 360), (4096, 640, 360), (9000, 639, 360), (9000, None, None)], "length long, w int, h int")
    got = [r.v.reason for r in rows.select(validity.validity(F.col("length"), F.col("w"), F.col("h")).alias("v")).collect()]
    assert got == ["missing", "too_small:4095B", "ok", "unexpected_size:639x360", "open_error:no size"]


def test_stat_errors_and_ordered_listings(spark, tmp_path):
    rows = spark.createDataFrame([(None, None), (None, "EIO"), (10, None), (9000, None)], "length long, err string")
    got = [r.v.reason for r in rows.select(validity.validity(F.col("length"), stat_error=F.col("err")).alias("v")).collect()]
    assert got == ["missing", "stat_error:EIO", "too_small:10B", "ok"]
    for name, n in (("b.jpg", 9), ("a.jpg", 5000), ("c.jpg", 4096)):
        (tmp_path / name).write_bytes(b"x" * n)
    assert [r.path.rsplit("/", 1)[-1] for r in files.listing(spark, f"file://{tmp_path}", min_bytes=4096, ordered=True).collect()] == ["a.jpg", "c.jpg"]


def test_reports(spark):
    published = [(2020, 2500, 2224, 1639), (2021, 2500, 2249, 1655), (2022, 2500, 2200, 1660)]
    df = spark.createDataFrame([(y, i < r, i < v) for y, n, r, v in published for i in range(n)], "year int, r boolean, v boolean")
    got = {r.year: (r.sampled, r.retrieved, r.placeholder, r.valid, r.valid_pct) for r in reports.valid_rates(df, "year", F.col("r"), F.col("v")).collect()}
    assert got[2020] == (2500, 2224, 585, 1639, 65.6) and got[None][0] == 7500
    empty = reports.annotation_stats(df.limit(0), F.col("r"), F.lit(1.0)).first()
    assert (empty.processed, empty.mean_seconds, empty.ok_pct) == (0, 0.0, 0.0)


def test_tables_ties(spark):
    cells = spark.createDataFrame([("i", -1, 0, 0, 0.0), ("i", 2, 0, 1, 0.5), ("j", 3, 1, 1, 0.9), ("j", 1, 2, 2, 0.9), ("j", 1, 1, 5, 0.9), ("j", 3, 1, 0, 0.1)], "image_id string, motif_id int, patch_row int, patch_col int, motif_probability double")
    h = tables.motif_histogram(cells)
    assert {(r.image_id, r.dominant_motif_id) for r in tables.dominant_motif(h).collect()} == {("i", -1), ("j", 1)}
    best = {(r.motif_id, r.image_id): (r.best_patch_row, r.best_patch_col) for r in tables.best_patch(cells).collect()}
    assert best[1, "j"] == (1, 5) and best[3, "j"] == (1, 1)
    shares = h.groupBy("image_id").agg(F.sum("patch_fraction").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-3 for r in shares)
    meta = spark.createDataFrame([(2, "x/i", "second"), (1, "y/i/", "first"), (3, " ", "none"), (4, "nan", "none")], "n int, thumbnail_path string, title string")
    out = tables.cluster_assignments(spark.createDataFrame([("i", 0), ("k", 1)], "image_id string, cluster_id int"), meta, "n", ("title", "thumbnail_path"))
    assert {(r.image_id, r.title) for r in out.collect()} == {("i", "first"), ("k", "")}


def blobs(n=40):
    rng = np.random.default_rng(0)
    return np.r_[rng.normal(0, 0.1, (n, 4)), rng.normal(3, 0.1, (n, 4)), rng.uniform(-20, 20, (4, 4))]


def naive_tree_weight(points, core):
    n = len(points)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    d = np.maximum(d, np.maximum(core[:, None], core[None]))
    inside, total = {0}, 0.0
    while len(inside) < n:
        w, j = min((d[i, j], j) for i in inside for j in range(n) if j not in inside)
        inside.add(j)
        total += w
    return total


@pytest.mark.parametrize("selection", ["eom", "leaf"])
def test_hdbscan_on_blobs(selection):
    x = blobs()
    labels, p = hierarchy.hdbscan(x, 10, 5, selection)
    assert set(labels[80:]) == {-1} and (p[labels == -1] == 0).all() and p.max() <= 1
    first, second = set(labels[:40]) - {-1}, set(labels[40:80]) - {-1}
    assert first and second and not first & second
    if selection == "eom":
        assert len(first) == len(second) == 1 and (labels[:80] >= 0).all()
    core = hierarchy.core_distances(x, 5)
    assert abs(hierarchy.reachability_tree(x, core)[:, 2].sum() - naive_tree_weight(x, core)) < 1e-6
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 1)
    assert np.allclose(core, d[:, 5], atol=1e-6)


def test_hdbscan_small_and_equal():
    assert set(hierarchy.hdbscan(np.zeros((2, 3)), 3, 1)[0]) == {-1}
    labels, _ = hierarchy.hdbscan(np.zeros((9, 3)), 3, 1)
    assert len(labels) == 9
    with pytest.raises(ValueError, match="at most"):
        hierarchy.hdbscan(np.zeros((9, 3)), limit=5)


@pytest.mark.parametrize("shift", [0, 1e6])
def test_hdbscan_is_the_same_by_blocks_and_orders(shift):
    rng = np.random.default_rng(6)
    x = np.round(np.repeat(rng.normal(0, 1, (300, 4)), rng.integers(1, 4, 300), axis=0), 2) + shift
    core = hierarchy.core_distances(x, 3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.array_equal(core, np.sort(d, 1)[:, 3])
    trees = [hierarchy.reachability_tree(x, core, block=b) for b in (50, 170, 6144)]
    assert all(np.allclose(t[:, 2], trees[0][:, 2], rtol=0, atol=1e-7) for t in trees)
    some, core = x[:120], hierarchy.core_distances(x[:120], 3)
    assert abs(hierarchy.reachability_tree(some, core, block=50)[:, 2].sum() - naive_tree_weight(some, core)) < 1e-6
    order = rng.permutation(len(x))
    for selection in ("eom", "leaf"):
        labels, p = hierarchy.hdbscan(x, 5, 3, selection)
        other, q = hierarchy.hdbscan(x[order], 5, 3, selection)
        pairs = set(zip(labels[order].tolist(), other.tolist(), strict=True))
        assert labels.max() > 2 and len(pairs) == len(set(labels.tolist())) == len(set(other.tolist())) and np.allclose(p[order], q)


def test_hdbscan_takes_equal_distances_apart_together():
    x = np.array([(a, b) for a in range(30) for b in range(30)], float)
    assert set(hierarchy.hdbscan(x, 5, 3, "leaf")[0]) == {-1}


def test_ward_equals_naive():
    x = blobs(8)
    groups = [[i] for i in range(len(x))]
    while len(groups) > 4:
        def cost(a, b):
            ca, cb = x[a].mean(0), x[b].mean(0)
            return len(a) * len(b) / (len(a) + len(b)) * ((ca - cb) ** 2).sum()

        _, i, j = min((cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    labels = hierarchy.ward(x, 4)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels)}


def test_ward_with_short_lists(monkeypatch):
    """Lists too short to tell much make clusters search again and again; the merges stay those of all pairs."""
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(0, 1, (120, 3)), rng.integers(1, 4, 120), axis=0)
    want = {k: hierarchy.ward(x, k) for k in (2, 7, 40)}
    centre, size, merges = {i: p for i, p in enumerate(x)}, dict.fromkeys(range(len(x)), 1), []
    while len(centre) > 1:
        ids = np.array(list(centre))
        c, s = np.array([centre[i] for i in ids]), np.array([size[i] for i in ids])
        cost = ((c[:, None] - c[None]) ** 2).sum(2) * s[:, None] * s / (s[:, None] + s)
        np.fill_diagonal(cost, np.inf)
        a, b = sorted(ids[list(np.unravel_index(cost.argmin(), cost.shape))].tolist())
        centre[a] = (size[a] * centre[a] + size[b] * centre.pop(b)) / (size[a] + size[b])
        size[a] += size.pop(b)
        merges.append((a, b))
    for near in (1, 2, 12):
        monkeypatch.setattr(hierarchy._Ward, "near", near)
        for k in want:
            of = np.arange(len(x))
            for a, b in merges[: len(x) - k]:
                of[of == b] = a
            seen = {}
            assert hierarchy.ward(x, k).tolist() == want[k].tolist() == [seen.setdefault(g, len(seen)) for g in of.tolist()]


def test_pipeline_methods(spark):
    x = blobs()
    df = spark.createDataFrame([(f"i{n:03}", [float(v) for v in row]) for n, row in enumerate(x)], "image_id string, embedding array<float>")
    for method, extra in (("kmeans", {"k": 3}), ("hdbscan", {"min_cluster_size": 10, "min_samples": 5, "selection": "eom"}), ("agglomerative", {"k": 3})):
        out = clustering.run(df, "image_id", "embedding", method=method, components=3, **extra)
        assert out.assignments.count() == len(x) and out.pca_components == 3 and 0.9 < out.explained <= 1
    with pytest.raises(ValueError, match="unknown method"):
        clustering.run(df, "image_id", "embedding", method="x")
    with pytest.raises(ValueError, match="2 or more"):
        clustering.run(df, "image_id", "embedding", method="kmeans", k=1)
    reduced, share, used = reduce.pca(df, "embedding", 99)
    means = reduced.select(F.posexplode("pca")).groupBy("pos").agg(F.avg("col").alias("m")).collect()
    assert used == 4 and abs(share - 1) < 1e-9 and all(abs(r.m) < 1e-6 for r in means)
    shares = [reduce.pca(df, "embedding", k)[1] for k in (1, 2, 3)]
    assert shares == sorted(shares)


def test_layout_separates_blobs():
    y = reduce.umap_layout(blobs()[:80], neighbors=10, metric="euclidean")
    a, b = y[:40].mean(0), y[40:].mean(0)
    spread = max(np.linalg.norm(y[:40] - a, axis=1).mean(), np.linalg.norm(y[40:] - b, axis=1).mean())
    assert np.linalg.norm(a - b) > 2 * spread


def test_injected_functions(spark):
    rows = spark.createDataFrame([("http://p/1", "abcdefghijk"), ("http://p/2", "zzz"), ("http://p/3", None)], "url string, key string")

    def web():
        def get(url):
            if url.startswith("abc/"):
                return 200, "image/jpeg", b"one"
            if url == "http://p/2":
                return 200, "text/html", b"img2"
            if url == "img2":
                return 200, "IMAGE/png", b"two"
            raise OSError("nothing there")

        return get

    got = {r.url: (r.success, r.thumbnail_url, r.error) for r in apply.fetch(rows, web, lambda body: body.decode()).collect()}
    assert got["http://p/1"] == (True, "abc/def/ghi/abcdefghijk", None) and got["http://p/2"] == (True, "img2", None) and got["http://p/3"] == (False, None, "no key")

    items = spark.createDataFrame([("a.jpg", "t", "x"), ("b.jpg", None, "y")], "image_id string, title string, usable_path string")

    def model():
        def ask(prompt, ident, title):
            if ident.startswith("b"):
                raise RuntimeError("busy")
            return '{"framing": "close"}'

        return ask

    said = {r.image_id: r for r in apply.annotate(items, model, "p").collect()}
    assert said["b.jpg"].raw_output == "REQUEST_ERROR: busy" and said["a.jpg"].success

    def vectors():
        def run(path):
            if path == "y":
                raise ValueError("unexpected_size:1x1")
            return [1.0, 2.0]

        return run

    made = {r.image_id: r for r in apply.embed(items, vectors).collect()}
    assert made["a.jpg"].embedding == [1.0, 2.0] and made["b.jpg"].error == "ValueError: unexpected_size:1x1"
    tokens = np.arange(2 * (1 + 4)).reshape(5, 2)
    assert apply.patch_vectors(tokens, (2, 2), [1]) == [(1, 0, [6.0, 7.0]), (1, 1, [8.0, 9.0])]
    with pytest.raises(ValueError, match="grid"):
        apply.patch_vectors(tokens, (3, 2), [1])
    with pytest.raises(ValueError, match="no content"):
        apply.patch_vectors(tokens, (2, 2), [])


def test_preview_names_round_as_c_does(spark):
    fractions = [k / 10000 for k in range(10001)] + [k / 1024 for k in range(1024)] + [2.0**41, float("inf"), -0.0625]
    df = spark.createDataFrame([(x,) for x in fractions] + [(None,)], "x double")
    got = df.select("x", layout.preview_name(F.lit("i"), F.col("x")).alias("name")).collect()
    wrong = [(r.x, r.name) for r in got if r.x not in (None, float("inf")) and r.name != f"i_{r.x:.3f}.jpg"]
    assert not wrong
    assert [r.name for r in got if r.x is None] == ["i_na.jpg"]


def test_pixels():
    picture = np.zeros((36, 64, 3), np.uint8)
    picture[:, 32:] = 200
    square, top = images.letterbox(picture)
    assert square.shape == (64, 64, 3) and top == 14 and not square[:14].any() and (square[14:50] == picture).all()
    assert images.resize(picture, 64, 36) is picture and images.resize(picture, 32, 18).shape == (18, 32, 3)
    assert (images.crop_cell(square, 1, 3, 16, 2) == 200).all()
    assert images.grid([picture] * 5, 18, 4).shape == (36, 128, 3)
    assert (images.box(picture, 0, 0, 8, 8)[0, 0] == (255, 0, 0)).all() and not picture[0, 0].any()
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x01\x68\x02\x80\x03" + b"\0" * 9
    assert images.header_size(jpeg) == (640, 360) and images.header_size(b"junk") is None
    out = images.preprocess(b"x" * 5000, 32, decoder=lambda _: np.zeros((360, 640, 3)))
    assert out["image"].shape == (32, 32, 3) and out["frame"] == {"side": 640, "above": 140, "target": 32}
    with pytest.raises(ValueError, match="too_small"):
        images.preprocess(b"x")


def test_runs_and_sinks(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(FileNotFoundError):
        store.resolve()
    df = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "image_id string, embedding array<float>")
    store.append(df, "r1")
    store.record("r1", "vectors", 1, 1, partial=True)
    store.record("r1", "vectors", 2, 1)
    assert store.resolve() == store.resolve("r1") == "r1" and store.counts("r1") == (2, 1) and store.counts("zz") == (0, 0)
    assert [r.image_id for r in store.load().collect()] == ["a", "b"] and store.completed("r1").count() == 2 and store.completed("r2").count() == 0
    store.append(df.limit(1), "r1")
    with pytest.raises(ValueError, match="rows for"):
        store.load("r1")
    sinks.append_log(df, f"file://{tmp_path}/log")
    sinks.append_log(df, f"file://{tmp_path}/log")
    assert spark.read.json(f"file://{tmp_path}/log").count() == 4
    assert sinks.archive(spark, f"file://{tmp_path}/log", f"file://{tmp_path}/old/log") and not sinks.archive(spark, f"file://{tmp_path}/log", f"file://{tmp_path}/old/log")
    (tmp_path / "m.json").write_text(json.dumps({"ok": 3}))
    assert files.json_manifest(spark, f"file://{tmp_path}/m.json") == {"ok": 3} and files.json_manifest(spark, f"file://{tmp_path}/none") == {}
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.jpg").write_bytes(b"x" * 10)
    listed = files.listing_with_sizes(spark, f"file://{tmp_path}/img").collect()
    assert [(r.length, r.width) for r in listed] == [(10, None)]
    assert files.prompt(None, "say", "!") == "say!" and files.prompt(str(tmp_path / "zz"), "say") == "say"


def test_second_run_does_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.range(10).write.parquet(f"{root}/in")
    step = lambda b: b.withColumn("x", F.col("id") * 2)
    heard = []
    args = (spark, f"{root}/in", "id long", f"{root}/out", f"{root}/ck", step)
    assert resume.process_new(*args, on_batch=lambda i, n: heard.append(n)) == 10
    assert resume.process_new(*args) == 0
    spark.range(10, 13).write.mode("append").parquet(f"{root}/in")
    assert resume.process_new(*args) == 3 and spark.read.parquet(f"{root}/out").count() == 13 and heard == [10]


def test_late_events(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h, 5), "a") for h in (0, 0, 1)]
    spark.createDataFrame(rows, "ts timestamp, kind string").write.parquet(f"file://{tmp_path}/ev")
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(f"file://{tmp_path}/ev")
    q = resume.windowed_counts(stream, "ts", "kind").writeStream.outputMode("update").format("memory").queryName("late_events").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.events for r in spark.table("late_events").collect()) == [1, 2]


def stub_model():
    """A vector from a path's characters."""
    return lambda path: [float(ord(c)) for c in (path + "....")[:4]]


def test_command_line(spark, tmp_path):
    m = tmp_path / "m.csv"
    m.write_text("url,date,title,categories,thumbnail_path\n" + "".join(f"u{i},20{15 + i % 8}-01-01,t,c,d/{i}.jpg\n" for i in range(40)))
    flat = tmp_path / "flat.csv"
    flat.write_text("url,date,title,categories\n" + "".join(f"u{i},20{15 + i % 8}-01-01,t,c\n" for i in range(40)))
    assert cli.main(["sample", "--input", str(flat), "--output", f"file://{tmp_path}/s", "--per-year", "3"]) == {"command": "sample"} | {str(y): 3 for y in range(2018, 2023)}
    spark.createDataFrame([(f"d/{i}.jpg", 5000) for i in range(30)], "path string, length long").write.parquet(f"file://{tmp_path}/l")
    common = ["--csv", str(m), "--listing", f"file://{tmp_path}/l", "--root", f"file://{tmp_path}/r", "--factory", "tests.core.test_operators:stub_model", "--run-id", "one"]
    assert cli.main(["extract", *common, "--dry-run"])["todo"] == 30
    assert cli.main(["extract", *common])["ok"] == 30 and cli.main(["extract", *common])["ok"] == 0
    assert cli.main(["check", "--root", f"file://{tmp_path}/r", "--run-id", "one", "--dimension", "4"])["ok"]
    out = cli.main(["cluster", "--root", f"file://{tmp_path}/r", "--out", f"file://{tmp_path}/c", "--method", "kmeans", "--n-clusters", "2", "--pca", "2"])
    assert out["clusters"] == 2 and spark.read.option("header", True).csv(f"file://{tmp_path}/c/assignments").count() == 30
