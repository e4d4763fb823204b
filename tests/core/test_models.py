"""The queries over all vectors of a small table."""

import numpy as np
import pandas as pd
import pytest

from loomcorpus.operators import hierarchy
from loomcorpus.plans import models


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """(folder, points): four well separated groups of unequal size, labels that cut across them."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 20, (4, 24))
    points = np.vstack([c + rng.normal(0, 1, (n, 24)) for c, n in zip(centres, (70, 50, 40, 30), strict=True)]).astype(np.float32)
    root = str(tmp_path_factory.mktemp("vectors"))
    rows = [(i, [float(v) for v in x], i % 3) for i, x in enumerate(points)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return root, points.astype(float)


@pytest.mark.parametrize("name", ["hdbscan_clusters", "ward_clusters", "umap_layout"])
def test_every_vector_is_clustered(spark, vectors, name):
    root, points = vectors
    got = models.QUERIES[name](spark, root).collect()
    assert sorted(r["vec_id"] for r in got) == list(range(len(points)))
    if name == "hdbscan_clusters":
        found = {r["vec_id"]: r["cluster_id"] for r in got}
        group = np.repeat(range(4), (70, 50, 40, 30))
        # a cluster never has vectors of two groups, and most vectors are in one
        assert all(len({int(group[i]) for i in found if found[i] == c}) == 1 for c in set(found.values()) - {-1})
        assert sum(c >= 0 for c in found.values()) > 150


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """(folder, groups): 20,010 vectors in three groups, more than a driver compared all with all before."""
    rng = np.random.default_rng(8)
    group = np.arange(20_010) % 3
    points = rng.normal(0, 20, (3, 6))[group] + rng.normal(0, 1, (len(group), 6))
    root = str(tmp_path_factory.mktemp("many"))
    frame = pd.DataFrame({"vec_id": range(len(group)), "embedding": points.tolist(), "label": 0})
    spark.createDataFrame(frame, "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return root, group


@pytest.mark.parametrize("name", ["hdbscan_clusters", "umap_layout", "ward_clusters"])
def test_more_than_twenty_thousand_vectors(spark, many, name):
    root, group = many
    got = models.QUERIES[name](spark, root).toPandas().sort_values("vec_id")
    assert got["vec_id"].tolist() == list(range(len(group)))
    clusters = [ids.index for c, ids in got.set_index("vec_id").groupby("cluster_id") if c >= 0]
    assert len(clusters) > 2 and all(len(set(group[ids])) == 1 for ids in clusters)


@pytest.mark.parametrize("block", [40, 2048])
def test_core_distance_of_every_vector(spark, vectors, block):
    root, points = vectors
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    # the first column is the point itself, which is no neighbour of its own
    want = np.sort(d, axis=1)[:, 3]
    df = spark.read.parquet(f"{root}/embeddings.parquet")
    got = {r["vec_id"]: r["core_distance"] for r in hierarchy.core_distance_table(df, "vec_id", "embedding", 3, block).collect()}
    assert sorted(got) == list(range(len(points)))
    assert np.allclose([got[i] for i in range(len(points))], want, atol=1e-9)
    if block == 2048:
        rows = models.QUERIES["hdbscan_core_distance_all"](spark, root).collect()
        assert {r["vec_id"]: r["core_distance"] for r in rows} == {i: pytest.approx(v, abs=2e-6) for i, v in enumerate(want)}
