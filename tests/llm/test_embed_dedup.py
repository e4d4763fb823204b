import numpy as np
import pytest

from loomcorpus.llm import embed_dedup
from loomcorpus.llm.shared import Scratch
from tests.llm.brute import components


@pytest.mark.parametrize(("cells", "block"), [(1, 2048), (5, 16)])
def test_links_equal_brute_force(spark, cells, block):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(25):
        base = rng.normal(size=8)
        for _ in range(8):
            rows.append(((base + rng.normal(size=8) * rng.choice([0, 0.2, 0.45])).astype(np.float32), int(c % 3)))
    rows += [(rows[0][0] * np.float32(2), 0), (rows[0][0], None), (None, 0), (np.zeros(8, np.float32), 0), (np.array([np.nan] * 8, np.float32), 0), (np.array([np.inf] + [1] * 7, np.float32), 0), (np.ones(3, np.float32), 0), (np.ones(3, np.float32) * 3, 0), (np.array([], np.float32), 1)]
    data = [(i, None if v is None else [float(x) for x in v], label) for i, (v, label) in enumerate(rows)] + [(500, [1.0, None], 1), (500, [1.0, None], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as cell", "2 as id")
    got = embed_dedup.linked(df, Scratch(spark, "t"), cells=cells, block=block).collect()
    ok = {i: np.array(v, float) for i, v, label in data if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(i, j) for i in ok for j in ok if i < j and rows[i][1] == rows[j][1] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.93]
    want = components({i for i, _, _ in data}, links)
    assert len(got) == len(data)
    for r in got:
        n = sum(r.vec_id in e for e in links)
        assert (r.n_links, r.component_id, r.kept) == (n, want[r.vec_id], want[r.vec_id] == r.vec_id)


def test_copies_and_null_ids(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0], 1), (2, [1.0, -0.0], 1), (None, [1.0, 0.01], 1), (None, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((r.n_links, r.component_id or -1, r.kept) for r in embed_dedup.linked(df, Scratch(spark, "t")).collect())
    assert got == [(0, -1, False), (2, 2, False), (2, 2, False), (2, 2, True)]
    assert embed_dedup.linked(df.limit(0), Scratch(spark, "t")).count() == 0


def grouped_vectors(groups, each, dims, spread, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return np.concatenate([c + rng.normal(size=(each, dims)) * spread for c in centres])


def test_query_equals_sql_on_linked_vectors(spark, tmp_path):
    """The registered query and its SQL on a table that has links."""
    import duckdb

    from loomcorpus.llm.queries import ORACLE, QUERIES

    x = grouped_vectors(40, 6, 64, 0.27).astype(np.float32)
    rows = [(i, [float(v) for v in e], None if i % 97 == 0 else i % 3 // 2) for i, e in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in QUERIES["op1_embedding_dedup"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(ORACLE["op1_embedding_dedup"]).fetchall())
    assert got == want and sum(n for _, n, _, _ in got) > 200


def test_cells_rule_out_most_of_separate_vectors():
    """Vectors in separate groups hardly visit a second cell; long vectors take no table of all centres."""
    import pyarrow as pa

    x = grouped_vectors(32, 60, 1024, 0.1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = embed_dedup.centres(x, 32)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(x)), pa.array(range(len(x))), pa.array([1] * len(x)), pa.array(list(x))], ["label", "id", "m", "vec"])
    placed = sum(b.num_rows for b in embed_dedup._assign(found, 0.93)([batch]))
    # a cell may hold two groups; all pairs would be 32 visits each
    assert len(x) <= placed <= 2 * len(x)
