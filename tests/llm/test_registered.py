"""The registered queries on the smallest tables, against SQL or brute force."""

import os
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from loomcorpus.llm import packing, spans
from loomcorpus.llm.queries import ORACLE, QUERIES, tokenizer_path
from tests.llm.brute import components
from tests.llm.test_simhash import plain_fingerprint
from tests.llm.test_spans import brute

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in "documents embeddings pages labels".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    assert got == want


def test_op1(spark, duck):
    rows = duck.sql("SELECT vec_id, embedding::DOUBLE[], label FROM embeddings").fetchall()
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    links = [(rows[i][0], rows[j][0]) for i, j in combinations(range(len(rows)), 2) if near[i, j] and rows[i][2] == rows[j][2]]
    comp = components({r[0] for r in rows}, links)
    want = sorted((i, sum(i in e for e in links), c, i == c) for i, c in comp.items())
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in QUERIES["op1_embedding_dedup"](spark, DIR).collect()) == want


def test_op3(spark, duck):
    fps = {i: plain_fingerprint(t) for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}
    comp = components(fps, [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op3_simhash"](spark, DIR).collect()) == sorted((i, f"{f:016x}", comp[i]) for i, f in fps.items())


def test_op4(spark, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    got = sorted((r.doc_id, r.start, r.end) for r in QUERIES["op4_substring_dedup"](spark, DIR).collect())
    assert got and got == brute(rows)
    assert spans.BREAK.split("a. b") == ["a.", "b"]


def test_op6(spark, duck):
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for (i,) in duck.sql("SELECT doc_id FROM documents").fetchall()}
    got = QUERIES["op6_toxicity"](spark, DIR).collect()
    assert {r.doc_id: r.held_out for r in got} == held and all(r.predicted == int(r.score >= 0.3) for r in got)


def check_pieces(rows, docs):
    """docs: (doc_id, text) with repeats; every document is packed once a row, whole and gapless."""
    tok = packing.WordEncoder(tokenizer_path()).tokenizer
    want = []
    for i, t in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want.append((i, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert len(by) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_op10(spark, duck):
    check_pieces(QUERIES["op10_pack_documents"](spark, DIR).collect(), duck.sql("SELECT doc_id, text FROM documents").fetchall())


def test_pipeline_by_stages(spark, duck):
    """Each stage on what its predecessor kept, by its brute-force meaning."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    scores = {r.doc_id: r.predicted for r in QUERIES["op6_toxicity"](spark, DIR).collect()}
    stages = dict(corpus_pipeline.STAGES)

    def run(name, docs):
        out = stages[name](spark, docs, DIR).cache()
        out.count()
        return out

    one = run("toxicity", docs)
    assert one.columns == columns and {r.doc_id for r in one.select("doc_id").collect()} == {i for i, p in scores.items() if not p}

    two = run("line dedup", one)
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in (one, two))
    assert two.columns == columns and before.keys() == after.keys()
    seen = set()
    for i in sorted(after):
        lines = [x.strip(" \t\r").lower() for x in after[i].split("\n") if x.strip(" \t\r")]
        assert not seen & set(lines) and len(lines) == len(set(lines))
        seen |= set(lines)
        left = iter(before[i].split("\n"))
        assert after[i] == "" or all(line in left for line in after[i].split("\n"))

    three = run("simhash near-dedup", two)
    fps = {i: plain_fingerprint(t) for i, t in after.items()}
    comp = components(fps, [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert {r.doc_id: r.text for r in three.collect()} == {i: after[i] for i, c in comp.items() if i == c}

    four = run("mix sources", three)
    size = {r.doc_id: (r.source, len(r.text.encode().split())) for r in three.collect()}
    total, taken = {}, {}
    for s, n in size.values():
        total[s] = total.get(s, 0) + n
    repeats = {}
    for r in four.collect():
        n = len(r.text.encode().split())
        taken[r.source] = taken.get(r.source, 0) + n
        repeats[r.doc_id] = repeats.get(r.doc_id, 0) + n
    sources = sorted(total)
    from tests.llm.test_mixing import waterfill

    for s, t in zip(sources, waterfill([total[s] for s in sources], [1 + k % 3 for k in range(len(sources))]), strict=True):
        assert abs(taken.get(s, 0) - t) <= 0.5 + 1e-6
    assert four.columns == columns and all(n <= 3 * size[i][1] for i, n in repeats.items())

    check_pieces(run("best-fit packing", four).collect(), [(r.doc_id, r.text) for r in four.collect()])
