import random
from itertools import combinations

import numpy as np
import xxhash

from loomcorpus.llm import simhash
from loomcorpus.llm.shared import Scratch, connected_components
from tests.llm.brute import components


def plain_fingerprint(text):
    import re

    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_groups_equal_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([1, 3, 4, 40, 400]))) for _ in range(60)]
    texts = [None, "", " \n", "ÀB C", "àb c", "Àb C"]
    for t in base:
        texts.append(t)
        for _ in range(rng.randrange(4)):
            words = t.split()
            words[rng.randrange(len(words))] = "x"
            texts.append(rng.choice([t.upper(), "\t".join(words), t]))
    rows = list(enumerate(texts)) + [(None, base[0]), (None, "only here without id, said in many words"), (7, base[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as key")
    got = simhash.grouped(docs, Scratch(spark, "t"), part=3).collect()
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = components(fps, links)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id != 7:
            assert (r.fp & (2**64 - 1), r.component_id) == (fps[r.doc_id], want[r.doc_id])
    assert {r.component_id for r in got if r.doc_id is None} == {want[6], None}
    kept = simhash.kept_documents(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted([-1] + [i for i in fps if want[i] == i])
    assert simhash.grouped(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_large_bucket_in_parts(spark):
    """Fingerprints of one bucket: chains of near ones, found across parts."""
    rng = np.random.default_rng(2)
    fps = []
    for _ in range(6):
        at = rng.integers(0, 2**20, dtype=np.uint64)
        for _ in range(40):
            at = at ^ np.uint64((1 << int(rng.integers(0, 20))) | (1 << int(rng.integers(0, 20))) | (1 << int(rng.integers(0, 20))))
            fps.append(int(at))
    fps = sorted(set(fps))
    rows = [(1, min(a, b), max(a, b), a, fp) for i, fp in enumerate(fps) for a in [i % 3] for b in range(3)]
    df = spark.createDataFrame(rows, "key long, pa long, pb long, side long, fp long").repartition("key", "pa", "pb").sortWithinPartitions("key", "pa", "pb", "fp")
    links = df.mapInArrow(simhash._links(4), "a long, b long")
    got = {r.id: r.component for r in connected_components(links, Scratch(spark, "t")).collect()}
    want = components(fps, [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4])
    assert {i: got.get(i, i) for i in fps} == want


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)] + [(5, None), (7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == components({x for e in real for x in e}, real)


def test_one_row_of_each_group_stays(spark):
    """Whatever their ids, copies go and texts that are nowhere else stay."""
    def text(k):
        return " ".join(f"{chr(97 + k)}{j * j % 91}" for j in range(60))

    rows = [(None, text(0)), (None, text(0)), (None, text(1)), (None, None), (None, ""), (5, text(2)), (5, text(3)), (5, text(3)), (9, text(1)), (8, text(4) + " word" * 200_000)]
    docs = spark.createDataFrame([(i, t, {"a": "b"}) for i, t in rows], "doc_id long, text string, extra map<string,string>")
    got = sorted((r.doc_id or 0, (r.text or "")[:9]) for r in simhash.kept_documents(docs, Scratch(spark, "t")).collect())
    assert got == sorted([(0, text(0)[:9]), (0, ""), (5, text(2)[:9]), (5, text(3)[:9]), (9, text(1)[:9]), (8, text(4)[:9])])
