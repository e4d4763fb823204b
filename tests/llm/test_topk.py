import random

from loomcorpus.llm import topk
from loomcorpus.llm.shared import Scratch


def test_search_equals_brute_force(spark):
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(300):
        code = rng.choice(centre)
        for _ in range(rng.randrange(14)):
            code ^= 1 << rng.randrange(64)
        rows.append((i, code - (1 << 64) if code >> 63 else code))
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(None, 5), (2000, None), rows[7]]
    df = spark.createDataFrame(rows, "id long, code long").selectExpr("*", "1 as value", "2 as q")
    queries = df.where("id % 20 = 0")
    got = [(r.query_id, r["rank"], r.neighbour_id, r.distance) for r in topk.nearest(df, queries, Scratch(spark, "t"), k=5).collect()]
    unique = {i: c for i, c in rows if i is not None and c is not None}
    want = []
    for q in unique:
        if q % 20 == 0:
            near = sorted((((unique[q] ^ c) & (2**64 - 1)).bit_count(), i) for i, c in unique.items() if i != q)[:5]
            want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert sorted(got) == sorted(want)
    assert topk.nearest(df.limit(0), queries.limit(0), Scratch(spark, "t")).count() == 0
    assert topk.nearest(df.where("id = 20"), queries, Scratch(spark, "t")).count() == queries.where("id <> 20 and code is not null").count()
