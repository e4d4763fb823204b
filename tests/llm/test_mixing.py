import random

from loomcorpus.llm import mixing
from loomcorpus.llm.shared import Scratch


def waterfill(sizes, weights, cap=3):
    total, fixed = sum(sizes), {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in fixed]
        level = (total - sum(fixed.values())) / sum(weights[i] for i in rest) if rest else 0
        over = [i for i in rest if weights[i] * level > cap * sizes[i]]
        if not over:
            return [fixed.get(i, weights[i] * level) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


def test_mix(spark):
    rng = random.Random(6)
    names = ["b", "a", "é", "z", "", None, "tiny"]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 30, 400])), rng.choice(names[:6])) for i in range(200)] + [(900, "one two", "tiny"), (901, None, "zero"), (None, "x y z", "a"), (3, "again", "b"), (3, "again", "b")]
    docs = spark.createDataFrame([(i, t, s, "size") for i, t, s in rows], "doc_id long, text string, source string, size string")
    mix = mixing.Mixture(docs, Scratch(spark, "t"), block=64)
    got = mix.taken.collect()
    assert len(got) == len(rows)
    sources = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == x) for x in sources]
    want = dict(zip(sources, waterfill(sizes, [1 + i % 3 for i in range(len(sources))]), strict=True))
    by = {}
    for r in got:
        source = None if r.src == "" else r.src[1:]
        assert abs(r.target - want[source]) < 1e-6 and r.taken <= 3 * r.size and r.source_size == sizes[sources.index(source)]
        by[source] = by.get(source, 0) + r.taken
    assert all(abs(by[s] - want[s]) <= 0.5 for s in sources)
    again = mixing.Mixture(docs.repartition(7), Scratch(spark, "t"), block=64).taken.collect()
    assert sorted((r.key, r.occ, r.taken) for r in got) == sorted((r.key, r.occ, r.taken) for r in again)
    # the schedule: every slot once, sources evenly spread
    slots = [r.src for r in mix.slots.orderBy("slot").collect()]
    n = len(slots)
    for s in set(slots):
        share = slots.count(s) / n
        assert all(abs(slots[:k].count(s) - share * k) < 4 for k in range(0, n, 7))
    out = mixing.mixed_documents(docs, Scratch(spark, "t"), block=64)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in by.items() if n}
    assert mixing.Mixture(docs.limit(0), Scratch(spark, "t")).taken.count() == 0


def test_order_of_the_emitted_mix(spark):
    """In the order of their slots the documents of every source come evenly spread."""
    docs = spark.createDataFrame([(None if i % 50 == 0 else i, f"{i} " * 20, "abc"[i % 7 % 3]) for i in range(900)], "doc_id long, text string, source string")
    mix = mixing.Mixture(docs, Scratch(spark, "t"), block=20)
    # documents without an id are dealt like others
    assert mix.taken.where("doc_id is null").select("key").distinct().count() == 18
    out = [r.source for r in mixing.mixed_documents(docs, Scratch(spark, "t"), in_order=True, block=20).collect()]
    first = sorted((r.slot, r.src) for r in mix.parts.collect())
    for source in "abc":
        share = out.count(source) / len(out)
        assert all(abs(out[:k].count(source) - share * k) < 12 for k in range(len(out)))
        assert abs(share - sum(s == "=" + source for _, s in first) / len(first)) < 0.01
