import random

from loomcorpus.llm.token_rollup import Rollup
from loomcorpus.session import shared_folder

CHANGES = "doc_id long, version string, source string, lang string, tokens long, deleted boolean, seq int, docs int"


def test_batches_equal_a_recount(spark):
    rng = random.Random(2)
    rollup, state = Rollup(spark, f"{shared_folder(spark)}/rollup-test", buckets=4, compact=3), {}
    for n in range(4):
        rows = [(rng.randrange(25), rng.choice(["v1", "v2"]), rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice([None, 1, 5, 9]), rng.choice([True, False, None]), s, 0) for s in range(30)]
        for i, v, source, lang, tokens, deleted, _, _ in rows:
            state[i, v] = None if deleted else (source, lang, v, tokens or 0)
        rows += [(None, "v1", "a", "en", 7, False, 0, 0), (1, None, "a", "en", 7, False, 0, 0), rows[-1]]
        df = spark.createDataFrame(rows, CHANGES)
        assert rollup.commit(f"b{n}", df)
        assert not rollup.commit(f"b{n}", df)
        want = {}
        for x in state.values():
            if x:
                docs, tokens = want.get(x[:3], (0, 0))
                want[x[:3]] = (docs + 1, tokens + x[3])
        assert {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in rollup.totals().collect()} == want
    assert rollup.commit("empty", spark.createDataFrame([], CHANGES)) and rollup.batches()[-1] == "empty"
    assert {(r.doc_id, r.version) for r in rollup.ledger().collect()} == {k for k, x in state.items() if x}
    assert [e["net"] is not None for e in rollup.log()] == [False, False, True, False, False]


def test_writers_that_meet(spark):
    """A writer with an old state makes its rows anew: what another one counted is not counted twice."""
    root = f"{shared_folder(spark)}/rollup-two"

    def batch(rows):
        return spark.createDataFrame([(i, "v", "s", "en", n, False, 0, 0) for i, n in rows], CHANGES)

    one, two = Rollup(spark, root, buckets=2), Rollup(spark, root, buckets=8)
    assert one.commit("a", batch([(1, 10), (2, 20)]))
    current = two.log
    stale = [[]]
    two.log = lambda: stale.pop() if stale else current()
    assert two.commit("b", batch([(1, 5), (3, 7)]))
    assert [(r.docs, r.tokens) for r in one.totals().collect()] == [(3, 32)]
    assert one.batches() == ["a", "b"] and not one.commit("b", batch([(9, 9)]))
