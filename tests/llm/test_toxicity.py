import math
import random

import numpy as np
import pytest

from loomcorpus.llm import toxicity
from loomcorpus.llm.shared import Scratch


def corpus(n, seed):
    """Toxic where an insult meets a group's name; each alone is clean."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"word{rng.randrange(60)}" for _ in range(12)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        if insult:
            words.insert(rng.randrange(12), rng.choice(["blorg!", "Zwick"]))
        if group:
            words.insert(rng.randrange(12), rng.choice(["martians", "Venusians,"]))
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_interactions_are_learnt(spark):
    rows = corpus(4000, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (10**6, "")], "doc_id long, text string").selectExpr("*", "1 as score", "'x' as y")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, Scratch(spark, "t"))
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    truth = {i: y for i, _, y in rows}
    held = [r for i, r in got.items() if r.held_out]
    assert len(got) == 4002 and 800 < len(held) < 1200
    right = sum(int(r.score >= 0.5) == truth[r.doc_id] for r in held) / len(held)
    assert right > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[None].score == got[10**6].score and not got[None].held_out
    assert toxicity.without_toxic(docs, model).count() == sum(1 - r.predicted for r in got.values())
    assert toxicity.without_toxic(docs, model).columns == docs.columns


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none, Scratch(spark, "t"))
    assert {r.score for r in toxicity.scored(docs, model).collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), model).count() == 0


def naive(model, text):
    """A score by the formula of the model, pair by pair."""
    place = {b: i for i, b in enumerate(model.buckets)}
    on = sorted({place[b] for w in (text or "").lower().split() for b in toxicity.term_buckets(w) if b in place})
    z = model.bias + sum(float(model.weights[i]) for i in on)
    z += sum(float(np.dot(model.factors[i].astype(float), model.factors[j].astype(float))) for k, i in enumerate(on) for j in on[k + 1 :])
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


@pytest.mark.parametrize("rule", ["xor", "and"])
def test_pairs_that_tell_nothing_alone(spark, rule):
    """Toxic by two terms of which neither tells anything (xor), held-out accuracy and every score anew."""
    rng, rows = random.Random(9), []
    for i in range(5000):
        words = [f"word{rng.randrange(60)}" for _ in range(12)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["blorg!"] * insult + ["martians"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult != group if rule == "xor" else insult and group)))
    rows.append((5000, "blorg " + "word3 " * 200_000, 1))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, Scratch(spark, "t"))
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if got[i].held_out]
    assert sum(int(got[i].score >= 0.5) == y for i, y in held) > 0.95 * len(held)
    for i, t, _ in rows[::25] + rows[-1:]:
        assert abs(got[i].score - naive(model, t)) < 1e-5
    again = toxicity.fit(docs.repartition(5), labels, Scratch(spark, "t"))
    assert again.buckets == model.buckets and np.array_equal(again.factors, model.factors)
