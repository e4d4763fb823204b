"""Toxicity scores from a factorization machine over hashed terms.

A text's terms are its lower-cased words without signs around them and the words' first four
and five characters, each hashed into ``2**BITS`` buckets and counted once. On a bounded sample
of labelled rows those buckets are chosen that tell the classes apart best by themselves, and
those that do so with another one, whether either tells anything alone or not. A factorization
machine learns a weight and a factor vector for each; the product of two factor vectors is what
the two terms say together beyond their own weights, such as an insult next to a group's name.
All texts are scored whole.

Defined cases: a null or empty text, or one without a learnt term, has the model's base score; a
text of any length has one number a term; a null ``doc_id`` is scored like any other and is never
in the training sample; without usable labels every score is the smoothed base rate; repeated
labels of a document count once, as the highest; documents that repeat a labelled id are rows of
their own; of equally telling buckets the smaller number comes first; an empty table gives no rows; other columns are not read.
"""

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcorpus.llm.shared import Scratch

BITS = 20
SIGNS = ".,;:!?\"'()[]{}<>*_-#&%$/\\|~`^+=@"


def term_buckets(word: str) -> tuple[int, ...]:
    """The buckets of a word's terms."""
    w = word.strip(SIGNS)
    if not w:
        return ()
    mask = (1 << BITS) - 1
    found = {zlib.crc32(b"w" + w.encode("utf-8", "replace")) & mask}
    if len(w) > 4:
        found.add(zlib.crc32(b"4" + w[:4].encode("utf-8", "replace")) & mask)
    if len(w) > 5:
        found.add(zlib.crc32(b"5" + w[:5].encode("utf-8", "replace")) & mask)
    return tuple(found)


class Terms:
    """The chosen buckets of texts, with what seen words give kept up to ``limit`` words."""

    def __init__(self, chosen: dict[int, int] | None = None, limit: int = 400_000):
        self.chosen, self.limit = chosen, limit
        self.seen: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> set[int]:
        out: set[int] = set()
        if not text:
            return out
        if len(self.seen) > self.limit:
            self.seen.clear()
        seen, chosen = self.seen, self.chosen
        for word in set(text.lower().split()):
            found = seen.get(word)
            if found is None:
                found = term_buckets(word)
                if chosen is not None:
                    found = tuple(chosen[b] for b in found if b in chosen)
                seen[word] = found
            if found:
                out.update(found)
        return out


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of ``values``, so many for each of ``sizes``."""
    padded = np.concatenate([values, np.zeros((1, *values.shape[1:]), values.dtype)])
    out = np.add.reduceat(padded, np.cumsum(sizes) - sizes, axis=0) if len(sizes) else padded[:0]
    out[sizes == 0] = 0
    return out


@dataclass
class Model:
    """bias, one weight and ``k`` factors for each learnt bucket."""

    buckets: list[int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, active: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of texts with so many features each, which ``active`` has in turn."""
        v = self.factors[active].astype(np.float64)
        total, own = _sums(v, sizes), _sums((v * v).sum(1), sizes)
        z = self.bias + _sums(self.weights[active].astype(np.float64), sizes) + 0.5 * ((total * total).sum(1) - own)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(y: np.ndarray, active: np.ndarray, begins: np.ndarray, sizes: np.ndarray, buckets: list[int], factors: int = 8, epochs: int = 15, steps: int = 1200, batch: int = 512, rate: float = 0.02, decay: float = 3e-5, seed: int = 7) -> Model:
    """Fits a model by mini-batch Adam: ``epochs`` passes, and ``steps`` steps at least.

    y: labels of the rows. Those of a row are the ``sizes`` features from ``begins`` on in ``active``.
    """
    rng = np.random.default_rng(seed)
    n, d = len(y), len(buckets)
    y = y.astype(np.float32)
    rate0 = (float(y.sum()) + 1) / (n + 2)
    bias = math.log(rate0 / (1 - rate0))
    params = [np.array([bias], np.float32), np.zeros(d, np.float32), rng.normal(0, 0.05, (d, factors)).astype(np.float32)]
    if not d or not n or y.min() == y.max():
        return Model(buckets, bias, params[1], params[2] * 0)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for _ in range(max(epochs, -(-steps // -(-n // batch)))):
        for at in np.array_split(rng.permutation(n), -(-n // batch)):
            t += 1
            many = sizes[at]
            row = np.repeat(np.arange(len(at)), many)
            x = active[np.arange(len(row)) + np.repeat(begins[at] - (np.cumsum(many) - many), many)]
            v = params[2][x]
            total = _sums(v, many)
            z = params[0][0] + _sums(params[1][x], many) + 0.5 * ((total * total).sum(1) - _sums((v * v).sum(1), many))
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / len(at)
            each = e[row]
            pull = each[:, None] * (total[row] - v)
            grads = [np.array([e.sum()], np.float32), np.bincount(x, each, d).astype(np.float32), np.stack([np.bincount(x, pull[:, j], d) for j in range(factors)], 1).astype(np.float32)]
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                if p is not params[0]:
                    g += decay * p
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return Model(buckets, float(params[0][0]), params[1], params[2])


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_rows: int = 20_000, max_terms: int = 1024, in_pairs: int = 1000) -> Model:
    """A model from at most ``max_rows`` labelled rows outside the held-out fold.

    The sample is those with the smallest hash of the id. Only ``labels`` decides about it, so
    its size bounds what is broadcast and what the driver gets: a label and at most
    ``max_terms + in_pairs`` numbers a row. max_terms: buckets that are learnt for what they tell
    alone. in_pairs: the most frequent buckets, every two of which are tried for what they tell
    together; those of pairs that do are learnt as well.
    """
    sample = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    sample = scratch.keep(sample.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")

    def all_buckets(batches):
        import pyarrow as pa

        terms = Terms()
        for b in batches:
            found = [sorted(terms.of(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "y", "buckets"])

    rows = scratch.keep(texts.mapInArrow(all_buckets, "doc_id long, y int, buckets array<int>"))

    def counts(batches):
        import pyarrow as pa

        seen = [np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)]
        for b in batches:
            y = b.column(1).to_numpy()
            flat = b.column(2).flatten().to_numpy()
            which = np.repeat(y, b.column(2).value_lengths().to_numpy())
            for c in (0, 1):
                seen[c] += np.bincount(flat[which == c], minlength=1 << BITS)
        at = np.flatnonzero(seen[0] + seen[1])
        for part in np.array_split(at, max(1, len(at) // 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[0][part]), pa.array(seen[1][part])], ["bucket", "neg", "pos"])

    sums = rows.mapInArrow(counts, "bucket long, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n0, n1 = float(size.get(0, 0)), float(size.get(1, 0))
    if not n0 or not n1:
        none = np.zeros(int(n0 + n1), np.int64)
        return train(np.repeat(np.array([0, 1]), [int(n0), int(n1)]), none[:0], none, none, [])

    def part(seen, expected):
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    pos, neg, all_ = F.col("pos").cast("double"), F.col("neg").cast("double"), F.lit(n0 + n1)
    have = pos + neg
    told = sum((part(a, have * n / all_) + part(F.lit(n) - a, (all_ - have) * n / all_) for a, n in ((pos, n1), (neg, n0))), F.lit(0.0))
    best = [r["bucket"] for r in sums.where("pos + neg >= 3").withColumn("told", told).where("told > 6.6").orderBy(F.desc("told"), "bucket").limit(max_terms).collect()]
    often = [r["bucket"] for r in sums.where(have < 0.98 * (n0 + n1)).orderBy(F.desc(have), "bucket").limit(in_pairs).collect()]
    wanted = best + sorted(set(often) - set(best))
    place = {b: i for i, b in enumerate(wanted)}

    def chosen(batches):
        import pyarrow as pa

        for b in batches:
            out = [[place[k] for k in row if k in place] for row in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "y", "active"])

    got = rows.mapInArrow(chosen, "doc_id long, y int, active array<int>").toArrow().to_batches()
    ids, y = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in got]) for c in ("doc_id", "y"))
    sizes = np.concatenate([b.column("active").value_lengths().to_numpy(zero_copy_only=False) for b in got]).astype(np.int64)
    active = np.concatenate([b.column("active").flatten().to_numpy(zero_copy_only=False) for b in got])
    # the terms of pairs, and of what is left the numbers of learnt features
    tells = paired(y, active, sizes, np.array([place[b] for b in often], np.int64), len(wanted))
    learnt = np.concatenate([np.arange(len(best)), np.setdiff1d(tells, np.arange(len(best)))]).astype(np.int64)
    number = np.full(len(wanted), -1, np.int64)
    number[learnt] = np.arange(len(learnt))
    active = number[active]
    sizes = _sums((active >= 0).astype(np.int64), sizes)
    active = active[active >= 0]
    # in an order that does not depend on how the rows came
    begins = np.cumsum(sizes) - sizes
    order = np.lexsort((_sums(active, sizes), sizes, ids))
    return train(y[order], active, begins[order], sizes[order], [wanted[i] for i in learnt])


def _g2(pos: np.ndarray, neg: np.ndarray, share: float) -> np.ndarray:
    """What counts of the two classes add to the deviance, against a common share of the first."""
    n = pos + neg
    out = np.zeros(np.shape(n))
    for seen, expected in ((pos, n * share), (neg, n * (1 - share))):
        np.add(out, 2 * seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1)), out=out)
    return out


def paired(y: np.ndarray, active: np.ndarray, sizes: np.ndarray, often: np.ndarray, d: int, least: float = 40.0) -> np.ndarray:
    """Features of pairs among ``often`` that tell by ``least`` more together than what each tells alone.

    least: of deviance; chance exceeds 40 for about one pair in ten thousand million.
    """
    k, at = len(often), np.full(d, -1)
    at[often] = np.arange(k)
    both = np.zeros((2, k, k))
    ends = np.cumsum(sizes)
    for c in (0, 1):
        for some in np.array_split(np.flatnonzero(y == c), max(1, -(-int((y == c).sum()) // 1000))):
            x = np.zeros((len(some), k), np.float32)
            for i, r in enumerate(some):
                on = at[active[ends[r] - sizes[r] : ends[r]]]
                x[i, on[on >= 0]] = 1
            both[c] += x.T @ x
    total = np.array([(y == 0).sum(), (y == 1).sum()], float)
    share = total[1] / total.sum()
    one = both[:, np.arange(k), np.arange(k)]
    alone = _g2(one[1], one[0], share) + _g2(total[1] - one[1], total[0] - one[0], share)
    found: list[np.ndarray] = []
    # rows at a time, so that tables of all pairs stay few
    for i in range(0, k, 100):
        a = both[:, i : i + 100]
        first, second = one[:, i : i + 100, None], one[:, None, :]
        cells = (a, first - a, second - a, total[:, None, None] - first - second + a)
        told = sum(_g2(np.maximum(c[1], 0), np.maximum(c[0], 0), share) for c in cells)
        more = told - alone[i : i + 100, None] - alone[None, :]
        p, q = np.nonzero(more > least)
        keep = p + i < q
        found += [often[p[keep] + i], often[q[keep]]]
    return np.unique(np.concatenate([np.zeros(0, np.int64), *found]))


def held_out(doc_id):
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _scores(model: Model, terms: "Terms", texts: list[str | None]) -> np.ndarray:
    """Scores of texts, so many at a time as have some hundred thousand characters."""
    out, some, size = [np.zeros(0)], [], 0
    for k, t in enumerate(texts):
        some.append(terms.of(t))
        size += len(t or "")
        if size > 500_000 or k + 1 == len(texts):
            sizes = np.array([len(x) for x in some], np.int64)
            out.append(model.scores(np.fromiter((f for x in some for f in sorted(x)), np.int64, int(sizes.sum())), sizes))
            some, size = [], 0
    return np.concatenate(out)


def scored(docs: DataFrame, model: Model, column: str = "score", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def run(batches):
        import pyarrow as pa

        terms = Terms({b: i for i, b in enumerate(model.buckets)})
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(model, terms, b.column(1).to_pylist()), pa.float64())], ["doc_id", column])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {column} double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), column, (F.col(column) >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms({b: i for i, b in enumerate(model.buckets)})
        for texts in parts:
            yield pd.Series(_scores(model, terms, texts.tolist()))

    return docs.where(score(F.col("text")) < threshold)
