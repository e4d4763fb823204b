"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products.

Centres are fitted on a bounded sample; every vector belongs to the cell of its nearest centre.
A vector also visits each later cell that may hold a vector within the threshold's angle: a
member ``y`` of cell ``c'`` is no nearer to the visitor's own centre ``c`` than to ``c'``, so
the two can be within the angle only if the visitor is within it of the plane between the
centres. The bound is exact, so no link is lost to the cells. Cells are compared in blocks of
bounded size; a block hands on link counts and a spanning forest of its links.

Equal vectors are one class with a multiplicity from the start, so copies meet no block.

Defined cases: vectors that are null, zero or hold null or non-finite components link with
nothing, nor do rows with a null label or vectors of different length; a null ``vec_id`` is
counted as a linked vector but names no component (its own component is null where no linked
vector has an id); repeated rows are vectors of their own; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcorpus.llm.shared import Scratch, connected_components


def centres(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centres of spherical k-means over unit rows."""
    rng = np.random.default_rng(seed)
    found = sample[rng.permutation(len(sample))[:k]]
    for _ in range(rounds):
        cell = (sample @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, cell, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), found)
    return found


def _matrix(column) -> np.ndarray:
    """Rows of a list column, all of one length, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _assign(found: np.ndarray, threshold: float):
    """(label, cell, home, id, m, vec) for a vector's own cell and the later ones it must visit."""
    reach = math.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9
    # vectors at a time: so that their products with all centres stay some tens of MB
    many = max(1, 4_000_000 // max(1, len(found)))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            lengths = b.column("vec").value_lengths().to_numpy()
            rows, cells, home = [], [], []
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                if not len(found) or size != found.shape[1]:
                    rows.append(at)
                    cells.append(np.zeros(len(at), np.int64))
                    home.append(np.ones(len(at), bool))
                    continue
                for some in np.array_split(at, -(-len(at) // min(many, 2000))):
                    x = _matrix(b.column("vec").take(pa.array(some)))
                    dots = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ found.T
                    own = dots.argmax(1)
                    ahead = dots[np.arange(len(some)), own][:, None] - dots
                    # how far apart unit centres are, from their products
                    gaps = np.sqrt(np.maximum(0, 2 - 2 * (found[own] @ found.T)))
                    goes = (ahead <= reach * gaps + 1e-9) & (np.arange(len(found))[None, :] >= own[:, None])
                    goes[np.arange(len(some)), own] = True
                    i, c = np.nonzero(goes)
                    rows.append(some[i])
                    cells.append(c)
                    home.append(own[i] == c)
            if not rows:
                continue
            rows, cells, home = np.concatenate(rows), np.concatenate(cells), np.concatenate(home)
            for part in np.array_split(np.arange(len(rows)), max(1, -(-len(rows) // 5000))):
                picked = pa.array(rows[part])
                yield pa.RecordBatch.from_arrays([b.column("label").take(picked), pa.array(cells[part], pa.int32()), pa.array(home[part]), b.column("id").take(picked), b.column("m").take(picked), b.column("vec").take(picked)], ["label", "cell", "home", "id", "m", "vec"])

    return run


def _compare(threshold: float):
    """Links of one block of (side, id, m, vec) rows: counts as (id, null, n), forest edges as (a, b, 0)."""

    def run(key, part):
        import pyarrow as pa

        inner = key[-1].as_py()
        ids, m, side = part.column("id").to_numpy(), part.column("m").to_numpy(), part.column("side").to_numpy()
        x = _matrix(part.column("vec").combine_chunks())
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = np.zeros((len(x), len(x)), bool)
        for at in range(0, len(x), 512):
            near[at : at + 512] = x[at : at + 512] @ x.T >= threshold
        if inner:
            np.fill_diagonal(near, False)
        else:
            near &= side[:, None] != side[None, :]
        counts = np.array([m[row].sum() for row in near], np.int64)
        a, b = [], []
        left = np.array([row.any() for row in near])
        while left.any():
            queue = [int(left.argmax())]
            left[queue[0]] = False
            while queue:
                i = queue.pop()
                new = np.flatnonzero(near[i] & left)
                left[new] = False
                a += [ids[i]] * len(new)
                b += ids[new].tolist()
                queue += new.tolist()
        some = np.flatnonzero(counts)
        return pa.table({
            "a": pa.array(np.r_[ids[some], np.array(a, np.int64)], pa.int64()),
            "b": pa.array(ids[some].tolist() and [None] * len(some) + b or b, pa.int64()),
            "n": pa.array(np.r_[counts[some], np.zeros(len(a), np.int64)], pa.int64()),
        })

    return run


def linked(vectors: DataFrame, scratch: Scratch, threshold: float = 0.93, sample: int = 20_000, cells: int | None = None, block: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    sample: rows the centres are fitted on at most. cells: their number; by default it grows
    with the square root of the table, up to a centre for four rows of the sample. block: vectors
    on each side of a product at most.
    """
    vec = F.col("embedding").cast("array<double>")
    good = (F.col("label").isNotNull() & F.col("embedding").isNotNull()) & (F.size("embedding") > 0)
    good &= ~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vec, lambda v: v != 0)
    good = F.coalesce(good, F.lit(False))
    # -0.0 and 0.0 are one value; two hashes name a vector's class
    plain = F.when(good, F.transform(vec, lambda v: v + F.lit(0.0)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, F.col("label").cast("string")).alias("label"), plain.alias("vec"))
    rows = rows.withColumn("h1", F.xxhash64("label", "vec")).withColumn("h2", F.xxhash64(F.lit("second"), "vec", "label"))
    grouped = rows.where("vec is not null").groupBy("label", "h1", "h2").agg(F.first("vec").alias("vec"), F.count("*").alias("m"), F.min("vec_id").alias("first"))
    classes = scratch.keep(grouped.select(F.xxhash64("h1", "h2").alias("id"), "label", "h1", "h2", "vec", "m", "first"))

    n = classes.count()
    k = cells or max(1, min(sample // 4, round(math.sqrt(n) / 16)))
    picked = classes.select("id", "vec").orderBy(F.xxhash64("id")).limit(sample).collect()
    sizes = [len(r.vec) for r in picked]
    found = np.zeros((0, 0))
    if picked:
        size = max(set(sizes), key=sizes.count)
        x = np.array([r.vec for r in picked if len(r.vec) == size])
        found = centres(x / np.linalg.norm(x, axis=1, keepdims=True), min(k, len(x)))

    placed = classes.select("label", "id", "m", "vec").mapInArrow(_assign(found, threshold), "label string, cell int, home boolean, id long, m long, vec array<double>")
    placed = scratch.keep(placed.withColumn("size", F.size("vec")))
    counted = placed.groupBy("label", "size", "cell").agg(F.ceil(F.count_if("home") / block).cast("long").alias("homes"), F.ceil(F.count_if(~F.col("home")) / block).cast("long").alias("guests"))
    dealt = placed.join(counted, ["label", "size", "cell"])
    # a block is a part with itself, two parts of a cell, or a part and a part of the visitors
    own = F.pmod(F.col("id"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests")))
    dealt = dealt.withColumn("own", own)
    with_homes = F.transform(F.sequence(F.lit(0).cast("long"), F.col("homes") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    with_guests = F.when(F.col("guests") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("guests"), F.lit(1)) - 1), lambda g: F.struct(F.col("own").alias("x"), (-1 - g).alias("y")))).otherwise(F.array().cast("array<struct<x:bigint,y:bigint>>"))
    as_guest = F.when(F.col("homes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("homes"), F.lit(1)) - 1), lambda o: F.struct(o.alias("x"), (-1 - F.col("own")).alias("y")))).otherwise(F.array().cast("array<struct<x:bigint,y:bigint>>"))
    dealt = dealt.withColumn("pair", F.explode(F.when(F.col("home"), F.concat(with_homes, with_guests)).otherwise(as_guest)))
    side = F.when(F.col("home"), F.col("own")).otherwise(F.lit(-1) - F.col("own"))
    dealt = dealt.select("label", "size", "cell", "pair.x", "pair.y", (F.col("pair.x") == F.col("pair.y")).alias("inner"), side.alias("side"), "id", "m", "vec")
    out = scratch.keep(dealt.groupBy("label", "size", "cell", "x", "y", "inner").applyInArrow(_compare(threshold), "a long, b long, n long"))

    counts = out.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    joined = connected_components(out.where("b is not null").select("a", "b"), scratch)
    labelled = classes.select("id", "h1", "h2", "label", "m", "first").join(counts, "id", "left").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = scratch.keep(labelled)
    firsts = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = labelled.join(firsts, "component").select("label", "h1", "h2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    several = rows.where("vec is not null").select("vec_id", "label", "h1", "h2").join(by_class, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return several.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
