"""Exact top-k search over 64-bit codes by incremental multi-index hashing.

Codes are cut into four segments of 16 bits, each indexed by value. In round ``r`` a query
looks up, in every segment, the values that differ from its own in exactly ``r`` bits. A code
at distance ``d`` has a segment at distance ``d // 4`` or less, so after round ``r`` every code
within ``4 * r + 3`` has been seen: a query ends when its k-th verified distance is within that.
Candidates are verified in the join itself against the query's k-th distance so far, and counted
only in the first segment that is nearest, so no pair is met twice.

Equal codes are one entry that names its ``k + 1`` smallest ids, enough for any answer; queries
of equal codes are searched once.

Defined cases: vectors of other lengths than 64 have a code, too (``sign_code``); rows with a null id or code are neither indexed nor asked; a row is not its own
neighbour, but an equal code of another row is; ties are broken by the smaller id; repeated rows
of one id count once; a table of fewer than ``k + 1`` rows gives what there is; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcorpus.llm.shared import Scratch

SEGMENTS, WIDTH = 4, 16


def sign_code(vec: Column) -> Column:
    """A vector's code: bit ``i`` is set where the sum of components i, i + 64, i + 128 .. is positive.

    With 64 components or fewer that is the component itself. A null component counts as zero, a
    NaN as positive; the code of a null vector is null, that of an empty one zero.
    """

    def packed(sums: Column) -> Column:
        bits = F.transform(sums, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    folded = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.aggregate(F.filter(vec, lambda v, j: F.pmod(j, F.lit(64)) == i), F.lit(0.0), lambda a, v: a + F.coalesce(v.cast("double"), F.lit(0.0))))
    return F.when(vec.isNotNull(), F.when(F.size(vec) <= 64, packed(vec)).otherwise(packed(folded)))


def _segment(code: Column, j: int) -> Column:
    return F.shiftrightunsigned(code, WIDTH * j).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def nearest(codes: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 10) -> DataFrame:
    """(query_id, rank, neighbour_id, distance) over ``codes`` and ``queries`` of (id, code)."""
    ranked = codes.where("id is not null and code is not null").select("id", "code").distinct().withColumn("n", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = scratch.keep(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    index = entries.select("code", F.col("ids")[0].alias("least"), F.size("ids").alias("size"), F.explode(F.array(*[F.struct(F.lit(j).alias("seg"), _segment(F.col("code"), j).alias("value")) for j in range(SEGMENTS)])).alias("at")).select("code", "least", "size", "at.seg", "at.value")
    index = scratch.keep(index)
    asked = queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct()
    asked = scratch.keep(asked)
    active = scratch.keep(asked.select("q").distinct().withColumn("bound", F.lit(64)))
    best: DataFrame | None = None
    ended: list[DataFrame] = []
    for r in range(WIDTH + 1):
        # many rows from few: dealt out first, and joined by sorting whatever the planner expects
        probes = active.repartition(codes.sparkSession.sparkContext.defaultParallelism, "q").withColumn("masks", _mask_array(r))
        probes = probes.select("q", "bound", F.explode("masks").alias("mask"))
        probes = probes.select("q", "bound", F.explode(F.array(*[F.struct(F.lit(j).alias("seg"), _segment(F.col("q"), j).bitwiseXOR(F.col("mask")).alias("value")) for j in range(SEGMENTS)])).alias("at")).select("q", "bound", "at.seg", "at.value")
        x = F.col("q").bitwiseXOR(F.col("code"))
        own = F.coalesce(*[F.when((F.col("seg") == j) & _first_nearest(x, j, r), F.lit(True)) for j in range(SEGMENTS)], F.lit(False))
        hits = probes.join(index.hint("merge"), ["seg", "value"]).where((F.bit_count(x) <= F.col("bound")) & own).select("q", "code", "least", "size", F.bit_count(x).cast("int").alias("distance"))
        if best is not None:
            hits = hits.unionByName(best.join(active.select("q"), "q", "left_semi").select(*hits.columns))
        order = W.partitionBy("q").orderBy("distance", "least")
        top = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).withColumn("have", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
        best = scratch.keep(top.drop("n"))
        seen = best.groupBy("q").agg(F.min(F.when(F.col("have") >= k + 1, F.col("distance"))).alias("kth"))
        state = scratch.keep(active.select("q").join(seen, "q", "left").select("q", F.coalesce("kth", F.lit(64)).alias("bound")))
        covered = SEGMENTS * r + SEGMENTS - 1
        done = state.where(F.col("bound") <= covered) if r < WIDTH else state
        ended.append(best.join(done.select("q"), "q", "left_semi"))
        active = state.where(F.col("bound") > covered)
        if active.isEmpty():
            break
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    full = asked.join(found, "q").join(entries.select("code", "ids"), "code").select("query_id", "distance", F.explode("ids").alias("neighbour_id")).where("query_id <> neighbour_id")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return full.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "distance")


def _mask_array(r: int) -> Column:
    """All masks of ``r`` bits, made by the engine."""
    return F.filter(F.sequence(F.lit(0), F.lit((1 << WIDTH) - 1)), lambda m: F.bit_count(m) == r)


def _first_nearest(x: Column, j: int, r: int) -> Column:
    """Segment ``j`` differs in ``r`` bits, no segment in fewer, and none before it in as few."""
    parts = [F.bit_count(_segment(x, i)) for i in range(SEGMENTS)]
    out = parts[j] == r
    for i in range(SEGMENTS):
        if i != j:
            out = out & (parts[i] > r if i < j else parts[i] >= r)
    return out
