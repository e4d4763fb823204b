"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents, shuffled by a hash, form one stream of words that repeats when it is
used up. The stream is cut into blocks of equal words. The schedule is a golden-ratio lattice:
slot ``i`` of ``M`` has the point ``(i * g mod M) / M`` with ``g`` next to ``M`` divided by the
golden ratio and prime to ``M``; the point, mapped through the cumulative target weights, names
the slot's source. The ``r``-th slot of a source takes block ``r`` of its stream. As the lattice
visits every point once, each source gets exactly the slots of its weight, evenly spread.

Everything is DataFrame code. Prefix sums and ranks that run over a whole source are made in
two steps (within hash buckets, then over bucket totals), so a source that holds a third of all
rows is dealt over many tasks.

Defined cases: a null text has size 0; a null source is a source of its own, after the others;
a document without a ``doc_id`` is dealt by its text; repeated rows count as documents of their
own; texts of any length are counted whole; a document of which nothing is taken has no slot; an
empty table gives no rows; other columns are carried through by ``mixed_documents`` and ignored
elsewhere. Rows that differ in nothing but a column that cannot be hashed (a map, a variant) are
told apart by no order, so which of them is cut is open.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcorpus.llm.shared import Scratch

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = (math.sqrt(5) - 1) / 2


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hashable(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]


class Mixture:
    """The plan of a mix: ``targets`` by source, ``slots`` in schedule order, ``taken`` by document."""

    def __init__(self, docs: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (1.0, 2.0, 3.0), repeats: int = 3, share: float = 1.0, block: int = 512, buckets: int = 4096):
        """weights: of the sources in code point order, repeating. share: of all words. block: words a slot takes; grows only to keep the slots below 2**31. buckets: a power of 16, of the shuffled order."""
        spark = docs.sparkSession
        digits = round(math.log(buckets, 16))
        narrow = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("src"), word_count(F.col("text")).alias("size"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("="), F.col("text")), F.lit("")).alias("name"), F.xxhash64(*_hashable(docs)).alias("__hash"))
        # without an id the text deals a document, so that many such rows are no one key
        narrow = narrow.withColumn("key", F.md5(F.col("name").cast("binary")))
        narrow = narrow.withColumn("bucket", F.conv(F.substring("key", 1, digits), 16, 10).cast("long"))
        # the order of repeated ids is by size and then by content, so reruns agree
        order = W.partitionBy("src", "bucket").orderBy("key", "size", "__hash")
        narrow = narrow.withColumn("before", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)))
        narrow = narrow.withColumn("occ", F.row_number().over(W.partitionBy("src", "bucket", "key").orderBy("size", "__hash")))
        rows = scratch.keep(narrow.select("doc_id", "src", "size", "__hash", "key", "bucket", "occ", F.coalesce("before", F.lit(0)).cast("long").alias("before")))
        totals = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
        totals = scratch.keep(totals.withColumn("offset", F.coalesce(F.sum("words").over(W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")))

        # targets: the level at which min(weight * level, repeats * size) sums to the share
        sizes = totals.groupBy("src").agg(F.sum("words").cast("long").alias("source_size"))
        w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(W.orderBy(F.col("src") == "", "src")) - 1, F.lit(len(weights))) + 1).cast("int"))
        every = W.orderBy("cap_at", "src")
        sized = sizes.withColumn("weight", w).withColumn("cap_at", F.lit(repeats) * F.col("source_size") / F.col("weight"))
        sized = sized.withColumn("left", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum(F.lit(repeats) * F.col("source_size")).over(every.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        sized = sized.withColumn("level", F.col("left") / F.sum("weight").over(every.rowsBetween(0, W.unboundedFollowing)))
        sized = sized.withColumn("level", F.max("level").over(W.partitionBy()))
        sized = sized.withColumn("target", F.least(F.col("weight") * F.col("level"), (F.lit(repeats) * F.col("source_size")).cast("double")))
        sized = sized.withColumn("quota", F.round("target").cast("long"))
        self.targets = scratch.keep(sized.select("src", "source_size", "weight", "target", "quota"))
        total = self.targets.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
        self.block = max(block, -(-int(total) // 2**31))

        # slots: the lattice, written per source and ranked by schedule position
        counted = self.targets.withColumn("n", F.ceil(F.col("quota") / F.lit(self.block)).cast("long"))
        counted = counted.withColumn("low", F.coalesce(F.sum("n").over(W.orderBy("src").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))
        m = int(counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        g = max(1, round(m * GOLDEN))
        while math.gcd(g, max(m, 1)) != 1:
            g += 1
        back = pow(g, -1, m) if m > 1 else 0
        chunk = 1 << 14
        pieces = counted.where("n > 0").select("src", "low", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long"))).alias("at"))
        points = pieces.repartition(spark.sparkContext.defaultParallelism, "src", "at").select("src", F.explode(F.sequence(F.col("low") + F.col("at"), F.col("low") + F.least(F.col("n"), F.col("at") + chunk) - 1)).alias("point"))
        slots = points.select("src", F.pmod(F.col("point") * F.lit(back), F.lit(max(m, 1))).cast("long").alias("slot"))
        slots = slots.withColumn("part", F.floor(F.col("slot") / chunk))
        inner = slots.withColumn("r", F.row_number().over(W.partitionBy("src", "part").orderBy("slot")))
        ahead = slots.groupBy("src", "part").count().withColumn("ahead", F.coalesce(F.sum("count").over(W.partitionBy("src").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        self.slots = scratch.keep(inner.join(ahead.drop("count").hint("merge"), ["src", "part"]).select("slot", "src", (F.col("ahead") + F.col("r") - 1).cast("long").alias("r")))

        # documents at their places in the repeating streams, cut at block borders
        placed = rows.join(totals.drop("words"), ["src", "bucket"]).select("doc_id", "src", "size", "__hash", "key", "occ", (F.col("offset") + F.col("before")).alias("start"))
        placed = placed.join(self.targets, "src")
        self.placed = placed
        turn = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn")
        turns = placed.where("size > 0").select("doc_id", "src", "key", "occ", "size", "quota", "source_size", "start", turn)
        turns = turns.withColumn("low", F.col("turn") * F.col("source_size") + F.col("start")).withColumn("high", F.least(F.col("low") + F.col("size"), F.col("quota"))).where("low < high")
        cut = turns.withColumn("r", F.explode(F.sequence(F.floor(F.col("low") / self.block).cast("long"), F.floor((F.col("high") - 1) / self.block).cast("long"))))
        cut = cut.select("doc_id", "src", "key", "occ", "turn", "r", F.greatest("low", F.col("r") * self.block).alias("low"), F.least("high", (F.col("r") + 1) * self.block).alias("high"), F.col("low").alias("first"))
        self.parts = cut.join(self.slots.hint("merge"), ["src", "r"]).select("slot", "doc_id", "src", "key", "occ", "turn", (F.col("low") - F.col("first")).alias("word_from"), (F.col("high") - F.col("low")).alias("words"))
        taken = self.parts.groupBy("src", "key", "occ").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
        self.taken = placed.join(taken, ["src", "key", "occ"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, scratch: Scratch, in_order: bool = False, **options) -> DataFrame:
    """The mix as documents: a row for every pass over a document, with all its columns.

    in_order: by the slots that the passes begin in, over range partitions and within them.

    A pass that the mix ends inside a document keeps the words up to there and the white space
    between them. Rows of one document in several passes are equal.
    """
    mix = Mixture(docs, scratch, **options)
    hashed = docs.withColumn("__hash", F.xxhash64(*_hashable(docs)))
    hashed = hashed.withColumn("__n", F.row_number().over(W.partitionBy("doc_id", "__hash").orderBy(F.lit(0))))
    begun = F.array_sort(F.collect_list(F.struct("turn", "slot")))
    if in_order:
        turns = mix.parts.groupBy("src", "key", "occ", "turn").agg(F.min("slot").alias("slot")).groupBy("src", "key", "occ").agg(begun.alias("begun"))
        named = mix.taken.join(turns, ["src", "key", "occ"], "left")
    else:
        named = mix.taken.withColumn("begun", F.lit(None).cast("array<struct<turn:int,slot:bigint>>"))
    takes = named.where("taken > 0").select(F.col("doc_id").alias("__id"), "__hash", "size", "taken", F.col("begun").alias("__begun"), F.row_number().over(W.partitionBy("doc_id", "__hash").orderBy("src", "start")).alias("__n"))
    takes = takes.withColumnRenamed("__hash", "__h").withColumnRenamed("__n", "__m").withColumnRenamed("size", "__size").withColumnRenamed("taken", "__taken")
    both = hashed.join(takes, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")) & (F.col("__n") == F.col("__m")))
    both = both.withColumn("__turn", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__taken") - 1) / F.col("__size")).cast("long"))))
    left = F.least(F.col("__taken") - F.col("__turn") * F.col("__size"), F.col("__size"))
    # the part of a text up to its n-th word, cut only where the mix ends inside the document
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("__left").cast("int")), "")
    both = both.withColumn("__left", left)
    both = both.withColumn("text", F.when(F.col("__left") < F.col("__size"), head).otherwise(F.col("text")))
    if dict(docs.dtypes).get("n_chars") in ("bigint", "int"):
        both = both.withColumn("n_chars", F.when(F.col("__left") < F.col("__size"), F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    if in_order:
        slot = F.get("__begun", F.col("__turn").cast("int"))["slot"]
        both = both.withColumn("__slot", slot).repartitionByRange("__slot", "doc_id").sortWithinPartitions("__slot", "doc_id")
    return both.select(*[F.col(f"`{c}`") for c in docs.columns])
