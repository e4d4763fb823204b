"""Substring dedup by sliding sentence spans.

A text is split into sentences after ``.``, ``!`` or ``?`` before white space and at line ends.
A span is a shortest run of at least ``sentences`` consecutive sentences with at least ``words``
words together: one starts and one ends at every sentence, so a repeated passage is removed up to
its last sentence. Spans are hashed over lower-cased words and
joined globally; the first span of a hash is the one in the smallest ``doc_id`` (and there the
earliest), and every other one is removed. Overlapping removed spans are one range.

Only hashes, ids and character positions leave the Python workers; a span that is very common
is reduced to its first document by partial aggregation and written, and the join back to it is
one that adaptive execution splits by skew.

Defined cases: a null, empty or one-sentence text has no spans; a text of any length is taken
whole. Rows of one ``doc_id`` and one text are one document, of which nothing is removed for the
other's sake; rows that share an id, or have none, with different texts are different documents,
in the order of hashes of their texts; those without an id come after all others. An empty table
gives no rows; other columns are kept by ``cleaned`` and not read elsewhere. Spans are told apart
by 64 hash bits, texts of one id by as many.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcorpus.llm.shared import Scratch

BREAK = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
LAST = 2**63 - 1


def _sentences(text: str | None) -> tuple[list[int], list[int], list[bytes], list[int]]:
    """Start, end, lower-cased words and number of words of each sentence."""
    starts, ends, parts, counts, at = [], [], [], [], 0
    if not text:
        return starts, ends, parts, counts
    for m in BREAK.finditer(text):
        if m.start() > at:
            starts.append(at)
            ends.append(m.start())
        at = m.end()
    if at < len(text):
        starts.append(at)
        ends.append(len(text))
    for a, b in zip(starts, ends, strict=True):
        found = text[a:b].lower().split()
        parts.append(" ".join(found).encode("utf-8", "surrogatepass"))
        counts.append(len(found))
    return starts, ends, parts, counts


def _runs(counts: list[int], sentences: int, words: int) -> Iterator[tuple[int, int]]:
    """(first, last) of the shortest run that is long enough from each sentence."""
    last, total, n = -1, 0, len(counts)
    for i in range(n):
        # [i, last] is the shortest run that is long enough
        while last + 1 < n and (total < words or last - i + 1 < sentences):
            last += 1
            total += counts[last]
        if total < words or last - i + 1 < sentences:
            return
        yield i, last
        total -= counts[i]


def _hashed(parts: list[bytes]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b"\n".join(parts), 9) - 2**63


def sentence_spans(text: str | None, sentences: int = 2, words: int = 20) -> Iterator[tuple[int, int, int]]:
    """(hash, start, end) of the spans that start or end at each sentence, by position.

    Any run that is long enough is covered by those of them that lie within it: its sentences up
    to the end of its first span by that, each later one by the span that ends there.
    """
    starts, ends, parts, counts = _sentences(text)
    last = len(counts) - 1
    both = set(_runs(counts, sentences, words))
    both.update((last - j, last - i) for i, j in _runs(counts[::-1], sentences, words))
    for i, j in sorted(both):
        yield _hashed(parts[i : j + 1]), starts[i], ends[j]


def _spans(sentences: int, words: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [], [])

            def batch(out=out):
                return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:3]], *[pa.array(np.array(c, np.int32)) for c in out[3:5]], pa.array(out[5], pa.bool_())], ["hash", "doc_id", "rid", "start", "end", "again"])

            for i, text in zip(ids, texts, strict=True):
                seen: set[int] = set()
                # as the engine's own function has it
                rid = np.uint64(xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), 42)).astype(np.int64)
                for h, start, end in sentence_spans(text, sentences, words):
                    for column, v in zip(out, (h, i, rid, start, end, h in seen), strict=True):
                        column.append(v)
                    seen.add(h)
                if len(out[0]) > 50_000:
                    yield batch()
                    for column in out:
                        column.clear()
            yield batch()

    return run


def removed_ranges(docs: DataFrame, scratch: Scratch, sentences: int = 2, words: int = 20) -> DataFrame:
    """(doc_id, rid, start, end, spans, first_doc_id): character ranges that repeat an earlier text.

    rid: the hash of the text, which tells rows of one id apart. first_doc_id is the smallest
    document that one of the range's spans was first seen in.
    """
    found = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text").mapInArrow(_spans(sentences, words), "hash long, doc_id long, rid long, start int, end int, again boolean")
    found = scratch.keep(found)
    # a document's place in one number, of fixed width so that partial aggregation needs no sorting
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + F.pmod("rid", F.lit(2**32)).cast("decimal(10,0)")
    found = found.withColumn("place", place.cast("decimal(38,0)"))
    first = found.groupBy("hash").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.max("again").alias("again_in")).where("first < last or again_in").select("hash", "first")
    hits = found.join(scratch.keep(first).hint("merge"), "hash").where("place > first or again").select("doc_id", "rid", "start", "end", F.floor(F.col("first") / F.lit(2**32).cast("decimal(10,0)")).cast("long").alias("first"))
    # ranges: a span that starts after all earlier ones ended begins a new one
    order = W.partitionBy("doc_id", "rid").orderBy("start", "end")
    hits = hits.withColumn("reach", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    hits = hits.withColumn("range", F.sum((F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = hits.groupBy("doc_id", "rid", "range").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("spans"), F.min("first").alias("first_doc_id"))
    return out.select(F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "rid", "start", "end", "spans", F.nullif("first_doc_id", F.lit(LAST)).alias("first_doc_id"))


def cleaned(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The documents with their removed ranges cut out of ``text``; other columns stay."""
    ranges = removed_ranges(docs, scratch, **options)
    cut = ranges.groupBy(F.col("doc_id").alias("__id"), F.col("rid").alias("__rid")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cut"))

    @F.pandas_udf("string")
    def without(text: pd.Series, cut: pd.Series) -> pd.Series:
        def one(t, ranges):
            if t is None or ranges is None:
                return t
            kept, at = [], 0
            for r in ranges:
                kept.append(t[at : r["start"]])
                at = r["end"]
            return "".join([*kept, t[at:]]).strip()

        return pd.Series([one(t, c) for t, c in zip(text, cut, strict=True)], dtype=object)

    both = docs.join(cut, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__rid")), "left")
    return both.select(*[without("text", "__cut").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
