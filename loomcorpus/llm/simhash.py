"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is split into ``blocks`` blocks. Two fingerprints that differ in at most
``distance`` bits agree on at least ``blocks - distance`` of them, so joining on every choice of
that many blocks finds every such pair; the Hamming distance is then verified. Equal
fingerprints are one class from the start. A bucket of many different fingerprints is dealt into
parts whose pairs are compared by different tasks, and a task hands on a spanning forest of the
links it found, never all pairs.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links
like any other; a null ``doc_id`` takes part but is never the smallest id (its component is null
if no document of its group has an id); rows that repeat an id count once more; texts of any
length are taken whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcorpus.llm.shared import Scratch, connected_components

BITS = 64
SEED = 42
LAST = 2**63 - 1


def fingerprint(text: str | None, words: int = 4) -> int:
    """The SimHash of a text's word shingles as an unsigned number."""
    import xxhash

    # bytes.lower() changes A-Z only, bytes.split() splits at \x20 and \x09-\x0D
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        shingles = list(map(b" ".join, zip(*[parts[k:] for k in range(words)], strict=False)))
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(BITS, np.int64), len(shingles)
    for at in range(0, n, 1 << 16):
        hashes = np.fromiter((digest(s, SEED) for s in shingles[at : at + (1 << 16)]), np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp, rid): every document's fingerprint, and its text's hash as the engine has it, as signed longs."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            texts = b.column(1).to_pylist()
            found = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            own = np.array([SEED if t is None else xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), SEED) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64()), pa.array(own, pa.int64())], ["doc_id", "fp", "rid"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long, rid long")


def block_keys(fp, distance: int, blocks: int):
    """The keys of a fingerprint: one for each choice of blocks that must agree."""
    edges = [round(BITS * k / blocks) for k in range(blocks + 1)]
    values = [F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) for k in range(blocks)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        key, room = F.lit(n).cast("long"), 0
        for k in chosen:
            key = F.shiftleft(key, edges[k + 1] - edges[k]).bitwiseOR(values[k])
            room += edges[k + 1] - edges[k]
        keys.append(key)
    return F.array(*keys)


def _forest(fp: np.ndarray, side: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the links among ``fp``; with sides, of those across."""
    links, left = [], np.arange(len(fp))
    queue: list[int] = []
    while len(left) or queue:
        if queue:
            i = queue.pop()
        else:
            i, left = int(left[0]), left[1:]
        if not len(left):
            continue
        near = np.bitwise_count(fp[left] ^ fp[i]) <= distance
        if side is not None:
            near &= side[left] != side[i]
        found = left[near]
        links += [(i, int(j)) for j in found]
        queue += found.tolist()
        left = left[~near]
    return links


def _links(distance: int, small: int = 8):
    """Links of sorted rows (key, pa, pb, side, fp): spanning forests of each (key, pa, pb)."""

    def of(key, pa_, pb, side, fp):
        fp = fp.view(np.uint64)
        change = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pa_[1:] != pa_[:-1]) | (pb[1:] != pb[:-1])])
        sizes = np.diff(np.r_[change, len(key)])
        run = np.repeat(np.arange(len(sizes)), sizes)
        out_a, out_b = [], []
        keep = sizes[run] <= small
        at, group = np.flatnonzero(keep), run[keep]
        for d in range(1, small):
            if len(at) <= d:
                break
            same = group[d:] == group[:-d]
            i, j = at[:-d][same], at[d:][same]
            near = np.bitwise_count(fp[i] ^ fp[j]) <= distance
            near &= (pa_[i] == pb[i]) | (side[i] != side[j])
            out_a.append(fp[i][near])
            out_b.append(fp[j][near])
        for r in np.flatnonzero(sizes > small):
            rows = slice(change[r], change[r] + sizes[r])
            across = pa_[change[r]] != pb[change[r]]
            found = np.array(_forest(fp[rows], side[rows] if across else None, distance), np.int64).reshape(-1, 2) + change[r]
            out_a.append(fp[found[:, 0]])
            out_b.append(fp[found[:, 1]])
        none = [np.zeros(0, np.uint64)]
        return np.concatenate(none + out_a).view(np.int64), np.concatenate(none + out_b).view(np.int64)

    def run(batches):
        import pyarrow as pa

        held: list[list[np.ndarray]] = []

        def flush(columns):
            a, b = of(*columns)
            for at in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 50_000]), pa.array(b[at : at + 50_000])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
            held.append(columns)
            if sum(len(h[0]) for h in held) < 50_000:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            # the last run may go on in the next batch
            last = (columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]) | (columns[2] != columns[2][-1])
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield from flush([c[:cut] for c in columns])
            held = [[c[cut:] for c in columns]]
        if held:
            yield from flush([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _components(docs: DataFrame, scratch: Scratch, words: int = 4, distance: int = 4, blocks: int = 6, part: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, rid) of every document and (fp, first, component) of every fingerprint.

    blocks: at 6 and distance 4 a key has 21 or 22 bits; more blocks give longer keys and more
    of them, for tables of many millions of different texts. part: fingerprints of a bucket that
    one task compares with each other.
    """
    fps = scratch.keep(fingerprints(docs, words))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    keyed = classes.select("fp", F.explode(block_keys(F.col("fp"), distance, blocks)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = keyed.join(shared.hint("merge"), "key").withColumn("parts", F.ceil(F.col("n") / part).cast("long"))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("fp"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("side", "other").alias("pa"), F.greatest("side", "other").alias("pb"), "side", "fp")
    dealt = dealt.repartition("key", "pa", "pb").sortWithinPartitions("key", "pa", "pb", "fp")
    links = dealt.mapInArrow(_links(distance), "a long, b long")
    found = connected_components(links, scratch)
    labelled = classes.join(found.select(F.col("id").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return fps, scratch.keep(labelled)


def grouped(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is its group's smallest doc_id.

    options: ``words`` of a shingle, ``distance``, ``blocks`` and ``part``.
    """
    fps, labelled = _components(docs, scratch, **options)
    firsts = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = labelled.join(firsts, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def kept_documents(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """One document of each group, with all columns: that of the smallest doc_id, then of the smaller text hash.

    Documents without an id come after all others. Rows equal in id and text are one document, of
    which one row stays; rows that share an id or have none, with texts of different groups, stay
    for each group that they are the first of.
    """
    fps, labelled = _components(docs, scratch, **options)
    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "rid")
    tops = fps.groupBy("fp").agg(F.min(place).alias("top")).join(labelled.select("fp", "component"), "fp").groupBy("component").agg(F.min("top").alias("top"))
    stay = scratch.keep(tops.select(F.col("top.id").alias("__id"), F.col("top.rid").alias("__rid")))
    known = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("__text", F.xxhash64("text"))
    one = known.join(stay, (F.col("__doc") == F.col("__id")) & (F.col("__text") == F.col("__rid")), "left_semi").dropDuplicates(["__doc", "__text"])
    return one.select(*[F.col(f"`{c}`") for c in docs.columns])
