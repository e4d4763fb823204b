"""Fuzzy line dedup by MinHash, with DataFrame functions only.

Lines are compared lower-cased and trimmed; equal ones are one class from the start. A line's
set is its character shingles. Its signature is, for each of ``bands * rows`` fixed points of the
64-bit hash space, the shingle hash nearest to that point by XOR; two sets agree on a point with
the probability of their Jaccard similarity. Lines that share a band are candidates; the exact
Jaccard similarity over all shingles decides. At similarity 0.8 a pair shares one of 8 bands of 4
rows with probability 0.985, at 0.85 with 0.997.

Links join into components, of which the first line stays: that of the smallest doc_id, then of
the smaller hash of the text, then the earlier line. A band is first compared with one leader, the
line that meets most others. What of the others is then still of different components is compared
in pairs, the most alike first, where bitmaps of the shingles do not rule the similarity out; that bound is
exact. Signatures that agree on fewer than half of the points go no further, which happens to a
pair at 0.8 with a probability below 0.0001. All other pairs that share a band are verified, or
ruled out, or of one component already.

Defined cases: blank lines stay and are not listed; null and empty texts have no lines; lines
shorter than a shingle are their own single shingle, so only equal ones match; lines and texts of
any length are taken whole. Rows of one ``doc_id`` and one text are one document; rows that share
an id, or have none, with different texts are different documents, and those without an id come
after all others. An empty table gives no rows; other columns are kept by ``cleaned`` and not read
elsewhere. Equal lines are told by 128 hash bits, shingles of a line by 64.
"""

from __future__ import annotations

import random
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcorpus.llm.shared import Scratch, connected_components

LAST = 2**63 - 1
#: Consecutive shingles that are hashed into one row: rows are dear, values in a row are not.
CHUNK = 16
#: Bits of a line's bitmap, and the similarities down to which pairs are compared before others.
BITS, STEPS = 4096, (0.84,)


def text_hash(text: Column) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(F.lit("row"), text)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, line, text, key, check) of the lines that are not blank; a null doc_id becomes the last id."""
    lines = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), text_hash(F.col("text")).alias("rid"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    lines = lines.select("doc_id", "rid", "line", F.lower(F.btrim("text", F.lit(" \t\r"))).alias("text")).where("text <> ''")
    return lines.withColumn("key", F.xxhash64("text")).withColumn("check", F.xxhash64(F.lit("check"), "text"))


def shingle_set(text: Column, n: int) -> Column:
    """The distinct shingle hashes of a text."""
    # four bytes a character, so that taking a piece out takes no scan; as an array of one, so
    # that it is made once and not for every piece
    wide = F.array(F.encode(text, "UTF-32"))
    at = F.sequence(F.lit(1), 4 * F.greatest(F.length(text) - n, F.lit(0)) + 1, F.lit(4))
    return F.array_distinct(F.flatten(F.transform(wide, lambda w: F.transform(at, lambda i: F.xxhash64(F.substring(w, i, F.lit(4 * n)))))))


def _chunks(lines: DataFrame, n: int) -> DataFrame:
    """(key, check, h0 .. ) rows of ``CHUNK`` consecutive shingle hashes; the last one fills the last row."""
    wide = lines.select("key", "check", F.encode("text", "UTF-32").alias("wide"), F.greatest(F.length("text") - n, F.lit(0)).alias("last"))
    begun = wide.select("*", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(CHUNK))).alias("at"))
    # four bytes a character, so that taking a piece out takes no scan
    return begun.select("key", "check", *[F.xxhash64(F.substring("wide", 4 * F.least(F.col("at") + k, F.col("last")) + 1, F.lit(4 * n))).alias(f"h{k}") for k in range(CHUNK)])


def signatures(lines: DataFrame, n: int, bands: int, rows: int, seed: int = 1) -> DataFrame:
    """(key, check, b0 .. , sig) of (key, check, text) lines: band hashes, and the low bytes of the signature in longs.

    Where ``lines`` is dealt by ``key`` and ``check``, this moves no row to another task.
    """
    rng = random.Random(seed)
    points = [rng.getrandbits(64) - 2**63 for _ in range(bands * rows)]
    mins = [F.min(F.least(*[F.col(f"h{k}").bitwiseXOR(F.lit(p)) for k in range(CHUNK)])).alias(f"m{i}") for i, p in enumerate(points)]
    made = _chunks(lines, n).groupBy("key", "check").agg(*mins)
    found = [F.xxhash64(F.lit(b), *[F.col(f"m{b * rows + r}") for r in range(rows)]).alias(f"b{b}") for b in range(bands)]
    sig = []
    for k in range(0, bands * rows, 8):
        word = F.lit(0).cast("long")
        for j in range(k, min(k + 8, bands * rows)):
            word = word.bitwiseOR(F.call_function("shiftleft", F.col(f"m{j}").bitwiseAND(F.lit(255)), F.lit(8 * (j - k))))
        sig.append(word)
    return made.select("key", "check", *found, F.array(*sig).alias("sig"))


def agreeing(x: Column, y: Column, points: int) -> Column:
    """On how many points two signatures have the same low byte."""
    out = F.lit(points)
    for k in range(-(-points // 8)):
        d = F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))
        # a byte's lowest bit becomes the union of its bits
        for step in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
        out = out - F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))
    return out


def similarity_of(x: Column, y: Column, n: int) -> Column:
    """Jaccard similarity of the shingle sets of two texts; each set is made once."""
    sets = F.array(F.struct(shingle_set(x, n).alias("x"), shingle_set(y, n).alias("y")))
    shared = F.transform(sets, lambda s: F.struct(F.size(F.array_intersect(s["x"], s["y"])).alias("both"), (F.size(s["x"]) + F.size(s["y"])).alias("sum")))
    return F.transform(shared, lambda s: s["both"] / (s["sum"] - s["both"]))[0]


def _verified(pairs: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """The (a, b) pairs of lines whose shingle sets have at least that Jaccard similarity."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    near = pairs.join(left, "a").join(right, "b")
    return near.where(similarity_of(F.col("x"), F.col("y"), n) >= similarity).select("a", "b")


def bitmaps(texts: DataFrame, n: int) -> DataFrame:
    """(id, bits, ones, size): the shingles of (id, text) rows hashed into a bitmap of ``BITS`` bits, and their number."""
    each = texts.select("id", F.explode(shingle_set(F.col("text"), n)).alias("h"))
    each = each.select("id", F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(BITS // 64 - 1)).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    each = each.groupBy("id", "word").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"))
    words = [F.coalesce(F.max(F.when(F.col("word") == w, F.col("bits"))), F.lit(0)).alias(f"w{w}") for w in range(BITS // 64)]
    made = each.groupBy("id").agg(F.sum(F.bit_count("bits")).alias("ones"), F.sum("n").alias("size"), *words)
    return made.select("id", F.array(*[F.col(f"w{w}") for w in range(BITS // 64)]).alias("bits"), "ones", "size")


def _may_reach(similarity: float) -> Column:
    """Whether lines of m and n shingles with bitmaps s and t of p and q ones can be that similar: never false where they are.

    A bit that only one of them has is a shingle, at least, that only this one has.
    """
    shared = F.aggregate(F.zip_with("s", "t", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, more: n + more)
    # what both share, at most; named once, as it is dear
    both = shared + F.least(F.col("m") - F.col("p"), F.col("n") - F.col("q"))
    return both * (1 + similarity) >= similarity * (F.col("m") + F.col("n")) - 1e-9


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _relabelled(component: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) after more (a, b) links of ids."""
    of = [component.select(F.col("id").alias(i), F.col("component").alias(c)) for i, c in (("a", "p"), ("b", "q"))]
    between = links.join(of[0], "a").join(of[1], "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
    more = connected_components(between, scratch).select(F.col("id").alias("component"), F.col("component").alias("root"))
    return scratch.keep(component.join(more, "component", "left").select("id", F.coalesce("root", "component").alias("component")))


def _apart(ranked: DataFrame, component: DataFrame) -> DataFrame:
    """(band, id, meets, component) of bands with several components."""
    named = ranked.join(component, "id").select("band", "id", "meets", "sig", "component")
    several = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    return named.join(several, "band")


def firsts(docs: DataFrame, scratch: Scratch, shingle: int = 8, similarity: float = 0.8, bands: int = 8, rows: int = 4) -> DataFrame:
    """(key, check, first, top): for each different line its first place and its component's.

    Places are (doc_id, rid, line).
    """
    spark = docs.sparkSession
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = lines_of(docs).groupBy("key", "check").agg(F.first("text").alias("text"), F.min(F.struct("doc_id", "rid", "line")).alias("first"))
    # written as it is dealt, so that what is made of a line later moves no text
    name = f"loom_lines_{uuid.uuid4().hex}"
    path = f"{scratch.root}/{name}"
    one.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(deal, "key", "check").saveAsTable(name)
    try:
        lines = spark.table(name)
        signed = scratch.keep(signatures(lines, shingle, bands, rows).withColumn("id", F.monotonically_increasing_id()))
        component = _components(lines, signed, scratch, shingle, similarity, bands, rows)
    finally:
        spark.sql(f"DROP TABLE {name}")
    places = spark.read.schema(one.schema).parquet(path).select("key", "check", "first")
    # only lines that share a band can be of a component with others
    linked = signed.select("id", "key", "check").join(component.hint("shuffle_hash"), "id").select("key", "check", "component")
    linked = scratch.keep(places.join(linked.hint("shuffle_hash"), ["key", "check"]))
    tops = scratch.keep(linked.groupBy("component").agg(F.min("first").alias("top")))
    tops = scratch.keep(linked.join(tops, "component").select("key", "check", "top"))
    return places.join(tops.hint("shuffle_hash"), ["key", "check"], "left").select("key", "check", "first", F.coalesce("top", "first").alias("top"))


def _components(lines: DataFrame, signed: DataFrame, scratch: Scratch, shingle: int, similarity: float, bands: int, rows: int) -> DataFrame:
    """(id, component) of the lines that share a band with another."""
    # dealt once by band, to be counted and to be joined
    banded = signed.select("id", F.explode(F.array(*[f"b{k}" for k in range(bands)])).alias("band")).repartition("band")
    several = banded.groupBy("band").agg(F.count("id").alias("n")).where("n > 1")
    shared = scratch.keep(banded.join(several.hint("shuffle_hash"), "band"))
    # a line that meets many others is likely what they were copied from: it leads its bands
    meets = shared.groupBy("id").agg(F.sum("n").alias("meets"))
    meets = scratch.keep(signed.select("id", "key", "check", "sig").join(meets.hint("shuffle_hash"), "id"))
    ranked = scratch.keep(shared.select("band", "id").join(meets.select("id", "meets", "sig"), "id"))
    texts = lines.select("key", "check", "text").join(meets.select("id", "key", "check").hint("shuffle_hash"), ["key", "check"])
    texts = scratch.keep(texts.select("id", "text"))

    # every band is compared with its leader
    members = ranked.withColumn("component", F.col("id"))
    leaders = members.groupBy("band").agg(F.max(F.struct("meets", "id", "sig")).alias("top")).select("band", F.col("top.id").alias("leader"), F.col("top.sig").alias("led_sig"))
    points = bands * rows
    same = agreeing(F.col("sig"), F.col("led_sig"), points) >= points // 2
    led = members.join(scratch.keep(leaders), "band").where(F.col("id") != F.col("leader"))
    asked = led.where(same)
    links = _verified(_ordered(asked.select(F.col("leader").alias("a"), F.col("id").alias("b"))), texts, shingle, similarity)
    component = _relabelled(meets.select("id", F.col("id").alias("component")), links, scratch)
    # the leader has met all of its band: what is left to compare is between the others
    others = led.select("band", "id", "meets", "sig")
    members = scratch.keep(_apart(others, component))
    if members.isEmpty():
        return component
    others = members.select("band", "id", "meets", "sig")
    # then what is of different components, the most alike first: what they join is not met again
    left = texts.join(members.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")
    maps = scratch.keep(bitmaps(left, shingle).join(meets.select("id", "sig"), "id"))
    for least in (*[x for x in STEPS if x > similarity], similarity):
        open_ = _apart(others, component).select("band", "id", "component").join(maps, "id")
        # pairs are many for few bytes: as many tasks as partitions, however small these are
        open_ = open_.repartition(int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions")), "band")
        x = open_.select("band", F.col("id").alias("a"), F.col("component").alias("u"), F.col("sig").alias("f"), F.col("bits").alias("s"), F.col("ones").alias("p"), F.col("size").alias("m"))
        y = open_.select("band", F.col("id").alias("b"), F.col("component").alias("v"), F.col("sig").alias("g"), F.col("bits").alias("t"), F.col("ones").alias("q"), F.col("size").alias("n"))
        apart = F.expr("a < b and u <> v") & (agreeing(F.col("f"), F.col("g"), points) >= points // 2)
        near = x.join(y, "band").where(apart & _may_reach(least)).select("a", "b").distinct()
        component = _relabelled(component, _verified(near, texts, shingle, similarity), scratch)
    return component


def grouped(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """(doc_id, line, first_doc_id, first_line, kept) of every line that is not blank; options: those of ``firsts``."""
    lines = lines_of(docs).select("key", "check", F.struct("doc_id", "rid", "line").alias("place"))
    out = lines.join(firsts(docs, scratch, **options).select("key", "check", "top"), ["key", "check"])
    return out.select(F.nullif("place.doc_id", F.lit(LAST)).alias("doc_id"), "place.line", F.nullif("top.doc_id", F.lit(LAST)).alias("first_doc_id"), F.col("top.line").alias("first_line"), (F.col("place") == F.col("top")).alias("kept"))


def cleaned(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The documents without the lines that repeat an earlier one; n_chars follows the text."""
    stay = firsts(docs, scratch, **options).where("first = top").groupBy(F.col("first.doc_id").alias("__id"), F.col("first.rid").alias("__rid")).agg(F.collect_set("first.line").alias("__stay"))
    known = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("__text", text_hash(F.col("text")))
    both = known.join(stay.hint("shuffle_hash"), (F.col("__doc") == F.col("__id")) & (F.col("__text") == F.col("__rid")), "left")

    def of(lines: Column) -> Column:
        # blank lines and those that stay, in order, by their numbers
        blank = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.btrim(F.get(lines, i), F.lit(" \t\r")) == "")
        at = F.sort_array(F.concat(blank, F.coalesce("__stay", F.array().cast("array<int>"))))
        return F.array_join(F.transform(at, lambda i: F.get(lines, i)), "\n")

    # as an array of one, so that a text is split once and not for every line
    left = F.transform(F.array(F.split("text", "\n")), of)[0]
    both = both.withColumn("__left", F.when(F.col("text").isNotNull(), left))
    kinds = dict(docs.dtypes)
    if kinds.get("n_chars") in ("bigint", "int"):
        both = both.withColumn("n_chars", F.when(F.col("__left") == F.col("text"), F.col("n_chars")).otherwise(F.coalesce(F.length("__left"), F.col("n_chars"))).cast(kinds["n_chars"]))
    return both.select(*[F.col("__left").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
