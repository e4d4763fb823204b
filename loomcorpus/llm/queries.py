"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcorpus.llm import embed_dedup, line_dedup, mixing, packing, simhash, spans, token_rollup, topk, toxicity, url_filter
from loomcorpus.llm.shared import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.Mixture(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
    return mix.taken.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "first_slot")


ORACLE["op9_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, least(weight * max(level) OVER (), 3.0 * source_size)::DOUBLE AS target FROM l
), p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, round(t.target)::BIGINT AS quota,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '=' || d.text, '')), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT source, ceil(round(target) / 512)::BIGINT AS n FROM t
), low AS (
  SELECT source, n, coalesce(sum(n) OVER (ORDER BY source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low FROM counted
), m AS (
  SELECT sum(n)::BIGINT AS m, greatest(1, round(sum(n) * (sqrt(5) - 1) / 2))::BIGINT AS near FROM low
), g AS (
  SELECT m, min(near + k) AS g FROM (SELECT m, near, unnest(range(0, 1000)) AS k FROM m) WHERE gcd(near + k, m) = 1 GROUP BY m
), slots AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS r
  FROM (SELECT i AS slot, i * g % m AS point FROM (SELECT m, g, unnest(range(0, m)) AS i FROM g)) x JOIN low ON point >= low.low AND point < low.low + low.n
), taken AS (
  SELECT *, (greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - source_size - start)) + greatest(0, least(size, quota - 2 * source_size - start)))::BIGINT AS taken FROM p
)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken, CASE WHEN taken > 0 THEN slot END::BIGINT AS first_slot
FROM taken LEFT JOIN slots ON slots.source IS NOT DISTINCT FROM taken.source AND slots.r = taken.start // 512
"""


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), Scratch(spark, "op10")).drop("filled")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), Scratch(spark, "op6")))


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.linked(table(spark, sf_dir, "embeddings"), Scratch(spark, "op1"))


ORACLE["op1_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), walk AS (
  SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.b, w.root FROM walk w JOIN links l ON l.a = w.id
), c AS (SELECT id, min(root) AS component_id FROM walk GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.removed_ranges(table(spark, sf_dir, "documents"), Scratch(spark, "op4")).drop("rid")


@query
def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.sign_code(F.col("embedding")).alias("code"))
    return topk.nearest(codes, codes.where("id % 100 = 0"), Scratch(spark, "op5"))


ORACLE["op5_exact_topk"] = """
WITH d AS (
  SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id,
    list_sum(list_transform(range(1, 65), lambda i: ((q.embedding[i] > 0) <> (e.embedding[i] > 0))::INT))::INT AS distance
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INT AS rank FROM d)
SELECT query_id, rank, neighbour_id, distance FROM r WHERE rank <= 10
"""


@query
def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents, takes down labelled toxic ones, revises those with repeated lines
    and counts the rest under a second tokenizer; two batches are sent again."""
    scratch = Scratch(spark, "op7")
    words = mixing.word_count(F.col("text"))
    once = mixing.word_count(F.array_join(F.array_distinct(F.split("text", "\n")), "\n"))
    pieces = F.coalesce(F.regexp_count("text", F.lit(r"[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]")), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", words.alias("words"), once.alias("once"), pieces.alias("pieces"))
    docs = scratch.keep(docs)
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    live = docs.join(toxic, "doc_id", "left_anti")

    def batch(rows: DataFrame, version: str, tokens, deleted: bool = False) -> DataFrame:
        return rows.select("doc_id", F.lit(version).alias("version"), "source", "lang", tokens.cast("long").alias("tokens"), F.lit(deleted).alias("deleted"), F.lit(1).alias("seq"))

    load = batch(docs, "words-1", F.col("words"))
    revise = batch(live.where("once <> words"), "words-1", F.col("once"))
    rollup = token_rollup.Rollup(spark, f"{scratch.root}/rollup")
    rollup.commit("1-load", load)
    rollup.commit("2-takedown", batch(docs.join(toxic, "doc_id", "left_semi"), "words-1", F.col("words"), True))
    rollup.commit("3-revise", revise)
    rollup.commit("4-pieces", batch(live, "pieces-1", F.col("pieces")))
    rollup.commit("3-revise", revise)
    rollup.commit("1-load", load)
    return rollup.totals()


ORACLE["op7_token_rollup"] = r"""
WITH c AS (
  SELECT doc_id, source, lang,
    len(regexp_extract_all(array_to_string(list_distinct(string_split(text, chr(10))), chr(10)), '[^\x20\x09-\x0D]+')) AS once,
    len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]')) AS pieces
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
)
SELECT source, lang, 'words-1' AS version, count(*)::BIGINT AS docs, coalesce(sum(once), 0)::BIGINT AS tokens FROM c GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces-1', count(*)::BIGINT, coalesce(sum(pieces), 0)::BIGINT FROM c GROUP BY source, lang
"""

#: A fixed day-of-log rule for every host; the query makes the same list, with one look at a host.
LIST_LOG = r"""
WITH hosts AS (
  SELECT DISTINCT {host} AS host FROM pages WHERE url IS NOT NULL
), h AS (
  SELECT host, ascii(substring(md5(host), 1, 1)) AS a, ascii(substring(md5(host), 2, 1)) AS b, ascii(substring(md5(host), 3, 1)) AS c, ascii(substring(md5(host), 4, 1)) AS d
  FROM hosts WHERE host IS NOT NULL AND host <> ''
)
SELECT 'spam' AS list, 'domain' AS kind, host AS pattern, 'add' AS action, (a * 7 + b * 13) % 300 AS day FROM h
UNION ALL SELECT 'spam', 'domain', host, 'remove', (a * 7 + b * 13) % 300 + 40 FROM h WHERE c % 2 = 0
UNION ALL SELECT 'spam', 'domain', host, 'add', (a * 7 + b * 13) % 300 + 80 FROM h WHERE d % 3 = 0
UNION ALL SELECT 'languages', 'prefix', concat(host, '/de'), 'add', (c * 11 + d) % 365 FROM h
UNION ALL SELECT 'languages', 'prefix', concat(host, '/fr'), 'add', (b * 11 + d) % 200 FROM h
UNION ALL SELECT 'languages', 'prefix', concat(host, '/fr'), 'remove', (b * 11 + d) % 200 + 100 FROM h
UNION ALL SELECT 'parents', 'domain', 'example.net', 'add', 100
UNION ALL SELECT 'parents', 'domain', 'example.net', 'remove', 160
UNION ALL SELECT 'parents', 'domain', 'example.net', 'add', 300
"""


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is a capture, fetched on a day that its id gives."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captured = pages.select(F.regexp_extract(F.lower("url"), url_filter.HOST, 1).alias("host")).where("host <> ''").distinct()
    a, b, c, d = (F.ascii(F.substring(F.md5(F.col("host").cast("binary")), k, 1)) for k in (1, 2, 3, 4))
    first = (a * 7 + b * 13) % 300

    def entry(name: str, kind: str, pattern: Column, action: str, at: Column, where: Column | None = None) -> Column:
        made = F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), at.cast("int").alias("at"))
        return made if where is None else F.when(where, made)

    host, de, fr = F.col("host"), F.concat("host", F.lit("/de")), F.concat("host", F.lit("/fr"))
    entries = [
        entry("spam", "domain", host, "add", first), entry("spam", "domain", host, "remove", first + 40, c % 2 == 0), entry("spam", "domain", host, "add", first + 80, d % 3 == 0),
        entry("languages", "prefix", de, "add", (c * 11 + d) % 365), entry("languages", "prefix", fr, "add", (b * 11 + d) % 200), entry("languages", "prefix", fr, "remove", (b * 11 + d) % 200 + 100),
    ]
    log = captured.select(F.explode(F.array(*entries)).alias("e")).where("e is not null").select("e.*")
    log = log.unionByName(spark.createDataFrame([("parents", "domain", "example.net", x, at) for x, at in (("add", 100), ("remove", 160), ("add", 300))], "list string, kind string, pattern string, action string, at int"))
    captures = pages.withColumn("fetched_at", F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int"))
    out = url_filter.judged(captures, log)
    return out.select("page_id", "url", "fetched_at", "blocked", "hits", F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("listed_since", F.lit(-1)).alias("listed_since"))


ORACLE["op8_url_filter"] = (
    "WITH log AS ("
    + LIST_LOG.format(host=rf"regexp_extract(lower(url), '{url_filter.HOST}', 1)")
    + r"""
), state AS (SELECT list, kind, pattern, day, min((action = 'add')::INT) AS is_on FROM log GROUP BY ALL),
change AS (SELECT *, lag(is_on, 1, 0) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS was FROM state),
spans AS (SELECT *, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS until FROM change WHERE is_on <> was),
active AS (SELECT * FROM spans WHERE is_on = 1),
captures AS (
  SELECT page_id, url, (page_id * 37 % 365)::INT AS fetched_at, regexp_extract(lower(url), '"""
    + url_filter.HOST
    + r"""', 1) AS host, regexp_extract(lower(url), '"""
    + url_filter.FIRST
    + r"""', 1) AS path FROM pages
), met AS (
  SELECT c.page_id, a.list, a.day FROM captures c JOIN active a
    ON (a.kind = 'domain' AND (c.host = a.pattern OR ends_with(c.host, '.' || a.pattern)) OR a.kind = 'prefix' AND c.path <> '' AND c.host || c.path = a.pattern)
    AND a.day <= c.fetched_at AND (a.until IS NULL OR c.fetched_at < a.until)
), found AS (SELECT page_id, count(*) AS hits, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, min(day) AS listed_since FROM met GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched_at, coalesce(hits, 0) > 0 AS blocked, coalesce(hits, 0)::BIGINT AS hits, coalesce(lists, '') AS lists, coalesce(listed_since, -1)::INT AS listed_since
FROM captures c LEFT JOIN found USING (page_id)
"""
)


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.grouped(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))
