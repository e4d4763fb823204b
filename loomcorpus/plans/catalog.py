"""Queries of the core library with their DuckDB counterparts.

The supplied tables stand in for the roles of the library's own: ``orders`` is dated metadata,
``documents`` a file listing (``n_chars`` as bytes), ``labels`` an acquisition state,
``embeddings`` vectors with cluster labels, and ``lineitem`` cells assigned to motifs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcorpus.functions import text as T
from loomcorpus.functions import vectors as V
from loomcorpus.functions.times import hour_of_millisecond
from loomcorpus.operators import acquire, checks, layout, reports, sampling, tables, validity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# sampling


@query("""
WITH o AS (SELECT o_orderkey, o_orderpriority, year(o_orderdate)::INT AS year FROM orders WHERE o_orderdate IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY md5('42-' || o_orderkey::VARCHAR), o_orderkey) AS n FROM o WHERE year >= (SELECT max(year) - 4 FROM o))
SELECT o_orderkey, o_orderpriority, year FROM r WHERE n <= 250
""")
def stratified_sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = sampling.years(table(spark, sf_dir, "orders"), "o_orderdate").select("o_orderkey", "o_orderpriority", "year")
    return sampling.per_stratum(sampling.latest_years(dated), "year", "o_orderkey", 250)


@query("SELECT o_orderkey FROM orders ORDER BY md5('7-' || o_orderkey::VARCHAR), o_orderkey LIMIT 100")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, seed=7)


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS orders FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def rows_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.years(table(spark, sf_dir, "orders"), "o_orderdate").groupBy("year").agg(F.count("*").alias("orders")).orderBy("year")


# acquisition


@query(r"""
WITH k AS (SELECT page_id, nullif(regexp_extract(url, '/([a-z]{2}/[0-9]+)', 1), '') AS key, nullif(regexp_extract(url, 'page=(\d+)', 1), '') AS page FROM pages)
SELECT page_id, key, page, '/data/' || key || '.jpg' AS path, concat_ws('/', 'http://x', substring(key, 1, 3), substring(key, 4, 3), substring(key, 7, 3), key) AS remote FROM k
""")
def extract_key_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "pages").select("page_id", T.first_group(F.col("url"), "/([a-z]{2}/[0-9]+)").alias("key"), T.first_group(F.col("url"), r"page=(\d+)").alias("page"))
    return keyed.select("*", T.local_path("/data", F.col("key")).alias("path"), F.when(F.col("key").isNotNull(), T.sharded_path("http://x", F.col("key"))).otherwise(F.lit("http://x")).alias("remote"))


@query("""
SELECT doc_id::VARCHAR AS url, toxic = 0 AS thumbnail_success, NULL::VARCHAR AS source FROM labels
UNION ALL SELECT doc_id::VARCHAR, false, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id::VARCHAR IS NOT DISTINCT FROM d.doc_id::VARCHAR)
""")
def merge_missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("url"), (F.col("toxic") == 0).alias("thumbnail_success"))
    incoming = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), "source")
    return acquire.merge_missing(state, incoming).select("url", "thumbnail_success", "source")


@query("""
WITH f AS (SELECT '/img/' || doc_id || '.jpg' AS path FROM documents WHERE n_chars >= 4096)
SELECT l.doc_id, CASE WHEN toxic = 1 AND f.path IS NOT NULL THEN f.path WHEN toxic = 0 THEN 'recorded' END AS thumbnail_path,
  toxic = 0 OR f.path IS NOT NULL AS thumbnail_success, toxic = 1 AND f.path IS NOT NULL AS reconciled
FROM labels l LEFT JOIN f ON f.path = '/img/' || l.doc_id || '.jpg'
""")
def reconcile_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 0, F.lit("recorded")).alias("thumbnail_path"), (F.col("toxic") == 0).alias("thumbnail_success"))
    listing = table(spark, sf_dir, "documents").where(validity.large_enough(F.col("n_chars"))).select(T.local_path("/img", F.col("doc_id").cast("string")).alias("path"))
    return acquire.reconcile(state, listing, T.local_path("/img", F.col("doc_id").cast("string")))[0].select("doc_id", "thumbnail_path", "thumbnail_success", "reconciled")


@query("SELECT count(*) AS rows, count_if(toxic = 0)::BIGINT AS done, (count(*) - count_if(toxic = 0))::BIGINT AS remaining, round(100.0::DOUBLE * count_if(toxic = 0) / count(*), 2) AS done_pct FROM labels")
def acquisition_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquire.progress(table(spark, sf_dir, "labels").select((F.col("toxic") == 0).alias("thumbnail_success")))


@query("""
SELECT event_id, user_id FROM (SELECT * FROM events ORDER BY event_id LIMIT 2000) e WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')
""")
def todo_after_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return acquire.todo(events, events.where("event_type = 'click'"), "event_id", "event_id", limit=2000).select("event_id", "user_id")


@query("SELECT page_id, (page_id * 100 % 300 = 0 AND contains(lower(url), 'https')) AS accepted FROM (SELECT page_id, url FROM pages)")
def fetch_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") * 100 % 300 == 0, 200).otherwise(404).alias("status"), F.when(F.lower("url").contains("https"), "IMAGE/jpeg").otherwise("text/html").alias("kind"))
    return pages.select("page_id", acquire.accepted(F.col("status"), F.col("kind")).alias("accepted"))


# validity


@query("""
WITH v AS (SELECT d.doc_id, CASE WHEN n_chars IS NULL THEN 'missing' WHEN n_chars < 4096 THEN 'too_small:' || n_chars || 'B'
  WHEN 640 - d.doc_id % 2 <> 640 THEN 'unexpected_size:' || (640 - d.doc_id % 2) || 'x360' ELSE 'ok' END AS reason
  FROM (SELECT doc_id, CASE WHEN source <> 'src1' THEN n_chars END AS n_chars FROM documents) d)
SELECT doc_id, reason = 'ok' AS ok, reason FROM v
""")
def validity_with_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") != "src1", F.col("n_chars")).alias("length"), (F.lit(640) - F.col("doc_id") % 2).alias("w"), F.lit(360).alias("h"))
    return files.select("doc_id", validity.validity(F.col("length"), F.col("w"), F.col("h")).alias("v")).select("doc_id", "v.ok", "v.reason")


@query("""
WITH r AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'a/' || doc_id || '.jpg' ELSE 'b/' || doc_id || '.jpg' END AS path FROM labels),
g AS (SELECT 'a/' || doc_id || '.jpg' AS path FROM documents WHERE n_chars >= 4096 UNION ALL SELECT 'c/' || doc_id || '.jpg' FROM documents WHERE n_chars >= 8192)
SELECT r.doc_id, r.doc_id || '.jpg' AS image_id, coalesce(x.path, y.path) AS usable_path FROM r LEFT JOIN g x ON x.path = r.path LEFT JOIN g y ON y.path = 'c/' || r.doc_id || '.jpg'
WHERE coalesce(x.path, y.path) IS NOT NULL
""")
def path_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".jpg"))
    rows = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.when(F.col("quality") == 1, F.lit("a/")).otherwise(F.lit("b/")), name).alias("path"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    listing = docs.select(F.concat(F.lit("a/"), name).alias("path"), F.col("n_chars").alias("length")).unionAll(docs.where("n_chars >= 8192").select(F.concat(F.lit("c/"), name), "n_chars"))
    return validity.usable_paths(rows, listing, "path", "c").select("doc_id", "image_id", "usable_path")


@query("""
WITH s AS (SELECT d.source, l.doc_id IS NOT NULL AS r, l.doc_id IS NOT NULL AND d.n_chars >= 4096 AS v FROM documents d LEFT JOIN labels l USING (doc_id)),
g AS (SELECT source, count(*) AS sampled, count_if(r)::BIGINT AS retrieved, count_if(v)::BIGINT AS valid, grouping(source)::INT AS is_total FROM s GROUP BY ROLLUP (source))
SELECT source, sampled, retrieved, valid, is_total, (sampled - retrieved)::BIGINT AS not_retrieved, (retrieved - valid)::BIGINT AS placeholder,
  round(100.0::DOUBLE * (sampled - retrieved) / sampled, 1) AS not_retrieved_pct, round(100.0::DOUBLE * (retrieved - valid) / sampled, 1) AS placeholder_pct, round(100.0::DOUBLE * valid / sampled, 1) AS valid_pct FROM g
""")
def valid_rate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(labels, "doc_id", "left")
    return reports.valid_rates(docs, "source", F.col("labelled").isNotNull(), F.col("n_chars") >= 4096)


# annotation


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE (props->>'$.k')::BIGINT END AS k, event_type <> 'error' AS parsed FROM events
""")
def json_from_model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers of several shapes around a JSON object; errors have a broken one."""
    props, kind = F.col("props"), F.col("event_type")
    raw = F.when(kind == "error", F.concat(F.lit("no } braces { here "), F.substring("props", 1, 3))).when(kind == "click", F.concat(F.lit(" ```json\n"), props, F.lit("\n``` done"))).when(kind == "view", F.concat(F.lit("```JSON\n"), props)).otherwise(F.concat(F.lit("Here it is: "), props, F.lit(" as asked.")))
    found = table(spark, sf_dir, "events").select("event_id", T.json_object(raw).alias("o"))
    return found.select("event_id", F.coalesce(F.try_variant_get("o", "$.k", "bigint"), F.lit(-1)).alias("k"), F.col("o").isNotNull().alias("parsed"))


@query("""
SELECT count(*) AS processed, count_if(event_type <> 'error')::BIGINT AS ok, count_if(event_type = 'error')::BIGINT AS failed, round(sum(value), 3) AS elapsed,
  round(sum(value) / count(*), 3) AS mean_seconds, round(100.0::DOUBLE * count_if(event_type <> 'error') / count(*), 2) AS ok_pct FROM events
""")
def annotation_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.annotation_stats(table(spark, sf_dir, "events"), F.col("event_type") != "error", F.col("value"))


@query("""
WITH c AS (SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN repeat(text, 60) ELSE text END AS text FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'system' THEN text WHEN text <> '' THEN substring(text, 1, 2000) END AS raw_output FROM c
""")
def cut_raw_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty, very long and other outputs, by turn."""
    text = F.when(F.col("turn") % 3 == 0, F.lit("")).when(F.col("turn") % 3 == 1, F.repeat("text", F.lit(60))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.cut_raw(text, F.col("role") == "system").alias("raw_output"))


@query(r"""
WITH p AS (SELECT page_id, html FROM pages)
SELECT page_id, nullif(regexp_extract(html, '<meta charset="([^"]*)"', 1), '') AS charset,
  CASE page_id % 6 WHEN 0 THEN 'http://i/' || page_id || '.jpg?a=1&b=2' WHEN 1 THEN 'it"' || page_id || '.png' WHEN 2 THEN 'plain' || page_id WHEN 3 THEN 'a > b''s' END AS image
FROM p
""")
def html_meta_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a picture named in each way of quoting, under another attribute, or empty."""
    ident = F.col("page_id").cast("string")
    named = [
        F.concat(F.lit('<meta property="og:image" content="http://i/'), ident, F.lit('.jpg?a=1&amp;b=2">')), F.concat(F.lit("<META content='it\""), ident, F.lit(".png' property='og:image'/>")),
        F.concat(F.lit("<meta property=og:image content=plain"), ident, F.lit(">")), F.lit('<meta name="x" content="y"><meta content="a > b&#39;s" property="og:image">'),
        F.lit('<meta name="og:image" content="no">'), F.lit('<meta property="og:image" content="">'),
    ]
    html = F.concat(F.element_at(F.array(*named), (F.col("page_id") % 6 + 1).cast("int")), "html")
    return table(spark, sf_dir, "pages").select("page_id", T.first_group(F.col("html"), '<meta charset="([^"]*)"').alias("charset"), T.meta_content(html).alias("image"))


@query("""
WITH s AS (SELECT event_id, greatest(value * event_id - 100, 0)::DOUBLE AS s FROM events), w AS (SELECT *, floor(s)::BIGINT AS w FROM s)
SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%dm %ds', w // 60, w % 60) ELSE printf('%dh %dm %ds', w // 3600, w % 3600 // 60, w % 60) END AS took FROM w
""")
def duration_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.human_duration(F.col("value") * F.col("event_id") - 100).alias("took"))


@query("""
WITH t AS (SELECT o_orderkey, year(o_orderdate)::INT AS year, unnest(list_distinct([o_orderpriority, o_orderstatus, 'all'])) AS tag FROM orders),
n AS (SELECT year(o_orderdate)::INT AS year, count(*) AS total FROM orders GROUP BY 1)
SELECT t.year, tag, count(*) AS items, round(count(*) / any_value(total)::DOUBLE, 4) AS share FROM t JOIN n USING (year) GROUP BY t.year, tag
""")
def tag_prevalence_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.array("o_orderpriority", "o_orderstatus", F.lit("all")).alias("tags"))
    return reports.tag_prevalence(items, "year", "tags")


# clusters


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as a clustering result: label 0 is noise."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(F.concat(F.col("vec_id").cast("string"), F.lit(".jpg")).alias("image_id"), (F.col("label") - 1).alias("cluster_id"), F.round(F.abs(F.element_at("embedding", 1).cast("double")), 3).alias("cluster_probability"))


CLUSTERS = "c AS (SELECT vec_id || '.jpg' AS image_id, label - 1 AS cluster_id, round(abs(embedding[1]::DOUBLE), 3) AS cluster_probability FROM embeddings)"


@query(f"WITH {CLUSTERS} SELECT cluster_id, count(*) AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM c GROUP BY cluster_id")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.group_summary(_clusters(spark, sf_dir), "cluster_id", 1)


@query(f"""WITH {CLUSTERS} SELECT count(*) AS rows, count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS groups, count_if(cluster_id = -1)::BIGINT AS noise,
  round(100.0::DOUBLE * count_if(cluster_id = -1) / count(*), 1) AS noise_pct FROM c""")
def cluster_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.noise_stats(_clusters(spark, sf_dir), "cluster_id")


@query(f"""
WITH {CLUSTERS}, m AS (SELECT o_orderkey, (o_orderkey // 2) || '.jpg' AS image_id, o_orderpriority AS title, year(o_orderdate)::INT AS year, o_orderstatus AS categories, 'x/' || (o_orderkey // 2) || '.jpg/' AS thumbnail_path FROM orders WHERE o_orderstatus <> 'P'),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY o_orderkey) = 1)
SELECT c.image_id, coalesce(title, '') AS title, coalesce(year, 0)::INT AS year, coalesce(categories, '') AS categories, coalesce(thumbnail_path, '') AS thumbnail_path, cluster_id, cluster_probability FROM c LEFT JOIN f USING (image_id)
""")
def cluster_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    meta = orders.select("o_orderkey", F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("categories"), F.concat(F.lit("x/"), F.floor(F.col("o_orderkey") / 2).cast("string"), F.lit(".jpg/")).alias("thumbnail_path"))
    return tables.cluster_assignments(_clusters(spark, sf_dir), meta, "o_orderkey").withColumn("year", F.coalesce("year", F.lit(0)))


@query(f"""
WITH {CLUSTERS}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cluster_probability DESC, image_id)::INT AS rank FROM c) SELECT * FROM r WHERE rank <= 12
""")
def cluster_top_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.top_samples(_clusters(spark, sf_dir), 12)


# motifs

MOTIFS = """p AS (SELECT l_orderkey AS image_id, (l_suppkey % 41 - 1)::INT AS motif_id, l_linenumber AS patch_row, (l_partkey % 14)::INT AS patch_col, l_discount AS motif_probability,
  CASE WHEN l_linenumber % 2 = 1 THEN 'img/' || l_orderkey || '.jpg' ELSE ' ' END AS thumbnail_path FROM lineitem),
h AS (SELECT image_id, motif_id, count(*) AS patch_count, round(count(*) / sum(count(*)) OVER (PARTITION BY image_id), 4) AS patch_fraction FROM p GROUP BY image_id, motif_id),
m AS (SELECT o_orderkey AS image_id, o_orderpriority AS title, year(o_orderdate)::INT AS year, CASE WHEN o_orderstatus = 'F' THEN 'meta/' || o_orderkey END AS thumbnail_path FROM orders),
b AS (SELECT motif_id, image_id, patch_row AS best_patch_row, patch_col AS best_patch_col, motif_probability AS best_patch_probability FROM p
  QUALIFY row_number() OVER (PARTITION BY motif_id, image_id ORDER BY motif_probability DESC, patch_row, patch_col) = 1),
w AS (SELECT image_id, min(thumbnail_path) AS path FROM p WHERE trim(thumbnail_path) <> '' GROUP BY image_id),
k AS (SELECT h.motif_id, h.image_id, patch_count, patch_fraction, title, year, best_patch_row, best_patch_col, best_patch_probability, coalesce(nullif(trim(m.thumbnail_path), ''), w.path) AS thumbnail_path
  FROM h LEFT JOIN m USING (image_id) LEFT JOIN b ON b.motif_id = h.motif_id AND b.image_id = h.image_id LEFT JOIN w ON w.image_id = h.image_id)"""


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("img/"), F.col("l_orderkey").cast("string"), F.lit(".jpg"))).otherwise(F.lit(" "))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_suppkey") % 41 - 1).cast("int").alias("motif_id"), F.col("l_linenumber").alias("patch_row"), (F.col("l_partkey") % 14).cast("int").alias("patch_col"), F.col("l_discount").alias("motif_probability"), path.alias("thumbnail_path"))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("meta/"), F.col("o_orderkey").cast("string")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year"), path.alias("thumbnail_path"))


@query(f"WITH {MOTIFS} SELECT * FROM h")
def motif_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.motif_histogram(_patches(spark, sf_dir))


@query(f"WITH {MOTIFS} SELECT motif_id, count(*) AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM p GROUP BY motif_id")
def motif_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.group_summary(_patches(spark, sf_dir), "motif_id", 2)


@query(f"""WITH {MOTIFS}, d AS (SELECT image_id, motif_id AS dominant_motif_id, patch_count, patch_fraction FROM h QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY patch_count DESC, motif_id) = 1)
SELECT d.*, m.title, m.year, m.thumbnail_path FROM d LEFT JOIN m USING (image_id)""")
def dominant_motif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.dominant_with_metadata(tables.motif_histogram(_patches(spark, sf_dir)), _metadata(spark, sf_dir))


@query(f"WITH {MOTIFS} SELECT * FROM b")
def best_patch_per_motif_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.best_patch(_patches(spark, sf_dir))


@query(f"WITH {MOTIFS} SELECT * FROM k")
def motif_image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.image_links(_patches(spark, sf_dir), _metadata(spark, sf_dir))


@query(f"""WITH {MOTIFS}, r AS (SELECT *, row_number() OVER (PARTITION BY motif_id ORDER BY patch_fraction DESC, patch_count DESC, image_id)::INT AS rank FROM k) SELECT * FROM r WHERE rank <= 12""")
def motif_top_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.top_images(_patches(spark, sf_dir), _metadata(spark, sf_dir))


@query(f"""WITH {MOTIFS}, r AS (SELECT motif_id, image_id, patch_row, patch_col, motif_probability, row_number() OVER (PARTITION BY motif_id ORDER BY motif_probability DESC, image_id, patch_row, patch_col)::INT AS rank FROM p)
SELECT * FROM r WHERE rank <= 12""")
def motif_top_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.top_patches(_patches(spark, sf_dir).drop("thumbnail_path"))


# geometry

GEOMETRY = """g(name, w, h, target) AS (VALUES ('wide', 640, 360, 224), ('wide', 640, 360, 518), ('tall', 360, 640, 224), ('square', 100, 100, 224)),
s AS (SELECT *, greatest(w, h) AS side FROM g), q AS (SELECT *, (side - w) // 2 AS pad_left, (side - h) // 2 AS pad_top FROM s),
z AS (SELECT *, round_even(pad_top * target / side::DOUBLE, 0)::INT AS content_top, round_even(h * target / side::DOUBLE, 0)::INT AS content_h FROM q)"""


def _pictures(spark: SparkSession) -> DataFrame:
    rows = [("wide", 640, 360, 224), ("wide", 640, 360, 518), ("tall", 360, 640, 224), ("square", 100, 100, 224)]
    return layout.letterbox(spark.createDataFrame(rows, "name string, w int, h int, target int"), "w", "h", F.col("target"))


@query(f"WITH {GEOMETRY} SELECT name, target, side, pad_left, pad_top, content_top, content_h FROM z")
def letterbox_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pictures(spark).select("name", "target", "side", "pad_left", "pad_top", "content_top", "content_h")


@query(f"""WITH {GEOMETRY}, c AS (SELECT *, unnest(range(target // 16)) AS r FROM z)
SELECT name, target, r::INT AS patch_row, c2::INT AS patch_col FROM (SELECT *, unnest(range(target // 16)) AS c2 FROM c WHERE (r + 0.5) * 16 >= content_top AND (r + 0.5) * 16 < content_top + content_h)""")
def patch_content_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.content_cells(_pictures(spark), F.col("target"), F.lit(16)).select("name", "target", "patch_row", "patch_col")


@query(f"""WITH {CLUSTERS}, r AS (SELECT image_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY cluster_probability DESC, image_id) AS rank, 90 + length(image_id)::INT AS pic_w FROM c),
t AS (SELECT *, ((rank - 1) // 4)::INT AS grid_row, ((rank - 1) % 4)::INT AS grid_col FROM r WHERE rank <= 12)
SELECT cluster_id, image_id, rank::INT AS rank, grid_row, grid_col, coalesce(sum(pic_w) OVER (PARTITION BY cluster_id, grid_row ORDER BY grid_col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x, (grid_row * 90)::INT AS y FROM t""")
def montage_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = tables.top_samples(_clusters(spark, sf_dir), 12)
    return layout.grid_places(top, "cluster_id", "rank", F.lit(90) + F.length("image_id")).select("cluster_id", "image_id", "rank", "grid_row", "grid_col", "x", "y")


@query(f"WITH {MOTIFS} SELECT motif_id, image_id, best_patch_col * 16 AS x0, best_patch_row * 16 AS y0, (best_patch_col + 1) * 16 AS x1, (best_patch_row + 1) * 16 AS y1, image_id || '_' || printf('%.3f', patch_fraction) || '.jpg' AS name FROM k")
def highlight_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cell_links(_patches(spark, sf_dir)).select("motif_id", "image_id", *layout.cell_box(F.col("best_patch_row"), F.col("best_patch_col"), 16), layout.preview_name(F.col("image_id").cast("string"), F.col("patch_fraction")).alias("name"))


# vectors

NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


@query(f"SELECT count(*) AS vectors, count_if({FINITE})::BIGINT AS finite, round(min({NORM}), 6) AS min_norm, round(max({NORM}), 6) AS max_norm, round(avg({NORM}), 6) AS mean_norm FROM embeddings")
def vector_norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.norm_stats(table(spark, sf_dir, "embeddings"), "embedding")


@query(f"""WITH e AS (SELECT vec_id, CASE vec_id % 50 WHEN 0 THEN list_transform(embedding, lambda x: 'NaN'::FLOAT) WHEN 1 THEN embedding[1:63] WHEN 2 THEN list_transform(embedding, lambda x: 0::FLOAT)
  WHEN 3 THEN list_transform(embedding, lambda x: 'Infinity'::FLOAT) ELSE embedding END AS embedding FROM embeddings)
SELECT count(*) AS rows, count(DISTINCT vec_id) AS ids, count_if(len(embedding) <> 64)::BIGINT AS wrong_dim, count_if(NOT {FINITE})::BIGINT AS not_finite, count_if({NORM} = 0)::BIGINT AS zero_norm,
  count(*) = count(DISTINCT vec_id) AND count_if(len(embedding) <> 64) = 0 AND count_if(NOT {FINITE}) = 0 AS ok FROM e""")
def embedding_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of which some are too short, zero, not numbers or not finite."""
    of, vec = F.col("vec_id") % 50, F.col("embedding")

    def all_(x: str) -> Column:
        return F.transform(vec, lambda _: F.lit(x).cast("float"))

    made = F.when(of == 0, all_("NaN")).when(of == 1, F.slice(vec, 1, 63)).when(of == 2, all_("0")).when(of == 3, all_("Infinity")).otherwise(vec)
    return checks.vector_checks(table(spark, sf_dir, "embeddings").withColumn("embedding", made), "vec_id", "embedding", 64)


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count(*) AS images, sum(n)::BIGINT AS patches, min(n) AS min_patches, max(n) AS max_patches, round(avg(n), 4) AS mean_patches, trunc(median(n))::INT AS median_patches FROM n""")
def patch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.patch_count_stats(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.missing(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query(f"SELECT label, round(min({NORM}), 6) AS min_norm, round(max({NORM}), 6) AS max_norm FROM embeddings GROUP BY label")
def per_image_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.per_image_norms(table(spark, sf_dir, "embeddings"), "label", "embedding")


@query("""WITH r AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY md5('0-' || vec_id::VARCHAR), vec_id) - 1 AS n FROM embeddings)
SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM r a JOIN r b ON b.n = a.n + 1 WHERE a.n % 2 = 0 AND a.n < 100""")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.random_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 50)


# native addition: windowed counts over the event stream's table


@query("SELECT epoch_ms((epoch_ms(ts) // 3600000) * 3600000)::TIMESTAMP AS hour, event_type, count(*) AS events FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    hour = hour_of_millisecond(F.col("ts"), zoned=dict(events.dtypes)["ts"] == "timestamp")
    return events.groupBy(hour.alias("hour"), "event_type").agg(F.count("*").alias("events"))


def _register_models() -> None:
    """Queries over the clustering and incremental parts, which bring no SQL of their own."""
    from loomcorpus.plans import models

    QUERIES.update(models.QUERIES)
    ORACLE.update(models.ORACLE)


_register_models()
