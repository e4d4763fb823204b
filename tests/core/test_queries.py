"""Every core query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from loomcorpus.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(catalog.ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want


def test_known_numbers(spark):
    cells = catalog.QUERIES["patch_content_mask"](spark, DIR)
    counts = {(r["name"], r["target"]): r["count"] for r in cells.groupBy("name", "target").count().collect()}
    assert counts["wide", 224] == 112 and counts["tall", 224] == 196
    rows = {(r["name"], r["target"]): (r["content_top"], r["content_h"]) for r in catalog.QUERIES["letterbox_geometry"](spark, DIR).collect()}
    assert rows["wide", 224] == (49, 126) and rows["wide", 518] == (113, 291)


@pytest.mark.parametrize("zoned", [False, True])
def test_hours_at_their_edges(spark, tmp_path, zoned):
    """Hours next to half a millisecond, before 1970 and of no time are those of the SQL."""
    hour = 3_600_000_000
    micros = [sign * (k * hour + d) for sign in (1, -1) for k in (0, 1, 25, 473_352) for d in (0, 1, 499, 500, 501, 999, -1, -499, -500, -501, -1000)] + [None]
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"COPY (SELECT make_timestamp{'tz' * zoned}(u) AS ts, 'e' || (i % 2) AS event_type FROM (SELECT unnest({micros}) AS u, unnest(range({len(micros)})) AS i)) TO '{tmp_path}/events.parquet'".replace("None", "NULL").replace("make_timestamptz(u)", "make_timestamp(u) AT TIME ZONE 'UTC'"))
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = catalog.QUERIES["events_tumbling"](spark, str(tmp_path))
    assert dict(df.dtypes)["hour"] == ("timestamp" if zoned else "timestamp_ntz")
    got = [tuple(r) for r in df.withColumn("hour", F.col("hour").cast("string")).collect()]
    want = [(None if h is None else str(h), e, n) for h, e, n in con.sql(catalog.ORACLE["events_tumbling"]).fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
