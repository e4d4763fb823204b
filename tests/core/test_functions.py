import pytest
from pyspark.sql import functions as F

from loomcorpus.functions import text as T
from loomcorpus.functions import vectors as V


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "want"), [
    ('{"a": 1}', '{"a":1}'), ('```json\n{"a": 1}\n```', '{"a":1}'), ('```JSON {"a": 1}``` tail }', '{"a":1}'), ('```\n{"a": 1}', '{"a":1}'),
    ('Sure: {"a": {"b": [1]}} done', '{"a":{"b":[1]}}'), ("", None), (" \n ", None), ("no braces", None), ("} {", None), ('{"a": 1', None), ("{'a': 1}", None), (None, None), ('{"a": NaN}', None),
])
def test_json_object(spark, raw, want):
    assert one(spark, raw, lambda c: F.to_json(T.json_object(c))) == want


@pytest.mark.parametrize(("raw", "want"), [('so: {"a": NaN, "b": 1, "b": 2}', '{"a": NaN, "b": 2}'), ('{"a": "é"}', '{"a": "é"}'), ("{1}", None), ("none", None), (None, None)])
def test_lenient_json(spark, raw, want):
    assert one(spark, raw, T.json_object_lenient) == want


@pytest.mark.parametrize(("html", "want"), [
    ('<meta property="og:image" content="http://i/1.jpg">', "http://i/1.jpg"), ("<META content='x.png' property='og:image'/>", "x.png"), ('<meta property="og:image" content="">', None),
    ('<meta property="og:image" content="http://i/a.jpg?x=1&amp;y=2&#38;z=&quot;&#x27;">', "http://i/a.jpg?x=1&y=2&z=\"'"), ('<meta property="og:image" content="it\'s.jpg">', "it's.jpg"), ("<meta property=og:image content=http://i/2.jpg>", "http://i/2.jpg"),
    ('<meta name="og:image" content="no">', None), ('<meta content="a > b" data-x="1" property="og:image">', "a > b"), ('<meta property="og:image:width" content="640"><meta property="og:image" content="later">', "later"), ('<meta property="og:image" content="&amp;lt;">', "&lt;"),
    ("<meta charset='utf-8'>", None), ('<meta property="og:image" content="a"><meta property="og:image" content="b">', "a"), (None, None),
])
def test_meta_content(spark, html, want):
    assert one(spark, html, T.meta_content) == want


@pytest.mark.parametrize(("path", "want"), [("a/b.jpg", "b.jpg"), ("a/b.jpg/", "b.jpg"), (" ", None), ("nan", None), (None, None), ("/", None), ("c.jpg", "c.jpg")])
def test_basename(spark, path, want):
    assert one(spark, path, T.basename) == want


@pytest.mark.parametrize(("seconds", "want"), [(-1.0, "0.0s"), (59.94, "59.9s"), (60.0, "1m 0s"), (301.0, "5m 1s"), (3661.0, "1h 1m 1s")])
def test_durations(spark, seconds, want):
    assert spark.range(1).select(T.human_duration(F.lit(seconds))).first()[0] == want


def test_keys_and_paths(spark):
    assert one(spark, "http://h/v?viewkey=ph5x&z", T.first_group) == "ph5x"
    assert one(spark, "http://h/v?key=1", T.first_group) is None
    assert one(spark, "abcdefghij", lambda c: T.sharded_path("http://x/", c)) == "http://x/abc/def/ghi/abcdefghij"
    assert one(spark, "ab", lambda c: T.sharded_path("x", c)) == "x/ab///ab"
    assert one(spark, "a.b.jpg", T.stem) == "a.b"
    assert one(spark, "r/x", lambda c: T.absolute(c, "/root")) == "/root/r/x" and one(spark, "/x", lambda c: T.absolute(c, "/r")) == "/x"


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], [0.0, 0.0], [float("nan"), 1.0])], "a array<float>, b array<float>, z array<float>, n array<float>")
    r = row.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("a")), V.cosine(F.col("a"), F.col("z")), V.norm(F.col("b")), V.all_finite(F.col("n")), V.all_finite(F.col("a")), V.squared_distance(F.col("a"), F.col("b"))).first()
    assert r[0] == 0 and r[1] == 1 and r[2] != r[2] and r[3] == 2 and not r[4] and r[5] and r[6] == 5
