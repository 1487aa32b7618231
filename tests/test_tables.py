"""Table functions in SQL: rows, columns from constant arguments, odd texts, wrong arguments."""

import json

import pytest

from runweave.functions import tables


@pytest.fixture(scope="module")
def sql(spark):
    tables.register(spark)
    return lambda text, **k: [tuple(r) for r in spark.sql(text, **k).collect()]


def test_leaves(spark, sql):
    t = spark.createDataFrame([(1, '{"a":[1,{"b":"é"}],"c":{},"d/e~":null}'), (2, "{"), (3, None), (4, "[]"), (5, "7")], "id int, doc string")
    got = sql("SELECT t.id, l.* FROM {t} t, LATERAL json_leaves(t.doc) l", t=t)
    assert sorted(got) == [(1, "/a/0", "1"), (1, "/a/1/b", '"é"'), (1, "/c", "{}"), (1, "/d~1e~0", "null"), (4, "", "[]"), (5, "", "7")]
    deep = "[" * 500 + "]" * 500
    assert sql("SELECT length(path), value FROM json_leaves({x})".replace("{x}", f"'{deep}'")) == [(2 * 499, "[]")]


def test_differences(spark, sql):
    t = spark.createDataFrame([('{"a":1,"b":[1,2],"z":{"q":1}}', '{"a":"1","b":[3],"z":{"q":2}}'), ("{}", None), ("1", "1.0")], "x string, y string")
    assert sorted(sql("SELECT d.* FROM {t} t, LATERAL json_differences(t.x, t.y, ignore => '/z/*') d", t=t)) == [("type", "/a"), ("value", "/b"), ("value", "/b/0")]


def test_references(spark, sql):
    ref = {"schema_version": "0.2.0", "digest": "a" * 64, "media_type": "text/plain", "byte_length": 3}
    t = spark.createDataFrame([(json.dumps({"x": [ref, {**ref, "preview": "p"}, {**ref, "digest": "short"}]}),)], "doc string")
    assert sorted(sql("SELECT r.path, r.byte_length, r.preview FROM {t} t, LATERAL artifact_references(t.doc) r", t=t)) == [("/x/0", 3.0, None), ("/x/1", 3.0, "p")]


def test_spans_have_a_column_for_each_attribute(spark, sql):
    span = {"traceId": "1", "spanId": "2", "startTimeUnixNano": 5, "attributes": [{"key": "n", "value": {"intValue": "5"}}, {"key": "odd"}, {"key": "n", "value": {"doubleValue": 1.5}}, 3]}
    t = spark.createDataFrame([(json.dumps({"resourceSpans": [7, {"scopeSpans": [{"spans": [span, "x"]}]}]}),), ("[]",)], "x string")
    df = spark.sql("SELECT s.* FROM {t} t, LATERAL otlp_spans(t.x, attributes => 'n, missing') s", t=t)
    assert df.columns[-2:] == ["n", "missing"] and [tuple(r) for r in df.collect()] == [(1, 0, 0, "1", "2", None, None, "5", None, "1.5", None)]
    with pytest.raises(Exception, match="constant text"):
        spark.sql("SELECT s.* FROM {t} t, LATERAL otlp_spans(t.x, t.x) s", t=t)
    with pytest.raises(Exception, match="JSON texts"):
        spark.sql("SELECT * FROM json_leaves(5)")
