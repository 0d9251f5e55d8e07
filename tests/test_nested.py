"""Walks through nested logs, case by case."""

import json

from lumenfold.functions import nested


def told(spark, column, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(column(df)).collect()]


def test_redaction(spark):
    deep = inner = {}
    for _ in range(10):
        inner["x"] = {}
        inner = inner["x"]
    # names and values that are replaced stand as name=value in the end, as in any text
    cases = {
        json.dumps({"apiKey": "abcd", "user": {"PASSWORD": {"a": 1}, "name": "n", "list": [{"Authorization": "x"}, 3, None, True]}}): '{apiKey=[REDACTED],"user":{PASSWORD=[REDACTED],"name":"n","list":[{Authorization=[REDACTED]},3,null,true]}}',
        json.dumps({"note": "Bearer abc.def", "inner": json.dumps({"secret": "s", "ok": "fine"})}): '{"note":"Bearer [REDACTED]","inner":"{secret=[REDACTED],\\"ok\\":\\"fine\\"}"}',
    }
    got = told(spark, lambda df: nested.redacted(df["t"]), [(k,) for k in cases], "t string")
    assert got == list(cases.values())
    assert "[truncated]" in told(spark, lambda df: nested.redacted(df["t"]), [(json.dumps(deep),)], "t string")[0]
    texts = ["plain", "", None, "password = hunter22", "token: 'abcdef' and \"secret\": \"wxyz1\"", "api-key=abc", "{not json password=hunter22", "y" * 9000]
    assert told(spark, lambda df: nested.redacted(df["t"]), [(x,) for x in texts], "t string") == ["plain", "", None, "password=[REDACTED]", "token=[REDACTED] and secret=[REDACTED]", "api-key=abc", "{not json password=[REDACTED]", "y" * 8192 + "…<truncated 808 chars>"]


def test_failures(spark):
    rows = [
        ("review", "", "this is a false positive"),
        ("search", "", "this is a false positive"),
        ("search", "", json.dumps({"result": json.dumps({"nodes": []})})),
        ("review", "", json.dumps({"nodes": []})),
        ("search", "q", "No results here"),
        ("other", "", json.dumps([{"freshness": {"isFresh": False}}])),
        ("other", "", json.dumps({"a": {"b": {"state": "pending"}}})),
        ("other", "", "lost context"),
        ("retrieve", "", "lost context"),
        ("other", "compressed it", "lost context; index is stale"),
        (None, None, None),
    ]
    want = [["review-false-positive"], [], ["empty-search"], [], ["empty-search"], ["stale-index"], ["stale-index"], [], ["compression-over-aggressive"], ["compression-over-aggressive", "stale-index"], []]
    assert told(spark, lambda df: nested.failures(df["tool"], df["a"], df["b"]), rows, "tool string, a string, b string") == want
