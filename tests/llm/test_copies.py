import json
from collections import Counter

import pytest

from embedflow.llm import copies as C
from embedflow.operators.protocol import parse_line

LINES = [
    '{"id": 1, "text": "Hello, world"}', '{"text":"HELLO world!","id":1}', '{"id": "1", "text": "hello world"}', '{"id": {"a": 1, "b": 2}, "text": "x y"}', '{"id": {"b": 2, "a": 1}, "text": "X\u3000Y。", "more": [1]}',
    "broken", "", None, '{"id": null, "text": "t"}', '{"id": null, "text": "T\\n"}', '{"id": 1.0, "text": "hello world"}', '{"id": 2, "text": "Straße"}', '{"id": 2, "text": "STRASSE"}', '{"id": 3, "text": "..."}', '{"id": 3, "text": "  "}',
    '{"id": 1, "text": "Hello, world"}', '{"id": true, "text": "hello world"}', '{"id": 4, "text": "a+b"}', '{"id": 4, "text": "ab"}', '{"id": 5, "text": ""}', '{"text": "no id"}', '{"id": 6, "text": "' + "long " * 20_000 + '"}', '{"id": 6, "text": "' + "LONG " * 20_000 + '"}',
]


def expected(rows):
    first, links, counts = {}, set(), Counter()
    for no, line in sorted((n, x) for n, x in rows if n is not None and x is not None):
        if parse_line(line).kind != "record":
            continue
        v = json.loads(line)
        f = first.setdefault(C.canonical_key(v["id"], v["text"]), no)
        counts[f] += 1
        if f != no:
            links.add((f, no))
    return links, dict(counts)


def check(spark, df, rows):
    runs = C.copy_runs(df)
    links, counts = expected(rows)
    assert {tuple(r) for r in C.copy_links(runs).collect()} == links
    assert {r.first_line: r.copies for r in C.representatives(runs).collect()} == counts


@pytest.mark.parametrize("a,b,same", [(0, 1, True), (0, 2, False), (3, 4, True), (8, 9, True), (0, 10, True), (11, 12, True), (13, 14, True), (0, 16, False), (17, 18, False)])
def test_keys(a, b, same):
    key = lambda i: C.canonical_key(*(json.loads(LINES[i])[k] for k in ("id", "text")))
    assert (key(a) == key(b)) is same


def test_small(spark):
    rows = [*enumerate(LINES, 1), (None, LINES[0])]
    df = spark.createDataFrame([(n, x, "z", 0) for n, x in rows], "line_no int, line string, key string, h int")
    check(spark, df, rows)
    check(spark, df.limit(0), [])


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_runs_over_borders(spark, parts):
    """A key with a third of all rows fills several ranges; its parts are put together exactly."""
    rows = [(i, json.dumps({"id": 0 if i % 3 == 0 else i % 500, "text": "Hot" if i % 2 else "hot!"})) for i in range(6000)]
    df = spark.createDataFrame(rows, "line_no int, line string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, df, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
