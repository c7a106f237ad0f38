import json
import re

import pytest
from pyspark.sql import functions as F

from embedflow.operators import protocol as P
from embedflow.operators.running import buckets, position, running_sum
from embedflow.sources import lines as L

CASES = [
    ('{"id": 123, "text": "hello"}', "record", None, "123", "hello"),
    ('{"id": "b-9", "text": "改行\\nあり"}', "record", None, '"b-9"', "改行\nあり"),
    ("", "flush", None, None, None),
    ("   ", "flush", None, None, None),
    ("\u3000", "flush", None, None, None),
    (None, "flush", None, None, None),
    ("not json", "skip", "invalid JSON", None, None),
    ("[1,2]", "skip", "not a JSON object", None, None),
    ('{"text": "no id"}', "skip", 'missing "id"', None, None),
    ('{"id": 1}', "skip", 'missing or non-string "text"', None, None),
    ('{"id": 1, "text": 5}', "skip", 'missing or non-string "text"', None, None),
    ('{"id": 1, "text": ""}', "skip", 'empty "text"', None, None),
    ('{"id": null, "text": "x"}', "record", None, "null", "x"),
    ('{"id": 1, "text": "  "}', "record", None, "1", "  "),
    ('{"id":1,"text":"t"} junk', "skip", "invalid JSON", None, None),
    ('{"id": NaN, "text": "t"}', "skip", "invalid JSON", None, None),
    ('{"id": 1, "text": "\\ud800"}', "skip", "invalid JSON", None, None),
    ('{"id": 1.0, "text": "a", "text": "b"}', "record", None, "1.0", "b"),
    ('{"id": 123456789012345678901234567890, "text": "t"}', "record", None, "123456789012345678901234567890", "t"),
    ('{"id": {"b": 1, "a": [true]}, "text": "t", "more": 1}', "record", None, '{"b":1,"a":[true]}', "t"),
    ("[" * 100_000, "skip", "invalid JSON", None, None),
    ('{"id": 1e400, "text": "a"}', "skip", "invalid JSON", None, None), ('{"id": 1e300, "text": "a"}', "record", None, "1e+300", "a"),
]


@pytest.mark.parametrize("line,kind,reason,id_json,text", CASES)
def test_parse_line(line, kind, reason, id_json, text):
    assert P.parse_line(line) == (kind, reason, id_json, text)


def test_parse_lines_frame(spark):
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(CASES[:16], 1)], "line_no int, line string, kind string")
    out = {r.line_no: (r.kind, r.skip_reason, r.id_json, r.text) for r in P.parse_lines(df).collect()}
    assert out == {i: tuple(c[1:]) for i, c in enumerate(CASES[:16], 1)}
    assert P.parse_lines(df.limit(0)).count() == 0
    blank = df.select(P.is_blank(F.col("line")).alias("b"), "line").where("line IS NOT NULL").collect()
    assert all(r.b == (P.parse_line(r.line).kind == "flush") for r in blank)
    assert {r.message for r in P.quarantine(P.parse_lines(df)).collect()} >= {"skip line 7: invalid JSON", 'skip line 12: empty "text"'}


def test_batches_and_chunks(spark):
    kinds = ["record", "flush", "record", "record", "flush", "flush", "record"]
    df = spark.createDataFrame([(i, s, k) for s in ("x", None) for i, k in enumerate(kinds, 1)], "line_no int, s string, kind string")
    out = P.with_batches(df, stream_col="s", bucket_rows=2).orderBy("s", "line_no").collect()
    assert [r.batch_no for r in out] == [0, 0, 1, 1, 1, 2, 3] * 2
    chunked = P.with_chunks(df.where("kind = 'record'"), size=2, by=("s",), bucket_rows=2).orderBy("s", "line_no").collect()
    assert [(r["index"], r.chunk_no) for r in chunked] == [(0, 0), (1, 0), (2, 1), (3, 1)] * 2


def test_position_hot_key(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k")
    out = position(df, ["id"], F.floor(F.col("id") / 64), "p").collect()
    assert all(r.p == r.id for r in out)


def test_prefix_keeps_blanks(spark):
    df = spark.createDataFrame([(" a ",), ("",)], "text string")
    assert [r.input_text for r in P.with_prefix(df, "q: ").collect()] == ["q:  a ", "q: "]
    assert [r.input_text for r in P.with_prefix(df, F.lit(None).cast("string")).collect()] == [" a ", ""]


def test_line_source(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes("y\rz\r\n\nlast\n".encode())
    (tmp_path / "b.jsonl").write_bytes("no end".encode())
    (tmp_path / "c.jsonl").write_bytes(b"")
    rows = L.read_lines(spark, str(tmp_path / "*.jsonl")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.line_no):
        got.setdefault(r.file[-7:], []).append(r.line)
    assert got == {"a.jsonl": ["y\rz", "", "last"], "b.jsonl": ["no end"]}
    texts = L.read_texts(spark, str(tmp_path / "a.jsonl")).orderBy("id").collect()
    assert [tuple(r) for r in texts] == [(0, "y\rz"), (1, "last")]
    (tmp_path / "bad.jsonl").write_bytes(b"\xff\n")
    with pytest.raises(Exception):
        L.read_lines(spark, str(tmp_path / "bad.jsonl")).collect()


def test_argument_source(spark):
    assert [tuple(r) for r in L.from_arguments(spark, ["a", "", "a"]).collect()] == [(0, "a"), (1, ""), (2, "a")]


def test_writers(spark):
    df = spark.createDataFrame([("1", [0.5, 0.5], 7, False, True), ('"b"', [1.0], None, None, True), ("2", [1e-5], 3, True, False)], "id_json string, e array<float>, n int, t boolean, report boolean")
    lines = [r[0] for r in df.select(L.jsonl_line(F.col("id_json"), F.col("e"), F.col("n"), F.col("t"), F.col("report"))).collect()]
    assert lines[0] == '{"id":1,"embedding":[0.5,0.5],"n_tokens":7,"truncated":false}'
    assert [set(json.loads(x)) for x in lines[1:]] == [{"id", "embedding"}] * 2
    assert json.loads(lines[2])["embedding"] == [pytest.approx(1e-5)]


def test_openai_documents(spark):
    batches = spark.createDataFrame([(0, "m"), (1, "m"), (2, None)], "b int, model string")
    records = spark.createDataFrame([(0, 1, [2.0], 4), (0, 0, [1.0], 3), (2, 0, [5.0], None)], "b int, index int, embedding array<float>, n_tokens int")
    out = {r.b: (r.n_items, r.prompt_tokens, json.loads(r.document)) for r in L.openai_documents(batches, records, ["b"]).collect()}
    assert out[0][:2] == (2, 7) and [d["index"] for d in out[0][2]["data"]] == [0, 1] and out[0][2]["usage"] == {"prompt_tokens": 7, "total_tokens": 7}
    assert out[1] == (0, 0, {"object": "list", "data": [], "model": "m", "usage": {"prompt_tokens": 0, "total_tokens": 0}})
    assert all("id" not in d for d in out[0][2]["data"]) and out[2][2]["model"] == ""


def test_running_sum_in_levels(spark):
    """Buckets within buckets, a null key, gaps, and negative positions."""
    df = spark.range(-300, 900).where("id % 7 <> 3").selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('k', id % 10) END k", "id % 4 v")
    levels = [F.floor(F.col("id") / 100), F.floor(F.col("id") / 50), F.floor(F.col("id") / 5)]
    out = running_sum(df, F.col("v"), ["id"], levels, "s", ["k"])
    assert out.columns == ["id", "k", "v", "s"]
    seen = {}
    for r in sorted(out.collect()):
        assert r.s == seen.get(r.k, 0)
        seen[r.k] = seen.get(r.k, 0) + r.v
    assert position(df.limit(0), ["id"], buckets(F.col("id")), "p").count() == 0


def test_no_ordered_pass_over_all_buckets(spark):
    """Of the three windows only that over the groups of buckets has no key."""
    plan = position(spark.range(10), ["id"], buckets(F.col("id")), "p")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"windowspecdefinition\(", plan)) == 3 and len(re.findall(r"windowspecdefinition\(_b0#\w+ ASC", plan)) == 1


def test_large_file_is_read_in_parts(spark, tmp_path):
    lines = [f"{i} " + "x" * (i % 50) for i in range(6000)]
    (tmp_path / "a.txt").write_text("\n".join(lines), "utf-8")
    (tmp_path / "b.txt").write_text("\n\n" + "\n".join(lines[:10]) + "\n", "utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        raw = L.raw_lines(spark.read.option("lineSep", "\n").text(f"{tmp_path}/*.txt"))
        assert raw.rdd.getNumPartitions() > 10
        got = {}
        for r in L.read_lines(spark, f"{tmp_path}/*.txt").collect():
            got.setdefault(r.file[-5:], []).append((r.line_no, r.line))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got["a.txt"]) == list(enumerate(lines, 1)) and sorted(got["b.txt"]) == list(enumerate(["", "", *lines[:10]], 1))
