import json
import time

from embedflow.sources.lines import read_lines
from embedflow.spec import EncoderSpec, Options
from embedflow.streaming import requests as S


def test_requests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id": 1, "text": "one"}\n\n{"id": 2, "text": "two"}\nbroken\n', "utf-8")
    (tmp_path / "in" / "b.jsonl").write_text("\n", "utf-8")
    seen = []
    q = S.run_requests(S.read_requests(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp"), then=lambda df, epoch: seen.append(df.count()))
    q.awaitTermination(120)
    lines, records = (spark.read.parquet(str(tmp_path / "out" / n)) for n in ("lines", "records"))
    assert sorted(seen) == [0, 2] and records.count() == 2
    assert {(r.id_json, r.batch_no) for r in records.collect()} == {("1", 0), ("2", 1)}
    batch, _ = S.answer(read_lines(spark, str(tmp_path / "in" / "*")), EncoderSpec())
    assert {(r.id_json, tuple(r.embedding)) for r in batch.collect()} == {(r.id_json, tuple(r.embedding)) for r in records.collect()}
    got = S.summary(lines, records, EncoderSpec()).first().asDict()
    assert got == {"model": "synthetic", "dim": 64, "n_in": 3, "n_out": 2, "skipped": 1, "truncated": 0}
    none = S.summary(lines.limit(0), records.limit(0), EncoderSpec()).first()
    assert (none.dim, none.n_in, none.n_out) == (0, 0, 0)


def test_answers_in_both_formats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id": 1, "text": "one"}\n\n\n{"id": 2, "text": "two"}\n', "utf-8")
    for form, want in (("jsonl", [1, None, None, 2]), ("openai", [[0], [], [0]])):
        spec = EncoderSpec(options=Options(format=form))
        S.run_requests(S.read_requests(spark, str(tmp_path / "in")), str(tmp_path / form), str(tmp_path / f"cp-{form}"), spec).awaitTermination(120)
        parts = sorted((tmp_path / form / "answers" / "epoch=0").glob("part-*"))
        lines = [json.loads(x) if x else None for f in parts for x in f.read_text().split("\n")[:-1]]
        assert [x and (x["id"] if form == "jsonl" else [i["index"] for i in x["data"]]) for x in lines] == want


def test_query_without_an_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    q = S.run_requests(S.read_requests(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), then=lambda df, epoch: seen.append(df.count()), every="200 milliseconds")
    try:
        for n in (1, 2):
            (tmp_path / "new").write_text('{"id": 1, "text": "one"}\n' * n, "utf-8")
            (tmp_path / "new").rename(tmp_path / "in" / f"{n}.jsonl")
            for _ in range(300):
                if len(seen) == n:
                    break
                time.sleep(0.1)
        assert seen == [1, 2] and q.isActive
    finally:
        q.stop()
