import json

import pytest

from embedflow import __main__ as cli
from embedflow import run
from embedflow.spec import EncoderSpec, Options


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": {"k": 1}, "text": "one"}\n\n\n{"id": 2, "text": "two words"}\nbroken\n', "utf-8")
    return tmp_path


def test_jsonl(spark, folder):
    result = run.run_files(spark, str(folder / "a.jsonl"), str(folder / "out"), EncoderSpec().with_options(report_tokens=True))
    assert (result.n_in, result.n_out, result.skipped, result.truncated, result.dim, result.code) == (3, 2, 1, 0, 64, 2)
    lines = [x for f in sorted((folder / "out" / "vectors").glob("part-*")) for x in f.read_text().splitlines()]
    assert [json.loads(x)["id"] if x else None for x in lines] == [{"k": 1}, None, None, 2]
    assert [json.loads(x)["n_tokens"] for x in lines if x] == [3, 4]
    assert spark.read.parquet(str(folder / "out" / "skipped")).first().message == "skip line 5: invalid JSON"


def test_openai(spark, folder):
    run.run_files(spark, str(folder / "a.jsonl"), str(folder / "out"), EncoderSpec(options=Options(format="openai")))
    docs = [json.loads(r.value) for r in spark.read.text(str(folder / "out" / "vectors")).collect()]
    assert sorted((len(d["data"]), d["usage"]["total_tokens"]) for d in docs) == [(0, 0), (1, 3), (1, 4)]
    assert all(x["index"] == 0 for d in docs for x in d["data"])


def test_empty_input(spark, folder):
    (folder / "none.jsonl").write_text("")
    result = run.run_files(spark, str(folder / "none.jsonl"), str(folder / "out"))
    assert (result.dim, result.n_in, result.n_out, result.code) == (0, 0, 0, 0)
    assert spark.read.text(str(folder / "out" / "vectors")).count() == 0
    run.run_files(spark, str(folder / "none.jsonl"), str(folder / "out"), EncoderSpec(options=Options(format="openai")))
    assert [json.loads(r.value)["data"] for r in spark.read.text(str(folder / "out" / "vectors")).collect()] == [[]]


def test_texts(spark):
    rows = run.run_texts(spark, ["a", "", "a"]).orderBy("id").collect()
    assert [(r.id, r.n_tokens) for r in rows] == [(0, 3), (1, 2), (2, 3)] and rows[0].embedding == rows[2].embedding


def test_command_line(capsys):
    assert cli.main(["--text", "a", "--device", "metal"]) == 3
    assert cli.main(["--text", "a", "--format", "openai", "--report-tokens"]) == 3
    assert cli.main(["--input", "in.jsonl"]) == 1
    assert cli.main(["--output", "out"]) == 1
    assert cli.main(["--text", "a", "--tokenizer-path", "t.json"]) == 1
    assert cli.main(["--text", "a", "--model-path", "/nowhere"]) == 1
    a = cli.spec_of(cli.parser().parse_args(["--prefix", "q: ", "--pooling", "cls", "--no-normalize", "--shapes", "128,64"]))
    assert (a.options.prefix, a.pooling, a.options.normalize, a.options.shapes) == ("q: ", "cls", False, (64, 128))
    capsys.readouterr()


LINES = [b'{"id": 1, "text": "one"}\n', b"\n", b"broken\r\n", b" \t\n", b'{"id": "b", "text": "two words"}\r\n', b'{"id": null, "text": "three"}']


def streamed(spark, source, spec):
    out, err = [], []
    return run.run_stream(spark, source, out.append, err.append, spec), out, err


def test_stream_of_lines(spark, monkeypatch, tmp_path):
    """As a run over a file with the same lines; batches in chunks, each answered at its end."""
    spec = EncoderSpec().with_options(report_tokens=True)
    result, out, err = streamed(spark, LINES, spec)
    assert (result.n_in, result.n_out, result.skipped, result.truncated, result.dim, result.code) == (4, 3, 1, 0, 64, 2)
    assert [json.loads(x)["id"] if x else None for x in out] == [1, None, None, "b", None] and err == ["skip line 3: invalid JSON"]
    (tmp_path / "a.jsonl").write_bytes(b"".join(LINES))
    run.run_files(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "out"), spec)
    assert out == [x for f in sorted((tmp_path / "out" / "vectors").glob("part-*")) for x in f.read_text().split("\n")[:-1]]
    monkeypatch.setattr(run, "CHUNK", 1)
    assert streamed(spark, LINES, spec)[:2] == (result, out)
    with pytest.raises(UnicodeDecodeError):
        streamed(spark, [b"\xff\n"], spec)


def test_stream_of_documents(spark, monkeypatch):
    monkeypatch.setattr(run, "CHUNK", 1)
    spec = EncoderSpec(options=Options(format="openai"), label='a "model" \\ é')
    _, out, _ = streamed(spark, LINES, spec)
    docs = [json.loads(x) for x in out]
    assert [[x["index"] for x in d["data"]] for d in docs] == [[0], [], [0, 1]] and {d["model"] for d in docs} == {spec.label}
    assert [d["usage"]["total_tokens"] for d in docs] == [3, 0, 7]
    assert [json.loads(x)["data"] for x in streamed(spark, [], spec)[1]] == [[]]
    assert streamed(spark, [], EncoderSpec())[1] == []


def checkpoint(folder):
    """A checkpoint folder with drawn weights and a tokenizer of a few words."""
    import struct

    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    from embedflow.spec import TINY, synthetic_weights

    folder.mkdir()
    weights = {f"model.{k}": v for k, v in synthetic_weights(TINY).items()}
    header, at = {}, 0
    for k, v in weights.items():
        header[k] = {"dtype": "F32", "shape": list(v.shape), "data_offsets": [at, at + v.nbytes]}
        at += v.nbytes
    raw = json.dumps(header).encode()
    (folder / "model.safetensors").write_bytes(struct.pack("<Q", len(raw)) + raw + b"".join(v.tobytes() for v in weights.values()))
    config = {"vocab_size": 32, "hidden_size": 16, "num_hidden_layers": 3, "num_attention_heads": 2, "intermediate_size": 8, "max_position_embeddings": 64, "local_attention": 4, "global_attn_every_n_layers": 3, "global_rope_theta": 160000.0, "local_rope_theta": 10000.0}
    (folder / "config.json").write_text(json.dumps(config))
    words = Tokenizer(models.WordLevel({"[PAD]": 0, "[CLS]": 1, "[SEP]": 2, "[UNK]": 3, "one": 4, "two": 5}, unk_token="[UNK]"))
    words.pre_tokenizer = pre_tokenizers.Whitespace()
    words.post_processor = processors.TemplateProcessing(single="[CLS] $A [SEP]", special_tokens=[("[CLS]", 1), ("[SEP]", 2)])
    words.save(str(folder / "tokenizer.json"))
    return folder


def test_checkpoint_is_shipped(spark, tmp_path):
    """Workers open their own copies: the driver's folder may be gone by then."""
    import shutil

    from embedflow.embed import embed_batch, embed_records, ship_checkpoint

    spec = EncoderSpec.from_files(str(checkpoint(tmp_path / "tiny")), options=Options(max_seq_length=5))
    texts = ["one two", "two", "other one two one", ""]
    want, sizes, cut = embed_batch(texts, spec)
    assert sizes == [4, 3, 5, 2] and cut == [False, False, True, False] and want.shape == (4, 16)
    ship_checkpoint(spark, spec)
    shutil.rmtree(tmp_path / "tiny")
    got = embed_records(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), spec).orderBy("i").collect()
    assert [r.n_tokens for r in got] == sizes and [r.truncated for r in got] == cut
    assert max(abs(a - b) for r, v in zip(got, want) for a, b in zip(r.embedding, v.tolist())) < 1e-5


def test_checkpoints_are_refused(tmp_path):
    from embedflow.embed import check_output
    from embedflow.spec import UnsupportedRequest, config_from_json

    folder = checkpoint(tmp_path / "tiny")
    with pytest.raises(UnsupportedRequest, match="hidden_size twice"):
        config_from_json((folder / "config.json").read_text()[:-1] + ', "hidden_size": 16}')
    (folder / "tokenizer.json").unlink()
    with pytest.raises(FileNotFoundError, match="tokenizer.json"):
        EncoderSpec.from_files(str(folder), options=Options(max_seq_length=5))
    import numpy as np

    check_output(np.zeros((1, 2, 4)), (1, 2, 4))
    for wrong in (np.zeros((1, 2, 5)), np.full((1, 2, 4), np.nan)):
        with pytest.raises(ValueError):
            check_output(wrong, (1, 2, 4))
