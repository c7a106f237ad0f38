"""python -m embedflow: JSON lines in files, or texts as arguments, to vectors."""

from __future__ import annotations

import argparse
import sys

from embedflow import run
from embedflow.runtime import local_session, ship
from embedflow.spec import QUANTIZE, SHAPES, EncoderSpec, Options, UnsupportedRequest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="embedflow", description=__doc__)
    p.add_argument("--input", help="files of JSON lines (a path or pattern); without it, or with -, standard input is answered on standard output")
    p.add_argument("--output", help="folder for vectors and skipped lines")
    p.add_argument("--text", action="append", default=[], help="a text to embed; may be given again")
    p.add_argument("--model-path", help="folder of a checkpoint; without it, synthetic weights")
    p.add_argument("--tokenizer-path")
    p.add_argument("--model-id", help="the model's label")
    p.add_argument("--prefix", default="")
    p.add_argument("--pooling", choices=["mean", "cls"])
    p.add_argument("--precision", choices=["f32", "bf16"], default="f32")
    p.add_argument("--device", default="cpu")
    p.add_argument("--format", choices=["jsonl", "openai"], default="jsonl")
    p.add_argument("--report-tokens", action="store_true")
    p.add_argument("--no-normalize", action="store_true")
    p.add_argument("--max-seq-length", type=int, default=512)
    p.add_argument("--batch-size", type=int, default=64)
    p.add_argument("--shapes", default=",".join(map(str, SHAPES)))
    p.add_argument("--pad-to-shapes", action="store_true")
    p.add_argument("--threads", default="*", help="cores of the local session")
    p.add_argument("--quantize", choices=list(QUANTIZE), default="none")
    return p


def spec_of(a: argparse.Namespace) -> EncoderSpec:
    shapes = tuple(int(s) for s in a.shapes.split(",") if s.strip())
    o = Options(a.prefix, a.pooling, not a.no_normalize, a.max_seq_length, a.batch_size, a.precision, a.device, a.format, a.report_tokens, shapes, a.pad_to_shapes, a.quantize)
    if a.tokenizer_path and not a.model_path:
        raise ValueError("--tokenizer-path goes with --model-path")
    if a.model_path:
        return EncoderSpec.from_files(a.model_path, a.tokenizer_path, o, a.model_id)
    return EncoderSpec(options=o, pooling=o.pooling or "mean", label=a.model_id or "synthetic")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        spec = spec_of(a)
        spec.config.checked(spec.options.max_seq_length)
        stream = a.input in (None, "-") and not a.text
        if not a.text and not stream and not a.output:
            raise ValueError("--input of files goes with --output")
        if stream and a.output:
            raise ValueError("standard input is answered on standard output")
        spark = ship(local_session(a.threads))
        if a.text:
            for line in run.run_texts(spark, a.text, spec).orderBy("id").drop("model_tag").toJSON().collect():
                print(line)
            return 0
        if stream:
            say = lambda line: print(line, flush=True)
            result = run.run_stream(spark, sys.stdin.buffer, say, lambda message: print(message, file=sys.stderr), spec)
            print(result, file=sys.stderr)
            return result.code
        result = run.run_files(spark, a.input, a.output, spec)
        print(result, file=sys.stderr)
        return result.code
    except UnsupportedRequest as e:
        print(f"unsupported: {e}", file=sys.stderr)
        return 3
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
