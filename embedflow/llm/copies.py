"""Problem 3: records that differ only in layout, collapsed with the exact number of copies.

Canonical records are range-partitioned and sorted externally by a hash of the key, the full key and the line
number; a scan then compares the full keys of adjacent rows. A run that reaches over the border of two ranges
(a key with very many copies fills several of them) is put together from its parts afterwards.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedflow.operators.protocol import accepted_records
from embedflow.runtime import materialize

_left_out = regex.compile(r"[\s\p{White_Space}\p{P}]+")


def _same_number(v):
    if isinstance(v, float) and v.is_integer():
        return int(v)
    if isinstance(v, dict):
        return {k: _same_number(x) for k, x in v.items()}
    return [_same_number(x) for x in v] if isinstance(v, list) else v


def canonical_key(record_id, text: str) -> str:
    """Equal for copies: the id as JSON with sorted members, the text in one case without white space and punctuation."""
    return json.dumps(_same_number(record_id), sort_keys=True) + "\0" + _left_out.sub("", text).casefold()


def canonical_records(lines: DataFrame, number_col: str = "line_no", line_col: str = "line") -> DataFrame:
    """(h, key, line_no) of the accepted records."""

    def canonical(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, found in accepted_records(batches, "n", "l"):
            keys = [canonical_key(*r) for r in found]
            h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(keys, pa.string()), pa.array(numbers, pa.int64())], names=["h", "key", "line_no"])

    return lines.select(F.col(f"`{number_col}`").cast("long").alias("n"), F.col(f"`{line_col}`").alias("l")).mapInArrow(canonical, "h long, key string, line_no long")


def _scan_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range become (line_no, part, run, first_line); each run adds a row with its copies.

    The rows of runs carry their key where their hash is the first or the last of the range.
    """
    part = TaskContext.get().partitionId()
    names = ["line_no", "part", "run", "first_line", "copies", "key"]
    first_h = last = None  # last: (h, key, run, first line, copies so far)
    held: list[tuple] = []  # finished runs of the hash seen last: they may be at the range's end
    run = -1

    def rows(lines, runs, firsts, copies, keys):
        n = len(runs)
        return pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), pa.array(np.full(n, part), pa.int32()), pa.array(runs, pa.int64()), pa.array(firsts, pa.int64()), pa.array(copies, pa.int64()), pa.array(keys, pa.string())], names=names)

    def done(runs: list[tuple], edge: bool):
        return rows([None] * len(runs), [r[2] for r in runs], [r[3] for r in runs], [r[4] for r in runs], [r[1] if edge else None for r in runs])

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        h, key, line = b.column("h").to_numpy(), b.column("key"), b.column("line_no").to_numpy()
        fresh = np.ones(n, bool)
        same_h = np.flatnonzero(h[1:] == h[:-1]) + 1
        if len(same_h):
            fresh[same_h] = ~pc.equal(key.take(pa.array(same_h)), key.take(pa.array(same_h - 1))).to_numpy(zero_copy_only=False)
        if last is not None:
            fresh[0] = not (last[0] == h[0] and last[1] == key[0].as_py())
        else:
            first_h = h[0]
        starts = np.flatnonzero(fresh)
        runs = run + np.cumsum(fresh)
        firsts = np.empty(n, np.int64)
        if len(starts):
            firsts[starts[0] :] = np.repeat(line[starts], np.diff(np.append(starts, n)))
        lead = starts[0] if len(starts) else n
        if lead:
            firsts[:lead] = last[3]
            last = (*last[:4], last[4] + lead)
        yield rows(line, runs, firsts, [None] * n, [None] * n)
        if len(starts):
            ends = np.append(starts[1:], n)
            closed = ([last] if last is not None else []) + [(h[s], key[s].as_py() if h[s] == first_h or h[s] == h[-1] else None, int(runs[s]), int(line[s]), int(e - s)) for s, e in zip(starts, ends)]
            last = closed.pop()
            if last[1] is None:
                last = (last[0], key[int(starts[-1])].as_py(), *last[2:])
            still = [r for r in held + closed if r[0] == h[-1]]
            out = [r for r in held + closed if r[0] != h[-1]]
            held = still
            if out:
                yield done([r for r in out if r[0] != first_h], False)
                yield done([r for r in out if r[0] == first_h], True)
        run = int(runs[-1])
    if last is not None:
        yield done([*held, last], True)


def copy_runs(lines: DataFrame, number_col: str = "line_no", line_col: str = "line") -> DataFrame:
    """(line_no, first_line, copies): a row for each accepted record (copies null) and one for each part of a run
    (line_no null, copies: the records of that part).

    Accepted are lines that are JSON objects with a member id and a non-empty string text. Null lines, lines
    without a number, blank and broken lines take no part; a text that is nothing but white space and punctuation
    is the empty text, equal to others of its id. Numbers are equal by value (1 and 1.0), 1 and "1" differ. An
    empty frame gives an empty one.
    """
    records = materialize(canonical_records(lines, number_col, line_col), "canonical")
    ordered = records.repartitionByRange("h", "line_no").sortWithinPartitions("h", "key", "line_no")
    scanned = materialize(ordered.mapInArrow(_scan_runs, "line_no long, part int, run long, first_line long, copies long, key string"), "runs")
    # two hashes a range can stand at its ends: the table is bounded by the number of ranges, not by the rows
    ends = scanned.where("key IS NOT NULL")
    joined = ends.groupBy("key").agg(F.min("first_line").alias("first"), F.count("*").alias("n")).where("n > 1")
    moved = ends.join(joined, "key").select("part", "run", "first")
    return scanned.join(F.broadcast(moved), ["part", "run"], "left").select("line_no", F.coalesce("first", "first_line").alias("first_line"), "copies")


def copy_links(runs: DataFrame) -> DataFrame:
    """(first_line, copy_line) of each copy but the first of its set."""
    return runs.where("line_no IS NOT NULL AND line_no <> first_line").select("first_line", F.col("line_no").alias("copy_line"))


def representatives(runs: DataFrame) -> DataFrame:
    """(first_line, copies): one record of each set, the one with the smallest line number, and its exact count."""
    return runs.where("line_no IS NULL").groupBy("first_line").agg(F.sum("copies").alias("copies"))
