"""JSON arrays read in parts (A4): one file of any size, ``[{...}, {...}, ...]``, by several tasks.

Whether a byte of such a file lies inside a string depends on all bytes before it.  A first pass therefore sums up every
byte range for each state it may begin in (outside a string, inside one, after a backslash): the state it ends in and
the change of depth.  Chaining these few numbers per range gives the true state and depth at every range's start.  In the
second pass a range yields the records whose opening brace it holds, reading on to the end of the last one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUT, IN, ESCAPED = 0, 1, 2
#: A whole string, a string that is not closed here, or a bracket.
TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"|"|[\[\]{}]', re.S)
REST_OF_STRING = re.compile(rb'(?:[^"\\]|\\.)*"', re.S)
#: Bytes that are read at first and at most beyond a range for the end of its last record.
READ_ON, READ_ON_MOST = 1 << 12, 1 << 20
#: A task takes ranges of about so many bytes; with fewer than ``LEAST_TASKS`` tasks, fewer.
TASK_BYTES, LEAST_TASKS = 8 << 20, 64


def ends_escaped(data: bytes) -> bool:
    return (len(data) - len(data.rstrip(b"\\"))) % 2 == 1


def after_string(data: bytes, state: int) -> tuple[int, int]:
    """(position after the string that ``data`` begins in, state there); the end of ``data`` if it does not close."""
    at = 1 if state == ESCAPED else 0
    found = REST_OF_STRING.match(data, at)
    if found:
        return found.end(), OUT
    return len(data), ESCAPED if ends_escaped(data[at:]) else IN


def summary(data: bytes, state: int) -> tuple[int, int]:
    """(state at the end, change of depth) of a range that begins in ``state``."""
    if not data:
        return state, 0
    at = 0
    if state != OUT:
        at, state = after_string(data, state)
        if state != OUT:
            return state, 0
    depth = 0
    for token in TOKEN.finditer(data, at):
        text = token[0]
        if text == b'"':
            return (ESCAPED if ends_escaped(data[token.end():]) else IN), depth
        depth += text in b"[{"
        depth -= text in b"]}"
    return OUT, depth


def records(data: bytes, more: Iterator[bytes], state: int, depth: int) -> Iterator[bytes]:
    """The records that open in ``data`` (objects directly in the outer array), which begins in ``state`` at ``depth``;
    ``more`` continues the file for the last of them."""
    size, start, at = len(data), None, 0
    if state != OUT:
        at, state = after_string(data, state)
        if state != OUT:
            return
    while True:
        for token in TOKEN.finditer(data, at):
            text, cut = token[0], token.start()
            if text == b'"':  # goes on beyond what has been read
                at = cut
                break
            if text == b"{" and depth == 1:
                if cut >= size:
                    return
                start = cut
            depth += text in b"[{"
            depth -= text in b"]}"
            if text == b"}" and depth == 1 and start is not None:
                yield data[start:token.end()]
                start = None
                if token.end() >= size:
                    return
        else:
            at = len(data)
        if start is None:
            return
        extra = next(more, b"")
        if not extra:
            raise ValueError("the array ends inside a record")
        if start:  # what lies before the record is not needed again
            data, at, size, start = data[start:], at - start, size - start, 0
        data += extra


def ranges(store: pafs.FileSystem, path: str, part_bytes: int) -> list[tuple[str, int, int]]:
    info = store.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.type == pafs.FileType.File else [
        f for f in store.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
    return [(f.path, a, min(a + part_bytes, f.size)) for f in sorted(files, key=lambda f: f.path) for a in range(0, f.size, part_bytes)]


def read_on(f, at: int, size: int) -> Iterator[bytes]:
    """What follows in ``f`` from ``at`` on, in steps that grow: most records end soon after their range."""
    step = READ_ON
    while at < size:
        yield f.read_at(min(step, size - at), at)
        at, step = at + step, min(2 * step, READ_ON_MOST)


def json_array_texts(spark: SparkSession, path: str, part_bytes: int = 32 << 20) -> DataFrame:
    """(file, value): the text of every record of the JSON array file ``path``, or of all such files in that folder."""
    store, base = pafs.FileSystem.from_uri(path)
    parts = [(i, *r) for i, r in enumerate(ranges(store, base, part_bytes))]
    if not parts:
        return spark.createDataFrame([], "file string, value string")
    # a task reads many ranges: their size bounds memory, not the number of tasks
    tasks = min(len(parts), max(LEAST_TASKS, sum(end - start for *_, start, end in parts) // TASK_BYTES))
    table = spark.createDataFrame(parts, "part int, file string, start long, end long").repartition(tasks)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(path)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                with store.open_input_file(r["file"]) as f:
                    data = f.read_at(r["end"] - r["start"], r["start"])
                out.append((r["part"], [v for state in (OUT, IN, ESCAPED) for v in summary(data, state)]))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([v for _, v in out], pa.list_(pa.int32()))],
                                             names=["part", "ends"])

    found = {r["part"]: r["ends"] for r in table.mapInArrow(sum_up, "part int, ends array<int>").collect()}  # a row per range
    begins, file, state, depth = [], None, OUT, 0
    for i, name, start, end in parts:
        if name != file:
            file, state, depth = name, OUT, 0
        begins.append((i, name, start, end, state, depth))
        state, depth = found[i][2 * state], depth + found[i][2 * state + 1]
    placed = spark.createDataFrame(begins, "part int, file string, start long, end long, state int, depth int").repartition(tasks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(r["file"]) as f:
                    size = f.size()
                    data = f.read_at(r["end"] - r["start"], r["start"])
                    more = read_on(f, r["end"], size)
                    held = []
                    for text in records(data, more, r["state"], r["depth"]):
                        held.append(text.decode("utf-8", "replace"))
                        if len(held) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * 1000), pa.array(held)], names=["file", "value"])
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(held)), pa.array(held)], names=["file", "value"])

    return placed.mapInArrow(read, "file string, value string")


def read_json_arrays(spark: SparkSession, path: str, schema: str, part_bytes: int = 32 << 20) -> DataFrame:
    """The records of ``path`` as rows of ``schema`` (DDL); what is missing or of another type is NULL, other fields go."""
    texts = json_array_texts(spark, path, part_bytes)
    return texts.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def write_json_arrays(df: DataFrame, path: str) -> str:
    """``df`` as JSON array files, one per partition."""
    texts = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([(lead if i == 0 else ",") + v for i, v in enumerate(lines)])], names=["value"])
                lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"])], names=["value"])

    texts.mapInArrow(wrap, "value string").write.mode("overwrite").text(path)
    return path
