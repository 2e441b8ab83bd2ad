"""Exact CSV in parallel: a data source that reads byte ranges, and one that commits a single file.

A byte tells where it stands in a record only together with all before it.  So
a scan has two passes.  In the first, every range is walked once for each state
it may begin in (states soon fall together), which gives, for each, the state
at its end and how many records begin in it; composing these from range to
range tells the true state and the row number at every range.  In the second,
each range parses the records that begin in it, the last one to its end.

States follow Python's csv reader: a quote counts at the start of a field only,
two quotes within quotes are one, and CR, LF and CRLF end records.  Blank lines
are no records.

Writing: every task writes a part under a name of its own attempt; the commit
puts the parts of the tasks that succeeded together in order, behind the header,
under a temporary name, and renames it.  Parts of failed or killed tasks lie in
the same staging folder, which goes at the end of either outcome.

Paths are local ones or URIs that pyarrow's file systems know.
"""

from __future__ import annotations

import csv
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: States: between records, behind a CR that ended one, at the start of a field, in a bare field, in quotes, behind a quote in quotes.
BETWEEN, RETURNED, FIELD, BARE, QUOTED, CLOSING = range(6)
STATES = range(6)
RANGE, BLOCK, ROWS = 64 << 20, 1 << 20, 4096  # bytes of a range, bytes read at once, rows of a batch
_SIGNS = re.compile(rb'[",\r\n]')
_ENDS = re.compile(rb"[,\r\n]")
BOM = b"\xef\xbb\xbf"


def walk(data: bytes, state: int, starts: list[int] | None = None) -> tuple[int, int]:
    """(state behind the data, records that begin in it); their places go to starts."""
    i, n, begun = 0, len(data), 0
    while i < n:
        if state == QUOTED:
            i = data.find(b'"', i) + 1
            if not i:
                break
            state = CLOSING
            continue
        if state == BARE:
            m = _ENDS.search(data, i)
            if m is None:
                break
            i = m.start()
        c = data[i]
        if state <= RETURNED:
            if c == 10:
                state, i = BETWEEN, i + 1
                continue
            if c == 13:
                state, i = RETURNED, i + 1
                continue
            begun += 1
            if starts is not None:
                starts.append(i)
            state = FIELD
        if c == 34:
            state = QUOTED if state in (FIELD, CLOSING) else BARE
        else:
            state = {44: FIELD, 10: BETWEEN, 13: RETURNED}.get(c, BARE)
        i += 1
    return state, begun


def effect(blocks: Iterator[bytes]) -> tuple[list[int], list[int]]:
    """Of a range, for each state at its start: the state at its end, and how many records begin in it.

    States that have fallen together are walked once.
    """
    at, begun = list(STATES), [0] * len(STATES)
    for block in blocks:
        done = {s: walk(block, s) for s in set(at)}
        begun = [n + done[s][1] for s, n in zip(at, begun)]
        at = [done[s][0] for s in at]
    return at, begun


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def blocks(path: str, low: int, high: int, size: int = BLOCK) -> Iterator[bytes]:
    system, name = opened(path)
    with system.open_input_file(name) as f:
        f.seek(low)
        while low < high:
            block = f.read(min(size, high - low))
            if not block:
                return
            low += len(block)
            yield block


def _size(path: str) -> int:
    system, name = opened(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return info.size


def header(path: str) -> tuple[list[str], int]:
    """The names of the first record, and the byte behind a mark of the byte order, if there is one."""
    data, state, size = b"", BETWEEN, _size(path)
    skip = 3 if b"".join(blocks(path, 0, min(3, size))) == BOM else 0
    for block in blocks(path, skip, size, 1 << 16):
        data += block
        starts: list[int] = []
        state, _ = walk(data, BETWEEN, starts)
        if len(starts) > 1:
            data = data[: starts[1]]
            break
    names = next((r for r in csv.reader(io.StringIO(data.decode("utf-8"), newline="")) if r), None)
    if names is None:
        raise ValueError(f"{path}: a header is needed")
    if len(set(names)) < len(names):
        raise ValueError(f"{path}: names of the header repeat")
    return names, skip


@dataclass
class Range(InputPartition):
    low: int
    high: int
    state: int
    rows: int  # records before it, the header among them

    def __post_init__(self):
        self.value = self.low


def records(path: str, part: Range, size: int, block: int = BLOCK) -> Iterator[tuple[int, list[str]]]:
    """(number, cells) of the records that begin in a range; the header has number 0."""
    state, number, held, at = part.state, part.rows, b"", part.low
    open_ = False  # whether held begins with a record

    def parsed(data: bytes, offset: int) -> Iterator[list[str]]:
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError as e:
            raise ValueError(f"{path}: invalid UTF-8 at byte {offset + e.start}") from e
        return (r for r in csv.reader(io.StringIO(text, newline="")) if r)

    csv.field_size_limit(2**31 - 1)
    for data in blocks(path, part.low, size, block):
        starts: list[int] = []
        state, _ = walk(data, state, starts)
        behind = at + len(data)
        mine = [s for s in starts if at + s < part.high]
        cut = None
        if len(mine) < len(starts):
            cut = starts[len(mine)]  # the first record of the next range
        elif mine:
            cut = mine[-1]
        if open_ or mine:
            begin = 0 if open_ else mine[0]
            if cut is None:
                held += data
            else:
                whole = held + data[begin:cut]
                for row in parsed(whole, at + begin - len(held)):
                    yield number, row
                    number += 1
                held = data[cut:] if len(mine) == len(starts) else b""
            open_ = open_ or bool(mine)
        at = behind
        if len(mine) < len(starts) or at >= part.high and not open_:
            return
        if at >= part.high and state <= RETURNED:
            break
    if held:
        for row in parsed(held, at - len(held)):
            yield number, row
            number += 1


class ExactCsv(DataSource):
    """Options: path; for reading ranges (of Range, in JSON) and names; for writing columns."""

    @classmethod
    def name(cls) -> str:
        return "exact_csv"

    def schema(self) -> StructType:
        # Names are places, since a column of the file may have any name.
        return StructType([StructField("0", LongType()), *(StructField(str(k), StringType()) for k, _ in enumerate(json.loads(self.options["names"]), 1))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options["size"])
        self.ranges, self.width = json.loads(options["ranges"]), len(json.loads(options["names"]))

    def partitions(self) -> list[Range]:
        return [Range(*r) for r in self.ranges]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            cols = [pa.array([r[k] for r in rows], pa.string()) for k in range(1, self.width + 1)]
            names = [str(k) for k in range(self.width + 1)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *cols], names=names)

        rows, held = [], 0
        for number, cells in records(self.path, partition, self.size):
            if number == 0:
                continue
            if len(cells) > self.width:
                raise ValueError(f"{self.path}: row {number} has {len(cells)} cells for {self.width} columns")
            rows.append((number, *cells, *[""] * (self.width - len(cells))))
            held += sum(map(len, cells))
            if len(rows) == ROWS or held > BLOCK:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """All cells as strings, with row_index (1, 2, ...) in file order; short rows end in empty cells, rows that are too long raise."""
    names, skip = header(path)
    size = _size(path)
    bounds = [(k, low, min(size, low + range_bytes)) for k, low in enumerate(range(skip, size, range_bytes))]

    def first(batches):
        for batch in batches:
            rows = [effect(blocks(path, low, high)) for low, high in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["k", "to", "begun"])

    ranges, state, rows = [], BETWEEN, 0
    if len(bounds) > 1:
        table = spark.createDataFrame(bounds, "k long, low long, high long").repartition(len(bounds), "k")
        effects = {r.k: r for r in table.mapInArrow(first, "k long, to array<long>, begun array<long>").collect()}
    # A row for each scan task, as the scheduler holds it too.
    for k, low, high in bounds:
        ranges.append((low, high, state, rows))
        if len(bounds) > 1:
            state, rows = effects[k].to[state], rows + effects[k].begun[state]
    spark.dataSource.register(ExactCsv)
    options = {"path": path, "size": str(size), "names": json.dumps(names), "ranges": json.dumps(ranges)}
    df = spark.read.format("exact_csv").options(**options).load()
    return df.toDF("row_index", *names)


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.staging, self.names = options["path"], options["staging"], json.loads(options["columns"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = opened(self.staging)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        rows = 0
        with system.open_output_stream(name) as out:
            for batch in iterator:
                text = io.StringIO(newline="")
                writer = csv.writer(text)
                writer.writerows(zip(*(c.to_pylist() for c in batch.columns)) if batch.num_columns else [()] * batch.num_rows)
                out.write(text.getvalue().encode("utf-8"))
                rows += batch.num_rows
        return Part(context.partitionId(), name, rows)

    def commit(self, messages: list) -> None:
        system, target = opened(self.path)
        _, folder = opened(self.staging)
        system.create_dir(folder, recursive=True)
        if "/" in target:
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
        text = io.StringIO(newline="")
        csv.writer(text).writerow(self.names)
        whole = f"{folder}/whole"
        with system.open_output_stream(whole) as out:
            out.write(text.getvalue().encode("utf-8"))
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.number):
                with system.open_input_stream(part.name) as f:
                    while block := f.read(BLOCK):
                        out.write(block)
        system.move(whole, target)
        system.delete_dir(folder)

    def abort(self, messages: list) -> None:
        system, folder = opened(self.staging)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


def write(df: DataFrame, path: str, columns: list[str], index: str = "row_index") -> None:
    """One file in order of a column of whole numbers, with the given columns, CRLF line ends and minimal quoting; missing columns and nulls are empty.

    Each task takes a range of numbers, of equal widths between the least and the greatest, and sorts it; no sample is drawn.
    """
    spark = df.sparkSession
    spark.dataSource.register(ExactCsv)
    cells = [F.coalesce(df[f"`{c}`"].cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in columns]
    # Names given by place: columns may be asked for twice, or be called as the number.
    rows = df.select(df[f"`{index}`"].alias("__index"), *(c.alias(f"__{k}") for k, c in enumerate(cells)))
    least, most = df.agg(F.min(f"`{index}`"), F.max(f"`{index}`")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if least is not None and most > least:
        place = F.coalesce(F.floor((F.col("__index") - least) * parts / (most - least + 1)), F.lit(0)).cast("int")
        rows = rows.repartitionById(parts, place)
    else:
        rows = rows.repartition(1)
    rows = rows.sortWithinPartitions("__index").select(*(f"__{k}" for k in range(len(cells))))
    staging = f"{path}.{uuid.uuid4().hex}.parts"
    rows.write.format("exact_csv").mode("append").options(path=path, staging=staging, columns=json.dumps(columns)).save()
