"""Lines of large files, read by byte ranges, and tables whose rows are lines already.

A large file is never a row.  Its bytes are dealt out in ranges, each a partition of a Python data
source; a line belongs to the range in which it starts.  A task reads the lines of its range and,
beyond both seams, the few that the context needs.  Numbers of lines are prefix sums of what the
ranges hold, which a second reading counts.

In tables of lines the lines of a file are in no order, and a file may have more rows than a
task can hold.  Lines are dealt out in blocks of BLOCK numbers; the lines next to a seam go to both
blocks (the halo), so that `lag` and `lead` within a block are right, with one shuffle and no
large group.  Where rows have no gapless numbers, `numbered` makes them.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as X
from .shared import staged

#: Bytes of a range, bytes read at once, bytes and lines of an Arrow batch.
RANGE_BYTES, READ_BYTES, BATCH_BYTES, BATCH_LINES = 64 << 20, 4 << 20, 4 << 20, 10_000
#: Lines of context on either side; lines of a block.
AROUND, BLOCK = 2, 4096
#: Characters of a file that decide whether it speaks of secrets.
HEAD = 65536


# ---------------------------------------------------------------- byte ranges


class Range(InputPartition):
    def __init__(self, uri: str, path: str, number: int, start: int, end: int):
        self.uri, self.path, self.number, self.start, self.end = uri, path, number, start, end


def lines_from(file, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) from an offset on; \\n, \\r\\n and \\r end lines."""
    file.seek(start)
    held, size = [], 0  # what a line has so far
    while chunk := file.read(READ_BYTES):
        held.append(chunk)
        size += len(chunk)
        if b"\n" not in chunk and b"\r" not in chunk and not (len(held) > 1 and held[-2].endswith(b"\r")):
            continue
        parts = b"".join(held).splitlines(keepends=True)
        # what has no end, or a \r that a \n may follow, waits for more
        held, size = ([parts.pop()] if not parts[-1].endswith(b"\n") else []), 0
        for part in parts:
            yield start, part.rstrip(b"\r\n")
            start += len(part)
    for part in b"".join(held).splitlines(keepends=True):
        yield start, part.rstrip(b"\r\n")
        start += len(part)


def first_start(file, at: int) -> int | None:
    """Where the first line begins that begins at `at` or later; None if there is none."""
    if not at:
        return 0
    begun = lines_from(file, at - 1)
    next(begun, None)
    found = next(begun, None)
    return found[0] if found else None


def lines_before(file, at: int, n: int = AROUND) -> list[bytes]:
    """The last n lines that end before the line that begins at `at`."""
    back = 1 << 16
    while True:
        low = max(0, at - back)
        file.seek(low)
        lines = file.read(at - low).splitlines()
        if low == 0 or len(lines) > n:
            return (lines if low == 0 else lines[1:])[-n:]
        back *= 4


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.each = json.loads(options["files"]), int(options.get("rangeBytes", RANGE_BYTES))
        self.counting = options.get("mode") == "count"

    def partitions(self) -> list[Range]:
        return [Range(uri, path, i, at, min(at + self.each, size)) for uri, path, size in self.files for i, at in enumerate(range(0, size, self.each))]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if part is None:  # what Spark asks for where there are no ranges
            return
        system, inner = fs.FileSystem.from_uri(part.uri)
        with system.open_input_file(inner) as file:
            start = first_start(file, part.start)
            inside = start is not None and start < part.end
            if self.counting:
                n = 0
                for at, _ in lines_from(file, start) if inside else ():
                    if at >= part.end:
                        break
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([part.number], pa.int32()), pa.array([n], pa.int64())], names=["file", "range", "n"])
            elif inside:
                file.seek(0)
                head = file.read(4 * HEAD).decode("utf-8", "replace")[:HEAD]
                yield from self._batches(part, file, start, bool(re.search(X.SECRET_CONTEXT, head)))

    def _batches(self, part: Range, file, start: int, spoken: bool) -> Iterator[pa.RecordBatch]:
        near: deque[bytes] = deque(lines_before(file, start), maxlen=AROUND)
        ahead: deque[tuple[int, bytes]] = deque()
        more, rows, size, number = lines_from(file, start), [], 0, 0

        def batch() -> pa.RecordBatch:
            at, line, before, after = zip(*rows, strict=True)
            n = len(rows)
            columns = [pa.array([part.path] * n), pa.array([part.number] * n, pa.int32()), pa.array(at, pa.int64()), *(pa.array(x, pa.binary()) for x in (line, before, after)), pa.array([spoken] * n)]
            return pa.RecordBatch.from_arrays(columns, names=["file", "range", "at", "content", "before", "after", "spoken"])

        while True:
            while len(ahead) <= AROUND and (found := next(more, None)) is not None:
                ahead.append(found)
            if not ahead or ahead[0][0] >= part.end:
                break
            line = ahead.popleft()[1]
            rows.append((number, line, b"\n".join(near), b"\n".join(x for _, x in ahead)))
            size += sum(map(len, rows[-1][1:]))
            number += 1
            near.append(line)
            if size >= BATCH_BYTES or len(rows) >= BATCH_LINES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class LineSource(DataSource):
    """Options: files, a JSON list of (uri, path, bytes); rangeBytes; mode, "count" for the number of lines of each range."""

    @classmethod
    def name(cls) -> str:
        return "sift_lines"

    def schema(self) -> str:
        if self.options.get("mode") == "count":
            return "file string, range int, n long"
        return "file string, range int, at long, content binary, before binary, after binary, spoken boolean"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)


def large_file_lines(spark: SparkSession, files: list[tuple[str, str, int]], range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Lines (file, range, at, line_text, context_before, context_after, spoken) of files (uri, path, bytes), where `at`
    counts within a range, and (file, range, before): how many lines the ranges before have."""
    spark.dataSource.register(LineSource)
    read = spark.read.format("sift_lines").option("files", json.dumps(files)).option("rangeBytes", str(range_bytes))
    text = lambda c: F.make_valid_utf8(F.col(c).cast("string"))
    lines = read.load().select("file", "range", "at", text("content").alias("line_text"), text("before").alias("context_before"), text("after").alias("context_after"), "spoken")
    counts = spark.read.format("sift_lines").option("files", json.dumps(files)).option("rangeBytes", str(range_bytes)).option("mode", "count").load()
    before = F.sum("n").over(Window.partitionBy("file").orderBy("range")) - F.col("n")
    return lines, counts.select("file", "range", before.alias("before"))


# ---------------------------------------------------------------- tables of lines


def numbered(rows: DataFrame, key: str, order: list[str], out: str = "line") -> DataFrame:
    """Rows with their place from 1 within the key, by the order columns; ties in any order.

    Rows are dealt out by ranges of key and order, so that a key of any size is in many tasks, and counted in two steps."""
    tasks = max(2, rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = staged(rows.repartitionByRange(tasks, key, *order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__own")).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy("__key").orderBy("__own")) - F.col("__n")).drop("__n")
    placed = ranged.withColumn("__row", F.row_number().over(Window.partitionBy(key, "__part").orderBy(*order)))
    joined = placed.join(before, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__own")))
    return joined.withColumn(out, (F.col("__before") + F.col("__row")).cast("long")).drop("__part", "__key", "__own", "__before", "__row")


def with_numbers(rows: DataFrame, key: str, order: list[str], out: str = "line") -> DataFrame:
    """As `numbered`, for wide rows that key and order columns tell apart: only these are dealt out and counted, and the
    rows meet their numbers in one shuffle."""
    numbers = numbered(rows.select(key, *order), key, order, out).select(out, *[F.col(c).alias(f"__{i}") for i, c in enumerate([key, *order])])
    met = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate([key, *order])]
    return rows.drop(out).join(numbers, met).drop(*[f"__{i}" for i in range(len(order) + 1)])


def with_line_context(rows: DataFrame, file: str = "file", line: str = "line", text: str = "line_text", block: int = BLOCK) -> DataFrame:
    """Rows with context_before and context_after: up to AROUND lines on both sides, joined by line ends.

    Lines are numbered from 1 (or any number) without gaps; `numbered` makes such numbers.  Null texts count as empty
    lines.  Each number stands once in a file."""
    # the number's block, and that of the neighbour at whose seam it lies
    n = F.col(line)
    own = F.floor(n / block)
    seam = F.when(n % block < AROUND, own - 1).when(n % block >= block - AROUND, own + 1)
    rows = rows.drop("context_before", "context_after")
    dealt = rows.withColumn("__block", F.explode(F.array_compact(F.array(own, seam)))).withColumn("__halo", F.col("__block") != own)
    place = Window.partitionBy(file, "__block").orderBy(line)

    def near(steps: list[int]) -> Column:
        value = F.coalesce(F.col(text), F.lit(""))
        return F.concat_ws("\n", *[F.lag(value, k).over(place) for k in steps])

    out = dealt.withColumn("context_before", near(list(range(AROUND, 0, -1)))).withColumn("context_after", near([-k for k in range(1, AROUND + 1)]))
    return out.where(~F.col("__halo")).drop("__block", "__halo")
