"""Terminated lines of growing files, read by byte ranges: a file of any size in many tasks, from where the last pass ended.

A range owns the lines that begin in it and reads on to the end of the last of them, so no line is read by two tasks. Line numbers
are the places in a range and the numbers of lines of the ranges before. What follows the last line end isn't taken:
the file's ack is the byte after it, and the next pass begins there. Ranges are rows that Spark deals out; tasks open
files by Arrow's file systems, by the scheme of the path.
"""

from __future__ import annotations

from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialogmill.sources.staging import staged

#: Bytes of a range, of one read, and of lines that are given out together.
RANGE, READ, OUT = 64 << 20, 4 << 20, 8 << 20
#: Tasks at most; more ranges than that go to them in turn.
TASKS = 100_000
STATE = "path string, ack bigint, lines bigint"


def byte_ranges(listing: DataFrame, state: DataFrame | None = None, size: int = RANGE) -> DataFrame:
    """(path, low, high, ack, lines) of a listing (path, size) and a state (path, ack, lines) of the last pass.

    A file without a state, or one that has become shorter than its ack, is read from its beginning.
    """
    known = listing.select("path", "size")
    if state is None:
        known = known.withColumns({"ack": F.lit(0).cast("bigint"), "lines": F.lit(0).cast("bigint")})
    else:
        known = known.join(state.select("path", "ack", "lines"), "path", "left")
        fits = F.coalesce(F.col("ack") <= F.col("size"), F.lit(False))
        known = known.withColumns({"lines": F.when(fits, F.col("lines")).otherwise(F.lit(0)), "ack": F.when(fits, F.col("ack")).otherwise(F.lit(0))})
    lows = known.where("size > ack").withColumn("low", F.explode(F.sequence("ack", F.col("size") - 1, F.lit(size).cast("bigint"))))
    return lows.select("path", "low", F.least(F.col("low") + size, "size").alias("high"), "ack", "lines")


def _owned(file, low: int, high: int, first: bool):
    """(begin, line without its end) of the terminated lines that begin in [low, high); first: a line begins at low."""
    begin = low if first else low - 1  # a line begins at low if the byte before it ends one
    file.seek(begin)
    skipping, parts = not first, []
    while begin < high:
        data = file.read(READ)
        if not data:
            return
        *ended, rest = data.split(b"\n")
        for piece in ended:
            line = b"".join([*parts, piece]) if parts else piece
            if not skipping:
                yield begin, line
            begin, skipping, parts = begin + len(line) + 1, False, []
            if begin >= high:
                return
        if skipping:
            begin += len(rest)
        elif rest:
            parts.append(rest)


def located(path: str):
    """The file system of a path, and the path in it; names of local files are taken as they are."""
    import pyarrow.fs as fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@?=&%+"))


def owned_lines(path: str, low: int, high: int, first: bool):
    """The lines of a file that begin in [low, high), as in _owned."""
    files, inner = located(path)
    with files.open_input_file(inner) as file:
        yield from _owned(file, low, high, first)


def read_ranges(ranges: DataFrame) -> DataFrame:
    """(path, low, n, begin, bytes, line) of byte_ranges: n is the line's place in its range, bytes its length with the line end."""

    def run(batches):
        names = ["path", "low", "n", "begin", "bytes", "line"]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            for row in batch.to_pylist():
                path, low = row["path"], row["low"]
                out, held, n = [], 0, 0

                def rows(out):
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([path] * len(out), [low] * len(out), *zip(*out)), kinds)], names=names)

                for begin, line in owned_lines(path, low, row["high"], low == row["ack"]):
                    out.append((n, begin, len(line) + 1, line.decode("utf-8", "replace")))
                    n, held = n + 1, held + len(line)
                    if held >= OUT:
                        yield rows(out)
                        out, held = [], 0
                if out:
                    yield rows(out)

    # a task for each range; their rows are so small that Spark would put them together if it weren't told a number
    n = min(max(ranges.count(), 1), TASKS)
    dealt = ranges.select("path", "low", "high", "ack").repartition(n)
    return dealt.mapInArrow(run, "path string, low bigint, n bigint, begin bigint, bytes bigint, line string")


def new_lines(listing: DataFrame, state: DataFrame | None = None, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Lines (path, line_no, line, begin) after the state's acks, and the state after this pass (path, ack, lines).

    line_no counts from 1 over all passes. The lines are written once; their numbers come from sums over the ranges.
    A file without a new line keeps its state, one that has vanished leaves it. Spark lists no empty files.
    """
    listing = staged(listing.select("path", "size"), "listing")  # files may grow while they are read
    ranges = staged(byte_ranges(listing, state, size), "ranges")
    found = staged(read_ranges(ranges), "range-lines")
    counts = found.groupBy("path", "low").agg(F.count("*").alias("here"), F.sum("bytes").alias("bytes"))
    before = F.sum("here").over(W.partitionBy("path").orderBy("low").rowsBetween(W.unboundedPreceding, -1))  # a row for each range
    starts = ranges.select("path", "low", "ack", "lines").join(counts, ["path", "low"]).withColumn("base", F.col("lines") + F.coalesce(before, F.lit(0)))
    lines = found.join(starts.select("path", "low", "base"), ["path", "low"]).select("path", (F.col("base") + F.col("n") + 1).alias("line_no"), "line", "begin")
    moved = starts.groupBy("path").agg((F.min("ack") + F.sum("bytes")).alias("ack"), (F.min("lines") + F.sum("here")).alias("lines"))
    kept = ranges.groupBy("path").agg(F.min("ack").alias("old_ack"), F.min("lines").alias("old_lines"))
    state_now = listing.select("path").join(moved, "path", "left").join(kept, "path", "left")
    if state is not None:
        state_now = state_now.join(state.select("path", F.col("ack").alias("last_ack"), F.col("lines").alias("last_lines")), "path", "left")
    else:
        state_now = state_now.withColumns({"last_ack": F.lit(None).cast("bigint"), "last_lines": F.lit(None).cast("bigint")})
    now = lambda c: F.coalesce(c, f"old_{c}", f"last_{c}", F.lit(0).cast("bigint")).alias(c)
    return lines, staged(state_now.select("path", now("ack"), now("lines")), "acks")
