"""Session files as a stream: lines that are appended to any file of a growing folder, to events that are upserted.

* The source's offset is the ack of each file, the byte after its last line end, so a file that grows gives its new lines only.
  Files are read by byte ranges, as in sources.ranges.
* The state of a file is its number of lines, its calls that no result has closed yet, and the stack of those that are
  open for a shell run. From it each new line gets its number, and each result or run the call that it belongs to; a run
  that a late result displaces is taken back. State grows with open calls, not with lines.
* What comes out is lines and proofs (which line proves which call), kept in tables by batch, so a batch that is run again after
  a failure replaces its own rows. Events that a batch touches are built anew from these tables, by the functions of the batch
  job, and upserted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor

from dialogmill.sources import jsonl
from dialogmill.sources.archive import write_events
from dialogmill.sources.ranges import RANGE, owned_lines

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TAIL = 1 << 16


@dataclass
class Bytes(InputPartition):
    path: str
    low: int
    high: int
    first: bool


class LineReader(DataSourceStreamReader):
    """Offsets are {path: ack}; the files that have no line end yet aren't in it."""

    def __init__(self, folder: str, size: int):
        self.folder, self.size, self.known = folder, size, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, inner = pa.fs.FileSystem.from_uri(self.folder)
        found = files.get_file_info(pa.fs.FileSelector(inner, recursive=True, allow_not_found=True))
        scheme = self.folder[: len(self.folder) - len(inner)] if self.folder.endswith(inner) else ""
        wanted = [f for f in found if f.is_file and f.path.endswith(".jsonl") and not re.search(r"/\.[^/]|/subagent-artifacts/", f.path)]
        for f in wanted:
            size, ack = self.known.get(f.path, (-1, 0))
            if size != f.size:
                self.known[f.path] = (f.size, self._ack(files, f.path, f.size, ack))
        return {scheme + path: ack for path, (_, ack) in sorted(self.known.items()) if ack}

    @staticmethod
    def _ack(files, path: str, size: int, low: int) -> int:
        """The byte after the last line end, looked for from the end back to the last ack."""
        with files.open_input_file(path) as file:
            while size > low:
                start = max(low, size - TAIL)
                file.seek(start)
                end = file.read(size - start).rfind(b"\n")
                if end >= 0:
                    return start + end + 1
                size = start
        return low

    def partitions(self, start: dict, end: dict) -> list[Bytes]:
        out = []
        for path, ack in end.items():
            done = start.get(path, 0)
            out += [Bytes(path, low, min(low + self.size, ack), low == done) for low in range(done, ack, self.size)]
        return out or [Bytes("", 0, 0, True)]

    def read(self, partition: Bytes) -> Iterator[tuple]:
        if partition.path:
            for begin, line in owned_lines(partition.path, partition.low, partition.high, partition.first):
                yield partition.path, begin, line.decode("utf-8", "replace")


class SessionLines(DataSource):
    """Appended lines of the session files below a folder (option path); bytes: of a range."""

    @classmethod
    def name(cls) -> str:
        return "session_lines"

    def schema(self) -> str:
        return "path string, begin bigint, line string"

    def streamReader(self, schema) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("bytes", RANGE)))


class Calls(StatefulProcessor):
    """Numbers a file's lines and matches its calls with results and shell runs.

    Out: (kind, path, line_no, k, ref_line, line): a line, or a proof: ref_line proves call k of line_no; null takes a proof back.
    """

    def init(self, handle) -> None:
        self.state = handle.getValueState("file", "value string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else {"lines": 0, "calls": {}, "stack": []}
        calls, stack, out = state["calls"], state["stack"], []
        for line in pd.concat(list(rows)).sort_values("begin")["line"]:
            state["lines"] += 1
            n = state["lines"]
            out.append(("line", key[0], n, None, None, line))
            for at, k, ref in self._step(line, n, calls, stack):
                out.append(("proof", key[0], at, k, ref, None))
        self.state.update((json.dumps(state),))
        frame = pd.DataFrame(out, columns=["kind", "path", "line_no", "k", "ref_line", "line"])
        yield frame.astype({"k": "Int64", "ref_line": "Int64"})

    @staticmethod
    def _step(line: str, n: int, calls: dict, stack: list) -> Iterator[tuple]:
        try:
            row = json.loads(line)
        except ValueError:
            return
        message = row.get("message") if isinstance(row, dict) and row.get("type") == "message" else None
        if not isinstance(message, dict):
            return
        role = message.get("role")
        if role == "assistant":
            for k, item in enumerate(message.get("content") or ()):
                if isinstance(item, dict) and item.get("type") == "toolCall" and item.get("id") is not None and item["id"] not in calls:
                    calls[item["id"]] = [n, k, None]
                    if item.get("name") == "bash":
                        stack.append(item["id"])
        elif role == "toolResult" and message.get("toolCallId") in calls:
            at, k, _ = calls.pop(message["toolCallId"])
            if message["toolCallId"] in stack:
                stack.remove(message["toolCallId"])
            yield at, k, n
        elif role == "bashExecution" and stack:
            call = stack.pop()
            calls[call][2] = n
            yield calls[call][0], calls[call][1], n


def _touched_events(spark: SparkSession, base: str, batch: int) -> DataFrame:
    """Events of the messages that a batch has brought or proved, from the tables of all batches."""
    lines, proofs = spark.read.parquet(f"{base}/lines"), spark.read.parquet(f"{base}/proofs")
    fresh = lines.where(F.col("batch") == batch).select("path", "line_no").unionByName(proofs.where(F.col("batch") == batch).select("path", "line_no")).distinct()
    last = W.partitionBy("path", "line_no", "k").orderBy(F.col("batch").desc(), F.col("ref_line").desc())
    now = proofs.join(fresh, ["path", "line_no"], "left_semi").withColumn("n__", F.row_number().over(last)).where("n__ = 1").select("path", "line_no", "k", "ref_line")
    heads = fresh.select("path", F.lit(1).cast("bigint").alias("line_no")).distinct()
    wanted = fresh.unionByName(now.select("path", F.col("ref_line").alias("line_no"))).unionByName(heads).distinct()
    found = lines.join(wanted, ["path", "line_no"], "left_semi").select("path", "line_no", "line")
    msgs = jsonl.messages(found)
    outputs = jsonl.results(msgs).drop("call_id").unionByName(jsonl.bash_runs(msgs)).select("path", F.col("line_no").alias("ref_line"), F.col("id").alias("ref"), "exit_code", "output")
    proved = now.join(outputs, ["path", "ref_line"]).drop("ref_line")
    return jsonl.assembled(msgs.join(fresh, ["path", "line_no"], "left_semi"), proved, jsonl.headers(found))


def stream_sessions(spark: SparkSession, folder: str, base: str, checkpoint: str, size: int = RANGE):
    """Read what has been appended below folder and bring base/events up to date; running it again goes on from there.

    base holds lines and proofs by batch, and the events archive. State is kept in RocksDB, which this kind of
    state needs.
    """
    spark.dataSource.register(SessionLines)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def merge(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        rows = rows.persist()
        mine = [rows.where("kind = 'line'").select("path", "line_no", "line"), rows.where("kind = 'proof'").select("path", "line_no", "k", "ref_line")]
        for part, name in zip(mine, ("lines", "proofs")):
            part.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch}")
        rows.unpersist()
        archive = f"{base}/events"
        hadoop = session.sparkContext._jvm.org.apache.hadoop.fs.Path(archive)
        exists = hadoop.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        write_events(session, _touched_events(session, base, batch), archive, exists)

    lines = spark.readStream.format("session_lines").option("path", folder).option("bytes", size).load()
    out = "kind string, path string, line_no bigint, k int, ref_line bigint, line string"
    found = lines.groupBy("path").transformWithStateInPandas(Calls(), out, "append", "none")
    return found.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
