"""The task-event log: parsing, monotone progress and terminal states, as a stream and in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from framelake.schemas import TASK_EVENT
from framelake.session import ship_package

STEP, TOTAL, DONE_FRAMES, CACHED = r"^\[step (\d+)/(\d+)\]", r"^(\S+): (\d+) frames$", r"^(\S+): frame (\d+)/", r"^(\S+): cached$"


def read_log(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """Line-delimited JSON events; a batch read fails on a corrupt line, a stream follows new files."""
    reader = (spark.readStream if stream else spark.read).schema(TASK_EVENT)
    return reader.json(path) if stream else reader.option("mode", "FAILFAST").json(path)


def append_log(events: DataFrame, path: str, checkpoint: str):
    """Starts the append-only sink of a stream of events."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def step_of(line: Column) -> Column:
    """(index, total) of a step boundary, null for other lines."""
    index, total = F.regexp_extract(line, STEP, 1), F.regexp_extract(line, STEP, 2)
    return F.when(line.rlike(STEP), F.struct(index.cast("int").alias("index"), total.cast("int").alias("total")))


def step_progress(events: DataFrame, *, task: str, order: list[str], boundary: Column, total: Column) -> DataFrame:
    """Every event with its task's step counter and progress, at most 1; null without a positive total."""
    w = Window.partitionBy(task).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("step", F.sum(boundary.cast("int")).over(w))
    return rows.withColumn("progress", F.when(total > 0, F.round(F.least(F.col("step") / total, F.lit(1.0)), 6)))


def running_best(events: DataFrame, *, task: str, order: list[str], value: str, name: str = "best") -> DataFrame:
    """A value that never falls: the largest so far."""
    return events.withColumn(name, F.max(value).over(Window.partitionBy(task).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def terminal_states(events: DataFrame, *, task: str, order: str, kind: str, line: str, tail: int = 20) -> DataFrame:
    """(task, state, n, tail): done, failed, cancelled or running by the last decisive event; failures keep last lines."""
    w = Window.partitionBy(task).orderBy(F.desc(order))
    rows = events.withColumn("__k", F.row_number().over(w))
    decisive = F.max(F.when(F.col(kind).isin("done", "failed", "cancelled"), F.struct(order, kind)))
    out = rows.groupBy(task).agg(decisive.alias("__d"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("__k") <= tail, F.struct(F.col(order).alias("o"), F.col(line).alias("l"))))).alias("__t"))
    state = F.coalesce(F.col(f"__d.{kind}"), F.lit("running"))
    return out.select(task, state.alias("state"), "n", F.when(state == "failed", F.concat_ws("|", F.transform("__t", lambda x: x["l"]))).alias("tail"))


class Progress(StatefulProcessor):
    """Overall progress of a task's files: totals are registered, files finish when cached or passed, and the percentage
    emitted never falls."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        row = T.StructType([T.StructField("total", T.LongType()), T.StructField("done", T.LongType())])
        self.files = handle.getMapState("files", T.StructType([T.StructField("fid", T.StringType())]), row)
        self.best = handle.getValueState("best", T.StructType([T.StructField("percent", T.DoubleType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            best = self.best.get()[0] if self.best.exists() else 0.0
            for r in pdf.sort_values("ts").itertuples():
                had = self.files.getValue((r.fid,)) if self.files.containsKey((r.fid,)) else (0, 0)
                total = int(r.total) if pd.notna(r.total) and r.total > 0 else had[0]
                done = total if r.kind == "cached" else max(had[1], int(r.done) if pd.notna(r.done) else 0)
                self.files.updateValue((r.fid,), (total, min(done, total)))
            sums = [tuple(v) for _, v in self.files.iterator()]
            whole = sum(t for t, _ in sums)
            best = max(best, 100.0 * sum(d for _, d in sums) / whole if whole else 0.0)
            self.best.update((best,))
            yield pd.DataFrame([(key[0], best)], columns=["task_id", "percent"])

    def close(self) -> None:
        pass


def progress_stream(lines: DataFrame) -> DataFrame:
    """(task_id, percent) after every micro-batch of parsed lines (task_id, ts, fid, kind, total, done).

    The session needs the RocksDB state store provider.
    """
    ship_package(lines.sparkSession)
    return lines.groupBy("task_id").transformWithStateInPandas(Progress(), "task_id string, percent double", "Append", "None")


def parsed_lines(events: DataFrame) -> DataFrame:
    """Log lines that speak of frames as (task_id, ts, fid, kind, total, done)."""
    line = F.col("line")
    part = lambda pattern, k: F.regexp_extract(line, pattern, k)
    kind = F.when(line.rlike(TOTAL), "total").when(line.rlike(DONE_FRAMES), "done").when(line.rlike(CACHED), "cached")
    fid = F.regexp_extract(line, r"^(\S+):", 1)
    return events.select("task_id", "ts", fid.alias("fid"), kind.alias("kind"), F.when(kind == "total", part(TOTAL, 2).cast("long")).alias("total"), F.when(kind == "done", part(DONE_FRAMES, 2).cast("long")).alias("done")).where("kind IS NOT NULL")
