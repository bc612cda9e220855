"""Running a streaming frame to the end of what its source holds.

Sinks are Parquet tables in the shared folder, never the driver's memory.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.windows import keep_last
from ..sources.scratch import scratch_dir


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, name: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    """File stream over a folder; `name` picks files by glob."""
    reader = spark.readStream.schema(schema)
    if name:
        reader = reader.option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def _paths(spark: SparkSession, name: str, out: str | None, checkpoint: str | None) -> tuple[str, str]:
    """Output and checkpoint of a job. A job that is to resume gets both; fresh ones are for a run of its own."""
    if (out is None) != (checkpoint is None):
        raise ValueError("give both paths, or none for a run that will not be resumed")
    return out or scratch_dir(spark, name), checkpoint or scratch_dir(spark, f"{name}-ckpt")


def drain_append(stream: DataFrame, name: str, out: str | None = None, checkpoint: str | None = None) -> tuple[DataFrame, StreamingQuery]:
    """Append mode into a Parquet table; (table, finished query). With the same paths the next run goes on where this one ended."""
    spark = stream.sparkSession
    out, checkpoint = _paths(spark, name, out, checkpoint)
    q = (
        stream.writeStream.outputMode("append").format("parquet").trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).option("path", out).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), q


def drain_update(stream: DataFrame, keys: list[str], name: str, out: str | None = None, checkpoint: str | None = None,
                 once: bool = False) -> DataFrame:
    """Update mode: every batch is written with its id, the last one per key counts.

    A batch that is tried again overwrites its own folder, so replays add nothing. once: a batch has a key
    once, so that nothing is to be chosen where there is one batch.
    """
    spark = stream.sparkSession
    out, checkpoint = _paths(spark, name, out, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (
        stream.writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).start()
    )
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(out)
    if once:
        fs, path = _hadoop(spark, out)
        if sum(f.getPath().getName().startswith("batch=") for f in fs.listStatus(path)) == 1:
            return rows.drop("batch")
    return keep_last(rows, keys, ["batch"]).drop("batch")


def stored_table(spark: SparkSession, out: str) -> DataFrame | None:
    """What a job has written so far, with its batch numbers; None before the first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not any(f.isDirectory() and f.getPath().getName().startswith("batch=") for f in fs.listStatus(path)):
        return None
    return spark.read.parquet(out).withColumn("batch", F.col("batch").cast("long"))


def run_daily(stream: DataFrame, stages: list[Callable[[DataFrame, DataFrame | None], DataFrame]], name: str = "daily",
              out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Ingest job: each micro-batch goes through the stages and is written under its id.

    A stage takes the batch and what earlier batches have stored (None at first), so
    rules that look back, like the last accepted close, see the history. A batch
    that is tried again sees only the batches before it and replaces its own folder.
    An empty source gives an empty table.
    """
    spark = stream.sparkSession
    out, checkpoint = _paths(spark, name, out, checkpoint)

    def staged(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
        for stage in stages:
            batch = stage(batch, stored)
        return batch

    def write(batch: DataFrame, batch_id: int) -> None:
        stored = stored_table(spark, out)
        if stored is not None:
            stored = stored.where(F.col("batch") < batch_id)
        staged(batch, stored).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    q.awaitTermination()
    stored = stored_table(spark, out)
    if stored is None:
        empty = spark.createDataFrame([], stream.schema)
        return staged(empty, None).withColumn("batch", F.lit(0).cast("long"))
    return stored


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def committed_batches(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the batches of which all tables are written."""
    fs, path = _hadoop(spark, f"{out}/_commits")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []


def committed_table(spark: SparkSession, out: str, name: str, before: int | None = None) -> DataFrame | None:
    """One table of a daily job with its batch numbers: whole batches only, all or those before one; None if there are none."""
    ids = [i for i in committed_batches(spark, out) if before is None or i < before]
    if not ids:
        return None
    found = spark.read.option("basePath", f"{out}/{name}").parquet(*[f"{out}/{name}/batch={i}" for i in ids])
    return found.withColumn("batch", F.col("batch").cast("long"))


class Day:
    """What a stage of a daily job sees: the tables of its batch so far, and those of earlier batches."""

    def __init__(self, spark: SparkSession, out: str, batch_id: int, incoming: DataFrame):
        self.spark, self.out, self.batch_id, self.tables = spark, out, batch_id, {"incoming": incoming}

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def before(self, name: str) -> DataFrame | None:
        return committed_table(self.spark, self.out, name, self.batch_id)

    def so_far(self, name: str) -> DataFrame:
        """Earlier batches and this one."""
        old = self.before(name)
        return self[name] if old is None else old.drop("batch").unionByName(self[name])


def run_daily_tables(stream: DataFrame, stages: dict[str, Callable[[Day], DataFrame]], out: str, checkpoint: str) -> list[int]:
    """Daily job of several stages, each with a table of its own at `out`/name; the committed batches.

    Stages run in order; one reads the batch, the tables of the stages before it and those of
    earlier batches. The tables of a batch become visible together, when a marker with its number is
    written last. A batch that is tried again goes on behind the last stage whose table is
    whole, and a table that was broken off is written anew, so no row is repeated.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        day = Day(batch.sparkSession, out, batch_id, batch)
        for name, stage in stages.items():
            path = f"{out}/{name}/batch={batch_id}"
            fs, whole = _hadoop(spark, f"{path}/_SUCCESS")
            if not fs.exists(whole):
                stage(day).write.mode("overwrite").parquet(path)
            day.tables[name] = batch.sparkSession.read.parquet(path)
        fs, marker = _hadoop(spark, f"{out}/_commits/{batch_id}")
        fs.create(marker, True).close()

    q = stream.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    q.awaitTermination()
    return committed_batches(spark, out)


class ProgressLog(StreamingQueryListener):
    """Keeps the counters of every micro-batch of the queries that it hears of.

    A query itself remembers its last batches only. Three numbers per batch are kept, so a run of any length fits.
    """

    def __init__(self):
        self.rows: dict[tuple[str, int], tuple[int, int]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        self.rows[(str(p.runId), p.batchId)] = (p.numInputRows, late)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.add(str(event.runId))

    def table(self, spark: SparkSession, query: StreamingQuery, wait_s: float = 30.0) -> DataFrame:
        """batch, input_rows, late_rows of a query that has ended; its last events are waited for."""
        run, until = str(query.runId), time.time() + wait_s
        while run not in self.ended and time.time() < until:
            time.sleep(0.05)
        rows = [(batch, n, late) for (r, batch), (n, late) in sorted(self.rows.items()) if r == run]
        return spark.createDataFrame(rows, "batch long, input_rows long, late_rows long")


@contextmanager
def logged_progress(spark: SparkSession):
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        yield log
    finally:
        spark.streams.removeListener(log)
