"""Streaming: import, indexing, stable files and overdue jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from callgrain.operators.index import fold_changes, upsert_calls
from callgrain.operators.ingest import dedupe_first
from callgrain.sources.recordings import hash_files

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_import(spark: SparkSession, folder: str, table: str, pattern: str = "*", compact_every: int = 16) -> DataStreamWriter:
    """foreachBatch sink that imports the files of a folder as they arrive: one row per content hash, kept in the folder `table`.

    A micro-batch lists its new files, hashes them in the executors a chunk at a time,
    keeps the first path of each hash, and drops hashes that the table has. So the stream
    itself holds no state; what is known of older contents is the table. read_new gives
    it: path, modificationTime, length, sha256.
    """
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern).load(folder)
    return stream_new(files.select("path", "modificationTime", "length"), table, "sha256", ("path",), compact_every, hash_files)


def first_by_content(stream: DataFrame, content: str, time: str | None = None, delay: str | None = None) -> DataFrame:
    """One row per content hash over the stream's life; its state grows with distinct contents, 32 bytes of key each.

    With a column of event times and a delay, one row per hash within the delay: state
    older than that goes. stream_new then keeps repeats that come later out.
    """
    hashed = stream.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)).drop(content)
    return hashed.dropDuplicates(["sha256"]) if time is None else hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["sha256"])


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete batches under a folder."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName()[6:]) for p in found if files.exists(p.suffix("/_SUCCESS")))


def _drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _publish(table: DataFrame, folder: str, batch_id: int) -> None:
    """Write a version under a name of its own, then give it its name. One that is there already stays: it has the same rows."""
    spark = table.sparkSession
    new = f"{folder}/.new-{uuid.uuid4().hex}"
    table.write.parquet(new)
    if batch_id in _batches(spark, folder):
        return _drop(spark, new)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={batch_id}")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(target, True)  # what an earlier attempt left unfinished
    if not files.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new), target):
        raise OSError(f"could not publish batch {batch_id} in {folder}")


def _clean(spark: SparkSession, folder: str) -> None:
    """Delete what the base before the newest replaced: readers of the newest two bases keep their files."""
    bases = _batches(spark, f"{folder}/base")
    if len(bases) < 2:
        return
    for part in ("base", "changes"):
        for n in _batches(spark, f"{folder}/{part}"):
            if n < bases[-2] or n == bases[-2] and part == "changes":
                _drop(spark, f"{folder}/{part}/batch={n}")


def _versions(spark: SparkSession, folder: str, schema: StructType, upto: int | None = None) -> DataFrame | None:
    """The newest base and the changes after it, with their batch numbers; those up to a batch, if one is given."""
    fits = lambda n: upto is None or n <= upto
    base = max(filter(fits, _batches(spark, f"{folder}/base")), default=-1)
    paths = [(base, f"{folder}/base/batch={base}")] if base >= 0 else []
    paths += [(n, f"{folder}/changes/batch={n}") for n in _batches(spark, f"{folder}/changes") if n > base and fits(n)]
    parts = [spark.read.schema(schema).parquet(p).withColumn("_batch", F.lit(n)) for n, p in paths]
    return reduce(DataFrame.unionByName, parts) if parts else None


def read_index(spark: SparkSession, folder: str, schema: StructType, upto: int | None = None) -> DataFrame:
    """The index that stream_index keeps in a folder: a row per call."""
    every = _versions(spark, folder, schema, upto)
    return spark.createDataFrame([], schema) if every is None else fold_changes(every, F.col("_batch")).drop("_batch")


def read_replaced(spark: SparkSession, folder: str, schema: StructType, upto: int | None = None) -> DataFrame:
    """The table that stream_replace keeps in a folder: of each call the rows of its last batch."""
    every = _versions(spark, folder, schema, upto)
    if every is None:
        return spark.createDataFrame([], schema)
    last = every.groupBy("call_id").agg(F.max("_batch").alias("_batch"))
    return every.join(last, ["call_id", "_batch"], "left_semi").select(*schema.names)


def _keep(changes: DataFrame, folder: str, compact_every: int, reduced: Callable, read: Callable, schema: StructType | None = None) -> DataStreamWriter:
    """Keep a table as versions: the newest complete base is the pointer to what holds, and changes after it come on top.

    A version is written whole under another name before it gets its own, and is never
    overwritten; what it replaces is deleted one compaction later. So a batch may be
    repeated after a crash at any point, with the same table as its outcome, and a reader
    that has listed its versions can finish while a compaction goes on.
    """
    schema = schema or changes.schema

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id <= max(_batches(spark, f"{folder}/base"), default=-1):
            return _clean(spark, folder)  # a base holds this batch already
        if batch_id not in _batches(spark, f"{folder}/changes"):
            _publish(reduced(batch, batch_id), f"{folder}/changes", batch_id)
        if (batch_id + 1) % compact_every == 0:
            _publish(read(spark, folder, schema, batch_id), f"{folder}/base", batch_id)
            _clean(spark, folder)

    return changes.writeStream.foreachBatch(apply)


def read_new(spark: SparkSession, folder: str, schema: StructType, upto: int | None = None) -> DataFrame:
    """The table that stream_new keeps in a folder: every row that was new in its batch."""
    every = _versions(spark, folder, schema, upto)
    return spark.createDataFrame([], schema) if every is None else every.drop("_batch")


def stream_new(rows: DataFrame, folder: str, key: str, order: tuple[str, ...], compact_every: int = 16, prepare: Callable | None = None) -> DataStreamWriter:
    """foreachBatch sink that keeps the first row of each key: by batch, and in a batch by the columns `order`. read_new gives the table.

    prepare, if given, is applied to each batch first and may add the key. A batch reads
    the key column of the table, no more.
    """
    prepare = prepare or (lambda b: b)
    schema = prepare(rows.sparkSession.createDataFrame([], rows.schema)).schema

    def fresh(batch: DataFrame, batch_id: int) -> DataFrame:
        known = read_new(batch.sparkSession, folder, schema, batch_id - 1).select(key)
        return dedupe_first(prepare(batch), key, *order).join(known, key, "left_anti").select(*schema.names)

    return _keep(rows, folder, compact_every, fresh, read_new, schema)


def stream_index(changes: DataFrame, folder: str, order: str | None = None, compact_every: int = 16) -> DataStreamWriter:
    """foreachBatch sink that upserts index rows; read_index gives the table.

    A batch writes its own changes only, one row per call (several are applied in order
    of the column `order`); a repeated batch changes nothing. Every `compact_every` batches
    the table is written whole as a new base, and what the base before it replaced is
    deleted: bytes written per batch follow the batch, and few files stay.
    """
    none = changes.sparkSession.createDataFrame([], changes.schema)
    return _keep(changes, folder, compact_every, lambda b, _: upsert_calls(none, b, order), read_index)


def stream_replace(changes: DataFrame, folder: str, compact_every: int = 16) -> DataStreamWriter:
    """As stream_index, for tables in which a call has many rows; read_replaced gives the table."""
    return _keep(changes, folder, compact_every, lambda b, _: b, read_replaced)


def stream_stale_jobs(started: DataFrame, finished: DataFrame, threshold: str = "300 seconds", delay: str = "60 seconds") -> DataFrame:
    """Starts (call_id, stage, started_at) without a finish (call_id, stage, finished_at) within the threshold, once both watermarks have passed it."""
    s = started.withWatermark("started_at", delay).alias("s")
    f = finished.withWatermark("finished_at", delay).alias("f")
    near = F.expr(f"s.call_id = f.call_id AND s.stage = f.stage AND f.finished_at BETWEEN s.started_at AND s.started_at + INTERVAL {threshold}")
    return s.join(f, near, "left_outer").where("f.finished_at IS NULL").select("s.call_id", "s.stage", "s.started_at")


STABLE = "path string, length bigint, mtime timestamp"


def stream_stable_files(observations: DataFrame, window_s: int = 20, poll_s: int = 5, delay: str = "60 seconds", forget: str = "1 hour") -> DataFrame:
    """From observations(path, length, mtime, observed_at) of files: each path once, when its last observations, as many
    as fit the window, agree in size and time.

    State is a row per path: what was seen last, and how often in a row. A timer drops
    it once the watermark, `delay` behind the latest observation, is `forget` past the
    path's last one; a path that is
    observed again after that is new. Observations of one batch count in order of time,
    repeats of one moment once; those with a null path, size or time never agree.
    """
    needed = max(2, window_s // max(poll_s, 1))

    def settle(key, frames: Iterator, state):  # type: ignore[no-untyped-def]
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        length, mtime, seen, done = state.get if state.exists else (None, None, 0, False)
        rows = pd.concat(list(frames)).drop_duplicates().sort_values("observed_at")
        out = []
        for r in rows.itertuples():
            same = seen > 0 and r.length == length and r.moment == mtime
            length, mtime, seen = int(r.length), int(r.moment), min(needed, seen + 1) if same else 1
            if seen >= needed and not done:
                done = True
                out.append((key[0], length, r.mtime))
        state.update((length, mtime, seen, done))
        state.setTimeoutTimestamp(max(int(rows["observed_at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + forget_ms)
        yield pd.DataFrame(out, columns=["path", "length", "mtime"])

    spark = observations.sparkSession
    forget_ms = int(spark.sql(f"SELECT CAST(INTERVAL {forget} AS INTERVAL DAY TO SECOND) AS i").first()["i"].total_seconds() * 1000)
    seen = observations.where("path is not null and length is not null and mtime is not null and observed_at is not null")
    seen = seen.select("path", "length", F.col("mtime").cast("timestamp").alias("mtime"), F.unix_micros(F.col("mtime").cast("timestamp")).alias("moment"), F.col("observed_at").cast("timestamp").alias("observed_at"))
    return seen.withWatermark("observed_at", delay).groupBy("path").applyInPandasWithState(settle, STABLE, "length bigint, mtime bigint, seen int, done boolean", "append", "EventTimeTimeout")
