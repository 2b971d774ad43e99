"""Streams over the given tables, run until the input is used up, and the SQL of what they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from callgrain.plans.fixtures import EVENTS
from callgrain.plans.queries import query
from callgrain.plans.scratch import scratch
from callgrain.streaming import streams


def drain(writer: DataStreamWriter, folder: str) -> None:
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern: the table may be one file


@query("ref_stream_import", "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def stream_import(spark, d):
    """The first document of each content; the stream holds no state of its own."""
    folder = scratch(spark, "stream")
    hashed = lambda b: b.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")
    rows = table_stream(spark, d, "documents").select("doc_id", "text")
    drain(streams.stream_new(rows, f"{folder}/calls", "sha256", ("doc_id",), prepare=hashed), folder)
    return streams.read_new(spark, f"{folder}/calls", hashed(rows).schema).select("sha256", "doc_id")


SEEN = "SELECT concat('/in/', CAST(doc_id AS STRING), '.wav') AS path, n_chars + CASE WHEN doc_id % 5 = 0 THEN i ELSE 0 END AS length, TIMESTAMP'2024-01-01 00:00:00' AS mtime, TIMESTAMP'2024-01-02 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, 5 * i) AS observed_at FROM {docs} LATERAL VIEW explode(sequence(1, 4)) t AS i WHERE doc_id % 7 > 0 OR i < 4"


@query("ref_stream_stable_files", "SELECT concat('/in/', CAST(doc_id AS VARCHAR), '.wav') AS path, n_chars AS length FROM documents WHERE doc_id % 5 > 0 AND doc_id % 7 > 0")
def stream_stable_files(spark, d):
    """Every document as a file that is observed four times; every fifth grows, every seventh is seen three times only."""
    folder = scratch(spark, "stream")
    seen = spark.sql(SEEN, docs=table_stream(spark, d, "documents").select("doc_id", "n_chars"))
    stable = streams.stream_stable_files(seen)
    drain(stable.writeStream.format("parquet").option("path", f"{folder}/out"), folder)
    return spark.read.parquet(f"{folder}/out").select("path", "length")


@query("ref_stream_index", "SELECT doc_id AS call_id, sha256(text) AS sha256, 1 AS imported_at, CAST(n_chars AS INTEGER) AS recorded_at FROM documents")
def stream_index(spark, d):
    folder = scratch(spark, "stream")
    docs = table_stream(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("call_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.lit(1).alias("imported_at"), F.col("n_chars").cast("int").alias("recorded_at"))
    drain(streams.stream_index(rows, f"{folder}/index"), folder)
    return streams.read_index(spark, f"{folder}/index", rows.schema)


OVERDUE = """SELECT s.call_id, s.stage, strftime(s."at", '%Y-%m-%d %H:%M:%S') AS started_at FROM ev s
WHERE s.event = 'started' AND s."at" + INTERVAL 3600 SECOND < (SELECT least(max("at") FILTER (WHERE event = 'started'), max("at") FILTER (WHERE event = 'finished')) - INTERVAL 60 SECOND FROM ev)
AND NOT EXISTS (SELECT 1 FROM ev f WHERE f.event = 'finished' AND f.call_id = s.call_id AND f.stage = s.stage AND f."at" BETWEEN s."at" AND s."at" + INTERVAL 3600 SECOND)"""


@query("ref_stream_stale_jobs", OVERDUE, "ev")
def stream_stale_jobs(spark, d):
    folder = scratch(spark, "stream")

    def ended(event: str, name: str) -> DataFrame:
        e = spark.sql(EVENTS.replace("FROM events", "FROM {events}"), events=table_stream(spark, d, "events"))
        return e.where(F.col("event") == event).select("call_id", "stage", F.col("at").cast("timestamp").alias(name))

    late = streams.stream_stale_jobs(ended("started", "started_at"), ended("finished", "finished_at"), "3600 seconds")
    drain(late.writeStream.format("parquet").option("path", f"{folder}/out"), folder)
    out = spark.read.parquet(f"{folder}/out")
    return out.select("call_id", "stage", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"))
