"""Streams against their batch counterparts."""

import datetime as dt

from pyspark.sql import functions as F

from callgrain.operators import index, ingest, jobs
from callgrain.sources import recordings
from callgrain.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def drain(writer, tmp_path, name):
    q = writer.option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_import_is_batch_import(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "calls")
    src.mkdir()
    for name, data in (("a.wav", b"abc"), ("b.wav", b"def"), ("c.wav", b"abc")):
        (src / name).write_bytes(data)
    drain(streams.stream_import(spark, str(src), table), tmp_path, "i")
    (src / "d.wav").write_bytes(b"def")
    drain(streams.stream_import(spark, str(src), table), tmp_path, "i")
    batch = recordings.content_hash(recordings.scan_recordings(spark, str(src)))
    want = {(r.path, r.sha256) for r in ingest.dedupe_first(batch.drop("content"), "sha256", "path").collect()}
    schema = batch.drop("content").schema
    assert {(r.path, r.sha256) for r in streams.read_new(spark, table, schema).collect()} == want


def test_stream_index_is_batch_index(spark, tmp_path):
    kind = "call_id string, sha256 string, imported_at int, recorded_at int"
    parts = [[("a", "h", 1, 1), ("b", "i", 1, None)], [("a", "z", 2, None), ("c", "j", 2, 2)]]
    src, want = tmp_path / "src", spark.createDataFrame([], kind)
    for i, p in enumerate(parts):
        df = spark.createDataFrame(p, kind)
        df.coalesce(1).write.mode("append").parquet(str(src))
        want = index.upsert_calls(want, df)
        drain(streams.stream_index(spark.readStream.schema(kind).parquet(str(src)), str(tmp_path / "t")), tmp_path, "x")
    got = streams.read_index(spark, str(tmp_path / "t"), want.schema)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_batches_write_their_changes_only(spark, tmp_path):
    kind = "call_id int, sha256 string, imported_at int, recorded_at int, state string, at int"
    src, want, sizes = tmp_path / "src", spark.createDataFrame([], kind), []
    t = str(tmp_path / "t")
    for i in range(7):
        p = [(k, f"h{i}", i, i if k % 2 else None, f"s{i}", k % 3) for k in range(0 if i == 0 else i, 2000 if i == 0 else i + 3)] + [(1, f"x{i}", i, None, "again", 9)]
        df = spark.createDataFrame(p, kind)
        df.coalesce(1).write.mode("append").parquet(str(src))
        want = spark.createDataFrame(index.upsert_calls(want, df, "at").collect(), df.schema)
        drain(streams.stream_index(spark.readStream.schema(kind).parquet(str(src)), t, "at", compact_every=4), tmp_path, "x")
        changed = tmp_path / "t" / "changes" / f"batch={i}"
        sizes.append(sum(f.stat().st_size for f in changed.rglob("*.parquet")) if changed.exists() else None)
    got = streams.read_index(spark, t, want.schema)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert all(x < sizes[0] for x in sizes[1:])
    assert [p.name for p in (tmp_path / "t" / "base").iterdir()] == ["batch=3"] and sorted(p.name for p in (tmp_path / "t" / "changes").iterdir()) == [f"batch={i}" for i in range(7)]


def test_stream_replace_keeps_the_last_batch_of_a_call(spark, tmp_path):
    kind = "call_id int, task string"
    src, t = tmp_path / "src", str(tmp_path / "t")
    for part in ([(1, "a"), (1, "b"), (2, "c")], [(1, "d")], [(3, "e"), (3, "f")]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(src))
        drain(streams.stream_replace(spark.readStream.schema(kind).parquet(str(src)), t, compact_every=2), tmp_path, "x")
    got = streams.read_replaced(spark, t, spark.createDataFrame([], kind).schema)
    assert sorted(map(tuple, got.collect())) == [(1, "d"), (2, "c"), (3, "e"), (3, "f")]


def test_stream_stale_jobs_is_batch_stale_jobs(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    starts = [("a", "s", at(0)), ("b", "s", at(1)), ("c", "s", at(2)), ("z", "s", at(60)), ("z", "s", at(90))]
    ends = [("a", "s", at(3)), ("c", "s", at(20)), ("z", "s", at(61)), ("z", "s", at(91))]
    for name, rows, c in (("s", starts, "started_at"), ("f", ends, "finished_at")):
        for i, r in enumerate(rows):
            spark.createDataFrame([r], f"call_id string, stage string, {c} timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda n, c: spark.readStream.schema(f"call_id string, stage string, {c} timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n))
    out = str(tmp_path / "o")
    late = streams.stream_stale_jobs(read("s", "started_at"), read("f", "finished_at"))
    drain(late.writeStream.format("parquet").option("path", out), tmp_path, "j")
    got = {(r.call_id, r.started_at) for r in spark.read.parquet(out).collect()}
    j = spark.createDataFrame([("1", "b", "running", at(1))], "job_id string, call_id string, status string, started_at timestamp")
    never = {(r.call_id, r.started_at) for r in jobs.stale_jobs(j, F.lit(at(90))).collect()}
    assert got == never | {("c", at(2))}  # c finished too late
