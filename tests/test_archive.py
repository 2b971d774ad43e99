"""Call folders, digests of files, and streams that are stopped at any point."""

import datetime as dt
import hashlib
import json
import resource
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from callgrain.plans import queries
from callgrain.plans.queries import ORACLES, QUERIES
from callgrain.sources import archive, recordings
from callgrain.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def test_digest_of_a_file_beyond_two_gigabytes(spark, tmp_path):
    big, n = tmp_path / "big file%20ü.wav", 2_300_000_000
    with big.open("wb") as f:
        f.truncate(n)
        f.seek(n - 3)
        f.write(b"end")
    (tmp_path / "one.MP3").write_bytes(b"1")
    want = hashlib.sha256()
    for _ in range(n // 1_000_000 - 1):
        want.update(bytes(1_000_000))
    want.update(bytes(n - 3 - (n // 1_000_000 - 1) * 1_000_000) + b"end")
    found = recordings.hash_files(recordings.scan_recordings(spark, str(tmp_path), content=False).withColumn("sha256", F.lit("old")))

    def with_peak(batches):
        for b in batches:
            yield b.assign(peak=resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)

    rows = found.select("length", "sha256").mapInPandas(with_peak, "length long, sha256 string, peak long").collect()
    assert {(r.length, r.sha256) for r in rows} == {(n, want.hexdigest()), (1, hashlib.sha256(b"1").hexdigest())}
    assert max(r.peak for r in rows) < 1_000_000  # KB: a third of the file
    assert recordings.hash_files(spark.createDataFrame([], "path string, length long")).count() == 0


def put(root, folder, files):
    d = root / folder
    d.mkdir(parents=True)
    for name, body in files.items():
        (d / name).write_text(body if isinstance(body, str) else json.dumps(body, ensure_ascii=False), encoding="utf-8")


def test_archive_is_walked(spark, tmp_path):
    at = "2024-01-05T10:00:00+00:00"
    put(tmp_path, "2024/01/05/call_a", {
        "metadata.json": {"call_id": "a", "source_filename": "ü.wav", "sha256": "h1", "imported_at": at, "errors": ["x", "y"], "low_confidence": True, "other": {"k": 1}},
        "summary.json": {"short_summary": "short", "detailed_summary": "long", "analysis_language": "de"},
        "transcript_clean.txt": "  line one\nline two",
        "tasks.json": [{"task_id": "dup", "text": "t1"}, {"task_id": "dup", "text": "t2", "status": "confirmed"}],
        "tasks_reviewed.json": [{"task_id": "dup", "text": "r1", "type": "reminder"}],
        "audio_normalized.wav": "x", "notes.txt": "no artifact",
    })
    put(tmp_path, "call_b", {"metadata.json": {"call_id": "b", "source_filename": "b.wav", "sha256": "h2", "imported_at": at, "current_state": "failed"}, "tasks.json": "not json", "summary.json": "[]"})
    put(tmp_path, "deep/er/still/call_other", {"metadata.json": {"call_id": "c", "source_filename": "c.wav", "sha256": "h2", "imported_at": "2024-01-06T00:00:00+00:00"}, "transcript_clean.txt": ""})
    put(tmp_path, "call_none", {"summary.json": {"short_summary": "of no call"}})
    parts = archive.rebuild_archive(spark, str(tmp_path))
    calls = {r.call_id: r for r in parts["calls"].collect()}
    assert calls.keys() == {"a", "b"}  # c has the content of b, and came later
    a, b = calls["a"], calls["b"]
    assert a.search_text == "line one\nline two\nshort\nlong\nt1 t2\nr1" and (a.last_error, a.low_confidence, a.current_state, a.review_state, a.language_summary) == ("y", 1, "indexed", "pending", "de")
    assert a.archive_path.endswith("/2024/01/05/call_a") and (b.search_text, b.current_state, b.last_error) == ("", "failed", None)
    tasks = sorted((r.call_id, r.stored_id, r.text, r.type, r.status, r.is_reviewed) for r in parts["tasks"].collect())
    assert tasks == [("a", "a:extracted:dup", "t1", "task", "new", 0), ("a", "a:extracted:dup:2", "t2", "task", "confirmed", 0), ("a", "a:reviewed:dup", "r1", "reminder", "new", 1)]
    kinds = {(r.call_id, r.kind) for r in parts["artifacts"].collect()}
    assert kinds == {("a", k) for k in ("metadata", "summary", "transcript_clean", "tasks", "tasks_reviewed", "audio_normalized")} | {("b", "metadata"), ("b", "tasks"), ("b", "summary")}


def test_an_archive_is_read_once(spark, tmp_path):
    at = "2024-01-05T10:00:00+00:00"
    root = tmp_path / "a rchive ü%20"
    put(root, "1/2/call_a", {"metadata.json": "\ufeff" + json.dumps({"call_id": "a", "sha256": "h1", "imported_at": at}), "transcript_clean.txt": "text", "tasks.json": [{"text": "t1"}], "processing_log.json": "", "transcript_raw.json": "{"})
    put(root, "call_b", {"metadata.json": [{"call_id": "b", "sha256": "h2", "imported_at": at}], "tasks.json": {"text": "alone"}, "summary.json": {"short_summary": 1}})
    put(root, ".call_c", {"metadata.json": {"call_id": "c", "sha256": "h3", "imported_at": at}})
    put(root, "_call_d", {"metadata.json": {"call_id": "d", "sha256": "h4", "imported_at": at}})
    put(root, "empty", {})
    parts = archive.rebuild_archive(spark, str(root))
    for df in parts.values():  # the files are no part of what is returned, so each is opened once
        assert df.inputFiles() and not any("rchive" in f for f in df.inputFiles())
    shutil.rmtree(root)
    calls = {r.call_id: r.search_text for r in parts["calls"].collect()}
    assert calls == {"a": "text\n\n\nt1", "b": "1\n\nalone"}
    found = sorted((r.call_id, r.kind, r.path.startswith("file:/")) for r in parts["artifacts"].collect())
    assert found == [("a", k, True) for k in ("metadata", "tasks", "transcript_clean", "transcript_raw")] + [("b", k, True) for k in ("metadata", "summary", "tasks")]
    with pytest.raises(Exception, match="rchive"):
        archive.load_archive(spark, str(root))


def tables(folder, texts):
    """Documents of these texts, and two conversations, as the queries read them."""
    folder.mkdir()
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, 'en', 'src', 1)", [[i, t] for i, t in enumerate(texts)])
    con.sql("create table conversations as select i // 3 as conv_id, i % 3 as turn, 'user' as role, 'said ' || i as text from range(6) r(i)")
    for name in ("documents", "conversations"):
        con.sql(f"copy {name} to '{folder / name}.parquet'")
    return con


def same_as_sql(spark, con, folder, name):
    got = QUERIES[name](spark, str(folder))
    columns = ", ".join(sorted(got.columns))
    want = con.sql(f"select {columns} from ({ORACLES[name]})").fetchall()
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=key) == sorted(want, key=key)
    return len(want)


def test_a_text_of_zero_bytes_is_an_artifact(spark, tmp_path):
    for i, texts in enumerate((["", "b", "c"], ["a", None, "", "b"])):
        con = tables(tmp_path / str(i), texts)
        assert same_as_sql(spark, con, tmp_path / str(i), "ref_rebuild_archive") == 3


def test_recordings_are_listed_by_executors(spark, tmp_path):
    folder = tmp_path / "in ü%20"
    folder.mkdir()
    for name, body in {"a.wav": b"abc", "no.wav.txt": b"x", "c d%20ü.Flac": b"", ".h.wav": b"x", "_h.wav": b"x", "wav": b"x", "deep.wav": None}.items():
        (folder / name).mkdir() if body is None else (folder / name).write_bytes(body)
    (folder / "deep.wav" / "e.wav").write_bytes(b"x")
    for content in (False, True):
        found = recordings.scan_recordings(spark, str(folder), content=content)
        assert found.inputFiles() == []  # else the driver has listed them
        assert sorted((r.path[-14:].split("/")[-1], r.length, bytes(r.content) if content else None) for r in found.collect()) == [("a.wav", 3, b"abc" if content else None), ("c d%20ü.Flac", 0, b"" if content else None)]
    spark_s = spark.read.format("binaryFile").load(str(folder / "a.wav")).drop("content")
    assert recordings.scan_recordings(spark, str(folder), content=False).where("length > 0").collect() == spark_s.collect()
    assert spark_s.schema.simpleString() == recordings.scan_recordings(spark, str(folder), content=False).schema.simpleString()
    con = tables(tmp_path / "t", ["a", "", "c", "d", "e", "f"])
    assert same_as_sql(spark, con, tmp_path / "t", "ref_scan_recordings") == 4


def test_an_archive_goes_part_by_part(spark, tmp_path, monkeypatch):
    shared, there, write = tmp_path / "shared", [], archive.write_files
    found = lambda: len(list(shared.rglob("metadata.json")))
    monkeypatch.setattr(archive, "write_files", lambda *a: (write(*a), there.append(found())))
    monkeypatch.setattr(queries, "PART_CALLS", 4, raising=False)
    monkeypatch.setattr(queries, "scratch", lambda spark, label: str(shared / f"{label}-{len(there)}"))
    assert same_as_sql(spark, tables(tmp_path / "t", [f"text {i % 8}" for i in range(10)]), tmp_path / "t", "ref_rebuild_archive") == 8
    assert sum(there) == 10 and max(there) <= 4 and found() == 0  # no more than a part at a time, and nothing stays


def test_files_are_written_again_by_repeated_tasks(spark, tmp_path):
    files = spark.createDataFrame([("x/y/a.json", "ü"), ("b.txt", "")], "name string, body string")
    for _ in range(2):
        assert archive.write_files(files, str(tmp_path)) == 2
    assert sorted((p.name, p.read_text(encoding="utf-8")) for p in tmp_path.rglob("*") if p.is_file()) == [("a.json", "ü"), ("b.txt", "")]


class Stopped(Exception):
    pass


KIND = "call_id int, task string"
PARTS = [[(1, "a"), (1, "b"), (2, "c")], [(1, "d")], [(3, "e"), (3, "f")], [(2, "g")], [(4, "h")], [(1, "i")]]


def batch_function(spark, folder, sink):
    """The function that a sink gives to foreachBatch."""
    held = {}

    class Frame:
        schema, sparkSession = spark.createDataFrame([], KIND).schema, spark

        class writeStream:  # noqa: N801
            foreachBatch = staticmethod(lambda f: held.setdefault("f", f))  # noqa: N815

    sink(Frame, folder)
    return held["f"]


@pytest.mark.parametrize("kind", ["replace", "index", "new"])
def test_a_batch_stopped_anywhere_is_repeated(spark, tmp_path, monkeypatch, kind):
    sinks = {"replace": (lambda f, t: streams.stream_replace(f, t, 2), streams.read_replaced), "index": (lambda f, t: streams.stream_index(f, t, compact_every=2), streams.read_index), "new": (lambda f, t: streams.stream_new(f, t, "call_id", ("task",), 2), streams.read_new)}
    sink, read = sinks[kind]
    schema = spark.createDataFrame([], KIND).schema
    rows = lambda t: sorted(map(tuple, read(spark, t, schema).collect()))
    want, plain = [], batch_function(spark, str(tmp_path / "plain"), sink)
    for n, part in enumerate(PARTS[:4]):
        plain(spark.createDataFrame(part, KIND), n)
        want.append(rows(str(tmp_path / "plain")))
    publish, drop = streams._publish, streams._drop
    for stop in range(6):  # before and after the changes, the base, and among the deletions
        folder, calls = str(tmp_path / f"stop{stop}"), [0]

        def step(f, *a, stop=stop, calls=calls):
            calls[0] += 1
            if calls[0] == 2 * stop + 1:
                raise Stopped
            out = f(*a)
            calls[0] += 1
            if calls[0] == 2 * stop + 2 and stop % 2:
                raise Stopped
            return out

        apply = batch_function(spark, folder, sink)
        for n, part in enumerate(PARTS[:4]):
            calls[0] = 0 if n in (1, 3) else -99
            monkeypatch.setattr(streams, "_publish", lambda *a: step(publish, *a))
            monkeypatch.setattr(streams, "_drop", lambda *a: step(drop, *a))
            try:
                apply(spark.createDataFrame(part, KIND), n)
            except Stopped:
                pass
            monkeypatch.setattr(streams, "_publish", publish)
            monkeypatch.setattr(streams, "_drop", drop)
            for _ in range(2):  # repeated, after its own compaction too
                apply(spark.createDataFrame(part, KIND), n)
                assert rows(folder) == want[n], (stop, n)


def test_a_reader_outlives_a_compaction(spark, tmp_path):
    t = str(tmp_path / "t")
    apply = batch_function(spark, t, lambda f, x: streams.stream_replace(f, x, 2))
    schema = spark.createDataFrame([], KIND).schema
    for n, part in enumerate(PARTS):
        before = streams.read_replaced(spark, t, schema)  # listed now, read after the batch
        plan = sorted(map(tuple, before.collect()))
        apply(spark.createDataFrame(part, KIND), n)
        assert sorted(map(tuple, before.collect())) == plan
    assert sorted(p.name for p in (tmp_path / "t" / "base").iterdir()) == ["batch=3", "batch=5"]


def drain(writer, folder):
    q = writer.option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_import_holds_no_state(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for batch in ({"b.wav": b"abc", "a.wav": b"abc", "c.wav": b"def"}, {"0.wav": b"abc", "d.wav": b"new"}, {}):
        for name, data in batch.items():
            (src / name).write_bytes(data)
        q = drain(streams.stream_import(spark, str(src), str(tmp_path / "calls"), "*.wav", 2), tmp_path / "ck")
        assert not any(p.stateOperators for p in q.recentProgress)
    schema = spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, sha256 string").schema
    got = streams.read_new(spark, str(tmp_path / "calls"), schema).collect()
    assert sorted((r.path[-5:], r.length, r.sha256) for r in got) == sorted((n, 3, hashlib.sha256(x).hexdigest()) for n, x in (("a.wav", b"abc"), ("c.wav", b"def"), ("d.wav", b"new")))


def test_stable_files_are_emitted_once(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    kind = "path string, length bigint, mtime timestamp, observed_at timestamp"
    src = tmp_path / "src"
    same = lambda p, *seconds: [(p, 5, at(0), at(s)) for s in seconds]
    parts = [
        [*same("/a", 10), *same("/b", 10, 20, 30, 40), ("/c", 1, at(0), at(10)), (None, 1, at(0), at(10)), ("/n", None, at(0), at(10))],
        [*same("/a", 20, 20, 20), ("/c", 2, at(0), at(20)), *same("/b", 50)],
        [*same("/a", 30, 40), *[("/c", 2, at(0), at(s)) for s in (30, 40, 50)], *same("/b", 60)],
        [*same("/a", 70), *same("/c", 70)],
        same("/z", 20_000),
        [*same("/z", 20_010)],
        same("/a", 20_020, 20_030, 20_040, 20_050),  # forgotten since, so new
    ]
    sizes, out = [], str(tmp_path / "out")
    for p in parts:
        spark.createDataFrame(p, kind).coalesce(1).write.mode("append").parquet(str(src))
        stable = streams.stream_stable_files(spark.readStream.schema(kind).parquet(str(src)))
        q = drain(stable.writeStream.format("parquet").option("path", out), tmp_path / "ck")
        sizes.append(q.lastProgress.stateOperators[0].numRowsTotal if q.lastProgress and q.lastProgress.stateOperators else None)
    got = sorted(r.path for r in spark.read.parquet(out).collect())
    assert got == ["/a", "/a", "/b", "/c"]
    assert sizes[3] == 3 and min(x for x in sizes[4:] if x is not None) <= 2
