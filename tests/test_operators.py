"""Small cases: edges, ties, nulls, idempotence."""

import datetime as dt

from pyspark.sql import functions as F

from callgrain.functions import payloads, text
from callgrain.operators import analysis, compare, index, ingest, jobs, search, segments, tasks
from callgrain.sources import recordings


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_clean_and_render(spark):
    df = spark.createDataFrame([(0.0, "unknown", "  Hello   there!!!  "), (12.5, "speaker_1", "a  b??..")], "start double, label string, text string")
    lines = [r[0] for r in df.select(text.render_line(F.col("start"), F.col("label"), F.col("text"))).collect()]
    assert lines == ["[0000.00] UNKNOWN: Hello there!", "[0012.50] SPEAKER 1: a b?."]


def test_predicates_are_unicode_aware(spark):
    df = spark.createDataFrame([("Recall it",), ("Мы AGREED, да",), ("disagreed",), ("why?",), (None,)], "t string")
    t = F.col("t")
    got = [tuple(r) for r in df.select(text.is_task_candidate(t), text.is_decision(t), text.is_question(t)).collect()]
    assert got == [(True, False, False), (False, True, False), (False, False, False), (False, False, True), (None, None, None)]


def test_classify_and_excerpt(spark):
    df = spark.createDataFrame([("connection", None), ("timeout", None), ("status", 403), ("status", 429), ("status", 422), ("status", 500), (None, None)], "e string, s int")
    assert [r[0] for r in df.select(text.classify_failure(F.col("e"), F.col("s"))).collect()] == ["transport", "timeout", "auth", "rate_limit", "api_validation", "unknown", "unknown"]
    long = spark.createDataFrame([("x" * 300,), ("a  b\n",)], "t string").select(text.excerpt(F.col("t"))).collect()
    assert long[0][0] == "x" * 237 + "..." and long[1][0] == "a b"


SEG = "call_id string, seg_idx int, start_sec double, end_sec double, text string"
TURN = "call_id string, turn_idx int, start_sec double, end_sec double, speaker_cluster_id string, confidence string"


def test_alignment_edges(spark):
    s = spark.createDataFrame([("a", 0, 0.0, 2.0, "x"), ("a", 1, 10.0, 12.0, "x"), ("a", 2, 5.0, 4.0, "x"), ("b", 0, 0.0, 1.0, "x"), ("a", 3, 3.0, 3.5, "x")], SEG)
    t = spark.createDataFrame([("a", 0, 0.0, 1.0, "s1", None), ("a", 1, 1.0, 3.0, "s2", "high"), ("a", 2, 6.0, 7.0, "s3", ""), ("a", 3, 7.0, 3.0, "s4", "low")], TURN)
    want = [("a", 0, "s1", "medium"), ("a", 1, "s3", "medium"), ("a", 2, "s3", "medium"), ("a", 3, "s2", "high"), ("b", 0, "speaker_1", "low")]
    columns = ("call_id", "seg_idx", "speaker_cluster_id", "diarization_confidence")
    assert rows(segments.align_turns(s, t), *columns) == want
    assert rows(segments.align_turns_bucketed(s, t, 2.0), *columns) == want


def test_bucketed_alignment_agrees(spark):
    import random

    r = random.Random(3)
    s = [(str(c), i, a, a + r.choice([0.0, 0.5, 4.0, -1.0]), "x") for c in range(4) for i in range(60) for a in [r.randrange(0, 4000) / 4]]
    t = [(str(c), i, a, a + r.choice([0.25, 2.0, 50.0, -2.0]), f"s{i % 3}", "high") for c in range(3) for i in range(25) for a in [r.randrange(0, 3600) / 4]]
    s, t = spark.createDataFrame(s, SEG), spark.createDataFrame(t, TURN)
    columns = ("call_id", "seg_idx", "speaker_cluster_id", "diarization_confidence")
    assert rows(segments.align_turns(s, t), *columns) == rows(segments.align_turns_bucketed(s, t), *columns)


def test_fallback_and_mapping(spark):
    s = spark.createDataFrame([("a", 0, "speaker_1", None), ("a", 1, "", "speaker_2"), ("a", 2, None, None)], "call_id string, seg_idx int, speaker_cluster_id string, speaker_label string")
    m = spark.createDataFrame([("a", {"speaker_1": "me", "speaker_2": "boss"})], "call_id string, mapping map<string,string>")
    once = segments.apply_speaker_mapping(s, m)
    want = [("a", 0, "speaker_1", "me"), ("a", 1, "speaker_2", "speaker_2"), ("a", 2, "speaker_1", "me")]
    columns = ("call_id", "seg_idx", "speaker_cluster_id", "speaker_label")
    assert rows(once, *columns) == want == rows(segments.apply_speaker_mapping(once, m), *columns)
    assert segments.single_speaker_fallback(s, enabled=False).count() == 0


def test_segment_numbers_keep_gaps(spark):
    kind = "call_id string, text string, segments array<struct<start_sec:double,start:double,end_sec:double,end:double,text:string,avg_logprob:double,speaker:string>>"
    df = spark.createDataFrame([("a", "", [(None, 1.0, None, 2.0, " x ", -0.5, None), (0.0, None, 0.0, None, "  ", None, None), (None, None, 3.0, None, "y", None, "s")]), ("b", " whole ", []), ("c", " ", []), ("d", "t", None)], kind)
    got = rows(segments.normalize_raw_segments(segments.synthesize_single_segment(df)), "call_id", "segment_id", "start_sec", "end_sec", "text")
    assert got == [("a", "seg_0001", 1.0, 2.0, "x"), ("a", "seg_0003", 0.0, 3.0, "y"), ("b", "seg_0001", 0.0, 0.0, "whole"), ("d", "seg_0001", 0.0, 0.0, "t")]


def test_unique_ids_with_literal_clash(spark):
    t = spark.createDataFrame([("c", "extracted", "dup:2", 0), ("c", "extracted", "dup", 1), ("c", "extracted", "dup", 2), ("d", "extracted", "dup", 0), ("d", "extracted", "", 1)], "call_id string, kind string, task_id string, pos int")
    got = {(r.call_id, r.pos): r.stored_id for r in tasks.unique_task_ids(t).collect()}
    assert got[("c", 0)] == "c:extracted:dup:2" and got[("c", 1)] == "c:extracted:dup" and got[("c", 2)] == "c:extracted:dup:3"
    assert got[("d", 0)] == "d:extracted:dup" and len(set(got.values())) == 5


def test_task_source_levels(spark):
    s = spark.createDataFrame([("a", 0, 0.0, 1.0, "first words"), ("a", 1, 1.0, 2.0, "send THE report"), ("a", 2, 2.0, 3.0, "please call me")], SEG)
    t = spark.createDataFrame([("a", "1", "the report"), ("a", "2", "me? call"), ("a", "3", "zzz"), ("a", "4", ""), ("b", "5", "x")], "call_id string, task_id string, text string")
    t = t.withColumn("source_quote", F.lit(None).cast("string")).withColumn("source_timestamp", F.lit(None).cast("double"))
    got = rows(tasks.attach_task_source(t, s), "task_id", "source_timestamp")
    assert got == [("1", 1.0), ("2", 2.0), ("3", 0.0), ("4", 0.0), ("5", None)]


def test_import_dedupes_and_is_repeatable(spark, tmp_path):
    for name, data in (("a.WAV", b"abc"), ("b.wav", b"abc"), ("c.mp3", b"def"), ("d.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    files = recordings.content_hash(recordings.scan_recordings(spark, str(tmp_path)))
    ts = F.lit("2024-05-06 07:08:09").cast("timestamp")
    none = spark.createDataFrame([], "sha256 string")
    first = ingest.import_new_calls(files, none, ts)
    got = rows(first, "source_filename", "call_id")
    assert [g[0] for g in got] == ["a.WAV", "c.mp3"] and got[0][1] == "20240506_070809_ba7816"
    assert ingest.import_new_calls(files, first, ts).count() == 0


def test_artifact_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", ["ü", "b"])], "call_id string, errors array<string>")
    recordings.write_artifacts(df, str(tmp_path / "x"))
    back = recordings.read_artifacts(spark, str(tmp_path / "x"), "call_id string, errors array<string>, missing int").collect()
    assert back[0]["errors"] == ["ü", "b"] and back[0]["missing"] is None
    e = spark.createDataFrame([(1, "a", "s", "started", dt.datetime(2024, 1, 1), None)], recordings.JOB_EVENTS)
    recordings.append_events(e, str(tmp_path / "e"))
    recordings.append_events(e, str(tmp_path / "e"))
    assert recordings.read_events(spark, str(tmp_path / "e")).count() == 2
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert recordings.read_text_artifacts(spark, str(tmp_path / "t.txt")).collect()[0]["text"] == "one\ntwo"


def test_stable_files(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", 1, t, t)] * 4 + [("b", i, t, t) for i in range(4)] + [("c", 1, t, t)], "path string, length long, mtime timestamp, observed_at timestamp")
    assert rows(ingest.stable_files(df), "path") == [("a",)]
    assert rows(ingest.stable_files(df, 2, 1), "path") == [("a",)]


def test_upsert_is_idempotent(spark):
    k = "call_id string, sha256 string, imported_at int, recorded_at int, current_state string"
    old = spark.createDataFrame([("a", "h", 1, 5, "indexed"), ("b", "i", 1, None, "x")], k)
    new = spark.createDataFrame([("a", "z", 9, None, None), ("c", "y", 3, 4, "new")], k)
    once = index.upsert_calls(old, new)
    want = [("a", "h", 1, 5, None), ("b", "i", 1, None, "x"), ("c", "y", 3, 4, "new")]
    assert rows(once, *once.columns) == want == rows(index.upsert_calls(once, new), *once.columns)
    r = index.replace_tasks(old.select("call_id"), new.select("call_id"))
    assert rows(r, "call_id") == rows(index.replace_tasks(r, new.select("call_id")), "call_id")


def test_like_has_no_escape(spark):
    df = spark.createDataFrame([("a\\b",), ("A_B",), ("ЖЖ",)], "t string")
    hits = lambda p: [r[0] for r in df.where(search.like_ascii(F.col("t"), p)).collect()]
    assert hits("a\\b") == ["a\\b"] and hits("a_b") == ["a\\b", "A_B"] and hits("%жж%") == []


def test_stale_reclaim(spark):
    k = "job_id string, call_id string, stage string, status string, priority int, attempt_count int, max_attempts int, available_at timestamp, started_at timestamp"
    t = dt.datetime(2024, 1, 1)
    j = spark.createDataFrame([("1", "a", "s", "running", 0, 1, 2, t, t), ("2", "a", "s", "running", 0, 2, 2, t, t), ("3", "a", "s", "running", 0, 0, 2, t, None)], k)
    got = jobs.stale_resolution(j, F.lit("2024-01-01 00:05:00").cast("timestamp"))
    assert rows(got, "job_id", "status") == [("1", "queued"), ("2", "failed")]
    assert jobs.stale_jobs(j, F.lit("2024-01-01 00:04:59").cast("timestamp")).count() == 0


def test_payload_defaults(spark):
    df = spark.createDataFrame([('{"tasks":[{"text":"a"},{"text":"b","type":null}]}',), ("{}",), ('{"tasks":null}',), ('{"tasks":[{"owner":"x"}]}',), ("[]",), ("",), (None,)], "p string")
    got = [r[0] for r in df.select(payloads.parse_analysis_json(F.col("p"))).collect()]
    assert [t["task_id"] for t in got[0]["tasks"]] == ["task_0001", "task_0002"] and got[0]["tasks"][1]["type"] == "task"
    assert got[1]["analysis_language"] == "unknown" and got[1]["analysis_confidence"] is None and got[1]["tasks"] == [] and got[2:] == [None] * 5


def test_provider_choice(spark):
    a = spark.createDataFrame([("a", "local", False, None, "x"), ("a", "cloud", True, "t", None), ("b", "local", False, None, "x"), ("b", "cloud", False, None, "y")], "call_id string, provider string, ok boolean, text string, error string")
    p = spark.createDataFrame([("a", "local"), ("b", "local")], "call_id string, provider string")
    assert rows(compare.first_successful_provider(a, p), "call_id", "provider", "error") == [("a", "cloud", None), ("b", None, "local: x; cloud: y")]
    assert rows(compare.first_successful_provider(a, p, cloud_enabled=False), "call_id", "error") == [("a", "local: x"), ("b", "local: x")]


def test_empty_calls_give_defaults(spark):
    lines = spark.createDataFrame([("a", [" ", "x"]), ("b", [])], "call_id string, lines array<string>")
    none = "No transcript content available."
    assert rows(analysis.extractive_summary(lines), "call_id", "short_summary", "detailed_summary") == [("a", "x", "x"), ("b", none, none)]
    merged = segments.parse_role_mapping(spark.createDataFrame([("a", ["s", "s", "t"], ["me", "other", "bad"])], "call_id string, clusters array<string>, roles array<string>"))
    assert merged.collect()[0]["mapping"] == {"s": "other"}


def test_payload_keys(spark):
    p = [
        ('[{"description":"d","responsible":"me","deadline":null,"priority":"high","category":"work","confidence":0.9,"context":"c"}]', '{"duration_estimate":"5 minutes","mood_tone":"casual","outcome":"o","participants":["a"],"follow_up_needed":false}', '{"people":[{"name":"A","role":"r"}],"patterns":[{"observation":"x","confidence":0.7}],"events":[]}'),
        ("nope", "nope", "nope"),
    ]
    df = spark.createDataFrame(p, "items string, summary string, insights string")
    a, b = df.select(payloads.parse_action_items(F.col("items")).alias("i"), payloads.parse_call_summary(F.col("summary")).alias("s"), payloads.parse_insights(F.col("insights")).alias("n")).collect()
    assert a.i[0].asDict() == {"description": "d", "responsible": "me", "deadline": None, "priority": "high", "category": "work", "confidence": 0.9, "context": "c"}
    assert (a.s.duration_estimate, a.s.mood_tone, a.s.outcome, a.s.participants, a.s.follow_up_needed) == ("5 minutes", "casual", "o", ["a"], False)
    assert a.n.people[0].name == "A" and a.n.patterns[0].confidence == 0.7 and a.n.events == [] and a.n.projects is None
    assert b.i == []


def test_several_changes_of_a_call_in_one_batch(spark):
    k = "call_id int, sha256 string, imported_at int, recorded_at int, current_state string"
    old = spark.createDataFrame([(1, "h", None, 5, "x")], k)
    changes = [(1, "b", 7, None, "second", 2), (1, "a", 6, 4, "first", 1), (2, "d", None, 9, "second", 2), (2, "c", None, None, "first", 1), (2, "e", 8, None, "third", 3)]
    new = spark.createDataFrame(changes, k + ", at int")
    want = old
    for at in (1, 2, 3):
        want = index.upsert_calls(want, new.where(F.col("at") == at).drop("at"))
    once = index.upsert_calls(old, new, "at")
    assert rows(once, *once.columns) == rows(want, *once.columns) == [(1, "h", 6, 4, "second"), (2, "c", 8, 9, "third")]
    assert index.upsert_calls(old, new.drop("at")).count() == 2


def test_empty_translation_keeps_the_text(spark):
    c = spark.createDataFrame([("a", "t", "de", 0.9), ("b", "t", "de", 0.9), ("c", "t", "en", 0.9)], "call_id string, text string, language string, confidence double")
    tr = spark.createDataFrame([("a", ""), ("b", "u"), ("c", "u")], "call_id string, translation string")
    assert rows(analysis.translation_candidates(c, tr), "call_id", "translation_needed", "text") == [("a", False, "t"), ("b", True, "u"), ("c", False, "t")]


def test_stored_confidence_stays(spark):
    kind = "call_id string, segments array<struct<start_sec:double,start:double,end_sec:double,end:double,text:string,confidence:double,avg_logprob:double,speaker:string>>"
    df = spark.createDataFrame([("a", [(0.0, None, 1.0, None, "x", 0.25, -1.0, None), (0.0, None, 1.0, None, "y", None, -1.0, None)])], kind)
    assert rows(segments.normalize_raw_segments(df), "text", "confidence") == [("x", 0.25), ("y", -1.0)]


def test_broken_turn_times_do_not_explode(spark):
    s = spark.createDataFrame([("a", i, float(i), i + 1.0, "x") for i in range(5)], SEG)
    t = spark.createDataFrame([("a", 0, 2.0, 1e300, "s1", None), ("a", 1, 0.0, 1e7, "s2", None), ("a", 2, 3.0, 90_000.0, "s3", None), ("a", 3, 1.0, 3.0, "s4", None), ("a", 4, float("nan"), 1.0, "s5", None)], TURN)
    columns = ("call_id", "seg_idx", "speaker_cluster_id", "diarization_confidence")
    assert rows(segments.align_turns_bucketed(s, t.where("turn_idx < 4")), *columns) == rows(segments.align_turns(s, t.where("turn_idx < 4")), *columns)


def test_archive_listing(spark, tmp_path):
    for name in ("call_1/metadata.json", "call_1/summary.json", "call_2/audio_normalized.wav", "call_2/other.txt"):
        f = tmp_path / "2024" / "05" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("{}")
    (tmp_path / "w.wma").write_bytes(b"x")
    assert rows(recordings.artifact_listing(spark, str(tmp_path)), "call_id", "kind") == [("1", "metadata"), ("1", "summary"), ("2", "audio_normalized")]
    assert recordings.scan_recordings(spark, str(tmp_path)).count() == 1
