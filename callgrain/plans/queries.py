"""One query per operator over the derived tables, with the same result as DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.functions import payloads, text
from callgrain.operators import analysis, compare, index, ingest, jobs, mapping, search, segments, tasks
from callgrain.plans.fixtures import fixture, with_tables
from callgrain.plans.scratch import scratch
from callgrain.sources import archive, layout
from callgrain.sources import recordings as recordings_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-20 00:00:00"
WS, EDGE = r"\s+", r"^\s+|\s+$"


def query(name: str, sql: str | None = None, *tables: str):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(sql, *tables) if tables else sql
        return fn

    return register


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def seg(spark, d):
    return fixture(spark, d, "seg")


def kept_seg(spark, d):
    """Numbered non-blank segments."""
    s = seg(spark, d)
    return s.where(~text.is_blank(F.col("text"))).withColumn("segment_id", segments.segment_id(F.col("seg_idx")))


def labelled(spark, d):
    return segments.align_turns_bucketed(kept_seg(spark, d), fixture(spark, d, "tur"))


# SQL fragments shared by oracles
KEPT = r"SELECT *, CASE WHEN end_sec >= start_sec THEN (start_sec + end_sec) / 2 ELSE start_sec END AS mid FROM seg WHERE regexp_matches(text, '\S')"
ALIGNED = f"""SELECT s.call_id, s.seg_idx, s.text, s.start_sec, s.end_sec, coalesce(b.cluster, 'speaker_1') AS cluster,
  CASE WHEN b.call_id IS NULL THEN 'low' ELSE coalesce(nullif(b.confidence, ''), 'medium') END AS confidence
FROM ({KEPT}) s LEFT JOIN (
  SELECT call_id, seg_idx, speaker_cluster_id AS cluster, confidence FROM (
    SELECT k.call_id, k.seg_idx, t.speaker_cluster_id, t.confidence, row_number() OVER (PARTITION BY k.call_id, k.seg_idx ORDER BY
      CASE WHEN t.start_sec <= k.mid AND k.mid <= t.end_sec THEN 0 ELSE 1 END,
      CASE WHEN t.start_sec <= k.mid AND k.mid <= t.end_sec THEN 0.0 ELSE least(abs(t.start_sec - k.mid), abs(t.end_sec - k.mid)) END, t.turn_idx) AS rn
    FROM ({KEPT}) k JOIN tur t ON k.call_id = t.call_id) r WHERE rn = 1) b ON s.call_id = b.call_id AND s.seg_idx = b.seg_idx"""


def clean_sql(c: str) -> str:
    out = rf"regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
    for mark in "?.!,":
        out = f"regexp_replace({out}, '[{mark}]{{2,}}', '{mark}', 'g')"
    return out


LINE = f"concat('[', printf('%07.2f', start_sec), '] ', upper(replace(cluster, 'speaker_', 'speaker ')), ': ', {clean_sql('text')})"


@query("ref_clean_transcript", f"SELECT call_id, string_agg({LINE}, chr(10) ORDER BY seg_idx) AS clean_text FROM ({ALIGNED}) a GROUP BY call_id", "seg", "tur")
def clean_transcript(spark, d):
    return analysis.build_clean_transcript(labelled(spark, d).withColumn("speaker_label", F.col("speaker_cluster_id"))).select("call_id", "clean_text")


@query("ref_align_turns", f"SELECT call_id, seg_idx, cluster AS speaker_cluster_id, confidence AS diarization_confidence FROM ({ALIGNED}) a", "seg", "tur")
def align_turns(spark, d):
    return segments.align_turns(kept_seg(spark, d), fixture(spark, d, "tur")).select("call_id", "seg_idx", "speaker_cluster_id", "diarization_confidence")


@query("ref_align_turns_bucketed", f"SELECT call_id, seg_idx, cluster AS speaker_cluster_id, confidence AS diarization_confidence FROM ({ALIGNED}) a", "seg", "tur")
def align_turns_bucketed(spark, d):
    return segments.align_turns_bucketed(kept_seg(spark, d), fixture(spark, d, "tur")).select("call_id", "seg_idx", "speaker_cluster_id", "diarization_confidence")


@query("ref_single_speaker_fallback", rf"SELECT call_id, seg_idx, 'speaker_1' AS speaker_cluster_id, 'low' AS diarization_confidence FROM seg WHERE regexp_matches(text, '\S')", "seg")
def single_speaker(spark, d):
    return segments.single_speaker_fallback(kept_seg(spark, d)).select("call_id", "seg_idx", "speaker_cluster_id", "diarization_confidence")


@query(
    "ref_number_segments",
    r"SELECT call_id, printf('seg_%04d', rn) AS segment_id, text FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY seg_idx) AS rn FROM seg) t WHERE regexp_matches(text, '\S')",
    "seg",
)
def number_segments(spark, d):
    return segments.number_segments(seg(spark, d).withColumnRenamed("seg_idx", "turn")).select("call_id", "segment_id", "text")


def raw_transcripts(spark, d):
    """Transcripts with nested segments; calls divisible by 7 have text but no segments."""
    s = seg(spark, d).groupBy("call_id").agg(
        F.sort_array(F.collect_list(F.struct("seg_idx", F.when(F.col("seg_idx") % 3 == 0, F.col("start_sec")).alias("start_sec"), F.when(F.col("seg_idx") % 3 == 1, F.col("start_sec")).alias("start"), F.col("end_sec"), F.lit(None).cast("double").alias("end"), "text", (-F.col("start_sec")).alias("avg_logprob"), F.col("role").alias("speaker")))).alias("a")
    )
    segs = F.transform("a", lambda x: x.dropFields("seg_idx"))
    empty = F.col("call_id") % 7 == 0
    t = s.select("call_id", F.when(empty, F.concat(F.lit(" full text "), F.col("call_id").cast("string"))).alias("text"), segs.alias("segments"))
    return t.withColumn("segments", F.when(empty, F.slice("segments", 1, 0)).otherwise(F.col("segments")))


@query(
    "ref_normalize_raw_segments",
    rf"""SELECT call_id, printf('seg_%04d', rn) AS segment_id, CASE WHEN seg_idx % 3 = 2 THEN 0.0 ELSE start_sec END AS start_sec, end_sec, regexp_replace(text, '{EDGE}', '', 'g') AS text, -start_sec AS confidence, role AS speaker
    FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY seg_idx) AS rn FROM seg WHERE call_id % 7 <> 0) t WHERE regexp_matches(text, '\S')
    UNION ALL SELECT DISTINCT call_id, 'seg_0001', 0.0, 0.0, concat('full text ', CAST(call_id AS VARCHAR)), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR) FROM seg WHERE call_id % 7 = 0""",
    "seg",
)
def normalize_raw(spark, d):
    t = segments.synthesize_single_segment(raw_transcripts(spark, d))
    return segments.normalize_raw_segments(t).drop("seg_idx")


@query(
    "ref_flag_low_confidence",
    "SELECT DISTINCT call_id, call_id % 7 = 0 OR call_id % 4 = 0 AS low_confidence FROM seg",
    "seg",
)
def flag_low(spark, d):
    t = raw_transcripts(spark, d)
    reasons = t.select("call_id", F.when(F.col("call_id") % 4 == 0, "fallback").otherwise("").alias("reason"))
    return segments.flag_low_confidence(t, reasons)


def role_forms(spark, d):
    c = seg(spark, d).select("call_id").distinct()
    return c.select("call_id", F.array(F.lit("speaker_1"), F.lit("speaker_2"), F.lit("speaker_1")).alias("clusters"), F.array(F.lit("me"), F.when(F.col("call_id") % 2 == 0, "other").otherwise("boss"), F.when(F.col("call_id") % 3 == 0, "unknown").otherwise("x")).alias("roles"))


@query(
    "ref_apply_speaker_mapping",
    f"""SELECT call_id, seg_idx, CASE WHEN cluster = 'speaker_1' THEN CASE WHEN call_id % 3 = 0 THEN 'unknown' ELSE 'me' END WHEN call_id % 2 = 0 THEN 'other' ELSE cluster END AS speaker_label FROM ({ALIGNED}) a""",
    "seg",
    "tur",
)
def speaker_mapping(spark, d):
    m = segments.parse_role_mapping(role_forms(spark, d))
    s = labelled(spark, d).withColumn("speaker_label", F.lit(None).cast("string"))
    return segments.apply_speaker_mapping(s, m).select("call_id", "seg_idx", "speaker_label")


@query("ref_speaker_clusters", f"SELECT call_id, string_agg(DISTINCT cluster, ',' ORDER BY cluster) AS clusters FROM ({ALIGNED}) a GROUP BY call_id", "seg", "tur")
def clusters(spark, d):
    return segments.speaker_clusters(labelled(spark, d).withColumn("speaker_label", F.lit(""))).select("call_id", F.array_join("clusters", ",").alias("clusters"))


@query("ref_clean_text", f"SELECT call_id, seg_idx, {clean_sql('text')} AS cleaned FROM seg", "seg")
def clean(spark, d):
    return seg(spark, d).select("call_id", "seg_idx", text.clean_text(F.col("text")).alias("cleaned"))


MARK = " OR ".join(f"contains(lower(text), '{m}')" for m in ("need to", "should", "will", "follow up", "send", "call", "review"))
WORD = r"regexp_matches(lower(text), '\b({})\b')"
DECIDED, PROMISED = WORD.format("decided|agreed|confirm"), WORD.format("i will|we will|promise")


@query("ref_signal_predicates", f"SELECT call_id, seg_idx, {MARK} AS task, {DECIDED} AS decision, contains(text, '?') AS question, {PROMISED} AS commitment FROM seg", "seg")
def predicates(spark, d):
    t = F.col("text")
    return seg(spark, d).select("call_id", "seg_idx", text.is_task_candidate(t).alias("task"), text.is_decision(t).alias("decision"), text.is_question(t).alias("question"), text.is_commitment(t).alias("commitment"))


def first10(cond: str) -> str:
    return f"coalesce(array_to_string((list(text ORDER BY seg_idx) FILTER (WHERE {cond}))[1:10], '|'), '')"


@query(
    "ref_call_signals",
    rf"""SELECT call_id, {first10(DECIDED)} AS decisions, {first10("contains(text, '?')")} AS open_questions, {first10(PROMISED)} AS commitments,
    coalesce(array_to_string(list(printf('task_%04d', seg_idx + 1) ORDER BY seg_idx) FILTER (WHERE {MARK}), '|'), '') AS task_ids,
    CASE WHEN count(*) FILTER (WHERE {MARK}) > 0 THEN CAST(0.45 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS confidence FROM seg WHERE regexp_matches(text, '\S') GROUP BY call_id""",
    "seg",
)
def signals(spark, d):
    s = analysis.call_signals(kept_seg(spark, d))
    j = lambda c: F.array_join(c, "|")
    return s.select("call_id", *[j(c).alias(c) for c in ("decisions", "open_questions", "commitments")], j(F.transform("tasks", lambda t: t["task_id"])).alias("task_ids"), analysis.analysis_confidence(F.col("tasks")).cast("double").alias("confidence"))


@query(
    "ref_extractive_summary",
    f"""SELECT call_id, CASE WHEN call_id % 9 = 0 THEN 'No transcript content available.' ELSE l[1] END AS short_summary, CASE WHEN call_id % 9 = 0 THEN 'No transcript content available.' ELSE array_to_string(l[1:8], ' ') END AS detailed_summary,
    CASE WHEN call_id % 9 = 0 THEN '' ELSE array_to_string(l[1:5], '|') END AS key_points FROM (SELECT call_id, list({LINE} ORDER BY seg_idx) AS l FROM ({ALIGNED}) a GROUP BY call_id) t""",
    "seg",
    "tur",
)
def summary(spark, d):
    t = analysis.build_clean_transcript(labelled(spark, d).withColumn("speaker_label", F.col("speaker_cluster_id")))
    t = t.withColumn("lines", F.when(F.col("call_id") % 9 == 0, F.array(F.lit("  "))).otherwise(F.col("lines")))
    return analysis.extractive_summary(t).withColumn("key_points", F.array_join("key_points", "|"))


@query(
    "ref_fallback_analysis",
    f"""SELECT call_id, 'mixed' AS analysis_language, 'deterministic fallback analysis' AS low_confidence_reason, CASE WHEN count(*) FILTER (WHERE {MARK}) > 0 THEN CAST(0.45 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS analysis_confidence,
    coalesce(array_to_string(list(concat_ws(':', printf('task_%04d', seg_idx + 1), 'unknown', 'task', 'new', '0.5', text) ORDER BY seg_idx) FILTER (WHERE {MARK}), '|'), '') AS tasks FROM ({ALIGNED}) a GROUP BY call_id""",
    "seg",
    "tur",
)
def fallback(spark, d):
    s = labelled(spark, d).withColumn("speaker_label", F.col("speaker_cluster_id"))
    a = analysis.fallback_analysis(analysis.call_signals(s), analysis.extractive_summary(analysis.build_clean_transcript(s)))
    one = F.transform("tasks", lambda t: F.concat_ws(":", t["task_id"], t["owner"], t["type"], t["status"], t["confidence"].cast("string"), t["text"]))
    return a.select("call_id", "analysis_language", "low_confidence_reason", F.col("analysis_confidence").cast("double").alias("analysis_confidence"), F.array_join(one, "|").alias("tasks"))


def tasks_of(spark, d):
    return fixture(spark, d, "tasks")


SOURCE_TASKS = "SELECT call_id, concat(task_id, '-', CAST(pos AS VARCHAR)) AS task_id, CASE pos % 4 WHEN 1 THEN substr(text, 5, 30) ELSE concat('zzz ', substr(text, 1, 12), ' qqq') END AS task_text FROM tasks"


@query(
    "ref_attach_task_source",
    rf"""SELECT call_id, task_id, seg_text AS source_quote, start_sec AS source_timestamp FROM (
      SELECT t.call_id, t.task_id, s.text AS seg_text, s.start_sec, row_number() OVER (PARTITION BY t.call_id, t.task_id ORDER BY
        CASE WHEN length(t.task_text) > 0 AND contains(lower(s.text), substr(lower(t.task_text), 1, 40)) THEN 1
             WHEN len(list_filter(list_filter(regexp_split_to_array(regexp_replace(lower(t.task_text), '{EDGE}', '', 'g'), '\s+'), lambda w: w <> '')[1:3], lambda w: contains(lower(s.text), w))) > 0 THEN 2 ELSE 3 END, s.seg_idx) AS rn
      FROM ({SOURCE_TASKS}) t JOIN seg s ON t.call_id = s.call_id) r WHERE rn = 1""",
    "seg",
    "tasks",
)
def task_source(spark, d):
    pos = F.col("pos")
    t = tasks_of(spark, d).select(
        "call_id",
        F.concat("task_id", F.lit("-"), pos.cast("string")).alias("task_id"),
        F.when(pos % 4 == 1, F.substring("text", 5, 30)).otherwise(F.concat(F.lit("zzz "), F.substring("text", 1, 12), F.lit(" qqq"))).alias("text"),
        F.lit(None).cast("string").alias("source_quote"),
        F.lit(None).cast("double").alias("source_timestamp"),
    )
    return tasks.attach_task_source(t, seg(spark, d)).select("call_id", "task_id", "source_quote", "source_timestamp")


@query(
    "ref_merge_review_edits",
    f"""SELECT f.call_id, f.pos, concat('reviewed_', f.task_id) AS task_id, f.text, CASE WHEN f.pos % 2 = 0 THEN NULL ELSE 'me' END AS owner, 'task' AS type,
      CASE WHEN f.pos % 3 = 0 THEN 'edited' ELSE 'confirmed' END AS status, CAST(NULL AS VARCHAR) AS deadline, o.text AS source_quote, 'ui' AS review_source, f.task_id AS original_task_id, '{AS_OF}' AS reviewed_at
    FROM (SELECT call_id, rn - 1 AS pos, CASE WHEN rn % 4 = 0 THEN 'nope' ELSE task_id END AS task_id, text FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY pos) AS rn FROM tasks) t) f
    LEFT JOIN (SELECT call_id, task_id, arg_max(text, pos) AS text FROM tasks GROUP BY call_id, task_id) o ON f.call_id = o.call_id AND f.task_id = o.task_id""",
    "tasks",
)
def review(spark, d):
    t = tasks_of(spark, d)
    g = t.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("pos", "task_id", "text"))).alias("a"))
    pick = lambda fn: F.transform("a", fn)
    f = g.select(
        "call_id",
        pick(lambda x, i: F.when((i + 1) % 4 == 0, "nope").otherwise(x["task_id"])).alias("task_id"),
        pick(lambda x: x["text"]).alias("text"),
        pick(lambda x, i: F.when(i % 2 == 0, "").otherwise("me")).alias("owner"),
        pick(lambda x: F.lit("")).alias("task_type"),
        pick(lambda x, i: F.when(i % 3 == 0, "").otherwise("confirmed")).alias("status"),
        pick(lambda x: F.lit("")).alias("deadline"),
    )
    e = t.select("call_id", "task_id", F.col("text").alias("source_quote"), F.lit(0.0).alias("source_timestamp"), F.col("pos").alias("ord"))
    return tasks.merge_review_edits(f, e, as_of()).drop("source_timestamp", "confidence").withColumn("reviewed_at", stamp("reviewed_at"))


@query(
    "ref_unique_task_ids",
    """SELECT call_id, pos, concat(CAST(call_id AS VARCHAR), ':', kind, ':', task_id, CASE WHEN rn > 1 THEN concat(':', CAST(rn AS VARCHAR)) ELSE '' END) AS stored_id
    FROM (SELECT *, row_number() OVER (PARTITION BY call_id, kind, task_id ORDER BY pos) AS rn FROM tasks) t""",
    "tasks",
)
def unique_ids(spark, d):
    t = tasks_of(spark, d).withColumn("call_id", F.col("call_id").cast("string"))
    return tasks.unique_task_ids(t).select(F.col("call_id").cast("long").alias("call_id"), "pos", "stored_id")


@query(
    "ref_reviewed_overrides_extracted",
    "SELECT call_id, pos, CASE WHEN call_id % 3 = 0 THEN 'reviewed' ELSE 'extracted' END AS kind FROM tasks WHERE call_id % 3 <> 0 OR pos % 4 = 1",
    "tasks",
)
def overrides(spark, d):
    t = tasks_of(spark, d)
    reviewed = t.where("call_id % 3 = 0 and pos % 4 = 1").withColumn("kind", F.lit("reviewed"))
    return tasks.reviewed_overrides_extracted(t, reviewed).select("call_id", "pos", "kind")


@query(
    "ref_task_status_counts",
    "SELECT call_id, count(*) AS n_tasks, count(*) FILTER (WHERE status = 'confirmed') AS n_confirmed, count(*) FILTER (WHERE status = 'dismissed') AS n_dismissed FROM tasks GROUP BY call_id",
    "tasks",
)
def status_counts(spark, d):
    return tasks.task_status_counts(tasks_of(spark, d))


@query("ref_union_task_sources", "SELECT kind2 AS kind, is_reviewed, count(*) AS n FROM (SELECT 'extracted' AS kind2, 0 AS is_reviewed FROM tasks UNION ALL SELECT 'reviewed', 1 FROM tasks WHERE pos % 4 = 1) t GROUP BY 1, 2", "tasks")
def union_sources(spark, d):
    t = tasks_of(spark, d)
    return tasks.union_task_sources(t, t.where("pos % 4 = 1")).groupBy("kind", "is_reviewed").agg(F.count(F.lit(1)).alias("n"))


@query("ref_call_task_counts", "SELECT c.call_id, count(t.pos) AS task_count FROM calls c LEFT JOIN tasks t ON c.call_id = t.call_id GROUP BY c.call_id", "calls", "tasks")
def call_task_counts(spark, d):
    return index.call_task_counts(fixture(spark, d, "calls"), tasks_of(spark, d)).select("call_id", "task_count")


@query(
    "ref_archive_search",
    "SELECT call_id, strftime(imported_at, '%Y-%m-%d') AS day FROM calls WHERE translate(search_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%the_and%' AND source_filename LIKE '%src1%' AND strftime(imported_at, '%Y-%m-%d') LIKE '2024-0%'",
    "calls",
)
def archive_search(spark, d):
    return search.archive_search(fixture(spark, d, "calls"), q="The_and", source="SRC1", date="2024-0").select("call_id", F.date_format("imported_at", "yyyy-MM-dd").alias("day"))


@query(
    "ref_indexed_search",
    "SELECT call_id, strftime(imported_at, '%Y-%m-%d') AS day FROM calls WHERE translate(search_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%the%onhe_%and%' AND source_filename LIKE '%src%' AND strftime(imported_at, '%Y-%m-%d') LIKE '2024-0%'",
    "calls",
)
def indexed_search(spark, d):
    """Postings for all texts are written to the shared folder, then one search goes by them."""
    folder = scratch(spark, "postings")
    search.build_search_index(fixture(spark, d, "calls"), folder)
    return search.indexed_search(spark, folder, "tHe%onhe_%and", "SRC", "2024-0").select("call_id", F.date_format("imported_at", "yyyy-MM-dd").alias("day"))


@query(
    "ref_apply_review",
    "SELECT call_id, CASE WHEN call_id IN (SELECT call_id FROM tasks) THEN 'reviewed' ELSE current_state END AS current_state, CASE WHEN call_id IN (SELECT call_id FROM tasks) THEN 'reviewed' ELSE 'pending' END AS review_state FROM calls",
    "calls",
    "tasks",
)
def apply_review(spark, d):
    calls = fixture(spark, d, "calls").select("call_id", "current_state", F.lit("pending").alias("review_state"))
    return tasks.apply_review(calls, tasks_of(spark, d).select("call_id"))


@query(
    "ref_archive_search_ext",
    "SELECT call_id, source_filename FROM calls WHERE lower(search_text) LIKE '%and%' AND current_state = 'indexed' AND NOT low_confidence AND source_filename IN ('src1', 'src2', 'src3') AND imported_at BETWEEN DATE '2024-02-01' AND DATE '2024-09-30'",
    "calls",
)
def archive_search_ext(spark, d):
    return search.archive_search_ext(fixture(spark, d, "calls"), "and", "indexed", False, ("src1", "src2", "src3"), "2024-02-01", "2024-09-30").select("call_id", "source_filename")


@query("ref_newest_calls", "SELECT call_id, strftime(imported_at, '%Y-%m-%d') AS day FROM calls ORDER BY imported_at DESC, call_id LIMIT 25", "calls")
def newest(spark, d):
    return search.newest_calls(fixture(spark, d, "calls"), 25).select("call_id", F.date_format("imported_at", "yyyy-MM-dd").alias("day"))


@query("ref_latest_call", "SELECT call_id, search_text FROM calls ORDER BY imported_at DESC, call_id LIMIT 1", "calls")
def latest(spark, d):
    return search.get_call(fixture(spark, d, "calls")).select("call_id", "search_text")


@query("ref_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, d):
    return recordings_source.content_hash(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "text").select("doc_id", "sha256")


def recordings(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.format_string("/in/%012d.wav", "doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("n_chars").alias("length"), F.lit(AS_OF).cast("timestamp_ntz").alias("modificationTime"))


IMPORTED = "SELECT doc_id, h, n_chars FROM (SELECT doc_id, sha256(text) AS h, n_chars, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) t WHERE rn = 1 AND h NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 3)"


@query("ref_import_new_calls", f"SELECT concat('20240120_000000_', substr(h, 1, 6)) AS call_id, printf('%012d.wav', doc_id) AS source_filename, h AS sha256, n_chars AS file_size_bytes, 'imported' AS current_state FROM ({IMPORTED}) t")
def import_calls(spark, d):
    r = recordings(spark, d)
    known = r.where(F.regexp_extract("path", r"(\d)\.wav$", 1) == "3").select("sha256")
    return ingest.import_new_calls(r, known, as_of()).select("call_id", "source_filename", "sha256", "file_size_bytes", "current_state")


@query("ref_dedupe_first", "SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents GROUP BY sha256(text)")
def dedupe(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return ingest.dedupe_first(docs, "sha256", "doc_id")


@query(
    "ref_stable_files",
    "SELECT concat('f', CAST(user_id % 40 AS VARCHAR)) AS path FROM events GROUP BY 1 HAVING count(*) >= 4 AND count(DISTINCT CASE WHEN user_id % 40 < 20 THEN 1 ELSE event_id % 2 END) = 1",
)
def stable(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    u = F.col("user_id") % 40
    snaps = e.select(F.concat(F.lit("f"), u.cast("string")).alias("path"), F.when(u < 20, 1).otherwise(F.col("event_id") % 2).alias("length"), F.lit(0).alias("mtime"), F.col("ts").alias("observed_at"))
    return ingest.stable_files(snaps)


@query("ref_archive_partition", "SELECT call_id, strftime(imported_at, '%Y') AS year, strftime(imported_at, '%m') AS month, strftime(imported_at, '%d') AS day, concat(strftime(imported_at, '%Y/%m/%d'), '/call_', CAST(call_id AS VARCHAR)) AS archive_path FROM calls", "calls")
def partition(spark, d):
    return ingest.archive_partition(fixture(spark, d, "calls")).select("call_id", "year", "month", "day", "archive_path")


@query("ref_attach_audio_metadata", "SELECT doc_id AS call_id, 'wav' AS audio_format, CASE WHEN doc_id % 2 = 0 THEN round(n_chars / 1000.0, 3) END AS duration_seconds, CASE WHEN doc_id % 2 = 0 THEN 'audio_prepared' ELSE 'imported' END AS current_state FROM documents")
def audio(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    calls = docs.select(F.col("doc_id").alias("call_id"), F.format_string("rec.%d.WAV", "doc_id").alias("source_filename"), F.lit("imported").alias("current_state"))
    return ingest.attach_audio_metadata(calls, docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("call_id"), F.col("n_chars").alias("duration_ms"))).select("call_id", "audio_format", "duration_seconds", "current_state")


@query("ref_table_row_counts", "SELECT 'calls' AS table_name, count(*) AS n_rows FROM calls UNION ALL SELECT 'tasks', count(*) FROM tasks", "calls", "tasks")
def row_counts(spark, d):
    return ingest.table_row_counts({"calls": fixture(spark, d, "calls"), "tasks": tasks_of(spark, d)})


@query("ref_smallest_calls", "SELECT printf('/in/%012d.wav', doc_id) AS path, n_chars AS length FROM documents ORDER BY n_chars, doc_id LIMIT 10")
def smallest(spark, d):
    return compare.smallest_calls(recordings(spark, d).select("path", "length"), 10)


def jobs_of(spark, d):
    return fixture(spark, d, "jobs")


STALE = f"status = 'running' AND started_at IS NOT NULL AND started_at <= TIMESTAMP '{AS_OF}' - INTERVAL 300 SECOND"


@query("ref_stale_jobs", f"SELECT job_id, call_id FROM jobs WHERE {STALE}", "jobs")
def stale(spark, d):
    return jobs.stale_jobs(jobs_of(spark, d), as_of()).select("job_id", "call_id")


@query("ref_stale_resolution", f"SELECT job_id, CASE WHEN attempt_count < max_attempts THEN 'queued' ELSE 'failed' END AS status, '{AS_OF}' AS finished_at, 'Reclaimed stale running job after worker interruption' AS error_message, attempt_count FROM jobs WHERE {STALE}", "jobs")
def stale_resolution(spark, d):
    return jobs.stale_resolution(jobs_of(spark, d), as_of()).select("job_id", "status", stamp("finished_at").alias("finished_at"), "error_message", "attempt_count")


@query("ref_failure_resolution", "SELECT job_id, CASE WHEN priority > 0 AND attempt_count < max_attempts THEN 'queued' ELSE 'failed' END AS status, repeat('x', 2000) AS error_message FROM jobs WHERE status = 'failed'", "jobs")
def failure(spark, d):
    f = jobs_of(spark, d).where("status = 'failed'").withColumn("retryable", F.col("priority") > 0).withColumn("error", F.repeat(F.lit("x"), F.lit(2500)))
    return jobs.failure_resolution(f, as_of()).select("job_id", "status", "error_message")


@query("ref_retry_limit_lookup", "SELECT job_id, CASE stage WHEN 'transcription' THEN 2 WHEN 'analysis' THEN 3 ELSE 1 END AS retry_limit FROM jobs", "jobs")
def retry(spark, d):
    return jobs.retry_limit_lookup(jobs_of(spark, d), {"transcription": 2, "analysis": 3}).select("job_id", "retry_limit")


NEXT = "CASE stage WHEN 'audio_prepare' THEN 'transcription' WHEN 'transcription' THEN 'diarization' WHEN 'diarization' THEN 'transcript_clean' WHEN 'transcript_clean' THEN 'analysis' WHEN 'analysis' THEN 'indexing' END"


@query(
    "ref_next_stage_backlog",
    f"SELECT DISTINCT call_id, nxt AS stage FROM (SELECT call_id, {NEXT} AS nxt FROM jobs WHERE status = 'done') t WHERE nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.call_id = t.call_id AND j.stage = t.nxt AND j.status IN ('queued', 'running') AND j.call_id % 3 <> 0)",
    "jobs",
)
def backlog(spark, d):
    j = jobs_of(spark, d)
    return jobs.next_stage_backlog(j.where("not (call_id % 3 = 0 and status in ('queued', 'running'))"))


@query("ref_exclude_active", "SELECT call_id, count(*) AS n FROM jobs t WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.call_id = t.call_id AND j.stage = t.stage AND j.status = 'running' AND j.priority = 0) GROUP BY call_id", "jobs")
def active(spark, d):
    j = jobs_of(spark, d)
    return jobs.exclude_active(j, j.where("status = 'running' and priority = 0")).groupBy("call_id").agg(F.count(F.lit(1)).alias("n"))


AFTER = "CASE stage WHEN 'audio_prepare' THEN 'audio_prepared' WHEN 'transcription' THEN 'transcribed' WHEN 'diarization' THEN 'diarized' WHEN 'transcript_clean' THEN 'transcript_clean' WHEN 'analysis' THEN 'analyzed' ELSE 'indexed' END"


@query("ref_call_state_from_events", f"""SELECT call_id, arg_max(CASE WHEN event = 'failed' THEN 'failed' ELSE {AFTER} END, "at") AS state, coalesce(array_to_string(list(error ORDER BY "at", event_id) FILTER (WHERE event = 'failed'), '|'), '') AS errors FROM ev WHERE event IN ('finished', 'failed') GROUP BY call_id""", "ev")
def call_state(spark, d):
    return jobs.call_state_from_events(fixture(spark, d, "ev")).withColumn("errors", F.array_join("errors", "|"))


@query(
    "ref_transition_violations",
    f"""SELECT call_id, event_id, previous, state FROM (SELECT call_id, event_id, {AFTER} AS state, lag({AFTER}) OVER (PARTITION BY call_id ORDER BY "at", event_id) AS previous FROM ev WHERE event = 'finished') t
    WHERE previous IS NOT NULL AND concat(previous, '>', state) NOT IN ('imported>audio_prepared', 'audio_prepared>transcribed', 'transcribed>diarized', 'diarized>analyzed', 'diarized>transcript_clean', 'transcript_clean>analyzed', 'analyzed>indexed', 'indexed>reviewed')""",
    "ev",
)
def violations(spark, d):
    return jobs.transition_violations(fixture(spark, d, "ev"))


NEEDED = "SELECT 'audio_prepared' AS state, 'audio_original' AS kind UNION ALL SELECT 'transcribed', 'audio_normalized' UNION ALL SELECT 'diarized', 'transcript_raw' UNION ALL SELECT 'analyzed', 'transcript_segments' UNION ALL SELECT 'indexed', 'summary' UNION ALL SELECT 'indexed', 'tasks'"


@query(
    "ref_missing_preconditions",
    f"""SELECT e.call_id, e.state, n.kind, count(*) AS n FROM (SELECT call_id, {AFTER} AS state FROM ev WHERE event = 'finished') e JOIN ({NEEDED}) n ON e.state = n.state
    WHERE NOT (n.kind <> 'summary' AND e.call_id % 3 = 0) GROUP BY 1, 2, 3""",
    "ev",
)
def preconditions(spark, d):
    e = fixture(spark, d, "ev").where("event = 'finished'")
    states = e.select("call_id", F.expr(AFTER).alias("state"))
    there = e.where("call_id % 3 = 0").select("call_id", F.explode(F.array(*map(F.lit, ("metadata", "audio_original", "audio_normalized", "transcript_raw", "transcript_segments", "tasks")))).alias("kind"))
    return jobs.missing_preconditions(states, there).groupBy("call_id", "state", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("ref_ready_jobs_topk", "SELECT job_id, priority FROM jobs WHERE status = 'queued' ORDER BY priority DESC, available_at, job_id LIMIT 10", "jobs")
def topk(spark, d):
    return jobs.ready_jobs_topk(jobs_of(spark, d), 10).select("job_id", "priority")


@query("ref_job_list", "SELECT job_id, status FROM jobs WHERE status IN ('queued', 'running')", "jobs")
def job_list(spark, d):
    return jobs.job_list(jobs_of(spark, d), ("queued", "running")).select("job_id", "status")


ATTEMPTS = """SELECT *, count(*) FILTER (WHERE event = 'started') OVER (PARTITION BY call_id, stage ORDER BY "at", event_id) AS attempt FROM ev"""


@query("ref_job_attempts", f"SELECT event_id, attempt FROM ({ATTEMPTS}) t", "ev")
def attempts(spark, d):
    return jobs.job_attempts(fixture(spark, d, "ev")).select("event_id", "attempt")


@query(
    "ref_stage_durations",
    f"""SELECT call_id, stage, attempt, strftime(s, '%Y-%m-%d %H:%M:%S') AS started_at, CAST(floor((epoch_us(f) - epoch_us(s)) / 1000.0) AS BIGINT) AS duration_ms, error FROM (
      SELECT call_id, stage, attempt, min("at") FILTER (WHERE event = 'started') AS s, min("at") FILTER (WHERE event IN ('finished', 'failed')) AS f, arg_max(error, "at") FILTER (WHERE event = 'failed') AS error
      FROM ({ATTEMPTS}) t WHERE attempt > 0 GROUP BY call_id, stage, attempt) u""",
    "ev",
)
def durations(spark, d):
    e = fixture(spark, d, "ev").withColumn("at", F.col("at").cast("timestamp"))
    return jobs.stage_durations(e).select("call_id", "stage", "attempt", stamp("started_at").alias("started_at"), "duration_ms", "error")


@query("ref_build_search_text", rf"SELECT call_id, regexp_replace(concat(string_agg(text, chr(10) ORDER BY seg_idx), chr(10), chr(10), 'd', chr(10), chr(10)), '{EDGE}', '', 'g') AS search_text FROM seg GROUP BY call_id", "seg")
def search_text(spark, d):
    s = seg(spark, d).groupBy("call_id").agg(F.array_join(analysis.ordered(F.col("text"), F.col("seg_idx")), "\n").alias("clean"))
    return s.select("call_id", index.build_search_text(F.col("clean"), F.lit(None), F.lit("d"), F.lit(""), F.lit(None)).alias("search_text"))


def call_rows(spark, d, kind: str):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    old = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("call_id"), F.concat(F.lit("old"), F.col("doc_id").cast("string")).alias("sha256"), F.lit(1).alias("imported_at"), F.when(F.col("doc_id") % 2 == 0, 10).alias("recorded_at"), F.lit("indexed").alias("current_state"))
    new = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("call_id"), F.concat(F.lit("new"), F.col("doc_id").cast("string")).alias("sha256"), F.lit(2).alias("imported_at"), F.when(F.col("doc_id") % 4 == 0, 20).alias("recorded_at"), F.when(F.col("doc_id") % 5 != 0, F.lit("reviewed")).alias("current_state"))
    return old if kind == "old" else new


@query(
    "ref_upsert_calls",
    """SELECT doc_id AS call_id, concat(CASE WHEN doc_id % 3 <> 0 THEN 'old' ELSE 'new' END, CAST(doc_id AS VARCHAR)) AS sha256, CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 2 END AS imported_at,
    CASE WHEN doc_id % 2 = 0 AND doc_id % 4 = 0 THEN 20 WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN 10 END AS recorded_at,
    CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 5 <> 0 THEN 'reviewed' END ELSE 'indexed' END AS current_state FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0""",
)
def upsert(spark, d):
    return index.upsert_calls(call_rows(spark, d, "old"), call_rows(spark, d, "new"))


@query(
    "ref_upsert_changes",
    """SELECT doc_id AS call_id, concat(CASE WHEN doc_id % 3 <> 0 THEN 'old' ELSE 'first' END, CAST(doc_id AS VARCHAR)) AS sha256, CASE WHEN doc_id % 3 <> 0 THEN 1 WHEN doc_id % 4 = 0 THEN 3 ELSE 2 END AS imported_at,
    CASE WHEN doc_id % 6 = 0 THEN 21 WHEN doc_id % 2 = 0 THEN 20 WHEN doc_id % 3 <> 0 THEN 10 END AS recorded_at, CASE WHEN doc_id % 2 = 0 THEN 'second' ELSE 'indexed' END AS current_state FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0""",
)
def upsert_changes(spark, d):
    """Two changes of each even call, in one batch."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("call_id"))
    i = F.col("call_id")
    row = lambda df, at, sha, imported, recorded, state: df.select("call_id", F.concat(F.lit(sha), i.cast("string")).alias("sha256"), imported.alias("imported_at"), recorded.alias("recorded_at"), F.lit(state).alias("current_state"), F.lit(at).alias("at"))
    old = row(docs.where("call_id % 3 <> 0"), 0, "old", F.lit(1), F.lit(10), "indexed").drop("at")
    even = docs.where("call_id % 2 = 0")
    later = row(even, 2, "second", F.lit(3), F.when(i % 6 == 0, 21), "second")
    new = later.unionByName(row(even, 1, "first", F.when(i % 4 != 0, 2), F.lit(20), "first"))
    return index.upsert_calls(old, new, "at")


@query("ref_replace_tasks", "SELECT call_id, pos, kind FROM tasks WHERE call_id % 3 <> 0 UNION ALL SELECT call_id, pos, 'new' FROM tasks WHERE call_id % 3 = 0 AND pos % 4 = 1", "tasks")
def replace_tasks(spark, d):
    t = tasks_of(spark, d)
    new = t.where("call_id % 3 = 0 and pos % 4 = 1").withColumn("kind", F.lit("new"))
    return index.replace_tasks(t, new, t.where("call_id % 3 = 0")).select("call_id", "pos", "kind")


def artifacts(spark, d):
    return fixture(spark, d, "calls").select("call_id", F.sha2(F.concat_ws(":", F.col("call_id").cast("string"), F.lit("tasks")), 256).alias("artifact_id"), F.lit("tasks").alias("kind"), F.col("source_filename").alias("path"), F.date_format("imported_at", "yyyy-MM-dd").alias("created_at"))


@query("ref_replace_artifacts", "SELECT call_id, 'tasks' AS kind, source_filename AS path FROM calls WHERE call_id % 2 <> 0 UNION ALL SELECT call_id, 'analysis', 'p' FROM calls WHERE call_id % 4 = 0 UNION ALL SELECT call_id, 'audio', 'p' FROM calls WHERE call_id % 4 = 0", "calls")
def replace_artifacts(spark, d):
    a = artifacts(spark, d)
    listing = a.where("call_id % 4 = 0").select("call_id", F.explode(F.array(F.lit("analysis"), F.lit("audio"))).alias("kind"), F.lit("p").alias("path"), F.col("created_at").alias("imported_at"))
    return index.replace_artifacts(a, listing, a.where("call_id % 2 = 0")).select("call_id", "kind", "path")


@query("ref_rebuild_index", "SELECT arg_min(call_id, (imported_at, call_id)) AS call_id, sha256(search_text) AS sha256 FROM calls GROUP BY sha256(search_text)", "calls")
def rebuild(spark, d):
    c = fixture(spark, d, "calls")
    m = c.select("call_id", "imported_at", F.sha2(F.col("search_text").cast("binary"), 256).alias("sha256"), "low_confidence", F.array(F.lit("a")).alias("errors"))
    return index.rebuild_index(m, c.select("call_id", "search_text")).select("call_id", "sha256")


def reset_parts(spark, d):
    calls = fixture(spark, d, "calls").select("call_id", "current_state", F.lit("reviewed").alias("review_state"), "search_text", F.lit("e").alias("last_error"))
    requests = calls.where("call_id % 10 = 0").select("call_id", F.lit("cloud").alias("provider"), F.lit("m").alias("model"))
    kinds = F.explode(F.array(*map(F.lit, ("metadata", "audio_normalized", "transcript_raw", "transcript_segments", "transcript_clean", "summary", "tasks", "tasks_reviewed", "processing_log"))))
    every = artifacts(spark, d).withColumn("kind", kinds)
    return index.invalidate_downstream(requests, calls, jobs_of(spark, d), tasks_of(spark, d), every, as_of())


@query("ref_reset_calls", "SELECT call_id, CASE WHEN call_id % 10 = 0 THEN 'audio_prepared' ELSE current_state END AS current_state, CASE WHEN call_id % 10 = 0 THEN 'pending' ELSE 'reviewed' END AS review_state, CASE WHEN call_id % 10 <> 0 THEN length(search_text) END AS n FROM calls", "calls")
def reset_calls(spark, d):
    return reset_parts(spark, d)["calls"].select("call_id", "current_state", "review_state", F.length("search_text").alias("n"))


@query(
    "ref_reset_jobs",
    "SELECT job_id, call_id, stage, status FROM jobs j WHERE NOT (stage <> 'audio_prepare' AND call_id % 10 = 0 AND call_id IN (SELECT call_id FROM calls)) UNION ALL SELECT concat(CAST(call_id AS VARCHAR), ':transcription'), call_id, 'transcription', 'queued' FROM calls WHERE call_id % 10 = 0",
    "jobs",
    "calls",
)
def reset_jobs(spark, d):
    return reset_parts(spark, d)["jobs"].select("job_id", "call_id", "stage", "status")


@query(
    "ref_reset_artifacts",
    """SELECT call_id, kind FROM (SELECT call_id, unnest(['metadata', 'audio_normalized', 'transcript_raw', 'transcript_segments', 'transcript_clean', 'summary', 'tasks', 'tasks_reviewed', 'processing_log']) AS kind FROM calls) t
    WHERE call_id % 10 <> 0 OR kind IN ('metadata', 'audio_normalized', 'tasks_reviewed', 'processing_log')""",
    "calls",
)
def reset_artifacts(spark, d):
    return reset_parts(spark, d)["artifacts"].select("call_id", "kind")


@query("ref_reset_tasks", "SELECT call_id, pos, task_id FROM tasks WHERE call_id % 10 <> 0 OR call_id NOT IN (SELECT call_id FROM calls)", "tasks", "calls")
def reset_tasks(spark, d):
    return reset_parts(spark, d)["tasks"].select("call_id", "pos", "task_id")


def metadata_of(spark, d):
    i = F.col("call_id")
    c = fixture(spark, d, "calls")
    return c.select(
        "call_id",
        "current_state",
        F.lit("reviewed").alias("review_state"),
        F.when(i % 4 == 0, F.struct(F.lit("cloud").alias("provider"), F.when(i % 8 == 0, "m").alias("model"))).alias("transcription_preference"),
        F.when(i % 5 == 0, F.create_map(F.lit("speaker_1"), F.lit("me"))).alias("speaker_mapping"),
        F.lit("2024-01-02").alias("speaker_mapping_reviewed_at"),
        F.lit("ui").alias("speaker_mapping_source"),
        F.array(F.lit("e1"), F.lit("e2")).alias("errors"),
    )


def requests_of(spark, d):
    choice = text.parse_model_choice(F.concat(F.lit("cloud:m:"), "source_filename"))
    return fixture(spark, d, "calls").where("call_id % 10 = 0").select("call_id", choice["provider"].alias("provider"), choice["model"].alias("model"))


@query(
    "ref_reset_metadata",
    """SELECT call_id, CASE WHEN call_id % 10 = 0 THEN 'audio_prepared' ELSE current_state END AS current_state, CASE WHEN call_id % 10 = 0 THEN 'pending' ELSE 'reviewed' END AS review_state,
    CASE WHEN call_id % 10 = 0 THEN concat('cloud:m:', source_filename) WHEN call_id % 8 = 0 THEN 'cloud:m' WHEN call_id % 4 = 0 THEN 'cloud' ELSE '' END AS choice, CASE WHEN call_id % 10 = 0 THEN 0 WHEN call_id % 5 = 0 THEN 1 ELSE -1 END AS n_mapping,
    CASE WHEN call_id % 10 <> 0 THEN '2024-01-02' END AS reviewed_at, CASE WHEN call_id % 10 = 0 THEN 'none' ELSE 'ui' END AS mapping_source, CASE WHEN call_id % 10 = 0 THEN 0 ELSE 2 END AS n_errors FROM calls""",
    "calls",
)
def reset_metadata(spark, d):
    m = index.reset_metadata(requests_of(spark, d), metadata_of(spark, d))
    choice = F.concat_ws(":", "transcription_preference.provider", "transcription_preference.model")
    return m.select("call_id", "current_state", "review_state", choice.alias("choice"), F.coalesce(F.size("speaker_mapping"), F.lit(-1)).alias("n_mapping"), F.col("speaker_mapping_reviewed_at").alias("reviewed_at"), F.col("speaker_mapping_source").alias("mapping_source"), F.size("errors").alias("n_errors"))


@query("ref_reset_log", f"SELECT call_id, 'retranscribe_requested' AS event, '{AS_OF}' AS at_time, 'cloud' AS provider, concat('m:', source_filename) AS model FROM calls WHERE call_id % 10 = 0", "calls")
def reset_log(spark, d):
    return index.reset_log(requests_of(spark, d), as_of()).withColumn("at_time", stamp("at")).drop("at")


def rebuilt(spark, d):
    c = fixture(spark, d, "calls").withColumn("call_id", F.col("call_id").cast("string"))
    m = c.select("call_id", "imported_at", F.sha2(F.col("search_text").cast("binary"), 256).alias("sha256"), "low_confidence", F.array(F.lit("a")).alias("errors"))
    t = tasks_of(spark, d).withColumn("call_id", F.col("call_id").cast("string")).drop("kind")
    listing = c.select("call_id", F.explode(F.array(F.lit("metadata"), F.lit("summary"))).alias("kind"), F.col("source_filename").alias("path"))
    return index.rebuild_all(m, c.select("call_id", "search_text"), t, t.where("pos % 4 = 1"), listing)


FIRSTS = "SELECT arg_min(call_id, (imported_at, CAST(call_id AS VARCHAR))) AS call_id, min(imported_at) AS imported_at FROM calls GROUP BY sha256(search_text)"


@query(
    "ref_rebuild_tasks",
    f"""SELECT CAST(call_id AS VARCHAR) AS call_id, pos, concat(CAST(call_id AS VARCHAR), ':', k, ':', task_id, CASE WHEN rn > 1 THEN concat(':', CAST(rn AS VARCHAR)) ELSE '' END) AS stored_id FROM (
      SELECT *, row_number() OVER (PARTITION BY call_id, k, task_id ORDER BY pos) AS rn FROM (SELECT call_id, pos, task_id, 'extracted' AS k FROM tasks UNION ALL SELECT call_id, pos, task_id, 'reviewed' FROM tasks WHERE pos % 4 = 1) u
      WHERE call_id IN (SELECT call_id FROM ({FIRSTS}) f)) t""",
    "tasks",
    "calls",
)
def rebuild_tasks(spark, d):
    return rebuilt(spark, d)["tasks"].select("call_id", "pos", "stored_id")


@query("ref_rebuild_artifacts", f"SELECT CAST(f.call_id AS VARCHAR) AS call_id, unnest(['metadata', 'summary']) AS kind, strftime(f.imported_at, '%Y-%m-%d') AS created FROM ({FIRSTS}) f", "calls")
def rebuild_artifacts(spark, d):
    return rebuilt(spark, d)["artifacts"].select("call_id", "kind", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("ref_patch_call_metadata", "SELECT call_id, CASE WHEN call_id % 3 = 0 THEN NULL ELSE source_filename END AS source_filename, CASE WHEN call_id % 3 = 0 THEN 'late' ELSE current_state END AS current_state FROM calls", "calls")
def patch(spark, d):
    c = fixture(spark, d, "calls").select("call_id", "source_filename", "current_state")
    p = c.where("call_id % 3 = 0")
    row = lambda seq, name, state, sets: p.select("call_id", F.lit(seq).alias("seq"), F.lit(name).cast("string").alias("source_filename"), F.lit(sets[0]).alias("set_source_filename"), F.lit(state).cast("string").alias("current_state"), F.lit(sets[1]).alias("set_current_state"))
    patches = row(1, "x", "early", (True, True)).unionByName(row(2, None, "late", (True, True))).unionByName(row(3, "unset", "unset", (False, False)))
    return index.patch_call_metadata(c, patches)


@query(
    "ref_call_detail",
    """SELECT c.call_id, coalesce(s.n, 0) AS n_segments, coalesce(t.n, 0) AS n_tasks, coalesce(s.clusters, '') AS clusters, CASE WHEN c.call_id % 8 = 0 THEN 'cloud:m' WHEN c.call_id % 4 = 0 THEN 'cloud:large-v3-turbo' ELSE 'local:large-v3-turbo' END AS selected_model, coalesce(e.n, 0) AS n_log,
      CASE WHEN c.call_id % 5 = 0 THEN 1 ELSE 0 END AS n_mapping, c.current_state AS state, CASE WHEN c.call_id % 2 = 0 THEN c.source_filename END AS short_summary, CASE WHEN c.call_id % 3 = 0 THEN length(c.search_text) ELSE 0 END AS n_text FROM calls c
    LEFT JOIN (SELECT call_id, count(*) AS n, string_agg(DISTINCT role, ',' ORDER BY role) AS clusters FROM seg GROUP BY call_id) s ON c.call_id = s.call_id
    LEFT JOIN (SELECT call_id, count(*) AS n FROM tasks GROUP BY call_id) t ON c.call_id = t.call_id
    LEFT JOIN (SELECT call_id, count(*) AS n FROM ev GROUP BY call_id) e ON c.call_id = e.call_id""",
    "calls",
    "seg",
    "tasks",
    "ev",
)
def detail(spark, d):
    return detail_digest(index.call_detail(*detail_parts(spark, d).values()))


def detail_parts(spark, d):
    s = seg(spark, d).withColumnRenamed("role", "speaker_cluster_id")
    t = tasks_of(spark, d)
    c = fixture(spark, d, "calls")
    return {
        "calls": c.select("call_id"),
        "segments": s,
        "tasks": t,
        "reviewed": t.where("pos % 4 = 1"),
        "events": fixture(spark, d, "ev"),
        "metadata": metadata_of(spark, d),
        "summaries": c.where("call_id % 2 = 0").select("call_id", F.col("source_filename").alias("short_summary")),
        "transcripts": c.where("call_id % 3 = 0").select("call_id", F.col("search_text").alias("clean_text")),
    }


def detail_digest(out):
    n = lambda c: F.size(c).cast("long")
    return out.select(
        "call_id",
        n("segments").alias("n_segments"),
        n("tasks").alias("n_tasks"),
        F.array_join("clusters", ",").alias("clusters"),
        "selected_model",
        n("log").alias("n_log"),
        F.size("speaker_mapping").alias("n_mapping"),
        F.col("metadata.current_state").alias("state"),
        F.col("summary.short_summary").alias("short_summary"),
        F.length("transcript_clean").alias("n_text"),
    )


@query("ref_call_detail_by_call", ORACLES["ref_call_detail"])
def detail_by_call(spark, d):
    """The same from tables laid out by call: eight inputs, no shuffle after the layout."""
    return detail_digest(index.call_detail(*laid_out(spark, detail_parts(spark, d)).values()))


def laid_out(spark, parts):
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch(spark, "by-call")
    tag = folder.rsplit("-", 1)[1]
    for name, df in parts.items():
        layout.save_by_call(df, f"{name}_{tag}", f"{folder}/{name}", buckets)
    return {name: layout.by_call(spark, f"{name}_{tag}") for name in parts}


def mapping_saved(spark, d):
    """Forms of every second call, two for those divisible by four; the earlier one is overruled."""
    forms = role_forms(spark, d).where("call_id % 2 = 0")
    early = forms.where("call_id % 4 = 0").withColumns({"seq": F.lit(1), "roles": F.array(F.lit("other"), F.lit("other"), F.lit("other"))})
    forms = forms.withColumn("seq", F.lit(2)).unionByName(early)
    s = labelled(spark, d).withColumn("speaker_label", F.col("speaker_cluster_id"))
    c = fixture(spark, d, "calls").select("call_id", "search_text", "current_state")
    texts = c.select("call_id", F.lit("s").alias("short"), F.when(F.col("call_id") % 3 == 0, "d").alias("detailed"), F.lit("").alias("tasks"), F.lit("r").alias("reviewed"))
    return mapping.save_speaker_mapping(forms, metadata_of(spark, d), s, texts, c, as_of())


MAPPED = f"""SELECT call_id, seg_idx, text, start_sec, CASE WHEN call_id % 2 <> 0 THEN cluster WHEN cluster = 'speaker_1' THEN CASE WHEN call_id % 3 = 0 THEN 'unknown' ELSE 'me' END ELSE 'other' END AS cluster FROM ({ALIGNED}) a"""


@query("ref_save_mapping_segments", f"SELECT call_id, seg_idx, cluster AS speaker_label FROM ({MAPPED}) m", "seg", "tur")
def save_mapping_segments(spark, d):
    return mapping_saved(spark, d)["segments"].select("call_id", "seg_idx", "speaker_label")


@query("ref_save_mapping_transcripts", f"SELECT s.call_id, coalesce(t.text, '') AS clean_text FROM (SELECT DISTINCT call_id FROM seg WHERE call_id % 2 = 0) s LEFT JOIN (SELECT call_id, string_agg({LINE}, chr(10) ORDER BY seg_idx) AS text FROM ({MAPPED}) m GROUP BY call_id) t ON s.call_id = t.call_id", "seg", "tur")
def save_mapping_transcripts(spark, d):
    return mapping_saved(spark, d)["transcripts"].select("call_id", "clean_text")


@query(
    "ref_save_mapping_calls",
    rf"""SELECT c.call_id, c.current_state, CASE WHEN f.call_id IS NULL THEN c.search_text ELSE regexp_replace(concat(coalesce(t.text, ''), chr(10), 's', chr(10), CASE WHEN c.call_id % 3 = 0 THEN 'd' ELSE '' END, chr(10), chr(10), 'r'), '{EDGE}', '', 'g') END AS search_text
    FROM calls c LEFT JOIN (SELECT DISTINCT call_id FROM seg WHERE call_id % 2 = 0) f ON c.call_id = f.call_id
    LEFT JOIN (SELECT call_id, string_agg({LINE}, chr(10) ORDER BY seg_idx) AS text FROM ({MAPPED}) m GROUP BY call_id) t ON c.call_id = t.call_id""",
    "seg",
    "tur",
    "calls",
)
def save_mapping_calls(spark, d):
    return mapping_saved(spark, d)["calls"]


@query(
    "ref_save_mapping_metadata",
    f"""SELECT c.call_id, CASE WHEN f.call_id IS NOT NULL THEN 2 WHEN c.call_id % 5 = 0 THEN 1 ELSE -1 END AS n_mapping, CASE WHEN f.call_id IS NOT NULL THEN '{AS_OF}' ELSE '2024-01-02' END AS reviewed_at, 'ui' AS mapping_source, current_state
    FROM calls c LEFT JOIN (SELECT DISTINCT call_id FROM seg WHERE call_id % 2 = 0) f ON c.call_id = f.call_id""",
    "seg",
    "calls",
)
def save_mapping_metadata(spark, d):
    m = mapping_saved(spark, d)["metadata"]
    return m.select("call_id", F.coalesce(F.size("speaker_mapping"), F.lit(-1)).alias("n_mapping"), F.col("speaker_mapping_reviewed_at").alias("reviewed_at"), F.col("speaker_mapping_source").alias("mapping_source"), "current_state")


@query(
    "ref_save_mapping_log",
    f"""SELECT call_id, seq, 'speaker_mapping_saved' AS event, '{AS_OF}' AS at_time, CASE WHEN seq = 1 THEN 'other' WHEN call_id % 3 = 0 THEN 'unknown' ELSE 'me' END AS first_role, 'other' AS second_role
    FROM (SELECT DISTINCT call_id FROM seg WHERE call_id % 2 = 0) f, (SELECT 1 AS seq UNION ALL SELECT 2) n WHERE seq = 2 OR call_id % 4 = 0""",
    "seg",
)
def save_mapping_log(spark, d):
    return mapping_saved(spark, d)["log"].select("call_id", "seq", "event", stamp("at").alias("at_time"), F.col("mapping")["speaker_1"].alias("first_role"), F.col("mapping")["speaker_2"].alias("second_role"))


def runs(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    i = F.col("doc_id")
    ok = i % 3 != 0
    return docs.select(
        "source",
        i.alias("run_id"),
        F.concat(F.lit("f"), F.floor(i / 3).cast("string")).alias("file"),
        F.concat(F.lit("m"), (i % 3).cast("string")).alias("model_name"),
        F.when(i % 2 == 0, "local").otherwise("cloud").alias("provider"),
        ok.alias("ok"),
        F.when(i % 5 == 0, "").otherwise(F.col("lang")).alias("language"),
        (i % 8 * 0.5).cast("double").alias("elapsed_seconds"),
        F.when(ok, F.col("text")).alias("text"),
        F.when(~ok, F.lit("HTTP  error")).alias("error"),
        F.when(~ok, text.classify_failure(F.when(i % 2 == 0, "status").otherwise("timeout"), F.when(i % 4 == 0, 429).otherwise(404))).alias("failure_kind"),
    )


SQUASH = rf"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '{EDGE}', '', 'g')"
RUNS = rf"""SELECT concat('f', CAST(CAST(floor(doc_id / 3) AS BIGINT) AS VARCHAR)) AS file, CASE WHEN doc_id % 2 = 0 THEN 'local' ELSE 'cloud' END AS provider, concat('m', CAST(doc_id % 3 AS VARCHAR)) AS model_name, doc_id % 3 <> 0 AS ok,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS language, doc_id % 8 * CAST(0.5 AS DOUBLE) AS elapsed_seconds, text, CASE WHEN doc_id % 2 <> 0 THEN 'timeout' WHEN doc_id % 4 = 0 THEN 'rate_limit' ELSE 'api_validation' END AS kind, doc_id FROM documents"""


@query(
    "ref_model_comparison",
    f"""SELECT file, provider, model_name, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status, coalesce(nullif(language, ''), 'unknown') AS language, elapsed_seconds, CASE WHEN ok THEN length(text) ELSE 0 END AS chars,
    CASE WHEN NOT ok THEN 'HTTP error' WHEN length({SQUASH}) > 240 THEN concat(substr({SQUASH}, 1, 237), '...') ELSE {SQUASH} END AS excerpt, CASE WHEN NOT ok THEN kind END AS failure_kind FROM ({RUNS}) r""",
)
def model_comparison(spark, d):
    return compare.model_comparison(runs(spark, d))


@query(
    "ref_report_lines",
    rf"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY doc_id) AS run_pos, concat(provider, ':', model_name) AS name, {SQUASH} AS flat FROM ({RUNS}) x),
    l AS (SELECT file, run_pos, unnest(list_filter([name, repeat('-', length(name)), concat('status: ', CASE WHEN ok THEN 'ok' ELSE 'failed' END), concat('language: ', coalesce(nullif(language, ''), 'unknown')),
      concat('elapsed_seconds: ', printf('%.2f', elapsed_seconds)), CASE WHEN doc_id % 4 = 1 THEN concat('input_path: /in/', CAST(doc_id AS VARCHAR)) END,
      CASE WHEN ok THEN concat('chars: ', CAST(length(text) AS VARCHAR)) ELSE concat('failure_kind: ', kind) END,
      CASE WHEN ok THEN concat('excerpt: ', CASE WHEN length(flat) > 240 THEN concat(substr(flat, 1, 237), '...') ELSE flat END) ELSE 'error: HTTP  error' END, ''], lambda e: e IS NOT NULL)) AS line,
      generate_subscripts(list_filter([1, 2, 3, 4, 5, CASE WHEN doc_id % 4 = 1 THEN 6 END, 7, 8, 9], lambda e: e IS NOT NULL), 1) - 1 AS line_no FROM r)
    SELECT file, run_pos, line_no, line FROM l
    UNION ALL SELECT file, 0, line_no, CASE line_no WHEN 0 THEN repeat('=', 80) WHEN 1 THEN file WHEN 2 THEN concat('File size bytes: ', CAST(n AS VARCHAR)) ELSE '' END
    FROM (SELECT concat('f', CAST(CAST(floor(doc_id / 3) AS BIGINT) AS VARCHAR)) AS file, max(n_chars) AS n FROM documents GROUP BY 1) f, (SELECT unnest([0, 1, 2, 3]) AS line_no) i""",
)
def report_lines(spark, d):
    sizes = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("run_id"), F.col("n_chars").alias("file_size_bytes"))
    path = F.when(F.col("run_id") % 4 == 1, F.concat(F.lit("/in/"), F.col("run_id").cast("string")))
    return compare.report_lines(runs(spark, d).join(sizes, "run_id").withColumn("input_path", path))


@query("ref_model_summary", f"SELECT provider, model_name, count(*) AS runs, count(*) FILTER (WHERE ok) AS ok_runs, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 2) AS ok_percent, avg(elapsed_seconds) AS mean_seconds FROM ({RUNS}) r GROUP BY 1, 2")
def model_summary(spark, d):
    return compare.model_summary(runs(spark, d)).withColumn("ok_percent", F.col("ok_percent").cast("double"))


@query("ref_model_matrix", f"SELECT file, max(length(text)) FILTER (WHERE ok AND model_name = 'm0') AS m0, max(length(text)) FILTER (WHERE ok AND model_name = 'm1') AS m1, max(length(text)) FILTER (WHERE ok AND model_name = 'm2') AS m2 FROM ({RUNS}) r GROUP BY file")
def model_matrix(spark, d):
    return compare.model_matrix(runs(spark, d), ["m0", "m1", "m2"])


@query(
    "ref_classify_failure",
    "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'transport' WHEN 1 THEN 'timeout' WHEN 2 THEN 'auth' WHEN 3 THEN 'auth' WHEN 4 THEN 'rate_limit' WHEN 5 THEN 'api_validation' ELSE 'unknown' END AS kind FROM documents",
)
def failure_kinds(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", (F.col("doc_id") % 8).cast("int").alias("i"))
    kind = F.get(F.array(*map(F.lit, ("connection", "timeout", "status", "status", "status", "status", "status", None))), F.col("i"))
    status = F.get(F.array(*map(F.lit, (None, None, 401, 403, 429, 422, 503, None))), F.col("i"))
    return docs.select("doc_id", text.classify_failure(kind, status).alias("kind"))


@query(
    "ref_provider_models",
    """SELECT doc_id AS call_id, CASE WHEN doc_id % 2 = 0 THEN 'cloud' ELSE 'local' END AS provider, CASE WHEN doc_id % 2 = 0 THEN 'whisper-1' WHEN doc_id % 3 = 0 THEN 'small' ELSE 'large-v3-turbo' END AS model FROM documents""",
)
def provider_models(spark, d):
    """Local runs of two models and cloud runs of two; local is preferred, by name of a model for every third call, and fails for even ones."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("call_id"))
    i = F.col("call_id")
    runs = F.explode(F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(m).alias("model")) for p, m in (("local", "small"), ("local", "large-v3-turbo"), ("cloud", "small"), ("cloud", "whisper-1"))]))
    ok = (i % 2 == 1) | (F.col("provider") == "cloud")
    a = docs.withColumn("r", runs).select("call_id", "r.*").withColumns({"ok": ok, "text": F.when(ok, "t"), "error": F.when(~ok, "E")})
    preferred = docs.select("call_id", F.lit("local").alias("provider"), F.when(i % 3 == 0, "small").alias("model"))
    return compare.first_successful_provider(a, preferred).select("call_id", "provider", "model")


@query(
    "ref_first_successful_provider",
    """SELECT call_id, CASE WHEN p_ok THEN 'local' WHEN c_ok THEN 'cloud' END AS provider, CASE WHEN NOT p_ok AND NOT c_ok THEN 'local: E; cloud: E' END AS error
    FROM (SELECT doc_id AS call_id, doc_id % 2 = 0 AS p_ok, doc_id % 3 = 0 AS c_ok FROM documents) t""",
)
def first_provider(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("call_id"))
    at = lambda p, ok: docs.select("call_id", F.lit(p).alias("provider"), ok.alias("ok"), F.when(ok, p).alias("text"), F.when(~ok, "E").alias("error"))
    a = at("local", F.col("call_id") % 2 == 0).unionByName(at("cloud", F.col("call_id") % 3 == 0)).unionByName(at("other", F.lit(True)))
    return compare.first_successful_provider(a, docs.withColumn("provider", F.lit("local"))).select("call_id", "provider", "error")


@query("ref_select_transcription_preference", "SELECT call_id, CASE WHEN call_id % 6 = 0 THEN 'cloud' ELSE 'local' END AS provider, CASE WHEN call_id % 2 = 0 THEN 'big' END AS model FROM calls", "calls")
def preference(spark, d):
    c = fixture(spark, d, "calls").select("call_id")
    p = c.where("call_id % 2 = 0").select("call_id", F.when(F.col("call_id") % 3 == 0, "cloud").otherwise("").alias("provider"), F.lit("big").alias("model"))
    return compare.select_transcription_preference(c, p).select("call_id", "provider", "model")


@query("ref_scalar_choices", "SELECT call_id, 'cloud' AS provider, concat('m:', source_filename) AS model, substr(search_text, 1, 500) AS sample, language AS hint, 'last' AS last_error FROM calls", "calls")
def scalars(spark, d):
    c = fixture(spark, d, "calls")
    choice = text.parse_model_choice(F.concat(F.lit("cloud:m:"), "source_filename"))
    return c.select("call_id", choice["provider"].alias("provider"), choice["model"].alias("model"), text.detection_sample(F.col("search_text")).alias("sample"), text.first_language_hint(F.array("language")).alias("hint"), text.last_error(F.array(F.lit("a"), F.lit("last"))).alias("last_error"))


@query("ref_translation_candidates", "SELECT call_id, language <> 'en' AND call_id % 10 > 7 AS needs_translation, language <> 'en' AND call_id % 10 = 8 AS translation_needed, length(CASE WHEN language <> 'en' AND call_id % 10 = 8 THEN concat(search_text, '!') ELSE search_text END) AS n FROM calls", "calls")
def translation(spark, d):
    c = fixture(spark, d, "calls").select("call_id", F.col("search_text").alias("text"), "language", ((F.col("call_id") % 10) / 10).cast("double").alias("confidence"))
    tr = c.where("call_id % 10 >= 8").select("call_id", F.when(F.col("call_id") % 10 == 8, F.concat("text", F.lit("!"))).otherwise("").alias("translation"))
    return analysis.translation_candidates(c, tr).select("call_id", "needs_translation", "translation_needed", F.length("text").alias("n"))


def payload():
    """JSON text in four forms, by call: good, a task without text, null tasks, malformed."""
    i = F.col("call_id") % 4
    good = F.to_json(F.struct(F.col("source_filename").alias("short_summary"), F.array(F.struct(F.lit("do it").alias("text"), F.col("source_filename").alias("owner"))).alias("tasks"), F.lit(0.75).alias("analysis_confidence"), F.when(F.col("call_id") % 8 == 0, "he").alias("analysis_language")))
    return F.when(i == 0, good).when(i == 1, F.lit('{"tasks":[{"owner":"z"}]}')).when(i == 2, F.lit('{"tasks":null}')).otherwise(F.lit("not json"))


@query("ref_parse_analysis_json", "SELECT call_id, call_id % 4 <> 0 AS fallback, CASE WHEN call_id % 4 = 0 THEN source_filename END AS short_summary, CASE WHEN call_id % 8 = 0 THEN 'he' WHEN call_id % 4 = 0 THEN 'unknown' END AS analysis_language, CASE WHEN call_id % 4 = 0 THEN CAST(0.75 AS DOUBLE) END AS analysis_confidence, CASE WHEN call_id % 4 = 0 THEN concat('task_0001:do it:', source_filename, ':task:new') END AS tasks FROM calls", "calls")
def analysis_json(spark, d):
    c = fixture(spark, d, "calls").withColumn("a", payloads.parse_analysis_json(payload()))
    one = F.transform("a.tasks", lambda t: F.concat_ws(":", t["task_id"], t["text"], t["owner"], t["type"], t["status"]))
    return c.select("call_id", F.col("a").isNull().alias("fallback"), "a.short_summary", "a.analysis_language", "a.analysis_confidence", F.array_join(one, "|").alias("tasks"))


@query("ref_action_items", "SELECT call_id, CASE WHEN call_id % 3 = 0 THEN 0 ELSE 2 END AS n_items, CASE WHEN call_id % 3 = 0 THEN '' ELSE 'a/me/friday/high/work/said so|b/Ann' END AS items, CASE WHEN call_id % 3 = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.625 AS DOUBLE) END AS mean_confidence FROM calls", "calls")
def action_items(spark, d):
    raw = F.when(F.col("call_id") % 3 == 0, "[broken").otherwise('[{"description":"a","responsible":"me","deadline":"friday","priority":"high","category":"work","confidence":0.75,"context":"said so"},{"description":"b","responsible":"Ann","deadline":null}]')
    c = fixture(spark, d, "calls").select("call_id", payloads.parse_action_items(raw).alias("items"))
    one = F.transform("items", lambda x: F.concat_ws("/", x["description"], x["responsible"], x["deadline"], x["priority"], x["category"], x["context"]))
    shown = c.select("call_id", F.size("items").alias("n_items"), F.array_join(one, "|").alias("items"))
    return analysis.mean_action_confidence(c).join(shown, "call_id").select("call_id", "n_items", "items", "mean_confidence")


@query("ref_insight_counts", "SELECT call_id, 'people' AS kind, 2 AS n FROM calls UNION ALL SELECT call_id, unnest(['projects', 'preferences', 'commitments', 'patterns']), 1 FROM calls WHERE call_id % 2 = 0", "calls")
def insights(spark, d):
    people = '"people":[{"name":"Ann","relationship":"friend","role":"","notes":""},{"name":"Bo"}]'
    more = ',"projects":[{"name":"p","status":"open"}],"preferences":[{"type":"t","description":"d","confidence":0.8}],"commitments":[{"description":"d","from_who":"me","to_who":"Ann"}],"events":[],"patterns":[{"observation":"o","confidence":0.7}]'
    raw = F.when(F.col("call_id") % 2 == 0, "{" + people + more + "}").otherwise("{" + people + "}")
    return analysis.insight_counts(fixture(spark, d, "calls").select("call_id", payloads.parse_insights(raw).alias("insights")))


@query("ref_call_summary_json", "SELECT call_id, source_filename AS outcome, '5 minutes' AS duration_estimate, 'me|Ann' AS participants, 'a|b' AS topics, 'business' AS call_type, 'casual' AS mood_tone, true AS follow_up FROM calls", "calls")
def call_summary(spark, d):
    said = '{"duration_estimate":"5 minutes","participants":["me","Ann"],"main_topics":["a","b"],"call_type":"business","mood_tone":"casual","follow_up_needed":true,"outcome":"'
    raw = F.concat(F.lit(said), "source_filename", F.lit('"}'))
    c = fixture(spark, d, "calls").select("call_id", payloads.parse_call_summary(raw).alias("s"))
    return c.select("call_id", "s.outcome", "s.duration_estimate", F.array_join("s.participants", "|").alias("participants"), F.array_join("s.main_topics", "|").alias("topics"), "s.call_type", "s.mood_tone", F.col("s.follow_up_needed").alias("follow_up"))


@query("ref_coalesce_transcript_keys", "SELECT doc_id AS call_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'unknown' END AS provider, 'unknown' AS model, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'unknown' END AS language FROM documents")
def transcript_keys(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    i = F.col("doc_id")
    t = docs.select(i.alias("call_id"), F.when(i % 2 == 0, F.col("source")).alias("provider"), F.lit(None).cast("string").alias("model"), F.when(i % 3 == 0, F.col("lang")).alias("language"))
    return segments.coalesce_transcript_keys(t)


@query(
    "ref_scan_recordings",
    """SELECT concat(CAST(doc_id AS VARCHAR), CASE doc_id % 4 WHEN 0 THEN '.wav' WHEN 1 THEN '.MP3' ELSE '.Flac' END) AS file, strlen(text) AS length, sha256(text) AS sha256
    FROM documents WHERE doc_id % 4 < 3 AND doc_id % 3 > 0""",
)
def scan(spark, d):
    """Every document as a file: suffixes of both cases, some not allowed, a third of them one folder deeper; listed, then hashed in chunks."""
    folder = scratch(spark, "recordings")
    i = F.col("doc_id")
    suffix = F.when(i % 4 == 0, ".wav").when(i % 4 == 1, ".MP3").when(i % 4 == 2, ".Flac").otherwise(".txt")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    archive.write_files(docs.select(F.concat(F.when(i % 3 == 0, "deeper/").otherwise(""), i.cast("string"), suffix).alias("name"), F.col("text").alias("body")), folder)
    found = recordings_source.hash_files(recordings_source.scan_recordings(spark, folder, content=False))
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", "sha256")


ARCHIVED = f"""SELECT CAST(call_id AS VARCHAR) AS call_id, source_filename, current_state, strftime(imported_at, '%Y-%m-%d') AS day, 'short ' || source_filename AS short_summary, language AS language_summary,
  strftime(imported_at, '%Y/%m/%d/call_') || CAST(call_id AS VARCHAR) AS folder, coalesce(n, 0) + CASE WHEN n IS NOT NULL AND call_id % 2 = 0 THEN 1 ELSE 0 END AS n_tasks,
  3 + CASE WHEN n IS NULL THEN 0 ELSE 1 END + CASE WHEN n IS NOT NULL AND call_id % 2 = 0 THEN 1 ELSE 0 END AS n_artifacts,
  sha256(regexp_replace(concat(coalesce(search_text, ''), chr(10), 'short ', source_filename, chr(10), chr(10), coalesce(texts, ''), chr(10), CASE WHEN n IS NOT NULL AND call_id % 2 = 0 THEN 'checked' ELSE '' END), '{EDGE}', '', 'g')) AS search_sha
FROM (SELECT c.*, t.n, t.texts FROM calls c JOIN (SELECT arg_min(call_id, (imported_at, CAST(call_id AS VARCHAR))) AS call_id FROM calls GROUP BY sha256(coalesce(search_text, ''))) f ON c.call_id = f.call_id
  LEFT JOIN (SELECT call_id, count(*) AS n, string_agg(text, ' ' ORDER BY pos) AS texts FROM tasks GROUP BY call_id) t ON t.call_id = c.call_id) own"""


# About so many calls, or an eighth of them, have their folders at a time; ranges of ids of a part.
PART_CALLS, ARCHIVE_PARTS, PART_RANGES = 20_000, 8, 8


def artifact_files(calls, extracted):
    """The artifacts of these calls and their tasks, as files(name, body). Texts go to their files without a shuffle."""
    folder = F.concat(F.date_format("imported_at", "yyyy/MM/dd"), F.lit("/call_"), F.col("call_id"), F.lit("/"))
    files = lambda df, bodies: df.select(F.explode(F.array(*[F.struct(F.concat(folder, F.lit(n)).alias("name"), b.alias("body")) for n, b in bodies.items()])).alias("f")).select("f.*")
    c = calls.withColumn("call_id", F.col("call_id").cast("string"))
    meta = F.to_json(F.struct("call_id", "source_filename", "imported_at", F.sha2(F.coalesce("search_text", F.lit("")).cast("binary"), 256).alias("sha256"), "current_state", "low_confidence", F.array(F.lit("e1"), F.lit("e2")).alias("errors")))
    summary = F.to_json(F.struct(F.concat(F.lit("short "), "source_filename").alias("short_summary"), F.lit("").alias("detailed_summary"), F.col("language").alias("analysis_language")))
    t = extracted.groupBy("call_id").agg(F.to_json(analysis.ordered(F.struct("task_id", "text", "status"), F.col("pos"))).alias("tasks")).join(calls.select("call_id", "imported_at"), "call_id")
    reviewed = F.when(F.col("call_id") % 2 == 0, F.lit('[{"task_id":"reviewed_a","text":"checked"}]'))
    of_calls = files(c, {"metadata.json": meta, "summary.json": summary, "transcript_clean.txt": F.coalesce("search_text", F.lit(""))})
    return of_calls.union(files(t, {"tasks.json": F.col("tasks"), "tasks_reviewed.json": reviewed})).where("body is not null")


@query("ref_rebuild_archive", ARCHIVED, "calls", "tasks")
def rebuild_archive(spark, d):
    """Every call as a folder of JSON and text artifacts, written by the executors; then the folders are walked and the index rebuilt from them.

    The folders are scratch and take many times the tables' size, as small files fill whole
    blocks. So they come in parts, and a part goes when it has been walked. A part is some
    ranges of call_id, apart from each other so that they lie in several input files.
    """
    c, t = fixture(spark, d, "calls").where("call_id is not null"), tasks_of(spark, d)
    parts = max(1, min(ARCHIVE_PARTS, -(-c.count() // PART_CALLS)))
    ranges = parts * PART_RANGES if parts > 1 else 1
    cuts = sorted(set(c.agg(F.percentile_approx("call_id", [i / ranges for i in range(1, ranges)])).first()[0])) if parts > 1 else []
    within = [(F.lit(True) if low is None else F.col("call_id") > low) & (F.lit(True) if high is None else F.col("call_id") <= high) for low, high in zip([None, *cuts], [*cuts, None], strict=True)]

    def roots():
        for one in filter(None, (within[i::parts] for i in range(parts))):
            own, of = c.where(reduce(or_, one)), t.where(reduce(or_, one))
            root = scratch(spark, "archive")
            archive.write_files(artifact_files(own, of), root)
            yield root
            archive.drop_folders(own.select(F.date_format("imported_at", "yyyy/MM/dd").alias("name")), root)

    parts = archive.rebuild_archive(spark, roots())
    n = lambda df, name: df.groupBy("call_id").agg(F.count(F.lit(1)).alias(name))
    calls = parts["calls"].withColumn("search_sha", F.sha2(F.col("search_text").cast("binary"), 256)).drop("search_text")
    calls = calls.join(n(parts["tasks"], "n_tasks"), "call_id", "left").join(n(parts["artifacts"], "n_artifacts"), "call_id", "left")
    return calls.select(
        "call_id", "source_filename", "current_state", F.date_format("imported_at", "yyyy-MM-dd").alias("day"), "short_summary", "language_summary",
        F.regexp_extract("archive_path", r"(\d{4}/\d\d/\d\d/call_[^/]+)$", 1).alias("folder"), F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"), "n_artifacts", "search_sha",
    )


@query("ref_artifact_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS call_id, text, lang, concat(source, '|ü') AS errors FROM documents")
def artifact_round_trip(spark, d):
    """Every document as a call's artifact, written as JSON lines to the shared folder and read back."""
    folder = scratch(spark, "artifacts")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select(F.col("doc_id").cast("string").alias("call_id"), "text", "lang", F.array("source", F.lit("ü")).alias("errors"))
    recordings_source.write_artifacts(rows, folder)
    back = recordings_source.read_artifacts(spark, folder, "call_id string, text string, lang string, errors array<string>", whole=False)
    return back.select("call_id", "text", "lang", F.array_join("errors", "|").alias("errors"))


@query("ref_append_events", "SELECT call_id, event, count(*) AS n, count(error) AS n_errors FROM ev GROUP BY call_id, event", "ev")
def append_events(spark, d):
    """The event log, appended in two parts and read back."""
    folder = scratch(spark, "events")
    e = fixture(spark, d, "ev").withColumns({"at": F.col("at").cast("timestamp"), "call_id": F.col("call_id").cast("string")})
    for part in (0, 1):
        recordings_source.append_events(e.where(F.col("event_id") % 2 == part), folder)
    return recordings_source.read_events(spark, folder).groupBy(F.col("call_id").cast("long").alias("call_id"), "event").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("n_errors"))
