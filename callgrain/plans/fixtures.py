"""Call tables derived from the given tables, by SQL that reads the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SEG = """
SELECT conv_id AS call_id, turn AS seg_idx, role, text,
       sum(dur) OVER (PARTITION BY conv_id ORDER BY turn) - dur AS start_sec,
       sum(dur) OVER (PARTITION BY conv_id ORDER BY turn) AS end_sec
FROM (
  SELECT c.conv_id, c.turn, c.role,
         CASE WHEN (c.conv_id + c.turn) % 11 = 0 THEN '   ' ELSE concat(c.text, CASE (c.conv_id * 7 + c.turn) % 6
           WHEN 0 THEN '  We   need to send docs!!!' WHEN 1 THEN ' Agreed, I will call you tomorrow..' WHEN 2 THEN ' Can you review it??'
           WHEN 3 THEN '' WHEN 4 THEN ' we decided to wait' ELSE ' Let us follow up,, I promise' END) END AS text,
         CAST(0.25 AS DOUBLE) * (1 + length(c.text) % 40) AS dur
  FROM conversations c) t"""

TUR = f"""
SELECT call_id, seg_idx AS turn_idx, start_sec + CAST(0.5 AS DOUBLE) AS start_sec, end_sec + CAST(0.25 AS DOUBLE) AS end_sec,
       CASE WHEN seg_idx % 4 = 0 THEN 'speaker_1' ELSE 'speaker_2' END AS speaker_cluster_id,
       CASE WHEN seg_idx % 3 = 0 THEN '' ELSE 'high' END AS confidence
FROM ({SEG}) s WHERE seg_idx % 2 = 0 AND call_id % 5 <> 0"""

STAGE = "CASE {} WHEN 0 THEN 'audio_prepare' WHEN 1 THEN 'transcription' WHEN 2 THEN 'diarization' WHEN 3 THEN 'transcript_clean' WHEN 4 THEN 'analysis' ELSE 'indexing' END"

EVENTS = f"""
SELECT event_id, user_id AS call_id, {STAGE.format('event_id % 6')} AS stage,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'finished' ELSE 'started' END AS event,
       ts AS at, CASE WHEN event_type = 'error' THEN concat('E', CAST(event_id AS STRING)) END AS error
FROM events"""

JOBS = f"""
SELECT concat('j', CAST(event_id AS STRING)) AS job_id, user_id AS call_id, {STAGE.format('event_id % 6')} AS stage,
       CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'done' WHEN 3 THEN 'done' ELSE 'failed' END AS status,
       CAST(event_id % 3 AS INT) AS priority, CAST(event_id % 4 AS INT) AS attempt_count, 2 AS max_attempts,
       ts AS available_at, CASE WHEN event_id % 7 <> 0 THEN ts END AS started_at
FROM events"""

CALLS = """
SELECT doc_id AS call_id, source AS source_filename, text AS search_text, lang AS language, n_chars AS file_size_bytes,
       CAST('2024-01-01' AS DATE) + CAST(doc_id % 365 AS INT) AS imported_at,
       CASE WHEN doc_id % 3 = 0 THEN 'indexed' WHEN doc_id % 3 = 1 THEN 'reviewed' ELSE 'failed' END AS current_state,
       doc_id % 4 = 0 AS low_confidence
FROM documents"""

TASKS = f"""
SELECT call_id, concat('t', CAST(seg_idx % 3 AS STRING)) AS task_id, seg_idx AS pos, text, 'extracted' AS kind,
       CASE seg_idx % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'dismissed' ELSE 'edited' END AS status
FROM ({SEG}) s WHERE seg_idx % 2 = 1"""

TABLES = {"seg": SEG, "tur": TUR, "ev": EVENTS, "jobs": JOBS, "calls": CALLS, "tasks": TASKS}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table over the given folder."""
    sql = TABLES[name]
    base = {"seg": "conversations", "tur": "conversations", "tasks": "conversations", "ev": "events", "jobs": "events", "calls": "documents"}[name]
    return spark.sql(sql.replace(f"FROM {base}", f"FROM {{{base}}}"), **{base: spark.read.parquet(f"{sf_dir}/{base}.parquet")})


def with_tables(sql: str, *names: str) -> str:
    """DuckDB SQL that sees the derived tables by name."""
    own = ", ".join(f"{n} AS ({TABLES[n].replace(' AS STRING', ' AS VARCHAR')})" for n in names)
    return f"WITH {own} {sql}"
