"""Explicit schemas of the tables that the operators read and write."""

from __future__ import annotations

RAW_SEGMENT = "struct<start_sec:double,start:double,end_sec:double,end:double,text:string,confidence:double,avg_logprob:double,speaker:string>"
RAW_TRANSCRIPT = f"call_id string, provider string, model string, language string, text string, segments array<{RAW_SEGMENT}>"
SEGMENTS = "call_id string, seg_idx int, segment_id string, start_sec double, end_sec double, text string, confidence double, speaker string"
TURNS = "call_id string, turn_idx int, start_sec double, end_sec double, speaker_cluster_id string, confidence string"
# Keys of the payloads.
TASK = "struct<text:string,owner:string,type:string,status:string,deadline:string,confidence:double>"
ANALYSIS = f"struct<short_summary:string,detailed_summary:string,key_points:array<string>,decisions:array<string>,open_questions:array<string>,commitments:array<string>,analysis_confidence:double,analysis_language:string,tasks:array<{TASK}>>"
ACTION_ITEMS = "array<struct<description:string,responsible:string,deadline:string,priority:string,category:string,confidence:double,context:string>>"
INSIGHT_KINDS = ("people", "projects", "preferences", "commitments", "events", "patterns")
INSIGHTS = (
    "struct<people:array<struct<name:string,relationship:string,role:string,notes:string>>,"
    "projects:array<struct<name:string,status:string,deadline:string,priority:string>>,"
    "preferences:array<struct<type:string,description:string,confidence:double>>,"
    "commitments:array<struct<description:string,from_who:string,to_who:string,deadline:string>>,"
    "events:array<struct<description:string,date:string,type:string>>,"
    "patterns:array<struct<observation:string,confidence:double>>>"
)
CALL_SUMMARY = "struct<duration_estimate:string,participants:array<string>,main_topics:array<string>,call_type:string,mood_tone:string,outcome:string,follow_up_needed:boolean>"
METADATA = (
    "call_id string, source_filename string, source_path string, imported_at timestamp, recorded_at timestamp, file_size_bytes bigint, sha256 string, "
    "audio_format string, duration_seconds double, language_hints array<string>, current_state string, review_state string, low_confidence boolean, errors array<string>"
)
JOB_EVENTS = "event_id bigint, call_id string, stage string, event string, at timestamp, error string"

# Stages in order, roles, states after a stage, artifact names.
STAGES = ("audio_prepare", "transcription", "diarization", "transcript_clean", "analysis", "indexing")
ROLES = ("me", "other", "unknown")
ACTIVE = ("queued", "running")
STATE_AFTER = {
    "audio_prepare": "audio_prepared",
    "transcription": "transcribed",
    "diarization": "diarized",
    "transcript_clean": "transcript_clean",
    "analysis": "analyzed",
    "indexing": "indexed",
}
# Allowed steps of a call's state, with and without the state of the cleaning stage, and the artifacts that a state presupposes.
STATE_EDGES = (
    ("detected", "imported"),
    ("imported", "audio_prepared"),
    ("audio_prepared", "transcribed"),
    ("transcribed", "diarized"),
    ("diarized", "analyzed"),
    ("diarized", "transcript_clean"),
    ("transcript_clean", "analyzed"),
    ("analyzed", "indexed"),
    ("indexed", "reviewed"),
)
PRECONDITIONS = {
    "audio_prepared": ("audio_original",),
    "transcribed": ("audio_normalized",),
    "diarized": ("transcript_raw",),
    "analyzed": ("transcript_segments",),
    "indexed": ("summary", "tasks"),
}
