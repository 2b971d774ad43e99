"""What saving the speaker roles of calls changes: metadata, segments, clean texts, logs, index rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.operators.analysis import build_clean_transcript
from callgrain.operators.index import build_search_text
from callgrain.operators.segments import apply_speaker_mapping, parse_role_mapping

SAVED, SOURCE = "speaker_mapping_saved", "ui"  # fixed values: the log's event, who mapped


def saved_mappings(forms: DataFrame) -> DataFrame:
    """forms(call_id, seq, clusters array, roles array): (call_id, mapping) of each call's last form by seq.

    Roles that are none are left out, so a form without a valid role gives an empty map,
    which takes earlier roles away. Of forms with equal seq the greatest counts.
    """
    last = forms.groupBy("call_id").agg(F.max(F.struct("seq", "clusters", "roles")).alias("f")).select("call_id", "f.clusters", "f.roles")
    valid = parse_role_mapping(last)
    kind = valid.schema["mapping"].dataType
    return last.select("call_id").join(valid, "call_id", "left").withColumn("mapping", F.coalesce("mapping", F.create_map().cast(kind)))


def save_speaker_mapping(forms: DataFrame, metadata: DataFrame, segments: DataFrame, texts: DataFrame, calls: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """The state after saving forms(call_id, seq, clusters, roles) at as_of.

    metadata: mapping, its time and source are new for calls with a form. segments: theirs
    have labels by the mapping; others stay as they are. transcripts(call_id, clean_text):
    the calls with a form, empty without segments. log(call_id, event, at, mapping): one
    entry a form, of its own roles. calls: index rows with search_text built from the new
    clean text and texts(call_id, short, detailed, tasks, reviewed). Forms of calls
    without metadata leave log and transcript only. Saving again with the same as_of
    changes nothing else.
    """
    m = saved_mappings(forms)
    fresh = {"speaker_mapping": F.col("_m"), "speaker_mapping_reviewed_at": as_of, "speaker_mapping_source": F.lit(SOURCE)}
    hit = metadata.join(m.select("call_id", F.col("mapping").alias("_m")), "call_id", "left")
    new = lambda c: F.when(F.col("_m").isNotNull(), fresh[c] if c == "speaker_mapping" else fresh[c].cast(metadata.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    own = segments.join(m.select("call_id"), "call_id", "left_semi")
    mapped = apply_speaker_mapping(own, m).select(*segments.columns)
    clean = m.select("call_id").join(build_clean_transcript(mapped).select("call_id", "clean_text"), "call_id", "left").withColumn("clean_text", F.coalesce("clean_text", F.lit("")))
    parts = clean.join(texts.select("call_id", "short", "detailed", "tasks", "reviewed"), "call_id", "left")
    search = parts.select("call_id", build_search_text(*map(F.col, ("clean_text", "short", "detailed", "tasks", "reviewed"))).alias("_text"))
    rows = calls.join(search, "call_id", "left")
    numbered = forms.withColumn("_id", F.struct("call_id", "seq", "clusters", "roles"))
    each = parse_role_mapping(numbered.select(F.col("_id").alias("call_id"), "clusters", "roles"))
    log = numbered.select(F.col("_id").alias("call_id")).join(each, "call_id", "left")
    return {
        "metadata": hit.select(*[new(c) if c in fresh else F.col(c) for c in metadata.columns]),
        "segments": segments.join(m.select("call_id"), "call_id", "left_anti").unionByName(mapped),
        "transcripts": clean,
        "log": log.select("call_id.call_id", "call_id.seq", F.lit(SAVED).alias("event"), as_of.alias("at"), F.coalesce("mapping", F.create_map().cast(each.schema["mapping"].dataType)).alias("mapping")),
        "calls": rows.select(*[F.coalesce("_text", "search_text").alias(c) if c == "search_text" else F.col(c) for c in calls.columns]),
    }
