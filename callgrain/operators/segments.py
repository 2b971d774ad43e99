"""Transcript segments: normalising, numbering, speaker alignment and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgrain.functions.text import is_blank, strip
from callgrain.schemas import ROLES


TIER = 64  # time buckets that a turn covers at most


def coalesce_transcript_keys(df: DataFrame) -> DataFrame:
    """Missing provider, model and language become `unknown`."""
    return df.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("provider", "model", "language")})


def synthesize_single_segment(df: DataFrame) -> DataFrame:
    """A transcript with text but without segments gets one segment [0, 0] holding the text."""
    kind = df.schema["segments"].dataType.elementType.simpleString()
    whole = F.array(F.from_json(F.to_json(F.struct(F.lit(0.0).alias("start_sec"), F.lit(0.0).alias("end_sec"), F.col("text").alias("text"))), kind))
    none = F.coalesce(F.size("segments") <= 0, F.lit(True)) & ~is_blank(F.col("text"))
    return df.withColumn("segments", F.when(none, whole).otherwise(F.col("segments")))


def normalize_raw_segments(df: DataFrame) -> DataFrame:
    """One row per non-blank segment of transcripts(call_id, segments), numbered over all of them, so that dropped blanks leave gaps.

    start_sec falls back to start, then 0; likewise for the end. Text is stripped. A stored
    confidence stays; one that isn't stored is avg_logprob.
    """
    fields = df.schema["segments"].dataType.elementType.names
    s = df.select("call_id", F.posexplode("segments").alias("seg_idx", "s"))
    time = lambda a, b: F.coalesce(F.col(f"s.{a}"), F.col(f"s.{b}"), F.lit(0.0))
    out = s.where(~is_blank(F.col("s.text"))).select(
        "call_id",
        "seg_idx",
        segment_id(F.col("seg_idx")).alias("segment_id"),
        time("start_sec", "start").alias("start_sec"),
        time("end_sec", "end").alias("end_sec"),
        strip(F.col("s.text")).alias("text"),
        F.coalesce(*[F.col(f"s.{c}") for c in ("confidence", "avg_logprob") if c in fields], F.lit(None).cast("double")).alias("confidence"),
        F.col("s.speaker").alias("speaker"),
    )
    return out


def segment_id(idx: Column) -> Column:
    return F.format_string("seg_%04d", idx + 1)


def number_segments(df: DataFrame, call: str = "call_id", order: str = "turn") -> DataFrame:
    """Number rows within a call in order, counting blanks, then drop blanks."""
    n = F.row_number().over(Window.partitionBy(call).orderBy(order))
    return df.withColumn("seg_idx", n - 1).where(~is_blank(F.col("text"))).withColumn("segment_id", segment_id(F.col("seg_idx")))


def flag_low_confidence(transcripts: DataFrame, reasons: DataFrame) -> DataFrame:
    """Per call: no segments, or the analysis gave a reason."""
    joined = transcripts.join(reasons.select("call_id", "reason"), "call_id", "left")
    flag = (F.coalesce(F.size("segments"), F.lit(0)) <= 0) | (F.coalesce("reason", F.lit("")) != "")
    return joined.select("call_id", flag.alias("low_confidence"))


def midpoint() -> Column:
    return F.when(F.col("end_sec") >= F.col("start_sec"), (F.col("start_sec") + F.col("end_sec")) / 2).otherwise(F.col("start_sec"))


def align_turns(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Give each segment(call_id, seg_idx, start_sec, end_sec, ...) a speaker from turns(call_id, turn_idx, start_sec, end_sec, speaker_cluster_id, confidence).

    The first turn in turn order that holds the segment's midpoint, both ends included;
    else the turn with the nearest end, ties to the earliest. Segments of calls without
    turns go to speaker_1 with confidence low. The join's pairs are bounded by segments x
    turns of one call; for calls of many hours use align_turns_bucketed.
    """
    t = turns.select("call_id", F.struct("turn_idx", "start_sec", "end_sec", "speaker_cluster_id", "confidence").alias("t"))
    mid = segments.withColumn("mid", midpoint()).select("call_id", "seg_idx", "mid")
    outside = ~((F.col("t.start_sec") <= F.col("mid")) & (F.col("mid") <= F.col("t.end_sec")))
    away = F.when(outside, F.least(F.abs(F.col("t.start_sec") - F.col("mid")), F.abs(F.col("t.end_sec") - F.col("mid")))).otherwise(0.0)
    best = mid.join(t, "call_id").groupBy("call_id", "seg_idx").agg(F.min_by("t", F.struct(outside, away, F.col("t.turn_idx"))).alias("t"))
    return _labelled(segments, best)


def _labelled(segments: DataFrame, best: DataFrame) -> DataFrame:
    out = segments.join(best, ["call_id", "seg_idx"], "left")
    confidence = F.when(F.col("t").isNull(), "low").otherwise(F.coalesce(F.nullif("t.confidence", F.lit("")), F.lit("medium")))
    return out.withColumn("speaker_cluster_id", F.coalesce("t.speaker_cluster_id", F.lit("speaker_1"))).withColumn("diarization_confidence", confidence).drop("t")


def align_turns_bucketed(segments: DataFrame, turns: DataFrame, seconds: float = 30.0) -> DataFrame:
    """As align_turns, with work linear in segments and turns.

    Turns are dealt over the time buckets they cover, and a segment meets those of its
    midpoint's bucket. Buckets have three widths, each TIER times the one before, and a
    turn uses the least width of which it covers TIER at most; a longer one, of a broken
    end time, say, has one bucket for the whole call. So no turn is dealt more than TIER + 1 times. The rest look up the nearest end before and the nearest start
    behind their midpoint, by two ordered windows over all of a call's times.
    """
    widths = [seconds * TIER**k for k in range(3)]
    bucket = lambda c, k: F.floor(c / widths[k])
    mid = segments.withColumn("mid", midpoint()).select("call_id", "seg_idx", "mid")
    t = turns.withColumn("t", F.struct("turn_idx", "start_sec", "end_sec", "speaker_cluster_id", "confidence")).select("call_id", "t")
    start, end = F.col("t.start_sec"), F.col("t.end_sec")
    covered, places = F.array(F.lit(-1).cast("bigint")), [F.struct(F.lit(3).alias("tier"), F.lit(-1).cast("bigint").alias("bucket"))]
    tier = F.lit(3)
    for k in (2, 1, 0):
        fits = end - start <= TIER * widths[k]
        tier = F.when(fits, k).otherwise(tier)
        covered = F.when(fits, F.sequence(bucket(start, k), bucket(end, k))).otherwise(covered)
        places.append(F.struct(F.lit(k).alias("tier"), bucket(F.col("mid"), k).alias("bucket")))
    spread = t.where("t.start_sec <= t.end_sec").withColumn("tier", tier).withColumn("bucket", F.explode(covered))
    met = mid.withColumn("p", F.explode(F.array(*places))).select("call_id", "seg_idx", "mid", "p.tier", "p.bucket")
    hit = met.join(spread, ["call_id", "tier", "bucket"]).where("t.start_sec <= mid and mid <= t.end_sec")
    inside = hit.groupBy("call_id", "seg_idx").agg(F.min_by("t", F.col("t.turn_idx")).alias("t"))
    rest = mid.join(inside, ["call_id", "seg_idx"], "left_anti")
    ends = t.select("call_id", F.explode(F.array("t.start_sec", "t.end_sec")).alias("at"), "t").groupBy("call_id", "at").agg(F.min_by("t", F.col("t.turn_idx")).alias("t"))
    line = rest.select("call_id", F.col("mid").alias("at"), F.lit(None).cast(ends.schema["t"].dataType).alias("t"), "seg_idx", "mid").unionByName(
        ends.select("call_id", "at", "t", F.lit(None).cast("int").alias("seg_idx"), F.lit(None).cast("double").alias("mid"))
    )
    point = F.when(F.col("t").isNotNull(), F.struct("at", "t"))
    w = Window.partitionBy("call_id")
    before = F.last(point, ignorenulls=True).over(w.orderBy("at", F.col("seg_idx").asc_nulls_first()))
    behind = F.last(point, ignorenulls=True).over(w.orderBy(F.desc("at"), F.col("seg_idx").asc_nulls_first()))
    looked = line.withColumn("before", before).withColumn("behind", behind).where("seg_idx is not null")
    db, da = F.abs(F.col("mid") - F.col("before.at")), F.abs(F.col("mid") - F.col("behind.at"))
    first = F.col("behind").isNull() | (db < da) | ((db == da) & (F.col("before.t.turn_idx") <= F.col("behind.t.turn_idx")))
    near = looked.where("before is not null or behind is not null").select("call_id", "seg_idx", F.when(F.col("before").isNotNull() & first, F.col("before.t")).otherwise(F.col("behind.t")).alias("t"))
    return _labelled(segments, inside.unionByName(near))


def single_speaker_fallback(segments: DataFrame, enabled: bool = True) -> DataFrame:
    """Every segment goes to speaker_1 with confidence low; nothing if the fallback is disabled."""
    out = segments.withColumn("speaker_cluster_id", F.lit("speaker_1")).withColumn("diarization_confidence", F.lit("low"))
    return out if enabled else out.where(F.lit(False))


def resolve_speaker_label(mapping: Column, cluster: Column, roles: tuple[str, ...] = ROLES) -> Column:
    """The mapped role, if it is one, else the cluster itself."""
    role = mapping[cluster]
    return F.when(role.isin(*roles), role).otherwise(cluster)


def apply_speaker_mapping(segments: DataFrame, mapping: DataFrame) -> DataFrame:
    """segments left-joined to mapping(call_id, mapping map): cluster is the first non-empty of cluster, label, speaker_1. Applying twice changes nothing."""
    cluster = F.coalesce(F.nullif("speaker_cluster_id", F.lit("")), F.nullif("speaker_label", F.lit("")), F.lit("speaker_1"))
    joined = segments.withColumn("speaker_cluster_id", cluster).join(mapping.select("call_id", "mapping"), "call_id", "left")
    return joined.withColumn("speaker_label", resolve_speaker_label(F.col("mapping"), F.col("speaker_cluster_id"))).drop("mapping")


def parse_role_mapping(df: DataFrame, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """df(call_id, clusters array, roles array): zip, keep valid roles, later duplicates win."""
    z = df.select("call_id", F.posexplode(F.arrays_zip(F.col("clusters").alias("cluster"), F.col("roles").alias("role"))).alias("pos", "z"))
    z = z.where(F.col("z.role").isin(*roles) & F.col("z.cluster").isNotNull())
    last = z.groupBy("call_id", F.col("z.cluster").alias("cluster")).agg(F.max_by("z.role", "pos").alias("role"))
    return last.groupBy("call_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cluster", "role")))).alias("mapping"))


def speaker_clusters(segments: DataFrame) -> DataFrame:
    """Sorted distinct non-empty clusters, or labels, of each call."""
    name = F.coalesce(F.nullif("speaker_cluster_id", F.lit("")), F.nullif("speaker_label", F.lit("")))
    return segments.groupBy("call_id").agg(F.sort_array(F.collect_set(name)).alias("clusters"))
