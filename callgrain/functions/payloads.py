"""JSON payloads of language models, decoded with explicit schemas and defaults.

A missing key and an explicit null get the same default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callgrain.schemas import ACTION_ITEMS, ANALYSIS, CALL_SUMMARY, INSIGHTS, TASK


def parse_analysis_json(payload: Column) -> Column:
    """Analysis bundle with defaults (tasks get their source by attach_task_source), or null where the whole call needs the fallback: malformed JSON, a task without text, or `tasks` set to null."""
    raw = F.from_json(payload, ANALYSIS, {"mode": "PERMISSIVE"})
    variant = F.try_parse_json(payload)
    tasks_null = F.coalesce(F.is_variant_null(F.try_variant_get(variant, "$.tasks", "variant")), F.lit(False))
    is_object = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    textless = F.exists(raw["tasks"], lambda t: t["text"].isNull())
    empty = F.array().cast("array<string>")
    strings = lambda k: F.coalesce(raw[k], empty).alias(k)
    text = lambda k, d: F.coalesce(raw[k], F.lit(d)).alias(k)
    tasks = F.transform(
        F.coalesce(raw["tasks"], F.array().cast(f"array<{TASK}>")),
        lambda t, i: F.struct(
            F.format_string("task_%04d", i + 1).alias("task_id"),
            t["text"].alias("text"),
            t["owner"].alias("owner"),
            F.coalesce(t["type"], F.lit("task")).alias("type"),
            F.coalesce(t["status"], F.lit("new")).alias("status"),
            t["deadline"].alias("deadline"),
            t["confidence"].alias("confidence"),
        ),
    )
    bundle = F.struct(
        text("short_summary", ""),
        text("detailed_summary", ""),
        strings("key_points"),
        strings("decisions"),
        strings("open_questions"),
        strings("commitments"),
        raw["analysis_confidence"].alias("analysis_confidence"),
        text("analysis_language", "unknown"),
        tasks.alias("tasks"),
    )
    return F.when(is_object & raw.isNotNull() & ~tasks_null & ~F.coalesce(textless, F.lit(False)), bundle)


def parse_action_items(payload: Column) -> Column:
    """Array of action items; empty for malformed JSON."""
    return F.coalesce(F.from_json(payload, ACTION_ITEMS), F.array().cast(ACTION_ITEMS))


def parse_insights(payload: Column) -> Column:
    return F.from_json(payload, INSIGHTS)


def parse_call_summary(payload: Column) -> Column:
    return F.from_json(payload, CALL_SUMMARY)
