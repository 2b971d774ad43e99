"""Scalar text functions, all built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a task, a decision, a commitment.
TASK_MARKERS = ("need to", "should", "will", "follow up", "send", "call", "review")
DECISION = r"(?iU)\b(decided|agreed|confirm)\b"
COMMITMENT = r"(?iU)\b(i will|we will|promise)\b"


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Strip, squash white space, then squash repeats of one mark among ? . ! ,"""
    return F.regexp_replace(F.regexp_replace(strip(c), r"(?U)\s+", " "), r"([?.!,])\1+", "$1")


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)\S")


def render_line(start: Column, label: Column, text: Column) -> Column:
    """`[SSSS.ss] LABEL: text`. Half-way cases round up, where binary rounding may not."""
    shown = F.upper(F.replace(label, F.lit("speaker_"), F.lit("speaker ")))
    return F.concat(F.lit("["), F.format_string("%07.2f", start), F.lit("] "), shown, F.lit(": "), clean_text(text))


def is_task_candidate(c: Column, markers: tuple[str, ...] = TASK_MARKERS) -> Column:
    low, out = F.lower(c), F.lit(False)
    for m in markers:
        out = out | F.contains(low, F.lit(m))
    return out


def is_decision(c: Column) -> Column:
    return c.rlike(DECISION)


def is_question(c: Column) -> Column:
    return F.contains(c, F.lit("?"))


def is_commitment(c: Column) -> Column:
    return c.rlike(COMMITMENT)


def excerpt(c: Column, limit: int = 240) -> Column:
    """Squash white space; longer texts end in three dots, within the limit."""
    flat = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit - 3)), F.lit("..."))).otherwise(flat)


def truncate_error(c: Column, limit: int = 2000) -> Column:
    return F.left(c, F.lit(limit))


def parse_model_choice(c: Column) -> Column:
    """`provider:model`, split at the first colon; no colon leaves the model null."""
    parts = F.split(c, ":", 2)
    return F.struct(F.get(parts, 0).alias("provider"), F.get(parts, 1).alias("model"))


def classify_failure(error_type: Column, status: Column) -> Column:
    """Failure kind from the error's class and status."""
    return (
        F.when(error_type == "connection", "transport")
        .when(error_type == "timeout", "timeout")
        .when(status.isin(401, 403), "auth")
        .when(status == 429, "rate_limit")
        .when((status >= 400) & (status < 500), "api_validation")
        .otherwise("unknown")
    )


def first_language_hint(hints: Column) -> Column:
    return F.try_element_at(hints, F.lit(1))


def last_error(errors: Column) -> Column:
    return F.try_element_at(errors, F.lit(-1))


def detection_sample(text: Column, n: int = 500) -> Column:
    return F.substring(text, 1, n)
