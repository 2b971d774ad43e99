"""Transcription runs: choosing and comparing models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgrain.functions.text import excerpt


def select_transcription_preference(calls: DataFrame, preferences: DataFrame, default: str = "local") -> DataFrame:
    """Provider and model per call: its preference, else the default provider; the model may be null."""
    j = calls.join(preferences.select("call_id", "provider", "model"), "call_id", "left")
    return j.withColumn("provider", F.coalesce(F.nullif("provider", F.lit("")), F.lit(default))).withColumn("model", F.nullif("model", F.lit("")))


#: The providers' own models.
DEFAULT_MODELS = {"local": "large-v3-turbo", "cloud": "whisper-1"}


def first_successful_provider(
    attempts: DataFrame, preferred: DataFrame, fallback: str = "cloud", cloud_enabled: bool = True, models: dict[str, str] = DEFAULT_MODELS
) -> DataFrame:
    """attempts(call_id, provider, ok, text, error) tried in order: preferred(call_id, provider), then the fallback. First success wins; otherwise the errors, joined.

    A provider that is neither is never tried; `cloud` only if enabled. Where attempts
    have a column `model`, only those by the chosen model count: the preferred provider
    uses the model in preferred(call_id, provider, model), if there is one; the fallback,
    and a preference without a model, use the provider's own.
    """
    chosen = F.col("model") if "model" in preferred.columns else F.lit(None).cast("string")
    p = preferred.select("call_id", F.col("provider").alias("_p"), chosen.alias("_m"))
    a = attempts.join(p, "call_id")
    rank = F.when(F.col("provider") == F.col("_p"), 0).when(F.col("provider") == fallback, 1)
    a = a.withColumn("rank", rank).where(F.col("rank").isNotNull())
    if not cloud_enabled:
        a = a.where("provider <> 'cloud'")
    if "model" in attempts.columns:
        own = F.coalesce(*[F.when(F.col("provider") == k, v) for k, v in models.items()])
        a = a.where(F.col("model") == F.coalesce(F.when(F.col("rank") == 0, F.nullif("_m", F.lit(""))), own))
    else:
        a = a.withColumn("model", F.lit(None).cast("string"))
    best = F.min_by(F.struct("provider", "model", "text"), F.when(F.col("ok"), F.col("rank")))
    errors = F.transform(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.struct("rank", F.concat_ws(": ", "provider", "error").alias("e"))))), lambda x: x["e"])
    g = a.groupBy("call_id").agg(best.alias("b"), F.bool_or("ok").alias("ok"), errors.alias("errors"))
    won = F.col("ok")
    return g.select("call_id", F.when(won, F.col("b.provider")).alias("provider"), F.when(won, F.col("b.model")).alias("model"), F.when(won, F.col("b.text")).alias("text"), F.when(~won, F.array_join("errors", "; ")).alias("error"))


def model_comparison(runs: DataFrame) -> DataFrame:
    """One line per run: status, language, seconds, characters, excerpt, failure kind."""
    ok = F.col("ok")
    return runs.select(
        "file",
        "provider",
        "model_name",
        F.when(ok, "ok").otherwise("failed").alias("status"),
        F.coalesce(F.nullif("language", F.lit("")), F.lit("unknown")).alias("language"),
        "elapsed_seconds",
        F.length(F.coalesce("text", F.lit(""))).alias("chars"),
        excerpt(F.when(ok, F.coalesce("text", F.lit(""))).otherwise(F.coalesce("error", F.lit("")))).alias("excerpt"),
        F.when(~ok, F.coalesce("failure_kind", F.lit("unknown"))).alias("failure_kind"),
    )


def report_lines(runs: DataFrame, order: str = "run_id") -> DataFrame:
    """The text report of runs as rows: (file, run_pos, line_no, line), to be read in that order.

    runs also has `file_size_bytes` and `input_path` (null: no such line). A file's own
    lines have run_pos 0, its runs are numbered from 1 by `order`. Unlike the comparison,
    a failed run's error stands whole, apart from its kind. Files are ordered by name.
    """
    ok, text = F.col("ok"), F.coalesce("text", F.lit(""))
    name = F.concat_ws(":", F.coalesce("provider", F.lit("")), F.coalesce("model_name", F.lit("")))
    line = lambda label, value: F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit("")))
    some = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    own = F.array(
        name,
        F.repeat(F.lit("-"), F.length(name)),
        line("status", F.when(ok, "ok").otherwise("failed")),
        line("language", some("language", "unknown")),
        line("elapsed_seconds", F.format_string("%.2f", F.coalesce("elapsed_seconds", F.lit(0.0)))),
        F.when(F.col("input_path") != "", line("input_path", F.col("input_path"))),
    )
    good = F.array(line("chars", F.length(text)), line("excerpt", excerpt(text)))
    bad = F.array(line("failure_kind", some("failure_kind", "unknown")), line("error", F.col("error")))
    lines = F.array_compact(F.concat(own, F.when(ok, good).otherwise(bad), F.array(F.lit(""))))
    n = F.row_number().over(Window.partitionBy("file").orderBy(order)).alias("run_pos")
    body = runs.select("file", n, lines.alias("lines"))
    heads = runs.groupBy("file").agg(F.max("file_size_bytes").alias("n"))
    top = heads.select("file", F.lit(0).alias("run_pos"), F.array(F.repeat(F.lit("="), F.lit(80)), F.coalesce("file", F.lit("")), line("File size bytes", F.col("n")), F.lit("")).alias("lines"))
    return body.unionByName(top).select("file", "run_pos", F.posexplode("lines").alias("line_no", "line"))


def model_summary(runs: DataFrame) -> DataFrame:
    """Runs, share of successes and mean seconds of each model."""
    return runs.groupBy("provider", "model_name").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("ok").alias("ok_runs"), F.round(100.0 * F.count_if("ok") / F.count(F.lit(1)), 2).alias("ok_percent"), F.avg("elapsed_seconds").alias("mean_seconds")
    )


def model_matrix(runs: DataFrame, models: list[str]) -> DataFrame:
    """Characters of each file's transcript by model; the models are named, so no extra pass finds them."""
    return runs.groupBy("file").pivot("model_name", models).agg(F.max(F.when(F.col("ok"), F.length("text"))))


def smallest_calls(recordings: DataFrame, k: int) -> DataFrame:
    """The k smallest files by size and path."""
    return recordings.orderBy("length", "path").limit(k)
