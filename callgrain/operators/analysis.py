"""Clean transcripts, call signals and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgrain.functions.text import is_commitment, is_decision, is_question, is_task_candidate, render_line
from callgrain.schemas import INSIGHT_KINDS

#: Fixed values.
NO_CONTENT = "No transcript content available."
FALLBACK_LANGUAGE, FALLBACK_REASON = "mixed", "deterministic fallback analysis"


def ordered(value: Column, order: Column, keep: Column | None = None) -> Column:
    """Aggregate: array of values in order, of the rows where keep holds."""
    pair = F.struct(order.alias("o"), value.alias("v"))
    return F.transform(F.sort_array(F.collect_list(F.when(keep, pair) if keep is not None else pair)), lambda x: x["v"])


def cap_per_call(values: Column, n: int) -> Column:
    return F.slice(values, 1, n)


def build_clean_transcript(segments: DataFrame) -> DataFrame:
    """One text per call: rendered lines in segment order."""
    line = render_line(F.col("start_sec"), F.coalesce(F.nullif("speaker_label", F.lit("")), F.col("speaker_cluster_id"), F.lit("unknown")), F.col("text"))
    return segments.groupBy("call_id").agg(ordered(line, F.col("seg_idx")).alias("lines")).select("call_id", "lines", F.array_join("lines", "\n").alias("clean_text"))


def call_signals(segments: DataFrame) -> DataFrame:
    """Per call, on uncleaned text: first ten decisions, questions and commitments, and every task candidate as a struct."""
    t, i = F.col("text"), F.col("seg_idx")
    task = F.struct(
        number_tasks(i).alias("task_id"),
        t.alias("text"),
        F.lit("unknown").alias("owner"),
        F.lit("task").alias("type"),
        F.col("start_sec").alias("source_timestamp"),
        t.alias("source_quote"),
        F.lit("new").alias("status"),
        F.lit(0.5).alias("confidence"),
    )
    rules = {"decisions": is_decision(t), "open_questions": is_question(t), "commitments": is_commitment(t)}
    said = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda k: k.isNotNull())
    marked = segments.select("call_id", "seg_idx", "text", F.explode(said).alias("kind"))
    # only the first ten of a kind leave the task that finds them
    first = Window.partitionBy("call_id", "kind").orderBy("seg_idx")
    ten = marked.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= 10).drop("_n")
    none = F.lit(None).cast("string")
    tasks = segments.where(is_task_candidate(t)).select("call_id", "seg_idx", none.alias("text"), F.lit("tasks").alias("kind"), task.alias("task"))
    calls = segments.select("call_id", F.lit(None).cast(segments.schema["seg_idx"].dataType).alias("seg_idx"), none.alias("text"), none.alias("kind")).distinct()
    every = ten.unionByName(calls).withColumn("task", F.lit(None).cast(tasks.schema["task"].dataType)).unionByName(tasks)
    of = lambda name, value: F.filter(ordered(value, i, F.col("kind") == name), lambda x: x.isNotNull()).alias(name)
    return every.groupBy("call_id").agg(*[of(name, t) for name in rules], of("tasks", F.col("task")))


def number_tasks(position: Column) -> Column:
    return F.format_string("task_%04d", position + 1)


def extractive_summary(transcripts: DataFrame) -> DataFrame:
    """transcripts(call_id, lines): first non-blank line, first eight joined, first five. Calls without a line get a fixed text for both summaries."""
    full = F.filter("lines", lambda x: x.rlike(r"(?U)\S"))
    return transcripts.select(
        "call_id",
        F.coalesce(F.get(full, 0), F.lit(NO_CONTENT)).alias("short_summary"),
        F.when(F.size(full) > 0, F.array_join(cap_per_call(full, 8), " ")).otherwise(NO_CONTENT).alias("detailed_summary"),
        cap_per_call(full, 5).alias("key_points"),
    )


def analysis_confidence(tasks: Column) -> Column:
    """Confidence of the fallback analysis, which always gives a reason and the language `mixed`."""
    return F.when(F.size(tasks) > 0, 0.45).otherwise(0.3)


def fallback_analysis(signals: DataFrame, summaries: DataFrame) -> DataFrame:
    """The whole analysis of calls without a payload: signals and summaries of the same calls, confidence, language and reason."""
    return signals.join(summaries, "call_id").withColumns(
        {"analysis_confidence": analysis_confidence(F.col("tasks")), "analysis_language": F.lit(FALLBACK_LANGUAGE), "low_confidence_reason": F.lit(FALLBACK_REASON)}
    )


def mean_action_confidence(items: DataFrame) -> DataFrame:
    """items(call_id, items array): mean confidence, 0.5 where missing, 0 without items."""
    total = F.aggregate("items", F.lit(0.0), lambda a, x: a + F.coalesce(x["confidence"], F.lit(0.5)))
    return items.select("call_id", F.when(F.size("items") > 0, total / F.size("items")).otherwise(0.0).alias("mean_confidence"))


def insight_counts(insights: DataFrame) -> DataFrame:
    """insights(call_id, insights struct of arrays): number of items of each non-empty kind."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.size(F.col(f"insights.{k}")).alias("n")) for k in INSIGHT_KINDS])
    return insights.select("call_id", F.explode(kinds).alias("k")).select("call_id", "k.kind", "k.n").where("n > 0")


def translation_candidates(calls: DataFrame, translations: DataFrame, threshold: float = 0.7) -> DataFrame:
    """calls(call_id, text, language, confidence): what needs translation, and the text to use: a translation, if there is one and it isn't empty."""
    needs = (F.lower("language") != "en") & (F.lower("language") != "english") & (F.col("confidence") > threshold)
    j = calls.join(translations.select("call_id", "translation"), "call_id", "left")
    use = needs & (F.coalesce("translation", F.lit("")) != "")
    return j.select(
        "call_id",
        "language",
        F.coalesce(needs, F.lit(False)).alias("needs_translation"),
        F.coalesce(use & (F.col("translation") != F.col("text")), F.lit(False)).alias("translation_needed"),
        F.when(use, F.col("translation")).otherwise(F.col("text")).alias("text"),
    )
