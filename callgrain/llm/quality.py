"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules are fixed. The further rules compare signals with cutoffs chosen from
labelled documents: a cutoff is used only if an exact binomial bound shows that it
rejects at most `alpha` of a stratum's good documents, with an error probability of
at most `delta` over all strata and signals together (Bonferroni over strata x
signals; along one signal's cutoffs the tests form a fixed sequence from lenient to
strict, which needs no further correction).

Defined cases: null and empty texts have no words, hence fail the base rules. A null
lang is a stratum of its own. Unlabelled strata, and strata with too few labelled
documents for any bound, get no cutoffs: only the base rules reject there. Repeated
doc_ids are judged row by row; a repeated label row counts once, a document with
contradictory labels counts as good, and texts that are equal but for case and white
space are one trial. Extra columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.llm.common import drop, materialize, packed, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class RiskControl:
    """alpha: allowed false rejection per stratum; delta: probability that any chosen cutoff breaks it."""

    alpha: float = 0.03
    delta: float = 0.05
    #: signal -> candidate cutoffs; a document with signal >= cutoff is rejected
    grid: dict[str, tuple[float, ...]] = field(
        default_factory=lambda: {
            "symbols_per_word": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0),
            "dup_line_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
            "repeat_word_share": (0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.18),
        }
    )


def with_features(packed_docs: DataFrame, text: Column) -> DataFrame:
    """Add the counts of the base rules beside the column `row`: one pass over the text, no shuffle.

    n_repeat_words is the number of words inside any 5-word window found at least twice
    in the same text. Texts without a repeated 64-bit hash of a window have none; in the
    others windows are sorted, by hash and words, and compared word by word.
    """
    has_word = lambda line: F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0
    full = F.coalesce(text, F.lit(""))
    step = packed_docs.withColumn("_w", words(text)).withColumn("_l", F.filter(F.split(full, "\n"), has_word))
    step = step.select(
        "row",
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate(full, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))
    step = step.withColumn("_h", F.when(F.size("_w") > WINDOW, windows))
    tagged = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), F.slice("_w", i + 1, WINDOW).alias("w"), i.alias("i"))))
    step = step.withColumn("_t", F.when(F.size("_h") > F.size(F.array_distinct("_h")), tagged)).drop("_h", "_w")
    like = lambda s, k: F.coalesce((F.get("_t", k)["h"] == s["h"]) & (F.get("_t", k)["w"] == s["w"]), F.lit(False))
    same = lambda s, k: like(s, k - 1) | like(s, k + 1)
    starts = F.sort_array(F.transform(F.filter("_t", same), lambda s: s["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return step.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_t").isNotNull(), covered), F.lit(0)).cast("long")).drop("_t")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def signals() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_word_share": share("n_repeat_words", "n_words"),
    }


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly from the logs of its terms.

    It is 1 where k >= n*p: the value is then at least about one half and passes no test.
    """
    odds = F.lit(p / (1 - p))
    first = n * F.log1p(F.lit(-p))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")),
        F.struct(first.alias("log_t"), F.exp(first).alias("total")),
        lambda a, i: F.struct(
            (a["log_t"] + F.log((n - i + 1) / i * odds)).alias("log_t"),
            (a["total"] + F.exp(a["log_t"] + F.log((n - i + 1) / i * odds))).alias("total"),
        ),
        lambda a: a["total"],
    )
    return F.when(k >= n * p, 1.0).when(k == 0, F.exp(first)).otherwise(terms)


def cutoffs(labelled: DataFrame, control: RiskControl) -> DataFrame:
    """labelled(stratum, quality, signals...): one row per stratum and signal with the strictest cutoff that the bound allows.

    The Clopper-Pearson upper bound of the false rejection rate at confidence 1 - d is
    at most a exactly when P(Binomial(n, a) <= k) <= d; that is what is tested, with a =
    alpha / number of signals and d = delta / (number of strata x number of signals).
    """
    good = labelled.where("quality = 1")
    names = list(control.grid)
    rejected = [
        F.sum(F.when(F.col(s) >= c, 1).otherwise(0)).cast("double").alias(f"k_{s}_{i}")
        for s in names
        for i, c in enumerate(control.grid[s])
    ]
    counts = good.groupBy("stratum").agg(F.count(F.lit(1)).cast("double").alias("n"), *rejected)
    tests = F.array(
        *[
            F.struct(F.lit(s).alias("signal"), F.lit(float(c)).alias("cutoff"), F.col(f"k_{s}_{i}").alias("k"))
            for s in names
            for i, c in enumerate(control.grid[s])
        ]
    )
    strata = good.agg(F.count_distinct(F.coalesce("stratum", F.lit("\x00null"))).alias("strata"))
    tested = counts.select("stratum", "n", F.explode(tests).alias("t")).select("stratum", "n", "t.*")
    n_strata = max(1, strata.first()["strata"])
    level = control.delta / (n_strata * len(names))
    passed = binomial_cdf(F.col("k"), F.col("n"), control.alpha / len(names)) <= level
    return (
        tested.where(passed)
        .groupBy("stratum")
        .agg(*[F.min(F.when(F.col("signal") == s, F.col("cutoff"))).alias(f"cut_{s}") for s in names])
    )


def learn_cutoffs(features: DataFrame, labels: DataFrame, control: RiskControl) -> DataFrame:
    """features(doc_id, stratum, signals..., base_failed, content) joined to labels; base-failed rows never reach the signals.

    Trials of a binomial are independent: of rows with equal `content` in a stratum one
    counts, as good if any of them is labelled so (their signals are equal, too).
    """
    lab = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    judged = features.where("not base_failed").join(lab, "doc_id").select("stratum", "content", "quality", *control.grid)
    once = judged.groupBy("stratum", "content").agg(F.max("quality").alias("quality"), *[F.min(s).alias(s) for s in control.grid])
    return cutoffs(once, control)


def judge(features: DataFrame, cut: DataFrame, control: RiskControl) -> DataFrame:
    """Add `kept`. cut has a row per stratum; it is broadcast only while it is small, and joined by a shuffle beyond that."""
    small = cut.limit(20_001).count() <= 20_000
    side = cut.withColumnRenamed("stratum", "_stratum")
    joined = features.join(F.broadcast(side) if small else side, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    within = ~F.col("base_failed")
    for s in control.grid:
        within = within & (F.col(f"cut_{s}").isNull() | (F.col(s) < F.col(f"cut_{s}")))
    return joined.withColumn("kept", within)


def features_of(docs: DataFrame) -> DataFrame:
    """row, counts, signals, base_failed and stratum (the row's lang) for every document."""
    f = with_features(packed(docs), F.col("row.text")).withColumn("base_failed", base_failed())
    return f.withColumns(signals()).withColumn("stratum", F.col("row.lang"))


def content_key(text: Column) -> Column:
    """Equal for texts that differ in case and white space only."""
    return F.xxhash64(F.translate(F.lower(text), " \t\n\x0b\x0c\r", ""))


def quality_table(docs: DataFrame, labels: DataFrame, control: RiskControl | None = None) -> DataFrame:
    """Counts and verdict per document. The counts are computed once and kept in a narrow table."""
    control = control or RiskControl()
    f = features_of(docs.select("doc_id", "lang", "text")).select(
        F.col("row.doc_id").alias("doc_id"), "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *control.grid,
        content_key(F.col("row.text")).alias("content"),
    )
    f = materialize(f, "quality")
    cut = materialize(learn_cutoffs(f, labels, control), "cutoffs")
    return judge(f, cut, control)


def quality_filter(docs: DataFrame, labels: DataFrame, control: RiskControl | None = None) -> DataFrame:
    """The kept documents, with their own columns.

    Labelled documents are measured first, to learn the cutoffs, then all: so no text is
    written. Up to 2,000,000 labelled ids are broadcast; with more, all are measured twice.
    """
    control = control or RiskControl()
    made: list[str] = []
    ids = labels.where("quality is not null").select("doc_id").distinct()
    measured = docs.select("doc_id", "lang", "text")
    if ids.limit(2_000_001).count() <= 2_000_000:
        measured = measured.join(F.broadcast(ids), "doc_id", "left_semi")
    f = features_of(measured).select(F.col("row.doc_id").alias("doc_id"), "stratum", "base_failed", *control.grid, content_key(F.col("row.text")).alias("content"))
    cut = materialize(learn_cutoffs(materialize(f, "quality", made), labels, control), "cutoffs")
    # the row number keeps the filter above the projections: pushed below, it would compute the words anew for every window
    f = features_of(docs).withColumn("_number", F.monotonically_increasing_id())
    out = judge(f, cut, control).where(F.col("kept") & (F.col("_number") >= 0)).select("row.*")
    drop(docs.sparkSession, made)
    return out


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_table(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
