"""Archive search."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a gram; folders of postings and of texts.
GRAM, POSTING_BUCKETS, TEXT_BLOCKS = 3, 64, 64
#: Characters of texts whose postings one task makes, that one task writes, and whose postings one task sorts: tasks become more with the texts, not larger.
MADE_CHARS, WRITTEN_CHARS, SORTED_CHARS = 1 << 23, 1 << 25, 1 << 22
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def like_ascii(value: Column, pattern: str) -> Column:
    """LIKE that ignores the case of A-Z only; % and _ in the user's text are wildcards, and nothing escapes.

    As a regular expression on the text itself: its flags fold ASCII letters only, and no
    copy of the text is made. Wildcards at the ends become missing anchors.
    """
    inner = pattern.strip("%")
    body = "".join({"%": ".*", "_": "."}.get(c) or (c if c.isascii() and c.isalnum() or ord(c) > 127 else f"\\x{{{ord(c):x}}}") for c in inner)
    head, tail = ("" if pattern.startswith("%") else r"\A"), ("" if pattern.endswith("%") else r"\z")
    return value.rlike(f"(?is){head}{body}{tail}")


def archive_search(calls: DataFrame, q: str = "", source: str = "", date: str = "") -> DataFrame:
    """Calls that match all given terms, newest first. A date such as 2024-03 also prunes partitions if year, month, day are columns."""
    return newest_calls(_matching(calls, q, source, date))


def _matching(calls: DataFrame, q: str, source: str, date: str) -> DataFrame:
    out = calls
    if date:
        for part, name in zip(date[:10].split("-"), ("year", "month", "day"), strict=False):
            if name in calls.columns and len(part) == (4 if name == "year" else 2):
                out = out.where(F.col(name) == part)
        out = out.where(F.date_format("imported_at", "yyyy-MM-dd'T'HH:mm:ss").startswith(date))
    if source:
        out = out.where(like_ascii(F.col("source_filename"), f"%{source}%"))
    if q:  # last: the cheap conditions leave fewer texts to look through
        out = out.where(like_ascii(F.col("search_text"), f"%{q}%"))
    return out


def archive_search_ext(calls: DataFrame, q: str = "", status: str | None = None, low_confidence: bool | None = None, sources: tuple[str, ...] = (), since: str | None = None, until: str | None = None) -> DataFrame:
    """Search with status, confidence, list of sources and range of dates (both ends included)."""
    out = calls
    if status is not None:
        out = out.where(F.col("current_state") == status)
    if low_confidence is not None:
        out = out.where(F.col("low_confidence").cast("boolean") == low_confidence)
    if sources:
        out = out.where(F.col("source_filename").isin(*sources))
    if since is not None:
        out = out.where(F.to_date("imported_at") >= F.lit(since).cast("date"))
    if until is not None:
        out = out.where(F.to_date("imported_at") <= F.lit(until).cast("date"))
    return newest_calls(_matching(out, q, "", ""))  # the text comes last


def newest_calls(calls: DataFrame, n: int | None = None) -> DataFrame:
    out = calls.orderBy(F.desc("imported_at"), "call_id")
    return out if n is None else out.limit(n)


def get_call(calls: DataFrame, call_id: str | None = None) -> DataFrame:
    """One call by id, or the newest."""
    return newest_calls(calls, 1) if call_id is None else calls.where(F.col("call_id") == call_id)


def grams(text: Column, n: int = GRAM) -> Column:
    """The different runs of n characters of a text, A-Z in lower case; linear in the text."""
    chars = F.split(F.translate(text, _UPPER, _LOWER), "")
    windows = F.arrays_zip(*[F.slice(chars, k + 1, F.greatest(F.size(chars) - n + 1, F.lit(0))).alias(f"c{k}") for k in range(n)])
    return F.array_distinct(F.transform(windows, lambda w: F.concat(*[w[f"c{k}"] for k in range(n)])))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(POSTING_BUCKETS)).cast("int")


def build_search_index(calls: DataFrame, folder: str) -> None:
    """Write calls(call_id, search_text, ...) for indexed_search: the rows in TEXT_BLOCKS folders, neighbours by time together,
    and a posting (gram, call, block) for every different gram of a text, in POSTING_BUCKETS folders sorted by gram.

    A gram that all texts share has a posting a call, in many rows of files, never in one value.
    """
    spark = calls.sparkSession
    chars = calls.agg(F.sum(F.length("search_text").cast("long"))).first()[0] or 0
    share = lambda folders, most: max(1, math.ceil(chars / folders / most))
    parts = share(TEXT_BLOCKS, WRITTEN_CHARS)  # ranges in a row are one block
    blocks = calls.repartitionByRange(TEXT_BLOCKS * parts, "imported_at", "call_id").withColumn("block", F.floor(F.spark_partition_id() / parts).cast("int"))
    blocks.write.mode("overwrite").partitionBy("block").parquet(f"{folder}/texts")
    texts = _texts(spark, folder).select("call_id", "block", "search_text").repartition(max(TEXT_BLOCKS, share(1, MADE_CHARS)), "call_id")
    postings = texts.select("call_id", "block", F.explode(grams(F.coalesce("search_text", F.lit("")))).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    parts = share(POSTING_BUCKETS, SORTED_CHARS)
    place = F.col("bucket") * parts + F.pmod(F.xxhash64("call_id"), F.lit(parts)).cast("int")
    dealt = postings.repartitionById(POSTING_BUCKETS * parts, place).sortWithinPartitions("bucket", "gram", "block", "call_id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/texts").withColumn("block", F.col("block").cast("int"))


def search_candidates(spark: SparkSession, folder: str, q: str) -> DataFrame | None:
    """(call_id, block) of the calls that hold every gram of the parts of q between its wildcards; None if no part is long enough."""
    low = q.translate(str.maketrans(_UPPER, _LOWER))
    wanted = sorted({part[i : i + GRAM] for part in re.split("[%_]", low) for i in range(len(part) - GRAM + 1)})
    if not wanted:
        return None
    postings = spark.read.parquet(f"{folder}/postings")
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]
    found = postings.where(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
    return found.groupBy("call_id", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).drop("n")


def indexed_search(spark: SparkSession, folder: str, q: str, source: str = "", date: str = "") -> DataFrame:
    """archive_search over a folder of build_search_index: postings first, then only the blocks of texts that hold candidates, and in them LIKE.

    The blocks, at most TEXT_BLOCKS numbers, come to the driver. A q without a part of
    GRAM characters between wildcards looks through all texts.
    """
    texts = _texts(spark, folder)
    found = search_candidates(spark, folder, q)
    if found is not None:
        blocks = [r.block for r in found.select("block").distinct().collect()]
        texts = texts.where(F.col("block").isin(blocks)).join(found.drop("block"), "call_id", "left_semi") if blocks else texts.where(F.lit(False))
    return newest_calls(_matching(texts.drop("block"), q, source, date))
