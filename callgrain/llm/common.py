"""Shared helpers of the training-data operators: words, row packing and scratch tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch: documents can be long, so a worker holds few of them at a time.
ARROW_ROWS = 200
_SHIPPED: set[str] = set()


def words(text: Column) -> Column:
    """Array of the maximal runs of characters other than space and U+0009-U+000D; null text has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(flat, " "), "")


def n_words(text: Column) -> Column:
    """Number of words of a text, as a long; 0 for null."""
    return F.size(words(text)).cast("long")


def python_ready(spark: SparkSession) -> None:
    """Ship this package to the executors, once per application, and bound what one Arrow batch of texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "callgrain_modules.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that all executors share: spark.checkpoint.dir, or, on a local master only, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        root = spark.sparkContext.getCheckpointDir()
    # a plain path means the default file system, for Spark and for the tasks that open files themselves
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return "file://" + found[5:] if found.startswith("file:/") and not found.startswith("file://") else found


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/callgrain-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, made: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, and lost executors lose nothing.

    made, if given, collects the path, so that the caller can drop the table once nothing reads it any more.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that no remaining plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        with contextlib.suppress(Exception):  # a leftover costs disk, not results
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    paths.clear()


def join_counted(left: DataFrame, right: DataFrame, key: str, rows: str, salt: str, least: int = 256) -> DataFrame:
    """Inner join on a key that right holds once, beside the number of rows that left holds of it (column `rows`).

    A key with many rows is dealt over several tasks by the hash of left's column `salt`;
    right's row goes to each of them. What counts as many grows with the table, so at
    most 200,000 keys do, and those are broadcast. right is read again: give a written table.
    """
    most, total = right.agg(F.max(rows), F.sum(rows)).first()
    bound = max(least, (total or 0) // 200_000)
    if (most or 0) <= bound:
        return left.join(right, key)
    parts = F.ceil(F.col(rows) / bound).cast("int")
    hot = right.where(F.col(rows) > bound).select(key, parts.alias("_parts"))
    left = left.join(F.broadcast(hot), key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(salt), F.col("_parts")), F.lit(0)).cast("int"))
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return left.drop("_parts").join(right, [key, "_part"]).drop("_part")


def packed(df: DataFrame) -> DataFrame:
    """One struct column `row` holding all columns, so that columns added beside it can't clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def open_folder(uri: str):
    """(filesystem, path) of a folder that every executor reaches, by its URI (those of fresh_dir have one); plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_whole(filesystem, path: str, attempt: int, write) -> None:
    """Write a file under a name of this attempt, then move it: a repeated or lost task leaves no half file."""
    own = f"{path}.attempt-{attempt}"
    with filesystem.open_output_stream(own) as out:
        write(out)
    filesystem.move(own, path)
