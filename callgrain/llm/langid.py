"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1- to 3-grams of the lower-cased whole text, weighted by
relative term frequency times inverse document frequency. Document frequencies count
every learnable text. The weights are trained by follow-the-regularised-leader
(per-coordinate FTRL-proximal) with elastic-net penalties on a bounded sample of
labelled rows: at most `rows_per_label` rows of each lang value, those with the smallest
hash of doc_id, and `sample_rows` together. A fifth of the sample is held back to fit one
softmax temperature. Every lang value is learned. With more than `cells` / 2**`bits` of
them features share fewer slots, so that features x labels stay within `cells`: that
bounds what the fitting task and the broadcast hold. Labels that would leave features
fewer than 2**FEWEST slots raise an error; more `cells` take them, at the cost of memory.
`max_labels` is for callers who want the most frequent values only (ties: first in order).

Defined cases: null texts, empty texts and texts without a letter are `und` with score
0; so is everything when there is nothing to learn from. Equal probabilities go to the
label that sorts first. Rows with a null lang count for document frequencies only.
Repeated rows are predicted alike. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgrain.llm.common import packed, python_ready


#: Features have at least 2**FEWEST slots.
FEWEST = 8


@dataclass(frozen=True)
class LangIdConfig:
    bits: int = 17  # features: 2**bits
    orders: tuple[int, ...] = (1, 2, 3)
    rows_per_label: int = 1500  # bound of the fitted sample, per lang value
    sample_rows: int = 150_000  # and over all
    max_labels: int | None = None
    cells: int = 1 << 23  # bound of features x labels
    max_chars: int = 1 << 20  # code points hashed at once; longer texts go in overlapping steps
    epochs: int = 2
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.01
    scale: float = 10.0


MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def gram_steps(text: str, c: LangIdConfig) -> Iterator[np.ndarray]:
    """Hashed n-grams of the whole text, in steps of bounded size; each n-gram occurs in exactly one step."""
    text = f" {text.lower()} "
    over = max(c.orders) - 1
    shift = np.uint64(64 - c.bits)
    for at in range(0, len(text), c.max_chars):
        part = text[at : at + c.max_chars + over]
        cp = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        own = min(c.max_chars, len(text) - at)  # n-grams start here
        found = []
        for n in c.orders:
            m = min(own, len(cp) - n + 1)
            if m <= 0:
                continue
            h = cp[:m] * MIX[0]
            for k in range(1, n):
                h = (h ^ (h >> np.uint64(29))) * MIX[1] + cp[k : k + m] * MIX[k % 3]
            h ^= h >> np.uint64(32)
            found.append(((h * MIX[2]) >> shift).astype(np.int64))
        yield np.concatenate(found)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def document_frequencies(texts: DataFrame, c: LangIdConfig) -> tuple[np.ndarray, int]:
    """Of every hashed n-gram over all rows of texts(text). What reaches the driver is bounded by the feature space."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << c.bits, np.int64), 0
        seen = np.zeros(1 << c.bits, bool)
        for b in batches:
            for text in b.column(0).to_pylist():
                seen[:] = False
                for h in gram_steps(text, c):
                    seen[h] = True
                df += seen
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["feature", "df"])

    rows = texts.select("text").mapInArrow(count, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()
    out, total = np.zeros(1 << c.bits), 0
    for f, v in zip(rows["feature"], rows["df"], strict=True):
        if f < 0:
            total = int(v)
        else:
            out[f] = v
    return out, total


def sparse(text: str, idf: np.ndarray, c: LangIdConfig) -> tuple[np.ndarray, np.ndarray]:
    """Indices and TF-IDF values of one text."""
    parts = [np.unique(h, return_counts=True) for h in gram_steps(text, c)]
    at, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    tf = np.bincount(inverse, np.concatenate([p[1] for p in parts]))
    return at, tf / tf.sum() * idf[at] * c.scale


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, c: LangIdConfig) -> tuple[np.ndarray, float]:
    """Weights and temperature. rows: indices, values, class; every fifth is kept for the temperature."""
    z, n = np.zeros((1 << c.bits, k)), np.zeros((1 << c.bits, k))

    def weights(at) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= c.l1, 0.0, -(zz - np.sign(zz) * c.l1) / ((c.beta + np.sqrt(n[at])) / c.alpha + c.l2))

    train = [r for i, r in enumerate(rows) if i % 5 != 4]
    held = [r for i, r in enumerate(rows) if i % 5 == 4] or train
    rng = np.random.default_rng(7)
    for _ in range(c.epochs):
        for i in rng.permutation(len(train)):
            at, x, y = train[i]
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / c.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    logits, ys = np.array([x @ w[at] for at, x, _ in held]), np.array([y for _, _, y in held])
    temperatures = np.geomspace(0.02, 20, 200)
    logs = [np.log(softmax(logits / t) + 1e-12) for t in temperatures]
    doubt = 1 / (len(ys) + 2)  # a finite sample without errors doesn't prove certainty
    loss = [-np.mean((1 - doubt) * x[np.arange(len(ys)), ys] + doubt * x.mean(axis=1)) for x in logs]
    return w, float(temperatures[int(np.argmin(loss))])


@dataclass
class LangIdModel:
    labels: list[str]
    table: np.ndarray  # idf * weights * scale / temperature, float32
    config: LangIdConfig


def train(learnable: DataFrame, config: LangIdConfig | None = None) -> LangIdModel:
    """learnable(doc_id, text, lang): the rows that may be learned from."""
    c = config or LangIdConfig()
    spark = learnable.sparkSession
    python_ready(spark)
    texts = learnable.select("doc_id", "text", "lang").where(has_letter(F.col("text")))
    labelled = learnable.where("lang is not null").groupBy("lang").count()
    bound = max(1, c.cells >> FEWEST)
    wanted = bound + 1 if c.max_labels is None else min(c.max_labels, bound + 1)
    counts = [(r["lang"], r["count"]) for r in labelled.orderBy(F.desc("count"), "lang").limit(wanted).collect()]
    if len(counts) > bound:
        raise ValueError(f"more than {bound} values of lang: raise LangIdConfig.cells ({c.cells}), {1 << FEWEST} for each value at least")
    c = replace(c, bits=max(FEWEST, min(c.bits, (c.cells // max(1, len(counts))).bit_length() - 1)))
    df, total = document_frequencies(texts, c)
    idf = np.where(df > 0, np.log((1 + total) / (1 + df)) + 0.1, 0.0)
    key = F.xxhash64(F.col("doc_id").cast("string"))
    order = Window.partitionBy("lang").orderBy(key, "doc_id", "text")
    # first a share of each label's rows, by hash, so that no task ranks more than a few times the bound
    each = min(c.rows_per_label, max(5, c.sample_rows // max(1, len(counts))))
    share = spark.createDataFrame([(v, (1 << 20) * 4 * each // n + 1) for v, n in counts], "lang string, share long")
    sample = texts.join(F.broadcast(share), "lang").where(F.pmod(key, F.lit(1 << 20)) < F.col("share"))
    sample = sample.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    shared = spark.sparkContext.broadcast(idf)

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(r.lang, int(r.rank), *sparse(r.text, shared.value, c)) for f in frames for r in f.itertuples()]
        rows.sort(key=lambda r: (r[1], r[0]))  # labels in turn, so that both parts of the sample hold all of them
        labels = sorted({r[0] for r in rows})
        if labels:
            w, t = fit([(at, x, labels.index(lang)) for lang, _, at, x in rows], len(labels), c)
            yield pd.DataFrame({"label": labels, "t": t, "w": [w[:, i].astype("<f4").tobytes() for i in range(len(labels))]})

    got = sample.select("text", "lang", "rank").repartition(1).mapInPandas(learn, "label string, t double, w binary").collect()
    shared.unpersist()
    got.sort(key=lambda r: r["label"])
    w = np.stack([np.frombuffer(r["w"], "<f4") for r in got], axis=1) if got else np.zeros((1 << c.bits, 0), "f4")
    return LangIdModel([r["label"] for r in got], (w * idf[:, None] * c.scale / (got[0]["t"] if got else 1)).astype("f4"), c)


def predictor(spark, model: LangIdModel):
    """A column function from text to struct<lang_pred, score>. The shared table is bounded by features x labels."""
    shared = spark.sparkContext.broadcast((model.labels, np.ascontiguousarray(model.table)))
    c = model.config

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        labels, table = shared.value
        step = max(256, (1 << 20) // max(1, len(labels)))
        out = []
        for t in text:
            total, m = np.zeros(len(labels)), 0
            if t is not None:
                for h in gram_steps(t, c):
                    for at in range(0, len(h), step):  # a block of grams x labels at a time
                        total += np.take(table, h[at : at + step], axis=0).sum(axis=0, dtype=np.float64)
                    m += len(h)
            if t is None or not labels:
                out.append(("und", 0.0))
            else:
                p = softmax(total / m)
                i = int(np.argmax(p))
                out.append((labels[i], float(p[i])))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return lambda text: predict(F.when(has_letter(text), text))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, config: LangIdConfig | None = None) -> DataFrame:
    """docs(doc_id, text, lang, ...) as column `row`, with held_out, lang_pred and score beside it."""
    python_ready(docs.sparkSession)
    model = train(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))), config)
    predict = predictor(docs.sparkSession, model)
    found = packed(docs).withColumn("p", predict(F.col("row.text")))
    return found.select("row", held_out(F.col("row.doc_id")).alias("held_out"), "p.lang_pred", "p.score")


def language_filter(docs: DataFrame, min_score: float = 0.4, config: LangIdConfig | None = None) -> DataFrame:
    """The documents whose language is recognised: not `und`, and with a calibrated probability of at least min_score."""
    return identify(docs, config).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select("row.*")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("row.doc_id", "held_out", "lang_pred", "score")
