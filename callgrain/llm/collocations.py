"""Collocations per language, by a weighted de Bruijn graph of words.

Pieces of text, between line ends and signs, are runs of words. The graph's nodes are
runs of four words, an edge joins two that overlap in three: it is a run of five and
weighs its occurrences. Only these longest grams are aggregated, and the runs of four words
at which pieces end. The count of a phrase of four words is the flow out of its node, the
weights of all grams of five words that start with it, plus the pieces that end with it.
Runs of two and three words are the edges of the graphs whose nodes are single words and
pairs. All filters start from their weights, so they are weighed once, beforehand, and not
handed on with the longer runs: those that are frequent lie in nearly every task, and would
make as many rows as there are tasks times such runs.

Two things keep the graph small without changing a count that matters:

* A phrase with enough occurrences has only parts with enough. Words that reach the bound
  are marked by a 64-bit hash in a bitmap of 2**FILTER_BITS bits, the only thing broadcast;
  pairs are made of these only. Pairs that reach it are marked in another, runs of three
  words are made of these only, and marked in the same. Then runs of four words whose runs
  of three are marked are counted by hash and marked too, and so on.
  A run that is not marked is no edge: where it would go on, its first words end a piece.
  Hashes or bits that coincide only leave rare runs in.
* Unary paths, nodes with one edge in and one out of the same weight, are compacted in
  the task that finds them: a passage that repeats is one path with one weight, not a row
  per edge. Whole-graph compaction is what absorbs a phrase into a longer one: a phrase is
  dropped if one word more, before or after, has the same count. That is enough, for if
  any longer phrase around it has that count, so have those between.

Defined cases: null text is empty; null lang is `und`; other columns are not read. Rows
that repeat count as often. No documents give no rows. Products that pass 38 digits
raise an error.
"""

from __future__ import annotations

import gc
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgrain.llm.common import drop, materialize, python_ready

LEAST, FIRST, LONGEST = 100, 2000, 5
FILTER_BITS = 27
#: Entries of a task's counts before they are handed on, hashes before they are counted, bytes looked at together, rows of a batch of runs.
HELD, HASHES, PART_BYTES, RUN_ROWS = 400_000, 4_000_000, 1 << 21, 1 << 16
#: Runs of up to so many words are weighed beforehand.
WEIGHED = 3
# fixed values: what ends a piece, and what parts words
BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KIND = np.array([2 if b in BREAKS else 1 if b in GAPS else 0 for b in range(256)], np.uint8)
_SPACED = bytes(32 if _KIND[b] else _LOWER[b] for b in range(256))
_BASE, _MIX, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class Words:
    """Places and hashes of the words of a stretch of bytes, all at once: the hash of a word is a difference of two prefix sums."""

    _powers = np.cumprod(np.r_[np.uint64(1), np.full(PART_BYTES, _BASE, np.uint64)])
    _inverse = np.cumprod(np.r_[np.uint64(1), np.full(PART_BYTES, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)])

    def __init__(self, data: bytes, lang: int):
        if len(data) >= len(Words._powers):  # a piece longer than usual
            Words._powers = np.cumprod(np.r_[np.uint64(1), np.full(len(data), _BASE, np.uint64)])
            Words._inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(data), np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)])
        b = np.frombuffer(data, np.uint8)
        kind = _KIND[b]
        edge = np.flatnonzero(np.diff(np.r_[False, kind == 0, False].astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        sums = np.r_[np.uint64(0), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self._powers[: len(b)])]
        h = _mixed((sums[self.end] - sums[self.start]) * self._inverse[self.start])
        piece = np.cumsum(kind == 2)[self.start]
        self.joined = piece[1:] == piece[:-1]  # a word and the next are of one piece
        self._h, self._lang = h, np.uint64(lang)

    def runs(self, k: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the runs of k words that start at the words `at`."""
        h = self._h[at]
        for i in range(1, k):
            h = h * _BASE + self._h[at + i]
        return _mixed(h + self._lang)

    def marks(self, marked: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
        """Whether the runs of k words that start at the words `at` are marked."""
        bit = self.runs(k, at) >> np.uint64(64 - FILTER_BITS)
        return (marked[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def inner(self, marked: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """For 2 to k words: whether the run that starts at each word is of one piece and it and all runs within it are marked."""
        ok = self.joined
        for size in range(2, k + 1):
            if size > 2:
                ok = ok[:-1] & ok[1:]
            at = np.flatnonzero(ok)
            ok = np.zeros(len(ok), bool)
            ok[at] = self.marks(marked, size, at)
            yield ok

    def candidates(self, marked: np.ndarray, k: int) -> np.ndarray:
        """The words at which a run of k words of one piece starts whose shorter runs are marked; for two words, both words."""
        if k == 2:
            known = self.marks(marked, 1, np.arange(len(self.start)))
            return np.flatnonzero(self.joined & known[:-1] & known[1:])
        *_, ok = self.inner(marked, k - 1)
        return np.flatnonzero(ok[:-1] & ok[1:])


def _lang_number(lang: str) -> int:
    return int(_mixed(np.frombuffer(lang.encode()[:8].ljust(8, b"\0"), "<u8") + np.uint64(len(lang)))[0])


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, bytes) of lang and text columns, lower-cased, texts of a language joined by a line end, cut at the ends of pieces."""
    for b in batches:
        texts = defaultdict(list)
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text:
                texts[lang].append(text.encode())
        for lang, own in texts.items():
            data, at = b"\n".join(own).translate(_LOWER), 0
            while at < len(data):
                to = at + PART_BYTES
                if to < len(data):
                    ends = [data.rfind(x.to_bytes(), at, to) for x in BREAKS]
                    to = max(ends) + 1 or min((x for x in (data.find(y.to_bytes(), to) for y in BREAKS) if x >= 0), default=len(data) - 1) + 1
                yield lang, data[at:to]
                at = to


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, n: occurrences of every word of docs(lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                yield _batch({"lang": ([lang] * len(c), pa.string()), "word": ([w.decode() for w in c], pa.string()), "n": (list(c.values()), pa.int64())})
            held.clear()

        for lang, data in stretches(batches):
            held[lang].update(data.translate(_SPACED).split())
            if sum(map(len, held.values())) > HELD:
                yield from out()
        yield from out()

    parts = docs.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _bitmap(hashes: DataFrame) -> bytearray:
    """Bitmap of hashes(h)."""
    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS) + 1
    pages = hashes.groupBy(F.bitmap_bucket_number(bit).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = bytearray(1 << FILTER_BITS - 3)
    for r in pages.collect():  # at most 2**FILTER_BITS bits in all
        out[4096 * (r.page - 1) : 4096 * r.page] = r.bits
    return out


def _often(docs: DataFrame, least: int, k: int, bits: bytes) -> bytearray:
    """Bitmap of the hashes of runs of k words that occur often enough; only runs whose shorter runs are marked in bits are counted."""
    mask = docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        marked = np.frombuffer(mask.value, np.uint8)

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for lang, data in stretches(batches):
            w = Words(data, _lang_number(lang))
            held.append(w.runs(k, w.candidates(marked, k)))
            size += len(held[-1])
            if size > HASHES:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    often = _bitmap(docs.select("lang", "text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    mask.destroy()
    return often


def run_marks(runs: DataFrame, k: int) -> bytes:
    """Bitmap of the hashes of runs(lang, phrase) of k words each; its size is fixed, so it may be broadcast."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in stretches(batches):
            w = Words(data, _lang_number(lang))
            yield pa.RecordBatch.from_arrays([pa.array(w.runs(k, np.arange(0, len(w.start), k)).view(np.int64))], ["h"])

    return bytes(_bitmap(runs.select("lang", "phrase").mapInArrow(hashed, "h long")))


def pair_bits(pairs: DataFrame) -> bytes:
    """Bitmap of the hashes of pairs(lang, phrase)."""
    return run_marks(pairs, 2)


def count_runs(docs: DataFrame, k: int, bits: bytes, at_once: int = HASHES) -> DataFrame:
    """lang, phrase, n: occurrences of the runs of k words of docs(lang, text) whose shorter runs (of pairs: whose words)
    are marked; a task holds at_once of them before it counts them."""
    mask = docs.sparkSession.sparkContext.broadcast(bits)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(mask.value, np.uint8)
        ids: dict[str, dict[bytes, int]] = defaultdict(dict)
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        size, low = 0, 0xFFFFFFFF

        def out() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                # a run is the number of the run of its first words, and its last word
                run, *more, last = np.concatenate(own, axis=1).astype(np.int64)
                shorter = []
                for word in more:
                    seen, run = np.unique(run << 32 | word, return_inverse=True)
                    shorter.append(seen)
                runs, n = np.unique(run << 32 | last, return_counts=True)
                names = pa.array([w.decode() for w in ids[lang]], pa.string())
                for at in range(0, len(runs), RUN_ROWS):
                    some, words = runs[at : at + RUN_ROWS], []
                    for seen in reversed(shorter):
                        words.append(some & low)
                        some = seen[some >> 32]
                    words += [some & low, some >> 32]
                    phrase = pc.binary_join_element_wise(*(names.take(pa.array(x)) for x in reversed(words)), " ")
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(some)), phrase, pa.array(n[at : at + RUN_ROWS], pa.int64())], ["lang", "phrase", "n"])
            held.clear()
            ids.clear()

        for lang, data in stretches(batches):
            w = Words(data, _lang_number(lang))
            at = w.candidates(marked, k)
            used = np.zeros(len(w.start), bool)
            for i in range(k):
                used[at + i] = True
            own, number = ids[lang], np.zeros(len(used), np.int32)
            number[used] = [own.setdefault(x, len(own)) for x in compress(data.translate(_SPACED).split(), used.tolist())]
            held[lang].append(np.stack([number[at + i] for i in range(k)]))
            size += len(at)
            if size > at_once or sum(map(len, ids.values())) > HELD:
                yield from out()
                size = 0
        yield from out()

    parts = docs.select("lang", "text").mapInArrow(weigh, "lang string, phrase string, n long")
    return parts.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def compacted(edges: dict[bytes, int]) -> Iterator[tuple[bytes, int]]:
    """Edges (words joined by spaces, with weights) as paths: edges that follow each other without another way in or out, and with one weight, are one."""
    after: dict[bytes, bytes | None] = {}
    into: dict[bytes, bytes | None] = {}
    for e in edges:
        a, b = e[: e.rindex(b" ")], e[e.index(b" ") + 1 :]
        after[a] = None if a in after else e
        into[b] = None if b in into else e

    def follows(e: bytes) -> bytes | None:
        node = e[e.index(b" ") + 1 :]
        f = after.get(node)
        return f if f is not None and into[node] == e and edges[f] == edges[e] else None

    inner = {f for e in edges if (f := follows(e)) is not None}
    seen = set()
    for starts in ((e for e in edges if e not in inner), edges):  # what is left then are rings
        for e in starts:
            if e in seen:
                continue
            path, at = [e], e
            seen.add(e)
            while (f := follows(at)) is not None and f not in seen:
                path.append(f[f.rindex(b" ") :])
                seen.add(f)
                at = f
            yield b"".join(path), edges[e]


def find_paths(docs: DataFrame, bits: bytes, longest: int = LONGEST) -> DataFrame:
    """lang, path, n: paths of longest words or more, each run of `longest` words in it being marked and having n
    occurrences in the task; and shorter marked runs, of more than WEIGHED words, that end a piece n times, as no
    marked run of one word more starts there."""
    mask = docs.sparkSession.sparkContext.broadcast(bits)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # no cycles here
        marked = np.frombuffer(mask.value, np.uint8)
        edges: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
        ends: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))

        def out() -> Iterator[pa.RecordBatch]:
            for lang in edges.keys() | ends.keys():
                rows = [*compacted(edges[lang]), *ends[lang].items()]
                yield _batch({"lang": ([lang] * len(rows), pa.string()), "path": ([p.decode() for p, _ in rows], pa.string()), "n": ([n for _, n in rows], pa.int64())})
            edges.clear()
            ends.clear()

        for lang, data in stretches(batches):
            w = Words(data, _lang_number(lang))
            words = data.translate(_SPACED).split()
            inner = [*w.inner(marked, longest)]
            for k, ok in enumerate(inner[WEIGHED - 1 :], WEIGHED + 1):
                own = edges[lang] if k == longest else ends[lang]
                if k < longest:
                    ok = ok.copy()
                    ok[:-1] &= ~inner[k - 1]  # those of one word more
                for i in np.flatnonzero(ok).tolist():
                    own[b" ".join(words[i : i + k])] += 1
            if sum(map(len, edges.values())) + sum(map(len, ends.values())) > HELD:
                yield from out()
        yield from out()
        gc.enable()

    return docs.select("lang", "text").mapInArrow(find, "lang string, path string, n long")


def phrase_counts(docs: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST, made: list[str] | None = None) -> DataFrame:
    """lang, phrase, k, n: all phrases of 2 to longest words of docs(lang, text) with at least `least` occurrences; words as of count_words."""
    made = [] if made is None else made
    bits = run_marks(words.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase")), 1)
    paths, held = None, []
    for k in range(2, longest + 1):
        if k > WEIGHED:
            more = _often(docs, least, k, bits)
        else:
            runs = materialize(count_runs(docs, k, bits).where(F.col("n") >= least), "runs", held)
            paths = runs if paths is None else paths.unionByName(runs)
            more = pair_bits(runs) if k == 2 else run_marks(runs, k)
        bits = bytes(more) if k == 2 else (np.frombuffer(bits, np.uint8) | np.frombuffer(more, np.uint8)).tobytes()
    paths = paths.withColumnRenamed("phrase", "path")
    if longest > WEIGHED:
        paths = find_paths(docs, bits, longest).unionByName(paths)
    paths = materialize(paths, "paths", made)
    drop(docs.sparkSession, held)
    parts = F.split("path", " ")
    cut = F.transform(F.sequence(F.lit(1), F.size(parts) - longest + 1), lambda i: F.array_join(F.slice(parts, i, longest), " "))
    grams = paths.where(F.size(parts) >= longest).select("lang", F.explode(cut).alias("phrase"), "n")
    out, old = None, []
    for k in range(longest, 1, -1):
        counted = materialize(grams.groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "grams", now := [])
        often = materialize(counted.where(F.col("n") >= least).withColumn("k", F.lit(k)), "phrases", made)
        out = often if out is None else out.unionByName(often)
        flow = counted.select("lang", F.substring_index("phrase", " ", k - 1).alias("phrase"), "n")
        ends = paths.where(F.size(parts) == k - 1).select("lang", F.col("path").alias("phrase"), "n")
        grams = flow.unionByName(ends) if k - 1 > WEIGHED else ends  # weighed ones have all their occurrences
        drop(docs.sparkSession, old)
        old = now
    drop(docs.sparkSession, old)
    return out


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, longest: int = LONGEST) -> DataFrame:
    """The first collocations of each language of docs(lang, text): lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase and its two parts at the cut that scores lowest, n the
    language's words; score is floor(1000 a n / (l r)).
    """
    spark: SparkSession = docs.sparkSession
    python_ready(spark)
    made: list[str] = []
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = materialize(count_words(docs), "words")
    phrases = phrase_counts(docs, words, least, longest, made)
    counts = phrases.select("lang", "phrase", F.col("n").alias("f")).unionByName(words.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("total"))
    # one word more at either end, with the same count, absorbs a phrase
    longer = phrases.where("k > 2").select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))).alias("phrase"), "n")
    most = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = phrases.join(most, ["lang", "phrase"], "left").where("longer is null or longer < n").drop("longer")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', cut)"), "right": F.expr("substring_index(phrase, ' ', cut - k)")})
    part = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    joined = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(F.broadcast(sizes), "lang")
    big = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"(1000 * {big('n')} * {big('total')}) div ({big('l')} * {big('r')})")
    lowest = joined.withColumn("score", score).groupBy("lang", "phrase").agg(F.min_by(F.struct("n", "l", "r", "total", "score"), F.struct("score", "cut")).alias("x"))
    flat = lowest.select("lang", "phrase", F.col("x.n").alias("a"), "x.l", "x.r", F.col("x.total").alias("n"), "x.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return flat.withColumn("rank", rank.cast("long")).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
