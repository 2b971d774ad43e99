"""Near duplicates by min-max hashing.

Each permutation of the shingle hashes contributes its minimum and its maximum, so a
signature of 2 x `permutations` values costs half the evaluations. Bands of `rows`
minima, and bands of `rows` maxima, are the candidate keys.

Steps: (1) one pass over the texts makes set size, digest of the word sequence and band
keys; (2) texts of equal words form a class; classes that share a band with others are
candidates, and one text of each is written to a table of its own; (3) in every band
bucket the class that shares most buckets leads, and is compared with each other one;
(4) links give components; in buckets that still hold several components the remaining
pairs are compared too, except those whose similarity is ruled out by the triangle
inequality of the Jaccard distance (towards the leader) or by the sizes of the sets,
where shingles that no other class has can't be shared; (5) components again.

Sets are compared by 64-bit hashes. A pair that these link is confirmed on the shingles
themselves, byte by byte; those that only share a hash are taken off again. Bytes of a
word are hashed by tables of random numbers, one per place, and words of more than
WORD_BYTES bytes by BLAKE2, so no two words collide but by chance.

Hot groups are dealt: a leader's text travels once per block of its partners; the
remaining pairs of a bucket are formed between blocks of classes whose distances to the
leader are near enough; keys with many rows are split in joins (join_counted).

Defined cases: words are maximal runs without space and U+0009-U+000D, A-Z lower-cased.
Null texts and texts without a word have an empty set and link with nothing. Fewer words
than a shingle holds make one shingle of the whole sequence. Rows that share a doc_id
count as one document: it has the links of all its rows' texts, and a row without words
has the component of the others. Rows with a null doc_id are documents of their own, link
like others, and never name a component unless all its documents have no id. Extra
columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm.common import drop, join_counted, materialize, packed, python_ready
from callgrain.llm.components import connected_components

U = np.uint64
STEP = 1 << 20  # bytes hashed at once
WORD_BYTES = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = np.random.default_rng(19).integers(0, 1 << 64, WORD_BYTES * 256, dtype=U)


@dataclass(frozen=True)
class NearDupConfig:
    shingle: int = 5
    percent: int = 80  # linked if 100 * |intersection| >= percent * |union|
    permutations: int = 40
    rows: int = 4
    block: int = 64  # partners of one leader per task group
    pair_block: int = 2048  # classes of one bucket that meet at once


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def lower_steps(text: str) -> Iterator[np.ndarray]:
    """Bytes of the lower-cased text, in steps that split no word."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    at = 0
    while at < len(raw):
        end = min(len(raw), at + STEP)
        if end < len(raw):  # cut behind a separator
            gaps = np.flatnonzero(_SPACE[raw[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(_SPACE[raw[end:]])
                end = end + int(later[0]) + 1 if len(later) else len(raw)
        yield raw[at:end]
        at = end


@dataclass
class Words:
    """The words of a text: 64-bit hashes, and places in `joined`, the words with one space behind each."""

    hashes: np.ndarray
    sizes: np.ndarray
    joined: bytes


def words_of(text: str | None) -> Words:
    hashes, sizes, joined = [np.zeros(0, U)], [np.zeros(0, np.int64)], []
    for b in lower_steps(text or ""):
        inside = ~_SPACE[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        size = (ends - starts).astype(np.int32)
        first = np.cumsum(size, dtype=np.int32) - size
        letters = b[inside]
        cell = np.arange(len(letters), dtype=np.int32) - np.repeat(first, size)  # place in the word
        long = np.flatnonzero(size > WORD_BYTES)
        if len(long):
            np.minimum(cell, WORD_BYTES - 1, out=cell)
        cell <<= 8
        cell |= letters
        h = np.add.reduceat(_TABLE[cell], first)
        for i in long:
            h[i] = int.from_bytes(hashlib.blake2b(b[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        keep = inside
        keep[ends[ends < len(b)]] = True  # the separator behind each word
        spaced = b[keep]
        spaced[np.cumsum(size + 1, dtype=np.int32)[: len(size) - int(ends[-1] == len(b))] - 1] = 32
        hashes.append(_mix(h + size.astype(U)))
        sizes.append(size)
        joined.append(spaced.tobytes() + b" " * int(ends[-1] == len(b)))
    return Words(np.concatenate(hashes), np.concatenate(sizes), b"".join(joined))


def shingle_hashes(w: Words, n: int) -> np.ndarray:
    """64-bit hashes of the shingles of n words, in order; of the whole sequence if it is shorter."""
    k = len(w.hashes)
    if not k:
        return w.hashes
    m = min(n, k)
    h = np.full(k - m + 1, U(m))
    for i in range(m):
        h = h * U(0xD6E8FEB86659FD93) + w.hashes[i : k - m + 1 + i]
    return _mix(h)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    return np.unique(shingle_hashes(words_of(text), n))


class ShingleSet:
    """The distinct shingles of a whole text: sorted hashes, and where each first stands."""

    def __init__(self, text: str | None, n: int):
        w = words_of(text)
        self.hashes, at = np.unique(shingle_hashes(w, n), return_index=True)
        ends = np.cumsum(w.sizes + 1)
        self.starts, self.ends = ends[at] - w.sizes[at] - 1, ends[at + min(n, max(1, len(w.sizes))) - 1]
        self.joined = w.joined

    def shared(self, other: ShingleSet, percent: int) -> int:
        """Number of shared shingles: by hash; if that links the two, by the words themselves."""
        both, i, j = np.intersect1d(self.hashes, other.hashes, assume_unique=True, return_indices=True)
        n = len(both)
        if 100 * n < percent * (len(self.hashes) + len(other.hashes) - n):
            return n
        a, b, spans = self.joined, other.joined, (self.starts[i], self.ends[i], other.starts[j], other.ends[j])
        return sum(a[p:q] == b[r:s] for p, q, r, s in zip(*(x.tolist() for x in spans), strict=True))


@cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    a = rng.integers(0, 1 << 63, n, dtype=U) * U(2) + U(1)
    return a[:, None], rng.integers(0, 1 << 63, n, dtype=U)[:, None]


def band_keys(s: np.ndarray, c: NearDupConfig) -> np.ndarray:
    """Min-max signature of a non-empty set, folded into band keys (int64)."""
    a, b = _permutations(c.permutations)
    low, high = np.full(c.permutations, ~U(0)), np.zeros(c.permutations, U)
    for at in range(0, len(s), 512):
        v = a * s[None, at : at + 512]
        v += b
        v ^= v >> U(32)
        v *= a
        low, high = np.minimum(low, v.min(axis=1)), np.maximum(high, v.max(axis=1))
    signature = np.stack([low, high])
    bands = signature.reshape(-1, c.rows)
    h = np.arange(len(bands)).astype(U)
    for k in range(c.rows):
        h = _mix(h * U(0xD6E8FEB86659FD93) + bands[:, k])
    return h.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash that tells the texts of one doc_id apart) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def signatures(docs: DataFrame, c: NearDupConfig) -> DataFrame:
    """docs(doc_id, text): doc_id, text_key, n_shingles, digest of the words (null if there are none) and band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, bands = [], [], []
            for text in b.column(2).to_pylist():
                w = words_of(text)
                s = np.unique(shingle_hashes(w, c.shingle))
                sizes.append(len(s))
                digests.append(hashlib.blake2b(w.joined, digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(s, c) if len(s) else np.zeros(0, np.int64))
            values = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, bands)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, values)],
                ["doc_id", "text_key", "n_shingles", "digest", "bands"],
            )

    return keyed(docs).mapInArrow(sign, "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>")


def texts_of(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """classes(node, doc_id, text_key): (node, text), one row each. Up to 500,000 are broadcast, so that no other text is shuffled; more are joined."""
    wanted = classes.select("node", F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"))
    n = wanted.count()
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k"))
    found = materialize(keyed(docs).join(F.broadcast(wanted) if n <= 500_000 else wanted, same).select("node", "text"), "texts")
    if found.count() > n:  # rows that repeat
        found = materialize(found.groupBy("node").agg(F.min("text").alias("text")), "texts")
    return found


def private_counts(nodes: DataFrame, texts: DataFrame, c: NearDupConfig) -> DataFrame:
    """For each class in nodes: how many of its shingles no other class in nodes has."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t, c.shingle).view(np.int64) for t in b.column(1).to_pylist()]
            owners = np.repeat(np.array(b.column(0).to_pylist(), np.int64), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(owners), pa.array(np.concatenate(found) if found else owners)], ["node", "shingle"])

    held = texts.join(nodes, "node", "left_semi").mapInArrow(sets, "node long, shingle long")
    once = held.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
    return once.groupBy("node").agg(F.count(F.lit(1)).alias("private"))


def compare(pairs: DataFrame, texts: DataFrame, c: NearDupConfig, made: list[str]) -> DataFrame:
    """pairs(a, b) of classes: adds the sizes of intersection and union of their full sets."""
    partners = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners")), "partners", made)
    blocks = F.ceil(F.col("partners") / c.block).cast("int")
    partner = join_counted(pairs, partners, "a", "partners", "b").select("a", "b", F.pmod(F.xxhash64("b"), blocks).cast("int").alias("block"))
    partner = partner.join(texts.withColumnRenamed("node", "b"), "b").select("a", "block", "b", "text")
    leader = texts.withColumnRenamed("node", "a").join(partners.select("a", blocks.alias("blocks")), "a")
    leader = leader.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), "text")
    dealt = leader.unionByName(partner).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, None
        for batch in batches:
            rows: list[tuple] = []
            for a, b, t in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                s = ShingleSet(t, c.shingle)
                if b is None:
                    lead, own = a, s
                elif lead == a:
                    both = own.shared(s, c.percent)
                    rows.append((a, b, both, len(own.hashes) + len(s.hashes) - both))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["a", "b", "both", "either"])

    return dealt.mapInArrow(intersect, "a long, b long, both long, either long")


def remaining_pairs(left: DataFrame, c: NearDupConfig, made: list[str]) -> DataFrame:
    """left(band, node, n, comp, both, else, d, bands): pairs (a, b) of one bucket and of different components that no bound rules out.

    Distances d to the leader differ by at most `reach` within a pair. So classes meet
    those of their own cell of that width and of the next, in blocks of `pair_block`: the
    work of a task does not grow with its bucket.
    """
    reach = 1 - c.percent / 100 + 1e-9
    left = left.withColumn("cell", F.floor(F.col("d") / reach).cast("int"))
    cells = left.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.groupBy("band").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.ceil(F.col("n") / c.pair_block).cast("int").alias("n")))).alias("blocks"), F.sum("n").alias("rows"))
    cells = materialize(cells.where("rows > 1"), "cells", made)
    left = join_counted(left, cells, "band", "rows", "node").drop("rows")
    blocks = lambda cell: F.coalesce(F.try_element_at("blocks", cell), F.lit(0))
    left = left.withColumn("block", F.pmod(F.xxhash64("node"), blocks(F.col("cell"))).cast("int"))
    own, block = F.col("cell"), F.col("block")
    every = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    ahead = F.concat(
        F.transform(F.filter(every(blocks(own)), lambda i: i >= block), lambda i: F.struct(own.alias("c1"), block.alias("b1"), own.alias("c2"), i.alias("b2"))),
        F.transform(every(blocks(own + 1)), lambda i: F.struct(own.alias("c1"), block.alias("b1"), (own + 1).alias("c2"), i.alias("b2"))),
    )
    behind = F.concat(
        F.transform(F.filter(every(blocks(own)), lambda i: i <= block), lambda i: F.struct(own.alias("c1"), i.alias("b1"), own.alias("c2"), block.alias("b2"))),
        F.transform(every(blocks(own - 1)), lambda i: F.struct((own - 1).alias("c1"), i.alias("b1"), own.alias("c2"), block.alias("b2"))),
    )
    columns = ["node", "n", "comp", "both", "else", "d", "bands"]
    x = left.select("band", F.explode(ahead).alias("m"), F.struct(*columns).alias("x")).select("band", "m.*", "x")
    y = left.select("band", F.explode(behind).alias("m"), F.struct(*columns).alias("y")).select("band", "m.*", "y")
    most = F.least("x.both", "y.both") + F.least("x.else", "y.else")
    met = x.join(y, ["band", "c1", "b1", "c2", "b2"]).where(
        ((F.col("c1") < F.col("c2")) | (F.col("b1") < F.col("b2")) | (F.col("x.node") < F.col("y.node")))
        & (F.col("x.comp") != F.col("y.comp"))
        & (100 * most >= c.percent * (F.col("x.n") + F.col("y.n") - most))
        & (F.abs(F.col("x.d") - F.col("y.d")) <= reach)
        & (F.col("band") == F.array_min(F.array_intersect("x.bands", "y.bands")))  # in the first bucket that both are left in
    )
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def component_classes(docs: DataFrame, c: NearDupConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """signed(doc_id, text_key, n_shingles, digest), a row per row of docs(doc_id, text);
    classes(digest, rows, doc_id, text_key, component, component_id): the smallest row of each class, its component's number and smallest doc_id;
    shared(doc_id, digest): the doc_ids of several rows, with the digest of one of their texts, null if none has words.
    """
    spark = docs.sparkSession
    python_ready(spark)
    made: list[str] = []
    docs = docs.select("doc_id", "text")
    signed = materialize(signatures(docs, c), "signatures")
    rows = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key")
    reps = signed.where("digest is not null").groupBy("digest").agg(
        F.min(rows).alias("row"), F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    reps = reps.select("digest", "rows", "n", "bands", "row.doc_id", "row.text_key", F.monotonically_increasing_id().alias("node"))
    reps = materialize(reps, "classes", made)  # numbers are fixed by writing them
    shared = signed.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("digest").alias("digest"), F.max("digest").alias("other"))
    shared = materialize(shared.where("rows > 1"), "repeated-ids")
    several = shared.where("digest < other").select("doc_id", F.col("digest").alias("first"))
    same = signed.where("digest is not null").join(several, "doc_id").where("digest <> first").select("first", "digest").distinct()
    node = lambda side: reps.select(F.col("digest").alias(side), F.col("node").alias(f"{side}_node"))
    same = same.join(node("first"), "first").join(node("digest"), "digest").select(F.col("first_node").alias("a"), F.col("digest_node").alias("b"))
    same = materialize(same, "same-ids", made)

    keys = reps.select("node", "n", F.explode("bands").alias("band"))
    crowds = materialize(keys.groupBy("band").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1"), "crowds", made)
    members = materialize(join_counted(keys, crowds, "band", "crowd", "node"), "members", made)
    # the member that shares most buckets leads: in a group of copies of one original, that is the original
    share = materialize(members.groupBy("node").agg(F.sum("crowd").alias("share")), "shares", made)
    texts = texts_of(share.select("node").join(reps.select("node", "doc_id", "text_key"), "node"), docs)
    lead = members.join(share, "node").groupBy("band").agg(F.max_by("node", F.struct("share", F.xxhash64("node"))).alias("lead"), F.count(F.lit(1)).alias("crowd"))
    lead = materialize(lead, "leaders", made)
    members = materialize(join_counted(members.drop("crowd"), lead, "band", "crowd", "node").drop("crowd"), "led", made)
    first = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    first = materialize(compare(first, texts, c, made), "compared", made)
    linked = 100 * F.col("both") >= c.percent * F.col("either")
    found = materialize(connected_components(first.where(linked).select("a", "b").unionByName(same)), "components", made)
    # pairs left: other components of the same bucket, unless sizes or the distances to the leader rule them out
    seen = (
        members.join(found, "node", "left")
        .join(first.select(F.col("a").alias("lead"), F.col("b").alias("node"), "both", (1 - F.col("both") / F.col("either")).alias("d")), ["lead", "node"])
        .select("band", "node", "n", F.coalesce("component", "node").alias("comp"), "both", "d")
    )
    seen = materialize(seen, "seen", made)
    heads = members.where("node = lead").join(found, "node", "left").select("band", F.coalesce("component", "node").alias("comp"))
    mixed = seen.select("band", "comp").unionByName(heads).groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("crowd")).where("lo < hi").select("band", "crowd")
    mixed = materialize(mixed, "mixed", made)
    left = materialize(join_counted(seen, mixed, "band", "crowd", "node"), "left", made)
    # two members share at most the lesser of what each shares with the leader, and of what else each has;
    # what only one class of a crowd has is shared by none
    # (leaders count among the crowd, so what a member has alone is outside of its leader's set too)
    inside = left.where("crowd > 4").select("band", "node")
    ahead = members.where("node = lead").join(inside.select("band").distinct(), "band", "left_semi").select("node")
    crowded = materialize(inside.select("node").union(ahead).distinct(), "crowded", made)
    alone = private_counts(crowded, texts, c)
    left = left.join(alone, "node", "left").withColumn("else", F.col("n") - F.col("both") - F.when(F.col("crowd") > 4, F.coalesce("private", F.lit(0))).otherwise(0))
    left = materialize(left.where(100 * (F.col("both") + F.col("else")) >= c.percent * F.col("n")), "left", made)
    own = left.groupBy("node").agg(F.collect_set("band").alias("bands"))
    left = materialize(left.join(own, "node"), "left", made)
    rest = materialize(remaining_pairs(left, c, made), "rest", made)
    more = compare(rest, texts, c, made).where(linked).select("a", "b")
    labels = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    classes = reps.join(labels, "node", "left").select("node", "digest", "rows", "doc_id", "text_key", F.coalesce("component", "node").alias("component"))
    classes = materialize(classes, "labels", made)
    names = materialize(classes.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("classes")), "names", made)
    classes = materialize(join_counted(classes, names, "component", "classes", "node").drop("node", "classes"), "named")
    drop(spark, made)
    return signed.drop("bands"), classes, shared.select("doc_id", "digest")


def near_duplicates(docs: DataFrame, config: NearDupConfig | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs(doc_id, text)."""
    signed, classes, shared = component_classes(docs, config or NearDupConfig())
    full = join_counted(signed.where("digest is not null"), classes.select("digest", "rows", "component_id"), "digest", "rows", "doc_id")
    full = full.select("doc_id", "n_shingles", "component_id")
    # rows without words: alone, unless their document has words elsewhere
    other = shared.where("digest is not null").join(classes.select("digest", "component_id"), "digest").select("doc_id", F.col("component_id").alias("other"))
    empty = signed.where("digest is null").join(other, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("other", "doc_id").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dup_filter(docs: DataFrame, config: NearDupConfig | None = None) -> DataFrame:
    """One row of each component stays: that of the smallest doc_id, null last; of several such rows, that of the smallest hash.

    Rows without words stay, unless their doc_id has a row with words.
    """
    signed, classes, shared = component_classes(docs, config or NearDupConfig())
    rows = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key")
    stay = materialize(classes.groupBy("component").agg(F.min(rows).alias("r")).select("r.doc_id", "r.text_key"), "stay")
    null_safe = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))
    gone = signed.where("digest is not null").select("doc_id", "text_key").distinct().alias("g").join(stay.alias("s"), null_safe("g", "s"), "left_anti")
    blank = signed.where("digest is null").join(shared.where("digest is not null"), "doc_id", "left_semi").select("doc_id", "text_key").distinct()
    gone = materialize(gone.select("doc_id", "text_key").unionByName(blank), "gone")
    again = stay.where("doc_id is null").unionByName(stay.join(shared.select("doc_id"), "doc_id", "left_semi"))
    again = materialize(again, "again")
    every = packed(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("text_key")).alias("d")
    small = lambda df: F.broadcast(df) if df.count() <= 1_000_000 else df
    kept = every.join(small(gone).alias("g"), null_safe("d", "g"), "left_anti")
    if again.count() == 0:
        return kept.select("row.*")
    repeated = every.join(small(again).alias("a"), null_safe("d", "a"), "left_semi")
    one = repeated.groupBy("doc_id", "text_key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    single = kept.join(small(again).alias("a"), null_safe("d", "a"), "left_anti")
    return single.select("row.*").unionByName(one.select("row.*"))


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), NearDupConfig(shingle=4))
