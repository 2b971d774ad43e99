"""Packing of tokenised documents into sequences of a fixed capacity: best fit, then a local search that swaps.

Documents become pieces: ids and the end id, cut into pieces of the capacity only if they
are longer; the first piece takes what is left over. Pieces of full length are sequences
by themselves. The others are dealt by a hash into blocks of about BLOCK_PIECES, each a
task of its own: longest first, every piece goes into the fullest sequence that has room.
Then the emptiest sequence gives up its pieces: it moves one into a gap, exchanges one of
its own for a shorter one of another sequence, or two of its own for one, always so that
the other gets fuller; the sum of squared fills grows with each step, so the search
ends, and a sequence that has nothing left is gone. Sequences still far from full are
dealt anew, whole, and searched again, until they fit one block or no longer get fewer.

Defined cases: null and empty texts have the end id alone. Repeated and null doc_ids are
documents of their own (piece_key tells pieces apart). Extra columns are left alone. No
documents give no rows.
"""

from __future__ import annotations

import gc
import heapq
import zlib
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm.bytebpe import byte_encoder
from callgrain.llm.common import materialize, python_ready

CAPACITY, END_ID = 1024, 2
BLOCK_PIECES = 20_000
#: Times that every underfull sequence may be the one to empty.
PASSES = 4
#: Sequences filled to less than this share are searched again among those of other blocks.
FULL_ENOUGH = 15 / 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, piece, start, length, ids_crc32 and, if kept, their ids as little-endian unsigned 32-bit integers."""
    python_ready(docs.sparkSession)
    path, end = path or vocabulary_path(), np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # no cycles here, and scanning what is remembered takes time
        encoder = byte_encoder(path)
        for b in batches:
            columns: list[list] = [[] for _ in range(6)]
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode_all(b.column(1).to_pylist()), strict=True):
                data = ids + end
                first = len(data) // 4 % capacity or capacity
                cuts = [0, *range(4 * first, len(data) + 1, 4 * capacity)]
                for k, (at, to) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = data[at:to]
                    for c, v in zip(columns, (doc_id, k, at // 4, (to - at) // 4, zlib.crc32(part), part), strict=True):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)][: 5 + keep_ids], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])
        gc.enable()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES + ", ids binary" * keep_ids)


def best_fit(lengths: Iterable[int], capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest bin with room for it."""
    bins: list[list[int]] = []
    by_gap: dict[int, list[int]] = defaultdict(list)
    gaps = 0  # bit g is set if some bin has a gap of g
    for x in sorted(lengths, reverse=True):
        roomy = gaps >> x
        if roomy:
            gap = x + (roomy & -roomy).bit_length() - 1
            i = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
            bins[i].append(x)
            gap -= x
        else:
            i, gap = len(bins), capacity - x
            bins.append([x])
        if gap:
            by_gap[gap].append(i)
            gaps |= 1 << gap
    return bins


class SwapSearch:
    """Empties underfull bins into the gaps of fuller ones; see the module."""

    def __init__(self, bins: list[list[int]], capacity: int):
        self.bins, self.capacity = bins, capacity
        self.gap = [capacity - sum(b) for b in bins]
        self.open = [g > 0 for g in self.gap]
        # of each length (0: nothing in exchange), bins that hold it, by falling gap; outdated entries go when met
        self.holders: list[list[tuple[int, int]]] = [[] for _ in range(capacity)]
        self.widest = np.zeros(capacity, np.int64)
        for i in range(len(bins)):
            self._enter(i)

    def _enter(self, i: int) -> None:
        if self.open[i]:
            for y in {0, *self.bins[i]}:
                if y < self.capacity:
                    heapq.heappush(self.holders[y], (-self.gap[i], i))
                    self.widest[y] = max(self.widest[y], self.gap[i])

    def _top(self, y: int) -> int | None:
        """The bin with the widest gap among the open ones that hold y."""
        heap = self.holders[y]
        while heap:
            g, i = heap[0]
            if self.open[i] and self.gap[i] == -g and (y == 0 or y in self.bins[i]):
                break
            heapq.heappop(heap)
        self.widest[y] = -heap[0][0] if heap else 0
        return heap[0][1] if heap else None

    def _offer(self, x: int) -> tuple[int, int, int] | None:
        """(gain, length taken in exchange, bin) of the largest gain that x brings to another bin."""
        low = 0
        while low < x:
            ok = np.flatnonzero(self.widest[low:x] >= np.arange(x - low, 0, -1))
            if not len(ok):
                return None
            y = low + int(ok[0])
            i = self._top(y)
            if i is not None and self.gap[i] >= x - y:
                return x - y, y, i
            low = y if self.widest[y] >= x - y else y + 1
        return None

    def _give(self, source: int, out: tuple[int, ...], y: int, target: int) -> None:
        for x in out:
            self.bins[source].remove(x)
        self.bins[target] += out
        if y:
            self.bins[target].remove(y)
            self.bins[source].append(y)
        moved = sum(out) - y
        self.gap[source] += moved
        self.gap[target] -= moved
        self.open[target] = self.gap[target] > 0
        self._enter(target)

    def _step(self, source: int) -> tuple[tuple[int, ...], int, int] | None:
        """What to give away next, what to take for it (0: nothing), and the other bin."""
        singles = [(o, (x,)) for x in set(self.bins[source]) if (o := self._offer(x))]
        best = max(singles, default=None)
        if best is None or best[0][1]:  # nothing moves outright: two for one may bring more
            pairs = set(combinations(sorted(self.bins[source])[:8], 2))
            best = max([*singles, *((o, p) for p in pairs if sum(p) < self.capacity and (o := self._offer(sum(p))))], default=None)
        return None if best is None else (best[1], *best[0][1:])

    def run(self) -> list[list[int]]:
        total = sum(map(sum, self.bins))
        least = max(-(-total // self.capacity), sum(2 * x > self.capacity for b in self.bins for x in b))
        left = sum(map(bool, self.bins))
        for _ in range(PASSES):
            steps = 0
            for source in sorted((i for i, b in enumerate(self.bins) if b and self.gap[i]), key=lambda i: -self.gap[i]):
                if left <= least:
                    break
                self.open[source] = False  # it gives, and takes no part in this pass any more
                while self.bins[source] and (best := self._step(source)):
                    self._give(source, *best)
                    steps += 1
                left -= not self.bins[source]
            if left <= least or not steps:
                break
            for i, b in enumerate(self.bins):  # the others have changed since
                if b and self.gap[i] and not self.open[i]:
                    self.open[i] = True
                    self._enter(i)
        return [b for b in self.bins if b]


def pack_lengths(lengths: Iterable[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of lengths up to the capacity: best fit, then the search."""
    return SwapSearch(best_fit(lengths, capacity), capacity).run()


def _pack_block(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece_key")
        lengths, keys = table["length"].to_pylist(), table["piece_key"].to_pylist()
        was = table["sequence_id"].to_pylist()
        if was[0] is None:
            bins = pack_lengths(lengths, capacity)
        else:
            held: dict[int, list[int]] = defaultdict(list)
            for s, n in zip(was, lengths, strict=True):
                held[s].append(n)
            bins = SwapSearch(list(held.values()), capacity).run()
        rows = defaultdict(deque)  # pieces of a length are alike to the search
        for i, n in enumerate(lengths):
            rows[n].append(i)
        sequence, offset, fill = ([0] * len(lengths) for _ in range(3))
        for b in bins:
            own = [rows[n].popleft() for n in sorted(b, reverse=True)]
            at, name, full = 0, keys[own[0]], sum(b)
            for i in own:
                sequence[i], offset[i], fill[i] = name, at, full
                at += lengths[i]
        for name, values in (("sequence_id", sequence), ("offset", offset), ("fill", fill)):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(values, pa.int64()))
        return table

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """pieces(length, ...) with piece_key, sequence_id (the key of the sequence's first piece) and offset. Give pieces no longer than the capacity.

    Rows that the search needs are narrow: leave ids out and join them by piece_key.
    """
    none = F.lit(None).cast("long")
    t = materialize(pieces.withColumn("piece_key", F.monotonically_increasing_id()), "pieces")
    done = [t.where(F.col("length") >= capacity).select("*", F.col("piece_key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    part = t.where(F.col("length") < capacity).select("*", none.alias("sequence_id"), none.alias("offset"), none.alias("fill"))
    n, by = part.count(), "piece_key"
    while n:
        blocks = -(-n // block_pieces)
        dealt = part.withColumn("block", F.pmod(F.xxhash64(by, F.lit(len(done))), F.lit(blocks)).cast("int")).repartition(blocks, "block")
        part = materialize(dealt.groupBy("block").applyInArrow(_pack_block(capacity), dealt.schema).drop("block"), "packed")
        far = part.where(F.col("fill") < FULL_ENOUGH * capacity)
        before, n = n, far.count() if blocks > 1 else 0
        if n > before // 2:  # nothing fits them; another round would find the same
            n = 0
        done.append((part.where(F.col("fill") >= FULL_ENOUGH * capacity) if n else part).drop("fill"))
        part, by = far, "sequence_id"
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def packed_sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: sequence_id, ids (array of int, at most the capacity), and pieces, an array of (offset, doc_id, piece, start, length)."""
    coded = materialize(encode_pieces(docs, path, capacity, keep_ids=True).withColumn("_at", F.monotonically_increasing_id()), "coded")
    placed = pack(coded.drop("ids"), capacity)
    whole = placed.join(coded.select("_at", "ids"), "_at")
    row = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    s = whole.groupBy("sequence_id").agg(F.sort_array(F.collect_list(row)).alias("p"))  # a sequence bounds its pieces

    @F.pandas_udf("array<int>")
    def joined(parts):
        return parts.map(lambda ids: np.frombuffer(b"".join(ids), "<u4").astype(np.int32))

    return s.select("sequence_id", joined(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("pieces"))


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, the least number of sequences that the tokens need, and the share of places filled."""
    s = placed.agg(F.count_if(F.col("offset") == 0).alias("sequences"), F.sum("length").alias("tokens"))
    return s.withColumn("least", F.ceil(F.col("tokens") / capacity)).withColumn("filled", F.col("tokens") / (F.col("sequences") * capacity))


def op11_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(encode_pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
