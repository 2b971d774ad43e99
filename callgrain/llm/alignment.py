"""Alignment of two tokenisations of the same texts, and corpus-wide counts of linked token pairs.

Side A is a byte-level vocabulary (the tokenizers library), side B a piece vocabulary
with byte fallback (sentencepiece). Both encode a space and the text. Where tokens of
both sides end at one byte, a group ends; tokens whose byte ranges overlap are linked.

Counting is external. A task encodes its documents and collects pair-document records
(A id, B id, document, links); when it holds RUN_RECORDS of them it closes a run: the
records are sorted side-major, radix-partitioned by the low bits of the A id, and written
as one zstandard frame a digit, its pairs with their number of documents apart from the
documents. Only the pairs are shuffled: per digit a k-way heap merge adds the counts of
the runs' equal pairs. It takes two steps, so that no task merges more than MERGED_RUNS
runs: the first leaves sums per set of runs, the second totals per digit and, as pairs
come side-major, the highest count of an A id when the next one begins. A third step
merges totals into each set's pairs and streams counts and best marks back to the runs,
where they are added up per document.

So a pair is one entry a run, however many documents hold it, and no group grows with
the documents but by one entry a run. A run is a row group of bounded size; a document
is never split over two, so one of very many different links makes a long run.

Defined cases: null, empty, and texts whose joined bytes on either side differ from the
space and the text have no tokens: zeros and an empty digest column. Null and repeated
doc_ids are rows of their own. Extra columns are left alone. No documents give no rows.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm.bytebpe import PART_CHARS, REMEMBERED, REMEMBERED_CHARS, ByteEncoder, byte_encoder, parts
from callgrain.llm.common import materialize, python_ready

RUN_RECORDS, RADIX_BITS, MERGED_RUNS = 2_000_000, 8, 512
SPACE = "▁"
B_BITS = 32
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Side:
    """What one vocabulary's ids stand for: their bytes, and their decimal numbers."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array(list(map(len, entries)), np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        numbers = np.array([str(i) for i in range(len(entries))], "S")
        self.digits = numbers.view(np.uint8).reshape(len(entries), -1)
        self.width = np.char.str_len(numbers).astype(np.int64)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after the other."""
        size = self.size[ids]
        at = np.arange(size.sum()) + np.repeat(self.start[ids] - np.cumsum(size) + size, size)
        return self.bytes[at]


def written(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, side_a: Side, side_b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Groups as text, `a1,a2|b1;` each, as bytes; and the place at which the text of each A id starts.

    A line of digits is made for every id, put at its place, and what is not used of it is left out.
    """
    groups = int(a_group[-1]) + 1 if len(a_group) else 0
    a_upto, b_upto = np.cumsum(np.bincount(a_group, minlength=groups)), np.cumsum(np.bincount(b_group, minlength=groups))
    a_at = np.arange(len(a)) + np.r_[0, b_upto][a_group]
    b_at = np.arange(len(b)) + a_upto[b_group]
    wide = max(side_a.digits.shape[1], side_b.digits.shape[1]) + 1
    lines, width = np.zeros((len(a) + len(b), wide), np.uint8), np.zeros(len(a) + len(b), np.int64)
    lines[a_at, : side_a.digits.shape[1]], lines[b_at, : side_b.digits.shape[1]] = side_a.digits[a], side_b.digits[b]
    width[a_at], width[b_at] = side_a.width[a], side_b.width[b]
    sign = np.full(len(lines), ord(","), np.uint8)
    sign[a_at[a_upto - 1]], sign[b_at[b_upto - 1]] = ord("|"), ord(";")
    lines[np.arange(len(lines)), width] = sign
    starts = np.cumsum(width + 1) - width - 1
    return lines[lines > 0], starts[a_at]


class Aligner:
    """Both encoders, and the alignment of texts as arrays.

    Long texts are cut before single spaces between two other characters: there a token
    ends on both sides, so groups and links of a text are those of its parts. That the
    pieces of a vocabulary allow it (none has the space sign after another character) is
    checked on loading; if they don't, texts are aligned whole.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a: ByteEncoder = byte_encoder(a_path, True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = range(self.b.get_piece_size())
        self.splits = self.a.splits and not any(SPACE in self.b.id_to_piece(i).lstrip(SPACE) for i in pieces)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.sides = Side([e or b"" for e in self.a.entry]), Side([self._piece(i) for i in pieces])

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[1:-1], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode()

    def _parts(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
        """Parts of texts, each to be read after a space, and the places of their texts: about PART_CHARS at a time."""
        docs: list[int] = []
        held: list[str] = []
        size = 0
        for k, text in enumerate(texts):
            if not text:
                continue
            first, *more = parts(text) if self.splits and not self.a.whole(text) else [text]
            for part in (first, *(m[1:] for m in more)):
                docs.append(k)
                held.append(part)
                size += len(part)
                if size >= PART_CHARS:
                    yield docs, held
                    docs, held, size = [], [], 0
        if held:
            yield docs, held

    def _ids(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of both sides of texts, each after a space, by the libraries."""
        return list(zip(self.a.encode_all([" " + t for t in texts]), [np.array(x, "<u4").tobytes() for x in self.b.encode(texts, num_threads=1)], strict=True))

    def _coded(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of both sides; those of words between single spaces are remembered, in two generations."""
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        split = [t.split(" ") if self.splits and self.a.apart(t) else None for t in texts]
        found = [list(map(self.known.get, ws)) if ws else [] for ws in split]
        lacking = {w for ws, got in zip(split, found, strict=True) if None in got for w, v in zip(ws, got, strict=True) if v is None}
        now = {w: v for w in lacking if (v := self.older.get(w)) is not None}
        new = [w for w in lacking if w not in now]
        now.update(zip(new, self._ids(new), strict=True))
        self.known.update((w, v) for w, v in now.items() if len(w) <= REMEMBERED_CHARS)
        whole = iter(self._ids([t for t, ws in zip(texts, split, strict=True) if ws is None]))
        out = []
        for ws, got in zip(split, found, strict=True):
            if ws is None:
                out.append(next(whole))
                continue
            both = [v if v is not None else now[w] for w, v in zip(ws, got, strict=True)]
            out.append((b"".join([v[0] for v in both]), b"".join([v[1] for v in both])))
        return out

    def align(self, texts: list[str | None]) -> tuple[list[tuple[int, int, int, int, str]], np.ndarray, np.ndarray, np.ndarray]:
        """Per text its numbers of A ids, B ids, groups and links, and the digest of its groups; and, as arrays, the
        different pairs (A id << 32 | B id) of each text (its place in the list) with their links."""
        total, bad = np.zeros((len(texts), 4), np.int64), np.array([not t for t in texts], bool)
        digests = [hashlib.sha256() for _ in texts]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for docs, held in self._parts(texts):
            found.append(self._align(np.array(docs), held, total, bad, digests))
        doc, key, links = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        if len(found) > 1:  # a text may have parts in several
            order = np.lexsort((key, doc))
            doc, key, links = doc[order], key[order], links[order]
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]) if len(doc) else np.zeros(0, np.int64)
            doc, key, links = doc[first], key[first], np.add.reduceat(links, first) if len(first) else links
        total[bad] = 0
        good = ~bad[doc]
        return [(*r, "" if b else d.hexdigest()) for r, b, d in zip(total.tolist(), bad.tolist(), digests, strict=True)], doc[good], key[good], links[good]

    def _align(self, docs: np.ndarray, held: list[str], total: np.ndarray, bad: np.ndarray, digests: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wanted = [(" " + t).encode() for t in held]
        length = np.array(list(map(len, wanted)), np.int64)
        coded = self._coded(held)
        counts = tuple(np.array([len(x[s]) // 4 for x in coded], np.int64) for s in (0, 1))
        ids = tuple(np.frombuffer(b"".join([x[s] for x in coded]), "<u4").astype(np.int64) for s in (0, 1))
        keep = np.ones(len(held), bool)
        for side, x, n in zip(self.sides, ids, counts, strict=True):
            part = np.repeat(np.arange(len(held)), n)
            keep &= np.bincount(part, side.size[x], len(held)) == length
        for side, x, n in zip(self.sides, ids, counts, strict=True):  # of those with the right length, the bytes
            some = b"".join([w for w, k in zip(wanted, keep.tolist(), strict=True) if k])
            differs = np.flatnonzero(side.joined(x[np.repeat(keep, n)]) != np.frombuffer(some, np.uint8))
            if len(differs):
                own = np.flatnonzero(keep)
                keep[own[np.unique(np.searchsorted(np.cumsum(length[own]), differs, side="right"))]] = False
        bad[docs[~keep]] = True
        (a, b), (n_a, n_b) = (x[np.repeat(keep, n)] for x, n in zip(ids, counts, strict=True)), (n[keep] for n in counts)
        docs, length = docs[keep], length[keep]
        if not len(a):
            none = np.zeros(0, np.int64)
            return none, none, none
        # places at which tokens end, one after the other over all parts; the ends of parts are among them on both sides
        in_a, in_b = np.zeros(length.sum() + 1, bool), np.zeros(length.sum() + 1, bool)
        a_end, b_end = np.cumsum(self.sides[0].size[a]), np.cumsum(self.sides[1].size[b])
        in_a[a_end] = in_b[b_end] = True
        common = in_a & in_b
        upto = np.cumsum(common) - common  # groups that ended before
        cut = np.flatnonzero(in_a | in_b)  # between two cuts lies one link
        i, j = np.cumsum(in_a)[cut] - in_a[cut], np.cumsum(in_b)[cut] - in_b[cut]
        part_a, part_b = np.repeat(np.arange(len(docs)), n_a), np.repeat(np.arange(len(docs)), n_b)
        part = part_a[i]
        ends = np.flatnonzero(common)
        numbers = n_a, n_b, np.bincount(part_a[np.cumsum(in_a)[ends] - 1], minlength=len(docs)), np.bincount(part, minlength=len(docs))
        for c, n in enumerate(numbers):
            np.add.at(total[:, c], docs, n)
        text, at = written(a, b, upto[a_end], upto[b_end], *self.sides)
        first = np.r_[0, np.cumsum(n_a)[:-1]]
        bounds = [*at[first].tolist(), len(text)]
        view = memoryview(text)
        for k, d in enumerate(docs.tolist()):
            if k and docs[k - 1] == d or self._begun is digests[d]:
                digests[d].update(b";")
            digests[d].update(view[bounds[k] : bounds[k + 1] - 1])
            self._begun = digests[d]
        # one number for document and pair, sorted at once
        wide_b = int(self.sides[1].size.size - 1).bit_length()
        wide = wide_b + int(self.sides[0].size.size - 1).bit_length()
        both = docs[part] << wide | a[i] << wide_b | b[j]
        both.sort()
        one = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        links, both = np.diff(np.r_[one, len(both)]), both[one]
        a_of, b_of = both >> wide_b & (1 << wide - wide_b) - 1, both & (1 << wide_b) - 1
        return both >> wide, a_of << B_BITS | b_of, links

    _begun: object = None


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length or several, as one zstandard frame; ascending ones should be given as differences."""
    import zstandard

    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], "<i8")
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(a.tobytes() for a in arrays)]))


def unsqueeze(frame: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(frame)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    head, at, out = np.frombuffer(data, "<i8", 2 * n, 8).tolist(), 8 + 16 * n, []
    for size, width in zip(head[::2], head[1::2], strict=True):
        out.append(np.frombuffer(data, f"<i{width}", size, at))
        at += size * width
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype("<i4" if not len(values) or values.max() < 1 << 31 else "<i8")


def count_links(docs: DataFrame, a_path: str, b_path: str, run_records: int = RUN_RECORDS) -> DataFrame:
    """Runs of docs(doc_id, text): run, digit, pairs (frame: pairs as differences, documents of each), docs (frame: documents, links); digit -1 has
    the documents' own numbers instead."""
    python_ready(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # no cycles here, and scanning what is remembered takes time
        both, part = aligner(a_path, b_path), TaskContext.get().partitionId()
        ids, rows, held, size, runs = [], [], [], 0, 0
        radix = (1 << RADIX_BITS) - 1

        def close() -> pa.RecordBatch:
            doc, key, links = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in range(3))
            digit = (key >> B_BITS) & radix
            order = np.lexsort((doc, key, digit))
            doc, key, links, digit = doc[order], key[order], links[order], digit[order]
            number = part << 20 | runs
            numbers = np.array([r[:4] for r in rows], np.int64).T
            doc_ids = np.array([0 if x is None else x for x in ids], np.int64)
            named = np.array([x is not None for x in ids], np.int8)
            digests = np.frombuffer(b"".join(bytes.fromhex(r[4]) if r[4] else bytes(32) for r in rows), np.int8)
            out = [(number, -1, squeeze(doc_ids, named, *numbers), squeeze(digests))]
            cuts = np.flatnonzero(np.r_[True, digit[1:] != digit[:-1]]) if len(digit) else []
            for a, b in zip(cuts, [*cuts[1:], len(digit)], strict=True):
                k = key[a:b]
                first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                head = squeeze(np.diff(k[first], prepend=0), _narrow(np.diff(np.r_[first, b - a])))
                out.append((number, int(digit[a]), head, squeeze(_narrow(doc[a:b]), _narrow(links[a:b]))))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["run", "digit", "pairs", "docs"])

        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(texts), 100):
                own, doc, key, links = both.align(texts[at : at + 100])
                held.append((doc + len(rows), key, links))
                rows += own
                ids += doc_ids[at : at + 100]
                size += len(key)
                if size >= run_records:
                    yield close()
                    ids, rows, held, size, runs = [], [], [], 0, runs + 1
        if rows:
            yield close()
        gc.enable()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "run long, digit int, pairs binary, docs binary")


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """k-way heap merge of runs of (ascending pairs, counts): every pair with its sum, ascending, so A ids come one after the other."""
    heads = [(int(k[0]), r, 0) for r, (k, _) in enumerate(runs) if len(k)]
    heapq.heapify(heads)
    lists = [(k.tolist(), c.tolist()) for k, c in runs]
    now, total = -1, 0
    while heads:
        key, r, i = heads[0]
        keys, counts = lists[r]
        if key != now:
            if now >= 0:
                yield now, total
            now, total = key, 0
        total += counts[i]
        if i + 1 < len(keys):
            heapq.heapreplace(heads, (keys[i + 1], r, i + 1))
        else:
            heapq.heappop(heads)
    if now >= 0:
        yield now, total


def _opened(frames: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.cumsum(k), c.astype(np.int64)) for k, c in map(unsqueeze, frames)]


def with_best(pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, bool]]:
    """Side-major pairs with counts, and whether the count is the highest of the A id; one A id is held at a time."""
    held: list[tuple[int, int]] = []
    for key, n in chain(pairs, [(-1, 0)]):
        if held and key >> B_BITS != held[0][0] >> B_BITS:
            most = max(c for _, c in held)
            yield from ((k, c, c == most) for k, c in held)
            held = []
        held.append((key, n))


def _sums(table: pa.Table) -> pa.Table:
    """First merge: the sums of one digit in one set of runs."""
    out = list(merged(_opened(table["pairs"].to_pylist())))
    frame = squeeze(np.diff(np.array([k for k, _ in out], np.int64), prepend=0), np.array([c for _, c in out], np.int64))
    return pa.table({"digit": table["digit"][:1], "pairs": pa.array([frame], pa.binary())})


def _totals(table: pa.Table) -> pa.Table:
    """Second merge: totals and best marks of one digit."""
    out = list(with_best(merged(_opened(table["pairs"].to_pylist()))))
    frame = squeeze(np.diff(np.array([k for k, _, _ in out], np.int64), prepend=0), np.array([c for _, c, _ in out], np.int64), np.array([b for _, _, b in out], np.int8))
    return pa.table({"digit": table["digit"][:1], "totals": pa.array([frame], pa.binary())})


def _returned(runs: pa.Table, totals: pa.Table) -> pa.Table:
    """Third step: counts and best marks for the pairs of each run of one digit and set."""
    out = []
    if runs.num_rows:
        key, count, best = unsqueeze(totals["totals"][0].as_py())
        key = np.cumsum(key)
        for frame in runs["pairs"].to_pylist():
            at = np.searchsorted(key, np.cumsum(unsqueeze(frame)[0]))
            out.append(squeeze(_narrow(count[at]), best[at]))
    return pa.table({"run": runs["run"], "digit": runs["digit"], "back": pa.array(out, pa.binary())})


def _added(run: pa.Table, back: pa.Table) -> pa.Table:
    """The documents of one run with their sums."""
    frames = {d: (p, q) for d, p, q in zip(run["digit"].to_pylist(), run["pairs"].to_pylist(), run["docs"].to_pylist(), strict=True)}
    own, digests = frames.pop(-1)
    doc_ids, named, *numbers = unsqueeze(own)
    digests = unsqueeze(digests)[0].tobytes()
    best, total = np.zeros(len(doc_ids), np.int64), np.zeros(len(doc_ids), np.int64)
    for d, frame in zip(back["digit"].to_pylist(), back["back"].to_pylist(), strict=True):
        (_, held), (doc, links), (count, mark) = unsqueeze(frames[d][0]), unsqueeze(frames[d][1]), unsqueeze(frame)
        np.add.at(total, doc, links.astype(np.int64) * np.repeat(count, held))
        np.add.at(best, doc, links.astype(np.int64) * np.repeat(mark, held))
    shown = [digests[32 * i : 32 * i + 32].hex() if n else "" for i, n in enumerate(numbers[0].tolist())]
    columns = {"doc_id": pa.array(doc_ids, mask=named == 0), **dict(zip(("n_a", "n_b", "n_groups", "n_links"), map(pa.array, numbers), strict=True))}
    return pa.table({**columns, "n_best": best, "count_sum": total, "groups_sha256": pa.array(shown, pa.string())})


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, run_records: int = RUN_RECORDS, merged_runs: int = MERGED_RUNS) -> DataFrame:
    """Per document of docs(doc_id, text) its alignment in numbers: see OUT. Paths must exist on every executor."""
    default = vocabulary_paths()
    runs = materialize(count_links(docs, a_path or default[0], b_path or default[1], run_records), "runs")
    n_runs = runs.where("digit = -1").count()
    sets = max(1, -(-n_runs // merged_runs))
    heads = runs.where("digit >= 0").select("run", "digit", "pairs", F.pmod(F.xxhash64("run"), F.lit(sets)).cast("int").alias("part"))
    sums = heads.groupBy("digit", "part").applyInArrow(_sums, "digit int, pairs binary")
    totals = materialize(sums.groupBy("digit").applyInArrow(_totals, "digit int, totals binary"), "totals")
    spread = totals.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    back = heads.groupBy("digit", "part").cogroup(spread.groupBy("digit", "part")).applyInArrow(_returned, "run long, digit int, back binary")
    return runs.groupBy("run").cogroup(back.groupBy("run")).applyInArrow(_added, OUT)


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, run_records: int = RUN_RECORDS, merged_runs: int = MERGED_RUNS) -> DataFrame:
    """The counted pairs themselves: a_id, b_id, docs (documents that hold them linked), best (highest of its A id, ties included)."""
    default = vocabulary_paths()
    runs = materialize(count_links(docs, a_path or default[0], b_path or default[1], run_records), "runs")
    sets = max(1, -(-runs.where("digit = -1").count() // merged_runs))
    heads = runs.where("digit >= 0").select("digit", "pairs", F.pmod(F.xxhash64("run"), F.lit(sets)).cast("int").alias("part"))
    sums = heads.groupBy("digit", "part").applyInArrow(_sums, "digit int, pairs binary")

    def listed(table: pa.Table) -> pa.Table:
        out = list(with_best(merged(_opened(table["pairs"].to_pylist()))))
        low = (1 << B_BITS) - 1
        return pa.table({"a_id": [k >> B_BITS for k, _, _ in out], "b_id": [k & low for k, _, _ in out], "docs": [c for _, c, _ in out], "best": [b for _, _, b in out]})

    return sums.groupBy("digit").applyInArrow(listed, "a_id long, b_id long, docs long, best boolean")


def op13_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
