"""Token ids in seekable binary files: independent zstandard frames and a trailing seek table.

A file holds documents in ascending doc_id order as little-endian unsigned 32-bit ids:

* data: zstandard frames, each with whole documents of about FRAME_IDS ids together
  (a document far longer than that is cut into several frames);
* index: one skippable frame with doc_id, null flag and number of ids of each document;
* seek table: the public seekable format's skippable frame, with compressed size, size
  and checksum (low 32 bits of XXH64 of the content) of each data frame.

A reader takes the two tables from the end of the file and decompresses only the frames
that hold the documents it was asked for; every frame read is held against its checksum.

Defined cases: null and empty texts have the end id alone. Null doc_ids come first.
Repeated doc_ids stand next to each other, in order of a hash of their texts. Extra columns are left alone.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgrain.llm.common import fresh_dir, materialize, open_folder, python_ready, write_whole

# fixed values of the public zstandard seekable format
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

FRAME_IDS = 1 << 16
REMEMBERED, REMEMBERED_CHARS = 500_000, 64  # stretches in each of two generations
END_ID = 2
READ_ROWS = 20_000  # handed over together
_WORD = re.compile("[^ \t\n\x0b\x0c\r]+")
# runs of ASCII signs and digits that touch no apostrophe
_RUN = re.compile(r"(?<![!-@\[-`{-~])([!-&(-@\[-`{-~]++)(?!')")
_ODD = re.compile(r"[^\x00-\x7f\w]|İ")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# fixed values: the settings of a vocabulary that stretches() may split for
SPLITTING = {
    "normalizer": [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)],
    "pre_tokenizer": [("Split", "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"), ("ByteLevel", None)],
    "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False},
}


def splits_at_space(settings: dict) -> bool:
    """Whether a tokenizer has the settings in SPLITTING, and no added token but those that start with `<|`."""

    def steps(key: str) -> list[tuple[str, str | None]]:
        part = settings.get(key) or {}
        listed = part.get("normalizers") or part.get("pretokenizers") or []
        return [(x["type"], x["pattern"].get("Regex") if "pattern" in x else None) for x in listed]

    model = {k: settings["model"].get(k) for k in SPLITTING["model"]}
    added = all(x["content"].startswith("<|") and not (x["lstrip"] or x["rstrip"]) for x in settings["added_tokens"])
    return added and model == SPLITTING["model"] and all(steps(k) == SPLITTING[k] for k in ("normalizer", "pre_tokenizer"))


class WordEncoder:
    """Encodes whole texts with the tokenizers library.

    The vocabulary drops white space and no token crosses it, so a text's ids are those
    of its stretches, and those of a stretch are remembered. New stretches of letters
    alone go to the library many at a time, joined by spaces; each ends with the only
    piece in it that ends a word. For ASCII letters, which are lower-cased here, the
    vocabulary's normaliser and splitter would change nothing and are left out. All this
    holds for vocabularies with the settings in SPLITTING, which is checked on loading;
    texts are given to any other vocabulary whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.splits = splits_at_space(json.loads(self.tokenizer.to_str()))
        # for lower-case ASCII letters, normalising and byte mapping change nothing
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        # stretches and their parts, in two generations: what is used while the newer one fills survives when the older one goes
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _each(self, parts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(parts), 1024):
            coded = self.tokenizer.encode_batch_fast(parts[at : at + 1024], add_special_tokens=False)
            out += [np.array(e.ids, "<u4").tobytes() for e in coded]
        return out

    def _joined(self, parts: list[str], tokenizer) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):  # a letter to Python that is none to the library
                out += self._each(some)
                continue
            data, last = ids.tobytes(), 0
            for c in (4 * cuts).tolist():
                out.append(data[last:c])
                last = c
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if not self.splits:
            return self._each([t or "" for t in texts])
        split = [stretches(t) if t else [] for t in texts]
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        words = list(set().union(*split))
        now = dict(zip(words, map(known.get, words), strict=True))  # small, so that most lookups stay near
        plain: list[str] = []
        letters: list[str] = []
        rest: list[str] = []
        for w in [w for w, value in now.items() if value is None]:
            value = older.get(w)
            if value is not None:
                known[w] = now[w] = value
            elif not w.isalpha():
                rest.append(w)
            else:
                (plain if w.isascii() else letters).append(w)
        coded = ((plain, self._joined(list(map(str.lower, plain)), self.plain)), (letters, self._joined(letters, self.tokenizer)), (rest, self._each(rest)))
        for group, values in coded:
            now.update(zip(group, values, strict=True))
            known.update((w, v) for w, v in zip(group, values, strict=True) if len(w) <= REMEMBERED_CHARS)
        return [b"".join(map(now.__getitem__, ws)) for ws in split]


def stretches(text: str) -> list[str]:
    """Parts of a text, in order, that no token crosses: what stands between white space, with runs of ASCII signs and digits apart.

    The vocabulary's own splitting cuts between letters and such a run, too. Not so with
    an apostrophe, which starts contractions, with `<|`, which may start a special token,
    with other signs, which may compose or join with their neighbours, and with U+0130,
    whose lower case has such a sign. str.split takes four control characters for white
    space that the library doesn't.
    """
    if text.isascii():
        if "<|" not in text:
            text = _RUN.sub(r" \1 ", text.lower())
    elif "<|" not in text and not _ODD.search(text):
        text = _RUN.sub(r" \1 ", text)
    return _WORD.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class TokenFileWriter:
    def __init__(self, out):
        import zstandard

        self.out, self.zstd = out, zstandard.ZstdCompressor(level=1)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, bool, int]] = []
        self.held: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= 4 * FRAME_IDS:
            self._frames()

    def _frames(self) -> None:
        import xxhash

        data = b"".join(self.held)
        step = 4 * FRAME_IDS if len(data) > 64 * FRAME_IDS else len(data)
        for at in range(0, len(data), step or 1):
            part = data[at : at + step]
            packed = self.zstd.compress(part)
            self.out.write(packed)
            self.frames.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        self._frames()
        table = b"".join(struct.pack("<q?Q", *d) for d in self.docs)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(table)) + table)
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        tail = struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(tail)) + entries + tail)


def read_tables(f) -> tuple[list[tuple[int, int, int]], list[tuple[int | None, int]]]:
    """Frames and documents of an open random-access file, from its end."""
    size = f.size()
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEK_MAGIC or not flags & HAS_CHECKSUMS:
        raise ValueError("not a token file")
    f.seek(size - 9 - 12 * n)
    frames = list(struct.iter_unpack("<III", f.read(12 * n)))
    f.seek(sum(x[0] for x in frames))
    magic, length = struct.unpack("<II", f.read(8))
    if magic != SKIPPABLE_INDEX:
        raise ValueError("the document index is missing")
    return frames, [(None if null else d, k) for d, null, k in struct.iter_unpack("<q?Q", f.read(length))]


def read_documents(f, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, ids before it in this file, its ids as bytes) of the wanted documents, or of all.

    Only frames that hold wanted documents are read and decompressed.
    """
    import xxhash
    import zstandard

    frames, docs = read_tables(f)
    zstd = zstandard.ZstdDecompressor()
    places = np.cumsum([0, *(x[0] for x in frames)])
    ends = np.cumsum([x[1] for x in frames]) if frames else np.zeros(0, np.int64)
    held: tuple[int, bytes] = (-1, b"")
    before = 0
    for doc_id, k in docs:
        start, end = 4 * before, 4 * (before + k)
        before += k
        if wanted is not None and doc_id not in wanted:
            continue
        parts = []
        i = int(np.searchsorted(ends, start, side="right"))
        while k and i < len(frames) and (ends[i] - frames[i][1]) < end:
            if held[0] != i:
                f.seek(int(places[i]))
                data = zstd.decompress(f.read(frames[i][0]), max_output_size=max(1, frames[i][1]))
                if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != frames[i][2]:
                    raise ValueError(f"frame {i} is damaged")
                held = (i, data)
            low = int(ends[i]) - frames[i][1]
            parts.append(held[1][max(0, start - low) : end - low])
            i += 1
        yield doc_id, start // 4, b"".join(parts)


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Encode docs(doc_id, text) and write the files: part, file, n_docs, n_ids, one row per file, parts in doc_id order."""
    python_ready(docs.sparkSession)
    filesystem, root = open_folder(folder)
    filesystem.create_dir(root, recursive=True)
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # no cycles here, and scanning the remembered words takes time
        encoder, task = word_encoder(path), TaskContext.get()
        fs, top = open_folder(folder)
        name, counts = f"part-{task.partitionId():06d}.zst", [0, 0]

        def body(out) -> None:
            writer = TokenFileWriter(out)
            for b in batches:
                texts, ids = b.column(1).to_pylist(), b.column(0).to_pylist()
                for at in range(0, len(ids), 100):
                    for doc_id, coded in zip(ids[at : at + 100], encoder.encode_all(texts[at : at + 100]), strict=True):
                        writer.add(doc_id, coded + end)
                        counts[0] += 1
                        counts[1] += len(coded) // 4 + 1
            writer.close()

        write_whole(fs, f"{top}/{name}", task.taskAttemptId(), body)
        gc.enable()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (task.partitionId(), name, *counts)], ["part", "file", "n_docs", "n_ids"])

    # the rows of one doc_id, however many, are dealt over several files by their texts
    order = [F.col("doc_id").asc_nulls_first(), F.col("_text")]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_text")).repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order, "text").drop("_text")
    return materialize(dealt.mapInArrow(write, "part long, file string, n_docs long, n_ids long"), "tokens")


def read_token_files(index: DataFrame, folder: str) -> DataFrame:
    """Read every document back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    n = max(1, index.count())
    bases = index.withColumn("base", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))  # one row per file

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_folder(folder)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{top}/{name}") as f:
                    found = ((doc_id, base + start, len(data) // 4, zlib.crc32(data)) for doc_id, start, data in read_documents(f))
                    while rows := list(islice(found, READ_ROWS)):
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = bases.select("file", F.col("base").cast("long").alias("base")).repartition(n)
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = fresh_dir(spark, "tokenfiles")
    index = write_token_files(docs, folder, vocabulary_path())
    return read_token_files(index, folder)
