"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from the model file and composed with each input:

* the normaliser: an arc that reads nothing and writes U+2581, taken once in front of a
  text (only if the model says so), and one that reads a space and writes U+2581; other
  characters are copied. The second is composed with the piece machine on loading, so the
  machine reads spaces of the input itself;
* the piece machine: a trie of the vocabulary. A path through it reads the characters of
  a piece, writes its id and costs the piece's negated score. The state it ends in is that
  piece. In a unigram model every piece may follow every other at no further cost, so the
  scores alone decide. In a merge (BPE) model the arc from piece s to piece t costs
  nothing more if merging s + t leaves the two as they are, else infinity. Of two pieces,
  each knows how its inner and outer edge grow while it is merged (`Track`); running two
  tracks side by side shows whether a merge across them comes first;
* byte fallback: an arc that reads a character of no piece and writes its UTF-8 bytes'
  ids, behind and before any piece. It costs ten more than the worst piece in a unigram
  model; in a merge model, where no path can avoid it, nothing.

The encoding is the shortest path in the tropical semiring: states are pairs of position
and last piece, relaxed from left to right, and the least sum of costs wins; of equals,
the one whose last piece begins first. In a merge model a sequence of pieces whose
neighbours all pass is what merging makes of the whole text, so one path has a finite
cost. Costs are summed in double precision. The library sums those of unigram models in
single precision, over the whole text: of paths whose costs are equal, or differ by less
than that rounding, it may take another one (&&& as && & instead of & &&).

No piece has U+2581 behind another character, and none holds a fallback character (both
are checked on loading). So paths through different stretches of text are independent,
and a stretch's path is remembered in a bounded table. Models with other settings
(word or character models, a table of character replacements, removal of extra white space,
suffix white space, user-defined or unused pieces, no byte fallback) are refused.

Decoding is the inverse machine: pieces to characters, runs of bytes through UTF-8 with
U+FFFD for each invalid byte, U+2581 to a space, and the added first space dropped. A
U+2581 of the text itself comes back as a space, as it does in the library.

Defined cases: null text is empty text, which has no ids. Extra columns are left alone.
"""

from __future__ import annotations

import codecs
import itertools
import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.llm.common import packed, python_ready

SPACE = "▁"
REMEMBERED, REMEMBERED_CHARS, PAIRS = 400_000, 64, 1_000_000
codecs.register_error("one-by-one", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values of the public model format: kinds of pieces
UNIGRAM_MODEL, MERGE_MODEL = 1, 2
FALLBACK_COST = 10.0  # fixed value: how much more a character of no piece costs than the worst piece
START = -1  # the state in front of the text, and behind a fallback character
END = ""  # the trie's key of a finished piece


class Track:
    """How the edges of a piece grow while its characters are merged.

    steps: scores of its merges, in order; left and right: the outermost parts before
    each of them, and at the end. whole: whether all of it becomes one part.
    """

    __slots__ = ("left", "right", "steps", "whole")

    def __init__(self, piece: str, score: dict[str, float]):
        parts = list(piece)
        self.steps, self.left, self.right = [], [parts[0]], [parts[-1]]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.steps.append(best)
            self.left.append(parts[0])
            self.right.append(parts[-1])
        self.steps.append(-math.inf)
        self.whole = len(parts) == 1


class PieceMachine:
    """The compiled machines of one unigram or merge model."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, [p.type for p in model.pieces]
        self.text = [p.piece for p in model.pieces]
        self.bytes = {i: int(self.text[i][3:5], 16) for i, k in enumerate(kinds) if k == BYTE}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.silent = {i for i, k in enumerate(kinds) if k in (UNKNOWN, CONTROL)}
        self.unknown = kinds.index(UNKNOWN)
        self.id = {p: i for i, p in enumerate(self.text) if kinds[i] == NORMAL}
        self.score = {p: model.pieces[i].score for p, i in self.id.items()}
        chars = set("".join(self.id))
        self.merges = model.trainer_spec.model_type == MERGE_MODEL
        if model.trainer_spec.model_type not in (UNIGRAM_MODEL, MERGE_MODEL) or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or len(self.byte_id) != 256:
            raise ValueError("only unigram and merge models with byte fallback and plain pieces are supported")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("this model's normaliser is not supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.id) or any(c not in self.id for c in chars):
            raise ValueError("this vocabulary has pieces that cross words, or whose characters are none")
        self.prefix, self.arcs = SPACE if spec.add_dummy_prefix else "", {" ": SPACE}
        self.trie: dict = {}
        for p, i in self.id.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[END] = i
        self._compose(self.trie)
        self.start = self._flat(self.trie, {})
        # what each id is in the output; None for silent ones
        self.spelled = [bytes([self.bytes[i]]) if i in self.bytes else " ⁇ ".encode() if i == self.unknown else None if i in self.silent else p.encode() for i, p in enumerate(self.text)]
        self.cost = [-p.score for p in model.pieces]
        self.fallback = 0.0 if self.merges else max((self.cost[i] for i in self.id.values()), default=0.0) + FALLBACK_COST
        self.tracks: list[Track | None] = [None] * len(self.text)
        # letters and other characters part too if no piece holds both behind its leading U+2581
        odd = "".join(sorted(c for c in chars if re.match(r"[^\W\d_]", c) and not c.isalpha()))
        letter, other = f"[^\\W\\d_{odd}]", f"(?:[\\d_{odd}]|[^\\w{SPACE}{''.join(self.arcs)}])"
        mixed = any(re.search(letter, q) and re.search(other, q) for q in (p.lstrip(SPACE) for p in self.id))
        gap = f"[{SPACE}{''.join(self.arcs)}]"  # what the normaliser makes U+2581 of
        self.stretch = re.compile(f"{gap}*[^{gap[1:]}+|{gap}+" if mixed else f"{gap}*(?:{letter}+|{other}+)|{gap}+")
        self.joins: dict[int, float] = {}
        self.known: dict[str, bytes] = {}

    def _compose(self, node: dict) -> None:
        """The normaliser's arcs in front of the piece machine: what it reads leads where what it writes does."""
        for c, below in list(node.items()):
            if c != END:
                self._compose(below)
        for read, write in self.arcs.items():
            if write in node:
                node[read] = node[write]
            else:
                node.pop(read, None)

    def _flat(self, node: dict, done: dict) -> tuple[int, dict]:
        """A node as (id of the piece that ends there or -1, nodes below), which takes one lookup a character; shared nodes stay shared."""
        found = done.get(id(node))
        if found is None:
            found = done[id(node)] = (node.get(END, -1), {c: self._flat(below, done) for c, below in node.items() if c != END})
        return found

    def track(self, t: int) -> Track:
        found = self.tracks[t]
        if found is None:
            found = self.tracks[t] = Track(self.text[t], self.score)
        return found

    def join(self, s: int, t: int) -> float:
        """The cost of reading piece t in state s: nothing or infinity."""
        key = s << 20 | t
        cost = self.joins.get(key)
        if cost is None:
            if len(self.joins) >= PAIRS:
                self.joins.clear()
            cost = self.joins[key] = 0.0 if self._apart(s, t) else math.inf
        return cost

    def _apart(self, s: int, t: int) -> bool:
        """Whether merging s + t ends in these two: no merge across them is ever the next, the best one or the first of equals."""
        b = self.track(t)
        if s == START:
            return b.whole
        a, score, i, j = self.track(s), self.score, 0, 0
        if not (a.whole and b.whole):
            return False
        while True:
            x, y, across = a.steps[i], b.steps[j], score.get(a.right[i] + b.left[j])
            if across is not None and across > x and across >= y:
                return False
            if x == y == -math.inf:
                return True
            if x >= y:
                i += 1
            else:
                j += 1

    def shortest(self, s: str) -> tuple[float, list[int]]:
        """Cost and ids of the shortest path through a stretch: positions in order, each relaxing what its arcs reach.

        In a unigram model the last piece bars no arc. In a merge model what a finite path
        has read is merged to the pieces that it wrote, and merging has one result. So in
        both the cheapest state of a position stands for all of its states.
        """
        n, inf, first, cost, joins, merges = len(s), math.inf, self.start[1], self.cost, self.joins, self.merges
        dist, state, back = [inf] * (n + 1), [START] * (n + 1), [0] * (n + 1)
        dist[0] = 0.0
        for pos in range(n):
            d = dist[pos]
            if d == inf:
                continue
            node, at, last = first.get(s[pos]), pos + 1, state[pos] << 20
            if node is None and d + self.fallback < dist[at]:
                dist[at], state[at], back[at] = d + self.fallback, START, pos
            while node is not None:
                t, below = node
                if t >= 0 and (total := d + cost[t]) < dist[at]:
                    w = 0.0
                    if merges:
                        w = joins.get(last | t)
                        if w is None:
                            w = self.join(last >> 20, t)
                    if w == 0.0:
                        dist[at], state[at], back[at] = total, t, pos
                if at == n:
                    break
                node, at = below.get(s[at]), at + 1
        if dist[n] == inf:
            raise ValueError("no path")
        pos, out = n, []
        while pos:
            if state[pos] == START:
                out.extend(self.byte_id[b] for b in reversed(s[back[pos]].encode("utf-8", "surrogatepass")))
            else:
                out.append(state[pos])
            pos = back[pos]
        return dist[n], out[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.zeros(0, np.uint32)
        known, stretches = self.known, self.stretch.findall(self.prefix + text)
        out = list(map(known.get, stretches))
        if None in out:
            now: dict[str, bytes] = {}
            for k, (s, got) in enumerate(zip(stretches, out, strict=True)):
                if got is None:
                    got = now.get(s)
                    if got is None:
                        got = now[s] = struct.pack(f"<{len(ids := self.shortest(s)[1])}I", *ids)
                    out[k] = got
            for s, got in now.items():
                if len(s) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[s] = got
        return np.frombuffer(b"".join(out), "<u4")

    def _spelled(self, ids: list[int]) -> str:
        """Pieces are whole characters, so bytes beside them neither add to them nor take from them; silent ids part runs of bytes."""
        out = list(map(self.spelled.__getitem__, ids))
        if None not in out:
            return b"".join(out).decode("utf-8", "one-by-one")
        at = [-1, *(k for k, b in enumerate(out) if b is None), len(out)]
        return "".join(b"".join(out[i + 1 : j]).decode("utf-8", "one-by-one") for i, j in itertools.pairwise(at))

    def decode(self, ids) -> str:
        text = self._spelled(ids).replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_MACHINES: dict[str, PieceMachine] = {}


def machine(path: str) -> PieceMachine:
    """One machine per worker process and vocabulary."""
    if path not in _MACHINES:
        _MACHINES[path] = PieceMachine(path)
    return _MACHINES[path]


def encoder(path: str) -> Callable[[Column], Column]:
    """Column function: text to array<int> of ids. path must exist on every executor."""

    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = machine(path)
        for texts in parts:
            yield pd.Series([m.encode(t).astype(np.int32) for t in texts])

    return encode


def decoder(path: str) -> Callable[[Column], Column]:
    """Column function: ids to text; null ids give null."""

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = machine(path)
        for rows in parts:
            yield pd.Series([None if r is None else m.decode(r.tolist()) for r in rows])

    return decode


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens and token_ids of every document; rows that repeat stay repeated."""
    python_ready(docs.sparkSession)
    encode = encoder(path or vocabulary_path())
    coded = packed(docs.select("doc_id", "source", "text")).withColumn("token_ids", encode(F.col("row.text")))
    return coded.select("row.doc_id", "row.source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every document: doc_id, n_tokens, ids_crc32, whether decoding gives the text back, and its length."""
    python_ready(docs.sparkSession)
    path = path or vocabulary_path()

    @F.pandas_udf("n_tokens long, ids_crc32 long, decoded_chars long, round_trip boolean")
    def measure(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = machine(path)
        for texts in parts:
            rows = []
            for t in texts:
                ids = m.encode(t)
                back = m.decode(ids.tolist())
                rows.append((len(ids), zlib.crc32(ids.tobytes()), len(back), back == (t or "").replace(SPACE, " ")))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_crc32", "decoded_chars", "round_trip"])

    return docs.select("doc_id", measure(F.col("text")).alias("m")).select("doc_id", "m.*")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
