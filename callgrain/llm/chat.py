"""Chat formatting with typed content parts.

A turn's content is an ordered list of parts: text, image, audio or document. A visitor
flattens them: text is written with control strings escaped; every other part becomes a
placeholder numbered within its turn, and is recorded with its reference, its place and
the number of tokens that the placeholder stands for once expanded.

The output is a table of segments, one per turn; a conversation's formatted text is its
segments in order of turn. So no conversation is gathered into one value, however long.
The loss mask of a segment is a list of [start, end) code point ranges in it: for
assistant turns, the texts of text parts; for others, nothing.

Escaping is reversible: a backslash is doubled, and a backslash is put behind the first
character of every control string, so that none is left; unescaping drops each
backslash and keeps what follows it. Text parts that follow each other are escaped as
one text.

Reading back, a conversation's turns pass one task in order, as its digests run over all
of them; the task holds a batch and two digests, so a long conversation takes time there
but no memory.

Defined cases: null text and role are empty. Turns are ordered by turn, null first; rows
that repeat a turn by their segment. A null conv_id is a conversation of its own. Parts
of another kind are placeholders called `file`; null parts are skipped. Extra columns are
left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.llm.common import materialize, python_ready

TURN, BREAK, END = "<|turn|>", "\n", "<|end|>\n"
#: Strings that steer this template or other common ones.
CONTROL = ("<|", "|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ").", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_SEGMENT = re.compile(r"<\|turn\|>((?:[^\n\\]|\\.)*)\n(.*)<\|end\|>\n", re.DOTALL)
#: Tokens that a placeholder expands to where the part doesn't say.
DEFAULT_TOKENS = {"image": 576, "audio": 750, "document": 1024}

PARTS = "array<struct<kind:string,text:string,ref:string,tokens:int>>"
SEGMENT = "segment string, loss array<struct<start:int,end:int>>, attachments array<struct<kind:string,number:int,ref:string,at:int,tokens:int>>, extra_tokens long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


class PartVisitor:
    """Flattens one turn. visit() calls the method named after the part's kind."""

    def __init__(self, role: str):
        self.text: list[str] = [TURN, escape(role).replace("\n", "\\\n"), BREAK]
        self.length = sum(map(len, self.text))
        self.learned = role == "assistant"
        self.run: list[str] = []
        self.loss: list[tuple[int, int]] = []
        self.attachments: list[tuple[str, int, str | None, int, int]] = []

    def visit(self, kind: str | None, text: str | None, ref: str | None, tokens: int | None) -> None:
        getattr(self, f"visit_{kind}", self.visit_other)(text, ref, tokens)

    def visit_text(self, text, ref, tokens) -> None:
        self.run.append(text or "")

    def end_run(self) -> None:
        """Write the text parts since the last placeholder, escaped as one: neighbours can't make a control string."""
        start = self.length
        self._put(escape("".join(self.run)))
        self.run = []
        if self.learned and self.length > start:
            self.loss.append((start, self.length))

    def visit_image(self, text, ref, tokens) -> None:
        self._attach("image", ref, tokens)

    def visit_audio(self, text, ref, tokens) -> None:
        self._attach("audio", ref, tokens)

    def visit_document(self, text, ref, tokens) -> None:
        self._attach("document", ref, tokens)

    def visit_other(self, text, ref, tokens) -> None:
        self._attach("file", ref, tokens)

    def _attach(self, kind: str, ref: str | None, tokens: int | None) -> None:
        self.end_run()
        number = len(self.attachments) + 1
        n = DEFAULT_TOKENS.get(kind, 0) if tokens is None else int(tokens)
        self.attachments.append((kind, number, ref, self.length, n))
        self._put(f"<|{kind}:{number}|>")

    def _put(self, text: str) -> None:
        self.text.append(text)
        self.length += len(text)

    def segment(self) -> str:
        self.end_run()
        return "".join(self.text) + END


def text_parts(text: Column) -> Column:
    """Content of a plain turn: one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def _segments(role: pd.Series, parts: pd.Series) -> pd.DataFrame:
    rows = []
    for r, ps in zip(role, parts, strict=True):
        v = PartVisitor(r or "")
        for p in ps if ps is not None else ():
            if p is not None:
                v.visit(p["kind"], p["text"], p["ref"], p["tokens"])
        segment = v.segment()
        attached = [dict(zip(("kind", "number", "ref", "at", "tokens"), a, strict=True)) for a in v.attachments]
        rows.append((segment, [{"start": a, "end": b} for a, b in v.loss], attached, sum(a[4] for a in v.attachments)))
    return pd.DataFrame(rows, columns=["segment", "loss", "attachments", "extra_tokens"])


def format_turns(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, parts) with parts of type PARTS: conv_id, turn and the segment's columns."""
    python_ready(turns.sparkSession)
    flatten = F.pandas_udf(_segments, SEGMENT)
    return turns.select("conv_id", "turn", flatten("role", "parts").alias("s")).select("conv_id", "turn", "s.*")


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and content text of a segment, unescaped; placeholders stay."""
    m = _SEGMENT.fullmatch(segment)
    if m is None:
        raise ValueError("not a segment")
    return unescape(m[1]), unescape(m[2])


def read_conversations(segments: DataFrame) -> DataFrame:
    """Parse written segments back, in order: one row per conversation with counts and digests of turns and learned text.

    Rows pass through in sorted order; a task holds one batch and two running digests.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, chars, loss_chars, turns, learned = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )
            done.clear()
            return out

        for b in batches:
            for conv, segment, loss in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if n and conv != now:
                    done.append((now, n, turns.hexdigest(), loss_chars, learned.hexdigest(), chars))
                    n, chars, loss_chars, turns, learned = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                now = conv
                role, text = parse_segment(segment)
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n, chars = n + 1, chars + len(segment)
                for span in loss or ():
                    part = unescape(segment[span["start"] : span["end"]])
                    learned.update(part.encode("utf-8", "surrogatepass"))
                    loss_chars += len(part)
            yield flush()
        if n:
            done.append((now, n, turns.hexdigest(), loss_chars, learned.hexdigest(), chars))
            yield flush()

    dealt = segments.select("conv_id", "turn", "segment", "loss").repartition("conv_id")
    dealt = dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "segment").select("conv_id", "segment", "loss")
    return dealt.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    rows = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    turns = turns.unionByName(rows).select("conv_id", "turn", "role", text_parts(F.coalesce("text", F.lit(""))).alias("parts"))
    return read_conversations(materialize(format_turns(turns), "segments"))
