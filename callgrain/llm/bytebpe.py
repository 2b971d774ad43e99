"""Ids of texts under a byte-level vocabulary, by the tokenizers library, with a memory of what stands between spaces.

Such a vocabulary's splitter takes at most one space into a token, the one before it. So
it cuts before each single space between two other characters, and within runs of white
space at known places; a text's ids are those of its stretches one after the other. New
stretches go to the library many at a time. All this holds for the settings checked on
loading; texts go to any other vocabulary whole, as do texts with white space outside
ASCII or with what may start a special token.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Stretches remembered in each of two generations, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 300_000, 48
#: Texts longer than this are encoded in parts, cut where no token crosses.
PART_CHARS = 1 << 20
_STRETCH = re.compile(r" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_CUT = re.compile(r"(?<=[^\t-\r ]) (?=[^\t-\r ])")
# what makes a single space, or a line end, stand beside other white space
_RUNS = ("  ", "\t", "\x0b", "\x0c", "\r", " \n", "\n ", "\n\n")
WHITE = "\t\n\x0b\x0c\r "
# a word of Latin letters, perhaps first in its line, and the signs after it
_TAIL = re.compile(r"(\n?[A-Za-zÀ-ÖØ-öø-ſ]+)([!-&(-/:-@\[-`{-~]*)\Z")
# characters on which the two sides may disagree whether they are white space
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  ⁠　﻿]")


def has_runs(text: str) -> bool:
    """Whether white space other than single spaces and line ends occurs."""
    return any(run in text for run in _RUNS)


def byte_alphabet() -> dict[str, int]:
    """The published byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on, in order."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """A text cut into parts of about size characters, each from the second on starting with a single space that starts a token."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


class ByteEncoder:
    """plain: the strings of special tokens are ordinary text; else they are their tokens, as the library has it."""

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = self.plain = plain
        settings = json.loads(self.tokenizer.to_str())
        pre, model = settings["pre_tokenizer"] or {}, settings["model"]
        self.splits = (
            settings["normalizer"] is None
            and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) == ("ByteLevel", False, True)
            and (model["type"], model["dropout"], model["continuing_subword_prefix"], model["end_of_word_suffix"]) == ("BPE", None, None, None)
            and (plain or all(t["content"].startswith("<|") for t in settings["added_tokens"]))
        )
        letters, n = byte_alphabet(), self.tokenizer.get_vocab_size()
        self.entry: list[bytes | None] = [None] * n  # the bytes of each id; None for special tokens
        special = {t["id"] for t in settings["added_tokens"]}
        for token, i in self.tokenizer.get_vocab().items():
            if i not in special:
                self.entry[i] = bytes(letters[c] for c in token)
        self.spaced = np.array([bool(e) and e[:1] == b" " for e in self.entry])
        self.newline = next((i for i, e in enumerate(self.entry) if e == b"\n"), -1)
        # the same merges for stretches that are split and written in the byte alphabet here
        self.bare = Tokenizer.from_file(path)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {b: ord(c) for c, b in letters.items()}
        self.tails: dict[str, bytes] = {"": b""}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _each(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 1024):
            coded = self.tokenizer.encode_batch_fast(texts[at : at + 1024], add_special_tokens=False)
            out += [np.array(e.ids, "<u4").tobytes() for e in coded]
        return out

    def _joined(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words of letters, each after a space or a line end, which belongs to them: many in one call, cut where it comes again."""
        out: list[bytes] = []
        glue = " Ġ" if before == " " else " Ċ "
        for at in range(0, len(words), 8192):
            text = glue.join([w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words[at : at + 8192]])
            ids = np.array(self.bare.encode_batch_fast([glue[1:] + text], add_special_tokens=False)[0].ids, "<u4")
            starts = self.spaced[ids] if before == " " else ids == self.newline
            ends = [*(4 * np.flatnonzero(starts)[1:]).tolist(), 4 * len(ids)]
            data, last = ids.tobytes(), 0
            for end in ends:
                out.append(data[last:end])
                last = end
        return out

    def _new(self, stretches: list[str]) -> dict[str, bytes]:
        """Ids of distinct stretches that aren't remembered; a line end belongs to them, else they have a space before them."""
        out: dict[str, bytes] = {}
        split: dict[str, tuple[str, str]] = {}
        whole, heads, tails = [], set(), set()
        for w in stretches:
            if w.isalpha():
                heads.add(w)
            elif m := _TAIL.match(w):  # a word and the signs after it have tokens of their own, unless an apostrophe may start a contraction
                split[w] = m[1], m[2]
                heads.add(m[1])
                tails.add(m[2])
            else:
                whole.append(w)
        lacking = []
        for h in heads:
            v = self.known.get(h) or self.older.get(h)
            if v is None:
                lacking.append(h)
            else:
                out[h] = v
        for before in " \n":
            words = [h for h in lacking if (h[0] == "\n") == (before == "\n")]
            out.update(zip(words, self._joined([h.lstrip("\n") for h in words], before), strict=True))
        ends = list(tails - self.tails.keys())
        if len(self.tails) > 10_000:
            self.tails, ends = {"": b""}, list(tails)
        self.tails.update(zip(ends, self._each(ends), strict=True))
        out.update((w, out[h] + self.tails[t]) for w, (h, t) in split.items())
        out.update(zip(whole, self._each([w if w[0] == "\n" else " " + w for w in whole]), strict=True))
        return out

    def whole(self, text: str) -> bool:
        """Whether a text must go to the library as it is."""
        if not self.splits or not self.plain and "<|" in text:
            return True
        return any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else _ODD.search(text) is not None

    def spaced_ids(self, lists: list[list[str]]) -> list[list[bytes]]:
        """Ids of the stretches of each list, every stretch having a space before it."""
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        found = [list(map(self.known.get, ws)) for ws in lists]
        lacking = {w for ws, got in zip(lists, found, strict=True) if None in got for w, v in zip(ws, got, strict=True) if v is None}
        now = {w: v for w in lacking if (v := self.older.get(w)) is not None}
        now.update(self._new([w for w in lacking if w not in now]))
        self.known.update((w, v) for w, v in now.items() if len(w) <= REMEMBERED_CHARS)
        return [[v if v is not None else now[w] for w, v in zip(ws, got, strict=True)] if None in got else got for ws, got in zip(lists, found, strict=True)]

    def apart(self, text: str) -> bool:
        """Whether every space of a text stands between two other characters, so that a token starts with each, and one with a space before the text."""
        return self.splits and not self.whole(text) and text[0] not in WHITE and text[-1] not in WHITE and not has_runs(text)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers; null texts are empty."""
        out: list[list[bytes]] = [[] for _ in texts]
        easy: list[tuple[int, list[str]]] = []
        hard: list[tuple[int, int, str]] = []  # text, place among its ids, stretch: as the library has it
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.whole(t):
                out[i] = self._each([t])
            elif t[-1] not in WHITE and t[0] == " " != t[1:2] and not has_runs(t):
                easy.append((i, t[1:].replace("\n", " \n").split(" ")))
            elif t[0] in WHITE or t[-1] in WHITE or has_runs(t):
                at = _STRETCH.findall(t)
                spaced = [k for k, s in enumerate(at) if s[0] == " " and len(s) > 1 and s[1] not in WHITE]
                out[i] = [b""] * len(at)
                easy.append((i, [at[k][1:] for k in spaced]))
                hard += [(i, k, at[k]) for k in sorted(set(range(len(at))) - set(spaced))]
                out[i].append(spaced)  # type: ignore[arg-type]
            else:
                head, *ws = t.replace("\n", " \n").split(" ")
                out[i] = [b""]
                hard.append((i, 0, head))
                easy.append((i, ws))
        for (i, _), ids in zip(easy, self.spaced_ids([ws for _, ws in easy]), strict=True):
            if out[i] and isinstance(out[i][-1], list):
                for k, v in zip(out[i].pop(), ids, strict=True):
                    out[i][k] = v
            else:
                out[i] += ids
        coded = self._each([s for _, _, s in hard])
        for (i, k, _), v in zip(hard, coded, strict=True):
            out[i][k] = v
        return [b"".join(v) for v in out]


_ENCODERS: dict[tuple[str, bool], ByteEncoder] = {}


def byte_encoder(path: str, plain: bool = False) -> ByteEncoder:
    """One encoder per worker process, vocabulary and mode."""
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = ByteEncoder(path, plain)
    return _ENCODERS[path, plain]
