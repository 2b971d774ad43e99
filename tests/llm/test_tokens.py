"""Byte-level encoder, packing and alignment against the libraries, brute force and exact round trips."""

import collections
import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from callgrain.llm import alignment, bytebpe, packing

ALPHABET = ["a", "b", "the ", "and", "'s", "é", "\n", " ", "  ", "\t", ",", "1", "<|endoftext|>", "</s>", "<s>", "x\x1c", "　", "ß", "𝒳", "▁", "<0x41>", "中", "\x00", "ﬁ"]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET[: 12 if i % 3 else None]) for _ in range(r.randint(0, 25))) for i in range(n)] + ["", " ", "  ", "  x ", "it's  o'clock", "\n\n a", None]


@pytest.mark.parametrize("plain", [False, True])
def test_byte_encoder_is_the_library(plain):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = plain
    texts = odd_texts(4000)
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder = bytebpe.ByteEncoder(path, plain)
    assert encoder.encode_all(texts) == want
    assert encoder.encode_all(texts) == want  # now from memory


def test_byte_encoder_long_texts_and_generations(monkeypatch):
    monkeypatch.setattr(bytebpe, "REMEMBERED", 50)
    monkeypatch.setattr(bytebpe.parts, "__defaults__", (100,))
    text = " ".join(w for w in odd_texts(300) if w and "<|" not in w and "\x1c" not in w and "　" not in w)
    encoder = bytebpe.ByteEncoder(packing.vocabulary_path())
    assert len(bytebpe.parts(text)) > 5 and "".join(bytebpe.parts(text)) == text
    want = np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode_all([text, text[:40]])[0] == want


def least_bins(lengths, capacity):
    """The true minimum, by trying every place."""
    best = [len(lengths)]

    @lru_cache(None)
    def place(rest, bins):
        if not rest:
            return len(bins)
        x, out = rest[0], len(bins) + 1 + len(rest)
        for i, b in enumerate(bins):
            if b + x <= capacity:
                out = min(out, place(rest[1:], tuple(sorted(bins[:i] + (b + x,) + bins[i + 1 :]))))
        return min(out, place(rest[1:], tuple(sorted(bins + (x,)))))

    best[0] = place(tuple(sorted(lengths, reverse=True)), ())
    return best[0]


def test_packing_against_the_true_minimum():
    r = random.Random(5)
    over = 0
    for _ in range(150):
        lengths = [r.randint(1, 19) for _ in range(r.randint(1, 9))]
        bins = packing.pack_lengths(lengths, 20)
        assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= 20 for b in bins)
        over += len(bins) - least_bins(lengths, 20)
    assert over <= 3
    assert packing.pack_lengths([], 20) == []


@pytest.mark.parametrize("kind", ["uniform", "short", "third", "copies"])
def test_search_empties_bins_and_never_lowers_the_squares(kind):
    r = random.Random(7)
    draw = {"uniform": lambda: r.randint(1, 1023), "short": lambda: 1 + int(r.expovariate(1 / 250)) % 1000, "third": lambda: 700 if r.random() < 0.34 else r.randint(1, 500), "copies": lambda: 512}[kind]
    lengths = [draw() for _ in range(4000)]
    start = [[]]
    for x in lengths:  # each into the last bin or a new one
        if sum(start[-1]) + x > 1024:
            start.append([])
        start[-1].append(x)
    squares = lambda bins: sum(sum(b) ** 2 for b in bins)
    before, n = squares(start), len(start)
    done = packing.SwapSearch([list(b) for b in start], 1024).run()
    assert sorted(x for b in done for x in b) == sorted(lengths) and max(map(sum, done)) <= 1024 and squares(done) >= before
    least = max(-(-sum(lengths) // 1024), sum(2 * x > 1024 for x in lengths))
    assert len(done) == n if kind == "copies" else len(done) - least < 0.65 * (n - least)


def test_exchanges_are_needed():
    # nothing fits any gap as it is: one for one, then two for one
    assert len(packing.SwapSearch([[6, 3], [5, 4], [2]], 10).run()) == 2
    assert len(packing.SwapSearch([[7, 2], [3, 2, 4]], 10).run()) == 2


def brute_pieces(docs, path):
    from tokenizers import Tokenizer

    library, out = Tokenizer.from_file(path), []
    for d, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        out += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return out


def test_packed_documents(spark):
    r = random.Random(3)
    docs = [(i, t) for i, t in enumerate(odd_texts(300))] + [(None, "x"), (None, None), (5, "again"), (900, "word " * 9000), (901, "a" * 5000), (902, " b" * 1023), (903, " b" * 1024)]
    docs += [(1000 + i, " ".join("w" * r.randint(1, 6) for _ in range(r.randint(1, 700)))) for i in range(120)]
    frame = spark.createDataFrame([(d, t, "extra") for d, t in docs], "doc_id long, text string, piece_key string")
    placed = packing.pack(packing.encode_pieces(frame), block_pieces=60)
    got = placed.collect()
    assert sorted(map(repr, ((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got))) == sorted(map(repr, brute_pieces(docs, packing.vocabulary_path())))
    sequences = collections.defaultdict(list)
    for x in got:
        sequences[x.sequence_id].append((x.offset, x.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    report = packing.fill_report(placed).first()
    assert report.sequences == len(sequences) and report.sequences <= 1.05 * report.least
    assert packing.pack(packing.encode_pieces(frame.limit(0))).count() == 0


def test_packed_sequences_hold_the_ids(spark):
    docs = [(i, t) for i, t in enumerate(odd_texts(60))] + [(77, "word " * 3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {}
    for s in packing.packed_sequences(frame).collect():
        assert len(s.ids) == sum(p.length for p in s.pieces) <= 1024
        for p in s.pieces:
            found[p.doc_id, p.piece] = (p.start, p.length, zlib.crc32(np.array(s.ids[p.offset : p.offset + p.length], "<u4").tobytes()))
    assert sorted((d, k, *v) for (d, k), v in found.items()) == sorted(brute_pieces(docs, packing.vocabulary_path()))


def brute_alignment(docs):
    """Every token of one side against every token of the other."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.vocabulary_paths()
    side_a, side_b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    side_a.encode_special_tokens = True
    letters = bytebpe.byte_alphabet()

    def spans(parts):
        ends = np.cumsum([0, *map(len, parts)]).tolist()
        return list(zip(ends, ends[1:], strict=False))

    rows, counts = [], collections.Counter()
    for d, t in docs:
        a, b = (side_a.encode(" " + t, add_special_tokens=False).ids, side_b.encode(t)) if t else ([], [])
        a_bytes = [bytes(letters[c] for c in side_a.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(side_b.id_to_piece(i)[1:-1], 16)]) if side_b.is_byte(i) else side_b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(a_bytes) != (" " + t).encode() or b"".join(b_bytes) != (" " + t).encode():
            rows.append((d, None))
            continue
        a_at, b_at, groups, low = spans(a_bytes), spans(b_bytes), [], 0
        for cut in sorted({e for _, e in a_at} & {e for _, e in b_at}):
            inside = lambda ids, at, low=low, cut=cut: ",".join(str(i) for i, (x, y) in zip(ids, at, strict=True) if low <= x and y <= cut)
            groups.append(f"{inside(a, a_at)}|{inside(b, b_at)}")
            low = cut
        links = [(i, j) for i, (x, y) in zip(a, a_at, strict=True) for j, (u, v) in zip(b, b_at, strict=True) if x < v and u < y]
        counts.update(set(links))
        rows.append((d, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    best = collections.defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = [(d, 0, 0, 0, 0, 0, 0, "") if r is None else (d, *r[:3], len(r[3]), sum(counts[x] == best[x[0]] for x in r[3]), sum(counts[x] for x in r[3]), r[4]) for d, r in rows]
    return out, counts, best


@pytest.mark.parametrize(("run_records", "merged_runs"), [(2_000_000, 512), (400, 2)])
def test_alignment_is_brute_force(spark, run_records, merged_runs):
    docs = [(i, t) for i, t in enumerate(odd_texts(900))] + [(None, "the end"), (None, None), (1, "the end"), (1, "the end"), (8, "long " * 3000 + "x")]
    frame = spark.createDataFrame([(d, t, "extra") for d, t in docs], "doc_id long, text string, run string").repartition(3)
    want, counts, best = brute_alignment(docs)
    got = alignment.align_documents(frame, run_records=run_records, merged_runs=merged_runs).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    pairs = alignment.pair_counts(frame, run_records=run_records, merged_runs=merged_runs).collect()
    assert {(p.a_id, p.b_id): (p.docs, p.best) for p in pairs} == {k: (n, n == best[k[0]]) for k, n in counts.items()}
    assert alignment.align_documents(frame.limit(0)).count() == 0


def test_alignment_of_parts(monkeypatch):
    monkeypatch.setattr(alignment, "PART_CHARS", 60)
    monkeypatch.setattr(bytebpe.parts, "__defaults__", (50,))
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    texts = [" ".join(t for t in odd_texts(40, s) if t and "▁" not in t and "\x1c" not in t and "　" not in t) for s in range(6)] + ["one", None, "two"]
    both = alignment.Aligner(*alignment.vocabulary_paths())
    rows, doc, key, links = both.align(texts)
    want, counts, _ = brute_alignment(list(enumerate(texts)))
    assert [r for r in rows] == [(*w[1:5], w[7]) for w in want]
    assert len(doc) == sum(counts.values()) and links.sum() == sum(w[4] for w in want)


def test_merge_of_runs_is_a_sum():
    r = random.Random(2)
    runs = [sorted(collections.Counter(r.randrange(50) for _ in range(r.randrange(80))).items()) for _ in range(9)]
    want = collections.Counter()
    for run in runs:
        want.update(dict(run))
    assert list(alignment.merged([(np.array([k for k, _ in x], np.int64), np.array([n for _, n in x], np.int64)) for x in runs])) == sorted(want.items())


def test_decoding_by_tables_is_decoding_by_runs():
    from callgrain.llm import pieces

    own, r = pieces.machine(pieces.vocabulary_path()), random.Random(9)

    def by_runs(ids):
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i in own.bytes:
                raw.append(own.bytes[i])
                continue
            out.append(raw.decode("utf-8", "one-by-one"))
            raw.clear()
            out.append("" if i is None or i in own.silent and i != own.unknown else " ⁇ " if i == own.unknown else own.text[i])
        text = "".join(out).replace("▁", " ")
        return text[1:] if own.prefix and text.startswith(" ") else text

    odd = [*own.bytes, *own.silent]
    for _ in range(3000):
        ids = [r.choice(odd) if r.random() < 0.7 else r.randrange(len(own.text)) for _ in range(r.randint(0, 12))]
        assert own.decode(ids) == by_runs(ids)
    # the flat machine is the trie, one lookup a character
    assert own.start[1][" "] is own.start[1]["▁"]
    t, below = own.start[1]["t"][1]["h"]
    assert (t, below["e"][0]) == (own.id["th"], own.id["the"])
