"""Collocations against a plain count of all phrases."""

import collections
import random
import re

import pytest

from callgrain.llm import collocations as c


def brute(docs, least, first):
    counts, sizes = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = lang or "und"
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(ws)
            for k in range(1, 6):
                counts.update((lang, *ws[i : i + k]) for i in range(len(ws) - k + 1))
    often = {g: n for g, n in counts.items() if n >= least}
    rows = collections.defaultdict(list)
    for g, a in often.items():
        lang, ws = g[0], g[1:]
        if len(ws) < 2 or any(h[0] == lang and len(h) > len(g) and n >= a and any(h[i : i + len(ws)] == ws for i in range(1, len(h))) for h, n in often.items()):
            continue
        score, _, l, r = min((1000 * a * sizes[lang] // (often[lang, *ws[:k]] * often[lang, *ws[k:]]), k, often[lang, *ws[:k]], often[lang, *ws[k:]]) for k in range(1, len(ws)))
        rows[lang].append((-score, -a, " ".join(ws).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, sizes[lang], -s) for lang, own in rows.items() for k, (s, a, p, l, r) in enumerate(sorted(own)[:first]))


@pytest.fixture(scope="module")
def docs():
    r = random.Random(4)
    words = ["Ab", "b", "é", "x y", "中", "don't", "A", "-", "\x1c", "zz"]
    out = []
    for i in range(400):
        text = "".join(r.choice(words[: 4 + i % 7]) + r.choice([" "] * 8 + ["  ", "\t", ". ", "\n", "!", ";\r"]) for _ in range(r.randint(0, 40)))
        out.append((r.choice(["en", "en", "de", None]), text + "one two three four five six seven" * (i % 3 == 0)))
    return [*out, (None, None), ("fr", None), ("fr", ""), ("und", "b b b"), ("en", "word " * 3000), ("xx", "."), *[("en", "same same passage here, same same passage here") for _ in range(60)]]


@pytest.mark.parametrize(("least", "first"), [(3, 2000), (20, 5), (100, 2000)])
def test_same_as_plain_counts(spark, docs, least, first):
    frame = spark.createDataFrame([(lang, t, i) for i, (lang, t) in enumerate(docs)], "lang string, text string, n long").repartition(3)
    got = sorted(tuple(x) for x in c.collocations(frame, least, first).collect())
    assert got == brute(docs, least, first) and got
    assert c.collocations(frame.limit(0), least, first).count() == 0


def test_a_full_bitmap_changes_nothing(spark, docs, monkeypatch):
    frame = spark.createDataFrame(docs, "lang string, text string")
    monkeypatch.setattr(c, "pair_bits", lambda *_: b"\xff" * (1 << c.FILTER_BITS - 3))
    assert sorted(tuple(x) for x in c.collocations(frame, 20, 50).collect()) == brute(docs, 20, 50)


def test_windows_only_where_all_their_parts_are_frequent(spark, monkeypatch):
    r = random.Random(9)
    docs = [("en", " ".join(r.choice("abcdefghijkl") for _ in range(10)) + (". one two three four five six" if i % 40 == 0 else ".")) for i in range(2000)]
    kept, seen = c.materialize, {}

    def materialize(df, label, made=None):
        out = kept(df, label, made)
        seen.setdefault(label, sorted((x.path, x.n) for x in out.collect()) if label == "paths" else None)
        return out

    monkeypatch.setattr(c, "materialize", materialize)
    frame = spark.createDataFrame(docs, "lang string, text string").coalesce(1)
    assert sorted(tuple(x) for x in c.collocations(frame, 40, 200).collect()) == brute(docs, 40, 200)
    # every pair of letters is frequent and no three are: counted as pairs, not as windows of five
    assert [p for p in seen["paths"] if p[0].count(" ") >= 4] == [("one two three four five six", 50)]
    letters = [p for p in seen["paths"] if len(p[0].split()[0]) == 1]
    assert {len(p) for p, _ in letters} == {3} and sum(n for _, n in letters) == 9 * 2000
    # a word starts one run at most: no more rows than words, whatever the groups
    assert sum(n * max(1, p.count(" ") - 3) for p, n in seen["paths"]) <= sum(len(t.replace(".", " ").split()) for _, t in docs)


def test_a_short_run_is_one_row_however_many_tasks_have_it(spark, monkeypatch):
    r = random.Random(12)
    docs = [("en", " ".join(r.choice("abcdefghij") for _ in range(12)) + (". one two three" if i % 20 == 0 else ".")) for i in range(2400)]
    kept, seen = c.materialize, []

    def materialize(df, label, made=None):
        out = kept(df, label, made)
        if label == "paths":
            seen.extend((x.path, x.n) for x in out.collect())
        return out

    monkeypatch.setattr(c, "materialize", materialize)
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(8)
    assert sorted(tuple(x) for x in c.collocations(frame, 100, 200).collect()) == brute(docs, 100, 200)
    # before, each of the eight tasks handed on its own row of each of these
    assert len(seen) == len({p for p, _ in seen}) == 100 + 2 + 1
    assert sum(n for p, n in seen if len(p) == 3) == 11 * 2400


@pytest.mark.parametrize("longest", [2, 3, 4, 7])
def test_other_longest_phrases(spark, longest):
    docs = [("en", "one two three four five six seven eight"), ("en", "two three four. one two three")] * 12 + [("en", "seven eight one two")] * 5
    counts = collections.Counter(tuple(ws[i : i + k]) for _, t in docs for p in t.split(".") for ws in [p.split()] for k in range(2, longest + 1) for i in range(len(ws) - k + 1))
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = c.phrase_counts(frame, c.count_words(frame), 6, longest).collect()
    assert sorted((tuple(x.phrase.split(" ")), x.k, x.n) for x in got) == sorted((g, len(g), n) for g, n in counts.items() if n >= 6)


@pytest.mark.parametrize("k", [2, 3, 4])
def test_runs_of_marked_parts_are_counted_in_small_batches(spark, docs, k):
    frame = spark.createDataFrame(docs, "lang string, text string").select(c.F.coalesce("lang", c.F.lit("und")).alias("lang"), "text").repartition(3)
    plain = collections.Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").lower()):
            ws = re.findall("[^\x20\x09]+", piece)
            plain.update((lang or "und", " ".join(ws[i : i + k])) for i in range(len(ws) - k + 1))
    full = b"\xff" * (1 << c.FILTER_BITS - 3)
    for at_once in (3, c.HASHES):
        got = {(x.lang, x.phrase): x.n for x in c.count_runs(frame, k, full, at_once).collect()}
        assert got == plain
    assert c.count_runs(frame, k, bytes(1 << c.FILTER_BITS - 3)).count() == 0
    if k == 2:
        some = spark.createDataFrame([("en", "one"), ("en", "two"), ("en", "three"), ("de", "b")], "lang string, phrase string")
        assert {(x.lang, x.phrase) for x in c.count_runs(frame, k, c.run_marks(some, 1)).collect()} == {("en", "one two"), ("en", "two three"), ("de", "b b")}


def test_small_parts_and_long_pieces(spark, docs, monkeypatch):
    whole = [("en", d) for _, d in c.stretches(iter([_rows(docs)]))]
    for size in (7, 50):
        monkeypatch.setattr(c, "PART_BYTES", size)
        parts = [("en", d) for _, d in c.stretches(iter([_rows(docs)]))]
        assert len(parts) > len(whole) and b"".join(d for _, d in parts) == b"".join(d for _, d in whole)
        assert all(d[-1] in c.BREAKS for _, d in parts[:-1] if len(d) > size) or size == 7


def _rows(docs):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(["en"] * len(docs)), pa.array([t for _, t in docs])], ["lang", "text"])


def test_paths_hold_the_edges():
    r = random.Random(6)
    for _ in range(30):
        edges = collections.Counter()
        for _ in range(r.randint(1, 6)):
            ws = [r.choice("abcdefgh") for _ in range(r.randint(5, 30))] if r.random() < 0.7 else list("abcdeabcdeabcde")
            for _ in range(r.randint(1, 3)):
                edges.update(" ".join(ws[i : i + 5]).encode() for i in range(len(ws) - 4))
        found, paths = collections.Counter(), list(c.compacted(dict(edges)))
        for p, n in paths:
            ws = p.split(b" ")
            for i in range(len(ws) - 4):
                found[b" ".join(ws[i : i + 5])] += n
        assert found == edges
    line = {b"a b c d e": 2, b"b c d e f": 2, b"c d e f g": 2, b"d e f g h": 1}
    assert sorted(c.compacted(line)) == [(b"a b c d e f g", 2), (b"d e f g h", 1)]
