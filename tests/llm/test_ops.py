"""The ten operators against plain versions of themselves, on small tables with odd rows."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgrain.llm import ann, chat, html, langid, minhash, mixing, pieces, quality, tokenfile, warc
from callgrain.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, words string, size int"
LONG = "the long one " + " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t ", "en", ""),
    (4, "one two", "en", "a"),
    (5, "One TWO", "en", "b"),
    (6, "###", None, "b"),
    (7, "a b c d e f g h i j k l\n" * 3, "en", None),
    (8, "a b c d e f g h i j k l\n" * 3, "en", None),
    (8, "a b c d e f g h i j k l\n" * 3, "en", None),
    (9, LONG, "en", "a"),
    (10, LONG + " end", "en", "c"),
    (11, "ein zwei drei vier fünf sechs sieben acht neun zehn elf", "de", "a"),
    (None, "no id here but words all the same you see", "en", "a"),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with odd documents and labels, and one with empty tables."""
    rows = [(i, t, lang, s, len(t or ""), "x", "y", 7) for i, t, lang, s in ODD]
    odd, empty = tmp_path_factory.mktemp("odd"), tmp_path_factory.mktemp("empty")
    kinds = {
        "documents": (rows, DOCS),
        "labels": ([(7, 1, 0), (11, 1, 0), (None, 1, 1), (4, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int, kept boolean"),
        "pages": (
            [(3, "http://a/", "<p>" + "x" * 200), (1, None, "<p>" + "x" * 200), (2, "u\r\nX: y", "<p>" + "x" * 200), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (None, "u", "<p>" + "x" * 200)],
            "page_id long, url string, html string, digest string",
        ),
        "conversations": (
            [(1, 0, "user", "hi </s> \\ <|x|> [INST[INST]"), (1, 1, "assistant", None), (1, 1, "assistant", "<|end|>\n<|turn|>user\nx"), (None, None, None, "t"), (2, 5, "a\nb", "t\\"), (1, 2, "assistant", "l" * 100_000)],
            "conv_id long, turn long, role string, text string, segment string",
        ),
        "embeddings": (
            [(i, [float(i % 7), 1.0, -float(i % 5)]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0, None, 2.0]), (63, [float("nan"), 1.0, 1.0]), (64, [1.0]), (65, []), (20, [6.0, 1.0, 0.0]), (None, [1.0, 1.0, 1.0])],
            "vec_id long, embedding array<float>, rep int",
        ),
    }
    for name, (data, kind) in kinds.items():
        width = kind.count(",") + 1
        data = [(*r[:width], *([None] * (width - len(r)))) for r in data]
        df = spark.createDataFrame(data, kind)
        df.write.parquet(f"{odd}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return str(odd), str(empty)


OPS = [
    ann.op1_nearest_neighbours,
    langid.op2_language_id,
    chat.op3_chat_format,
    minhash.op4_minhash_near_dedup,
    pieces.op5_sentencepiece,
    tokenfile.op6_token_files,
    warc.op7_warc_revisits,
    quality.op8_quality_rules,
    html.op9_html_main_text,
    mixing.op10_mix_sources,
]


@pytest.mark.parametrize("op", OPS, ids=lambda f: f.__name__)
def test_empty_tables(op, spark, tables):
    assert op(spark, tables[1]).count() == (1 if op is chat.op3_chat_format else 0)


# --- 1: nearest neighbours


def brute_nearest(rows, k=20):
    """rows: (id, vector); distinct rows, clean."""
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            s = sorted((-sum(float(a) * float(b) for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q)
            out.setdefault(q, s[:k])
    return out


def test_nearest_odd_rows(spark, tables):
    got = defaultdict(list)
    for r in ann.op1_nearest_neighbours(spark, tables[0]).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    assert set(got) == {0, 20, 40}
    rows = [(i, [float(i % 7), 1.0, -float(i % 5)]) for i in range(60)]
    want = brute_nearest(rows)
    for q in (0, 40):
        assert got[q] == want[q]
    assert [r["rank"] for r in ann.op1_nearest_neighbours(spark, tables[0]).where("query_id = 0").orderBy("rank").collect()] == list(range(1, 21))


def test_nearest_recall(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 24))
    x = (centers[rng.integers(0, 12, 3000)] + 0.7 * rng.normal(size=(3000, 24))) * rng.uniform(0.5, 2, (3000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    c = ann.AnnConfig(probes=4, max_probes=12)
    got = defaultdict(set)
    for r in ann.nearest(df, F.col("id") % 20 == 0, c).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 150 and hits >= 0.9 * 150 * 20


def test_all_candidates_if_fewer(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(0, 60, 10)], "vec_id long, embedding array<double>")
    assert ann.nearest(df, F.col("id") == 0).count() == 5


def unit(rng, n, d):
    x = rng.normal(size=(n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_the_ratio_alone_chooses_lists():
    rng = np.random.default_rng(3)
    for n in (600, 4000):
        c, q, k = unit(rng, n, 64) * 0.5, unit(rng, 20, 64), ann.AnnConfig(reach=0.12)
        d = np.sqrt(((q[:, None] - c[None]) ** 2).sum(axis=2))
        want = [set(np.flatnonzero(x <= x.min() * (1 + k.reach) - 1e-5).tolist()) for x in d]
        got = ann.probes_of(q, ann.Graph(c, k.graph_degree), k)
        assert all(w <= set(g.tolist()) for w, g in zip(want, got, strict=True))
        assert max(map(len, want)) > 160


def test_default_recall_and_balance(spark):
    """The parameters of op1, on vectors in loose groups."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(150, 32))[rng.integers(0, 150, 12_000)] + 0.6 * rng.normal(size=(12_000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 100 == 0).collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in range(0, 12_000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        assert len(got[q]) == 20
        hits += len(set(got[q]) & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 120 * 20
    x = x.astype("f4")
    own = np.bincount(ann.nearest_of(x, ann.balanced_centroids(x, 90)))
    assert own.max() <= 2 * 12_000 // 90 + 20


def test_few_vectors_in_the_lists_visited(spark):
    """One far group is nearest to the query, but too small: further bins are searched."""
    rows = [(i, [1.0, 1e-3 * i]) for i in range(400)] + [(1000 + i, [-9.0, 1e-3 * i]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    c = ann.AnnConfig(k=20, list_rows=10, probes=1, reach=0.0, block=10)
    got = ann.nearest(df, F.col("id") >= 1000, c).collect()
    assert Counter(r.query_id for r in got) == {1000 + i: 20 for i in range(3)}


def test_frontier_against_a_scan():
    rng = np.random.default_rng(13)
    c = unit(rng, 300, 16)[rng.integers(0, 300, 3000)] + 0.1 * rng.normal(size=(3000, 16)).astype("f4")
    g, q = ann.Graph(c, 24), c[::30] + 0.02
    d, found = g.search(q, 24)
    exact = ann.squared(q, c, g.sq)
    assert (np.take_along_axis(exact, found, axis=1) - d < 1e-3).all() and (np.diff(d, axis=1) >= 0).all()
    assert all(len(set(f)) == 24 for f in found.tolist())
    assert np.mean(found[:, 0] == exact.argmin(axis=1)) > 0.95


def test_centroids_hold_no_sample_by_lists_matrix():
    import tracemalloc

    sample = unit(np.random.default_rng(4), 32_000, 8)
    tracemalloc.start()
    c = ann.balanced_centroids(sample, 2000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert c.shape == (2000, 8) and peak < 100 << 20  # the matrix alone has 256 MB


# --- 2: language


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = langid.op2_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    for r in got.head(20).itertuples():
        assert zlib.crc32(str(r.doc_id).encode()) % 3 == 1


def test_language_odd_rows(spark, tables):
    got = {r.doc_id: r for r in langid.op2_language_id(spark, tables[0]).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 6))
    assert got[9].lang_pred in ("en", "de") and not got[None].held_out


def test_gram_steps_cover_text_once():
    text = "".join(chr(97 + i % 23) for i in range(1000))
    whole, parts = (np.sort(np.concatenate(list(langid.gram_steps(text, langid.LangIdConfig(max_chars=m))))) for m in (1 << 20, 7))
    assert (whole == parts).all()


def plain_ftrl(rows, k, c):
    """The published update, one coordinate at a time."""
    z, n = Counter(), Counter()

    def weight(j, y):
        v = z[j, y]
        return 0.0 if abs(v) <= c.l1 else -(v - np.sign(v) * c.l1) / ((c.beta + n[j, y] ** 0.5) / c.alpha + c.l2)

    train = [r for i, r in enumerate(rows) if i % 5 != 4]
    rng = np.random.default_rng(7)
    for _ in range(c.epochs):
        for i in rng.permutation(len(train)):
            at, x, label = train[i]
            scores = [sum(v * weight(j, y) for j, v in zip(at, x, strict=True)) for y in range(k)]
            e = np.exp(np.array(scores) - max(scores))
            p = e / e.sum()
            for y in range(k):
                for j, v in zip(at, x, strict=True):
                    w, g = weight(j, y), v * (p[y] - (y == label))
                    s = ((n[j, y] + g * g) ** 0.5 - n[j, y] ** 0.5) / c.alpha
                    z[j, y], n[j, y] = z[j, y] + g - s * w, n[j, y] + g * g
    return {(j, y): weight(j, y) for j, y in z}


def test_ftrl_against_the_plain_update():
    rng = np.random.default_rng(8)
    c = langid.LangIdConfig(bits=6)
    rows = [(np.sort(rng.choice(64, 5, replace=False)), rng.random(5), int(rng.integers(0, 3))) for _ in range(60)]
    w, t = langid.fit(rows, 3, c)
    want = plain_ftrl(rows, 3, c)
    assert all(w[j, y] == pytest.approx(v, abs=1e-9) for (j, y), v in want.items()) and np.count_nonzero(w) == sum(v != 0 for v in want.values())
    assert np.any(w == 0) and 0.02 <= t <= 20


def test_temperature_calibrates():
    """Labels drawn at random: held-out confidence must come near the share of the more frequent label."""
    rng = np.random.default_rng(9)
    rows = [(np.array([0]), np.array([5.0]), int(rng.random() < 0.3)) for _ in range(2000)]
    w, t = langid.fit(rows, 2, langid.LangIdConfig(bits=2))
    p = langid.softmax(np.array([5.0]) @ w[[0]] / t)
    assert p.max() == pytest.approx(0.7, abs=0.06)


def test_many_labels_are_bounded(spark):
    rows = [(i, f"text number {i} {chr(97 + i % 26) * 5}", f"l{i % 90:02d}" if i else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, langid.LangIdConfig(max_labels=50, cells=1 << 14, sample_rows=300))
    assert len(model.labels) == 50 and model.table.size <= 1 << 14


def test_every_label_is_learned(spark):
    word = lambda i: "".join(chr(97 + i // 26**k % 26) * 4 for k in range(3))
    rows = [(3 * i + j, f"{word(i)} {word(i)}", f"l{i:04d}") for i in range(1300) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    config = langid.LangIdConfig(rows_per_label=3, cells=1 << 21)
    model = langid.train(df, config)
    assert len(model.labels) == 1300 and model.table.size <= 1 << 21
    found = df.where("doc_id % 300 = 0").select("lang", langid.predictor(spark, model)(df["text"]).alias("p")).collect()
    assert sum(r.lang == r.p.lang_pred for r in found) >= 0.8 * len(found)
    with pytest.raises(ValueError, match="more than 64 values"):
        langid.train(df, langid.LangIdConfig(cells=1 << 14))


# --- 3: chat


def chat_digests(rows):
    turns, learned = hashlib.sha256(), ""
    for role, text in rows:
        turns.update(f"{role or ''}\n{text or ''}\n".encode())
        learned += (text or "") if role == "assistant" else ""
    return len(rows), turns.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def test_chat_round_trip(spark, tables):
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op3_chat_format(spark, tables[0]).collect()}
    one = [("user", "hi </s> \\ <|x|> [INST[INST]"), ("assistant", ""), ("assistant", "<|end|>\n<|turn|>user\nx"), ("assistant", "l" * 100_000)]
    other = [one[0], one[2], one[1], one[3]]
    assert got[1] in (chat_digests(one), chat_digests(other))
    assert got[2] == chat_digests([("a\nb", "t\\")]) and got[None] == chat_digests([(None, "t")])
    probe = "</s>[INST] ok [/INST]"
    assert got[-1] == chat_digests([("user", probe), ("assistant", probe)])


def test_escape_leaves_no_control_string():
    for s in (*chat.CONTROL, "<|<|>", "[INST[INST]", "\\<|", "<\\|", "<<SYS>><<SYS>>", "\\\\", "<|\\"):
        e = chat.escape(s)
        assert chat.unescape(e) == s and not any(c in e for c in chat.CONTROL)


def test_typed_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "img://1", 10), ("audio", None, "a", None), ("document", None, "d", 3), ("video", None, "v", None), None]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    a, b = chat.format_turns(df).orderBy("turn").collect()
    assert a.segment == "<|turn|>assistant\nsee <|image:1|><|audio:2|><|document:3|><|file:4|><|end|>\n"
    assert [(x.kind, x.ref, x.tokens, a.segment[x.at : x.at + 2]) for x in a.attachments] == [("image", "img://1", 10, "<|"), ("audio", "a", 750, "<|"), ("document", "d", 3, "<|"), ("file", "v", 0, "<|")]
    assert a.extra_tokens == 763 and [a.segment[x.start : x.end] for x in a.loss] == ["see "]
    assert chat.parse_segment(b.segment) == ("user", "") and b.loss == []


def test_adjacent_text_parts_make_no_control_string(spark):
    parts = [("text", x, None, None) for x in ("a [INS", "T] </", None, "s> x <", "|end|", ">")] + [("image", None, "i", 1), ("text", "<", None, None), ("text", "|turn|>", None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_turns(df).first()
    shown = r.segment.removeprefix(chat.TURN).removesuffix(chat.END).replace("<|image:1|>", "")
    assert not any(c in shown for c in chat.CONTROL)
    assert [chat.unescape(r.segment[x.start : x.end]) for x in r.loss] == ["a [INST] </s> x <|end|>", "<|turn|>"]
    assert r.segment[r.attachments[0].at :].startswith("<|image:1|>")


# --- 4: near duplicates


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(docs, n):
    sets = defaultdict(list)
    for i, t in docs:
        sets[i].append(shingles(t, n))
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    inverted = defaultdict(set)
    for i in ids:
        for s in sets[i]:
            for g in s:
                inverted[g].add(i)
    for i in ids:
        near = Counter(j for s in sets[i] for g in s for j in inverted[g] if j < i)
        for j in near:
            for a in sets[i]:
                for b in sets[j]:
                    if a and b and 100 * len(a & b) >= 80 * len(a | b) and root(i) != root(j):
                        parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in ids}


def test_near_duplicates_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in minhash.op4_minhash_near_dedup(spark, sf).collect()}
    want = brute_components(docs, 4)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) and r.n_shingles == len(shingles(dict(docs)[i], 4)) for i, r in got.items())


def test_near_duplicates_odd_rows(spark, tables):
    got = minhash.op4_minhash_near_dedup(spark, tables[0]).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert [by[i].n_shingles for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1]
    assert [by[i].component_id for i in (1, 4, 5, 7, 8, 9, 10)] == [1, 4, 4, 7, 7, 9, 9]
    assert by[None].component_id is None and by[None].kept


def test_group_of_graded_copies(spark):
    """Copies of one text with up to a third of its words changed: links between copies that the original doesn't link."""
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(160):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(0, 8)), replace=False):
            w[at] = f"x{rng.integers(0, 3)}"
        rows.append((i + 5, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, minhash.NearDupConfig(shingle=4)).collect()}
    assert got == brute_components(rows, 4)


def test_shingles_shared_with_the_leader_only(spark):
    """Two texts are alike, and ten shingles of one are shared by their bucket's leader only; all are in the same two buckets."""
    c = minhash.NearDupConfig(shingle=1, permutations=1, rows=1)
    for seed in range(5000):
        texts = [" ".join(f"w{seed}_{i}" for i in range(n)) for n in (200, 100, 90, 30, 39, 50, 64)]
        if len({tuple(minhash.band_keys(minhash.shingle_set(t, 1), c)) for t in texts}) == 1:
            break
    rows = [(5 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, c).collect()}
    assert got == brute_components(rows, 1) and got[6] == got[7] == 6


def test_word_hashes_do_not_depend_on_steps(monkeypatch):
    text = "Ä b\tc " * 50 + "x" * 300 + " tail\n"
    whole = minhash.words_of(text)
    monkeypatch.setattr(minhash, "STEP", 16)
    parts = minhash.words_of(text)
    assert (parts.hashes == whole.hashes).all() and parts.joined == whole.joined and len(whole.hashes) == len(WORD.findall(text))


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_words_that_collide_in_polynomials(spark):
    """Polynomial hashes modulo 2^64 give these two words one value, whatever the base is."""
    w = thue_morse(4096)
    other = w.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{w} {w} {w} {w} {w}"), (2, " ".join([other] * 5)), (3, f"{w} x {w} {w} y"), (4, f"{other} x {other} {other} y")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(1, 5)}


def test_links_are_confirmed_on_the_words(spark, monkeypatch):
    """Two texts whose shingles have the same hashes share what their words share."""
    a, b = minhash.ShingleSet("one two three four five six", 2), minhash.ShingleSet("one two three four nine ten", 2)
    b.hashes = a.hashes
    assert a.shared(b, 80) < 5 and a.shared(a, 80) == 5
    assert minhash.ShingleSet("x y", 5).shared(minhash.ShingleSet("X  Y", 5), 80) == 1


def variants(n, base, changed, seed, words=60):
    """n texts of so many words around one base, each with up to `changed` words of its own."""
    rng = np.random.default_rng(seed)
    for i in range(n):
        w = [f"{base}{k}" for k in range(words)]
        for k in rng.choice(words, int(rng.integers(0, changed + 1)), replace=False):
            w[k] = f"x{i}_{k}"
        yield " ".join(w)


def test_null_and_repeated_ids(spark):
    c = minhash.NearDupConfig(shingle=3)
    near = list(variants(12, "a", 2, 1, 200))
    rows = [(5, near[0]), (None, near[1]), (None, "all alone here with no id at all"), (None, "  "), (7, ""), (7, near[2]), (8, None), (8, None)]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), c).collect())
    assert got == Counter({(5, 5, True): 1, (None, 5, False): 1, (None, None, True): 2, (7, 5, False): 2, (8, 8, True): 2})
    # every doc_id has two texts; links of either count
    rows = []
    for base in range(6):
        texts = list(variants(8, f"b{base}_", 3, base))
        rows += [(10 * base + k, texts[k]) for k in range(4)] + [(10 * ((base + 3) % 6) + k + 5, texts[k + 4]) for k in range(2)]
        rows += [(10 * base + 5, f"one more {base} text")]
    rows += [(200 + k, t) for k, t in enumerate(variants(6, "b0_", 2, 40))] + [(-3, rows[0][1]), (-(1 << 63), "least of all numbers"), ((1 << 63) - 1, "least of all numbers")]
    got = defaultdict(set)
    for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), c).collect():
        got[r.doc_id].add(r.component_id)
    assert {i: v.pop() for i, v in got.items() if len(v) == 1} == brute_components(rows, 3)


def test_filter_leaves_one_row_of_each_component(spark):
    near = list(variants(6, "a", 1, 2, 200))
    rows = [(5, near[0], 1), (5, near[0], 1), (5, near[0], 2), (None, near[1], 3), (9, near[2], 4), (None, "alone without an id here", 5), (None, "alone without an id here", 6), (7, "", 7), (7, "", 8), (9, None, 9), (11, "some other text of five words", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = minhash.near_dup_filter(df)
    assert got.columns == df.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert kept == Counter({(5, near[0]): 1, (None, "alone without an id here"): 1, (7, ""): 2, (11, "some other text of five words"): 1})


def test_remaining_pairs_in_blocks(spark):
    """Blocks of two classes: every pair of a bucket that the bounds leave open is formed once."""
    c = minhash.NearDupConfig(pair_block=2)
    rng = np.random.default_rng(3)
    rows = [(b, bytes([b, i]), 100, bytes([i % 3]), int(rng.integers(70, 100)), int(rng.integers(0, 10)), float(rng.random() * 0.6), [b]) for b in range(3) for i in range(25)]
    left = spark.createDataFrame(rows, "band long, node binary, n long, comp binary, both long, else long, d double, bands array<long>")
    got = Counter((bytes(r.a), bytes(r.b)) for r in minhash.remaining_pairs(left, c, []).collect())
    want = set()
    for x in rows:
        for y in rows:
            most = min(x[4], y[4]) + min(x[5], y[5])
            if x[0] == y[0] and x[1] < y[1] and x[3] != y[3] and abs(x[6] - y[6]) <= 0.2 + 1e-9 and 100 * most >= 80 * (200 - most):
                want.add((x[1], y[1]))
    assert set(got) == want and set(got.values()) == {1}


def test_counted_join(spark):
    from callgrain.llm.common import join_counted

    left = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(600)], "key long, x long")
    right = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("key <> 3")
    got = join_counted(left, right, "key", "n", "x", least=10)
    assert sorted(map(tuple, got.select("key", "x", "n").collect())) == sorted(map(tuple, left.join(right, "key").select("key", "x", "n").collect()))


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(7, 7), (300, 301), (301, 300)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 301: 300}
    assert connected_components(e.limit(0)).count() == 0


# --- 5: pieces


def test_pieces_against_the_library():
    import random

    import sentencepiece

    path = pieces.vocabulary_path()
    lib, own, r = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceMachine(path), random.Random(2)
    alphabet = list("abcdefghij thein er on ▁  ,.!0123\n\t'éüß日本語ゼ😀執<>s0x41²·_") + ["\x00", "é", "   "]
    for k in range(4000):
        s = "".join(r.choice(alphabet if k % 5 else [" ", "  ", "a", "the"]) for _ in range(r.randint(0, 50)))
        ids = own.encode(s).tolist()
        assert ids == lib.encode(s) and own.decode(ids) == lib.decode(ids), s
    broken = [own.byte_id[0xE2], own.byte_id[0x96], own.id["a"], 1, 0]
    assert own.decode(broken) == lib.decode(broken)


def plain_merge(parts, score):
    while True:
        pairs = [(score[parts[i] + parts[i + 1]], -i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in score]
        if not pairs:
            return parts
        i = -max(pairs)[1]
        parts = parts[:i] + [parts[i] + parts[i + 1]] + parts[i + 2 :]


def test_shortest_path_against_all_paths():
    import random

    own, r = pieces.PieceMachine(pieces.vocabulary_path()), random.Random(4)

    def paths(s, last):
        """(cost, ids) of every path of finite cost through s: neighbours must stay apart when merged alone."""
        if not s:
            yield 0.0, []
        elif s[0] not in own.id:
            for c, ids in paths(s[1:], ""):
                yield c, [own.byte_id[b] for b in s[0].encode()] + ids
        else:
            for k in range(1, len(s) + 1):
                p = s[:k]
                if p in own.id and plain_merge(list(last + p), own.score) == ([last, p] if last else [p]):
                    for c, ids in paths(s[k:], p):
                        yield c - own.score[p], [own.id[p], *ids]

    for _ in range(300):
        s = "▁" * r.randint(0, 2) + "".join(r.choice("thereandingsoabc😀0") for _ in range(r.randint(1, 9)))
        found = list(paths(s, ""))
        cost, ids = own.shortest(s)
        assert len(found) == 1 and ids == found[0][1] and cost == pytest.approx(min(found)[0])


@pytest.mark.parametrize("change", ["kind", "charsmap", "spaces", "suffix", "user", "bytes"])
def test_unsupported_models_are_refused(change, tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(open(pieces.vocabulary_path(), "rb").read())
    if change == "kind":
        m.trainer_spec.model_type = 3
    elif change == "charsmap":
        m.normalizer_spec.precompiled_charsmap = b"x"
    elif change == "spaces":
        m.normalizer_spec.remove_extra_whitespaces = True
    elif change == "suffix":
        m.trainer_spec.treat_whitespace_as_suffix = True
    elif change == "user":
        m.pieces[500].type = 4
    else:
        del m.pieces[100]
    (tmp_path / "m").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        pieces.PieceMachine(str(tmp_path / "m"))


def unigram_model(path, seed, low=-14.0):
    """The given pieces with random scores, as a unigram model: nothing is trained."""
    import random

    from sentencepiece import sentencepiece_model_pb2

    m, r = sentencepiece_model_pb2.ModelProto(), random.Random(seed)
    m.ParseFromString(open(pieces.vocabulary_path(), "rb").read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.type == pieces.NORMAL:
            p.score = r.uniform(low, -1.0)
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_unigram_models_against_the_library(spark, tmp_path):
    import random

    import sentencepiece

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    alphabet = list("abcdefghij thein er on ▁  ,.!0123\n\t'éüß日本語ゼ😀執<>s0x41²·_") + ["\x00", "é", "   ", "ing", "the"]
    coded = []
    for seed in (1, 2):
        path, r = unigram_model(tmp_path / f"u{seed}", seed), random.Random(3)
        lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceMachine(path)
        strings = texts + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(2000)]
        ids, theirs = [own.encode(s).tolist() for s in strings], [lib.encode(s) for s in strings]
        cost = lambda v: sum(own.cost[i] for i in v)
        other = [(cost(a), cost(b)) for a, b in zip(ids, theirs, strict=True) if a != b]
        # the library sums in single precision, so of all but equal paths it may take another; never a cheaper one
        assert len(other) <= 4 and all(0 <= b - a + 1e-9 < 1e-6 * a + 1e-9 for a, b in other)
        assert all(own.decode(v) == lib.decode(v) for v in ids)
        coded.append(ids)
    differ = sum(a != b for a, b in zip(*coded, strict=True))
    assert differ > 1500  # the scores decide


def test_unigram_shortest_path_against_all_paths(tmp_path):
    import random

    own, r = pieces.PieceMachine(unigram_model(tmp_path / "u", 5)), random.Random(6)
    worst = max(-x for x in own.score.values())

    def paths(s):
        if not s:
            yield 0.0, []
        if s and s[0] not in own.id and s[0] != " ":
            yield from ((c + worst + 10, [own.byte_id[b] for b in s[0].encode()] + ids) for c, ids in paths(s[1:]))
        for k in range(1, len(s) + 1):
            p = s[:k].replace(" ", "▁")
            if p in own.id:
                yield from ((c - own.score[p], [own.id[p], *ids]) for c, ids in paths(s[k:]))

    several = 0
    for _ in range(300):
        s = r.choice(["", " ", "▁", "▁ "]) + "".join(r.choice("thereandingsoabc😀0") for _ in range(r.randint(1, 9)))
        found = list(paths(s))
        cost, ids = own.shortest(s)
        several += len(found) > 1
        assert cost == pytest.approx(min(found)[0])
        assert ids in [v for c, v in found if c == pytest.approx(cost, abs=1e-9)]  # paths of equal cost
    assert several > 250


def test_prefix_comes_from_the_model(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(open(pieces.vocabulary_path(), "rb").read())
    m.normalizer_spec.add_dummy_prefix = False
    (tmp_path / "m").write_bytes(m.SerializeToString())
    lib, own = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m")), pieces.PieceMachine(str(tmp_path / "m"))
    for s in ("the end", " the end", "  x", "a"):
        assert own.encode(s).tolist() == lib.encode(s) and own.decode(own.encode(s)) == lib.decode(lib.encode(s))


def test_pieces_odd_rows(spark, tables):
    got = {r.doc_id: r for r in pieces.op5_sentencepiece(spark, tables[0]).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and all(r.round_trip for r in got.values())
    import sentencepiece

    ids = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_path()).encode(LONG)
    assert got[9].n_tokens == len(ids) and got[9].ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


# --- 6: token files


def test_token_files_against_the_library(spark, tables, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenfile.vocabulary_path())
    for folder in (tables[0], sf):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        docs.sort(key=lambda r: (r.doc_id is not None, r.doc_id, r.text is not None, r.text))
        got = sorted(map(tuple, tokenfile.op6_token_files(spark, folder).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
        at = 0
        for r, g in zip(docs, got, strict=True):
            ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
            assert g == (at, r.doc_id, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
            at += len(ids)


def test_special_strings_inside_words():
    from tokenizers import Tokenizer

    path = tokenfile.vocabulary_path()
    lib, own = Tokenizer.from_file(path), tokenfile.WordEncoder(path)
    texts = ["a<|endoftext|>b c", "  İI'S ŉ's é ǅ x\x85y\xa0z ", "it's 123 ...\x0bq\x1cz", "ΑΣ ς"]
    assert [list(np.frombuffer(b, "<u4")) for b in own.encode_all(texts)] == [lib.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_settings_are_checked_on_loading(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    lib, own = Tokenizer.from_file(path), tokenfile.WordEncoder(path)
    assert own.splits == (name == "word_bpe_49k.json")
    texts = ["Two  words, and\n\nmore... 12's", None, ""]
    assert [list(np.frombuffer(b, "<u4")) for b in own.encode_all(texts)] == [lib.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_reader_opens_only_wanted_frames(tmp_path):
    from pyarrow import fs

    path = str(tmp_path / "f")
    docs = [(i, np.arange(i, i + n, dtype="<u4").tobytes()) for i, n in enumerate([3, 70_000, 0, 5, 9_000_000, 1])]
    with fs.LocalFileSystem().open_output_stream(path) as out:
        w = tokenfile.TokenFileWriter(out)
        for d in docs:
            w.add(*d)
        w.close()
    with fs.LocalFileSystem().open_input_file(path) as f:
        assert [(i, b) for i, _, b in tokenfile.read_documents(f)] == docs
        frames, _ = tokenfile.read_tables(f)
        assert len(frames) > 3
    data = bytearray(open(path, "rb").read())
    data[frames[0][0] + 100] ^= 255  # inside the second frame
    open(path, "wb").write(data)
    with fs.LocalFileSystem().open_input_file(path) as f:
        assert [b for _, _, b in tokenfile.read_documents(f, {0})] == [docs[0][1]]
        with pytest.raises(Exception):
            list(tokenfile.read_documents(f, {4}))


# --- 7: WARC


def test_warc_odd_rows(spark, tables):
    got = sorted(map(tuple, warc.op7_warc_revisits(spark, tables[0]).select("page_id", "record_type", "refers_to", "payload_bytes").collect()), key=repr)
    assert got == sorted([(1, "response", None, 203), (2, "revisit", 1, 203), (3, "revisit", 1, 203), (4, "response", None, 0), (5, "response", None, 5), (6, "response", None, 5), (None, "response", None, 203)], key=repr)


def test_warc_digests(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    got = warc.op7_warc_revisits(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        p = pages[r.page_id]
        again = len(p) >= 100 and first[p] != r.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None)


# --- 8: quality


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, tables, sf):
    for folder in (tables[0], sf):
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
        for r in quality.op8_quality_rules(spark, folder).collect():
            n = brute_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
            assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)


def test_windows_with_equal_hashes_are_compared(spark, monkeypatch):
    monkeypatch.setattr(quality.F, "xxhash64", lambda *x: F.lit(7).cast("long"))
    t = [" ".join(f"w{i}" for i in range(30)), "a b c d e f a b c d e g", "x " * 9]
    df = quality.with_features(spark.createDataFrame([(x,) for x in t], "text string").select(F.struct("text").alias("row")), F.col("row.text"))
    assert {r.row.text: r.n_repeat_words for r in df.collect()} == {x: brute_counts(x)[4] for x in t}


def test_copies_among_labelled_rows_are_one_trial(spark):
    """900 copies of one good document prove nothing."""
    text = "some good words that are here all the time and once more "
    docs = spark.createDataFrame([(i, text.upper() if i % 2 else text + " ", "en") for i in range(900)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    f = quality.features_of(docs).withColumn("doc_id", F.col("row.doc_id")).withColumn("content", quality.content_key(F.col("row.text")))
    assert quality.learn_cutoffs(f, labels, quality.RiskControl()).count() == 0
    distinct = docs.withColumn("text", F.concat("text", F.lit(" x"), "doc_id"))
    f = quality.features_of(distinct).withColumn("doc_id", F.col("row.doc_id")).withColumn("content", quality.content_key(F.col("row.text")))
    assert quality.learn_cutoffs(f, labels, quality.RiskControl()).first().cut_symbols_per_word is not None


def exact_cdf(k, n, p):
    from math import exp, lgamma, log, log1p

    return sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1))


def test_binomial_bound(spark):
    cases = [(0, 100), (3, 400), (12, 2000), (90, 10_000)]
    df = spark.createDataFrame([(float(k), float(n)) for k, n in cases], "k double, n double")
    got = [r[0] for r in df.select(quality.binomial_cdf(F.col("k"), F.col("n"), 0.01)).collect()]
    assert got == pytest.approx([exact_cdf(k, n, 0.01) for k, n in cases], rel=1e-9)


def test_cutoffs_hold_and_are_the_strictest(spark):
    rng = np.random.default_rng(3)
    rows = [("a" if i % 3 else None, int(i % 7 > 0), float(s), 0.0, 0.0) for i, s in enumerate(rng.exponential(0.03, 6000))]
    df = spark.createDataFrame(rows, "stratum string, quality int, symbols_per_word double, dup_line_share double, repeat_word_share double")
    c = quality.RiskControl()
    got = {r.stratum: r.cut_symbols_per_word for r in quality.cutoffs(df, c).collect()}
    for stratum in ("a", None):
        good = [r[2] for r in rows if r[0] == stratum and r[1]]
        allowed = [x for x in c.grid["symbols_per_word"] if exact_cdf(sum(s >= x for s in good), len(good), c.alpha / 3) <= c.delta / 6]
        assert got[stratum] == min(allowed)
    small = quality.cutoffs(df.limit(50), c).collect()
    assert all(r.cut_symbols_per_word is None for r in small)


# --- 9: HTML


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<nav>a</nav><article><h1>T&eacute;</h1><p>one\n two<p>x</p><aside>no</aside><div class='share-bar'>no</div></article><footer>f</footer>", "Té\none two\nx"),
        ("<body><div id=cookie-notice>c</div><div class=content><p>" + "long text " * 30 + "</p><p>short</p></div><ul><li><a href=x>m</a><li><a href=y>n</a></ul>", ("long text " * 30).strip() + "\nshort"),
        ("<article><p>a<script>if (1<2) '</p>'</script>b</p><!-- c --><form><p>f</p></form><section class=comments><p>no</p></section></article>", "ab"),
        ("<main><table><tr><td>1<td>2<tr><td>3</table><ul><li>i<li>j</ul></main>", "1\n2\n3\ni\nj"),
        ("<article><p>a<br>b &#8364; &nbsp; c</p></article>", "a b € c"),
        ("<main><article><header><h1>H</h1></header><p>a</p><div class='post-comments'>c</div><div class=article-footer>f</div></article><h2>More</h2></main>", "H\na"),
        ("<div class='page with-sidebar'><div class=main-nav>n</div><div class=post-content><p>" + "w " * 99 + "<p>z</div><div id=sidebar>s</div></div>", ("w " * 99).strip() + "\nz"),
        ("<div hidden>h</div><article>t<div style='display: none'>u</div></article><div role=navigation>v</div>", "t"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_teaser_cards_do_not_replace_the_story():
    story = [f"story {i} " + "long plain words of the story " * 8 for i in range(8)]
    cards = "".join(f"<article class=card><h3><a href=/{i}>Card {i}</a></h3><p>{'teaser of some other story ' * 5}</p></article>" for i in range(8))
    page = "<body><div class=wrap><div>" + "".join(f"<div>{x}</div>" for x in story) + f"</div><div class=list>{cards}</div></div></body>"
    got = html.main_text(page).split("\n")
    assert [x for x in got if x.startswith("story")] == [x.strip() for x in story]


@pytest.mark.parametrize(
    "part",
    [
        '<h2 id="related-work">t</h2>',
        '<h2 id="search-methods">t</h2>',
        '<section id="discussion"><p>t</p></section>',
        '<section id="comments-on-method" class="section"><p>t</p></section>',
        '<div id="social-history"><p>t</p></div>',
        '<p id="social-history">t</p>',
        '<span class="warning">t</span>',
        '<a id="login" href="#x">t</a>',
        '<div class="warning"><p>t</p></div>',
        '<div class="related-work"><p>t</p></div>',
    ],
)
def test_names_made_from_titles_stay(part):
    assert html.main_text(f"<article><p>a</p>{part}<p>b</p></article>") .split() == ["a", "t", "b"]
    assert html.main_text(f"<article><p>a {part}</p></article>").split() == ["a", "t"]
    for name in ("ad", "ads", "share-bar", "related-posts", "post-comments", "article-footer"):
        assert html.main_text(f"<article><p>a</p><div class={name}>no</div></article>") == "a"


PARAS = [f"Plain words of the story number {i} that go on for a while, so that the line is long enough to count. " * 2 for i in range(6)]
STORY = "\n".join(x.strip() for x in PARAS)
P, LINKS = "".join(f"<p>{x}</p>" for x in PARAS), "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(8))
TEASERS = "".join(f"<div><a href=/{i}>teaser</a> text of teaser</div>" for i in range(6))


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class=a1>{LINKS}</div><div class=b1><h2>Head</h2>{P}<ul><li>one<li>two</ul><p>end</p></div><div class=c1><p>Imprint and such</p></div>", f"Head\n{STORY}\none\ntwo\nend"),
        (f"<div class=a1>{LINKS}</div><div class=w><h1>Head</h1><div class=b1>{P}</div></div><div class=c1>Imprint</div>", f"Head\n{STORY}"),
        (f"<div>{LINKS}</div><div class=s><div>{P}</div><div>{P}</div><div>{P}</div></div>", "\n".join([STORY] * 3)),
        (f"<div id=l>{TEASERS}</div><div id=r><h1>H</h1>{P}</div>", f"H\n{STORY}"),
        (f"<div>{LINKS}</div><div class=b>{P}<p><a href=x>A paragraph that is a link</a></p>{P}</div>", f"{STORY}\nA paragraph that is a link\n{STORY}"),
        (f"<ul>{LINKS}</ul>{P}<ul>{LINKS}</ul>", STORY),
        (f"<form><div class=q1><ul>{LINKS}</ul></div><div class=q2><h1>Title</h1>{P}<p>short</p></div><div class=q3>Small print.</div></form>", f"Title\n{STORY}\nshort"),
        (f"<nav><ul>{LINKS}</ul><div class=q2><h1>Title</h1>{P}</div>", f"Title\n{STORY}"),
        (f"<nav><ul>{LINKS}</ul></nav><div class='node widget-article'><h1>T</h1>{P}</div><footer>foot text here</footer>", f"T\n{STORY}"),
        (f"<article>{P}<p class=alert-quote>q</p><p class=social-science>s</p><section id=discussion><h2>Discussion</h2><p>d</p></section></article>", f"{STORY}\nq\ns\nDiscussion\nd"),
        (f"<article>{P}<section class=comments><p>{PARAS[0]}</p><p>{PARAS[1]}</p></section></article>", STORY),
        (f"<div>Some teaser text that stands here, longer than a menu, with many words.</div><form><div>{P}</div></form>", STORY),
    ],
)
def test_ratios_choose_the_region(page, text):
    """Pages without article elements, with names that tell nothing or the wrong thing."""
    assert html.main_text(f"<html><body>{page}</body></html>") == text


def test_clusters_decide(monkeypatch, sf):
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{sf}/pages.parquet").column("html").to_pylist()
    before = [html.main_text(x) for x in pages]
    monkeypatch.setattr(html, "content_runs", lambda ratios, groups, sizes: [True] * len(ratios))
    assert sum(html.main_text(x) != b for x, b in zip(pages, before, strict=True)) >= len(pages) // 4


def test_threshold_against_all_cuts():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 10, 40):
        v, w = rng.normal(size=n).round(1).tolist(), rng.integers(1, 50, n).tolist()

        def spread(cut):
            total = 0.0
            for part in ([(a, b) for a, b in zip(v, w, strict=True) if a < cut], [(a, b) for a, b in zip(v, w, strict=True) if a >= cut]):
                if part:
                    mean = sum(a * b for a, b in part) / sum(b for _, b in part)
                    total += sum(b * (a - mean) ** 2 for a, b in part)
            return total

        assert spread(html.threshold(v, w)) == pytest.approx(min(map(spread, v)))


def test_smoothing_against_the_formula():
    r, g = [3.0, 0.0, 10.0, 4.0, 4.0], [0, 0, 1, 0, 0]
    k = lambda d: np.exp(-d * d / 8)
    assert html.smoothed(r, g)[1] == pytest.approx((3 * k(1) + 4 * k(2) + 4 * k(3)) / (k(0) + k(1) + k(2) + k(3)))
    assert html.smoothed(r, g)[2] == 10


@pytest.mark.parametrize("page", ["<div>a" * 40_000, "<b><p>x</p>" * 30_000, "<i><div>" + "<b>" * 30_000 + "</i>" * 30_000, "<li>" * 40_000 + "x"])
def test_odd_nesting_is_linear(page):
    import time

    began = time.time()
    assert html.main_text(page)[:1] in ("a", "x", "")
    assert time.time() - began < 6


def test_main_text_of_pages(spark, sf):
    """The made pages keep their text in one article element."""
    import html as entities

    got = {r.page_id: r for r in html.op9_html_main_text(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|li|ul|div)\b[^>]*>", body))
        want = "\n".join(filter(None, blocks))
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


# --- 10: mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > 2 * sizes[s]}
        if not full:
            out |= {s: left * w[s] / total for s in open_}
            break
        out |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_mix(which, spark, tables, sf):
    folder = tables[0] if which == "odd" else "/root/testdata/sf0.01"
    rows = mixing.op10_mix_sources(spark, folder).collect()
    again = mixing.op10_mix_sources(spark.newSession(), folder).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(rows) == len(docs)
    sizes = Counter()
    for d in docs:
        sizes[d.source] += len(WORD.findall(d.text or ""))
    want, taken, biggest = brute_targets(sizes), Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(biggest[s] * (2 if which == "odd" else 1), 0.02 * want[s])


def test_mix_gives_whole_rows(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    table = mixing.op10_mix_sources(spark, tables[0])
    assert out.count() == table.agg(F.sum("copies")).first()[0]


def test_tree_rounds_to_the_nearest_count(spark):
    units = spark.range(1000).select(F.lit("s").alias("source"), "id", (F.col("id") % 50 + 1).alias("size"), F.lit(0.3).alias("p"))
    rounded = mixing.round_units(units, mixing.MixConfig(block=8)).collect()
    assert len(rounded) == 1000 and sum(r.one for r in rounded) in (299, 300, 301)


SOURCES = "<p><a href=x>Source one of the story</a></p><p><a href=y>Source two of it</a></p>"
MENU = f"<nav><ul>{LINKS}</ul></nav>"
FOOT = "<footer><p>Copyright 2024</p><a href=t>Terms</a></footer>"


@pytest.mark.parametrize("before, after", [("", ""), (MENU, ""), (MENU, FOOT), (f"<ul>{LINKS}</ul>", f"<ul>{LINKS}</ul>")])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_links_at_the_end_of_the_story_stay(tag, before, after):
    page = f"<html><body>{before}<{tag}>{P}{SOURCES}</{tag}>{after}</body></html>"
    assert html.main_text(page) == f"{STORY}\nSource one of the story\nSource two of it"
    listed = f"<html><body>{before}<{tag}><ul><li><a href=1>First</a><li><a href=2>Second</a></ul>{P}</{tag}>{after}</body></html>"
    assert html.main_text(listed) == f"First\nSecond\n{STORY}"


def test_smoothing_keeps_short_lines_and_drops_a_long_one(monkeypatch):
    """Short lines inside long text, and one long line inside a list: alone, their ratios say the wrong thing."""
    ratios = [2.0] * 9 + [60.0] + [2.0] * 9 + [160.0, 3.0, 4.0] * 6
    sizes = [2] * 9 + [60] + [2] * 9 + [160, 3, 4] * 6
    runs = html.content_runs(ratios, [0] * len(ratios), sizes)
    assert runs == [False] * 19 + [True] * 18 or runs == [False] * 18 + [True] * 19
    monkeypatch.setattr(html, "smoothed", lambda r, g, s=0: list(r))
    raw = html.content_runs(ratios, [0] * len(ratios), sizes)
    assert raw[9] and sum(raw[-18:]) == 6


def compared_share(x, queries, c):
    """Rows that queries are compared with, as a share of all, and the recall of what they meet, by the index's own parts."""
    n, top = len(x), (x**2).sum(axis=1).max()
    raised = np.concatenate([x, np.sqrt(np.maximum(top - (x**2).sum(axis=1), 0))[:, None]], axis=1).astype("f4")
    lists = n // c.list_rows
    sample = raised[np.random.default_rng(0).permutation(n)[: lists * c.sample_per_list]]
    graph = ann.Graph(ann.balanced_centroids(sample, lists).astype("f4"), c.graph_degree)
    held = ann.members([np.array(t) for at in range(0, n, 4000) for t in ann.lists_of(raised[at : at + 4000], graph, c)])
    q = np.concatenate([x[queries], np.zeros((len(queries), 1))], axis=1).astype("f4")
    work = hits = 0
    for at, visited in zip(queries, ann.probes_of(q, graph, c), strict=True):
        rows = [held[v] for v in visited.tolist() if v in held]
        work += sum(map(len, rows))
        s = x @ x[at]
        s[at] = -np.inf
        hits += len(np.intersect1d(np.concatenate(rows), np.argsort(-s)[:20]))
    return work / len(queries) / n, hits / len(queries) / 20


@pytest.mark.parametrize("kind, most", [("groups", 0.15), ("random", 1.0)])
def test_work_and_recall_of_the_default_parameters(kind, most):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 64))[rng.integers(0, 150, 40_000)] + 0.6 * rng.normal(size=(40_000, 64)) if kind == "groups" else unit(rng, 40_000, 64)
    share, recall = compared_share(np.asarray(x, np.float64), list(range(0, 40_000, 800)), ann.AnnConfig())
    print(kind, share, recall)
    assert share <= most and recall >= 0.9


def test_a_doc_id_of_a_third_of_all_rows_is_dealt_over_files(spark, tmp_path):
    rows = [(7 if i % 3 == 0 else i, f"text {i} with a few words") for i in range(6000)] + [(7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = f"file://{tmp_path}/files"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if the files were large
    try:
        index = tokenfile.write_token_files(docs, folder, tokenfile.vocabulary_path())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(r.n_docs for r in index.collect())
    assert len(sizes) > 2 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    back = tokenfile.read_token_files(index, folder).orderBy("start").collect()
    assert [r.doc_id for r in back] == sorted(d for d, _ in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(back, back[1:], strict=False))
