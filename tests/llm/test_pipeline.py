"""Each stage, on the output of the one before, against a plain version of what it should do."""

from collections import Counter, defaultdict

import numpy as np
from test_ops import brute_components, brute_counts, brute_targets, exact_cdf

import corpus_pipeline
from callgrain.llm import langid, pieces, quality

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_language(model, text):
    """Softmax of the summed weights of a text's n-grams, counted one by one."""
    score, n = np.zeros(len(model.labels)), 0
    for gram, k in Counter(np.concatenate(list(langid.gram_steps(text, model.config))).tolist()).items():
        score, n = score + k * model.table[gram].astype(float), n + k
    e = np.exp(score / n - (score / n).max())
    return e.max() / e.sum()


def plain_quality(docs, labels):
    """ids of the documents that pass, by exact bounds over lists."""
    control = quality.RiskControl()
    counts = {d.doc_id: brute_counts(d.text) for d in docs}
    lines = {d.doc_id: sum(1 for x in (d.text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")) for d in docs}
    signal = {}
    for i, (n, _, symbols, dup, repeat) in counts.items():
        signal[i] = {"symbols_per_word": symbols / n if n else 0, "dup_line_share": dup / lines[i] if lines[i] else 0, "repeat_word_share": repeat / n if n else 0}
    base = {i for i, c in counts.items() if c[0] >= 10 and 100 * c[4] <= 20 * c[0]}
    good = defaultdict(dict)
    for d in docs:
        if d.doc_id in base and labels.get(d.doc_id) is not None:
            key = "".join(d.text.lower().split())
            if labels[d.doc_id] == 1:
                good[d.lang].setdefault(key, signal[d.doc_id])
    cut = {}
    for lang, texts in good.items():
        for s, grid in control.grid.items():
            level = control.delta / (len(good) * len(control.grid))
            passed = [c for c in grid if exact_cdf(sum(x[s] >= c for x in texts.values()), len(texts), control.alpha / 3) <= level]
            cut[lang, s] = min(passed, default=np.inf)
    return {d.doc_id for d in docs if d.doc_id in base and all(signal[d.doc_id][s] < cut.get((d.lang, s), np.inf) for s in control.grid)}


def test_stages(spark, tmp_path):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "minhash_near_dedup", "mix_sources", "sentencepiece_ids"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs)
        if name != "sentencepiece_ids":
            assert docs.columns == columns

    before, after = kept["language_id"]
    model = langid.train(before.select("doc_id", "text", "lang").where(~langid.held_out(before["doc_id"])))
    want = {d.doc_id for d in before.collect() if any(c.isalpha() for c in d.text or "") and plain_language(model, d.text) >= 0.4}
    assert {d.doc_id for d in after.collect()} == want and len(want) > 0.95 * before.count()

    before, after = kept["quality_rules"]
    labels = defaultdict(lambda: None)
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r.quality is not None:
            labels[r.doc_id] = max(r.quality, labels[r.doc_id] or 0)
    want = plain_quality(before.collect(), labels)
    assert {d.doc_id for d in after.collect()} == want and 0 < len(want) < before.count()

    before, after = kept["minhash_near_dedup"]
    component = brute_components([(d.doc_id, d.text) for d in before.collect()], 5)
    want = [tuple(d) for d in before.collect() if component[d.doc_id] == d.doc_id]
    assert rows(after) == sorted(want, key=repr) and len(want) < before.count()

    before, after = kept["mix_sources"]
    n_words = {d.doc_id: brute_counts(d.text)[0] for d in before.collect()}
    size, copies, taken, biggest = Counter(), Counter(d.doc_id for d in after.collect()), Counter(), Counter()
    for d in before.collect():
        size[d.source] += n_words[d.doc_id]
        biggest[d.source] = max(biggest[d.source], n_words[d.doc_id])
    target = brute_targets(size)
    for d in before.collect():
        factor = target[d.source] / size[d.source]
        assert copies[d.doc_id] in (int(factor + 1e-9), int(factor + 1e-9) + 1) and copies[d.doc_id] <= 2
        taken[d.source] += copies[d.doc_id] * n_words[d.doc_id]
    assert all(abs(taken[s] - target[s]) <= max(biggest[s], 0.02 * target[s]) for s in size)
    own = {d.doc_id: tuple(d) for d in before.collect()}
    assert all(own[d.doc_id] == tuple(d) for d in after.collect())

    before, after = kept["sentencepiece_ids"]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_path())
    texts = {d.doc_id: d.text for d in before.collect()}
    assert after.count() == before.count()
    assert all(r.token_ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.token_ids) for r in after.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(after)
