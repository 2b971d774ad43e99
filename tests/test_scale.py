"""Operators of one call against plain loops, on odd rows and on calls of 100,000 segments."""

import random
import time

import pytest
from pyspark.sql import functions as F

from callgrain.operators import analysis, search, tasks


def brute_ids(rows):
    """Each row in order takes its base, or the first free number."""
    taken, out = {}, {}
    for call, kind, base, pos in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        held = taken.setdefault((call, kind), set())
        name, k = base, 2
        while name in held:
            name, k = f"{base}:{k}", k + 1
        held.add(name)
        out[call, kind, pos] = f"{call}:{kind}:{name}"
    return out


def test_unique_ids_are_those_of_a_loop(spark):
    r = random.Random(3)
    bases = ["a", "a:2", "a:3", "a:2:2", "a:2:3", "a:3:2", "b", "b:10", "b:02", "b:1", "a:2:2:2", ":2", "c:2"]
    rows = [(f"call{c}", k, r.choice(bases[: 4 + c % 9]), i) for c in range(40) for k in ("extracted", "reviewed") for i in range(r.randint(1, 14))]
    df = spark.createDataFrame(rows, "call_id string, kind string, task_id string, pos long").repartition(3)
    got = {(x.call_id, x.kind, x.pos): x.stored_id for x in tasks.unique_task_ids(df).collect()}
    assert got == brute_ids(rows)


def test_unique_ids_of_a_long_call(spark):
    n = 100_000
    df = spark.range(n).select(F.lit("c").alias("call_id"), F.lit("extracted").alias("kind"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("dup:"), (F.col("id") % 1000 + 2).cast("string"))).otherwise("dup").alias("task_id"), F.col("id").alias("pos"))
    began = time.time()
    got = tasks.unique_task_ids(df).select(F.count_distinct("stored_id"), F.count("stored_id")).first()
    assert tuple(got) == (n, n) and time.time() - began < 60


def brute_source(task, segs):
    low = (task or "").lower()
    for test in (lambda s: low and low[:40] in s, lambda s: any(w in s for w in low.split()[:3]), lambda s: True):
        for i, text in segs:
            if test((text or "").lower()):
                return i
    return None


@pytest.mark.parametrize("searched", [50_000, 3])
def test_task_sources_are_those_of_a_loop(spark, monkeypatch, searched):
    monkeypatch.setattr(tasks.first_holders, "__defaults__", (searched,))
    r = random.Random(4)
    word = lambda: r.choice(["send", "Report", "a", "né", "will", "ÉTÉ", "x1", "  ", "call me", "z" * 50])
    segs = [(c, i, None if r.random() < 0.05 else " ".join(word() for _ in range(r.randint(0, 6))), float(i)) for c in "abcdef" for i in range(r.randint(1, 20))]
    rows = [(c, f"t{i}", r.choice([None, "", " ", "zzzq", " ".join(word() for _ in range(r.randint(1, 4)))])) for c in "abcdefg" for i in range(15)]
    s = spark.createDataFrame(segs, "call_id string, seg_idx int, text string, start_sec double")
    t = spark.createDataFrame([(*x, "old", 1.0) for x in rows], "call_id string, task_id string, text string, source_quote string, source_timestamp double")
    got = {(x.call_id, x.task_id): x.source_timestamp for x in tasks.attach_task_source(t, s).collect()}
    assert got == {(c, i): brute_source(text, [(n, x) for k, n, x, _ in segs if k == c]) for c, i, text in rows}
    assert tasks.attach_task_source(t.limit(0), s).count() == 0 and tasks.attach_task_source(t, s.limit(0)).where("source_quote is null").count() == len(rows)


def test_task_sources_of_a_long_call(spark):
    n = 100_000
    s = spark.range(n).select(F.lit("c").alias("call_id"), F.col("id").cast("int").alias("seg_idx"), F.concat(F.lit("we need to send the report number "), F.col("id").cast("string"), F.lit(" now")).alias("text"), F.col("id").cast("double").alias("start_sec"))
    t = spark.range(n).select(F.lit("c").alias("call_id"), F.col("id").cast("string").alias("task_id"), F.concat(F.lit("send the report number "), F.col("id").cast("string"), F.lit(" now")).alias("text"), F.lit("").alias("source_quote"), F.lit(0.0).alias("source_timestamp"))
    began = time.time()
    wrong = tasks.attach_task_source(t, s).where(F.col("source_timestamp") != F.col("task_id").cast("double")).count()
    assert wrong == 0 and time.time() - began < 60


def test_signals_are_the_first_ten(spark):
    texts = ["We decided it?", "I will call", None, "", "plain", "Agreed. We will send it?", "i promise"]
    rows = [(f"c{c}", i, texts[(i * (c + 1)) % 7], float(i)) for c in range(5) for i in range(60 if c else 3)] + [("quiet", 0, "plain", 0.0)]
    got = {x.call_id: x for x in analysis.call_signals(spark.createDataFrame(rows, "call_id string, seg_idx int, text string, start_sec double")).collect()}
    assert got.keys() == {x[0] for x in rows}
    for call, x in got.items():
        own = [t or "" for c, _, t, _ in rows if c == call]
        low = [t.lower() for t in own]
        assert x.decisions == [t for t, v in zip(own, low, strict=True) if "decided" in v or "agreed" in v][:10]
        assert x.open_questions == [t for t in own if "?" in t][:10]
        assert x.commitments == [t for t, v in zip(own, low, strict=True) if "i will" in v or "we will" in v or "promise" in v][:10]
        assert [y.text for y in x.tasks] == [t for t, v in zip(own, low, strict=True) if "will" in v or "send" in v or "call" in v]
        assert [y.task_id for y in x.tasks] == [f"task_{i + 1:04d}" for i, v in enumerate(low) if "will" in v or "send" in v or "call" in v]


def test_search_by_postings(spark, tmp_path):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    rows = [(i, f"{word()}.wav", None if i % 97 == 0 else " ".join(word() for _ in range(30)) + ("Zebra_x 10%" if i % 400 == 7 else ""), f"2024-0{1 + i % 9}-11") for i in range(3000)]
    calls = spark.createDataFrame(rows, "call_id long, source_filename string, search_text string, day string").withColumn("imported_at", F.to_timestamp("day"))
    folder = str(tmp_path / "index")
    search.build_search_index(calls, folder)
    for q, source, date in [("zebra", "", ""), ("ZEB%x 1", "", ""), ("ze_ra", "", "2024-03"), ("abc", "a", "2024-0"), ("ab", "", ""), ("%", "", ""), ("", "", ""), ("nothing here", "", ""), ("10%", "", ""), ("é", "", "")]:
        want = [x.call_id for x in search.archive_search(calls, q, source, date).collect()]
        assert [x.call_id for x in search.indexed_search(spark, folder, q, source, date).collect()] == want, q
    found = search.search_candidates(spark, folder, "zebra").collect()
    assert len(found) == 8 and len({x.block for x in found}) <= 8  # of 64 blocks
    plan = search.indexed_search(spark, folder, "zebra")._jdf.queryExecution().executedPlan().toString()
    assert "block" in plan and search.search_candidates(spark, folder, "a_b") is None


def test_index_tasks_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    from callgrain.operators import search

    calls = spark.range(400).selectExpr("id call_id", "date_add(date'2024-01-01', int(id)) imported_at", "'s' source_filename", "concat('the same words ', id, ' and ', id * 7919) search_text")
    for name, n in (("MADE_CHARS", 100), ("WRITTEN_CHARS", 50), ("SORTED_CHARS", 20)):
        monkeypatch.setattr(search, name, n, raising=False)
    search.build_search_index(calls, str(tmp_path))
    found = search.indexed_search(spark, str(tmp_path), "wOrds%39_ and")
    assert [r.call_id for r in found.orderBy("call_id").collect()] == list(range(390, 400))
    postings = spark.read.parquet(f"{tmp_path}/postings")
    frequent = postings.groupBy("bucket").count().orderBy("count", ascending=False).first().bucket
    files = [r["count"] for r in postings.where(f"bucket = {frequent}").groupBy("_metadata.file_path").count().collect()]
    assert len(files) > 4 and max(files) < sum(files) / 4  # of the largest folder: one file, or four, whatever its size
    assert spark.read.parquet(f"{tmp_path}/texts").select("block").distinct().count() <= search.TEXT_BLOCKS
