"""Tables laid out by call, saved speaker roles, and the lines of a report."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from callgrain.operators import compare, index, mapping
from callgrain.plans.queries import detail_parts, laid_out
from callgrain.sources import layout

FORM = "call_id string, seq int, clusters array<string>, roles array<string>"
SEGMENT = "call_id string, seg_idx int, start_sec double, text string, speaker_cluster_id string, speaker_label string"
META = "call_id string, speaker_mapping map<string,string>, speaker_mapping_reviewed_at timestamp, speaker_mapping_source string, clusters string"
TEXTS = "call_id string, short string, detailed string, tasks string, reviewed string"
RUN = "run_id int, file string, provider string, model_name string, ok boolean, language string, elapsed_seconds double, text string, error string, failure_kind string, file_size_bytes long, input_path string"


@pytest.fixture
def merge_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_detail_of_laid_out_tables_has_no_exchange(spark, sf, merge_joins):
    parts = detail_parts(spark, sf)
    plain = index.call_detail(*parts.values())
    assert plan_of(plain).count("Exchange") >= 8
    laid = index.call_detail(*laid_out(spark, parts).values())
    assert "Exchange" not in plan_of(laid)
    assert laid.count() == plain.count()
    assert "Exchange" not in plan_of(laid.where("call_id = 3"))


def test_layout_keeps_nulls_hot_calls_and_extra_columns(spark, tmp_path, merge_joins):
    rows = [(None, 1, "a"), (None, 2, "b")] + [("hot", i, "x") for i in range(500)] + [(f"c{i}", i, None) for i in range(100)]
    df = spark.createDataFrame(rows, "call_id string, n int, _bucket string")
    layout.save_by_call(df, "laid_rows", str(tmp_path / "rows"), 7, ("n",))
    back = layout.by_call(spark, "laid_rows")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    grouped = back.groupBy("call_id").agg(F.count("*").alias("n"))
    assert "Exchange" not in plan_of(grouped) and {r.call_id: r.n for r in grouped.collect()}["hot"] == 500
    layout.save_by_call(df.where("false"), "laid_rows", str(tmp_path / "rows"), 7)
    assert layout.by_call(spark, "laid_rows").count() == 0


def saved(spark, forms, segs, meta, texts, calls):
    at = F.lit(dt.datetime(2024, 1, 20))
    return mapping.save_speaker_mapping(
        spark.createDataFrame(forms, FORM), spark.createDataFrame(meta, META), spark.createDataFrame(segs, SEGMENT), spark.createDataFrame(texts, TEXTS), spark.createDataFrame(calls, "call_id string, search_text string, mapping string"), at
    )


def test_saved_roles_reach_every_table(spark):
    forms = [
        ("a", 1, ["s1", "s2"], ["other", "other"]),
        ("a", 2, ["s1", "s2", "s1"], ["me", "boss", "unknown"]),  # the later of two roles, an unknown role left out
        ("b", 1, ["s1"], [None]),  # no valid role
        ("gone", 1, ["s1", "s2"], ["me"]),  # no metadata, fewer roles than clusters
        ("nil", 1, None, None),
    ]
    segs = [("a", 1, 0.0, "hi", "s1", "x"), ("a", 2, 1.0, "yes", "s2", "x"), ("a", 3, 2.0, None, None, ""), ("b", 1, 0.0, "b", "s1", "me"), ("c", 1, 0.0, "c", "", "kept")]
    meta = [("a", None, None, None, "x"), ("b", {"s1": "me"}, None, "none", "x"), ("c", {"s1": "me"}, None, "old", "x"), ("nil", {"s1": "me"}, None, None, None)]
    out = saved(spark, forms, segs, meta, [("a", "short", None, "", "r")], [("a", "old a", "m"), ("c", "old c", "m"), ("b", None, None)])
    m = {r.call_id: r for r in out["metadata"].collect()}
    assert [m[c].speaker_mapping for c in "abc"] == [{"s1": "unknown"}, {}, {"s1": "me"}] and m["nil"].speaker_mapping == {}
    assert [m[c].speaker_mapping_source for c in "abc"] == ["ui", "ui", "old"] and m["c"].speaker_mapping_reviewed_at is None
    assert m["a"].speaker_mapping_reviewed_at == dt.datetime(2024, 1, 20) and m["a"].clusters == "x"
    labels = {(r.call_id, r.seg_idx): (r.speaker_cluster_id, r.speaker_label) for r in out["segments"].collect()}
    assert labels == {("a", 1): ("s1", "unknown"), ("a", 2): ("s2", "s2"), ("a", 3): ("speaker_1", "speaker_1"), ("b", 1): ("s1", "s1"), ("c", 1): ("", "kept")}
    clean = {r.call_id: r.clean_text for r in out["transcripts"].collect()}
    assert set(clean) == {"a", "b", "gone", "nil"} and clean["gone"] == clean["nil"] == "" and clean["a"].startswith("[0000.00] UNKNOWN: hi\n")
    log = {(r.call_id, r.seq): (r.event, r.mapping) for r in out["log"].collect()}
    assert log == {("a", 1): ("speaker_mapping_saved", {"s1": "other", "s2": "other"}), ("a", 2): ("speaker_mapping_saved", {"s1": "unknown"}), ("b", 1): ("speaker_mapping_saved", {}), ("gone", 1): ("speaker_mapping_saved", {"s1": "me"}), ("nil", 1): ("speaker_mapping_saved", {})}
    calls = {r.call_id: (r.search_text, r.mapping) for r in out["calls"].collect()}
    assert calls["c"] == ("old c", "m") and calls["a"] == (clean["a"] + "\nshort\n\n\nr", "m") and calls["b"] == (clean["b"], None)


def test_saving_roles_twice_or_none_changes_nothing(spark):
    segs, meta = [("a", 1, 0.0, "hi", "s1", "x")], [("a", None, None, None, None)]
    once = saved(spark, [("a", 1, ["s1"], ["me"])], segs, meta, [], [("a", "", None)])
    again = saved(spark, [("a", 1, ["s1"], ["me"])], [tuple(r) for r in once["segments"].collect()], [tuple(r) for r in once["metadata"].collect()], [], [tuple(r) for r in once["calls"].collect()])
    for k in ("metadata", "segments", "transcripts", "calls", "log"):
        assert once[k].collect() == again[k].collect()
    none = saved(spark, [], segs, meta, [], [("a", "t", None)])
    assert [none[k].count() for k in ("metadata", "segments", "transcripts", "log", "calls")] == [1, 1, 0, 0, 1]
    assert none["calls"].first().search_text == "t"


def test_report_reads_as_text(spark):
    runs = [
        (2, "b.wav", "cloud", "w", False, None, 1.25, None, "HTTP  500\nbusy", None, 9, ""),
        (1, "b.wav", "local", "m", True, "en", 2.0, " a  b ", None, None, 9, "/tmp/x"),
        (3, None, None, None, None, "", None, None, None, None, None, None),
    ]
    rows = compare.report_lines(spark.createDataFrame(runs, RUN)).orderBy("file", "run_pos", "line_no").collect()
    b = "\n".join(r.line for r in rows if r.file == "b.wav")
    assert b == (
        "=" * 80 + "\nb.wav\nFile size bytes: 9\n\nlocal:m\n-------\nstatus: ok\nlanguage: en\nelapsed_seconds: 2.00\ninput_path: /tmp/x\nchars: 6\nexcerpt: a b\n\n"
        "cloud:w\n-------\nstatus: failed\nlanguage: unknown\nelapsed_seconds: 1.25\nfailure_kind: unknown\nerror: HTTP  500\nbusy\n"
    )
    assert [r.line for r in rows if r.file is None][4:] == [":", "-", "status: failed", "language: unknown", "elapsed_seconds: 0.00", "failure_kind: unknown", "error: ", ""]
    assert compare.report_lines(spark.createDataFrame([], RUN)).count() == 0
