"""Micro fixtures with expectations derived by hand (FIXTURES.md)."""

import pytest
from pyspark.sql import functions as F

from tidalframe.functions import models, scoring, text, timefmt
from tidalframe.operators import captions, energy, intervals, ranking, streams, tracking, windows
from tidalframe.sources import tables, vtt


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(
    ("value", "lenient", "strict", "colon"),
    [("00:01:23.456", 83.456, 83.456, 83.456), ("00:01:23.5", 83.005, 0.0, 83.5), ("00:01:23.4567", 87.567, 83.456, 83.4567), ("01:23.456", 0.0, 0.0, 83.456)],
)
def test_timestamps(spark, value, lenient, strict, colon):
    c = F.lit(value)
    got = one(spark, timefmt.lenient_seconds(c), timefmt.strict_seconds(c), timefmt.colon_seconds(c))
    assert [pytest.approx(x) for x in got] == [lenient, strict, colon]


def test_clock_forms(spark):
    got = one(spark, timefmt.format_clock(F.lit(3725.9)), timefmt.format_label(F.lit(125.2)), timefmt.clock_seconds(F.lit("01:02:05")), timefmt.clock_seconds(F.lit("02:05")), timefmt.transcript_line(F.lit(12.7), F.lit("x")))
    assert tuple(got) == ("01:02:05", "2:05", 3725.0, None, "[12s / 0:12] x")


CAPTIONS = """WEBVTT

00:00:00.000 --> 00:00:02.000
bonjour<00:00:00.500><c> à</c><00:00:01.000><c> tous</c>

00:00:02.000 --> 00:00:02.010
bonjour à tous

00:00:02.010 --> 00:00:04.000
bonjour à tous
merci<00:00:03.000><c> bien.</c>
"""


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("f", CAPTIONS)], "source_id string, value string")


def test_separator_and_all_cues(files):
    assert [(r.start_s, r.text) for r in vtt.separator_cues(files).collect()] == [(2.0, "bonjour à tous")]
    cues = [(r.start_s, r.end_s, r.text) for r in vtt.all_cues(files).orderBy("cue_idx").collect()]
    assert cues == [(0.0, 2.0, "bonjour   à    tous"), (2.0, 2.01, "bonjour à tous"), (2.01, 4.0, "bonjour à tous merci   bien.")]


def test_text_between(files):
    near = vtt.text_between(vtt.separator_cues(files), F.lit(3.0), F.lit(9.0))
    assert [r.text for r in near.collect()] == ["bonjour à tous"]


def test_word_cues(files):
    words = lambda off: [(r.word, round(r.start_s, 3), round(r.end_s, 3)) for r in vtt.word_cues(files, off).orderBy("start_s", "word_idx").collect()]
    assert words(0.0) == [("bonjour", 0.0, 0.5), ("à", 0.5, 1.0), ("tous", 1.0, 2.0), ("merci", 2.01, 3.0), ("bien.", 3.0, 4.0)]
    assert words(-1.0) == [("bonjour", 0.0, 0.1), ("tous", 0.0, 1.0), ("merci", 1.01, 2.0), ("bien.", 2.0, 3.0)]


def test_whole_file_scans(spark, tmp_path):
    (tmp_path / "a.vtt").write_text(CAPTIONS)
    assert vtt.all_cues(vtt.read_whole(spark, str(tmp_path / "a.vtt"))).count() == 3
    (tmp_path / "w.json").write_text('{"segments":[{"words":[{"word":" hi ","start":1.0,"end":1.5}]},{"words":[{"word":"yo","start":2.0,"end":2.5}]}]}')
    assert [tuple(r)[1:] for r in tables.words_json(spark, str(tmp_path / "w.json"), 1.0).orderBy("word_idx").collect()] == [(0, "hi", 2.0, 2.5), (1, "yo", 3.0, 3.5)]
    (tmp_path / "d.json").write_text('[{"start":0.0,"end":5.0,"speaker":"A"},{"start":5.0,"end":9.0,"speaker":"B"}]')
    assert [(r.seg_idx, r.start_s, r.end_s, r.speaker) for r in tables.speakers_json(spark, str(tmp_path / "d.json")).collect()] == [(0, 0.0, 5.0, "A"), (1, 5.0, 9.0, "B")]
    (tmp_path / "c.json").write_text('[{"start":0.0,"end":1.0,"crop_x":100}]')
    assert [r.crop_x for r in tables.crops_json(spark, str(tmp_path / "c.json")).collect()] == [100]
    tables.write_json(spark.range(2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_silence_log(spark):
    log = "x silence_start: 1.5\ny silence_end: 2.5 | silence_duration: 1\nsilence_start: 8"
    logs = spark.createDataFrame([("f", log, 10.0)], "source_id string, value string, d double")
    assert [(r.start_s, r.end_s) for r in tables.silence_log(logs).collect()] == [(1.5, 2.5)]
    assert [(r.start_s, r.end_s) for r in tables.silence_log(logs, "d").collect()] == [(1.5, 2.5), (8.0, 10.0)]


def test_first_segment_wins_closed(spark):
    seg = spark.createDataFrame([("s", 0, 0.0, 5.0, "A"), ("s", 1, 5.0, 9.0, "B")], "source_id string, seg_idx int, start_s double, end_s double, speaker string")
    grid = spark.createDataFrame([("s", 10), ("s", 18), ("s", 19)], "source_id string, frame_idx long")
    assert {r.frame_idx: r.speaker for r in intervals.first_at_frame(grid, seg, "speaker", 2.0).collect()} == {10: "A", 18: "B", 19: None}


def test_last_writer_wins_floored(spark):
    seg = spark.createDataFrame([("s", 0, 0.0, 1.0, 100), ("s", 1, 0.5, 2.0, 200)], "source_id string, seg_idx int, start_s double, end_s double, crop_x int")
    grid = spark.range(30).select(F.lit("s").alias("source_id"), F.col("id").alias("frame_idx"))
    got = [r.crop_x for r in intervals.last_at_frame(grid, seg, "crop_x", 10.0).orderBy("frame_idx").collect()]
    assert got == [100] * 5 + [200] * 15 + [0] * 10


def test_group_and_word_lookup(spark):
    words = spark.createDataFrame([("s", 0, "a", 0.0, 1.0), ("s", 1, "b", 1.0, 2.0), ("s", 2, "c", 2.0, 3.0)], "source_id string, word_idx int, word string, start_s double, end_s double")
    groups = captions.fixed_groups(words, 2)
    grid = spark.createDataFrame([("s", 200), ("s", 220), ("s", 235)], "source_id string, frame_idx long")
    got = {r.frame_idx: (r.seg_idx, r.word) for r in captions.frame_words(grid, groups, 100.0).collect()}
    assert got == {200: (0, 1), 220: (0, 1), 235: (1, 0)}
    points = grid.withColumn("t", F.col("frame_idx") / 100)
    asof = {r.frame_idx: (r.seg_idx, r.active) for r in intervals.next_ending(points, groups).collect()}
    assert asof == {200: (1, True), 220: (1, True), 235: (1, True)}
    assert captions.distinct_renders(captions.frame_words(grid, groups, 100.0)).count() == 2


def test_sentence_windows(spark):
    cues = spark.createDataFrame([("s", 0, 0.0, 12.0, "a b."), ("s", 1, 12.0, 24.0, "c d?"), ("s", 2, 24.0, 33.0, "e f!"), ("s", 3, 33.0, 50.0, "g h")], "source_id string, cue_idx int, start_s double, end_s double, text string")
    got = [(r.start_s, r.end_s, r.text) for r in windows.sentence_windows(cues).orderBy("start_s").collect()]
    assert got == [(0.0, 33.0, "a b. c d? e f!"), (20.0, 50.0, "c d? e f! g h"), (40.0, 70.0, "g h")]


def test_energy_variance_and_scores(spark):
    samples = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate([3, 3, 3, 3, 1, 1, 1, 1, 9])], "source_id string, i int, amp double")
    assert energy.tumbling_variance(samples, ["source_id"], ["i"], 4).first().energy_var == 1.0
    assert energy.tumbling_variance(samples.where("i < 7"), ["source_id"], ["i"], 4).first().energy_var == 0.0
    metrics = spark.createDataFrame([("s", 0.1, 0.0, 2.0, 0.10), ("s", 0.3, 0.0, 4.0, 0.50)], "source_id string, rms double, energy_var double, rate double, silence_ratio double")
    assert sorted(round(r.score, 6) for r in energy.normalised_scores(metrics).collect()) == [2.8, 7.5]


def test_near_time_dedup(spark):
    hits = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate([(0, 50), (25, 60), (50, 55), (58, 61), (100, 10)])], "source_id string, hit_id int, start_s double, score double")
    assert sorted(r.start_s for r in ranking.near_dedup(hits).collect()) == [25.0, 58.0, 100.0]


def test_keep_segments(spark):
    silences = spark.createDataFrame([("s", 2.0, 3.0), ("s", 5.0, 5.1), ("s", 9.5, 10.0)], "source_id string, start_s double, end_s double")
    totals = spark.createDataFrame([("s", 10.0), ("t", 4.0)], "source_id string, total double")
    kept = lambda df, s: [(round(r.start_s, 3), round(r.end_s, 3)) for r in df.where(F.col("source_id") == s).orderBy("seg_idx").collect()]
    keeps = intervals.keep_segments(silences, totals)
    assert kept(keeps, "s") == [(0.0, 2.075), (2.925, 9.575), (9.925, 10.0)] and kept(keeps, "t") == [(0.0, 4.0)]
    assert kept(intervals.cutter_segments(silences, totals), "s") == [(0.0, 2.075), (2.925, 5.075), (5.025, 9.575), (9.925, 10.0)]
    points = spark.createDataFrame([("s", 1.0), ("s", 2.5), ("s", 4.0)], "source_id string, t double")
    assert [r.t_cut and round(r.t_cut, 3) for r in intervals.remap_times(points, keeps).orderBy("t").collect()] == [1.0, None, 3.15]
    assert "concat=n=3" in tables.trim_filter(keeps.where("source_id = 's'")).first().graph


def test_smoothing(spark):
    rows = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 2.0), ("s", 2, 6.0)], "source_id string, idx int, x double")
    assert [r.m for r in rows.select(windows.moving_average("x", ("idx",), 1).alias("m")).collect()] == [1.5, 3.0, 4.0]
    line = spark.createDataFrame([("s", i, y) for i, y in enumerate([0.0, None, None, None, 1.0, None, None])], "source_id string, idx int, y double")
    assert [r.v for r in line.select("idx", windows.interpolate("idx", "y", F.col("y").isNotNull()).alias("v")).orderBy("idx").collect()] == [0.0, 0.25, 0.5, 0.75, 1.0, 1.0, 1.0]
    ema = streams.Ema(0.95)
    assert [ema.step(1), ema.step(0)] == [1.0, 0.95]


def test_hysteresis_machine():
    single = [{"cx": 0.8, "w": 0.1, "score": 0.9}]
    held = streams.Hysteresis()
    assert {held.step(single) for _ in range(100)} == {0.5}
    follows = streams.Hysteresis(reset_on_single=False)
    assert [follows.step(single) for _ in range(15)][-1] == 0.8
    wide = [{"cx": 0.2, "w": 0.1, "score": 0.9}, {"cx": 0.8, "w": 0.2, "score": 0.5}]
    state = streams.Hysteresis()
    assert [state.step(wide) for _ in range(16)] == [0.5] * 14 + [0.8] * 2


def test_median_segments(spark):
    rows = lambda xs: spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(xs)], "source_id long, idx long, x double")
    got = lambda xs: [(r.start_idx, r.end_idx, r.crop_x) for r in tracking.segment_by_median(rows(xs), 100.0, 2.0).orderBy("seg_idx").collect()]
    assert got([0, 0, 0, 20, 20, 20]) == [(0, 3, 0), (3, 6, 20)]
    assert got([0, 0, 20, 20, 20, 20]) == [(0, 3, 0), (3, 6, 20)]


def test_short_segments_merge(spark):
    seg = spark.createDataFrame([(1, 0, 0, 5, 10), (1, 1, 5, 6, 20), (1, 2, 6, 11, 30), (2, 0, 0, 1, 7), (2, 1, 1, 6, 8)], "source_id long, seg_idx long, start_idx long, end_idx long, crop_x long")
    got = sorted(tuple(r) for r in tracking.merge_short(seg, 3).collect())
    assert got == [(1, 0, 0, 6, 10), (1, 1, 6, 11, 30), (2, 0, 0, 1, 7), (2, 1, 1, 6, 8)]


def test_text_functions(spark):
    c = lambda s: text.clean_word(F.lit(s))
    assert tuple(one(spark, c("&lt;b&gt;x"), c("[ __ ]"), c("&nbsp;__"))) == ("x", "***", "***")
    answers = spark.createDataFrame([('```json\n{"total":7}\n```',), ("oops",)], "answer string")
    assert [(r.rubric.total, r.rubric.verdict) for r in models.rubric(answers).collect()] == [(7, None), (0, "parse_error")]
    scored = answers.withColumns({"p1": F.lit(7.0), "p2": F.lit(8.0)})
    assert [r.final_score for r in models.detailed_score(scored, "p1", "p2").collect()] == [75.0, 75.0]
    assert models.score_texts(spark.createDataFrame([("a?",)] * 30, "text string"), models.heuristic_scorer).count() == 30


def test_word_groups(spark):
    words = spark.createDataFrame([(1, i, "x", i * 1.0, i + 1.0) for i in range(9)], "source_id long, word_idx long, word string, start_s double, end_s double")
    size = lambda n: [len(r.words) for r in captions.fixed_groups(words.where(F.col("word_idx") < n)).orderBy("seg_idx").collect()]
    assert size(8) == [4, 4] and size(9) == [4, 4, 1]
    packed = captions.packed_groups(words, {"X": 1.0}, 100.0).groupBy("group_idx").count().orderBy("group_idx").collect()
    assert [r["count"] for r in packed] == [6, 3]
    narrow = captions.packed_groups(words, {"X": 60.0}, 100.0).groupBy("group_idx").count().collect()
    assert {r["count"] for r in narrow} <= {1, 2}


def test_geometry(spark):
    got = one(spark, *scoring.crop_size(F.lit(1920), F.lit(1080)), *scoring.crop_size(F.lit(480), F.lit(1080)), scoring.crop_left(F.lit(1.0), F.lit(1920), F.lit(607)), scoring.silence_score(F.lit(0.5)), scoring.fitted_font(F.lit(60), F.lit(2000), F.lit(1080)))
    assert tuple(got)[:5] == (607, 1080, 480, 853, 1313) and round(got[5], 6) == 0.5 and got[6] == 27


def test_recovery_holds_and_reopens():
    state = streams.Recovery(1920, 1080, 1.0)
    face = {"cx": 400.0, "cy": 500.0, "w": 300.0, "h": 400.0, "score": 0.9}
    assert state.step([face]) == 96
    assert [state.step([]) for _ in range(5)] == [96] * 5
    assert state.step([dict(face, cx=1500.0, w=700.0)]) == int(1500 - 303.5)


def test_remaining_selectors(spark):
    hits = spark.createDataFrame([(0, 0, 5), (0, 1, 9), (0, 2, 8), (0, 26, 9), (0, 1, 7)], "batch int, id int, score int")
    rows = spark.createDataFrame([(0, i, i * 10) for i in range(1, 4)], "batch int, id int, doc int")
    assert {(r.doc, r.score) for r in ranking.back_join(rows, hits).collect()} == {(10, 7), (20, 8)}
    assert [r.id for r in ranking.every_nth(spark.range(20), "id", 5, 3).collect()] == [0, 5, 10]
    placed = spark.createDataFrame([(1, 0, 0, 0, 100.0), (1, 0, 0, 1, 50.0)], "source_id int, group_idx int, line_idx int, word_idx int, w double")
    assert [r.x for r in captions.line_layout(placed, 1000.0, 1000.0, 10.0, 50.0).orderBy("word_idx").collect()] == [420.0, 530.0]


def test_clean_pages_cleans_whole_texts(spark, sf):
    import re

    from tidalframe.plans.queries import QUERIES

    def clean(html):
        for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", "\xa0"), ("copy", "\xa9"), ("amp", "&")):
            html = html.replace(f"&{name};", value)
        space = " \t\n\x0b\f\r\xa0"
        html = re.sub("<[^>]+>", "", html).strip(space)
        return re.sub(rf"\[?[{space}]*__[{space}]*\]?", "***", html)

    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r.text for r in QUERIES["clean_pages"](spark, sf).collect()}
    assert max(len(r.html) for r in pages) > 300
    assert got == {r.page_id: clean(r.html) for r in pages}


def test_clean_entities_decodes_as_the_library(spark, sf):
    import html
    import re

    from tidalframe.plans.queries import QUERIES

    def clean(word):
        space = " \t\n\x0b\f\r\xa0"
        word = re.sub("<[^>]+>", "", html.unescape(word)).strip(space)
        return re.sub(rf"\[?[{space}]*__[{space}]*\]?", "***", word)

    got = {r.page_id: r.text for r in QUERIES["clean_entities"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert got == {r.page_id: clean("&eacute;&#233;&#xE9;&notin; " + r.html) for r in pages}
    rows = spark.createDataFrame([(None,), ("",), ("a&b",), ("&lt;b&gt;x",)], "w string")
    assert [r.c for r in rows.select(text.clean_every_entity(F.col("w")).alias("c")).collect()] == [None, "", "a&b", "x"]


def test_result_files(spark, tmp_path):
    import glob
    import json

    ranked = spark.createDataFrame([(i, f"clip {i}", i * 1.5) for i in range(1, 8)], "rank long, clip string, score double")
    tables.write_results(ranked.repartition(3), str(tmp_path / "out"))
    read_one = lambda name: json.loads(open(glob.glob(str(tmp_path / "out" / name / "part-*"))[0], encoding="utf-8").read())
    assert [r["rank"] for r in read_one("final")] == [1, 2, 3, 4, 5] and len(read_one("all")) == 7
    assert read_one("final")[0] == {"rank": 1, "clip": "clip 1", "score": 1.5}


def test_faces_by_height_and_order(spark):
    face = lambda cx, w, h, s: (cx, w, h, s)
    rows = spark.createDataFrame([([face(9.0, 600.0, 10.0, 0.9), face(5.0, 10.0, 600.0, 0.9), face(7.0, 500.0, 500.0, 0.2), face(3.0, 5.0, 5.0, 0.4)],)], "f array<struct<cx:double,w:double,h:double,score:double>>")
    kept = rows.select(tracking.plausible(F.col("f"), 1080.0).alias("f")).first().f
    assert [x.cx for x in kept] == [7.0, 3.0]
    assert [x.cx for x in rows.select(tracking.by_x(F.col("f")).alias("f")).first().f] == [3.0, 5.0, 7.0, 9.0]
    state = streams.Recovery(1920, 1080, 1.0)
    tall = {"cx": 400.0, "cy": 500.0, "w": 100.0, "h": 600.0, "score": 0.9}
    assert state.step([tall]) == 656  # taller than half of the height
    low = {"cx": 400.0, "cy": 5.0, "w": 300.0, "h": 400.0, "score": 0.9}
    assert state.step([low]) == 96 and state.step([dict(low, cy=1000.0)]) == 96  # only x counts
    assert state.step([dict(low, cx=1900.0, w=10.0, h=10.0, score=0.2)]) == 96  # rates below the least


def test_hysteresis_clamps_and_agrees_strictly():
    low, high = tracking.crop_bounds(1920, 1080)
    assert (round(low, 6), round(high, 6)) == (round(607 / 3840, 6), round(1 - 607 / 3840, 6))
    one = lambda cx: [{"cx": cx, "w": 0.1, "score": 0.9}]
    state = streams.Hysteresis(start=0.2, bounds=(low, high))
    assert state.step(one(0.01)) == low
    wide = lambda cx: [{"cx": 0.0, "w": 0.1, "score": 0.9}, {"cx": cx, "w": 0.2, "score": 0.5}]
    state = streams.Hysteresis(needed=2)
    assert [state.step(wide(x)) for x in (0.75, 0.875, 0.8125)] == [0.5, 0.5, 0.875]  # 0.125 apart: another candidate
    assert streams.Hysteresis(needed=2, agree=0.125).step(wide(0.75)) == 0.5
    state = streams.Hysteresis(needed=2, agree=0.125)
    assert [state.step(wide(x)) for x in (0.75, 0.875)] == [0.5, 0.5]  # exactly the bound does not agree
    both = [{"cx": 0.6, "w": 0.2, "score": 0.9}, {"cx": 0.2, "w": 0.2, "score": 0.9}]
    assert streams.Hysteresis(needed=1).step(both) == 0.2  # equals: the leftmost


def test_segments_stay_inside_the_frame(spark):
    rows = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([950, 950, 950, -40, -40, -40])], "source_id long, idx long, x double")
    assert [r.crop_x for r in tracking.segment_by_median(rows, 100.0, 2.0, src_w=1000).orderBy("seg_idx").collect()] == [900, 0]


def test_long_timelines_cost_their_length(spark):
    import time

    rows = spark.range(60_000).selectExpr("1L as source_id", "id as idx", "cast(id as double) as t", "if(id % 50000 = 0, cast(id as double), null) as y")
    began = time.time()
    assert rows.select(windows.interpolate("idx", "y", F.col("y").isNotNull()).alias("v")).agg(F.sum("v")).first()[0] > 0
    ends = spark.createDataFrame([(1, 0, 0.0, 59_999.5)], "source_id long, seg_idx int, start_s double, end_s double")
    assert intervals.next_ending(rows.select("source_id", "idx", "t"), ends).where("active").count() == 60_000
    assert time.time() - began < 30
