"""Model calls: prompts, attempts, parsing, fallbacks."""

import json

from pyspark.sql import functions as F

from tidalframe.functions import models
from tidalframe.operators import calls
from tidalframe.sources import tables


def test_scores_by_place_first_answer_counts():
    text = 'x ```json\n[{"id": 2, "score": 9}, {"id": 2, "score": 1}, {"id": 0, "score": 5}, {"id": 4, "score": 5}, {"id": 1, "score": "7"}]\n``` y'
    assert calls.parsed_scores(text, 3) == {2: 9.0, 1: 7.0}
    assert calls.first_parsed([None, "no", '{"id": 1}', "[]"], lambda t: calls.parsed_scores(t, 3)) == {}
    assert calls.first_parsed([None, "[1]"], lambda t: calls.parsed_scores(t, 3)) is None


def test_hits_keep_well_typed_fields():
    text = '```json\n{"highlights": [{"start_s": 1, "end_s": "x", "viral_score": true, "hook_text": "h"}, {}]}\n```'
    assert calls.parsed_hits(text) == [{"start_s": 1, "hook_text": "h"}, {}]
    assert calls.first_parsed(['{"other": 1}'], calls.parsed_hits) == [] and calls.first_parsed(["[]", '{"highlights": [1]}'], calls.parsed_hits) is None


def test_batches_ask_retry_and_fall_back(spark):
    rows = spark.createDataFrame([(b, i, (i - 1) * 30.0, i * 30.0, None if i == 2 else f"text {b} {i}") for b in (0, 1, 2) for i in range(1, 5)], "batch long, id int, start_s double, end_s double, text string")
    prompts = calls.batch_prompts(rows)
    first = prompts.where("batch = 0").first()
    assert first.prompt == "#1 [0.0s-30.0s]:\ntext 0 1\n#2 [30.0s-60.0s]:\n\n#3 [60.0s-90.0s]:\ntext 0 3\n#4 [90.0s-120.0s]:\ntext 0 4"

    def answer(prompt, attempt):
        if "text 2" in prompt or attempt == 0:
            raise TimeoutError
        return json.dumps([{"id": 1, "score": 8}, {"id": 3, "score": 6.5}])

    scores = calls.score_batches(rows, calls.asked(prompts, answer, retries=1))
    got = {(r.batch, r.id): (r.score, r.status) for r in scores.collect()}
    for b in (0, 1):
        assert [got[b, i] for i in range(1, 5)] == [(8.0, "scored"), (None, "missing"), (6.5, "scored"), (None, "missing")]
    assert {got[2, i] for i in range(1, 5)} == {(5.0, "error")} and len(got) == 12
    assert sorted((r.batch, r.id) for r in calls.passed(scores).collect()) == [(0, 1), (1, 1)]
    assert {r.status for r in calls.score_batches(rows, calls.with_attempts(prompts, spark.createDataFrame([], "digest string, attempt int, answer string"))).collect()} == {"error"}


def test_transcripts_are_sampled(spark):
    cues = spark.range(3000).selectExpr("if(id % 2 = 0, 1L, 2L) as source_id", "id div 2 as cue_idx", "cast(id as double) as start_s", "'t' as text")
    prompts = {r.source_id: r.prompt.split("\n") for r in calls.transcript_prompts(cues.unionByName(spark.range(4000).selectExpr("3L as source_id", "id as cue_idx", "cast(id as double) as start_s", "'u' as text"))).collect()}
    assert len(prompts[1]) == 300 and len(prompts[3]) == 500 and prompts[3][1] == "[5s / 0:05] u"
    answers = spark.createDataFrame([(1, ["no", '{"highlights": [{"start_s": 2, "viral_score": 70}]}']), (2, None), (3, ["no"])], "source_id int, attempts array<string>")
    assert [(r.source_id, r.hit_idx, r.start_s, r.viral_score, r.end_s) for r in calls.detect(answers).collect()] == [(1, 0, 2.0, 70, None)]


def test_detailed_answer_and_report(spark):
    rows = spark.createDataFrame([("{}", "x" * 120, 7.0, 8.0), ('{"score": 81, "hook_score": 20, "has_conclusion": true}', None, 1.0, 1.0), (None, None, 1.0, 2.0)], "answer string, text string, p1 double, p2 double")
    a, b, c = models.detailed_answer(rows, "p1", "p2").collect()
    assert (a.final_score, a.hook_text, a.explanation, a.hook_score) == (75.0, "x" * 100 + "...", models.AUTO_SCORED, None)
    assert (b.final_score, b.hook_text, b.explanation, b.hook_score, b.has_conclusion) == (81.0, "", "", 20, True)
    assert (c.final_score, c.best_quote, c.explanation) == (15.0, "", models.AUTO_SCORED)
    ranked = spark.createDataFrame([(i, 80.5, 61.0, 92.0, "h", None, "w", 7.0, 8.0) for i in range(1, 8)], "rank int, final_score double, start_s double, end_s double, hook_text string, best_quote string, explanation string, p1 double, p2 double")
    lines = [r.line for r in tables.full_report(ranked).orderBy("rank", "line_no").collect()]
    assert len(lines) == 4 + 5 * 8 and lines[4:7] == ["", "#1 - SCORE: 80/100", "⏱️  Time: 00:01:01 - 00:01:32"] and lines[8] == "💬 Best Quote: "
    assert tables.full_report(ranked).where(F.col("rank") == 6).count() == 0


def test_sources_with_one_prompt_keep_their_answers(spark, tmp_path):
    from tidalframe.plans.queries import QUERIES

    turns = [(1, 0, "Same."), (2, 0, "Same."), (2, 1, ""), (3, 0, "..."), (4, 0, None), (4, 1, "Same.")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.source_id, r.hit_idx): (r.hook_text, r.end_s) for r in QUERIES["text_detector"](spark, str(tmp_path)).collect()}
    assert got == {(k, i): (f"hook {k}", n * 2.5 if i == 0 else n + 20.25) for k, n in ((1, 1), (2, 2), (3, 1), (4, 2)) for i in (0, 1)}
    # Batches of equal texts: each has its own answers.
    spark.createDataFrame([(i, f"text {i % 25}") for i in range(75)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.batch, r.id): r.score for r in QUERIES["batch_calls"](spark, str(tmp_path)).collect()}
    want = {(d // 25, d % 25 + 1): 5.0 if d // 25 % 5 == 0 else None if d % 13 == 0 else d % 10 + 1.0 for d in range(75)}
    assert got == want


def test_an_answer_is_parsed_once(spark):
    rows = spark.createDataFrame([("{}", "x", 7.0, 8.0)], "answer string, text string, p1 double, p2 double").repartition(1)
    for out in (models.detailed_answer(rows, "p1", "p2"), models.detailed_score(rows, "p1", "p2")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1 and plan.count("try_parse_json") + plan.count("VariantExpressionEvalUtils") + plan.count("parseJson") <= 2


def test_every_cue_of_a_transcript_is_asked(spark, tmp_path, monkeypatch):
    from tidalframe.plans.queries import QUERIES

    # 1 203 sentences over 3 turns: three prompts; 1 000 of line breaks only, whose two prompts are equal; one; none.
    turns = [(1, t, " ".join(f"Cue {i}." for i in range(t * 401, t * 401 + 401))) for t in range(3)]
    turns += [(2, t, "\n") for t in range(1000)] + [(3, 0, "Alone."), (4, 0, "...")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    asked, attempts = [], calls.with_attempts

    def seen(prompts, *rest):
        asked.append(prompts)
        return attempts(prompts, *rest)

    monkeypatch.setattr(calls, "with_attempts", seen)
    got = {(r.source_id, r.hit_idx): (r.start_s, r.hook_text, r.score) for r in QUERIES["text_detector"](spark, str(tmp_path)).collect()}
    want = {(k, i): ((1.5, n * 1.0)[i], f"hook {k}", (k, n)[i]) for k, n in ((1, 3), (2, 1000), (3, 1), (4, 1)) for i in (0, 1)}
    assert got == want
    lines, parts = {}, {}
    for r in asked[0].orderBy("source_id", "part").collect():
        lines.setdefault(r.source_id, []).extend(x.split("] ")[1] for x in r.prompt.split("\n") if "] " in x)
        parts[r.source_id] = parts.get(r.source_id, 0) + 1
    assert lines[1] == [f"Cue {i}." for i in range(1203)] and lines[3] == ["Alone."]
    assert parts == {1: 3, 2: 2, 3: 1, 4: 1}
