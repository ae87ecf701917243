"""Model calls as table functions: detectors of a source's transcript, scorers of ordered batches.

A prompt is built from the rows of its source or batch, in order. Answers come from a table of
recorded answers keyed by the prompt's digest, and the caller where calls were recorded one by one (several attempts each), or from a function that a
deployment hands in; nothing here calls a network. A table function takes the rows of one prompt,
partitioned and ordered by Spark, tries the attempts until one parses, and gives typed rows; where
none does, a scorer falls back to a default and a detector finds nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows in a batch, score at which a passage passes, score where no answer parses.
BATCH, PASSES, DEFAULT = 25, 7, 5.0
#: Every fifth cue of a sampled transcript; lines of a prompt at most.
STEP, MOST = 5, 500
SCORED = "batch long, id int, score double, status string"
HITS = "source_id long, hit_idx int, start_time string, end_time string, start_s double, end_s double, duration_seconds int, hook_text string, punchline string, why_viral string, viral_score int"

Answer = Callable[[str, int], str]


def unfenced(text: str) -> str:
    """An answer without the code fence around it."""
    text = text.strip()
    if "```" not in text:
        return text
    inner = text.split("```json", 1)[1] if "```json" in text else text.split("```", 1)[1]
    return inner.split("```", 1)[0].strip()


def parsed_scores(text: str, size: int) -> dict[int, float]:
    """Scores by place in the batch (1 to ``size``); of repeated places the first, of wrong ones none."""
    out: dict[int, float] = {}
    for item in json.loads(unfenced(text)):
        place, score = int(item["id"]), float(item["score"])
        if 1 <= place <= size:
            out.setdefault(place, score)
    return out


def parsed_hits(text: str) -> list[dict]:
    """The highlights of a detector's answer, fields of another type left out."""
    kinds = {"start_time": str, "end_time": str, "start_s": (int, float), "end_s": (int, float), "duration_seconds": int, "hook_text": str, "punchline": str, "why_viral": str, "viral_score": int}
    found = json.loads(re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", text.strip()))).get("highlights", [])
    return [{k: h[k] for k, kind in kinds.items() if isinstance(h.get(k), kind) and not isinstance(h.get(k), bool)} for h in found]


def first_parsed(attempts: list, parse: Callable):
    """The first attempt that parses; None if none does."""
    for text in attempts:
        try:
            return parse(text)
        except (ValueError, KeyError, TypeError, AttributeError):
            continue
    return None


def digest(prompt: Column) -> Column:
    return F.sha2(F.encode(prompt, "UTF-8"), 256)


def batch_prompts(rows: DataFrame) -> DataFrame:
    """(batch, prompt, digest) of rows (batch, id, start_s, end_s, text)."""
    line = F.format_string("#%d [%.1fs-%.1fs]:\n%s", "id", "start_s", "end_s", F.coalesce("text", F.lit("")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("batch").agg(F.array_join(listed, "\n").alias("prompt")).withColumn("digest", digest(F.col("prompt")))


def transcript_prompts(cues: DataFrame) -> DataFrame:
    """(source_id, prompt, digest): every fifth cue (cue_idx, start_s, text), 500 at most, with its
    time: one prompt for a glance at a source. ``transcript_parts`` has every cue."""
    sampled = cues.where((F.col("cue_idx") % STEP == 0) & (F.col("cue_idx") < STEP * MOST))
    return _listed_cues(sampled, "source_id")


def transcript_parts(cues: DataFrame) -> DataFrame:
    """(source_id, part, prompt, digest): every cue (cue_idx, start_s, text) with its time, in parts
    of ``MOST`` cues, so that no prompt grows with its source."""
    return _listed_cues(cues.withColumn("part", F.floor(F.col("cue_idx") / MOST).cast("int")), "source_id", "part")


def _listed_cues(cues: DataFrame, *keys: str) -> DataFrame:
    from ..functions.timefmt import transcript_line

    listed = F.transform(F.array_sort(F.collect_list(F.struct("cue_idx", transcript_line(F.col("start_s"), F.col("text")).alias("line")))), lambda x: x["line"])
    return cues.groupBy(*keys).agg(F.array_join(listed, "\n").alias("prompt")).withColumn("digest", digest(F.col("prompt")))


def with_attempts(prompts: DataFrame, recorded: DataFrame, *keys: str) -> DataFrame:
    """``prompts`` with ``attempts``: the recorded answers (digest, attempt, answer) in order of attempt.

    ``keys`` name the columns, of both, whose calls were recorded each by itself: sources (parts,
    batches) with one prompt among them then keep their own answers.
    """
    on = [*keys, "digest"]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("attempt", "answer"))), lambda x: x["answer"])
    return prompts.join(recorded.groupBy(*on).agg(listed.alias("attempts")), on, "left")


def asked(prompts: DataFrame, answer: Answer, retries: int = 2) -> DataFrame:
    """``prompts`` with ``attempts`` from a function of (prompt, number of the attempt); a call that
    raises counts as an answer that does not parse."""

    @F.udf("array<string>")
    def ask(prompt):
        out = []
        for k in range(retries + 1):
            try:
                out.append(answer(prompt, k))
            except Exception:  # noqa: BLE001 - whatever a client raises is a failed attempt
                out.append(None)
        return out

    return prompts.withColumn("attempts", ask("prompt"))


class ScoreBatch:
    """Rows (batch, id, attempts on the first) of one batch to a score for each."""

    def __init__(self):
        self.batch, self.ids, self.attempts = None, [], []

    def eval(self, row):
        self.batch = row["batch"]
        self.ids.append(row["id"])
        self.attempts = row["attempts"] or self.attempts

    def terminate(self):
        got = first_parsed(self.attempts, lambda text: parsed_scores(text, len(self.ids)))
        for i in self.ids:
            if got is None:
                yield self.batch, i, DEFAULT, "error"
            else:
                yield self.batch, i, got.get(i), "scored" if i in got else "missing"


class DetectHits:
    """A source's attempts, part by part, to its highlights, numbered through."""

    def __init__(self):
        self.n = 0

    def eval(self, row):
        for k, h in enumerate(first_parsed(row["attempts"] or [], parsed_hits) or [], self.n):
            self.n = k + 1
            yield (row["source_id"], k, h.get("start_time"), h.get("end_time"), None if "start_s" not in h else float(h["start_s"]), None if "end_s" not in h else float(h["end_s"]),
                   h.get("duration_seconds"), h.get("hook_text"), h.get("punchline"), h.get("why_viral"), h.get("viral_score"))


def score_batches(rows: DataFrame, answered: DataFrame) -> DataFrame:
    """(batch, id, score, status) of rows (batch, id) with ``answered`` (batch, attempts).

    status: ``scored``; ``missing`` where the answer leaves the place out (null score); ``error``
    where no attempt parses: all of the batch get the default score. Attempts go with a batch's
    first row, not with each.
    """
    first = answered.select("batch", "attempts").withColumn("id", F.lit(1))
    each = rows.select("batch", F.col("id").cast("int").alias("id")).join(first, ["batch", "id"], "left")
    call = F.udtf(ScoreBatch, returnType=SCORED)
    return call(each.asTable().partitionBy("batch").orderBy("id"))


def passed(scores: DataFrame) -> DataFrame:
    """Scored rows that reach the passing score; default scores do not pass."""
    return scores.where((F.col("status") == "scored") & (F.col("score") >= PASSES))


def detect(answered: DataFrame) -> DataFrame:
    """Typed hits of (source_id, attempts), or of (source_id, part, attempts) in order of the parts."""
    part = F.col("part") if "part" in answered.columns else F.lit(0)
    call = F.udtf(DetectHits, returnType=HITS)
    return call(answered.select(F.col("source_id").cast("long").alias("source_id"), part.alias("part"), "attempts").asTable().partitionBy("source_id").orderBy("part"))
