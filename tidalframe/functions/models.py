"""Model calls behind interfaces: detectors and scorers are tables or functions of a batch.

The engine never calls a network. Production hands in a table of recorded answers or a
``Scorer``; the heuristic one is for tests and claims no likeness to any model.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUBRIC = "hook int, arc int, emotion int, punchline int, autonomie int, total int, verdict string"
HITS = "highlights array<struct<start_time:string,end_time:string,start_s:double,end_s:double,duration_seconds:int,hook_text:string,punchline:string,why_viral:string,viral_score:int>>"


DETAIL = "score int, hook_score int, arc_score int, emotion_score int, punchline_score int, value_score int, has_conclusion boolean, hook_text string, best_quote string, explanation string, suggested_trim string"
#: Fixed value: the explanation of a passage whose answer does not parse.
AUTO_SCORED = "Auto-scored (API error)"


class Scorer(Protocol):
    def __call__(self, texts: pd.Series) -> pd.Series:
        """A JSON answer for each text."""


def heuristic_scorer(texts: pd.Series) -> pd.Series:
    """Deterministic stand-in: totals from length and marks."""
    total = texts.fillna("").map(lambda t: min(100, len(t) // 20 + 5 * t.count("?") + 5 * t.count("!")))
    return total.map(lambda n: f'{{"total": {n}, "verdict": "heuristic"}}')


def score_texts(rows: DataFrame, scorer: Scorer, text: str = "text", batch: int = 25) -> DataFrame:
    """``rows`` with ``answer``, scored in batches of at most ``batch`` texts."""
    schema = T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType())])

    def run(parts):
        for pdf in parts:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch].copy()
                part["answer"] = scorer(part[text]).to_numpy()
                yield part

    return rows.mapInPandas(run, schema)


def recorded_answers(rows: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with recorded answers; null where none was recorded."""
    return rows.join(answers, keys, "left")


def rubric(answers: DataFrame, column: str = "answer") -> DataFrame:
    """The parsed rubric; text that does not parse gives total 0 and verdict ``parse_error``."""
    from .text import parse_json

    broken = F.from_json(F.lit('{"total":0,"verdict":"parse_error"}'), RUBRIC)
    return answers.withColumn("rubric", parse_json(F.col(column), RUBRIC, broken))


def _parsed(answers: DataFrame, column: str, schema: str) -> DataFrame:
    """``answers`` with ``__parsed``, as ``parse_json`` gives it: a column of its own, so that a row is
    parsed once and not for each field that is taken from it."""
    from .text import strip_fence

    held = answers.withColumn("__whole", strip_fence(F.col(column)))
    value = F.when(F.try_parse_json("__whole").isNotNull(), F.from_json("__whole", schema, {"mode": "PERMISSIVE"}))
    return held.withColumn("__parsed", value).drop("__whole")


def detailed_score(answers: DataFrame, p1: str, p2: str, column: str = "answer") -> DataFrame:
    """``final_score``: the answer's score, or ``(p1 + p2) * 5`` where it does not parse."""
    parsed = F.col("__parsed")
    return _parsed(answers, column, "struct<score:int,explanation:string>").withColumns({
        "final_score": F.coalesce(parsed["score"].cast("double"), (F.col(p1) + F.col(p2)) * 5),
        "explanation": F.coalesce(parsed["explanation"], F.lit("fallback")),
    }).drop("__parsed")


def detailed_answer(answers: DataFrame, p1: str, p2: str, text: str = "text", column: str = "answer") -> DataFrame:
    """``answers`` with ``final_score`` and all fields of the detailed answer.

    An answer without a score counts as one that does not parse: the score is ``(p1 + p2) * 5``, the
    hook the text's first 100 characters, and the part scores are null.
    """
    from .text import prefix

    parsed = F.col("__parsed")
    scored, hook = parsed["score"].isNotNull(), prefix(F.coalesce(F.col(text), F.lit("")), 100, "...")

    def field(name: str, missing, failed):
        return F.when(scored, F.coalesce(parsed[name], missing)).otherwise(failed)

    parts = {n: F.when(scored, parsed[n]) for n in ("hook_score", "arc_score", "emotion_score", "punchline_score", "value_score", "has_conclusion", "suggested_trim")}
    none = F.lit("")
    return _parsed(answers, column, "struct<" + DETAIL.replace(", ", ",").replace(" ", ":") + ">").withColumns({
        "final_score": F.when(scored, parsed["score"].cast("double")).otherwise((F.col(p1) + F.col(p2)) * 5),
        **parts, "hook_text": field("hook_text", hook, hook), "best_quote": field("best_quote", none, none),
        "explanation": field("explanation", none, F.lit(AUTO_SCORED)),
    }).drop("__parsed")
