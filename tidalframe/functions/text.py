"""Scalar text functions: tags, entities, word counts, fences and tolerant JSON."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entities that are decoded without Python; ``&amp;`` last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&amp;": "&"}
FENCE = "```"


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_tags(text: Column) -> Column:
    """Each tag becomes a space, ends are trimmed; inner spacing stays."""
    return strip(F.regexp_replace(text, "<[^>]+>", " "))


def unescape(text: Column) -> Column:
    """Decode the entities of ``ENTITIES``."""
    for name, value in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


@F.pandas_udf(T.StringType())
def unescape_all(text: pd.Series) -> pd.Series:
    """Decode every HTML5 entity, named or numeric, as browsers do."""
    return text.map(html.unescape, na_action="ignore")


def clean_every_entity(word: Column) -> Column:
    """``clean_word`` over all entities; only texts with an ampersand leave the JVM."""
    return clean_word(F.when(word.contains("&"), unescape_all(word)).otherwise(word), decoded=True)


def clean_word(word: Column, decoded: bool = False) -> Column:
    """Decode entities, then drop tags, trim (no-break spaces too), and mask ``[ __ ]`` as ``***``."""
    plain = F.regexp_replace(word if decoded else unescape(word), "<[^>]+>", "")
    plain = F.regexp_replace(plain, r"^[\s ]+|[\s ]+$", "")
    return F.regexp_replace(plain, r"\[?[\s ]*__[\s ]*\]?", "***")


def word_count(text: Column) -> Column:
    """Words by Unicode white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def ends_sentence(text: Column) -> Column:
    """Whether the last character before trailing space is one of ``. ! ? …``."""
    return F.rtrim(text).rlike("[.!?…]$")


def prefix(text: Column, n: int, mark: str = "") -> Column:
    """The first n characters, with ``mark`` only if something was cut."""
    cut = F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(cut, F.lit(mark))).otherwise(cut) if mark else cut


def strip_fence(text: Column) -> Column:
    """Drop a leading code fence (with its language name) and a trailing one."""
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```[a-z]*\s*", ""), r"\s*```$", ""))


def fenced_part(text: Column) -> Column:
    """What the first pair of code fences encloses, without a language name; else the text."""
    inner = F.split_part(text, F.lit(FENCE), F.lit(2))
    return strip(F.when(F.instr(text, FENCE) > 0, F.regexp_replace(inner, r"^json\s*", "")).otherwise(text))


def parse_json(text: Column, schema: str, fallback: Column | None = None) -> Column:
    """The value of a (fenced) JSON text; ``fallback`` where it does not parse."""
    value = F.from_json(strip_fence(text), schema, {"mode": "PERMISSIVE"})
    whole = F.try_parse_json(strip_fence(text)).isNotNull()
    return F.when(whole, value).otherwise(fallback if fallback is not None else F.lit(None).cast(schema))
