"""Operator 11: fill-in-middle documents, cut at offsets of the tokenizers library.

*Units.* A ``Split`` pre-tokenizer with the unit pattern and isolated matches, without any
model or training, cuts a text into units; its code-point offsets are all that is used: the
length of the offset array is n, and the two cuts are ranks in it. Stretches that the pattern
does not match are units too. With single code points as units (the default) a text may be cut
anywhere before it is split, so its space-separated chunks are split one by one and the
lengths of a chunk's units are remembered, in a bounded memo; other patterns see whole texts.

*Cuts and forms.* Four 32-bit numbers of SHA-256 over ``seed:doc_id`` choose cuts and form, so a
row's result depends on nothing but the row. ``psm`` is prefix, suffix, middle, each after its
sentinel; ``spm`` is suffix, prefix, middle; ``plain`` is the text itself.

Row by row in one pass, no shuffle. Defined results: null text is empty; empty texts and texts
that hold a sentinel's string stay plain, so that every output can be taken apart again; a null
id is hashed as no digits; rows that repeat an id get the same numbers; an empty table gives an
empty result; columns named like the new ones are replaced.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunked import ChunkEncoder
from .common import read
from .textkernel import blocks

#: One code point, whatever it is.
CODE_POINT = r"[\s\S]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NEW = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "fim_text": T.StringType()}


@functools.lru_cache(maxsize=4)
def _splitter(unit: str):
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(unit), "isolated")


def _lengths(unit: str, texts: list[str]) -> list[bytes]:
    """Code points of each unit of each text, as unsigned 32-bit integers."""
    split = _splitter(unit).pre_tokenize_str
    return [np.array([b - a for _, (a, b) in split(t)], np.uint32).tobytes() for t in texts]


@functools.lru_cache(maxsize=4)
def _units(unit: str):
    """Texts to the lengths of their units."""
    lengths = functools.partial(_lengths, unit)
    return lengths if unit != CODE_POINT else ChunkEncoder(lengths, limit=300_000, joined=False)


def unit_offsets(text: str, unit: str = CODE_POINT) -> np.ndarray:
    """Where the units begin, and where the last one ends, in code points."""
    sizes = np.frombuffer(_units(unit)([text])[0], np.uint32)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def draws(seed: str, doc_id) -> tuple[int, int, int, int]:
    """The four numbers of a row."""
    word = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(word[i : i + 4], "big") for i in (0, 4, 8, 12))


def check_sentinels(marks: tuple[str, str, str]) -> None:
    """No mark may begin with what ends one, else an output could be taken apart in two ways."""
    if not all(marks) or len(set(marks)) < 3:
        raise ValueError("sentinels are three different strings")
    for a in marks:
        for b in marks:
            if a != b and b in a or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} could overlap in an output")


def fill_in_middle(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: str = "1", fim_percent: int = 90, spm_percent: int = 20,
    unit: str = CODE_POINT, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars (null if plain) and fim_text."""
    check_sentinels(sentinels)
    docs = docs.drop(*(c for c in NEW if c in docs.columns))
    text_at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in NEW.items())])
    p, s, m = sentinels

    def one(text: str, sizes: bytes, doc_id) -> tuple:
        at = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64)])
        n = len(at) - 1
        h1, h2, h3, h4 = draws(seed, doc_id)
        if not text or h3 % 100 >= fim_percent or any(x in text for x in sentinels):
            return n, "plain", None, None, text
        lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = int(at[lo]), int(at[hi])
        spm = h4 % 100 < spm_percent
        out = f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}" if spm else f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"
        return n, "spm" if spm else "psm", a, b - a, out

    def run(batches):
        units = _units(unit)
        for batch in batches:
            for block in blocks(batch.column(text_at)):
                texts = [block.text(i).decode() for i in range(block.n_docs)]
                part = batch.slice(block.first, block.n_docs)
                rows = list(map(one, texts, units(texts), part.column(id_at).to_pylist()))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=schema.names)

    return docs.mapInArrow(run, schema)


def restore(fim: DataFrame, fim_col: str = "fim_text", form_col: str = "form", out_col: str = "restored", sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """``fim`` with the texts rebuilt from outputs and forms alone."""
    part = F.split(fim[fim_col], "|".join(f"\\Q{x}\\E" for x in sentinels))
    whole = F.when(fim[form_col] == "psm", F.concat(part[1], part[3], part[2])).when(fim[form_col] == "spm", F.concat(part[2], part[3], part[1]))
    return fim.withColumn(out_col, whole.otherwise(fim[fim_col]))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore(fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text")))
    digests = [F.sha2(F.encode(c, "UTF-8"), 256).alias(f"{name}_sha256") for c, name in (("fim_text", "output"), ("restored", "restored"))]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP11_SQL = r"""
with h as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as x
  from documents),
d as (
  select *, ('0x' || x[1:8])::bigint % (n + 1) as c1, ('0x' || x[9:16])::bigint % (n + 1) as c2,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || x[17:24])::bigint % 100 >= 90 then 'plain'
              when ('0x' || x[25:32])::bigint % 100 < 20 then 'spm' else 'psm' end as form
  from h),
p as (
  select *, least(c1, c2) as a, greatest(c1, c2) as b,
         substring(t, 1, least(c1, c2)) as pre, substring(t, least(c1, c2) + 1, abs(c1 - c2)) as mid, substring(t, greatest(c1, c2) + 1) as suf
  from d)
select doc_id, n::bigint as n, form,
       case when form <> 'plain' then a::bigint end as prefix_chars,
       case when form <> 'plain' then (b - a)::bigint end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
              else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""
