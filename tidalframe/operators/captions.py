"""Word groups for display, and which group and word a frame shows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buckets import ROWS, numbered
from .intervals import first_at_frame

WORD = "word_idx", "word", "start_s", "end_s"


def fixed_groups(words: DataFrame, size: int = 4) -> DataFrame:
    """(source_id, seg_idx, start_s, end_s, words): runs of ``size`` words, the last may be shorter."""
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("word_idx")) - 1
    rows = words.withColumn("seg_idx", F.floor(place / size).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct(*WORD)))
    return rows.groupBy("source_id", "seg_idx").agg(F.min_by("start_s", "word_idx").alias("start_s"), F.max_by("end_s", "word_idx").alias("end_s"), listed.alias("words"))


def glyph_width(word: Column, widths: dict[str, float], default: float) -> Column:
    """Width of a word in capitals: its glyphs' widths, ``default`` for glyphs not named."""
    letters = F.split(F.upper(word), "")
    if not widths:
        return F.size(letters) * F.lit(default)
    known = F.create_map(*[F.lit(x) for pair in widths.items() for x in (pair[0], float(pair[1]))])
    return F.aggregate(letters, F.lit(0.0), lambda s, c: s + F.coalesce(F.try_element_at(known, c), F.lit(default)))


def line_jumps(held: Column, own: Column, per_line: int, room: float, joined) -> Column:
    """For each of the first ``own`` words of an array (with ``w``), how many words a line takes that
    begins there: ``joined(used, w)`` is a line's width with one more word."""

    def jump(i: Column) -> Column:
        used, fits, out = F.element_at(held, i)["w"], F.lit(True), F.lit(1)
        for k in range(1, per_line):
            there = i + k <= F.size(held)
            used = joined(used, F.when(there, F.element_at(held, F.when(there, i + k).otherwise(1))["w"]))
            fits = fits & there & (used <= room)
            out = out + F.when(F.coalesce(fits, F.lit(False)), 1).otherwise(0)
        return out

    return F.transform(F.sequence(F.lit(1), own), jump)


def _pass(jumps: Column, wait: Column) -> Column:
    """(wait, lines) after a run of words: ``wait`` words belong to the line before, and the next begins one."""
    begin = F.struct(wait.cast("int").alias("wait"), F.lit(0).cast("long").alias("lines"))

    def step(acc: Column, jump: Column) -> Column:
        opens = acc["wait"] == 0
        return F.struct(F.when(opens, jump - 1).otherwise(acc["wait"] - 1).cast("int").alias("wait"), (acc["lines"] + opens.cast("long")).alias("lines"))

    return F.aggregate(jumps, begin, step)


def _numbers(jumps: Column, wait: Column, before: Column) -> Column:
    """The line of each word of a run, ``before`` lines having begun earlier."""
    begin = F.struct(wait.cast("int").alias("wait"), before.cast("long").alias("lines"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, jump: Column) -> Column:
        opens = acc["wait"] == 0
        lines = acc["lines"] + opens.cast("long")
        return F.struct(F.when(opens, jump - 1).otherwise(acc["wait"] - 1).cast("int").alias("wait"), lines.alias("lines"), F.concat(acc["out"], F.array(lines - 1)).alias("out"))

    return F.aggregate(jumps, begin, step)["out"]


def _enter(maps: DataFrame, per_line: int) -> DataFrame:
    """(source_id, block, wait, before): where the lines stand at the start of each block, from the
    blocks' maps, streamed by source: a row a block."""

    def run(batches):
        source, wait, before = None, 0, 0
        for batch in batches:
            out = []
            for s, block, waits, lines in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if s != source:
                    source, wait, before = s, 0, 0
                out.append((s, block, wait, before))
                wait, before = waits[wait], before + lines[wait]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((batch.column(0).type, pa.int64(), pa.int32(), pa.int64()))], names=["source_id", "block", "wait", "before"])

    kind = maps.schema["source_id"].dataType.simpleString()
    return maps.repartition("source_id").sortWithinPartitions("source_id", "block").mapInArrow(run, f"source_id {kind}, block long, wait int, before long")


def packed_groups(words: DataFrame, widths: dict[str, float], room: float, per_line: int = 3, lines: int = 2, space: float = 10.0, default: float = 20.0, block: int = 256) -> DataFrame:
    """Greedy packing: lines of at most ``per_line`` words within ``room`` pixels, groups of
    ``lines``; a word wider than the room still opens a line. (source_id, word_idx, group_idx,
    line_idx); ``widths`` gives glyph widths, ``default`` the others'. Blank words are not shown.

    Where a line ends is a function of its first word, so a block of words maps each of the
    ``per_line`` ways in which a line may reach into it to the way in which it leaves it. Blocks are
    mapped side by side, their maps are followed by source, and each block is then numbered.
    """
    shown = words.where(F.col("word").rlike(r"(?U)\S")).select("source_id", "word_idx", glyph_width(F.col("word"), widths, default).alias("w"))
    placed = numbered(shown, ("word_idx",), ROWS, "place")
    own, at = F.floor(F.col("place") / block), F.col("place") % block
    seen_by = F.filter(F.array(own, F.when(at < per_line - 1, own - 1)), lambda b: b >= 0)  # a line may end in the next block
    dealt = placed.withColumns({"own": own, "block": F.explode(seen_by)})
    held = dealt.groupBy("source_id", "block").agg(F.array_sort(F.collect_list(F.struct("place", "word_idx", "w"))).alias("held"), F.count_if(F.col("own") == F.col("block")).cast("int").alias("own"))
    jumps = line_jumps(F.col("held"), F.col("own"), per_line, room, lambda used, w: used + (w + space))
    blocks = held.select("source_id", "block", F.transform(F.slice("held", 1, F.col("own")), lambda x: x["word_idx"]).alias("word_idx"), jumps.alias("jumps"))
    ways = F.array(*[_pass(F.col("jumps"), F.lit(k)) for k in range(per_line)])
    maps = blocks.select("source_id", "block", ways.alias("m")).select("source_id", "block", F.col("m.wait").alias("waits"), F.col("m.lines").alias("lines"))
    numbered_lines = blocks.join(_enter(maps, per_line), ["source_id", "block"]).select("source_id", F.explode(F.arrays_zip("word_idx", _numbers(F.col("jumps"), F.col("wait"), F.col("before")).alias("line"))).alias("x"))
    line = F.col("x.line")
    return numbered_lines.select("source_id", F.col("x.word_idx").alias("word_idx"), F.floor(line / lines).alias("group_idx"), (line % lines).alias("line_idx"))


def wrapped_lines(words: DataFrame, widths: dict[str, float], room: float, per_line: int = 3, space: float = 10.0, default: float = 20.0) -> DataFrame:
    """Lines of each display group at render: (source_id, group_idx, word_idx, line_idx). A line
    breaks before a word that makes it wider than the room or longer than ``per_line``."""
    rows = words.select("source_id", "group_idx", "word_idx", glyph_width(F.col("word"), widths, default).alias("w"))
    held = rows.groupBy("source_id", "group_idx").agg(F.array_sort(F.collect_list(F.struct("word_idx", "w"))).alias("held"))
    jumps = line_jumps(F.col("held"), F.size("held"), per_line, room, lambda used, w: used + space + w)
    placed = held.select("source_id", "group_idx", F.col("held.word_idx").alias("word_idx"), jumps.alias("jumps"))
    lines = F.arrays_zip("word_idx", _numbers(F.col("jumps"), F.lit(0), F.lit(0)).alias("line"))
    return placed.select("source_id", "group_idx", F.explode(lines).alias("x")).select("source_id", "group_idx", F.col("x.word_idx").alias("word_idx"), F.col("x.line").alias("line_idx"))


def active_word(words: Column, t: Column, linger: float = 0.15) -> Column:
    """Index of the first word with start <= t <= end + linger; else the last begun; else -1."""
    place = F.transform(words, lambda w, i: F.struct(i.alias("i"), w["start_s"].alias("s"), w["end_s"].alias("e")))
    spoken = F.array_min(F.transform(F.filter(place, lambda p: (p["s"] <= t) & (t <= p["e"] + linger)), lambda p: p["i"]))
    begun = F.array_max(F.transform(F.filter(place, lambda p: p["s"] <= t), lambda p: p["i"]))
    return F.coalesce(spoken, begun, F.lit(-1))


def lit_words(words: Column, t: Column) -> Column:
    """Indices of all words with start <= t < end."""
    hit = F.transform(words, lambda w, i: F.when((w["start_s"] <= t) & (t < w["end_s"]), i))
    return F.filter(hit, lambda i: i.isNotNull())


def frame_words(grid: DataFrame, groups: DataFrame, fps: float, slack: float = 0.3) -> DataFrame:
    """(source_id, frame_idx, seg_idx, word): what each frame of the grid shows; null outside."""
    shown = first_at_frame(grid, groups.select("source_id", "seg_idx", "start_s", "end_s", F.col("seg_idx").alias("shown")), "shown", fps, slack)
    # Estimates do not see that words were spelled out before they were grouped: no broadcast on their word.
    held = shown.join(groups.select("source_id", F.col("seg_idx").alias("shown"), "words").hint("merge"), ["source_id", "shown"], "left")
    word = F.when(F.col("shown").isNotNull(), active_word(F.col("words"), F.col("frame_idx") / fps))
    return held.select("source_id", "frame_idx", F.col("shown").alias("seg_idx"), word.alias("word"))


def distinct_renders(frames: DataFrame) -> DataFrame:
    """The (group, word) pictures that a render has to draw once."""
    return frames.where("seg_idx is not null").select("source_id", "seg_idx", "word").distinct()


def line_layout(words: DataFrame, width: float, height: float, space: float, line_height: float) -> DataFrame:
    """Placed words (source_id, group_idx, line_idx, word_idx, w): centred x by line, y at 70 % of
    the height less half of the block."""
    line = Window.partitionBy("source_id", "group_idx", "line_idx")
    before = F.coalesce(F.sum(F.col("w") + space).over(line.orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("w").over(line) + space * (F.count(F.lit(1)).over(line) - 1)
    lines = F.max("line_idx").over(Window.partitionBy("source_id", "group_idx")) + 1
    return words.withColumns({"x": (width - total) / 2 + before, "y": 0.7 * height - lines * line_height / 2 + F.col("line_idx") * line_height})


def shifted(words: DataFrame, duration: float) -> DataFrame:
    """Words inside a clip: those that begin before its end and end after 0, clamped to it."""
    inside = words.where((F.col("start_s") < duration) & (F.col("end_s") > 0))
    return inside.withColumns({"start_s": F.greatest("start_s", F.lit(0.0)), "end_s": F.least("end_s", F.lit(duration))})
