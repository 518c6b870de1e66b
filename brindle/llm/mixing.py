"""Mixing sources to target weights by a low-discrepancy source schedule.

The corpus is laid out as a schedule of N slots of `block` words. Slot i stands at the golden-ratio point (i * g mod N) / N, where g is the
integer next to N / phi that has no factor in common with N, so the N points are all different and evenly spread at every prefix. The point
falls into one source's part of the cumulative block counts; the rank of the slot among the slots of its source says which
block of the source it takes. A source's documents are shuffled by hash and laid end to end, again from the start after each turn; the blocks
are the equal cuts of that stream (the last one is shorter). Ranked slots are joined to blocks, and what a document
gives is the sum of the words that its slots take from it. Every block is met by one slot, so a source gives round(target) words.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes;
no target is above `max_repeat` times its source's size, the excess is shared again by weight.
Slot ranks and stream places are two-level prefix sums over about sqrt(n) pieces of about sqrt(n) rows, so one hot source is never one task's
work. Per-source figures are one row a source: they are ordered in one task, and broadcast only if they are counted to be few.

Nulls: a null text has size 0 and is never taken; a null source is a source of its own; a null id is a value like others. Wholly equal rows
are laid as one document of their joint size, which they share row by row. An empty table gives an empty result. Extra columns are
carried; columns named like the results are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import ROW, WORD_PATTERN, broadcast_if_small, checkpointed, column, kept_columns, mapped, named, packed, unpacked

RESULTS = ("size", "source_size", "target", "taken", "first_slot", "takes")
MOST_SLOTS = 1 << 40
CELLS = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_repeat: int = 3) -> DataFrame:
    """One row a source (_source, source_size, target, _nth): its target and its place among the sources.

    Sources are capped in the order of cap over weight; the sum of what is left is shared by the rest.
    """
    per = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("_nth", F.row_number().over(Window.orderBy(F.col("_source").isNull(), "_source")))
    per = per.withColumn("_w", ((F.col("_nth") - 1) % 3 + 1).cast("double"))
    everything = Window.partitionBy()
    per = per.withColumn("_total", F.sum("source_size").over(everything).cast("double")).withColumn("_weights", F.sum("_w").over(everything))
    per = per.withColumn("_cap", (F.col("source_size") * max_repeat).cast("double"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_nth").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0.0)))
    per = per.withColumn("_open", F.col("_weights") - F.coalesce(F.sum("_w").over(by_ratio), F.lit(0.0)))
    per = per.withColumn("_level", F.col("_left") / F.col("_open"))
    free = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    per = per.withColumn("_share", F.max(free).over(everything))
    per = per.withColumn("target", F.least(F.coalesce(F.col("_share") * F.col("_w"), F.col("_cap")), F.col("_cap")))
    return per.select("_source", "source_size", "target", "_nth")


def golden_step(n: int) -> int:
    """The integer nearest to n / phi without a factor in common with n."""
    near = round(n * (math.sqrt(5) - 1) / 2)
    return next(g for away in range(n + 1) for g in (near - away, near + away) if 0 < g <= n and math.gcd(g, n) == 1)


def _pieces(n: int) -> int:
    """Pieces for a two-level prefix sum over n rows: as many as each has rows."""
    return max(1, math.isqrt(max(0, n - 1)) + 1)


def source_schedule(spark, parts: DataFrame, slots: int) -> DataFrame:
    """The schedule: slot, _source and rank (the slot's number among those of its source, from 0); parts has _source and its blocks [_lo, _hi)."""
    if slots > MOST_SLOTS:
        raise ValueError(f"{slots} slots: choose a larger block")
    step, wide = golden_step(slots) if slots else 0, max(1, -(-slots // CELLS))
    size = -(-slots // _pieces(slots)) or 1
    # i * g mod N without overflow: N has at most 41 bits, i is taken apart at bit 20
    high = f"pmod(pmod(shiftright(id, 20) * {step}L, {max(slots, 1)}L) * 1048576L, {max(slots, 1)}L)"
    point = f"pmod({high} + pmod((id & 1048575L) * {step}L, {max(slots, 1)}L), {max(slots, 1)}L)"
    ring = spark.range(0, slots).select(F.col("id").alias("slot"), F.expr(point).alias("_point"), F.expr(f"id div {size}L").alias("_piece"))
    cells = F.explode(F.sequence(F.expr(f"_lo div {wide}L"), F.expr(f"(_hi - 1) div {wide}L")))
    spread = broadcast_if_small(parts.where("_hi > _lo").select("_source", "_lo", "_hi", cells.alias("_cell")), 2 * CELLS)
    placed = ring.withColumn("_cell", F.expr(f"_point div {wide}L")).join(spread, "_cell")
    placed = placed.where((F.col("_point") >= F.col("_lo")) & (F.col("_point") < F.col("_hi"))).select("slot", "_piece", "_source")
    counts = placed.groupBy("_source", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_source").alias("_s"), F.col("_piece").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_source", "_piece").orderBy("slot")) - 1)
    return ranked.join(counts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_piece") == F.col("_p"))).select("slot", "_source", (F.col("_before") + F.col("_r")).alias("rank"))


def laid_blocks(sized: DataFrame, drawn: DataFrame, rows: int, block: int) -> DataFrame:
    """The blocks of all sources as parts of documents: _k, _c, _turn, rank, _from (the first word of the document) and words.

    sized has _k, _c, _source and _laid, the words of a document and all rows equal to it; drawn has one row a source with source_size and
    _drawn, the words it gives.
    """
    pieces = _pieces(rows)
    placed = sized.select("_k", "_c", "_source", "_laid").withColumn("_piece", F.expr(f"shiftrightunsigned(_k, 33) * {pieces}L div {1 << 31}L"))
    sums = placed.groupBy("_source", "_piece").agg(F.sum("_laid").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_source").alias("_s2"), F.col("_piece").alias("_p2"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_source", "_piece").orderBy("_k", "_c").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_at", F.coalesce(F.sum("_laid").over(inside), F.lit(0)))
    placed = placed.join(sums, F.col("_source").eqNullSafe(F.col("_s2")) & (F.col("_piece") == F.col("_p2")))
    figures = broadcast_if_small(drawn.select(F.col("_source").alias("_s"), "source_size", "_drawn"))
    placed = placed.join(figures, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_start", F.col("_base") + F.col("_at"))
    placed = placed.where("_laid > 0 and _start < _drawn")
    turns = placed.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.expr("int((_drawn - _start - 1) div source_size)"))))
    turns = turns.withColumn("_begin", F.expr("_start + _turn * source_size")).withColumn("_end", F.expr("least(_begin + _laid, _drawn)"))
    cut = turns.withColumn("rank", F.explode(F.sequence(F.expr(f"_begin div {block}L"), F.expr(f"(_end - 1) div {block}L"))))
    first = F.expr(f"greatest(_begin, rank * {block}L)")
    words = F.expr(f"least(_end, (rank + 1) * {block}L)") - first
    return cut.select("_k", "_c", "_source", "_turn", "rank", (first - F.col("_begin")).alias("_from"), words.alias("words"))


def mix(df: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id", carry: list[str] | None = None, block: int | None = None, max_repeat: int = 3) -> DataFrame:
    """df's columns (or those in `carry`) with size, source_size, target, taken, first_slot and takes.

    takes has one entry (slot, words) for each turn that takes from the document: the slot of the first block that does, and how
    many words it and the following ones take from the document's start; taken is their sum. Wholly equal rows are taken in turn and
    share their slots. Block: `block` words, or 1/50,000 of the corpus, at most 1,024.
    """
    carry = kept_columns(df, carry, RESULTS)
    plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    whole = F.xxhash64(*[x for c in plain for x in (named(c), named(c).isNull())], F.lit(43))
    key = F.xxhash64(named(row_id), F.xxhash64(named(text)), F.lit(41))
    heavy = text in carry  # then decide on slim rows and move the texts once to their decisions
    keyed = df.select(packed([] if heavy else carry), named(source).alias("_source"), word_count(named(text)).alias("size"), key.alias("_k"), whole.alias("_c"))
    copies = [F.first(c).alias(c) for c in (ROW, "_source", "size")]
    sized = keyed.groupBy("_k", "_c").agg(*copies, F.count(F.lit(1)).alias("_copies"))
    sized = checkpointed(sized.withColumn("_laid", F.col("size") * F.col("_copies")))
    targets = source_targets(sized.withColumn("size", F.col("_laid")), max_repeat)
    targets = checkpointed(targets.withColumn("_drawn", F.least(F.round("target").cast("long"), F.col("source_size") * max_repeat)))
    total, rows = (targets.agg(F.sum("source_size")).first()[0] or 0), sized.count()
    block = block or max(1, min(1024, total // 50_000))
    parts = targets.withColumn("_blocks", F.expr(f"(_drawn + {block - 1}L) div {block}L"))
    parts = parts.withColumn("_hi", F.sum("_blocks").over(Window.orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)))
    parts = checkpointed(parts.select("_source", (F.col("_hi") - F.col("_blocks")).alias("_lo"), "_hi"))
    slots = parts.agg(F.max("_hi")).first()[0] or 0
    schedule = source_schedule(df.sparkSession, parts, slots).select("slot", F.col("_source").alias("_s"), F.col("rank").alias("_r"))
    blocks = laid_blocks(sized, targets, rows, block)
    met = blocks.join(schedule, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("rank") == F.col("_r")))
    turns = [F.col("_turn") == t for t in range(max_repeat)]
    per_turn = [F.struct(F.min(F.when(x, F.struct("_from", "slot"))).getField("slot").alias("slot"), F.sum(F.when(x, F.col("words"))).alias("words")) for x in turns]
    given = met.groupBy("_k", "_c").agg(F.filter(F.array(*per_turn), lambda t: t["words"].isNotNull()).alias("_given"))
    figures = broadcast_if_small(targets.select(F.col("_source").alias("_s"), "source_size", "target"))
    decided = sized.join(given, ["_k", "_c"], "left").join(figures, F.col("_source").eqNullSafe(F.col("_s")))
    if heavy:
        wide = df.select(packed(carry), key.alias("_k"), whole.alias("_c"))
        rows_of = wide.join(decided.drop(ROW), ["_k", "_c"]).withColumn("_nth", F.row_number().over(Window.partitionBy("_k", "_c").orderBy(F.lit(0))) - 1)
    else:
        rows_of = decided.withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    share = F.transform("_given", lambda t: F.struct(t["slot"].alias("slot"), F.least(F.col("size"), t["words"] - F.col("_nth") * F.col("size")).alias("words")))
    takes = F.coalesce(F.filter(share, lambda t: t["words"] > 0), F.array().cast("array<struct<slot:bigint,words:bigint>>"))
    out = rows_of.withColumn("takes", takes).withColumn("taken", F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + t["words"]))
    return unpacked(out.withColumn("first_slot", F.array_min(F.transform("takes", lambda t: t["slot"]))), carry, *RESULTS)


def take(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: rows of a mix() that carries the text, once for each take, cut after its last taken word; slot instead of the results.

    Each partition is in the order of the schedule. A partition holds documents of all sources by hash, so each is a sample of the mix.
    """
    carry = [c for c in mixed.columns if c not in RESULTS and c.lower() != "slot"]
    taken = mixed.select(packed([c for c in carry if c != text]), named(text).alias("_text"), "size", F.explode("takes").alias("take"))
    taken = taken.select(ROW, "_text", "size", "take.slot", "take.words").sortWithinPartitions("slot")
    word = re.compile(WORD_PATTERN)

    def cut(value: str, n: int) -> str:
        return value[: next(m.end() for i, m in enumerate(word.finditer(value), 1) if i == n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, words = (np.asarray(column(batch, c)) for c in ("size", "words"))
            short = np.flatnonzero(words < size).tolist()
            if short:
                texts = column(batch, "_text").to_pylist()
                for i in short:
                    texts[i] = cut(texts[i], int(words[i]))
                batch = batch.set_column(1, "_text", pa.array(texts, batch.schema.field("_text").type))
            yield batch

    done = taken.transform(mapped(run, taken.schema))
    rest = [c for c in carry if c != text]
    return done.select(*[F.col("_text").alias(c) if c == text else F.col(ROW).getField(c).alias(c) for c in carry], "slot") if rest else done.select(F.col("_text").alias(text), "slot")
