"""Epochs on two levels: blocks of a recording, and epochs within them; stimulus sequences cut into epochs.

Spans are found by windows over the events of a key, in order of time and then of a tie column. Samples meet spans by equality
of key and bin: a span lies in every bin that it touches, a sample in one, and bins are as wide as the mean span. A null
key or time belongs nowhere; events of null type match nothing. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans_between(events: DataFrame, key: str, at: str, tie: str, starts: Column, ends: Column | None = None, pick: list[int] | None = None) -> DataFrame:
    """key, block (from 1, in order), lo, hi: from each start to the next end, both included.

    A start that is followed by another start before any end, or by no end, opens no block. Without ends, a block goes on up to
    the next start, and the last one to the key's last event. pick names the blocks to keep.
    """
    order = Window.partitionBy(key).orderBy(at, tie)
    timed = events.where(F.col(at).isNotNull() & F.col(key).isNotNull())
    begins = F.coalesce(starts, F.lit(False))
    if ends is None:
        marked = timed.withColumn("_hi", F.max(at).over(Window.partitionBy(key))).where(begins)
        found = marked.select(key, F.col(at).alias("lo"), F.coalesce(F.lead(at).over(order), F.col("_hi")).alias("hi"), tie)
    else:
        closes = F.coalesce(ends, F.lit(False))
        # Of starts and ends in order, those starts that an end follows.
        marks = timed.where(begins | closes).withColumns({"_begins": begins, "_next": F.lead(at).over(order), "_ends": F.lead(closes & ~begins).over(order)})
        found = marks.where(F.col("_begins") & F.col("_ends")).select(key, F.col(at).alias("lo"), F.col("_next").alias("hi"), tie)
    out = found.withColumn("block", F.row_number().over(Window.partitionBy(key).orderBy("lo", tie))).select(key, "block", "lo", "hi")
    return out.where(F.col("block").isin(pick)) if pick is not None else out


def within_spans(rows: DataFrame, spans: DataFrame, key: str, at: str, width: float | None = None) -> DataFrame:
    """rows at lo to hi of a span of their key, once for each; adds the spans' other columns. A join by bins, not by ranges."""
    if width is None:
        # One number: the mean length of a span.
        mean = spans.agg(F.avg(F.col("hi") - F.col("lo"))).first()[0]
        width = max(float(mean or 1), 1e-9)
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    joined = rows.withColumn("_bin", F.floor(F.col(at) / width)).join(binned, [key, "_bin"])
    return joined.where((F.col(at) >= F.col("lo")) & (F.col(at) <= F.col("hi"))).drop("_bin")


def block_epochs(events: DataFrame, samples: DataFrame, key: str, at: str, tie: str, block_starts: Column, block_ends: Column | None, epoch_starts: Column, offset: tuple[float, float], pick: list[int] | None = None) -> DataFrame:
    """samples within [start + offset0, start + offset1] of each epoch start that lies in a block; adds block, epoch (from 1 in its block) and offset."""
    blocks = spans_between(events, key, at, tie, block_starts, block_ends, pick)
    starts = within_spans(events.where(epoch_starts).select(key, F.col(at).alias("start"), F.col(tie).alias("_tie")), blocks, key, "start")
    numbered = starts.withColumn("epoch", F.row_number().over(Window.partitionBy(key, "block").orderBy("start", "_tie")))
    spans = numbered.select(key, "block", "epoch", "start", (F.col("start") + offset[0]).alias("lo"), (F.col("start") + offset[1]).alias("hi"))
    found = within_spans(samples, spans, key, at, max(offset[1] - offset[0], 1e-9))
    return found.withColumn("offset", F.col(at) - F.col("start")).drop("lo", "hi", "start")


#: What a stimulus's change makes of the sequence: x is its level, d0 the step to it, d1 the step after it. First and last have none.
CHANGES = {
    "level": lambda x, d0, d1: x,
    "rise": lambda x, d0, d1: F.coalesce((d0 > 0).cast("double"), F.lit(0.0)),
    "fall": lambda x, d0, d1: F.coalesce((d0 < 0).cast("double"), F.lit(0.0)),
    "edge": lambda x, d0, d1: F.coalesce((d0 != 0).cast("double"), F.lit(0.0)),
    "step": lambda x, d0, d1: F.coalesce(d0, F.lit(0.0)),
    "curve": lambda x, d0, d1: F.coalesce(d1 - d0, F.lit(0.0)),
    "peak": lambda x, d0, d1: F.coalesce(((d0 > 0) & (d1 <= 0)).cast("double"), F.lit(0.0)),
    "valley": lambda x, d0, d1: F.coalesce(((d0 <= 0) & (d1 > 0)).cast("double"), F.lit(0.0)),
    "turn": lambda x, d0, d1: F.coalesce((((d0 > 0) & (d1 <= 0)) | ((d0 <= 0) & (d1 > 0))).cast("double"), F.lit(0.0)),
}


def sequence_values(stimuli: DataFrame, keys: list[str], at: str, change: str = "level") -> DataFrame:
    """stimuli (keys, at, x) with x after a change of CHANGES along each sequence."""
    order = Window.partitionBy(*keys).orderBy(at)
    x = F.col("x").cast("double")
    d0, d1 = x - F.lag(x).over(order), F.lead(x).over(order) - x
    return stimuli.withColumn("x", CHANGES[change](x, d0, d1))


def sequence_epochs(samples: DataFrame, stimuli: DataFrame, key: str, at: str, length: float, every: int = 1, offset: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """samples within length of each every-th stimulus of their key: subepoch (from 1), offset (from its start) and y (the stimulus's value).

    stimuli: key, at, y. With more than one stimulus to an epoch, it is longer by the largest step between starts. offset
    moves both ends. Stimuli of one time are told apart by y; those of null time are left out, and the rest are numbered on.
    """
    order = Window.partitionBy(key).orderBy("start", "y")
    known = stimuli.where(F.col(at).isNotNull()).select(key, F.col(at).alias("start"), "y").withColumn("_i", F.row_number().over(order))
    starts = known.where((F.col("_i") - 1) % every == 0).withColumn("subepoch", ((F.col("_i") - 1) / every + 1).cast("int"))
    longer = 0.0
    if every > 1:
        step = starts.withColumn("_d", F.lead("start").over(order) - F.col("start")).agg(F.max("_d")).first()[0]
        longer = float(step or 0)
    lo = F.col("start") + offset[0]
    spans = starts.select(key, "subepoch", "y", "start", lo.alias("lo"), (F.col("start") + longer + length + offset[1]).alias("hi"))
    found = within_spans(samples, spans, key, at, max(longer + length + offset[1] - offset[0], 1e-9))
    return found.where(F.col(at) < F.col("hi")).withColumn("offset", F.col(at) - F.col("lo")).drop("lo", "hi", "start")
