"""Blocks, epochs in them and stimulus sequences against loops over rows."""

import random

import pytest
from pyspark.sql import functions as F

from spectrafold.operators import blocks


@pytest.fixture(scope="module")
def events(spark):
    draw = random.Random(6)
    rows = [(draw.choice(["p", "q"]), draw.randint(0, 300), i, draw.choice("SEXxxxx")) for i in range(400)]
    rows += [(None, 3, 900, "S"), ("p", None, 901, "S"), ("q", 5, 902, None), ("lone", 7, 903, "S")]
    return rows, spark.createDataFrame(rows, "k string, t int, i int, kind string").repartition(3).cache()


def _spans(rows, key, ends=True):
    own = sorted((t, i, kind) for k, t, i, kind in rows if k == key and t is not None)
    out = []
    marks = [r for r in own if r[2] == "S" or ends and r[2] == "E"]
    for a, b in zip(marks, [*marks[1:], None]):
        if a[2] == "S" and (b is not None and b[2] == "E" if ends else True):
            out.append((a[0], b[0] if b else own[-1][0]))
    return out


@pytest.mark.parametrize("ends", [True, False])
def test_spans(events, ends):
    rows, table = events
    found = blocks.spans_between(table, "k", "t", "i", F.col("kind") == "S", F.col("kind") == "E" if ends else None).collect()
    for key in ("p", "q", "lone"):
        assert [(r["lo"], r["hi"]) for r in sorted(found, key=lambda r: r["block"]) if r["k"] == key] == _spans(rows, key, ends)
    picked = blocks.spans_between(table, "k", "t", "i", F.col("kind") == "S", F.col("kind") == "E", [2]).collect()
    assert all(r["block"] == 2 for r in picked) and len(picked) == 2


def test_epochs_in_blocks(events, spark):
    rows, table = events
    found = sorted((r["k"], r["block"], r["epoch"], r["t"], r["offset"], r["i"]) for r in blocks.block_epochs(table, table, "k", "t", "i", F.col("kind") == "S", F.col("kind") == "E", F.col("kind") == "X", (-2, 5)).collect())
    wanted = []
    for key in ("p", "q"):
        own = sorted((t, i, kind) for k, t, i, kind in rows if k == key and t is not None)
        for number, (lo, hi) in enumerate(_spans(rows, key), 1):
            for epoch, (start, _, _) in enumerate([r for r in own if r[2] == "X" and lo <= r[0] <= hi], 1):
                wanted += [(key, number, epoch, t, t - start, i) for t, i, _ in own if start - 2 <= t <= start + 5]
    assert found == sorted(wanted)
    assert blocks.block_epochs(table.limit(0), table, "k", "t", "i", F.col("kind") == "S", None, F.col("kind") == "X", (0, 1)).collect() == []


def test_sequences(spark, events):
    rows, table = events
    for every in (1, 3):
        stimuli = table.where("kind = 'X'").select("k", "t", F.col("i").cast("double").alias("y"))
        found = sorted((r["k"], r["subepoch"], r["y"], r["t"], r["offset"], r["i"]) for r in blocks.sequence_epochs(table.select("k", "t", "i"), stimuli, "k", "t", 4, every, (1, 2)).collect())
        starts = {k: sorted((t, float(i)) for q, t, i, kind in rows if q == k and kind == "X" and t is not None)[::every] for k in ("p", "q")}
        longer = max(b[0] - a[0] for s in starts.values() for a, b in zip(s, s[1:])) if every > 1 else 0
        wanted = [(k, n, y, t, t - start - 1, i) for k, s in starts.items() for n, (start, y) in enumerate(s, 1) for q, t, i, _ in rows if q == k and t is not None and start + 1 <= t < start + longer + 4 + 2]
        assert found == sorted(wanted)


def test_changes(spark):
    xs = [1.0, 3.0, 3.0, 2.0, 2.0, 5.0, None, 4.0]
    table = spark.createDataFrame([("a", t, x) for t, x in enumerate(xs)] + [("b", 0, 7.0)], "k string, t int, x double")
    out = {c: [r["x"] for r in sorted(blocks.sequence_values(table, ["k"], "t", c).where("k = 'a'").collect(), key=lambda r: r["t"])] for c in blocks.CHANGES}
    assert out["rise"] == [0, 1, 0, 0, 0, 1, 0, 0] and out["fall"] == [0, 0, 0, 1, 0, 0, 0, 0] and out["edge"] == [0, 1, 0, 1, 0, 1, 0, 0]
    assert out["step"] == [0, 2, 0, -1, 0, 3, 0, 0] and out["curve"] == [0, -2, -1, 1, 3, 0, 0, 0]
    assert out["peak"] == [0, 1, 0, 0, 0, 0, 0, 0] and out["valley"] == [0, 0, 0, 0, 1, 0, 0, 0] and out["turn"] == [0, 1, 0, 0, 1, 0, 0, 0]
    assert blocks.sequence_values(table, ["k"], "t", "peak").where("k = 'b'").collect()[0]["x"] == 0
