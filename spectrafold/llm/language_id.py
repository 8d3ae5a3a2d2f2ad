"""Language identification by a bidirectional gated recurrent network over bytes, trained by backpropagation through time.

A text's UTF-8 bytes are cut into segments of SEGMENT bytes, the last one shorter; both directions run over each segment
from a zero state. The states of both directions at a byte give the probabilities of the languages there, and a text's
are the means over all its bytes. The most probable language is the prediction and its probability the score.

The model is fitted on a bounded sample: of each language PER_LANGUAGE labelled documents at most, the first ones by hash,
and of each PARTS stretches, anywhere in the text. So what reaches the driver is bounded for each language. Training on
them is plain numpy: cross-entropy at every byte, steps by Adam, weights and order drawn from a fixed seed. The model, some
kilobytes, goes to the tasks with their closure.

Defined results: a null text, or one without a letter, is `und` with score 0, and so is every text where there is no
labelled document to learn from; with one language only every text has it, with score 1; a null doc_id counts as the
empty text in the checksum that holds rows out; languages that are equally probable: the first by code point; repeated rows
have equal results beside each other; a null lang teaches nothing; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIDDEN = 12
SEGMENT = 128
#: Labelled documents of a language that train the model, at most; the row limit of Spark's group-limited windows is 1000.
PER_LANGUAGE = 600
#: Stretches of SEGMENT characters that each of them gives, at most.
PARTS = 3
STEPS, BATCH, RATE, SEED = 300, 128, 0.02, 7
#: Segments that run side by side.
ABREAST = 512
UNKNOWN = "und"
#: Documents whose remainder it is, of a checksum of their id, are held out.
FOLDS, HELD_OUT = 4, 2


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT


class Network:
    """table: what a byte adds to the gates, by direction; recurrent, out, offset: the other weights. Gates: reset, update, new.

    Arrays have rows that run side by side as their last axis. Gates are clipped lines, clip(x / 4 + 1/2, 0, 1), and the new
    state is x / (1 + |x|).
    """

    def __init__(self, labels: list[str], seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.labels = labels
        self.table = draw.normal(0, 0.3, (2, 3 * HIDDEN, 256)).astype(np.float32)
        self.recurrent = draw.normal(0, HIDDEN**-0.5, (2, 3 * HIDDEN, HIDDEN)).astype(np.float32)
        self.out = draw.normal(0, HIDDEN**-0.5, (2, len(labels), HIDDEN)).astype(np.float32)
        self.offset = np.zeros((len(labels), 1), np.float32)

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.table, self.recurrent, self.out, self.offset]

    def run(self, both: np.ndarray, kept: list[tuple] | None = None) -> np.ndarray:
        """States [time, direction, unit, row] of bytes [direction, time, row]; kept gets what each step made."""
        _, steps, rows = both.shape
        found, gates_end = np.empty((steps, 2, HIDDEN, rows), np.float32), 2 * HIDDEN
        h, x, g, size = (np.zeros((2, n * HIDDEN, rows), np.float32) for n in (1, 3, 3, 1))
        # The gates' slope is in the weights, their middle in the table.
        slope = np.where(np.arange(3 * HIDDEN) < gates_end, 0.25, 1).astype(np.float32)[:, None]
        table, recurrent = self.table * slope, self.recurrent * slope
        table[:, :gates_end] += 0.5
        gates, new, own = x[:, :gates_end], x[:, gates_end:], g[:, gates_end:]
        for t in range(steps):
            for d in range(2):
                table[d].take(both[d, t], 1, out=x[d], mode="clip")
                np.matmul(recurrent[d], h[d], out=g[d])
            gates += g[:, :gates_end]
            np.maximum(gates, 0, out=gates)
            np.minimum(gates, 1, out=gates)
            if kept is not None:
                kept.append((h.copy(), gates.copy(), own.copy()))
            own *= gates[:, :HIDDEN]
            new += own
            np.abs(new, out=size)
            size += 1
            new /= size
            if kept is not None:
                kept[-1] += (new.copy(),)
            h -= new
            h *= gates[:, HIDDEN:]
            h += new
            found[t] = h
        return found

    def probabilities(self, forth: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Of each language at each byte, [time, language, row], from the states of both directions there."""
        logits = self.out[0] @ forth
        logits += self.out[1] @ back
        logits += self.offset
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def step(self, segments: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy over all bytes of segments [row, time] of one length."""
        rows, steps = segments.shape
        both, kept = np.stack([segments.T, segments.T[::-1]]), []
        found = self.run(both, kept)
        forth, back = found[:, 0], found[::-1, 1]
        wrong = self.probabilities(forth, back)
        wrong[:, label, np.arange(rows)] -= 1
        wrong /= rows * steps
        out = np.stack([np.tensordot(wrong, side, ((0, 2), (0, 2))) for side in (forth, back)])
        from_out = np.stack([self.out[0].T @ wrong, (self.out[1].T @ wrong)[::-1]], 1)
        recurrent, dh, dx = np.zeros_like(self.recurrent), np.zeros((2, HIDDEN, rows), np.float32), np.empty((steps, 2, 3 * HIDDEN, rows), np.float32)
        back_through = self.recurrent.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            h, gates, own, n = kept[t]
            r, z, inside = gates[:, :HIDDEN], gates[:, HIDDEN:], 0.25 * ((gates > 0) & (gates < 1))
            dh = dh + from_out[t]
            # The slope of x / (1 + |x|) is (1 - |n|) squared.
            dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
            dx[t] = np.concatenate([dn * own * inside[:, :HIDDEN], dh * (h - n) * inside[:, HIDDEN:], dn], 1)
            dg = np.concatenate([dx[t, :, : 2 * HIDDEN], dn * r], 1)
            recurrent += dg @ h.transpose(0, 2, 1)
            dh = dh * z + back_through @ dg
        table = np.zeros_like(self.table)
        for d in range(2):
            # Sums by byte: sorted by it, then added up between its changes.
            order = np.argsort(both[d], None, kind="stable")
            of = both[d].reshape(-1)[order]
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            table[d][:, of[starts]] = np.add.reduceat(dx[:, d].transpose(1, 0, 2).reshape(3 * HIDDEN, -1)[:, order], starts, 1)
        return [table, recurrent, out, wrong.sum((0, 2))[:, None]]

    def fit(self, segments: np.ndarray, label: np.ndarray) -> Network:
        draw = np.random.default_rng(SEED)
        means, squares = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        for k in range(STEPS):
            some = draw.integers(0, len(label), min(BATCH, len(label)))
            rate = RATE * min(1, 2 * (1 - k / STEPS))
            for w, m, s, g in zip(self.weights, means, squares, self.step(segments[some], label[some])):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= rate * (m / (1 - 0.9 ** (k + 1))) / (np.sqrt(s / (1 - 0.99 ** (k + 1))) + 1e-8)
        return self

    def sums(self, segments: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities [row, language] added up over the bytes of each segment; segments are filled up at the end."""
        forth, steps = np.ascontiguousarray(segments.T), segments.shape[1]
        if (lengths == steps).all():
            found = self.run(np.stack([forth, forth[::-1]]))
            return self.probabilities(found[:, 0], found[::-1, 1]).sum(0).T
        time = np.arange(steps)[:, None]
        inside = time < lengths
        turned = np.where(inside, lengths - 1 - time, time)
        found = self.run(np.stack([forth, np.take_along_axis(forth, turned, 0)]))
        each = self.probabilities(found[:, 0], np.take_along_axis(found[:, 1], turned[:, None], 0))
        return np.einsum("tlr,tr->rl", each, inside.astype(np.float32))

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities [text, language]; texts are not empty."""
        size = np.array([len(t) for t in texts])
        parts = -(-size // SEGMENT)
        room = np.zeros((parts.sum(), SEGMENT), np.uint8)
        first = np.cumsum(parts) - parts
        flat = room.reshape(-1)
        for at, t in zip(first, texts):
            flat[at * SEGMENT : at * SEGMENT + len(t)] = np.frombuffer(t, np.uint8)
        lengths = np.full(len(room), SEGMENT)
        lengths[first + parts - 1] = size - (parts - 1) * SEGMENT
        # Longest first, so that those side by side have about the same length.
        order, found = np.argsort(-lengths, kind="stable"), np.empty((len(room), len(self.labels)), np.float32)
        for k in range(0, len(order), ABREAST):
            some = order[k : k + ABREAST]
            found[some] = self.sums(room[some, : lengths[some[0]]], lengths[some])
        return np.add.reduceat(found.astype(float), first, 0) / size[:, None]


def sample(docs: DataFrame) -> DataFrame:
    """lang and part: stretches of labelled documents that aren't held out, bounded for each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    mark = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    at = lambda k: F.lit(1) + F.pmod(F.xxhash64(mark, k), F.greatest(F.lit(1), F.length("text") - SEGMENT)).cast("int")
    parts = F.transform(F.sequence(F.lit(1), F.lit(PARTS)), lambda k: F.col("text").substr(at(k), F.lit(SEGMENT)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("mark", "parts"))
    few = known.select("lang", mark.alias("mark"), parts.alias("parts")).withColumn("nth", nth).where(F.col("nth") <= PER_LANGUAGE)
    return few.select("lang", "mark", F.posexplode("parts").alias("k", "part"))


def train(docs: DataFrame) -> Network | None:
    rows = sorted((r["lang"], r["mark"], r["k"], r["part"].encode()) for r in sample(docs).collect())
    labels = sorted({r[0] for r in rows})
    if not rows:
        return None
    # Stretches shorter than a segment are repeated up to its length.
    segments = np.array([np.resize(np.frombuffer(r[3], np.uint8), SEGMENT) for r in rows])
    number = {name: k for k, name in enumerate(labels)}
    own = np.array([number[r[0]] for r in rows])
    # As many of each language.
    most = np.bincount(own).max()
    even = np.concatenate([np.resize(np.flatnonzero(own == k), most) for k in range(len(labels))])
    return Network(labels).fit(segments[even], own[even]) if len(labels) > 1 else Network(labels)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model, names = train(rows), ["doc_id", "held_out", "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                # Rows of about 4 MB together.
                ends = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in whole.column(2)[at : at + 2000]])
                batch = whole.slice(at, max(1, int(np.searchsorted(ends, 4 << 20))))
                at += batch.num_rows
                texts = batch.column(2).to_pylist()
                some = [k for k, t in enumerate(texts) if t] if model else []
                names_of, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if some:
                    found = model.predict([texts[k] for k in some])
                    for k, own in zip(some, found):
                        names_of[k], score[k] = model.labels[int(own.argmax())], min(1.0, float(own.max()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names_of, pa.string()), pa.array(score)], names)

    read = rows.select("doc_id", held_out().alias("held_out"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text").cast("binary")).alias("text"))
    return read.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
