"""Importance resampling against plain code, on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

from spectrafold.llm import resampling

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
TEXTS = [None, "", " .,", "One", "ÉCOLE École 12a", "wörd " * 30, "alpha beta Gamma " * 9, "x" * 5000 + " y", "a\x00b\x1cc\x85d  e " * 6, "same text of twenty words " * 5]


def _features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return [zlib.crc32(f.encode()) % 10000 for f in words + [" ".join(p) for p in zip(words, words[1:])]], len(words)


def _expected(rows, target):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(_features(text)[0])
    for text in target:
        t.update(_features(text)[0])
    top, bottom = s.total() + 10000, t.total() + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * top / ((s[b] + 1) * bottom))) for b in range(10000)]
    out = []
    for doc_id, text in rows:
        own, n = _features(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[: 25 * len(fit) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def _rows(copies):
    return [(len(TEXTS) * k + i, t) for k in range(copies) for i, t in enumerate(TEXTS)] + [(None, TEXTS[5]), (5, TEXTS[5]), (None, None)]


def test_against_plain_code(spark):
    rows, target = _rows(12), ["wörd beta", None, "same text", "gamma ALPHA 12a"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    found = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert found.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert Counter(map(tuple, found.collect())) == _expected(rows, target)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none.select("text")).collect() == []
    rows = _rows(1)
    assert Counter(map(tuple, resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), none.select("text")).collect())) == _expected(rows, [])


def test_blocks_and_files(spark, monkeypatch):
    # Small blocks: sums between offsets are taken block by block.
    monkeypatch.setattr(resampling, "BLOCK_FEATURES", 16)
    out = []

    class Kept:
        def write(self, raw):
            out.append(raw)

        def close(self):
            pass

    kept = resampling.BucketFile(Kept())
    for t in TEXTS:
        kept.add(*resampling.features(t.encode() if t else None))
    kept.close()
    wanted = Counter(b for t in TEXTS for b in _features(t)[0])
    assert {b: n for b, n in enumerate(kept.counts) if n} == wanted
    assert len(b"".join(out)) == 2 * wanted.total() + 24 * len(TEXTS) + 8
