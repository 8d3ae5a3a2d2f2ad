"""The pipeline's stages in turn on a small table, each held against plain code on what it was given."""

from collections import defaultdict

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def _words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def _near(kept, given):
    sets = {}
    for r in given:
        w = _words(r["text"])
        sets[r["doc_id"]] = frozenset(zip(*(w[i:] for i in range(5)))) if len(w) > 5 else frozenset([tuple(w)] if w else [])
    name = {i: i for i in sets}
    find = lambda i: i if name[i] == i else find(name[i])
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and len(x & y) >= 0.8 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                name[hi] = lo
    assert {r["doc_id"] for r in kept} == {find(i) for i in sets}


def _leaks(text, items):
    w = _words(text)
    held = set(w)
    for item in items:
        n = min(13, len(item))
        if 100 * sum(x in held for x in item) < 80 * n:
            continue
        for j in range(len(item) - n + 1):
            for i in range(len(w) - n + 1):
                if 100 * sum(a == b for a, b in zip(w[i : i + n], item[j : j + n])) >= 80 * n:
                    return True
    return False


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, items = docs.columns, [w for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if (w := _words(r["text"]))]
    for name, stage in corpus_pipeline.STAGES:
        given = docs.collect()
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
        if name == "quality_rules":
            assert {r["doc_id"] for r in kept} <= {r["doc_id"] for r in given if len(_words(r["text"])) >= 20} and len(kept) > 0.5 * len(given)
        elif name == "near_dedup":
            _near(kept, given)
        elif name == "decontamination":
            assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in given if not _leaks(r["text"], items)}
        elif name == "mixing":
            assert sum(len(_words(r["text"])) for r in kept) == sum(len(_words(r["text"])) for r in given)
            assert {r["doc_id"] for r in kept} <= {r["doc_id"] for r in given}
        else:
            slots = defaultdict(list)
            for r in kept:
                slots[r["shard"]].append(r["slot"])
            assert len(kept) == len(given) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(slots) < 40
