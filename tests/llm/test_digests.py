"""Columns of the queries' digests against plain code, and the parse on its own."""

import zlib
from collections import Counter

import numpy as np

from spectrafold.llm import quality_rules, sharding, substring_dedup

TEXTS = [None, "", " \n", "# a|b <c>\n& $%*", "wörd ünd\nwörd ünd\n\n", "x" * 5000, "a " * 300, "same", "same", "\x1c# \x85"]


def _docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "same", "clash"), (3, TEXTS[3], "clash")], "doc_id long, text string, size string").repartition(3)


def test_characters_of_quality_rules(spark):
    found = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"]) for r in quality_rules.statistics(_docs(spark)).collect())
    wanted = Counter()
    for i, t in [*enumerate(TEXTS), (None, "same"), (3, TEXTS[3])]:
        words = [w.decode() for w in (t or "").encode().split()]
        wanted[i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or "")] += 1
    assert found == wanted


def test_sizes_and_checksums_of_shards(spark):
    found = sharding.shard_documents(_docs(spark), 4).collect()
    wanted = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in [*enumerate(TEXTS), (None, "same"), (3, TEXTS[3])])
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == wanted
    # The largest group is above an even share, so no shard need be larger.
    by_shard = Counter()
    for r in found:
        by_shard[r["shard"]] += r["size"]
    assert max(by_shard.values()) == max(len((t or "").encode()) + 16 for t in TEXTS)


def test_more_groups_than_units(spark, monkeypatch):
    monkeypatch.setattr(sharding, "UNITS", 16)
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id % 1500) AS text")
    found = sharding.shard_documents(docs, 5).collect()
    shards = {}
    assert all(shards.setdefault(r["text_crc32"], r["shard"]) == r["shard"] for r in found) and len(found) == 3000
    assert sorted({r["shard"] for r in found}) == [0, 1, 2, 3, 4]


def test_spans_come_from_factors_and_their_boundaries():
    # Windows 0..9 at source 1, 8..20 at source 2 (two of them begin in the first factor), 60 alone.
    runs = np.array([(0, 10, 1, 0, 100), (10, 11, 2, 0, 7), (60, 1, 1, 0, 300)])
    factors, spans = substring_dedup.greedy(runs, 35)
    assert [(f["start"], f["length"], f["source_id"]) for f in factors] == [(0, 44, 1), (60, 35, 1)]
    assert spans == [{"start": 0, "end": 55}, {"start": 60, "end": 95}]
    apart = np.array([(0, 1, 1, 0, 0), (40, 5, 2, 0, 0)])
    factors, spans = substring_dedup.greedy(apart, 35)
    assert [f["source_id"] for f in factors] == [1, 2] and spans == [{"start": 0, "end": 35}, {"start": 40, "end": 79}]


def test_mixing_against_sql(spark):
    import duckdb

    from spectrafold.llm.queries import ORACLES, QUERIES

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{data}/documents.parquet')")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    found = sorted(tuple(r) for r in QUERIES["op7_mixing"](spark, data).select(*columns).collect())
    wanted = sorted(con.sql(ORACLES["op7_mixing"]).select(*columns).fetchall())
    assert len(found) == len(wanted) and all(a[:3] == b[:3] and a[4] == b[4] and abs(a[3] - b[3]) < 1e-6 * b[3] + 1e-9 for a, b in zip(found, wanted))
