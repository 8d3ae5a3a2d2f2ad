"""Token alignment against a merge of both tokenizers' whole texts, and the tables of tokens against the libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spectrafold.llm import token_alignment as own

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab .,'\n\n\t  éß中ا12-<|>_   \x85\x1c\U0001F600stheDié"


def _expected(rows):
    side_a, side_b = own.sides(*PATHS)
    counted, found = Counter(), []
    for doc_id, text in rows:
        a, b = (side_a.own.encode(" " + text, add_special_tokens=False).ids, side_b.own.encode(text)) if text else ([], [])
        if text and any(b"".join(side.bytes[k] for k in ids) != (" " + text).encode() for side, ids in ((side_a, a), (side_b, b))):
            a, b = [], []
        i = j = end_a = end_b = 0
        groups, group, links = [], ([], []), []
        while i < len(a) or j < len(b):
            next_a, next_b = end_a + len(side_a.bytes[a[i]]), end_b + len(side_b.bytes[b[j]])
            links.append((a[i], b[j]))
            at = min(next_a, next_b)
            if next_a == at:
                group[0].append(a[i])
            if next_b == at:
                group[1].append(b[j])
            if next_a == next_b:
                groups.append("|".join(",".join(map(str, side)) for side in group))
                group = ([], [])
            if next_a == at:
                i, end_a = i + 1, at
            if next_b == at:
                j, end_b = j + 1, at
        counted.update(links)
        found.append((doc_id, len(a), len(b), groups, links))
    best = {}
    for (_, b), n in counted.items():
        best[b] = max(best.get(b, 0), n)
    return Counter((doc_id, n_a, n_b, len(groups), len(links), sum(counted[x] == best[x[1]] for x in links), sum(counted[x] for x in links), ";".join(groups)) for doc_id, n_a, n_b, groups, links in found)


def _texts():
    draw = random.Random(5)
    fixed = [None, "", " ", "\n", "a", " a", "a ", "\na", "a▁b c", "▁", "<s> </s><|endoftext|> <0x0A>", "x" * 3000, "中" * 700, "the cat sat on the mat. " * 200, "The End.\nThe End.\n\nThe  End."]
    return fixed + ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(1, 40))) for _ in range(150)]


@pytest.mark.parametrize("pattern", [own.PATTERN, None])
def test_against_a_merge(spark, pattern):
    rows = list(enumerate(_texts())) + [(None, "the cat"), (2, "the cat"), (2, "the cat"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, row int, stretch string").repartition(3)
    found = own.align(docs, *PATHS, pattern)
    assert found.columns == ["doc_id", *own.SUMS, "groups"]
    assert Counter(map(tuple, found.collect())) == _expected(rows)


def test_frequent_and_rare_stretches(spark, monkeypatch):
    # Whatever part of the stretches is broadcast, the result is the same.
    rows = list(enumerate(_texts()))
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string"), _expected(rows)
    for room in (0, 20 * own.HOT_ROW):
        monkeypatch.setattr(own, "HOT_BYTES", room)
        assert Counter(map(tuple, own.align(docs, *PATHS).collect())) == wanted


def test_documents_that_do_not_fit_count_nowhere(spark, monkeypatch):
    rows = [(1, "the cat"), (2, "the odd cat"), (3, "cat")]
    real = own.Pieces.ids
    # A vocabulary that loses a word.
    monkeypatch.setattr(own, "encoded", lambda stretches, a, b, real=own.encoded: real(stretches, a, b).withColumn("fits", F.col("stretch") != " odd"))
    found = {r["doc_id"]: r for r in own.align(spark.createDataFrame(rows, "doc_id long, text string"), *PATHS).collect()}
    monkeypatch.setattr(own.Pieces, "ids", real)
    wanted = {r[0]: r for r in _expected([(1, "the cat"), (2, None), (3, "cat")])}
    assert {i: tuple(r) for i, r in found.items()} == wanted


def test_empty_table_and_digest(spark):
    assert own.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []
    found = own.op12_token_alignment(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    wanted = Counter((*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in _expected([tuple(r) for r in docs]).elements())
    assert Counter(map(tuple, found.select("doc_id", *own.SUMS, "groups_sha256").collect())) == wanted


def test_disk(spark):
    # The join on ends deals no side again; nothing that the result does not read is left in the shared folder.
    import os

    from spectrafold.llm.shared import joins_as_dealt, shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    docs = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string")
    found = own.align(docs, *PATHS, made=F.length)
    left = {name.split("-")[0] for name in set(os.listdir(folder)) - before}
    assert left == {"aligned"} and found.count() == len(_texts())
    tokens = own.encoded(spark.createDataFrame([(" the cat", 1)], "stretch string, n long"), *PATHS)
    with joins_as_dealt(spark):
        plan = own.links(tokens)._jdf.queryExecution().executedPlan().toString()
    assert "end" not in "".join(line.split("hashpartitioning")[1] for line in plan.splitlines() if "hashpartitioning" in line)
