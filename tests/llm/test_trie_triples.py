"""The n-gram trie of order 3 against plain counts."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from spectrafold.llm import ngram_trie
from spectrafold.llm.shared import new_folder


def test_triples(spark, monkeypatch):
    rng = random.Random(7)
    texts = [None, "", "a", "new", *(" ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randint(1, 60))) for _ in range(60)), "a new b c", "a b c " * 40]
    docs = spark.createDataFrame([(i, t, i % 4 == 3) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean").repartition(3)
    tokens = lambda t: [*(t or "").encode().lower().split(), b" end"]
    one, two, three, context = Counter(), Counter(), Counter(), Counter()
    for i, t in enumerate(texts):
        if i % 4 != 3:
            w = tokens(t)
            one.update(w)
            two.update(zip([b" start", *w], w))
            context.update([b" start", *w[:-1]])
            three.update(zip([b" start", *w], w, w[1:]))
    n, v, mu = sum(one.values()), len(one), ngram_trie.MU

    def pair(a, w):
        return (two[a, w] + mu * (one[w] + 1) / (n + v + 1)) / (context[a] + mu)

    monkeypatch.setattr(ngram_trie, "SHARD_PAIRS", 1 << 9)
    found = {r["doc_id"]: r for r in ngram_trie.score(docs, ngram_trie.train(docs.where("not held_out"), new_folder(spark, "trie"), 3)).collect()}
    told_apart = 0
    for i, t in enumerate(texts):
        w = [b" start", *tokens(t)]
        pairs = [pair(a, b) for a, b in zip(w, w[1:])]
        whole = [pairs[0], *((three[a, b, c] + mu * p) / (two[a, b] + mu) for a, b, c, p in zip(w, w[1:], w[2:], pairs[1:]))]
        assert abs(found[i]["score"] - sum(map(math.log10, whole))) <= 0.02 * len(pairs)
        told_apart += abs(sum(map(math.log10, whole)) - sum(map(math.log10, pairs))) > 0.04 * len(pairs)
    assert told_apart and len(found) == len(texts)
    assert ngram_trie.score(docs, ngram_trie.train(docs.limit(0), new_folder(spark, "trie"), 3)).agg(F.max(F.abs("score"))).first()[0] == 0
