"""Benchmark items of every length up to a passage, with all substitutions that are allowed and one more."""

from itertools import combinations

from spectrafold.llm import decontamination


def test_items_of_every_length(spark):
    docs, items, wanted = [], [], set()
    for n in range(1, 14):
        item = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for changes in range(n * 20 // 100 + 2):
            for places in combinations(range(n), changes):
                said = ["New" if k in places else w.upper() for k, w in enumerate(item)]
                # Within a text, and as all of it.
                for text in (["a", "b", *said, "c"], said):
                    if 100 * (n - changes) >= 80 * n:
                        wanted.add((len(docs), n, n - changes, text.index(said[0]) if said[0] != "New" else (2 if text[0] == "a" else 0)))
                    docs.append((len(docs), " ".join(text)))
    # Cut off at the document's ends: what lies beyond counts as substituted.
    for n in range(5, 14):
        for text, start in ((items[n - 1][1].split()[1:], -1), (items[n - 1][1].split()[:-1], 0)):
            wanted.add((len(docs), n, n - 1, start))
            docs.append((len(docs), " ".join(text)))
    docs += [(len(docs), ""), (len(docs) + 1, None)]
    benchmark = spark.createDataFrame([*items, (0, ""), (20, None)], "item_id long, text string")
    found = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark)
    assert {(r["doc_id"], r["item_id"], r["agreed"], r["start"]) for r in found.collect()} == wanted
