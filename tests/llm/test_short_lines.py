"""Lines of every length from 1 to 40, edited once to three times, against a plain edit distance."""

import random

from spectrafold.llm import line_dedup


def _distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_short_lines(spark):
    rng, lines = random.Random(8), set()
    for n in [*range(1, 41)] * 3:
        line = [rng.choice("abcdeü0123") for _ in range(n)]
        lines.add("".join(line))
        for edits in (1, 1, 2, 2, 3):
            other = list(line)
            for _ in range(edits):
                at = rng.randrange(len(other) + 1)
                other[at : at + rng.randint(0, 1)] = rng.choice([[], ["x"], ["a"]])
            lines.add("".join(other))
    lines = sorted(lines - {""})
    name = {x: x for x in lines}
    find = lambda x: x if name[x] == x else find(name[x])
    for i, a in enumerate(lines):
        for b in lines[:i]:
            allowed = min(2, min(len(a), len(b)) // 6)
            if abs(len(a) - len(b)) <= allowed and _distance(a, b) <= allowed:
                name[find(a)] = find(b)
    first, wanted = set(), {}
    for k, x in enumerate(lines):
        wanted[k] = "" if find(x) in first else x
        first.add(find(x))
    assert any(wanted[k] == "" for k, x in enumerate(lines) if len(x) < 12) and any(wanted[k] == "" for k, x in enumerate(lines) if 12 <= len(x) < 36)
    found = line_dedup.dedup_lines(spark.createDataFrame([*enumerate(lines)], "doc_id long, text string"))
    assert {r["doc_id"]: r["kept"] for r in found.collect()} == wanted
