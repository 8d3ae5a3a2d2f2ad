"""The numbered operators against brute force on small tables with the awkward rows: nulls, blanks, ties, repeated rows, long texts."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spectrafold.llm import decontamination, line_dedup, mixing, near_dedup, ngram_trie, quality_rules, sharding, substring_dedup, token_files, warc
from spectrafold.llm.shared import new_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, _row int"


def _words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "the of Ana lo re mi".split() for b in ("", "n", "ts,", "é", "X")]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = say(120), say(50)
    texts = [None, "", "  \n\t ", "one", "two words", base, base, base.upper(), base + " tail", passage, say(40) + " " + passage + " " + say(30), passage + "\n" + passage, "a " * 200, say(3000)]
    texts += [" ".join(w if i % 17 else "other" for i, w in enumerate(base.split())), base.replace("of", "if", 1)]
    line = "A line of more than forty characters, said again"
    texts += [line, line + "!", line.replace("again", "agaim") + "\nx", "# $ % & | < > " * 9, "\x1c\x85  word x " + say(20), "<|endoftext|> and text"]
    texts += [say(rng.randint(1, 60)) for _ in range(25)]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "clash", i) for i, t in enumerate(texts)]
    return out + [out[5], out[3], out[0], (None, base, "en", "s1", 1, "clash", 0), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_dedup(docs, rows, none):
    wanted, starts = Counter(), Counter()
    for r in rows:
        w = _words(r[1])
        starts.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    for r in rows:
        w = _words(r[1])
        free = [True] * len(w)
        for i in range(len(w) - 34):
            if starts[tuple(w[i : i + 35])] > 1:
                free[i : i + 35] = [False] * 35
        wanted[r[0], len(w), len(w) - sum(free), b" ".join(x for x, f in zip(w, free) if f).decode()] += 1
    found = substring_dedup.parse(docs)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found.collect()) == wanted
    for r in found.where("factors is not null").collect():
        assert all(f["length"] >= 35 for f in r["factors"])
    assert substring_dedup.parse(none).count() == 0


def _classes(rows, length, similarity):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append(frozenset(zip(*(w[i:] for i in range(length)))) if len(w) > length else frozenset([tuple(w)] if w else []))
    name = list(range(len(rows)))
    find = lambda i: i if name[i] == i else find(name[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and len(a & sets[j]) >= similarity * len(a | sets[j]):
                name[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    return sets, members


@pytest.mark.parametrize("length", [2, 5])
def test_near_duplicates(docs, rows, none, length):
    sets, members = _classes(rows, length, 0.8)
    wanted = Counter()
    for group in members.values():
        least = min((rows[i][0] for i in group if rows[i][0] is not None), default=None)
        wanted.update((rows[i][0], len(sets[i]), least, rows[i][0] == least) for i in group)
    found = near_dedup.near_duplicates(docs, length)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()) == wanted
    assert near_dedup.near_duplicates(none, length).count() == 0


def test_keep_one(docs, rows):
    _, members = _classes(rows, 5, 0.8)
    blank = sum(1 for r in rows if not _words(r[1]))
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == blank + sum(1 for g in members.values() if _words(rows[g[0]][1]))


def test_odd_sketch_passes_what_is_similar():
    rng, limit = random.Random(1), near_dedup.most_differing_bits(0.8)
    for _ in range(200):
        import numpy as np

        both, a, b = ([rng.getrandbits(63) for _ in range(n)] for n in (400, 50, 50))
        x, y = (near_dedup.signature(np.unique(np.array(both + s, np.uint64)))[1].view(np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= limit


def test_line_dedup(docs, rows, none):
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    spots = [(r[0] is None, r[0] or 0, k, line, n) for n, r in enumerate(rows) for k, line in enumerate((r[1] or "").split("\n")) if _words(line)]
    lines = sorted({s[3] for s in spots})
    name = {x: x for x in lines}
    find = lambda x: x if name[x] == x else find(name[x])
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(a), len(b)) >= line_dedup.MIN_CHARS and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                name[find(a)] = find(b)
    first = {}
    for s in sorted(spots, key=lambda s: s[:3]):
        first.setdefault(find(s[3]), s[:3])
    gone = {s[4]: set() for s in spots}
    for s in spots:
        if s[:3] != first[find(s[3])]:
            gone[s[4]].add(s[2])
    wanted = Counter((r[0], "\n".join(x for k, x in enumerate((r[1] or "").split("\n")) if k not in gone.get(n, ()))) for n, r in enumerate(rows))
    assert Counter((r["doc_id"], r["kept"]) for r in line_dedup.dedup_lines(docs).collect()) == wanted
    assert line_dedup.dedup_lines(none).count() == 0


def test_bit_parallel_distance(spark):
    rng, pairs = random.Random(3), []
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randint(5, 20))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice([[], ["x"], ["a"]])
        a, b = sorted(("".join(a), "".join(b)), key=len, reverse=True)
        if len(b) > 3:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.split("a", "").alias("cells_long"), F.split("b", "").alias("cells_short"))
    assert df.where(line_dedup.within_edits(2) != (F.levenshtein("a", "b") <= 2)).count() == 0


def test_quality_statistics(docs, rows, spark, none):
    found = {(r["doc_id"], r["n_words"], r["n_repeat_words"], r["n_dup_lines"], r["base_failed"]) for r in quality_rules.statistics(docs).collect()}
    wanted = set()
    for r in rows:
        w, grams = _words(r[1]), defaultdict(list)
        for i in range(len(w) - 7):
            grams[tuple(w[i : i + 8])].append(i)
        repeated = len({j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)})
        lines = [x for x in (r[1] or "").split("\n") if _words(x)]
        wanted.add((r[0], len(w), repeated, len(lines) - len(set(lines)), len(w) < 20 or 100 * repeated > 30 * len(w)))
    assert found == wanted
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.filter_documents(docs, labels).columns == docs.columns
    assert quality_rules.judge(none, labels).count() == 0


def test_decision_list_learns_a_planted_rule():
    names = ["a", "b"]
    cells = [(i, j, 40 * bad, 40, 20 * bad, 20) for i in range(3) for j in range(3) for bad in [int(i == 2 and j == 0)]]
    rules = quality_rules.learn({n: [1.0, 2.0] for n in names}, cells)
    assert [str(r) for r in rules] == ["a > 2 and b <= 1 -> reject"] or [str(r) for r in rules] == ["b <= 1 and a > 2 -> reject"]


def test_decontamination(spark, docs, rows, none):
    passage = rows[9][1].split()[5:30]
    changed = [w if i not in (3, 9) else "changed" for i, w in enumerate(passage[:13])]
    benchmark = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(changed)), (3, None), (4, "too short"), (5, " ".join(f"unseen{i}" for i in range(30)))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, benchmark).collect()}

    def leaks(text, item):
        w, x = (text or "").lower().split(), item.lower().split()
        return any(sum(a == b for a, b in zip(w[i : i + 13], x[j : j + 13])) >= 11 for j in range(len(x) - 12) for i in range(len(w) - 12))

    wanted = {(r[0], k) for r in rows for k, item in ((1, " ".join(passage)), (2, " ".join(changed))) if leaks(r[1] and " ".join(x.decode() for x in _words(r[1])), item)}
    assert found == wanted
    clean = decontamination.remove_leaks(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(r[0] not in {d for d, _ in wanted} for r in rows)
    assert decontamination.leaks(none, benchmark).count() == 0


def test_mixing(docs, rows, none):
    found = mixing.mix(docs).collect()
    total = sum(r["size"] for r in found)
    assert sum(r["taken"] for r in found) == total
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    by_source = defaultdict(int)
    for r in found:
        by_source[r["source"]] += r["taken"]
    most = max(r["size"] for r in found)
    assert all(abs(by_source[r["source"]] - r["target"]) <= 2 * most for r in found)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and sum(len(_words(r["text"])) for r in mixed.collect()) == total
    assert mixing.mix(none).count() == 0


def test_sharding(docs, rows, none):
    found = sharding.shard_documents(docs, 5).collect()
    assert len(found) == len(rows) and Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    slots, texts = defaultdict(list), defaultdict(set)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        texts[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in texts.values())
    assert sharding.shard_documents(none, 5).count() == 0


def test_minimax_cut_is_least():
    def brute(sizes, shards):
        best = [0] + [math.inf] * len(sizes)
        for _ in range(shards):
            best = [0] + [min(max(best[i], sum(sizes[i:j])) for i in range(j)) for j in range(1, len(sizes) + 1)]
        return best[-1]

    rng = random.Random(2)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 30) for _ in range(rng.randint(1, 9))), reverse=True)
        cuts = sharding.minimax_cuts(sizes, 3)
        assert cuts == sorted(cuts) and max(cuts) < 3
        assert max(sum(s for s, c in zip(sizes, cuts) if c == k) for k in range(3)) == brute(sizes, 3)


def test_trie_scores(docs, rows, none, spark):
    training = [r for r in rows if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 != 2]
    tokens = lambda t: [*(t or "").encode().lower().split(), b" end"]
    one, two, context = Counter(), Counter(), Counter()
    for r in training:
        t = tokens(r[1])
        one.update(t)
        two.update(zip([b" start", *t], t))
        context.update([b" start", *t[:-1]])
    n, v = sum(one.values()), len(one)
    read = docs.withColumn("held_out", ngram_trie.split_part() == ngram_trie.HELD_OUT)
    found = ngram_trie.score(read, ngram_trie.train(read.where("not held_out"), new_folder(spark, "trie"))).collect()
    base = lambda w: (one[w] + 1) / (n + v + 1)
    wanted = Counter()
    for r in rows:
        t = tokens(r[1])
        wanted[r[0], len(t), sum(one[w] > 0 for w in t), n, round(sum(math.log10(base(w)) for w in t), 6)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == wanted
    exact = defaultdict(list)
    for r in rows:
        t = tokens(r[1])
        exact[r[0]].append(sum(math.log10((two[a, w] + ngram_trie.MU * base(w)) / (context[a] + ngram_trie.MU)) for a, w in zip([b" start", *t], t)))
    assert all(min(abs(r["score"] - e) for e in exact[r["doc_id"]]) <= 0.02 * r["n_tokens"] for r in found)


def test_elias_fano():
    import numpy as np

    rng = np.random.default_rng(4)
    for n, bound in ((0, 1), (1, 1), (5, 7), (1000, 1100), (3000, 1 << 40), (2000, (1 << 64) - 1)):
        values = np.sort(rng.integers(0, bound, n, np.uint64, endpoint=True))
        level = ngram_trie.EliasFano.build(values, bound)
        if n:
            assert (level.get(np.arange(n)) == values).all()
            sought = np.concatenate([values, rng.integers(0, bound, 200, np.uint64, endpoint=True)])
            assert (level.successor(sought) == np.searchsorted(values, sought)).all()


def test_token_files(spark, docs, rows, none):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    manifest = token_files.write_tokens(docs, path, new_folder(spark, "tokens"))
    found = sorted(token_files.read_tokens(manifest).collect(), key=lambda r: r["start"])
    ids = Counter((r[0], zlib.crc32(np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for r in rows)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in found) == ids
    assert [r["start"] for r in found] == list(np.append(0, np.cumsum([r["n_tokens"] for r in found]))[:-1])
    order = [(r["doc_id"] is not None, r["doc_id"]) for r in found]
    assert order == sorted(order, key=lambda x: (x[0], x[1] or 0))
    first = manifest.orderBy("part").first()
    with token_files.open_shared(first["path"], "rb") as source:
        reader = token_files.Reader(source)
        assert all((reader.document(k) == ids).all() for k, (_, ids) in enumerate(reader.all()))
    with token_files.open_shared(first["path"], "rb") as source:
        damaged = bytearray(source.read())
    damaged[20] ^= 1
    import io

    with pytest.raises(Exception):
        list(token_files.Reader(io.BytesIO(bytes(damaged))).all())
    assert token_files.read_tokens(token_files.write_tokens(none, path, new_folder(spark, "tokens"))).count() == 0


def test_warc(spark):
    pages = [(1, "http://www.b.org/x y?q=1", "same"), (7, "http://a.org/", "same"), (3, None, None), (4, "", ""), (5, "http://a.org/", "ü" * 50000), (None, "http://c.org", "same"), (7, "http://a.org/", "same")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    found = warc.archive(table, new_folder(spark, "warc")).collect()
    last = {}
    for p, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if p is None else p)
    wanted = Counter((p, len((h or "").encode()), warc.sha1_base32((h or "").encode()), "response" if last[h or ""] == p else "revisit", None if last[h or ""] == p else last[h or ""]) for p, _, h in pages)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == wanted
    order = [(r["url_key"], r["captured"]) for r in found]
    assert order == sorted(order)
    assert warc.archive(table.limit(0), new_folder(spark, "warc")).count() == 0


def test_loser_tree():
    rng = random.Random(6)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted(((None, rng.choice("abc"), rng.randint(0, 9), "p", i, 0) for i in range(rng.randint(0, 20))), key=warc.order) for _ in range(k)]
        assert [warc.order(r) for r in warc.merge([iter(r) for r in runs])] == sorted(warc.order(x) for r in runs for x in r)


def test_digest_columns(docs):
    kept = substring_dedup.parse(docs).select("doc_id", F.sha2("kept", 256).alias("d")).where("doc_id = 3").first()
    assert kept["d"] == hashlib.sha256(b"one").hexdigest()
