"""Near-duplicate detection: banded MinHash, odd sketches, exact confirmation, connected components.

Texts of equal shingle sets are one node. Of each node, HASHES MinHash samples give BANDS keys of
ROWS samples, and an odd sketch: a bitmap in which each (sample number, value) toggles one bit. The
XOR population count of two bitmaps grows with the number of differing samples, so at high
similarity it says closely whether a pair that met in a band is worth the check on the full sets.

Pairs are never made of a whole band group. First each member meets the group's least node, its hub,
only; the links that hold give components. A pair that shares a band shares that band's hub, so what is
left is looked for among the nodes of a hub, each of them once however many bands it shares with it. Only hubs whose
nodes are still of several components go on: the nodes outside the hub's largest component are compared with all
others by bitmap within tasks, in blocks of about BLOCK nodes a side, and those that may be similar by their full
sets there; only links leave a task. Nodes of one component need no further link, so the components are
those of all candidate pairs.

With 46 bands of 6 samples a pair of similarity 0.8 is missed with probability (1 - 0.8**6) ** 46 < 1e-6.
The bitmap passes a pair unless its count is above what five standard deviations allow.

Defined results: a null, empty or blank text has no shingles, no link and its own class; fewer
words than a shingle count as one shingle; equal texts are linked; repeated rows carry equal
results; a null doc_id names a class only if it has no other, and then counts as kept; an empty
table gives an empty result; keep_one() returns all columns, whatever their names, and one row of
each class, the least doc_id with nulls last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import WordHashes, cut, keyed, lower_utf8_words, mix64, slices, window_hashes, with_small

ROWS, BANDS = 6, 46
HASHES = ROWS * BANDS
BITS = 1024
BLOCK = 500
#: Shingles that a batch of results holds at least, unless its input ends.
BATCH = 1_000_000

_NUMBER = np.arange(1, HASHES + 1, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
FACTOR, OFFSET = mix64(_NUMBER * _STEP) | np.uint64(1), mix64(_NUMBER * _STEP + _STEP)


def most_differing_bits(similarity: float) -> int:
    """Bits that may differ at the similarity: the mean and five standard deviations, of samples and bits together."""
    gap = HASHES * (1 - similarity)
    bits = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * gap))
    spread = (2 * (1 - 2 * bits / BITS)) ** 2 * gap * similarity + BITS / 4 * (1 - (1 - 2 * bits / BITS) ** 2)
    return int(bits + 5 * spread**0.5) + 1


def shingle_set(words: list[bytes], length: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of fewer words, one of all."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(hashes.of(words, len(words)), min(length, len(words))) ^ np.uint64(min(length, len(words))))


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BANDS keys and the odd sketch as BITS / 64 integers."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at : at + 256, None] * FACTOR + OFFSET).min(axis=0), out=least)
    mixed = mix64(least ^ FACTOR)
    keys = mix64((mixed * np.tile(FACTOR[:ROWS], BANDS)).reshape(BANDS, ROWS).sum(axis=1) + OFFSET[:BANDS])
    odd = np.bincount((mixed >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return keys.view(np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(rows: DataFrame, length: int) -> DataFrame:
    """doc_id, _id, _key, sid (digest of the set; null if empty), n, bands, sketch."""
    names = ["doc_id", "_id", "_key", "sid", "n", "bands", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, hashes = pa.list_(pa.int64()), WordHashes()
        for batch in slices(batches):
            sids, ns, bands, sketches = [], [], [], []
            for text in batch.column(3).cast(pa.large_binary()):
                shingles = shingle_set(lower_utf8_words(text.as_py()), length, hashes)
                keys, sketch = signature(shingles) if len(shingles) else (None, None)
                sids.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                ns.append(len(shingles))
                bands.append(keys)
                sketches.append(sketch)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sids, pa.binary()), pa.array(ns, pa.int64()), pa.array(bands, longs), pa.array(sketches, longs)], names)

    return rows.select("doc_id", "_id", "_key", "text").mapInArrow(run, "doc_id long, _id long, _key long, sid binary, n long, bands array<long>, sketch array<long>")


def full_sets(rows: DataFrame, length: int) -> DataFrame:
    """node, n, shingles of rows that have node and text."""
    names = ["node", "n", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        done = lambda nodes, sets: pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names)
        for batch in slices(batches):
            nodes, sets, held = [], [], 0
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                nodes.append(node)
                sets.append(shingle_set(lower_utf8_words(text.as_py()), length, hashes).view(np.int64))
                held += len(sets[-1])
                if held > BATCH:
                    yield done(nodes, sets)
                    nodes, sets, held = [], [], 0
            yield done(nodes, sets)

    return rows.select("node", "text").mapInArrow(run, "node long, n long, shingles array<long>")


def _ends(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with the columns of both ends, as x_a and x_b."""
    for end in ("a", "b"):
        pairs = pairs.join(table.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
    return pairs


def _similar_sizes(percent: int) -> Column:
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def sketched(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that size and odd sketch let pass."""
    differ = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return _ends(pairs, nodes, "n", "sketch").where(_similar_sizes(round(100 * similarity))).where(differ <= most_differing_bits(similarity)).select("a", "b")


def sets_of(used: DataFrame, nodes: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """node, n, shingles of the nodes in used, made again from the text of one document each."""
    chosen = cut(nodes.join(used, "node", "left_semi").select("node", "_id", "_key"), "used")
    # Equal rows give a node's set twice.
    return cut(full_sets(with_small(rows, chosen, ["_id", "_key"], 64), length).dropDuplicates(["node"]), "sets")


def confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, length: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar."""
    percent = round(100 * similarity)
    pairs = cut(pairs, "candidates")
    full = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, rows, length)
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return cut(_ends(pairs, full, "n", "shingles").where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b"), "links")


#: Of a node that a block is dealt: hub, its block and that of those it meets, whether it is the one that asks, node,
#: component, set size, and whether it is outside the hub's largest component.
_PLAIN = ["hub", "asked", "asking", "asks", "node", "label", "n", "small"]
_PLACE = _PLAIN[:3]
_LISTS = ["sketch", "bands", "hubs"]


def _rivals(i: int, g: dict[str, np.ndarray], label: np.ndarray, limit: int, percent: int) -> np.ndarray:
    """Rows of a block that its row i, which asks, is to be compared with.

    They are of another component, and size and odd sketch let them pass. They share a band, and no lesser hub, so a
    pair is compared once; of two that both ask, the lesser node does.
    """
    n = g["n"]
    fits = ~g["asks"] & (label != label[i]) & (~g["small"] | (g["node"] > g["node"][i])) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
    at = np.flatnonzero(fits)
    at = at[np.bitwise_count((g["sketch"][at] ^ g["sketch"][i]).view(np.uint64)).sum(axis=1) <= limit]
    at = at[(g["bands"][at] == g["bands"][i]).any(axis=1)]
    lesser = [h for h in g["hubs"][i] if 0 <= h < g["hub"][0]]
    return at[~np.isin(g["hubs"][at], lesser).any(axis=1)] if lesser else at


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each block, of rows sorted by _PLACE."""
    held, now = [], None
    for batch in batches:
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _PLAIN}
        for c in _LISTS:
            columns[c] = batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        change = np.logical_or.reduce([np.diff(columns[c]) != 0 for c in _PLACE])
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for first, last in zip(edges[:-1], edges[1:]):
            here = tuple(int(columns[c][first]) for c in _PLACE)
            if held and here != now:
                yield {c: np.concatenate([x[c] for x in held]) for c in held[0]}
                held = []
            now = here
            held.append({c: x[first:last] for c, x in columns.items()})
    if held:
        yield {c: np.concatenate([x[c] for x in held]) for c in held[0]}


def dealt_blocks(stars: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of hubs with several components, dealt over blocks: _PLAIN and _LISTS. stars: a (hub), b (node)."""
    named = cut(stars.join(labels.withColumnRenamed("node", "b"), "b", "left").select(F.col("a").alias("hub"), F.col("b").alias("node"), F.coalesce("label", "b").alias("label")), "named")
    kinds = named.groupBy("hub", "label").agg(F.count("*").alias("k"))
    largest = F.max_by("label", F.struct("k", "label")).alias("largest")
    open_hubs = kinds.groupBy("hub").agg(largest, F.sum("k").alias("members"), F.max("k").alias("most")).where("members > most")
    hubs_of = named.groupBy("node").agg(F.array_sort(F.collect_set("hub")).alias("hubs"))
    # As long as bands, so that rows make a matrix.
    padded = F.concat("hubs", F.array_repeat(F.lit(-1).cast("long"), BANDS - F.size("hubs"))).alias("hubs")
    known = nodes.select("node", "n", "sketch", "bands").join(hubs_of.select("node", padded), "node")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    placed = with_small(named, open_hubs, ["hub"], 40).withColumns({"small": F.col("label") != F.col("largest"), "wide": blocks("members"), "askers": F.ceil((F.col("members") - F.col("most")) / BLOCK).cast("int")})
    own = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    each = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    asked = F.transform(each("askers"), lambda k: F.struct(own("wide").alias("asked"), k.alias("asking"), F.lit(False).alias("asks")))
    asking = F.transform(each("wide"), lambda k: F.struct(k.alias("asked"), own("askers").alias("asking"), F.lit(True).alias("asks")))
    roles = placed.join(known, "node").withColumn("role", F.explode(F.when(F.col("small"), F.concat(asked, asking)).otherwise(asked)))
    return roles.select("hub", "role.asked", "role.asking", "role.asks", "node", "label", "n", "small", *_LISTS)


def across(stars: DataFrame, labels: DataFrame, nodes: DataFrame, rows: DataFrame, length: int, similarity: float) -> DataFrame:
    """Links that join the components among the nodes of each hub.

    A block's task first names the nodes that are to be compared with another; only these
    bring their full sets, and a task links no two that it has joined before: links are fewer than nodes.
    """
    limit, percent = most_differing_bits(similarity), round(100 * similarity)
    dealt = dealt_blocks(stars, labels, nodes)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[dict]) -> pa.RecordBatch:
            g = {c: np.concatenate([x[c] for x in parts]) for c in parts[0]}
            lists = [pa.ListArray.from_arrays(np.arange(len(g[c]) + 1, dtype=np.int32) * np.int32(g[c].shape[1]), g[c].ravel()) for c in _LISTS]
            return pa.RecordBatch.from_arrays([*(pa.array(g[c]) for c in _PLAIN), *lists], [*_PLAIN, *_LISTS])

        parts, size = [], 0
        for g in _blocks(batches):
            met = np.zeros(len(g["node"]), bool)
            for i in np.flatnonzero(g["asks"]):
                at = _rivals(i, g, g["label"], limit, percent)
                met[at] = True
                met[i] = len(at) > 0
            if met.any():
                parts.append({c: x[met] for c, x in g.items()})
                size += int(met.sum())
            if size > 5000:
                yield done(parts)
                parts, size = [], 0
        if parts:
            yield done(parts)

    kept = cut(dealt.repartition(*_PLACE).sortWithinPartitions(*_PLACE).mapInArrow(meet, dealt.schema), "rivals")
    full = sets_of(kept.select("node"), nodes, rows, length)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        g = {c: pdf[c].to_numpy() for c in _PLAIN} | {c: np.stack(pdf[c].to_numpy()) for c in _LISTS}
        label, sets, node, links = g["label"].copy(), pdf["shingles"].to_numpy(), g["node"], []
        for i in np.flatnonzero(g["asks"]):
            for j in _rivals(i, g, label, limit, percent):
                if label[i] != label[j]:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        label[label == label[j]] = label[i]
                        links.append((node[i], node[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return cut(kept.join(full.select("node", "shingles"), "node").groupBy(*_PLACE).applyInPandas(link, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, length: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, _id, _key, n_shingles, label, component_id, kept of each document."""
    rows = keyed(docs)
    marked = cut(signatures(rows, length), "signatures")
    sets = marked.where(F.col("sid").isNotNull()).groupBy("sid").agg(*(F.first(c).alias(c) for c in ("n", "bands", "sketch")), F.min(F.struct("_id", "_key")).alias("one"))
    # Written before it is used, so the numbers stay.
    nodes = cut(sets.select("sid", "n", "bands", "sketch", "one._id", "one._key", F.monotonically_increasing_id().alias("node")), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    hubs = cut(banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").cast("int").alias("members")).where("members > 1"), "hubs")
    # A group of two is its first and last node; only larger ones need their members.
    two = hubs.where("members = 2").select(F.col("hub").alias("a"), F.col("last").alias("b"))
    more = with_small(banded, hubs.where("members > 2").select("key", "hub"), ["key"], 32).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    stars = cut(two.unionByName(more).distinct(), "stars")
    first = confirmed(sketched(stars, nodes, similarity), nodes, rows, length, similarity)
    second = across(stars, connected(first), nodes, rows, length, similarity)
    labels = connected(first.unionByName(second))
    labelled = nodes.select("sid", "node").join(labels, "node", "left").select("sid", F.coalesce("label", "node").alias("label"))
    joined = cut(marked.select("doc_id", "_id", "_key", F.col("n").alias("n_shingles"), "sid").join(labelled, "sid", "left").drop("sid"), "classes")
    least = joined.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("least"))
    named_by = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return joined.join(least, "label", "left").select("doc_id", "_id", "_key", "n_shingles", "label", named_by.alias("component_id"), F.col("doc_id").eqNullSafe(named_by).alias("kept"))


def keep_one(docs: DataFrame, length: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, all columns, with one row of each class."""
    classes = near_duplicates(docs, length, similarity)
    # A document of no shingles is a class of its own; equal rows of that kind are kept apart.
    winner = F.min(F.struct(F.isnull("doc_id").alias("none"), "_id", "_key")).alias("w")
    chosen = classes.where(F.col("label").isNotNull()).groupBy("label").agg(winner).select("w._id", "w._key", F.lit(True).alias("_chosen"))
    blank = classes.where(F.col("label").isNull()).select("_id", "_key", F.lit(False).alias("_chosen")).distinct()
    met = keyed(docs).select("_row", "_id", "_key").join(chosen.unionByName(blank), ["_id", "_key"])
    once = met.where("_chosen").groupBy("_id", "_key").agg(F.first("_row").alias("_row")).select("_row.*")
    return once.unionByName(met.where("not _chosen").select("_row.*"))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=2).select("doc_id", "n_shingles", "component_id", "kept")
