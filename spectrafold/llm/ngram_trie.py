"""Language-model scoring with an n-gram trie in Elias-Fano levels.

Training counts triples (word before, word, next word) over all training documents, with a start before and an end after
each; pairs follow from them. The trie has three levels, split over files of bounded size:

- words: the 64-bit hashes of all words, by their upper bits over SHARD_WORDS each about, as a monotone sequence; a
  word's rank is its place in it, and its exact count lies at that place;
- pairs: by hash of the pair over SHARD_PAIRS tokens each about: the monotone sequence of context ranks, the monotone pointers to
  where each context's next words begin, and those words' ranks, relative to their context by adding the
  number of the context times the vocabulary, again one monotone sequence, with a probability quantised to STEP for each, in 8 bits, or 16 in files that need them.
- triples, in their pair's file: monotone pointers from each pair to where its next words begin, those words' ranks relative
  to the pair in the same way, their quantised probabilities, and for each pair the quantised logarithm of its count.

Triples are counted within tasks and leave them packed, one row a task's chunk and file, so the shuffle moves columns of numbers.

Monotone sequences are Elias-Fano coded: low bits packed, high bits in unary with counts by block. A lookup is a
successor search: of the rank within its context's range. Files are memory-mapped from the shared folder where that is a
file system, so processes share what they touch; a store of another kind is read into memory.

The probability is Dirichlet-smoothed: (count(pair) + MU * p(word)) / (count(context) + MU), where p is the
add-one unigram of the base score, so the model sums to one over the vocabulary and the unknown word. In the same way the triples' counts are smoothed
by the pair's probability, which alone stands for the first word of a text and after pairs that weren't seen. A model
of order 2 has no triples.

Defined results: a null or empty text is its end alone; a null doc_id counts as the empty string for the split; with no training
documents every count is 0 and both scores are 0, as the unknown word has probability 1; repeated rows count and score
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, cut, lower_utf8_words, mix64, new_folder, open_shared, slices

HELD_OUT, OF = 2, 7
MU = 30.0
SHARD_WORDS, SHARD_PAIRS = 1 << 20, 1 << 21
#: Steps of log10 probability, from 0 down.
STEP = 0.03
#: Tokens of which pairs are counted before they leave a task.
CHUNK = 1_000_000
#: Neither can be a word, as both hold a blank.
END, START = xxhash.xxh3_64_intdigest(b" end"), xxhash.xxh3_64_intdigest(b" start")


class EliasFano:
    """A monotone sequence of unsigned 64-bit numbers below a bound, in arrays that may be memory-mapped."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        # Zeros before each word of the unary part.
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def build(cls, values: np.ndarray, bound: int) -> EliasFano:
        n, values = len(values), values.astype(np.uint64)
        bits = max(0, (bound // max(1, n)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            at, part = np.arange(n, dtype=np.uint64) * np.uint64(bits), values & np.uint64((1 << bits) - 1)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (bound >> bits) + n + 2
        high = np.zeros(-(-size // 64) + 1, np.uint64)
        np.bitwise_or.at(high, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        ones = np.append(0, np.cumsum(np.bitwise_count(high), dtype=np.int64))
        ones = ones.astype(np.uint32 if n < 1 << 32 else np.uint64)
        return cls(n, bits, low, high, ones)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        upper = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | upper) & np.uint64((1 << self.low_bits) - 1)

    def _select(self, number: np.ndarray, one: bool) -> np.ndarray:
        """Positions of the number-th (from 0) ones, or zeros, of the unary part."""
        before = self.ones if one else self.zeros
        at = np.minimum(np.searchsorted(before, number.astype(before.dtype), side="right") - 1, len(self.high) - 1)
        rest = number - before[at].astype(np.int64)
        word, bit = self.high[at] if one else ~self.high[at], np.zeros(len(number), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            lower = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            up = lower <= rest
            rest -= lower * up
            bit += half * up
            word = word >> (np.uint64(half) * up.astype(np.uint64))
        return at * 64 + bit

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self._select(at, True) - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)

    def _range(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where elements of each value's upper bits begin and end, and the value's lower bits."""
        values = values.astype(np.uint64)
        group = (values >> np.uint64(self.low_bits)).astype(np.int64)
        start = np.where(group > 0, self._select(np.maximum(group - 1, 0), False) + 1, 0)
        # The ones from there on are the group, up to the next zero; mostly that is near.
        word, shift = start >> 6, (start & 63).astype(np.uint64)
        after = self.high[np.minimum(word + 1, len(self.high) - 1)] << ((np.uint64(64) - shift) & np.uint64(63))
        near = (self.high[word] >> shift) | np.where(shift > 0, after, np.uint64(0))
        size = np.bitwise_count((near ^ (near + np.uint64(1))) >> np.uint64(1)).astype(np.int64)
        left = start - group
        right = left + size
        if len(far := np.flatnonzero(size >= 63)):
            right[far] = self._select(group[far], False) - group[far]
        return left, np.minimum(right, self.n), values & np.uint64((1 << self.low_bits) - 1)

    def _search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each value's successor, where the elements of its upper bits end, and its lower bits."""
        left, end, part = self._range(values)
        right = end.copy()
        open_ = np.flatnonzero(left < right)
        while len(open_):
            middle = (left[open_] + right[open_]) >> 1
            less = self._low(middle) < part[open_]
            left[open_[less]] = middle[less] + 1
            right[open_[~less]] = middle[~less]
            open_ = open_[left[open_] < right[open_]]
        return left, end, part

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Place of the first element that isn't less than each value; n if none is."""
        return self._search(values)[0] if self.n and len(values) else np.zeros(len(values), np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, -1 where it isn't an element: of its successor, if that has the same upper and lower bits."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        place, end, part = self._search(values)
        at = np.flatnonzero(place < end)
        found = np.full(len(values), -1, np.int64)
        at = at[self._low(place[at]) == part[at]]
        found[at] = place[at]
        return found

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.ones]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(int(arrays[0][0]), int(arrays[0][1]), *arrays[1:4])


def save(path: str, arrays: list[np.ndarray]) -> None:
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    head += b" " * (-(len(head) + 8) % 8)
    with open_shared(path, "wb") as out:
        out.write(struct.pack("<Q", len(head)) + head)
        for a in arrays:
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


def load(path: str) -> list[np.ndarray]:
    if re.match(r"file:|/", path):
        # As a plain array: indexing a memmap costs more.
        data = np.memmap(re.sub(r"^file:/*", "/", path), np.uint8, "r").view(np.ndarray)
    else:
        with open_shared(path, "rb") as source:
            data = np.frombuffer(source.read(), np.uint8)
    at = 8 + int(data[:8].view("<u8")[0])
    out = []
    for kind, n in json.loads(bytes(data[8:at])):
        size = n * np.dtype(kind).itemsize
        out.append(data[at : at + size].view(kind))
        at += size + -size % 8
    return out


def chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with the word hashes of their texts, an end after each, and where each text begins."""
    hashes = WordHashes()
    for batch in slices(batches, 1000):
        at = 0
        parts, sizes, first = [], [], 0
        for value in batch.column(text).cast(pa.large_binary()):
            words = lower_utf8_words(value.as_py())
            parts.append(np.append(hashes.of(words, len(words)), np.uint64(END)))
            sizes.append(len(words) + 1)
            at += 1
            if sum(sizes) >= CHUNK or at == batch.num_rows:
                yield batch.slice(first, at - first), np.concatenate(parts), np.append(0, np.cumsum(sizes))[:-1]
                parts, sizes, first = [], [], at


def counted(keys: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the key columns and how often each occurs."""
    whole = keys[0] if len(keys) == 1 else mix64(keys[0] * np.uint64(0x9E3779B97F4A7C15) + keys[1])
    _, first, n = np.unique(whole, return_index=True, return_counts=True)
    return [k[first] for k in keys], n


def split_part() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(OF))


class Vocabulary:
    """All word levels: rank and count of words by hash."""

    def __init__(self, files: list[tuple[str, int]], bits: int):
        self.levels, self.first = [(EliasFano.of(a[:4]), a[4]) for a in (load(path) for path, _ in files)], [first for _, first in files]
        self.shards = self.bits = bits

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (-1 if unknown) and count of each."""
        rank, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard, rest = _upper(hashes, self.bits)
        for s in np.unique(shard):
            level, counts = self.levels[s]
            at = np.flatnonzero(shard == s)
            place = level.find(rest[at])
            known = place >= 0
            rank[at[known]], count[at[known]] = self.first[s] + place[known], counts[place[known]]
        return rank, count


def _upper(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The upper bits, and the rest."""
    if not bits:
        return np.zeros(len(hashes), np.int64), hashes
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), hashes & np.uint64((1 << (64 - bits)) - 1)


def word_levels(docs: DataFrame, folder: str) -> tuple[list[tuple[str, int]], int, int, int, int]:
    """Files and first ranks in order, bits of the shard, number of words V, of tokens N and of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, _ in chunks(batches, 0):
            (key,), n = counted([words])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    words = cut(docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.when(F.col("word") == np.uint64(END).view(np.int64).item(), F.col("n"))), F.lit(0))).first()
    bits = max(0, (total[0] // SHARD_WORDS).bit_length())
    shard = F.shiftrightunsigned("word", 64 - bits).cast("int") if bits else F.lit(0)
    dealt = words.withColumn("shard", shard).repartition(1 << bits, "shard").withColumn("sign", F.col("word") < 0).sortWithinPartitions("shard", "sign", "word").select("shard", "word", "n")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (word, n) in by_shard(batches):
            path = f"{folder}/words-{shard:06d}-{uuid.uuid4().hex}"
            save(path, [*EliasFano.build(_upper(word.view(np.uint64), bits)[1], (1 << (64 - bits)) - 1).arrays(), n.astype(np.uint32 if n.max() < 1 << 32 else np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(word)], pa.int64())], ["shard", "path", "n"])

    files = {r["shard"]: r for r in cut(dealt.mapInArrow(write, "shard int, path string, n long"), "word-files").collect()}
    out, first = [], 0
    for s in range(1 << bits):
        if s not in files:
            save(path := f"{folder}/words-{s:06d}-none", [*EliasFano.build(np.empty(0, np.uint64), 1).arrays(), np.empty(0, np.uint32)])
        out.append((files[s]["path"] if s in files else path, first))
        first += files[s]["n"] if s in files else 0
    return out, bits, *total


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Consecutive rows of one shard, the first column, with the others as arrays."""
    held, now = [], None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        edges = np.append(np.append(0, np.flatnonzero(np.diff(columns[0])) + 1), batch.num_rows)
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if held and columns[0][a] != now:
                yield int(now), [np.concatenate(c) for c in zip(*held)]
                held = []
            now = columns[0][a]
            held.append([c[a:b] for c in columns[1:]])
    if held:
        yield int(now), [np.concatenate(c) for c in zip(*held)]


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers byte by byte, so that equal upper bytes lie together and compress."""
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)


def unpacked(data: bytes, kinds: list[str], n: int) -> list[np.ndarray]:
    out, at = [], 0
    for kind in map(np.dtype, kinds):
        plain = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(plain.T).view(kind).ravel())
        at += n * kind.itemsize
    return out


PACKED = ["<u8", "<u4", "<u4"]


def pair_levels(docs: DataFrame, folder: str, vocabulary: tuple, words: int, tokens: int, starts: int, order: int) -> list[str]:
    """Files in order of shards, with triples where order is above 2. The start's rank is the number of words, which as next word means none."""
    shards = max(1, -(-tokens // SHARD_PAIRS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Vocabulary(*vocabulary)
        for _, hashes, begin in chunks(batches, 0):
            own, back = np.unique(hashes, return_inverse=True)
            rank = levels.find(own)[0][back]
            context, following = np.append(words, rank[:-1]), np.append(rank[1:], words)
            context[begin] = following[begin - 1] = words
            if order < 3:
                following[:] = words
            pair = _pair(context, rank, words)
            (pair, following), n = counted([pair, following.astype(np.uint64)])
            shard = _shard(pair, shards)
            at = np.argsort(shard, kind="stable")
            shard, pair, following, n = shard[at], pair[at], following[at].astype("<u4"), n[at].astype("<u4")
            edge = np.append(np.append(0, np.flatnonzero(np.diff(shard)) + 1), len(shard))
            rows = [packed([x[a:b] for x in (pair, following, n)]) for a, b in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(shard[edge[:-1]].astype(np.int32)), pa.array(np.diff(edge)), pa.array(rows, pa.binary())], ["shard", "n", "rows"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Vocabulary(*vocabulary)
        for shard, (pair, following, n) in merged_shards(batches):
            edge = np.append(0, np.flatnonzero(np.diff(pair)) + 1)
            sums, pairs = np.add.reduceat(n, edge), pair[edge]
            context, word = (pairs // np.uint64(words + 1)).astype(np.int64), pairs % np.uint64(words + 1)
            first = np.append(0, np.flatnonzero(np.diff(context)) + 1)
            own = context[first]
            total = np.concatenate([levels_count(levels, own[own < words]), np.full(int((own == words).sum()), starts)])
            number = np.repeat(np.arange(len(own)), np.diff(np.append(first, len(pairs))))
            arrays = [*EliasFano.build(own, words + 1).arrays(), *EliasFano.build(np.append(first, len(pairs)), len(pairs) + 1).arrays()]
            arrays += [*EliasFano.build(number.astype(np.uint64) * np.uint64(words) + word, len(own) * words).arrays(), coded(-np.log10(sums / (total[number] + MU)))]
            if order > 2:
                inner = following < words
                of = np.repeat(np.arange(len(pairs)), np.diff(np.append(edge, len(pair))))[inner]
                begins = np.append(0, np.cumsum(np.bincount(of, minlength=len(pairs))))
                arrays += [coded(np.log10((sums + MU) / MU)), *EliasFano.build(begins, int(inner.sum()) + 1).arrays()]
                arrays += [*EliasFano.build(of.astype(np.uint64) * np.uint64(words) + following[inner], len(pairs) * words).arrays(), coded(-np.log10(n[inner] / (sums[of] + MU)))]
            path = f"{folder}/pairs-{shard:06d}-{uuid.uuid4().hex}"
            save(path, arrays)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path])], ["shard", "path"])

    packs = docs.select("text").mapInArrow(count, "shard int, n long, rows binary")
    dealt = packs.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    files = {r["shard"]: r["path"] for r in cut(dealt.mapInArrow(write, "shard int, path string"), "pair-files").collect()}
    return [files.get(s, "") for s in range(shards)]


#: Rows of one shard that are held before equal ones are added up.
HELD = 1 << 23


def merged_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Of each shard, whose packs follow each other, the distinct pairs and next words in order, and their counts."""

    def added(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        pair, following, n = (np.concatenate(c) for c in zip(*held))
        at = np.lexsort((following, pair))
        pair, following, n = pair[at], following[at], n[at].astype(np.int64)
        edge = np.append(0, np.flatnonzero((np.diff(pair) != 0) | (np.diff(following) != 0)) + 1)
        return [pair[edge], following[edge], np.add.reduceat(n, edge)]

    held, size, now = [], 0, None
    for batch in batches:
        for shard, n, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if held and (shard != now or size > HELD):
                sums = added(held)
                if shard != now:
                    yield now, sums
                held, size = ([sums], len(sums[0]) // 2) if shard == now else ([], 0)
            now = shard
            held.append(unpacked(rows.as_py(), PACKED, n))
            size += n
    if held:
        yield now, added(held)


def coded(level: np.ndarray) -> np.ndarray:
    """Codes of -log10 of shares, in as few bits as hold them all: no count of 64 bits comes near the end of 16."""
    codes = np.rint(level / STEP)
    return codes.astype(np.uint8 if codes.max(initial=0) < 256 else np.uint16)


def levels_count(levels: Vocabulary, rank: np.ndarray) -> np.ndarray:
    """Counts of words by rank, in ascending order."""
    out, first = np.zeros(len(rank), np.int64), np.array(levels.first)
    shard = np.searchsorted(first, rank, side="right") - 1
    for s in np.unique(shard):
        at = shard == s
        out[at] = levels.levels[s][1][rank[at] - first[s]]
    return out


def _pair(context: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
    return context.astype(np.uint64) * np.uint64(words + 1) + word.astype(np.uint64)


def _shard(pair: np.ndarray, shards: int) -> np.ndarray:
    found = mix64(pair * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(shards)
    return found.astype(np.uint16 if shards <= 1 << 16 else np.uint32)


class Pairs:
    """All pair levels and the triples in them; a file is opened when it is first asked."""

    def __init__(self, files: list[str]):
        self.files, self.levels = files, [None] * len(files)

    def _level(self, s: int) -> tuple | None:
        if self.levels[s] is None and self.files[s]:
            a = load(self.files[s])
            triples = (a[13], EliasFano.of(a[14:18]), EliasFano.of(a[18:22]), a[22]) if len(a) > 13 else None
            self.levels[s] = EliasFano.of(a[:4]), EliasFano.of(a[4:8]), EliasFano.of(a[8:12]), a[12], triples
        return self.levels[s]

    def look(self, context: np.ndarray, word: np.ndarray, following: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of the pair's own share of its probability and of the triple's with the following word, -inf where they weren't
        seen, and log10 of (pair's count + MU) / MU."""
        share, triple, count = np.full(len(word), -np.inf), np.full(len(word), -np.inf), np.zeros(len(word))
        shard = _shard(_pair(np.maximum(context, 0), np.maximum(word, 0), words), len(self.files))
        order = np.argsort(shard, kind="stable")
        order = order[(context[order] >= 0) & (word[order] >= 0)]
        edge = np.searchsorted(shard[order], np.arange(len(self.files) + 1))
        for s in range(len(self.files)):
            at = order[edge[s] : edge[s + 1]]
            if not len(at) or not (level := self._level(s)):
                continue
            contexts, pointers, nexts, codes, triples = level
            number = contexts.find(context[at])
            at, number = at[number >= 0], number[number >= 0]
            place = nexts.find(number.astype(np.uint64) * np.uint64(words) + word[at].astype(np.uint64))
            at, number, place = at[place >= 0], number[place >= 0], place[place >= 0]
            share[at] = -STEP * codes[place]
            if triples is None:
                continue
            counts, begins, after, shares = triples
            count[at] = STEP * counts[place]
            inner = following[at] >= 0
            at, place = at[inner], place[inner]
            # Most pairs have few next words: where a pair has none, nothing is sought.
            found = after.find(place.astype(np.uint64) * np.uint64(words) + following[at].astype(np.uint64))
            triple[at[found >= 0]] = -STEP * shares[found[found >= 0]]
        return share, triple, count

    def find(self, context: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
        return self.look(context, word, np.full(len(word), -1), words)[0]


def train(docs: DataFrame, folder: str, order: int = 2) -> dict:
    """The model's files and numbers, small and of one entry for each file."""
    files, bits, words, tokens, starts = word_levels(docs, folder)
    pairs = pair_levels(docs, folder, (files, bits), words, tokens, starts, order)
    return {"vocabulary": (files, bits), "pairs": pairs, "words": words, "tokens": tokens, "starts": starts}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs' doc_id and held_out, and n_tokens, n_known, train_tokens, base_score, score."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    words, tokens = model["words"], model["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, pairs = Vocabulary(*model["vocabulary"]), Pairs(model["pairs"])
        for part, hashes, begin in chunks(batches, 2):
            own, back = np.unique(hashes, return_inverse=True)
            rank, count = (x[back] for x in vocabulary.find(own))
            base = (count + 1) / (tokens + words + 1)
            context, seen, following = np.append(words, rank[:-1]), np.append(0, count[:-1]), np.append(rank[1:], -1)
            context[begin], seen[begin], following[begin - 1] = words, model["starts"], -1
            share, triple, times = pairs.look(context, rank, following, words)
            pair = 10.0**share + MU / (seen + MU) * base
            # What a pair says of its next word belongs to the token after it; a text's first has none.
            triple, times = np.append(-np.inf, triple[:-1]), np.append(0.0, times[:-1])
            triple[begin], times[begin] = -np.inf, 0.0
            full = np.minimum(1.0, 10.0**triple + 10.0**-times * np.minimum(1.0, pair))
            sums = lambda x: np.add.reduceat(x, begin)
            n = np.diff(np.append(begin, len(hashes)))
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(n, pa.int64()), pa.array(sums((count > 0).astype(np.int64))), pa.array(np.full(len(n), tokens), pa.int64()), pa.array(sums(np.log10(base))), pa.array(sums(np.log10(full)))], names)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_ngram_trie(spark, sf_dir: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = read.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (split_part() == HELD_OUT).alias("held_out"))
    return score(docs, train(docs.where("not held_out"), new_folder(spark, "trie"), 3))
