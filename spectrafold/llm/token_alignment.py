"""Alignment of two tokenizers, relationally: tokens exploded with places, running lengths, an equi-join on ends, running cuts.

A text, after a blank, is cut into stretches that begin at a blank or a line break between characters that are neither white
space nor controls. Neither tokenizer reaches across such a place: the byte-level one begins a pre-token there, and the
other has no piece that goes on after its blank mark or holds a line break beside other characters (checked when the vocabulary
is read; otherwise, and where `pattern` is None, a stretch is a whole text). So equal stretches have equal tokens, and
the relational work is done once for each distinct stretch, with the number of times that it occurs:

* each side's tokens are exploded by place; a window adds up their lengths to ends; a full join on stretch and end finds
  the cuts, where both end; a running count of cuts numbers the groups.
* Between two ends that follow each other lie bytes of one token of either side, and any two tokens overlap in one such
  piece. So the rows of the full join are the links; a window gives each the tokens that cover it, which is a range join by
  merging. Nothing is paired within a group.
* Links are counted by pair of ids, weighted with the stretches' numbers, and each stretch gets its sums.

Documents are put together from their stretches in order. The most frequent stretches, whose table is bounded (HOT_BYTES), are
looked up where the text is; all others by a join on the stretch.

Links, and documents, are made in PASSES, each for a share of the stretches or rows: of links and of the groups' text, which
are larger than the input, only a pass's share is shuffled at a time.

Defined results: a null or empty text, or one whose bytes differ from those of either side's tokens, has no tokens: zeros and
the empty string, and its stretches count nowhere; repeated rows have equal results beside each other and each counts; a
null doc_id is a document as any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, cut, discard, joins_as_dealt, slices, with_small

#: Where a stretch may begin: before a blank or line break, between characters that are no white space, controls or unassigned.
#: What comes after is looked at first: at most places that is one comparison.
PATTERN = r"(?=[ \n][^\s\p{Z}\p{C}])(?<=[^\s\p{Z}\p{C}])"
#: Bytes of the broadcast table of frequent stretches, at most; of the texts of a row in it, at most; and of the rest of a row.
HOT_BYTES, HOT_ROW, ROW_BYTES = BROADCAST_BYTES, 160, 96
#: Shares of the stretches, and of the rows, that are worked on one after the other. Each of the rows' reads all rare stretches.
PASSES, ROW_PASSES = 4, 2
BLANK_MARK = "▁"
SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class ByteLevel:
    """Side A: ids of texts and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        # Special tokens' strings inside texts are plain text.
        self.own.encode_special_tokens = True
        # Printable characters stand for themselves, the other bytes for code points from 256 on, in order.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in plain]
        back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        self.bytes = [b""] * (1 + max(self.own.get_vocab().values()))
        for entry, k in self.own.get_vocab().items():
            self.bytes[k] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()

    def ids(self, stretches: list[str]) -> list[list[int]]:
        return [e.ids for e in self.own.encode_batch_fast(stretches, add_special_tokens=False)]


class Pieces:
    """Side B, which puts a blank before each text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.own.id_to_piece(k) for k in range(self.own.vocab_size())]
        as_byte = [re.fullmatch("<0x([0-9A-F]{2})>", n) for n in names]
        self.bytes = [bytes([int(m[1], 16)]) if m else n.replace(BLANK_MARK, " ").encode() for n, m in zip(names, as_byte)]
        self.mark = names.index(BLANK_MARK) if BLANK_MARK in names else None
        #: Whether texts may be cut at PATTERN.
        self.parts = self.mark is not None and not any(re.search(f"[^{BLANK_MARK}]{BLANK_MARK}|\n.|.\n", n, re.S) for n in names)

    def ids(self, stretches: list[str]) -> list[list[int]]:
        found = self.own.encode([s[1:] if s[0] == " " else s for s in stretches], num_threads=1)
        # A stretch that begins with a line break follows other text: the blank put before it goes.
        return [own if s[0] == " " else own[1:] for s, own in zip(stretches, found)]


@lru_cache(2)
def sides(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(path_a), Pieces(path_b)


def encoded(stretches: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """stretch, n, number, fits (both sides' bytes are the stretch's), and ids and lengths of either side's tokens."""
    names = ["stretch", "n", "fits", "a", "a_size", "b", "b_size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        # Tasks are as many as cores; the library's own threads would only get in their way.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        both = sides(path_a, path_b)
        sizes = [np.array([len(b) for b in side.bytes], np.int32) for side in both]
        for batch in slices(batches, 2000):
            texts = batch.column(0).to_pylist()
            raw, fits, columns = [t.encode() for t in texts], np.ones(len(texts), bool), []
            for side, size in zip(both, sizes):
                ids = side.ids(texts)
                fits &= [b"".join(map(side.bytes.__getitem__, own)) == r for own, r in zip(ids, raw)]
                flat = np.fromiter((k for own in ids for k in own), np.int32)
                at = np.concatenate(([0], np.cumsum([len(own) for own in ids]))).astype(np.int32)
                columns += [pa.ListArray.from_arrays(at, flat), pa.ListArray.from_arrays(at, size[flat])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fits), *columns], names)

    made = stretches.select("stretch", "n").mapInArrow(run, "stretch string, n long, fits boolean, a array<int>, a_size array<int>, b array<int>, b_size array<int>")
    return cut(made.withColumn("number", F.monotonically_increasing_id()), "encoded")


def links(tokens: DataFrame) -> DataFrame:
    """A row for each link of each stretch: number, n, end, a, b, whether either token ends here, group (counted from the last).

    Tokens are dealt by number; planned under joins_as_dealt(), the join on ends leaves them where they are.
    """
    near = tokens.repartition("number")

    def ends(side: str, *more: str) -> DataFrame:
        each = near.select("number", *more, F.posexplode(F.arrays_zip(F.col(side).alias("id"), F.col(f"{side}_size").alias("size"))).alias("place", "token"))
        so_far = F.sum("token.size").over(Window.partitionBy("number").orderBy("place"))
        return each.select("number", *more, F.col("token.id").alias(side), so_far.alias("end"))

    met = ends("a").join(ends("b"), ["number", "end"], "full").withColumns({"a_ends": F.col("a").isNotNull(), "b_ends": F.col("b").isNotNull()})
    # From the last end back: the token that covers a piece is the one that ended last, so far.
    back = Window.partitionBy("number").orderBy(F.desc("end"))
    return met.select("number", "end", "a_ends", "b_ends", F.last("a", True).over(back).alias("a"), F.last("b", True).over(back).alias("b"), F.sum((F.col("a_ends") & F.col("b_ends")).cast("int")).over(back).alias("group"))


def _ids(side: str) -> Column:
    """The ids of the tokens that end in a group, in order, joined by commas."""
    own = F.sort_array(F.collect_list(F.when(F.col(f"{side}_ends"), F.struct("end", side))))
    return F.array_join(F.transform(own, lambda t: t[side].cast("string")), ",")


def _grouped(tokens: DataFrame) -> DataFrame:
    """number, its groups as text, their number, tokens of either side and the pairs of ids that are linked."""
    groups = links(tokens).groupBy("number", "group").agg(F.concat(_ids("a"), F.lit("|"), _ids("b")).alias("ids"), F.count_if("a_ends").alias("n_a"), F.count_if("b_ends").alias("n_b"), F.collect_list(F.struct("a", "b")).alias("pairs"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("group", "ids")), False), lambda g: g["ids"]), ";")
    return groups.groupBy("number").agg(ordered.alias("groups"), F.count("*").alias("n_groups"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.flatten(F.collect_list("pairs")).alias("pairs"))


def aligned_stretches(tokens: DataFrame) -> DataFrame:
    """stretch, n, the sums of a stretch and its groups as text. tokens is removed."""
    some = [tokens.where(F.col("number") % PASSES == k) for k in range(PASSES)]
    with joins_as_dealt(tokens.sparkSession):
        written = [cut(t.select("number", "stretch", "n").join(_grouped(t), "number"), "links") for t in some]
    discard(tokens)
    linked = reduce(DataFrame.unionAll, written)
    # How many of the corpus's links hold a pair, and whether no other id's links with b are more.
    pairs = cut(linked.select("n", F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    highest = pairs.groupBy("b").agg(F.max("count").alias("highest"))
    counts = pairs.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    sums = with_small(linked.select("number", F.inline("pairs")), counts, ["a", "b"], 64).groupBy("number").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
    whole = linked.withColumn("n_links", F.size("pairs").cast("long")).drop("pairs").join(sums, "number")
    found = cut(whole.select("stretch", "n", *SUMS, "groups"), "stretches")
    discard(*written, pairs)
    return found


def _frequent(stretches: DataFrame) -> Column:
    """Holds for the most frequent stretches whose rows keep to HOT_BYTES together. Levels of frequency are a few hundred."""
    own = F.octet_length("stretch") + F.octet_length("groups")
    short, level = own <= HOT_ROW, F.floor(8 * F.log2("n")).cast("int")
    found = stretches.where(short).groupBy(level.alias("level")).agg(F.sum(own + ROW_BYTES).alias("bytes")).collect()
    room, least = HOT_BYTES, None
    for at, size in sorted(found, reverse=True):
        room -= size
        if room < 0:
            break
        least = at
    return short & (level >= least) if least is not None else F.lit(False)


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str | None = PATTERN, made: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, the SUMS, and groups (the alignment as text, or what is made of it) of every row."""
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "texts", "zstd")
    pattern = pattern if sides(path_a, path_b)[1].parts else None
    # The blank mark stands for a blank, so a text that holds it can't be told from one with blanks: it never fits.
    able = (F.length("text") > 0) & ~F.col("text").contains(BLANK_MARK)
    text = F.concat(F.lit(" "), F.when(able, F.col("text")))

    def exploded(some: DataFrame) -> DataFrame:
        return some.select("row", "doc_id", F.posexplode(F.split(text, pattern) if pattern else F.array_compact(F.array(text))).alias("place", "stretch"))

    tokens = encoded(exploded(rows).groupBy("stretch").agg(F.count("*").alias("n")), path_a, path_b)
    if not tokens.where(~F.col("fits")).isEmpty():
        # Documents with a stretch that fits neither side have no tokens at all: what is left is counted again.
        odd = tokens.where(~F.col("fits")).select("stretch")
        out = exploded(rows).join(odd, "stretch", "left_semi").select("row").distinct()
        fitting = cut(rows.join(out.withColumn("odd", F.lit(True)), "row", "left").select("row", "doc_id", F.when(F.col("odd").isNull(), F.col("text")).alias("text")), "fitting", "zstd")
        discard(rows, tokens)
        rows = fitting
        tokens = encoded(exploded(rows).groupBy("stretch").agg(F.count("*").alias("n")), path_a, path_b)
    stretches = aligned_stretches(tokens)
    frequent = _frequent(stretches)
    hot, cold = stretches.where(frequent).drop("n"), stretches.where(~frequent).drop("n")
    part = F.struct("place", "groups")
    sums = [F.sum(c).alias(c) for c in SUMS]
    none = F.array().cast("array<struct<place:int,groups:string>>")

    def whole(some: DataFrame) -> DataFrame:
        # Texts are dealt by row before they are exploded, so what is looked up stays where it is.
        near = exploded(some.repartition("row")).join(F.broadcast(hot), "stretch").groupBy("row").agg(F.collect_list(part).alias("parts"), *sums)
        rest = exploded(some).join(F.broadcast(hot.select("stretch")), "stretch", "left_anti").join(cold, "stretch").groupBy("row").agg(F.collect_list(part).alias("more"), *(F.sum(c).alias(f"{c}_more") for c in SUMS))
        # Left joins keep the rows where they are; parts of texts are never dealt again.
        both = some.select("row", "doc_id").join(near, "row", "left").join(rest, "row", "left")
        parts = F.sort_array(F.concat(F.coalesce("parts", none), F.coalesce("more", none)))
        groups = F.array_join(F.transform(parts, lambda x: x["groups"]), ";")
        return both.select("doc_id", *((F.coalesce(c, F.lit(0)) + F.coalesce(f"{c}_more", F.lit(0))).cast("long").alias(c) for c in SUMS), (made(groups) if made else groups).alias("groups"))

    found = [cut(whole(rows.where(F.col("row") % ROW_PASSES == k)), "aligned", "zstd") for k in range(ROW_PASSES)]
    discard(rows, stretches)
    return reduce(DataFrame.unionAll, found)


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), made=lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256)))
    return found.withColumnRenamed("groups", "groups_sha256")
