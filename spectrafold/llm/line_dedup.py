"""Line dedup: a segment-partition edit join of lines.

Two lines are near-duplicates within EDITS edits, or one for each EDIT_CHARS code points of the shorter if that
is less. Two lines within so many edits share, if the shorter is cut into one segment more, at least one whole segment
at a place that its number and the difference in length narrow down. Each line indexes its own
segments and probes those of lines as long or up to EDITS shorter, under keys of length, segment
number and substring. Lines under one key are candidates, verified by banded bit-parallel edit distance.

Distinct lines are numbered once, so all that is shuffled after that is numbers.

Pairs are never made of a whole key group. First each line of a group meets the group's least line, its hub;
the links that hold give components. Two lines that share a key share its hub, so what is left is looked for among
the lines of a hub. Only hubs whose lines are still of several components go on: the lines outside the hub's largest
component are compared with all others, in blocks of about BLOCK lines a side, by length and the
parity bits of their characters, of which an edit changes two at most, and only survivors become
pairs to verify. What a pair has in common at either end is found by halving and left out of the distance.

A class is a component of linked lines; it keeps its first occurrence by (doc_id, line number), all
others go. Equal lines are one class at any length; with fewer than EDIT_CHARS code points no edit is
allowed, so only they are.

Defined results: a null text has no lines; lines without a word are kept and belong to no class;
null doc_ids come after all others; repeated rows cannot be told from each other, so their
lines are kept or dropped alike; an empty table gives an
empty result; dedup_lines() keeps all columns in _row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import cut, keyed, with_small

EDITS = 2
#: A line has so many code points for each edit that is allowed; segments have 3 (one edit) or 4 (two) at least.
EDIT_CHARS = 6
#: From here on all EDITS are allowed.
MIN_CHARS = EDITS * EDIT_CHARS
BLOCK = 200
#: Code points that a pair keeps of what it has in common at an end.
MARGIN = 4


def _probes(edits: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """How much shorter the line looked for is, the edits that it then allows, and the numbers and shifts of its segments."""
    out = []
    for shorter in range(edits + 1):
        for allowed in range(max(shorter, 1), edits + 1):
            shifts = lambda n: range(max(-n, shorter - (allowed - n)), min(n, shorter + (allowed - n)) + 1)  # noqa: B023, E731
            out.append((shorter, allowed, [(n, shift) for n in range(allowed + 1) for shift in shifts(n)]))
    return out


def _keys(edits: int) -> Column:
    """The keys that a line, column line of chars code points, indexes and probes.

    Lambdas over tables of segments: spelt out, the expression would be more code than the JVM compiles.
    """

    def keys(segments: list[tuple[int, int]], parts: int, length: Column) -> Column:
        table = F.array(*(F.struct(F.lit(n).alias("number"), F.lit(shift).alias("shift")) for n, shift in segments))
        # The last segments are longer by one where the length doesn't divide.
        cuts = F.struct(length.alias("length"), F.floor(length / parts).cast("int").alias("short"), (parts - F.pmod(length, F.lit(parts))).alias("first_long"))

        def key(c: Column, p: Column) -> Column:
            extra = p["number"] - c["first_long"]
            start = 1 + p["number"] * c["short"] + F.greatest(F.lit(0), extra) + p["shift"]
            return F.xxhash64(c["length"], p["number"], F.substring("line", start, c["short"] + (extra >= 0).cast("int")))

        return _let(cuts, lambda c: F.transform(table, lambda p: key(c, p)))

    none, found = F.array().cast("array<bigint>"), []
    for shorter, allowed, segments in _probes(edits):
        length = F.col("chars") - shorter
        found.append(F.when(allowed_edits(length, edits) == allowed, keys(segments, allowed + 1, length)).otherwise(none))
    return F.array_distinct(F.concat(none, *found))


def allowed_edits(length: Column, edits: int) -> Column:
    """Edits allowed between a line of so many code points and one that is no shorter."""
    return F.least(F.lit(edits), F.floor(length / EDIT_CHARS).cast("int"))


def parity(line: Column) -> Column:
    """64 bits, each the parity of the count of some characters: an edit changes two at most."""
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(F.when(c == "", F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int")))))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def within_edits(edits: int, cells_long: Column | str = "cells_long", cells_short: Column | str = "cells_short") -> Column:
    """Whether two strings, as arrays of characters, the long no shorter, are within so many edits.

    Bit-parallel dynamic programming over a diagonal band (Hyyro 2003): of each column of the matrix,
    the 2 * edits + 1 rows around the diagonal are one number for the places where the value rises by one
    downwards and one for those where it falls; the value at the band's lowest row is followed along
    the diagonal, and along the last row once the band has reached it.
    """
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    n_long = F.size(cells_long)
    invert = lambda x: x.bitwiseXOR(F.lit(full))
    has = lambda x, bit: (x.bitwiseAND(bit) != 0).cast("int")

    def column(state: Column, i: Column) -> Column:
        c = F.get(cells_short, i)
        eq = F.lit(0)
        for back in range(width):
            row = i + edits - back
            eq = eq + F.when((row >= 0) & (F.get(cells_long, F.greatest(row, F.lit(0))) == c), F.lit(1 << (width - 1 - back))).otherwise(F.lit(0))
        vp, vn, at, left = state["vp"], state["vn"], state["at"], n_long - edits - i

        def with_d(d: Column) -> Column:
            hp, hn, down = vn.bitwiseOR(invert(d.bitwiseOR(vp))), d.bitwiseAND(vp), F.shiftright(d, 1)
            # Past the last row the bit of that row moves up the band by one a column.
            last = F.call_function("shiftright", F.lit(top), F.greatest(F.lit(1) - left, F.lit(0)))
            now = F.when(left > 0, at + 1 - has(d, F.lit(top))).otherwise(at + has(hp, last) - has(hn, last))
            return F.struct(hn.bitwiseOR(invert(down.bitwiseOR(hp))).bitwiseAND(F.lit(full)).alias("vp"), down.bitwiseAND(hp).alias("vn"), now.alias("at"))

        d = _let(eq, lambda x: (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full)))
        return _let(d, with_d)

    start = F.struct(F.lit(full ^ ((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("at"))
    run = F.aggregate(F.sequence(F.lit(0), F.size(cells_short) - 1), start, column)
    return (n_long - F.size(cells_short) <= edits) & (run["at"] <= edits)


def _common(a: Column, b: Column, most: Column) -> Column:
    """How many code points, most at most, two strings have in common at their start, by halving."""
    steps = F.sequence(F.ceil(F.log2(most + 1)).cast("int"), F.lit(0))

    def longer(n: Column, step: Column) -> Column:
        more = F.call_function("shiftleft", F.lit(1), step)
        return F.when((n + more <= most) & (F.substring(a, n + 1, more) == F.substring(b, n + 1, more)), n + more).otherwise(n)

    return F.aggregate(steps, F.lit(0), longer)


def _without_common_ends(long: Column, short: Column) -> Column:
    """struct of both strings without what they have in common at the ends, but for MARGIN code points at each."""

    def end(pair: Column) -> Column:
        common = _common(F.reverse(pair["long"]), F.reverse(pair["short"]), F.length(pair["short"]))
        return _let(F.greatest(F.lit(0), common - MARGIN), lambda n: F.struct(*(F.substring(pair[x], F.lit(1), F.length(pair[x]) - n).alias(x) for x in ("long", "short"))))

    def start(n: Column) -> Column:
        rest = lambda x: F.substring(x, n + 1, F.length(x))
        return _let(F.struct(rest(long).alias("long"), rest(short).alias("short")), end)

    return _let(F.greatest(F.lit(0), _common(long, short, F.length(short)) - MARGIN), start)


def verified(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) whose lines are within the edits that the shorter allows. lines: node, line, bits."""
    for end in ("a", "b"):
        pairs = pairs.join(lines.select(F.col("node").alias(end), F.col("line").alias(f"line_{end}"), F.col("bits").alias(f"bits_{end}")), end)
    swap = F.length("line_a") < F.length("line_b")
    longer, shorter = (F.when(swap, F.col(f"line_{x}")).otherwise(F.col(f"line_{y}")) for x, y in ("ba", "ab"))
    may = (F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= 2 * edits) & (F.abs(F.length("line_a") - F.length("line_b")) <= edits)

    def within(pair: Column) -> Column:
        allowed_here, close = allowed_edits(F.length(pair["short"]), edits), F.lit(False)

        def distance(cells: Column) -> Column:
            answer = close
            for allowed in range(1, edits + 1):
                answer = F.when(allowed_here == allowed, within_edits(allowed, cells["long"], cells["short"])).otherwise(answer)
            return answer

        split = lambda ends: F.struct(*(F.split(ends[x], "").alias(x) for x in ("long", "short")))
        return _let(_without_common_ends(pair["long"], pair["short"]), lambda ends: _let(split(ends), distance))

    # A filter takes in the expressions of the columns it names, so the strings are bound inside, once a pair.
    close = F.when(may, _let(F.struct(longer.alias("long"), shorter.alias("short")), within)).otherwise(F.lit(False))
    return cut(pairs.where(close).select("a", "b"), "links")


def left_open(stars: DataFrame, labels: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of lines of one hub and different components that length and parity bits let pass. stars: a (hub), b (line)."""
    named = cut(stars.join(labels.withColumnRenamed("node", "b"), "b", "left").select(F.col("a").alias("hub"), F.col("b").alias("node"), F.coalesce("label", "b").alias("label")), "named")
    kinds = named.groupBy("hub", "label").agg(F.count("*").alias("k"))
    open_hubs = kinds.groupBy("hub").agg(F.max_by("label", F.struct("k", "label")).alias("largest"), F.sum("k").alias("members"), F.max("k").alias("most")).where("members > most")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    placed = with_small(named, open_hubs, ["hub"], 40).withColumns({"small": F.col("label") != F.col("largest"), "wide": blocks(F.col("members")), "askers": blocks(F.col("members") - F.col("most"))})
    own = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    each = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    asked = F.transform(each("askers"), lambda k: F.struct(own("wide").alias("asked"), k.alias("asking"), F.lit(False).alias("asks")))
    asking = F.transform(each("wide"), lambda k: F.struct(k.alias("asked"), own("askers").alias("asking"), F.lit(True).alias("asks")))
    known = placed.join(texts.select("node", F.length("line").alias("chars"), "bits"), "node")
    dealt = known.withColumn("role", F.explode(F.when(F.col("small"), F.concat(asked, asking)).otherwise(asked)))
    member = F.struct("node", "label", "chars", "bits", "small")
    sides = [F.collect_list(F.when(F.col("role.asks") == side, member)).alias(name) for side, name in ((False, "them"), (True, "us"))]
    met = dealt.groupBy("hub", "role.asked", "role.asking").agg(*sides)
    rival = lambda x, y: (x["label"] != y["label"]) & (~y["small"] | (x["node"] < y["node"])) & (F.abs(x["chars"] - y["chars"]) <= edits) & (F.bit_count(x["bits"].bitwiseXOR(y["bits"])) <= 2 * edits)
    found = F.flatten(F.transform("us", lambda x: F.transform(F.filter("them", lambda y: rival(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    return met.select(F.explode(found).alias("pair")).select("pair.*").distinct()


def classes(lines: DataFrame, edits: int) -> DataFrame:
    """node, label of the lines that are linked to others. lines: node (number), line, chars, each once."""
    placed = lines.where(F.col("chars") >= EDIT_CHARS).select("node", F.explode(_keys(edits)).alias("key"))
    ends = placed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("rows"))
    ends = cut(ends.where("hub <> last"), "ends")
    # A group of two is its first and last line; only larger ones need their members.
    two = ends.where("rows = 2").select(F.col("hub").alias("a"), F.col("last").alias("b"))
    more = with_small(placed, ends.where("rows > 2").select("key", "hub"), ["key"], 32).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    stars = cut(two.unionByName(more).distinct(), "stars")
    used = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = cut(with_small(lines, cut(used, "used"), ["node"], 24).select("node", "line", parity(F.col("line")).alias("bits")), "texts")
    first = verified(stars, texts, edits)
    rest = left_open(stars, connected(first), texts, edits).join(stars.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")), (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")
    return connected(first.unionByName(verified(cut(rest, "rivals"), texts, edits)))


def digest() -> Column:
    return F.unhex(F.md5(F.col("line").cast("binary")))


def split_lines(rows: DataFrame) -> DataFrame:
    """_id, _key, none (null doc_id), at, line, digest of each line that has a word."""
    each = rows.select("_id", "_key", F.isnull("doc_id").alias("none"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return each.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("digest", digest())


def dedup_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """_row, doc_id, n_lines (with a word), n_removed, kept (text) of each document."""
    rows = keyed(docs)
    each = split_lines(rows)
    # By the line itself: a string among the aggregates would have every task sort its lines.
    once = each.groupBy("line").agg(F.count("*").alias("n"))
    # Written before it is used, so the numbers stay.
    lines = cut(once.select(F.monotonically_increasing_id().alias("node"), digest().alias("digest"), "line", F.length("line").alias("chars"), "n"), "lines", "zstd")
    labels = classes(lines.select("node", "line", "chars"), edits)
    # Only lines that are repeated, or linked to others, can lose an occurrence.
    shared = lines.select("node", "digest", "n").join(labels, "node", "left").where("n > 1 or label is not null").select("digest", F.coalesce("label", "node").alias("label"))
    spots = cut(with_small(each.select("digest", "none", "_id", "_key", "at"), cut(shared, "shared"), ["digest"], 64).drop("digest"), "spots")
    spot = F.struct("none", "_id", "_key", "at")
    keeps = spots.groupBy("label").agg(F.min(spot).alias("keeps"))
    gone = spots.join(keeps, "label").where(~spot.eqNullSafe(F.col("keeps"))).groupBy("_id", "_key").agg(F.collect_set("at").alias("gone"))
    gone = cut(gone, "gone")
    met = with_small(rows, gone, ["_id", "_key"], F.size("gone") * 4 + 64, "left")
    split = met.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    kept = F.array_join(F.filter("lines", lambda x, i: F.col("gone").isNull() | ~F.array_contains("gone", i)), "\n")
    with_word = F.size(F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    return split.select("_row", "doc_id", with_word.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
