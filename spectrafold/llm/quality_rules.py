"""Quality rules: a decision list, learned by sequential covering, over per-document statistics.

Everything per document is a Spark expression. What the learner needs of the labelled rows is a
table of counts per combination of binned features: its size is bounded by (BINS + 1) to the
number of features, whatever the number of labels, and only that table reaches the driver.

Defined results: a null or empty text has zero words and fails the base rule; a row without a
label counts for no rule; with no usable labels the list is empty and only the base rule rejects;
several labels of one document count as its lowest; repeated rows are judged alike; other columns
of the input pass through filter_documents() untouched.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, keyed, text_of, with_small, words_of

#: Windows of this many words count as repeated when found twice.
WINDOW = 8
#: Base rule: fewer words, or a larger percentage of repeated words, fail.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Thresholds per feature; the table of counts has at most (BINS + 1) ** len(FEATURES) rows.
BINS = 9
#: A rule must hold for so many of the rejected labels among those it covers, on rows not grown on.
MIN_PRECISION, MIN_COVER, MAX_RULES, MAX_CONDITIONS = 0.9, 5, 8, 4

FEATURES = {
    "mean_word_chars": lambda: F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    "symbols_per_word": lambda: F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1)),
    "capitals_per_char": lambda: F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
    "dup_lines_per_word": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_words"), F.lit(1)),
    "repeat_share": lambda: F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """All conditions hold: the document is rejected."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (c.column() for c in self.conditions))

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + " -> reject"


def statistics(docs: DataFrame) -> DataFrame:
    """docs' columns and the statistics, by expressions over each row alone: no shuffle.

    An array that a lambda reads is referred to at least twice, so that the optimiser keeps it as a
    column and does not move its making into the lambda.
    """
    gram = lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW))
    size = F.size("_grams")
    near = lambda p, i: (F.get("_pairs", i - 1)["g"] == p["g"]) | (F.get("_pairs", i + 1)["g"] == p["g"])
    return (
        docs.withColumn("_text", text_of(docs))
        .withColumn("_words", words_of(F.col("_text")))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace("_text", r"[^#*$%&|<>]++", "")).cast("long"))
        .withColumn("n_capitals", F.length(F.regexp_replace("_text", r"[^A-Z!]++", "")).cast("long"))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_grams", F.when(F.size("_hashes") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_hashes") - (WINDOW - 1)), gram)).otherwise(F.array().cast("array<bigint>")))
        .withColumn("_pairs", F.when(F.size(F.array_distinct("_grams")) < size, F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
        .withColumn("_starts", F.array_sort(F.filter(F.transform("_pairs", lambda p, i: F.when(near(p, i), p["i"])), lambda i: i.isNotNull())))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(F.transform("_starts", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .drop("_text", "_words", "_lines", "_hashes", "_grams", "_pairs", "_starts")
    )


def with_features(stats: DataFrame) -> DataFrame:
    return stats.withColumns({name: make() for name, make in FEATURES.items()})


def count_table(stats: DataFrame, labels: DataFrame) -> tuple[dict[str, list[float]], list[tuple]]:
    """Thresholds by feature, and rows (bins..., grow_bad, grow_all, prune_bad, prune_all)."""
    label = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    known = with_features(stats.where(~F.col("base_failed"))).join(label, "doc_id").select("doc_id", "_quality", *FEATURES)
    known = cut(known, "labelled")
    marks = [(i + 1) / (BINS + 1) for i in range(BINS)]
    # Quantiles of either class, as the rejected one is small.
    by_class = known.groupBy((F.col("_quality") > 0).alias("good")).agg(*(F.percentile_approx(f, marks, 10_000).alias(f) for f in FEATURES)).collect()
    thresholds = {f: sorted({x for row in by_class for x in row[f][1 - row["good"] :: 2]})[:BINS] for f in FEATURES}
    grow, bad = F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0, F.col("_quality") <= 0
    bins = [sum(((F.col(f) > t).cast("int") for t in thresholds[f]), F.lit(0)).alias(f"b_{f}") for f in FEATURES]
    cells = known.select(*bins, grow.alias("grow"), bad.alias("bad")).groupBy(*(f"b_{f}" for f in FEATURES)).agg(F.count_if(F.col("grow") & F.col("bad")), F.count_if(F.col("grow")), F.count_if(~F.col("grow") & F.col("bad")), F.count_if(~F.col("grow")))
    return thresholds, [tuple(row) for row in cells.collect()]


def _best(cells: list[tuple], names: list[str], thresholds: dict[str, list[float]], taken: set) -> tuple[float, Condition, int, int] | None:
    """The condition with the largest gain in information on the rows to grow on."""
    n = len(names)
    bad, total = sum(c[n] for c in cells), sum(c[n + 1] for c in cells)
    if not bad or bad == total:
        return None
    found, before = None, log2(bad / total)
    for k, name in enumerate(names):
        by_bin = [[0, 0] for _ in range(len(thresholds[name]) + 1)]
        for c in cells:
            by_bin[c[k]][0] += c[n]
            by_bin[c[k]][1] += c[n + 1]
        low_bad = low_all = 0
        for j, t in enumerate(thresholds[name]):
            low_bad, low_all = low_bad + by_bin[j][0], low_all + by_bin[j][1]
            for above, b, a in ((False, low_bad, low_all), (True, bad - low_bad, total - low_all)):
                if b and (k, above, j) not in taken and (gain := b * (log2(b / a) - before)) > (found[0] if found else 1e-9):
                    found = gain, Condition(name, above, t), k, j
    return found


def learn(thresholds: dict[str, list[float]], cells: list[tuple]) -> list[Rule]:
    """Sequential covering: grow a conjunction, prune it from its end on held-back rows, drop what it covers."""
    names, rules = list(thresholds), []
    n = len(names)
    while len(rules) < MAX_RULES:
        inside, grown, taken = cells, [], set()
        while len(grown) < MAX_CONDITIONS and (best := _best(inside, names, thresholds, taken)):
            _, condition, k, j = best
            taken.add((k, condition.above, j))
            inside = [c for c in inside if (c[k] > j) == condition.above]
            grown.append((condition, k, j))
        if not grown:
            break

        def holds(c: tuple, conditions: list) -> bool:
            return all((c[k] > j) == x.above for x, k, j in conditions)

        scored = []
        for length in range(1, len(grown) + 1):
            covered = [c for c in cells if holds(c, grown[:length])]
            bad, total = sum(c[n + 2] for c in covered), sum(c[n + 3] for c in covered)
            scored.append(((2 * bad - total) / total if total else -1.0, -length, bad, total))
        _, short, bad, total = max(scored)
        if total < MIN_COVER or bad < MIN_PRECISION * total:
            break
        kept = grown[:-short]
        rules.append(Rule(tuple(x for x, _, _ in kept)))
        cells = [c for c in cells if not holds(c, kept)]
    return rules


def fit(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    return learn(*count_table(stats, labels))


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: true keeps."""
    listed = F.when(F.col("base_failed"), F.lit(False))
    for rule in rules:
        listed = listed.when(rule.column(), F.lit(False))
    return listed.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: the statistics, base_failed and kept. The statistics are made once."""
    stats = cut(statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    rules = fit(stats, labels)
    return with_features(stats).withColumn("kept", verdict(rules)).drop(*FEATURES)


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that base rule and list keep, with all their columns."""
    rows = keyed(docs)
    # Written first: a filter would else be moved below the statistics and make them again for each rule.
    stats = cut(statistics(rows.select("doc_id", "_id", "_key", "text")).drop("text"), "statistics")
    rejected = cut(with_features(stats).where(~verdict(fit(stats, labels))).select("_id", "_key").distinct(), "rejected")
    return with_small(rows.select("_row", "_id", "_key"), rejected, ["_id", "_key"], 64, "left_anti").select("_row.*")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
