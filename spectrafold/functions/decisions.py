"""Labels, sub-problems, decoding of decision values, and bounds of confidence."""

from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.operators.ordered import followed, numbered, running_sums
from spectrafold.operators.statistics import met
from spectrafold.plans.lineage import small


def labelled(indicators: DataFrame, item: list[str], name: str = "sub_problem", value: str = "y") -> DataFrame:
    """The label of the largest indicator of each item, the least of equal ones."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(name).alias("n")))
    return indicators.where(F.col(value).isNotNull()).groupBy(*item).agg(best.alias("_b")).select(*item, F.col("_b.n").alias("label"))


def class_index(label: Column, classes: list[list]) -> Column:
    """The number, from 1, of the first class that has the label; 0 for none."""
    found = F.lit(0)
    for i, members in reversed([*enumerate(classes, 1)]):
        found = F.when(label.isin(*members), i).otherwise(found)
    return F.when(label.isNull(), 0).otherwise(found)


def sub_problems(rows: DataFrame, label: str, problems: dict[str, tuple[list, list]]) -> DataFrame:
    """Of each problem (positive and negative labels) the rows of either side, with sub_problem and y, 1 or -1."""
    sides = [F.struct(F.lit(n).alias("sub_problem"), F.when(F.col(label).isin(*pos), 1).when(F.col(label).isin(*neg), -1).alias("y")) for n, (pos, neg) in problems.items()]
    wide = rows.withColumn("_p", F.explode(F.array(*sides)))
    return wide.select(*rows.columns, "_p.sub_problem", "_p.y").where("y is not null")


def leave_one_out(rows: DataFrame, order: list[str]) -> DataFrame:
    """fold: each row its own, by its key: no numbering, so no sort of all rows."""
    return rows.withColumn("fold", F.concat_ws("_", *(F.col(c).cast("string") for c in order)))


def fold_signs(rows: DataFrame, fold: str, n: int) -> DataFrame:
    """Each row once a fold with f: 1 where it is tested, -1 where it trains, 0 where its fold is null."""
    wide = rows.withColumn("in_fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return wide.withColumn("f", F.when(F.col(fold).isNull(), 0).when(F.col(fold) == F.col("in_fold"), 1).otherwise(-1))


def two_way_folds(row_fold: Column, column_fold: Column, n: int) -> Column:
    """The fold of a cell, of n by its row and any number by its column."""
    return row_fold + n * column_fold


def decoded(values: DataFrame, codes: DataFrame, item: list[str]) -> DataFrame:
    """The class whose code (sub_problem, class, w) agrees best with the decision values (sub_problem, dv): pred, score.

    The code table has one row a sub-problem and class: small.
    """
    scores = values.join(small(codes), "sub_problem").groupBy(*item, "class").agg(F.sum(F.col("dv") * F.col("w")).alias("score"))
    best = scores.groupBy(*item).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("class"))).alias("_b"))
    return best.select(*item, F.col("_b.class").alias("pred"), (-F.col("_b.s")).alias("score"))


def voted(values: DataFrame, item: list[str]) -> DataFrame:
    """The class that wins most pairings (first, second, dv above 0 for the first), the least of equal ones: pred, votes."""
    won = values.select(*item, F.when(F.col("dv") > 0, F.col("first")).otherwise(F.col("second")).alias("class"))
    counts = won.groupBy(*item, "class").agg(F.count("*").alias("votes"))
    best = counts.groupBy(*item).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("class"))).alias("_b"))
    return best.select(*item, F.col("_b.class").alias("pred"), (-F.col("_b.v")).alias("votes"))


def problem_losses(targets: DataFrame, values: DataFrame, item: list[str]) -> DataFrame:
    """The share that each classifier (classifier, dv) gets right on each sub-problem (sub_problem, y), y of 0 left out: rate, n."""
    right = (F.signum("dv") == F.signum("y")).cast("double")
    return targets.where("y <> 0").join(values, item).groupBy("classifier", "sub_problem").agg(F.avg(right).alias("rate"), F.count("*").alias("n"))


def sequence_values(values: DataFrame, sequences: DataFrame, along: str) -> DataFrame:
    """Sums of decision values times each sequence's weights: sequence, dv."""
    keep = [c for c in values.columns if c not in (along, "dv")]
    return values.join(small(sequences), along).groupBy(*keep, "sequence").agg(F.sum(F.col("dv") * F.col("w")).alias("dv"))


def correlation(rows: DataFrame, y: str, estimate: str, group: list[str], centre_estimate: bool = False) -> DataFrame:
    """Sum of products by the root of the sums of squares; targets of 0 or null are left out, and both are
    centred by the mean of the targets, the estimates by their own with centre_estimate."""
    kept = rows.where((F.col(y) != 0) & F.col(estimate).isNotNull())
    means = kept.groupBy(*group).agg(F.avg(y).alias("_my"), F.avg(estimate).alias("_me"))
    a, b = F.col(y) - F.col("_my"), F.col(estimate) - F.col("_me" if centre_estimate else "_my")
    return met(kept, means, group).groupBy(*group).agg(F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("corr"))


def average_value(rows: DataFrame, y: str, dv: str, group: list[str]) -> DataFrame:
    return rows.where(F.col(y) != 0).groupBy(*group).agg(F.avg(dv).alias("dv"))


def best_offset(rows: DataFrame, y: str, dv: str, group: list[str]) -> DataFrame:
    """The offset to add to decision values for the fewest errors: minus the middle of the two around the first best cut.

    Labels of 0 are left out; equal values are cut in the order of their counts, so sums run over distinct values.
    """
    counted = rows.where(F.col(y) != 0).groupBy(*group, F.col(dv).alias("_v")).agg(F.count_if(F.col(y) > 0).alias("p"), F.count_if(F.col(y) < 0).alias("q"))
    summed = running_sums(counted, group, ["_v"], {"_p": F.col("p"), "_q": F.col("q")}, total=True)
    cut = followed(summed, group, ["_v"], "_v", "_next").withColumn("_e", F.col("_p") + F.col("_q_all") - F.col("_q"))
    best = cut.where("_next is not null").groupBy(*group).agg(F.min(F.struct("_e", "_v", "_next")).alias("_b"))
    return best.select(*group, (-(F.col("_b._v") + F.col("_b._next")) / 2).alias("offset"), F.col("_b._e").alias("errors"))


def prototype_values(rows: DataFrame, item: str, y: str, feat: str = "feat") -> DataFrame:
    """dv of each item by the difference of the class means, 0 in the middle between them."""
    means = rows.groupBy(feat).agg(F.avg(F.when(F.col(y) > 0, F.col("x"))).alias("_p"), F.avg(F.when(F.col(y) < 0, F.col("x"))).alias("_n"))
    w = F.col("_p") - F.col("_n")
    return met(rows, means, [feat]).groupBy(item, y).agg(F.sum(w * (F.col("x") - (F.col("_p") + F.col("_n")) / 2)).alias("dv"))


def fold_summary(losses: DataFrame, measures: list[str], fold: str = "fold") -> DataFrame:
    """Of each measure the mean over the folds and its standard error: measure, mean, se, folds."""
    wide = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures)))
    return losses.select(fold, wide.alias("m")).groupBy(F.col("m.measure").alias("measure")).agg(F.avg("m.v").alias("mean"), (F.stddev_samp("m.v") / F.sqrt(F.count("m.v"))).alias("se"), F.count("m.v").alias("folds"))


def auc_width(n: Column, delta: float = 0.05, rho: float = 0.5) -> Column:
    return F.sqrt(log(2 / delta) / (2 * rho * (1 - rho) * n)) / 3


def _normal_quantile(p: float) -> float:
    """On a grid of hundredths, by summing the density."""
    from math import exp

    total, k = 0.0, 0
    while 0.5 + total <= p:
        total += exp(-0.5 * (k * 0.01) ** 2) * 0.01 / (2 * pi) ** 0.5
        k += 1
    return (k - 1) * 0.01


def binomial_width(n: Column, p: Column, delta: float = 0.05, corrected: bool = True) -> Column:
    """Half the interval of a rate; corrected by two hits and two misses more."""
    z = _normal_quantile(1 - delta / 2)
    rate, of = ((p * n + 2) / (n + 4), n + 4) if corrected else (p, n)
    return z * F.sqrt(rate * (1 - rate) / of)


def correlation_bounds(n: Column, r: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The upper and lower bound of a correlation in Fisher's transform; infinite for fewer than 4 samples."""
    few = n < 4
    width = z / F.sqrt(F.when(few, 1).otherwise(n - 3))
    return F.when(few, float("inf")).otherwise(F.atanh(r) + width), F.when(few, float("-inf")).otherwise(F.atanh(r) - width)


def shuffled_rank(rows: DataFrame, group: list[str], key: Column) -> DataFrame:
    """rank: a fixed permutation of each group's rows, by a hash of their key."""
    return numbered(rows, group, [F.md5(key.cast("string").cast("binary")), key], "rank").withColumn("rank", F.col("rank").cast("int"))


def labels_along(labels: DataFrame, values: DataFrame, excluded: Column) -> DataFrame:
    """Labels (.., y) repeated along the values of a dimension, 0 where excluded. The result has a row for each of both."""
    return labels.crossJoin(small(values)).withColumn("y", F.when(excluded, 0).otherwise(F.col("y")))


def block_sub_problems(rows: DataFrame, block: str, y: str) -> DataFrame:
    """One sub-problem a block: y in its own rows, 0 in all others. Blocks are few: their table is the distinct values."""
    blocks = rows.select(F.col(block).alias("sub_problem")).distinct().where("sub_problem is not null")
    return rows.crossJoin(small(blocks)).withColumn(y, F.when(F.col(block).eqNullSafe(F.col("sub_problem")), F.col(y)).otherwise(0))


def binned_labels(rows: DataFrame, along: str, width: int) -> DataFrame:
    """mid and far of each bin: the median, and what is furthest from 0."""
    keep = [c for c in rows.columns if c not in (along, "x")]
    binned = rows.withColumn("bin", F.floor(F.col(along) / width))
    return binned.groupBy(*keep, "bin").agg(F.median("x").alias("mid"), F.max_by("x", F.abs("x")).alias("far"))


def with_universum(rows: DataFrame, label: str, positive: list, negative: list) -> DataFrame:
    """y of the two sides, and all other labelled rows twice, once on either."""
    one = F.when(F.col(label).isin(*positive), F.array(F.lit(1))).when(F.col(label).isin(*negative), F.array(F.lit(-1))).when(F.col(label).isNotNull(), F.array(F.lit(1), F.lit(-1)))
    return rows.withColumn("y", F.explode(one))


def permutation_bounds(rows: DataFrame, group: list[str], y: str, dv: str, delta: float = 0.05) -> DataFrame:
    """group, n, rate, p (that labels in random order give a higher rate) and bound (the highest rate that chance reaches with delta).

    With labels in random order the number of true positives is hypergeometric in the counts of positives and of positive
    values, and the rate follows from it; so all orders count at once, and no row is copied. Labels of 0 or null and null values
    are left out; a value of 0 is negative. No label left: no row.
    """
    from math import lgamma

    import numpy as np
    import pyarrow as pa

    pos, says = F.col(y) > 0, F.col(dv) > 0
    counts = rows.where((F.col(y) != 0) & F.col(dv).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.count_if(pos).alias("_p"), F.count_if(says).alias("_q"), F.count_if(pos == says).alias("_right"))
    counts = counts.where("n > 0")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in counts.select(*group).schema)
    at = len(group)

    def run(batches):
        choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
        for batch in batches:
            made = []
            for n, p, q, right in zip(*(batch.column(at + k).to_pylist() for k in range(4))):
                # Ten standard deviations to either side hold all but 1e-20.
                middle, spread = p * q / n, (p * q * (n - p) * (n - q) / max(n * n * (n - 1), 1)) ** 0.5
                hits = np.arange(max(0, p + q - n, int(middle - 10 * spread) - 2), min(p, q, int(middle + 10 * spread) + 2) + 1)
                chance = np.exp([choose(p, k) + choose(n - p, q - k) - choose(n, q) for k in hits.tolist()])
                rate = (n - p - q + 2 * hits) / n
                above = np.cumsum(chance[::-1])[::-1]
                reach = rate[above >= delta]
                made.append((n, right / n, float(chance[rate > right / n + 1e-12].sum()), float(reach.max() if len(reach) else rate[0])))
            if made:
                n, rate, p, bound = zip(*made)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(at)), pa.array(n, pa.int64()), *(pa.array(c, pa.float64()) for c in (rate, p, bound))], [*group, "n", "rate", "p", "bound"])

    return counts.mapInArrow(run, f"{kinds}n long, rate double, p double, bound double")


def auc_chance(rows: DataFrame, group: list[str], y: str = "y", value: str = "x") -> DataFrame:
    """group, auc, se (of the area under labels in random order, ties included) and z. Labels of 0 or null are left out."""
    from .scores import auc

    labelled = rows.where((F.col(y) != 0) & F.col(value).isNotNull())
    ties = labelled.groupBy(*group, value).agg(F.count_if(F.col(y) > 0).alias("p"), F.count("*").alias("t"))
    t = F.col("t").cast("double")
    sums = ties.groupBy(*group).agg(F.sum("p").cast("double").alias("_p"), F.sum(t).alias("_n"), F.sum(t * t * t - t).alias("_ties"))
    n, p = F.col("_n"), F.col("_p")
    se = F.sqrt(F.try_divide((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1)), 12 * p * (n - p)))
    return met(auc(labelled, group, value, y), sums, group).select(*group, "auc", se.alias("se"), F.try_divide(F.col("auc") - 0.5, se).alias("z"))
