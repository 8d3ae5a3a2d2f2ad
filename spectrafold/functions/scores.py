"""Labels, folds, confusion and ranks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.operators.ordered import numbered, running_sums
from spectrafold.operators.statistics import met
from spectrafold.plans.lineage import small


def indicators(rows: DataFrame, label: str, classes: list) -> DataFrame:
    """sub_problem and y: one against the rest for each class; null labels are 0, left out of training."""
    pairs = F.explode(F.array(*(F.struct(F.lit(str(c)).alias("sub_problem"), F.when(F.col(label).isNull(), 0).when(F.col(label) == c, 1).otherwise(-1).alias("y")) for c in classes)))
    return rows.withColumn("_p", pairs).select(*rows.columns, "_p.sub_problem", "_p.y")


def all_indicators(rows: DataFrame, label: str) -> DataFrame:
    """indicators() of all classes that the labels have."""
    classes = rows.select(F.col(label).alias("_c")).where("_c is not null").distinct()
    y = F.when(F.col(label).isNull(), 0).when(F.col(label) == F.col("_c"), 1).otherwise(-1)
    return rows.crossJoin(small(classes)).select(*rows.columns, F.col("_c").cast("string").alias("sub_problem"), y.alias("y"))


def folds(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """Adds fold: rows of each class in turn over n folds, so that every fold has its share."""
    return numbered(rows, [by], [order], "_n").withColumn("fold", ((F.col("_n") - 1) % n).cast("int")).drop("_n")


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def balanced_loss(rows: DataFrame, truth: str, predicted: str, group: list[str]) -> DataFrame:
    """Mean over the classes of the share that is predicted wrongly."""
    by_class = rows.groupBy(*group, truth).agg(F.avg((F.col(truth) != F.col(predicted)).cast("double")).alias("wrong"))
    return by_class.groupBy(*group).agg(F.avg("wrong").alias("loss"))


def auc(rows: DataFrame, group: list[str], value: str = "x", y: str = "y") -> DataFrame:
    """Area under the curve from mid-ranks; labels of 0 are left out.

    Equal values are counted first, so the running sum is over distinct values, not over rows.
    """
    counted = rows.where(F.col(y) != 0).groupBy(*group, value).agg(F.count_if(F.col(y) > 0).alias("p"), F.count_if(F.col(y) < 0).alias("q"))
    summed = running_sums(counted, group, [value], {"_upto": F.col("q")})
    return summed.withColumn("won", F.col("p") * (F.col("_upto") - F.col("q") / 2)).groupBy(*group).agg(F.try_divide(F.sum("won"), F.sum("p") * F.sum("q")).alias("auc"))


def agreement(counts: DataFrame, truth: str, predicted: str, group: list[str] = ()) -> DataFrame:
    """Cohen's kappa of confusion counts (column n): share of agreement p0, expected by chance pe, kappa."""
    grouped = lambda *by: counts.groupBy(*group, *by)
    rows, columns = grouped(truth).agg(F.sum("n").alias("r")), grouped(predicted).agg(F.sum("n").alias("c"))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group] + [F.col(f"a.{truth}") == F.col(f"b.{predicted}")]
    chance = rows.alias("a").join(columns.alias("b"), same).groupBy(*(F.col(f"a.{g}").alias(g) for g in group)).agg(F.sum(F.col("r").cast("double") * F.col("c")).alias("rc"))
    total = grouped().agg(F.sum("n").alias("all"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    joined = total.join(chance, list(group)) if group else total.crossJoin(chance)
    p0, pe = F.col("hit") / F.col("all"), F.col("rc") / F.col("all") / F.col("all")
    return joined.select(*group, p0.alias("p0"), pe.alias("pe"), F.try_divide(p0 - pe, 1 - pe).alias("kappa"))


def binary_losses(rows: DataFrame, y: str, dv: str, group: list[str] = ()) -> DataFrame:
    """tp, fn, fp, tn of the decision value's sign against y, labels of 0 left out, and rate, recall, precision, balanced."""
    pos, says = F.col(y) > 0, F.col(dv) > 0
    four = rows.where((F.col(y) != 0) & F.col(dv).isNotNull()).groupBy(*group).agg(F.count_if(pos & says).alias("tp"), F.count_if(pos & ~says).alias("fn"), F.count_if(~pos & says).alias("fp"), F.count_if(~pos & ~says).alias("tn"))
    tp, fn, fp, tn = map(F.col, ("tp", "fn", "fp", "tn"))
    recall, true_negative = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return four.withColumns({"rate": F.try_divide(tp + tn, tp + fn + fp + tn), "recall": recall, "precision": F.try_divide(tp, tp + fp), "balanced": (recall + true_negative) / 2})


def absolute_fit(rows: DataFrame, y: str, estimate: str, group: list[str] = ()) -> DataFrame:
    """1 less the sum of absolute errors by the sums of absolute values; targets of 0 are left out."""
    a, b = F.col(y), F.col(estimate)
    return rows.where(a != 0).groupBy(*group).agg((1 - F.try_divide(F.sum(F.abs(a - b)), F.sum(F.abs(a)) + F.sum(F.abs(b)))).alias("fit"))


def block_folds(rows: DataFrame, block: str, n: int) -> DataFrame:
    """Adds fold: whole blocks in turn, by their rank. Ranks come from the distinct blocks, not from the rows."""
    ranked = numbered(rows.select(block).where(F.col(block).isNotNull()).distinct(), [], [block], "_n").select(block, ((F.col("_n") - 1) % n).cast("int").alias("fold"))
    return rows.join(ranked, block)


def balanced_rows(rows: DataFrame, label: str, order: str, group: list[str] = ()) -> DataFrame:
    """As many rows of each label as its group's rarest has, the first in order."""
    sizes = rows.groupBy(*group, label).agg(F.count("*").alias("_n"))
    least = sizes.groupBy(*group).agg(F.min("_n").alias("_least"))
    joined = met(numbered(rows, [*group, label], [order], "_r"), least, list(group))
    return joined.where("_r <= _least").drop("_r", "_least")
