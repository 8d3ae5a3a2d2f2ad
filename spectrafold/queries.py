"""Queries by name over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels, scores
from .functions.predicates import matches, within
from .functions.spectra import fourier, welch
from .operators import records, restructure, spatial, statistics, tensor, wide, windows
from .sources.cubes import event_cube, feature_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CUBE = "cube AS (SELECT event_type AS ch, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS time, user_id AS epoch, avg(value) AS x FROM events GROUP BY 1, 2, 3)"
FEATURES = "feats AS (SELECT vec_id AS epoch, label, CASE WHEN label % 2 = 0 THEN 1 ELSE -1 END AS y, CAST(i AS INT) AS feat, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(i))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns or ("x",)})


@query(f"WITH {CUBE} SELECT ch, count(*) AS n, round(avg(x), 6) AS mu, round(stddev_pop(x), 6) AS sigma FROM cube GROUP BY ch")
def channel_event_mean(spark, d):
    cube = event_cube(spark, d)
    return cube.groupBy("ch").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mu"), F.round(F.stddev_pop("x"), 6).alias("sigma"))


@query(f"WITH {CUBE} SELECT ch, time, epoch, round(x, 6) AS x FROM cube WHERE regexp_matches(ch, '^p') AND epoch BETWEEN 10 AND 40")
def retain_range_and_pattern(spark, d):
    return _rounded(restructure.retain(event_cube(spark, d), matches("ch", ["#^p#"]) & within("epoch", "between", 10, 40)))


@query(f"WITH {CUBE} SELECT ch, time, epoch, round(x, 6) AS x FROM cube WHERE NOT (epoch < 100)")
def reject_before(spark, d):
    return _rounded(restructure.reject(event_cube(spark, d), within("epoch", "before", 100)))


@query(f"WITH {CUBE}, a AS (SELECT * FROM cube WHERE epoch < 60), b AS (SELECT ch, time, epoch, -x AS x FROM cube WHERE epoch BETWEEN 40 AND 90) SELECT coalesce(a.ch, b.ch) AS ch, coalesce(a.time, b.time) AS time, coalesce(a.epoch, b.epoch) AS epoch, round(CASE WHEN b.ch IS NOT NULL THEN b.x ELSE a.x END, 6) AS x FROM a FULL JOIN b ON a.ch = b.ch AND a.time = b.time AND a.epoch = b.epoch")
def merge_cells(spark, d):
    cube = event_cube(spark, d)
    return _rounded(restructure.merge(cube.where("epoch < 60"), cube.where("epoch between 40 and 90").withColumn("x", -F.col("x")), ["ch", "time", "epoch"]))


@query(f"WITH {CUBE} SELECT ch, time, epoch, src, round(x, 6) AS x FROM (SELECT *, 1 AS src FROM cube WHERE epoch < 20 UNION ALL SELECT *, 2 AS src FROM cube WHERE epoch > 120) q")
def concatenate_cubes(spark, d):
    cube = event_cube(spark, d)
    return _rounded(restructure.concatenate(cube.where("epoch < 20"), cube.where("epoch > 120")))


#: A second cube: the negative of each cell a day later, so that it meets some cells of the first and adds others.
LATER = "later AS (SELECT ch, time + 1 AS time, epoch, -x AS x FROM cube)"


def _later(cube: DataFrame) -> DataFrame:
    return cube.select("ch", (F.col("time") + 1).alias("time"), "epoch", (-F.col("x")).alias("x"))


@query(f"WITH {CUBE}, {LATER} SELECT coalesce(a.ch, b.ch) AS ch, coalesce(a.time, b.time) AS time, coalesce(a.epoch, b.epoch) AS epoch, round(CASE WHEN b.ch IS NOT NULL THEN b.x ELSE a.x END, 6) AS x FROM cube a FULL JOIN later b ON a.ch = b.ch AND a.time = b.time AND a.epoch = b.epoch")
def merge_all_cells(spark, d):
    cube = event_cube(spark, d)
    return _rounded(restructure.merge(cube, _later(cube), ["ch", "time", "epoch"]))


@query(f"WITH {CUBE}, {LATER} SELECT ch, time, epoch, src, round(x, 6) AS x FROM (SELECT *, 1 AS src FROM cube UNION ALL SELECT *, 2 AS src FROM later) q")
def concatenate_all_cells(spark, d):
    cube = event_cube(spark, d)
    return _rounded(restructure.concatenate(cube, _later(cube)))


@query(f"WITH {CUBE} SELECT epoch, ch || '_' || CAST(time AS VARCHAR) AS feat, round(x, 6) AS x FROM cube")
def compress_dims(spark, d):
    return _rounded(restructure.compress(event_cube(spark, d), ["ch", "time"], "feat"))


@query("WITH m AS (SELECT conv_id, turn, role, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS e FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, sum(e) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM m), q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id, run) AS c FROM r) SELECT conv_id, turn, role, CAST(run AS BIGINT) AS run, CAST(k AS BIGINT) AS seq, CAST(0 AS BIGINT) AS at FROM q")
def split_dim_runs(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role")
    return restructure.split_runs(turns, ["conv_id"], ["turn"], "role", 1).select("conv_id", "turn", "role", F.col("run").cast("long").alias("run"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("long").alias("at"))


@query("WITH m AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(e) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m), q AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id, run) AS c FROM r) SELECT user_id, event_id, CAST(run AS BIGINT) AS run, CAST(k // 2 AS BIGINT) AS seq, CAST(k % 2 AS BIGINT) AS at FROM q WHERE (k // 2 + 1) * 2 <= c")
def split_dim_pairs(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "ts", "event_type")
    return restructure.split_runs(events, ["user_id"], ["ts", "event_id"], "event_type", 2).select("user_id", "event_id", *(F.col(c).cast("long").alias(c) for c in ("run", "seq", "at")))


@query(f"WITH {CUBE}, m AS (SELECT ch, avg(x) AS y FROM cube GROUP BY ch) SELECT ch, time, epoch, round(x / y, 6) AS x FROM cube JOIN m USING (ch)")
def broadcast_divide(spark, d):
    cube = event_cube(spark, d)
    return _rounded(tensor.broadcasting(cube, "/", statistics.reduced(cube, ["time", "epoch"])))


@query(f"WITH {CUBE}, n AS (SELECT epoch, count(DISTINCT time) AS n FROM cube GROUP BY epoch) SELECT epoch, a.ch, b.ch AS ch2, round(sum(a.x * b.x) / max(n.n), 6) AS x FROM cube a JOIN cube b USING (epoch, time) JOIN n USING (epoch) GROUP BY epoch, a.ch, b.ch")
def channel_covariance(spark, d):
    return _rounded(tensor.covariance(event_cube(spark, d), "ch", "time", ["epoch"]))


@query(f"WITH {CUBE}, w AS (SELECT ch, count(*) / 1000.0 AS y FROM cube GROUP BY ch) SELECT time, epoch, round(sum(x * CAST(y AS DOUBLE)), 6) AS x FROM cube JOIN w USING (ch) GROUP BY time, epoch")
def contract_channels(spark, d):
    cube = event_cube(spark, d)
    weight = cube.groupBy("ch").agg((F.count("*") / 1000.0).alias("x"))
    return _rounded(tensor.contract(cube, weight, ["ch"]))


@query(f"WITH {CUBE}, c AS (SELECT a.ch AS i, b.ch AS j, sum(a.x * b.x) AS x FROM cube a JOIN cube b USING (epoch, time) GROUP BY 1, 2) SELECT i, j, round(CASE WHEN i = j THEN x ELSE 2 * x END, 4) AS x FROM c WHERE i <= j")
def upper_triangle(spark, d):
    cube = event_cube(spark, d)
    sums = tensor.contract(cube.withColumnRenamed("ch", "i"), cube.withColumnRenamed("ch", "j"), ["epoch", "time"])
    return restructure.upper_triangle(sums, "i", "j").withColumn("x", F.round("x", 4))


@query(f"WITH {CUBE} SELECT ch, epoch, round(ln(avg(x * x)), 6) AS x FROM cube GROUP BY ch, epoch")
def log_power(spark, d):
    return _rounded(statistics.reduced(event_cube(spark, d), ["time"], "logpower"))


@query(f"WITH {CUBE} SELECT ch, time, epoch, round(x - avg(x) OVER (PARTITION BY time, epoch), 6) AS x FROM cube")
def rereference_channels(spark, d):
    return _rounded(statistics.rereference(event_cube(spark, d), "ch"))


@query(f"WITH {CUBE} SELECT ch, time, epoch, round(x - coalesce(avg(CASE WHEN time % 30 < 10 THEN x END) OVER (PARTITION BY ch, epoch), 0), 6) AS x FROM cube")
def baseline(spark, d):
    return _rounded(statistics.rereference(event_cube(spark, d), "time", F.col("time") % 30 < 10))


@query(f"WITH {CUBE}, s AS (SELECT ch, avg(x) AS mu, stddev_pop(x) AS sd FROM cube GROUP BY ch) SELECT ch, time, epoch, round((x - mu) / CASE WHEN sd = 0 THEN 1 ELSE greatest(sd, 1e-5) END, 6) AS x FROM cube JOIN s USING (ch)")
def standardize(spark, d):
    return _rounded(statistics.standardised(event_cube(spark, d), ["ch"]))


@query(f"WITH {CUBE}, s AS (SELECT ch, epoch, sqrt(avg(x * x)) AS r FROM cube GROUP BY ch, epoch) SELECT ch, time, epoch, round(x / CASE WHEN r = 0 THEN 1 ELSE greatest(r, 1e-5) END, 6) AS x FROM cube JOIN s USING (ch, epoch)")
def normalize_power(spark, d):
    return _rounded(statistics.normalised(event_cube(spark, d), ["ch", "epoch"]))


@query(f"WITH {CUBE}, c AS (SELECT *, CAST(time - min(time) OVER (PARTITION BY ch, epoch) AS DOUBLE) AS t FROM cube), l AS (SELECT ch, epoch, avg(t) AS mt, avg(x) AS mx, CASE WHEN var_pop(t) = 0 THEN 0 ELSE covar_pop(x, t) / var_pop(t) END AS b FROM c GROUP BY ch, epoch) SELECT ch, time, epoch, round(x - mx - b * (t - mt), 9) + 0 AS x FROM c JOIN l USING (ch, epoch)")
def detrend(spark, d):
    return statistics.detrended(event_cube(spark, d), "time").withColumn("x", F.round("x", 9) + 0)


@query(f"WITH {CUBE}, m AS (SELECT ch, median(x) AS med FROM cube GROUP BY ch), s AS (SELECT ch, max(med) AS med, median(abs(x - med)) AS mad FROM cube JOIN m USING (ch) GROUP BY ch) SELECT ch, time, epoch, round(greatest(least(x, med + 2.75 * mad), med - 2.75 * mad), 6) AS x FROM cube JOIN s USING (ch)")
def windsor(spark, d):
    return _rounded(statistics.clipped(event_cube(spark, d), ["ch"]))


@query(f"WITH {CUBE}, f AS (SELECT ch, epoch, stddev_pop(x) AS x FROM cube GROUP BY ch, epoch), m AS (SELECT ch, median(x) AS med FROM f GROUP BY ch), s AS (SELECT ch, max(med) AS med, sqrt(avg((x - med) * (x - med))) AS s FROM f JOIN m USING (ch) GROUP BY ch) SELECT ch, epoch, round(x, 6) AS x, x > med + 1.5 * s AS bad FROM f JOIN s USING (ch)")
def mark_outliers(spark, d):
    return _rounded(statistics.outliers(statistics.reduced(event_cube(spark, d), ["time"], "std"), ["ch"], 1.5, 1))


@query(f"WITH {CUBE} SELECT ch, CAST(floor(time / 7.0) * 7 AS BIGINT) AS time, epoch, round(avg(x), 6) AS x FROM cube GROUP BY 1, 2, 3")
def subsample(spark, d):
    return _rounded(statistics.bin_averaged(event_cube(spark, d), "time", 7)).withColumn("time", F.col("time").cast("long"))


@query(f"WITH {CUBE}, w AS (SELECT ch, epoch, x, unnest(range(CAST(floor((time - 7) / 3.0) + 1 AS BIGINT), CAST(floor(time / 3.0) AS BIGINT) + 1)) * 3 AS win FROM cube) SELECT ch, epoch, CAST(win AS BIGINT) AS \"window\", count(*) AS n, round(avg(x), 6) AS x FROM w GROUP BY 1, 2, 3")
def sliding_windows(spark, d):
    cut = windows.sliding(event_cube(spark, d), "time", 7, 3)
    return cut.groupBy("ch", "epoch", F.col("window").cast("long").alias("window")).agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("x"))


@query(f"WITH {CUBE} SELECT ch, time, epoch, round(avg(x) OVER (PARTITION BY ch, epoch ORDER BY time ROWS 4 PRECEDING), 6) AS x FROM cube")
def moving_average(spark, d):
    return _rounded(windows.moving_average(event_cube(spark, d), "time", 5))


def _ordered_events(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "ts", "value")
    return events.withColumn("at", F.date_diff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long"))


@query("WITH e AS (SELECT event_id, user_id, event_type, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS at, value FROM events) SELECT s.event_id AS epoch, count(*) AS n, round(sum(e.value), 4) AS x FROM e s JOIN e ON e.user_id = s.user_id AND e.at >= s.at - 1 AND e.at < s.at + 3 WHERE s.event_type = 'purchase' GROUP BY 1")
def event_epochs(spark, d):
    cut = windows.epochs(_ordered_events(spark, d), "user_id", "at", F.col("event_type") == "purchase", 1, 3)
    return cut.groupBy("epoch").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("x"))


@query("WITH e AS (SELECT event_id, user_id, event_type, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS at FROM events) SELECT a.event_id, min(b.at) - a.at AS wait FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.event_type = 'purchase' AND b.at >= a.at WHERE a.event_type = 'click' GROUP BY a.event_id, a.at")
def next_event(spark, d):
    found = windows.next_match(_ordered_events(spark, d), "user_id", "at", F.col("event_type") == "click", F.col("event_type") == "purchase")
    return found.select("event_id", (F.col("next_at") - F.col("at")).alias("wait"))


@query("WITH e AS (SELECT event_id, user_id, event_type AS s, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT event_id, user_id, CASE WHEN s = 'purchase' THEN 1 ELSE -1 END AS edge FROM e WHERE p IS NOT NULL AND (s = 'purchase') <> (p = 'purchase')")
def phase_edges(spark, d):
    return windows.edges(_ordered_events(spark, d), ["user_id"], ["ts", "event_id"], "event_type", "purchase").select("event_id", "user_id", "edge")


@query(f"WITH {FEATURES} SELECT label, feat, round(avg(x), 6) AS x FROM feats GROUP BY label, feat")
def class_average(spark, d):
    return feature_rows(spark, d).groupBy("label", "feat").agg(F.round(F.avg("x"), 6).alias("x"))


@query(f"WITH {FEATURES}, c AS (SELECT feat, x, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN y < 0 THEN 1 ELSE 0 END) AS q FROM feats GROUP BY feat, x), b AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY feat ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT feat, round(CAST(sum(p * (before + q / 2.0)) AS DOUBLE) / CAST(sum(p) * sum(q) AS DOUBLE), 6) AS auc FROM b GROUP BY feat")
def feature_auc(spark, d):
    return scores.auc(feature_rows(spark, d), ["feat"]).withColumn("auc", F.round("auc", 6))


@query("SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS INT) AS fold FROM labels")
def stratified_folds(spark, d):
    return scores.folds(spark.read.parquet(f"{d}/labels.parquet"), "quality", "doc_id", 5).select("doc_id", "fold")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def confusion_counts(spark, d):
    return scores.confusion(spark.read.parquet(f"{d}/labels.parquet"), "quality", "toxic")


@query("WITH c AS (SELECT quality, avg(CASE WHEN quality <> toxic THEN 1.0 ELSE 0.0 END) AS wrong FROM labels GROUP BY quality) SELECT round(CAST(avg(wrong) AS DOUBLE), 6) AS loss FROM c")
def balanced_loss(spark, d):
    return scores.balanced_loss(spark.read.parquet(f"{d}/labels.parquet"), "quality", "toxic", []).withColumn("loss", F.round("loss", 6))


@query("SELECT vec_id, s.c AS sub_problem, CASE WHEN label IS NULL THEN 0 WHEN CAST(label AS VARCHAR) = s.c THEN 1 ELSE -1 END AS y FROM embeddings, (VALUES ('0'), ('1'), ('2')) s(c)")
def label_indicators(spark, d):
    return scores.indicators(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label"), "label", [0, 1, 2]).select("vec_id", "sub_problem", "y")


@query("SELECT vec_id, CAST(s.c AS VARCHAR) AS sub_problem, CASE WHEN label IS NULL THEN 0 WHEN label = s.c THEN 1 ELSE -1 END AS y FROM embeddings, (SELECT DISTINCT label AS c FROM embeddings WHERE label IS NOT NULL) s")
def label_indicators_all(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label")
    return scores.all_indicators(rows, "label").select("vec_id", "sub_problem", "y")


@query(f"WITH {FEATURES}, m AS (SELECT label AS class, feat, avg(x) AS mu FROM feats GROUP BY 1, 2) SELECT epoch, class, round(sum((x - mu) * (x - mu)), 5) AS dist FROM feats JOIN m USING (feat) GROUP BY 1, 2")
def prototype_distances(spark, d):
    rows = feature_rows(spark, d)
    means = rows.groupBy(F.col("label").alias("class"), "feat").agg(F.avg("x").alias("mu"))
    return rows.join(means, "feat").groupBy("epoch", "class").agg(F.round(F.sum(F.pow(F.col("x") - F.col("mu"), 2)), 5).alias("dist"))


_WELCH = "s AS (SELECT ch, epoch, min(time) AS lo, greatest(14, max(time) - min(time) + 1) AS n FROM cube GROUP BY 1, 2), w AS (SELECT ch, epoch, lo, unnest(range(0, greatest(0, n - 14) + 1, 7)) AS st FROM s), g AS (SELECT w.ch, w.epoch, st, i, coalesce(c.x, 0) AS x FROM w CROSS JOIN range(14) r(i) LEFT JOIN cube c ON c.ch = w.ch AND c.epoch = w.epoch AND c.time = w.lo + st + i), d AS (SELECT ch, epoch, st, i, (x - avg(x) OVER q - covar_pop(x, i) OVER q / 16.25 * (i - 6.5)) * (0.54 - 0.46 * cos(2 * pi() * i / 13)) AS y FROM g WINDOW q AS (PARTITION BY ch, epoch, st)), f AS (SELECT ch, epoch, st, k, sum(y * cos(2 * pi() * k * i / 14)) AS re, sum(y * sin(2 * pi() * k * i / 14)) AS im FROM d, range(8) o(k) GROUP BY 1, 2, 3, 4)"


@query(f"WITH {CUBE}, {_WELCH} SELECT ch, epoch, k / 14.0 AS freq, round(avg(2 * (re * re + im * im)) / (SELECT sum(power(0.54 - 0.46 * cos(2 * pi() * i / 13), 2)) FROM range(14) r(i)), 6) + 0 AS x FROM f GROUP BY 1, 2, 3")
def welch_spectrum(spark, d):
    return welch(event_cube(spark, d), "time", 1.0, 14).withColumn("x", F.round("x", 6) + 0)


LANDMARKS = f"{FEATURES}, z AS (SELECT label AS class, feat, avg(x) AS mu FROM feats GROUP BY 1, 2)"
DAYS = "date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))"


def _class_means(spark, d):
    return feature_rows(spark, d).groupBy(F.col("label").alias("class"), "feat").agg(F.avg("x").alias("x"))


@query(f"WITH {LANDMARKS} SELECT epoch, class, round(sum(x * mu), 5) AS x FROM feats JOIN z USING (feat) GROUP BY 1, 2")
def linear_kernel(spark, d):
    rows = feature_rows(spark, d).select("epoch", "feat", "x")
    return kernels.kernel(rows, _class_means(spark, d)).withColumn("x", F.round("x", 5))


@query(f"WITH {LANDMARKS} SELECT epoch, class, round(power(sum(x * mu) + 1, 2), 5) AS x FROM feats JOIN z USING (feat) GROUP BY 1, 2")
def polynomial_kernel(spark, d):
    rows = feature_rows(spark, d).select("epoch", "feat", "x")
    return kernels.kernel(rows, _class_means(spark, d), "poly").withColumn("x", F.round("x", 5))


@query(f"WITH {LANDMARKS} SELECT epoch, class, round(exp(-0.5 * sum((x - mu) * (x - mu)) / 4), 6) AS x FROM feats JOIN z USING (feat) GROUP BY 1, 2")
def rbf_kernel(spark, d):
    rows = feature_rows(spark, d).select("epoch", "feat", "x")
    return _rounded(kernels.kernel(rows, _class_means(spark, d), "rbf", 4.0))


@query(f"WITH {LANDMARKS}, k AS (SELECT epoch, class, sum(x * mu) AS x FROM feats JOIN z USING (feat) GROUP BY 1, 2) SELECT epoch, class, round(x - avg(x) OVER (PARTITION BY epoch) - avg(x) OVER (PARTITION BY class) + avg(x) OVER (), 5) AS x FROM k")
def centred_kernel(spark, d):
    rows = feature_rows(spark, d).select("epoch", "feat", "x")
    return kernels.centred(kernels.kernel(rows, _class_means(spark, d)), "epoch", "class").withColumn("x", F.round("x", 5))


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('click', 'purchase') AND NOT regexp_matches(CAST(user_id AS VARCHAR), '^1') AND value IS NOT NULL")
def record_match(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.struct("event_type", "value").alias("what"), F.struct(F.struct(F.col("user_id").cast("string").alias("name"), "user_id").alias("user")).alias("who"))
    chosen = events.where(records.match({"what.event_type": ["click", "purchase"], "~who.user.name": "#1#", "what.value": "*"}))
    return records.fields(chosen, {"event_id": -1, "what.event_type": "", "who.user.user_id": -1})


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_custkey, " + ", ".join(f"max(CASE WHEN o_orderpriority = '{p}' THEN CAST(o_totalprice AS DOUBLE) END) AS p{p[0]}" for p in PRIORITIES) + " FROM orders GROUP BY o_custkey")
def pivot_results(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("score"))
    table = records.result_table(orders, ["o_custkey"], "o_orderpriority", PRIORITIES, "score")
    return table.withColumnsRenamed({p: f"p{p[0]}" for p in PRIORITIES})


@query("SELECT o_custkey, o_orderpriority AS priority, max(CAST(o_totalprice AS DOUBLE)) AS score FROM orders WHERE o_orderpriority IN (" + ", ".join(f"'{p}'" for p in PRIORITIES) + ") GROUP BY 1, 2 HAVING max(CAST(o_totalprice AS DOUBLE)) > 0")
def result_records(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("score"))
    return records.result_records(records.result_table(orders, ["o_custkey"], "o_orderpriority", PRIORITIES, "score"), ["o_custkey"], "priority", "score")


@query(f"WITH e AS (SELECT event_id, user_id, event_type, {DAYS} AS t FROM events), p AS (SELECT a.event_id, a.t, max(CASE WHEN b.t <= a.t THEN b.t END) AS lo, min(CASE WHEN b.t >= a.t THEN b.t END) AS hi FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.event_type = 'purchase' WHERE a.event_type = 'click' GROUP BY 1, 2) SELECT event_id, CASE WHEN lo IS NULL OR hi - t < t - lo THEN hi ELSE lo END - t AS wait FROM p")
def asof_nearest(spark, d):
    found = windows.nearest_match(_ordered_events(spark, d), "user_id", "at", F.col("event_type") == "click", F.col("event_type") == "purchase")
    return found.select("event_id", (F.col("nearest_at") - F.col("at")).alias("wait"))


@query(f"WITH {CUBE} SELECT ch, time, epoch, round(x - l[CAST(greatest(ceil(0.3 * len(l)), 1) AS INT)], 6) AS x FROM (SELECT *, list_sort(list(x) OVER (PARTITION BY ch, epoch ORDER BY time ROWS 8 PRECEDING)) AS l FROM cube) q")
def percentile_filter(spark, d):
    return _rounded(windows.percentile_filtered(event_cube(spark, d), "time", 9, 0.3))


@query(f"WITH {CUBE} SELECT ch, time, epoch, round(0.25 * first_value(x) OVER (PARTITION BY ch, epoch ORDER BY time) + 0.75 * x, 6) AS x FROM cube")
def blend_with_first(spark, d):
    return _rounded(windows.smoothed_to_first(event_cube(spark, d), "time", 0.25))


@query(f"WITH {CUBE}, g AS (SELECT ch, time, epoch, CASE WHEN time % 3 <> 0 THEN x END AS x FROM cube), t AS (SELECT *, CASE WHEN x IS NOT NULL THEN time END AS s FROM g), b AS (SELECT ch, time, epoch, x, max(s) OVER (PARTITION BY ch, epoch ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo, min(s) OVER (PARTITION BY ch, epoch ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM t) SELECT b.ch, b.time, b.epoch, round(coalesce(b.x, l.x + (h.x - l.x) * (b.time - b.lo) / (b.hi - b.lo)), 6) AS x FROM b LEFT JOIN g l ON l.ch = b.ch AND l.epoch = b.epoch AND l.time = b.lo LEFT JOIN g h ON h.ch = b.ch AND h.epoch = b.epoch AND h.time = b.hi")
def linear_interpolation(spark, d):
    gaps = event_cube(spark, d).withColumn("x", F.when(F.col("time") % 3 != 0, F.col("x")))
    return _rounded(windows.interpolated(gaps, "time"))


@query(f"WITH {CUBE}, o AS (SELECT *, CASE WHEN time - lag(time) OVER w <= 4 THEN 0 ELSE 1 END AS o FROM cube WINDOW w AS (PARTITION BY ch, epoch ORDER BY time)) SELECT ch, time, epoch, CAST(sum(o) OVER (PARTITION BY ch, epoch ORDER BY time) AS BIGINT) AS block FROM o")
def block_ids(spark, d):
    return windows.block_numbers(event_cube(spark, d), ["ch", "epoch"], ["time"], "time", 4).select("ch", "time", "epoch", "block")


@query(f"WITH {CUBE} SELECT ch, epoch, round((count(*) - 1) / (max(time) - min(time)), 6) AS x FROM cube GROUP BY ch, epoch HAVING max(time) > min(time)")
def sample_rate(spark, d):
    return _rounded(windows.sample_rate(event_cube(spark, d), "time"))


@query("WITH n AS (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS p0, avg(CAST(quality AS DOUBLE)) AS a, avg(CAST(toxic AS DOUBLE)) AS b FROM labels), e AS (SELECT p0, a * b + (1 - a) * (1 - b) AS pe FROM n) SELECT round(CAST(p0 AS DOUBLE), 6) AS p0, round(pe, 6) AS pe, round((p0 - pe) / (1 - pe), 6) AS kappa FROM e")
def kappa(spark, d):
    counts = scores.confusion(spark.read.parquet(f"{d}/labels.parquet"), "quality", "toxic")
    return _rounded(scores.agreement(counts, "quality", "toxic"), "p0", "pe", "kappa")


@query(f"WITH {FEATURES}, c AS (SELECT feat, count(*) FILTER (y > 0 AND x > 0) AS tp, count(*) FILTER (y > 0 AND x <= 0) AS fn, count(*) FILTER (y < 0 AND x > 0) AS fp, count(*) FILTER (y < 0 AND x <= 0) AS tn FROM feats GROUP BY feat) SELECT feat, tp, fn, fp, tn, round((tp + tn) / (tp + fn + fp + tn), 6) AS rate, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp, 0), 6) AS precision, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced FROM c")
def confusion_losses(spark, d):
    return _rounded(scores.binary_losses(feature_rows(spark, d), "y", "x", ["feat"]), "rate", "recall", "precision", "balanced")


@query(f"WITH {FEATURES} SELECT feat, round(1 - sum(abs(y - x)) / (sum(abs(y)) + sum(abs(x))), 6) AS fit FROM feats GROUP BY feat")
def absolute_fit(spark, d):
    return _rounded(scores.absolute_fit(feature_rows(spark, d), "y", "x", ["feat"]), "fit")


@query("SELECT event_id, user_id, CAST((dense_rank() OVER (ORDER BY user_id) - 1) % 6 AS INT) AS fold FROM events")
def leave_block_out(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id")
    return scores.block_folds(events, "user_id", 6).select("event_id", "user_id", "fold")


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r FROM labels), m AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM labels GROUP BY quality) q) SELECT doc_id, quality FROM n, m WHERE r <= m")
def balanced_labels(spark, d):
    return scores.balanced_rows(spark.read.parquet(f"{d}/labels.parquet"), "quality", "doc_id").select("doc_id", "quality")


@query(f"WITH {CUBE} SELECT ch, epoch, k, round(sum(x * cos(-2 * pi() * k * time / 30)), 5) AS re, round(sum(x * sin(-2 * pi() * k * time / 30)), 5) AS im FROM cube, (VALUES (1), (2), (4)) s(k) GROUP BY 1, 2, 3")
def dft_small(spark, d):
    return fourier(event_cube(spark, d), "time", 30, [1, 2, 4]).withColumns({c: F.round(c, 5) for c in ("re", "im")})


def _vectors(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").where("label is not null")
    y = F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0)
    return rows.select("vec_id", F.col("embedding").alias("v"), y.alias("y"), F.pmod(F.col("vec_id"), F.lit(5)).cast("long").alias("fold"), (y > 0).cast("long").alias("side"))


@query()
def whiten(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"), F.lit(0).cast("long").alias("all"))
    moments = spatial.second_moments(rows, "all", "v", 64)
    weights = spatial.whitener(sum(moments.values()) / max(rows.count(), 1)) if moments else spatial.np.eye(64)
    return wide.projected(rows.select("vec_id", "v"), "v", weights)


@query()
def common_spatial_patterns(spark, d):
    rows = _vectors(spark, d)
    sums = spatial.second_moments(rows, "side", "v", 64)
    return wide.projected(rows.select("vec_id", "y", "v"), "v", spatial.common_patterns(sums[1], sums[0], 2))


@query()
def ridge_decision_values(spark, d):
    rows = _vectors(spark, d)
    weights = spatial.ridge_folds(rows, "fold", "v", "y", 64, 1.0)
    return spatial.decision_values(rows, "fold", "v", weights).select("vec_id", "fold", "y", "dv")


@query()
def cross_validated_losses(spark, d):
    return scores.binary_losses(ridge_decision_values(spark, d), "y", "dv", ["fold"])


from . import queries_more, queries_signals  # noqa: E402, F401  register their queries
