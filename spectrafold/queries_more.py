"""More queries by name: element-wise work, moments, transforms, decisions and records."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from .functions import decisions, fourier
from .functions.predicates import found_at, nested_match, part_match
from .operators import cells, moments, records, restructure, statistics, tensor
from .queries import CUBE, FEATURES, LANDMARKS, ORACLES, QUERIES, _class_means, _ordered_events, _rounded, query
from .sources.cubes import event_cube, feature_rows

#: The cube by day of the series, from its first, which is what transforms of 30 days take.
SERIES = f"{CUBE}, z AS (SELECT ch, CAST(time - min(time) OVER () AS BIGINT) AS time, epoch, x FROM cube)"


def _series(spark, d):
    cube = event_cube(spark, d)
    first = cube.agg(F.min("time").alias("_first"))
    return cube.crossJoin(F.broadcast(first)).withColumn("time", F.col("time") - F.col("_first")).drop("_first")


# Broadcasting operators: each cell with its channel's mean.
_SQL_OPERATORS = {"plus": "x + y", "minus": "x - y", "times": "x * y", "least": "least(x, y)", "greatest": "greatest(x, y)"} | {n: f"CASE WHEN x {o} y THEN 1.0 ELSE 0.0 END" for n, o in (("equal", "="), ("unequal", "<>"), ("below", "<"), ("above", ">"), ("at_most", "<="), ("at_least", ">="))}
_SPARK_OPERATORS = {"plus": "+", "minus": "-", "times": "*", "least": "min", "greatest": "max", "equal": "==", "unequal": "~=", "below": "<", "above": ">", "at_most": "<=", "at_least": ">="}


def _broadcast_query(name: str):
    # The mean is rounded, so that a cell near it falls on the same side in either engine.
    def run(spark, d):
        cube = event_cube(spark, d).withColumn("x", F.round("x", 3))
        return _rounded(tensor.broadcasting(cube, _SPARK_OPERATORS[name], statistics.reduced(cube, ["time", "epoch"]).withColumn("x", F.round("x", 3))))

    QUERIES[f"broadcast_{name}"] = run
    ORACLES[f"broadcast_{name}"] = f"WITH {CUBE}, c AS (SELECT ch, time, epoch, round(x, 3) AS x FROM cube), m AS (SELECT ch, round(avg(x), 3) AS y FROM c GROUP BY ch) SELECT ch, time, epoch, round(CAST({_SQL_OPERATORS[name]} AS DOUBLE), 6) AS x FROM c JOIN m USING (ch)"


for _name in _SPARK_OPERATORS:
    _broadcast_query(_name)


@query(f"WITH {CUBE}, m AS (SELECT ch, avg(abs(x)) / max(abs(x)) AS y FROM cube GROUP BY ch) SELECT ch, time, epoch, round(power(abs(x), y), 6) AS x FROM cube JOIN m USING (ch)")
def broadcast_power(spark, d):
    cube = event_cube(spark, d).withColumn("x", F.abs("x"))
    share = cube.groupBy("ch").agg((F.avg("x") / F.max("x")).alias("x"))
    return _rounded(tensor.broadcasting(cube, "^", share))


@query(f"WITH {CUBE}, m AS (SELECT ch, avg(x) AS y FROM cube GROUP BY ch) SELECT ch, time, epoch, round(abs(x - y), 6) AS x, round(CASE WHEN x = y THEN 0 ELSE sign(x - y) * sqrt(abs(x - y)) END, 5) AS root FROM cube JOIN m USING (ch)")
def absolute_and_root(spark, d):
    cube = event_cube(spark, d)
    off = tensor.broadcasting(cube, "-", statistics.reduced(cube, ["time", "epoch"]))
    return off.select("ch", "time", "epoch", F.round(F.abs("x"), 6).alias("x"), F.round(cells.signed_root(F.col("x")), 5).alias("root"))


@query(f"WITH {CUBE} SELECT ch, time, epoch, round(CASE WHEN x > 0 THEN 10 * ln(x) END, 6) AS x FROM cube")
def log_db(spark, d):
    return event_cube(spark, d).withColumn("x", F.round(cells.log_values(F.col("x"), True), 6))


@query(f"WITH {CUBE} SELECT ch, time, epoch, round(x / nullif(sqrt(sum(x * x) OVER (PARTITION BY ch, epoch)), 0), 6) AS x FROM cube")
def unit_vectors(spark, d):
    return _rounded(cells.unit_length(event_cube(spark, d), ["time"]))


@query(f"WITH {CUBE} SELECT round(max(abs(a.x - b.x)), 6) AS x FROM cube a JOIN cube b ON a.ch = b.ch AND a.epoch = b.epoch AND a.time = b.time + 1")
def largest_difference(spark, d):
    cube = event_cube(spark, d)
    return _rounded(cells.largest_difference(cube, cube.withColumn("time", F.col("time") + 1), ["ch", "time", "epoch"]))


_CODED = "s AS (SELECT ch, min(x) AS lo, max(x) AS hi FROM cube GROUP BY ch), i AS (SELECT cube.*, lo, CASE WHEN hi = lo THEN 1 ELSE (hi - lo) / 255.0 END AS gain FROM cube JOIN s USING (ch))"


@query(f"WITH {CUBE}, {_CODED} SELECT ch, time, epoch, CAST(round((x - lo) / gain) AS BIGINT) AS i FROM i")
def float_to_int(spark, d):
    return cells.to_integers(event_cube(spark, d), ["ch"], 8).select("ch", "time", "epoch", "i")


@query(f"WITH {CUBE}, {_CODED} SELECT ch, time, epoch, round(round((x - lo) / gain) * gain + lo, 6) AS x FROM i")
def int_to_float(spark, d):
    return _rounded(cells.from_integers(cells.to_integers(event_cube(spark, d), ["ch"], 8)))


@query(f"WITH {CUBE}, w AS (SELECT time, 1.0 + time % 3 AS w FROM (SELECT DISTINCT time FROM cube) q), s AS (SELECT sum(w) AS total FROM w) SELECT ch, time, epoch, round(x * CAST(w AS DOUBLE) / CAST(total AS DOUBLE), 6) AS x FROM cube JOIN w USING (time), s")
def reweighted(spark, d):
    return _rounded(cells.reweighted(event_cube(spark, d), "time", (1 + F.col("time") % 3).cast("double")))


@query(f"WITH {CUBE}, p AS (SELECT ch, avg(x) AS p FROM cube GROUP BY ch) SELECT ch, time, epoch, round(x - p * sum(x * p) OVER w / sum(p * p) OVER w, 5) AS x FROM cube JOIN p USING (ch) WINDOW w AS (PARTITION BY time, epoch)")
def deflated(spark, d):
    cube = event_cube(spark, d)
    return cells.deflated(cube, statistics.reduced(cube, ["time", "epoch"]), "ch").withColumn("x", F.round("x", 5))


@query(f"WITH {SERIES}, f AS (SELECT ch, epoch, k, sum(x * cos(-2 * pi() * k * time / 30)) AS re, sum(x * sin(-2 * pi() * k * time / 30)) AS im FROM z, (VALUES (1), (2)) s(k) GROUP BY 1, 2, 3) SELECT ch, epoch, k, 'real' AS part, round(re, 5) AS x FROM f UNION ALL SELECT ch, epoch, k, 'imag', round(im, 5) FROM f")
def complex_parts(spark, d):
    from .functions.spectra import fourier as coefficients

    return cells.complex_parts(coefficients(_series(spark, d), "time", 30, [1, 2])).withColumn("x", F.round("x", 5))


@query(f"WITH {CUBE} SELECT count(DISTINCT ch) AS ch, count(DISTINCT time) AS time, count(DISTINCT epoch) AS epoch FROM cube")
def dimension_sizes(spark, d):
    return cells.dimension_sizes(event_cube(spark, d), ["ch", "time", "epoch"])


@query(f"WITH {CUBE} SELECT ch, time, epoch, round(x, 6) AS x FROM cube")
def squeezed(spark, d):
    return _rounded(cells.squeezed(event_cube(spark, d).withColumn("subject", F.lit(1)), ["subject"]))


@query(f"WITH {CUBE} SELECT ch, time, epoch, k AS lag, round(CASE k WHEN 0 THEN x WHEN 1 THEN lag(x, 1, 0) OVER w ELSE lag(x, 2, 0) OVER w END, 6) AS x FROM cube, (VALUES (0), (1), (2)) s(k) WINDOW w AS (PARTITION BY ch, epoch, k ORDER BY time)")
def lag_features(spark, d):
    return _rounded(cells.lag_features(event_cube(spark, d), 2))


@query(f"WITH {CUBE} SELECT ch, time, epoch, round(0.5 * x + 0.3 * lag(x, 1, 0) OVER w + 0.2 * lag(x, 2, 0) OVER w, 6) AS x FROM cube WINDOW w AS (PARTITION BY ch, epoch ORDER BY time)")
def convolved(spark, d):
    return _rounded(cells.convolved(event_cube(spark, d), [0.5, 0.3, 0.2]))


_DAY = "date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))"


@query(f"SELECT user_id, \"at\", tau, count(*) AS n FROM (SELECT user_id, {_DAY} + tau AS \"at\", tau FROM events, (VALUES (0), (1), (2)) s(tau) WHERE event_type = 'click') q GROUP BY 1, 2, 3")
def response_matrix(spark, d):
    clicks = _ordered_events(spark, d).where("event_type = 'click'").select("user_id", "at")
    return cells.response_matrix(clicks, "at", 3).groupBy("user_id", "at", "tau").agg(F.count("*").alias("n"))


def _upsampled_sql(value: str) -> str:
    return f"WITH {CUBE}, n AS (SELECT *, lead(x) OVER (PARTITION BY ch, epoch ORDER BY time) AS nx FROM cube) SELECT ch, epoch, CAST(time * 3 + k AS BIGINT) AS time, round({value}, 6) AS x FROM n, (VALUES (0), (1), (2)) s(k)"


for _how, _value in (("nearest", "x"), ("linear", "x + (coalesce(nx, x) - x) * k / 3.0"), ("zero", "CASE WHEN k = 0 THEN x ELSE 0 END")):

    @query(_upsampled_sql(_value))
    def _upsampled(spark, d, how=_how):
        return _rounded(cells.upsampled(event_cube(spark, d), 3, how)).withColumn("time", F.col("time").cast("long"))

    QUERIES[f"upsampled_{_how}"], ORACLES[f"upsampled_{_how}"] = QUERIES.pop("_upsampled"), ORACLES.pop("_upsampled")

_CAP = "('click', 0.5, 0.1), ('purchase', 1.0, -2.0), ('view', 1.2, 3.0)"


@query(f"WITH {CUBE}, cap(ch, lat, long) AS (VALUES {_CAP}), c AS (SELECT DISTINCT ch FROM cube) SELECT ch, round(CAST(lat AS DOUBLE) * cos(long), 6) AS x2, round(CAST(lat AS DOUBLE) * sin(long), 6) AS y2, round(sin(lat) * cos(long), 6) AS x3, round(sin(lat) * sin(long), 6) AS y3, round(cos(lat), 6) AS z3, lat IS NOT NULL AS iseeg, round(CAST(lat AS DOUBLE), 6) AS back FROM c LEFT JOIN cap USING (ch)")
def positions(spark, d):
    cap = spark.sql(f"SELECT ch, CAST(lat AS DOUBLE) AS lat, CAST(long AS DOUBLE) AS long FROM VALUES {_CAP} AS t(ch, lat, long)")
    placed = cells.positions(event_cube(spark, d).select("ch").distinct(), cap)
    back = cells.latitude(F.col("x2"), F.col("y2"))[0]
    return _rounded(placed.withColumn("back", back).drop("lat", "long"), "x2", "y2", "x3", "y3", "z3", "back")


@query("SELECT event_id, CAST(i AS BIGINT) AS i, CAST(i % 7 AS BIGINT) AS a, CAST((i // 7) % 5 AS BIGINT) AS b FROM (SELECT event_id, event_id % 7 + 7 * (user_id % 5) AS i FROM events) q")
def index_arithmetic(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id")
    index = cells.linear_index([7, 5], F.col("event_id") % 7, F.col("user_id") % 5)
    a, b = cells.subscripts([7, 5], F.col("i"))
    return events.select("event_id", index.cast("long").alias("i")).withColumns({"a": a.cast("long"), "b": b.cast("long")})


_PRODUCTS = "p AS (SELECT a.time AS i, b.time AS j, sum(a.x * b.x) AS x FROM cube a JOIN cube b USING (ch, epoch) GROUP BY 1, 2)"


def _products(spark, d):
    cube = event_cube(spark, d)
    return tensor.contract(cube.withColumnRenamed("time", "i"), cube.withColumnRenamed("time", "j"), ["ch", "epoch"])


@query(f"WITH {CUBE}, {_PRODUCTS} SELECT i, j, round(x, 6) AS x FROM p WHERE j - i = 1")
def first_diagonal(spark, d):
    return cells.kth_diagonal(_products(spark, d), "i", "j", 1).withColumn("x", F.round("x", 6))


@query(f"WITH {CUBE}, {_PRODUCTS} SELECT i, round(x, 6) AS x FROM p WHERE i = j")
def diagonal(spark, d):
    return restructure.diagonal(_products(spark, d), "i", "j").withColumn("x", F.round("x", 6))


@query(f"WITH {CUBE} SELECT ch, CAST(time + epoch * 100000 AS BIGINT) AS time, round(x, 6) AS x FROM cube")
def folded_epochs(spark, d):
    folded = cells.folded(event_cube(spark, d), "epoch", "time", 100_000, F.col("epoch"))
    return _rounded(folded).withColumn("time", F.col("time").cast("long"))


@query(f"WITH {CUBE} SELECT DISTINCT ch AS val, 1 AS src FROM cube UNION ALL SELECT DISTINCT event_type, 2 FROM events WHERE value > 50")
def dimension_table(spark, d):
    other = spark.read.parquet(f"{d}/events.parquet").where("value > 50").withColumnRenamed("event_type", "ch")
    return cells.dimension_table(event_cube(spark, d), other, dim="ch")


@query(f"WITH {CUBE} SELECT ch, time, epoch, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x FROM cube")
def single_precision(spark, d):
    return event_cube(spark, d).withColumn("x", F.col("x").cast("float").cast("double"))


@query("SELECT o_orderkey, CAST(strpos(o_orderpriority, '-') AS INT) AS at, regexp_extract(o_orderpriority, '^[0-9]-(.*)$', 1) IN ('URGENT', 'LOW') AS part, list_contains(string_split(o_orderpriority, '-'), 'HIGH') AS nested FROM orders")
def string_matches(spark, d):
    p = F.col("o_orderpriority")
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", found_at(p, "-").alias("at"), part_match(p, "^[0-9]-(.*)$", ["URGENT", "LOW"]).alias("part"), nested_match(F.split(p, "-"), ["HIGH"]).alias("nested"))


# Moments.


@query(f"WITH {CUBE} SELECT ch, epoch, round(sum(x), 5) AS total, round(var_pop(x), 5) AS variance, round(median(x), 6) AS middle FROM cube GROUP BY ch, epoch")
def sums_and_medians(spark, d):
    cube = event_cube(spark, d)
    kinds = {"total": ("sum", 5), "variance": ("var", 5), "middle": ("median", 6)}
    return cube.groupBy("ch", "epoch").agg(*(F.round(statistics.KINDS[k](F.col("x")), n).alias(name) for name, (k, n) in kinds.items()))


for _how, _order in (("max", "DESC"), ("min", "ASC")):

    @query(f"WITH {CUBE} SELECT ch, round(x, 6) AS x, time AS at_time, epoch AS at_epoch FROM (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY x {_order}, time, epoch) AS r FROM cube) q WHERE r = 1")
    def _extreme(spark, d, how=_how):
        return _rounded(moments.extremes(event_cube(spark, d), ["time", "epoch"], how))

    QUERIES[f"{_how}_and_where"], ORACLES[f"{_how}_and_where"] = QUERIES.pop("_extreme"), ORACLES.pop("_extreme")


@query(f"WITH {CUBE}, s AS (SELECT ch, sum(1 + epoch % 4) AS w, sum((1 + epoch % 4) * x) AS wx, sum((1 + epoch % 4) * x * x) AS wxx FROM cube GROUP BY ch) SELECT ch, round(wx / w, 6) AS mu, round(wxx / w - (wx / w) * (wx / w), 4) AS var FROM s")
def weighted_moments(spark, d):
    found = moments.weighted_moments(event_cube(spark, d), ["time", "epoch"], 1 + F.col("epoch") % 4)
    return found.select("ch", F.round("mu", 6).alias("mu"), F.round("var", 4).alias("var"))


@query(f"WITH {CUBE} SELECT epoch, round(min(x), 6) AS least, round(avg(x), 6) AS mu, round(max(x), 6) AS most, round(var_samp(x), 5) AS var FROM cube GROUP BY epoch")
def column_summary(spark, d):
    found = moments.column_summary(event_cube(spark, d), ["epoch"])
    return _rounded(found, "least", "mu", "most").withColumn("var", F.round("var", 5))


_LAGGED = "n AS (SELECT epoch, count(DISTINCT time) AS n FROM cube GROUP BY epoch), g AS (SELECT a.epoch, CAST(k AS INT) AS lag, a.ch AS i, b.ch AS j, sum(a.x * b.x) AS x FROM (SELECT * FROM cube, (VALUES (0), (1), (3)) s(k)) a JOIN cube b ON a.epoch = b.epoch AND b.time = a.time + a.k GROUP BY 1, 2, 3, 4)"


for _norm, _by in (("none", "1"), ("mean", "n"), ("unbiased", "greatest(n - lag, 1)")):

    @query(f"WITH {CUBE}, {_LAGGED} SELECT epoch, lag, i, j, round(x / {_by}, 5) AS x FROM g JOIN n USING (epoch)")
    def _lagged(spark, d, norm=_norm):
        return moments.lagged_covariance(event_cube(spark, d), [0, 1, 3], norm).withColumn("x", F.round("x", 5))

    QUERIES[f"lagged_covariance_{_norm}"], ORACLES[f"lagged_covariance_{_norm}"] = QUERIES.pop("_lagged"), ORACLES.pop("_lagged")

_STIMULI = f"st AS (SELECT DISTINCT user_id AS epoch, {_DAY} AS d, event_type AS code FROM events WHERE value > 50)"


def _stimuli(spark, d):
    return _ordered_events(spark, d).where("value > 50").select(F.col("user_id").alias("epoch"), F.col("at").alias("time"), F.col("event_type").alias("code")).distinct()


@query(f"WITH {CUBE}, {_STIMULI} SELECT ch, code, CAST(k AS INT) AS lag, round(sum(x * 0.5), 6) AS x, count(*) AS n FROM (SELECT epoch, d + k AS time, code, k FROM st, (VALUES (0), (1), (2)) s(k)) q JOIN cube USING (epoch, time) GROUP BY 1, 2, 3")
def cross_covariance(spark, d):
    found = moments.cross_covariance(event_cube(spark, d), _stimuli(spark, d).withColumn("w", F.lit(0.5)), [0, 1, 2])
    return found.withColumn("x", F.round("x", 6))


@query(f"WITH {CUBE}, {_STIMULI} SELECT ch, code, CAST(k AS INT) AS lag, round(avg(x), 6) AS x, count(*) AS n FROM (SELECT epoch, d + k AS time, code, k FROM st, (VALUES (0), (1), (2)) s(k)) q JOIN cube USING (epoch, time) GROUP BY 1, 2, 3")
def lagged_class_average(spark, d):
    return _rounded(moments.lagged_average(event_cube(spark, d), _stimuli(spark, d), [0, 1, 2]))


@query(f"WITH {CUBE}, c AS (SELECT epoch, a.time AS i, b.time AS j, sum(a.x * b.x) / 5.0 AS x FROM cube a JOIN cube b USING (epoch, ch) WHERE a.time = b.time GROUP BY 1, 2, 3) SELECT round(avg(s), 5) AS x FROM (SELECT epoch, sum(abs(x)) AS s FROM c GROUP BY epoch) q")
def mean_trace(spark, d):
    cube = event_cube(spark, d)
    covariance = cube.groupBy("epoch", F.col("time").alias("i"), F.col("time").alias("j")).agg((F.sum(F.col("x") * F.col("x")) / 5).alias("x"))
    return moments.mean_trace(covariance, "i", "j", ["epoch"]).withColumn("x", F.round("x", 5))


_SHRUNK = "k AS (SELECT time, epoch FROM cube GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT ch) FROM cube)), f AS (SELECT cube.* FROM cube JOIN k USING (time, epoch)), m AS (SELECT ch, avg(x) AS mu FROM f GROUP BY ch), c AS (SELECT f.time, f.epoch, ch, x - mu AS x FROM f JOIN m USING (ch)), p AS (SELECT a.ch AS i, b.ch AS j, count(*) AS t, avg(a.x * b.x) AS s, avg(a.x * b.x * a.x * b.x) AS q FROM c a JOIN c b USING (time, epoch) GROUP BY 1, 2), w AS (SELECT greatest(0, least(1, sum(CASE WHEN i <> j THEN q - s * s ELSE 0 END) / nullif(sum(CASE WHEN i <> j THEN s * s ELSE 0 END), 0) / max(t))) AS shrinkage FROM p)"


@query(f"WITH {CUBE}, {_SHRUNK} SELECT i, j, round(CASE WHEN i = j THEN s ELSE (1 - shrinkage) * s END, 3) AS x, round(shrinkage, 5) AS shrinkage FROM p, w")
def shrunk_covariance(spark, d):
    found = moments.shrunk_to_diagonal(event_cube(spark, d))
    return found.select("i", "j", F.round("x", 3).alias("x"), F.round("shrinkage", 5).alias("shrinkage"))


_ROBUST = "f AS (SELECT ch, epoch, avg(x * x) AS x FROM cube GROUP BY 1, 2), b AS (SELECT ch, median(x) + 4.0 * sqrt(var_pop(x) + power(avg(x) - median(x), 2)) AS top FROM f GROUP BY ch), r AS (SELECT ch, avg(x) AS x, count(*) AS n FROM f JOIN b USING (ch) WHERE x <= top GROUP BY ch)"


@query(f"WITH {CUBE}, {_ROBUST} SELECT ch, round(x, 4) AS x, n, round(0.1 * x, 4) AS scale FROM r")
def robust_variance(spark, d):
    powers = statistics.reduced(event_cube(spark, d), ["time"], "power")
    return moments.robust_variance(powers, ["ch"]).select("ch", F.round("x", 4).alias("x"), "n", F.round(0.1 * F.col("x"), 4).alias("scale"))


@query(f"WITH {CUBE}, d AS (SELECT a.ch, a.time, a.epoch, a.x - b.x AS d FROM cube a JOIN cube b ON a.ch = b.ch AND a.epoch = b.epoch AND b.time = a.time - 1), r AS (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY abs(d), time, epoch) AS r FROM d WHERE abs(d) > 0), s AS (SELECT ch, abs(sum(sign(d) * r)) AS w, count(*) AS n FROM r GROUP BY ch) SELECT ch, CAST(w AS DOUBLE) AS w, n, round((w - 0.5) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 6), 6) AS z FROM s")
def signed_ranks(spark, d):
    cube = event_cube(spark, d)
    before = cube.withColumn("time", F.col("time") + 1).withColumnRenamed("x", "_b")
    found = moments.signed_ranks(cube.join(before, ["ch", "time", "epoch"]), ["ch"], F.col("x") - F.col("_b"), ["time", "epoch"])
    return found.withColumn("z", F.round("z", 6))


_BOUNDS = ["f0 AS (SELECT ch, epoch, stddev_pop(x) AS x FROM cube GROUP BY 1, 2), b0 AS (SELECT DISTINCT ch, CAST('inf' AS DOUBLE) AS top FROM f0)"] + [f"b{k} AS (SELECT ch, least(max(top), median(CASE WHEN x <= top THEN x END) + 1.5 * sqrt(var_pop(CASE WHEN x <= top THEN x END) + power(avg(CASE WHEN x <= top THEN x END) - median(CASE WHEN x <= top THEN x END), 2))) AS top FROM f0 JOIN b{k - 1} USING (ch) GROUP BY ch)" for k in (1, 2, 3)]


@query(f"WITH {CUBE}, {', '.join(_BOUNDS)} SELECT ch, epoch, round(x, 6) AS x, x > top AS bad FROM f0 JOIN b3 USING (ch)")
def mark_outliers_three_rounds(spark, d):
    return _rounded(statistics.outliers(statistics.reduced(event_cube(spark, d), ["time"], "std"), ["ch"], 1.5, 3))


# Transforms.

_FOURIER = "f AS (SELECT ch, epoch, CAST(k AS INT) AS k, sum(x * cos(-2 * pi() * k * time / 30)) AS re, sum(x * sin(-2 * pi() * k * time / 30)) AS im FROM z, range(16) s(k) GROUP BY 1, 2, 3)"
_BACK = "sum((CASE WHEN k IN (0, 15) THEN 1 ELSE 2 END) * (re * cos(2 * pi() * k * t / 30) - im * sin(2 * pi() * k * t / 30))) / 30"


@query(f"WITH {SERIES}, {_FOURIER} SELECT ch, epoch, k, round(re, 4) + 0 AS re, round(im, 4) + 0 AS im FROM f")
def full_transform(spark, d):
    return fourier.transform(_series(spark, d), "time", 30).withColumns({c: F.round(c, 4) + 0 for c in ("re", "im")})


@query(f"WITH {SERIES}, e AS (SELECT DISTINCT ch, epoch FROM z), g AS (SELECT ch, epoch, t AS time FROM e, range(30) s(t)) SELECT ch, epoch, CAST(time AS BIGINT) AS time, round(coalesce(x, 0), 4) + 0 AS x FROM g LEFT JOIN z USING (ch, epoch, time)")
def inverse_transform(spark, d):
    back = fourier.inverse(fourier.transform(_series(spark, d), "time", 30), "time", 30)
    return back.select("ch", "epoch", F.col("time").cast("long").alias("time"), (F.round("x", 4) + 0).alias("x"))


@query(f"WITH {SERIES}, {_FOURIER} SELECT ch, epoch, CAST(t AS BIGINT) AS time, round({_BACK.replace('re *', 'gain * re *').replace('im *', 'gain * im *')}, 4) + 0 AS x FROM (SELECT *, CASE WHEN k BETWEEN 2 AND 5 THEN 1 ELSE 0 END AS gain FROM f) q, range(30) s(t) GROUP BY 1, 2, 3")
def band_filtered(spark, d):
    gain = F.when(F.col("k").between(2, 5), 1.0).otherwise(0.0)
    found = fourier.filtered(_series(spark, d), "time", 30, gain)
    return found.select("ch", "epoch", F.col("time").cast("long").alias("time"), (F.round("x", 4) + 0).alias("x"))


@query(f"WITH {SERIES}, {_FOURIER}, h AS (SELECT f.*, band, CASE WHEN k BETWEEN lo AND hi THEN 1 ELSE 0 END AS gain FROM f, (VALUES ('slow', 0, 3), ('fast', 8, 15)) b(band, lo, hi)) SELECT ch, epoch, band, CAST(t AS BIGINT) AS time, round({_BACK.replace('re *', 'gain * re *').replace('im *', 'gain * im *')}, 4) + 0 AS x FROM h, range(30) s(t) GROUP BY 1, 2, 3, 4")
def filter_bank(spark, d):
    bands = {n: F.when(F.col("k").between(lo, hi), 1.0).otherwise(0.0) for n, lo, hi in (("slow", 0, 3), ("fast", 8, 15))}
    found = fourier.filter_bank(_series(spark, d), "time", 30, bands)
    return found.select("ch", "epoch", "band", F.col("time").cast("long").alias("time"), (F.round("x", 4) + 0).alias("x"))


@query(f"WITH {SERIES}, w AS (SELECT ch, epoch, x, time, unnest(range(CAST(floor((time - 8) / 4.0) + 1 AS BIGINT), CAST(floor(time / 4.0) AS BIGINT) + 1)) * 4 AS win FROM z), f AS (SELECT ch, epoch, win, CAST(k AS INT) AS k, sum(x * (1 + (time - win) % 3) * cos(-2 * pi() * k * (time - win) / 8)) AS re, sum(x * (1 + (time - win) % 3) * sin(-2 * pi() * k * (time - win) / 8)) AS im FROM w, range(5) s(k) GROUP BY 1, 2, 3, 4) SELECT ch, epoch, CAST(win AS BIGINT) AS \"window\", k, round(sqrt(re * re + im * im) * sqrt(2) / 15, 4) AS x FROM f")
def spectrogram(spark, d):
    found = fourier.spectrogram(_series(spark, d), "time", 8, 4, 1 + F.col("_i") % 3, 15)
    return found.select("ch", "epoch", F.col("window").cast("long").alias("window"), "k", F.round("x", 4).alias("x"))


@query(f"WITH {SERIES}, {_FOURIER}, m AS (SELECT k, avg(sqrt(re * re + im * im)) AS m FROM f GROUP BY k) SELECT ch, epoch, k, round(re / m, 5) + 0 AS re, round(im / m, 5) + 0 AS im FROM f JOIN m USING (k)")
def flattened_spectrum(spark, d):
    return fourier.flattened(fourier.transform(_series(spark, d), "time", 30)).withColumns({c: F.round(c, 5) + 0 for c in ("re", "im")})


# Labels, folds and decisions.


@query(f"WITH {FEATURES}, m AS (SELECT label AS class, feat, avg(x) AS mu FROM feats GROUP BY 1, 2), q AS (SELECT epoch, class, round(sum(x * mu), 5) AS s FROM feats JOIN m USING (feat) GROUP BY 1, 2) SELECT epoch, class AS label FROM (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY s DESC, class) AS r FROM q) t WHERE r = 1")
def label_of_largest(spark, d):
    rows = feature_rows(spark, d)
    means = rows.groupBy(F.col("label").alias("sub_problem"), "feat").agg(F.avg("x").alias("mu"))
    scored = rows.join(means, "feat").groupBy("epoch", "sub_problem").agg(F.round(F.sum(F.col("x") * F.col("mu")), 5).alias("y"))
    return decisions.labelled(scored, ["epoch"])


@query("SELECT vec_id, CASE WHEN label IN (0, 3) THEN 1 WHEN label IN (1, 2, 7) THEN 2 ELSE 0 END AS class FROM embeddings")
def class_index(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", decisions.class_index(F.col("label"), [[0, 3], [1, 2, 7]]).alias("class"))


@query("SELECT vec_id, p AS sub_problem, y FROM (SELECT vec_id, 'low' AS p, CASE WHEN label IN (0, 1, 2) THEN 1 WHEN label IN (7, 8, 9) THEN -1 END AS y FROM embeddings UNION ALL SELECT vec_id, 'even', CASE WHEN label IN (0, 2, 4, 6, 8) THEN 1 WHEN label IN (1, 3, 5, 7, 9) THEN -1 END FROM embeddings) q WHERE y IS NOT NULL")
def sub_problem_rows(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label")
    problems = {"low": ([0, 1, 2], [7, 8, 9]), "even": ([0, 2, 4, 6, 8], [1, 3, 5, 7, 9])}
    return decisions.sub_problems(rows, "label", problems).select("vec_id", "sub_problem", "y")


@query("SELECT vec_id, CAST(vec_id AS VARCHAR) AS fold FROM embeddings")
def leave_one_out(spark, d):
    return decisions.leave_one_out(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id"), ["vec_id"])


@query("SELECT vec_id, CAST(k AS INT) AS in_fold, CASE WHEN label IS NULL THEN 0 WHEN vec_id % 4 = k THEN 1 ELSE -1 END AS f FROM embeddings, range(4) s(k)")
def fold_signs(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.when(F.col("label").isNotNull(), F.col("vec_id") % 4).alias("fold"))
    return decisions.fold_signs(rows, "fold", 4).select("vec_id", "in_fold", "f")


@query(f"WITH {CUBE} SELECT ch, time, epoch, CAST(epoch % 3 + 3 * (time % 2) AS BIGINT) AS fold FROM cube")
def two_way_folds(spark, d):
    fold = decisions.two_way_folds(F.col("epoch") % 3, F.col("time") % 2, 3).cast("long")
    return event_cube(spark, d).select("ch", "time", "epoch", fold.alias("fold"))


_VALUES = "v AS (SELECT epoch, 'p' || feat AS sub_problem, feat, y, x AS dv FROM feats WHERE feat < 3)"


def _values(spark, d):
    return feature_rows(spark, d).where("feat < 3").select("epoch", F.concat(F.lit("p"), "feat").alias("sub_problem"), "feat", "y", F.col("x").alias("dv"))


_CODES = "('p0', 'a', 1.0), ('p1', 'a', -1.0), ('p0', 'b', -1.0), ('p2', 'b', 1.0), ('p1', 'c', 1.0), ('p2', 'c', -1.0)"


@query(f"WITH {FEATURES}, {_VALUES}, c(sub_problem, class, w) AS (VALUES {_CODES}), s AS (SELECT epoch, class, sum(dv * w) AS score FROM v JOIN c USING (sub_problem) GROUP BY 1, 2) SELECT epoch, class AS pred, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY score DESC, class) AS r FROM s) q WHERE r = 1")
def decoded_classes(spark, d):
    codes = spark.sql(f"SELECT sub_problem, class, CAST(w AS DOUBLE) AS w FROM VALUES {_CODES} AS t(sub_problem, class, w)")
    return decisions.decoded(_values(spark, d), codes, ["epoch"]).withColumn("score", F.round("score", 5))


@query(f"WITH {FEATURES}, {_VALUES}, w AS (SELECT epoch, CASE WHEN dv > 0 THEN feat ELSE (feat + 1) % 3 END AS class FROM v), n AS (SELECT epoch, class, count(*) AS votes FROM w GROUP BY 1, 2) SELECT epoch, class AS pred, votes FROM (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY votes DESC, class) AS r FROM n) q WHERE r = 1")
def pairwise_votes(spark, d):
    pairs = _values(spark, d).select("epoch", F.col("feat").alias("first"), ((F.col("feat") + 1) % 3).alias("second"), "dv")
    return decisions.voted(pairs, ["epoch"])


@query(f"WITH {FEATURES}, {_VALUES}, t AS (SELECT vec_id AS epoch, s.c AS sub_problem, CASE WHEN label IS NULL THEN 0 WHEN CAST(label AS VARCHAR) = s.c THEN 1 ELSE -1 END AS y FROM embeddings, (VALUES ('0'), ('1')) s(c)) SELECT v.sub_problem AS classifier, t.sub_problem, round(avg(CASE WHEN sign(dv) = sign(t.y) THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM t JOIN v USING (epoch) WHERE t.y <> 0 GROUP BY 1, 2")
def problem_losses(spark, d):
    from .functions.scores import indicators

    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("epoch"), "label")
    targets = indicators(rows, "label", [0, 1]).select("epoch", "sub_problem", "y")
    values = _values(spark, d).select("epoch", F.col("sub_problem").alias("classifier"), "dv")
    return decisions.problem_losses(targets, values, ["epoch"]).withColumn("rate", F.round("rate", 6))


@query(f"WITH {FEATURES}, {_VALUES}, s(feat, sequence, w) AS (VALUES (0, 'up', 1.0), (1, 'up', 2.0), (2, 'up', 3.0), (0, 'down', -1.0), (2, 'down', 1.0)) SELECT epoch, y, sequence, round(sum(dv * w), 5) AS dv FROM v JOIN s USING (feat) GROUP BY 1, 2, 3")
def sequence_values(spark, d):
    sequences = spark.sql("SELECT feat, sequence, CAST(w AS DOUBLE) AS w FROM VALUES (0, 'up', 1.0), (1, 'up', 2.0), (2, 'up', 3.0), (0, 'down', -1.0), (2, 'down', 1.0) AS t(feat, sequence, w)")
    values = _values(spark, d).select("epoch", "y", "feat", "dv")
    return decisions.sequence_values(values, sequences, "feat").withColumn("dv", F.round("dv", 5))


for _centred, _mean in ((False, "my"), (True, "me")):

    @query(f"WITH {FEATURES}, m AS (SELECT feat, avg(y) AS my, avg(x) AS me FROM feats GROUP BY feat) SELECT feat, round(sum((y - my) * (x - {_mean})) / nullif(sqrt(sum((y - my) * (y - my)) * sum((x - {_mean}) * (x - {_mean}))), 0), 6) AS corr FROM feats JOIN m USING (feat) GROUP BY feat")
    def _corr(spark, d, centred=_centred):
        return _rounded(decisions.correlation(feature_rows(spark, d), "y", "x", ["feat"], centred), "corr")

    _n = "centred_correlation" if _centred else "correlation"
    QUERIES[_n], ORACLES[_n] = QUERIES.pop("_corr"), ORACLES.pop("_corr")


@query(f"WITH {FEATURES} SELECT feat, round(avg(x), 6) AS dv FROM feats WHERE y <> 0 GROUP BY feat")
def average_value(spark, d):
    return _rounded(decisions.average_value(feature_rows(spark, d), "y", "x", ["feat"]), "dv")


@query(f"WITH {FEATURES}, c AS (SELECT feat, x AS v, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN y < 0 THEN 1 ELSE 0 END) AS q FROM feats GROUP BY 1, 2), e AS (SELECT feat, v, sum(p) OVER w + sum(q) OVER (PARTITION BY feat) - sum(q) OVER w AS e, lead(v) OVER w AS n FROM c WINDOW w AS (PARTITION BY feat ORDER BY v)) SELECT feat, round(-(v + n) / 2, 6) AS \"offset\", CAST(e AS BIGINT) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY feat ORDER BY e, v) AS r FROM e WHERE n IS NOT NULL) q WHERE r = 1")
def best_offset(spark, d):
    return _rounded(decisions.best_offset(feature_rows(spark, d), "y", "x", ["feat"]), "offset")


@query(f"WITH {FEATURES}, m AS (SELECT feat, avg(CASE WHEN y > 0 THEN x END) AS p, avg(CASE WHEN y < 0 THEN x END) AS n FROM feats GROUP BY feat) SELECT epoch, y, round(sum((p - n) * (x - (p + n) / 2)), 5) AS dv FROM feats JOIN m USING (feat) GROUP BY 1, 2")
def prototype_values(spark, d):
    return decisions.prototype_values(feature_rows(spark, d), "epoch", "y").withColumn("dv", F.round("dv", 5))


@query(f"WITH {FEATURES}, l AS (SELECT epoch % 5 AS fold, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS rate, avg(x) AS mean_value FROM feats GROUP BY 1), u AS (SELECT 'rate' AS measure, CAST(rate AS DOUBLE) AS v FROM l UNION ALL SELECT 'mean_value', mean_value FROM l) SELECT measure, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS se, count(v) AS folds FROM u GROUP BY measure")
def fold_summary(spark, d):
    losses = feature_rows(spark, d).groupBy((F.col("epoch") % 5).alias("fold")).agg(F.avg((F.col("x") > 0).cast("double")).alias("rate"), F.avg("x").alias("mean_value"))
    return _rounded(decisions.fold_summary(losses, ["rate", "mean_value"]), "mean", "se")


_Z = decisions._normal_quantile(0.975)


@query(f"WITH {FEATURES}, s AS (SELECT feat, count(*) AS n, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS p, corr(x, y) AS r FROM feats GROUP BY feat) SELECT feat, round(sqrt(ln(2 / 0.05) / (2 * 0.25 * n)) / 3, 6) AS auc, round({_Z} * sqrt(((p * n + 2) / (n + 4)) * (1 - (p * n + 2) / (n + 4)) / (n + 4)), 6) AS rate, round(atanh(r) + 1.96 / sqrt(n - 3), 6) AS above, round(atanh(r) - 1.96 / sqrt(n - 3), 6) AS below FROM s")
def confidence_widths(spark, d):
    s = feature_rows(spark, d).groupBy("feat").agg(F.count("*").alias("n"), F.avg((F.col("x") > 0).cast("double")).alias("p"), F.corr("x", "y").alias("r"))
    above, below = decisions.correlation_bounds(F.col("n"), F.col("r"))
    found = s.select("feat", decisions.auc_width(F.col("n")).alias("auc"), decisions.binomial_width(F.col("n"), F.col("p")).alias("rate"), above.alias("above"), below.alias("below"))
    return _rounded(found, "auc", "rate", "above", "below")


@query("SELECT doc_id, quality, CAST(row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS INT) AS rank FROM labels")
def shuffled_rank(spark, d):
    return decisions.shuffled_rank(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), ["quality"], F.col("doc_id"))


_MAHALANOBIS = "m AS (SELECT label AS class, feat, avg(x) AS mu FROM feats GROUP BY 1, 2), s AS (SELECT feat, var_pop(x) AS v FROM feats GROUP BY feat)"


@query(f"WITH {FEATURES}, {_MAHALANOBIS} SELECT epoch, class, round(sqrt(sum((x - mu) * (x - mu))), 5) AS euclid, round(sum((x - mu) * (x - mu) / v), 4) AS scaled, round(0.5 * sum(x * mu) + 0.5 * power(sum(x * mu) + 1, 2), 4) AS mixed FROM feats JOIN m USING (feat) JOIN s USING (feat) GROUP BY 1, 2")
def distances_and_mixed_kernel(spark, d):
    from .functions import kernels

    rows = feature_rows(spark, d).select("epoch", "feat", "x", "label")
    means = rows.groupBy(F.col("label").alias("class"), "feat").agg(F.avg("x").alias("x"))
    plain = rows.select("epoch", "feat", "x")
    scale = plain.groupBy("feat").agg(F.var_pop("x").alias("v"))
    by = lambda r: r.join(scale, "feat").withColumn("x", F.col("x") / F.sqrt("v")).drop("v")
    euclid = kernels.square_distances(plain, means).select("epoch", "class", F.round(F.sqrt("x"), 5).alias("euclid"))
    scaled = kernels.square_distances(by(plain), by(means)).select("epoch", "class", F.round("x", 4).alias("scaled"))
    mixed = kernels.mixed(plain, means, {"linear": 0.5, "poly": 0.5}).select("epoch", "class", F.round("x", 4).alias("mixed"))
    keys = [F.col("a.epoch").eqNullSafe(F.col("b.epoch")), F.col("a.class").eqNullSafe(F.col("b.class"))]
    two = euclid.alias("a").join(scaled.alias("b"), keys).select("a.epoch", "a.class", "euclid", "scaled")
    return two.alias("a").join(mixed.alias("b"), keys).select("a.epoch", "a.class", "euclid", "scaled", "mixed")


# Records.


def _records(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select("event_id", F.struct("event_type", F.round("value", 4).alias("value")).alias("what"), F.struct(F.struct("user_id").alias("user")).alias("who"))


@query("SELECT event_id, event_type, round(value, 4) * 2 AS value, user_id FROM events")
def set_field(spark, d):
    changed = records.set_field(_records(spark, d), "what.value", F.col("what.value") * 2)
    return changed.select("event_id", "what.event_type", "what.value", "who.user.user_id")


@query("SELECT event_id, 'what.event_type' AS field, event_type AS value FROM events WHERE event_type IS NOT NULL UNION ALL SELECT event_id, 'who.user.user_id', CAST(user_id AS VARCHAR) FROM events WHERE user_id IS NOT NULL")
def flattened_fields(spark, d):
    return records.flattened(_records(spark, d).withColumn("what", F.struct("what.event_type")), ["event_id"])


@query("SELECT event_id, event_type, CASE WHEN user_id % 2 = 0 THEN 0.0 ELSE round(value, 4) END AS value, user_id % 3 AS extra FROM events")
def merged_records(spark, d):
    rows = _records(spark, d).withColumn("other", F.struct(F.when(F.col("who.user.user_id") % 2 == 0, 0.0).alias("value"), (F.col("who.user.user_id") % 3).alias("extra")))
    return records.merged(rows, "what", "other").select("event_id", "what.event_type", "what.value", "what.extra")


# Made data.


@query(f"WITH {CUBE} SELECT ch, time, epoch, round(x + sin({2 * pi} * 10 * time / 100.0) * length(ch) * (CASE WHEN epoch % 2 = 0 THEN 1 ELSE -1 END) + exp(-power((time - 19740) / 20.0, 2) / 2), 6) AS x FROM cube")
def made_cube(spark, d):
    # A made signal on top of what was recorded.
    from .sources.made import mixed, peak, sine

    side = F.when(F.col("epoch") % 2 == 0, 1).otherwise(-1)
    return _rounded(mixed(event_cube(spark, d), sine(10, 100) * F.length("ch") * side + peak(19740, 20)))


# Labels along dimensions, epochs and references.


@query(f"WITH {CUBE}, y AS (SELECT DISTINCT epoch, CASE WHEN epoch % 2 = 0 THEN 1 ELSE -1 END AS y FROM cube), t AS (SELECT DISTINCT time FROM cube) SELECT epoch, time, CASE WHEN time % 7 = 0 THEN 0 ELSE y END AS y FROM y, t")
def labels_along_time(spark, d):
    cube = event_cube(spark, d)
    labels = cube.select("epoch").distinct().withColumn("y", F.when(F.col("epoch") % 2 == 0, 1).otherwise(-1))
    return decisions.labels_along(labels, cube.select("time").distinct(), F.col("time") % 7 == 0)


@query("SELECT vec_id, 'b' || CAST(k AS VARCHAR) AS sub_problem, CASE WHEN vec_id % 3 = k THEN CASE WHEN label % 2 = 0 THEN 1 ELSE -1 END ELSE 0 END AS y FROM embeddings, range(3) s(k) WHERE label IS NOT NULL")
def block_sub_problems(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").where("label is not null").select("vec_id", F.concat(F.lit("b"), F.col("vec_id") % 3).alias("block"), F.when(F.col("label") % 2 == 0, 1).otherwise(-1).alias("y"))
    return decisions.block_sub_problems(rows, "block", "y").select("vec_id", "sub_problem", "y")


@query(f"WITH {SERIES}, b AS (SELECT ch, epoch, time // 7 AS bin, median(x) AS mid, arg_max(x, abs(x)) AS far FROM z GROUP BY 1, 2, 3) SELECT ch, epoch, CAST(bin AS BIGINT) AS bin, round(mid, 6) AS mid, round(far, 6) AS far FROM b")
def label_bins(spark, d):
    return _rounded(decisions.binned_labels(_series(spark, d), "time", 7).withColumn("bin", F.col("bin").cast("long")), "mid", "far")


@query(f"WITH {CUBE}, e(name, lo, hi) AS (VALUES ('early', 19700, 19740), ('late', 19735, 19900)) SELECT name, ch, count(*) AS n, round(sum(x), 6) AS x FROM cube JOIN e ON time >= lo AND time < hi GROUP BY 1, 2")
def given_epochs(spark, d):
    from .operators.windows import given_epochs as cut

    spans = spark.sql("SELECT * FROM VALUES ('early', 19700, 19740), ('late', 19735, 19900) AS t(name, lo, hi)")
    return cut(event_cube(spark, d), spans, "time").groupBy("name", "ch").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("x"))


@query(f"WITH {CUBE} SELECT ch, epoch, CAST(floor(time / 10.0) * 10 AS BIGINT) AS \"window\", count(*) AS n, round(sum(x * (0.54 - 0.46 * cos(2 * pi() * (time - floor(time / 10.0) * 10) / 9))), 5) AS x FROM cube GROUP BY 1, 2, 3")
def tapered_windows(spark, d):
    from .operators.windows import sliding

    place = F.col("time") - F.col("window")
    cut = sliding(event_cube(spark, d), "time", 10, 10).withColumn("x", F.col("x") * (0.54 - 0.46 * F.cos(2 * pi * place / 9)))
    return cut.groupBy("ch", "epoch", F.col("window").cast("long").alias("window")).agg(F.count("*").alias("n"), F.round(F.sum("x"), 5).alias("x"))


@query(f"WITH {CUBE} SELECT ch, time, epoch, round(x - median(x) OVER (PARTITION BY time, epoch), 6) AS x FROM cube")
def rereference_median(spark, d):
    return _rounded(statistics.rereference_by(event_cube(spark, d), ["time", "epoch"], "median"))


@query(f"WITH {CUBE}, r AS (SELECT time, epoch, x AS ref FROM cube WHERE ch = 'click') SELECT ch, time, epoch, round(x - coalesce(ref, 0), 6) AS x FROM cube LEFT JOIN r USING (time, epoch)")
def rereference_named(spark, d):
    return _rounded(statistics.rereference(event_cube(spark, d), "ch", F.col("ch") == "click"))


_ARTEFACT = "a AS (SELECT time, epoch, x AS a FROM cube WHERE ch = 'error'), b AS (SELECT ch, epoch, sum(x * a) / nullif(sum(a * a), 0) AS b FROM cube JOIN a USING (time, epoch) WHERE ch <> 'error' GROUP BY 1, 2)"


@query(f"WITH {CUBE}, {_ARTEFACT} SELECT ch, time, epoch, round(x - coalesce(b * a, 0), 5) AS x FROM cube LEFT JOIN a USING (time, epoch) LEFT JOIN b USING (ch, epoch) WHERE ch <> 'error'")
def without_artefact(spark, d):
    return statistics.regressed_out(event_cube(spark, d), "error").withColumn("x", F.round("x", 5))


@query(f"WITH {CUBE}, w AS (SELECT ch, avg(abs(x)) / max(abs(x)) AS w FROM cube GROUP BY ch), s AS (SELECT time, epoch, sum(x * w) AS s FROM cube JOIN w USING (ch) GROUP BY 1, 2) SELECT epoch, round(avg(s * s), 4) AS x FROM s GROUP BY epoch")
def filtered_power(spark, d):
    cube = event_cube(spark, d)
    weight = cube.groupBy("ch").agg((F.avg(F.abs("x")) / F.max(F.abs("x"))).alias("x"))
    power = statistics.reduced(tensor.contract(cube, weight, ["ch"]), ["time"], "power")
    return power.withColumn("x", F.round("x", 4))


@query(f"WITH {CUBE}, c AS (SELECT a.ch AS i, b.ch AS j, sum(a.x * b.x) AS x FROM cube a JOIN cube b USING (time, epoch) GROUP BY 1, 2), w AS (SELECT ch, count(*) / 1000.0 AS w FROM cube GROUP BY ch) SELECT round(sum(x * CAST(a.w AS DOUBLE) * CAST(b.w AS DOUBLE)), 3) AS x FROM c JOIN w a ON a.ch = i JOIN w b ON b.ch = j")
def quadratic_form(spark, d):
    cube = event_cube(spark, d)
    sums = tensor.contract(cube.withColumnRenamed("ch", "i"), cube.withColumnRenamed("ch", "j"), ["time", "epoch"])
    weight = cube.groupBy("ch").agg((F.count("*") / 1000.0).alias("x"))
    once = tensor.contract(sums, weight.withColumnRenamed("ch", "i"), ["i"])
    return tensor.contract(once, weight.withColumnRenamed("ch", "j"), ["j"]).withColumn("x", F.round("x", 3))


@query(f"WITH {CUBE}, g AS (SELECT CAST(k AS INT) AS lag, a.ch AS i, b.ch AS j, sum(a.x * b.x) AS x FROM (SELECT * FROM cube, (VALUES (0), (1), (2)) s(k)) a JOIN cube b ON a.epoch = b.epoch AND b.time = a.time + a.k GROUP BY 1, 2, 3) SELECT p AS lag_i, q AS lag_j, CASE WHEN q >= p THEN i ELSE j END AS i, CASE WHEN q >= p THEN j ELSE i END AS j, round(x, 6) AS x FROM (SELECT CAST(p AS INT) AS p, CAST(q AS INT) AS q FROM range(3) a(p), range(3) b(q)) t JOIN g ON lag = abs(p - q)")
def lagged_blocks(spark, d):
    from .operators.moments import lag_blocks, lagged_covariance

    sums = lagged_covariance(event_cube(spark, d), [0, 1, 2]).groupBy("lag", "i", "j").agg(F.sum("x").alias("x"))
    return lag_blocks(sums, 3).withColumn("x", F.round("x", 6))


@query(f"WITH {CUBE} SELECT 'ch' AS dim, epoch, a.ch AS i, b.ch AS j, round(sum(a.x * b.x), 6) AS x FROM cube a JOIN cube b USING (epoch, time) GROUP BY 2, 3, 4 UNION ALL SELECT 'time', epoch, CAST(a.time AS VARCHAR), CAST(b.time AS VARCHAR), round(sum(a.x * b.x), 6) FROM cube a JOIN cube b USING (epoch, ch) WHERE abs(a.time - b.time) <= 1 GROUP BY 2, 3, 4")
def covariance_by_dimension(spark, d):
    cube = event_cube(spark, d)
    over = moments.products_by_dimension(cube, ["ch", "time"], ["epoch"]).withColumn("x", F.round("x", 6))
    # Times that are near each other, as far as the query is asked.
    return over.where((F.col("dim") == "ch") | (F.abs(F.col("i").try_cast("long") - F.col("j").try_cast("long")) <= 1))


@query(f"WITH {LANDMARKS} SELECT a.class AS class, b.class AS class2, round(sum(a.mu * b.mu), 6) AS x FROM z a JOIN z b USING (feat) GROUP BY 1, 2")
def landmark_kernel(spark, d):
    from .functions import kernels

    means = _class_means(spark, d)
    return _rounded(kernels.kernel(means, means.withColumnRenamed("class", "class2")))


@query("SELECT vec_id, label, 1 AS y FROM embeddings WHERE label = 0 UNION ALL SELECT vec_id, label, -1 FROM embeddings WHERE label = 1 UNION ALL SELECT vec_id, label, s.y FROM embeddings, (VALUES (1), (-1)) s(y) WHERE label > 1")
def universum(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label")
    return decisions.with_universum(rows, "label", [0], [1]).select("vec_id", "label", "y")


# Decompositions, held against what they must give.

_IDENTITY = "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS x FROM range({n}) a(i), range({n}) b(j)"


def _small_vectors(spark, d):
    from .queries import _vectors

    return _vectors(spark, d).withColumn("v", F.slice(F.col("v").cast("array<double>"), 1, 8))


def _moment_rows(rows):
    wide = rows.select(F.posexplode("v").alias("i", "_a"), "v").select("i", "_a", F.posexplode("v").alias("j", "_b"))
    return wide.groupBy("i", "j").agg((F.round(F.sum(F.col("_a") * F.col("_b")), 6) + 0).alias("x"))


@query(_IDENTITY.format(n=8))
def whitened_covariance(spark, d):
    from .operators import spatial

    rows = _small_vectors(spark, d).withColumn("all", F.lit(0))
    weights = spatial.whitener(sum(spatial.second_moments(rows, "all", "v", 8).values()))
    return _moment_rows(rows.select(spatial.project("v", weights).alias("v")))


@query(_IDENTITY.format(n=4))
def pattern_covariance(spark, d):
    from .operators import spatial

    rows = _small_vectors(spark, d)
    sums = spatial.second_moments(rows, "side", "v", 8)
    return _moment_rows(rows.select(spatial.project("v", spatial.common_patterns(sums[1], sums[0], 2)).alias("v")))


_RIDGE = "r AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CASE WHEN label % 2 = 0 THEN 1.0 ELSE -1.0 END AS y, vec_id % 5 AS fold FROM embeddings WHERE label IS NOT NULL), s AS (SELECT f.fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM (SELECT DISTINCT fold FROM r) f JOIN r ON r.fold <> f.fold GROUP BY 1), w AS (SELECT fold, (sxy - sx * sy / n) / (sxx - sx * sx / n + 1) AS b, sx / n AS mx, sy / n AS my FROM s), v AS (SELECT vec_id, r.fold, y, my + b * (x - mx) AS dv FROM r JOIN w USING (fold))"


def _ridge_values(spark, d):
    from .operators import spatial

    rows = _small_vectors(spark, d).withColumn("v", F.slice("v", 1, 1))
    weights = spatial.ridge_folds(rows, "fold", "v", "y", 1, 1.0)
    return spatial.decision_values(rows, "fold", "v", weights)


@query(f"WITH {_RIDGE} SELECT vec_id, CAST(fold AS BIGINT) AS fold, CAST(y AS DOUBLE) AS y, round(CAST(dv AS DOUBLE), 8) AS dv FROM v")
def ridge_one_feature(spark, d):
    return _ridge_values(spark, d).select("vec_id", "fold", "y", F.round("dv", 8).alias("dv"))


@query(f"WITH {_RIDGE} SELECT CAST(fold AS BIGINT) AS fold, round(avg(CASE WHEN (dv > 0) = (y > 0) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM v GROUP BY fold")
def cross_validated_rate(spark, d):
    from .functions.scores import binary_losses

    return binary_losses(_ridge_values(spark, d), "y", "dv", ["fold"]).select("fold", F.round("rate", 6).alias("rate"))
