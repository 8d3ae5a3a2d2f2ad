"""Queries of recursive filters, long transforms, responses, blocks, robust and wide decompositions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import recursive
from .queries import ORACLES, QUERIES, _rounded, query


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


_SERIES = "e AS (SELECT user_id, event_id, ts, value AS x, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(f"WITH RECURSIVE {_SERIES}, r AS (SELECT user_id, i, event_id, ts, x, 0.2 * x AS y, 0.0::DOUBLE AS y1, 0.0::DOUBLE AS x1 FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.event_id, e.ts, e.x, 0.2 * e.x + 0.3 * r.x + 0.1 * r.x1 + 0.9 * r.y - 0.4 * r.y1, r.y, r.x FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, ts, event_id, round(y, 6) AS x FROM r")
def recursive_filter(spark, d):
    rows = _events(spark, d).select("user_id", "ts", "event_id", F.col("value").alias("x"))
    return _rounded(recursive.filtered(rows, ["user_id"], ["ts", "event_id"], recursive.equation([0.2, 0.3, 0.1], [1.0, -0.9, 0.4])))


@query("WITH RECURSIVE e AS (SELECT event_id, ts, value AS x, row_number() OVER (ORDER BY ts, event_id) AS i FROM events), r AS (SELECT i, event_id, ts, x, 0.25 * x AS y FROM e WHERE i = 1 UNION ALL SELECT e.i, e.event_id, e.ts, e.x, 0.25 * e.x + 0.25 * r.x + 0.5 * r.y FROM r JOIN e ON e.i = r.i + 1) SELECT ts, event_id, round(y, 6) AS x FROM r")
def recursive_filter_one_series(spark, d):
    # All events are one series: no key to deal them by.
    rows = _events(spark, d).select("ts", "event_id", F.col("value").alias("x"))
    return _rounded(recursive.filtered(rows, [], ["ts", "event_id"], recursive.equation([0.25, 0.25], [1.0, -0.5])))


_SEGMENTS = f"{_SERIES}, g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS s FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, s ORDER BY i) AS k FROM g)"


@query(f"WITH RECURSIVE {_SEGMENTS}, r AS (SELECT user_id, s, k, event_id, ts, x, 0.1 * x AS m, 0.1::DOUBLE AS w FROM n WHERE k = 1 UNION ALL SELECT n.user_id, n.s, n.k, n.event_id, n.ts, n.x, 0.9 * r.m + 0.1 * n.x, 0.9 * r.w + 0.1 FROM r JOIN n ON n.user_id = r.user_id AND n.s = r.s AND n.k = r.k + 1) SELECT user_id, ts, event_id, round(x - m / w, 6) + 0 AS x FROM r")
def less_exponential_mean(spark, d):
    rows = _events(spark, d).select("user_id", "ts", "event_id", F.col("value").alias("x"), "event_type")
    found = _rounded(recursive.less_exponential_mean(rows, ["user_id"], ["ts", "event_id"], 0.9, F.col("event_type") == "error"))
    return found.withColumn("x", F.col("x") + 0)


@query(f"WITH RECURSIVE {_SERIES}, r AS (SELECT user_id, i, event_id, ts, x, 0.1 * x * x AS m, 0.1::DOUBLE AS w FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.event_id, e.ts, e.x, 0.9 * r.m + 0.1 * e.x * e.x, 0.9 * r.w + 0.1 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, ts, event_id, round(CASE WHEN m = 0 THEN 0 ELSE x / sqrt(m / w) END, 6) AS x FROM r")
def by_exponential_power(spark, d):
    rows = _events(spark, d).select("user_id", "ts", "event_id", F.col("value").alias("x"))
    return _rounded(recursive.by_exponential_power(rows, ["user_id"], ["ts", "event_id"], 0.9))


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS number, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS so_far, round(sum(value) OVER (PARTITION BY user_id), 4) AS so_far_all FROM events")
def running_values(spark, d):
    from .operators import ordered

    rows = _events(spark, d).select("user_id", "event_id", "ts", "value")
    sums = ordered.running_sums(rows, ["user_id"], ["ts", "event_id"], {"so_far": F.col("value")}, total=True)
    return _rounded(ordered.numbered(sums, ["user_id"], ["ts", "event_id"]), "so_far", "so_far_all").withColumns({c: F.round(c, 4) for c in ("so_far", "so_far_all")}).select("user_id", "event_id", "number", "so_far", "so_far_all")


# Hours with events, of each type: a series of 1024 places, whose transform SQL takes term by term.

_HOURS = "h AS (SELECT event_type AS ch, date_diff('hour', TIMESTAMP '2024-01-01', ts) % 1024 AS t, sum(value) AS x FROM events GROUP BY 1, 2)"
_COEFFICIENTS = "c AS (SELECT ch, k, sum(x * cos(-2 * pi() * ((k * t) % 1024) / 1024)) AS re, sum(x * sin(-2 * pi() * ((k * t) % 1024) / 1024)) AS im FROM h, range({n}) r(k) GROUP BY 1, 2)"


def _hours(spark, d):
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) - 473352
    return _events(spark, d).groupBy(F.col("event_type").alias("ch"), (hour % 1024).alias("t")).agg(F.sum("value").alias("x"))


@query(f"WITH {_HOURS}, {_COEFFICIENTS.format(n=1024)} SELECT ch, CAST(k AS BIGINT) AS k, round(re, 4) + 0 AS re, round(im, 4) + 0 AS im FROM c")
def long_transform(spark, d):
    from .functions import long_fourier

    return long_fourier.transform(_hours(spark, d), "t", 1024).select("ch", "k", *((F.round(c, 4) + 0).alias(c) for c in ("re", "im")))


@query(f"WITH {_HOURS}, {_COEFFICIENTS.format(n=513)}, g AS (SELECT * FROM c WHERE k BETWEEN 10 AND 60 OR k = 512) SELECT ch, CAST(t AS BIGINT) AS t, round(sum(CASE WHEN k = 512 THEN 0.5 ELSE 2 END * (re * cos(2 * pi() * ((k * t) % 1024) / 1024) - im * sin(2 * pi() * ((k * t) % 1024) / 1024))) / 1024, 5) + 0 AS x FROM g, range(1024) r(t) GROUP BY 1, 2")
def long_filtered(spark, d):
    from .functions import long_fourier

    gain = F.when(F.col("k").between(10, 60), 1.0).when(F.col("k") == 512, 0.5).otherwise(0.0)
    return long_fourier.filtered(_hours(spark, d), "t", 1024, gain).select("ch", "t", (F.round("x", 5) + 0).alias("x"))


@query(f"WITH {_HOURS} SELECT ch, CAST(s.t AS BIGINT) AS t, round(coalesce(x, 0), 5) + 0 AS x FROM (SELECT * FROM (SELECT DISTINCT ch FROM h) q, range(1021) r(t)) s LEFT JOIN (SELECT ch, t % 1021 AS t, sum(x) AS x FROM h GROUP BY 1, 2) m USING (ch, t)")
def chirped_there_and_back(spark, d):
    # 1021 is prime: by chirps, and back it must be the series.
    from .functions import long_fourier

    cells = _hours(spark, d).withColumn("t", F.col("t") % 1021)
    there = long_fourier.transform(cells, "t", 1021, 512)
    return long_fourier.inverse(there, "t", 1021, 512).select("ch", "t", (F.round("re", 5) + 0).alias("x"))


# Responses: days of a user are a series, its purchases and errors stimuli; two lags of one code have a closed form.

_DAYS = "v AS (SELECT event_type AS ch, user_id AS epoch, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS time, sum(value) AS x FROM events GROUP BY 1, 2, 3), u AS (SELECT user_id AS epoch, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS time, count(*)::DOUBLE AS w FROM events WHERE event_type = 'error' GROUP BY 1, 2)"


@query(
    f"WITH {_DAYS}, hi AS (SELECT epoch, max(time) AS hi FROM v GROUP BY 1), g AS (SELECT sum(w * w) AS g00, sum(CASE WHEN time + 1 <= hi THEN w * w ELSE 0 END) AS g11 FROM u JOIN hi USING (epoch)), p AS (SELECT sum(a.w * b.w) AS g01 FROM u a JOIN u b ON a.epoch = b.epoch AND b.time = a.time + 1), "
    "c AS (SELECT ch, sum(CASE WHEN v.time = u.time THEN x * w ELSE 0 END) AS c0, sum(CASE WHEN v.time = u.time + 1 THEN x * w ELSE 0 END) AS c1 FROM v JOIN u ON u.epoch = v.epoch AND v.time - u.time IN (0, 1) GROUP BY ch) "
    "SELECT ch, CAST(l AS INT) AS lag, round(CASE l WHEN 0 THEN (g11 * c0 - g01 * c1) ELSE (g00 * c1 - g01 * c0) END / (g00 * g11 - g01 * g01), 6) + 0 AS x FROM c, g, p, range(2) r(l)"
)
def deconvolved(spark, d):
    from .operators import responses

    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    events = _events(spark, d).select(F.col("event_type").alias("ch"), F.col("user_id").alias("epoch"), day.alias("time"), "value")
    cube = events.groupBy("ch", "epoch", "time").agg(F.sum("value").alias("x"))
    stimuli = events.where("ch = 'error'").groupBy("epoch", "time").agg(F.count("*").cast("double").alias("w")).withColumn("code", F.lit(1))
    return responses.deconvolved(cube, stimuli, ["epoch"], 2).select("ch", "lag", (F.round("x", 6) + 0).alias("x"))


_TIMED = "e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1e6 AS t FROM events)"
_BLOCKS = "m AS (SELECT *, lead(t) OVER w AS nt, lead(event_type) OVER w AS ny FROM e WHERE event_type IN ('purchase', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), b AS (SELECT user_id, t AS lo, nt AS hi, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS block FROM m WHERE event_type = 'purchase' AND ny = 'error')"


def _timed(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return _events(spark, d).select("user_id", "event_id", "event_type", "value", t.alias("t"))


@query(f"WITH {_TIMED}, {_BLOCKS} SELECT user_id, CAST(block AS INT) AS block, round(lo, 3) AS lo, round(hi, 3) AS hi FROM b")
def block_spans(spark, d):
    from .operators import blocks

    return _rounded(blocks.spans_between(_timed(spark, d), "user_id", "t", "event_id", F.col("event_type") == "purchase", F.col("event_type") == "error"), "lo", "hi").withColumns({c: F.round(c, 3) for c in ("lo", "hi")})


@query(f"WITH {_TIMED}, {_BLOCKS}, s AS (SELECT b.user_id, block, e.t AS start, row_number() OVER (PARTITION BY b.user_id, block ORDER BY e.t, e.event_id) AS epoch FROM b JOIN e ON e.user_id = b.user_id AND e.t BETWEEN lo AND hi WHERE e.event_type = 'click') SELECT s.user_id, e.event_id, e.event_type, e.value, CAST(s.block AS INT) AS block, CAST(s.epoch AS INT) AS epoch, round(e.t - start, 3) + 0 AS off FROM s JOIN e ON e.user_id = s.user_id AND e.t BETWEEN start - 3600 AND start + 86400")
def block_epochs(spark, d):
    from .operators import blocks

    kind = F.col("event_type")
    rows = _timed(spark, d)
    found = blocks.block_epochs(rows.select("user_id", "event_id", "event_type", "t"), rows, "user_id", "t", "event_id", kind == "purchase", kind == "error", kind == "click", (-3600.0, 86400.0))
    return found.select("user_id", "event_id", "event_type", "value", "block", "epoch", (F.round("offset", 3) + 0).alias("off"))


@query(f"WITH {_TIMED}, k AS (SELECT user_id, t AS start, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY t, value) AS i FROM e WHERE event_type = 'view'), a AS (SELECT *, (i - 1) // 2 + 1 AS n FROM k WHERE (i - 1) % 2 = 0), g AS (SELECT max(d) AS longer FROM (SELECT lead(start) OVER (PARTITION BY user_id ORDER BY start, y) - start AS d FROM a) q) SELECT e.user_id, e.event_id, CAST(n AS INT) AS subepoch, y, round(e.t - start - 60, 3) + 0 AS off FROM a JOIN e ON e.user_id = a.user_id, g WHERE e.t >= start + 60 AND e.t < start + longer + 7200 + 120")
def sequence_epochs(spark, d):
    from .operators import blocks

    rows = _timed(spark, d)
    stimuli = rows.where("event_type = 'view'").select("user_id", "t", F.col("value").alias("y"))
    found = blocks.sequence_epochs(rows.select("user_id", "event_id", "t"), stimuli, "user_id", "t", 7200.0, 2, (60.0, 120.0))
    return found.select("user_id", "event_id", "subepoch", "y", (F.round("offset", 3) + 0).alias("off"))


_CHANGED = {"rise": "CASE WHEN d0 > 0 THEN 1 ELSE 0 END", "curve": "coalesce(d1 - d0, 0)", "turn": "CASE WHEN (d0 > 0 AND d1 <= 0) OR (d0 <= 0 AND d1 > 0) THEN 1 ELSE 0 END"}

for _change, _sql in _CHANGED.items():

    @query(f"WITH s AS (SELECT user_id, event_id, value AS x, value - lag(value) OVER w AS d0, lead(value) OVER w - value AS d1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, round(CAST({_sql} AS DOUBLE), 5) + 0 AS x FROM s")
    def _sequence(spark, d, change=_change):
        from .operators import blocks

        rows = _events(spark, d).select("user_id", "event_id", F.col("value").alias("x"))
        return blocks.sequence_values(rows, ["user_id"], "event_id", change).select("user_id", "event_id", (F.round("x", 5) + 0).alias("x"))

    QUERIES[f"sequence_{_change}"], ORACLES[f"sequence_{_change}"] = QUERIES.pop("_sequence"), ORACLES.pop("_sequence")


# Decompositions of all 64 features: what they must give, or SQL of the same rounds.

_UNIT = "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM range({n}) a(i), range({n}) b(j)"


def _vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _products(rows, dimension, scale=None):
    """i, j, x: sums of products of the entries, each by a scale."""
    from .operators import wide

    sums = wide.outer_sums(rows, F.lit(0), "v", dimension).select("i", F.posexplode("sums").alias("j", "x"))
    return sums.select("i", "j", (F.round(F.col("x") * (1.0 if scale is None else scale), 6) + 0).alias("x"))


@query(_UNIT.format(n=64))
def whitened_all_features(spark, d):
    from .operators import spatial, wide

    rows = _vectors(spark, d)
    sums = wide.gathered(wide.outer_sums(rows, F.lit(0), "v", 64), 64, 64)[0]
    return _products(wide.projected(rows, "v", spatial.whitener(sums)), 64)


@query("SELECT vec_id, CAST(i AS INT) AS feat, round(CAST(embedding[i + 1] AS DOUBLE), 5) + 0 AS x FROM embeddings, range(64) r(i)")
def principal_reconstruction(spark, d):
    from .operators import wide

    rows = _vectors(spark, d)
    middle, components, _ = wide.principal(rows, "v", 64, 64)
    scores = wide.projected(rows, "v", components, middle)
    back = wide.mapped(scores, "v", 64, lambda s: s @ components.T + middle)
    return back.select("vec_id", F.posexplode("v").alias("feat", "x")).withColumn("x", F.round("x", 5) + 0)


@query("SELECT round(sum(v), 6) AS total FROM (SELECT var_pop(CAST(embedding[i + 1] AS DOUBLE)) AS v FROM embeddings, range(64) r(i) GROUP BY i) q")
def principal_total(spark, d):
    # From factors alone: the squares of R's entries, by the number of vectors.
    from .operators import wide

    rows = _vectors(spark, d)
    n, middle = wide.mean(rows, "v", 64)
    import numpy as np

    r = wide.triangle(wide.projected(rows, "v", np.eye(64), middle), "v", 64)
    return rows.select("v").limit(1).select(F.round(F.lit(float((r * r).sum() / n)), 6).alias("total"))


@query(_UNIT.format(n=6))
def principal_scores(spark, d):
    from .operators import wide

    rows = _vectors(spark, d)
    middle, components, variances = wide.principal(rows, "v", 64, 6)
    n, _ = wide.mean(rows, "v", 64)
    return _products(wide.projected(rows, "v", components / (variances * n) ** 0.5, middle), 6)


@query("SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM range(64) a(i), range(64) b(j) WHERE (i < 32) = (j < 32) OR i % 32 <> j % 32")
def canonical_pairs(spark, d):
    # Variates of either half have unit variance and vary together with their partner alone.
    from .operators import wide

    import numpy as np

    rows = _vectors(spark, d)
    halves = rows.select("vec_id", F.slice("v", 1, 32).alias("p"), F.slice("v", 33, 32).alias("q"))
    wx, wy, _ = wide.canonical(halves, "p", "q", 32, 32)
    n, middle = wide.mean(rows, "v", 64)
    both = np.block([[wx, np.zeros((32, 32))], [np.zeros((32, 32)), wy]])
    found = _products(wide.projected(rows, "v", both, middle), 64, 1 / n)
    return found.where(((F.col("i") < 32) == (F.col("j") < 32)) | (F.col("i") % 32 != F.col("j") % 32))


@query("WITH e AS (SELECT CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings), r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM e) SELECT round(sqrt((ac * ac + bc * bc - 2 * ab * ac * bc) / (1 - ab * ab)), 6) AS rho FROM r")
def canonical_correlation(spark, d):
    from .operators import wide

    rows = _vectors(spark, d).select(F.slice("v", 1, 2).alias("p"), F.slice("v", 3, 1).alias("q"))
    _, _, rho = wide.canonical(rows, "p", "q", 2, 1)
    return rows.limit(1).select(F.round(F.lit(float(rho[0])), 6).alias("rho"))


def _robust_sql(rounds: int, parameter: float) -> str:
    """Pairs of features, each pair a group of its own; a round weighs by the matrix of the round before."""
    steps = ["e AS (SELECT CAST(p AS INT) AS g, CAST(embedding[2 * p + 1] AS DOUBLE) AS a, CAST(embedding[2 * p + 2] AS DOUBLE) AS b FROM embeddings, range(32) r(p))", "m0 AS (SELECT g, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM e GROUP BY g)"]
    for k in range(rounds):
        steps.append(f"w{k} AS (SELECT e.*, n, least(1.0::DOUBLE, {parameter**2}::DOUBLE * 2 / n / greatest((bb * a * a - 2 * ab * a * b + aa * b * b) / (aa * bb - ab * ab), 1e-300)) AS w FROM e JOIN m{k} USING (g))")
        steps.append(f"m{k + 1} AS (SELECT g, max(n) AS n, sum(w * a * a) * max(n) / sum(w) AS aa, sum(w * a * b) * max(n) / sum(w) AS ab, sum(w * b * b) * max(n) / sum(w) AS bb FROM w{k} GROUP BY g)")
    return "WITH " + ", ".join(steps) + f" SELECT g, round(aa, 5) AS aa, round(ab, 5) + 0 AS ab, round(bb, 5) AS bb FROM m{rounds}"


@query(_robust_sql(4, 1.5))
def robust_pairs(spark, d):
    from .operators import wide

    pairs = _vectors(spark, d).select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda p: F.slice("v", 2 * p + 1, 2))).alias("g", "v"))
    found = wide.robust_covariance(pairs, F.col("g"), "v", 2, "bounded", 1.5, rounds=4, tolerance=0.0)
    rows = [(g, float(m[0, 0]), float(m[0, 1]), float(m[1, 1])) for g, (m, _) in sorted(found.items())]
    made = spark.createDataFrame(rows, "g int, aa double, ab double, bb double")
    return made.select("g", F.round("aa", 5).alias("aa"), (F.round("ab", 5) + 0).alias("ab"), F.round("bb", 5).alias("bb"))


# Fitted pipelines, kernel features, distances of matrices, chance.

_LINE = "r AS (SELECT vec_id, vec_id % 5 AS fold, CAST(i AS INT) AS feat, CAST(embedding[i + 1] AS DOUBLE) AS x, CASE WHEN label % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM embeddings, range(64) r(i) WHERE label IS NOT NULL)"


def _labelled(spark, d):
    side = F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0)
    return _vectors(spark, d).where("label IS NOT NULL").select("vec_id", (F.col("vec_id") % 5).alias("fold"), side.alias("y"), "v")


@query(
    f"WITH {_LINE}, m AS (SELECT f.fold, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) AS xy, count(*) AS n FROM (SELECT * FROM r WHERE feat = 0) t JOIN (SELECT DISTINCT fold FROM r) f ON t.fold <> f.fold GROUP BY f.fold), p(penalty) AS (VALUES (1.0::DOUBLE), (10.0::DOUBLE)) "
    "SELECT vec_id, CAST(fold AS BIGINT) AS fold, penalty, round(my + (x - mx) / sx * (n * xy / sx) / (n + penalty), 6) + 0 AS dv FROM r JOIN m USING (fold), p WHERE feat = 0"
)
def standardised_ridge(spark, d):
    # One feature, standardised within the other folds, then ridge regression: a closed form.
    from .functions import pipelines

    rows = _labelled(spark, d).withColumn("v", F.slice("v", 1, 1))
    weights = pipelines.fold_weights(rows, "fold", "v", "y", 1, [pipelines.standardised], [1.0, 10.0])
    return pipelines.fold_values(rows, "fold", "v", weights, [1.0, 10.0]).select("vec_id", "fold", "penalty", (F.round("dv", 6) + 0).alias("dv"))


@query(f"WITH {_LINE} SELECT DISTINCT vec_id, CAST(fold AS BIGINT) AS fold, penalty, 0.0::DOUBLE AS difference FROM r, (VALUES (0.5::DOUBLE), (5.0::DOUBLE)) p(penalty)")
def whitened_ridge(spark, d):
    # All features, whitened within the other folds: the same as ridge by the features' covariance, computed another way.
    import numpy as np

    from .functions import pipelines

    rows, penalties = _labelled(spark, d), [0.5, 5.0]
    weights = pipelines.fold_weights(rows, "fold", "v", "y", 64, [pipelines.standardised, pipelines.whitened], penalties)
    found = pipelines.fold_values(rows, "fold", "v", weights, penalties)
    other = {}
    for f in sorted({f for f, _ in weights}):
        train = rows.where(F.col("fold") != f)
        from .operators import wide

        sums = wide.gathered(wide.outer_sums(train.select(F.concat(F.array(F.lit(1.0)), "v", F.array("y")).alias("v")), F.lit(0), "v", 66), 66, 66)[0]
        n, mean, target = sums[0, 0], sums[0, 1:-1] / sums[0, 0], sums[0, -1] / sums[0, 0]
        covariance, shared = sums[1:-1, 1:-1] / n - np.outer(mean, mean), sums[1:-1, -1] / n - mean * target
        for p in penalties:
            # After whitening the penalty weighs every direction alike: n / (n + p) of the unpenalised weights.
            w = np.linalg.solve(covariance, shared) * n / (n + p)
            other[f, p] = np.r_[target - w @ mean, w]
    twin = pipelines.fold_values(rows, "fold", "v", other, penalties).select("vec_id", "penalty", F.col("dv").alias("_o"))
    return found.join(twin, ["vec_id", "penalty"]).select("vec_id", "fold", "penalty", (F.round(F.abs(F.col("dv") - F.col("_o")), 5) + 0).alias("difference"))


@query("SELECT vec_id, round(sum(CAST(embedding[i + 1] AS DOUBLE) * CAST(embedding[i + 1] AS DOUBLE)), 5) AS x FROM embeddings, range(64) r(i) GROUP BY vec_id")
def nystrom_norms(spark, d):
    # With as many landmarks as span all vectors the features' products are the kernel.
    from .functions import kernels

    rows = _vectors(spark, d)
    chosen, _ = kernels.landmarks(rows, "v", 64, 80)
    found = kernels.nystrom(rows, "v", 64, chosen)
    return found.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e), 5).alias("x"))


_MATRICES = "c AS (SELECT user_id, 1 + avg(value * value) / 1000 AS aa, avg(value * m) / 1000 AS ab, 1 + avg(m * m) / 1000 AS bb FROM (SELECT user_id, value, (event_id % 60)::DOUBLE AS m FROM events) q GROUP BY 1), z(k, aa, ab, bb) AS (VALUES (0, 2.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE), (1, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE))"


def _matrices(spark, d):
    a, b = F.col("value"), (F.col("event_id") % 60).cast("double")
    found = _events(spark, d).groupBy("user_id").agg((1 + F.avg(a * a) / 1000).alias("aa"), (F.avg(a * b) / 1000).alias("ab"), (1 + F.avg(b * b) / 1000).alias("bb"))
    return found.select("user_id", F.array("aa", "ab", "ab", "bb").alias("m"))


_DISTANCES = {
    "log_product": "0.5 * (ln(c.aa * c.bb - c.ab * c.ab) / 2 + ln(z.aa * z.bb - z.ab * z.ab) / 2 - ln(((c.aa + z.aa) * (c.bb + z.bb) - (c.ab + z.ab) * (c.ab + z.ab)) / 4))",
    "traces": "((z.aa * c.bb - 2 * z.ab * c.ab + z.bb * c.aa) / (c.aa * c.bb - c.ab * c.ab) + (c.aa * z.bb - 2 * c.ab * z.ab + c.bb * z.aa) / (z.aa * z.bb - z.ab * z.ab)) / 2",
    "logarithms": "sqrt(pow(ln((t + sqrt(t * t - 4 * q)) / 2), 2) + pow(ln((t - sqrt(t * t - 4 * q)) / 2), 2))",
}

for _how, _sql in _DISTANCES.items():

    @query(f"WITH {_MATRICES} SELECT user_id, CAST(k AS INT) AS k, round({_sql}, 6) + 0 AS x FROM (SELECT c.user_id, z.k, c, z, (z.aa * c.bb - 2 * z.ab * c.ab + z.bb * c.aa) / (c.aa * c.bb - c.ab * c.ab) AS t, (z.aa * z.bb - z.ab * z.ab) / (c.aa * c.bb - c.ab * c.ab) AS q FROM c, z) s")
    def _distance(spark, d, how=_how):
        from .functions import covariances

        found = covariances.distances(_matrices(spark, d), "m", 2, [[[2.0, 0.5], [0.5, 1.0]], [[1.0, 0.0], [0.0, 1.0]]], how)
        return found.select("user_id", F.posexplode("distance").alias("k", "x")).withColumn("x", F.round("x", 6) + 0)

    QUERIES[f"matrix_{_how}"], ORACLES[f"matrix_{_how}"] = QUERIES.pop("_distance"), ORACLES.pop("_distance")

_VALUED = "f AS (SELECT CAST(i AS INT) AS feat, CAST(embedding[i + 1] AS DOUBLE) AS x, CASE WHEN label % 2 = 0 THEN 1 ELSE -1 END AS y FROM embeddings, range(64) r(i) WHERE label IS NOT NULL)"


@query(
    f"WITH {_VALUED}, c AS (SELECT feat, count(*) AS n, count(*) FILTER (y > 0) AS p, count(*) FILTER (x > 0) AS q, count(*) FILTER ((y > 0) = (x > 0)) AS ok FROM f GROUP BY feat), h AS (SELECT *, unnest(range(greatest(0, p + q - n), least(p, q) + 1)) AS k FROM c), "
    "d AS (SELECT *, (n - p - q + 2 * k) / n AS r, exp(lgamma(p + 1) - lgamma(k + 1) - lgamma(p - k + 1) + lgamma(n - p + 1) - lgamma(q - k + 1) - lgamma(n - p - q + k + 1) - lgamma(n + 1) + lgamma(q + 1) + lgamma(n - q + 1)) AS w FROM h), e AS (SELECT *, sum(w) OVER (PARTITION BY feat ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS above FROM d) "
    "SELECT feat, n, round(max(ok / n), 6) AS rate, round(sum(CASE WHEN r > ok / n + 1e-12 THEN w ELSE 0 END), 6) AS p, round(max(CASE WHEN above >= 0.05 THEN r END), 6) AS bound FROM e GROUP BY feat, n"
)
def permutation_bounds(spark, d):
    from .functions import decisions

    rows = _labelled(spark, d).select("y", F.posexplode("v").alias("feat", "x"))
    return _rounded(decisions.permutation_bounds(rows, ["feat"], "y", "x"), "rate", "p", "bound")


@query(f"WITH {_VALUED}, t AS (SELECT feat, x, sum((y > 0)::INT) AS p, count(*)::DOUBLE AS t FROM f GROUP BY 1, 2), b AS (SELECT *, sum(t - p) OVER (PARTITION BY feat ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM t), s AS (SELECT feat, sum(p)::DOUBLE AS p, sum(t) AS n, sum(t * t * t - t) AS ties, sum(p * (coalesce(below, 0) + (t - p) / 2)) AS won FROM b GROUP BY feat) SELECT feat, round(won / (p * (n - p)), 6) AS auc, round(sqrt((n + 1 - ties / (n * (n - 1))) / (12 * p * (n - p))), 6) AS se, round((won / (p * (n - p)) - 0.5) / sqrt((n + 1 - ties / (n * (n - 1))) / (12 * p * (n - p))), 5) + 0 AS z FROM s")
def auc_chance(spark, d):
    from .functions import decisions

    rows = _labelled(spark, d).select("y", F.posexplode("v").alias("feat", "x"))
    return _rounded(decisions.auc_chance(rows, ["feat"]), "auc", "se").withColumn("z", F.round("z", 5) + 0)


@query(f"WITH cube AS (SELECT event_type AS ch, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS time, user_id AS epoch, avg(value) AS x FROM events GROUP BY 1, 2, 3), b AS (SELECT *, unnest(range(CAST(floor(time / 2.5::DOUBLE) AS BIGINT), CAST(ceil((time + 1) / 2.5::DOUBLE) AS BIGINT))) AS bin FROM cube), w AS (SELECT *, least(time + 1, (bin + 1) * 2.5::DOUBLE) - greatest(time, bin * 2.5::DOUBLE) AS part FROM b) SELECT ch, epoch, bin, round(sum(part * x) / sum(part), 6) AS x, round(sum(part), 6) AS weight FROM w GROUP BY 1, 2, 3")
def fractional_bins(spark, d):
    from .operators.statistics import fractional_bins as binned
    from .sources.cubes import event_cube

    return _rounded(binned(event_cube(spark, d), "time", 2.5), "x", "weight")


@query("WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CAST('0x' || substr(md5(user_id || ':' || event_id), 1, 8) AS BIGINT) / 2147483648.0::DOUBLE - 1 AS w FROM events), r AS (SELECT user_id, i, event_id, w AS y, 0.0::DOUBLE AS y1 FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.event_id, e.w + 0.7::DOUBLE * r.y - 0.2::DOUBLE * r.y1, r.y FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, event_id, round(y, 6) + 0 AS x FROM r")
def coloured_noise(spark, d):
    from .sources.made import coloured_noise as made

    return made(_events(spark, d), ["user_id"], ["event_id"], [0.7, -0.2]).select("user_id", "event_id", (F.round("x", 6) + 0).alias("x"))


# Event types on a sphere; days on which views are taken for missing, of users that have all types that day.

_CAP = {"click": (1.0, 0.0, 0.2), "error": (0.0, 1.0, 0.1), "purchase": (-1.0, 0.3, 0.4), "signup": (0.2, -1.0, 0.3), "view": (0.1, 0.1, 1.0)}


def _filled_sql() -> str:
    """Of the days with one or more other types, by constants for each pattern of what is there."""
    import numpy as np

    from .operators import surface

    names = sorted(_CAP)
    at = np.array([_CAP[n] for n in names])
    at = at / np.linalg.norm(at, axis=1, keepdims=True)
    rows = []
    for pattern in range(1, 2 ** len(names) - 1):
        there = [k for k in range(len(names)) if pattern >> k & 1]
        gone = [k for k in range(len(names)) if k not in there]
        w = surface.weights(at[there], at[gone])
        rows += [f"({pattern}, '{names[g]}', '{names[t]}', {float(w[i, j])!r}::DOUBLE)" for i, g in enumerate(gone) for j, t in enumerate(there)]
    codes = ", ".join(f"('{n}', {1 << k})" for k, n in enumerate(names))
    cube = "cube AS (SELECT event_type AS ch, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS time, user_id AS epoch, avg(value) AS x FROM events GROUP BY 1, 2, 3)"
    return f"WITH {cube}, k AS (SELECT * FROM cube WHERE NOT (ch = 'view' AND time % 3 = 0)), b(ch, bit) AS (VALUES {codes}), p AS (SELECT time, epoch, CAST(sum(bit) AS INT) AS pattern FROM k JOIN b USING (ch) GROUP BY 1, 2), w(pattern, gone, ch, w) AS (VALUES {', '.join(rows)}) SELECT time, epoch, gone AS ch, round(sum(x * w), 5) AS x FROM p JOIN w USING (pattern) JOIN k USING (time, epoch, ch) GROUP BY 1, 2, 3 UNION ALL SELECT time, epoch, ch, round(x, 5) FROM k"


@query(_filled_sql())
def filled_channels(spark, d):
    from .operators import surface
    from .sources.cubes import event_cube

    cube = event_cube(spark, d).where(~((F.col("ch") == "view") & (F.col("time") % 3 == 0)))
    return surface.filled(cube, _CAP).select("time", "epoch", "ch", F.round("x", 5).alias("x"))


@query(
    "WITH e AS (SELECT vec_id, CAST(i AS INT) AS f, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(i)), c AS (SELECT vec_id, f, x - avg(x) OVER (PARTITION BY f) AS x FROM e), v AS (SELECT *, avg(x) OVER (PARTITION BY vec_id) AS m FROM c), "
    "p AS (SELECT a.f AS i, b.f AS j, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * a.m) AS t, avg(a.x * b.x * a.m * a.m) AS u FROM v a JOIN v b USING (vec_id) GROUP BY 1, 2), k AS (SELECT f, avg(x * m) AS g FROM v GROUP BY f), o AS (SELECT avg(m * m) AS w, count(*) AS n FROM (SELECT DISTINCT vec_id, m FROM v) q), "
    "h AS (SELECT avg(q * q) AS whole, avg(d) AS single FROM (SELECT vec_id, sum(x * x) AS q, sum(x * x * x * x) AS d FROM v GROUP BY vec_id) z), l AS (SELECT p.*, a.g AS gi, b.g AS gj, w, n, CASE WHEN i = j THEN s ELSE a.g * b.g / w END AS model FROM p JOIN k a ON a.f = i JOIN k b ON b.f = j, o), "
    "r AS (SELECT greatest(0.0, least(1.0, ((max(whole) - sum(s * s)) - (max(single) - sum(CASE WHEN i = j THEN s * s ELSE 0 END) + sum(CASE WHEN i <> j THEN 2 * (t - gi * s) * gj / w - (u - w * s) * gi * gj / (w * w) ELSE 0 END))) / sum((s - model) * (s - model)) / max(n))) AS amount FROM l, h) "
    "SELECT i, j, round(amount * model + (1 - amount) * s, 8) + 0 AS x, round(amount, 6) AS shrinkage FROM l, r"
)
def market_shrunk(spark, d):
    from .operators import wide

    rows = _vectors(spark, d)
    matrix, amount = wide.market_shrunk(rows, "v", 64)
    made = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], "i int, v array<double>")
    return made.select("i", F.posexplode("v").alias("j", "x"), F.round(F.lit(amount), 6).alias("shrinkage")).withColumn("x", F.round("x", 8) + 0)


@query(f"WITH {_LINE}, m AS (SELECT f.fold, avg(x) AS mx, var_pop(x) AS vx, avg(y) AS my, covar_pop(x, y) AS xy FROM (SELECT * FROM r WHERE feat = 0) t JOIN (SELECT DISTINCT fold FROM r) f ON t.fold <> f.fold GROUP BY f.fold), p(penalty) AS (VALUES (0.001::DOUBLE), (0.01::DOUBLE), (1.0::DOUBLE)) SELECT vec_id, CAST(fold AS BIGINT) AS fold, penalty, round(my + (x - mx) * sign(xy) * greatest(abs(xy) - penalty, 0) / vx, 6) + 0 AS dv FROM r JOIN m USING (fold), p WHERE feat = 0")
def lasso_one_feature(spark, d):
    from .functions import pipelines

    rows, penalties = _labelled(spark, d).withColumn("v", F.slice("v", 1, 1)), [0.001, 0.01, 1.0]
    weights = pipelines.fold_weights(rows, "fold", "v", "y", 1, [], penalties, pipelines.lasso)
    return pipelines.fold_values(rows, "fold", "v", weights, penalties).select("vec_id", "fold", "penalty", (F.round("dv", 6) + 0).alias("dv"))


@query("WITH cube AS (SELECT event_type AS ch, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS time, user_id AS epoch, avg(value) AS x FROM events GROUP BY 1, 2, 3), w(v) AS (VALUES (19725.4::DOUBLE), (19731.0::DOUBLE), (99999.0::DOUBLE)), n AS (SELECT v, time, row_number() OVER (PARTITION BY v ORDER BY abs(time - v), time) AS r FROM (SELECT DISTINCT time FROM cube) q, w) SELECT ch, time, epoch, round(x, 6) AS x FROM cube WHERE time IN (SELECT time FROM n WHERE r = 1)")
def retain_nearest(spark, d):
    from .operators import restructure
    from .sources.cubes import event_cube

    return _rounded(restructure.retain_nearest(event_cube(spark, d), "time", [19725.4, 19731.0, 99999.0]))
