"""Drift and stepping: regression, one-dimensional density clustering, diagnosis, transitions and stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.delays import accepted_windows
from tidemark.plans.fixtures import oracle, r6, windows
from tidemark.plans.registry import query

WINDOW_S = 10.0


def linear_fit(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, n, slope, intercept, r2) by least squares; 0 where there are fewer than two rows or no spread in x, r2 0 where y has none."""
    sums = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.regr_r2(y, x).alias("r"), F.regr_syy(y, x).alias("yy"), F.avg(y).alias("mean"))
    flat = F.col("s").isNull() | (F.col("n") < 2)
    return sums.select(key, "n", F.when(flat, 0.0).otherwise(F.col("s")).alias("slope"), F.when(flat, F.col("mean")).otherwise(F.col("i")).alias("intercept"), F.when(flat | (F.col("yy") < 1e-12), 0.0).otherwise(F.col("r")).alias("r2"))


def density_clusters(rows: DataFrame, key: str, order: str, value: str, eps: float, min_samples: Column) -> DataFrame:
    """Rows with label: clusters of one-dimensional density clustering, -1 for noise.

    A core row has at least min_samples rows within eps, itself included. In one
    dimension clusters are runs of sorted cores without a gap over eps; they are
    numbered by their first core in row order, and a border row takes the smallest
    number within eps. Only ordered windows and range frames are needed, no search
    by pairs.
    """
    around = f"over (partition by {key} order by {value} range between {eps}D preceding and {eps}D following)"  # SQL has range frames of doubles
    counted = rows.withColumn("__near", F.expr(f"count(1) {around}")).withColumn("__core", F.col("__near") >= min_samples)
    # cores and other rows are numbered apart, which spares joining the rows with themselves
    apart = Window.partitionBy(key, "__core").orderBy(value)
    step = F.col(value) - F.lag(value).over(apart)
    islands = counted.withColumn("__new", F.when(step <= eps, 0).otherwise(1)).withColumn("__island", F.sum("__new").over(apart.rowsBetween(Window.unboundedPreceding, 0)))
    firsts = islands.withColumn("__first", F.min(order).over(Window.partitionBy(key, "__core", "__island")))
    numbered = firsts.withColumn("__id", F.when(F.col("__core"), F.dense_rank().over(Window.partitionBy(key, "__core").orderBy("__first")) - 1))
    nearest = F.expr(f"min(__id) {around}")
    return numbered.withColumn("label", F.coalesce("__id", nearest, F.lit(-1)).cast("int")).drop("__near", "__core", "__new", "__island", "__first", "__id")


def clustered_windows(rows: DataFrame, eps: float = 20.0, percent: float = 1.5) -> DataFrame:
    """The accepted windows with their label by rounded delay; min_samples is max(2, trunc(n * percent / 100))."""
    own = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("source_key"))).withColumn("value", F.col("delay_ms").cast("double"))
    return density_clusters(own, "source_key", "window_idx", "value", eps, F.greatest(F.lit(2), (F.col("__n") * percent / 100).cast("int")))


def cluster_details(labelled: DataFrame) -> DataFrame:
    """Per source and cluster its mean, spread, members, time range and match."""
    return _details(labelled.where("label >= 0"))


def _details(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("source_key", "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("delay_ms").alias("mean_ms"), F.stddev_pop("delay_ms").alias("std_ms"), F.min("start_s").alias("t0"), F.max("start_s").alias("t1"),
        F.avg("match_pct").alias("avg_match"), F.min("match_pct").alias("min_match"), F.sort_array(F.collect_list("window_idx")).alias("members"),
    )


#: Percent of windows, seconds and match that a cluster needs, and clusters that stepping needs, by mode.
THRESHOLDS = {"strict": (10.0, 30.0, 90.0, 2), "normal": (5.0, 20.0, 85.0, 2), "lenient": (3.0, 10.0, 75.0, 2)}


def thresholds(mode: str = "normal", custom: tuple[float, float, float, int] | None = None) -> tuple[float, float, float, int]:
    """A mode's thresholds; those given where the mode is custom; normal for an unknown one."""
    return custom if mode == "custom" and custom else THRESHOLDS.get(mode, THRESHOLDS["normal"])


def validate_clusters(labelled: DataFrame, mode: str = "normal", custom: tuple[float, float, float, int] | None = None) -> DataFrame:
    """Three checks of each cluster, how many passed, and whether all did."""
    return validate_modes(labelled, [mode], custom).drop("mode")


def validate_modes(labelled: DataFrame, modes: list[str], custom: tuple[float, float, float, int] | None = None) -> DataFrame:
    """validate_clusters() by several modes, with the mode; clusters are made once for all of them."""
    rows = _details(labelled).withColumn("total", F.sum("n").over(Window.partitionBy("source_key"))).where("label >= 0")
    each = []
    for mode in modes:
        share, seconds, match, _ = thresholds(mode, custom)
        checks = [F.col("n") / F.col("total") * 100 >= share, F.col("t1") - F.col("t0") + WINDOW_S >= seconds, F.col("avg_match") >= match]
        passed = sum((c.cast("int") for c in checks), F.lit(0))
        each.append(F.struct(*[c.alias(a) for c, a in zip(checks, ("ok_share", "ok_duration", "ok_match"))], passed.alias("passed"), (passed == 3).alias("valid"), F.lit(mode).alias("mode")))
    return rows.select("source_key", "label", "n", F.inline(F.array(*each)))


#: Slope in ms a second that a 25/24 speed-up gives and how near it must be; slope and R² from which drift is linear, for lossy and lossless codecs.
SPEED_UP, SPEED_UP_REACH = 40.9, 5.0
LOSSY, LOSSLESS = (0.7, 0.90), (0.2, 0.95)


def diagnose(rows: DataFrame, mode: str = "normal", correction: str = "full", fallback: str = "nearest", fps: Column | None = None, codec: Column | None = None) -> DataFrame:
    """PAL_DRIFT, STEPPING, LINEAR_DRIFT or UNIFORM for each source; fewer than six windows are uniform.

    First, at 25 frames a second (fps), the slope of a speed-up. Then clusters: with
    correction disabled they are uniform; full and strict need all of them valid;
    filtered needs enough valid ones, and with the fallback reject no other. One
    cluster is drift if slope and R² are above the codec's thresholds.
    """
    labelled = clustered_windows(rows)
    fits = linear_fit(rows.withColumn("y", F.col("delay_ms").cast("double")), "source_key", "start_s", "y")
    checked = validate_clusters(labelled, mode).groupBy("source_key").agg(F.count(F.lit(1)).alias("clusters"), F.count_if("valid").alias("valid"))
    joined = fits.join(checked, "source_key", "left").fillna(0, ["clusters", "valid"])
    rate = fps if fps is not None else F.lit(0.0)
    name = F.lower(codec) if codec is not None else F.lit("")
    lossless = name.contains("pcm") | name.contains("flac") | name.contains("truehd")
    slope_limit, r2_limit = (F.when(lossless, LOSSLESS[i]).otherwise(LOSSY[i]) for i in range(2))
    enough, whole = F.col("valid") >= thresholds(mode)[3], F.col("valid") == F.col("clusters")
    steps = {"full": enough & whole, "strict": enough & whole, "filtered": enough & (whole | F.lit(fallback != "reject"))}.get(correction, F.lit(False))
    kind = (
        F.when(F.col("n") < 6, "UNIFORM")
        .when((F.abs(rate - 25) < 0.1) & (F.abs(F.col("slope") - SPEED_UP) < SPEED_UP_REACH), "PAL_DRIFT")
        .when(F.col("clusters") > 1, F.when(steps, "STEPPING").otherwise("UNIFORM"))
        .when((F.abs("slope") > slope_limit) & (F.col("r2") > r2_limit), "LINEAR_DRIFT")
        .otherwise("UNIFORM")
    )
    return joined.select("source_key", "n", "clusters", "valid", "slope", "r2", kind.alias("diagnosis"))


def transitions(details: DataFrame) -> DataFrame:
    """The step from each cluster to the next in time, with the mean delays before and after it."""
    order = Window.partitionBy("source_key").orderBy("t0", "label")
    after = details.select("source_key", "label", "t1", "mean_ms", F.lead("t0").over(order).alias("next_t0"), F.lead("mean_ms").over(order).alias("next_mean"))
    zone = (F.col("t1").alias("zone_start"), F.col("next_t0").alias("zone_end"), (F.col("next_mean") - F.col("mean_ms")).alias("jump_ms"), F.col("mean_ms").alias("before_ms"), F.col("next_mean").alias("after_ms"))
    return after.where("next_t0 is not null").select("source_key", "label", *zone)


def label_changes(labelled: DataFrame) -> DataFrame:
    """Where the label changes between neighbours that aren't noise."""
    order = Window.partitionBy("source_key").orderBy("window_idx")
    seen = labelled.where("label >= 0").select("source_key", "window_idx", "label", F.lag("label").over(order).alias("was"), F.lag("window_idx").over(order).alias("last_idx"))
    return seen.where("was <> label").select("source_key", "last_idx", "window_idx", "was", "label")


def compress_ranges(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """The numbers of each key as text such as 1-3,5."""
    order = Window.partitionBy(*keys).orderBy(number)
    islands = rows.select(*keys, number, (F.col(number) - F.row_number().over(order)).alias("__g")).groupBy(*keys, "__g").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    ordered = F.sort_array(F.collect_list(F.struct("a", text.alias("t"))))
    return islands.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), ",").alias("ranges"))


def _far(reference: Column, any_mode: bool, outlier_ms: float) -> Column:
    return F.abs(F.col("raw_delay_ms") - reference) > (0.0001 if any_mode else outlier_ms)


def r4(column: Column) -> Column:
    """Four decimals without a negative zero."""
    return F.round(column, 4) + F.lit(0.0)


def uniform_stability(rows: DataFrame, variance_ms: float = 0.0, any_mode: bool = False, outlier_ms: float = 1.0) -> DataFrame:
    """Of each source whether its raw delays vary by more than variance_ms (by anything, if that is 0), their range, sample deviation and mean, and the outliers.

    An outlier is outlier_ms away from the mean, or in any_mode differs from the first
    delay. The first ten are listed by their number among the source's windows.
    """
    order = Window.partitionBy("source_key").orderBy("window_idx")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in order, as a sum of doubles depends on it
    numbered = rows.select("*", F.row_number().over(order).alias("chunk"), F.first("raw_delay_ms").over(order).alias("first_ms"), F.avg("raw_delay_ms").over(whole).alias("mean_ms"))
    far = _far(F.col("first_ms" if any_mode else "mean_ms"), any_mode, outlier_ms)
    spread = F.max("raw_delay_ms") - F.min("raw_delay_ms")
    return numbered.groupBy("source_key").agg(
        F.count(F.lit(1)).alias("n"), ((F.count(F.lit(1)) > 1) & (spread > (variance_ms if variance_ms > 0 else 0.0001))).alias("varies"), r4(spread).alias("variance_ms"),
        r4(F.coalesce(F.stddev_samp("raw_delay_ms"), F.lit(0.0))).alias("std_ms"), r4(F.avg("raw_delay_ms")).alias("mean_ms"), r4(F.min("raw_delay_ms")).alias("min_ms"), r4(F.max("raw_delay_ms")).alias("max_ms"),
        F.count_if(far).alias("outliers"), F.slice(F.sort_array(F.collect_list(F.when(far, F.col("chunk")))), 1, 10).alias("first_outliers"),
    )


def cluster_stability(labelled: DataFrame, variance_ms: float = 0.0, any_mode: bool = False, outlier_ms: float = 1.0) -> DataFrame:
    """Of each source the widest range inside a cluster and whether it is too wide, and the clusters that have outliers (number, mean, range, outliers). Clusters of one window say nothing."""
    order = Window.partitionBy("source_key", "label").orderBy("window_idx")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in order, as a sum of doubles depends on it
    inside = labelled.where("label >= 0").withColumn("first_ms", F.first("raw_delay_ms").over(order)).withColumn("mean_ms", F.avg("raw_delay_ms").over(whole))
    far = _far(F.col("first_ms" if any_mode else "mean_ms"), any_mode, outlier_ms)
    each = inside.groupBy("source_key", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("raw_delay_ms").alias("mean_ms"), (F.max("raw_delay_ms") - F.min("raw_delay_ms")).alias("range_ms"), F.count_if(far).alias("outliers"))
    told = F.col("n") > 1
    issue = F.when(told & (F.col("outliers") > 0), F.struct("label", r6(F.col("mean_ms")).alias("mean_ms"), r6(F.col("range_ms")).alias("range_ms"), "outliers"))
    widest = F.coalesce(F.max(F.when(told, F.col("range_ms"))), F.lit(0.0))
    return each.groupBy("source_key").agg(
        F.count(F.lit(1)).alias("clusters"), r4(widest).alias("variance_ms"), (widest > (variance_ms if variance_ms > 0 else 0.0001)).alias("varies"),
        F.coalesce(F.sum(F.when(told, F.col("outliers"))), F.lit(0)).alias("outliers"), F.sort_array(F.collect_list(issue)).alias("issues"),
    )


def sync_stability(rows: DataFrame, least: int = 3, **settings) -> DataFrame:
    """Sources of at least so many accepted windows, by their clusters where they have more than one and as a whole otherwise."""
    labelled = clustered_windows(rows)
    counted = labelled.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("k")).where(F.col("n") >= least)
    stepping, whole = (counted.where(c).select("source_key", "n") for c in (F.col("k") > 1, F.col("k") <= 1))
    by_cluster = cluster_stability(labelled.join(stepping.select("source_key"), "source_key", "left_semi"), **settings).join(stepping, "source_key")
    uniform = uniform_stability(rows.join(whole.select("source_key"), "source_key", "left_semi"), **settings)
    columns = ("source_key", "n", "varies", "variance_ms", "outliers")
    return by_cluster.select(*columns, F.lit(True).alias("is_stepping")).unionByName(uniform.select(*columns, F.lit(False).alias("is_stepping")))


def quality_gate(rows: DataFrame, base_ms: float = 0.0, percent: float = 90.0, skip: bool = False) -> DataFrame:
    """Whether corrected windows pass, and the first reason why not: too few accepted, their median delay off the base, or too wide a spread; looser limits in skip mode."""
    median_ms, std_ms = (100.0, 500.0) if skip else (20.0, 15.0)
    own = F.when(F.col("accepted"), F.col("delay_ms").cast("double"))
    stats = rows.groupBy("source_key").agg(F.count(F.lit(1)).alias("total"), F.count_if("accepted").alias("n"), F.median(own).alias("median_ms"), F.stddev_pop(own).alias("std_ms"))
    reason = F.when(F.col("n") < F.greatest(F.lit(10), (F.col("total") * percent / 100).cast("int")), "insufficient_accepted").when(F.abs(F.col("median_ms") - base_ms) > median_ms, "median_mismatch").when(F.col("std_ms") > std_ms, "unstable").otherwise("passed")
    return stats.select("source_key", "n", reason.alias("reason"))


_A = ", a AS (SELECT * FROM windows WHERE accepted)"
_FIT = """, f AS (SELECT source_key, count(*) AS n, regr_slope(delay_ms, start_s) AS s, regr_intercept(delay_ms, start_s) AS i, regr_r2(delay_ms, start_s) AS r, regr_syy(delay_ms, start_s) AS yy, avg(delay_ms) AS m FROM a GROUP BY 1),
fit AS (SELECT source_key, n, CASE WHEN s IS NULL THEN 0 ELSE s END AS slope, CASE WHEN s IS NULL THEN m ELSE i END AS intercept, CASE WHEN s IS NULL OR yy < 1e-12 THEN 0 ELSE r END AS r2 FROM f)"""
#: The oracle follows chains of cores by recursion instead of runs.
_LABEL = _A + """, n AS (SELECT *, greatest(2, trunc(count(*) OVER (PARTITION BY source_key) * 1.5 / 100)) AS need FROM a),
c AS (SELECT x.source_key, x.window_idx, x.delay_ms, x.need, (SELECT count(*) FROM n y WHERE y.source_key = x.source_key AND abs(y.delay_ms - x.delay_ms) <= 20) AS near FROM n x),
core AS (SELECT source_key, window_idx, delay_ms FROM c WHERE near >= need),
gaps AS (SELECT source_key, delay_ms, CASE WHEN delay_ms - lag(delay_ms) OVER w <= 20 THEN 0 ELSE 1 END AS g FROM (SELECT DISTINCT source_key, delay_ms FROM core) WINDOW w AS (PARTITION BY source_key ORDER BY delay_ms)),
isl AS (SELECT source_key, delay_ms, sum(g) OVER (PARTITION BY source_key ORDER BY delay_ms) AS island FROM gaps),
num AS (SELECT source_key, island, row_number() OVER (PARTITION BY source_key ORDER BY min(window_idx)) - 1 AS id FROM core JOIN isl USING (source_key, delay_ms) GROUP BY source_key, island),
cl AS (SELECT source_key, window_idx, delay_ms, id FROM core JOIN isl USING (source_key, delay_ms) JOIN num USING (source_key, island)),
lab AS (SELECT a.*, coalesce(cl.id, (SELECT min(b.id) FROM cl b WHERE b.source_key = a.source_key AND abs(b.delay_ms - a.delay_ms) <= 20), -1)::INT AS label
  FROM a LEFT JOIN cl ON a.source_key = cl.source_key AND a.window_idx = cl.window_idx),
det AS (SELECT source_key, label, count(*) AS n, avg(delay_ms) AS mean_ms, stddev_pop(delay_ms) AS std_ms, min(start_s) AS t0, max(start_s) AS t1, avg(match_pct) AS avg_match, min(match_pct) AS min_match FROM lab WHERE label >= 0 GROUP BY 1, 2)"""
_VALID = """, v AS (SELECT source_key, label, n, n / total * 100 >= 5 AS ok_share, t1 - t0 + 10 >= 20 AS ok_duration, avg_match >= 85 AS ok_match FROM det JOIN (SELECT source_key, count(*) AS total FROM a GROUP BY 1) USING (source_key)),
val AS (SELECT *, ok_share::INT + ok_duration::INT + ok_match::INT AS passed FROM v)"""


def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    return accepted_windows(windows(spark, sf))


@query("drift_fit", oracle("windows", body=_A + _FIT + " SELECT source_key, n, round(slope, 6) + 0.0 AS slope, round(intercept, 6) + 0.0 AS intercept, round(r2, 6) + 0.0 AS r2 FROM fit"))
def q_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows = _accepted(spark, sf).withColumn("y", F.col("delay_ms").cast("double"))
    return linear_fit(rows, "source_key", "start_s", "y").withColumns({c: r6(F.col(c)) for c in ("slope", "intercept", "r2")})


@query("density_clusters", oracle("windows", body=_LABEL + " SELECT source_key, window_idx, delay_ms, label FROM lab"))
def q_density(spark: SparkSession, sf: str) -> DataFrame:
    return clustered_windows(_accepted(spark, sf)).select("source_key", "window_idx", "delay_ms", "label")


@query("cluster_details", oracle("windows", body=_LABEL + " SELECT source_key, label, n, round(mean_ms, 6) + 0.0 AS mean_ms, round(std_ms, 6) + 0.0 AS std_ms, round(t0, 6) + 0.0 AS t0, round(t1, 6) + 0.0 AS t1, round(avg_match, 6) + 0.0 AS avg_match, min_match FROM det"))
def q_details(spark: SparkSession, sf: str) -> DataFrame:
    return cluster_details(clustered_windows(_accepted(spark, sf))).drop("members").withColumns({c: r6(F.col(c)) for c in ("mean_ms", "std_ms", "t0", "t1", "avg_match")})


def _valid(share: float, seconds: float, match: float) -> str:
    return _VALID.replace(">= 5 AS", f">= {share} AS").replace(">= 20 AS", f">= {seconds} AS").replace(">= 85 AS", f">= {match} AS")


_MODES = {"strict": (10.0, 30.0, 90.0, 2), "normal": (5.0, 20.0, 85.0, 2), "lenient": (3.0, 10.0, 75.0, 2), "custom": (1.0, 5.0, 50.0, 3)}


@query("cluster_validation", oracle("windows", body=_LABEL + "".join(_valid(*m[:3]).replace(" v AS", f" v{i} AS").replace("val AS", f"val{i} AS").replace("FROM v)", f"FROM v{i})") for i, m in enumerate(_MODES.values())) + " " + " UNION ALL ".join(f"SELECT *, passed = 3 AS valid, '{m}' AS mode FROM val{i}" for i, m in enumerate(_MODES))))
def q_validation(spark: SparkSession, sf: str) -> DataFrame:
    return validate_modes(clustered_windows(_accepted(spark, sf)), list(_MODES), _MODES["custom"])


_DIAGNOSED = """, k AS (SELECT source_key, count(*) AS clusters, count(*) FILTER (passed = 3) AS valid FROM val GROUP BY 1),
j AS (SELECT source_key, n, coalesce(clusters, 0) AS clusters, coalesce(valid, 0) AS valid, slope, r2, CASE source_key % 4 WHEN 0 THEN 25.0 ELSE 23.976 END AS fps, source_key % 2 = 0 AS lossless FROM fit LEFT JOIN k USING (source_key))
SELECT source_key, n, clusters, valid, round(slope, 6) + 0.0 AS slope, round(r2, 6) + 0.0 AS r2,
  CASE WHEN n < 6 THEN 'UNIFORM' WHEN abs(fps - 25) < 0.1 AND abs(slope - 40.9) < 5 THEN 'PAL_DRIFT' WHEN clusters > 1 THEN CASE WHEN {steps} THEN 'STEPPING' ELSE 'UNIFORM' END
    WHEN abs(slope) > CASE WHEN lossless THEN 0.2 ELSE 0.7 END AND r2 > CASE WHEN lossless THEN 0.95 ELSE 0.9 END THEN 'LINEAR_DRIFT' ELSE 'UNIFORM' END AS diagnosis FROM j"""
#: Windows on a slope for some sources: a speed-up's, one that only lossless codecs show, and one that all do; others on two levels, the rest as they are.
_SLOPED = "CASE source_key % 8 WHEN 0 THEN 40.9 * window_idx WHEN 2 THEN 0.5 * window_idx WHEN 3 THEN 2.0 * window_idx WHEN 5 THEN CASE WHEN window_idx > 25 THEN 300 ELSE 0 END WHEN 6 THEN CASE WHEN window_idx > 25 THEN 300 ELSE 0 END ELSE raw_delay_ms END"
_SLOPED_SQL = f", was AS (SELECT * FROM windows), windows2 AS (SELECT * REPLACE (window_idx::DOUBLE AS start_s, round({_SLOPED})::INT AS delay_ms, 90 + match_pct / 10 AS match_pct) FROM was)"


def _sloped(spark: SparkSession, sf: str) -> DataFrame:
    moved = windows(spark, sf).withColumns({"start_s": F.col("window_idx").cast("double"), "delay_ms": F.round(F.expr(_SLOPED)).cast("int"), "match_pct": F.col("match_pct") / 10 + 90})
    return accepted_windows(moved)


def _diagnosis(spark: SparkSession, sf: str, **modes: str) -> DataFrame:
    fps, codec = F.when(F.col("source_key") % 4 == 0, 25.0).otherwise(23.976), F.when(F.col("source_key") % 2 == 0, "A_FLAC").otherwise("A_AC3")
    return diagnose(_sloped(spark, sf), fps=fps, codec=codec, **modes).withColumns({c: r6(F.col(c)) for c in ("slope", "r2")})


def _diagnosis_sql(steps: str) -> str:
    return oracle("windows", body=_SLOPED_SQL + (_LABEL + _VALID + _FIT).replace("FROM windows", "FROM windows2") + _DIAGNOSED.format(steps=steps))


@query("diagnosis", _diagnosis_sql("valid = clusters AND valid >= 2"))
def q_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    return _diagnosis(spark, sf)


@query("diagnosis_filtered", _diagnosis_sql("valid >= 2"))
def q_diagnosis_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _diagnosis(spark, sf, correction="filtered")


@query("transition_zones", oracle("windows", body=_LABEL + """, z AS (SELECT source_key, label, t1, mean_ms, lead(t0) OVER w AS next_t0, lead(mean_ms) OVER w AS next_mean FROM det WINDOW w AS (PARTITION BY source_key ORDER BY t0, label))
SELECT source_key, label, round(t1, 6) + 0.0 AS zone_start, round(next_t0, 6) + 0.0 AS zone_end, round(next_mean - mean_ms, 6) + 0.0 AS jump_ms FROM z WHERE next_t0 IS NOT NULL"""))
def q_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return transitions(cluster_details(clustered_windows(_accepted(spark, sf)))).select("source_key", "label", *[r6(F.col(c)).alias(c) for c in ("zone_start", "zone_end", "jump_ms")])


def transition_pattern(details: DataFrame) -> DataFrame:
    """Per source the jumps between its clusters in order of their mean delay: how many, whether all go up or down, and whether their sizes are within 50 ms of the mean size."""
    order = Window.partitionBy("source_key").orderBy("mean_ms", "label")
    steps = details.select("source_key", (F.lead("mean_ms").over(order) - F.col("mean_ms")).alias("jump")).where("jump is not null")
    sized = steps.withColumn("mean_size", F.avg(F.abs("jump")).over(Window.partitionBy("source_key")))
    return sized.groupBy("source_key").agg(
        F.count("jump").alias("jumps"), F.every(F.col("jump") > 0).alias("all_up"), F.every(F.col("jump") < 0).alias("all_down"),
        (F.every(F.abs(F.abs("jump") - F.col("mean_size")) < 50) & (F.count("jump") > 1)).alias("consistent"),
    )


@query("transition_pattern", oracle("windows", body=_LABEL + """, z AS (SELECT source_key, lead(mean_ms) OVER w - mean_ms AS jump FROM det WINDOW w AS (PARTITION BY source_key ORDER BY mean_ms, label)),
y AS (SELECT *, avg(abs(jump)) OVER (PARTITION BY source_key) AS size FROM z WHERE jump IS NOT NULL)
SELECT source_key, count(jump) AS jumps, bool_and(jump > 0) AS all_up, bool_and(jump < 0) AS all_down, bool_and(abs(abs(jump) - size) < 50) AND count(jump) > 1 AS consistent FROM y GROUP BY 1"""))
def q_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return transition_pattern(cluster_details(clustered_windows(_accepted(spark, sf))))


@query("label_changes", oracle("windows", body=_LABEL + """, s AS (SELECT source_key, window_idx, label, lag(label) OVER w AS was, lag(window_idx) OVER w AS last_idx FROM lab WHERE label >= 0 WINDOW w AS (PARTITION BY source_key ORDER BY window_idx))
SELECT source_key, last_idx, window_idx, was, label FROM s WHERE was <> label"""))
def q_changes(spark: SparkSession, sf: str) -> DataFrame:
    return label_changes(clustered_windows(_accepted(spark, sf)))


@query("chunk_ranges", oracle("windows", body=_A + """, g AS (SELECT source_key, window_idx, window_idx - row_number() OVER (PARTITION BY source_key ORDER BY window_idx) AS g FROM a),
i AS (SELECT source_key, min(window_idx) AS a, max(window_idx) AS b FROM g GROUP BY source_key, g)
SELECT source_key, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM i GROUP BY 1"""))
def q_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return compress_ranges(_accepted(spark, sf), ["source_key"], "window_idx")


_UNIFORM = """, u AS (SELECT *, row_number() OVER w AS chunk, first(raw_delay_ms) OVER w AS first_ms, avg(raw_delay_ms) OVER (PARTITION BY source_key) AS mean FROM {t} WINDOW w AS (PARTITION BY source_key ORDER BY window_idx)),
us AS (SELECT source_key, count(*) AS n, count(*) > 1 AND max(raw_delay_ms) - min(raw_delay_ms) > {v} AS varies, round(max(raw_delay_ms) - min(raw_delay_ms), 4) + 0.0 AS variance_ms, round(coalesce(stddev_samp(raw_delay_ms), 0), 4) + 0.0 AS std_ms,
  round(avg(raw_delay_ms), 4) + 0.0 AS mean_ms, round(min(raw_delay_ms), 4) + 0.0 AS min_ms, round(max(raw_delay_ms), 4) + 0.0 AS max_ms, count(*) FILTER ({far}) AS outliers,
  coalesce(array_to_string((list(chunk ORDER BY chunk) FILTER ({far}))[1:10], ','), '') AS first_outliers FROM u GROUP BY 1)"""
_INSIDE = """, i AS (SELECT *, avg(raw_delay_ms) OVER (PARTITION BY source_key, label) AS mean FROM lab WHERE label >= 0),
e AS (SELECT source_key, label, count(*) AS n, avg(raw_delay_ms) AS mean_ms, max(raw_delay_ms) - min(raw_delay_ms) AS range_ms, count(*) FILTER (abs(raw_delay_ms - mean) > 1) AS outliers FROM i GROUP BY 1, 2),
cs AS (SELECT source_key, count(*) AS clusters, round(coalesce(max(range_ms) FILTER (n > 1), 0), 4) + 0.0 AS variance_ms, coalesce(max(range_ms) FILTER (n > 1), 0) > 0.0001 AS varies, coalesce(sum(outliers) FILTER (n > 1), 0)::BIGINT AS outliers,
  coalesce(string_agg(label || ':' || outliers, ',' ORDER BY label) FILTER (n > 1 AND outliers > 0), '') AS issues FROM e GROUP BY 1)"""


def _listed(found: DataFrame) -> DataFrame:
    return found.withColumn("first_outliers", F.array_join(F.col("first_outliers").cast("array<string>"), ","))


@query("stability_uniform", oracle("windows", body=_A + _UNIFORM.format(t="a", v=25, far="abs(raw_delay_ms - mean) > 1") + " SELECT * FROM us"))
def q_stability(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(uniform_stability(_accepted(spark, sf), variance_ms=25.0))


@query("stability_any", oracle("windows", body=_A + _UNIFORM.format(t="a", v=0.0001, far="abs(raw_delay_ms - first_ms) > 0.0001") + " SELECT * FROM us"))
def q_stability_any(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(uniform_stability(_accepted(spark, sf), any_mode=True))


@query("stability_clusters", oracle("windows", body=_LABEL + _INSIDE + " SELECT * FROM cs"))
def q_stability_clusters(spark: SparkSession, sf: str) -> DataFrame:
    found = cluster_stability(clustered_windows(_accepted(spark, sf)))
    return found.withColumn("issues", F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["label"].cast("string"), i["outliers"].cast("string"))), ","))


@query("stability", oracle("windows", body=_LABEL + _INSIDE + ", k AS (SELECT source_key, count(*) AS n, count(DISTINCT label) FILTER (label >= 0) AS k FROM lab GROUP BY 1), w AS (SELECT * FROM a WHERE source_key IN (SELECT source_key FROM k WHERE k <= 1))" + _UNIFORM.format(t="w", v=0.0001, far="abs(raw_delay_ms - mean) > 1") + """
SELECT source_key, k.n, varies, variance_ms, outliers, true AS is_stepping FROM cs JOIN k USING (source_key) WHERE k > 1 AND k.n >= 3 UNION ALL SELECT source_key, n, varies, variance_ms, outliers, false FROM us WHERE n >= 3"""))
def q_stability_all(spark: SparkSession, sf: str) -> DataFrame:
    return sync_stability(_accepted(spark, sf))


_GATE = """, s AS (SELECT source_key, count(*) AS total, count(*) FILTER (accepted) AS n, median(delay_ms) FILTER (accepted) AS m, stddev_pop(delay_ms) FILTER (accepted) AS d FROM windows GROUP BY 1)
SELECT source_key, n, CASE WHEN n < greatest(10, trunc(total * 85.0 / 100)) THEN 'insufficient_accepted' WHEN abs(m - 10) > {m} THEN 'median_mismatch' WHEN d > {d} THEN 'unstable' ELSE 'passed' END AS reason FROM s"""


@query("quality_gate", oracle("windows", body=_GATE.format(m=20, d=15)))
def q_gate(spark: SparkSession, sf: str) -> DataFrame:
    return quality_gate(windows(spark, sf), base_ms=10.0, percent=85.0)


@query("quality_gate_skip", oracle("windows", body=_GATE.format(m=100, d=500)))
def q_gate_skip(spark: SparkSession, sf: str) -> DataFrame:
    return quality_gate(windows(spark, sf), base_ms=10.0, percent=85.0, skip=True)


@query("tempo_ratios", oracle("windows", body=_A + _FIT + " SELECT source_key, round(1000 / (1000 + slope), 6) + 0.0 AS tempo, abs(slope) > 0.5 AS applied, round(CASE WHEN abs(slope) > 0.5 THEN 1000 / (1000 + slope) ELSE 1 END, 6) + 0.0 AS segment_tempo, round((24000.0 / 1001) / 25, 6) AS pal_tempo FROM fit"))
def q_tempo(spark: SparkSession, sf: str) -> DataFrame:
    """The speeds that undo drift."""
    rows = _accepted(spark, sf).withColumn("y", F.col("delay_ms").cast("double"))
    tempo = F.lit(1000.0) / (F.col("slope") + 1000.0)
    applied = F.abs("slope") > 0.5
    return linear_fit(rows, "source_key", "start_s", "y").select("source_key", r6(tempo).alias("tempo"), applied.alias("applied"), r6(F.when(applied, tempo).otherwise(1.0)).alias("segment_tempo"), F.round(F.lit(24000.0 / 1001 / 25), 6).alias("pal_tempo"))
