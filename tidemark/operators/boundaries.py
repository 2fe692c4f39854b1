"""Splice points of stepping corrections (U09): for each transition a quiet zone, a zero crossing near its middle, and a keyframe inside it, each found by a lateral join on what was found before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.clusters import _LABEL, _accepted, cluster_details, clustered_windows, transitions
from tidemark.operators.signals import levels, rms_db_int, runs, zone_score
from tidemark.operators.timeline import to_reference, to_target
from tidemark.plans.fixtures import keyframes, oracle, pcm, r6
from tidemark.plans.registry import query
from tidemark.session import shared_path

#: What a search reads of a signal; searches that read the same share it.
SPAN = ("signal", "first", "last")


@dataclass(frozen=True)
class Search:
    """Settings of the search; rate is the samples' rate in Hz."""

    rate: float
    window_s: float = 5.0
    threshold_db: float = -40.0
    min_ms: float = 100.0
    jump_db: float = 8.0
    depth_weight: float = 10.0
    length_weight: float = 2.0
    level_s: float = 0.05
    jump_s: float = 0.01
    margin_s: float = 0.05
    crossing_ms: float = 2.0
    snap_s: float = 2.0

    @property
    def bin(self) -> int:
        """Samples in a bin by which searches and samples meet: a search's own length, so that it meets few samples beyond its own."""
        return self.samples(2 * self.window_s)

    def samples(self, seconds: float) -> int:
        """Whole samples in a time, one at least."""
        return max(int(seconds * self.rate), 1)


def _kept(frame: DataFrame) -> DataFrame:
    """frame, written to the shared folder and read back: a row for each transition or so, which the next steps read more than once."""
    path = shared_path(frame.sparkSession, "boundaries")
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def inside(ranges: DataFrame, samples: DataFrame, first: str, last: str, width: int) -> DataFrame:
    """ranges(signal, first, last, ...) with each sample(signal, sample_idx, v) from first up to but not including last; met by bins of so many samples."""
    bins = F.explode(F.sequence(F.floor(F.col(first) / width), F.floor((F.col(last) - 1) / width)))
    asked = ranges.where(F.col(first) < F.col(last)).withColumn("__bin", bins)
    binned = samples.select("signal", F.floor(F.col("sample_idx") / width).alias("__bin"), "sample_idx", "v")
    return asked.join(binned, ["signal", "__bin"]).where((F.col("sample_idx") >= F.col(first)) & (F.col("sample_idx") < F.col(last))).drop("__bin")


def searches(steps: DataFrame, samples: DataFrame, search: Search) -> DataFrame:
    """steps(boundary, signal, ref_start_s, ref_end_s, before_ms, after_ms) with their middle on the target's timeline and the samples around it: target_s, from_s, to_s, first, last, n."""
    middle = to_target((F.col("ref_start_s") + F.col("ref_end_s")) / 2, F.col("before_ms"))
    lengths = samples.groupBy("signal").agg((F.max("sample_idx") + 1).alias("n"))
    placed = steps.withColumn("target_s", middle).withColumns({"from_s": F.greatest(F.col("target_s") - search.window_s, F.lit(0.0)), "to_s": F.col("target_s") + search.window_s}).join(lengths, "signal")
    return placed.withColumns({"first": (F.col("from_s") * search.rate).cast("long"), "last": F.least(F.greatest(F.col("to_s"), F.lit(0.0)) * search.rate, F.col("n")).cast("long")})


def _levels(asked: DataFrame, samples: DataFrame, search: Search) -> DataFrame:
    """(signal, first, last, size, w, db): levels of the whole windows of both sizes, counted from the start of each span that is searched."""
    sizes = F.array(F.lit(search.samples(search.level_s)), F.lit(search.samples(search.jump_s)))
    each = inside(asked.select(*SPAN).distinct(), samples, "first", "last", search.bin).withColumn("size", F.explode(sizes))
    window = F.floor((F.col("sample_idx") - F.col("first")) / F.col("size"))
    whole = each.where(window < F.floor((F.col("last") - F.col("first")) / F.col("size")))
    square = F.col("v").cast("double") * F.col("v").cast("double")
    return whole.groupBy(*SPAN, "size", window.alias("w")).agg(rms_db_int(F.avg(square)).alias("db"))


def _long_enough(start: Column, end: Column, search: Search) -> Column:
    return ((end - start) * search.rate).cast("long") >= int(search.min_ms / 1000 * search.rate)


def quiet_zones(levels_: DataFrame, search: Search) -> DataFrame:
    """(signal, first, last, start_s, end_s, mean_db): runs of windows below the threshold; one that the span cuts off ends with its last sample."""
    size = search.samples(search.level_s)
    order = Window.partitionBy(*SPAN).orderBy("w")  # a span has as many windows as the search's settings say
    low = levels_.where((F.col("size") == size) & (F.col("db") < search.threshold_db)).withColumn("g", F.col("w") - F.row_number().over(order))
    found = low.groupBy(*SPAN, "g").agg(F.min("w").alias("a"), F.max("w").alias("b"), F.avg("db").alias("mean_db"))
    cut = F.col("b") + 1 == F.floor((F.col("last") - F.col("first")) / size)
    start, end = (F.col("first") + F.col("a") * size) / search.rate, F.when(cut, F.col("last")).otherwise(F.col("first") + (F.col("b") + 1) * size) / search.rate
    return found.select(*SPAN, start.alias("start_s"), end.alias("end_s"), "mean_db").where(_long_enough(F.col("start_s"), F.col("end_s"), search))


def speech_gaps(asked: DataFrame, gaps: DataFrame, search: Search) -> DataFrame:
    """(boundary, signal, n, start_s, end_s): what a search holds of the target's gaps(signal, start_s, end_s) between speech. Gaps and searches meet by bins of time."""
    width = search.bin / search.rate
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    left = asked.select("boundary", "signal", "n", "from_s", "to_s").where("to_s >= from_s").withColumn("bin", bins(F.col("from_s"), F.col("to_s")))
    right = gaps.select("signal", F.col("start_s").alias("g0"), F.col("end_s").alias("g1")).withColumn("bin", bins(F.col("g0"), F.col("g1")))
    start, end = F.greatest("from_s", "g0"), F.least("to_s", "g1")
    met = left.join(right, ["signal", "bin"]).where((start < end) & (F.floor(start / width) == F.col("bin")))
    return met.select("boundary", "signal", "n", start.alias("start_s"), end.alias("end_s")).where((F.col("end_s") - F.col("start_s")) * 1000 >= search.min_ms)


def candidates(asked: DataFrame, samples: DataFrame, gaps: DataFrame | None, search: Search) -> DataFrame:
    """(boundary, source, preference, start_s, end_s, mean_db, jumps, score) of all zones of a search: quiet and without speech, quiet, or without speech."""
    levels_ = _kept(_levels(asked, samples, search))
    spans = asked.select("boundary", *SPAN)
    quiet = spans.join(quiet_zones(levels_, search), list(SPAN)).drop(*SPAN)
    zones = quiet.select("boundary", F.lit("rms").alias("source"), "start_s", "end_s", "mean_db")
    if gaps is not None:
        silent = speech_gaps(asked, gaps, search)
        start, end = F.greatest("start_s", "g0"), F.least("end_s", "g1")
        both = quiet.join(silent.select("boundary", F.col("start_s").alias("g0"), F.col("end_s").alias("g1")), "boundary").where(start < end)  # inside one search, so bounded
        zones = zones.unionByName(both.select("boundary", F.lit("combined").alias("source"), start.alias("start_s"), end.alias("end_s"), "mean_db"))
        ranged = silent.withColumns({"a": (F.col("start_s") * search.rate).cast("long"), "b": F.least(F.col("end_s") * search.rate, F.col("n")).cast("long")})
        square = F.col("v").cast("double") * F.col("v").cast("double")
        heard = inside(ranged.select("signal", "a", "b").distinct(), samples, "a", "b", search.bin).groupBy("signal", "a", "b").agg(rms_db_int(F.avg(square)).alias("mean_db"))
        own = ranged.join(heard, ["signal", "a", "b"], "left").select("boundary", F.lit("vad").alias("source"), "start_s", "end_s", F.coalesce("mean_db", F.lit(-96.0)).alias("mean_db"))
        zones = zones.unionByName(own)
    size = search.samples(search.jump_s)
    order = Window.partitionBy(*SPAN).orderBy("w")
    steps = levels_.where(F.col("size") == size).withColumn("jump", F.col("db") - F.lag("db").over(order)).where(F.col("jump") >= search.jump_db)
    times = spans.join(steps, list(SPAN)).select("boundary", ((F.col("first") + F.col("w") * size) / search.rate).alias("time_s"))
    near = (F.col("time_s") >= F.col("start_s") - search.margin_s) & (F.col("time_s") <= F.col("end_s") + search.margin_s)
    counted = zones.join(times, "boundary").where(near).groupBy("boundary", "source", "start_s", "end_s").agg(F.count(F.lit(1)).alias("jumps"))
    scored = zones.join(counted, ["boundary", "source", "start_s", "end_s"], "left").fillna(0, ["jumps"]).join(asked.select("boundary", "target_s"), "boundary")
    score = zone_score((F.col("start_s") + F.col("end_s")) / 2, F.col("target_s"), F.col("mean_db"), F.col("end_s") - F.col("start_s"), F.col("jumps"), search.window_s, search.threshold_db, search.depth_weight, search.length_weight)
    preference = F.when(F.col("source") == "combined", 0).when(F.col("source") == "rms", 1).otherwise(2)
    speech = F.max(F.col("source") == "vad").over(Window.partitionBy("boundary"))
    return scored.select("boundary", "source", preference.alias("preference"), "start_s", "end_s", "mean_db", "jumps", F.round(score, 6).alias("score"), speech.alias("has_gaps"))


def refine(steps: DataFrame, samples: DataFrame, search: Search, gaps: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """steps(boundary, signal, track, ref_start_s, ref_end_s, before_ms, after_ms), boundary unique, with the point at which to splice.

    samples(signal, sample_idx, v) are whole numbers against 32-bit full scale, gaps
    (signal, start_s, end_s) what a speech detector left, keys(track, key_s) the
    reference's keyframes. The best zone is searched around the middle of the step on the
    target's timeline; the middle of the zone, or of the step if there is none, moves to
    the nearest zero crossing, the earlier of two; a keyframe near that, the earlier of
    two, is taken if it lies in the zone. A signal without samples gives no rows. Gives
    zone_start, zone_end, source, mean_db, score, near_jump, over_speech, crossed_s, key_s,
    snap (none, accepted, rejected), splice_s and ref_s.
    """
    asked = _kept(searches(steps, samples, search))
    zones = _kept(candidates(asked, samples, gaps, search))
    # outer columns have names of their own, as a name that the inner table also has would be taken from there
    best = zones.where(F.col("boundary") == F.col("wanted").outer()).orderBy("preference", F.desc("score"), "start_s").limit(1)
    best = best.select(F.col("start_s").alias("zone_start"), F.col("end_s").alias("zone_end"), "source", "mean_db", "score", (F.col("jumps") > 0).alias("near_jump"), ((F.col("source") == "rms") & F.col("has_gaps")).alias("over_speech"))
    middle = F.coalesce((F.col("zone_start") + F.col("zone_end")) / 2, F.col("target_s"))
    radius = search.samples(search.crossing_ms / 1000)
    at = F.greatest(F.col("middle_s") * search.rate, F.lit(0.0)).cast("long")
    found = asked.withColumn("wanted", F.col("boundary")).lateralJoin(best, how="left").withColumn("middle_s", middle)
    found = _kept(found.withColumn("at", at).withColumns({"low": F.greatest(F.col("at") - radius, F.lit(0)), "high": F.col("at") + radius + 1}))
    # only the samples around the middles are looked at; a crossing is a sign change to the next sample, or a zero
    near = inside(found.select("boundary", "signal", "low", "high", "at"), samples, "low", "high", search.bin)
    after = F.lead("v").over(Window.partitionBy("boundary").orderBy("sample_idx"))  # at most 2 * radius + 1 samples
    signs = near.withColumn("next", after).where("next IS NOT NULL AND ((v > 0 AND next <= 0) OR (v < 0 AND next >= 0) OR v = 0)")
    crossing = signs.where(F.col("boundary") == F.col("wanted").outer()).select(F.abs(F.col("sample_idx") - F.col("at")).alias("apart"), F.col("sample_idx").alias("crossing")).orderBy("apart", "crossing").limit(1)
    crossed = found.lateralJoin(crossing, how="left").drop("apart").withColumn("crossed_s", F.coalesce(F.col("crossing") / search.rate, F.col("middle_s")))
    crossed = crossed.withColumn("asked_s", to_reference(F.col("crossed_s"), F.col("before_ms")))
    if keys is None:
        snapped = crossed.withColumn("key_s", F.lit(None).cast("double"))
    else:
        crossed = _kept(crossed)
        around = F.explode(F.array(*[F.floor(F.col("asked_s") / search.snap_s) + d for d in (-1, 0, 1)]))
        binned = keys.select("track", "key_s", F.floor(F.col("key_s") / search.snap_s).alias("bin"))
        # keyframes meet the steps by track and bin before the search: what it compares with an outer column but by = is held against all of them
        met = crossed.select("boundary", "track", "asked_s", around.alias("bin")).join(binned, ["track", "bin"])
        reached = met.select("boundary", "key_s", F.abs(F.col("key_s") - F.col("asked_s")).alias("apart")).where(F.col("apart") <= search.snap_s)
        nearest = reached.where(F.col("boundary") == F.col("wanted").outer()).select("key_s", "apart").orderBy("apart", "key_s").limit(1)
        snapped = crossed.lateralJoin(nearest, how="left").drop("apart")
    moved = to_target(F.col("key_s"), F.col("before_ms"))
    moves = F.col("key_s").isNotNull() & (F.abs(F.col("key_s") - F.col("asked_s")) > 1e-10) & F.col("zone_start").isNotNull()
    snap = F.when(moves & moved.between(F.col("zone_start"), F.col("zone_end")), "accepted").when(moves, "rejected").otherwise("none")
    ended = snapped.withColumn("snap", snap).withColumn("splice_s", F.when(F.col("snap") == "accepted", moved).otherwise(F.col("crossed_s")))
    return ended.withColumn("ref_s", to_reference(F.col("splice_s"), F.col("before_ms"))).drop("n", "first", "last", "at", "low", "high", "crossing", "asked_s", "middle_s", "from_s", "to_s", "wanted")


#: The query's clips have 320 samples a second and some six seconds; times of the tables' month, and keyframes of its seven years, are scaled to that.
_SEARCH = Search(rate=320.0, window_s=0.4, threshold_db=-21.0, snap_s=0.25)
_MONTH, _YEARS = 430_000.0, 35_000_000.0
_SIGNALS = ("click", "error", "purchase", "signup", "view")


def wave(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of pcm around zero as whole numbers: (signal, sample_idx, v)."""
    return pcm(spark, sf).select("signal", "sample_idx", ((F.col("value") - 0.1) * 2147483647).cast("long").alias("v"))


@query("boundary_refinement", oracle("windows", "pcm", "keyframes", body=_LABEL + f""", wave AS MATERIALIZED (SELECT signal, sample_idx, trunc((value - 0.1) * 2147483647)::BIGINT AS v FROM pcm),
len AS (SELECT signal, max(sample_idx) + 1 AS n FROM wave GROUP BY 1),
z AS (SELECT source_key, label, t1, mean_ms, lead(t0) OVER w AS next_t0, lead(mean_ms) OVER w AS next_mean FROM det WINDOW w AS (PARTITION BY source_key ORDER BY t0, label)),
s0 AS (SELECT source_key, label, {list(_SIGNALS)}[source_key % 5 + 1] AS signal, mean_ms AS before_ms, next_mean AS after_ms, (t1 / {_MONTH} + next_t0 / {_MONTH}) / 2 - mean_ms / 1000.0::DOUBLE AS target_s FROM z WHERE next_t0 IS NOT NULL),
s AS MATERIALIZED (SELECT *, source_key * 1000 + label AS boundary, greatest(target_s - 0.4, 0) AS from_s, target_s + 0.4 AS to_s, trunc(greatest(target_s - 0.4, 0) * 320)::BIGINT AS first, trunc(least(greatest(target_s + 0.4, 0) * 320, n))::BIGINT AS last FROM s0 JOIN len USING (signal)),
lv AS MATERIALIZED (SELECT boundary, size, (sample_idx - first) // size AS w, greatest(CASE WHEN sqrt(avg(v::DOUBLE * v) / power(2147483648.0, 2)) < 1e-12 THEN -96 ELSE 20 * log10(sqrt(avg(v::DOUBLE * v) / power(2147483648.0, 2))) END, -96) AS db
  FROM s JOIN wave USING (signal), (VALUES (16), (3)) t(size) WHERE sample_idx >= first AND sample_idx < last AND (sample_idx - first) // size < (last - first) // size GROUP BY ALL),
q AS (SELECT *, w - row_number() OVER (PARTITION BY boundary ORDER BY w) AS g FROM lv WHERE size = 16 AND db < -21),
quiet AS (SELECT boundary, (any_value(first) + min(w) * 16) / 320.0::DOUBLE AS a, CASE WHEN max(w) + 1 = (any_value(last) - any_value(first)) // 16 THEN any_value(last) ELSE any_value(first) + (max(w) + 1) * 16 END / 320.0::DOUBLE AS b, avg(db) AS mean_db
  FROM q JOIN s USING (boundary) GROUP BY boundary, g HAVING trunc((CASE WHEN max(w) + 1 = (any_value(last) - any_value(first)) // 16 THEN any_value(last) ELSE any_value(first) + (max(w) + 1) * 16 END / 320.0::DOUBLE - (any_value(first) + min(w) * 16) / 320.0::DOUBLE) * 320) >= 32),
blk AS (SELECT signal, sample_idx // 16 AS block, 20 * log10(sqrt(avg(value * value))) AS db FROM pcm GROUP BY 1, 2 HAVING count(*) = 16),
gp AS (SELECT signal, block, block - row_number() OVER (PARTITION BY signal ORDER BY block) AS g FROM blk WHERE db < -18),
gap AS (SELECT signal, min(block) * 0.05::DOUBLE AS g0, (max(block) + 1) * 0.05::DOUBLE AS g1 FROM gp GROUP BY signal, g HAVING count(*) >= 2),
vad AS (SELECT boundary, signal, n, greatest(from_s, g0) AS a, least(to_s, g1) AS b FROM s JOIN gap USING (signal) WHERE greatest(from_s, g0) < least(to_s, g1) AND (least(to_s, g1) - greatest(from_s, g0)) * 1000 >= 100),
zones AS (SELECT boundary, 1 AS p, a, b, mean_db FROM quiet
  UNION ALL SELECT boundary, 0, greatest(x.a, y.a), least(x.b, y.b), mean_db FROM quiet x JOIN vad y USING (boundary) WHERE greatest(x.a, y.a) < least(x.b, y.b)
  UNION ALL SELECT boundary, 2, a, b, coalesce((SELECT 20 * log10(sqrt(avg(v::DOUBLE * v) / power(2147483648.0, 2))) FROM wave WHERE wave.signal = vad.signal AND sample_idx >= trunc(a * 320) AND sample_idx < trunc(least(b * 320, n))), -96) FROM vad),
j AS (SELECT boundary, (first + w * 3) / 320.0::DOUBLE AS t FROM (SELECT boundary, w, db - lag(db) OVER (PARTITION BY boundary ORDER BY w) AS jump FROM lv WHERE size = 3) JOIN s USING (boundary) WHERE jump >= 8),
cand AS (SELECT *, (SELECT count(*) FROM j WHERE j.boundary = zones.boundary AND t >= a - 0.05 AND t <= b + 0.05) AS jumps FROM zones),
sc AS (SELECT cand.*, round(greatest((0.4 - abs((a + b) / 2 - target_s)) / 0.4, 0) * 5 + greatest((-21 - mean_db) / 10, 0) * 10 + least(b - a, 1) * 2 - 3 * jumps, 6) AS score, max(p) OVER (PARTITION BY boundary) = 2 AS has_gaps FROM cand JOIN s USING (boundary)),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY boundary ORDER BY p, score DESC, a) = 1),
f AS (SELECT s.*, p, a, b, mean_db, score, jumps > 0 AS near_jump, p = 1 AND has_gaps AS over_speech, coalesce((a + b) / 2, target_s) AS middle, trunc(greatest(coalesce((a + b) / 2, target_s) * 320, 0))::BIGINT AS spot FROM s LEFT JOIN best USING (boundary)),
x AS (SELECT signal, sample_idx FROM (SELECT signal, sample_idx, v, lead(v) OVER (PARTITION BY signal ORDER BY sample_idx) AS after FROM wave) WHERE (v > 0 AND after <= 0) OR (v < 0 AND after >= 0) OR (v = 0 AND after IS NOT NULL)),
m AS (SELECT f.*, coalesce((SELECT arg_min(sample_idx, (abs(sample_idx - spot), sample_idx)) FROM x WHERE x.signal = f.signal AND sample_idx >= spot - 1 AND sample_idx + 1 <= spot + 1) / 320.0::DOUBLE, middle) AS crossed_s FROM f),
k AS (SELECT m.*, crossed_s + before_ms / 1000.0::DOUBLE AS asked_s, (SELECT arg_min(y.key_s, (abs(y.key_s - (crossed_s + before_ms / 1000.0::DOUBLE)), y.key_s)) FROM (SELECT track, key_ns / 1e9 / {_YEARS} AS key_s FROM keyframes) y WHERE y.track = m.source_key AND abs(y.key_s - (crossed_s + before_ms / 1000.0::DOUBLE)) <= 0.25) AS key_s FROM m),
e AS (SELECT *, CASE WHEN key_s IS NULL OR abs(key_s - asked_s) <= 1e-10 OR a IS NULL THEN 'none' WHEN key_s - before_ms / 1000.0::DOUBLE BETWEEN a AND b THEN 'accepted' ELSE 'rejected' END AS snap FROM k),
o AS (SELECT *, CASE WHEN snap = 'accepted' THEN key_s - before_ms / 1000.0::DOUBLE ELSE crossed_s END AS splice FROM e)
SELECT source_key, label, signal, CASE p WHEN 0 THEN 'combined' WHEN 1 THEN 'rms' WHEN 2 THEN 'vad' END AS source, round(a, 6) + 0.0 AS zone_start, round(b, 6) + 0.0 AS zone_end, round(mean_db, 6) + 0.0 AS mean_db, score + 0.0 AS score, near_jump, over_speech,
  round(crossed_s, 6) + 0.0 AS crossed_s, snap, round(splice, 6) + 0.0 AS splice_s, round(splice + before_ms / 1000.0::DOUBLE, 6) + 0.0 AS ref_s FROM o"""))
def q_refinement(spark: SparkSession, sf: str) -> DataFrame:
    """U09 over all steps between clusters, each source on one of the signals, with the gaps between loud blocks as speech gaps and the source's number as keyframe track."""
    steps = transitions(cluster_details(clustered_windows(_accepted(spark, sf))))
    names = F.array(*map(F.lit, _SIGNALS))
    placed = steps.select(
        (F.col("source_key") * 1000 + F.col("label")).alias("boundary"), "source_key", "label", F.get(names, (F.col("source_key") % 5).cast("int")).alias("signal"), F.col("source_key").alias("track"),
        (F.col("zone_start") / _MONTH).alias("ref_start_s"), (F.col("zone_end") / _MONTH).alias("ref_end_s"), "before_ms", "after_ms",
    )
    blocks = levels(pcm(spark, sf))
    gaps = runs(blocks, F.col("db") < -18, 2).select("signal", (F.col("first") * 0.05).alias("start_s"), ((F.col("last") + 1) * 0.05).alias("end_s"))
    keys = keyframes(spark, sf).select("track", (F.col("key_ns") / 1e9 / _YEARS).alias("key_s"))
    found = refine(placed, wave(spark, sf), _SEARCH, gaps, keys)
    rounded = [r6(F.col(c)).alias(c) for c in ("zone_start", "zone_end", "mean_db", "score", "crossed_s", "splice_s", "ref_s")]
    return found.select("source_key", "label", "signal", "source", "near_jump", "over_speech", "snap", *rounded)
