"""Queries of grid hashes: an embedding of 64 numbers is a grid of 8 by 8 pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashes import grid_hashes, nearest_difference
from tidemark.plans.registry import query
from tidemark.session import table


def grids(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, pixels): embeddings around middle grey."""
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * 256) + 128, F.lit(255)), F.lit(0)).cast("int")).alias("pixels"))


_SINC = "CASE WHEN d = 0 THEN 1 WHEN abs(d) >= 3 THEN 0 ELSE sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) END"
# Pixels x of row y; weights of 8 pixels for 9 and for 32 places; resampled grids as sums of weights, and waves as sums over rows, then columns.
_SQL = f"""WITH g AS MATERIALIZED (SELECT vec_id, y, x, greatest(least(floor(embedding[y * 8 + x + 1]::DOUBLE * 256) + 128, 255), 0) AS p FROM embeddings, range(8) a(y), range(8) b(x)),
d AS (SELECT n, o, x, x - ((o + 0.5) * 8.0::DOUBLE / n - 0.5) AS d FROM (VALUES (9), (32)) v(n), range(32) t(o), range(8) u(x) WHERE o < n AND x >= floor((o + 0.5) * 8.0::DOUBLE / n - 3) AND x < ceil((o + 0.5) * 8.0::DOUBLE / n + 3)),
w AS MATERIALIZED (SELECT n, o, x, {_SINC} / sum({_SINC}) OVER (PARTITION BY n, o) AS w FROM d),
r9 AS MATERIALIZED (SELECT vec_id, y, o, greatest(least(floor(round(sum(p * w), 9) + 0.5), 255), 0) AS p FROM g JOIN w USING (x) WHERE n = 9 GROUP BY ALL),
dh AS (SELECT a.vec_id, a.y * 8 + a.o AS i, a.p < b.p AS bit FROM r9 a JOIN r9 b ON a.vec_id = b.vec_id AND a.y = b.y AND b.o = a.o + 1),
ah AS (SELECT vec_id, y * 8 + x AS i, p >= avg(p) OVER (PARTITION BY vec_id) AS bit FROM g),
v AS MATERIALIZED (SELECT vec_id, o AS y, g.x, sum(p * w) AS p FROM g JOIN w ON w.x = g.y AND n = 32 GROUP BY ALL),
r32 AS MATERIALIZED (SELECT vec_id, y, o AS x, greatest(least(floor(round(sum(p * w), 9) + 0.5), 255), 0) AS p FROM v JOIN w USING (x) WHERE n = 32 GROUP BY ALL),
c AS MATERIALIZED (SELECT k, i, cos((2 * i + 1) * k * pi() / 64) AS c FROM range(8) a(k), range(32) b(i)),
h AS MATERIALIZED (SELECT vec_id, k, x, sum(p * c) AS p FROM r32 JOIN c ON i = y GROUP BY ALL),
f AS (SELECT vec_id, h.k * 8 + c.k AS i, round(sum(p * c), 6) AS p FROM h JOIN c ON c.i = x GROUP BY ALL),
ph AS (SELECT vec_id, i, p > (median(p) FILTER (i > 0) OVER (PARTITION BY vec_id)) AS bit FROM f),
bits AS (SELECT 'dhash' AS method, * FROM dh UNION ALL SELECT 'average_hash', * FROM ah UNION ALL SELECT 'phash', * FROM ph),
digits AS (SELECT method, vec_id, i // 4 AS j, sum(CASE WHEN bit THEN 1 << (3 - i % 4) ELSE 0 END)::INT AS digit FROM bits GROUP BY ALL),
hex AS (SELECT method, vec_id, string_agg(printf('%x', digit), '' ORDER BY j) AS hex FROM digits GROUP BY ALL),
n AS (SELECT a.vec_id, sum(CASE WHEN a.p < b.p THEN CASE WHEN y * 8 + i = 63 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << (y * 8 + i)::HUGEINT END ELSE 0 END)::BIGINT AS nearest
  FROM (SELECT vec_id, y, i, p FROM g, range(9) t(i) WHERE x = i * 8 // 9) a JOIN (SELECT vec_id, y, i - 1 AS i, p FROM g, range(9) t(i) WHERE x = i * 8 // 9) b USING (vec_id, y, i) GROUP BY 1)
SELECT n.vec_id, nearest, max(hex) FILTER (method = 'dhash') AS dhash, max(hex) FILTER (method = 'average_hash') AS average_hash, max(hex) FILTER (method = 'phash') AS phash FROM n JOIN hex USING (vec_id) GROUP BY 1, 2"""


@query("grid_hashes", _SQL)
def q_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """F01, F03 over all embeddings."""
    return grid_hashes(grids(spark, sf), "pixels", 8, 8).select("vec_id", nearest_difference(F.col("pixels"), 8, 8).alias("nearest"), "dhash", "average_hash", "phash")
