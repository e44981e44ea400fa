"""Stream sketches over orders as a stream of customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches as K
from . import views as V
from .registry import query

BLOOM, FM, SAMPLE, SLOTS = 1999, 1 << 16, 100, [0, 20, 40, 60, 80]


def _h(size: int, col: str = "item") -> list[str]:
    return [f"(({a} * {col} + {b}) % {K.PRIME}) % {size}" for a, b in K.COEFFICIENTS]


@query("SELECT batch, count(*) AS n, min(seq) AS first, max(seq) AS last FROM st GROUP BY batch", "st")
def stream_batches(spark, d):
    return V.batches(spark, d).groupBy("batch").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


@query("SELECT batch, count(*) AS n, count(DISTINCT item) AS n_distinct FROM st GROUP BY batch", "st")
def batch_distinct(spark, d):
    return K.batch_distinct(V.batches(spark, d))


@query()
def hll_distinct(spark, d):
    return K.hll_distinct(V.batches(spark, d))


@query("SELECT batch, CAST(coalesce(k, 0) AS BIGINT) AS new_items, CAST(sum(coalesce(k, 0)) OVER (ORDER BY batch) AS BIGINT) AS total FROM (SELECT DISTINCT batch FROM st) LEFT JOIN (SELECT batch, count(*) AS k FROM (SELECT item, min(batch) AS batch FROM st GROUP BY item) GROUP BY batch) USING (batch)", "st")
def cumulative_distinct(spark, d):
    return K.cumulative_distinct(V.batches(spark, d))


_FIRST = "SELECT item, min(batch) AS first FROM st GROUP BY item"
_BITS = " UNION ALL ".join(f"SELECT item, first, {h} AS bit FROM ft" for h in _h(BLOOM))
_BLOOM = f""", ft AS MATERIALIZED ({_FIRST}), ps AS MATERIALIZED ({_BITS}), bs AS (SELECT bit, min(first) AS s FROM ps GROUP BY bit),
kn AS (SELECT item, max(s) AS s, min(first) AS first FROM ps JOIN bs USING (bit) GROUP BY item),
x AS (SELECT batch, count(*) AS n, count(*) FILTER (s < batch) AS positives, count(*) FILTER (s < batch AND first >= batch) AS false_positives FROM st JOIN kn USING (item) GROUP BY batch)
SELECT *, round(false_positives / nullif(n - positives + false_positives, 0), 6) AS fpr FROM x"""


@query()
def bloom_filter_fpr(spark, d):
    return K.bloom_fpr(V.batches(spark, d), BLOOM)


def _tz(h: str) -> str:
    return f"CASE WHEN {h} = 0 THEN 0 ELSE length(bin({h})) - length(rtrim(bin({h}), '0')) END"


_FM = "SELECT batch, count(DISTINCT item) AS truth, CAST(round((" + " + ".join(f"power(2.0, max({_tz(h)}))" for h in _h(FM)) + f") / {len(K.COEFFICIENTS)}) AS BIGINT) AS estimate FROM st GROUP BY batch"


@query(_FM, "st")
def fm_estimate(spark, d):
    return K.flajolet_martin(V.batches(spark, d), FM)


@query(f"SELECT round(sum(estimate) / sum(truth), 6) AS ratio FROM ({_FM})", "st")
def fm_ratio(spark, d):
    return K.fm_ratio(K.flajolet_martin(V.batches(spark, d), FM))


_DRAWS = f"SELECT n, item, CASE WHEN n <= {SAMPLE} THEN n - 1 ELSE ((69621 * n + 7) % 2147483647) % {SAMPLE} END AS slot FROM (SELECT seq + 1 AS n, item FROM st) WHERE n <= {SAMPLE} OR ((48271 * n + 11) % 2147483647 % 1000003) * n < {SAMPLE * 1000003}"


@query(f"SELECT slot, arg_max(item, n) AS item, max(n) AS n FROM ({_DRAWS}) GROUP BY slot", "st")
def reservoir_sample(spark, d):
    return K.reservoir(V.stream(spark, d), "seq", "item", SAMPLE)


@query(f"SELECT e.n AS n, {', '.join(f'arg_max(item, w.n) FILTER (slot = {k}) AS s_{k}' for k in SLOTS)} FROM (SELECT DISTINCT ((seq + {SAMPLE}) // {SAMPLE}) * {SAMPLE} AS n FROM st) e JOIN ({_DRAWS}) w ON w.n <= e.n GROUP BY e.n", "st")
def reservoir_trace(spark, d):
    return K.reservoir_trace(V.stream(spark, d), "seq", "item", SAMPLE, SAMPLE, SLOTS)


def _register_bloom() -> None:
    from .registry import SQL, WITH

    SQL["bloom_filter_fpr"] = f"WITH st AS MATERIALIZED ({WITH['st']})" + _BLOOM


_register_bloom()
